"""Text primitives as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
PUNCTUATION = ".,!?;:\"'()[]{}"


def tokens(text: Column) -> Column:
    """Words of letters, digits and underscores, in order, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"))


def trigrams(text: Column) -> Column:
    """The distinct three-character pieces."""
    n = F.length(text)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def trigram_recall(keyword: str, grams: Column) -> Column:
    own = sorted({keyword[i : i + 3] for i in range(len(keyword) - 2)})
    return F.size(F.array_intersect(F.array(*map(F.lit, own)), grams)) / F.lit(float(len(own)))


def bigrams(words: Column) -> Column:
    """Neighbouring words joined by a blank."""
    return F.when(F.size(words) >= 2, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat(F.element_at(words, i), F.lit(" "), F.element_at(words, i + 1)))).otherwise(F.array().cast("array<string>"))


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length; two empty strings are equal."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / n)


def character_error_rate(truth: Column, read: Column) -> Column:
    return F.levenshtein(truth, read) / F.length(truth)


def word_error_rate(truth: Column, read: Column) -> Column:
    """Edits between words for each word of the truth; null for an empty truth."""
    def rate(a: str | None, b: str | None) -> float | None:
        x, y = (a or "").split(), (b or "").split()
        row = list(range(len(y) + 1))
        for i, w in enumerate(x, 1):
            new = [i]
            for j, v in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != v)))
            row = new
        return row[-1] / len(x) if x else None

    @F.pandas_udf("double")
    def rates(t: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([rate(a, b) for a, b in zip(t, r, strict=True)], dtype="float64")

    return rates(truth, read)


def sound_code(word: Column) -> Column:
    """A four-character sound code in which vowels, H and W separate equal codes."""
    w = F.upper(word)
    d = F.translate(w, "AEIOUYHWBFPVCGJKQSXZDTLMNR", "00000000111122222222334556")
    for k in "0123456":
        d = F.regexp_replace(d, f"{k}+", k)
    rest = F.replace(F.substring(d, F.lit(2), F.length(d)), F.lit("0"))
    return F.when(F.length(word) > 0, F.rpad(F.concat(F.substring(w, 1, 1), rest), 4, "0"))


def clean_word(word: Column) -> Column:
    return F.lower(F.btrim(word, F.lit(PUNCTUATION)))


def clipped(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def human_bytes(n: Column) -> Column:
    """1536 as 1.5 KB."""
    k = F.when(n < 1024, 0).when(n < 1 << 20, 1).when(n < 1 << 30, 2).otherwise(3)
    unit = F.element_at(F.array(*map(F.lit, ("Bytes", "KB", "MB", "GB"))), k + 1)
    return F.when(n == 0, "0 Bytes").otherwise(F.concat(F.round(n / F.pow(F.lit(1024.0), k), 2).cast("string"), F.lit(" "), unit))


def ago(seconds: Column) -> Column:
    unit = lambda n, s: F.concat(F.floor(seconds / n).cast("string"), F.lit(s))
    return F.when(seconds < 60, "just now").when(seconds < 3600, unit(60, "m ago")).when(seconds < 86400, unit(3600, "h ago")).otherwise(unit(86400, "d ago"))
