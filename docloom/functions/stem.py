"""English lexemes: stop words out, suffixes off (Porter's algorithm, 1980)."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import tokens

# English stop words.
STOP_WORDS = frozenset(
    """a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down
    during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my
    myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them
    themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you
    your yours yourself yourselves""".split()
)
# The suffix tables of the algorithm's second to fourth steps.
STEP_2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"


def _shape(stem: str) -> str:
    """Letters as c and v; y is a vowel after a consonant."""
    out = ""
    for k, c in enumerate(stem):
        out += "v" if c in "aeiou" or (c == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _closed(stem: str) -> bool:
    return len(stem) > 2 and _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _replaced(word: str, table: str) -> str:
    for old, new in sorted((x.split(":") for x in table.split()), key=lambda p: -len(p[0])):
        if word.endswith(old):
            stem = word[: -len(old)]
            return stem + new if _measure(stem) > 0 else word
    return word


@lru_cache(200_000)
def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _closed(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, STEP_2), STEP_3)
    ends = [e for e in (*STEP_4.split(), "ion") if w.endswith(e)]
    if ends:
        end = max(ends, key=len)
        left = w[: -len(end)]
        if _measure(left) > 1 and (end != "ion" or left.endswith(("s", "t"))):
            w = left
    if w.endswith("e"):
        left = w[:-1]
        if _measure(left) > 1 or (_measure(left) == 1 and not _closed(left)):
            w = left
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def stems(word: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda w: None if w is None else stem(w))

    return run(word)


def lexemes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lexeme, positions): stemmed postings without stop words. Each distinct word is stemmed once."""
    words = docs.select(key, F.posexplode(tokens(F.col(text))).alias("pos", "word")).filter(~F.col("word").isin(*sorted(STOP_WORDS)))
    table = words.select("word").distinct().withColumn("lexeme", stems(F.col("word")))
    return words.join(table, "word").groupBy(key, "lexeme").agg(F.sort_array(F.collect_list(F.col("pos") + 1)).alias("positions"))
