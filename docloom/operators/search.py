"""Full-text search, JSON-field search, numeric ranges and suggestions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.stem import STOP_WORDS, stem, stems
from docloom.functions.text import TOKEN, clean_word, tokens
from docloom.operators.documents import check_page


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lexeme, positions), positions from 1: the inverted index, to be written sorted by lexeme.

    Texts are dealt out by key and their words grouped where they lie, so a text is shuffled once and its words never.
    """
    words = docs.select(key, text).repartition(key).select(key, F.posexplode(tokens(F.col(text))).alias("pos", "lexeme"))
    return words.groupBy(key, "lexeme").agg(F.sort_array(F.collect_list(F.col("pos") + 1)).alias("positions"))


def words_of(q: str) -> list[str]:
    import regex

    return sorted(set(regex.findall(TOKEN, q.lower())))


def lexemes_of(q: str) -> list[str]:
    """The stems that a document must hold to answer q: stop words ask for nothing."""
    return sorted({stem(w) for w in words_of(q) if w not in STOP_WORDS})


def search(docs: DataFrame, q: str, key: str, text: str, page: int = 1, page_size: int = 20, total: bool = False, only: Column | None = None) -> DataFrame:
    """Documents that hold every lexeme of q, by frequency of its lexemes; a q of stop words finds nothing.

    `only` restricts documents by type, status, date or whatever they have. Words can share a stem only if they
    share its first letters but the last two, so a scan looks at these alone; the words found are stemmed once
    each, and documents are ranked by counts that were added up before they were shuffled.
    """
    check_page(page, page_size)
    wanted = lexemes_of(q)
    if not wanted:
        return docs.select(F.lit(0).cast("long").alias("total")).limit(0).agg(F.count("*").alias("total")) if total else docs.select(key, F.lit(0).alias("rank")).limit(0)
    rows = docs if only is None else docs.filter(only)
    likely = "|".join(sorted({re.escape(w[: max(1, len(w) - 2)]) for w in wanted}))
    hits = rows.select(F.col(key).alias("_key"), F.explode(F.filter(tokens(F.col(text)), lambda w: w.rlike(f"^(?:{likely})") & ~w.isin(*sorted(STOP_WORDS)))).alias("_w"))
    hits = hits.groupBy("_key", "_w").agg(F.count("*").alias("_n")).withColumn("_l", stems(F.col("_w"))).filter(F.col("_l").isin(wanted))
    found = hits.groupBy("_key").agg(F.sum("_n").alias("rank"), F.countDistinct("_l").alias("_k")).filter(F.col("_k") == len(wanted))
    if total:
        return found.agg(F.count("*").alias("total"))
    return found.select(F.col("_key").alias(key), "rank").orderBy(F.desc("rank"), key).offset((page - 1) * page_size).limit(page_size)


def search_postings(index: DataFrame, q: str, key: str, page: int = 1, page_size: int = 20) -> DataFrame:
    """The same over a written index (key, lexeme, positions) of `stem.lexemes`: only the rows of q's lexemes are read."""
    check_page(page, page_size)
    wanted = lexemes_of(q)
    hits = index.filter(F.col("lexeme").isin(wanted)).groupBy(key).agg(F.sum(F.size("positions")).alias("rank"), F.countDistinct("lexeme").alias("_k"))
    return hits.filter((F.col("_k") == len(wanted)) & F.lit(bool(wanted))).select(key, "rank").orderBy(F.desc("rank"), key).offset((page - 1) * page_size).limit(page_size)


def snippet(text: Column, q: str, words: int = 20) -> Column:
    """Up to so many words around the first hit, hits marked."""
    any_ = "|".join(words_of(q)) or "(?!)"
    around = F.regexp_extract(text, rf"(?iU)((?:\S+\s+){{0,{words // 2}}}\S*\b(?:{any_})\b\S*(?:\s+\S+){{0,{words // 2}}}+)", 1)
    return F.regexp_replace(around, rf"(?iU)\b({any_})\b", "<mark>$1</mark>")


def json_like(meta: DataFrame, data: str, field: str, value: str) -> DataFrame:
    """Rows whose JSON field contains value; % and _ in it are wildcards, letter case does not count."""
    return meta.filter(F.get_json_object(data, f"$.{field}").ilike(f"%{value}%"))


def json_range(meta: DataFrame, data: str, field: str, low: float | None = None, high: float | None = None, strict: bool = False) -> DataFrame:
    """Rows whose JSON number lies in the range, with it as `amount`; strict raises for other text."""
    if low is None and high is None:
        raise ValueError("one bound is needed")
    raw = F.get_json_object(data, f"$.{field}")
    amount = raw.cast("decimal(38,9)") if strict else raw.try_cast("decimal(38,9)")
    rows = meta.withColumn("amount", amount).filter("amount is not null")
    if low is not None:
        rows = rows.filter(F.col("amount") >= low)
    return rows.filter(F.col("amount") <= high) if high is not None else rows


def suggestions(docs: DataFrame, text: str, partial: str, limit: int = 10) -> DataFrame:
    """Words of at least three characters that begin with partial, in order."""
    if len(partial) < 2 or not 1 <= limit <= 50:
        raise ValueError("two characters at least, and a limit of 1 to 50")
    w = docs.select(F.explode(F.split(text, " ")).alias("word")).select(clean_word(F.col("word")).alias("word"))
    return w.filter((F.length("word") >= 3) & F.col("word").startswith(partial.lower())).distinct().orderBy("word").limit(limit)
