"""A corpus pipeline over `documents`: each stage works on all that the one before it kept.

Every stage but the last returns the columns of documents. Stages are written as Parquet in the shared
folder and read again, so a lost executor never costs more than the stage it worked on.

Defined cases, for each stage: columns other than doc_id and text may be null or have any name, and pass through;
an empty table stays empty. A null or empty text is not toxic, near nothing, repeats nothing and holds no benchmark
item, and packs as the end id alone. Rows without doc_id are kept by near-duplicate removal and judged like any other by
all other stages. Rows that share a doc_id are documents of their own. Of rows that repeat id and text,
the toxicity, near-duplicate and benchmark stages keep all or none; the suffix stage leaves the text of one if it is
long enough to be a passage. Ties: of a group of near copies the smallest doc_id stays; of a repeated passage the first by
doc_id and place. Very long texts are read whole by every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import decontam, neardup, packing, suffix, tokens, toxicity
from docloom.llm.common import Stage
from docloom.session import table

#: Least length in bytes of a passage that counts as repeated: passages of over 50 words are longer.
PASSAGE = 200
CAPACITY = 2048


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from this stage's labelled rows, rejects go; null texts stay."""
    return toxicity.flag(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays: that of the smallest doc_id."""
    return neardup.drop_near_duplicates(docs, k=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated passages are cut, characters whole; texts of which nothing is left go, empty ones stay; n_chars follows."""
    return suffix.cut_repeats(docs, PASSAGE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item (four fifths of its five-word shingles) go, with or without doc_id."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left and their places in sequences of at most 2048 ids."""
    return packing.pack(docs, tokens.default_path(), CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: Learning, MinHash and packing have no SQL; each stage is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, step in STAGES[:-1]:
        docs = stage.write(step(spark, docs, sf_dir), name)
        if before:
            stage.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
