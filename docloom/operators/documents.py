"""Relational reads, statistics and state changes over a document table.

A document table has id, filename, status, document_type, ocr_confidence, classification_confidence,
file_size, retry_count, upload_timestamp, processing_started_at, processing_completed_at. Tables are
immutable: a change is a function from the table and its changes to the next table.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("pending", "processing", "completed", "failed", "needs_review")
TYPES = ("invoice", "receipt", "medical", "legal", "financial", "identity", "correspondence", "unknown")


def check_page(page: int, page_size: int) -> None:
    if page < 1 or not 1 <= page_size <= 100:
        raise ValueError("page starts at 1 and page_size is 1 to 100")


def point_lookup(docs: DataFrame, key) -> DataFrame:
    return docs.filter(F.col("id") == key)


def with_metadata(docs: DataFrame, meta: DataFrame) -> DataFrame:
    """Each document with its metadata row, or nulls: metadata is unique by document_id."""
    return docs.join(meta, docs["id"] == meta["document_id"], "left").drop("document_id")


def selected(docs: DataFrame, status: str | None = None, document_type: str | None = None) -> DataFrame:
    if status is not None:
        docs = docs.filter(F.col("status") == status)
    if document_type is not None:
        docs = docs.filter(F.col("document_type") == document_type)
    return docs


def list_page(docs: DataFrame, status: str | None = None, document_type: str | None = None, page: int = 1, page_size: int = 20) -> DataFrame:
    """One page, newest first; equal times in order of id."""
    check_page(page, page_size)
    rows = selected(docs, status, document_type).orderBy(F.col("upload_timestamp").desc_nulls_last(), "id")
    return rows.offset((page - 1) * page_size).limit(page_size)


def page_counts(docs: DataFrame, page_size: int, status: str | None = None) -> DataFrame:
    n = F.count("*")
    return selected(docs, status).agg(n.alias("total"), F.ceil(n / page_size).cast("long").alias("total_pages"))


def metrics(docs: DataFrame, as_of: date) -> DataFrame:
    """All dashboard figures in one scan. Zero averages of seconds become null, as on the dashboard."""
    status = lambda s: F.count_if(F.col("status") == s)
    today = F.count_if(F.to_date("upload_timestamp") == F.lit(as_of))
    return docs.agg(
        F.count("id").alias("total_documents"),
        status("completed").alias("processed_documents"),
        status("pending").alias("pending_documents"),
        status("failed").alias("failed_documents"),
        status("needs_review").alias("needs_review"),
        F.coalesce(F.avg("ocr_confidence"), F.lit(0.0)).alias("average_ocr_confidence"),
        F.nullif(F.avg(seconds()), F.lit(0.0)).alias("average_processing_time"),
        today.alias("documents_today"),
        (today * 7).alias("documents_this_week"),
        F.count_if((F.to_date("upload_timestamp") <= F.lit(as_of)) & (F.to_date("upload_timestamp") > F.date_sub(F.lit(as_of), 7))).alias("documents_last_7_days"),
    )


def seconds() -> Column:
    """Processing time; null unless both ends are known."""
    return (F.unix_micros(F.col("processing_completed_at").cast("timestamp")) - F.unix_micros(F.col("processing_started_at").cast("timestamp"))) / 1e6


def set_status(docs: DataFrame, changes: DataFrame, now) -> DataFrame:
    """changes: id, status, error. Processing stamps the start; completed and failed stamp the end."""
    c = changes.select("id", F.col("status").alias("_status"), F.col("error").alias("_error"))
    ends = F.col("_status").isin("completed", "failed")
    return docs.join(c, "id", "left").select(
        *[
            {
                "status": F.coalesce("_status", "status"),
                "processing_started_at": F.when(F.col("_status") == "processing", F.lit(now)).otherwise(F.col("processing_started_at")),
                "processing_completed_at": F.when(ends, F.lit(now)).otherwise(F.col("processing_completed_at")),
            }.get(k, F.col(k)).alias(k)
            for k in docs.columns
            if k != "error_log"
        ],
        F.coalesce(F.nullif("_error", F.lit("")), F.col("error_log") if "error_log" in docs.columns else F.lit(None)).alias("error_log"),
    )


def final_status(text: Column, flagged: Column, confidence: Column, threshold: float) -> Column:
    """failed for blank text, needs_review when flagged or under the threshold, else completed."""
    blank = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "") == ""
    return F.when(blank, "failed").when(flagged | (confidence < threshold), "needs_review").otherwise("completed")


def newest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row for each key, the first in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with rows of changes in place of rows of the same key; changes are unique by key."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes)


def pending(files: DataFrame, key: str, *columns: str) -> DataFrame:
    """New document rows, still to be processed: id, what is known of the file, status and tries."""
    return files.select(F.col(key).alias("id"), *columns, F.lit("pending").alias("status"), F.lit(0).alias("retry_count"))


def ocr_rows(results: DataFrame, key: str, found: Column, page: Column | None = None) -> DataFrame:
    """One row for each of the texts that were found on a page; pages that are not told are the first."""
    number = F.coalesce(page, F.lit(1)) if page is not None else F.lit(1)
    return results.select(key, number.cast("int").alias("page_number"), F.explode(found).alias("text"))


def recognised(docs: DataFrame, results: DataFrame) -> DataFrame:
    """results: id, text, confidence, page_count. Text and confidence are replaced; a page count that is null or 0 leaves
    the old one. The search index follows by `reindexed`."""
    r = results.select("id", F.col("text").alias("_text"), F.col("confidence").alias("_confidence"), F.nullif("page_count", F.lit(0)).alias("_pages"), F.lit(True).alias("_seen"))
    new = {"raw_text": "_text", "ocr_confidence": "_confidence"}
    out = docs.join(r, "id", "left")
    made = {c: F.when(F.col("_seen"), F.col(n)).otherwise(F.col(c)) for c, n in new.items()} | {"page_count": F.coalesce("_pages", "page_count")}
    return out.select(*[made.get(c, F.col(c)).alias(c) for c in docs.columns])


def reindexed(index: DataFrame, docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The search index (id, lexeme, positions) with the rows of changed documents made anew; others are not read again."""
    from docloom.functions.stem import lexemes

    new = lexemes(docs.join(changed.select("id"), "id", "left_semi"), "id", "raw_text")
    return index.join(changed.select("id"), "id", "left_anti").unionByName(new)


def classified(docs: DataFrame, results: DataFrame) -> DataFrame:
    """results: id, document_type, confidence: both are replaced."""
    r = results.select("id", F.col("document_type").alias("_type"), F.col("confidence").alias("_confidence"), F.lit(True).alias("_seen"))
    made = {"document_type": "_type", "classification_confidence": "_confidence"}
    return docs.join(r, "id", "left").select(*[(F.when(F.col("_seen"), F.col(made[c])).otherwise(F.col(c)) if c in made else F.col(c)).alias(c) for c in docs.columns])


def reviewed(docs: DataFrame, reviews: DataFrame, at=None) -> DataFrame:
    """reviews: id, document_type (null: as it was), and if there are such columns by (who) and data (the fields as
    corrected). A review completes; a type from it is certain."""
    has = set(reviews.columns)
    r = reviews.select("id", F.col("document_type").alias("_type"), F.lit(True).alias("_seen"), *[F.col(c).alias(f"_{c}") for c in ("by", "data") if c in has])
    out = docs.join(r, "id", "left")
    return out.select(
        "id",
        F.when(F.col("_seen"), "completed").otherwise(F.col("status")).alias("status"),
        F.coalesce("_type", "document_type").alias("document_type"),
        F.when(F.col("_type").isNotNull(), 1.0).otherwise(F.col("classification_confidence")).alias("classification_confidence"),
        F.coalesce("_seen", F.lit(False)).alias("is_validated"),
        *([F.col("_by").alias("validated_by"), F.when(F.col("_seen"), F.lit(at)).alias("validated_at")] if "by" in has else []),
        *([F.coalesce("_data", *(["data"] if "data" in docs.columns else [])).alias("data")] if "data" in has else []),
    )


def deleted(tables: dict[str, DataFrame], keys: dict[str, str], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the documents in gone (one column id)."""
    return {name: df.join(gone.select(F.col("id").alias(keys[name])), keys[name], "left_anti") for name, df in tables.items()}


def reprocess(docs: DataFrame, ids: DataFrame) -> DataFrame:
    again = ids.select("id", F.lit(True).alias("_again"))
    out = docs.join(again, "id", "left")
    return out.select("id", F.when(F.col("_again"), "pending").otherwise(F.col("status")).alias("status"), (F.col("retry_count") + F.coalesce(F.col("_again").cast("int"), F.lit(0))).alias("retry_count"))


def duplicate_texts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Groups of equal text (case and white space aside) of more than one row."""
    norm = F.regexp_replace(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), r"\s+", " ")
    groups = rows.select(F.col(key).alias("_key"), F.sha2(norm, 256).alias("_digest")).groupBy("_digest").agg(F.count("*").alias("n"), F.min("_key").alias("first_id"))
    groups = groups.filter("n > 1")  # digests are shuffled, and then the text of one row of each group alone
    return rows.select(F.col(key).alias("first_id"), norm.alias("norm")).join(groups, "first_id").filter(F.sha2("norm", 256).eqNullSafe(F.col("_digest"))).dropDuplicates(["first_id", "_digest"]).select("norm", "n", "first_id")
