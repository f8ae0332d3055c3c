"""Queries of sources, validation, reads, statistics and state changes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from docloom.operators import documents as D
from docloom.operators import files as V
from docloom.plans.bindings import CATALOGUE_SQL, catalogue
from docloom.plans.catalog import query
from docloom.session import table

AS_OF = dt.date(1995, 3, 15)
NOW = dt.datetime(2024, 1, 1)
WITH = "WITH " + CATALOGUE_SQL + " "
EXT = "lower(regexp_extract(filename, '[^/.](\\.[^./]*)$', 1))"
MIME = "CASE " + EXT + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.MIME_BY_EXTENSION.items()) + " END"


def docs(spark, sf_dir):
    return catalogue(table(spark, sf_dir, "orders"))


# --- files ---------------------------------------------------------------------------------------
@query("S2_mime_type", WITH + f"SELECT id, filename, {MIME} AS mime FROM d")
def s2(spark, sf_dir):
    return docs(spark, sf_dir).select("id", "filename", V.mime_type(F.col("filename")).alias("mime"))


@query("S3_text_hash", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def s3(spark, sf_dir):
    t = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t, 256).alias("sha256"), F.md5(t).alias("md5"))


@query("S4_size_extension", WITH + f"SELECT id, file_size, {EXT} AS extension FROM d")
def s4(spark, sf_dir):
    return docs(spark, sf_dir).select("id", "file_size", V.extension(F.col("filename")).alias("extension"))


@query(
    "S5_safe_filename",
    """WITH u AS (SELECT page_id, translate(regexp_extract(url, '([^/]*)$', 1), '<>:"/\\|?*', '_________') AS base FROM pages),
    e AS (SELECT *, regexp_extract(base, '[^.](\\.[^.]*)$', 1) AS ext FROM u)
    SELECT page_id, CASE WHEN length(base) > 200 THEN concat(substr(base, 1, 200 - length(ext)), ext) ELSE base END AS safe FROM e""",
)
def s5(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", V.safe_name(F.col("url")).alias("safe"))


@query("S7_cleanup_plan", WITH + "SELECT count(*) AS files, CAST(sum(file_size) AS DOUBLE) / 1048576 AS mb FROM d WHERE upload_timestamp < TIMESTAMP '1995-03-15' - INTERVAL 30 DAY")
def s7(spark, sf_dir):
    old = V.expired(docs(spark, sf_dir), "upload_timestamp", dt.datetime(1995, 3, 15), 30)
    return old.agg(F.count("*").alias("files"), (F.sum("file_size").cast("double") / 1048576).alias("mb"))


@query("S10_text_layer", "SELECT conv_id, nullif(string_agg(text, '\n\n' ORDER BY turn, text) FILTER (trim(text) <> ''), '') AS text FROM conversations GROUP BY conv_id")
def s10(spark, sf_dir):
    from docloom.sources.readers import text_layer

    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("page"), "text")
    return text_layer(c).withColumnRenamed("path", "conv_id")


@query("S14_backfill_created", WITH + "SELECT id, coalesce(processing_started_at, upload_timestamp) AS created_at FROM d")
def s14(spark, sf_dir):
    return docs(spark, sf_dir).select("id", F.coalesce("processing_started_at", "upload_timestamp").alias("created_at"))


@query("V1_size_limit", WITH + "SELECT id, file_size <= 52428800 AS ok FROM d")
def v1(spark, sf_dir):
    return docs(spark, sf_dir).select("id", (F.col("file_size") <= V.MAX_MB * 1024 * 1024).alias("ok"))


@query("V2_type_allowed", WITH + f"SELECT id, {EXT} IN ({', '.join(repr(k) for k in V.MIME_BY_EXTENSION)}) AS ok FROM d")
def v2(spark, sf_dir):
    return docs(spark, sf_dir).select("id", V.extension(F.col("filename")).isin(*V.MIME_BY_EXTENSION).alias("ok"))


@query(
    "V3_validate_upload",
    WITH
    + f""", m AS (SELECT id, file_size, {EXT} AS e, coalesce({MIME}, 'application/octet-stream') AS mime FROM d)
    SELECT id, mime, (e IN ({', '.join(repr(k) for k in V.MIME_BY_EXTENSION)})) AND file_size <= 52428800 AS valid,
    CASE WHEN file_size > 52428800 THEN 'too large' WHEN NOT (e IN ({', '.join(repr(k) for k in V.MIME_BY_EXTENSION)})) THEN 'type not allowed' END AS error,
    mime = 'application/pdf' AS is_pdf, starts_with(mime, 'image/') AS is_image FROM m""",
)
def v3(spark, sf_dir):
    return V.validated(docs(spark, sf_dir), "filename", "file_size").select("id", "mime", "valid", "error", "is_pdf", "is_image")


@query(
    "V4_page_range",
    """WITH r AS (SELECT l_orderkey, l_linenumber, greatest(l_linenumber - 2, 1) AS s, CASE WHEN l_suppkey % 9 - 1 = -1 OR l_suppkey % 9 - 1 > 5 THEN 5 ELSE l_suppkey % 9 - 1 END AS e FROM lineitem)
    SELECT l_orderkey, l_linenumber, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, s > 5 OR e < s AS bad FROM r""",
)
def v4(spark, sf_dir):
    s, e, bad = V.page_range(F.col("l_linenumber") - 2, F.col("l_suppkey") % 9 - 1, F.lit(5))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", s.cast("long").alias("s"), e.cast("long").alias("e"), bad.alias("bad"))


# --- reads ---------------------------------------------------------------------------------------
@query("Q1_point_lookup", WITH + "SELECT id, filename, status, document_type FROM d WHERE id = 7")
def q1(spark, sf_dir):
    return D.point_lookup(docs(spark, sf_dir), 7).select("id", "filename", "status", "document_type")


@query("Q2_with_metadata", "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q2(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    m = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "document_id")
    return D.with_metadata(d, m).withColumnRenamed("id", "doc_id").select("doc_id", "lang", "quality", "toxic")


@query("Q3_list_documents", WITH + "SELECT id, filename, status, upload_timestamp FROM d WHERE status = 'completed' AND document_type = 'invoice' ORDER BY upload_timestamp DESC NULLS LAST, id LIMIT 20 OFFSET 40")
def q3(spark, sf_dir):
    return D.list_page(docs(spark, sf_dir), "completed", "invoice", 3, 20).select("id", "filename", "status", "upload_timestamp")


@query("Q4_page_counts", WITH + "SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM d WHERE status = 'completed'")
def q4(spark, sf_dir):
    return D.page_counts(docs(spark, sf_dir), 20, "completed")


@query("Q5_review_queue", WITH + "SELECT id, upload_timestamp FROM d WHERE status = 'needs_review' ORDER BY upload_timestamp DESC NULLS LAST, id LIMIT 20")
def q5(spark, sf_dir):
    return D.list_page(docs(spark, sf_dir), "needs_review").select("id", "upload_timestamp")


@query("Q6_ocr_rows", "SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, CASE WHEN role = 'system' THEN NULL ELSE role END NULLS LAST, text) AS pos FROM conversations")
def q6(spark, sf_dir):
    from pyspark.sql import Window

    seq = F.when(F.col("role") != "system", F.col("role"))
    w = Window.partitionBy("conv_id").orderBy("turn", seq.asc_nulls_last(), "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.row_number().over(w).cast("long").alias("pos"))


@query("Q7_ocr_response", "SELECT conv_id, count(*) AS n, coalesce(avg(length(text)), 0.0) AS average, string_agg(text, '|' ORDER BY coalesce(turn, 1), text) AS joined FROM conversations GROUP BY conv_id")
def q7(spark, sf_dir):
    parts = F.sort_array(F.collect_list(F.struct(F.coalesce("turn", F.lit(1)).alias("p"), "text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.coalesce(F.avg(F.length("text")), F.lit(0.0)).alias("average"), F.array_join(F.transform(parts, lambda x: x["text"]), "|").alias("joined"))


@query("Q8_status", WITH + "SELECT id, status, coalesce(document_type, 'unknown') AS document_type, coalesce(ocr_confidence, 0.0) AS ocr_confidence, retry_count FROM d")
def q8(spark, sf_dir):
    return docs(spark, sf_dir).select("id", "status", F.coalesce("document_type", F.lit("unknown")).alias("document_type"), F.coalesce("ocr_confidence", F.lit(0.0)).alias("ocr_confidence"), "retry_count")


@query("Q9_filename_filter", WITH + "SELECT id, filename FROM d WHERE contains(lower(filename), '7.png') AND status = 'completed' AND document_type = 'medical'")
def q9(spark, sf_dir):
    return D.selected(docs(spark, sf_dir), "completed", "medical").filter(F.lower("filename").contains("7.png")).select("id", "filename")


@query("Q10_recent_five", WITH + "SELECT id, upload_timestamp FROM d ORDER BY upload_timestamp DESC NULLS LAST, id LIMIT 5")
def q10(spark, sf_dir):
    return D.list_page(docs(spark, sf_dir), page_size=5).select("id", "upload_timestamp")


# --- statistics ----------------------------------------------------------------------------------
@query("A1_total", WITH + "SELECT count(id) AS total FROM d")
def a1(spark, sf_dir):
    return docs(spark, sf_dir).agg(F.count("id").alias("total"))


@query("A2_status_counts", WITH + "SELECT status, count(*) AS n FROM d GROUP BY status")
def a2(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query("A3_average_confidence", WITH + "SELECT round(coalesce(avg(ocr_confidence), 0.0), 9) AS average FROM d")
def a3(spark, sf_dir):
    return docs(spark, sf_dir).agg(F.round(F.coalesce(F.avg("ocr_confidence"), F.lit(0.0)), 9).alias("average"))


SECONDS = "(epoch_us(processing_completed_at) - epoch_us(processing_started_at)) / 1000000.0"


@query("A4_average_seconds", WITH + f"SELECT round(nullif(avg({SECONDS}), 0), 6) AS average FROM d")
def a4(spark, sf_dir):
    return docs(spark, sf_dir).agg(F.round(F.nullif(F.avg(D.seconds()), F.lit(0.0)), 6).alias("average"))


@query("A5_documents_today", WITH + "SELECT count(*) FILTER (CAST(upload_timestamp AS DATE) = DATE '1995-03-15') AS n FROM d")
def a5(spark, sf_dir):
    return docs(spark, sf_dir).agg(F.count_if(F.to_date("upload_timestamp") == F.lit(AS_OF)).alias("n"))


@query("A6_week_estimate", WITH + "SELECT 7 * count(*) FILTER (CAST(upload_timestamp AS DATE) = DATE '1995-03-15') AS n FROM d")
def a6(spark, sf_dir):
    return D.metrics(docs(spark, sf_dir), AS_OF).select(F.col("documents_this_week").alias("n"))


@query(
    "A7_dashboard_metrics",
    WITH
    + f"""SELECT count(id) AS total_documents, count(*) FILTER (status = 'completed') AS processed_documents, count(*) FILTER (status = 'pending') AS pending_documents,
    count(*) FILTER (status = 'failed') AS failed_documents, count(*) FILTER (status = 'needs_review') AS needs_review, round(coalesce(avg(ocr_confidence), 0.0), 9) AS average_ocr_confidence,
    round(nullif(avg({SECONDS}), 0), 6) AS average_processing_time, count(*) FILTER (CAST(upload_timestamp AS DATE) = DATE '1995-03-15') AS documents_today,
    7 * count(*) FILTER (CAST(upload_timestamp AS DATE) = DATE '1995-03-15') AS documents_this_week,
    count(*) FILTER (CAST(upload_timestamp AS DATE) <= DATE '1995-03-15' AND CAST(upload_timestamp AS DATE) > DATE '1995-03-08') AS documents_last_7_days FROM d""",
)
def a7(spark, sf_dir):
    return D.metrics(docs(spark, sf_dir), AS_OF).withColumns({"average_ocr_confidence": F.round("average_ocr_confidence", 9), "average_processing_time": F.round("average_processing_time", 6)})


@query("A8_type_distribution", WITH + "SELECT coalesce(document_type, 'unknown') AS document_type, count(*) AS n, count(document_type) AS n_known FROM d GROUP BY 1")
def a8(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(F.coalesce("document_type", F.lit("unknown")).alias("document_type")).agg(F.count("*").alias("n"), F.count("document_type").alias("n_known"))


@query("A9_histogram", "SELECT CAST(floor(value / 5) AS BIGINT) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def a9(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("value is not null").groupBy(F.floor(F.col("value") / 5).alias("bin")).agg(F.count("*").alias("n"))


@query("A10_daily_volume", WITH + "SELECT strftime(upload_timestamp, '%Y-%m-%d') AS day, count(*) AS n FROM d GROUP BY 1")
def a10(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(F.date_format("upload_timestamp", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("A11_kpi_means", WITH + "SELECT round(avg(ocr_confidence) * 100, 6) AS ocr, round(avg(classification_confidence) * 100, 6) AS classification FROM d")
def a11(spark, sf_dir):
    return docs(spark, sf_dir).agg(F.round(F.avg("ocr_confidence") * 100, 6).alias("ocr"), F.round(F.avg("classification_confidence") * 100, 6).alias("classification"))


@query("A12_client_stats", WITH + f"SELECT CASE WHEN count(*) = 0 THEN 0.0 ELSE round(count(*) FILTER (status = 'completed') * 100.0 / count(*), 1) END AS success_rate, round(avg({SECONDS}) FILTER (status = 'completed'), 6) AS mean_seconds FROM d")
def a12(spark, sf_dir):
    done = F.col("status") == "completed"
    rate = F.when(F.count("*") == 0, 0.0).otherwise(F.round(F.count_if(done) * F.lit(100.0) / F.count("*"), 1))
    return docs(spark, sf_dir).agg(rate.alias("success_rate"), F.round(F.avg(F.when(done, D.seconds())), 6).alias("mean_seconds"))


@query("A13_queue", "SELECT count(*) FILTER (event_type IN ('view', 'click')) AS depth, count(DISTINCT user_id % 8) FILTER (event_type = 'click') AS workers FROM events")
def a13(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.agg(F.count_if(F.col("event_type").isin("view", "click")).alias("depth"), F.count_distinct(F.when(F.col("event_type") == "click", F.col("user_id") % 8)).alias("workers"))


@query(
    "A15_page_rollup",
    """WITH p AS (SELECT conv_id, turn, string_agg(text, ' ' ORDER BY text) AS text, avg(length(text)) AS m FROM conversations GROUP BY conv_id, turn)
    SELECT conv_id, string_agg(text, '\n\n' ORDER BY turn) AS text, round(avg(m), 6) AS average, avg(m) < 60 AS needs_review FROM p GROUP BY conv_id""",
)
def a15(spark, sf_dir):
    page = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("text"), F.avg(F.length("text")).alias("m"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return page.groupBy("conv_id").agg(F.array_join(parts, "\n\n").alias("text"), F.round(F.avg("m"), 6).alias("average"), (F.avg("m") < 60).alias("needs_review"))


@query("A16_duplicate_texts", "SELECT md5(regexp_replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g')) AS h, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def a16(spark, sf_dir):
    return D.duplicate_texts(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.md5("norm").alias("h"), "n", "first_id")


@query("A17_ghosts", WITH + "SELECT id, filename FROM d WHERE document_type = 'unknown' AND classification_confidence = 0.0")
def a17(spark, sf_dir):
    return docs(spark, sf_dir).filter("document_type = 'unknown' AND classification_confidence = 0.0").select("id", "filename")


@query(
    "A18_field_scores",
    WITH
    + """SELECT round(0.4 * f + 0.4 * o + 0.2 * h, 6) AS composite, round(f, 6) AS coverage, round(h, 6) AS high FROM (SELECT count(document_type) * 100.0 / count(*) AS f,
    avg(ocr_confidence) * 100 AS o, count(*) FILTER (ocr_confidence >= 0.8) * 100.0 / count(*) AS h FROM d) x""",
)
def a18(spark, sf_dir):
    s = docs(spark, sf_dir).agg((F.count("document_type") * 100.0 / F.count("*")).alias("f"), (F.avg("ocr_confidence") * 100).alias("o"), (F.count_if(F.col("ocr_confidence") >= 0.8) * 100.0 / F.count("*")).alias("h"))
    return s.select(F.round(0.4 * F.col("f") + 0.4 * F.col("o") + 0.2 * F.col("h"), 6).alias("composite"), F.round("f", 6).alias("coverage"), F.round("h", 6).alias("high"))


# --- writes --------------------------------------------------------------------------------------
@query("W1_insert_pending", "SELECT doc_id AS id, 'pending' AS status, 0 AS retry_count FROM documents")
def w1(spark, sf_dir):
    return D.pending(table(spark, sf_dir, "documents"), "doc_id")


@query(
    "W2_upsert_metadata",
    """WITH n AS (SELECT doc_id, quality, toxic FROM labels)
    SELECT doc_id, 0 AS quality, 0 AS toxic FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT doc_id, quality, toxic FROM n""",
)
def w2(spark, sf_dir):
    base = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    new = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    return D.upsert(base, new, "doc_id")


@query("W3_insert_ocr_rows", "SELECT doc_id, CAST(1 AS INT) AS page_number, unnest(string_split(text, chr(10))) AS line FROM documents")
def w3(spark, sf_dir):
    return D.ocr_rows(table(spark, sf_dir, "documents"), "doc_id", F.split("text", "\n")).withColumnRenamed("text", "line")


@query(
    "W4_set_status",
    WITH
    + """SELECT id, CASE WHEN id % 5 = 0 THEN 'processing' WHEN id % 5 = 1 THEN 'completed' ELSE status END AS status,
    CASE WHEN id % 5 = 0 THEN TIMESTAMP '2024-01-01' ELSE processing_started_at END AS processing_started_at,
    CASE WHEN id % 5 = 1 THEN TIMESTAMP '2024-01-01' ELSE processing_completed_at END AS processing_completed_at FROM d""",
)
def w4(spark, sf_dir):
    d = docs(spark, sf_dir)
    changes = d.filter("id % 5 < 2").select("id", F.when(F.col("id") % 5 == 0, "processing").otherwise("completed").alias("status"), F.lit("").alias("error"))
    return D.set_status(d, changes, NOW).select("id", "status", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("processing_started_at", "processing_completed_at")])


def texts_of(spark, sf_dir):
    """documents with the texts of a first recognition, and what a second one gives for some of them."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("old words").alias("raw_text"), F.lit(0.5).alias("ocr_confidence"), F.lit(1).alias("page_count"))
    again = table(spark, sf_dir, "documents").filter("doc_id % 4 <> 3")
    return d, again.select(F.col("doc_id").alias("id"), "text", F.lit(0.9).alias("confidence"), (F.col("doc_id") % 3).cast("int").alias("page_count"))


@query("W5_ocr_update", "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 9 ELSE length(text) END AS n, CASE WHEN doc_id % 4 = 3 THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS confidence, CASE WHEN doc_id % 4 = 3 OR doc_id % 3 = 0 THEN 1 ELSE CAST(doc_id % 3 AS INT) END AS page_count FROM documents")
def w5(spark, sf_dir):
    new = D.recognised(*texts_of(spark, sf_dir))
    return new.select(F.col("id").alias("doc_id"), F.length("raw_text").cast("long").alias("n"), F.col("ocr_confidence").alias("confidence"), "page_count")


@query("W5_index_update", "SELECT count(*) AS docs, CAST(sum(CASE WHEN doc_id % 4 = 3 THEN 2 ELSE 0 END) AS BIGINT) AS old_rows FROM documents WHERE doc_id % 4 = 3 OR length(regexp_replace(lower(text), '[^a-z]', '', 'g')) > 200")
def w5_index(spark, sf_dir):
    """The search index after the update: documents with words in it, and rows that the old texts still have."""
    from docloom.functions.stem import lexemes

    old, again = texts_of(spark, sf_dir)
    new = D.reindexed(lexemes(old, "id", "raw_text"), D.recognised(old, again), again)
    long = table(spark, sf_dir, "documents").filter("doc_id % 4 = 3 OR length(regexp_replace(lower(text), '[^a-z]', '')) > 200").select(F.col("doc_id").alias("id"))
    rows = new.join(long, "id", "left_semi").groupBy("id").agg(F.count("*").alias("n"))
    return rows.agg(F.count("*").alias("docs"), F.sum(F.when(F.col("id") % 4 == 3, F.col("n")).otherwise(0)).alias("old_rows"))


@query("W6_classification_update", WITH + "SELECT id, CASE WHEN id % 2 = 0 THEN 'legal' ELSE document_type END AS document_type, CASE WHEN id % 2 = 0 THEN 0.9 ELSE classification_confidence END AS confidence FROM d")
def w6(spark, sf_dir):
    d = docs(spark, sf_dir)
    named = d.filter("id % 2 = 0").select("id", F.lit("legal").alias("document_type"), F.lit(0.9).alias("confidence"))
    return D.classified(d, named).select("id", "document_type", F.col("classification_confidence").alias("confidence"))


@query(
    "W7_review",
    WITH
    + """SELECT id, CASE WHEN id % 3 = 0 THEN 'completed' ELSE status END AS status, CASE WHEN id % 6 = 0 THEN 'legal' ELSE document_type END AS document_type,
    CASE WHEN id % 6 = 0 THEN 1.0 ELSE classification_confidence END AS classification_confidence, id % 3 = 0 AS is_validated,
    CASE WHEN id % 3 = 0 THEN 'user' || CAST(id % 7 AS VARCHAR) END AS validated_by, CASE WHEN id % 3 = 0 THEN TIMESTAMP '2024-01-01' END AS validated_at, CASE WHEN id % 3 = 0 THEN '{"id": ' || CAST(id AS VARCHAR) || '}' END AS data FROM d""",
)
def w7(spark, sf_dir):
    d = docs(spark, sf_dir)
    by, data = F.concat(F.lit("user"), (F.col("id") % 7).cast("string")), F.concat(F.lit('{"id": '), F.col("id").cast("string"), F.lit("}"))
    out = D.reviewed(d, d.filter("id % 3 = 0").select("id", F.when(F.col("id") % 6 == 0, "legal").alias("document_type"), by.alias("by"), data.alias("data")), NOW)
    return out.withColumn("validated_at", F.col("validated_at").cast("timestamp_ntz"))


@query("W8_delete_cascade", "SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 10 <> 0) AS docs, (SELECT count(*) FROM lineitem WHERE l_orderkey % 10 <> 0) AS rows_left")
def w8(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    left = D.deleted({"o": o, "l": li}, {"o": "o_orderkey", "l": "l_orderkey"}, o.filter("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("id")))
    both = left["o"].agg(F.count("*").alias("docs"), F.lit(0).alias("rows_left")).unionByName(left["l"].agg(F.lit(0).alias("docs"), F.count("*").alias("rows_left")))
    return both.agg(F.sum("docs").alias("docs"), F.sum("rows_left").alias("rows_left"))


@query("W9_reprocess", WITH + "SELECT id, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status, retry_count + CASE WHEN status = 'failed' THEN 1 ELSE 0 END AS retry_count FROM d")
def w9(spark, sf_dir):
    d = docs(spark, sf_dir)
    return D.reprocess(d, d.filter("status = 'failed'").select("id"))


@query("W10_final_status", WITH + "SELECT id, CASE WHEN filename = '' THEN 'failed' WHEN retry_count = 2 OR ocr_confidence < 0.3 THEN 'needs_review' ELSE 'completed' END AS status FROM d")
def w10(spark, sf_dir):
    return docs(spark, sf_dir).select("id", D.final_status(F.col("filename"), F.col("retry_count") == 2, F.col("ocr_confidence"), 0.3).alias("status"))
