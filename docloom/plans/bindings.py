"""The driver tables seen as the engine's document tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: `orders` as a document catalogue. The same text serves Spark and DuckDB.
CATALOGUE_COLUMNS = """
    o_orderkey AS id,
    concat('doc_', CAST(o_orderkey AS STRING), CASE o_orderkey % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpg'
        WHEN 3 THEN '.tiff' WHEN 4 THEN '.exe' ELSE '' END) AS filename,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN CASE WHEN o_orderkey % 10 = 0 THEN 'failed' ELSE 'pending' END
        ELSE 'needs_review' END AS status,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'invoice' WHEN '2' THEN 'receipt' WHEN '3' THEN 'medical'
        WHEN '4' THEN 'unknown' END AS document_type,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS DOUBLE) / 100 END AS ocr_confidence,
    CASE WHEN o_orderkey % 4 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(o_orderkey % 97 AS DOUBLE) / 96 END AS classification_confidence,
    CAST(floor(o_totalprice * 200) AS BIGINT) AS file_size,
    CAST(o_custkey % 3 AS INT) AS retry_count,
    o_orderdate AS upload_timestamp,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS processing_started_at,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate + CAST(o_orderkey % 3600 AS INT) * INTERVAL '1' SECOND END AS processing_completed_at
"""
CATALOGUE_SQL = "d AS (SELECT " + CATALOGUE_COLUMNS + " FROM orders)"


def catalogue(orders: DataFrame) -> DataFrame:
    parts = [p for p in _split(CATALOGUE_COLUMNS)]
    return orders.selectExpr(*parts)


def _split(text: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


#: `lineitem` as recognised text boxes.
BOX_COLUMNS = """
    l_orderkey AS doc, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS seq, concat('w', CAST(l_partkey % 9 AS STRING)) AS text,
    CAST(1 - l_discount AS DOUBLE) AS confidence,
    CAST(l_partkey * 7 % 800 AS DOUBLE) AS x, CAST(l_suppkey * 13 % 200 AS DOUBLE) AS y,
    CAST(20 + l_partkey % 300 AS DOUBLE) AS w, CAST(10 + l_suppkey % 70 AS DOUBLE) AS h
"""
BOX_SQL = "b AS (SELECT " + BOX_COLUMNS + " FROM lineitem)"


def boxes(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(*_split(BOX_COLUMNS))


def events_sql() -> str:
    return "SELECT event_id, ts, user_id, event_type, value, props FROM events"


__all__ = ["BOX_SQL", "CATALOGUE_SQL", "boxes", "catalogue", "F"]
