"""Recognised boxes into text: voting, reading order, lines, layout, suppression, watermarks.

Boxes are rows of doc, seq, text, confidence, x, y, w, h. All but the greedy suppression are windows and
aggregates by document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cell of a vote, height of a row, width of an indent, all in pixels.
CELL, ROW, INDENT = 30, 15, 40


def cx() -> Column:
    return F.col("x") + F.col("w") / 2


def cy() -> Column:
    return F.col("y") + F.col("h") / 2


def area() -> Column:
    return F.col("w") * F.col("h")


def merge_votes(boxes: DataFrame, cell: int = CELL) -> DataFrame:
    """One text for each cell: the best mean confidence, a tenth more for each vote; first seen wins ties."""
    g = [F.floor(cx() / cell).alias("gx"), F.floor(cy() / cell).alias("gy")]
    votes = boxes.groupBy("doc", *g, F.trim("text").alias("text")).agg(F.avg("confidence").alias("m"), F.count("*").alias("n"), F.max("confidence").alias("confidence"), F.min("seq").alias("first"))
    votes = votes.withColumn("score", F.round(F.col("m") * (1 + 0.1 * F.col("n")), 9))
    w = Window.partitionBy("doc", "gx", "gy").orderBy(F.desc("score"), "first")
    return votes.withColumn("k", F.row_number().over(w)).filter("k = 1").select("doc", "gx", "gy", "text", "confidence", "score")


def merged_text(boxes: DataFrame, cell: int = CELL) -> DataFrame:
    """(doc, text, confidence): the texts that won their cells, by rows of cells, and their mean confidence."""
    won = merge_votes(boxes, cell).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("gy", "gx", "text"))).alias("t"), F.avg("confidence").alias("confidence"))
    return won.select("doc", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"), "confidence")


def dedupe(boxes: DataFrame, cell: int = 20) -> DataFrame:
    w = Window.partitionBy("doc", F.floor(cx() / cell), F.floor(cy() / cell)).orderBy(F.desc("confidence"), "seq")
    return boxes.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def reading_order(boxes: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc").orderBy((cy() / ROW).cast("long"), cx(), "seq")
    return boxes.withColumn("pos", F.row_number().over(w).cast("long"))


def lines(boxes: DataFrame) -> DataFrame:
    """pos (place in reading order, from 1) and line (from 0): boxes follow each other in reading order, and a
    new line begins where a centre is further from the one before than the tolerance."""
    by = Window.partitionBy("doc")
    order = by.orderBy("pos")
    out = reading_order(boxes).withColumns({"_cy": cy(), "_tol": F.greatest(F.lit(float(ROW)), F.avg(F.abs("h")).over(by) * 0.5)})
    jump = F.coalesce((F.abs(F.col("_cy") - F.lag("_cy").over(order)) > F.col("_tol")).cast("int"), F.lit(0))
    out = out.withColumn("_jump", jump)
    return out.withColumn("line", F.sum("_jump").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_cy", "_tol", "_jump")


def layout_text(boxes: DataFrame) -> DataFrame:
    """(doc, text): lines with indents of two blanks for each 40 pixels, and blank lines at wide gaps."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"])
    ls = lines(boxes).groupBy("doc", "line").agg(F.array_join(parts, " ").alias("text"), F.min("x").alias("left"), F.min("y").alias("top"), F.max(F.col("y") + F.col("h")).alias("bottom"))
    w = Window.partitionBy("doc").orderBy("line")
    first = F.first("left").over(w.rowsBetween(Window.unboundedPreceding, 0))
    indent = F.greatest(F.lit(0), ((F.col("left") - first) / INDENT).cast("int"))
    gap = F.col("top") - F.lag("bottom").over(w) > 1.5 * (F.col("bottom") - F.col("top"))
    ls = ls.select("doc", "line", F.concat(F.when(gap, "\n").otherwise(""), F.repeat(F.lit("  "), indent), "text").alias("text"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n")
    return ls.groupBy("doc").agg(joined.alias("text"))


def page_text(laid_out: Column, merged: Column, equations: Column | None = None) -> Column:
    """The layout text, or the merged text where it is blank; equations follow when asked for."""
    text = F.coalesce(F.when(F.trim(laid_out) != "", laid_out), merged, F.lit(""))
    return text if equations is None else F.concat_ws("\n\n", text, F.nullif(equations, F.lit("")))


def machine_readable_lines(lines_: Column, document_type: Column) -> Column:
    """The first two lines of 28 characters or more, blanks as <; null with fewer or for other types. A type that is
    not known may be one of them."""
    long = F.filter(F.transform(lines_, lambda s: F.replace(F.upper(s), F.lit(" "), F.lit("<"))), lambda s: F.length(s) >= 28)
    known = F.lower(F.coalesce(document_type, F.lit(""))).isin("", "passport", "travel_document", "id_card")
    return F.when(known & (F.size(long) >= 2), F.array_join(F.slice(long, 1, 2), "\n"))


def machine_readable(boxes: DataFrame, height: float, document_type: Column) -> DataFrame:
    """(doc, mrz) from the boxes of the bottom fifth of a page, line by line; document_type is a column of boxes."""
    low = lines(boxes.withColumn("_type", document_type).filter(cy() >= 0.8 * height))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), " ")
    by_line = low.groupBy("doc", "line").agg(text.alias("text"), F.first("_type").alias("_type"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda s: s["text"])
    return by_line.groupBy("doc").agg(machine_readable_lines(in_order, F.first("_type")).alias("mrz"))


# Fixed values in what follows: areas, confidences and shares.
def is_watermark(width: float, height: float) -> Column:
    c, n = F.col("confidence"), F.length("text")
    central = (F.abs(cx() - width / 2) / (width / 2) < 0.3) & (F.abs(cy() - height / 2) / (height / 2) < 0.3)
    return ((area() > 20000) & (c < 0.85)) | ((area() > 10000) & (c < 0.70)) | ((area() > 5000) & (n < 5)) | ((area() > 15000) & (c < 0.90) & central)


def style() -> dict[str, Column]:
    return {
        "vertical": F.col("h") > 1.5 * F.col("w"),
        "font": F.greatest(F.lit(10), F.least(F.lit(200), (F.col("h") * 0.8 * 3).cast("int"))),
        "alpha": F.when((area() > 15000 * 9) & (F.col("confidence") < 0.85), 40).otherwise(255),
    }


def draw_order(boxes: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc").orderBy(area().desc(), "seq")
    return boxes.withColumn("rank", F.row_number().over(w).cast("long"))


def equation_candidates(boxes: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc").orderBy("y", "x", "seq")
    return boxes.filter("w > 200 AND w < 800 AND h > 20 AND h < 150").withColumn("pos", F.row_number().over(w).cast("long"))


def overlaps(boxes: DataFrame, cell: int = 128) -> DataFrame:
    """(doc, a, b, inter) of boxes of a document that share some area. Boxes meet in the cells of a grid that they
    cover, and a pair counts in the cell where what it shares begins, so far boxes never meet."""
    span = lambda at, size: F.explode(F.sequence(F.floor(F.col(at) / cell), F.floor((F.col(at) + F.col(size)) / cell)))
    placed = boxes.select("doc", "seq", "x", "y", "w", "h", span("x", "w").alias("gx")).withColumn("gy", span("y", "h"))
    p, q = placed.alias("p"), placed.alias("q")
    met = p.join(q, (F.col("p.doc") == F.col("q.doc")) & (F.col("p.gx") == F.col("q.gx")) & (F.col("p.gy") == F.col("q.gy")) & (F.col("p.seq") < F.col("q.seq")))
    begin = {a: F.greatest(f"p.{a}", f"q.{a}") for a in "xy"}
    side = {a: F.least(F.col(f"p.{a}") + F.col(f"p.{n}"), F.col(f"q.{a}") + F.col(f"q.{n}")) - begin[a] for a, n in ("xw", "yh")}
    here = (F.floor(begin["x"] / cell) == F.col("p.gx")) & (F.floor(begin["y"] / cell) == F.col("p.gy"))
    return met.filter((side["x"] > 0) & (side["y"] > 0) & here).select("p.doc", F.col("p.seq").alias("a"), F.col("q.seq").alias("b"), (side["x"] * side["y"]).alias("inter"))


def _alike(a: str, b: str) -> bool:
    """Is the edit ratio of two trimmed, lower-cased texts over 0.9; with an empty one it is not."""
    n = max(len(a), len(b))
    if not a or not b or 10 * abs(len(a) - len(b)) >= n:
        return False
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (c != d))
    return 10 * row[-1] < n


def _suppressed(rows: list[tuple]) -> list[int]:
    """Numbers of the kept rows of one document, given as (confidence, seq, text, x, y, w, h, number)."""
    kept: list[tuple] = []
    out = []
    for _, _, text, x, y, w, h, number in sorted(rows, key=lambda r: (-r[0], r[1])):
        size, t = w * h, text.strip().lower()
        if size <= 0 or not text:
            continue
        mx, my = x + w / 2, y + h / 2
        for t2, x2, y2, w2, h2, size2, mx2, my2 in kept:
            inter = max(0.0, min(x + w, x2 + w2) - max(x, x2)) * max(0.0, min(y + h, y2 + h2) - max(y, y2))
            iou = inter / (size + size2 - inter)
            if iou > 0.20 or inter / size2 > 0.80 or inter / size > 0.80:
                break
            if ((mx - mx2) ** 2 + (my - my2) ** 2 < 2500 or iou > 0.01) and _alike(t, t2):
                break
        else:
            kept.append((t, x, y, w, h, size, mx, my))
            out.append(number)
    return out


def suppress(boxes: DataFrame) -> DataFrame:
    """Greedy suppression by confidence (null: 0). Boxes without text or area go. It depends on order, so a
    document is one unit of work; documents lie side by side in their partition and are read as a stream."""

    def run(it):
        rest: list[pd.DataFrame] = []  # the last document may go on in the next batch
        for pdf in it:
            if not len(pdf):
                continue
            key = pdf["doc"].astype(object).where(pdf["doc"].notna(), None)
            last = key.iloc[-1]
            mine = key.isna() if last is None else key == last
            if rest and _first(rest[0]) != _first(pdf):
                yield _of_batch(pd.concat(rest, ignore_index=True))
                rest = []
            if mine.all():
                rest.append(pdf)
                continue
            yield _of_batch(pd.concat([*rest, pdf[~mine]], ignore_index=True))
            rest = [pdf[mine]]
        if rest:
            yield _of_batch(pd.concat(rest, ignore_index=True))

    return boxes.repartition("doc").sortWithinPartitions("doc").mapInPandas(run, boxes.schema)


def _first(pdf: pd.DataFrame):
    doc = pdf["doc"].iloc[0]
    return None if pd.isna(doc) else doc


def _of_batch(pdf: pd.DataFrame) -> pd.DataFrame:
    by: dict = {}
    docs = pdf["doc"].astype(object).where(pdf["doc"].notna(), None).tolist()
    confidence, text = pdf["confidence"].fillna(0).tolist(), pdf["text"].fillna("").tolist()
    columns = [pdf[c].tolist() for c in ("seq", "x", "y", "w", "h")]
    for k, (doc, c, t, seq, *place) in enumerate(zip(docs, confidence, text, *columns, strict=True)):
        by.setdefault(doc, []).append((c, seq, t, *place, k))
    return pdf.iloc[sorted(k for rows in by.values() for k in _suppressed(rows))]
