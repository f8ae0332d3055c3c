"""Golden cases of the operators that SQL cannot express, and of edge cases."""

import json
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.stem import lexemes
from docloom.operators import classify as C
from docloom.operators import documents as D
from docloom.operators import extract as X
from docloom.operators import files as V
from docloom.operators import images as I
from docloom.operators import layout as L
from docloom.operators import search as S
from docloom.streaming import pipeline as P


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("word,code", [("Ashcraft", "A226"), ("Tymczak", "T522"), ("Pfister", "P236")])
def test_sound_codes(spark, word, code):
    assert one(spark, T.sound_code(F.lit(word))) == code
    assert C.sound(word) == code


def test_edit_ratio(spark):
    assert round(one(spark, T.edit_ratio(F.lit("invoice"), F.lit("invoce"))), 6) == 0.857143
    assert C.close("invoice", "invoce") and not C.close("invoice", "in")


def test_word_errors_and_page_text(spark):
    df = spark.createDataFrame([("The quick brown fox", "The quik brown fox"), ("", "x")], "a string, b string")
    assert [r["v"] for r in df.select(T.word_error_rate(F.col("a"), F.col("b")).alias("v")).collect()] == [0.25, None]
    assert one(spark, L.page_text(F.lit(" "), F.lit("m"))) == "m" and one(spark, L.page_text(F.lit("l"), F.lit("m"), F.lit("e"))) == "l\n\ne"


@pytest.mark.parametrize(
    "text,kind,confidence,total,matched",
    [
        ("Invoice number 123, total amount due $500", "invoice", 1.0, 15.8983, ["invoice", "inv", "total", "amount due", "invoice number", "po number"]),
        ("Invoice #123 Total: $500", "invoice", 0.991387, 7.725, ["invoice", "inv", "total"]),
        ("P<USASMITH<<JOHN", "identity", 0.993307, 6.5224, ["p<usa"]),
        ("Dear Sir, sincerely", "correspondence", 0.986708, 5.1686, ["dear", "sincerely", "dear sir"]),
        ("zzz qqq", "unknown", 0.0, 0.0, []),
        ("", "unknown", 0.0, None, []),
        ("   \n\t  ", "unknown", 0.0, None, []),
    ],
)
def test_classifier_goldens(text, kind, confidence, total, matched):
    got = C.verdict(text)
    assert (got[0], got[2]) == (kind, matched)
    assert abs(got[1] - confidence) < 1e-4
    if total:
        assert abs(max(got[3].values()) - total) < 1e-3


def test_classify_frame_and_fallback(spark):
    df = spark.createDataFrame([(1, "Invoice number 123, total amount due $500"), (2, None), (3, "zzz qqq")], "id long, text string")
    rows = {r["id"]: r for r in C.classify(df, "id", "text", fallback=lambda t: "LEGAL").collect()}
    assert rows[1]["document_type"] == "invoice" and rows[2]["document_type"] == "unknown"
    assert (rows[3]["document_type"], rows[3]["confidence"]) == ("legal", 0.8)


def test_calibration_of_zero_scores(spark, tmp_path):
    """A value of 0 has a confidence, as in the query's SQL; it used to divide by zero."""
    import duckdb

    from docloom.plans import catalog

    spark.createDataFrame([(1, 0.0), (2, 0.01), (3, 60.0), (4, 80.5), (5, None)], "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["event_id"]: r["confidence"] for r in catalog.QUERIES["C12_calibration"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == dict(con.execute(catalog.ORACLES["C12_calibration"]).fetchall()) and got[1] == 0.047425873


def test_extraction_goldens(spark):
    texts = [
        "Invoice #12345\nDate: 2024-01-15\nTotal Amount: $9.00",
        "INVOICE\nInvoice Number: INV-2024-001\nDate: January 15, 2024\nTotal: $500.00",
        "Invoice No: INV-7 Subtotal: $50.00 Total: $55.00",
    ]
    f = X.invoice_fields(F.col("text"))
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(*[f[c].alias(c) for c in X.INVOICE])
    assert [tuple(r) for r in df.collect()] == [("12345", "2024-01-15", None), ("OICE", "January 15, 2024", 500.0), ("INV-7", None, 50.0)]
    g = X.identity_fields(F.col("text"))
    df = spark.createDataFrame([("ID: U89084829 03",), ("identification card Member ID: XYZ987654321",), ("Rx $10/30/60",), ("Rx: $15/$35/$70",)], "text string")
    rows = df.select(g["member_id"].alias("m"), g["copay_rx"].alias("c")).collect()
    assert [r["m"] for r in rows[:2]] == ["U89084829 03", "entification"]
    assert [r["c"] for r in rows[2:]] == ["$10/$30/$60", None]


def test_json_repair_and_generator(spark):
    assert X.repaired_json('```json\n{"a": 1}\n```') == {"a": 1}
    assert X.repaired_json("{'field': 'value',}") == {"field": "value"}
    with pytest.raises(ValueError):
        X.repaired_json("not valid json at all")
    df = spark.createDataFrame([(1, "x", "legal"), (2, "  ", "legal"), (3, "bad", "legal")], "id long, text string, kind string")
    rows = {r["id"]: r for r in X.extract(df, "id", "text", "kind", lambda t: '{"jurisdiction": "X", "other": 1}' if t.endswith("\nx") else "no").collect()}
    assert abs(rows[1]["confidence"] - 1 / 6) < 1e-9 and rows[2]["data"] == "{}" and rows[3]["confidence"] == 0


def test_prompts_types_and_fall_back(spark):
    asked = X.prompt("invoice", "t" * 9000)
    assert all(f in asked for f in X.FIELDS["invoice"]) and asked.count("t" * 8000) == 1 and "t" * 8001 not in asked
    assert X.prompt("correspondence", "x") == X.prompt("unknown", "x")
    assert X.conformed({"total_amount": "12.5", "currency": "EUR", "z": 1}, "invoice") == dict.fromkeys(X.FIELDS["invoice"]) | {"total_amount": 12.5, "currency": "EUR"}
    assert X.conformed({"total_amount": "much", "invoice_number": 7}, "invoice") == dict.fromkeys(X.FIELDS["invoice"]) | {"total_amount": "much", "invoice_number": 7}

    def down(_):
        raise OSError("no network")

    text = "Invoice No: INV-7 Subtotal: $50.00 Total: $55.00"
    df = spark.createDataFrame([(1, text, "invoice"), (2, "ID: U89084829 03 Rx $10/30/60 passport", "identity"), (3, "x", "legal")], "id long, text string, kind string")
    rows = {r["id"]: json.loads(r["data"]) for r in X.extract(df, "id", "text", "kind", down).collect()}
    assert (rows[1]["invoice_number"], rows[1]["total_amount"], rows[1]["invoice_date"]) == ("INV-7", 50.0, None)
    assert (rows[2]["member_id"], rows[2]["copay_rx"], rows[2]["card_type"]) == ("U89084829 03", "$10/$30/$60", "Passport")
    assert rows[3] == dict.fromkeys(X.FIELDS["legal"])
    # the expressions and the fall-back agree
    exprs = df.select("id", *[c.alias(f) for f, c in X.identity_fields(F.col("text")).items()]).filter("id = 2").first().asDict()
    assert {f: exprs[f] for f in X.FIELDS["identity"]} == rows[2]


def test_search_in_stems(spark):
    d = spark.createDataFrame([(1, "The relation of things", "a"), (2, "relational thing, relating THINGS", "b"), (3, "relative", "a"), (4, "happiness and ponies", "a")], "id long, text string, kind string")
    found = lambda q, **o: [r["id"] for r in S.search(d, q, "id", "text", **o).collect()]
    assert found("the thing") == [2, 1] and found("relates") == [2, 1] and found("happy pony") == [4] and found("the of") == []
    assert found("things", only=F.col("kind") == "a") == [1] and S.search(d, "thing", "id", "text", total=True).first()["total"] == 2
    index = lexemes(d, "id", "text")
    assert [r["id"] for r in S.search_postings(index, "the thing", "id").collect()] == [2, 1] and S.search_postings(index, "the", "id").count() == 0


def boxes(spark, rows):
    return spark.createDataFrame(rows, "doc long, seq long, text string, confidence double, x double, y double, w double, h double")


def test_votes(spark):
    b = [(1, 0, "A", 0.9, 0.0, 0.0, 4.0, 4.0), (1, 1, "A", 0.8, 0.0, 0.0, 4.0, 4.0), (1, 2, "B", 0.95, 0.0, 0.0, 4.0, 4.0)]
    assert L.merge_votes(boxes(spark, b)).first()["text"] == "B"
    b = [(1, 0, "A", 0.92, 0.0, 0.0, 4.0, 4.0), (1, 1, "A", 0.90, 0.0, 0.0, 4.0, 4.0), (1, 2, "B", 0.95, 0.0, 0.0, 4.0, 4.0)]
    r = L.merge_votes(boxes(spark, b)).first()
    assert (r["text"], r["confidence"]) == ("A", 0.92)


def test_lines_and_layout(spark):
    b = [(1, k, f"t{k}", 0.9, 0.0, y - 10, 10.0, 20.0) for k, y in enumerate((10.0, 22.0, 36.0, 60.0))]
    assert [r["line"] for r in L.lines(boxes(spark, b)).orderBy("seq").collect()] == [0, 0, 0, 1]
    b = [(1, 1, "L1", 0.9, 50.0, 0.0, 10.0, 20.0), (1, 2, "L2", 0.9, 95.0, 30.0, 10.0, 20.0), (1, 3, "L3", 0.9, 50.0, 100.0, 10.0, 20.0)]
    assert L.layout_text(boxes(spark, b)).first()["text"] == "L1\n  L2\n\nL3"


def test_suppression(spark):
    near = [(1, 0, "same", 0.9, 0.0, 0.0, 100.0, 20.0), (1, 1, "same", 0.8, 30.0, 0.0, 100.0, 20.0)]
    apart = [(2, 0, "same", 0.9, 0.0, 0.0, 100.0, 20.0), (2, 1, "same", 0.8, 120.0, 0.0, 100.0, 20.0)]
    inside = [(3, 0, "one", 0.9, 0.0, 0.0, 100.0, 100.0), (3, 1, "two", 0.8, 10.0, 10.0, 5.0, 5.0)]
    got = L.suppress(boxes(spark, near + apart + inside)).groupBy("doc").count().orderBy("doc").collect()
    assert [r["count"] for r in got] == [1, 2, 1]


def test_watermarks(spark):
    b = [(1, 0, "DRAFT", 0.80, 0.0, 0.0, 210.0, 100.0), (1, 1, "DRAFT", 0.75, 0.0, 0.0, 120.0, 100.0), (1, 2, "DRAF", 0.99, 0.0, 0.0, 60.0, 100.0)]
    assert [r["seq"] for r in boxes(spark, b).filter(L.is_watermark(1000.0, 1000.0)).orderBy("seq").collect()] == [0, 2]


def test_search_goldens(spark):
    d = spark.createDataFrame([(1, "invoice total"), (2, "invoice invoice paid"), (3, "receipt"), (4, None)], "id long, text string")
    assert [r["id"] for r in S.search(d, "invoice", "id", "text").collect()] == [2, 1]
    assert [r["id"] for r in S.search(d, "invoice total", "id", "text").collect()] == [1]
    assert S.search(d, "  ", "id", "text").count() == 0
    assert d.filter("id = 1").select(S.snippet(F.col("text"), "total").alias("s")).first()["s"] == "invoice <mark>total</mark>"
    s = spark.createDataFrame([("Invoice, (invoice) INVENTORY in",)], "text string")
    assert [r["word"] for r in S.suggestions(s, "text", "inv").collect()] == ["inventory", "invoice"]
    m = spark.createDataFrame([('{"vendor_name": "Acme Corporation", "total_amount": 1234.56}',), ('{"total_amount": "x"}',)], "data string")
    assert S.json_like(m, "data", "vendor_name", "a%corp").count() == 1
    assert S.json_range(m, "data", "total_amount", 1000, 2000).count() == 1


def test_validation_goldens(spark):
    f = spark.createDataFrame([("a.PDF", 52428800), ("a.pdf", 52428801), ("x.exe", 1), ("a.jpeg", 1)], "name string, size long")
    rows = V.validated(f, "name", "size").collect()
    assert [(r["valid"], r["mime"], r["error"]) for r in rows] == [(True, "application/pdf", None), (False, "application/pdf", "too large"), (False, "application/octet-stream", "type not allowed"), (True, "image/jpeg", None)]
    assert one(spark, V.safe_name(F.lit("a/b<c>.pdf"))) == "b_c_.pdf"
    assert len(one(spark, V.safe_name(F.lit("a" * 300 + ".pdf")))) == 200
    for (s, e, n), want in {(0, -1, 5): (1, 5, False), (6, 7, 5): (6, 5, True), (4, 2, 5): (4, 2, True)}.items():
        got = spark.range(1).select(*[c.alias(k) for k, c in zip("seb", V.page_range(F.lit(s), F.lit(e), F.lit(n)), strict=True)]).first()
        assert tuple(got) == want


def test_paging_bounds(spark):
    with pytest.raises(ValueError):
        D.check_page(0, 20)
    with pytest.raises(ValueError):
        D.check_page(1, 101)


def test_metrics_of_nothing(spark):
    from docloom.plans.bindings import catalogue

    empty = catalogue(spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(0))
    r = D.metrics(empty, dt.date(2024, 1, 1)).first()
    assert r["total_documents"] == 0 and r["average_ocr_confidence"] == 0.0 and r["average_processing_time"] is None


def test_images():
    import numpy as np

    img = np.zeros((40, 40, 3), np.uint8)
    img[:20] = (255, 0, 0)
    assert I.gray(img)[0, 0] == 29 and I.gray(I.gray(img)).shape == (40, 40)
    g = np.full((60, 60), 255, np.uint8)
    g[30] = 0
    assert set(np.unique(I.adaptive_threshold(g))) <= {0, 255}
    assert I.otsu(np.array([[10, 10, 200, 200]], np.uint8)).tolist() == [[0, 0, 255, 255]]
    assert I.compare(g, g) == {"ssim": 1.0, "pixel_match": 100.0, "text_match": 100.0, "overall": 100.0}
    assert I.compare(g, 255 - g)["overall"] < 50
    assert I.crop_border(np.pad(np.zeros((10, 10), np.uint8), 30, constant_values=255)).shape == (30, 30)
    assert abs(I.skew_angle(g)) < 0.5
    for f in (I.shadow_free, I.background_normalised, I.clahe, I.denoised, I.sharpened_if_soft, I.stretched):
        assert f(g).shape == g.shape and f(g).dtype == np.uint8
    assert I.gamma(np.array([[0, 255]], np.uint8), 1.2).tolist() == [[0, 255]]


def test_image_frame(spark, tmp_path):
    import struct
    import zlib

    raw = b"".join(b"\0" + bytes([10 * r, 20, 30] * 8) for r in range(8))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    from docloom.sources.readers import files, images

    out = I.transformed(images(spark, str(tmp_path)), ["gray", "shadow_free"]).first()
    assert (out["height"], out["width"], out["channels"]) == (8, 8, 1) and len(out["data"]) == 64
    assert files(spark, str(tmp_path)).first()["mime"] == "image/png"


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    stream = P.daily_counts(P.stream_of(spark, str(tmp_path / "in"), e.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda rows: sorted((str(r["day"]), r["event_type"], r["n"]) for r in rows)
    assert key(spark.table("daily").collect()) == key(P.daily_counts(e).collect())


def test_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("a.pdf", "b.png", "c.txt"):
        (tmp_path / "in" / n).write_bytes(b"Invoice number 1")
    from docloom.sources.readers import landing

    recognise = lambda df: df.select("path", F.when(F.col("path").endswith("a.pdf"), "Invoice number 1").alias("text"), F.lit(0.9).alias("confidence"))
    q = P.ingest(landing(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), recognise, lambda df: C.classify(df, "path", "text").select("path", "document_type"))
    q.awaitTermination()
    rows = {r["path"][-5:]: r for r in spark.read.parquet(str(tmp_path / "out/documents")).collect()}
    assert rows["a.pdf"]["status"] == "completed" and rows["a.pdf"]["document_type"] == "invoice" and rows["b.png"]["status"] == "failed"
    assert len(rows) == 2


def test_stemming(spark):
    from docloom.functions.stem import lexemes, stem

    known = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "conflated": "conflat", "hopping": "hop", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "generalizations": "gener", "adoption": "adopt", "rate": "rate", "roll": "roll"}
    assert {w: stem(w) for w in known} == known
    df = spark.createDataFrame([(1, "The invoices and the INVOICE were paid"), (2, None)], "id long, text string")
    assert sorted((r["lexeme"], r["positions"]) for r in lexemes(df, "id", "text").collect()) == [("invoic", [2, 5]), ("paid", [7])]


def test_line_order(spark):
    """Boxes of height 10: in rows of 15 pixels first, each compared with the one before it in that order."""
    rows = [(1, k, t, 0.9, x - 5.0, y - 5.0, 10.0, 10.0) for k, (t, x, y) in enumerate([("a", 50, 14), ("b", 100, 0), ("c", 50, 16)])]
    got = {r["text"]: r["line"] for r in L.lines(boxes(spark, rows)).collect()}
    assert got == {"a": 0, "b": 0, "c": 1}
    assert L.layout_text(boxes(spark, rows)).first()["text"] == "a b\nc"


def test_suppression_by_edit_ratio(spark):
    place = lambda k, t, x, doc=1: (doc, k, t, 0.9 - k / 100, float(x), 0.0, 5.0, 5.0)
    rows = [place(0, "total: 100", 0), place(1, "total: 10", 20), place(2, "  ", 40), place(3, " ", 60), place(4, "", 80), place(5, "TOTAL: 100 ", 30)]
    assert sorted(r["seq"] for r in L.suppress(boxes(spark, rows)).collect()) == [0, 1, 2, 3]
    none = [(None, k, "w", None if k else 0.5, 0.0, 0.0, 5.0, 5.0) for k in range(300)] + [(2, 0, None, 0.5, 0.0, 0.0, 5.0, 5.0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert [tuple(r)[:2] for r in L.suppress(boxes(spark, none)).collect()] == [(None, 0)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# --- recognition, pages, reconstruction ------------------------------------------------------------------
def image_rows(spark, *imgs):
    rows = [(f"f{k}", i.shape[0], i.shape[1], 1 if i.ndim == 2 else i.shape[2], bytearray(np.ascontiguousarray(i).tobytes())) for k, i in enumerate(imgs)]
    return spark.createDataFrame(rows, "origin string, height int, width int, channels int, data binary")


def test_flattened_page():
    img = np.zeros((400, 400, 3), np.uint8)
    y, x = np.mgrid[:400, :400]
    page = (x > 60 + y // 10) & (x < 320 - y // 20) & (y > 50) & (y < 350)
    img[page] = 230
    flat = I.flattened(img)
    assert (flat > 200).mean() > 0.97 and 230 <= flat.shape[1] <= 270 and 280 <= flat.shape[0] <= 305
    small = np.zeros((90, 90), np.uint8)
    small[20:60, 20:60] = 255
    assert I.flattened(small) is small and I.flattened(np.zeros((50, 50), np.uint8)).shape == (50, 50)


def test_largest_part():
    m = np.zeros((30, 30), bool)
    m[2:5, 2:5] = m[10:20, 10:12] = m[18:20, 10:25] = m[10:20, 23:25] = True
    want = m.copy()
    want[2:5, 2:5] = False
    assert (I.largest_part(m) == want).all()


def test_colour_kernels():
    r = np.random.default_rng(3)
    img = r.integers(0, 256, (40, 50, 3)).astype(np.uint8)
    assert I.denoised_colour(img).shape == img.shape and I.clahe_colour(img).shape == img.shape
    one = np.full((40, 50, 3), 90, np.uint8)
    assert (I.denoised_colour(one) == one).all()
    g = r.integers(0, 256, (40, 50)).astype(np.uint8)
    assert (I.clahe_colour(g) == I.clahe(g)).all()


def test_recognised_variants_and_merged_text(spark):
    img = np.full((60, 80), 255, np.uint8)

    def recognise(v):
        if v.shape[0] > 60:
            return [("big", 0.7, 40.0 * v.shape[1] / 80, 0.0, 8.0 * v.shape[1] / 80, 8.0)]
        if v.min() == 255 and v.ndim == 2:
            return [("A ", 0.9, 0.0, 0.0, 10.0, 10.0), ("B", 0.8, 40.0, 40.0, 10.0, 10.0)]
        raise RuntimeError("fails")

    got = I.recognised(image_rows(spark, img), recognise).collect()
    assert {r["variant"] for r in got} >= {"original", "enlarged"} and all(abs(r["x"] - 40) < 1e-6 for r in got if r["text"] == "big")
    b = boxes(spark, [(1, 0, "two", 0.9, 100.0, 0.0, 4.0, 4.0), (1, 1, "one", 0.7, 0.0, 0.0, 4.0, 4.0), (1, 2, "three", 0.8, 0.0, 90.0, 4.0, 4.0)])
    row = L.merged_text(b).first()
    assert row["text"] == "one two three" and abs(row["confidence"] - 0.8) < 1e-9


def test_verified_pages(spark):
    img = np.full((120, 200), 255, np.uint8)
    I.bar_text(img, "abc def", 20, 30, 70, 16, 1.0)
    rows = [("f0", 0, "abc def", 0.95, 20.0, 30.0, 70.0, 20.0)]
    b = spark.createDataFrame(rows, "origin string, seq long, text string, confidence double, x double, y double, w double, h double")
    good = I.verified(image_rows(spark, img), b).first()
    none = I.verified(image_rows(spark, img), b.limit(0)).first()
    assert good["overall"] > 97 and good["overall"] > none["overall"]
    assert I.write_files(image_rows(spark, img, np.zeros((2, 3, 3), np.uint8)), "out").select("name").collect()[1][0] == "out/f1.ppm"


# --- stores ------------------------------------------------------------------------------------------
def test_uploads_and_downloads(spark, tmp_path):
    from docloom.sources import readers as R

    (tmp_path / "x.pdf").write_bytes(b"abc")
    rows = spark.createDataFrame([("up/A.PDF", 10, dt.datetime(2024, 3, 5)), ("up/a.exe", 10, dt.datetime(2024, 3, 5)), ("b.png", 1 << 30, dt.datetime(2024, 3, 5))], "path string, length long, at timestamp")
    got = R.stored(rows, "at", "/data").collect()
    assert len(got) == 1 and got[0]["file_path"].startswith("/data/2024/03/05/") and got[0]["file_path"].endswith(".pdf")
    docs = spark.createDataFrame([(1, f"file://{tmp_path}/x.pdf", "mine.pdf"), (2, f"file://{tmp_path}/none.pdf", "no.pdf")], "id long, file_path string, original_filename string")
    row = R.download(docs, 1).first()
    assert (bytes(row["content"]), row["original_filename"]) == (b"abc", "mine.pdf") and R.download(docs, 2).count() == 0 and R.download(docs, 3).count() == 0


def test_database_round_trip(spark):
    from docloom.sources import readers as R

    url = "jdbc:derby:memory:docloom;create=true"
    df = spark.createDataFrame([(k, f"t{k}") for k in range(100)], "id long, name string")
    R.to_database(df, url, "things", "overwrite", parts=2)
    R.to_database(df.filter("id < 5"), url, "things")
    back = R.from_database(spark, url, "things", "id", (0, 100), 4)
    assert back.count() == 105 and back.rdd.getNumPartitions() == 4 and back.filter("id = 3").count() == 2


def test_health(spark):
    from docloom.sources import readers as R

    def down():
        raise OSError("gone")

    assert R.health(spark, probes={"model": down, "store": lambda: 1}) == {"engine": "healthy", "model": "unhealthy: gone", "store": "healthy"}


def test_one_bad_file_does_not_take_its_batch(spark, tmp_path):
    from docloom.sources.readers import landing

    (tmp_path / "in").mkdir()
    for k in range(6):
        (tmp_path / "in" / f"f{k}.pdf").write_bytes(b"Invoice number 1")

    def recognise(df):
        bad = F.col("path").endswith("f3.pdf")
        return df.select("path", F.when(bad, F.raise_error(F.lit("torn file"))).otherwise(F.lit("Invoice number 1")).alias("text"), F.lit(0.9).alias("confidence"))

    q = P.ingest(landing(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), recognise, lambda df: df.select("path", F.lit("invoice").alias("document_type")), wait=0.0)
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/documents")).count() == 5
    bad = spark.read.parquet(str(tmp_path / "out/quarantine")).collect()
    assert len(bad) == 1 and bad[0]["path"].endswith("f3.pdf") and "torn file" in bad[0]["error_log"]


def test_lists_as_shown(spark):
    assert one(spark, X.displayed_list(F.array(*map(F.lit, "abcdefg")))) == "a, b, c, d, e"
    assert one(spark, X.displayed_list(F.array().cast("array<string>"))) is None


def test_equation_regions():
    img = np.full((300, 900), 255, np.uint8)
    img[50:90, 100:400:12] = 0  # a row of strokes
    img[50:90, 101:400:12] = 0
    img[200:210, 20:60] = 0  # too small
    found = I.equation_regions(img)
    assert len(found) == 1 and abs(found[0][0] - 91) <= 12 and 300 <= found[0][2] <= 330 and 40 <= found[0][3] <= 46


def test_machine_readable_zone(spark):
    a, b = "P<USASMITH JOHN" + "<" * 25, "1234567890USA" + "<" * 20
    rows = [(1, 0, "title that is longer than most of the others", 0.9, 0.0, 0.0, 50.0, 10.0), (1, 1, b, 0.9, 0.0, 95.0, 50.0, 4.0), (1, 2, a, 0.9, 0.0, 79.0, 50.0, 4.0), (2, 0, a, 0.9, 0.0, 90.0, 5.0, 4.0)]
    got = lambda kind: {r["doc"]: r["mrz"] for r in L.machine_readable(boxes(spark, rows), 100.0, F.lit(kind)).collect()}
    assert got("Passport") == got(None) == {1: a.replace(" ", "<") + "\n" + b, 2: None} and got("invoice")[1] is None


def test_sound_codes_of_all_words(spark):
    """The expression against the plain rule, over every word of the texts."""
    from docloom.plans import catalog

    rows = catalog.QUERIES["T_sound_codes"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 1000 and all(r["code"] == C.sound(r["w"]) for r in rows)


def test_misspelled_keywords_by_brute_force(spark, monkeypatch):
    """Verdicts with every keyword compared with every word by the whole table of edits."""

    def ratio(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return 1 - row[-1] / max(len(a), len(b))

    keywords = sorted({k for ks in C.KEYWORDS.values() for k in ks if len(k) >= 4})
    texts = [r["text"][:600] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(25).collect()] + ["invoce numbr and recept, diagnosys of the patiant", "passprt natonality"]
    fast = [C.verdict(t) for t in texts]
    monkeypatch.setattr(C, "close_keywords", lambda w: [k for k in keywords if ratio(k, w) >= 0.7])
    assert [C.verdict(t) for t in texts] == fast


def test_pages_of_files(spark):
    from docloom.sources import readers as R

    rows = spark.createDataFrame([("a", bytearray(b"p1|p2|p3")), ("b", bytearray(b"")), ("c", bytearray(b"x"))], "path string, content binary")

    def render(content):
        if content == b"x":
            raise ValueError("torn")
        yield from content.split(b"|") if content else ()

    got = sorted((r["path"], r["page"] or 0, bytes(r["image"] or b""), r["error"]) for r in R.render_pages(rows, render, at_once=2).collect())
    assert got == [("a", 1, b"p1", None), ("a", 2, b"p2", None), ("a", 3, b"p3", None), ("c", 0, b"", "torn")]
    assert [r["page"] for r in R.render_pages(rows.filter("path = 'a'"), render, first=2, last=2).collect()] == [2]
    assert {r["path"]: r["page_count"] for r in R.page_counts(rows, lambda c: len(list(render(c)))).collect()} == {"a": 3, "b": 0, "c": None}
