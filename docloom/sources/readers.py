"""Sources: binary files, images and landing folders, batch and stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.files import extension, mime_type, validated

ALLOWED = "*.{pdf,png,jpg,jpeg,tiff,tif}"
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def files(spark: SparkSession, path: str, glob: str = ALLOWED) -> DataFrame:
    """Files with content, size, time, sha256 and type."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return rows.withColumns({"sha256": F.sha2("content", 256), "mime": mime_type(F.col("path"))})


def landing(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", ALLOWED).option("maxFilesPerTrigger", files_per_trigger).load(path)


def stored(rows: DataFrame, received: str, root: str) -> DataFrame:
    """Uploads that may come in, with the place where each is kept: a new name under year, month and day."""
    ok = validated(rows, "path", "length").filter("valid")
    name = F.concat(F.expr("uuid()"), extension(F.col("path")))
    return ok.withColumn("file_path", F.concat_ws("/", F.lit(root), F.date_format(received, "yyyy/MM/dd"), name))


def download(documents: DataFrame, document_id, read=files) -> DataFrame:
    """The original file of one document (no row where the document or its file is not there)."""
    row = documents.filter(F.col("id") == F.lit(document_id)).select("file_path", "original_filename").first()
    spark = documents.sparkSession
    if row is None:
        return spark.createDataFrame([], f"{FILE_SCHEMA}, original_filename string")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(row["file_path"])
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"{FILE_SCHEMA}, original_filename string")
    return read(spark, row["file_path"], "*").select("path", "modificationTime", "length", "content", F.lit(row["original_filename"]).alias("original_filename"))


def from_database(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options) -> DataFrame:
    """A table of a database; with a numeric key and its bounds it is read in so many parts at once."""
    options |= {"url": url, "dbtable": name}
    if key and bounds:
        options |= {"partitionColumn": key, "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": parts}
    return spark.read.format("jdbc").options(**options).load()


def to_database(rows: DataFrame, url: str, name: str, mode: str = "append", parts: int = 8, **options) -> None:
    """Rows into a table of a database, over at most so many connections, in batches that commit on their own."""
    rows.coalesce(parts).write.format("jdbc").options(url=url, dbtable=name, batchsize=10_000, **options).mode(mode).save()


def health(spark: SparkSession, streams: list | None = None, probes: dict[str, Callable[[], object]] | None = None) -> dict[str, str]:
    """State by component: the engine, each named stream, and whatever probes are given; a probe that raises is unhealthy."""
    out = {}
    checks: dict[str, Callable[[], object]] = {"engine": lambda: spark.sql("SELECT 1").first()} | (probes or {})
    for name, check in checks.items():
        try:
            check()
            out[name] = "healthy"
        except Exception as e:  # noqa: BLE001  whatever a probe raises
            out[name] = f"unhealthy: {e}"[:200]
    for q in streams or []:
        out[f"stream {q.name or q.id}"] = "healthy" if q.isActive else "unhealthy: " + (str(q.exception())[:150] if q.exception() else "not running")
    return out


def images(spark: SparkSession, path: str) -> DataFrame:
    """Images as BGR bytes with shape."""
    return spark.read.format("image").load(path).select(F.col("image.origin").alias("origin"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def render_pages(rows: DataFrame, renderer: Callable[[bytes], Iterator[bytes]], at_once: int = 8, first: int = 1, last: int | None = None) -> DataFrame:
    """One row for each page, from 1, of each file, or the pages of a range; the renderer yields pages and is
    called in the tasks. A file that it fails on gives a row without page that names the error."""

    def run(it):
        out: list[tuple] = []
        for pdf in it:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    for k, page in enumerate(renderer(bytes(content)), 1):
                        if last is not None and k > last:
                            break
                        if k >= first:
                            out.append((path, k, page, None))
                        if len(out) >= at_once:
                            yield pd.DataFrame(out, columns=["path", "page", "image", "error"])
                            out = []
                except Exception as e:  # noqa: BLE001  whatever a renderer raises
                    out.append((path, None, None, str(e)[:200]))
        if out:
            yield pd.DataFrame(out, columns=["path", "page", "image", "error"])

    return rows.select("path", "content").mapInPandas(run, "path string, page int, image binary, error string")


def page_counts(rows: DataFrame, count: Callable[[bytes], int]) -> DataFrame:
    """(path, page_count) by an injected counter; null where it fails."""

    def number(content) -> int | None:
        try:
            return int(count(bytes(content)))
        except Exception:  # noqa: BLE001  whatever a counter raises
            return None

    def run(it):
        for pdf in it:
            yield pd.DataFrame({"path": pdf["path"], "page_count": pd.array([number(c) for c in pdf["content"]], dtype="Int32")})

    return rows.select("path", "content").mapInPandas(run, "path string, page_count int")


def text_layer(pages: DataFrame) -> DataFrame:
    """(path, page, text) to the joined text of each file; null when all its pages are blank."""
    kept = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), lambda t: F.trim(t) != "")
    return pages.groupBy("path").agg(F.nullif(F.array_join(kept, "\n\n"), F.lit("")).alias("text"))
