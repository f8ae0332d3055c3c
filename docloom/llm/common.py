"""Shared pieces: staged tables, Arrow row builders and connected components.

Staged tables go to the shared folder that the cluster names in spark.checkpoint.dir, so a lost
executor costs a re-read and never a result. They are ordinary Parquet written through Spark.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import ship_package


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Stage:
    """Intermediate tables of one operator run, dropped one by one when no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/docloom/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for n in names:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Ask for the shuffle files of finished jobs to go: they stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], dict], schema: str, rows: int = 1024, needs: str = "") -> DataFrame:
    """mapInArrow with a function from one Arrow batch to a dict of columns; needs: as for `slices`."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    ship_package(df.sparkSession)
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, rows, needs):
            yield as_batch(f(batch), target)

    return df.mapInArrow(run, schema)


#: What a worker keeps from task to task, by name, and how to let go of it.
KEPT: dict[str, Callable[[], None]] = {}


def slices(it: Iterator[pa.RecordBatch], rows: int = 1024, needs: str = "") -> Iterator[pa.RecordBatch]:
    """Batches of a bounded number of rows, so that Python copies of long texts stay small.

    Workers outlive an operator: what others left in this one is let go, but for what this one needs."""
    for name in [k for k in KEPT if k != needs]:
        KEPT.pop(name)()
    for batch in it:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task, and others share the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a GNU C library
        pass


def as_batch(columns: dict, target: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in target:
        v = columns[field.name]
        if isinstance(v, pa.ChunkedArray):
            v = v.combine_chunks()
        arrays.append(v.cast(field.type) if isinstance(v, pa.Array) else pa.array(v, type=field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=target)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def crc_mod(doc_id, n: int) -> int:
    """crc32 of the id written as text, modulo n; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def crc_column(col, n: int):
    """The same as crc_mod, as a Spark column."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and the row offsets into them."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalising bit mixer on uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * M1
    x = x ^ (x >> np.uint64(33))
    x = x * M2
    return x ^ (x >> np.uint64(33))


def union_find(pairs_a: np.ndarray, pairs_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node and smallest node of its group, for the nodes that the pairs name."""
    nodes, inverse = np.unique(np.concatenate([pairs_a, pairs_b]), return_inverse=True)
    a, b = inverse[: len(pairs_a)], inverse[len(pairs_a) :]
    parent = np.arange(len(nodes))
    while True:
        ra, rb = parent[a], parent[b]
        keep = ra != rb
        if not keep.any():
            return nodes, nodes[parent]
        a, b, ra, rb = a[keep], b[keep], ra[keep], rb[keep]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def components(edges: DataFrame, stage: Stage, name: str) -> DataFrame:
    """(node, root) of every node that an edge names; edges has long columns a and b.

    Union-find first contracts the edges of each partition. What is left goes through rounds of
    hooking each node to its smallest neighbour and jumping pointers, all as joins and grouped
    minima, so no component is ever held by one task. The rounds end when the edges are stars.
    """
    ship_package(edges.sparkSession)
    target = arrow_schema("v long, u long")

    def contract(it):
        pa_, pb_ = [], []
        for batch in it:
            pa_.append(batch.column(0).to_numpy(zero_copy_only=False))
            pb_.append(batch.column(1).to_numpy(zero_copy_only=False))
            if sum(map(len, pa_)) > 2_000_000:
                n, r = union_find(np.concatenate(pa_), np.concatenate(pb_))
                pa_, pb_ = [n[n != r]], [r[n != r]]
                if len(pa_[0]) > 1_000_000:
                    yield as_batch({"v": pa_[0], "u": pb_[0]}, target)
                    pa_, pb_ = [], []
        if pa_:
            n, r = union_find(np.concatenate(pa_), np.concatenate(pb_))
            yield as_batch({"v": n[n != r], "u": r[n != r]}, target)

    e = stage.write(edges.select("a", "b").mapInArrow(contract, "v long, u long").distinct(), f"{name}-0")
    k, files = 0, max(1, -(-e.count() // 100_000))  # no more files than there are rows for
    while True:
        parent = stage.write(e.groupBy("v").agg(F.min("u").alias("p")).coalesce(files), f"{name}-p{k}")  # written, so that a hot u can be split in the join
        up = parent.select(F.col("v").alias("u"), F.col("p").alias("pu"))
        joined = e.join(up, "u", "left").join(parent, "v")
        state = joined.agg(F.count_if(F.col("pu").isNotNull() | (F.col("u") != F.col("p"))).alias("open")).first()
        if not state["open"]:
            break
        moved = joined.select(
            F.explode(
                F.array(
                    F.struct(F.col("v").alias("x"), F.coalesce("pu", "u").alias("y")),
                    F.struct(F.col("u").alias("x"), F.col("p").alias("y")),
                )
            ).alias("e")
        ).select(F.greatest("e.x", "e.y").alias("v"), F.least("e.x", "e.y").alias("u"))
        k += 1
        e = stage.write(moved.filter("v <> u").distinct().coalesce(files), f"{name}-{k}")
        stage.drop(f"{name}-{k - 1}", f"{name}-p{k - 1}")
    roots = e.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots)
