"""Token ids in fixed-width bit-packed blocks.

A file is a folder that Spark writes: one row for each block, so writes commit atomically, survive
lost executors, and reach any store that Spark reaches. A block holds whole documents:

    bytes 0-3   DLB1
    byte  4     width: bits of an id, the least that holds the largest id of the vocabulary
    bytes 5-8   documents (unsigned 32-bit, little-endian, as all that follows)
    bytes 9-16  ids (unsigned 64-bit)
    then        a null flag (1 byte) and id (signed 64-bit) of each document,
                the first id of each document and one end mark (unsigned 64-bit),
                the ids, `width` bits each, least significant bit first.

Id i of a block starts at bit i * width, so any range is unpacked with numpy alone. The rows also
hold the part, the block's number and its first id within the part: with the totals of the parts
these give every block its place in the whole corpus (`index`), and `read_span` reads any stretch.

Defined cases: a null or empty text is the end id alone; rows with equal ids follow each other in
the order of their texts' hashes; null ids come first; an empty table gives an empty file; a very long
text is one document of one block; other columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import arrow_schema, as_batch, map_batches, slices
from docloom.llm.tokens import encoder
from docloom.session import ship_package

MAGIC = b"DLB1"
HEAD = struct.Struct("<4sBIQ")


def bits_needed(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: bytes | memoryview, width: int, first: int, n: int) -> np.ndarray:
    """Ids first to first + n of packed data, as unsigned 32-bit numbers."""
    raw = np.frombuffer(data, np.uint8)
    if width in (8, 16, 32):
        size = width // 8
        return raw[first * size : (first + n) * size].view(f"<u{size}").astype(np.uint32)
    at = (first + np.arange(n, dtype=np.int64)) * width
    at -= (low := int(at[0] // 8) * 8 if n else 0)
    raw = np.concatenate([raw[low // 8 : low // 8 + (n * width + 7) // 8 + 1], np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for k in range(5):
        word |= raw[at // 8 + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (at % 8).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def write_block(doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    starts = np.zeros(len(ids) + 1, "<u8")
    starts[1:] = np.cumsum([len(x) for x in ids])
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([HEAD.pack(MAGIC, width, len(ids), len(flat)), nulls.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), starts.tobytes(), pack_bits(flat, width)])


class Block:
    """A view of a block's bytes; ids are unpacked only when asked for."""

    def __init__(self, data: bytes):
        magic, self.width, n, self.n_ids = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token block")
        at = HEAD.size
        nulls = np.frombuffer(data, np.uint8, n, at)
        found = np.frombuffer(data, "<i8", n, at := at + n)
        self.doc_ids = [None if z else int(d) for z, d in zip(nulls, found, strict=True)]
        self.starts = np.frombuffer(data, "<u8", n + 1, at := at + 8 * n).astype(np.int64)
        self.packed = memoryview(data)[at + 8 * (n + 1) :]

    def ids(self, first: int = 0, n: int | None = None) -> np.ndarray:
        return unpack_bits(self.packed, self.width, first, self.n_ids - first if n is None else n)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1] - self.starts[k]))


def write(docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int = 0, block_ids: int = 1 << 18) -> None:
    """Encode and write documents in ascending order of doc_id; blocks close at `block_ids` ids."""
    ship_package(docs.sparkSession)
    width, schema = bits_needed(max(vocabulary, end_id + 1)), "part long, block int, first long, n_ids long, n_docs int, payload binary"
    target, end = arrow_schema(schema), np.array([end_id], np.uint32)

    def run(it):
        part, k, first, held = None, 0, 0, ([], [])

        def close():
            nonlocal k, first, held
            n = sum(map(len, held[1]))
            row = as_batch({"part": [part], "block": [k], "first": [first], "n_ids": [n], "n_docs": [len(held[0])], "payload": [write_block(*held, width)]}, target)
            k, first, held = k + 1, first + n, ([], [])
            return row

        size = 0
        for batch in slices(it, 256, "tokens"):
            of = encoder(tokenizer).encode_column(batch.column("text"))
            for doc, part, ids in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), of, strict=True):  # noqa: B007
                held[0].append(doc)
                held[1].append(np.concatenate([ids, end]))
                size += len(held[1][-1])
                if size >= block_ids:
                    yield close()
                    size = 0
        if held[0]:
            yield close()

    # the hash lets the rows of one id, or those without, spread over many tasks
    order = ("doc_id", "t", "text")
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), "text").repartitionByRange("doc_id", "t").sortWithinPartitions(*order).drop("t")
    rows.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(run, schema).write.mode("overwrite").option("compression", "none").parquet(path)


def index(spark: SparkSession, path: str) -> DataFrame:
    """Every block with `start`, the ids of all blocks before it. Only totals of parts are ordered in one place."""
    blocks = spark.read.parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # at most one row for each task of the write
    return blocks.join(F.broadcast(parts), "part").withColumn("start", F.col("base") + F.col("first")).drop("base", "first")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a file: doc_id, start, n_tokens and ids (little-endian unsigned 32-bit)."""

    def run(batch):
        out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids": []}
        for payload, start in zip(batch.column("payload"), batch.column("start"), strict=True):
            b, at = Block(payload.as_py()), start.as_py()
            flat = b.ids()
            for d, s, e in zip(b.doc_ids, b.starts[:-1], b.starts[1:], strict=True):
                for c, v in zip(out, (d, at + int(s), int(e - s), flat[s:e].astype("<u4").tobytes()), strict=True):
                    out[c].append(v)
        return out

    return map_batches(index(spark, path).select("payload", "start"), run, "doc_id long, start long, n_tokens long, ids binary")


def read_span(spark: SparkSession, path: str, start: int, n: int) -> np.ndarray:
    """Ids start to start + n of the corpus; only blocks that overlap the span are read."""
    rows = index(spark, path).filter((F.col("start") < start + n) & (F.col("start") + F.col("n_ids") > start)).orderBy("start").collect()
    got = []
    for r in rows:
        lo = max(0, start - r["start"])
        got.append(Block(bytes(r["payload"])).ids(lo, min(r["n_ids"], start + n - r["start"]) - lo))
    return np.concatenate(got) if got else np.zeros(0, np.uint32)
