"""Best-fit packing of token sequences by large-item matching.

Documents become pieces of at most `capacity` ids. Lengths are whole numbers up to the capacity, so
the packing plan depends only on the histogram of lengths: at most `capacity` rows reach the driver,
whatever the input. The plan pairs pieces above a third of the capacity at most twice per bin, each
with the largest partner that fits, then puts smaller pieces, longest first, into the bins with the
least room that still fits. It is a list of runs: pieces number a to b of length L go to bins from c
on, k to a bin, from offset o. Each piece finds its run by its rank among the pieces of its length.

Ranks need no sort: a task counts the pieces of each length as it cuts them, and a prefix sum over
(task, length) totals turns local counts into global ranks. A length that half of all rows share is
thus spread over the tasks that read it.

Defined cases: a null or empty text is the end id alone; null ids and repeated rows are packed as
rows of their own; equal lengths take their places in order of task and row; a very long text becomes
many full pieces behind one that may be shorter; an empty table packs to an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import Stage, map_batches
from docloom.llm.tokens import encoder

#: Stated columns of a run: length, first rank, pieces, first bin, pieces to a bin, first offset.
Run = tuple[int, int, int, int, int, int]


def plan_runs(histogram: dict[int, int], capacity: int) -> list[Run]:
    """The packing plan for a histogram of lengths (1 to capacity)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    taken = np.zeros(capacity + 1, np.int64)
    runs: list[Run] = []
    room: dict[int, list[tuple[int, int, int]]] = {}  # gap: first bin, bins
    bins = 0

    def put(length: int, n: int, first: int, per: int, offset: int) -> None:
        runs.append((length, int(taken[length]), n, first, per, offset))
        taken[length] += n
        left[length] -= n

    def free(gap: int, first: int, n: int) -> None:
        if gap and n:
            room.setdefault(gap, []).append((first, n))

    third = capacity // 3
    for length in range(capacity, third, -1):
        while left[length]:
            top = min(capacity - length, length)
            partners = np.flatnonzero(left[third + 1 : top + 1]) if top > third else []
            mate = third + 1 + int(partners[-1]) if len(partners) else 0
            if mate == length and left[length] == 1:
                mate = third + 1 + int(partners[-2]) if len(partners) > 1 else 0
            n = int(left[length]) if not mate else int(left[length] // 2) if mate == length else int(min(left[length], left[mate]))
            put(length, n, bins, 1, 0)
            if mate:
                put(mate, n, bins, 1, length)
            free(capacity - length - mate, bins, n)
            bins += n
    for length in range(third, 0, -1):
        for gap in sorted(g for g in room if g >= length) if left[length] else []:
            per, kept, later = gap // length, [], []
            for first, n in room[gap]:
                full = int(min(n, left[length] // per))
                if full:
                    put(length, full * per, first, per, capacity - gap)
                    later.append((gap - per * length, first, full))
                    first, n = first + full, n - full
                rest = int(left[length])
                if n and 0 < rest < per:
                    put(length, rest, first, rest, capacity - gap)
                    later.append((gap - rest * length, first, 1))
                    first, n = first + 1, n - 1
                if n:
                    kept.append((first, n))
            room[gap] = kept
            for x in later:
                free(*x)
            if not left[length]:
                break
        if left[length]:
            per = capacity // length
            full, rest = divmod(int(left[length]), per)
            if full:
                put(length, full * per, bins, per, 0)
                free(capacity - per * length, bins, full)
                bins += full
            if rest:
                put(length, rest, bins, rest, 0)
                free(capacity - rest * length, bins, 1)
                bins += 1
    return runs


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n ids: only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n > capacity else [(0, n)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """The pieces of each document, with their local rank in (task, length)."""
    import pyarrow as pa

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, task long" + ", ids binary" * with_ids
    end = np.array([end_id], "<u4").tobytes()
    seen: dict[int, np.ndarray] = {}

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
        of = encoder(tokenizer).encode_column(batch.column("text"))
        for doc, task, ids in zip(batch.column("doc_id").to_pylist(), batch.column("task").to_pylist(), of, strict=True):
            if task not in seen:
                seen.clear()
                seen[task] = np.zeros(capacity + 1, np.int64)
            ids = ids.astype("<u4").tobytes() + end
            for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                own = ids[4 * start : 4 * (start + length)]
                for c, v in zip(("doc_id", "piece", "start", "length", "ids_crc32", "rank", "task"), (doc, k, start, length, zlib.crc32(own), int(seen[task][length]), task), strict=True):
                    out[c].append(v)
                if with_ids:
                    out["ids"].append(own)
                seen[task][length] += 1
        return out

    return map_batches(docs.select("doc_id", "text", F.spark_partition_id().cast("long").alias("task")), run, schema, 256, "tokens")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids, little-endian unsigned
    32-bit, if asked for), sequence_id and offset, its place in the packed sequence."""
    spark = docs.sparkSession
    stage = Stage(spark, "pack")
    cut_up = stage.write(pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    totals = cut_up.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in totals.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = np.array(sorted(plan_runs(histogram, capacity)) or [(0, 0, 1, 0, 1, 0)], np.int64)
    shift = 1 << 44
    keys = runs[:, 0] * shift + runs[:, 1]
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut_up.join(bases, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("task", "base")

    def place(batch):
        import pyarrow as pa

        length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        r = runs[np.searchsorted(keys, length * shift + rank, "right") - 1]
        at = rank - r[:, 1]
        cols = {c: batch.column(c) for c in batch.schema.names if c != "rank"}
        return cols | {"sequence_id": pa.array(r[:, 3] + at // r[:, 4]), "offset": pa.array(r[:, 5] + at % r[:, 4] * length)}

    return map_batches(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pack(with_ids=True): sequence_id and its ids in order."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))  # at most `capacity` of them
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id",
        F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"),
        F.col("p.doc_id").alias("doc_ids"),
    )
