"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle sets, in powers of two. For each partition a
document is read as overlapping windows of about twice that size, so a short item inside a long
document fills a fair share of some window and MinHash can see it. Windows are made of blocks of
equal length: a hash function costs one minimum for each block and a few for each window. A
window and an item that agree in any of the `hashes` minima (bands of one) are candidates; each
candidate is then verified by exact containment of the item's shingles in the whole document.

An item with containment c >= 0.8 that lies in one stretch fills over 0.8 / (3 + c) of a window, so all
48 minima miss it with probability under 4e-5; spread over two stretches, under 5e-3 each.

The benchmark is a fixed list. Its hashes are sent to the tasks only while it has at most
`most_items` items and `most_bytes` of text; beyond that, items are dealt into groups of about that many
and the documents are read once for each group. Documents are neither shuffled nor cut.

Defined cases: null and empty texts and items match nothing; an item with fewer words than a
shingle is one shingle, found only in a document that has exactly those words; items that repeat
match each by its own id, and rows that repeat id and text are one; null ids stay null; documents that repeat
match each; `decontaminate` judges each row by itself, with or without an id; an empty table on either side
gives no rows; other columns of any name are kept by `decontaminate` and else ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import arrow_schema, as_batch, mix64, slices, text_bytes
from docloom.llm.shingles import _MASK, _WEIGHTS, shingles, words
from docloom.session import ship_package

SEEDS = [np.uint64((i + 1) * int(_WEIGHTS[30]) & _MASK) for i in range(256)]


class Search:
    """The items' side: sets, size partitions and minima."""

    def __init__(self, ids: list[int | None], texts: list[str | None], k: int, hashes: int):
        self.k, self.hashes, self.ids = k, hashes, ids
        column = pa.array(texts, pa.string())
        self.sets = shingles(*words(*text_bytes(column)), k) if len(texts) else []
        self.parts: dict[int, list[int]] = {}
        for n, s in enumerate(self.sets):
            if len(s):
                self.parts.setdefault(int(len(s) - 1).bit_length(), []).append(n)
        # for each partition and hash function: sorted minima and the items that have them
        self.minima = {}
        for p, own in self.parts.items():
            for h in range(hashes):
                least = np.array([mix64(self.sets[n] ^ SEEDS[h]).min() for n in own], np.uint64)
                order = np.argsort(least, kind="stable")
                self.minima[p, h] = (least[order], np.array(own)[order])

    def candidates(self, full: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) pairs; full has the shingle hashes of all rows in text order, bounds where rows begin."""
        found: set[tuple[int, int]] = set()
        sizes = np.diff(bounds)
        rows = np.flatnonzero(sizes)
        if not len(rows):
            return found
        for h in range(self.hashes):
            mixed = mix64(full ^ SEEDS[h])
            for p in self.parts:
                step = max(1, (1 << p) // 2)  # a window is four blocks
                n = -(-sizes[rows] // step)
                first = np.concatenate([[0], np.cumsum(n)])
                owner = np.repeat(np.arange(len(rows)), n)
                at = bounds[rows][owner] + (np.arange(first[-1]) - first[owner]) * step
                least = np.minimum.reduceat(mixed, at)
                for j in (1, 2):  # windows stay within their row
                    nxt = np.minimum(np.arange(len(least)) + j, first[owner + 1] - 1)
                    least = np.minimum(least, least[nxt])
                values, items = self.minima[p, h]
                lo, hi = np.searchsorted(values, least, "left"), np.searchsorted(values, least, "right")
                for w in np.flatnonzero(hi > lo):
                    found.update((int(rows[owner[w]]), int(i)) for i in items[lo[w] : hi[w]])
        return found


def _matches(batch: pa.RecordBatch, search: Search, least: float) -> list[tuple[int, int, int]]:
    """Row, number of the item, and shared shingles, for each item that a text of the batch contains."""
    k = search.k
    w, bounds = words(*text_bytes(batch.column("text")))
    n = len(w)
    whole = shingles(w, bounds, k)
    roll = np.zeros(0, np.uint64)
    if n >= k:
        roll = w[: n - k + 1] * _WEIGHTS[0]
        for j in range(1, k):
            roll = roll + w[j : n - k + 1 + j] * _WEIGHTS[j]
        roll = mix64(roll)
    # shingles in text order, row after row
    parts = [roll[a : b - k + 1] if b - a >= k else whole[r] for r, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))]
    spans = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    out = []
    for r, i in sorted(search.candidates(np.concatenate(parts) if parts else roll, spans)):
        item = search.sets[i]
        at = np.minimum(np.searchsorted(whole[r], item), len(whole[r]) - 1)
        shared = int((whole[r][at] == item).sum())
        if shared >= least * len(item) - 1e-9:
            out.append((r, i, shared))
    return out


def _searches(benchmark: DataFrame, k: int, hashes: int, most_items: int, most_bytes: int):
    """The items' side, in groups of a bounded size."""
    items = benchmark.select("item_id", "text").distinct()
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    groups = max(1, -(-size["n"] // most_items), -(-size["b"] // most_bytes))
    for g in range(groups):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).collect()  # about most_items rows, most_bytes
        yield Search([r["item_id"] for r in own], [r["text"] for r in own], k, hashes)


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8, hashes: int = 48, most_items: int = 20_000, most_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, item_id, n_shared, n_item and containment of every pair at or above `least`."""
    ship_package(docs.sparkSession)
    schema = "doc_id long, item_id long, n_shared long, n_item long, containment double"
    target = arrow_schema(schema)

    def found(search: Search) -> DataFrame:
        def run(it):
            for batch in slices(it, 256):
                hits = _matches(batch, search, least)
                if hits:
                    ids = batch.column("doc_id").to_pylist()
                    rows = [(ids[r], search.ids[i], shared, len(search.sets[i]), shared / len(search.sets[i])) for r, i, shared in hits]
                    yield as_batch(dict(zip(target.names, zip(*rows, strict=True), strict=True)), target)

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [found(s) for s in _searches(benchmark, k, hashes, most_items, most_bytes)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8, hashes: int = 48, most_items: int = 20_000, most_bytes: int = 32 << 20) -> DataFrame:
    """The rows of docs, all columns kept, that hold no benchmark item; in one pass for each group of items."""
    ship_package(docs.sparkSession)

    def clean(rows: DataFrame, search: Search) -> DataFrame:
        def run(it):
            for batch in slices(it, 256):
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, _, _ in _matches(batch, search, least)]] = False
                yield batch.filter(pa.array(keep))

        return rows.mapInArrow(run, rows.schema)

    return reduce(clean, _searches(benchmark, k, hashes, most_items, most_bytes), docs)
