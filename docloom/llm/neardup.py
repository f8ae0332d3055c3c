"""MinHash near-duplicates: SuperMinHash signatures, banding, exact verification, union-find groups.

Texts with equal shingle sets are one class, so copies cost one hashed row each. Bands of the
signatures of the classes put them in buckets; classes that share buckets, directly or through
others, form a cluster, and any two classes of a cluster are compared by their full sets, unless they are
known to be connected already. A cluster of one block (`block` classes) is one small unit of work. In a
larger one each class is first compared with the first class of each of its buckets, in groups of a block;
that connects nearly all of a crowd of near copies at a cost in proportion to it. Then those outside
the cluster's largest connected part are compared with each other and with it, in pairs of blocks. Only
a spanning forest of the links leaves a task, so no pair is a row and one hot cluster is many tasks.

With 24 bands of 5 a pair of similarity 0.85 misses all buckets with probability 8e-7.

Defined cases: a document without text or words has an empty set and links with nothing; rows
without doc_id link with nothing (null component, kept); rows that share a doc_id are documents of their
own, each in the component of its text, and a component goes by its smallest doc_id; rows that share id
and set stay or go together; a very long text is one set; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Stage, arrow_schema, as_batch, components, map_batches, slices, text_bytes, union_find
from docloom.llm.shingles import band_keys, fingerprint, shingles, super_minhash, words
from docloom.session import ship_package


def batch_sets(column, k: int) -> list[np.ndarray]:
    return shingles(*words(*text_bytes(column)), k)


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, hash of the text, size and fingerprint of the shingle set, and its band keys."""
    ship_package(docs.sparkSession)
    schema = "doc_id long, t long, n long, f1 long, f2 long, bands array<long>"
    target = arrow_schema(schema)

    def run(it):
        for batch in slices(it, 256):
            sets = batch_sets(batch.column("text"), k)
            keys = band_keys(super_minhash(sets, bands * rows), bands, rows)
            prints = [fingerprint(s) for s in sets]
            yield as_batch(
                {"doc_id": batch.column("doc_id"), "t": batch.column("t"), "n": [len(s) for s in sets], "f1": [p[0] for p in prints], "f2": [p[1] for p in prints], "bands": [x if len(s) else None for x, s in zip(keys, sets, strict=True)]},
                target,
            )

    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(run, schema)


def links_of(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of linked sets, one from left and one from right, by the sizes of full intersections."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        both = np.intersect1d(*sets, assume_unique=True).size
        hit = 100 * both >= percent * (sizes.sum() - both)
        return (left, right) if hit else (left[:0], right[:0])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = counts > 1
    column = np.cumsum(shared) - 1
    keep = shared[inverse]
    owner, column = owner[keep], column[inverse[keep]]
    both = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(shared.sum()), 16_384):
        own = (column >= lo) & (column < lo + 16_384)
        a = np.zeros((len(sets), 16_384), np.float32)
        a[owner[own], column[own] - lo] = 1
        both += a[left] @ a[right].T
    both = both.astype(np.int64)
    hit = 100 * both >= percent * (sizes[left][:, None] + sizes[right][None, :] - both)
    i, j = np.nonzero(hit)
    i, j = left[i], right[j]
    return i[i != j], j[i != j]


def groups_of(docs: DataFrame, stage: Stage, k: int, percent: int, bands: int, rows: int, block: int, words_in_block: int) -> tuple[DataFrame, DataFrame]:
    """meta, one row for each row of docs, and of each class (n, f1, f2) its component."""
    meta = stage.write(signatures(docs, k, bands, rows), "meta")
    usable = meta.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    first = F.min(F.struct("doc_id", "t")).alias("at")
    # a class goes by a number of its own, fixed by being written; equal sets have equal bands
    classes = usable.groupBy("n", "f1", "f2").agg(first, F.first("bands").alias("bands")).select("n", "f1", "f2", "at.doc_id", "at.t", "bands")
    classes = stage.write(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    keyed = classes.select("node", F.explode("bands").alias("key"))
    buckets = stage.write(keyed.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("size")).filter("size > 1"), "buckets")
    met = stage.write(keyed.join(buckets.select("key", "lead"), "key").filter("node <> lead").select("node", "lead").distinct(), "met")
    clusters = components(met.select(F.col("node").alias("a"), F.col("lead").alias("b")), stage, "clusters").withColumnRenamed("root", "gid")
    blocks = lambda: F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / words_in_block)).cast("int")
    members = clusters.join(classes.select("node", "n"), "node")
    members = stage.write(members.join(members.groupBy("gid").agg(blocks().alias("cuts")), "gid"), "members")
    deal = lambda n: F.pmod(F.xxhash64("node", F.lit(3)), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    zero, columns = F.lit(0), ("node", "gid", "own", "i", "j")

    def verify(work: DataFrame, name: str) -> DataFrame:
        """Links found in the groups (gid, i, j) of work; a row belongs to part `own`, i or j, of its group."""
        groups = work.groupBy("node").agg(F.collect_list(F.struct("gid", "own", "i", "j")).alias("groups"))  # by blocks of a cluster
        wanted = classes.select("node", "doc_id", "t", "f1").join(groups, "node")
        # always a shuffle: the list of members grows with the documents
        texts = docs.select("doc_id", F.xxhash64("text").alias("t"), "text").hint("merge").join(wanted, ["doc_id", "t"]).dropDuplicates(["doc_id", "t", "node"])

        def attach(batch):
            sets = batch_sets(batch.column("text"), k)
            same = np.array([fingerprint(x)[0] for x in sets], np.int64) == batch.column("f1").to_numpy(zero_copy_only=False)
            return {c: batch.column(c) for c in ("node", "groups")} | {"words": [x.tobytes() if ok else None for x, ok in zip(sets, same, strict=True)]}

        part = "struct<gid:long,own:int,i:int,j:int>"
        sets = map_batches(texts.select("node", "f1", "groups", "text"), attach, f"node long, groups array<{part}>, words binary").filter("words is not null")
        dealt = sets.select("node", F.explode("groups").alias("g"), "words").select("node", "g.*", "words")
        return stage.write(pairs_of_blocks(dealt.repartition("gid", "i", "j").sortWithinPartitions("gid", "i", "j"), percent), name)

    small = members.filter("cuts = 1").select("node", "gid", zero.alias("own"), zero.alias("i"), zero.alias("j"))
    large = stage.write(members.filter("cuts > 1"), "large")
    stars = met.join(large.select("node", "n"), "node")
    stars = stars.join(stars.groupBy("lead").agg(blocks().alias("salts")), "lead")
    # groups of the first pass are numbered below zero, so that they are none of a cluster's
    of_lead = (-1 - F.col("lead")).alias("gid")
    own = (deal("salts") + 1).alias("own")
    points = stars.select("node", of_lead, own, zero.alias("i"), own.alias("j"))
    centres = stars.select("lead", "salts").distinct().select(F.col("lead").alias("node"), of_lead, zero.alias("own"), zero.alias("i"), F.explode(upto("salts")).alias("j")).withColumn("j", F.col("j") + 1)
    found = verify(small.unionByName(points.select(*columns)).unionByName(centres.select(*columns)), "found")
    joined = components(found, stage, "near").select("node", F.col("root").alias("part"))
    # what the first pass has not connected to the largest part of its cluster
    parts = large.join(joined, "node", "left").withColumn("part", F.coalesce("part", "node"))
    largest = parts.groupBy("gid", "part").agg(F.count("*").alias("c")).groupBy("gid").agg(F.max(F.struct("c", "part")).alias("most")).select("gid", F.col("most.part").alias("main"))
    parts = stage.write(parts.join(largest, "gid").withColumn("out", F.col("part") != F.col("main")), "parts")
    rest = parts.filter("out").groupBy("gid").agg(blocks().alias("cu"))
    main = parts.filter("not out").groupBy("gid").agg(blocks().alias("cm"))
    rest = rest.join(main, "gid")
    outer = parts.filter("out").join(rest, "gid").withColumn("own", deal("cu")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("cu") + F.col("cm") - 1)))
    outer = outer.select("node", "gid", "own", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"))
    inner = parts.filter("not out").join(rest, "gid").withColumn("own", deal("cm") + F.col("cu")).withColumn("i", F.explode(upto("cu"))).withColumn("j", F.col("own")).select(*columns)
    if rest.isEmpty():
        roots = joined.withColumnRenamed("part", "root")
    else:
        roots = components(found.unionByName(verify(outer.unionByName(inner), "more")), stage, "links")
    stage.drop("buckets", "met", "members", "large", "parts")
    grouped = classes.join(roots, "node", "left").select("n", "f1", "f2", "doc_id", F.coalesce("root", "node").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("doc_id").alias("component"))
    return meta, grouped.join(smallest, "root").select("n", "f1", "f2", "component")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 24, rows: int = 5, block: int = 128, words_in_block: int = 400_000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and the hash t of the text, for each row of docs.

    Two documents are linked when 100 * intersection >= percent * union of their k-word shingles.
    """
    meta, groups = groups_of(docs, Stage(docs.sparkSession, "neardup"), k, percent, bands, rows, block, words_in_block)
    component = F.coalesce("component", "doc_id")
    return meta.select("doc_id", "t", "n", "f1", "f2").join(groups, ["n", "f1", "f2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        "t",
    )


def pairs_of_blocks(dealt: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) as a spanning forest for each (gid, i, j); the rows of one are adjacent."""
    target = arrow_schema("a long, b long")

    def one(group) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array([r[1] for r in group], np.int64)
        sets = [np.frombuffer(r[3], np.uint64) for r in group]
        own, (_, i, j) = np.array([r[2] for r in group]), group[0][0]
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if len(ids) == 2 and i == j:
            left, right = left[:1], right[1:]
        if not len(left) or not len(right):
            return ids[:0], ids[:0]
        a, b = links_of(sets, left, right, percent)
        if not len(a):
            return ids[:0], ids[:0]
        node, root = union_find(ids[a], ids[b])
        return node[node != root], root[node != root]

    def run(it):
        held, out = [], ([], [])
        for batch in slices(it):
            d = batch.to_pydict()
            for key, *row in zip(zip(d["gid"], d["i"], d["j"], strict=True), d["node"], d["own"], d["words"], strict=True):
                if held and held[0][0] != key:
                    for x, y in zip(out, one(held), strict=True):
                        x.append(y)
                    held = []
                held.append((key, *row))
        if held:
            for x, y in zip(out, one(held), strict=True):
                x.append(y)
        if out[0]:
            yield as_batch({"a": np.concatenate(out[0]), "b": np.concatenate(out[1])}, target)

    return dealt.mapInArrow(run, "a long, b long")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns kept, without all but the first document of each group."""
    gone = near_duplicates(docs, **options).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("t").alias("gone_t")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_t"]), "left_anti")
