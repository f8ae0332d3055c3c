"""Repeated passages by truncated suffix arrays and longest previous (and next) factors.

A passage is a run of `length` bytes. Of the k-byte grams in a passage the one with the least hash
(the first of equals) is its anchor, so equal passages have equal anchors at equal places. Passages
that start next to each other mostly share an anchor; such a run is a stretch, of fewer than
2 * length bytes. Only hashes of stretches are shuffled at first:

1. Anchors that occur once have no repeats. Stretches that occur more than once, byte for byte, are
   repeated whole, copies of documents among them.
2. Of the other stretches with a shared anchor, one of each kind is cut from its text. Stretches of
   an anchor go to one block, blocks of bounded size; a suffix array of the block, by prefix
   doubling up to `length` bytes, puts equal passages next to each other. A passage has an earlier
   copy if a smaller position precedes or follows it among its equals in suffix order, and a later
   copy if a larger one does.
3. An anchor with more than `crowd` kinds of stretches is split first: each stretch is compared with
   the earliest one, to the left and to the right of the anchor. What both have around the anchor is
   a repeat if long enough. Any other passage reaches past a mismatch, and two stretches can only share
   it if they have the same mismatch in the same place: those become anchors of their own. So no
   group is ever compared pair by pair or held by one task.

`keep` says what stays: "first" keeps the first copy of a passage in order of doc_id and place and
removes later ones; "none" removes every copy. Passages are judged on the input as it was.

Defined cases: a null or short text has no passages (null counts as empty); rows without doc_id and
rows that share a doc_id are documents of their own, in text-hash order; rows that repeat count
as copies of each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Stage, arrow_schema, as_batch, map_batches, mix64, slices, text_bytes
from docloom.llm.shingles import _BYTE, _MASK, _WEIGHTS, _powers
from docloom.session import ship_package

GRAM = 20
_TABLE = _BYTE.copy()
_TABLE[65:91] = mix64(_TABLE[97:123] ^ _WEIGHTS[20]) | np.uint64(1)  # case counts here
_PLACE = (1 << 28) - 1


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w neighbours, by minima that run both ways within pieces of w."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    pieces = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(pieces, axis=1).reshape(-1)
    back = np.minimum.accumulate(pieces[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def stretches_of(raw: np.ndarray, length: int):
    """Anchor hash, stretch hash, first and last start, and place of the anchor, for each stretch."""
    n = len(raw)
    w = length - GRAM + 1
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[raw] * up[:n], out=sums[1:])
    grams = mix64((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    place = np.arange(len(grams), dtype=np.uint64)
    least = sliding_least((grams & np.uint64(_MASK ^ _PLACE)) | place, w) & np.uint64(_PLACE)
    turn = np.flatnonzero(least[1:] != least[:-1])
    lo = np.concatenate([[0], turn + 1])
    hi = np.concatenate([turn, [len(least) - 1]])
    at = least[lo].astype(np.int64)
    body = (sums[hi + length] - sums[lo]) * down[lo]
    kind = mix64(mix64(body) + (hi - lo).astype(np.uint64) * _WEIGHTS[21] + (at - lo).astype(np.uint64) * _WEIGHTS[22])
    return grams[at].astype(np.int64), kind.astype(np.int64), lo, hi, at


def stretches(docs: DataFrame, length: int) -> DataFrame:
    ship_package(docs.sparkSession)
    schema = "h long, kind long, doc_id long, t long, lo int, hi int, at int"
    target = arrow_schema(schema)

    def run(it):
        for batch in slices(it, 256):
            raw, offsets = text_bytes(batch.column("text"))
            rows = np.flatnonzero(np.diff(offsets) >= length)
            if not len(rows):
                continue
            found = [stretches_of(raw[offsets[r] : offsets[r + 1]], length) for r in rows]
            cols = {c: np.concatenate([f[k] for f in found]) for k, c in enumerate(("h", "kind", "lo", "hi", "at"))}
            which = np.repeat(rows, [len(f[0]) for f in found])
            yield as_batch(cols | {c: batch.column(c).take(_pa(which)) for c in ("doc_id", "t")}, target)

    return docs.select("doc_id", "t", "text").mapInArrow(run, schema)


def _pa(x):
    import pyarrow as pa

    return pa.array(x)


def _sorted(key: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys under `limit` in order, and where they stood; number and place share a word where they fit."""
    bits = max(1, len(key).bit_length())
    if limit << bits > 1 << 64:
        order = np.argsort(key, kind="stable")
        return key[order], order
    packed = np.sort(key << np.uint64(bits) | np.arange(len(key), dtype=np.uint64))
    return packed >> np.uint64(bits), (packed & np.uint64((1 << bits) - 1)).astype(np.int64)


def _first_of(new: np.ndarray) -> np.ndarray:
    """For each place the last place at or before it where something new begins."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def truncated_suffix_array(raw: np.ndarray, length: int) -> np.ndarray:
    """Rank of each place by its next `length` bytes (zeros after the end); equal ranks: equal bytes.

    Ranks of 5 bytes come from a sort, ranks of twice the bytes from pairs of ranks, and a place whose
    rank is its own is final and not sorted again.
    """
    n, have = len(raw), min(5, length)
    padded = np.concatenate([raw, np.zeros(length + 8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(have):
        key = (key << np.uint64(8)) | padded[k : k + n]
    key, order = _sorted(key, 1 << 40)
    rank = np.empty(n, np.int64)
    rank[order] = _first_of(np.concatenate([[True], key[1:] != key[:-1]])[:n])
    counts = np.bincount(rank, minlength=n)
    while have < length:
        step = min(have, length - have)
        open_ = np.flatnonzero(counts[rank] > 1)
        if not len(open_):
            break
        nxt = open_ + step
        pair = rank[open_] * (n + 1) + np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        pair, order = _sorted(pair.astype(np.uint64), (n + 1) ** 2)
        pair = pair.astype(np.int64)
        old = pair // (n + 1)
        group = _first_of(np.concatenate([[True], old[1:] != old[:-1]]))
        rank[open_[order]] = old + _first_of(np.concatenate([[True], pair[1:] != pair[:-1]])) - group
        counts = np.bincount(rank, minlength=n)
        have += step
    return rank


def factor_flags(rank: np.ndarray, starts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For passages at ascending starts: is there an earlier, is there a later copy among those of their group.

    Equal passages share an anchor. A passage past mismatches on both sides has two, so between anchors it
    would be its own copy.

    In suffix order equal passages are neighbours. The running minimum of places before a passage and
    after it, within its equals, tell whether a smaller place precedes or follows: the previous and next
    smaller positions of the longest-previous-factor rule. Maxima tell the same of later copies.
    """
    n = len(rank)
    r, order = _sorted((group * n + rank[starts]).astype(np.uint64), n * (int(group.max(initial=0)) + 1))
    r, p = r.astype(np.int64), starts[order]
    run = np.cumsum(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, np.int64)
    big = np.int64(1) << 40
    up, down = p - run * big, p + run * big
    previous = np.minimum.accumulate(up) < up
    following = np.minimum.accumulate((p + run * big)[::-1])[::-1] < down
    later = np.zeros(len(p), bool)
    before = np.maximum.accumulate(down) > down
    after = np.maximum.accumulate(up[::-1])[::-1] > up
    earlier_flag, later_flag = np.zeros(len(p), bool), later
    earlier_flag[order] = previous | following
    later_flag[order] = before | after
    return earlier_flag, later_flag


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of every run of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def hopeful(raw: np.ndarray, base: np.ndarray, anchor: np.ndarray, group: np.ndarray, length: int, parts: int = 8) -> np.ndarray:
    """Rows that may share a passage with another of their group; base and anchor are places in raw.

    A passage has some share of its bytes before the anchor. Cut to the next lower and upper of `parts`
    shares, it gives a string around the anchor that both rows have, so rows whose strings are all their
    own share nothing. What is left is decided by the suffix array.
    """
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * up[:-1], out=sums[1:])
    out = np.zeros(len(anchor), bool)
    salt = mix64(group.astype(np.uint64))
    for k in range(parts):
        a = anchor - k * length // parts
        b = anchor + max(GRAM, length - -(-(k + 1) * length // parts))
        there = np.flatnonzero((a >= base[:-1]) & (b <= base[1:]))
        a, b = a[there], b[there]
        _, inverse, counts = np.unique(mix64((sums[b] - sums[a]) * down[a]) ^ salt[there], return_inverse=True, return_counts=True)
        out[there[counts[inverse] > 1]] = True
    return out


def _blocks(dealt: DataFrame, length: int, keep: str, most: int = 1 << 19) -> DataFrame:
    """Spans of repeated passages; dealt has the stretches of an anchor in one task and side by side."""
    schema = "doc_id long, t long, start int, stop int"
    target = arrow_schema(schema)

    def solve(rows) -> dict:
        out = {"doc_id": [], "t": [], "start": [], "stop": []}
        base = np.concatenate([[0], np.cumsum([len(r[7]) for r in rows])])
        raw = np.frombuffer(b"".join(r[7] for r in rows), np.uint8)
        anchor = base[:-1] + np.array([r[5] - r[6] for r in rows], np.int64)
        some = np.flatnonzero(hopeful(raw, base, anchor, np.array([r[0] for r in rows], np.int64), length))
        rows = sorted((rows[k] for k in some.tolist()), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        if not rows:
            return out
        del raw
        base = np.concatenate([[0], np.cumsum([len(r[7]) for r in rows])])
        rank = truncated_suffix_array(np.frombuffer(b"".join(r[7] for r in rows), np.uint8), length)
        first = np.array([r[3] - r[6] for r in rows], np.int64)  # passages of a row start from here
        count = np.array([r[4] - r[3] + 1 for r in rows], np.int64)
        owner = np.repeat(np.arange(len(rows)), count)
        begin = np.concatenate([[0], np.cumsum(count)])
        starts = base[owner] + first[owner] + np.arange(begin[-1]) - begin[owner]
        _, group = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)
        earlier, later = factor_flags(rank, starts, group[owner])
        hit = earlier if keep == "first" else earlier | later
        for k in np.unique(owner[hit]).tolist():
            a, b = runs(hit[begin[k] : begin[k + 1]])
            out["doc_id"] += [rows[k][1]] * len(a)
            out["t"] += [rows[k][2]] * len(a)
            out["start"] += (a + rows[k][3]).tolist()
            out["stop"] += (b + rows[k][3] + length).tolist()
        return out

    def run(it):
        held, size, last = [], 0, None
        for batch in slices(it):
            d = batch.to_pydict()
            for row in zip(*(d[c] for c in ("h", "doc_id", "t", "lo", "hi", "at", "origin", "body")), strict=True):
                if row[0] != last and size > most:
                    yield as_batch(solve(held), target)
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += len(row[7])
        if held:
            yield as_batch(solve(held), target)

    return dealt.mapInArrow(run, schema)


def _split(joined: DataFrame, length: int, keep: str) -> DataFrame:
    """One row for each comparison with the earliest stretch: a span, or a stretch under a new anchor."""
    schema = "h long, doc_id long, t long, lo int, hi int, at int, origin int, body binary, start int, stop int"
    target = arrow_schema(schema)

    def common(a: bytes, b: bytes) -> int:
        n = min(len(a), len(b))
        x = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
        return int(x.argmax()) if x.any() else n

    def child(h: int, side: int, n: int, byte: int) -> int:
        v = (h * 0x9E3779B97F4A7C15 + side * int(_WEIGHTS[25]) + n * int(_WEIGHTS[26]) + (byte + 1) * int(_WEIGHTS[27])) & _MASK
        return int(mix64(np.array([v], np.uint64)).astype(np.int64)[0])

    def run(it):
        for batch in slices(it):
            d = batch.to_pydict()
            out = {c: [] for c in target.names}

            def put(*v, out=out):
                for c, x in zip(out, v, strict=True):
                    out[c].append(x)

            for h, doc, t, lo, hi, at, origin, body, rdoc, rt, rlo, rhi, rat, rorigin, rbody in zip(*(d[c] for c in ("h", "doc_id", "t", "lo", "hi", "at", "origin", "body", "r_doc_id", "r_t", "r_lo", "r_hi", "r_at", "r_origin", "r_body")), strict=True):
                if (doc, t, lo) == (rdoc, rt, rlo):
                    continue
                x, y = at - origin, rat - rorigin
                right = common(body[x:], rbody[y:])
                left = common(body[:x][::-1], rbody[:y][::-1])
                # passages of both rows that lie within what they share
                a, b = max(lo, at - left, at - (rat - rlo)), min(hi, at + right - length, at + (rhi - rat))
                if a <= b:
                    put(None, doc, t, None, None, None, None, None, a, b + length)
                    if keep != "first":
                        put(None, rdoc, rt, None, None, None, None, None, a - at + rat, b - at + rat + length)
                if at + right - length + 1 <= hi and x + right < len(body):
                    put(child(h, 1, right, body[x + right]), doc, t, max(lo, at + right - length + 1), hi, at, origin, body, None, None)
                if at - left - 1 >= lo and left < x:
                    put(child(h, 2, left, body[x - left - 1]), doc, t, lo, min(hi, at - left - 1), at, origin, body, None, None)
            yield as_batch(out, target)

    return joined.mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, length: int, keep: str, crowd: int, stage: Stage) -> DataFrame:
    """doc_id, t, start, stop of the repeated passages; docs has doc_id, t and text."""
    place = ("doc_id", "t", "lo", "hi", "at")
    found = stage.write(stretches(docs, length), "stretches")
    # written, so that rows of a frequent anchor can be split in the join
    shared = stage.write(found.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"), "shared")
    met = stage.write(found.join(shared, "h"), "met")
    stage.drop("stretches", "shared")
    kinds = stage.write(met.groupBy("h", "kind").agg(F.count("*").alias("c"), F.min(F.struct(*place)).alias("rep")), "kinds")
    whole = met.join(kinds.filter("c > 1"), ["h", "kind"])
    if keep == "first":
        whole = whole.filter(~F.struct(*place).eqNullSafe(F.col("rep")))
    spans = [stage.write(whole.select("doc_id", "t", F.col("lo").alias("start"), (F.col("hi") + length).alias("stop")), "whole")]
    stage.drop("met")
    many = kinds.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    reps = kinds.join(many, "h").select("h", "n", *[F.col(f"rep.{c}").alias(c) for c in place])
    wanted = reps.groupBy("doc_id", "t").agg(F.collect_list(F.struct("h", "n", "lo", "hi", "at")).alias("cuts"))  # of one text

    def cut_out(batch):
        out = {c: [] for c in ("h", "n", "doc_id", "t", "lo", "hi", "at", "origin", "body")}
        d = batch.to_pydict()
        for doc, t, text, cuts in zip(d["doc_id"], d["t"], d["text"], d["cuts"], strict=True):
            raw = text.encode()
            for c in cuts:
                for k, v in zip(out, (c["h"], c["n"], doc, t, c["lo"], c["hi"], c["at"], c["lo"], raw[c["lo"] : c["hi"] + length]), strict=True):
                    out[k].append(v)
        return out

    schema = "h long, n long, doc_id long, t long, lo int, hi int, at int, origin int, body binary"
    same = docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["t"] == wanted["t"])
    texts = docs.hint("merge").join(wanted, same).select(docs["doc_id"], docs["t"], "text", "cuts").dropDuplicates(["doc_id", "t"])
    open_ = stage.write(map_batches(texts, cut_out, schema), "open-0")
    k = 0
    while True:
        # n, the stretches of an anchor, is written with them: after a join by h Spark takes repartition("h") for
        # needless, and a join that becomes a broadcast one, or is split for skew, leaves an anchor in many tasks
        state = open_.agg(F.count_if(F.col("n") > 1).alias("some"), F.count_if(F.col("n") > crowd).alias("crowded")).first()
        if not state["some"]:
            break
        groups = open_.filter((F.col("n") > 1) & (F.col("n") <= crowd)).drop("n")
        spans.append(stage.write(_blocks(groups.repartition("h").sortWithinPartitions("h"), length, keep), f"blocks-{k}"))
        if not state["crowded"]:
            break
        crowds = open_.filter(F.col("n") > crowd).select("h", F.ceil(F.col("n") / 64).cast("int").alias("salts")).distinct()
        firsts = open_.join(crowds, "h").groupBy("h", "salts").agg(F.min(F.struct("doc_id", "t", "lo", "hi", "at", "origin")).alias("r"))
        r_cols = [F.col(f"r.{c}").alias(f"r_{c}") for c in ("doc_id", "t", "lo", "hi", "at", "origin")]
        firsts = firsts.select("h", "salts", *r_cols)
        key = open_.select("h", *[F.col(c).alias(f"r_{c}") for c in ("doc_id", "t", "lo", "hi", "at", "origin")], F.col("body").alias("r_body"))
        match = (firsts["h"] == key["h"]) & firsts["r_doc_id"].eqNullSafe(key["r_doc_id"]) & (firsts["r_t"] == key["r_t"]) & (firsts["r_lo"] == key["r_lo"])
        firsts = firsts.join(key, match).select(firsts["h"], "salts", *[firsts[f"r_{c}"] for c in ("doc_id", "t", "lo", "hi", "at", "origin")], "r_body")
        firsts = firsts.dropDuplicates(["h"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        rows = open_.join(crowds, "h").withColumn("salt", F.pmod(F.xxhash64("doc_id", "t", "lo"), F.col("salts")).cast("int"))
        done = stage.write(_split(rows.join(firsts, ["h", "salt"]), length, keep), f"split-{k}")
        spans.append(done.filter("start is not null").select("doc_id", "t", "start", "stop").distinct())
        k += 1
        new = done.filter("h is not null").select("h", "doc_id", "t", "lo", "hi", "at", "origin", "body")
        open_ = stage.write(new.join(new.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "h"), f"open-{k}")
        stage.drop(f"open-{k - 1}")
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def remove_repeats(docs: DataFrame, length: int = 400, keep: str = "first", crowd: int = 256, extra: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (start and stop of removed runs) and kept (binary) of each row of docs.

    With `extra`, a list of columns, also these, text, and left: the kept text, broken characters gone.
    """
    spark = docs.sparkSession
    if length < 2 * GRAM:
        raise ValueError(f"length is at least {2 * GRAM}")
    stage = Stage(spark, "suffix")
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")
    spans = repeated_spans(rows, length, keep, crowd, stage)
    by_doc = spans.distinct().groupBy("doc_id", "t").agg(F.collect_list(F.struct("start", "stop")).alias("found"))  # of one text
    # extra columns travel as one struct, whatever their names
    rest = F.struct(*[docs[c] for c in extra]).alias("rest") if extra else F.lit(None).cast("int").alias("rest")
    wide = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text", rest, F.monotonically_increasing_id().alias("row"))
    joined = wide.hint("merge").join(by_doc, wide["doc_id"].eqNullSafe(by_doc["doc_id"]) & (wide["t"] == by_doc["t"]), "left").select(wide["doc_id"], wide["t"], "text", "found", "rest", "row")
    whole = F.lit(False)
    if keep == "first":  # of rows that repeat id and text, all but one are later copies
        again = wide.groupBy("doc_id", "t").agg(F.min("row").alias("row"), F.count("*").alias("c")).filter("c > 1")
        joined = joined.join(again.select(F.col("doc_id").alias("d2"), F.col("t").alias("t2"), F.col("row").alias("row2")), F.expr("doc_id <=> d2 and t = t2"), "left")
        whole = F.coalesce((F.col("row") != F.col("row2")) & (F.octet_length("text") >= length), F.lit(False))
    joined = joined.select("doc_id", "text", "found", "rest", whole.alias("whole"))
    names = ["doc_id"] if extra is None else ["doc_id", "text", "rest"]

    def run(batch):
        out = {c: batch.column(c) for c in names} | {"n_bytes": [], "spans": [], "kept": [], "left": []}
        for text, found, whole in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), batch.column("whole").to_pylist(), strict=True):
            raw = (text or "").encode()
            cut = [(0, len(raw))] if whole else merged([(f["start"], f["stop"]) for f in found or ()])
            edges = [0, *[x for s in cut for x in s], len(raw)]
            out["n_bytes"].append(len(raw))
            out["spans"].append([{"start": a, "stop": b} for a, b in cut])
            out["kept"].append(b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]))
            out["left"].append(b"".join([raw[a:b].decode(errors="ignore").encode() for a, b in zip(edges[::2], edges[1::2], strict=True)]).decode() if extra is not None else None)
        return out

    fields = "n_bytes long, spans array<struct<start:int,stop:int>>, kept binary"
    if extra is None:
        return map_batches(joined, run, f"doc_id long, {fields}")
    kind = joined.schema["rest"].dataType.simpleString()
    return map_batches(joined, run, f"doc_id long, text string, rest {kind}, {fields}, left string").select("doc_id", "text", *[F.col(f"rest.`{c}`").alias(c) for c in extra], "n_bytes", "spans", "kept", "left")


def cut_repeats(docs: DataFrame, length: int = 400, crowd: int = 256) -> DataFrame:
    """The rows of docs, all columns kept, without later copies of repeated passages.

    A character of which any byte goes is gone. Rows of which no visible character is left go too, unless
    they had none before; n_chars, where there is one, becomes the characters that are left.
    """
    out = remove_repeats(docs, length, "first", crowd, extra=[c for c in docs.columns if c not in ("doc_id", "text")])
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.col("left"))
    out = out.withColumn("new", text).filter((F.size("spans") == 0) | (F.trim(F.regexp_replace("new", r"\s+", " ")) != ""))
    made = {"text": F.col("new"), "n_chars": F.when(F.size("spans") == 0, F.col("n_chars")).otherwise(F.length("new")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*[(made[c] if c in made else F.col(c)).alias(c) for c in docs.columns])
