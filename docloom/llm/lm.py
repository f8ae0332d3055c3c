"""Language-model scores from a hierarchical Pitman-Yor model with word contexts.

A text is a sequence of words (ASCII letters lower-cased, split at ASCII white space) and one end. The word
before (or the beginning of the text) is the context. Each context is a restaurant whose dishes are the
words that follow it; a new table there is a customer of the one parent that all contexts share, the
restaurant of the whole corpus; a new table there takes one of the training words or, with equal
chance, the class of all other words. So P(w | v) = (c_vw - d t_vw + (strength + d T_v) P(w)) / (strength
+ c_v), and P(w) is the same rule with the tables of all contexts as customers.

Seating is sampled by Gibbs sweeps. A dish's customers all leave their restaurant, and their tables leave
the parent; then a number of tables is drawn from its exact conditional given everybody else: generalised
Stirling numbers count the seatings with that many tables (from `exact` customers on, they sit down again
one after the other, and in groups that double). The parent's customers follow at once and are seated in
turn, so the next sweep sees new parents. A dish with one customer has one table and nothing to sample.
Predictive probabilities are averaged over the last `samples` sweeps.

How it is spread out: words are known by 64-bit hashes. Documents are read in chunks; each chunk sends every
(word, context) pair it holds, with its count, to the word's bucket, so a pair is named once by a chunk
however often it occurs. A word that is frequent in a sample has its pairs dealt over all buckets by
context; the sample decides nothing but that, and frequent words are at most 2 / `hot_share`. A
bucket sweeps over its own pairs, with a parent's state and a context's tables of other buckets as they were at
the last exchange (approximate distributed Gibbs); an exchange sends tables by context to the bucket of the context's name.
At the end buckets answer the chunks with counts and tables of what they named. What reaches the
driver is totals, and counts of the frequent words. Nothing is broadcast that grows with the input.

Defined cases: a null or empty text is one end; null ids are hashed as the empty text; repeated rows
count each; very long texts are one chunk; an empty table gives an empty result; without training
rows N and V are 0 and every probability is 1; other columns are ignored.
"""

from __future__ import annotations

import struct
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Stage, arrow_schema, as_batch, crc_mod, mix64, slices, text_bytes
from docloom.llm.shingles import words as word_hashes
from docloom.session import ship_package

END, BEGIN = np.uint64(0x5EC0DE5EC0DE0001), np.uint64(0xB5C0DE5EC0DE0002)
STRENGTH = 1.0
#: Kinds of rows that pass between chunks and buckets.
STATE, ASKED, MAIL, TOTALS, HOT = range(5)
SCHEMA = "kind int, bucket long, other long, data binary, x array<double>"


# --- compact columns -----------------------------------------------------------------------------------
def blob(arrays: list[np.ndarray]) -> bytes:
    """Whole numbers, each array byte by byte of its numbers, so that small numbers cost little."""
    import zstandard

    z, out = zstandard.ZstdCompressor(level=1), [struct.pack("<I", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        size = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        planes = a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T
        data = z.compress(np.ascontiguousarray(planes).tobytes())
        out += [struct.pack("<IBI", len(a), size, len(data)), data]
    return b"".join(out)


def unblob(data: bytes) -> list[np.ndarray]:
    import zstandard

    z, at, out = zstandard.ZstdDecompressor(), 4, []
    for _ in range(struct.unpack_from("<I", data)[0]):
        n, size, length = struct.unpack_from("<IBI", data, at)
        at += 9
        planes = np.frombuffer(z.decompress(data[at : at + length], max_output_size=max(1, n * size)), np.uint8).reshape(size, n)
        at += length
        full = np.zeros((n, 8), np.uint8)
        full[:, :size] = planes.T
        out.append(full.reshape(-1).view("<u8"))
    return out


def steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def names_of(h: np.ndarray) -> np.ndarray:
    """Contexts go by 48 bits of their hashes."""
    return h >> np.uint64(16)


def bucket_of(name: np.ndarray, buckets: int) -> np.ndarray:
    return ((name >> np.uint64(24)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _rows(it):
    """Rows one by one, as dicts."""
    for batch in slices(it, 16):
        d = batch.to_pydict()
        for row in zip(*(d[c] for c in batch.schema.names), strict=True):
            yield dict(zip(batch.schema.names, row, strict=True))


# --- chunks -----------------------------------------------------------------------------------------
class Chunk:
    """The pairs of a chunk in the order in which it asks for them: by bucket, word and context."""

    def __init__(self, sequences: list[np.ndarray], held: np.ndarray, buckets: int, hot: np.ndarray):
        self.lengths = np.array([len(s) for s in sequences], np.int64)
        flat = np.concatenate([*sequences, np.array([BEGIN])])  # the beginning is a word without customers
        self.words, number = np.unique(flat, return_inverse=True)
        begin = int(number[-1])
        word = number[:-1]
        before = np.concatenate([[begin], word[:-1]])
        self.first = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        before[self.first] = begin
        n = len(self.words)
        key, self.pair = np.unique(word * n + before, return_inverse=True)
        self.count = np.bincount(self.pair[np.repeat(~held, self.lengths)], minlength=len(key))
        w, v = key // n, key % n
        self.home = bucket_of(names_of(self.words), buckets)
        is_hot = np.isin(self.words, hot)
        bucket = self.home[w]
        away = is_hot[w]
        bucket[away] = bucket_of(names_of(mix64(self.words[w[away]] ^ mix64(self.words[v[away]]))), buckets)
        order = np.lexsort((v, w, bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pair, self.count = place[self.pair], self.count[order]
        self.w, self.v, self.bucket = w[order], v[order], bucket[order]
        self.check = int(mix64(key.astype(np.uint64) + self.words[v]).sum(dtype=np.uint64) >> np.uint64(1))

    def parts(self):
        """For each bucket: number, first and last + 1 pair, and the words it is asked about."""
        asked = np.unique(np.concatenate([self.bucket * (1 << 32) + self.w, self.home * (1 << 32) + np.arange(len(self.words))]))
        buckets = np.unique(asked >> 32)
        edges = np.searchsorted(asked >> 32, buckets)
        first, last = (np.searchsorted(self.bucket, buckets, side).tolist() for side in ("left", "right"))
        for k, b in enumerate(buckets.tolist()):
            yield b, first[k], last[k], asked[edges[k] : edges[k + 1] if k + 1 < len(edges) else None] & 0xFFFFFFFF


def chunks(docs: DataFrame, make, schema: str, folds: int, held: int, size: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """Rows that `make` yields for each chunk: its number, its Chunk, ids of its documents and which are held out."""
    ship_package(docs.sparkSession)
    target = arrow_schema(schema)

    def run(it):
        k, part, ids, sequences, total = 0, 0, [], [], 0

        def close():
            nonlocal k, ids, sequences, total
            out_of = np.array([crc_mod(i, folds) == held for i in ids])
            rows = make((part << 24) + k, Chunk(sequences, out_of, buckets, hot), ids, out_of)
            k, ids, sequences, total = k + 1, [], [], 0
            yield from (as_batch({c: [v] for c, v in zip(target.names, row, strict=True)}, target) for row in rows)

        for batch in slices(it, 128):
            raw, offsets = text_bytes(batch.column("text"))
            h, bounds = word_hashes(raw, offsets)
            part = batch.column("part")[0].as_py()
            for r, i in enumerate(batch.column("doc_id").to_pylist()):
                sequences.append(np.append(h[bounds[r] : bounds[r + 1]], END))
                ids.append(i)
                total += int(offsets[r + 1] - offsets[r]) + 8
                if total > size:
                    yield from close()
        if ids:
            yield from close()

    return docs.select("doc_id", "text", F.spark_partition_id().cast("long").alias("part")).mapInArrow(run, schema)


def frequent(docs: DataFrame, share: float, most: int) -> tuple[np.ndarray, int]:
    """Words with at least that share of the words of about `most` documents, and the bytes of all texts.

    Both only decide how work is dealt out, so results do not depend on the sample.
    """
    ship_package(docs.sparkSession)
    all_ = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    target = arrow_schema("h long, n long")

    def run(it):
        for batch in slices(it, 256):
            h, n = np.unique(np.append(word_hashes(*text_bytes(batch.column("text")))[0], np.repeat(END, batch.num_rows)), return_counts=True)
            yield as_batch({"h": h.astype(np.int64), "n": n}, target)

    some = docs.select("text").sample(fraction=min(1.0, most / max(1, all_["n"])), seed=11)
    counts = some.mapInArrow(run, "h long, n long")
    least = share * (counts.agg(F.sum("n")).first()[0] or 0)
    rows = counts.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("h").collect()  # at most 1 / share
    return np.sort(np.array([r["h"] for r in rows], np.int64).astype(np.uint64)), int(all_["size"])


# --- restaurants ---------------------------------------------------------------------------------------
def stirling(d: float, most: int) -> np.ndarray:
    """Logs of the generalised Stirling numbers: the weight of all seatings of c customers at t tables."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[1, 1] = 0
    t = np.arange(1, most + 1)
    for c in range(1, most):
        s[c + 1, 1:] = np.logaddexp(s[c, :-1], s[c, 1:] + np.log(np.maximum(c - d * t, 1e-300)))
    return s


def seat(rng, n: np.ndarray, mass: np.ndarray, d: float) -> np.ndarray:
    """Tables of dishes whose n customers sit down one after the other; mass is (strength + d * all tables) * parent's probability.

    The first 48 customers sit down one by one; later ones in groups that double, whose new tables
    are Poisson with the rate of the group's middle.
    """
    t = np.minimum(n, 1).astype(np.float64)
    for i in range(1, 48):
        open_ = n > i
        if not open_.any():
            return t
        p = mass[open_] / (mass[open_] + i - d * t[open_])
        t[open_] += rng.random(len(p)) < p
    lo = 48.0
    while True:
        open_ = n > lo
        if not open_.any():
            return t
        hi = np.minimum(n[open_], 2 * lo)
        rate = mass[open_] / (mass[open_] + (lo + hi) / 2 - d * t[open_])
        t[open_] = np.minimum(t[open_] + rng.poisson(rate * (hi - lo)), hi)
        lo *= 2


def reseat(rng, c: np.ndarray, rest: np.ndarray, p: np.ndarray, d: float, log_s: np.ndarray) -> np.ndarray:
    """New numbers of tables of dishes with c customers, given the other dishes' tables in their restaurants
    (rest) and the parent's probabilities of the dishes (p)."""
    t, exact = np.minimum(c, 1).astype(np.float64), len(log_s) - 1
    for n in np.unique(c[(c > 1) & (c <= exact)]).astype(int).tolist():
        own = np.flatnonzero(c == n)
        ways = np.log(STRENGTH + d * (rest[own, None] + np.arange(n))).cumsum(axis=1) + np.log(p[own, None]) * np.arange(1, n + 1) + log_s[n, 1 : n + 1]
        ways = np.exp(ways - ways.max(axis=1)[:, None]).cumsum(axis=1)
        t[own] = 1 + (ways < (rng.random(len(own)) * ways[:, -1])[:, None]).sum(axis=1)
    many = np.flatnonzero(c > exact)
    if len(many):
        t[many] = seat(rng, c[many], (STRENGTH + d * (rest[many] + 1)) * p[many], d)
    return t


def discount(n1: float, n2: float) -> float:
    return float(min(0.95, max(0.1, n1 / (n1 + 2 * n2)))) if n1 + n2 else 0.5


# --- buckets ------------------------------------------------------------------------------------------
def _mails(name: np.ndarray, flag: np.ndarray, values: list[np.ndarray], src: int, buckets: int):
    """Rows to the buckets of the contexts' names (ascending); flagged names want an answer."""
    at = np.searchsorted(bucket_of(name, buckets), np.arange(buckets + 1)) if len(name) else np.zeros(buckets + 1, np.int64)
    for b in np.flatnonzero(np.diff(at)).tolist():
        own = slice(at[b], at[b + 1])
        yield MAIL, b, src, blob([steps(name[own]), flag[own], *[v[own] for v in values]]), None


def build(asks: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """Pairs of each bucket over all chunks: its state, what each chunk asked, and tables by context at the start."""
    target = arrow_schema(SCHEMA)

    def solve(bucket: int, held: list) -> list:
        own = [(row["other"], *unblob(row["data"])) for row in held]
        own = [(k, np.cumsum(w), n, v, c, check) for k, w, n, v, c, check in own]
        words, word = np.unique(np.concatenate([x[1] for x in own]), return_inverse=True)
        word = np.repeat(word, np.concatenate([x[2] for x in own]).astype(np.int64))
        v, c = np.concatenate([x[3] for x in own]), np.concatenate([x[4] for x in own]).astype(np.int64)
        _, first, of = np.unique(mix64(words[word] ^ mix64(v + np.uint64(1))), return_index=True, return_inverse=True)
        order = np.lexsort((v[first], word[first]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        first, of = first[order], place[of]
        count = np.bincount(of, c, minlength=len(first)).astype(np.int64)
        w, v = word[first], v[first]
        known = count > 0
        active = count > 1
        code, number = np.minimum(count, 2), np.cumsum(active) - 1
        # customers of the root, one for each known pair at first; those of pairs with one customer stay
        fixed = np.bincount(w[count == 1], minlength=len(words))
        c_w = np.bincount(w, count, minlength=len(words)).astype(np.int64)
        n_w = np.bincount(w[known], minlength=len(words))
        cold = ~np.isin(words, hot)
        x = [c_w.sum(), (c_w[cold] > 0).sum(), (count == 1).sum(), (count == 2).sum(), (n_w[cold] == 1).sum(), (n_w[cold] == 2).sum(), n_w.sum()]
        name, inverse = np.unique(v[known], return_inverse=True)
        tables = np.bincount(inverse, minlength=len(name))
        wanted = np.bincount(inverse, active[known], minlength=len(name)) > 0
        first_active = np.searchsorted(name[wanted], v[active])
        out = [(STATE, bucket, None, blob([steps(words), c_w, fixed, name[wanted], w[active], first_active, count[active], np.ones(active.sum(), np.int64)]), [float(z) for z in x])]
        out += _mails(name, wanted, [tables], bucket, buckets)
        out += [(HOT, bucket, int(words[k].astype(np.int64)), None, [float(c_w[k]), float(n_w[k])]) for k in np.flatnonzero(~cold & (c_w > 0)).tolist()]
        i = 0
        for k, asked, n, _, _, check in own:
            entries = of[i : (i := i + int(n.sum()))]
            refs = number[entries[active[entries]]]
            out.append((ASKED, bucket, k, blob([steps(np.searchsorted(words, asked)), code[entries], _folded(refs), check]), None))
        return out

    return _by_bucket(asks, solve, target)


def _folded(x: np.ndarray) -> np.ndarray:
    """Steps between numbers that mostly grow, as small whole numbers."""
    s = np.diff(x, prepend=0)
    return np.where(s < 0, -2 * s - 1, 2 * s)


def _unfolded(s: np.ndarray) -> np.ndarray:
    s = s.astype(np.int64)
    return np.cumsum(np.where(s & 1, -(s + 1) // 2, s // 2))


def _by_bucket(rows: DataFrame, solve, target) -> DataFrame:
    """solve(bucket, its rows) for each bucket, as rows of SCHEMA."""

    def run(it):
        now, held = None, []

        def emit():
            for row in solve(now, held):
                yield as_batch({c: [v] for c, v in zip(target.names, row, strict=True)}, target)

        for row in _rows(it):
            if row["bucket"] != now:
                if held:
                    yield from emit()
                now, held = row["bucket"], []
            held.append(row)
        if held:
            yield from emit()

    return rows.repartition("bucket").sortWithinPartitions("bucket", "kind", "other").mapInArrow(run, SCHEMA)


def exchange(mail: DataFrame, totals: DataFrame | None) -> DataFrame:
    """The tables of each context over all buckets: TOTALS rows, and a MAIL row back to each bucket that asked."""
    target = arrow_schema(SCHEMA)

    def solve(bucket, held):
        mails = [(r["other"], *unblob(r["data"])) for r in held if r["kind"] == MAIL]
        mails = [(src, np.cumsum(n), flag, value.astype(np.float64)) for src, n, flag, value in mails]
        base = [unblob(r["data"]) for r in held if r["kind"] == TOTALS]
        known = [np.cumsum(b[0]) for b in base]
        name, of = np.unique(np.concatenate([*(m[1] for m in mails), *known]), return_inverse=True)
        sums = np.bincount(of, np.concatenate([*(m[3] for m in mails), *(b[1].astype(np.float64) for b in base)]), minlength=len(name))
        out = [] if base else [(TOTALS, bucket, None, blob([steps(name), sums.astype(np.int64)]), None)]
        for src, n, flag, _ in mails:
            wanted = n[flag > 0]
            if len(wanted):
                out.append((MAIL, src, bucket, blob([sums[np.searchsorted(name, wanted)].astype(np.int64)]), None))
        return out

    return _by_bucket(mail if totals is None else mail.unionByName(totals), solve, target)


def sweeps(state: DataFrame, replies: DataFrame, buckets: int, hot: np.ndarray, model: dict, n: int, seed: int) -> DataFrame:
    """n Gibbs sweeps in each bucket: its new state, tables beyond one by context, root customers of frequent words."""
    target = arrow_schema(SCHEMA)
    d1, d0, log_s, log_s0 = model["d1"], model["d0"], stirling(model["d1"], 64), stirling(model["d0"], 64)
    hot_n, hot_s = model["hot_n"], model["hot_s"]

    def solve(bucket, held):
        words, c_w, fixed, name, w, v, c, *old = unblob(held[0]["data"])
        t = old[-1].astype(np.float64)
        words, w, v, c = np.cumsum(words), w.astype(np.int64), v.astype(np.int64), c.astype(np.int64)
        tables = np.concatenate([unblob(r["data"])[0] for r in held[1:]]).astype(np.float64) if len(held) > 1 else np.zeros(0)
        rng = np.random.default_rng([seed, bucket])
        hot_at = np.searchsorted(hot, words)
        is_hot = np.isin(words, hot)
        n_w = fixed + np.bincount(w, t, minlength=len(words))
        n_w[is_hot] = hot_n[hot_at[is_hot]]
        s_w = np.minimum(n_w, 1.0)
        s_w[is_hot] = hot_s[hot_at[is_hot]]
        base = 1.0 / (model["types"] + 1)
        total_n, total_s = model["customers"], model["tables"]
        kept = []
        for _ in range(n):
            # dishes take turns in four shares, so that each share sees the tables of the others
            for part in np.array_split(rng.permutation(len(w)), 4):
                x, y, z = w[part], v[part], c[part]
                away = n_w[x] - t[part]
                p = (np.maximum(away - d0 * np.minimum(s_w[x], away), 0) + (STRENGTH + d0 * total_s) * base) / (STRENGTH + np.maximum(total_n - t[part], 0))
                new = reseat(rng, z, np.maximum(tables[y] - t[part], 0), p, d1, log_s)
                change = new - t[part]
                np.add.at(tables, y, change)
                np.add.at(n_w, x, change)
                total_n += change.sum()
                t[part] = new
            cold = np.flatnonzero(~is_hot & (n_w > 0))
            before = s_w[cold].sum()
            s_w[cold] = reseat(rng, n_w[cold].round().astype(np.int64), total_s - s_w[cold], np.full(len(cold), base), d0, log_s0)
            total_s += s_w[cold].sum() - before
            kept.append((t.copy(), n_w.copy(), s_w.copy()))
        kept = kept[-model["samples"] :]
        arrays = [steps(words), c_w, fixed, name, w, v, c]
        arrays += [a.round().astype(np.int64) for k in kept for a in (np.where(is_hot, 0, k[1]), np.where(is_hot, 0, k[2]))] if model["last"] else []
        arrays += [k[0].astype(np.int64) for k in (kept if model["last"] else kept[-1:])]
        cold = ~is_hot
        own = [fixed + np.bincount(w, k[0], minlength=len(words)) for k in kept]
        x = [z for k, m in zip(kept, own, strict=True) for z in (float(m.sum()), float(k[2][cold].sum()))]
        out = [(STATE, bucket, None, blob(arrays), x)]
        extra = [np.bincount(v, k[0] - 1, minlength=len(name)).astype(np.int64) for k in (kept if model["last"] else kept[-1:])]
        out += _mails(name, np.ones(len(name), np.int64), extra, bucket, buckets)
        out += [(HOT, bucket, int(words[k].astype(np.int64)), None, [float(m[k]) for m in own]) for k in np.flatnonzero(is_hot & (c_w > 0)).tolist()]
        return out

    return _by_bucket(state.unionByName(replies), solve, target)


def scores(docs: DataFrame, folds: int = 7, held: int = 2, rounds: int = 2, samples: int = 2, chunk: int = 8 << 20, bucket_bytes: int = 8 << 20, hot_share: float = 1 / 2000, hot_sample: int = 4000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs."""
    spark = docs.sparkSession
    stage = Stage(spark, "lm")
    hot, size = frequent(docs, hot_share, hot_sample)
    buckets = max(16, -(-size // bucket_bytes))

    def ask(number, c: Chunk, ids, out_of):
        for b, i, j, asked in c.parts():
            n = np.bincount(np.searchsorted(asked, c.w[i:j]), minlength=len(asked))
            yield ASKED, b, number, blob([steps(c.words[asked]), n, names_of(c.words[c.v[i:j]]), c.count[i:j], np.array([c.check])]), None

    ship_package(spark)
    asks = chunks(docs, ask, SCHEMA, folds, held, chunk, buckets, hot)
    built = stage.write(build(asks, buckets, hot), "built")
    of = lambda df, kind: df.filter(F.col("kind") == kind)
    total, types, n1, n2, r1, r2, customers = _sums(of(built, STATE), 7)
    hot_c, hot_n = _hot_sums(built, hot, 2).T
    model = {"d1": discount(n1, n2), "d0": discount(r1 + (hot_n == 1).sum(), r2 + (hot_n == 2).sum()), "types": types + (hot_c > 0).sum(), "samples": samples, "hot_n": hot_n, "hot_s": np.minimum(hot_n, 1.0), "customers": customers}
    model["tables"] = model["types"]
    met = stage.write(exchange(of(built, MAIL), None), "met")
    totals = of(met, TOTALS)
    state, replies = of(built, STATE), of(met, MAIL)
    rng = np.random.default_rng(5)
    log_s0 = stirling(model["d0"], 64)
    for k in range(rounds):
        model = model | {"last": k == rounds - 1}
        swept = stage.write(sweeps(state, replies, buckets, hot, model, samples, 100 + k), f"swept-{k}")
        sums = np.array(_sums(of(swept, STATE), 2 * samples)).reshape(samples, 2)
        hot_all = _hot_sums(swept, hot, samples)
        of_hot = [reseat(rng, m.round().astype(np.int64), model["tables"] - model["hot_s"], np.full(len(m), 1.0 / (model["types"] + 1)), model["d0"], log_s0) for m in hot_all.T]
        model = model | {"hot_n": hot_all[:, -1], "hot_s": of_hot[-1], "customers": sums[-1, 0], "tables": sums[-1, 1] + of_hot[-1].sum()}
        state = of(swept, STATE)
        if not model["last"]:
            replies = of(stage.write(exchange(of(swept, MAIL), totals), f"met-{k}"), MAIL)
    customers, tables = sums[:, 0], [sums[s, 1] + of_hot[s].sum() for s in range(samples)]
    d1, d0, types, trained = model["d1"], model["d0"], model["types"], int(total)
    floor = 1.0 / (types + 1)
    answer_schema = "chunk long, bucket long, data binary"

    def root(n, s, k):
        return (np.maximum(n - d0 * s, 0) + (STRENGTH + d0 * tables[k]) * floor) / (STRENGTH + customers[k])

    def answers(bucket, rows):
        if rows[0]["kind"] != STATE:
            return
        words, c_w, _, _, _, _, c, *rest = unblob(rows[0]["data"])
        words = np.cumsum(words)
        at_root, t = rest[: 2 * samples], rest[2 * samples :]
        sums_ = []
        mails = [unblob(r["data"]) for r in rows if r["kind"] == MAIL]
        base = [unblob(r["data"]) for r in rows if r["kind"] == TOTALS]
        name = np.cumsum(base[0][0]) if base else np.zeros(0, np.uint64)
        own = np.searchsorted(name, names_of(words))
        there = own < len(name)
        there[there] = name[own[there]] == names_of(words)[there]
        for s in range(samples):
            more = np.zeros(len(name))
            for m in mails:
                more[np.searchsorted(name, np.cumsum(m[0]))] += m[2 + s]
            of_word = np.zeros(len(words), np.int64)
            of_word[there] = (more + base[0][1])[own[there]].astype(np.int64) if base else 0
            sums_.append(of_word)
        for r in rows:
            if r["kind"] == ASKED:
                asked, code, refs, check = unblob(r["data"])
                asked, refs = np.cumsum(asked).astype(np.int64), _unfolded(refs)
                columns = [c_w, *at_root, *sums_]
                parts = [code, *[a[asked] for a in columns], c[refs], *[x[refs] for x in t], check]
                yield r["other"], bucket, blob(parts)

    target = arrow_schema(answer_schema)

    def answer(it):
        now, held_ = None, []
        for row in _rows(it):
            if row["bucket"] != now:
                for out in answers(now, held_) if held_ else ():
                    yield as_batch({x: [y] for x, y in zip(target.names, out, strict=True)}, target)
                now, held_ = row["bucket"], []
            held_.append(row)
        for out in answers(now, held_) if held_ else ():
            yield as_batch({x: [y] for x, y in zip(target.names, out, strict=True)}, target)

    last_mail = of(swept, MAIL)
    everything = reduce(DataFrame.unionByName, [state, of(built, ASKED), last_mail, totals])
    answered = everything.repartition("bucket").sortWithinPartitions("bucket", "kind", "other").mapInArrow(answer, answer_schema)
    final = 1 << 40

    def texts(number, ch: Chunk, ids, out_of):
        nulls = np.array([i is None for i in ids])
        own = np.array([i or 0 for i in ids], np.int64).view(np.uint64)
        word = ch.w[ch.pair]
        parts = [own, nulls, out_of, ch.lengths, word, steps(ch.words)]
        yield number, final, blob(parts)

    asked_texts = chunks(docs, texts, answer_schema, folds, held, chunk, buckets, hot)
    out_schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out_target = arrow_schema(out_schema)

    def add_up(it):
        held_ = []
        for row in _rows(it):
            if row["bucket"] != final:
                held_.append((row["bucket"], unblob(row["data"])))
                continue
            ids, nulls, out_of, lengths, word, words = unblob(row["data"])
            words, lengths = np.cumsum(words), lengths.astype(np.int64)
            edges = np.concatenate([[0], np.cumsum(lengths)])
            flat = words[word.astype(np.int64)]
            ch = Chunk([flat[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], out_of > 0, buckets, hot)
            if any(int(x[-1][0]) != ch.check for _, x in held_):
                raise ValueError("documents were read in another order the second time; write them to a table first")
            n = len(words)
            c_w, at_root, sums_ = np.zeros(n), np.zeros((2 * samples, n)), np.zeros((samples, n))
            count, t = np.zeros(len(ch.w)), np.zeros((samples, len(ch.w)))
            got = dict(held_)
            held_ = []
            for b, i, j, asked in ch.parts():
                if b not in got:
                    continue
                code, *columns = got[b]
                mine = ch.home[asked] == b
                for a, x in zip([c_w, *at_root, *sums_], columns, strict=False):
                    a[asked[mine]] = x[mine]
                count[i:j], t[:, i:j] = code, code > 0
                often = i + np.flatnonzero(code == 2)
                count[often] = columns[1 + 3 * samples]
                for s in range(samples):
                    t[s, often] = columns[2 + 3 * samples + s]
            is_hot = np.flatnonzero(np.isin(words, hot))
            of = np.searchsorted(hot, words[is_hot])
            c_w[is_hot] = hot_c[of]
            for s in range(samples):
                at_root[2 * s, is_hot], at_root[2 * s + 1, is_hot] = hot_all[of, s], of_hot[s][of]
            c_v = c_w.copy()
            c_v[words == BEGIN] = c_begin
            p = np.zeros(len(ch.w))
            for s in range(samples):
                share = (STRENGTH + d1 * sums_[s]) / (STRENGTH + c_v)
                p += np.maximum(count - d1 * t[s], 0) / (STRENGTH + c_v[ch.v]) + share[ch.v] * root(at_root[2 * s], at_root[2 * s + 1], s)[ch.w]
            log_p = np.log10(p / samples)[ch.pair]
            base = np.log10((c_w + 1) / (trained + types + 1))[ch.w[ch.pair]]
            known = (c_w > 0)[ch.w[ch.pair]]
            yield as_batch(
                {
                    "doc_id": [None if z else i for i, z in zip(ids.view(np.int64).tolist(), nulls.tolist(), strict=True)],
                    "held_out": out_of > 0,
                    "n_tokens": lengths,
                    "n_known": np.add.reduceat(known.astype(np.int64), ch.first),
                    "train_tokens": np.full(len(ids), trained, np.int64),
                    "base_score": np.add.reduceat(base, ch.first),
                    "score": np.add.reduceat(log_p, ch.first),
                },
                out_target,
            )

    # each training document has one end, so as many customers sit in the restaurant of the beginning
    c_begin = float(_count_trained(docs, folds, held))
    return answered.unionByName(asked_texts).repartition("chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(add_up, out_schema)


def _count_trained(docs: DataFrame, folds: int, held: int) -> int:
    from docloom.llm.common import crc_column

    return docs.filter(crc_column(F.col("doc_id"), folds) != held).count()


def _sums(rows: DataFrame, n: int) -> list[float]:
    return list(rows.agg(*[F.coalesce(F.sum(F.col("x")[k]), F.lit(0.0)).alias(f"x{k}") for k in range(n)]).first())


def _hot_sums(rows: DataFrame, hot: np.ndarray, n: int) -> np.ndarray:
    """Sums over all buckets for the frequent words, a row for each."""
    out = np.zeros((len(hot), n))
    got = rows.filter(F.col("kind") == HOT).groupBy("other").agg(*[F.sum(F.col("x")[k]) for k in range(n)]).collect()  # frequent words
    for r in got:
        out[np.searchsorted(hot, np.int64(r[0]).astype(np.uint64))] = r[1:]
    return out
