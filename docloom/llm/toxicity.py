"""Toxicity scores from a learned lexicon, matched through Levenshtein automata.

Learning uses at most `max_labelled` labelled documents, those whose ids hash lowest. Their words
give word beginnings that are far more frequent in toxic documents, stand after many different
words (else they only belong to a copied passage), and are as long as their counts allow. These are
the terms. A trie of the terms is intersected with the Levenshtein automaton of each: states are
sets of (trie node, edits left), built only as input reaches them, so a word costs one table
look-up for each letter and most words leave the automaton after a few letters.

A match is exact or misspelled, and stands in quotation marks or not. Counts of each kind, the most
matches in any window of `window` words, and the number of words go into a logistic regression
fitted on the same bounded sample. Whole texts are scored, each by itself: no shuffle of texts.

Defined cases: a null or empty text gets the score of a text without matches; labels that are null
or name no document are ignored, and repeated labels count once, toxic if any says so; without
labels of both kinds nothing is learned and every score is the smoothed share of toxic labels. Of rows
that share an id one text, that of the least hash, is learned from, and each row is scored; an empty table
of documents gives an empty result; other columns of any name are kept by `flag` and else ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import arrow_schema, as_batch, crc_column, map_batches, slices
from docloom.session import ship_package

WORD = re.compile(r"[^\W_]+")
MARKS = re.compile("[\"“”„«»‹›]")


@dataclass
class Options:
    max_labelled: int = 20_000
    folds: int = 5
    least_length: int = 4
    most_length: int = 12
    ratio: float = 20.0
    least_toxic: int = 3
    chance: float = 1e-4
    fuzzy_from: int = 5
    window: int = 40
    ridge: float = 1e-2


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    options: Options = field(default_factory=Options)


class Automaton:
    """The terms' trie under at most one edit; accepts words that begin with a term."""

    def __init__(self, terms: list[str], fuzzy_from: int):
        self.next: list[dict[str, int]] = [{}]
        self.end: list[bool] = [False]
        self.deep: list[bool] = [False]  # some term of fuzzy length passes here
        self.fuzzy: set[int] = set()  # or ends here
        for t in terms:
            at = 0
            long = len(t) >= fuzzy_from
            self.deep[0] |= long
            for c in t:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.end.append(False)
                    self.deep.append(False)
                at = self.next[at][c]
                self.deep[at] |= long
            self.end[at] = True
            if long:
                self.fuzzy.add(at)
        self.short = {t for t in terms if len(t) < fuzzy_from}
        self.table: dict[frozenset, dict[str, frozenset]] = {}
        self.start = self._close({(0, 1)} if self.deep[0] else {(0, 0)})

    def _close(self, states) -> frozenset:
        """With letters of the term left out."""
        out = set(states)
        for node, left in states:
            if left:
                out |= {(n, 0) for n in self.next[node].values() if self.deep[n]}
        return frozenset(out)

    def _step(self, states: frozenset, c: str) -> frozenset:
        out = set()
        for node, left in states:
            n = self.next[node].get(c)
            if n is not None:
                out.add((n, left))
            if left:
                out.add((node, 0))
                out |= {(m, 0) for m in self.next[node].values() if self.deep[m]}
        return self._close(out)

    def match(self, word: str) -> int:
        """2: begins with a term, 1: whole word is within one edit of a term, 0: neither."""
        at, table, node = self.start, self.table, 0
        exact = True
        for c in word:
            if exact:
                node = self.next[node].get(c, -1)
                if node < 0:
                    exact = False
                elif self.end[node]:
                    return 2
            row = table.get(at)
            if row is None:
                row = table[at] = {}
            to = row.get(c)
            if to is None:
                to = row[c] = self._step(at, c)
            at = to
            if not at:
                return 0
        return int(len(word) >= 4 and any(n in self.fuzzy for n, _ in at))


N_FEATURES = 6


def features(texts: list[str | None], model: Model, automaton: Automaton) -> np.ndarray:
    """One row for each text: 1, exact, misspelled, quoted, densest window, words."""
    lowered = [t.lower() if t else "" for t in texts]
    docs = [WORD.findall(t) for t in lowered]
    kind = {w: m for w in set().union(*docs) if (m := automaton.match(w))} if docs else {}
    out = np.zeros((len(texts), N_FEATURES))
    out[:, 0] = 1
    for k, words in enumerate(docs):
        out[k, 5] = np.log1p(len(words)) / 10
        at = np.array([i for i, w in enumerate(words) if w in kind] if kind else [], np.int64)
        if not len(at):
            continue
        exact = np.array([kind[words[i]] == 2 for i in at.tolist()])
        free = ~_quoted(lowered[k], at)
        a = at[free]
        dense = int((np.searchsorted(a, a + model.options.window) - np.arange(len(a))).max()) if len(a) else 0
        out[k, 1:5] = np.log1p([(free & exact).sum(), (free & ~exact).sum(), (~free).sum(), dense])
    return out


def _quoted(text: str, at: np.ndarray) -> np.ndarray:
    """Which of the words, by number, stand behind an odd number of quotation marks and before another one."""
    marks = np.array([m.start() for m in MARKS.finditer(text)], np.int64)
    if not len(marks):
        return np.zeros(len(at), bool)
    spans = np.array([m.span() for m in WORD.finditer(text)], np.int64)[at]
    return (np.searchsorted(marks, spans[:, 0]) % 2 == 1) & (marks[-1] >= spans[:, 1])


def _fit(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the constant is not shrunk."""
    w, pull = np.zeros(x.shape[1]), np.full(x.shape[1], ridge * len(y) ** 0.5)
    pull[0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull) + 1e-9 * np.eye(len(w)), x.T @ (y - p) - pull * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, o: Options) -> DataFrame:
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_column(F.col("doc_id"), o.folds) != 0))
    chosen = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(o.max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("t"), "text")).alias("one")
    return rows.groupBy("doc_id", "toxic").agg(one).select("doc_id", "one.text", "toxic")  # at most max_labelled rows


def learn(docs: DataFrame, labels: DataFrame, options: Options | None = None) -> Model:
    o = options or Options()
    ship_package(docs.sparkSession)
    rows = labelled_sample(docs, labels, o).select("text", "toxic").cache()

    def beginnings(words):
        for w in words:
            for n in range(o.least_length, min(len(w), o.most_length) + 1):
                yield w[:n]

    target = arrow_schema("p string, n0 long, n1 long")

    def count(it):
        own: dict[str, int] = {}  # toxic documents count 2^32

        def emit():
            n = np.fromiter(own.values(), np.int64, len(own))
            return as_batch({"p": list(own), "n0": n & 0xFFFFFFFF, "n1": n >> 32}, target)

        for batch in slices(it, 64):
            for t, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                one = 1 << 32 if y > 0 else 1
                for p in {""} | set(beginnings(set(WORD.findall(t.lower())) if t else ())):
                    own[p] = own.get(p, 0) + one
            if len(own) > 150_000:
                yield emit()
                own = {}
        if own:
            yield emit()

    counts = rows.mapInArrow(count, "p string, n0 long, n1 long").groupBy("p").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).cache()
    total = counts.filter("p = ''").first()
    n0, n1 = (total["n0"], total["n1"]) if total else (0, 0)
    model = Model(options=o)
    model.weights[0] = np.log((n1 + 0.5) / (n0 + 0.5))
    if n0 and n1:
        pure = counts.filter((F.col("p") != "") & (F.col("n1") >= o.least_toxic) & (F.col("n1") * n0 >= o.ratio * n1 * (F.col("n0") + 0.5)) & (_surprise(n1 / (n0 + n1)) >= -np.log(o.chance)))
        found = {r["p"]: r["n1"] for r in pure.collect()}  # beginnings of words of the bounded sample
        longer: dict[str, int] = {}  # the most that a beginning of one letter more has
        for q, n in found.items():
            longer[q[:-1]] = max(n, longer.get(q[:-1], 0))
        closed = {p for p in found if longer.get(p, 0) < 0.9 * found[p]}
        terms = {p for p in closed if not any(p[:k] in closed for k in range(o.least_length, len(p)))}
        model.terms = sorted(_diverse(rows, terms, found, o))
        automaton = Automaton(model.terms, o.fuzzy_from)
        m = model

        def describe(batch):
            d = batch.to_pydict()
            return {"x": list(features(d["text"], m, automaton)), "y": [float(v > 0) for v in d["toxic"]]}

        table = map_batches(rows, describe, "x array<double>, y double", 256).toPandas()  # at most max_labelled rows
        model.weights = _fit(np.array(table["x"].tolist()), table["y"].to_numpy(), o.ridge)
    rows.unpersist()
    counts.unpersist()
    return model


def _surprise(share: float):
    """Minus the log of Chernoff's bound on n1 of n0 + n1 documents being toxic if each is by `share`."""
    n1, n0 = F.col("n1"), F.col("n0")
    against = F.when(n0 > 0, n0 * F.log(n0 / ((n0 + n1) * (1 - share)))).otherwise(0.0)
    return n1 * F.log(n1 / ((n0 + n1) * share)) + against


def _diverse(rows: DataFrame, terms: set[str], found: dict[str, int], o: Options) -> list[str]:
    """Terms that follow many different words in toxic documents."""

    def before(batch):
        d, seen = batch.to_pydict(), set()
        for t, y in zip(d["text"], d["toxic"], strict=True):
            words = WORD.findall(t.lower()) if t and y else []
            for a, w in zip(["", *words], words, strict=False):
                for n in range(o.least_length, min(len(w), o.most_length) + 1):
                    if w[:n] in terms:
                        seen.add((w[:n], a))
        return {"p": [x[0] for x in seen], "a": [x[1] for x in seen]}

    n = map_batches(rows, before, "p string, a string", 256).groupBy("p").agg(F.countDistinct("a").alias("n")).collect()
    return [r["p"] for r in n if r["n"] >= min(0.25 * found[r["p"]], 100)]


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """doc_id, score (0 to 1) and the counts behind it, one row for each row of docs."""
    automaton = Automaton(model.terms, model.options.fuzzy_from)

    def run(batch):
        x = features(batch.column("text").to_pylist(), model, automaton)
        return {"doc_id": batch.column("doc_id"), "score": 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30))), "matches": np.expm1(x[:, 1:4]).sum(axis=1).round().astype(np.int64)}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, score double, matches long", 256)


def flag(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns kept, that are not toxic (score under 0.5)."""
    ship_package(docs.sparkSession)
    automaton = Automaton(model.terms, model.options.fuzzy_from)
    names = docs.columns

    def run(it):
        import pyarrow as pa

        for batch in slices(it, 256):
            x = features(batch.column(names.index("text")).to_pylist(), model, automaton)
            yield batch.filter(pa.array(x @ model.weights < 0))

    return docs.mapInArrow(run, docs.schema)
