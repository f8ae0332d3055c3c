"""Language identification by fusing evidence under Bayes' rule.

Four sources speak for each language l of a page: the likelihood of its main text under byte n-grams,
the language its markup declares, the address (country suffix of the host and a two-letter first
path segment), and a prior of its host. The n-gram model is fitted on at most `max_labelled`
documents whose language is known, into `1 << BITS` hashed cells. What declarations and addresses
are worth is counted, not assumed: over all pages, soft counts of text-only posteriors give
P(value | l). Values are language subtags and two-letter codes, so these tables have at most 678 rows.

Host priors are grouped sums of the same posteriors, smoothed hierarchically: a host towards its
domain, a domain towards all pages. A page's own vote is taken out of its host's sums. Texts are
read once; only numbers of a page are shuffled, and hosts are summed before they meet their domains.

Defined cases: a null or empty page, or one without text, is judged by the other evidence; a null
address has the empty host; without labelled documents the language is null and the probability 0;
ties go to the language first in order; repeated pages count each, repeated documents once; a very long
page is read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Stage, map_batches, mix64
from docloom.llm.html import main_text

BITS = 16
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})", re.I)


def cells(text: str) -> np.ndarray:
    """Hashed cells of the byte 2-, 3- and 4-grams of a lower-cased text."""
    raw = np.frombuffer((" " + text.lower() + " ").encode(), np.uint8).astype(np.uint64)
    out = []
    for n in (2, 3, 4):
        if len(raw) >= n:
            g = np.full(len(raw) - n + 1, n, np.uint64)
            for j in range(n):
                g = (g << np.uint64(8)) | raw[j : len(raw) - n + 1 + j]
            out.append(mix64(g) >> np.uint64(64 - BITS))
    return np.concatenate(out).astype(np.int64)


def fit(docs: DataFrame, max_labelled: int = 4000, least_share: float = 0.004) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities of cells (a row for each language).

    The sample has at most `max_labelled` ids, one text each, and languages with a lesser share of it than
    `least_share` are taken for errors, so the table has at most 1 / least_share rows.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    chosen = known.select("doc_id", "lang").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(max_labelled)
    by_lang = {r["lang"]: r["n"] for r in chosen.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # of max_labelled rows
    often = [k for k, n in by_lang.items() if n >= least_share * sum(by_lang.values())]
    one = F.min(F.struct(F.xxhash64("text").alias("t"), "text")).alias("one")
    rows = known.join(F.broadcast(chosen.filter(F.col("lang").isin(often))), ["doc_id", "lang"])
    rows = rows.groupBy("doc_id", "lang").agg(one).select("lang", "one.text")  # at most max_labelled rows

    def count(batch):
        by: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by[lang] = by.get(lang, 0) + np.bincount(cells(text), minlength=1 << BITS)
        lang, cell, n = [], [], []
        for k, v in by.items():
            at = np.flatnonzero(v)
            lang += [k] * len(at)
            cell.append(at)
            n.append(v[at])
        return {"lang": lang, "cell": np.concatenate(cell) if cell else [], "n": np.concatenate(n) if n else []}

    got = map_batches(rows, count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()  # languages x cells
    langs = sorted(got["lang"].unique().tolist())
    table = np.full((len(langs), 1 << BITS), 0.1)
    for k, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        table[k, own["cell"].to_numpy()] += own["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def text_posterior(text: str, logs: np.ndarray, most: float = 60.0) -> np.ndarray:
    """P(l | text) under equal priors; n-grams overlap, so their log odds count a third, up to `most`."""
    if not text:
        return np.full(len(logs), 1 / len(logs))
    s = logs[:, cells(text)].sum(axis=1, dtype=np.float64) / 3
    s = np.maximum(s - s.max(), -most)
    p = np.exp(s)
    return p / p.sum()


def identify(pages: DataFrame, docs: DataFrame, max_labelled: int = 4000, host_weight: float = 5.0, domain_weight: float = 20.0) -> DataFrame:
    """page_id, url, language, probability, text_language, declared, host of each row of pages."""
    spark = pages.sparkSession
    stage = Stage(spark, "langid")
    langs, logs = fit(docs, max_labelled)
    n = len(langs)
    if not n:
        return pages.select("page_id", "url", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("probability"), F.lit(None).cast("string").alias("text_language"), F.lit("").alias("declared"), F.lit("").alias("host"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))
    path = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*/([A-Za-z]{2})(?:[-_][A-Za-z]+)?(?:[/?#]|$)", 1))

    def read(batch):
        pages_ = batch.column("html").to_pylist()
        said = [(m[1].lower()[:2] if (m := DECLARED.search(h or "")) else "") for h in pages_]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "host": batch.column("host"), "path": batch.column("path"), "declared": [s if s in langs or not s else "?" for s in said], "p": [text_posterior(main_text(h), logs).tolist() for h in pages_]}

    schema = "page_id long, url string, host string, path string, declared string, p array<double>"
    seen = map_batches(pages.select("page_id", "url", "html", host.alias("host"), path.alias("path")), read, schema)
    seen = stage.write(seen.withColumn("suffix", F.regexp_extract("host", r"\.([a-z]{2})$", 1)), "seen")
    votes = [F.sum(F.col("p")[k]).alias(f"v{k}") for k in range(n)]
    get = lambda r: np.array([r[f"v{k}"] for k in range(n)])
    everything = seen.agg(*votes).first()
    overall = (get(everything) if everything["v0"] is not None else np.zeros(n)) + 1.0
    share = overall / overall.sum()
    log_of: dict[str, dict[str, list[float]]] = {}
    for kind in ("declared", "suffix", "path"):  # at most 678 rows each
        rows = {r[kind]: get(r) for r in seen.groupBy(kind).agg(*votes).collect()}
        all_ = sum(rows.values(), np.zeros(n))
        log_of[kind] = {v: np.log((c + c.sum() / max(all_.sum(), 1e-9)) / (all_ + 1)).tolist() for v, c in rows.items()}
    of_host = seen.groupBy("host").agg(*votes)
    of_host = of_host.withColumn("domain", F.regexp_extract("host", r"([^.]*\.[^.]*)$", 1))
    of_domain = of_host.groupBy("domain").agg(*[F.sum(f"v{k}").alias(f"d{k}") for k in range(n)])
    arr = lambda c: F.array(*[F.col(f"{c}{k}") for k in range(n)])
    hosts = stage.write(of_host.join(of_domain, "domain").select("host", arr("v").alias("at_host"), arr("d").alias("at_domain")), "hosts")
    joined = seen.join(hosts, "host")

    def fuse(batch):
        p = np.array(batch.column("p").to_pylist()).reshape(-1, n)
        at_host, at_domain = (np.maximum(np.array(batch.column(c).to_pylist()).reshape(-1, n) - own, 0) for c, own in (("at_host", p), ("at_domain", p)))
        prior = (at_domain + domain_weight * share) / (at_domain.sum(axis=1, keepdims=True) + domain_weight)
        prior = (at_host + host_weight * prior) / (at_host.sum(axis=1, keepdims=True) + host_weight)
        s = np.log(np.maximum(p, 1e-26)) + np.log(prior)
        for kind in ("declared", "suffix", "path"):
            s += np.array([log_of[kind][v] for v in batch.column(kind).to_pylist()])
        q = np.exp(s - s.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        best, text = q.argmax(axis=1), p.argmax(axis=1)
        return {c: batch.column(c) for c in ("page_id", "url", "declared", "host")} | {"language": [langs[k] for k in best], "probability": q[np.arange(len(q)), best], "text_language": [langs[k] for k in text]}

    return map_batches(joined, fuse, "page_id long, url string, language string, probability double, text_language string, declared string, host string")
