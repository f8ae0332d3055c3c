"""The operators of this part applied to their tables, with DuckDB equivalents where SQL has them."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.llm import decontam, html, langid, lm, neardup, packing, suffix, tokenfile, tokens, toxicity, vectors
from docloom.llm.common import Stage, crc_column
from docloom.session import table

CAPACITY, VOCABULARY = 2048, 50_257


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokens.default_path(), CAPACITY)


def op2_minhash_near_dedup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85).drop("t")


def op3_suffix_array_dedup(spark, sf_dir):
    out = suffix.remove_repeats(table(spark, sf_dir, "documents"), 400, keep="none")
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_token_binary(spark, sf_dir):
    path = Stage(spark, "tokens").root
    tokenfile.write(table(spark, sf_dir, "documents"), path, tokens.default_path(), VOCABULARY)
    return tokenfile.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_html_extraction(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        (crc_column(F.col("doc_id"), model.options.folds) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "matches",
    )


def op7_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_lm_scoring(spark, sf_dir):
    return lm.scores(table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark, sf_dir):
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_minhash_near_dedup, op3_suffix_array_dedup, op4_token_binary, op5_html_extraction, op6_toxicity, op7_language_id, op8_benchmark_decontamination, op9_lm_scoring, op10_embedding_near_dedup)}


def _shingles(table_: str, key: str, k: int) -> str:
    """Distinct (key, g) of a table's texts: k-word shingles, or the whole of a shorter sequence."""
    low = f"translate(text, '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}')"
    words = f"list_filter(regexp_split_to_array({low}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    many = f"list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))"
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= {k} THEN {many} WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
        FROM (SELECT {key}, {words} AS w FROM {table_} WHERE text IS NOT NULL)"""


ORACLES: dict[str, str] = {
    "op2_minhash_near_dedup": f"""WITH RECURSIVE s AS MATERIALIZED ({_shingles('documents', 'doc_id', 3)}),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
        r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id, least(d.doc_id, coalesce(m.b, d.doc_id)) = d.doc_id AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id""",
    "op8_benchmark_decontamination": f"""WITH d AS ({_shingles('documents', 'doc_id', 5)}), i AS ({_shingles('benchmark', 'item_id', 5)}),
        n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
        c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i ON d.g = i.g GROUP BY 1, 2)
        SELECT doc_id, c.item_id, n_shared, n AS n_item, n_shared * 1.0::DOUBLE / n AS containment FROM c JOIN n ON n.item_id = c.item_id WHERE n_shared >= 0.8 * n""",
    "op10_embedding_near_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
        l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_sum(list_transform(a.e, lambda x, i: x * b.e[i])) >= 0.93 * sqrt(list_sum(list_transform(a.e, lambda x: x * x))) * sqrt(list_sum(list_transform(b.e, lambda x: x * x)))),
        r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        m AS (SELECT a, min(b) AS b FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(m.b, e.vec_id)) AS component_id, least(e.vec_id, coalesce(m.b, e.vec_id)) = e.vec_id AS kept
        FROM embeddings e LEFT JOIN m ON m.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
}
