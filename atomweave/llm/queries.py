"""The registered queries of the operators: opN_<name>, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_report

    return quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_report

    return jaccard_report(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_report

    return line_report(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import dedup_report

    return dedup_report(_table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import token_report

    return token_report(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import files_report

    return files_report(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_report

    return pii_report(_table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(_table(spark, sf_dir, "documents")).drop("spans")


#: The production mixture: odd sources weigh twice as much as even ones; Spanish is raised, English lowered.
WEIGHTS = {("odd",): 2.0, ("odd", "es"): 2.0, ("even", "es"): 2.0, ("odd", "en"): 0.5, ("even", "en"): 0.5}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_report

    return mix_report(_table(spark, sf_dir, "documents"), weights=WEIGHTS, fraction=0.8, epochs=4, seed=17)


QUERIES = {
    "op1_quality": op1_quality,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_line_dedup": op3_line_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_bpe": op5_bpe,
    "op6_token_files": op6_token_files,
    "op7_pii": op7_pii,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_mixing": op10_mixing,
}

ORACLES = {
    "op2_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w
        ), x AS (SELECT doc_id, len(s) AS n, unnest(s) AS k FROM s), o AS (
            SELECT a.doc_id AS i, b.doc_id AS j, a.n + b.n AS t, count(*) AS c FROM x a JOIN x b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL
        ), p AS (SELECT i, j FROM o WHERE 100 * c >= 80 * (t - c)), r(id, c) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT r.id, p.j FROM r JOIN p ON r.c = p.i
        ), m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
        SELECT s.doc_id, len(s.s) AS n_shingles, m.c AS component_id FROM s JOIN m ON m.id = s.doc_id""",
    "op3_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents
        ), k AS (
            SELECT doc_id, line, pos,
                   translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
        ), g AS (
            SELECT key, min(doc_id) AS lo, max(doc_id) AS hi FROM k WHERE length(key) >= 10 GROUP BY key
        ), m AS (
            SELECT k.doc_id, k.line, k.pos, coalesce(g.lo <> g.hi AND k.doc_id <> g.lo, false) AS gone FROM k LEFT JOIN g ON k.key = g.key
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op8_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL
        ), p AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE isfinite(list_cosine_similarity(a.e, b.e)) AND list_cosine_similarity(a.e, b.e) >= 0.93
        ), r(id, c) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, p.y FROM r JOIN p ON r.c = p.x
        ), n AS (SELECT x, count(*) AS n FROM p GROUP BY x), c AS (SELECT id, min(c) AS c FROM r GROUP BY id)
        SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept
        FROM embeddings e JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.x = e.vec_id""",
}
