"""Registered queries: ballots of retrieval, dense, sparse and late."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decay
from ..functions import text as T
from ..operators import retrieval as R
from . import views as V

QUERIES: dict = {}
ORACLES: dict = {}


def _lexical(name: str, scorer: str, k: int = 10):
    def run(spark, d):
        hits = R.search_lexical(V.corpus(spark, d), V.asked(spark, d), scorer, k, digits=6)
        return hits.select("qid", "id", F.round("score", 6).alias("score"), "rank")

    QUERIES[name] = run
    ORACLES[name] = V.lexical_sql(R.scorer_named(scorer), k)


_lexical("bm25", "bm25")
_lexical("bm25_plus", "bm25+")
_lexical("dirichlet", "dirichlet")


def query_stats(spark, d):
    q = R.query_terms(V.asked(spark, d))
    i = R.build_index(V.corpus(spark, d), q)
    return i.terms.crossJoin(F.broadcast(i.stats)).select("term", "df", F.col("cf").cast("long").alias("cf"), F.round(R.idf(F.col("n"), F.col("df")), 6).alias("idf"), "n", "total", F.round("avg", 6).alias("avg"))


QUERIES["query_stats"] = query_stats
ORACLES["query_stats"] = f"WITH {V.INDEX} SELECT term, df, CAST(cf AS BIGINT) AS cf, round({V.IDF}, 6) AS idf, n, CAST(total AS BIGINT) AS total, round(av, 6) AS avg FROM tm CROSS JOIN st WHERE term IN (SELECT term FROM qt)"


def index_postings(spark, d):
    i = R.build_index(V.corpus(spark, d))
    return i.postings.groupBy("id", "len").agg(F.count(F.lit(1)).alias("terms"), F.max("c").cast("long").alias("most"))


QUERIES["index_postings"] = index_postings
ORACLES["index_postings"] = f"WITH {V.INDEX} SELECT id, len, count(*) AS terms, CAST(max(c) AS BIGINT) AS most FROM p GROUP BY id, len"


def index_replace(spark, d):
    """The index after every document marked toxic gave way to a line that names its source; terms beside the new size."""
    docs = V.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source"))
    marked = docs.join(V.table(spark, d, "labels").where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    rows = lambda df, c: df.select(F.col("doc_id").alias("id"), T.tokens(F.col(c)).alias("tokens"))
    i = R.replace(R.build_index(rows(docs, "text")), rows(marked, "text"), rows(marked, "source"))
    held = i.postings.groupBy("term").agg(F.countDistinct("id").alias("held"))
    return i.terms.join(held, "term").crossJoin(F.broadcast(i.stats.select("n", "total")))  # one row


QUERIES["index_replace"] = index_replace
ORACLES["index_replace"] = f"""WITH x AS (SELECT doc_id AS id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN coalesce(source, '') ELSE coalesce(text, '') END AS text FROM documents),
    t AS (SELECT id, {V.words_sql('text')} AS t FROM x), f AS (SELECT id, unnest(t) AS term FROM t)
    SELECT term, count(DISTINCT id) AS df, CAST(count(*) AS DOUBLE) AS cf, count(DISTINCT id) AS held, (SELECT count(*) FROM t) AS n, (SELECT CAST(sum(len(t)) AS BIGINT) FROM t) AS total FROM f GROUP BY term"""


def bm25_filtered_after(spark, d):
    """Filters come after scoring: the corpus statistics are of all documents."""
    hits = R.score(R.build_index(V.corpus(spark, d), q := R.query_terms(V.asked(spark, d))), q, "bm25+")
    kept = hits.join(V.corpus(spark, d).where("source = 'src1'").select("id"), "id", "left_semi").withColumn("score", F.round("relevance", 6))
    return R.top_k(kept.select("qid", "id", "score"), 5)


QUERIES["bm25_filtered_after"] = bm25_filtered_after
ORACLES["bm25_filtered_after"] = f"""WITH {V.INDEX}, s AS (
    SELECT qid, id, round(sum(qt.w * ({V.TERM['bm25+']})), 6) AS score FROM p JOIN tm USING (term) JOIN qt USING (term) CROSS JOIN st GROUP BY qid, id)
    SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s WHERE id IN (SELECT doc_id FROM documents WHERE source = 'src1')) WHERE rank <= 5"""


def rm3(spark, d):
    hits = R.search_expanded(V.corpus(spark, d), V.asked(spark, d), 10, digits=6)
    return hits.select("qid", "id", F.round("score", 6).alias("score"), "rank")


QUERIES["rm3"] = rm3
ORACLES["rm3"] = f"""WITH {V.INDEX}, f AS (
    SELECT qid, id, sum(qt.w * ({V.TERM['bm25']})) AS s FROM p JOIN tm USING (term) JOIN qt USING (term) CROSS JOIN st GROUP BY qid, id
), t10 AS (SELECT qid, id, s FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS r FROM f) WHERE r <= 10),
sh AS (SELECT qid, id, greatest(s, 0.0) / sum(greatest(s, 0.0)) OVER (PARTITION BY qid) AS share FROM t10),
fb AS (SELECT qid, term, sum(share * c / len) AS pr FROM sh JOIN p USING (id) WHERE share > 0 GROUP BY qid, term),
b10 AS (SELECT qid, term, 0.5 * pr / sum(pr) OVER (PARTITION BY qid) AS w FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(pr, 12) DESC, term) AS r FROM fb) WHERE r <= 10),
ws AS (SELECT qid, term, sum(w) AS w FROM (SELECT qid, term, 0.5 * w / sum(w) OVER (PARTITION BY qid) AS w FROM qt UNION ALL SELECT qid, term, w FROM b10) GROUP BY qid, term),
s AS (SELECT qid, id, round(sum(ws.w * ({V.TERM['bm25+']})), 6) AS score FROM p JOIN tm USING (term) JOIN ws USING (term) CROSS JOIN st GROUP BY qid, id)
SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10"""


def scan_linear(spark, d):
    c = V.corpus(spark, d).withColumn("bonus", F.lit(0.0))
    return R.search_linear(c, V.asked(spark, d), 5)


QUERIES["scan_linear"] = scan_linear
ORACLES["scan_linear"] = f"""WITH d AS (SELECT doc_id AS id, list_distinct({V.words_sql('text')}) AS t FROM documents), q AS (SELECT item_id AS qid, {V.words_sql('text')} AS t FROM benchmark),
h AS (SELECT id, unnest(t) AS h FROM d), hw AS (SELECT DISTINCT h FROM h), qw AS (SELECT qid, term, count(*) AS w FROM (SELECT qid, unnest(t) AS term FROM q) GROUP BY ALL), qd AS (SELECT DISTINCT term FROM qw),
pr AS (SELECT h, term, CASE WHEN h = term THEN 4.0 WHEN length(term) < 4 THEN 0.0 WHEN starts_with(h, term) THEN 3.0 WHEN contains(h, term) THEN 2.0 WHEN levenshtein(h, term) <= 1 THEN 1.5 ELSE 0.0 END AS s FROM hw CROSS JOIN qd),
b AS (SELECT id, term, max(s) AS s FROM h JOIN pr USING (h) WHERE s > 0 GROUP BY id, term), s AS (SELECT qid, id, sum(s * w) AS score FROM b JOIN qw USING (term) GROUP BY qid, id)
SELECT qid, id, CAST(score AS DOUBLE) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5"""


def prefix_ballot(spark, d):
    return R.search_prefix(V.corpus(spark, d), V.asked(spark, d), 5).select("qid", "id", F.round("score", 6).alias("score"), "rank")


QUERIES["prefix_ballot"] = prefix_ballot
ORACLES["prefix_ballot"] = f"""WITH d AS (SELECT doc_id AS id, {V.words_sql('text')} AS t FROM documents), q0 AS (SELECT item_id AS qid, {V.words_sql('text')} AS t FROM benchmark),
q AS (SELECT DISTINCT qid, unnest(t) AS term FROM q0),
p AS (SELECT id, term, count(*) AS c FROM (SELECT id, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL), tm AS (SELECT term, count(*) AS df FROM p GROUP BY term),
qq AS (SELECT qid, q.term, row_number() OVER (PARTITION BY qid ORDER BY coalesce(df, 0) DESC, q.term) AS dr FROM q LEFT JOIN tm ON tm.term = q.term),
h AS (SELECT qid, id, sum(ln(1 + c)) AS wt FROM p JOIN q USING (term) GROUP BY qid, id),
lv AS (SELECT h.qid, h.id, wt, coalesce(max(CASE WHEN p.term IS NULL THEN dr END), 0) AS lv FROM h JOIN qq ON qq.qid = h.qid LEFT JOIN p ON p.id = h.id AND p.term = qq.term GROUP BY ALL),
b AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(wt, 9) DESC, id) AS rank FROM (SELECT *, min(lv) OVER (PARTITION BY qid) AS ml FROM lv) WHERE lv = ml)
SELECT qid, id, round((max(rank) OVER (PARTITION BY qid) - rank + 1) / CAST(max(rank) OVER (PARTITION BY qid) AS DOUBLE), 6) AS score, rank FROM b WHERE rank <= 5"""


def dense_topk(spark, d):
    e = V.table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    hits = R.search_dense(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), q, 10, digits=6)
    return hits.select("qid", "id", F.round("score", 6).alias("score"), "rank")


COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
QUERIES["dense_topk"] = dense_topk
ORACLES["dense_topk"] = f"""WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS id, round({COS}, 6) AS score, {COS} AS c FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 20 = 0)
SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s WHERE c > 0) WHERE rank <= 10"""


def dense_trust(spark, d):
    """Cosine + 0.1 trust; trust here from the label."""
    e = V.table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    rows = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    hits = R.search_dense(rows, q, 8, bonus=F.lit(0.1) * F.coalesce(F.col("label"), F.lit(0)) / 10.0, digits=6)
    return hits.select("qid", "id", F.round("score", 6).alias("score"), F.round("cosine", 4).alias("cosine"), "rank")


QUERIES["dense_trust"] = dense_trust
ORACLES["dense_trust"] = f"""WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS id, {COS} AS c, round({COS} + 0.1 * coalesce(b.label, 0) / 10.0, 6) AS score FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 20 = 0)
SELECT qid, id, score, round(c, 4) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s WHERE c > 0) WHERE rank <= 8"""


def sparse_dot(spark, d):
    """Term counts as sparse vectors."""
    def vec(df, key):
        flat = df.select(key, F.explode("tokens").alias("t")).groupBy(key, "t").agg(F.count(F.lit(1)).cast("double").alias("c"))
        return flat.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("t", "c"))).alias("vector"))

    return R.search_sparse(vec(V.corpus(spark, d), "id"), vec(V.asked(spark, d), "qid"), 10)


QUERIES["sparse_dot"] = sparse_dot
ORACLES["sparse_dot"] = f"""WITH {V.INDEX}, s AS (SELECT qid, id, sum(qt.w * p.c) AS score FROM p JOIN qt USING (term) GROUP BY qid, id)
SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10"""


def max_sim(spark, d):
    """Vectors cut into four token vectors of 16."""
    cut = lambda c: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(c, i * 16 + 1, F.lit(16)))
    e = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), cut(F.col("embedding")).alias("vectors"))
    hits = R.search_late(e, e.where("id % 20 = 0").select(F.col("id").alias("qid"), "vectors"), 5, digits=6)
    return hits.select("qid", "id", F.round("score", 6).alias("score"), "rank")


QUERIES["max_sim"] = max_sim
ORACLES["max_sim"] = """WITH t AS (SELECT vec_id, [CAST(list_slice(embedding, i * 16 + 1, i * 16 + 16) AS DOUBLE[]) FOR i IN range(0, 4)] AS v FROM embeddings),
x AS (SELECT vec_id, unnest(v) AS v, generate_subscripts(v, 1) AS i FROM t), m AS (SELECT a.vec_id AS qid, b.vec_id AS id, a.i, max(list_cosine_similarity(a.v, b.v)) AS s FROM x a CROSS JOIN x b WHERE a.vec_id % 20 = 0 GROUP BY ALL),
s AS (SELECT qid, id, round(sum(s), 6) AS score FROM m GROUP BY qid, id HAVING sum(s) > 0)
SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5"""


def cosine_pairs(spark, d):
    """Each vector and the next by id."""
    e = V.table(spark, d, "embeddings").select("vec_id", "embedding")
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("v")), "vec_id")
    return p.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.round(decay.cosine(F.col("embedding"), F.col("v")), 6).alias("cosine"))


QUERIES["cosine_pairs"] = cosine_pairs
ORACLES["cosine_pairs"] = f"SELECT a.vec_id AS a, b.vec_id AS b, round({COS}, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def card_paragraphs(spark, d):
    """Paragraphs of documents as cards, scanned for the queries; the five best of each."""
    docs = V.table(spark, d, "documents").select("doc_id", F.posexplode(T.entries(F.coalesce("text", F.lit("")))).alias("n", "p"))
    cards = docs.select((F.col("doc_id") * 100_000 + F.col("n")).alias("id"), T.tokens(F.col("p")).alias("tokens"), F.lit(0.0).alias("bonus"))
    return R.search_linear(cards, V.asked(spark, d), 5)


SPLIT = "list_filter([regexp_replace(x, '^\\s+|\\s+$', '', 'g') FOR x IN string_split_regex(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '\\n(?:[^\\S\\n]*\\n)+')], lambda x: x <> '')"
QUERIES["card_paragraph_scores"] = card_paragraphs
ORACLES["card_paragraph_scores"] = f"""WITH l AS (SELECT doc_id * 100000 + generate_subscripts({SPLIT}, 1) - 1 AS id, unnest({SPLIT}) AS p FROM documents),
d AS (SELECT id, list_distinct({V.words_sql('p')}) AS t FROM l), q AS (SELECT item_id AS qid, {V.words_sql('text')} AS t FROM benchmark),
h AS (SELECT id, unnest(t) AS h FROM d), hw AS (SELECT DISTINCT h FROM h), qw AS (SELECT qid, term, count(*) AS w FROM (SELECT qid, unnest(t) AS term FROM q) GROUP BY ALL), qd AS (SELECT DISTINCT term FROM qw),
pr AS (SELECT h, term, CASE WHEN h = term THEN 4.0 WHEN length(term) < 4 THEN 0.0 WHEN starts_with(h, term) THEN 3.0 WHEN contains(h, term) THEN 2.0 WHEN levenshtein(h, term) <= 1 THEN 1.5 ELSE 0.0 END AS s FROM hw CROSS JOIN qd),
b AS (SELECT id, term, max(s) AS s FROM h JOIN pr USING (h) WHERE s > 0 GROUP BY id, term), s AS (SELECT qid, id, sum(s * w) AS score FROM b JOIN qw USING (term) GROUP BY qid, id)
SELECT qid, id, CAST(score AS DOUBLE) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5"""
