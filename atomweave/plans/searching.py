"""Registered queries: the composite search and what builds on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock
from ..functions import text as T
from ..operators import fusion as FU
from ..operators import retrieval as R
from ..operators import search as SE
from . import views as V

QUERIES: dict = {}
ORACLES: dict = {}


def both(name: str, sql: str | None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def _claims(spark, d):
    own = V.table(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.array(F.col("source")).alias("entities"), (F.col("doc_id") % 10 / 10.0).alias("trust"), (F.col("doc_id") % 30).cast("double").alias("age_days"), (1.0 + F.col("doc_id") % 5).alias("stability"), (F.col("doc_id") % 50 == 0).alias("due"), F.lit("atom").alias("field"))
    return own


def _asked(spark, d):
    return V.table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.coalesce("text", F.lit("")).alias("text"))


@both("search_ranked", None)
def search_ranked(spark, d):
    hits = SE.search(_claims(spark, d), _asked(spark, d), FU.Panel(), limit=8)
    return hits.select("qid", "key", F.round("score", 6).alias("score"), "rank", "ballots", "of")


@both("search_reranked", None)
def search_reranked(spark, d):
    """The reranker here is the share of the query's words that the text holds."""
    def share(q, t):
        a = T.raw_tokens(q)
        return F.size(F.array_intersect(a, T.raw_tokens(t))) / F.greatest(F.size(a), F.lit(1))

    hits = SE.search(_claims(spark, d), _asked(spark, d), FU.Panel("rrf", "none", "off"), "relevance", 5, reranker=share)
    return hits.select("qid", "key", "rank", F.round("rerank_score", 6).alias("rerank_score"))


@both("fused_scored", None)
def fused_scored(spark, d):
    a = R.search_lexical(V.corpus(spark, d), V.asked(spark, d), "bm25", 50, digits=6)
    b = R.search_lexical(V.corpus(spark, d), V.asked(spark, d), "dirichlet", 50, digits=6)
    return SE.fused_scored(a, b).select("qid", "id", F.round("vote", 6).alias("vote"), "rank")


@both("activate_cue", None)
def activate_cue(spark, d):
    e = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    from ..operators import graph as G

    hits = R.search_dense(e, e.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector"), 5, digits=6).select("qid", F.col("id").alias("key"), "score", "rank", F.lit(1).alias("ballots"), F.lit(1).alias("of"))
    return SE.activate(hits, G.knn(e, 5).drop("workspace")).select("qid", "id", F.round("energy", 6).alias("energy"), "weak")


@both("due_hits", f"WITH {V.ATOMS} SELECT id, round(2 + 0.1 * trust + pow(0.5, {V.DAYS.format('ts')} / 14.0), 6) AS score FROM atoms WHERE due_at <= now_ AND NOT tombstone")
def due_hits(spark, d):
    return SE.due_hits(V.atoms(spark, d).where("not tombstone"), V.now()).select("id", F.round("score", 6).alias("score"))


@both("recency_arm", f"""WITH {V.INDEX}, s AS (SELECT qid, id, sum(qt.w * ({V.TERM['bm25']})) AS s FROM p JOIN tm USING (term) JOIN qt USING (term) CROSS JOIN st GROUP BY qid, id), t AS (SELECT qid, id, s FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, id) AS n FROM s) WHERE n <= 10),
    w AS (SELECT qid, id, s * exp(-ln(2) / 14.0 * (id % 30)) AS s FROM t) SELECT qid, id, round(s, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS rank FROM w""")
def recency_arm(spark, d):
    hits = R.search_lexical(V.corpus(spark, d), V.asked(spark, d), "bm25", 10, digits=6)
    return SE.recency_arm(hits.withColumn("age_days", (F.col("id") % 30).cast("double"))).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@both("window_parse", """WITH e AS (SELECT event_id AS id, event_id % 7 AS n, DATE '2024-03-20' AS day FROM events) SELECT id,
    CAST(CASE n WHEN 0 THEN DATE '2024-02-03' WHEN 1 THEN day - 4 WHEN 2 THEN day - 21 WHEN 3 THEN DATE '2024-03-11' WHEN 4 THEN DATE '2024-02-01' WHEN 5 THEN DATE '2023-11-01' END AS VARCHAR) AS start,
    CAST(CASE n WHEN 0 THEN DATE '2024-02-03' WHEN 1 THEN day - 2 WHEN 2 THEN day - 7 WHEN 3 THEN DATE '2024-03-17' WHEN 4 THEN DATE '2024-02-29' WHEN 5 THEN DATE '2023-11-30' END AS VARCHAR) AS end_ FROM e""")
def window_parse(spark, d):
    n = F.col("event_id") % 7
    q = F.when(n == 0, "What on 2024/02/03?").when(n == 1, "Who called three days ago?").when(n == 2, "What did I buy two weeks ago").when(n == 3, "last week?").when(n == 4, "Last month?").when(n == 5, "trip in November").otherwise("plain question")
    w = SE.window_of(q, SE.asked_at(F.lit("2024/03/20 (Wed) 09:30")))
    return V.table(spark, d, "events").select(F.col("event_id").alias("id"), w.alias("w")).select("id", F.col("w.start").cast("string").alias("start"), F.col("w.end").cast("string").alias("end_"))


@both("window_boost", """WITH s AS (SELECT user_id AS qid, event_id AS id, CAST(ts AS DATE) AS at_, value AS s FROM events WHERE event_type = 'click'), b AS (SELECT qid, id, CASE WHEN at_ BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' THEN s * 2 ELSE s END AS s FROM s) SELECT qid, id, round(s, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS rank FROM b""")
def window_boost(spark, d):
    e = V.table(spark, d, "events").where("event_type = 'click'").select(F.col("user_id").alias("qid"), F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("value").alias("score"))
    e = e.withColumn("window", SE.window_of(F.lit("what did I click last week?"), F.lit("2024-01-17 10:00:00").cast("timestamp")))
    return SE.window_boost(e).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@both("second_hop", None)
def second_hop(spark, d):
    claims = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    hits = R.search_lexical(V.corpus(spark, d), V.asked(spark, d), "bm25", 3, digits=6)
    return SE.second_hop(hits, claims, _asked(spark, d)).select("qid", "id", "rank")


@both("proposals_mined", None)
def proposals_mined(spark, d):
    from ..operators.sets import fence
    from ..sources.jsonl import proposals

    c = V.table(spark, d, "conversations").select(F.col("conv_id").alias("day"), F.coalesce("text", F.lit("")).alias("text"))
    wall = fence(V.table(spark, d, "benchmark").select("text"), V.table(spark, d, "benchmark").select("text"))
    return proposals(c, wall).select("day", "id", "verdict")


@both("protocol_units", None)
def protocol_units(spark, d):
    from ..sources.jsonl import keep_units

    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("record"), F.lit("book").alias("source"), F.col("text").alias("context"))
    return keep_units(docs).select("record", "n", "status", "kind", F.md5(F.col("claim").cast("binary")).alias("claim"))


@both("session_days", "SELECT conv_id AS conv, count(*) AS turns, round(max(epoch_us(TIMESTAMP '2024-01-01' + to_days(CAST(turn AS INTEGER)))) / 86400000000.0, 6) AS last_day FROM conversations GROUP BY conv_id")
def session_days(spark, d):
    base = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    c = V.table(spark, d, "conversations").withColumn("at", base + F.expr("make_interval(0, 0, 0, cast(turn as int))"))
    days = clock.days_between(F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col("at"))
    return c.groupBy(F.col("conv_id").alias("conv")).agg(F.count(F.lit(1)).alias("turns"), F.round(F.max(days), 6).alias("last_day"))
