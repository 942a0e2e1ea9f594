"""Ranked search as one plan for many queries: ballots, panel, rerank, marks; and what builds on it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock, decay
from ..functions import text as T
from . import fusion as FU
from . import graph as G
from . import retrieval as R

#: What trust and a due date add to a score, hits a ballot holds, hits a reranker sees.
TRUST, DUE, BALLOT, HEAD = 0.1, 2.0, 64, 20


def bonus(rank: str, trust: Column, age_days: Column, due: Column | None = None) -> Column:
    """0.1 trust, recency unless rank is relevance, 2 for a due claim (the scan alone adds it)."""
    own = F.lit(TRUST) * F.coalesce(trust, F.lit(1.0))
    if rank == "fused":
        own = own + decay.recency(age_days)
    return own if due is None else own + F.when(due, DUE).otherwise(0.0)


def search(
    claims: DataFrame, queries: DataFrame, panel: FU.Panel = FU.Panel(), rank: str = "fused", limit: int = 16, scorer: str = "bm25+", reranker: Callable[[Column, Column], Column] | None = None, stem: bool = False
) -> DataFrame:
    """(qid, key, score, rank, ballots, of, dense_rank, cosine[, rerank_score]).

    claims: (id, text, entities, trust, age_days, stability, due, field[, vector]); queries: (qid, text[, vector]). Ballots are the
    scan, BM25+ and, where both sides have vectors, cosine. Queries without words get no answer.
    """
    words = claims.withColumn("tokens", T.atom_tokens(F.col("text"), F.col("entities"), stem))
    asked = queries.withColumn("tokens", T.tokens(F.col("text"), stem)).where(F.size("tokens") > 0)
    scan = R.search_linear(words.select("id", "tokens", bonus(rank, F.col("trust"), F.col("age_days"), F.col("due")).alias("bonus")), asked.select("qid", "tokens"), BALLOT)
    lexical = R.search_weighed(words.select("id", "tokens", bonus(rank, F.col("trust"), F.col("age_days")).alias("bonus")), asked.select("qid", "tokens"), scorer, BALLOT)
    parts = [scan, lexical]
    dense = None
    if "vector" in claims.columns and "vector" in queries.columns:
        dense = R.search_dense(claims.select("id", "vector", "trust"), asked.select("qid", "vector"), BALLOT, bonus=F.lit(TRUST) * F.coalesce("trust", F.lit(1.0)))
        parts.append(dense)
    ballots = None
    for n, p in enumerate(parts):
        own = p.select("qid", F.lit(n).alias("ballot"), (F.col("rank") - 1).alias("pos"), F.col("id").alias("key"), "score")
        ballots = own if ballots is None else ballots.unionByName(own)
    ballots = ballots.persist()  # BALLOT rows a query and ballot, read by each voter; of the claims, only those they name are read on
    rows = claims.select(F.col("id").alias("key"), "text", "field", "age_days", "stability")
    rows = rows.join(R.hinted(ballots.select("key").distinct()), "key", "left_semi")
    hits = FU.merge(ballots, rows, panel, rank, max(limit, HEAD) if reranker else limit)
    if reranker:
        hits = hits.join(rows.select("key", "text"), "key").join(queries.select("qid", F.col("text").alias("query")), "qid")
        hits = FU.rerank(hits, reranker, head=HEAD).where(F.col("rank") <= limit).drop("text", "query")
    if dense is None:
        return hits.withColumns({"dense_rank": F.lit(None).cast("int"), "cosine": F.lit(None).cast("double")})
    return FU.mark_dense(hits, dense.select("qid", F.col("id").alias("key"), "rank", "cosine"))


def fused_scored(a: DataFrame, b: DataFrame, limit: int = 50) -> DataFrame:
    """Two ballots (qid, id, score, rank) through CombMNZ alone: (qid, id, vote, rank)."""
    both = None
    for n, p in enumerate((a, b)):
        own = p.where(F.col("rank") <= limit).select("qid", F.lit(n).alias("ballot"), (F.col("rank") - 1).alias("pos"), F.col("id").alias("key"), "score")
        both = own if both is None else both.unionByName(own)
    return FU.fuse(both, "combmnz").select("qid", F.col("key").alias("id"), "vote", (F.col("place") + 1).alias("rank"))


def recency_arm(hits: DataFrame, half: float = 14.0) -> DataFrame:
    """hits(qid, id, score, age_days) ordered again by score times a half-life of its age."""
    own = hits.withColumn("score", F.col("score") * decay.temporal(F.lit("atom"), F.col("age_days"), half))
    return R.ranked(own.drop("rank"), digits=9)


#: The months by name.
MONTHS = "january february march april may june july august september october november december".split()


def asked_at(stamp: Column) -> Column:
    """The instant of 'YYYY/MM/DD (Dow) HH:MM'."""
    return F.try_to_timestamp(F.regexp_replace(stamp, "^(\\d{4})/(\\d{2})/(\\d{2}) \\([A-Za-z]+\\) (\\d{2}:\\d{2})$", "$1-$2-$3 $4"), F.lit("yyyy-MM-dd HH:mm"))


def window_of(question: Column, asked: Column) -> Column:
    """struct(start, end) of dates that a question names: a date, some days, weeks, months or years ago (with as much slack as one unit), last or this week or month, a month by name; else null."""
    q, day = F.lower(question), F.to_date(asked)
    date = F.regexp_extract(q, "(\\d{4})[/-](\\d{1,2})[/-](\\d{1,2})", 0)
    own = F.to_date(F.try_to_timestamp(F.regexp_replace(date, "/", "-"), F.lit("yyyy-M-d")))
    word = F.regexp_extract(q, "\\b(a|an|one|two|three|four|five|six|seven|eight|nine|ten|\\d{1,3}) (day|week|month|year)s? ago", 1)
    unit = F.regexp_extract(q, "\\b(?:a|an|one|two|three|four|five|six|seven|eight|nine|ten|\\d{1,3}) (day|week|month|year)s? ago", 1)
    n = F.try_to_number(word, F.lit("999")).cast("int")
    for i, w in enumerate("one two three four five six seven eight nine ten".split(), 1):
        n = F.when(word == w, i).otherwise(n)
    n = F.when(word.isin("a", "an"), 1).otherwise(n)
    size = F.when(unit == "day", 1).when(unit == "week", 7).when(unit == "month", 30).when(unit == "year", 365)
    ago = F.date_sub(day, n * size)
    slack = F.when(unit == "day", 1).otherwise(size)
    month = F.lit(None).cast("int")
    for i, m in enumerate(MONTHS, 1):
        month = F.when(q.rlike(f"\\bin {m}\\b"), i).otherwise(month)
    first = F.make_date(F.year(day) - F.when(month > F.month(day), 1).otherwise(0), month, F.lit(1))
    start = lambda u: F.to_date(F.date_trunc(u, F.to_timestamp(day)))
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    return (
        F.when(own.isNotNull(), pair(own, own)).when(size.isNotNull() & n.isNotNull(), pair(F.date_sub(ago, slack), F.date_add(ago, slack)))
        .when(q.contains("last week"), pair(F.date_sub(start("week"), 7), F.date_sub(start("week"), 1))).when(q.contains("this week"), pair(start("week"), day))
        .when(q.contains("last month"), pair(F.add_months(start("month"), -1), F.date_sub(start("month"), 1))).when(q.contains("this month"), pair(start("month"), day))
        .when(month.isNotNull(), pair(first, F.last_day(first)))
    )


def window_boost(hits: DataFrame, at: str = "at", window: str = "window", times: float = 2.0) -> DataFrame:
    """hits(qid, id, score, at, window) ordered again with the scores of documents inside the question's window doubled."""
    inside = F.col(window).isNotNull() & F.to_date(at).between(F.col(f"{window}.start"), F.col(f"{window}.end"))
    own = hits.withColumn("score", F.when(inside, F.col("score") * times).otherwise(F.col("score")))
    return R.ranked(own.drop("rank"), digits=9)


def activate(hits: DataFrame, edges: DataFrame, seeds: int = 5, hops: int = 2) -> DataFrame:
    """(qid, id, energy, weak) spread from the best hits of each query (qid, key, score, rank, ballots, of), the strongest at 1.

    An island is weak where fewer than two seeds are named by more than one ballot. edges: (src, dst, w) of the memory-only graph.
    """
    top = hits.where(F.col("rank") <= seeds)
    firm = top.groupBy("qid").agg((F.count_if((F.col("ballots") > 1) | (F.col("of") == 1)) < 2).alias("weak"))
    front = total = top.select("qid", F.col("key").alias("id"), F.col("score").alias("energy"))
    share = edges.withColumn("p", F.col("w") / F.sum("w").over(W.partitionBy("src"))).select("src", "dst", "p")
    for _ in range(hops):
        front = share.join(front.withColumnRenamed("id", "src"), "src").groupBy("qid", F.col("dst").alias("id")).agg(F.sum(F.lit(G.HOP) * F.col("energy") * F.col("p")).alias("energy"))
        total = total.unionByName(front)
    total = total.groupBy("qid", "id").agg(F.sum("energy").alias("energy"))
    most = F.max("energy").over(W.partitionBy("qid"))
    return total.withColumn("energy", F.col("energy") / most).join(firm, "qid")


def firing(active: DataFrame, most: int = 8) -> DataFrame:
    """(qid, id) that go off together: the strongest of each island that is not weak."""
    w = W.partitionBy("qid").orderBy(F.round("energy", 9).desc(), "id")
    return active.where("not weak").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("qid", "id")


def due_hits(claims: DataFrame, now: Column) -> DataFrame:
    """(id, score) of due claims (id, due_at, trust, ts): 2 + 0.1 trust + recency."""
    own = claims.where(F.col("due_at") <= now)
    return own.select("id", (F.lit(DUE) + bonus("fused", F.col("trust"), clock.days_between(F.col("ts"), now))).alias("score"))


def second_hop(hits: DataFrame, claims: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """A second round of BM25 asked with the names in each query's best claim that the query does not hold: (qid, id, score, rank), the first round's hits left out."""
    best = hits.where("rank = 1").select("qid", F.col("id")).join(claims.select("id", "text"), "id").select("qid", F.col("text").alias("fact"))
    own = best.join(queries.select("qid", "text"), "qid")
    fresh = F.array_except(T.tokens(F.array_join(T.capitalized_runs(F.col("fact")), " ")), T.tokens(F.col("text")))
    asked = own.select("qid", fresh.alias("tokens")).where(F.size("tokens") > 0)
    again = R.search_lexical(claims.select("id", T.tokens(F.col("text")).alias("tokens")), asked, "bm25", k + 1)
    again = again.drop("rank").join(hits.select("qid", "id"), ["qid", "id"], "left_anti")
    return R.top_k(again, k)
