"""Retrieval metrics and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tally(hits: DataFrame, judged: DataFrame, ks: tuple[int, ...] = (1, 5, 10), by: list[str] = ()) -> DataFrame:
    """hit@k, recall@k and nDCG@5, averaged over the queries of judged(qid, key, ...by); hits: (qid, key, rank). Queries without hits count 0."""
    want = judged.groupBy("qid", *by).agg(F.count_distinct("key").alias("n"))
    got = hits.join(judged.select("qid", "key").distinct(), ["qid", "key"]).groupBy("qid").agg(
        *[F.count_if(F.col("rank") <= k).alias(f"at{k}") for k in ks], F.sum(F.when(F.col("rank") <= 5, F.lit(1.0) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg")
    )
    ideal = F.lit(0.0)
    for i in range(1, 6):
        ideal = ideal + F.when(F.col("n") >= i, F.lit(1.0) / F.log2(F.lit(float(i + 1)))).otherwise(0.0)
    own = want.join(got, "qid", "left").fillna(0)
    out = [F.count(F.lit(1)).alias("queries")]
    for k in ks:
        out += [F.avg((F.col(f"at{k}") > 0).cast("double")).alias(f"hit_{k}"), F.avg(F.col(f"at{k}") / F.col("n")).alias(f"recall_{k}")]
    return own.groupBy(*by).agg(*out, F.avg(F.col("dcg") / ideal).alias("ndcg_5"))


def protocol_table(rows: DataFrame, by: str = "competency") -> DataFrame:
    """Admitted, refused, asked, hit and rate of rows(by, admitted, refused, asked, hit); no rate where nothing was asked."""
    sums = rows.groupBy(by).agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("admitted", "refused", "asked", "hit")])
    return sums.withColumn("rate", F.try_divide("hit", "asked"))


def collapse(hits: DataFrame, unit: str = "session") -> DataFrame:
    """Each unit at the place of its best document: (qid, unit, rank)."""
    best = hits.groupBy("qid", unit).agg(F.min("rank").alias("best"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("best", unit))).drop("best")


def latest_first(hits: DataFrame, k: int = 10, position: str = "position") -> DataFrame:
    """The k best of each query, newest first."""
    top = hits.where(F.col("rank") <= k)
    return top.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.col(position).desc())))


def windows(turns: DataFrame, size: int = 6, stride: int = 3) -> DataFrame:
    """(conv, start, text): passages of size turns every stride, the last one partial; a short session is one."""
    own = turns.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    last = F.greatest(F.size("t") - size, F.lit(0))
    starts = F.sequence(F.lit(0), (F.ceil(last / stride) * stride).cast("int"), F.lit(stride))
    own = own.select("conv", "t", F.explode(starts).alias("start"))
    return own.select("conv", "start", F.array_join(F.transform(F.slice("t", F.col("start") + 1, F.lit(size)), lambda x: x["text"]), "\n").alias("text"))


def sessions(turns: DataFrame) -> DataFrame:
    """The turns of a session as one document."""
    own = turns.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return own.select("conv", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))


def bearing(claims: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """(qid, hit): whether the k best claims by plain BM25 hold a normalised answer; claims (id, text), questions (qid, text, answers)."""
    from ..functions import text as T
    from .retrieval import search_lexical

    corpus = claims.select("id", T.tokens(F.col("text")).alias("tokens"))
    asked = questions.select("qid", T.tokens(F.col("text")).alias("tokens"))
    top = search_lexical(corpus, asked, "bm25", k, digits=9).join(claims.select("id", F.concat(F.lit(" "), T.normal(F.col("text")), F.lit(" ")).alias("hay")), "id")
    hay = top.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "hay"))), lambda x: x["hay"]), "").alias("hay"))
    answers = F.filter(F.transform("answers", T.normal), lambda a: a != "")
    own = questions.join(hay, "qid", "left")
    return own.select("qid", F.coalesce(F.exists(answers, lambda a: F.contains(F.col("hay"), a)), F.lit(False)).alias("hit"))


def latencies(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.percentile(value, p / 100).alias(f"p{p}") for p in (50, 95, 99)])


def tree_outline(files: DataFrame) -> DataFrame:
    """(top, files): files of each top folder, those without one under '.'."""
    top = F.when(F.contains("path", F.lit("/")), F.split_part("path", F.lit("/"), F.lit(1))).otherwise(".")
    return files.groupBy(top.alias("top")).agg(F.count(F.lit(1)).alias("files"))
