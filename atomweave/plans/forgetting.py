"""The longitudinal corpus for the decay slot: does a claim that was recalled on its clock outrank later paraphrases?

Every topic has one claim written early and recalled whenever it falls due, and three written late and never reviewed; all
share the topic's words. At the end each topic is asked, and the place of the recalled claim is measured for each ordering.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock, decay
from ..functions import text as T
from ..operators import fusion as FU
from ..operators import recall as RC
from ..operators import retrieval as R
from ..operators.review import DAY

#: Fixed values of the corpus: topics, paraphrases, length in days, first day, generator seed and shifts.
TOPICS, PARAPHRASES, DAYS, BASE = 300, 3, 180, dt.datetime(2026, 1, 1)
SEED, SHIFTS = 0x9E3779B97F4A7C15, (13, 7, 17)


def numbers(seed: int = SEED):
    """The xorshift sequence."""
    x, mask = seed, (1 << 64) - 1
    a, b, c = SHIFTS
    while True:
        x ^= (x << a) & mask
        x ^= x >> b
        x ^= (x << c) & mask
        yield x


def recalled(written: float, until: int) -> tuple[float, float, float]:
    """(last review, stability, due) in days of a claim that is recalled at every due time whose day is not past until."""
    last, s, d, due = written, 1.0, 5.0, written + 1.0
    for _ in range(64):
        if math.floor(due) > until:
            break
        r = min(max(0.9 ** ((due - last) / s), 0.01), 0.99)
        d = min(max(d - 0.15, 1.0), 10.0)
        s *= 1 + math.exp(1 - d / 10) * (1 - r)
        last, due = due, due + int(max(s, 1.0) * DAY) / DAY
    return last, s, due


def corpus(spark: SparkSession) -> DataFrame:
    """(id, topic, variant, text, ts, last, stability, due_at): id is the place in store order."""
    rng, rows = numbers(), []
    stamp = lambda day: BASE + dt.timedelta(seconds=round(day * DAY))
    for topic in range(TOPICS):
        early = next(rng) % 30
        own = [(0, early, *recalled(early, DAYS))]
        for v in range(1, PARAPHRASES + 1):
            late = 150 + next(rng) % 30
            own.append((v, late, late, 1.0, late + 1.0))
        for i in range(len(own) - 1, 0, -1):
            j = next(rng) % (i + 1)
            own[i], own[j] = own[j], own[i]
        for v, ts, last, s, due in own:
            text = f"On topic{topic} the settled answer is variant{v}. It was checked against detail{v}."
            rows.append((f"{len(rows):06}", topic, v, text, stamp(ts), stamp(last), s, stamp(due)))
    return spark.createDataFrame(rows, "id string, topic int, variant int, text string, ts timestamp_ntz, last timestamp_ntz, stability double, due_at timestamp_ntz")


def forgetting_table(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    """(ordering, kept_first, mean_rank): the share of topics whose recalled claim comes first, and its mean place, 10 where it is not among ten."""
    claims = corpus(spark).persist()
    now = F.lit(BASE + dt.timedelta(days=DAYS)).cast("timestamp_ntz")
    words = claims.select("id", T.tokens(F.col("text")).alias("tokens"))
    asked = claims.select(F.col("topic").alias("qid")).distinct().select("qid", T.tokens(F.concat(F.lit("topic"), F.col("qid").cast("string"), F.lit(" settled answer"))).alias("tokens"))
    hits = R.search_lexical(words, asked, "bm25", 20, digits=9).persist()
    b = hits.select("qid", F.lit(0).alias("ballot"), (F.col("rank") - 1).alias("pos"), F.col("id").alias("key"), "score")
    rows = claims.select(F.col("id").alias("key"), "text", F.lit("atom").alias("field"), clock.days_between(F.col("last"), now).alias("age_days"), "stability")
    facts = claims.select(F.col("id").alias("key"), "topic", "variant", "ts", "due_at")
    tables = []

    def add(name: str, ranked: DataFrame) -> None:
        place = ranked.select("qid", "key", "rank").join(facts.where("variant = 0").select("key", "topic"), "key").where((F.col("qid") == F.col("topic")) & (F.col("rank") <= 10)).select("qid", "rank")
        own = asked.select("qid").join(place, "qid", "left").withColumn("rank", F.coalesce("rank", F.lit(10)))
        tables.append(own.agg(F.lit(name).alias("ordering"), F.round(F.avg((F.col("rank") == 1).cast("double")), 3).alias("kept_first"), F.round(F.avg("rank"), 2).alias("mean_rank")))

    for name in ("off", "on", "fsrs"):
        add(name, FU.merge(b, rows, FU.Panel("combmnz", "none", name), limit=10))
    top = FU.merge(b, rows, FU.Panel("combmnz", "none", "off"), limit=10).withColumnRenamed("rank", "was").join(facts, "key")
    add("lru", top.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.col("ts").desc(), "was"))))

    # The recall path: a quarter of ten places for due claims, then the ten best hits as seeds, each in recall's order.
    stand = claims.select(F.col("id"), "ts", F.lit(None).cast("double").alias("trust"), (F.col("due_at") <= now).alias("due"), decay.retrievability(clock.days_between(F.col("last"), now), F.col("stability")).alias("retrievability"))
    due = stand.where("due").withColumn("n", F.row_number().over(W.orderBy(*RC.order()))).where(F.col("n") <= 10 // 4).withColumn("part", F.lit(1))  # one fixture, one order
    seeds = hits.where("rank <= 10").select("qid", "id").join(stand, "id").withColumn("part", F.lit(3))
    both = asked.select("qid").crossJoin(F.broadcast(due.drop("n"))).unionByName(seeds)
    both = both.withColumn("n", F.row_number().over(W.partitionBy("qid", "id").orderBy("part"))).where("n = 1")
    add("due first", both.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("part", *RC.order()))).withColumnRenamed("id", "key"))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


QUERIES: dict = {"forgetting_table": forgetting_table}
ORACLES: dict = {}
