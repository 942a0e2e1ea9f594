"""Recall without a ranked query: due claims, hints, neighbours, seeds, within a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import live_links, one_hop

#: Rows a recall gives at most, characters it gives at most.
CAP, BUDGET = 64, 32_000


def cap_limit(limit: Column | int | None) -> Column:
    """64 by default and at most, 0 at least."""
    own = limit if isinstance(limit, Column) else F.lit(limit).cast("int")
    return F.least(F.greatest(F.coalesce(own, F.lit(CAP)), F.lit(0)), F.lit(CAP))


def due_share(cap: Column | int) -> Column:
    """A quarter, 1 at least."""
    own = cap if isinstance(cap, Column) else F.lit(cap)
    return F.greatest(F.floor(own / 4).cast("int"), F.lit(1))


def order() -> list[Column]:
    """Due first, then trust, retrievability, newest, id."""
    return [F.col("due").desc(), F.coalesce("trust", F.lit(0.0)).desc(), F.round("retrievability", 9).desc(), F.col("ts").desc(), F.col("id")]


def budgeted(rows: DataFrame, by: list[Column], budget: int = BUDGET, key: str = "workspace") -> DataFrame:
    """Rows of each key in order until the characters pass the budget; the first always."""
    w = W.partitionBy(key).orderBy(*by)
    own = rows.withColumn("__sum", F.sum(F.char_length("text")).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(w))
    return own.where((F.col("__sum") <= budget) | (F.col("__n") == 1)).drop("__sum", "__n")


def front_due(due: DataFrame, ranked: DataFrame, limit: int) -> DataFrame:
    """(qid, key, tier, pos): due rows take half the places (rounded up) while there are ranked ones, and what these leave; each key once.

    Both inputs: (qid, key, pos) from 1.
    """
    half = -(-limit // 2)
    d = due.select("qid", "key", F.col("pos").alias("dpos"))
    r = ranked.select("qid", "key", F.col("pos").alias("rpos"))
    both = d.join(r, ["qid", "key"], "full")
    w = W.partitionBy("qid")
    only = both.withColumn("dn", F.when(F.col("dpos").isNotNull(), F.row_number().over(w.orderBy(F.col("dpos").asc_nulls_last(), "key"))))
    only = only.withColumn("early", F.coalesce(F.col("dn") <= half, F.lit(False)))
    rest = F.col("rpos").isNotNull() & ~F.col("early")
    tier = F.when(F.col("early"), 0).when(rest, 1).otherwise(2)
    only = only.withColumn("tier", tier).withColumn("pos", F.when(F.col("tier") == 1, F.col("rpos")).otherwise(F.col("dpos")))
    only = only.withColumn("n", F.row_number().over(w.orderBy("tier", "pos", "key"))).where(F.col("n") <= limit)
    return only.select("qid", "key", "tier", F.col("n").alias("pos"))


def matches_hints(hints: list[str], words: list[str]) -> Column:
    """Shares an entity with the hints, or holds at least half the cue's words in its text or entities."""
    names = F.array(*[F.lit(h) for h in hints]) if hints else F.array().cast("array<string>")
    hay = T.ascii_lower(F.concat_ws(" ", F.col("text"), F.array_join(F.coalesce("entities", F.array().cast("array<string>")), " ")))
    held = F.lit(0)
    for w in words:
        held = held + F.contains(hay, F.lit(w)).cast("int")
    half = (held * 2 >= len(words)) if words else F.lit(False)
    return F.coalesce(F.arrays_overlap("entities", names), F.lit(False)) | half


def resolve_seeds(live: DataFrame, ids: list[str], hints: list[str], words: list[str]) -> DataFrame:
    """The named claims that are live, else those that match the hints."""
    named = live.where(F.col("id").isin(ids)) if ids else live.limit(0)
    if ids and not named.isEmpty():
        return named
    return live.where(matches_hints(hints, words))


def recall(shown: DataFrame, ids: list[str] = (), hints: list[str] = (), words: list[str] = (), limit: int | None = None, budget: int = BUDGET) -> DataFrame:
    """Claims of each workspace, ordered and within cap and budget.

    shown: (workspace, id, text, entities, links, due, trust, retrievability, ts). A workspace that fits the cap comes whole.
    Else due claims (a quarter of the cap when a cue or ids are given), neighbours of the seeds, the seeds.
    """
    cap = CAP if limit is None else max(0, min(limit, CAP))
    asked = bool(ids or hints or words)
    shown = live_links(shown, shown)
    size = shown.groupBy("workspace").agg(F.count(F.lit(1)).alias("size"))
    small = F.broadcast(size)  # one row a workspace
    whole = shown.join(small, "workspace").where(F.col("size") <= cap).drop("size").withColumn("part", F.lit(0))
    big = shown.join(small, "workspace").where(F.col("size") > cap).drop("size")
    seeds = resolve_seeds(big, list(ids), list(hints), list(words)) if asked else big.limit(0)
    due = big.where("due")
    if hints or words:
        due = due.where(matches_hints(list(hints), list(words)))
    if asked:
        due = due.withColumn("n", F.row_number().over(W.partitionBy("workspace").orderBy(*order()))).where(F.col("n") <= max(1, cap // 4)).drop("n")
    parts = due.withColumn("part", F.lit(1)).unionByName(one_hop(big, seeds).withColumn("part", F.lit(2))).unionByName(seeds.withColumn("part", F.lit(3)))
    first = W.partitionBy("workspace", "id").orderBy("part")
    parts = parts.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    own = whole.unionByName(parts)
    place = W.partitionBy("workspace").orderBy("part", *order())
    own = own.withColumn("place", F.row_number().over(place)).where(F.col("place") <= cap)
    return budgeted(own, [F.col("place")], budget)
