"""Rank fusion: ballots (qid, ballot, pos, key, score) to one order per query; voters, diversifiers, the panel."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import decay

def per_query():
    return W.partitionBy("qid")


def ballots(hits: DataFrame) -> DataFrame:
    """hits(qid, ballot, key, score) as ballots: pos from 0 by score descending, then key; the first of a repeated key stays."""
    once = hits.groupBy("qid", "ballot", "key").agg(F.max("score").alias("score"))
    order = W.partitionBy("qid", "ballot").orderBy(F.col("score").desc(), "key")
    return once.withColumn("pos", F.row_number().over(order) - 1)


def first_seen(b: DataFrame) -> DataFrame:
    """(qid, key, seen): the place of a key in the ballots one after another, the universal tie-break."""
    return b.groupBy("qid", "key").agg(F.min(F.struct("ballot", "pos")).alias("seen"))


def minmax(b: DataFrame) -> DataFrame:
    """Scores of each ballot to 0..1; 1 where they are all equal; those that are not finite go."""
    w = W.partitionBy("qid", "ballot")
    fine = b.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf")))
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return fine.withColumn("score", F.when(hi - lo == 0, 1.0).otherwise((F.col("score") - lo) / (hi - lo)))


def _summed(b: DataFrame, value: Column) -> DataFrame:
    """Keys with a value in some ballot; null adds nothing. A key is first seen in the whole ballots, places without a value included."""
    return b.groupBy("qid", "key").agg(F.sum(value).alias("vote"), F.min(F.struct("ballot", "pos")).alias("seen")).where("vote is not null")


def borda(b: DataFrame, k: int = 64) -> DataFrame:
    """The first k of each ballot vote; ties as first seen in the whole ballots."""
    return _summed(b, F.when(F.col("pos") < k, (F.lit(k) - F.col("pos")).cast("double")))


def dowdall(b: DataFrame, k: int = 64) -> DataFrame:
    """The first k of each ballot vote; ties as first seen in the whole ballots."""
    return _summed(b, F.when(F.col("pos") < k, F.lit(1.0) / (F.col("pos") + 1)))


def rrf(b: DataFrame, k: int = 64, k0: float = 60.0) -> DataFrame:
    """No cut at k."""
    return _summed(b, F.lit(1.0) / (F.lit(k0) + F.col("pos") + 1))


def combsum(b: DataFrame, k: int = 64) -> DataFrame:
    return _summed(minmax(b), F.col("score"))


def combmnz(b: DataFrame, k: int = 64) -> DataFrame:
    """The sum of scores times the number of ballots that name the key, lowest places included."""
    own = minmax(b)
    return own.groupBy("qid", "key").agg((F.sum("score") * F.count(F.lit(1))).alias("vote"), F.min(F.struct("ballot", "pos")).alias("seen"))


def first(b: DataFrame, k: int | None) -> DataFrame:
    """The first k of each ballot; None: all of it."""
    return b if k is None else b.where(F.col("pos") < k)


def _rivals(b: DataFrame) -> DataFrame:
    """(qid, a, b, pa, pb): all pairs of two keys of a query and their places in its ballots one after another, the largest number where a ballot does not name a key.

    Pairs leave the join with all their places, so they are counted where they arise and none is shuffled.
    """
    missing = F.lit((1 << 63) - 1)
    names = b.groupBy("qid").agg(F.array_sort(F.collect_set("ballot")).alias("of"))
    once = b.groupBy("qid", "key", "ballot").agg(F.min("pos").cast("long").alias("pos"))
    placed = once.groupBy("qid", "key").agg(F.map_from_entries(F.collect_list(F.struct("ballot", "pos"))).alias("at")).join(names, "qid")
    placed = placed.select("qid", "key", F.transform("of", lambda x: F.coalesce(F.try_element_at("at", x), missing)).alias("p"))
    own = placed.select("qid", F.col("key").alias("a"), F.col("p").alias("pa"))
    return own.join(placed.select("qid", F.col("key").alias("b"), F.col("p").alias("pb")), "qid").where("a <> b")


def preferences(b: DataFrame, k: int | None = 64) -> DataFrame:
    """(qid, a, b, d): ballots whose first k (None: all) put a above b, or name a and not b."""
    above = F.aggregate(F.zip_with("pa", "pb", lambda x, y: (x < y).cast("long")), F.lit(0).cast("long"), lambda n, x: n + x)
    return _rivals(first(b, k)).select("qid", "a", "b", above.alias("d")).where("d > 0")


def copeland(b: DataFrame, k: int | None = 64) -> DataFrame:
    """Rivals beaten less rivals lost to. Candidates are the first k of each ballot, with None all; each meets each of its query."""
    top = first(b, k)
    lead = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.when(x < y, 1).when(x > y, -1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    votes = _rivals(top).groupBy("qid", F.col("a").alias("key")).agg(F.sum(F.signum(lead)).alias("vote"))
    return first_seen(top).join(votes, ["qid", "key"], "left").select("qid", "key", F.coalesce("vote", F.lit(0.0)).alias("vote"), "seen")


# -- sequential voters, one query at a time ----------------------------------------------------------------------------------
def _matrix(ballots_: list[list[str]]):
    """Keys as first seen, and the matrix of how many ballots put one above the other, or name it alone."""
    import numpy as np

    keys = list(dict.fromkeys(x for b in ballots_ for x in b))
    index = {x: i for i, x in enumerate(keys)}
    d = np.zeros((len(keys), len(keys)), np.int32)
    for b in ballots_:
        place = np.full(len(keys), len(b))
        place[[index[x] for x in reversed(b)]] = range(len(b) - 1, -1, -1)  # of a repeated key the first place
        d += place[:, None] < place[None, :]
    return keys, d


def _counts(ballots_: list[list[str]]) -> tuple[list[str], list[list[int]]]:
    keys, d = _matrix(ballots_)
    return keys, d.tolist()


def schulze_order(ballots_: list[list[str]]) -> list[str]:
    """By the number of rivals beaten over widest paths; ties as first seen.

    A path of a strength is a path over links of that strength or more, so each strength takes one closure over rows of bits,
    and the wider of two paths is the one found at more strengths.
    """
    import numpy as np

    keys, d = _matrix(ballots_)
    d = np.where(d > d.T, d, 0)
    found = np.zeros(d.shape, np.int32)
    for strength in np.unique(d[d > 0]).tolist():
        reach = np.packbits(d >= strength, axis=1)
        for m in range(len(keys)):
            via = (reach[:, m >> 3] >> (7 - (m & 7)) & 1).astype(bool)
            reach[via] |= reach[m]
        found += np.unpackbits(reach, axis=1, count=len(keys))
    wins = (found > found.T).sum(axis=1).tolist()
    return [keys[i] for i in sorted(range(len(keys)), key=lambda i: (-wins[i], i))]


def tideman_order(ballots_: list[list[str]]) -> list[str]:
    """Victories by margin, then votes, then first seen, locked where they close no circle; the earliest unbeaten key comes first."""
    keys, d = _counts(ballots_)
    n = len(keys)
    wins = sorted((-(d[i][j] - d[j][i]), -d[i][j], i, j) for i in range(n) for j in range(n) if d[i][j] > d[j][i])
    over: list[set[int]] = [set() for _ in range(n)]

    def reaches(a: int, b: int) -> bool:
        todo, seen = [a], {a}
        while todo:
            x = todo.pop()
            if x == b:
                return True
            new = over[x] - seen
            seen |= new
            todo += new
        return False

    for _, _, i, j in wins:
        if not reaches(j, i):
            over[i].add(j)
    left, out = list(range(n)), []
    while left:
        x = next((i for i in left if not any(i in over[j] for j in left)), left[0])
        left.remove(x)
        out.append(keys[x])
    return out


def borda_order(ballots_: list[list[str]], k: int) -> list[str]:
    keys, _ = _counts(ballots_)
    vote = dict.fromkeys(keys, 0)
    for b in ballots_:
        for i, x in enumerate(b):
            vote[x] += k - i
    return sorted(keys, key=lambda x: -vote[x])


def kemeny_order(ballots_: list[list[str]], k: int = 64, most: int = 8) -> list[str]:
    """The order of least disagreement, the first of equals in order of first-seen permutations; above most keys Borda's."""
    from itertools import permutations

    keys, d = _counts(ballots_)
    if len(keys) > most:
        return borda_order(ballots_, k)
    best, least = list(range(len(keys))), None
    for order in permutations(range(len(keys))):
        cost = sum(d[order[j]][order[i]] for i in range(len(order)) for j in range(i + 1, len(order)))
        if least is None or cost < least:
            best, least = list(order), cost
    return [keys[i] for i in best]


def _sequential(order: Callable[[list[list[str]]], list[str]]) -> Callable[[DataFrame, int], DataFrame]:
    def run(b: DataFrame, k: int | None = 64) -> DataFrame:
        import pandas as pd

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            lists = [g.sort_values("pos")["key"].tolist() for _, g in pdf.groupby("ballot", sort=True)]
            got = order(lists)
            return pd.DataFrame({"qid": [pdf["qid"].iloc[0]] * len(got), "key": got, "vote": [float(len(got) - i) for i in range(len(got))], "at": range(len(got))})

        kinds = {f.name: f.dataType.simpleString() for f in b.schema.fields}
        top = first(b, k).select("qid", "ballot", "pos", "key")
        got = top.groupBy("qid").applyInPandas(one, f"qid {kinds['qid']}, key {kinds['key']}, vote double, at int")
        return got.select("qid", "key", "vote", F.struct(F.lit(0).alias("ballot"), F.col("at").alias("pos")).alias("seen"))

    return run


VOTERS: dict[str, Callable[..., DataFrame]] = {
    "borda": borda, "rrf": rrf, "dowdall": dowdall, "combsum": combsum, "combmnz": combmnz, "copeland": copeland,
    "kemeny": _sequential(kemeny_order), "schulze": _sequential(schulze_order), "tideman": _sequential(tideman_order),
}


def fuse(b: DataFrame, voter: str = "combmnz", k: int | None = 64, digits: int = 9) -> DataFrame:
    """(qid, key, vote, place, weight): place from 0 by vote descending, ties as first seen; weight is n - place. k None: whole ballots, of voters that compare pairs."""
    if voter not in VOTERS:
        raise ValueError(f"unknown fuse: {voter}")
    votes = VOTERS[voter](b, k)
    order = per_query().orderBy(F.round("vote", digits).desc(), F.col("seen"))
    placed = votes.withColumn("place", F.row_number().over(order) - 1)
    return placed.withColumn("weight", (F.count(F.lit(1)).over(per_query()) - F.col("place")).cast("double")).select("qid", "key", "vote", "place", "weight")


def agreement(b: DataFrame) -> DataFrame:
    """(qid, key, ballots, of): ballots that name the key, of how many."""
    named = b.groupBy("qid", "key").agg(F.count_distinct("ballot").alias("ballots"))
    return named.join(b.groupBy("qid").agg(F.count_distinct("ballot").alias("of")), "qid")


# -- diversifiers -------------------------------------------------------------------------------------------------------------
def _alike(a: set, b: set) -> float:
    union = len(a | b)
    return len(a & b) / union if union else 0.0


def mmr_order(rel: list[float], words: list[set], lam: float = 0.7) -> list[int]:
    """Greedy: relevance (min-max) times lam less the likeness to what is chosen times 1 - lam."""
    if len(rel) < 2 or not 0 <= lam < 1:
        return list(range(len(rel)))
    lo, span = min(rel), max(max(rel) - min(rel), 1e-9)
    left, out, near = list(range(len(rel))), [], [0.0] * len(rel)
    while left:
        x = max(left, key=lambda i: (lam * (rel[i] - lo) / span - (1 - lam) * near[i], -left.index(i)))
        left.remove(x)
        out.append(x)
        for i in left:
            near[i] = max(near[i], _alike(words[i], words[x]))
    return out


def _determinant(m) -> float:
    """By elimination with row exchange; 0 as soon as no pivot of a column exceeds 1e-15."""
    import numpy as np

    m, value = np.array(m, float), 1.0
    for k in range(len(m)):
        top = k + int(np.abs(m[k:, k]).argmax())
        if abs(m[top, k]) <= 1e-15:
            return 0.0
        if top != k:
            m[[k, top]] = m[[top, k]]
            value = -value
        value *= m[k, k]
        m[k + 1 :, k:] -= np.outer(m[k + 1 :, k] / m[k, k], m[k, k:])
    return float(value)


def dpp_order(rel: list[float], words: list[set], k: int | None = None) -> list[int]:
    """Greedy MAP of a determinantal process with kernel rel_i rel_j likeness; what adds nothing follows in order. An item without words is like none, itself included."""
    import numpy as np

    n = len(rel)
    if n < 2:
        return list(range(min(k if k is not None else n, n)))
    kern = np.array([[rel[i] * rel[j] * (float(bool(words[i])) if i == j else _alike(words[i], words[j])) for j in range(n)] for i in range(n)])
    out: list[int] = []
    while len(out) < min(k if k is not None else n, n):
        best, value = None, 0.0
        for i in range(n):
            if i not in out:
                own = [*out, i]
                det = _determinant(kern[np.ix_(own, own)])
                if best is None or det > value:
                    best, value = i, det
        out.append(best)
    return out


def diversify(hits: DataFrame, how: str = "mmr", lam: float = 0.7, text: str = "text") -> DataFrame:
    """hits(qid, key, weight, place, text) with at: the place after diversifying. Groups are one query's fused hits."""
    import pandas as pd

    if how == "none":
        return hits.withColumn("at", F.col("place"))
    if how not in ("mmr", "dpp"):
        raise ValueError(f"unknown diversify: {how}")
    from ..functions.text import raw_tokens

    rows = hits.withColumn("words", raw_tokens(F.coalesce(F.col(text), F.lit(""))))
    kinds = {f.name: f.dataType.simpleString() for f in hits.schema.fields}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        rel, words = pdf["weight"].tolist(), [set(w) for w in pdf["words"]]
        order = mmr_order(rel, words, lam) if how == "mmr" else dpp_order(rel, words)
        at = [0] * len(order)
        for i, x in enumerate(order):
            at[x] = i
        return pd.DataFrame({"qid": pdf["qid"].tolist(), "key": pdf["key"].tolist(), "at": at})

    order = rows.select("qid", "key", "weight", "place", "words").groupBy("qid").applyInPandas(one, f"qid {kinds['qid']}, key {kinds['key']}, at int")
    return hits.join(order, ["qid", "key"])


# -- the panel ----------------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Panel:
    """Names of a fuse, a diversifier and a decay; unknown names fail."""

    fuse: str = "combmnz"
    diversify: str = "mmr"
    decay: str = "fsrs"

    def __post_init__(self):
        for value, known, what in ((self.fuse, VOTERS, "fuse"), (self.diversify, ("mmr", "dpp", "none"), "diversify"), (self.decay, ("off", "on", "fsrs"), "decay")):
            if value not in known:
                raise ValueError(f"unknown {what}: {value}")

    @classmethod
    def named(cls, text: str) -> Panel:
        """Of fuse,diversify,decay; parts left out take the default."""
        parts = [p.strip().lower() for p in text.split(",")] if text.strip() else []
        return cls(*[p or d for p, d in zip([*parts, "", "", ""][:3], (cls.fuse, cls.diversify, cls.decay), strict=True)])

    @classmethod
    def from_env(cls, env: dict[str, str]) -> Panel:
        return cls(env.get("ATOMWEAVE_FUSE", cls.fuse), env.get("ATOMWEAVE_DIVERSIFY", cls.diversify), env.get("ATOMWEAVE_DECAY", cls.decay))


def merge(b: DataFrame, rows: DataFrame, panel: Panel = Panel(), rank: str = "fused", limit: int = 16, k: int = 64) -> DataFrame:
    """Ballots to answers: fuse, decay, order again, diversify, annotate, limit.

    rows: (key, text, field, age_days, stability). (qid, key, score, rank, ballots, of); score is the weight.
    """
    if rank not in ("fused", "relevance"):
        raise ValueError(f"unknown rank: {rank}")
    own = fuse(b, panel.fuse, k).join(rows, "key")
    if rank == "fused" and panel.decay != "off":
        own = own.withColumn("weight", F.col("weight") * decay.weight(panel.decay, F.col("field"), F.col("age_days"), F.col("stability")))
        own = own.withColumn("place", F.row_number().over(per_query().orderBy(F.round("weight", 9).desc(), "place")) - 1)
    own = diversify(own.select("qid", "key", "weight", "place", "text"), panel.diversify)
    own = own.where(F.col("at") < limit).join(agreement(b), ["qid", "key"])
    return own.select("qid", "key", F.col("weight").alias("score"), (F.col("at") + 1).alias("rank"), "ballots", "of")


def rerank(hits: DataFrame, scorer: Callable[[Column, Column], Column], query: str = "query", text: str = "text", head: int = 20) -> DataFrame:
    """Reorders the first head hits of each query by scorer(query, text), a Column or pandas UDF; the tail keeps its order. A single hit is settled."""
    n = F.count(F.lit(1)).over(per_query())
    top = (F.col("rank") <= head) & (n > 1)
    own = hits.withColumn("rerank_score", F.when(top, scorer(F.col(query), F.col(text))))
    order = per_query().orderBy(F.col("rerank_score").isNull(), F.col("rerank_score").desc(), "rank")
    return own.withColumn("rank", F.row_number().over(order))


def mark_dense(fused: DataFrame, dense: DataFrame) -> DataFrame:
    """fused with dense_rank and cosine (4 decimals) of dense(qid, key, rank, cosine), null where it has none."""
    d = dense.select("qid", "key", F.col("rank").alias("dense_rank"), F.round("cosine", 4).alias("cosine"))
    return fused.join(d, ["qid", "key"], "left")


# -- juries -------------------------------------------------------------------------------------------------------------------
def jury(votes: DataFrame, k: int) -> DataFrame:
    """votes(case, accept) to (case, yes, seen, carried): at least k of those seen say yes."""
    g = votes.groupBy("case").agg(F.count_if("accept").alias("yes"), F.count("accept").alias("seen"))
    return g.withColumn("carried", F.col("yes") >= k)


def majority_sign(yes: Column, no: Column) -> Column:
    return F.signum((yes - no).cast("double")).cast("int")


def two_thirds(no: Column) -> Column:
    """The least yes with yes - 2 no above 0."""
    return no * 2 + 1


def positively_responsive(rule: Callable[[int, int], int], most: int) -> bool:
    """Whether a rule of (yes, no) never falls with a further yes, and breaks every tie upwards with it."""
    return all(rule(y + 1, n) >= rule(y, n) and (rule(y, n) != 0 or rule(y + 1, n) > 0) for y in range(most) for n in range(most))
