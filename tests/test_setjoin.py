"""The similarity join of sets against brute force, with small blocks and cells, and what it shuffles."""

import random

import pytest

from atomweave.operators import setjoin as SJ
from atomweave.operators import sets as ST


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def mixed_sets(seed: int) -> dict[int, list[str]]:
    """Sets of 1 to 200 items in families that drift apart, with copies, empty sets and odd items."""
    rng, out = random.Random(seed), {}
    for family in range(12):
        own = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([1, 2, 3, 5, 8, 40, 200]))]
        for _ in range(12):
            own = [f"w{rng.randint(0, 400)}" if rng.random() < 0.08 else w for w in own]
            out[len(out)] = rng.sample(sorted(set(own)), len(set(own)))
        out[len(out)] = list(reversed(out[len(out) - 1]))
    return out | {900: [], 901: [], 902: ['a","b'], 903: ["a", "b"], 904: ['a","b'], 905: ["", "a", "b"]}


@pytest.mark.parametrize("threshold", [0.25, 0.6, 1.0])
def test_setjoin_exact(spark, monkeypatch, threshold):
    monkeypatch.setattr(SJ, "BLOCK_ROWS", 7)
    monkeypatch.setattr(SJ, "WORDS", 150)
    monkeypatch.setattr(SJ, "COPIES", 1)
    sets = mixed_sets(3)
    df = spark.createDataFrame(list(sets.items()), "id long, items array<string>")
    got = [(r.a, r.b, round(r.jaccard, 9)) for r in ST.jaccard_pairs(df, None, threshold).collect()]
    wanted = {(a, b, round(jaccard(sets[a], sets[b]), 9)) for a in sets for b in sets if a < b and sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= threshold - 1e-12}
    assert len(got) == len(set(got)) and set(got) == wanted and wanted
    right = {i + 5: s for i, s in mixed_sets(3).items() if i % 3}
    other = spark.createDataFrame(list(right.items()), "id long, items array<string>")
    got = [(r.a, r.b) for r in ST.jaccard_pairs(df, other, threshold).collect()]
    wanted = {(a, b) for a in sets for b in right if a != b and sets[a] and right[b] and jaccard(sets[a], right[b]) >= threshold - 1e-12}
    assert len(got) == len(set(got)) and set(got) == wanted


def test_setjoin_empty(spark):
    none = spark.createDataFrame([], "id long, items array<string>")
    assert ST.jaccard_pairs(none, None, 0.6).collect() == []
    one = spark.createDataFrame([(1, []), (2, None), (3, ["a"])], "id long, items array<string>")
    assert ST.jaccard_pairs(one, None, 0.6).collect() == []


def test_sets_do_not_travel_with_pairs(spark):
    """300 near copies of 400 items give 44,850 pairs: their sets do not go through the shuffle once a pair, where nothing is small enough to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rng = random.Random(9)
    base = [f"word{rng.randint(0, 10**9)}" for _ in range(400)]
    df = spark.createDataFrame([(i, base[:-1] + [f"own{i}"]) for i in range(300)], "id long, items array<string>")
    wrote = lambda: sum(x.totalShuffleWrite() for x in (lambda s: [s.apply(i) for i in range(s.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    before = wrote()
    try:
        assert ST.jaccard_pairs(df, None, 0.6).count() == 300 * 299 // 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert wrote() - before < 6_000_000
