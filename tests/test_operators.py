"""Voters, diversifiers, review clock, links, graph, sets and store against row-wise versions and stated cases."""

import math
import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from atomweave.functions import decay
from atomweave.operators import evaluate as EV
from atomweave.operators import fusion as FU
from atomweave.operators import graph as G
from atomweave.operators import links as L
from atomweave.operators import recall as RC
from atomweave.operators import retrieval as R
from atomweave.operators import review as RV
from atomweave.operators import search as SE
from atomweave.operators import sets as ST
from atomweave.operators import store as S


def ballots(spark, lists):
    rows = [("q", b, p, k, float(s)) for b, own in enumerate(lists) for p, (k, s) in enumerate(own)]
    return spark.createDataFrame(rows, "qid string, ballot int, pos int, key string, score double")


TWO = [[("c", 1.0), ("d", 0.4), ("low", 0.0)], [("hi", 1.0), ("d", 0.25), ("lo", 0.0)]]


def order(df):
    return [r.key for r in df.orderBy("place").collect()]


def test_combmnz_fixture(spark):
    got = FU.fuse(ballots(spark, TWO), "combmnz")
    assert order(got)[:3] == ["d", "c", "hi"]
    assert abs(got.where("key = 'd'").first().vote - 1.3) < 1e-12
    assert got.where("key = 'd'").first().weight == 5.0


def test_sequential_voters_agree_with_brute_force():
    rng = random.Random(3)
    for _ in range(30):
        keys = [f"k{i}" for i in range(rng.randint(2, 6))]
        lists = [rng.sample(keys, rng.randint(1, len(keys))) for _ in range(rng.randint(1, 4))]
        names, d = FU._counts(lists)
        cost = lambda o: sum(d[names.index(o[j])][names.index(o[i])] for i in range(len(o)) for j in range(i + 1, len(o)))
        assert cost(FU.kemeny_order(lists)) == min(cost(o) for o in permutations(names))
        n = len(names)
        wins = [[d[i][j] if d[i][j] > d[j][i] else 0 for j in range(n)] for i in range(n)]
        best = lambda i, j: max((min(wins[a][b] for a, b in zip(p, p[1:])) for k in range(n) for mid in permutations([x for x in range(n) if x not in (i, j)], k) for p in [(i, *mid, j)]), default=0)  # noqa: E731,B905
        if n <= 5:
            beats = [sum(best(i, j) > best(j, i) for j in range(n) if j != i) for i in range(n)]
            assert FU.schulze_order(lists) == [names[i] for i in sorted(range(n), key=lambda i: (-beats[i], i))]
        ranked = FU.tideman_order(lists)
        assert sorted(ranked) == sorted(names)
        champion = [x for x in names if all(d[names.index(x)][names.index(y)] > d[names.index(y)][names.index(x)] for y in names if y != x)]
        if champion:
            assert ranked[0] == champion[0] == FU.schulze_order(lists)[0]


def test_kemeny_above_eight_is_borda():
    lists = [[f"k{i}" for i in range(10)], [f"k{i}" for i in range(9, -1, -1)]]
    assert FU.kemeny_order(lists, 64) == FU.borda_order(lists, 64)


def test_voters_run(spark):
    b = ballots(spark, TWO)
    for name in FU.VOTERS:
        assert FU.fuse(b, name).count() == 5
    with pytest.raises(ValueError):
        FU.fuse(b, "plurality")
    with pytest.raises(ValueError):
        FU.Panel("borda", "mmr", "never")
    assert FU.Panel.named("rrf,,off") == FU.Panel("rrf", "mmr", "off")


def test_mmr_and_dpp():
    words = [{"a", "b"}, {"a", "b"}, {"x", "y"}]
    assert FU.mmr_order([3.0, 2.9, 1.0], words, 0.3) == [0, 2, 1]
    assert FU.mmr_order([3.0], words[:1]) == [0] and FU.mmr_order([3.0, 2.0], words[:2], 1.0) == [0, 1]
    assert FU.dpp_order([3.0, 2.9, 1.0], words) == [0, 2, 1]
    assert FU.dpp_order([3.0, 2.0, 1.0], [set(), {"a"}, {"b"}]) == [1, 2, 0]  # without words an item adds nothing
    assert FU.dpp_order([3.0], [set()]) == [0] and FU.dpp_order([3.0, 2.0], [{"a"}, {"b"}], 0) == []


def test_juries():
    assert FU.positively_responsive(lambda y, n: (y > n) - (y < n), 5)
    assert not FU.positively_responsive(lambda y, n: 0, 5)


REVIEWS = [
    ("initial", {}, (1.0, 5.0, 0, 86400), "2026-01-02T00:00:00.000Z"),
    ("recalled", {}, (1.0167363850179754, 4.85, 1, 87846), "2026-01-02T00:24:06.000Z"),
    ("lapsed", {}, (0.5, 5.2, 0, 86400), "2026-01-02T00:00:00.000Z"),
    ("recalled", {"stability": 4.0, "difficulty": 6.0, "reps": 3, "last": "2025-12-20T00:00:00.000Z"}, (5.64157788291018, 5.85, 4, 487432), "2026-01-06T15:23:52.000Z"),
    ("lapsed", {"stability": 4.0, "difficulty": 6.0, "reps": 3, "last": "2025-12-20T00:00:00.000Z"}, (2.0, 6.2, 0, 172800), "2026-01-03T00:00:00.000Z"),
    ("recalled", {"stability": 0.2, "difficulty": 9.9, "reps": 1, "last": "2026-01-01T00:00:00.000Z"}, (0.20205063024104888, 9.75, 2, 86400), "2026-01-02T00:00:00.000Z"),
]


@pytest.mark.parametrize(("grade", "before", "want", "due"), REVIEWS)
def test_review(spark, grade, before, want, due):
    row = (before.get("stability"), before.get("difficulty"), before.get("reps"), None, None, None, before.get("last"), None, None)
    df = spark.createDataFrame([("a", row)], "id string, review struct<stability:double,difficulty:double,reps:int,recalls:int,interval_s:bigint,ease:double,last:string,neglected:int,used:int>")
    r = RV.graded(df, grade, F.lit("2026-01-01T00:00:00.000Z")).first()
    assert math.isclose(r.review.stability, want[0], rel_tol=1e-12) and math.isclose(r.review.difficulty, want[1], rel_tol=1e-12)
    assert (r.review.reps, r.review.interval_s) == want[2:] and r.due_at == due and r.review.ease == 2.5


def test_apply_links():
    live = [("one", {"Parser", "Header"}, []), ("two", {"Parser", "Header", "Record"}, []), ("three", {"Unrelated"}, ["subject"])]
    mine, changed = L.apply_links(("subject", {"Parser", "Header"}), live)
    assert mine == ["one", "two"] and changed == {"one": ["subject"], "two": ["subject"], "three": []}


def test_links_are_capped_at_both_ends():
    live = [(f"p{i:02}", {"A", "B", f"x{i}"}, []) for i in range(12)]
    mine, changed = L.apply_links(("s", {"A", "B"}), live)
    assert len(mine) == 8 and set(changed) == set(mine)


def test_fire(spark):
    rows = [("w", "a", ["b"], {"b": 0.5}), ("w", "b", ["a", "c"], {"a": 0.7, "c": 0.5}), ("w", "c", ["b"], {"b": 0.5}), ("w", "d", [], {})]
    atoms = spark.createDataFrame(rows, "workspace string, id string, links array<string>, link_weights map<string,double>")
    got = {r.id: r for r in G.fire(atoms, atoms.where("id in ('a', 'b', 'd')").select("workspace", "id")).collect()}
    assert math.isclose(got["a"].link_weights["b"], 0.73) and math.isclose(got["b"].link_weights["a"], 0.73)
    assert math.isclose(got["b"].link_weights["c"], 0.49) and math.isclose(got["c"].link_weights["b"], 0.49)
    assert got["d"].links == ["a", "b"] and math.isclose(got["d"].link_weights["a"], 0.55)


def graph(spark, pairs, n):
    nodes = spark.createDataFrame([("w", f"n{i}") for i in range(n)], "workspace string, id string")
    e = spark.createDataFrame([("w", f"n{a}", f"n{b}", w) for x, y, w in pairs for a, b in ((x, y), (y, x))], "workspace string, src string, dst string, w double")
    return nodes, e


TRIANGLES = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0), (2, 3, 0.1)]


def test_communities_and_modularity(spark):
    nodes, e = graph(spark, TRIANGLES, 7)
    rows = {r.id: r for r in G.communities(nodes, e).collect()}
    assert rows["n0"].label == rows["n2"].label != rows["n3"].label == rows["n5"].label and rows["n6"].label == "n6"
    assert rows["n0"].signature == rows["n4"].signature
    q = G.modularity(e, G.communities(nodes, e)).first().modularity
    assert 0.4 < q < 0.5


def test_pagerank_sums_to_one(spark):
    nodes, e = graph(spark, TRIANGLES, 7)
    r = {x.id: x.score for x in G.hubs(nodes, e, 12, 1e-9, every=6).collect()}
    assert abs(sum(r.values()) - 1) < 1e-9 and r["n6"] < min(v for k, v in r.items() if k != "n6")


def test_bm25_by_hand(spark):
    docs = {"a": "x x y", "b": "x z z z", "c": "w"}
    corpus = spark.createDataFrame([(k, v.split()) for k, v in docs.items()], "id string, tokens array<string>")
    q = spark.createDataFrame([("q", ["x", "z", "x"])], "qid string, tokens array<string>")
    got = {r.id: r.score for r in R.search_lexical(corpus, q, "bm25").collect()}
    avg = 8 / 3
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    s = lambda c, n, df: idf(df) * c * 2.2 / (c + 1.2 * (0.75 * n / avg + 0.25))
    assert math.isclose(got["a"], 2 * s(2, 3, 2)) and math.isclose(got["b"], 2 * s(1, 4, 2) + s(3, 4, 1)) and "c" not in got
    with pytest.raises(ValueError):
        R.scorer_named("tfidf")


def test_jaccard_pairs_exact(spark):
    rng = random.Random(5)
    sets = {i: sorted({f"w{rng.randint(0, 12)}" for _ in range(rng.randint(1, 9))}) for i in range(60)}
    df = spark.createDataFrame(list(sets.items()), "id long, items array<string>")
    got = {(r.a, r.b) for r in ST.jaccard_pairs(df, None, 0.6).collect()}
    j = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    assert got == {(a, b) for a in sets for b in sets if a < b and j(sets[a], sets[b]) >= 0.6 - 1e-12}


CLAIMS = [
    ("1", "lesson", "The evening ferry leaves at six", None), ("2", "lesson", "The evening ferry leaves at nine", None), ("3", "preference", "Never moor boats at night", None), ("4", "preference", "Never moor boats at a fishing pier", None),
    ("5", "correction", "Harbour opens late", ["Harbour"]), ("6", "correction", "All of it differs here", ["Harbour"]), ("7", "message", "The evening ferry leaves at six two", None), ("8", "lesson", "alpha beta gamma delta", ["X"]), ("9", "lesson", "alpha beta gamma delta epsilon", ["Y"]),
]


def test_replaces(spark):
    s = ST.shape(spark.createDataFrame(CLAIMS, "id string, kind string, text string, entities array<string>"))
    got = {(r.new_id, r.old_id) for r in ST.replaced(s, s).collect()}
    every = s.alias("n").crossJoin(s.alias("o")).where("n.id <> o.id").where(ST.replaces("n", "o", set())).select(F.col("n.id").alias("a"), F.col("o.id").alias("b"))
    assert got == {(r.a, r.b) for r in every.collect()}
    assert ("2", "1") in got and ("6", "5") in got and ("4", "3") not in got and ("9", "8") not in got and not any("7" in p for p in got)


def test_consolidate(spark):
    rows = [("w", i, k, t, e, f"2026-01-0{i}") for i, k, t, e in CLAIMS]
    df = spark.createDataFrame(rows, "workspace string, id string, kind string, text string, entities array<string>, ts string")
    assert {(r.new_id, r.old_id) for r in ST.consolidate(df).collect()} == {("2", "1"), ("6", "5")}


def test_upsert_and_stamps(spark):
    old = spark.createDataFrame([("w", "a", "t0", [1.0]), ("w", "b", "t0", [2.0])], "workspace string, id string, ts string, embedding array<float>")
    new = spark.createDataFrame([("w", "a", "t9", None, False, None), ("w", "b", "t9", [], True, None), ("w", "c", None, None, False, ["a"])], "workspace string, id string, ts string, embedding array<float>, has_embedding boolean, links array<string>")
    got = {r.id: r for r in S.stamped(new, old, F.lit("now")).collect()}
    assert got["a"].ts == "t0" and got["a"].embedding == [1.0] and got["b"].embedding is None and got["c"].ts == "now" and got["a"].links == []


def test_validate_kinds(spark):
    rows = [("trust", "a", "a", 0.5, None, None, "trust atom: from and to are the same agent"), ("trust", "a", "b", 0.0, None, None, "trust atom: weight must be a number in (0, 1]"), ("trust", "a", "b", 1.0, None, None, None),
            ("prediction", None, None, None, '{"x": 0.5}', "i", None), ("prediction", None, None, None, '{"x": -1}', "i", "prediction atom: expect is an option or an object of option to share"), ("prediction", None, None, None, "yes", None, "prediction atom needs issue"), ("note", None, None, None, None, None, "note atom needs issue, the ticket whose logbook it copies")]
    df = spark.createDataFrame([("w", "text here", *r) for r in rows], "workspace string, text string, kind string, `from` string, `to` string, weight double, expect string, issue string, want string").withColumn("agent", F.lit("x"))
    for r in S.validate(df).select("error", "want").collect():
        assert r.error == r.want


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "qid string, ballot int, pos int, key string, score double")
    for name in FU.VOTERS:
        assert FU.fuse(empty, name).count() == 0
    c = spark.createDataFrame([], "id string, tokens array<string>")
    q = spark.createDataFrame([("q", ["x"])], "qid string, tokens array<string>")
    assert R.search_lexical(c, q).count() == 0


def test_front_due(spark):
    due = spark.createDataFrame([("q", f"d{i}", i) for i in range(1, 6)], "qid string, key string, pos int")
    ranked = spark.createDataFrame([("q", "d1", 1), ("q", "r1", 2), ("q", "r2", 3)], "qid string, key string, pos int")
    assert [r.key for r in RC.front_due(due, ranked, 4).orderBy("pos").collect()] == ["d1", "d2", "r1", "r2"]
    assert RC.front_due(due, ranked.limit(0), 4).count() == 4


def test_windows(spark):
    t = spark.createDataFrame([(c, i, f"{c}{i}") for c, n in (("a", 8), ("b", 2)) for i in range(n)], "conv string, turn int, text string")
    got = {(r.conv, r.start): r.text.split("\n") for r in EV.windows(t).collect()}
    assert set(got) == {("a", 0), ("a", 3), ("b", 0)} and len(got[("a", 3)]) == 5 and len(got[("b", 0)]) == 2


def test_forgetting(spark):
    """A claim recalled on a schedule stays retrievable where its paraphrases fade: the ranking of the weights by panel."""
    rows = [("kept", 2.0, 200.0), ("p1", 170.0, 1.0), ("p2", 120.0, 1.0), ("p3", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id string, age double, s double")
    off, on, fsrs = (df.select("id", decay.weight(m, F.lit("atom"), F.col("age"), F.col("s")).alias("w")).orderBy(F.col("w").desc(), "id") for m in ("off", "on", "fsrs"))
    assert {r.w for r in off.collect()} == {1.0} and on.first().id == "p3" and fsrs.first().id == "kept" and min(r.w for r in fsrs.collect()) == 0.25


def test_forgetting_table(spark):
    """The published table of the longitudinal corpus."""
    from atomweave.plans.forgetting import forgetting_table

    got = {r.ordering: (r.kept_first, r.mean_rank) for r in forgetting_table(spark).collect()}
    assert got == {"off": (0.23, 2.49), "on": (0.27, 3.74), "fsrs": (0.947, 1.05), "lru": (0.0, 8.26), "due first": (0.0, 10.0)}


def test_dense_queries_in_blocks(spark):
    rng = random.Random(8)
    v = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(20_050)]
    few = spark.createDataFrame(v[:3], "id long, vector array<float>")
    many = spark.createDataFrame(v, "qid long, vector array<float>")
    got = R.search_dense(few, many, 3)
    unit = lambda x: [a / math.sqrt(sum(b * b for b in x)) for a in x]
    want = {(q, i) for q, x in v for i, y in v[:3] if sum(a * b for a, b in zip(unit(x), unit(y))) > 0}
    assert {(r.qid, r.id) for r in got.collect()} == want


def test_knn_over_several_blocks(spark, monkeypatch):
    rng = random.Random(9)
    e = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(90)], "id long, vector array<float>")
    rows = lambda: sorted((r.src, r.dst, round(r.w, 9)) for r in G.knn(e, 5).collect())
    one = rows()
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    assert rows() == one and len(one) >= 450
    assert R.search_dense(e, e.where("id < 0").withColumnRenamed("id", "qid"), 3).count() == 0
    near = spark.createDataFrame([(0, [1.0, 2e-4]), (1, [1.0, 0.0])], "id long, vector array<double>")
    assert R.search_dense(near, near.where("id = 1").withColumnRenamed("id", "qid"), 1, digits=6).first().id == 0


def test_window_boost_keeps_every_row(spark):
    hits = spark.range(1_000_010).select(F.lit(1).alias("qid"), "id", F.lit(1.0).alias("score"), F.lit("2024-01-10").cast("date").alias("at"), F.lit(None).cast("struct<start:date,end:date>").alias("window"))
    got = SE.window_boost(hits).agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last")).first()
    assert (got.n, got.last) == (1_000_010, 1_000_010)
    aged = hits.select("qid", "id", "score", F.lit(3.0).alias("age_days"))
    assert SE.recency_arm(aged).count() == 1_000_010


def test_max_sim_ties_after_rounding_go_by_id(spark, monkeypatch):
    from atomweave.plans import retrieval as PR

    rows = [(i, [1.0 if j % 16 == 0 else (1e-5 if i and j % 16 == 1 and i < 500 else 0.0) for j in range(64)]) for i in range(1000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(PR.V, "table", lambda *_: table.where("vec_id <= 5 or vec_id >= 500"))
    got = PR.max_sim(spark, "").where("qid = 500").orderBy("rank").collect()
    assert [r.id for r in got] == [0, 1, 2, 3, 4]
