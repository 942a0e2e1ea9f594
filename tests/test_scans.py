"""The scan, the fence and late interaction against row-wise versions, with very long words."""

import random

from pyspark.sql import functions as F

from atomweave.functions import text as T
from atomweave.functions.decay import max_sim
from atomweave.operators import retrieval as R
from atomweave.operators import sets as ST


def near(a, b):
    """Whether at most one edit parts a and b."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def word_score(q, h):
    if q == h:
        return 4.0
    if len(q) < 4:
        return 0.0
    return 3.0 if h.startswith(q) else 2.0 if q in h else 1.5 if near(q, h) else 0.0


def edited(r, w):
    i = r.randrange(len(w))
    return r.choice([w[:i] + w[i + 1 :], w[:i] + "b" + w[i + 1 :], w[:i] + "a" + w[i:]])


def test_scan_of_random_words(spark):
    r = random.Random(5)
    base = ["".join(r.choice("ab") for _ in range(n)) for n in (1, 2, 3, 4, 5, 7, 8, 9, 12, 62, 63, 64, 65, 66, 130, 300)]
    words = base + [edited(r, w) for w in base for _ in range(4)]
    words += [w[r.randrange(len(w)) :] for w in base] + ["x" + w + "y" for w in base]
    words = [w for w in words if w]
    docs = [(i, [w], 0.0) for i, w in enumerate(words)]
    asked = [(i, [w]) for i, w in enumerate(words)]
    c = spark.createDataFrame(docs, "id int, tokens array<string>, bonus double")
    q = spark.createDataFrame(asked, "qid int, tokens array<string>")
    got = {(x.qid, x.id): x.score for x in R.search_linear(c, q, len(docs)).collect()}
    assert got == {(i, j): s for i, a in enumerate(words) for j, b in enumerate(words) if (s := word_score(a, b))}


def test_scan_of_a_very_long_word(spark):
    r = random.Random(6)
    long = "".join(r.choice("abcdefghij") for _ in range(300_000))
    c = spark.createDataFrame([(1, [long], 0.0), (2, ["plain"], 0.0), (3, [], 0.0)], "id int, tokens array<string>, bonus double")
    q = spark.createDataFrame([(1, [long[200_000:200_012]]), (2, [long[:1000] + long[1001:]]), (3, ["plein", "plain"]), (4, [])], "qid int, tokens array<string>")
    got = [(x.qid, x.id, x.score) for x in R.search_linear(c, q, 5).orderBy("qid").collect()]
    assert got == [(1, 1, 2.0), (2, 1, 1.5), (3, 2, 5.5)]


def test_fence_of_random_lines(spark):
    r = random.Random(7)

    def line():
        return " ".join("".join(r.choice("ab") for _ in range(r.choice([1, 2, 3, 9, 12]))) for _ in range(r.choice([1, 1, 2, 2, 3, 4, 9])))

    claims = [(i, line()) for i in range(120)] + [(900, ""), (901, None), (902, "z" * 3000 + " q"), (903, "z" * 2999)]
    wall = sorted({line() for _ in range(25)} - {"a", "b"}) + ["z" * 2999 + " q x", ""]
    c = spark.createDataFrame(claims, "id int, text string")
    got = {x.id for x in ST.unfenced(c, spark.createDataFrame([(w,) for w in wall], "wall string")).collect()}
    assert got == {i for i, t in claims if t and not any(w and (w in t or t in w) for w in wall)}
    none = spark.createDataFrame([], "wall string")
    assert {x.id for x in ST.unfenced(c, none).collect()} == {i for i, t in claims if t}


def test_late_interaction(spark, monkeypatch):
    r = random.Random(8)

    def rows(n):
        vec = lambda: [r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(r.choice([2, 3]))]
        return [(i, [vec() for _ in range(r.randrange(4))]) for i in range(n)]

    d = spark.createDataFrame([*rows(40), (90, None)], "id int, vectors array<array<double>>")
    q = spark.createDataFrame(rows(9), "qid int, vectors array<array<double>>")
    monkeypatch.setattr(R, "LATE_BLOCK", 4)
    got = {(x.qid, x.id): round(x.score, 9) for x in R.search_late(d, q, 100).collect()}
    all_of = d.where("vectors is not null").crossJoin(q.withColumnRenamed("vectors", "v"))
    want = all_of.select("qid", "id", max_sim(F.col("v"), F.col("vectors")).alias("s")).where("s > 1e-12").collect()
    assert {k: s for k, s in got.items() if s > 0} == {(x.qid, x.id): round(x.s, 9) for x in want}
    assert R.search_late(d, q.limit(0)).count() == 0 and R.search_late(d.limit(0), q).count() == 0


def test_grams(spark):
    word = "".join(random.Random(9).choice("abcde") for _ in range(700))
    got = spark.createDataFrame([(word,), ("",), (None,), ("ab",)], "w string").select(T.grams(F.col("w")).alias("g")).collect()
    assert set(got[0].g) == {word[i : i + n] for n in range(1, 9) for i in range(700 - n + 1)}
    assert got[1].g == got[2].g == [] and sorted(got[3].g) == ["a", "ab", "b"]


def test_search_shuffles_neither_words_nor_hits(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abc") for _ in range(r.randrange(2, 7))) for _ in range(80)]
    docs = [(i, [r.choice(vocabulary) for _ in range(r.randrange(0, 20))], i % 7 / 10) for i in range(400)]
    asked = [(f"q{i}", [r.choice(vocabulary) for _ in range(6)]) for i in range(30)] + [("none", []), ("absent", ["zzzz"])]
    c = spark.createDataFrame(docs, "id int, tokens array<string>, bonus double").repartition(3)
    q = spark.createDataFrame(asked, "qid string, tokens array<string>")
    for scorer in ("bm25", "bm25+", "dirichlet"):
        terms = R.query_terms(q)
        whole = R.score(R.build_index(c, terms), terms, scorer).join(c, "id").select("qid", "id", (F.col("relevance") + F.col("bonus")).alias("score"))
        want = {(x.qid, x.rank): (x.id, round(x.score, 9)) for x in R.top_k(whole, 9, digits=9).collect()}
        got = R.search_weighed(c, q, scorer, 9)
        assert {(x.qid, x.rank): (x.id, round(x.score, 9)) for x in got.collect()} == want
        assert "Join" not in got._jdf.queryExecution().toString()
    scan = R.search_linear(c, q, 9)
    want = {}
    for qid, words in asked:
        hits = [(-sum(max((word_score(w, h) for h in tokens), default=0.0) for w in words), b, i) for i, tokens, b in docs]
        for at, (s, i) in enumerate(sorted((round(s - b, 9), i) for s, b, i in hits if s < 0)[:9], 1):
            want[qid, at] = (i, -s)
    assert {(x.qid, x.rank): (x.id, round(x.score, 9)) for x in scan.collect()} == want
    assert "Join" not in scan._jdf.queryExecution().toString()
