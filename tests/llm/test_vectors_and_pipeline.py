"""Embedding near-duplicates, components, the pipeline and the registered SQL."""

import random

import duckdb
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from atomweave.llm import queries
from atomweave.llm.components import components, forest
from atomweave.llm.embedding_dedup import near_vectors, plan, tables_for, unit


def brute(rows, threshold=0.93):
    def scaled(v):
        if not v or None in v:
            return None
        x = unit(np.array([v], float))[0]
        return x if np.isfinite(x).all() else None

    own = [None if label is None else scaled(v) for _, v, label in rows]
    n, p = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while p[x] != x:
            x = p[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if own[a] is not None and own[b] is not None and rows[a][2] == rows[b][2] and len(own[a]) == len(own[b]) and own[a] @ own[b] >= threshold:
                n[a] += 1
                n[b] += 1
                x, y = root(a), root(b)
                p[max(x, y)] = min(x, y)
    low = {}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            low[root(i)] = min(low.get(root(i), v), v)
    return sorted(((rows[i][0], n[i], low.get(root(i))) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("block", [8192, 40])
def test_near_vectors(spark, block):
    rng = np.random.default_rng(3)
    c, rows = rng.standard_normal((12, 64)), []
    for i in range(400):
        b = c[rng.integers(12)] / 8 if i % 2 else rng.standard_normal(64) / 8
        rows.append((i, [float(x) for x in b + rng.standard_normal(64) * rng.uniform(0, 0.06)], int(i % 3)))
    v = rows[1][1]
    rows += [(600, None, 1), (601, [0.0] * 64, 1), (602, v, None), (603, v, 1), (603, v, 1), (None, v, 1), (604, [float("nan")] * 64, 1), (605, [], 1), (606, [None] * 64, 1), (607, [1.0, 2.0], 1), (608, [2.0, 4.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, rid string, cell int")
    own = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = near_vectors(df, block=block).collect()
    want = brute(own)
    same = sum(a == b for a, b in zip(sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str), want, strict=True))
    assert same >= 0.97 * len(want)
    links = sum(w[1] for w in want)
    assert 0.9 * links <= sum(r.n_links for r in got) <= links
    if block == 40:
        assert near_vectors(df.limit(0)).count() == 0


def test_plan_meets_the_recall():
    window, need = plan(0.93, 32, 0.997)
    rng = np.random.default_rng(1)
    hits = (np.abs(rng.standard_normal((20_000, 32)) * window) <= window).sum(1)
    assert (hits >= need).mean() >= 0.99
    assert tables_for(8192, 8192, 0.93, 0.997) == (0, 1) and tables_for(0, 8192, 0.93, 0.997) == (0, 1)
    assert tables_for(8193, 8192, 0.93, 0.997)[0] == 1 and tables_for(10**6, 8192, 0.93, 0.997)[1] > 4


def test_recall_beyond_a_block(spark):
    """20,000 vectors of one label, with the block of production: found links against brute force, most of them close to the threshold."""
    rng = np.random.default_rng(5)
    n, dim = 20_000, 64
    x = rng.standard_normal((n, dim))
    for i in range(0, n, 2):  # a partner at a cosine of 0.93 to 0.96
        u = x[i] / np.linalg.norm(x[i])
        r = rng.standard_normal(dim)
        r -= (r @ u) * u
        c = rng.uniform(0.93, 0.96)
        x[i + 1] = c * u + np.sqrt(1 - c * c) * r / np.linalg.norm(r)
    x[10:40] = x[10]
    u = unit(x)
    want = np.zeros(n, int)
    for i in range(0, n, 1000):
        want[i : i + 1000] = (u[i : i + 1000] @ u.T >= 0.93).sum(1) - 1
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int").repartition(4)
    got = np.zeros(n, int)
    for r in near_vectors(df).select("vec_id", "n_links").collect():
        got[r.vec_id] = r.n_links
    assert (got <= want).all() and want.sum() > 20_000
    assert got.sum() >= 0.99 * want.sum()


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    p = {}

    def root(x):
        p.setdefault(x, x)
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        p[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(6)).collect()}
    assert all(got.get(x, x) == root(x) for x in p)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    a, b = forest(np.array([3, 2, 9]), np.array([2, 1, 8]))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {2: 1, 3: 1, 9: 8}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [list(want.columns).index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    kept = corpus_pipeline.classify(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() <= len(before)
    once = corpus_pipeline.drop_copies(spark, kept, SF)
    texts = [r.text for r in once.collect()]
    assert len(texts) == len(set(texts)) == kept.select("text").distinct().count()
    apart = corpus_pipeline.drop_near_copies(spark, once, SF)
    from test_text_operators import brute_jaccard

    rows = once.select("doc_id", "text").collect()
    want = {c for _, _, c in brute_jaccard([r.text for r in rows], [r.doc_id for r in rows])}
    assert {r.doc_id for r in apart.collect()} == want
    out = corpus_pipeline.tokenize(spark, corpus_pipeline.mix(spark, apart, SF), SF)
    assert 0 < out.count() and set(out.columns) == {"doc_id", "n_tokens", "ids", "decoded_sha256"}
    assert out.where(F.length("ids") != 4 * F.col("n_tokens")).count() == 0
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.run(spark, SF).count() > 0


def test_pipeline_stages_on_odd_tables(spark):
    """Nulls in any column, empty texts, repeated rows, extra columns with the operators' own names, and an empty table."""
    extra = "row_number string, quality_score int, rid string, row int, domain string, copies string, n_tokens int, h string, label string, digest string, rest string"
    kinds = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    more = ("r", 1, "r", 2, "d", "c", 3, "h", "l", "g", "t")
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, None, None, None), (None, "a b c", "en", "src1", 1), (None, None, None, None, None), (3, "", "en", None, 0), (4, f"{near} x", "en", "src2", 1), (5, f"{near} y", None, "src2", 1), (4, f"{near} x", "en", "src2", 1), (6, "z " * 60_000, "es", "src4", 1)]
    df = spark.createDataFrame([r + more for r in rows], kinds)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns and stage(spark, df.limit(0), SF).count() == 0
        for r in out.collect():
            assert tuple(r) in {r + more for r in rows}
    once = sorted(str(r.doc_id) for r in corpus_pipeline.drop_copies(spark, df, SF).collect())
    assert once == ["3", "4", "5", "6", "None"]  # of the empty texts the largest id, of the repeated rows one
    apart = sorted(str(r.doc_id) for r in corpus_pipeline.drop_near_copies(spark, df, SF).collect())
    assert apart == ["1", "3", "4", "6", "None", "None"]
    ids = corpus_pipeline.tokenize(spark, df, SF)
    assert ids.count() == len(rows) and corpus_pipeline.tokenize(spark, df.limit(0), SF).count() == 0
