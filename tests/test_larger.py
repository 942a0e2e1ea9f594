"""Queries against their SQL on tables where the smallest scale shows no difference: long ballots, peers declared twice, copies."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import rows

from atomweave.functions.fnv import fnv_words
from atomweave.operators import fusion as FU
from atomweave.operators import graph as G
from atomweave.operators import links as L
from atomweave.plans import catalogue


def same(spark, name, folder, **tables):
    """The query over tables (name to SQL) written to folder, against its SQL."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"copy ({sql}) to '{folder}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, str(folder))
    got, want = df.collect(), con.sql(catalogue.ORACLES[name])
    assert got and rows(df.columns, got) == rows(list(want.columns), want.fetchall())


#: One nation of 100 suppliers, ballots of 100 and 75; the sums are whole numbers.
LONG = {
    "supplier": "select range as s_suppkey, cast(1 as int) as s_nationkey from range(100)",
    "lineitem": "select range * 50 + l as l_orderkey, range as l_suppkey, cast(1 + range * 37 % 101 % 9 as double) as l_quantity, cast(range * 53 % 103 as double) as l_extendedprice, cast(0 as double) as l_discount from range(100), range(5) t(l) where l <= range * 29 % 5",
}


def test_preferences_of_long_ballots(spark, tmp_path):
    same(spark, "ballot_preferences", tmp_path, **LONG)


@pytest.mark.parametrize("voter", ["borda", "copeland", "dowdall", "schulze"])
def test_voters_of_long_ballots(spark, tmp_path, voter):
    same(spark, f"fuse_{voter}", tmp_path, **LONG)


@pytest.mark.parametrize("voter", ["borda", "dowdall"])
def test_ties_are_first_seen_in_whole_ballots(spark, voter):
    """x and y get the same from ballots 1 and 2; the first ballot names y before x, both beyond its first 64."""
    filler = lambda n, at: [f"f{at}-{i}" for i in range(n)]
    lists = [[*filler(65, 0), "y", "x"], [*filler(5, 1), "x"], [*filler(5, 2), "y"]]
    b = spark.createDataFrame([("q", i, p, k, 1.0) for i, own in enumerate(lists) for p, k in enumerate(own)], "qid string, ballot int, pos int, key string, score double")
    place = {r.key: r.place for r in FU.fuse(b, voter).collect()}
    assert place["y"] == place["x"] - 1


def test_preferences_keep_their_cut(spark):
    b = spark.createDataFrame([("q", 0, p, f"k{p}", 1.0) for p in range(5)], "qid string, ballot int, pos int, key string, score double")
    assert FU.preferences(b, 3).count() == 3 and FU.preferences(b, None).count() == 10
    assert FU.fuse(b, "copeland", 3).count() == FU.fuse(b, "schulze", 3).count() == 3


def test_peer_declared_twice(spark, tmp_path):
    """Parts whose two links are one: 7 k mod 1009 = 3 k mod 997."""
    same(spark, "links_symmetric", tmp_path, part="select range as p_partkey from range(1000) union all select range from range(1000, 1100000) where range * 7 % 1009 = range * 3 % 997")


def _named(n, copies):
    return [("w" if i % 3 else "v", str(i), [f"big{i % 2}", f"n{i // copies % 5}", f"m{i // copies % 7}", *([f"o{i % 4}"] if i % 5 else [])]) for i in range(n)]


def test_links_of_copies(spark):
    """Claims of one set in numbers beyond the pool, sets of other sizes, against every pair of claims."""
    claims = _named(420, 3) + [("w", f"c{i}", ["same", "set"]) for i in range(90)] + [("w", "none", []), ("w", "lone", ["own"])]
    atoms = spark.createDataFrame(claims, "workspace string, id string, names array<string>")
    alike = lambda x, y: len(set(x[2]) & set(y[2])) / len({*x[2], *y[2]}) if x[0] == y[0] and x[2] else 0.0
    near = {x[1]: [(alike(x, y), y[1], set(y[2])) for y in claims if y[1] != x[1] and alike(x, y) >= L.THRESHOLD] for x in claims}
    pairs = {(r.a, r.b): r.overlap for r in L.entity_pairs(atoms, atoms).collect()}
    assert pairs == {(a, b): o for a, own in near.items() for o, b, _ in own}
    assert {r.id: r.links for r in L.link_targets(atoms).collect()} == {a: L.targets(a, own) for a, own in near.items() if own}
    some = atoms.where("id like '%7'")
    assert {r.id: r.links for r in L.link_targets(atoms, some).collect()} == {a: L.targets(a, own) for a, own in near.items() if own and a.endswith("7")}


def test_frequent_names_meet_no_pairs(spark):
    """One name in common of 4,000 sets of three: 16 million pairs share it, none is a result, and none leaves the join."""
    atoms = spark.range(4000).select(F.lit("w").alias("workspace"), F.col("id").cast("string").alias("id"), F.array(F.lit("all"), F.concat(F.lit("a"), "id"), F.concat(F.lit("b"), "id")).alias("names"))
    x = L._classes(atoms)
    met = L._class_pairs(x, x, L.THRESHOLD)
    assert met.count() == 4000 and L.entity_pairs(atoms, atoms).count() == 0


def _plain_louvain(near, m2, gain=1e-12):
    """Local moves that look at every node in every pass."""
    com, k, moved = list(range(len(near))), [sum(x.values()) for x in near], True
    tot = k[:]
    while moved:
        moved = False
        for i, row in enumerate(near):
            to = {}
            for j, w in row.items():
                if j != i:
                    to[com[j]] = to.get(com[j], 0.0) + w
            tot[com[i]] -= k[i]
            best, value = com[i], to.get(com[i], 0.0) - tot[com[i]] * k[i] / m2
            for c in sorted(to):
                if to[c] - tot[c] * k[i] / m2 > value + gain:
                    best, value = c, to[c] - tot[c] * k[i] / m2
            tot[best] += k[i]
            moved |= best != com[i]
            com[i] = best
    return com


def test_louvain_moves_pass_over_nodes_that_stay():
    """Random graphs of many densities, weights, loops and lone nodes: the moves of every pass over all nodes."""
    rng = random.Random(5)
    for n, degree in [(1, 0), (30, 2), (80, 4), (300, 6), (300, 40), (900, 12)] * 4:
        near = [{} for _ in range(n)]
        for _ in range(n * degree // 2):
            a, b = (rng.randrange(n), rng.randrange(n)) if rng.random() < 0.5 else ((x := rng.randrange(n)), min(n - 1, x // 10 * 10 + rng.randrange(10)))
            near[a][b] = near[b][a] = rng.choice([0.25, 0.5, 0.75, 1.0])
        m2 = sum(sum(x.values()) for x in near)
        if m2:
            com = _plain_louvain(near, m2)
            assert G._moves(near, m2, 1e-12) == (com, com != list(range(n)))


def test_colours_take_neighbours_at_once():
    rng = random.Random(6)
    ids = [f"n{i}" for i in range(60)]
    pairs = {p for _ in range(200) for a, b in [rng.sample(ids[:50], 2)] for p in ((a, b, 1.0), (b, a, 1.0))}
    near = {x: [b for a, b, _ in pairs if a == x] for x in ids}
    colour = {x: fnv_words([len(near[x])]) for x in ids}
    for _ in range(3):
        colour = {x: fnv_words([colour[x], *sorted(colour[y] for y in near[x])]) for x in ids}
    assert G.wl_colours(ids, sorted(pairs)) == colour


def _bought(spark, folder, rows, parts):
    """louvain_islands over lineitem rows (order, part), and the same by hand over every pair of parts of an order."""
    con = duckdb.connect()
    con.execute("create table li (l_orderkey bigint, l_partkey bigint)")
    con.executemany("insert into li values (?, ?)", rows)
    con.execute(f"copy li to '{folder}/lineitem.parquet' (format parquet)")
    con.execute(f"copy (select range as p_partkey from range({parts})) to '{folder}/part.parquet' (format parquet)")
    orders, count = {}, {}
    for o, p in rows:
        if o is not None and p is not None and p < parts:
            orders.setdefault(o, set()).add(p)
    for own in orders.values():
        for a in own:
            for b in own - {a}:
                count[a, b] = count.get((a, b), 0) + 1
    near = [{b: min(count[a, b] / 4, 1.0) for b in range(parts) if (a, b) in count} for a in range(parts)]
    colour = {a: fnv_words([len(near[a])]) for a in range(parts)}
    for _ in range(3):
        colour = {a: fnv_words([colour[a], *sorted(colour[b] for b in near[a])]) for a in range(parts)}
    member = _plain_levels(near)
    islands = {c: [a for a in range(parts) if member[a] == c] for c in member}
    want = {f"{a:08d}": (f"{min(own):08d}", f"{fnv_words(sorted(colour[x] for x in own)):016x}") for own in islands.values() for a in own}
    got = catalogue.QUERIES["louvain_islands"](spark, str(folder)).collect()
    return {r.id: (r.label, r.signature) for r in got}, want


def _plain_levels(near):
    """The island of each node: plain moves, level by level."""
    member, m2 = list(range(len(near))), sum(sum(x.values()) for x in near)
    while m2:
        com = _plain_louvain(near, m2)
        names = {c: i for i, c in enumerate(dict.fromkeys(com))}
        member = [names[com[c]] for c in member]
        if len(names) == len(near):
            break
        joined = [{} for _ in names]
        for i, row in enumerate(near):
            for j, w in row.items():
                a, b = names[com[i]], names[com[j]]
                joined[a][b] = joined[a].get(b, 0.0) + w
        near = joined
    return member


@pytest.mark.parametrize("odd", [[], [(None, 1), (None, 100), (1, None), (2, None), (3, 500), (4, 500)]], ids=["whole", "odd"])
def test_islands_of_every_pair_of_an_order(spark, tmp_path, odd):
    """The first and the last part of an order are linked too; rows without an order, and parts that are none, name no pair."""
    rng = random.Random(7)
    rows = [(o, o % 4 * 30 + rng.randrange(30)) for o in range(400) for _ in range(rng.randrange(1, 7))]
    got, want = _bought(spark, tmp_path, [*rows, *rows[:50], *odd], 125)
    assert got == want and len(set(want.values())) > 5


def test_islands_of_many_components(spark):
    """Two workspaces of components, lone claims, a loop on a claim of its own: every workspace as one graph, in plain moves."""
    rng = random.Random(8)
    nodes, links, want = [], [], {}
    for space, n in (("v", 60), ("w", 230)):
        ids = sorted(f"n{i}" for i in range(n))
        near = [{} for _ in ids]
        for _ in range(3 * n):
            a = rng.randrange(n - 10)
            b = a // 20 * 20 + rng.randrange(20)
            if b < n - 10 and a != b:
                near[a][b] = near[b][a] = rng.choice([0.25, 0.5, 1.0])
        near[n - 1][n - 1] = near[3][3] = 0.5
        nodes += [(space, x) for x in ids]
        links += [(space, ids[a], ids[b], w) for a, row in enumerate(near) for b, w in row.items()]
        member = _plain_levels(near)
        want |= {(space, x): ids[member.index(member[i])] for i, x in enumerate(ids)}
    rng.shuffle(links)
    e = spark.createDataFrame(links, "workspace string, src string, dst string, w double")
    got = G.communities(spark.createDataFrame(nodes, "workspace string, id string"), e.repartition(7)).collect()
    assert len(got) == len(want) and {(r.workspace, r.id): r.label for r in got} == want


def test_components_are_groups_of_their_own(spark):
    """Three large components of one workspace go to tasks of their own; they waited for each other in one."""
    n, parts = 17_000, 3
    nodes = spark.range(n * parts).select(F.lit("w").alias("workspace"), "id")
    links = nodes.where(f"id % {n} > 0").select("workspace", F.col("id").alias("src"), (F.col("id") - 1 - F.pmod(F.xxhash64("id"), F.least(F.lit(40), F.col("id") % n))).alias("dst"), F.lit(1.0).alias("w"))
    e = links.unionByName(links.select("workspace", F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    got = G.communities(nodes, e).groupBy((F.col("id") / n).cast("int").alias("part"), F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low")).collect()
    assert sorted((r.part, r.n, r.low) for r in got) == [(i, n, i * n) for i in range(parts)] and len({r.task for r in got}) == parts


def test_moves_over_links_without_weight():
    """A link of weight 0 makes a community one of the neighbours'; weights that no sum keeps exact."""
    rng = random.Random(9)
    for n, degree, weights in [(200, 6, [0.0, 0.25, 1.0]), (400, 20, [0.1, 0.3, 0.7]), (400, 3, [1 / 3])]:
        near = [{} for _ in range(n)]
        for _ in range(n * degree // 2):
            a, b = rng.randrange(n), rng.randrange(n)
            near[a][b] = near[b][a] = rng.choice(weights)
        m2 = sum(sum(x.values()) for x in near)
        assert G._moves(near, m2, 1e-12)[0] == _plain_louvain(near, m2)
