"""The link graph: edges (workspace, src, dst, w), both directions; ranks, islands, communities, activation, firing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Default weight, learning rate, fading of other links, links a claim keeps, hop decay, damping.
WEIGHT, RATE, FADE, LINKS, HOP, DAMP = 0.5, 0.1, 0.98, 8, 0.5, 0.85


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a folder of our own only where that is unset on a local master."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="atomweave-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of an iteration by a reliable checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def edges(atoms: DataFrame, lens: str | None = None) -> DataFrame:
    """Symmetric edges of atoms(workspace, id, links[, link_weights, link_weights_by]).

    The weight is the larger of what both sides say, 0.5 where a side says nothing; self loops and links to absent claims go.
    """
    cols = set(atoms.columns)
    flat = atoms.select("workspace", "id", *[c for c in ("link_weights", "link_weights_by") if c in cols], F.explode("links").alias("dst"))
    own = F.try_element_at("link_weights", F.col("dst")) if "link_weights" in cols else F.lit(None).cast("double")
    if lens is not None and "link_weights_by" in cols:
        own = F.coalesce(F.try_element_at(F.try_element_at("link_weights_by", F.lit(lens)), F.col("dst")), own)
    flat = flat.select("workspace", F.col("id").alias("src"), "dst", F.coalesce(own, F.lit(WEIGHT)).alias("w")).where("src <> dst")
    ids = atoms.select("workspace", F.col("id").alias("dst"))
    flat = flat.join(ids, ["workspace", "dst"], "left_semi").select("workspace", "src", "dst", "w")
    back = flat.select("workspace", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return flat.unionByName(back).groupBy("workspace", "src", "dst").agg(F.max("w").alias("w"))


def degree(e: DataFrame) -> DataFrame:
    return e.groupBy("workspace", "src").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))


def hubs(nodes: DataFrame, e: DataFrame, rounds: int = 100, tolerance: float | None = 1e-9, every: int = 10) -> DataFrame:
    """(workspace, id, score): weighted PageRank per workspace, damping 0.85; what dangles is spread evenly. tolerance None: fixed rounds."""
    key = W.partitionBy("workspace")
    size = nodes.groupBy("workspace").agg(F.count(F.lit(1)).alias("n"))
    base = nodes.select("workspace", "id").join(size, "workspace")
    out = degree(e).select("workspace", F.col("src").alias("id"), "strength")
    base = cut(base.join(out, ["workspace", "id"], "left"))
    moves = cut(e.join(out.withColumnRenamed("id", "src"), ["workspace", "src"]).select("workspace", "src", "dst", (F.col("w") / F.col("strength")).alias("p")))
    rank = base.select("workspace", "id", (F.lit(1.0) / F.col("n")).alias("score"))
    for i in range(1, rounds + 1):
        got = moves.join(rank.withColumnRenamed("id", "src"), ["workspace", "src"]).groupBy("workspace", F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("score")).alias("got"))
        own = base.join(rank, ["workspace", "id"]).join(got, ["workspace", "id"], "left")
        lost = own.where("strength is null").groupBy("workspace").agg(F.sum("score").alias("lost"))
        own = own.join(F.broadcast(lost), "workspace", "left")  # one row a workspace
        new = own.select("workspace", "id", ((F.lit(1 - DAMP) / F.col("n")) + F.lit(DAMP) * (F.coalesce("got", F.lit(0.0)) + F.coalesce("lost", F.lit(0.0)) / F.col("n"))).alias("score"), F.col("score").alias("was"))
        new = cut(new)  # each round reads the last one three times
        if i % every == 0 and i < rounds:
            if tolerance is not None:
                worst = new.groupBy("workspace").agg(F.sum(F.abs(F.col("score") - F.col("was"))).alias("l1")).agg(F.max("l1")).first()[0]
                if worst is None or worst < tolerance:
                    return new.drop("was")
        rank = new.drop("was")
    return rank


def label_propagation(nodes: DataFrame, e: DataFrame, rounds: int = 20, every: int = 2) -> DataFrame:
    """(workspace, id, label): all at once, the heaviest label of the neighbours, the smallest of equals; lone claims keep their own."""
    own = nodes.select("workspace", "id", F.col("id").alias("label"))
    for i in range(1, rounds + 1):
        heard = e.join(own.select("workspace", F.col("id").alias("dst"), "label"), ["workspace", "dst"]).groupBy("workspace", "src", "label").agg(F.round(F.sum("w"), 9).alias("w"))
        best = W.partitionBy("workspace", "src").orderBy(F.col("w").desc(), "label")
        heard = heard.withColumn("n", F.row_number().over(best)).where("n = 1").select("workspace", F.col("src").alias("id"), F.col("label").alias("new"))
        own = own.join(heard, ["workspace", "id"], "left").select("workspace", "id", F.coalesce("new", "label").alias("label"))
        if i % every == 0 and i < rounds:
            own = cut(own)
    return own


def modularity(e: DataFrame, labels: DataFrame) -> DataFrame:
    """(workspace, modularity) of a partition (workspace, id, label)."""
    a = labels.select("workspace", F.col("id").alias("src"), F.col("label").alias("a"))
    b = labels.select("workspace", F.col("id").alias("dst"), F.col("label").alias("b"))
    own = e.join(a, ["workspace", "src"]).join(b, ["workspace", "dst"])
    part = own.groupBy("workspace", "a").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inside"))
    whole = part.groupBy("workspace").agg(F.sum("total").alias("m2"))
    return part.join(whole, "workspace").groupBy("workspace").agg(F.sum(F.col("inside") / F.col("m2") - F.pow(F.col("total") / F.col("m2"), 2)).alias("modularity"))


#: Entries of a block of nodes by communities that is compared at once, and its most nodes; nodes a window looks for such that may move.
CELLS, BLOCK, WINDOW = 1 << 17, 512, 1 << 14
#: Claims of the components that one group takes together; links that are contracted at once.
CLAIMS, FOREST = 1 << 14, 1 << 20


def _moves(near: list[dict[int, float]], m2: float, gain: float) -> tuple[list[int], bool]:
    """(community of each node, whether one moved) by local moves; near holds a node's neighbours and their weights."""
    import numpy as np

    start = np.cumsum([0, *map(len, near)])
    to, w = (np.array([x for row in near for x in get(row)], kind) for get, kind in ((dict.keys, np.int64), (dict.values, float)))
    com, moved = _local_moves(start, to, w, m2, gain)
    return com.tolist(), moved


def _last_gain(names, v, value: float, gain: float) -> int:
    """The community that a look at all of them in order ends with, where the largest gains are nearly the same."""
    best = -1
    for c, x in sorted(zip(names.tolist(), v.tolist(), strict=True)):
        if x > value + gain:
            best, value = c, x
    return best


def _local_moves(start, to, w, m2: float, gain: float):
    """(community of each node, whether one moved) by local moves in index order until none is left. Node i has the neighbours to[start[i]:start[i + 1]], once each.

    A node that stays has room: the gain another community lacks. Weight x that moves between communities takes 2 x k / m2 of
    it at most, a neighbour at weight w that leaves takes w, 2 w where it leaves the node's own community. Nodes with room left
    are passed over, as they would stay; a community without neighbours of the node is worth 0 at most. Where moves are rare, a block
    of nodes is compared with all communities at once: its nodes before the first that moves stay, those behind it are looked at again.
    """
    import numpy as np

    n, inf = len(start) - 1, float("inf")
    row = np.repeat(np.arange(n), np.diff(start))
    k = np.bincount(row, w, n)
    if (loops := row == to).any():
        to, w = to[~loops], w[~loops]
        start = np.concatenate([[0], np.cumsum(np.bincount(row[~loops], minlength=n))])
    del row, loops
    size, share, bounds, weight = np.diff(start), k / m2, start.tolist(), k.tolist()
    unit = np.divide(m2, k, out=np.zeros(n), where=k != 0)
    com = names = np.arange(n)
    tot, held, until = k.copy(), np.zeros(n), np.full(n, -1.0)
    sure = not len(w) or w.min() > 0  # else a community of neighbours can have no weight
    shifted, any_moved, moves, looks = 0.0, False, 1, 1

    def move(i: int, old: int, best: int) -> None:
        nonlocal shifted, moves, any_moved
        any_moved = True
        tot[old] -= weight[i]
        tot[best] += weight[i]
        com[i], until[i] = best, -1.0
        shifted += 2 * weight[i]
        moves += 1
        own = slice(bounds[i], bounds[i + 1])
        c, lost = com[to[own]], w[own] * unit[to[own]]
        lost[c == old] *= 2
        lost[c == best] = 0
        until[to[own]] -= lost

    def best_of(c, v, value: float, most: float) -> int:
        near = v >= most - 3 * gain
        c, v = c[near], v[near]
        if len(c) == 1 or v.min() == most:
            return int(c.min())
        return -1

    while moves:
        live, com = np.unique(com, return_inverse=True)
        tot, names, held = tot[live], names[live], held[: len(live)]
        many = len(live)
        block = min(BLOCK, CELLS // many, 3 * looks // (2 * moves)) if sure else 0
        moves = looks = at = 0
        if block < 12:
            for i in range(n):
                if shifted < until[i]:
                    continue
                looks += 1
                own = slice(bounds[i], bounds[i + 1])
                c, old, part = com[to[own]], com[i], share[i]
                np.add.at(held, c, w[own])
                value = held[old] - (tot[old] - weight[i]) * part
                v = held[c] - tot[c] * part
                held[c] = 0.0
                v[c == old] = -inf
                most = v.max(initial=-inf)
                if most > value + gain:
                    best = best_of(c, v, value, most)
                    move(i, old, best if best >= 0 else _last_gain(c, v, value, gain))
                else:
                    until[i] = shifted + (value + gain - max(most, 0.0)) * unit[i] * (1 - 1e-6) - m2 * 1e-12 if unit[i] else inf
            continue
        while at < n:
            due = at + np.flatnonzero(until[at : at + WINDOW] <= shifted)[:block]
            if not len(due):
                at += WINDOW
                continue
            each, rows = size[due], np.arange(len(due))
            if due[-1] - due[0] == len(due) - 1:
                own = slice(bounds[due[0]], bounds[due[-1] + 1])
            else:
                own = np.arange(each.sum()) + np.repeat(start[due] - np.cumsum(each) + each, each)
            into = np.bincount(np.repeat(rows * many, each) + com[to[own]], w[own], len(due) * many).reshape(-1, many)
            old, part = com[due], share[due]
            value = into[rows, old] - (tot[old] - k[due]) * part
            v = into - tot * part[:, None]
            v[into == 0] = -inf
            v[rows, old] = -inf
            most = v.max(axis=1)
            first = int(np.append(np.flatnonzero(most > value + gain), len(due))[0])
            looks += min(first + 1, len(due))
            stay = due[:first]
            # a hair less than the room there is, as sums are rounded
            room = (value[:first] + gain - np.maximum(most[:first], 0.0)) * unit[stay] * (1 - 1e-6) - m2 * 1e-12
            until[stay] = np.where(unit[stay] > 0, shifted + room, inf)
            if first < len(due):
                c = np.arange(many)
                best = best_of(c, v[first], value[first], most[first])
                move(int(due[first]), int(old[first]), best if best >= 0 else _last_gain(c, v[first], value[first], gain))
                at = int(due[first]) + 1
            else:
                at = int(due[-1]) + 1 if len(due) == block else at + WINDOW
    return names[com], any_moved


def _levels(n: int, src, dst, w, m2: float, gain: float = 1e-12):
    """The community of each of n nodes by local moves and aggregation; both directions of each link, sorted by (src, dst), no pair twice."""
    import numpy as np

    member = np.arange(n)
    while m2 > 0:
        com, any_moved = _local_moves(np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]), dst, w, m2, gain)
        _, first, com = np.unique(com, return_index=True, return_inverse=True)
        n, name = len(first), np.empty(len(first), np.int64)
        name[np.argsort(first)] = np.arange(n)
        com = name[com]
        member = com[member]
        if not any_moved:
            break
        pair, at = np.unique(com[src] * n + com[dst], return_inverse=True)
        w = np.bincount(at, w)
        src, dst = np.divmod(pair, n)
    return member


def louvain(ids: list, pairs: list[tuple], gain: float = 1e-12) -> dict:
    """Communities of one graph by local moves in index order and aggregation; pairs (src, dst, w) hold both directions."""
    import numpy as np

    index, n = {x: i for i, x in enumerate(ids)}, len(ids)
    pairs = list(pairs)
    key, at = np.unique(np.array([index[a] * n + index[b] for a, b, _ in pairs], np.int64), return_inverse=True)
    w = np.bincount(at, [x for _, _, x in pairs], len(key))
    return dict(zip(ids, _levels(n, key // max(n, 1), key % max(n, 1), w, float(w.sum()), gain).tolist(), strict=True))


def wl_colours(ids: list, pairs: list[tuple], rounds: int = 3) -> dict:
    """The colour of each claim: FNV-1a of its degree, then of its colour and its neighbours' sorted colours, round by round."""
    import numpy as np

    index = {x: i for i, x in enumerate(ids)}
    src, dst = (np.array([index[p[at]] for p in pairs], np.int64) for at in (0, 1))
    return dict(zip(ids, _colours(len(ids), src, dst, rounds), strict=True))


def _colours(n: int, src, dst, rounds: int = 3) -> list[int]:
    """Colours of n claims by their places in edges; all claims take their next neighbour at once."""
    import numpy as np

    from ..functions.fnv import BASIS64, fnv_fold

    degree = np.bincount(src, minlength=n)
    start = np.cumsum(degree) - degree
    by_degree = np.argsort(-degree, kind="stable")
    more = np.searchsorted(-degree[by_degree], -np.arange(int(degree.max(initial=0))), "left")  # claims with a neighbour there
    basis = np.full(n, BASIS64, np.uint64)
    colour = fnv_fold(basis, degree.astype(np.uint64))
    for _ in range(rounds):
        known, place = np.unique(colour, return_inverse=True)
        seen = known[np.sort(src * len(known) + place[dst]) % max(len(known), 1)]  # by claim, then by colour
        new = fnv_fold(basis, colour)
        for at, many in enumerate(more.tolist()):
            own = by_degree[:many]
            new[own] = fnv_fold(new[own], seen[start[own] + at])
        colour = new
    return colour.tolist()


def wl_signature(members: list, colour: dict) -> str:
    """FNV-1a over the members' sorted colours: equal for islands of one shape."""
    from ..functions.fnv import fnv_words

    return f"{fnv_words(sorted(colour[x] for x in members)):016x}"


def _components(t) -> tuple:
    """(workspaces, ids, root of each) of the claims in links (workspace, src, dst), roots as places in these."""
    import numpy as np
    import pyarrow as pa

    spaces = t["workspace"].combine_chunks().dictionary_encode()
    ids = pa.chunked_array([*t["src"].chunks, *t["dst"].chunks]).combine_chunks().dictionary_encode()
    key, at = np.unique(np.tile(spaces.indices.to_numpy().astype(np.int64), 2) * len(ids.dictionary) + ids.indices.to_numpy(), return_inverse=True)
    x, y = at[: t.num_rows], at[t.num_rows :]
    root = np.arange(len(key))
    while len(x):
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    return spaces.dictionary.take(pa.array(key // len(ids.dictionary))), ids.dictionary.take(pa.array(key % len(ids.dictionary))), root


def _forest(batches):
    """Fewer links with the same components, for the links of a task."""
    import numpy as np
    import pyarrow as pa

    held, rows, full = [], 0, FOREST

    def contracted():
        spaces, ids, root = _components(pa.Table.from_batches(held))
        own = pa.array(np.flatnonzero(root != np.arange(len(root))))
        return pa.table({"workspace": spaces.take(own), "src": ids.take(own), "dst": ids.take(pa.array(root)).take(own)}).combine_chunks().to_batches()

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= full:
            held = contracted()
            rows = sum(x.num_rows for x in held)
            full = rows * 2 + FOREST
    if rows:
        yield from contracted()


def _dealt(pairs: DataFrame, kind: str, loops: bool) -> DataFrame:
    """(workspace, id, part) of claims with a link: a part holds whole components, small ones together. A workspace's forest is one group."""
    import math

    import numpy as np
    import pyarrow as pa

    def parts(t: pa.Table) -> pa.Table:
        spaces, ids, root = _components(t)
        _, at, each = np.unique(root, return_inverse=True, return_counts=True)
        part = (np.cumsum(each) - each) // CLAIMS
        return pa.table({"workspace": spaces, "id": ids, "part": pa.array(part[at], pa.int64())})

    schema = f"workspace string, src {kind}, dst {kind}"
    f = pairs.select("workspace", "src", "dst").mapInArrow(_forest, schema)
    f = f.repartition(math.isqrt(f.rdd.getNumPartitions()) + 1).mapInArrow(_forest, schema)
    if loops:  # no forest has one
        f = f.unionByName(pairs.where("src = dst").select("workspace", "src", "dst").distinct())
    return f.groupBy("workspace").applyInArrow(parts, f"workspace string, id {kind}, part long")


def communities(nodes: DataFrame, e: DataFrame, both: bool = True) -> DataFrame:
    """(workspace, id, label, signature): Louvain per workspace and the signature of each island; claims go by their place in order of ids.

    Moves are sequential inside a component of links, and no move in one depends on another but by the weight of the whole workspace:
    components are groups of their own, small ones together. e holds a link in both directions; with both=False, once, and no loops.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from .setjoin import stored

    kind = nodes.schema["id"].dataType.simpleString()

    def one(n: pa.Table, p: pa.Table) -> pa.Table:
        space, m2 = n["workspace"][0], n["m2"][0].as_py()
        ids = n["id"].combine_chunks()
        ids = ids.take(pc.sort_indices(ids))
        a, b = (pc.index_in(p[c], value_set=ids) for c in ("src", "dst"))
        if a.null_count or b.null_count:
            raise KeyError("an edge of a claim that is no node")
        a, b, w = (x.to_numpy().astype(t) for x, t in ((a, np.int64), (b, np.int64), (p["w"], float)))
        back = a != b
        key, w = np.concatenate([a * len(ids) + b, (b * len(ids) + a)[back]]), np.concatenate([w, w[back]])
        order = np.argsort(key, kind="stable")
        key, w = key[order], w[order]
        del a, b, back, order
        src, dst = np.divmod(key, len(ids))
        com = _levels(len(ids), src, dst, w, m2)
        colour = _colours(len(ids), src, dst)
        order = np.argsort(com, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(com[order])) + 1)  # members by place, as communities are
        label, sig = np.empty(len(ids), np.int64), np.empty(len(ids), object)
        for m in groups:
            label[m], sig[m] = m[0], wl_signature(m.tolist(), colour)
        return pa.table({"workspace": pa.repeat(space, len(ids)), "id": ids, "label": ids.take(pa.array(label)), "signature": pa.array(sig, pa.string())})

    pairs = stored(e.select("workspace", "src", "dst", "w").where("src <= dst") if both else e.select("workspace", "src", "dst", "w"), "links")
    parts = stored(_dealt(pairs, kind, both), "parts")
    groups = parts.select("workspace", "part").distinct().count()
    whole = pairs.groupBy("workspace").agg(F.sum(F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(2 * F.col("w"))).alias("m2"))
    claims = nodes.select("workspace", "id").join(parts, ["workspace", "id"], "left").join(F.broadcast(whole), "workspace", "left")  # one row a workspace
    lone = -1 - F.pmod(F.xxhash64("id"), F.lit(16))
    claims = claims.select("workspace", F.coalesce("part", lone).alias("part"), "id", F.coalesce("m2", F.lit(0.0)).alias("m2"))
    own = pairs.join(parts.withColumnRenamed("id", "src"), ["workspace", "src"]).select("workspace", "part", "src", "dst", "w")
    many = min(8 * groups + 16, 4096)  # more tasks than groups, as two in one wait for each other
    claims, own = claims.repartition(many, "workspace", "part"), own.repartition(many, "workspace", "part")
    return claims.groupBy("workspace", "part").cogroup(own.groupBy("workspace", "part")).applyInArrow(one, f"workspace string, id {kind}, label {kind}, signature string")


def activate(e: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(workspace, id, energy) spread from seeds(workspace, id, energy): each hop passes half, by weight; what arrives adds up, seeds included."""
    share = e.withColumn("p", F.col("w") / F.sum("w").over(W.partitionBy("workspace", "src"))).select("workspace", "src", "dst", "p")
    front = total = seeds.groupBy("workspace", "id").agg(F.sum("energy").alias("energy"))
    for _ in range(hops):
        front = share.join(front.withColumnRenamed("id", "src"), ["workspace", "src"]).groupBy("workspace", F.col("dst").alias("id")).agg(F.sum(F.lit(HOP) * F.col("energy") * F.col("p")).alias("energy"))
        total = total.unionByName(front)
    return total.groupBy("workspace", "id").agg(F.sum("energy").alias("energy"))


def walk(nodes: DataFrame, e: DataFrame, seeds: DataFrame, rounds: int = 20, damp: float = 0.5) -> DataFrame:
    """Personalised PageRank from seeds(workspace, id, place): restart weights 1 / (place + 1)."""
    key = W.partitionBy("workspace")
    start = seeds.select("workspace", "id", (F.lit(1.0) / (F.col("place") + 1)).alias("r"))
    start = start.withColumn("r", F.col("r") / F.sum("r").over(key))
    share = e.withColumn("p", F.col("w") / F.sum("w").over(W.partitionBy("workspace", "src"))).select("workspace", "src", "dst", "p")
    base = cut(nodes.select("workspace", "id").join(start, ["workspace", "id"], "left").select("workspace", "id", F.coalesce("r", F.lit(0.0)).alias("r")))
    rank = base.withColumnRenamed("r", "score")
    for i in range(1, rounds + 1):
        got = share.join(rank.withColumnRenamed("id", "src"), ["workspace", "src"]).groupBy("workspace", F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("score")).alias("got"))
        rank = base.join(got, ["workspace", "id"], "left").select("workspace", "id", (F.lit(1 - damp) * F.col("r") + F.lit(damp) * F.coalesce("got", F.lit(0.0))).alias("score"))
        if i % 10 == 0 and i < rounds:
            rank = cut(rank)
    return rank


def one_hop(live: DataFrame, seeds: DataFrame) -> DataFrame:
    """Claims that seeds link to and that are no seeds, by (workspace, id)."""
    near = live.join(seeds.select("workspace", "id").distinct(), ["workspace", "id"], "left_semi").select("workspace", F.explode("links").alias("id")).distinct()
    return live.join(near, ["workspace", "id"], "left_semi").join(seeds.select("workspace", "id"), ["workspace", "id"], "left_anti")


def live_links(atoms: DataFrame, live: DataFrame) -> DataFrame:
    """atoms with links cut to claims of live in their workspace; order kept."""
    flat = atoms.select("workspace", "id", F.posexplode("links").alias("at", "peer"))
    flat = flat.join(live.select("workspace", F.col("id").alias("peer")).distinct(), ["workspace", "peer"], "left_semi")
    kept = flat.groupBy("workspace", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "peer"))), lambda x: x["peer"]).alias("__kept"))
    return atoms.join(kept, ["workspace", "id"], "left").withColumn("links", F.coalesce("__kept", F.array().cast("array<string>"))).drop("__kept")


def fire(atoms: DataFrame, fired: DataFrame) -> DataFrame:
    """atoms(workspace, id, links, link_weights) after fired(workspace, id) went off together.

    Pairs inside: the larger weight of both sides (0.5 by default) grows by a tenth of what lacks to 1, and a missing link is
    made where both hold fewer than eight. Other links of fired claims fade by 0.98 at both ends. A fired set is a few claims.
    """
    on = fired.select("workspace", "id").distinct()
    none = F.create_map().cast("map<string,double>")
    rows = atoms.withColumn("link_weights", F.coalesce("link_weights", none)).join(on.withColumn("__on", F.lit(True)), ["workspace", "id"], "left").withColumn("__on", F.coalesce("__on", F.lit(False)))
    sets = on.groupBy("workspace").agg(F.array_sort(F.collect_list("id")).alias("__set"))
    hot = rows.where("__on").select("workspace", "id", "links", "link_weights")
    x, y = hot.alias("x"), hot.alias("y")
    pair = x.join(y, (F.col("x.workspace") == F.col("y.workspace")) & (F.col("x.id") != F.col("y.id")))
    w = lambda a, b: F.coalesce(F.try_element_at(F.col(f"{a}.link_weights"), F.col(f"{b}.id")), F.lit(WEIGHT))
    linked = F.array_contains("x.links", F.col("y.id")) | F.array_contains("y.links", F.col("x.id"))
    room = (F.size("x.links") < LINKS) & (F.size("y.links") < LINKS)
    best = F.greatest(w("x", "y"), w("y", "x"))
    grown = pair.where(linked | room).select(F.col("x.workspace").alias("workspace"), F.col("x.id").alias("id"), F.col("y.id").alias("peer"), (best + F.lit(RATE) * (1 - best)).alias("w"))
    grown = grown.groupBy("workspace", "id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("peer", "w")))).alias("__grown"))
    rows = rows.join(F.broadcast(sets), "workspace", "left").join(grown, ["workspace", "id"], "left")
    inside = F.coalesce("__set", F.array().cast("array<string>"))
    grown_map = F.coalesce("__grown", none)
    faded = F.map_from_entries(
        F.transform(
            "links",
            lambda p: F.struct(
                p.alias("key"),
                F.coalesce(F.try_element_at(grown_map, p), F.coalesce(F.try_element_at("link_weights", p), F.lit(WEIGHT)) * F.when(F.col("__on") != F.array_contains(inside, p), F.lit(FADE)).otherwise(1.0)).alias("value"),
            ),
        )
    )
    fresh = F.array_except(F.map_keys(grown_map), F.col("links"))
    new = F.map_concat(faded, F.map_filter(grown_map, lambda k, v: F.array_contains(fresh, k)))
    return rows.withColumn("link_weights", new).withColumn("links", F.slice(F.concat("links", fresh), 1, LINKS)).drop("__on", "__set", "__grown")


def knn(vectors: DataFrame, k: int = 5, floor: float = 0.0) -> DataFrame:
    """Edges of the k nearest by cosine of (id, vector), symmetric; vectors are asked in blocks by search_dense, whatever their number."""
    from .retrieval import search_dense

    hits = search_dense(vectors, vectors.select(F.col("id").alias("qid"), "vector"), k + 1).where((F.col("qid") != F.col("id")) & (F.col("cosine") > floor))
    hits = hits.withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy(F.col("cosine").desc(), "id"))).where(F.col("n") <= k)
    one = hits.select(F.lit("all").alias("workspace"), F.col("qid").alias("src"), F.col("id").alias("dst"), F.col("cosine").alias("w"))
    back = one.select("workspace", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return one.unionByName(back).groupBy("workspace", "src", "dst").agg(F.max("w").alias("w"))
