"""Near-duplicates of embeddings by collision-counting projections.

Every vector gets m one-dimensional Gaussian projections. Inside a block the vectors are sorted by each of them. Each vector
is a query: in every sort order the window of one distance d around its own projection is found by binary search, and each
vector inside it collides once. Vectors at the threshold's distance differ by N(0, d) on a projection, so the collisions of a
true partner are binomial with a chance of 0.683; the pass count is the largest that a partner at the very threshold
reaches with the wanted recall. Pairs that reach it are verified by cosine in double precision.

Equal vectors of a label are one point with a weight. Points are dealt to blocks by tables of grid cells over further
projections; the projections of a cell and the tables follow from the label's size and the recall by one formula, which
for a label of up to block points gives one table of one cell. A cell larger than a block is split into chunks, and pairs of
chunks are tasks of their own: a cell of n points costs (n / block)^2 of them. Vectors are stored once; tables deal ids.
Blocks return link counts and a spanning forest, never pairs.

The recall is that of a pair at the very threshold, over grid and counts together; closer pairs are found with more. A pair
below the threshold is never linked.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULT, lean, mix64, sized, written
from .components import components, forest

GRID = 1.5  # width of a grid cell; unit vectors have projections of deviation 1
#: Upper bound of the share of a label's unrelated vectors that one projection's cell holds.
SHARE = 0.42


def _normal(x: float) -> float:
    return math.erf(x / math.sqrt(2))


def plan(threshold: float, m: int, recall: float) -> tuple[float, int]:
    """(window, pass count) of unit vectors at the threshold."""
    d = math.sqrt(2 - 2 * threshold)
    p, total = _normal(1.0), 0.0
    for count in range(m, 0, -1):
        total += math.comb(m, count) * p**count * (1 - p) ** (m - count)
        if total >= recall:
            return d, count
    return d, 1


def tables_for(points: int, block: int, threshold: float, recall: float) -> tuple[int, int]:
    """(projections a cell, tables) for a label of that many points: as many that a cell of unrelated vectors fills at most a block, and that partners share a cell of some table."""
    d = math.sqrt(2 - 2 * threshold)
    near = 1 - 2 * d / (math.sqrt(2 * math.pi) * GRID)  # of sharing a cell on one projection, from below
    k = min(16, max(0, math.ceil(math.log(max(1, points) / block) / math.log(1 / SHARE))))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log1p(-min(near**k, 1 - 1e-12))))


def directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, n))


def _cells(x: np.ndarray, k: int, tables: int, seed: int) -> np.ndarray:
    """A 64-bit cell of each vector in each of the first tables."""
    if not k:
        return np.zeros((len(x), tables), np.int64)
    rng = np.random.default_rng(seed + 1)
    out = np.empty((len(x), tables), np.int64)
    for t in range(tables):
        g = np.floor((x @ rng.standard_normal((x.shape[1], k)) + rng.uniform(0, GRID, k)) / GRID).astype(np.int64).view(np.uint64)
        h = np.full(len(x), t, np.uint64)
        for j in range(k):
            h = mix64(h * MULT[0] + g[:, j] * MULT[1] + MULT[2])
        out[:, t] = h.view(np.int64)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; nan in rows that are zero or hold a non-finite component."""
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        x = x / np.abs(x).max(1, keepdims=True)
        return x / np.sqrt((x * x).sum(1, keepdims=True))


def _units(batches):
    """(rid, label, dim, key, x) of the vectors that may link; key is a 128-bit digest of x."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    for b in batches:
        size = np.asarray(pc.fill_null(pc.list_value_length(b.column(2)), 0))
        for dim in np.unique(size[size > 0]).tolist():
            own = b.filter(pa.array(size == dim))
            flat = pc.fill_null(own.column(2).flatten().cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)
            x = unit(flat.reshape(-1, dim))
            fine = np.isfinite(x).all(1)
            raw = [r.tobytes() for r in x[fine]]
            own = own.filter(pa.array(fine))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([dim] * len(raw), pa.int32()), pa.array([xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())], ["rid", "label", "dim", "key", "x"])


def _pairs(xa, ha, xb, hb, same: bool, window: float, need: int, threshold: float):
    """Indices of linked pairs (a side, b side), each once: queries of a against b, sorted by each projection."""
    order = np.argsort(hb, axis=0, kind="stable").T.copy()
    lines = np.take_along_axis(hb.T, order, 1)
    lo = np.stack([np.searchsorted(line, q - window, "left") for line, q in zip(lines, ha.T, strict=True)])
    hi = np.stack([np.searchsorted(line, q + window, "right") for line, q in zip(lines, ha.T, strict=True)])
    out_a, out_b, held, waiting = [], [], [], 0

    def verify():
        a, b = (np.concatenate(v) for v in zip(*held, strict=True))
        for s in range(0, len(a), 100_000):
            p, q = a[s : s + 100_000], b[s : s + 100_000]
            ok = np.einsum("ij,ij->i", xa[p], xb[q]) >= threshold
            out_a.append(p[ok])
            out_b.append(q[ok])

    for i in range(len(xa)):
        inside = np.concatenate([o[f:t] for o, f, t in zip(order, lo[:, i].tolist(), hi[:, i].tolist(), strict=True)])
        j = np.flatnonzero(np.bincount(inside, minlength=len(xb)) >= need)
        if same:
            j = j[j > i]
        held.append((np.full(len(j), i), j))
        waiting += len(j)
        if waiting > 100_000:
            verify()
            held, waiting = [], 0
    if held:
        verify()
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, int), np.zeros(0, int))


def near_vectors(table: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", m: int = 32, recall: float = 0.997, block: int = 8192, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row.

    Only rows of equal non-null labels are compared, and vectors of different lengths never. A vector that is null, empty, zero
    or holds null or non-finite components links with nothing. Rows that share an id are vectors of their own; null ids count
    as larger than all others, and kept is whether the id equals the component's. n_links counts the other rows linked
    directly, equal vectors each by itself. Vectors of any length are read whole. Other columns are not read, whatever their
    names. An empty table gives no rows.
    """
    import pandas as pd
    import pyarrow as pa

    each = math.sqrt(recall)
    window, need = plan(threshold, m, each)
    rows = written(table.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("vid"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v")), "vectors")
    vectors = rows.where("label is not null and v is not null").select("rid", "label", "v").mapInArrow(lean(_units), "rid long, label string, dim int, key binary, x binary")
    vectors = written(vectors, "vector-units")
    of_key = vectors.groupBy("label", "key").agg(F.min("rid").alias("point"), F.count(F.lit(1)).alias("weight")).where("weight > 1")
    of_key = written(of_key, "vector-copies")
    own = vectors.select("rid", "label", "dim", "key").join(sized(of_key), ["label", "key"], "left")
    own = written(own.select("rid", "label", "dim", F.coalesce("point", "rid").alias("point"), F.coalesce("weight", F.lit(1)).alias("weight")), "vector-points")
    points = own.where("rid = point").select("rid", "label", "dim", "weight")
    units = vectors.select("rid", "x")

    size = points.groupBy("label", "dim").count()  # one row a label and length
    deal = points.join(sized(size), ["label", "dim"]).join(units, "rid").select("rid", "label", "dim", "weight", "count", "x")

    def spread(batches):
        for b in batches:
            count, dim = b.column(4).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            for n, width in {*zip(count.tolist(), dim.tolist(), strict=True)}:
                some = b.filter(pa.array((count == n) & (dim == width)))
                x = np.frombuffer(b"".join(some.column(5).to_pylist()), float).reshape(-1, width)
                k, tables = tables_for(n, block, threshold, each)
                cells = _cells(x, k, tables, seed)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([some.column(1), some.column(2), pa.array([t] * len(x), pa.int32()), pa.array(cells[:, t].copy()), some.column(0), some.column(3), some.column(4)], ["label", "dim", "t", "cell", "rid", "weight", "count"])

    dealt = written(deal.mapInArrow(lean(spread), "label string, dim int, t int, cell long, rid long, weight long, count long"), "vector-cells")
    cell = ["label", "dim", "t", "cell"]
    big = dealt.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*cell, F.ceil(F.col("n") / block).cast("int").alias("chunks"))
    big = written(big, "vector-cell-sizes")
    dealt = dealt.join(sized(big), cell).withColumn("own", F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int")).join(units, "rid")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    dealt = dealt.select(*cell, "rid", "weight", "count", "x", "own", other).withColumns({"ci": F.least("own", "other"), "cj": F.greatest("own", "other")})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        x = np.frombuffer(b"".join(pdf["x"]), float).reshape(len(pdf), -1)
        rid, chunk, weight, t = pdf["rid"].to_numpy(), pdf["own"].to_numpy(), pdf["weight"].to_numpy(), int(first["t"])
        h = x @ directions(x.shape[1], m, seed)
        same = first["ci"] == first["cj"]
        ia = ib = np.arange(len(x))
        if not same:
            ia, ib = np.flatnonzero(chunk == first["ci"]), np.flatnonzero(chunk == first["cj"])
        p, q = _pairs(x[ia], h[ia], x[ib], h[ib], same, window, need, threshold)
        p, q = ia[p], ib[q]
        if t and len(p):  # a pair counts in the first table that brings it together
            cells = _cells(x, tables_for(int(first["count"]), block, threshold, each)[0], t, seed)
            new = ~(cells[p] == cells[q]).any(axis=1)
            p, q = p[new], q[new]
        links = np.bincount(p, weight[q], len(x)) + np.bincount(q, weight[p], len(x))
        got = np.flatnonzero(links)
        a, b = forest(rid[p], rid[q]) if len(p) else (np.zeros(0, int), np.zeros(0, int))
        return pd.DataFrame({"a": np.r_[rid[got], a], "b": np.r_[np.full(len(got), -1), b], "n": np.r_[links[got].astype(int), np.zeros(len(a), int)]})

    found = written(dealt.groupBy(*cell, "ci", "cj").applyInPandas(join, "a long, b long, n long"), "vector-links")
    links = found.where("b < 0").groupBy(F.col("a").alias("point")).agg(F.sum("n").alias("n"))
    parts = components(found.where("b >= 0").select("a", "b"))
    parts = written(parts.unionByName(parts.select(F.col("component").alias("node"), "component").distinct()), "vector-components")
    of_point = written(links.join(parts, links.point == parts.node, "full").select(F.coalesce("point", "node").alias("point"), F.coalesce("component", "point").alias("c"), F.coalesce("n", F.lit(0)).alias("n")), "vector-of-points")
    named = own.join(sized(of_point), "point", "left").select("rid", F.coalesce("c", "point").alias("c"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"))
    named = written(rows.select("rid", "vid").join(named, "rid", "left").select("rid", "vid", "c", F.coalesce("n", F.lit(0)).alias("n")), "vector-named")
    shared = named.where("n > 0")  # rows that link with others: the rest are components of their own
    least = written(shared.groupBy("c").agg(F.min("vid").alias("low")), "vector-names")
    out = shared.join(sized(least), "c").select("vid", "n", "low").unionByName(named.where("n = 0").select("vid", "n", F.col("vid").alias("low")))
    return out.select(F.col("vid").alias("vec_id"), F.col("n").alias("n_links"), F.col("low").alias("component_id"), F.col("vid").eqNullSafe(F.col("low")).alias("kept"))
