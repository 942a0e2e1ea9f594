"""Jaccard join of word shingle sets in their metric space: pivots, Voronoi regions, triangle windows, recursion.

Distance is 1 - Jaccard, a metric; two documents link at distance 0.2 or less (5 words a shingle, similarity 0.8).

Pivots and regions. Documents drawn from a corpus lie at distance 1 from each other, and at distance 1 from pivots drawn
without regard to them, where windows would replicate every document everywhere. So each document brings landmarks: the
first n - ceil(0.8 n) + 1 of its n shingles in one fixed order. Linked documents share a landmark. Among the documents that
hold a landmark, the one of the smallest hash is its pivot: a document, the same for most landmarks of a group of copies. The
region of a pivot is all documents that hold one of its landmarks, so a document without company is in no region, and linked
documents share a region. Every document's distance to the pivots of its regions is found: one pair a document and pivot, never
all pairs of a region. Parity sketches, whose Hamming distance never exceeds the symmetric difference, bound it from below;
where they leave a link possible it is exact, elsewhere it lies between the bound and 1, and windows use both ends. Documents within 0.2 of a pivot are one component with it; the pivot itself needs no further comparison there.

Recursion. A region whose documents are of one component already is done. Any other of more than REGION documents is split:
PIVOTS of its documents outside the largest component become pivots, the distances of all its documents to them are found
and link what they link, and the documents go to the Voronoi region of their nearest pivot, at distance d, and to the region
of every pivot within d + 0.2. Of two linked documents let x be the one nearer to its own nearest pivot p: by the triangle
inequality the other is at most d(x) + 0.2 from p, so it is in the region of p too. Regions split until they hold REGION
documents. Where a split would not halve the pairs (documents at equal distances from each other) the region stays whole.

Join. In what remains, documents of different components are compared where the triangle window of the region's pivot (their
distances to it differ by at most 0.2) and their sizes allow a link; sketches reject most, and the rest is tested on the full
sets. In a region that could not be split, the
documents outside the largest component are a stated query set and meet the region in blocks. Each of them first gives its
few most promising pairs; in later rounds it gives more, if it is still apart, until no document has untested pairs.

The order of shingles is by frequency class, then hash: shingles in more than rare documents come later, the more frequent
the later. Any fixed order gives the same result; this one keeps regions small. Documents with equal sets are one point.
Nothing is dropped at any step, so the join is exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALT_ROWS, Shingler, fresh, lean, mix64, partitions, salted, scratch, sized, small_batches, text_slices, written
from .components import components

#: Shingles whose frequency class the driver reads and broadcasts, 16 bytes each (64 MB): the most frequent ones. A shingle
#: beyond them is held by fewer documents than all shingles of the corpus divided by this number, which bounds its group.
FREQUENT = 4_000_000
#: New pivots of a region that is split, and documents of a region that is not.
PIVOTS, REGION = 8, 128
#: Rows of a region that could not be split with which the rows of smaller components are compared in one group.
BLOCK = 2048
#: Pairs that an asking row gives in the first round of the join, and by how much later rounds raise it.
FIRST, RAISE = 3, 16
#: Rows of several regions that are joined in one Python group.
GROUP_ROWS = 20_000
#: The distance of a link, and what floating point may add to it.
NEAR = 0.2 + 1e-9


def _bits(docs: DataFrame) -> int:
    """Bits of the bucket number: at least eight buckets a shuffle partition."""
    return max(8, (8 * partitions(docs.sparkSession) - 1).bit_length())


def _count(bits: int):
    """Per slice of texts and bucket: the next 32 bits of all shingles, one for each document that holds it."""
    import pyarrow as pa

    def run(batches):
        shingles = Shingler()
        for b in batches:
            for _, _, texts in text_slices(b.column(0), 8_000_000):
                parts = [shingles(t) for t in texts]
                h = np.sort(np.concatenate(parts) >> np.uint64(32 - bits)) if parts else np.zeros(0, np.uint64)
                if len(h):
                    bucket = (h >> np.uint64(32)).astype(np.int32)
                    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                    low = h.astype(np.uint32)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array([x.tobytes() for x in np.split(low, at[1:])], pa.binary())], ["bucket", "keys"])

    return run


def _frequent(rare: int):
    import pandas as pd

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        keys, n = np.unique(np.frombuffer(b"".join(pdf["keys"]), np.uint32), return_counts=True)
        keys, n = keys[n > rare], n[n > rare]
        return pd.DataFrame({"key": (np.int64(key[0]) << 32) | keys.astype(np.int64), "level": np.floor(np.log2(n / rare)).astype(np.int64) + 1})

    return run


def frequent_shingles(docs: DataFrame, rare: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(leading bits + 32 bits, ascending; frequency class from 1) of the shingles in more than rare documents, at most FREQUENT of them."""
    found = docs.select("text").mapInArrow(lean(_count(bits)), "bucket int, keys binary").groupBy("bucket").applyInPandas(_frequent(rare), "key long, level long")
    found = written(found, "jaccard-frequent")
    least, total = 1, 0
    for level, n in sorted(((r["level"], r["count"]) for r in found.groupBy("level").count().collect()), reverse=True):  # one row a class
        total += n
        if total > FREQUENT:
            least = level + 1
            break
    rows = found.where(F.col("level") >= least).toPandas().sort_values("key")
    return rows["key"].to_numpy(np.uint64), rows["level"].to_numpy(np.int64)


def sketch(s: np.ndarray) -> bytes:
    """Parities of the hashes by their low bits: 2 to 4 bits a shingle, a power of two of at least 64."""
    m = max(64, 1 << int(2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1, bitorder="little").tobytes()


POP = np.array([bin(i).count("1") for i in range(256)], np.int64)


def apart(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets from their sketches; a larger sketch folds to the smaller's size."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(POP[x ^ y].sum())


SETS = "rid long, id long, id0 long, th long, n int, sig binary, sketch binary, rare binary, frequent array<struct<s:long,salts:int>>"


def _sets(bits: int, keys, levels, rare_rows: int):
    """Rows of SETS: rare holds the document's landmarks among rare shingles (64-bit hashes), frequent those that follow, each with the parts its documents are dealt to."""
    import pyarrow as pa
    import xxhash

    def run(batches):
        shingles, keys_, levels_ = Shingler(), keys.value, levels.value
        for b in batches:
            n, sig, sk, rare, freq, parts, ends = [], [], [], [], [], [], [0]
            for s in (shingles(t) for _, _, texts in text_slices(b.column(4)) for t in texts):
                n.append(len(s))
                sig.append(xxhash.xxh3_128_digest(s.tobytes()))
                sk.append(sketch(s) if len(s) else b"")
                p = len(s) - (80 * len(s) + 99) // 100 + 1 if len(s) else 0
                if len(keys_) and p:
                    k = s >> np.uint64(32 - bits)
                    at = np.minimum(np.searchsorted(keys_, k), len(keys_) - 1)
                    hot = keys_[at] == k
                    own = s[~hot][:p]
                    order = np.lexsort((s[hot], levels_[at[hot]]))[: max(0, p - len(own))]
                    freq.append(s[hot][order].view(np.int64))
                    parts.append(np.maximum(1, (rare_rows << np.minimum(levels_[at[hot]][order], 40)) // SALT_ROWS))
                else:
                    own = s[:p]
                rare.append(own.tobytes())
                ends.append(ends[-1] + (len(freq[-1]) if freq and len(keys_) and p else 0))
            flat = [pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(t)) for x, t in ((freq, np.int64), (parts, np.int32))]
            frequent = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, ["s", "salts"]))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(n, pa.int32()), pa.array(sig, pa.binary()), pa.array(sk, pa.binary()), pa.array(rare, pa.binary()), frequent], ["rid", "id", "id0", "th", "n", "sig", "sketch", "rare", "frequent"])

    return run


def _deal(bits: int):
    """Per batch and bucket: the rare landmarks there, and their documents, as arrays."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rid, raw = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            h = np.frombuffer(b"".join(raw), np.uint64)
            if not len(h):
                continue
            row = np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw])
            bucket = (h >> np.uint64(64 - bits)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, key, row = bucket[order], (h[order] >> np.uint64(32 - bits)).astype(np.uint32), row[order]
            at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            cut = lambda v, at=at: pa.array([x.tobytes() for x in np.split(v, at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), cut(key), cut(rid[row].astype(np.int64))], ["bucket", "key", "rid"])

    return run


def _stars_of_bucket(pdf):
    """(x, q) of the landmarks of a bucket that several documents hold: each with its pivot, the document of the smallest hash."""
    import pandas as pd

    key, rid = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("key", np.uint32), ("rid", np.int64)))
    order = np.lexsort((mix64(rid.view(np.uint64)), key))
    key, rid = key[order], rid[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    pivot = np.repeat(rid[first], np.diff(np.r_[first, len(key)]))
    own = pivot != rid
    return pd.DataFrame({"x": rid[own], "q": pivot[own]}).drop_duplicates()


def _bounds(batches):
    """(x, q, lo, maybe): a lower bound of the distance from the sketches and sizes, and whether a link is possible."""
    import pyarrow as pa

    for b in batches:
        lo, maybe = [], []
        for n, m, a, c in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True):
            d = max(apart(a, c), abs(n - m))
            lo.append(2 * d / (n + m + d))
            maybe.append(9 * d <= n + m)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lo, pa.float64()), pa.array(maybe, pa.bool_())], ["x", "q", "lo", "maybe"])


def _exact(batches):
    """(x, q, d, linked) from the full sets."""
    import pyarrow as pa

    for b in batches:
        d, linked = [], []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            union = len(x) + len(y) - both
            d.append(1 - both / union)
            linked.append(100 * both >= 80 * union)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d, pa.float64()), pa.array(linked, pa.bool_())], ["x", "q", "d", "linked"])


def _hashes(batches):
    import pyarrow as pa

    shingles = Shingler()
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([shingles(t).tobytes() for t in b.column(2).to_pylist()], pa.binary())], ["id0", "th", "set"])


def _measure(pairs: DataFrame, points: DataFrame, docs: DataFrame) -> DataFrame:
    """(x, q, lo, hi, linked) of each pair of points: the exact distance wherever the sketches allow a link, else the sketches' bound and 1. A point may be the q of any number of pairs."""
    with scratch(points.sparkSession, "jaccard-measured"):
        side = lambda c, a, n: points.select(F.col("rid").alias(c), F.col("n").alias(n), F.col("sketch").alias(a))
        near = salted(pairs.select("x", "q").join(side("x", "a", "an"), "x"), side("q", "b", "bn"), "q", "x", pairs).select("x", "q", "an", "bn", "a", "b")
        near = written(near.mapInArrow(lean(_bounds), "x long, q long, lo double, maybe boolean"), "jaccard-bounds")
        open_ = near.where("maybe").select("x", "q")
        ids = open_.select(F.col("x").alias("rid")).unionByName(open_.select(F.col("q").alias("rid"))).distinct()
        ids = written(ids.join(points.select("rid", "id0", "th"), "rid"), "jaccard-ids")
        sets = docs.select("id0", "th", "text").join(sized(ids.select("id0", "th").distinct()), ["id0", "th"], "left_semi").mapInArrow(lean(_hashes), "id0 long, th long, set binary").dropDuplicates(["id0", "th"])
        sets = written(ids.join(sets, ["id0", "th"]).select("rid", "set"), "jaccard-sets")
        both = salted(open_.join(sets.select(F.col("rid").alias("x"), F.col("set").alias("a")), "x"), sets.select(F.col("rid").alias("q"), F.col("set").alias("b")), "q", "x", open_)
        exact = both.select("x", "q", "a", "b").mapInArrow(lean(_exact), "x long, q long, d double, linked boolean")
        out = near.join(exact, ["x", "q"], "left").select("x", "q", F.coalesce("d", "lo").alias("lo"), F.coalesce("d", F.lit(1.0)).alias("hi"), F.coalesce("linked", F.lit(False)).alias("linked"))
        return written(out, "jaccard-measured")


def _ratio(sketches: list[bytes], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of pairs (i, j) of rows, nine times the sketches' bound of the symmetric difference by the sum of the sizes: at most 1 where a link is possible."""
    width = np.array([len(x) for x in sketches])
    out = np.zeros(len(i))
    swap = width[i] < width[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    for big, small in np.unique(np.stack([width[i], width[j]]), axis=1).T.tolist():
        at = np.flatnonzero((width[i] == big) & (width[j] == small))
        for some in np.array_split(at, -(-len(at) * (big + small) // 30_000_000)):
            a, b = (np.frombuffer(b"".join([sketches[k] for k in v[some].tolist()]), np.uint8).reshape(len(some), -1) for v in (i, j))
            while a.shape[1] > small:
                a = a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2 :]
            apart_ = np.bitwise_count(np.ascontiguousarray(a).view(np.uint64) ^ b.view(np.uint64)).sum(1, dtype=np.int64)
            out[some] = 9 * apart_ / (n[i[some]] + n[j[some]])
    return out


def _block(most: int):
    """(x, q, more) of rows that ask and rows of the same chunk of their region that may link: other component, sizes, window and sketches allow it. Each asking row gives its most promising pairs, as many as most says; more: whether it has others."""
    import pandas as pd

    return lambda pdf: _candidates(pdf, most) if len(pdf) else pd.DataFrame({"x": [], "q": [], "more": []})


def _candidates(pdf, most: int):
    import pandas as pd

    pdf = pdf.sort_values(["region", "chunk", "asks"])
    region, chunk, asks, rid, n, low, high, label, major = (pdf[c].to_numpy() for c in ("region", "chunk", "asks", "rid", "n", "lo", "hi", "label", "major"))
    n, sketches = n.astype(np.int64), pdf["sketch"].tolist()
    begin = np.flatnonzero(np.r_[True, (region[1:] != region[:-1]) | (chunk[1:] != chunk[:-1])])
    out, held, waiting = [], [], 0

    def test():
        i, j = (np.concatenate(v) for v in zip(*held, strict=True))
        ratio = _ratio(sketches, n, i, j)
        fine = np.flatnonzero(ratio <= 1)
        fine = fine[np.lexsort((ratio[fine], i[fine]))]
        i, j = i[fine], j[fine]
        first = np.searchsorted(i, i)
        place, count = np.arange(len(i)) - first, np.searchsorted(i, i, "right") - first
        on = place < most
        p, r = rid[i[on]], rid[j[on]]
        out.append(pd.DataFrame({"x": np.minimum(p, r), "q": np.maximum(p, r), "more": (count > most)[on]}))

    for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(rid)], strict=True):
        mid = lo + int(np.searchsorted(asks[lo:hi], True))
        rows = np.arange(lo, mid)
        for at in range(mid, hi, 512):
            own = np.arange(at, min(at + 512, hi))
            a, b = n[own][:, None], n[rows][None, :]
            ok = (5 * np.minimum(a, b) >= 4 * np.maximum(a, b)) & (9 * np.abs(a - b) <= a + b)
            ok &= (low[own][:, None] - high[rows][None, :] <= NEAR) & (low[rows][None, :] - high[own][:, None] <= NEAR)
            ok &= (label[own][:, None] != label[rows][None, :]) & ((label[rows] == major[rows])[None, :] | (rid[own][:, None] < rid[rows][None, :]))
            i, j = np.nonzero(ok)
            held.append((own[i], rows[j]))
            waiting += len(i)
            if waiting > 50_000:
                test()
                held, waiting = [], 0
    if held:
        test()
    return pd.concat(out) if out else pd.DataFrame({"x": np.zeros(0, np.int64), "q": np.zeros(0, np.int64), "more": np.zeros(0, bool)})


def _shared_landmarks(held: DataFrame) -> DataFrame:
    """(x, q) of the frequent landmarks (s, salts, rid): each document with the landmark's pivot. The documents of a landmark are dealt to its parts."""
    least = F.min(F.struct(F.xxhash64("rid").alias("h"), "rid")).alias("p")
    pivot = held.groupBy("s").agg(least, F.max("salts").alias("salts")).select("s", F.col("p.rid").alias("q"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    dealt = held.withColumn("salt", F.pmod(F.xxhash64("rid"), F.col("salts")).cast("int"))
    return dealt.join(pivot, ["s", "salt"]).where("rid <> q").select(F.col("rid").alias("x"), "q")


def _named(parts: DataFrame) -> DataFrame:
    return parts.unionByName(parts.select(F.col("component").alias("node"), "component").distinct())


def _unsettled(regions: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows (region, rid, lo, hi) of regions of several components, with their component (label), the region's largest (major) and its rows (size). Pivots are no rows: all their distances are known."""
    inside = regions.join(_named(parts), F.col("rid") == F.col("node"), "left").withColumn("label", F.coalesce("component", "rid")).drop("node", "component")
    inside = written(inside, "jaccard-inside")
    several = inside.groupBy("region", "label").count().groupBy("region").agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("count", "label")).alias("major"), F.sum("count").alias("size"))
    several = written(several.where("labels > 1").select("region", "major", "size"), "jaccard-several")
    return inside.join(sized(several), "region")


def _split(rows: DataFrame, points: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(regions, measured): rows of large regions dealt to the Voronoi regions of new pivots and of their own, with triangle windows; and all distances to the new pivots."""
    least = [F.min(F.struct(F.xxhash64("rid", F.lit(k)).alias("h"), "rid")).alias(f"p{k}") for k in range(PIVOTS)]
    chosen = rows.where("label <> major").groupBy("region").agg(*least)
    chosen = written(chosen.select("region", F.explode(F.array_distinct(F.array(*[f"p{k}.rid" for k in range(PIVOTS)]))).alias("q")), "jaccard-chosen")
    own = written(rows.join(sized(chosen), "region").select("region", "size", "flat", F.col("rid").alias("x"), "q", F.struct("lo", "hi", F.lit(-1).cast("long").alias("q")).alias("to_own")), "jaccard-asked")
    measured = _measure(own.where("x <> q").select("x", "q").distinct(), points, docs)
    known = own.join(measured.select("x", "q", "lo", "hi"), ["x", "q"], "left").withColumns({"lo": F.coalesce("lo", F.lit(0.0)), "hi": F.coalesce("hi", F.lit(0.0))})
    all_ = F.concat(F.collect_list(F.struct("lo", "hi", "q")), F.array(F.first("to_own")))
    each = known.groupBy("region", F.col("x").alias("rid")).agg(F.first("size").alias("parent"), all_.alias("to"), F.max(F.col("x") == F.col("q")).alias("pivot")).where("not pivot")
    nearest = F.array_min(F.transform("to", lambda t: t["hi"]))
    kept = each.withColumn("nearest", nearest).select("region", "rid", "parent", F.explode(F.filter("to", lambda t: t["lo"] <= F.col("nearest") + NEAR)).alias("t"))
    out = kept.select(F.xxhash64("region", "t.q").alias("part"), "rid", F.col("t.lo").alias("lo"), F.col("t.hi").alias("hi"), "region", "parent")
    out = written(out, "jaccard-split")
    parts = out.groupBy("region", "parent", "part").count().groupBy("region", "parent").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("work"))
    shrunk = written(parts.select("region", (2 * F.col("work") <= F.col("parent").cast("double") * F.col("parent")).alias("shrunk")), "jaccard-shrunk")
    dealt = out.join(sized(shrunk.where("shrunk").select("region")), "region", "left_semi").select(F.col("part").alias("region"), "rid", "lo", "hi", F.lit(False).alias("flat"))
    whole = rows.join(sized(shrunk.where("not shrunk").select("region")), "region", "left_semi").select("region", "rid", "lo", "hi", F.lit(True).alias("flat"))
    return written(dealt.unionByName(whole), "jaccard-regions"), measured


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = 32, region: int = REGION, row_col: str | None = None) -> DataFrame:
    """(rid, id, n_shingles, component_id, keep) of each row of docs.

    component_id is the smallest id reachable by links; null ids count as larger than all others, and stay null where no
    other is reached. keep marks one row of each component: the smallest id, and of rows that share it the first. Null and
    empty texts and texts without words have an empty set and link with nothing. Rows that share an id are rows of their own. A
    long text is read whole. Other columns of docs are not read, whatever their names. An empty table gives no rows. row_col:
    a column of distinct numbers to take as rid.
    """
    with scratch(docs.sparkSession, "jaccard-reach", "jaccard-names"):
        return _components_of(docs, id_col, text_col, rare, region, row_col)


def _components_of(docs: DataFrame, id_col: str, text_col: str, rare: int, region: int, row_col: str | None) -> DataFrame:
    """jaccard_components; the result reads the tables of reach and names only."""
    sc, bits = small_batches(docs).sparkSession.sparkContext, _bits(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rid = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), rid.alias("rid")).withColumns({"id0": F.coalesce("id", F.lit(0)), "th": F.xxhash64("text", F.col("id").isNull())})
    keys, levels = (sc.broadcast(x) for x in frequent_shingles(docs, rare, bits))
    points = docs.select("rid", "id", "id0", "th", "text").mapInArrow(lean(_sets(bits, keys, levels, rare)), SETS)
    points = written(points, "jaccard-points")

    # Equal sets are one point: the row written first.
    same = points.where("n > 0").groupBy("sig").agg(F.min("rid").alias("point"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("sig", "point")
    members = points.select("rid", "id", "n", "sig").join(sized(written(same, "jaccard-same")), "sig", "left").select("rid", "id", "n", F.coalesce("point", "rid").alias("point"))
    members = written(members, "jaccard-members")
    copies = members.where("rid <> point or n = 0").select("rid")
    points = points.join(sized(copies), "rid", "left_anti")

    # Pivots and their regions.
    rare_stars = points.select("rid", "rare").mapInArrow(lean(_deal(bits)), "bucket int, key binary, rid binary").groupBy("bucket").applyInPandas(_stars_of_bucket, "x long, q long")
    held = written(points.where(F.size("frequent") > 0).select("rid", F.explode("frequent").alias("f")).select("f.s", "f.salts", "rid"), "jaccard-held")
    stars = written(rare_stars.unionByName(_shared_landmarks(held)).distinct(), "jaccard-stars")
    measured = _measure(stars, points, docs)
    parts = components(measured.where("linked").select(F.col("x").alias("a"), F.col("q").alias("b")))
    regions = measured.select(F.col("q").alias("region"), F.col("x").alias("rid"), "lo", "hi", F.lit(False).alias("flat"))

    def merged(links: DataFrame) -> DataFrame:
        return components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links.where("linked").select(F.col("x").alias("a"), F.col("q").alias("b"))))

    # Recursion into Voronoi regions of the unsettled ones.
    final = None
    while True:
        inside = written(_unsettled(regions, parts), "jaccard-unsettled")
        done = inside.where((F.col("size") <= region) | F.col("flat")).select("region", "rid", "lo", "hi")
        final = done if final is None else final.unionByName(done)
        large = inside.where((F.col("size") > region) & ~F.col("flat"))
        if large.isEmpty():
            break
        regions, measured = _split(large, points, docs)
        parts = merged(measured)

    # Join of what is left, in rounds: pairs whose rows became one component meanwhile are never made.
    most, tested = FIRST, None
    while True:
        rows = _unsettled(final, parts).join(points.select("rid", "n", "sketch"), "rid").withColumns({"asks": F.lit(False), "chunks": F.ceil(F.col("size") / BLOCK).cast("int")})
        rows = written(rows, "jaccard-rows")
        asks = rows.where("label <> major").withColumns({"asks": F.lit(True), "chunk": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))})
        dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int")).unionByName(asks)
        groups = max(partitions(rows.sparkSession), rows.count() // GROUP_ROWS)
        dealt = dealt.withColumn("group", F.pmod(F.xxhash64("region", "chunk"), F.lit(groups)))
        cross = written(dealt.groupBy("group").applyInPandas(_block(most), "x long, q long, more boolean").groupBy("x", "q").agg(F.max("more").alias("more")), "jaccard-cross")
        new = cross.select("x", "q") if tested is None else cross.select("x", "q").join(tested, ["x", "q"], "left_anti")
        new = written(new, "jaccard-new")
        if not new.isEmpty():
            parts = merged(_measure(new, points, docs))
        if cross.where("more").isEmpty():
            break
        tested = new if tested is None else tested.unionByName(new)
        most *= RAISE

    reach = written(members.join(parts, F.col("point") == F.col("node"), "left").select("rid", "id", "n", F.coalesce("component", "point").alias("c")), "jaccard-reach")
    low = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("low")
    names = written(reach.groupBy("c").agg(low).select("c", F.col("low.id").alias("component_id"), F.col("low.rid").alias("first")), "jaccard-names")
    return reach.join(names, "c").select("rid", "id", F.col("n").cast("long").alias("n_shingles"), "component_id", (F.col("rid") == F.col("first")).alias("keep"))


def jaccard_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs."""
    return jaccard_components(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of linked documents: the smallest id, and of rows that share it the first; same columns.

    Rows with null, empty or wordless texts stay, each by itself. Extra columns may have any names. An empty table gives no rows.
    """
    with scratch(docs.sparkSession, "jaccard-docs", "jaccard-gone"):
        (row,) = fresh(docs, "row_number")
        own = written(docs.withColumn(row, F.monotonically_increasing_id()), "jaccard-docs")
        kept = jaccard_components(own.select(F.col(row).alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), row_col="rid")
        gone = written(kept.where(~F.col("keep")).select(F.col("rid").alias(row)), "jaccard-gone")
    return own.join(sized(gone), row, "left_anti").select(*docs.columns)
