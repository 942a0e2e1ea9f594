"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of WORDS words that together hold its whole text. Each passage is encoded by a small network
over the identity of its words (signed hashing into BUCKETS shares) and form features of them; gated attention weighs the
encodings, and the weighted sum is scored by a logistic unit. Only document labels are known; the attention weights are
learned from them.

Training runs on the driver over a bounded sample of labelled documents: sample_rows ids, those with the smallest hashes, one
row each, and of those the texts of at most sample_passages passages. Their passage features are computed on the executors
and cost the driver at most 4 (len(NAMES) + BUCKETS) bytes a passage. Scoring reads every document whole and once, without a
shuffle.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, lean, small_batches, text_slices

WORDS = 48
NAMES = ("symbols", "doubled marks", "capitals", "repeats of the word before", "repeats in the passage", "no letters", "length", "digits", "short words", "ends of clauses", "beyond ASCII", "size")
#: Signed shares of hashed words beside the form features; and all features of a passage.
BUCKETS = 64
WIDTH = len(NAMES) + BUCKETS
PLAIN = frozenset(".,;:!?'\"()-")


def _word(w: str) -> bytes:
    """What a passage sums of a word: eight marks, its length of 30 at most in the fifth place, and last its bucket and sign."""
    core = w.strip(".,;:!?'\"()-")
    odd = not core.isalnum() and any(not c.isalnum() and c not in PLAIN for c in w)
    return bytes((odd, len(w) > 2 and w[-1] == w[-2] and not w[-1].isalnum(), len(core) > 1 and core.isupper(), not core or not any(c.isalpha() for c in core), min(len(w), 30), not core.isalpha() and any(c.isdigit() for c in core), len(core) < 4, w[-1] in ".,", not w.isascii(), zlib.crc32((core or w).lower().encode("utf-8", "surrogatepass")) >> 24))


class PassageFeatures:
    """Texts to (features of all passages, passages of each text). The cache of word features is bounded; clearing it changes nothing but speed."""

    def __init__(self, cache: int = 100_000):
        self.limit, self.ids, self.rows, self.same = cache, {}, [], {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.ids) > self.limit:
            self.ids, self.rows = {}, []
        words = [t.split() for t in texts]
        new = set().union(*words).difference(self.ids)
        at = len(self.rows)
        for w in new:
            self.ids[w] = at
            row = _word(w)
            self.rows.append(self.same.setdefault(row, row))
            at += 1
        sizes = np.array([len(w) for w in words])
        bags = np.maximum(1, -(-sizes // WORDS))
        out = np.zeros((bags.sum(), WIDTH), np.float32)
        total = int(sizes.sum())
        if total:
            get = self.ids.__getitem__
            ids = np.fromiter((i for w in words for i in map(get, w)), np.int64, total)
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)
            place = np.arange(total) - first
            passage = np.repeat(np.cumsum(bags) - bags, sizes) + place // WORDS
            begin = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
            used = passage[begin]
            n = np.diff(np.r_[begin, total]).astype(np.float32)
            seen, back = np.unique(ids, return_inverse=True)
            table = np.frombuffer(b"".join([self.rows[i] for i in seen.tolist()]), np.uint8).reshape(len(seen), -1).astype(np.float32)
            table[:, 4] /= 10
            code = table[:, 9].astype(np.int64)
            table, bucket, sign = table[:, :9], code % BUCKETS, np.where(code // BUCKETS % 2, -1.0, 1.0)
            sums = np.add.reduceat(table[back], begin, axis=0)
            shares = np.bincount(passage * BUCKETS + bucket[back], sign[back], len(out) * BUCKETS).reshape(-1, BUCKETS)
            same = np.r_[False, (ids[1:] == ids[:-1]) & (place[1:] > 0)].astype(np.float32)
            pairs = np.unique(passage * np.int64(len(seen)) + back) // len(seen)
            distinct = np.bincount(pairs, minlength=len(out))[used]
            out[used, :3] = sums[:, :3]
            out[used, 3] = np.add.reduceat(same, begin)
            out[used, 4] = n - distinct
            out[used, 5:11] = sums[:, 3:9]
            out[used, :11] /= n[:, None]
            out[used, 11] = np.log1p(n) / 4
            out[used, 12:] = shares[used] / n[:, None]
        return out, bags


class Attention:
    """Passage encoder, gated attention and logistic score over flat passages; starts: the first passage of each bag."""

    SHAPES = (("w", "k d"), ("b", "d"), ("v", "d a"), ("u", "d a"), ("g", "a"), ("c", "d"), ("c0", ""))

    def __init__(self, k: int, d: int = 16, a: int = 8, seed: int = 5):
        rng, n = np.random.default_rng(seed), {"k": k, "d": d, "a": a}
        self.mean, self.scale = np.zeros(k), np.ones(k)
        self.p = {name: rng.standard_normal([n[x] for x in dims.split()]) * (0.3 if name not in ("b", "c0") else 0.0) for name, dims in self.SHAPES}

    def forward(self, x: np.ndarray, sizes: np.ndarray):
        p = self.p
        starts = np.cumsum(sizes) - sizes
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * s) @ p["g"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        att = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(att[:, None] * h, starts, axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["c0"], -30, 30)))
        return score, (x, h, t, s, att, z, starts)

    def score(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self.forward(x.astype(float), sizes)[0]

    def gradients(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float) -> tuple[float, dict[str, np.ndarray]]:
        """The weighted cross entropy with its penalty, and its gradients."""
        p = self.p
        score, (xs, h, t, s, att, z, starts) = self.forward(x, sizes)
        dl = (score - y) * weight
        g = {"c": z.T @ dl, "c0": dl.sum()}
        dz = np.repeat(dl, sizes)[:, None] * p["c"]
        da = (dz * h).sum(1)
        de = att * (da - np.repeat(np.add.reduceat(att * da, starts), sizes))
        dts = de[:, None] * p["g"]
        g["g"] = (t * s).T @ de
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        g["v"], g["u"] = h.T @ dt, h.T @ ds
        dh = (att[:, None] * dz + dt @ p["v"].T + ds @ p["u"].T) * (1 - h * h)
        g["w"], g["b"] = xs.T @ dh, dh.sum(0)
        held = np.clip(score, 1e-12, 1 - 1e-12)
        loss = -(weight * (y * np.log(held) + (1 - y) * np.log(1 - held))).sum() + l2 / 2 * sum((v * v).sum() for v in p.values())
        return float(loss), {k: g[k] + l2 * v for k, v in p.items()}

    def fit(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.02, l2: float = 1e-4, gain: float = 1e-2) -> Attention:
        """Adam over all bags at once; both classes weigh the same. Stops where twenty rounds lower the loss by less than that share."""
        x = x.astype(float)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        pos = max(y.mean(), 1e-6)
        weight = np.where(y > 0, 0.5 / pos, 0.5 / max(1 - pos, 1e-6)) / len(y)
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        losses: list[float] = []
        for step in range(1, rounds + 1):
            loss, grads = self.gradients(x, sizes, y, weight, l2)
            losses.append(loss)
            if step > 40 and losses[-21] - loss < gain * losses[-21]:
                break
            for k, v in self.p.items():
                m[k][0] = 0.9 * m[k][0] + 0.1 * grads[k]
                m[k][1] = 0.999 * m[k][1] + 0.001 * grads[k] * grads[k]
                self.p[k] = v - rate * (m[k][0] / (1 - 0.9**step)) / (np.sqrt(m[k][1] / (1 - 0.999**step)) + 1e-8)
        return self


def bucket(id_col) -> F.Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 4000, sample_passages: int = 100) -> Attention | None:
    """A model of label_col from labelled rows whose bucket is not 1; None where they hold no text or a single class.

    Ids with several labels take the smallest label, ids with several rows in docs the least text. At most sample_rows
    labelled ids are read, those with the smallest hashes, and of those the texts of at most sample_passages passages. Null
    ids and labels teach nothing; null texts count as empty.
    """
    import pyarrow as pa

    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").where(bucket("id") != 1)
    own = own.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)

    def run(batches):
        make = PassageFeatures()
        for b in batches:
            for i, j, texts in text_slices(b.column(1)):
                x, sizes = make(texts)
                parts = np.split(x, np.cumsum(sizes)[:-1])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array([v.tobytes() for v in parts], pa.binary())], ["id", "y", "x"])

    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(own), "id")  # at most sample_rows rows
    rows = rows.where(F.regexp_count("text", F.lit(r"\S+")) <= sample_passages * WORDS)
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    got = sorted(rows.select("id", "text", "y").mapInArrow(lean(run), "id long, y int, x binary").collect())
    if len({r.y for r in got}) < 2:
        return None
    x = [np.frombuffer(r.x, np.float32).reshape(-1, WIDTH) for r in got]
    return Attention(WIDTH).fit(np.concatenate(x), np.array([len(v) for v in x]), np.array([float(r.y) for r in got]))


def score(docs: DataFrame, model: Attention | None, text_col: str = "text", at_least: float | None = None, score_col: str = "quality_score") -> DataFrame:
    """docs with score_col (0 to 1), a name that docs must not hold; 0.5 everywhere without a model.

    Null and empty texts are one passage without words; a long text is scored by all its passages. Repeated rows get equal
    scores. An empty table gives no rows. at_least: rows of a lower score are left out.
    """
    import pyarrow as pa

    if fresh(docs, score_col) != [score_col]:
        raise ValueError(f"docs has a column {score_col} already")
    if model is None:
        out = docs.withColumn(score_col, F.lit(0.5))
        return out if at_least is None or at_least <= 0.5 else out.where(F.lit(False))
    at = docs.columns.index(text_col)

    def run(batches):
        make = PassageFeatures()
        for b in batches:
            for i, j, texts in text_slices(b.column(at)):
                got = model.score(*make(texts))
                own = pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, pa.array(got, pa.float64())], [*b.schema.names, score_col])
                yield own if at_least is None else own.filter(pa.array(got >= at_least))

    return small_batches(docs).mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def quality_report(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs: see score and train for nulls, long texts, repeated rows and empty tables. Rows with a null id are not held out."""
    r = score(docs.select("doc_id", "text"), train(docs, labels, sample_rows=sample_rows))
    return r.select("doc_id", F.coalesce(bucket("doc_id") == 1, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is at least threshold; same columns, of any names. Without a model all rows stay, where threshold is at most 0.5."""
    return score(docs, train(docs, labels), at_least=threshold, score_col=fresh(docs, "quality_score")[0]).select(*docs.columns)
