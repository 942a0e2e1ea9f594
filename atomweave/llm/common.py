"""What the operators share: the shared folder, written tables, hashing of words and shingles."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be broadcast as ids (8 to 16 bytes each); beyond it the same join is shuffled.
BROADCAST_ROWS = 1_000_000


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a folder of our own only where that is unset on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="atomweave-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/atomweave/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Queries that run inside remove their shuffle files when they end; else the files stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: (name, path) of the tables written inside the innermost scratch().
MADE: ContextVar[list | None] = ContextVar("MADE", default=None)


@contextmanager
def scratch(spark: SparkSession, *keep: str):
    """Deletes the tables written inside when it ends, but for those named in keep, which go to the scratch() around it. What leaves it may read no others."""
    token = MADE.set([])
    try:
        yield
    finally:
        made = MADE.get()
        MADE.reset(token)
        if MADE.get() is not None:
            MADE.get().extend(x for x in made if x[0] in keep)
        for _, path in (x for x in made if x[0] not in keep):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, survives lost executors, cuts lineage. Its shuffle files go at once."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    if MADE.get() is not None:
        MADE.get().append((name, path))
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(ids: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ids (a written table or a cheap plan) has at most limit rows."""
    return ids.limit(limit + 1).count() <= limit


def sized(ids: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """ids with a broadcast hint where its row count is at most limit, else unchanged (a shuffled join)."""
    return F.broadcast(ids) if small(ids, limit) else ids


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own beside those of df: each given name behind as many underscores as it takes to be none of df's, in any case."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


#: Rows of one key that a join deals to one task, where it is salted.
SALT_ROWS = 500


def salted(left: DataFrame, right: DataFrame, key: str, by: str, keys: DataFrame | None = None, rows: int = SALT_ROWS) -> DataFrame:
    """left joined with right on key (one row a key in right): a key of more than so many rows in left has them dealt by a hash of by, and right's row goes with each part. keys: a cheaper table with left's keys."""
    hot = (left if keys is None else keys).groupBy(key).count().where(F.col("count") > rows).select(key, F.ceil(F.col("count") / rows).cast("int").alias("salts"))
    hot = sized(written(hot, "hot-keys"))
    one = F.coalesce("salts", F.lit(1))
    a = left.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(by), one).cast("int")).drop("salts")
    b = right.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("salts")
    return a.join(b, [key, "salt"]).drop("salt")


def trim() -> None:
    """Gives memory that a Python worker no longer uses back to the machine: workers outlive tasks and share an executor's limit."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run):
    """run, a function of an iterator of batches, that trims its worker when a partition ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


#: Rows of an Arrow batch of texts at most: beside the rows in Spark's own buffers, a worker holds a batch going in and one coming out.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, after lowering the session's rows per Arrow batch to BATCH_ROWS where it is higher. Results do not depend on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def text_slices(column, chars: int = 1_000_000):
    """(from, to, texts) of runs of rows of an Arrow string column of about that many bytes, nulls as empty texts; only one run is decoded at a time."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i, n = 0, len(column)
    while i < n:
        done = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + chars, "right")))
        yield i, j, [x or "" for x in column.slice(i, j - i).to_pylist()]
        i = j


MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Texts to sorted distinct 64-bit hashes of word shingles. Words are runs of anything but ASCII white space, A-Z lower-cased.

    The cache of word hashes is bounded; clearing it changes nothing but speed.
    """

    def __init__(self, words: int = 5, cache: int = 100_000):
        self.k, self.limit, self.cache = words, cache, {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        cache, get = self.cache, xxhash.xxh3_64_intdigest
        if len(cache) > self.limit:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = get(w)
        return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        w, k = self.hashes(words), self.k
        if len(w) < k:
            h = np.array([len(w)], np.uint64) + sum((w[i : i + 1] * MULT[i] for i in range(len(w))), np.zeros(1, np.uint64))
        else:
            h = sum((w[i : len(w) - k + 1 + i] * MULT[i] for i in range(k)), np.zeros(len(w) - k + 1, np.uint64))
        return np.unique(mix64(h))
