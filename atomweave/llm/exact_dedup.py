"""Exact deduplication with keyed streaming state.

The documents are staged once, each row with a stable identifier (the run's number and its row number in the staged table), its
digest and its text. A Structured Streaming aggregation keyed by digest reads the narrow columns; its state lives in RocksDB,
has no watermark and so never expires, and holds per digest the best identifier, the locator of the retained content (the
staged row that came first) and a count. Partial aggregation before the shuffle collapses a hot digest to one row a task.
Every hit (a row whose digest is retained by another row) is then compared with the retained content byte for byte; rows of a
digest with a mismatch are grouped by their texts instead.

The state, its checkpoint and the staged rows lie in one folder. A later run over new documents with the same folder continues
the stream: its rows are found equal to those of earlier runs, whose contents it reads only where digests hit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, sized, written

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CONF = {
    "spark.sql.streaming.stateStore.providerClass": PROVIDER,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # a loaded instance preallocates 4 MB of local disk
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
STAGED = "run int, rid long, id long, digest binary, text string"
STATE = "digest binary, best struct<id:bigint,nrun:int,neg:bigint>, locator struct<run:int,rid:bigint>, n bigint, batch int"


def _read(spark, path: str, schema: str) -> DataFrame:
    """The Parquet table at path, an empty one where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _best():
    return F.max(F.struct("id", (-F.col("run")).alias("nrun"), (-F.col("rid")).alias("neg"))).alias("best")


def _state(spark, folder: str, files_per_batch: int) -> DataFrame:
    """Runs the stream over what was staged since it last ran; the state of each digest it met: (digest, best, locator, n)."""
    batches: list[int] = []
    before = {k: spark.conf.get(k, None) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(STAGED).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/staged")
        state = rows.groupBy("digest").agg(_best(), F.min(F.struct("run", "rid")).alias("locator"), F.count(F.lit(1)).alias("n"))

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/state/batch={number}")  # a batch that is run again overwrites its own folder
            batches.append(number)

        query = state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    found = _read(spark, f"{folder}/state", STATE).where(F.col("batch") >= min(batches, default=0))
    return found.groupBy("digest").agg(F.max_by(F.struct("best", "locator", "n"), "n").alias("s")).select("digest", "s.*")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256, files_per_batch: int = 1000, state_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(staged documents, decisions).

    staged: rid, id, digest, text and rest, a struct of the other columns, whatever their names. decisions: one row per
    input row: rid, id, keep_id, n, kept, seen, digest. Null texts count as empty. Of equal texts the row with the largest
    id stays; of rows that share that id too, the one staged first; null ids come last. A long text is hashed and compared
    whole. An empty table gives no rows. digest_bits below 256 is for tests of the byte check.

    state_path: a folder that driver and executors share, where the state of earlier runs lies or will lie; without it the
    state is new and serves this run alone. keep_id and n count the rows of all runs, kept is whether the row is the one of
    all runs that stays, seen whether an earlier run held an equal text. Runs of one folder come one after another; rows
    that a failed run staged belong to the next one.
    """
    spark = docs.sparkSession
    folder = state_path.rstrip("/") if state_path else shared_path(spark, "dedup")
    run = 0
    if state_path:
        run = _read(spark, f"{folder}/runs", "run int").agg(F.coalesce(F.max("run") + 1, F.lit(0))).first()[0]
        spark.range(1).select(F.lit(run).alias("run")).write.mode("append").parquet(f"{folder}/runs")
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256), 1, digest_bits // 4))
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    new = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), digest.alias("digest"), F.col(text_col).cast("string").alias("text"), rest.alias("rest"))
    new.write.parquet(f"{folder}/staged/run={run}")
    new = spark.read.schema(new.schema).parquet(f"{folder}/staged/run={run}")
    held = _read(spark, f"{folder}/staged", STAGED)  # of all runs
    state = written(_state(spark, folder, files_per_batch), "dedup-last")  # a table, so that a hot digest's rows can be split in the join
    members = written(new.select("rid", "id", "digest").join(state, "digest").select("rid", "id", "digest", "best", "locator", "n"), "dedup-members")

    hits = members.where((F.col("locator.run") < run) | (F.col("rid") != F.col("locator.rid"))).select("rid", F.col("locator.run").alias("lrun"), F.col("locator.rid").alias("lrid"))
    kept = sized(hits.select("lrun", "lrid").distinct())
    kept_texts = held.select(F.col("run").alias("lrun"), F.col("rid").alias("lrid"), text.alias("b")).join(kept, ["lrun", "lrid"])
    wrong = new.select("rid", text.alias("a")).join(sized(hits), "rid").join(kept_texts, ["lrun", "lrid"]).where(F.col("a").cast("binary") != F.col("b").cast("binary")).select("rid")
    wrong = written(wrong, "dedup-wrong")
    cols = ["rid", "id", "best", "n", "digest", "seen"]
    members = members.withColumn("seen", F.col("locator.run") < run)
    if wrong.isEmpty():
        final = members.select(cols)
    else:
        bad = members.join(wrong, "rid", "left_semi").select("digest").distinct()
        rows = held.select("run", "rid", "id", "digest", text.alias("a")).join(bad, "digest", "left_semi")
        again = rows.groupBy("digest", "a").agg(_best(), F.count(F.lit(1)).alias("n"), (F.min("run") < run).alias("seen"))
        final = members.join(bad, "digest", "left_anti").select(cols).unionByName(rows.where(F.col("run") == run).join(again, ["digest", "a"]).select(cols))
    stays = (F.col("best.nrun") == -run) & (F.col("best.neg") == -F.col("rid"))
    return new, final.select("rid", "id", F.col("best.id").alias("keep_id"), "n", stays.alias("kept"), "seen", "digest")


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs."""
    _, d = exact_dedup(docs)
    return d.select(F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state_path: str | None = None) -> DataFrame:
    """docs without the rows that exact_dedup drops; same columns, of any names. With state_path also without texts that earlier runs held: there one copy stayed already."""
    staged, d = exact_dedup(docs, id_col, text_col, state_path=state_path)
    if state_path:  # of this run alone: a text of an earlier run goes, of the others the largest id stays
        gone = d.where(F.col("seen") | ~F.col("kept")).select("rid")
    else:
        gone = d.where(~F.col("kept")).select("rid")
    out = staged.join(sized(written(gone, "dedup-dropped")), "rid", "left_anti")
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`") for c in docs.columns])
