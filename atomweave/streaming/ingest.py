"""Streams of claims: latest-wins ingestion, hold windows, batched projection, sweeps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def hold_window(stream: DataFrame, key: list[str], time: str = "ts", hold_seconds: float = 3600) -> DataFrame:
    """(key, time) of the events that pass: the first of each key, then the first at least the hold after the last that passed.

    The last instant that passed is the state of a key. Inside a batch events go in order of time; one that comes in a later
    batch than a newer one of its key is held back if it is not at least the hold after it. Null times do not pass. Of an
    event's columns only the key and its time are kept, eight bytes each for the batch's events of a key.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    names = [f.name for f in stream.select(*key, time).schema.fields]
    hold = int(hold_seconds * 1_000_000)

    def run(own, frames, state):
        at = np.sort(np.concatenate([f["at"].to_numpy(np.int64) for f in frames]))
        last = state.get[0] if state.exists else None
        out = []
        k = 0 if last is None else int(np.searchsorted(at, last + hold))
        while k < len(at):
            last = int(at[k])
            out.append(last)
            k = int(np.searchsorted(at, last + hold))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({**{n: [v] * len(out) for n, v in zip(names, own, strict=False)}, "at": out})

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    fields = ", ".join(f"`{k}` {kinds[k]}" for k in key)
    rows = stream.where(F.col(time).isNotNull()).select(*key, F.unix_micros(time).alias("at"))
    held = rows.groupBy(*key).applyInPandasWithState(run, f"{fields}, at long", "last long", "append", GroupStateTimeout.NoTimeout)
    return held.select(*key, F.timestamp_micros("at").alias(time))


def batched(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "3 seconds") -> StreamingQuery:
    """foreachBatch every so often; every None: all there is, then an end."""
    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def ingest(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends validated claims as versions (a folder a batch, overwritten when a batch runs again); latest() reads the table.

    Refused rows go to path/refused with their error.
    """
    from ..operators.store import validate

    def run(batch: DataFrame, number: int) -> None:
        own = validate(batch).withColumn("version", F.lit(number)).persist()
        own.where("error is null").drop("error").write.mode("overwrite").parquet(f"{path}/atoms/version={number}")
        own.where("error is not null").select("workspace", "id", "error").write.mode("overwrite").parquet(f"{path}/refused/version={number}")
        own.unpersist()

    return batched(stream, run, checkpoint, every)


def latest(versions: DataFrame, keys: tuple[str, ...] = ("workspace", "id")) -> DataFrame:
    """The last version of each claim."""
    cols = [c for c in versions.columns if c not in keys]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct("version", "seq") if "seq" in cols else F.col("version")).alias("r")).select(*keys, "r.*")


def windowed_counts(stream: DataFrame, by: list[str], time: str = "ts", size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by key and tumbling window, with a watermark for late ones."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count(F.lit(1)).alias("n"))
