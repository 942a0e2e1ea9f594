"""Claims and protocol records in JSON lines; cards and proposal logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import safety
from ..functions import text as T


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; competency is the file's stem unless the record names one."""
    df = spark.read.schema(schema).json(path)
    stem = F.regexp_extract(F.input_file_name(), "([^/]+?)\\.jsonl?$", 1)
    return df.withColumn("competency", F.coalesce("competency", stem) if "competency" in df.columns else stem)


def read_atoms(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Claims by schema; the whole line is kept as a variant in extra, so that unknown fields survive."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    own = lines.select(F.from_json("value", schema).alias("a"), F.try_parse_json("value").alias("extra"))
    return own.select("a.*", "extra")


def export_atoms(atoms: DataFrame, path: str) -> None:
    """Live rows, a folder of lines for each workspace file name."""
    atoms.withColumn("file", T.export_file_name(F.col("workspace"))).write.mode("overwrite").partitionBy("file").json(path)


def append_proposals(log: DataFrame, path: str) -> None:
    log.write.mode("append").json(path)


def open_proposals(log: DataFrame) -> DataFrame:
    """Proposals whose last record is open; log: (id, seq, state, ...)."""
    from ..operators.store import latest

    return latest(log).where("state = 'open'")


def proposals(archive: DataFrame, wall: DataFrame) -> DataFrame:
    """Claims mined from archive(day, text): the first sentence of each paragraph that no fence covers, with a verdict; repeated ones once."""
    from ..functions.prose import first_sentence
    from ..operators.sets import unfenced

    parts = archive.select("day", "text", F.posexplode(T.entries(F.col("text"))).alias("n", "part"))
    own = parts.where(~safety.is_tool_dump(F.col("part"))).select("day", "n", F.col("text").alias("transcript"), first_sentence(F.col("part")).alias("text")).where("text is not null")
    own = own.withColumn("id", T.short_digest(T.norm_claim(F.col("text")))).dropDuplicates(["id"])
    return unfenced(own, wall).withColumn("verdict", T.fidelity(F.col("text"), F.col("transcript"))).drop("transcript")


def card_warnings(cards: DataFrame, cap: int = 2200) -> DataFrame:
    """cards(workspace, field, text) with size, over (past its cap: seat cards 1375, workspace cards cap) and warnings."""
    most = F.when(F.col("field") == "user", 1375).otherwise(cap)
    return cards.withColumns({"size": F.char_length("text"), "over": F.char_length("text") > most, "warnings": safety.content_warnings(F.col("text"))})


def add_entry(text, entry):
    """The card with the paragraph at its end unless it has it."""
    own = T.entries(text)
    return F.when(F.array_contains(own, entry), text).otherwise(F.array_join(F.array_append(own, entry), "\n\n"))


def replace_entry(text, old, new):
    """The card with exactly one paragraph replaced; unchanged where it has none or several."""
    own = T.entries(text)
    return F.when(F.size(F.filter(own, lambda p: p == old)) == 1, F.array_join(F.transform(own, lambda p: F.when(p == old, new).otherwise(p)), "\n\n")).otherwise(text)


def remove_entry(text, old):
    own = T.entries(text)
    return F.when(F.size(F.filter(own, lambda p: p == old)) == 1, F.array_join(F.filter(own, lambda p: p != old), "\n\n")).otherwise(text)


def attach_source(spark: SparkSession, path: str, cap: int = 32_768) -> DataFrame:
    """Whole files, cut at cap characters (a feature of the attach slot)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.substring("value", 1, cap).alias("text"))


def keep_units(records: DataFrame) -> DataFrame:
    """The protocol over records(record, source, context): each unit as written, and once more with 'Remember: ' where it was refused.

    (record, n, unit, status, kind, claim); status: admitted, reoffered, refused.
    """
    own = records.select("record", F.posexplode(T.units(F.col("source"), F.col("context"))).alias("n", "unit"))
    line = F.regexp_replace(F.trim(F.col("unit")), "\\s+", " ")
    first, second = safety.admit(F.col("unit")), safety.admit(F.concat(F.lit("Remember: "), line))
    own = own.withColumns({"a": first, "b": second})
    return own.select("record", "n", "unit", F.when(F.col("a").isNotNull(), "admitted").when(F.col("b").isNotNull(), "reoffered").otherwise("refused").alias("status"), F.coalesce("a.kind", "b.kind").alias("kind"), F.coalesce("a.claim", "b.claim").alias("claim"))
