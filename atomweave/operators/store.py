"""The claim table: scans, point reads, latest-wins writes, states, exports. Partitioned by workspace, so a workspace is a pruned read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.predicates import is_due, is_live, is_live_at, shown_at

ATOM = (
    "workspace string, id string, kind string, text string, level string, origin string, content string, `set` string, source struct<basis:string,at:string>, "
    "entities array<string>, links array<string>, supersedes array<string>, warnings array<string>, ts string, updated string, valid_from string, valid_to string, due_at string, "
    "tombstone boolean, pinned boolean, hook boolean, trust double, weight double, anchor double, "
    "review struct<stability:double,difficulty:double,reps:int,recalls:int,interval_s:bigint,ease:double,last:string,neglected:int,used:int>, "
    "link_weights map<string,double>, link_weights_by map<string,map<string,double>>, embedding array<float>, `from` string, `to` string, name string, issue string, agent string, "
    "about string, choice string, pattern string, verdict string, expect string, forgotten string, retracted_by string, extra variant"
)


def scan(spark: SparkSession, path: str, workspace: str | None = None) -> DataFrame:
    """All rows, or those of one workspace (a partition filter); the empty name reads nothing."""
    df = spark.read.parquet(path)
    return df if workspace is None else df.where(F.col("workspace") == workspace) if workspace else df.limit(0)


def get(atoms: DataFrame, workspace: str, id_: str) -> DataFrame:
    return atoms.where((F.col("workspace") == workspace) & (F.col("id") == id_))


def live(atoms: DataFrame, now: Column) -> DataFrame:
    """Shown rows with links cut to those present."""
    from .graph import live_links

    shown = atoms.where(shown_at(F.col("tombstone"), F.col("valid_to"), F.col("due_at"), now))
    return live_links(shown, shown)


def current(atoms: DataFrame, now: Column, name: str | None = None) -> DataFrame:
    own = live(atoms, now)
    return own if name is None else own.where(F.col("set") == name)


def as_of(atoms: DataFrame, at: Column) -> DataFrame:
    return atoms.where(is_live_at(F.col("tombstone"), F.col("valid_from"), F.col("ts"), F.col("valid_to"), at))


def stamped(batch: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """batch as a write stores it: the stored ts stays, updated is now, a missing embedding keeps the stored one (an empty one clears it), links are an array.

    batch: has_embedding says whether the key was sent at all.
    """
    old = stored.select("workspace", "id", F.col("ts").alias("__ts"), F.col("embedding").alias("__v"))
    own = batch.join(old, ["workspace", "id"], "left")
    clear = F.col("has_embedding") & (F.col("embedding").isNull() | (F.size("embedding") == 0))
    vector = F.when(clear, None).when(F.col("has_embedding"), F.col("embedding")).otherwise(F.col("__v"))
    return own.withColumns({"ts": F.coalesce("__ts", "ts", now), "updated": now, "embedding": vector, "links": F.coalesce("links", F.array().cast("array<string>"))}).drop("__ts", "__v", "has_embedding")


def upsert(stored: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """Latest wins by (workspace, id): batch rows (the highest seq of each) over stored ones."""
    last = batch.groupBy("workspace", "id").agg(F.max_by(F.struct(*[c for c in batch.columns if c not in ("workspace", "id", seq)]), seq).alias("r")).select("workspace", "id", "r.*")
    return stored.join(last, ["workspace", "id"], "left_anti").unionByName(last, allowMissingColumns=True)


def update(stored: DataFrame, patches: DataFrame, now: Column, seq: str = "seq") -> DataFrame:
    """The stored claims that patches(workspace, id, seq, fields) change, merged and validated again, with error where they are refused.

    A field that is null in a patch stays; of several patches of a claim the highest seq counts. ts never moves, updated is now. Keys and
    stamps cannot be patched; unknown ids and tombstones change nothing. Rows without error go to upsert; refused ones leave the store as it is.
    """
    fixed = {"workspace", "id", "ts", "updated", "tombstone", seq}
    fields = [c for c in patches.columns if c in stored.columns and c not in fixed]
    last = patches.groupBy("workspace", "id").agg(F.max_by(F.struct(*fields), seq).alias("__patch"))
    own = stored.where(~F.coalesce("tombstone", F.lit(False))).join(last, ["workspace", "id"])
    own = own.withColumns({**{c: F.coalesce(F.col(f"__patch.{c}"), F.col(c)) for c in fields}, "updated": now}).drop("__patch")
    return validate(own)


def restored(atoms: DataFrame) -> DataFrame:
    """ts put back to the earliest of itself, valid_from and source_at."""
    return atoms.withColumn("ts", F.least("ts", F.col("valid_from"), F.col("source_at")))


def delete(atoms: DataFrame, workspace: str, id_: str, now: Column, why: str | None = None) -> DataFrame:
    """The current row becomes a tombstone."""
    hit = (F.col("workspace") == workspace) & (F.col("id") == id_) & ~F.coalesce("tombstone", F.lit(False))
    return atoms.withColumns({"tombstone": F.when(hit, True).otherwise(F.col("tombstone")), "updated": F.when(hit, now).otherwise(F.col("updated")), "retracted_by": F.when(hit, F.lit(why)).otherwise(F.col("retracted_by"))})


def forget(atoms: DataFrame, workspace: str) -> DataFrame:
    """Rows of a workspace go for good, its tombstones stay."""
    return atoms.where((F.col("workspace") != workspace) | F.coalesce("tombstone", F.lit(False)))


def counts(atoms: DataFrame, now: Column) -> DataFrame:
    """(workspace, kind, state, n, last_write): live, due, expired, tombstone."""
    state = F.when(F.coalesce("tombstone", F.lit(False)), "tombstone").when(is_live(F.col("tombstone"), F.col("valid_to"), now), "live").when(is_due(F.col("due_at"), now), "due").otherwise("expired")
    return atoms.groupBy("workspace", "kind", state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("updated", "ts")).alias("last_write"))


def workspaces(atoms: DataFrame, now: Column) -> DataFrame:
    """(workspace, live); global always."""
    ok = is_live(F.col("tombstone"), F.col("valid_to"), now)
    own = atoms.groupBy("workspace").agg(F.count_if(ok).alias("live"))
    base = atoms.sparkSession.sql("select 'global' as workspace, 0L as live")
    return own.unionByName(base).groupBy("workspace").agg(F.max("live").alias("live"))


def accessions(atoms: DataFrame) -> DataFrame:
    """Distinct accessions among the entities."""
    from ..functions.text import is_accession

    return atoms.select(F.explode("entities").alias("e")).select(F.trim("e").alias("accession")).where(is_accession(F.col("accession"))).distinct()


def citers(atoms: DataFrame, accession: str) -> DataFrame:
    return atoms.where(F.exists("entities", lambda e: F.trim(e) == accession))


def due_listing(atoms: DataFrame, now: Column) -> DataFrame:
    return atoms.where(is_due(F.col("due_at"), now)).orderBy("due_at", "id")


def pack(cards: DataFrame, rows: DataFrame) -> DataFrame:
    """(workspace, cards, atoms): one document a workspace, for workspaces of bounded size (the live cap)."""
    c = cards.groupBy("workspace").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "text")))).alias("cards"))
    a = rows.groupBy("workspace").agg(F.array_sort(F.collect_list(F.struct("id", "kind", "text"))).alias("atoms"))
    return a.join(c, "workspace", "full")


def latest(log: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The last record of each id in an append log."""
    w = W.partitionBy(key).orderBy(F.col(seq).desc())
    return log.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def validate(atoms: DataFrame) -> DataFrame:
    """atoms with error (the first refusal, else null), normalised set, level, origin and entities, warnings and prose."""
    from ..functions import prose, safety
    from ..functions import text as T
    from ..functions.predicates import KINDS, LEVELS, ORIGINS

    def has(name: str) -> Column:
        return F.coalesce(F.trim(F.col(name)), F.lit("")) != "" if name in atoms.columns else F.lit(False)

    def needs(kind: str, name: str, message: str) -> Column:
        return F.when((F.col("kind") == kind) & ~has(name), F.lit(message))

    col = lambda c, t="string": F.col(c) if c in atoms.columns else F.lit(None).cast(t)
    text, level, origin, own_set, entities = col("text"), col("level"), col("origin"), col("set"), col("entities", "array<string>")
    shares = F.try_parse_json(col("expect"))
    checks = [
        F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), F.concat(F.lit("unknown atom kind: "), F.coalesce("kind", F.lit("None")))),
        F.when(level.isNotNull() & ~level.isin(*LEVELS), F.concat(F.lit("unknown atom level: "), level)),
        F.when(origin.isNotNull() & (origin != "") & ~origin.isin(*ORIGINS), F.concat(F.lit("unknown atom origin: "), origin)),
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit("atom text is required")),
        F.when(F.char_length(text) > 500, F.lit("atom text exceeds soft cap 500")),
        F.when(~has("workspace"), F.lit("atom workspace is required")),
        F.when((own_set != "") & T.set_name(own_set).isNull(), F.concat(F.lit("bad set name: "), T.quoted(own_set))),
        F.try_element_at(F.array_compact(F.transform(entities, T.entity_error)), F.lit(1)),
        needs("trust", "from", "trust atom needs from"),
        needs("trust", "to", "trust atom needs to"),
        F.when((F.col("kind") == "trust") & (F.trim(col("from")) == F.trim(col("to"))), F.lit("trust atom: from and to are the same agent")),
        F.when((F.col("kind") == "trust") & ~F.coalesce((col("weight", "double") > 0) & (col("weight", "double") <= 1), F.lit(False)), F.lit("trust atom: weight must be a number in (0, 1]")),
        needs("persona", "name", "persona atom needs a name"),
        F.when((F.col("kind") == "persona") & ~F.coalesce(col("anchor", "double").between(0, 1), F.lit(False)), F.lit("persona atom: anchor must be a number in [0, 1]")),
        needs("prediction", "issue", "prediction atom needs issue"),
        needs("prediction", "agent", "prediction atom needs agent"),
        F.when((F.col("kind") == "prediction") & ~(has("expect") & (~F.startswith(F.trim(col("expect")), F.lit("{")) | F.coalesce(_fair(shares), F.lit(False)))), F.lit("prediction atom: expect is an option or an object of option to share")),
        needs("rule", "pattern", "rule atom needs a pattern"),
        F.when((F.col("kind") == "rule") & ~F.coalesce(col("verdict").isin("deny", "ask"), F.lit(False)), F.lit("rule atom: verdict is deny or ask")),
        needs("outcome", "issue", "outcome atom needs issue"),
        needs("outcome", "choice", "outcome atom needs choice"),
        needs("note", "issue", "note atom needs issue, the ticket whose logbook it copies"),
    ]
    out = atoms.withColumn("error", F.coalesce(*checks))
    return out.withColumns({
        "set": T.set_name(F.nullif(own_set, F.lit(""))), "level": F.coalesce(level, F.lit("explicit")), "origin": F.coalesce(F.nullif(origin, F.lit("")), F.lit("user-declared")),
        "entities": F.transform(entities, lambda e: F.trim(e)), "warnings": safety.content_warnings(F.coalesce(text, F.lit(""))), "prose": prose.report(text, F.col("kind")),
    })


def _fair(shares: Column) -> Column:
    """An object with at least one value, all of them numbers of 0 or more."""
    m = F.try_variant_get(shares, "$", "map<string,double>")
    return (F.size(m) > 0) & F.forall(F.map_values(m), lambda v: F.coalesce(v >= 0, F.lit(False)))
