"""Set-similarity joins, supersession, duplicates, the fence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.predicates import IDENTITY, MAIL
from .setjoin import jaccard_pairs as jaccard_pairs


def same_claims(existing: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of batch whose claim existing has: equal (null-safe) in all keys; mail never."""
    left = batch.where(~F.col("kind").isin(*MAIL)).alias("x")
    right = existing.select(*keys).distinct().alias("y")
    cond = None
    for k in keys:
        c = F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
        cond = c if cond is None else cond & c
    return left.join(right, cond, "left_semi")


def dedupe_claims(atoms: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each claim; all mail stays."""
    mail = F.col("kind").isin(*MAIL)
    w = W.partitionBy(*keys).orderBy(*order)
    kept = atoms.where(~mail).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return kept.unionByName(atoms.where(mail))


def retired(batch: DataFrame, atoms: DataFrame) -> DataFrame:
    """Rows of batch whose (workspace, id) a tombstone holds."""
    return batch.join(atoms.where("tombstone").select("workspace", "id"), ["workspace", "id"], "left_semi")


def shape(atoms: DataFrame) -> DataFrame:
    """atoms(id, text, entities, ...) with what replacing and linking read: tokens, head, names, gate, declared."""
    return atoms.withColumns(
        {
            "s_tokens": T.set_tokens(F.col("text")),
            "s_head": T.head_tokens(F.col("text")),
            "s_names": T.entities_of(F.col("text"), F.col("entities")),
            "s_gate": T.gate(F.col("text"), F.col("entities")),
            "s_declared": F.col("entities").isNotNull(),
        }
    )


def replaces(n: str, o: str, columns: set[str]) -> Column:
    """Whether the claim aliased n closes the one aliased o; both shaped. columns: which optional fields there are."""
    new, old = (lambda c: F.col(f"{n}.{c}")), (lambda c: F.col(f"{o}.{c}"))
    same = F.lit(True)
    for k in ("pattern", "verdict", *IDENTITY):
        if k in columns:
            same = same & new(k).eqNullSafe(old(k))
    shared = F.arrays_overlap(new("s_names"), old("s_names"))
    meets = (F.size(new("s_gate")) == 0) | (F.size(old("s_gate")) == 0) | F.arrays_overlap(new("s_gate"), old("s_gate"))
    rule = (
        F.when((new("kind") == "trust") & (new("s_gate") != old("s_gate")), False)
        .when(new("s_declared") & old("s_declared") & ~meets, False)
        .when((new("kind") == "correction") & shared, True)
        .when(meets & (T.jaccard(new("s_tokens"), old("s_tokens")) >= 0.6), True)
        .when(new("kind") == "preference", False)
        .otherwise(T.same_head(new("s_head"), old("s_head")))
    )
    named = F.coalesce(F.array_contains(new("supersedes"), old("id")), F.lit(False)) if "supersedes" in columns else F.lit(False)
    able = (new("kind") == old("kind")) & ~new("kind").isin(*MAIL) & (F.coalesce(new("text"), F.lit("")) != "") & (new("text") != old("text"))
    return able & (named | (same & rule))


def posting_terms() -> Column:
    """The terms a shape is filed under: its words, its three-word head, its names."""
    head = F.when(F.size("s_head") >= 3, F.array(F.concat(F.lit("h:"), F.array_join(F.slice("s_head", 1, 3), " ")))).otherwise(F.array().cast("array<string>"))
    return F.concat("s_tokens", head, F.transform("s_names", lambda e: F.concat(F.lit("e:"), e)))


def replacement_candidates(new: DataFrame, old: DataFrame) -> DataFrame:
    """(new_id, old_id) of shaped claims that replaces() may accept: a rare word in common (prefix filter at 0.6), the same three-word head, or a shared name."""
    n = new.select(F.col("id").alias("new_id"), "s_tokens", "s_head", "s_names")
    flat = old.select(F.col("id").alias("old_id"), F.explode("s_tokens").alias("w"))
    df = flat.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    mine = n.select("new_id", F.size("s_tokens").alias("k"), F.explode("s_tokens").alias("w")).join(df, "w", "left")
    rare = W.partitionBy("new_id").orderBy(F.coalesce("df", F.lit(0)), "w")
    mine = mine.withColumn("at", F.row_number().over(rare)).where(F.col("at") <= F.col("k") - F.ceil(F.col("k") * F.lit(0.6) - F.lit(1e-9)) + 1)
    words = mine.join(flat, "w").select("new_id", "old_id")
    head = lambda d, i: d.where(F.size("s_head") >= 3).select(F.col("id").alias(i), F.array_join(F.slice("s_head", 1, 3), " ").alias("h"))
    heads = head(new, "new_id").join(head(old, "old_id"), "h").select("new_id", "old_id")
    name = lambda d, i: d.select(F.col("id").alias(i), F.explode("s_names").alias("e"))
    names = name(new, "new_id").join(name(old, "old_id"), "e").select("new_id", "old_id")
    return words.unionByName(heads).unionByName(names).where("new_id <> old_id").distinct()


def replaced(new: DataFrame, old: DataFrame) -> DataFrame:
    """(new_id, old_id): pairs in which the new claim closes the old one."""
    pairs = replacement_candidates(new, old)
    optional = {c for c in ("pattern", "verdict", "supersedes", *IDENTITY) if c in new.columns and c in old.columns}
    own = pairs.join(new.alias("n"), F.col("new_id") == F.col("n.id")).join(old.alias("o"), F.col("old_id") == F.col("o.id"))
    return own.where(replaces("n", "o", optional)).select("new_id", "old_id")


def consolidate(atoms: DataFrame, most: int = 64, apply: bool = False, now: Column | None = None) -> DataFrame:
    """Pairs (new_id, old_id) in which a later claim closes an earlier one, greedily in order of ts; with apply, the atoms with windows closed.

    Candidates share a three-word head or a declared name (lower case); buckets of more than most claims are skipped. Pairs
    meet per connected bucket only; the greedy pass runs per workspace over the few accepted pairs, not over claims.
    """
    import pandas as pd

    own = shape(atoms)
    head = F.when(F.size("s_head") >= 3, F.array(F.concat(F.lit("h:"), F.array_join(F.slice("s_head", 1, 3), " ")))).otherwise(F.array().cast("array<string>"))
    names = F.when(F.col("s_declared"), F.transform("s_names", lambda e: F.concat(F.lit("e:"), F.lower(e)))).otherwise(F.array().cast("array<string>"))
    filed = own.select("workspace", "id", "ts", F.explode(F.array_distinct(F.concat(head, names))).alias("b"))
    small = filed.groupBy("workspace", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, most))
    filed = filed.join(small, ["workspace", "b"])
    x, y = filed.alias("x"), filed.alias("y")
    later = (F.col("x.ts") > F.col("y.ts")) | ((F.col("x.ts") == F.col("y.ts")) & (F.col("x.id") > F.col("y.id")))
    pairs = x.join(y, (F.col("x.workspace") == F.col("y.workspace")) & (F.col("x.b") == F.col("y.b")) & later).select(F.col("x.workspace").alias("workspace"), F.col("x.id").alias("new_id"), F.col("y.id").alias("old_id")).distinct()
    optional = {c for c in ("pattern", "verdict", "supersedes", *IDENTITY) if c in atoms.columns}
    hit = pairs.join(own.alias("n"), (F.col("new_id") == F.col("n.id")) & (pairs.workspace == F.col("n.workspace"))).join(own.alias("o"), (F.col("old_id") == F.col("o.id")) & (pairs.workspace == F.col("o.workspace")))
    hit = hit.where(replaces("n", "o", optional)).select(pairs.workspace, "new_id", "old_id", F.col("n.ts").alias("new_ts"))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        gone: set = set()
        out = []
        for r in pdf.sort_values(["new_ts", "new_id", "old_id"]).itertuples():
            if r.old_id not in gone and r.new_id not in gone:
                gone.add(r.old_id)
                out.append((r.workspace, r.new_id, r.old_id))
        return pd.DataFrame(out, columns=["workspace", "new_id", "old_id"])

    kind = atoms.schema["id"].dataType.simpleString()
    closed = hit.groupBy("workspace").applyInPandas(greedy, f"workspace string, new_id {kind}, old_id {kind}")
    if not apply:
        return closed
    ends = closed.select("workspace", F.col("old_id").alias("id"), F.lit(True).alias("__closed"))
    return atoms.join(ends, ["workspace", "id"], "left").withColumn("valid_to", F.when(F.col("__closed"), now).otherwise(F.col("valid_to"))).drop("__closed")


def fence(cards: DataFrame, live: DataFrame) -> DataFrame:
    """Distinct normalised paragraphs of cards(text) and texts of live(text)."""
    parts = cards.select(F.explode(T.entries(F.col("text"))).alias("p")).unionByName(live.select(F.col("text").alias("p")))
    return parts.select(T.norm_claim(F.col("p")).alias("wall")).where("wall <> ''").distinct()


def _flat(holders: DataFrame) -> DataFrame:
    """(key, h): the distinct words of holders(key, text); the texts stay behind."""
    return holders.select("key", F.explode(F.array_distinct(F.split("text", " "))).alias("h"))


def _short_words(holders: DataFrame, short: DataFrame) -> DataFrame:
    """(h, n, more): words h of the holders that hold the longest word of a short text n; more where n has other words too.

    The distinct words of the holders, not the holders, meet the short texts, on grams; hashes travel with the grams, and the words decide.
    """
    from .retrieval import hinted

    split = F.split("n", " ")
    probe = F.aggregate(split, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    asked = short.select("n", (F.size(split) > 1).alias("more"), probe.alias("p")).distinct()
    vocabulary = _flat(holders).select("h").distinct()
    keys = vocabulary.select(F.xxhash64("h").alias("hid"), F.explode(T.grams(F.col("h"))).alias("key"))
    near = keys.join(hinted(asked.select("p", T.gram_of(F.col("p")).alias("key")).distinct()), "key").select("hid", "p").distinct()
    words = vocabulary.withColumn("hid", F.xxhash64("h")).join(near, "hid").where(F.contains("h", F.col("p"))).select("h", "p").distinct()
    return words.join(asked, "p").select("h", "n", "more")


def _holding(holders: DataFrame, long: DataFrame, short: DataFrame) -> DataFrame:
    """(key, n) of holders(key, text) and the texts n they hold: long(n, k) by a whole inner word k, short(n) by its longest word; n is null where a holder holds a short text of one word."""
    at = _short_words(holders, short)
    asks = long.select(F.col("k").alias("h"), "n").unionByName(at.select("h", F.when(F.col("more"), F.col("n")).alias("n"))).distinct()
    met = _flat(holders).join(asks, "h").select("key", "n").distinct()
    return met.join(holders, "key").where(F.col("n").isNull() | F.contains("text", F.col("n"))).select("key", "n")


def unfenced(claims: DataFrame, wall: DataFrame, words: int = 3) -> DataFrame:
    """claims(id, text) that no line of the wall covers: neither holds the other. Null and empty texts go.

    If one text holds the other, every word of the held one but its two ends is a whole word of the holder; so candidates meet on the held text's
    longest whole inner word instead of by a nested loop. Texts of under three words meet the holders' distinct words on grams. Words
    travel with ids; the texts are read again for the candidates alone.
    """
    c = claims.withColumn("n", T.norm_claim(F.col("text"))).where("n <> ''")
    split = lambda x: F.split(x, " ")
    longest = lambda x: F.array_max(F.transform(x, lambda w: F.struct(F.length(w).alias("size"), w.alias("w"))))["w"]
    inner = lambda x: F.when(F.size(split(x)) >= words, longest(F.slice(split(x), 2, F.greatest(F.size(split(x)) - 2, F.lit(1)))))
    a = c.select("id", "n", inner(F.col("n")).alias("k"))
    b = wall.where("wall <> ''").distinct().select(F.xxhash64("wall").alias("key"), "wall", inner(F.col("wall")).alias("k"))
    texts, lines = a.select(F.col("id").alias("key"), F.col("n").alias("text")), b.select("key", F.col("wall").alias("text"))
    # Claims held by a line: of short ones of one word the line's words already tell.
    long_a, short_a = a.where("k is not null").select("n", "k").distinct(), a.where("k is null").select("n").distinct()
    held = _holding(lines, long_a, short_a).select("n").unionByName(_short_words(lines, short_a).where("not more").select("n")).where("n is not null").distinct()
    held = a.join(held, "n", "left_semi").select("id")
    # Claims that hold a line.
    hold = _holding(texts, b.where("k is not null").select(F.col("wall").alias("n"), "k"), b.where("k is null").select(F.col("wall").alias("n"))).select(F.col("key").alias("id"))
    covered = held.unionByName(hold).distinct()
    return claims.join(c.select("id"), "id", "left_semi").join(covered, "id", "left_anti")
