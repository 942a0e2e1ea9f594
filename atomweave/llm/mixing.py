"""Mixing sources to target weights by hierarchical budgeting.

The leaves of the tree are (domain, language, source). Target weights propagate from the root: each node splits its budget
among its children by their weights. A child that cannot use its share (its documents times the epochs allowed hold fewer
tokens) takes what it can, and its siblings share the rest by weight; only what all siblings together cannot use goes back
up, to be shared among the parent's siblings. Each leaf then takes the token-prefix of its seeded epochs: epoch e orders the
leaf's documents by a hash of (seed, e, id, text), and documents are taken while the tokens before them are fewer than the
budget.

Statistics cover all rows: token counts are summed per leaf and per leading digit of the hashes of an epoch's order, then per
next digit inside the one where the prefix ends, so only rows that share 24 leading bits are ordered. No leaf meets in one
task. Budgets are windows over siblings, so the tree may have any number of leaves; none of it comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import sized, written

#: Shifts that leave the first 8, 16 and 24 bits of a hash: the digits by which the end of a prefix is found.
LEVELS = (56, 48, 40)
LEAF = ["domain", "lang", "source"]


def share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes (parent columns, weight, holds, budget of the parent) with got: the budget split by weight; what a node cannot hold goes to its siblings.

    By the ratio of what a node holds to its weight, those filled come first: a node is filled if what is left after the nodes
    before it, dealt by weight to it and those after it, is at least what it holds.
    """
    open_ = (F.col("weight") > 0) & (F.col("holds") > 0)
    ordered = W.partitionBy(*parent, "open").orderBy(F.try_divide("holds", "weight"), *[c for c in LEAF if c in nodes.columns and c not in parent])
    n = nodes.withColumn("open", open_)
    before = F.coalesce(F.sum("holds").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rate = F.try_divide(F.col("budget") - before, F.sum("weight").over(ordered.rowsBetween(0, W.unboundedFollowing)))
    n = n.withColumn("rate", F.when(F.col("open"), rate)).withColumn("full", F.col("holds") <= F.col("rate") * F.col("weight"))
    first = F.first(F.when(~F.col("full"), F.col("rate")), ignorenulls=True).over(ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    got = F.when(~F.col("open"), 0.0).when(F.col("full"), F.col("holds")).otherwise(F.greatest(first, F.lit(0.0)) * F.col("weight"))
    return n.withColumn("got", got).drop("open", "rate", "full")


def budgets(leaves: DataFrame, weights: dict[tuple, float], total: float) -> DataFrame:
    """leaves (LEAF columns, tokens, holds) with their budget. weights: by any path prefix, 1 where absent; total: tokens wanted."""
    import pyarrow as pa

    spark, held = leaves.sparkSession, leaves
    for k in range(1, 4):
        own = [(*path, float(w)) for path, w in weights.items() if len(path) == k]
        names = LEAF[:k]
        # By way of Arrow: rows of Python would start a second set of Python workers on every executor.
        columns = [pa.array([r[i] for r in own], pa.string() if i < k else pa.float64()) for i in range(k + 1)]
        table = spark.createDataFrame(pa.table(columns, names=[*names, f"w{k}"]))
        held = held.join(F.broadcast(table), names, "left").withColumn(f"w{k}", F.coalesce(f"w{k}", F.lit(1.0)))  # as many rows as weights given
    usable = F.col("holds")
    for k in (3, 2, 1):
        held = held.withColumn(f"u{k}", usable)  # what of the leaf counts for its node at depth k
        usable = F.when(F.col(f"w{k}") > 0, usable).otherwise(0.0)
    held = written(held.withColumn("u0", usable), "mix-leaves")
    root = held.agg(F.coalesce(F.least(F.lit(float(total)), F.sum("u0")), F.lit(0.0)).alias("budget"))
    upper, keys = root, []
    for k in range(1, 4):
        names = LEAF[:k]
        nodes = held.groupBy(*names).agg(F.sum(f"u{k}").alias("holds"), F.first(f"w{k}").alias("weight"))
        nodes = nodes.join(sized(upper), keys) if keys else nodes.crossJoin(F.broadcast(root))  # the root is one row
        upper, keys = written(share(nodes, keys).select(*names, F.col("got").alias("budget")), "mix-budgets"), names
    return leaves.join(sized(upper), LEAF)


def _leaf_columns(docs: DataFrame, domain, lang_col: str, source_col: str) -> list:
    domain = domain if domain is not None else F.when(F.col(source_col).rlike("[02468]$"), "even").otherwise("odd")
    return [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(LEAF, (domain, F.col(lang_col), F.col(source_col)), strict=True)]


def _text(text_col: str):
    return F.coalesce(F.col(text_col), F.lit(""))


def _prefixes(narrow: DataFrame, weights: dict[tuple, float], fraction: float, epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Of narrow (LEAF columns, id, th, n_tokens): (LEAF, whole, rest, budget) of each leaf, and (LEAF, stop) where an epoch is taken in part."""
    sizes = narrow.groupBy(*LEAF).agg(F.sum("n_tokens").cast("double").alias("tokens")).withColumn("holds", F.col("tokens") * epochs)
    sizes = written(sizes, "mix-sizes")
    total = fraction * (sizes.agg(F.sum("tokens")).first()[0] or 0.0)
    whole = F.when(F.col("tokens") > 0, F.floor(F.try_divide("budget", "tokens"))).otherwise(0).cast("int")
    leaf = budgets(sizes, weights, total).withColumn("whole", whole)
    leaf = written(leaf.select(*LEAF, "whole", (F.col("budget") - F.col("whole") * F.col("tokens")).alias("rest"), "budget"), "mix-plan")

    placed = narrow.join(sized(leaf.where("rest > 0").select(*LEAF, "whole", "rest")), LEAF).withColumn("h", _order(seed))
    before = W.partitionBy(*LEAF).orderBy("p").rowsBetween(W.unboundedPreceding, -1)

    def running(sums: DataFrame) -> DataFrame:
        return sums.withColumn("before", F.col("from") + F.coalesce(F.sum("t").over(before), F.lit(0)))

    edge = None
    for bits in LEVELS:
        here = placed.withColumn("from", F.lit(0)) if edge is None else placed.join(edge, LEAF).where(F.shiftright("h", bits + 8) == F.col("p")).drop("p")
        sums = here.groupBy(*LEAF, "rest", "from", F.shiftright("h", bits).alias("p")).agg(F.sum("n_tokens").alias("t"))  # at most 256 rows a leaf
        edge = sized(written(running(sums).where("before < rest and before + t >= rest").select(*LEAF, "p", F.col("before").alias("from")), "mix-edges"))
    last = placed.join(edge, LEAF).where(F.shiftright("h", LEVELS[-1]) == F.col("p")).drop("p")
    last = running(last.groupBy(*LEAF, "rest", "from", F.col("h").alias("p")).agg(F.sum("n_tokens").alias("t")))
    return leaf, written(last.where("before < rest").groupBy(*LEAF).agg(F.max("p").alias("stop")), "mix-stops")


def _order(seed: int):
    return F.xxhash64(F.lit(seed), F.col("whole"), F.col("id"), F.col("th"))


def _taken(rows: DataFrame, leaf: DataFrame, stop: DataFrame, seed: int) -> DataFrame:
    out = rows.join(sized(leaf), LEAF).join(sized(stop), LEAF, "left")
    return out.withColumn("copies", F.col("whole") + F.coalesce(_order(seed) <= F.col("stop"), F.lit(False)).cast("int"))


def _narrow(docs: DataFrame, domain, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    tokens = F.regexp_count(_text(text_col), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    rows = docs.select(*_leaf_columns(docs, domain, lang_col, source_col), F.col(id_col).alias("id"), F.xxhash64(_text(text_col)).alias("th"), tokens.alias("n_tokens"), F.col(lang_col).alias("own_lang"), F.col(source_col).alias("own_source"))
    return written(rows, "mix-tokens")


def mix(docs: DataFrame, weights: dict[tuple, float] | None = None, fraction: float = 0.8, epochs: int = 4, seed: int = 17, domain=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, domain, lang, source, n_tokens, copies, budget): every row of docs with the number of epochs that take it, and its leaf's budget.

    fraction: tokens wanted, of those there are. weights: by (domain,), (domain, lang) or (domain, lang, source); 1 where
    absent. domain: a column of docs' leaf columns; by default the source's last digit even or odd. Tokens are runs of
    anything but ASCII white space, counted over whole texts. Null languages, sources or domains are leaves named ''. Rows
    without tokens cost nothing and go with the epochs that their leaf's budget enters. Equal rows (id and text) are taken
    together, null ids are told apart by their texts. Other columns are not read, whatever their names. Empty tables give no rows.
    """
    narrow = _narrow(docs, domain, id_col, text_col, lang_col, source_col)
    out = _taken(narrow, *_prefixes(narrow, weights or {}, fraction, epochs, seed), seed)
    return out.select("id", "domain", F.col("own_lang").alias("lang"), F.col("own_source").alias("source"), "n_tokens", "copies", "budget")


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, copies of each row of docs."""
    return mix(docs, **how).select(F.col("id").alias("doc_id"), "domain", "lang", "source", "n_tokens", "copies")


def mixed(docs: DataFrame, weights: dict[tuple, float] | None = None, fraction: float = 0.8, epochs: int = 4, seed: int = 17, domain=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """docs as the mixture: each row as often as its epochs take it; same columns, of any names. See mix."""
    narrow = _narrow(docs, domain, id_col, text_col, lang_col, source_col)
    leaf, stop = _prefixes(narrow, weights or {}, fraction, epochs, seed)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, *_leaf_columns(docs, domain, lang_col, source_col), F.col(id_col).alias("id"), F.xxhash64(_text(text_col)).alias("th"))
    out = _taken(rows, leaf, stop, seed).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns])
