"""The driver's tables as what the engine works on: claims, corpora, ballots, graphs; each as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

NOW = "2024-01-20 12:00:00"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def now() -> Column:
    return F.to_timestamp_ntz(F.lit(NOW))


def atoms(spark: SparkSession, d: str) -> DataFrame:
    """Events as claims: one workspace a user, kinds by event type, windows to the next event of the kind."""
    e = table(spark, d, "events")
    k = F.regexp_extract("props", "(-?[0-9]+)", 1).cast("int")
    w = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    kind = F.when(F.col("event_type") == "click", "lesson").when(F.col("event_type") == "view", "note").when(F.col("event_type") == "purchase", "preference").when(F.col("event_type") == "signup", "goal").otherwise("correction")
    e = e.withColumn("k", k)
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("workspace"), F.lpad(F.col("event_id").cast("string"), 10, "0").alias("id"), kind.alias("kind"),
        F.concat(F.lit("Event "), F.col("event_type"), F.lit(" of level "), F.col("k").cast("string")).alias("text"),
        "ts", F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"), (F.col("ts") + F.expr("make_interval(0, 0, 0, 1 + k % 5)")).alias("due_at"),
        (F.col("k") == 9).alias("tombstone"), (F.col("k") == 8).alias("pinned"), F.least(F.col("value") / 500, F.lit(1.0)).alias("trust"),
        F.when(F.col("k") < 3, "user-declared").when(F.col("k") < 6, "agent-derived").when(F.col("k") < 8, "tool-echo").otherwise("external").alias("origin"),
        F.when(F.col("k") % 2 == 0, "authoritative").alias("content"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("set-"), F.col("event_type"))).alias("set"),
        F.array(F.col("event_type"), F.concat(F.lit("k"), F.col("k").cast("string"))).alias("entities"), (1 + F.col("k") % 7).cast("double").alias("stability"), (2.0 + F.col("k") * 0.7).alias("difficulty"),
        (F.col("k") % 4).alias("neglected"), (F.col("k") % 3).alias("recalls"), (F.col("k") % 2).alias("used"), "k", "event_id", "user_id",
    )


ATOMS = f"""atoms AS (
    SELECT 'u' || user_id AS workspace, lpad(CAST(event_id AS VARCHAR), 10, '0') AS id,
        CASE event_type WHEN 'click' THEN 'lesson' WHEN 'view' THEN 'note' WHEN 'purchase' THEN 'preference' WHEN 'signup' THEN 'goal' ELSE 'correction' END AS kind,
        'Event ' || event_type || ' of level ' || k AS text, ts, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS valid_to,
        ts + to_days(CAST(1 + k % 5 AS INTEGER)) AS due_at, k = 9 AS tombstone, k = 8 AS pinned, least(value / 500, 1.0) AS trust,
        CASE WHEN k < 3 THEN 'user-declared' WHEN k < 6 THEN 'agent-derived' WHEN k < 8 THEN 'tool-echo' ELSE 'external' END AS origin,
        CASE WHEN k % 2 = 0 THEN 'authoritative' END AS content, CASE WHEN k % 3 = 0 THEN 'set-' || event_type END AS set_,
        [event_type, 'k' || k] AS entities, CAST(1 + k % 7 AS DOUBLE) AS stability, 2.0 + k * CAST(0.7 AS DOUBLE) AS difficulty,
        k % 4 AS neglected, k % 3 AS recalls, k % 2 AS used, k, event_id, user_id, TIMESTAMP '{NOW}' AS now_
    FROM (SELECT *, CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS INTEGER) AS k FROM events))"""
LIVE = "(NOT tombstone AND (valid_to IS NULL OR valid_to > now_))"
DUE = "coalesce(due_at <= now_, false)"
DAYS = "greatest((epoch_us(now_) - epoch_us({0})) / 86400000000.0, 0.0)"


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.tokens(F.coalesce("text", F.lit(""))).alias("tokens"), "text", "source")


def asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), T.tokens(F.coalesce("text", F.lit(""))).alias("tokens"), "text")


STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def words_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(translate(coalesce({text}, ''), '{T.UPPER}', '{T.LOWER}'), '[a-z0-9][a-z0-9_-]*'), lambda w: w NOT IN ({STOP}))"


INDEX = f"""d AS (SELECT doc_id AS id, {words_sql('text')} AS t FROM documents), q AS (SELECT item_id AS qid, {words_sql('text')} AS t FROM benchmark),
    st AS (SELECT count(*) AS n, sum(len(t)) AS total, sum(len(t)) / CAST(count(*) AS DOUBLE) AS av FROM d),
    p AS (SELECT id, len, term, CAST(count(*) AS DOUBLE) AS c FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM d) GROUP BY ALL),
    tm AS (SELECT term, count(*) AS df, sum(c) AS cf FROM p GROUP BY term),
    qt AS (SELECT qid, term, CAST(count(*) AS DOUBLE) AS w FROM (SELECT qid, unnest(t) AS term FROM q) GROUP BY ALL)"""
IDF = "ln(1 + (st.n - tm.df + 0.5) / (tm.df + 0.5))"
NORM = "(0.75 * p.len / st.av + 0.25)"
TERM = {
    "bm25": f"{IDF} * (p.c * 2.2 / (p.c + 1.2 * {NORM}))",
    "bm25+": f"{IDF} * (p.c * 2.2 / (p.c + 1.2 * {NORM}) + 1)",
    "dirichlet": "ln(1 + p.c / (2000.0 * (tm.cf / st.total))) + ln(2000.0 / (p.len + 2000.0))",
}


def lexical_sql(scorer: str, k: int, digits: int = 6) -> str:
    return f"""WITH {INDEX}, s AS (
        SELECT qid, id, round(sum(qt.w * ({TERM[scorer]})), {digits}) AS score FROM p JOIN tm USING (term) JOIN qt USING (term) CROSS JOIN st GROUP BY qid, id)
        SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= {k}"""


def supplier_ballots(spark: SparkSession, d: str) -> DataFrame:
    """Three ballots of a nation's suppliers: by revenue, by quantity, by number of orders."""
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("qid"))
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("r"), F.round(F.sum("l_quantity"), 2).alias("u"), F.count_distinct("l_orderkey").cast("double").alias("o"))
    own = li.join(s, "s_suppkey")
    flat = own.select("qid", F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("key"), F.posexplode(F.array("r", "u", "o")).alias("ballot", "score"))
    # the first ballot names everyone, the others their upper part, so that ballots differ in whom they name
    w = W.partitionBy("qid", "ballot").orderBy(F.col("score").desc(), "key")
    n = F.count(F.lit(1)).over(W.partitionBy("qid", "ballot"))
    flat = flat.withColumns({"pos": F.row_number().over(w) - 1, "n": n}).where((F.col("ballot") == 0) | (F.col("pos") * 4 < F.col("n") * 3))
    return flat.select("qid", "ballot", "pos", "key", "score")


BALLOTS = """li AS (SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS r, round(sum(l_quantity), 2) AS u, CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS o FROM lineitem GROUP BY l_suppkey),
    fl AS (SELECT s_nationkey AS qid, lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS key, 0 AS ballot, r AS score FROM li JOIN supplier ON s_suppkey = l_suppkey
        UNION ALL SELECT s_nationkey, lpad(CAST(s_suppkey AS VARCHAR), 8, '0'), 1, u FROM li JOIN supplier ON s_suppkey = l_suppkey
        UNION ALL SELECT s_nationkey, lpad(CAST(s_suppkey AS VARCHAR), 8, '0'), 2, o FROM li JOIN supplier ON s_suppkey = l_suppkey),
    bl AS (SELECT qid, ballot, pos, key, score FROM (SELECT *, row_number() OVER (PARTITION BY qid, ballot ORDER BY score DESC, key) - 1 AS pos, count(*) OVER (PARTITION BY qid, ballot) AS n FROM fl) WHERE ballot = 0 OR pos * 4 < n * 3),
    seen AS (SELECT qid, key, min(ballot * 1000000 + pos) AS seen FROM bl GROUP BY qid, key)"""


def links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of parts bought together: a part and the two parts by number next above it in its orders; weights from counts."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.lpad(F.col("l_partkey").cast("string"), 8, "0").alias("p")).distinct()
    w = W.partitionBy("o").orderBy("p")
    one = li.withColumn("q", F.lead("p").over(w)).where("q is not null").groupBy("p", "q").agg((F.count(F.lit(1)) / 4.0).alias("w"))
    both = one.select("p", "q", "w").unionByName(one.select(F.col("q").alias("p"), F.col("p").alias("q"), "w"))
    e = both.select(F.lit("all").alias("workspace"), F.col("p").alias("src"), F.col("q").alias("dst"), F.least("w", F.lit(1.0)).alias("w"))
    e = e.groupBy("workspace", "src", "dst").agg(F.max("w").alias("w"))
    nodes = table(spark, d, "part").select(F.lit("all").alias("workspace"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("id"))
    return nodes, e


def bought(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, pairs) of parts bought together, by number: any two parts of one order, once, the smaller as src; weights from counts. Orders' rows without an order, or without a part of the table, name no pair."""
    nodes = table(spark, d, "part").where("p_partkey is not null").select(F.col("p_partkey").alias("id")).distinct()
    li = table(spark, d, "lineitem").where("l_orderkey is not null").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("id")).join(nodes, "id", "left_semi")
    li = li.repartition("o").distinct()  # dealt once, for the rows of an order and for the join
    a, b = li.select("o", F.col("id").alias("src")), li.select("o", F.col("id").alias("dst"))
    pairs = a.join(b, "o").where("src < dst").groupBy("src", "dst").agg(F.least(F.count(F.lit(1)) / 4.0, F.lit(1.0)).alias("w"))
    return nodes.select(F.lit("all").alias("workspace"), "id"), pairs.select(F.lit("all").alias("workspace"), "src", "dst", "w")


LINKS = """li AS (SELECT DISTINCT l_orderkey AS o, lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS p FROM lineitem),
    one AS (SELECT p, q, count(*) / 4.0 AS w FROM (SELECT p, lead(p) OVER (PARTITION BY o ORDER BY p) AS q FROM li) WHERE q IS NOT NULL GROUP BY p, q),
    e AS (SELECT src, dst, max(least(w, 1.0)) AS w FROM (SELECT p AS src, q AS dst, w FROM one UNION ALL SELECT q, p, w FROM one) GROUP BY src, dst),
    nd AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS id FROM part)"""
