"""Registered queries: bitemporal reads, states, decay, review clock, recall, lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock, decay
from ..functions import predicates as P
from ..operators import recall as RC
from ..operators import review as RV
from ..operators import store as S
from . import views as V

QUERIES: dict = {}
ORACLES: dict = {}
A = V.ATOMS


def both(name: str, sql: str | None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
args = lambda: (F.col("tombstone"), F.col("valid_from"), F.col("ts"), F.col("valid_to"), V.now())
AT = "NOT tombstone AND valid_from <= now_ AND (valid_to IS NULL OR valid_to > now_)"


@both("scan_workspace", f"WITH {A} SELECT id, kind, text FROM atoms WHERE workspace = 'u7'")
def scan_workspace(spark, d):
    return V.atoms(spark, d).where("workspace = 'u7'").select("id", "kind", "text")


@both("get_claim", f"WITH {A} SELECT workspace, id, kind, text, CAST(trust AS DOUBLE) AS trust FROM atoms WHERE id = '0000000042'")
def get_claim(spark, d):
    a = V.atoms(spark, d)
    return a.where(F.col("id") == "0000000042").select("workspace", "id", "kind", "text", "trust")


@both("as_of", f"WITH {A} SELECT workspace, id, kind FROM atoms WHERE {AT}")
def as_of(spark, d):
    return S.as_of(V.atoms(spark, d), V.now()).select("workspace", "id", "kind")


@both("as_of_join", f"""WITH {A} SELECT o.user_id, o.event_id AS ask, a.id FROM events o JOIN atoms a ON a.user_id = o.user_id WHERE o.event_type = 'signup'
    AND NOT a.tombstone AND a.valid_from <= o.ts AND (a.valid_to IS NULL OR a.valid_to > o.ts)""")
def as_of_join(spark, d):
    """The claims in force at the instant of each question, per workspace."""
    asks = V.table(spark, d, "events").where("event_type = 'signup'").select("user_id", F.col("event_id").alias("ask"), F.col("ts").alias("at"))
    a = V.atoms(spark, d).drop("event_id")
    live = P.is_live_at(F.col("tombstone"), F.col("valid_from"), F.col("ts"), F.col("valid_to"), F.col("at"))
    return asks.join(a, "user_id").where(live).select("user_id", "ask", "id")


@both("live_now", f"WITH {A} SELECT workspace, count(*) AS n FROM atoms WHERE {V.LIVE} GROUP BY workspace")
def live_now(spark, d):
    return V.atoms(spark, d).where(P.is_live(F.col("tombstone"), F.col("valid_to"), V.now())).groupBy("workspace").agg(F.count(F.lit(1)).alias("n"))


@both("due_listing", f"WITH {A} SELECT id, epoch_us(due_at) AS due_us FROM atoms WHERE {V.DUE} AND {V.LIVE}")
def due_listing(spark, d):
    a = V.atoms(spark, d).where(P.is_live(F.col("tombstone"), F.col("valid_to"), V.now()))
    return S.due_listing(a, V.now()).select("id", us("due_at").alias("due_us"))


@both("shown_set", f"WITH {A} SELECT id, kind FROM atoms WHERE NOT tombstone AND ({V.LIVE} OR {V.DUE})")
def shown_set(spark, d):
    return V.atoms(spark, d).where(P.shown_at(F.col("tombstone"), F.col("valid_to"), F.col("due_at"), V.now())).select("id", "kind")


@both("status_counts", f"""WITH {A} SELECT workspace, kind, state, count(*) AS n, max(epoch_us(ts)) AS last_us FROM (SELECT *, CASE WHEN tombstone THEN 'tombstone' WHEN {V.LIVE} THEN 'live' WHEN {V.DUE} THEN 'due' ELSE 'expired' END AS state FROM atoms) GROUP BY ALL""")
def status_counts(spark, d):
    a = V.atoms(spark, d).withColumn("updated", F.lit(None).cast("timestamp_ntz"))
    return S.counts(a, V.now()).select("workspace", "kind", "state", "n", us("last_write").alias("last_us"))


@both("workspaces", f"WITH {A}, w AS (SELECT workspace, count(*) FILTER (WHERE {V.LIVE}) AS live FROM atoms GROUP BY workspace UNION ALL SELECT 'global', 0) SELECT workspace, max(live) AS live FROM w GROUP BY workspace")
def workspaces(spark, d):
    return S.workspaces(V.atoms(spark, d), V.now())


@both("kind_filter", f"WITH {A} SELECT id FROM atoms WHERE {V.LIVE} AND kind = 'lesson'")
def kind_filter(spark, d):
    a = V.atoms(spark, d)
    return a.where(P.serves(P.is_live(F.col("tombstone"), F.col("valid_to"), V.now()), F.col("set"), F.col("kind"), None, "lesson")).select("id")


@both("set_scope", f"WITH {A} SELECT id, kind FROM atoms WHERE {AT} AND set_ = 'set-click'")
def set_scope(spark, d):
    a = V.atoms(spark, d)
    return a.where(P.serves(P.is_live_at(*args()), F.col("set"), F.col("kind"), "set-click")).select("id", "kind")


@both("latest_versions", f"WITH {A} SELECT workspace, kind, arg_max(id, event_id) AS id FROM atoms GROUP BY workspace, kind")
def latest_versions(spark, d):
    a = V.atoms(spark, d).select("workspace", "kind", "event_id", F.col("id").alias("key"))
    return S.latest(a.withColumn("id", F.concat_ws("/", "workspace", "kind")), "id", "event_id").select("workspace", "kind", F.col("key").alias("id"))


@both("upsert", f"""WITH {A}, b AS (SELECT * FROM (SELECT workspace, kind AS id, text, event_id AS seq, row_number() OVER (PARTITION BY workspace, kind ORDER BY event_id DESC) AS n FROM atoms WHERE k < 5) WHERE n = 1),
    s AS (SELECT workspace, kind AS id, min(text) AS text FROM atoms GROUP BY ALL)
    SELECT workspace, id, text FROM b UNION ALL SELECT workspace, id, text FROM s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.workspace = s.workspace AND b.id = s.id)""")
def upsert(spark, d):
    a = V.atoms(spark, d)
    stored = a.groupBy("workspace", F.col("kind").alias("id")).agg(F.min("text").alias("text"))
    batch = a.where("k < 5").select("workspace", F.col("kind").alias("id"), "text", F.col("event_id").alias("seq"))
    return S.upsert(stored, batch)


@both("update", f"""WITH {A}, m AS (SELECT id, kind, ts, CASE WHEN k = 0 THEN '  ' WHEN k = 1 THEN 'moved: ' || text WHEN k = 2 THEN repeat('word ', 101) ELSE text END AS text FROM atoms WHERE NOT coalesce(tombstone, false))
    SELECT id, text, CAST(ts AS VARCHAR) AS ts, CASE WHEN trim(text) = '' THEN 'atom text is required' WHEN length(text) > 500 THEN 'atom text exceeds soft cap 500' WHEN kind = 'note' THEN 'note atom needs issue, the ticket whose logbook it copies' END AS error FROM m""")
def update(spark, d):
    """Two patches a claim, of which the later counts; one of a null text keeps the stored one."""
    a, k = V.atoms(spark, d), F.col("k")
    stored = a.select("workspace", "id", "kind", "text", "tombstone", F.col("ts").cast("string").alias("ts"), F.lit(None).cast("string").alias("updated"))
    text = F.when(k == 0, "  ").when(k == 1, F.concat(F.lit("moved: "), "text")).when(k == 2, F.repeat(F.lit("word "), 101))
    early = a.select("workspace", "id", F.lit(1).alias("seq"), F.lit("first try").alias("text"))
    later = a.select("workspace", "id", F.lit(2).alias("seq"), text.alias("text"))
    return S.update(stored, early.unionByName(later), F.lit("2026-01-01T00:00:00.000Z")).select("id", "text", "ts", "error")


@both("forget_workspace", f"WITH {A} SELECT workspace, count(*) AS n FROM atoms WHERE workspace <> 'u3' OR tombstone GROUP BY workspace")
def forget_workspace(spark, d):
    return S.forget(V.atoms(spark, d), "u3").groupBy("workspace").agg(F.count(F.lit(1)).alias("n"))


@both("retired_ids", f"WITH {A} SELECT id FROM atoms WHERE tombstone AND k = 9")
def retired_ids(spark, d):
    from ..operators.sets import retired

    a = V.atoms(spark, d)
    return retired(a.select("workspace", "id", "kind"), a).select("id")


@both("origin_trust", f"""WITH {A} SELECT origin, content, count(*) AS n, round(sum(CASE WHEN content = 'authoritative' THEN least(trust, CASE origin WHEN 'tool-echo' THEN 0.2 WHEN 'external' THEN 0.4 ELSE 9.0 END) ELSE trust END), 6) AS trust,
    max(CASE WHEN origin = 'user-declared' THEN 2 ELSE 1 END) AS rank FROM atoms GROUP BY ALL""")
def origin_trust(spark, d):
    a = V.atoms(spark, d)
    t = P.rank_trust(F.col("trust"), F.col("content"), F.col("origin"))
    return a.groupBy("origin", "content").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(t), 6).alias("trust"), F.max(P.origin_rank(F.col("origin"))).alias("rank"))


AGE = V.DAYS.format("ts")


@both("recency", f"WITH {A} SELECT id, round(pow(0.5, {AGE} / 14.0), 6) AS recency FROM atoms")
def recency(spark, d):
    a = V.atoms(spark, d)
    return a.select("id", F.round(decay.recency(clock.days_between(F.col("ts"), V.now())), 6).alias("recency"))


@both("half_life", f"WITH {A} SELECT id, round(CASE WHEN kind = 'goal' THEN 1.0 ELSE exp(-ln(2) / 14.0 * {AGE}) END, 6) AS w FROM atoms")
def half_life(spark, d):
    a = V.atoms(spark, d)
    source = F.when(F.col("kind") == "goal", "evergreen").otherwise("atom")
    return a.select("id", F.round(decay.weight("on", source, clock.days_between(F.col("ts"), V.now()), F.col("stability")), 6).alias("w"))


@both("fsrs_retrievability", f"WITH {A} SELECT id, round(pow(1.0 + 19.0 / 81.0 * {AGE} / stability, -0.5), 6) AS r FROM atoms")
def fsrs(spark, d):
    a = V.atoms(spark, d)
    return a.select("id", F.round(decay.retrievability(clock.days_between(F.col("ts"), V.now()), F.col("stability")), 6).alias("r"))


@both("decay_weight", f"WITH {A} SELECT id, round(CASE WHEN kind = 'note' THEN 1.0 ELSE greatest(0.25, pow(1.0 + 19.0 / 81.0 * {AGE} / stability, -0.5)) END, 6) AS w FROM atoms")
def decay_weight(spark, d):
    a = V.atoms(spark, d)
    return a.select("id", F.round(decay.weight("fsrs", F.when(F.col("kind") == "note", "user").otherwise("memory"), clock.days_between(F.col("ts"), V.now()), F.col("stability")), 6).alias("w"))


@both("stamps", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(((epoch_us(ts) // 1000) % 1000) AS VARCHAR), 3, '0') || 'Z' AS stamp, epoch_us(ts) // 1000 AS ms,
    strftime(ts + INTERVAL 90 SECOND, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(((epoch_us(ts) // 1000) % 1000) AS VARCHAR), 3, '0') || 'Z' AS later FROM events""")
def stamps(spark, d):
    raw = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    e = V.table(spark, d, "events").select("event_id", clock.canonicalize(raw).alias("stamp"))
    return e.select("event_id", "stamp", clock.parse_millis(F.col("stamp")).alias("ms"), clock.shift(F.col("stamp"), 90).alias("later"))


def _grade(grade: str, sql: dict[str, str]):
    cols = ("stability", "difficulty", "interval_s")
    q = f"WITH {A}, g AS (SELECT id, stability AS s, least(difficulty, 10.0) AS d0, {AGE} AS t FROM atoms), h AS (SELECT id, {sql['d']} AS d, s, t FROM g), x AS (SELECT id, d, {sql['s']} AS s FROM h) SELECT id, round(s, 6) AS stability, round(d, 6) AS difficulty, {sql['i']} AS interval_s FROM x"

    def run(spark, d):
        a = V.atoms(spark, d)
        out = RV.scheduled(grade, F.col("stability"), F.least("difficulty", F.lit(10.0)), F.lit(1), F.col("recalls"), clock.days_between(F.col("ts"), V.now()))
        return a.select("id", *[(F.round(out[c], 6) if c != "interval_s" else out[c]).alias(c) for c in cols])

    QUERIES[f"schedule_{grade}"], ORACLES[f"schedule_{grade}"] = run, q


SPAN = "CAST(floor(greatest(s, 1.0) * 86400) AS BIGINT)"
_grade("initial", {"d": "d0", "s": "s", "i": "86400::BIGINT"})
_grade("lapsed", {"d": "least(greatest(d0 + 0.2, 1.0), 10.0)", "s": "greatest(s / 2, 0.1)", "i": SPAN})
_grade("recalled", {"d": "least(greatest(d0 - 0.15, 1.0), 10.0)", "s": "s * (1 + exp(1 - d / 10) * (1 - least(greatest(pow(0.9, t / s), 0.01), 0.99)))", "i": SPAN})


@both("sweep", f"""WITH {A}, m AS (SELECT *, NOT tombstone AND {V.DUE} AND {V.DAYS.format('due_at')} > 2 * greatest(stability, 1.0) AS missed FROM atoms),
    x AS (SELECT *, CASE WHEN missed AND neglected + 1 >= 3 AND recalls = 0 AND used = 0 AND kind IN ('lesson', 'note', 'correction') AND NOT pinned THEN 'forgotten' WHEN missed THEN 'lapsed' ELSE 'kept' END AS action FROM m)
    SELECT id, action, CASE WHEN action = 'kept' THEN neglected ELSE neglected + 1 END AS neglected, round(CASE WHEN action = 'lapsed' THEN greatest(stability / 2, 0.1) ELSE stability END, 6) AS new_stability FROM x""")
def sweep(spark, d):
    a = V.atoms(spark, d).withColumn("interval_s", (F.col("stability") * 86_400).cast("long"))
    return RV.sweep(a, V.now()).select("id", "action", "neglected", F.round("new_stability", 6).alias("new_stability"))


@both("enforce_cap", f"""WITH {A}, s AS (SELECT * FROM atoms WHERE NOT tombstone AND ({V.LIVE} OR {V.DUE})), o AS (SELECT workspace, count(*) - 40 AS over_ FROM s GROUP BY workspace HAVING count(*) > 40),
    r AS (SELECT s.workspace, id, over_, row_number() OVER (PARTITION BY s.workspace ORDER BY round(pow(1.0 + 19.0 / 81.0 * {AGE} / stability, -0.5), 9), ts, id) AS n FROM s JOIN o ON s.workspace = o.workspace WHERE kind IN ('lesson', 'note', 'correction') AND NOT pinned)
    SELECT workspace, id FROM r WHERE n <= over_""")
def enforce_cap(spark, d):
    a = V.atoms(spark, d).where(P.shown_at(F.col("tombstone"), F.col("valid_to"), F.col("due_at"), V.now()))
    return RV.over_cap(a.withColumn("last", F.col("ts")), V.now(), 40)


@both("provenance_floor", f"""WITH {A}, p AS (SELECT workspace, id, origin, lag(origin) OVER (PARTITION BY user_id ORDER BY event_id) AS o FROM atoms), r AS (SELECT *, CASE origin WHEN 'user-declared' THEN 2 ELSE 1 END AS a, CASE o WHEN 'user-declared' THEN 2 ELSE 1 END AS b FROM p)
    SELECT id, CASE WHEN o IS NULL OR a <= b THEN origin ELSE o END AS floor_origin, CASE WHEN o IS NOT NULL AND a > b THEN 'provenance rises above what was stored' END AS warning FROM r""")
def provenance_floor(spark, d):
    """Each claim against the user's claim before it, as if it had been stored under its id."""
    from pyspark.sql import Window as W

    a = V.atoms(spark, d).withColumn("was", F.lag("origin").over(W.partitionBy("user_id").orderBy("event_id")))
    new = a.select("workspace", "id", "origin", F.lit("").alias("basis"))
    old = a.where("was is not null").select("workspace", "id", F.col("was").alias("origin"), F.lit("").alias("basis"))
    return RV.provenance(new, old).select("id", "floor_origin", "warning")


@both("review_replay", None)
def review_replay(spark, d):
    e = V.table(spark, d, "events").where("event_type in ('click', 'error')")
    grades = e.select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "click", "recalled").otherwise("lapsed").alias("grade"))
    return RV.replay(grades).select("id", F.round("stability", 6).alias("stability"), F.round("difficulty", 6).alias("difficulty"), "reps", "recalls")


@both("hold_proposals", f"WITH {A} SELECT id, CASE WHEN content = 'authoritative' AND origin IN ('tool-echo', 'external') THEN origin ELSE 'standing' END AS horizon FROM atoms WHERE pinned OR origin = 'agent-derived'")
def hold_proposals(spark, d):
    a = V.atoms(spark, d)
    return a.where(P.needs_accept(F.col("origin"), F.col("pinned"), True)).select("id", P.horizon(F.col("origin"), F.col("content")).alias("horizon"))


SHOWN = f"s AS (SELECT *, {V.DUE} AS due, round(pow(1.0 + 19.0 / 81.0 * {AGE} / stability, -0.5), 9) AS r FROM atoms WHERE NOT tombstone AND ({V.LIVE} OR {V.DUE}))"
ORDER = "due DESC, coalesce(trust, 0) DESC, r DESC, ts DESC, id"


def _shown(spark, d):
    a = V.atoms(spark, d).where(P.shown_at(F.col("tombstone"), F.col("valid_to"), F.col("due_at"), V.now()))
    return a.withColumns({"due": P.is_due(F.col("due_at"), V.now()), "retrievability": decay.retrievability(clock.days_between(F.col("ts"), V.now()), F.col("stability")), "links": F.array().cast("array<string>")})


@both("recall_whole", f"""WITH {A}, {SHOWN}, z AS (SELECT workspace, count(*) AS n FROM s GROUP BY workspace) SELECT s.workspace, id, row_number() OVER (PARTITION BY s.workspace ORDER BY {ORDER}) AS place FROM s JOIN z ON s.workspace = z.workspace WHERE n <= 64""")
def recall_whole(spark, d):
    """Workspaces that fit the cap come whole, in order."""
    return RC.recall(_shown(spark, d)).where("part = 0").select("workspace", "id", "place")


@both("recall_due", f"""WITH {A}, {SHOWN}, z AS (SELECT workspace, count(*) AS n FROM s GROUP BY workspace) SELECT workspace, id, place FROM (SELECT s.workspace, id, n, row_number() OVER (PARTITION BY s.workspace ORDER BY {ORDER}) AS place FROM s JOIN z ON s.workspace = z.workspace WHERE due AND n > 10) WHERE place <= 10""")
def recall_due(spark, d):
    """Over the cap, without a cue: due claims up to the cap."""
    return RC.recall(_shown(spark, d), limit=10).where("part = 1").select("workspace", "id", "place")


@both("recall_cue", f"""WITH {A}, {SHOWN}, z AS (SELECT workspace, count(*) AS n FROM s GROUP BY workspace), m AS (SELECT s.*, n FROM s JOIN z ON s.workspace = z.workspace WHERE n > 8 AND list_contains(entities, 'k4')),
    u AS (SELECT workspace, id, due, trust, r, ts, 1 AS part FROM (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY {ORDER}) AS c FROM m WHERE due) WHERE c <= 2 UNION ALL SELECT workspace, id, due, trust, r, ts, 3 FROM m),
    o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workspace, id ORDER BY part) AS c FROM u) WHERE c = 1)
    SELECT workspace, id, place FROM (SELECT workspace, id, row_number() OVER (PARTITION BY workspace ORDER BY part, {ORDER}) AS place FROM o) WHERE place <= 8""")
def recall_cue(spark, d):
    return RC.recall(_shown(spark, d), hints=["k4"], limit=8).where("part > 0").select("workspace", "id", "place")


@both("text_budget", """WITH s AS (SELECT doc_id, source, n_chars, sum(length(coalesce(text, ''))) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) SELECT source, doc_id FROM s WHERE t <= 32000 OR n = 1""")
def text_budget(spark, d):
    docs = V.table(spark, d, "documents").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return RC.budgeted(docs, [F.col("doc_id")], key="source").select("source", "doc_id")


@both("front_due", f"""WITH {A}, d AS (SELECT workspace AS qid, id AS key, row_number() OVER (PARTITION BY workspace ORDER BY due_at, id) AS dpos FROM atoms WHERE {V.DUE} AND NOT tombstone), r AS (SELECT workspace AS qid, id AS key, row_number() OVER (PARTITION BY workspace ORDER BY trust DESC, id) AS rpos FROM atoms WHERE k >= 5),
    b AS (SELECT coalesce(d.qid, r.qid) AS qid, coalesce(d.key, r.key) AS key, dpos, rpos FROM d FULL JOIN r ON d.qid = r.qid AND d.key = r.key), t AS (SELECT *, CASE WHEN dpos IS NOT NULL AND dpos <= 4 THEN 0 WHEN rpos IS NOT NULL THEN 1 ELSE 2 END AS tier FROM b),
    n AS (SELECT qid, key, tier, row_number() OVER (PARTITION BY qid ORDER BY tier, CASE WHEN tier = 1 THEN rpos ELSE dpos END, key) AS pos FROM t) SELECT qid, key, tier, pos FROM n WHERE pos <= 8""")
def front_due(spark, d):
    from pyspark.sql import Window as W

    a = V.atoms(spark, d)
    due = a.where(P.is_due(F.col("due_at"), V.now()) & ~F.col("tombstone")).select(F.col("workspace").alias("qid"), F.col("id").alias("key"), F.row_number().over(W.partitionBy("workspace").orderBy("due_at", "id")).alias("pos"))
    ranked = a.where("k >= 5").select(F.col("workspace").alias("qid"), F.col("id").alias("key"), F.row_number().over(W.partitionBy("workspace").orderBy(F.col("trust").desc(), "id")).alias("pos"))
    return RC.front_due(due, ranked, 8)


@both("limits", "SELECT event_id, CASE WHEN k = 0 THEN 64 ELSE least(greatest(k * 20 - 40, 0), 64) END AS cap, greatest(CASE WHEN k = 0 THEN 64 ELSE least(greatest(k * 20 - 40, 0), 64) END // 4, 1) AS due_share FROM (SELECT event_id, CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS INTEGER) AS k FROM events)")
def limits(spark, d):
    k = F.regexp_extract("props", "(-?[0-9]+)", 1).cast("int")
    cap = RC.cap_limit(F.when(k != 0, k * 20 - 40))
    return V.table(spark, d, "events").select("event_id", cap.alias("cap"), RC.due_share(cap).alias("due_share"))


@both("matches_hints", f"WITH {A} SELECT id FROM atoms WHERE list_contains(entities, 'k2') OR 2 * (CAST(contains(lower(text || ' ' || array_to_string(entities, ' ')), 'click') AS INT) + CAST(contains(lower(text || ' ' || array_to_string(entities, ' ')), 'purchase') AS INT) + CAST(contains(lower(text || ' ' || array_to_string(entities, ' ')), 'level 7') AS INT)) >= 3")
def hints(spark, d):
    return V.atoms(spark, d).where(RC.matches_hints(["k2"], ["click", "purchase", "level 7"])).select("id")


@both("accessions", "WITH e AS (SELECT unnest(['deed-run-' || k, ' sha256:' || event_type || ' ', 'deed-', 'deed-a,b', event_type]) AS e FROM (SELECT event_type, CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS INTEGER) AS k FROM events)) SELECT DISTINCT trim(e) AS accession FROM e WHERE regexp_matches(trim(e), '^(deed-|sha256:)[^,\\s]+$')")
def accessions(spark, d):
    k = F.regexp_extract("props", "(-?[0-9]+)", 1)
    e = V.table(spark, d, "events").select(F.array(F.concat(F.lit("deed-run-"), k), F.concat(F.lit(" sha256:"), F.col("event_type"), F.lit(" ")), F.lit("deed-"), F.lit("deed-a,b"), F.col("event_type")).alias("entities"))
    return S.accessions(e)


@both("citers", f"WITH {A} SELECT id FROM atoms WHERE list_contains(entities, 'k7')")
def citers(spark, d):
    return S.citers(V.atoms(spark, d), "k7").select("id")
