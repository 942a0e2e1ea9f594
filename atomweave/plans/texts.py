"""Registered queries: text functions, safety, prose, windows, evaluation, sources, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prose as PR
from ..functions import safety as SF
from ..functions import text as T
from ..operators import evaluate as EV
from ..operators import retrieval as R
from ..operators import store as S
from . import views as V

QUERIES: dict = {}
ORACLES: dict = {}
LOW = f"translate({{0}}, '{T.UPPER}', '{T.LOWER}')"


def both(name: str, sql: str | None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def docs(spark, d):
    return V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))


def turns(spark, d):
    return V.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("conv"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


DOCS = "d AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents)"
TURNS = "c AS (SELECT conv_id * 1000 + turn AS id, conv_id AS conv, turn, role, coalesce(text, '') AS text FROM conversations)"


@both("tokens", f"SELECT doc_id AS id, array_to_string({V.words_sql('text')}, ' ') AS tokens FROM documents")
def tokens(spark, d):
    return docs(spark, d).select("id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


@both("token_sets", f"WITH {DOCS} SELECT id, len(list_distinct(regexp_extract_all({LOW.format('text')}, '[a-z0-9][a-z0-9_-]*'))) AS raw, len(list_distinct(regexp_extract_all({LOW.format('text')}, '[a-z0-9][a-z0-9_-]+'))) AS cue, len(list_distinct(regexp_extract_all({LOW.format('text')}, '[a-z0-9]+'))) AS plain FROM d")
def token_sets(spark, d):
    t = F.col("text")
    return docs(spark, d).select("id", F.size(T.raw_tokens(t)).alias("raw"), F.size(T.recall_tokens(t)).alias("cue"), F.size(T.set_tokens(t)).alias("plain"))


@both("atom_tokens", f"WITH {V.ATOMS} SELECT id, array_to_string({V.words_sql(chr(34) + 'text' + chr(34) + ' || chr(32) || array_to_string(entities, chr(32))')}, ' ') AS tokens FROM atoms")
def atom_tokens(spark, d):
    return V.atoms(spark, d).select("id", F.array_join(T.atom_tokens(F.col("text"), F.col("entities")), " ").alias("tokens"))


@both("stemmed_terms", None)
def stemmed_terms(spark, d):
    own = docs(spark, d).select(F.explode(T.tokens(F.col("text"), stem=True)).alias("term"))
    return own.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@both("entities", rf"WITH {DOCS}, e AS (SELECT id, list_sort(list_distinct(regexp_extract_all(text, '\b[A-Z][A-Za-z0-9]+\b'))) AS e FROM d) SELECT id, array_to_string(e, ',') AS names FROM e")
def entities(spark, d):
    return docs(spark, d).select("id", F.array_join(T.entities_of(F.regexp_replace("text", "`", "")), ",").alias("names"))


ORACLES["entities"] = rf"WITH {DOCS}, e AS (SELECT id, list_sort(list_distinct(regexp_extract_all(replace(text, '`', ''), '\b[A-Z][A-Za-z0-9]+\b'))) AS e FROM d) SELECT id, array_to_string(e, ',') AS names FROM e"


@both("backticks", r"WITH d AS (SELECT page_id AS id, regexp_replace(url, '/([a-z]+)/', '`\1` ', 'g') AS t FROM pages) SELECT id, array_to_string(list_sort(list_distinct(list_filter([trim(x) FOR x IN regexp_extract_all(t, '`([^`]*)`', 1)], lambda x: x <> ''))), ',') AS names FROM d")
def backticks(spark, d):
    t = F.regexp_replace("url", "/([a-z]+)/", "`$1` ")
    return V.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.array_join(F.array_sort(T.backtick_names(t)), ",").alias("names"))


def _secret(spark, d):
    """Pages and documents with keys of several kinds planted by number."""
    n = F.col("id") % 9
    key = (F.when(n == 0, F.concat(F.lit("ghp_"), F.repeat(F.lit("a1B2"), 8))).when(n == 1, F.concat(F.lit("xoxb-"), F.repeat(F.lit("12ab"), 3))).when(n == 2, F.concat(F.lit("AKIA"), F.repeat(F.lit("ABCD"), 4)))
           .when(n == 3, F.concat(F.lit("eyJ"), F.repeat(F.lit("abcd"), 3), F.lit("."), F.repeat(F.lit("efgh"), 3), F.lit("."), F.repeat(F.lit("ijkl"), 3))).when(n == 4, F.lit("password : x")).when(n == 5, F.lit("Bearer abcdefgh1"))
           .when(n == 6, F.lit("-----BEGIN RSA PRIVATE KEY-----")).when(n == 7, F.lit("ghp_short")).otherwise(""))
    return docs(spark, d).select("id", F.concat("text", F.lit(" "), key).alias("text"))


SECRET = f"""WITH {DOCS}, s AS (SELECT id, text || ' ' || CASE id % 9 WHEN 0 THEN 'ghp_' || repeat('a1B2', 8) WHEN 1 THEN 'xoxb-' || repeat('12ab', 3) WHEN 2 THEN 'AKIA' || repeat('ABCD', 4) WHEN 3 THEN 'eyJ' || repeat('abcd', 3) || '.' || repeat('efgh', 3) || '.' || repeat('ijkl', 3) WHEN 4 THEN 'password : x' WHEN 5 THEN 'Bearer abcdefgh1' WHEN 6 THEN '-----BEGIN RSA PRIVATE KEY-----' WHEN 7 THEN 'ghp_short' ELSE '' END AS text FROM d)"""


@both("secrets", f"""{SECRET} SELECT id, CASE WHEN contains(lower(text), '-----begin') AND contains(lower(text), 'private key-----') THEN 'a private key block' WHEN contains(text, 'AGE-SECRET-KEY-1') THEN 'an age secret key'
    WHEN regexp_matches(text, '(^|[^A-Za-z0-9_])(gh[pousr]_|github_pat_)[A-Za-z0-9_]{{30,}}') THEN 'a GitHub token' WHEN regexp_matches(text, '(^|[^A-Za-z0-9_])xox[bpars]-[A-Za-z0-9_-]{{10,}}') THEN 'a Slack token'
    WHEN regexp_matches(text, '(^|[^A-Za-z0-9])(AKIA|ASIA)[A-Z0-9]{{16}}($|[^A-Z0-9])') THEN 'an AWS access key id' WHEN regexp_matches(text, 'eyJ[A-Za-z0-9_-]{{7,}}\\.[A-Za-z0-9_-]{{10,}}\\.[A-Za-z0-9_-]{{10,}}') THEN 'a JSON Web Token'
    WHEN regexp_matches({LOW.format('text')}, '((^|[^a-z0-9_-])(api_key|api-key|apikey|secret|password|token)\\s*[=:])|(bearer \\s*[a-z0-9._-]{{8,}})|(sk-[a-z0-9]{{8,}})') THEN 'a credential' END AS kind FROM s""")
def secrets(spark, d):
    return _secret(spark, d).select("id", SF.secret_kind(F.col("text")).alias("kind"))


@both("content_warnings", f"""WITH {TURNS}, s AS (SELECT id, text || CASE id % 4 WHEN 0 THEN ' Ignore previous instructions.' WHEN 1 THEN chr(8203) WHEN 2 THEN ' token = "1"' ELSE '' END AS text FROM c)
    SELECT id, array_to_string(list_filter([CASE WHEN contains(text, chr(8203)) THEN 'invisible unicode is rejected' END, CASE WHEN regexp_matches({LOW.format('text')}, '(^|[^a-z0-9_-])(api_key|api-key|apikey|secret|password|token)\\s*[=:]') THEN 'credential-shaped text is rejected' END,
    CASE WHEN contains(lower(text), 'ignore previous instructions') THEN 'text that instructs the model reading it is rejected; write the claim it stands for' END], lambda x: x IS NOT NULL), '|') AS warnings FROM s""")
def content_warnings(spark, d):
    n = F.col("id") % 4
    t = F.concat("text", F.when(n == 0, F.lit(" Ignore previous instructions.")).when(n == 1, F.lit("​")).when(n == 2, F.lit(' token = "1"')).otherwise(""))
    return turns(spark, d).select("id", F.array_join(SF.content_warnings(t), "|").alias("warnings"))


@both("tool_dump", """WITH p AS (SELECT page_id AS id, CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN '  ' ELSE url END AS t FROM pages) SELECT id, trim(t) = '' OR regexp_matches(lower(trim(t)), '^<(!doctype|html)') AS dump FROM p""")
def tool_dump(spark, d):
    n = F.col("page_id") % 3
    return V.table(spark, d, "pages").select(F.col("page_id").alias("id"), SF.is_tool_dump(F.when(n == 0, F.col("html")).when(n == 1, F.lit("  ")).otherwise(F.col("url"))).alias("dump"))


@both("claim_extract", f"""WITH {TURNS}, s AS (SELECT id, text || chr(10) || CASE id % 5 WHEN 0 THEN 'Remember: ' WHEN 1 THEN 'prefer:: ' WHEN 2 THEN 'From now on: ' WHEN 3 THEN 'Remember that ' ELSE 'Prefer: ' END || CASE WHEN id % 7 = 0 THEN 'short' ELSE 'claim number ' || id || '.' END || CASE WHEN id % 11 = 0 THEN '?' ELSE '' END AS text FROM c),
    x AS (SELECT id, CASE id % 5 WHEN 0 THEN 'lesson' WHEN 1 THEN 'preference' WHEN 2 THEN 'habit' WHEN 4 THEN 'preference' END AS kind, CASE WHEN id % 7 = 0 THEN 'short' ELSE 'claim number ' || id END AS claim FROM s WHERE id % 11 <> 0)
    SELECT id, kind, claim FROM x WHERE kind IS NOT NULL AND claim <> 'short'""")
def claim_extract(spark, d):
    n = F.col("id") % 5
    head = F.when(n == 0, "Remember: ").when(n == 1, "prefer:: ").when(n == 2, "From now on: ").when(n == 3, "Remember that ").otherwise("Prefer: ")
    body = F.when(F.col("id") % 7 == 0, F.lit("short")).otherwise(F.concat(F.lit("claim number "), F.col("id").cast("string"), F.lit(".")))
    t = F.concat("text", F.lit("\n"), head, body, F.when(F.col("id") % 11 == 0, "?").otherwise(""))
    return turns(spark, d).select("id", SF.claim_from_user(t).alias("c")).where("c is not null").select("id", "c.kind", "c.claim")


@both("norm_claim", f"""WITH {DOCS} SELECT id, md5(rtrim(trim(regexp_replace({LOW.format('text')}, '\\s+', ' ', 'g')), '.,;:')) AS norm FROM d""")
def norm_claim(spark, d):
    return docs(spark, d).select("id", F.md5(T.norm_claim(F.col("text")).cast("binary")).alias("norm"))


BLOCKS = "list_filter([regexp_replace(x, '^\\s+|\\s+$', '', 'g') FOR x IN string_split_regex(replace(text, chr(13) || chr(10), chr(10)), '\\n(?:[^\\S\\n]*\\n)+')], lambda x: x <> '')"
LINES = "list_filter([regexp_replace(x, '^\\s+|\\s+$', '', 'g') FOR x IN string_split(text, chr(10))], lambda x: x <> '')"


@both("paragraphs", f"""WITH {DOCS}, b AS (SELECT id, CASE WHEN len({BLOCKS}) <= 1 THEN {LINES} ELSE {BLOCKS} END AS p FROM d), u AS (SELECT id, unnest(p) AS p FROM b) SELECT id, count(*) AS n, CAST(sum(length(p)) AS BIGINT) AS chars FROM u GROUP BY id""")
def paragraphs(spark, d):
    """Blocks between blank lines; texts of one block are cut into lines."""
    p = docs(spark, d).select("id", F.explode(T.paragraphs(F.col("text"))).alias("p"))
    return p.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("p")).alias("chars"))


@both("word_chunks_384", r"WITH d AS (SELECT doc_id AS id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '') AS w FROM documents), n AS (SELECT id, w, unnest(range(0, CAST(ceil(len(w) / 384.0) AS INT))) AS i FROM d WHERE len(w) > 0) SELECT id, CAST(i AS INTEGER) AS i, md5(array_to_string(w[i * 384 + 1 : i * 384 + 384], ' ')) AS chunk FROM n")
def word_chunks(spark, d):
    c = docs(spark, d).select("id", F.posexplode(T.units(F.lit("x"), F.col("text"))).alias("i", "c"))
    return c.select("id", "i", F.md5(F.col("c").cast("binary")).alias("chunk"))


@both("fact_lines", f"""WITH {TURNS}, s AS (SELECT id, text || chr(10) || '1. A fact of ' || id || chr(10) || '2 none' || chr(10) || ' 30. Another. ' AS text FROM c), l AS (SELECT id, trim(unnest(string_split(text, chr(10)))) AS l FROM s) SELECT id, l AS fact FROM l WHERE regexp_matches(l, '^[0-9]') AND contains(l, '. ')""")
def fact_lines(spark, d):
    t = F.concat("text", F.lit("\n1. A fact of "), F.col("id").cast("string"), F.lit("\n2 none\n 30. Another. "))
    return turns(spark, d).select("id", F.explode(T.units(F.lit("factconsolidation_sh"), t)).alias("fact"))


@both("names", f"""WITH {V.ATOMS}, n AS (SELECT id, k, 'git@github.com:' || workspace || '/' || kind || '.git' AS r, 'dir:/home/' || workspace || '/x y' AS w, CASE WHEN k < 5 THEN ' Set-' || k || ' ' ELSE 'set_' || k END AS s FROM atoms)
    SELECT id, 'git:github.com/' || replace(replace(r, 'git@github.com:', ''), '.git', '') AS remote, 'dir_home_' || regexp_extract(w, 'home/(u[0-9]+)', 1) || '_x_y' AS slug, CASE WHEN k < 5 THEN 'set-' || k END AS set_, translate(w, '/\\:', '___') || '.jsonl' AS file, substr(sha256(w), 1, 16) AS digest FROM n""")
def names(spark, d):
    a = V.atoms(spark, d)
    r = F.concat(F.lit("git@github.com:"), "workspace", F.lit("/"), "kind", F.lit(".git"))
    w = F.concat(F.lit("dir:/home/"), "workspace", F.lit("/x y"))
    s = F.when(F.col("k") < 5, F.concat(F.lit(" Set-"), F.col("k").cast("string"), F.lit(" "))).otherwise(F.concat(F.lit("set_"), F.col("k").cast("string")))
    return a.select("id", T.normalize_remote(r).alias("remote"), T.workspace_slug(w).alias("slug"), T.set_name(s).alias("set_"), T.export_file_name(w).alias("file"), T.short_digest(w).alias("digest"))


@both("glob_ignored", "SELECT page_id AS id, regexp_matches(url, '^https://www.*') OR list_contains(string_split(url, '/'), 'fr') AS ignored FROM pages")
def glob_ignored(spark, d):
    return V.table(spark, d, "pages").select(F.col("page_id").alias("id"), T.is_ignored(F.col("url"), ["https://www*", "fr"]).alias("ignored"))


@both("query_parameters", "SELECT page_id AS id, 'a b' AS q, CAST(page_id AS VARCHAR) AS n FROM pages")
def query_parameters(spark, d):
    p = V.table(spark, d, "pages")
    m = T.query_parameters(F.concat(F.regexp_replace("url", "[?#].*", ""), F.lit("?q=a+b&n="), F.col("page_id").cast("string"), F.lit("&n=2#x")))
    return p.select(F.col("page_id").alias("id"), m["q"].alias("q"), m["n"].alias("n"))


@both("frontmatter", "SELECT page_id AS id, 'page ' || page_id AS title, url AS link FROM pages")
def frontmatter(spark, d):
    t = F.concat(F.lit("---\ntitle: page "), F.col("page_id").cast("string"), F.lit('\nlink: "'), "url", F.lit('"\n---\nbody: no'))
    return V.table(spark, d, "pages").select(F.col("page_id").alias("id"), T.frontmatter(t).alias("m")).select("id", F.col("m")["title"].alias("title"), F.col("m")["link"].alias("link"))


@both("fidelity", f"""WITH {TURNS} SELECT id, CASE WHEN id % 2 = 0 AND trim(regexp_replace({LOW.format('text')}, '\\s+', ' ', 'g')) <> '' THEN 'SUPPORTED' ELSE 'NEI' END AS verdict FROM c""")
def fidelity(spark, d):
    t = turns(spark, d)
    claim = F.when(F.col("id") % 2 == 0, F.concat(F.lit("So: "), F.translate("text", T.LOWER, T.UPPER))).otherwise("no such thing 12345")
    return t.select("id", T.fidelity(claim, F.col("text")).alias("verdict"))


WORDS = "regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*')"
FALSE = ", ".join(f"'{w}'" for w in PR.FALSE_LY)
ADV = ", ".join(f"'{w}'" for w in PR.ADVERBS)
BE = ", ".join(f"'{w}'" for w in PR.BE)


@both("prose_counts", f"""WITH {DOCS}, w AS (SELECT id, unnest({WORDS}) AS w FROM d), l AS (SELECT id, lower(w) AS w FROM w), n AS (SELECT id, w, len(regexp_extract_all(regexp_replace(w, '[^a-z]', '', 'g'), '[aeiouy]+')) AS v FROM l)
    SELECT id, count(*) AS words, count(*) FILTER (WHERE w NOT IN ({FALSE}) AND (w IN ({ADV}) OR (length(w) > 2 AND w LIKE '%ly'))) AS adverbs, count(*) FILTER (WHERE w IN ({BE})) AS be_verbs, count(*) FILTER (WHERE length(w) > 2 AND (w LIKE '%ed' OR w LIKE '%en')) AS participles,
    CAST(sum(greatest(1, v - CASE WHEN regexp_replace(w, '[^a-z]', '', 'g') LIKE '%e' AND v > 1 THEN 1 ELSE 0 END)) AS BIGINT) AS syllables FROM n GROUP BY id""")
def prose_counts(spark, d):
    c = PR.word_counts(F.col("text"))
    return docs(spark, d).select("id", *[v.cast("long").alias(k) for k, v in c.items()]).where("words > 0")


@both("prose_report", None)
def prose_report(spark, d):
    return turns(spark, d).select("id", PR.report(F.col("text")).alias("r")).select("id", "r.*")


@both("validate_errors", f"""WITH {V.ATOMS} SELECT id, CASE WHEN k = 0 THEN 'unknown atom kind: vibes' WHEN k = 1 THEN 'unknown atom level: guessed' WHEN k = 2 THEN 'atom text is required' WHEN k = 3 THEN 'bad set name: ''../etc''' WHEN k = 4 THEN '''deed-'' is a bare ''deed-'' and names no deed' WHEN k = 5 THEN 'unknown atom origin: moon' WHEN k = 6 THEN 'atom text exceeds soft cap 500' WHEN kind = 'note' THEN 'note atom needs issue, the ticket whose logbook it copies' END AS error FROM atoms""")
def validate_errors(spark, d):
    k = F.col("k")
    a = V.atoms(spark, d).select("id", "workspace", F.when(k == 0, "vibes").otherwise(F.col("kind")).alias("kind"), F.when(k == 1, "guessed").otherwise("explicit").alias("level"), F.when(k == 5, "moon").otherwise(F.lit(None)).alias("origin"),
        F.when(k == 2, "   ").when(k == 6, F.repeat(F.lit("word "), 101)).otherwise(F.col("text")).alias("text"), F.when(k == 3, "../etc").otherwise("Review").alias("set"), F.when(k == 4, F.array(F.lit("deed-"))).otherwise(F.array(F.lit("JOSS"))).alias("entities"), F.lit(None).cast("string").alias("issue"))
    return S.validate(a).select("id", "error")


# -- windows and evaluation -----------------------------------------------------------------------------------------------------
@both("passage_6_3", f"""WITH {TURNS}, n AS (SELECT conv, count(*) AS n FROM c GROUP BY conv), s AS (SELECT conv, unnest(range(0, CAST(ceil(greatest(n - 6, 0) / 3.0) AS INT) * 3 + 1, 3)) AS start FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn) - 1 AS p FROM c)
    SELECT s.conv, CAST(start AS INTEGER) AS start, md5(string_agg(text, chr(10) ORDER BY p)) AS text FROM s JOIN r ON r.conv = s.conv AND p >= start AND p < start + 6 GROUP BY s.conv, start""")
def passage_6_3(spark, d):
    return EV.windows(turns(spark, d).select("conv", "turn", "text")).select("conv", "start", F.md5(F.col("text").cast("binary")).alias("text"))


@both("session_documents", f"WITH {TURNS} SELECT conv, md5(string_agg(text, chr(10) ORDER BY turn)) AS text FROM c GROUP BY conv")
def session_documents(spark, d):
    return EV.sessions(turns(spark, d).select("conv", "turn", "text")).select("conv", F.md5(F.col("text").cast("binary")).alias("text"))


def _hits(spark, d):
    e = V.table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    h = R.search_dense(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), q, 10, digits=6)
    return h.join(e.select(F.col("vec_id").alias("id"), "label"), "id")


HITS = "s AS (SELECT a.vec_id AS qid, b.vec_id AS id, b.label, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 20 = 0), h AS (SELECT qid, id, label, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(c, 6) DESC, id) AS rank FROM s WHERE c > 0) WHERE rank <= 10)"


@both("collapse_best", f"WITH {HITS}, b AS (SELECT qid, label, min(rank) AS best FROM h GROUP BY ALL) SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY best, label) AS rank FROM b")
def collapse_best(spark, d):
    return EV.collapse(_hits(spark, d), "label")


@both("latest_first", f"WITH {HITS} SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY id DESC) AS rank FROM h WHERE rank <= 5")
def latest_first(spark, d):
    return EV.latest_first(_hits(spark, d), 5, "id").select("qid", "id", "rank")


@both("eval_tally", f"""WITH {HITS}, j AS (SELECT a.vec_id AS qid, b.vec_id AS key, a.label AS g FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id <= a.vec_id WHERE a.vec_id % 20 = 0), n AS (SELECT qid, g, count(*) AS n FROM j GROUP BY ALL),
    m AS (SELECT h.qid, count(*) FILTER (WHERE rank <= 1) AS a1, count(*) FILTER (WHERE rank <= 5) AS a5, count(*) FILTER (WHERE rank <= 10) AS a10, sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM h JOIN j ON j.qid = h.qid AND j.key = h.id GROUP BY h.qid),
    t AS (SELECT n.*, coalesce(a1, 0) AS a1, coalesce(a5, 0) AS a5, coalesce(a10, 0) AS a10, coalesce(dcg, 0) / list_sum([1 / log2(i + 1) FOR i IN range(1, least(n, 5) + 1)]) AS nd FROM n LEFT JOIN m USING (qid))
    SELECT g, count(*) AS queries, round(avg(CASE WHEN a1 > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_1, round(avg(CASE WHEN a5 > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_5, round(avg(a10 / CAST(n AS DOUBLE)), 6) AS recall_10, round(avg(nd), 6) AS ndcg_5 FROM t GROUP BY g""")
def eval_tally(spark, d):
    e = V.table(spark, d, "embeddings").select("vec_id", "label")
    j = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("g")).join(e.select(F.col("vec_id").alias("key"), F.col("label").alias("g")), "g").where("key <= qid")
    h = _hits(spark, d).select("qid", F.col("id").alias("key"), "rank")
    return EV.tally(h, j, by=["g"]).select("g", "queries", *[F.round(c, 6).alias(c) for c in ("hit_1", "hit_5", "recall_10", "ndcg_5")])


@both("protocol_table", f"WITH {V.ATOMS} SELECT kind AS competency, count(*) FILTER (WHERE k < 7) AS admitted, count(*) FILTER (WHERE k >= 7) AS refused, count(*) FILTER (WHERE k = 3 AND kind <> 'goal') AS asked, count(*) FILTER (WHERE k = 3 AND kind <> 'goal' AND trust > 0.1) AS hit, round(count(*) FILTER (WHERE k = 3 AND kind <> 'goal' AND trust > 0.1) / CAST(nullif(count(*) FILTER (WHERE k = 3 AND kind <> 'goal'), 0) AS DOUBLE), 6) AS rate FROM atoms GROUP BY kind")
def protocol_table(spark, d):
    a = V.atoms(spark, d)
    asked = (F.col("k") == 3) & (F.col("kind") != "goal")
    r = EV.protocol_table(a.select(F.col("kind").alias("competency"), (F.col("k") < 7).cast("int").alias("admitted"), (F.col("k") >= 7).cast("int").alias("refused"), asked.cast("int").alias("asked"), (asked & (F.col("trust") > 0.1)).cast("int").alias("hit")))
    return r.withColumn("rate", F.round("rate", 6))


@both("bearing", None)
def bearing(spark, d):
    claims = docs(spark, d)
    q = V.table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text", F.array("text").alias("answers"))
    return EV.bearing(claims, q)


@both("containment_relevance", "SELECT b.item_id AS qid, count(*) AS n FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def containment_relevance(spark, d):
    """Documents that hold a benchmark passage: the passages are a small stated set, checked before their broadcast."""
    b = V.table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    return docs(spark, d).join(R.hinted(b, 5000), F.contains("text", F.col("passage"))).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))


@both("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return EV.latencies(V.table(spark, d, "events"), ["event_type"], "value").select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


@both("tree_outline", "SELECT split_part(replace(replace(url, 'https://', ''), 'http://', ''), '/', 1) AS top, count(*) AS files FROM pages GROUP BY 1")
def tree_outline(spark, d):
    return EV.tree_outline(V.table(spark, d, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path")))


@both("cards_check", f"WITH {TURNS} SELECT id, length(text) AS size, length(text) > CASE WHEN role = 'user' THEN 1375 ELSE 2200 END AS over_ FROM c")
def cards_check(spark, d):
    from ..sources.jsonl import card_warnings

    c = turns(spark, d).select("id", F.lit("w").alias("workspace"), F.col("role").alias("field"), "text")
    return card_warnings(c).select("id", "size", F.col("over").alias("over_"))


@both("pack_documents", f"WITH {V.ATOMS} SELECT workspace, count(*) AS n, md5(string_agg(id, ',' ORDER BY id)) AS ids FROM atoms WHERE {V.LIVE} GROUP BY workspace")
def pack_documents(spark, d):
    a = V.atoms(spark, d)
    from ..functions.predicates import is_live

    live = a.where(is_live(F.col("tombstone"), F.col("valid_to"), V.now()))
    cards = live.select("workspace", F.lit("user").alias("field"), F.lit("card").alias("text")).distinct()
    p = S.pack(cards, live)
    return p.select("workspace", F.size("atoms").cast("long").alias("n"), F.md5(F.array_join(F.transform("atoms", lambda x: x["id"]), ",").cast("binary")).alias("ids"))


# -- streams --------------------------------------------------------------------------------------------------------------------
def _stream(spark, d):
    """The events as a stream: a folder of files, or the folder that holds the one file."""
    path = f"{d}/events.parquet"
    table = spark.read.parquet(path)
    one = table.inputFiles()[0].endswith("/events.parquet")
    reader = spark.readStream.schema(table.schema)
    return reader.option("pathGlobFilter", "events.parquet").parquet(d) if one else reader.parquet(path)


def _all(spark, stream, name: str, mode: str):
    """Runs a stream to its end into the shared folder and reads what it wrote."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="atomweave-")
    at = f"{root.rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    w = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    w.start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


@both("stream_windowed_counts", "SELECT epoch_us(date_trunc('day', ts)) AS day_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark, d):
    """Daily counts from the stream in update mode: the last update of each window."""
    from ..streaming.ingest import windowed_counts

    s = _stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    r = _all(spark, windowed_counts(s, ["event_type"]), "counts", "update")
    return r.groupBy(F.unix_micros("window.start").alias("day_us"), "event_type").agg(F.max("n").alias("n"))


@both(
    "stream_hold_window",
    """WITH RECURSIVE e AS (
        SELECT DISTINCT user_id, event_type, epoch_us(CAST(ts AS TIMESTAMP)) AS ts_us FROM events WHERE ts IS NOT NULL
    ), p AS (
        SELECT user_id, event_type, min(ts_us) AS ts_us FROM e GROUP BY ALL
        UNION ALL
        SELECT p.user_id, p.event_type, n.ts_us FROM p, LATERAL (
            SELECT min(e.ts_us) AS ts_us FROM e WHERE e.user_id IS NOT DISTINCT FROM p.user_id AND e.event_type IS NOT DISTINCT FROM p.event_type AND e.ts_us >= p.ts_us + 3600000000
        ) n WHERE n.ts_us IS NOT NULL
    ) SELECT * FROM p""",
)
def stream_hold_window(spark, d):
    """The events that the hold window of an hour lets through."""
    from ..streaming.ingest import hold_window

    s = _stream(spark, d).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    r = _all(spark, hold_window(s, ["user_id", "event_type"]), "hold", "append")
    return r.select("user_id", "event_type", F.unix_micros("ts").alias("ts_us"))


@both("stream_ingest_latest", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def stream_ingest_latest(spark, d):
    from ..streaming.ingest import latest

    s = _stream(spark, d).select("user_id", "event_type", "event_id", F.struct("ts", "event_id").alias("seq"))
    r = _all(spark, s, "ingest", "append").withColumnRenamed("batch", "version")
    return latest(r, ("user_id", "event_type")).select("user_id", "event_type", "event_id")
