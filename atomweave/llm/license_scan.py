"""License scans: ordered signature rules over normalised words, in DataFrame functions alone.

A rule (license_rules.py) is a regex over the words of a text (lower-cased, joined by single blanks), its keywords, a priority,
a score and a label. A text is tokenised only if it holds a keyword of any rule as a word, and a rule's regex runs only on texts
that hold one of its own. Detections are word intervals. One is suppressed when an interval of a higher priority, or of the same
priority and a larger size or an earlier rule, contains it.

Everything happens inside the row: no shuffle, no join, no Python. The work is linear in the words and, but for sorting, in the
detections: matches are marked in the text, so their places are read off the marked words, and the suppression runs over
chunks of CHUNK detections, so that no growing array is copied at each step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import RULES

#: Phrases whose places every scan reports, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = 5
#: Detections that the suppression takes at a time.
CHUNK = 128
KEPT = "array<struct<label:string,s:int,e:int,score:double>>"


def rules() -> list[tuple[str, str, int, float, str]]:
    """(label, keywords, priority, score, regex) in order: highest priority first, then as listed."""
    return sorted(RULES, key=lambda r: -r[2])


def keywords() -> list[str]:
    return sorted({k for r in RULES for k in r[1].split()})


def gate() -> str:
    """A regex that finds a keyword as a word, grouped by first letters so that most words fail at once."""
    by: dict[str, list[str]] = {}
    for k in keywords():
        by.setdefault(k[0], []).append(k[1:])
    letter = RAW_WORD.rstrip("+")
    return f"(?i)(?<!{letter})(?:{'|'.join(f'{c}(?:{"|".join(rest)})' for c, rest in sorted(by.items()))})(?!{letter})"


def _table() -> Column:
    def one(i: int, r: tuple[str, str, int, float, str]) -> Column:
        keys = F.array(*[F.lit(k) for k in r[1].split()])
        return F.struct(F.lit(r[0]).alias("label"), keys.alias("keys"), F.lit(r[2]).alias("prio"), F.lit(r[3]).alias("score"), F.lit(f"(?<= )(?:{r[4]})(?= )").alias("re"), F.lit(i).alias("at"))

    return F.array(*[one(i, r) for i, r in enumerate(rules())])


def _found(norm: Column, rule: Column) -> Column:
    """Word intervals of a rule's matches, with what the suppression needs: the ends of each match are marked, then looked up among the words."""
    words = F.split(F.regexp_replace(norm, rule["re"], F.lit("\x01$0\x02")), " ")
    marks = F.filter(F.transform(words, lambda x, i: F.struct(i.alias("i"), x.startswith("\x01").alias("s"), x.endswith("\x02").alias("e"))), lambda x: x["s"] | x["e"])

    def intervals(m: Column) -> Column:
        first, last = F.filter(m, lambda x: x["s"]), F.filter(m, lambda x: x["e"])
        return F.zip_with(first, last, lambda a, b: F.struct((a["i"] - 1).alias("s"), (-b["i"]).alias("e"), (-rule["prio"]).alias("p"), rule["at"].alias("at"), rule["label"].alias("label"), rule["score"].alias("score")))

    return F.when(F.rlike(norm, rule["re"]), F.get(F.transform(F.array(marks), intervals), 0)).otherwise(F.array().cast(FOUND))


FOUND = "array<struct<s:int,e:int,p:int,at:int,label:string,score:double>>"


def _standing(found: Column) -> Column:
    """The detections that no other suppresses. In order of start, larger ends, priority and rule, an interval is contained in an earlier one if that ends no sooner."""
    tops = [f"m{p}" for p in range(1, TOP + 1)]

    def step(acc: Column, d: Column) -> Column:
        end, prio = -d["e"], -d["p"]
        covered = F.lit(False)
        for p in range(1, TOP + 1):
            covered = covered | ((prio <= p) & (acc[f"m{p}"] >= end))
        own = F.array(F.struct(d["label"].alias("label"), d["s"].alias("s"), end.alias("e"), d["score"].alias("score")))
        return F.struct(*[F.when(prio == p, F.greatest(acc[f"m{p}"], end)).otherwise(acc[f"m{p}"]).alias(f"m{p}") for p in range(1, TOP + 1)], F.when(covered, acc["kept"]).otherwise(F.concat(acc["kept"], own)).alias("kept"))

    def chunk(acc: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(*[acc[m].alias(m) for m in tops], F.array().cast(KEPT).alias("kept")), step)
        return F.get(F.transform(F.array(inner), lambda x: F.struct(*[x[m].alias(m) for m in tops], F.concat(acc["kept"], F.array(x["kept"])).alias("kept"))), 0)

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK)), lambda c: F.slice(found, (c * CHUNK + 1).cast("int"), CHUNK))
    state = F.struct(*[F.lit(-1).alias(m) for m in tops], F.array().cast(f"array<{KEPT}>").alias("kept"))
    return F.when(F.size(found) > 0, F.flatten(F.aggregate(chunks, state, chunk, lambda a: a["kept"])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of each row of docs.

    spans: array of (label, start, end) in words, end exclusive, of the detections that stand, by start. Null and empty texts
    have no words: zero counts, null places, empty label strings, score 0. Repeated rows and null ids are scanned each by
    itself. Of detections of one interval and priority the rule listed first stands. A long text is read whole, in time linear in
    its words and detections. Other columns of docs are not read, whatever their names. An empty table gives no rows.
    """
    held = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    words = F.when(F.col("t").rlike(gate()), F.translate(F.array_join(F.regexp_extract_all("t", F.lit(RAW_WORD), F.lit(0)), " "), UPPER, LOWER))
    held = held.select("id", F.regexp_count("t", F.lit(RAW_WORD)).cast("long").alias("n_words"), F.concat(F.lit(" "), words, F.lit(" ")).alias("norm"))
    held = held.withColumn("w", F.split(F.trim("norm"), " "))

    def place(w: Column, i: Column) -> Column:
        out = None
        for phrase, label in BASE.items():
            parts = phrase.split(" ")
            here = w == parts[0]
            for k, p in enumerate(parts[1:], 1):
                here = here & F.coalesce(F.get(F.col("w"), i + k) == p, F.lit(False))
            value = F.struct(i.cast("long").alias("i"), F.lit(label).alias("label"))
            out = F.when(here, value) if out is None else out.when(here, value)
        return out

    none = F.array().cast("array<struct<i:bigint,label:string>>")
    said = F.lit(False)
    for phrase in BASE:
        said = said | F.contains("norm", F.lit(f" {phrase} "))
    base = F.coalesce(F.when(said, F.filter(F.transform("w", place), lambda x: x.isNotNull())), none)
    keys = F.array_intersect(F.col("w"), F.array(*[F.lit(k) for k in keywords()]))
    held = held.select("id", "n_words", "norm", base.alias("base"), keys.alias("keys"))
    picked = F.filter(_table(), lambda r: F.arrays_overlap(F.col("keys"), r["keys"]))
    found = F.when(F.size("keys") > 0, F.array_sort(F.flatten(F.transform(picked, lambda r: _found(F.col("norm"), r)))))
    held = held.select("id", "n_words", "base", found.alias("found"))
    held = held.select("id", "n_words", "base", F.coalesce(_standing(F.col("found")), F.array().cast(KEPT)).alias("spans"))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    names = F.transform("base", lambda x: x["label"])
    best = F.greatest(F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0)), F.when(F.size("base") > 0, 0.9).otherwise(0.0))
    places = F.transform("base", lambda x: x["i"])
    return held.select(
        F.col("id").alias(id_col), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        joined(names).alias("base_labels"), joined(F.concat(names, F.transform("spans", lambda x: x["label"]))).alias("labels"), best.alias("score"),
        F.transform("spans", lambda x: F.struct(x["label"].alias("label"), x["s"].alias("start"), x["e"].alias("end"))).alias("spans"),
    )
