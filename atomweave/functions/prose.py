"""Readability of claims: words, sentences, grade, ease, adverbs, passives, hard sentences.

The row functions are plain Python in Arrow batches, as a name's letters depend on what touches it; word_counts has what
Column expressions can say.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words in ly that are no adverbs, adverbs without ly, forms of be, abbreviations, limits.
FALSE_LY = ("only", "family", "apply", "early", "daily", "weekly", "monthly", "yearly", "supply", "reply", "imply", "comply", "ally", "belly", "fly", "sly", "july")
ADVERBS = ("very", "really", "quite", "just", "actually", "basically", "literally", "seriously", "extremely", "incredibly", "totally", "definitely", "probably", "certainly")
BE = ("am", "is", "are", "was", "were", "be", "been", "being")
ABBREVIATIONS = ("e.g.", "i.e.", "etc.", "vs.", "cf.", "approx.", "a.k.a.", "al.")
HARD, VERY_HARD, MAX_SENTENCES, MAX_GRADE, MAX_ADVERBS, NAME = 20, 30, 2, 14.0, 0.12, 6

WORD = re.compile(r"[A-Za-z][A-Za-z'-]*")
END = re.compile(r"(?:[.!?]+[\"')\]]*(?=\s|$)|\n\s*\n)")


def sentences(text: str) -> list[str]:
    """Pieces that end at a full stop, question or exclamation mark before white space, or at a blank line.

    Stops inside words, after abbreviations and after single capitals end none; pieces without words are left out.
    """
    out, start = [], 0
    for m in END.finditer(text):
        last = text[start : m.end()].split()
        word = last[-1].lstrip("\"'([") if last else ""
        if m[0].startswith(".") and (word.lower() in ABBREVIATIONS or re.fullmatch(r"[A-Z]\.", word)):
            continue
        out.append(text[start : m.end()])
        start = m.end()
    out.append(text[start:])
    return [s.strip() for s in out if WORD.search(s)]


def syllables(word: str) -> int:
    w = re.sub(r"[^a-z]", "", word.lower())
    n = len(re.findall(r"[aeiouy]+", w))
    return max(1, n - (w.endswith("e") and n > 1))


def letters(text: str, start: int, end: int) -> int:
    """Letters of the word at text[start:end]; a name (glued to a path or number, mixed in case, hyphenated) counts six at most."""
    word = text[start:end]
    if len(word) <= NAME:
        return len(word)
    touch = "_/.`$=:0123456789"
    before, after, beyond = text[start - 1 : start], text[end : end + 1], text[end + 1 : end + 2]
    glued = (before and before in touch) or (after and after in touch and beyond and beyond not in " \t\n\x0c\r")
    caps = sum(c.isupper() for c in word)
    mixed = caps > 1 or (caps == 1 and not word[0].isupper())
    return NAME if glued or mixed or "-" in word else len(word)


def is_adverb(word: str) -> bool:
    w = word.lower()
    return w not in FALSE_LY and (w in ADVERBS or (len(w) > 2 and w.endswith("ly")))


def _round(v: float, places: int) -> float:
    import math

    scale = 10**places
    return math.copysign(math.floor(abs(v) * scale + 0.5), v) / scale


def assess(text: str) -> dict:
    spans = [(m.start(), m.end()) for m in WORD.finditer(text)]
    words = [text[a:b] for a, b in spans]
    parts = sentences(text) or ([text] if words else [])
    n, k = len(words), max(1, len(parts))
    grade = ease = None
    if n >= 8:
        grade = _round(4.71 * (sum(letters(text, a, b) for a, b in spans) / n) + 0.5 * (n / k) - 21.43, 2)
        ease = _round(206.835 - 1.015 * (n / k) - 84.6 * (sum(map(syllables, words)) / n), 2)
    adverbs = sum(map(is_adverb, words))
    hard = very = passive = 0
    for p in parts:
        own = [w.lower() for w in WORD.findall(p)]
        very += len(own) >= VERY_HARD
        hard += HARD <= len(own) < VERY_HARD
        passive += any(w in BE for w in own) and any(len(w) > 2 and w.endswith(("ed", "en")) for w in own)
    return {"words": n, "sentences": len(parts) if words else 0, "grade": grade, "ease": ease, "adverbs": adverbs, "adverb_ratio": _round(adverbs / n, 3) if n else 0.0, "passives": passive, "hard_sentences": hard, "very_hard_sentences": very}


def refuse(text: str, atom: bool = True) -> str | None:
    """Why a claim is too hard for the working core, None where it is not; files may have any number of sentences."""
    r = assess(text)
    if atom and r["sentences"] > MAX_SENTENCES:
        return f"atom has {r['sentences']} sentences; one claim is at most {MAX_SENTENCES}"
    if atom and r["very_hard_sentences"]:
        at, n = next((i, n) for i, n in enumerate(len(WORD.findall(s)) for s in (sentences(text) or [text])) if n >= VERY_HARD)
        return f"atom sentence {at + 1} is very hard to read: {n} words, the limit is {VERY_HARD - 1}; split it at a conjunction or drop a clause"
    if r["words"] >= 12 and r["grade"] is not None:
        if r["grade"] > MAX_GRADE:
            return f"readability grade {r['grade']:g} exceeds {MAX_GRADE:g}; use shorter sentences and shorter words"
        if r["adverb_ratio"] > MAX_ADVERBS:
            return f"adverb ratio {r['adverb_ratio']:g} exceeds {MAX_ADVERBS:g}; cut the -ly words or replace them with a number"
    return None


REPORT = "words int, sentences int, grade double, ease double, adverbs int, adverb_ratio double, passives int, hard_sentences int, very_hard_sentences int, warning string"


def report(text: Column, kind: Column | None = None) -> Column:
    """Struct REPORT of a text; mail is not warned of, notes are read as files."""
    def run(texts: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        rows = []
        for t, k in zip(texts, kinds, strict=True):
            t = t if isinstance(t, str) else ""
            rows.append(assess(t) | {"warning": None if k in ("message", "receipt", "group") else refuse(t, k != "note")})
        return pd.DataFrame(rows, columns=[c.split()[0] for c in REPORT.split(", ")])

    return F.pandas_udf(run, f"struct<{', '.join(':'.join(c.split()) for c in REPORT.split(', '))}>")(text, kind if kind is not None else F.lit("lesson"))


def first_sentence(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: next(iter(sentences(t)), None) if isinstance(t, str) else None)

    return F.pandas_udf(run, "string")(text)


def word_counts(text: Column) -> dict[str, Column]:
    """words, adverbs, be_verbs, participles, syllables as Column expressions."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z'-]*"), F.lit(0))
    low = F.transform(words, F.lower)
    adverb = F.filter(low, lambda w: ~w.isin(*FALSE_LY) & (w.isin(*ADVERBS) | ((F.length(w) > 2) & F.endswith(w, F.lit("ly")))))
    bare = F.transform(low, lambda w: F.regexp_replace(w, "[^a-z]", ""))
    groups = F.transform(bare, lambda w: F.struct(w.alias("w"), F.regexp_count(w, F.lit("[aeiouy]+")).alias("n")))
    syl = F.transform(groups, lambda g: F.greatest(F.lit(1), g["n"] - F.when(F.endswith(g["w"], F.lit("e")) & (g["n"] > 1), 1).otherwise(0)))
    return {
        "words": F.size(words),
        "adverbs": F.size(adverb),
        "be_verbs": F.size(F.filter(low, lambda w: w.isin(*BE))),
        "participles": F.size(F.filter(low, lambda w: (F.length(w) > 2) & w.rlike("(?:ed|en)$"))),
        "syllables": F.aggregate(syl, F.lit(0), lambda a, x: a + x),
    }
