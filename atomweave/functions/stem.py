"""The English (Porter2) stemmer from its published rules, over arrays of words in Arrow batches."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Published exceptions, suffixes and their replacements.
WHOLE = {"skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "dying": "die", "lying": "lie", "tying": "tie"}
SAME = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed", "evening"}
STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogist": "og"}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
LI = "cdeghkmnrt"


def _regions(w: str) -> tuple[int, int]:
    m = re.match(r"(?:gener|commun|arsen|past|univers|later|emerg|organ|inter)", w)
    if m:
        r1 = m.end()
    else:
        m = re.search(r"[aeiouy][^aeiouy]", w)
        r1 = m.end() if m else len(w)
    m = re.compile(r"[aeiouy][^aeiouy]").search(w, r1)
    return r1, m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch(r"[aeiouy][^aeiouy]", w) or w == "past")


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word of ASCII letters and apostrophes."""
    w = word
    if len(w) <= 2 or w in SAME:
        return w
    if w in WHOLE:
        return WHOLE[w]
    w = w.removeprefix("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy].", w[:-1]):
        w = w[:-1]
    if w in AFTER_1A:
        return w.lower()
    # 1b
    if w.endswith(("eedly", "eed")):
        end = 5 if w.endswith("eedly") else 3
        if len(w) - end >= r1:
            w = w[:-end] + "ee"
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                base = w[: -len(end)]
                if end == "ing" and re.fullmatch(r"[^aeiouy]y", base.lower()) and len(base) == 2:
                    w = base[0] + "ie"
                elif re.search(r"[aeiouy]", base):
                    w = base
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(DOUBLES) and not re.fullmatch(r"[aeo](?:bb|dd|ff|gg|mm|nn|pp|rr|tt)", w):
                        w = w[:-1]
                    elif r1 >= len(w) and _short_end(w):
                        w += "e"
                break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # 2
    for end, to in sorted(STEP2.items(), key=lambda x: -len(x[0])):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + to
            break
    else:
        if w.endswith("ogi"):
            if len(w) - 3 >= r1 and w[-4:-3] == "l":
                w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in LI:
            w = w[:-2]
    # 3
    for end, to in sorted([*STEP3.items(), ("ative", "")], key=lambda x: -len(x[0])):
        if w.endswith(end):
            if len(w) - len(end) >= (r2 if end == "ative" else r1):
                w = w[: -len(end)] + to
            break
    # 4
    for end in STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2:
                w = w[: -len(end)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    # 5
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.lower()


def fold(word: str) -> str:
    """The stem of a word of letters; words with a digit, hyphen or underscore stay."""
    return stem(word) if word.isalpha() and word.isascii() else word


def stem_words(words: Column) -> Column:
    """fold over an array of words."""
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda own: None if own is None else [fold(w) for w in own])

    return F.pandas_udf(run, "array<string>")(words)
