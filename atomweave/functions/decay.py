"""How claims fade: recency, half-life, retrievability; and vector products."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half-life in days, floor of the retrievability weight, sources that do not fade.
HALF_LIFE, FLOOR = 14.0, 0.25
EVERGREEN = ("user", "global", "workspace", "evergreen")


def recency(age_days: Column) -> Column:
    """0.5 ^ (days / 14); 1 without a stamp."""
    return F.coalesce(F.pow(F.lit(0.5), age_days / F.lit(HALF_LIFE)), F.lit(1.0))


def temporal(source: Column, age_days: Column, half: float = HALF_LIFE) -> Column:
    fade = F.exp(F.lit(-math.log(2) / half) * F.greatest(age_days, F.lit(0.0)))
    return F.when(source.isin(*EVERGREEN), 1.0).otherwise(fade)


def retrievability(age_days: Column, stability: Column) -> Column:
    """(1 + 19/81 t/S) ^ -1/2; 1 without stability."""
    return F.when(stability <= 0, 1.0).otherwise(F.pow(F.lit(1.0) + F.lit(19.0 / 81.0) * age_days / stability, F.lit(-0.5)))


def weight(mode: str, source: Column, age_days: Column, stability: Column) -> Column:
    """The weight a fused hit is multiplied by: off, on (half-life) or fsrs (retrievability, 0.25 at least)."""
    if mode == "off":
        return F.lit(1.0)
    if mode == "on":
        return temporal(source, age_days)
    if mode == "fsrs":
        return F.when(source.isin(*EVERGREEN), 1.0).otherwise(F.greatest(F.lit(FLOOR), retrievability(age_days, stability)))
    raise ValueError(f"unknown decay: {mode}")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for vectors of different lengths or of length 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def max_sim(query: Column, document: Column) -> Column:
    """Late interaction: for each query vector the best cosine over the document's, summed."""
    best = F.transform(query, lambda q: F.coalesce(F.array_max(F.transform(document, lambda d: cosine(q, d))), F.lit(0.0)))
    return F.aggregate(best, F.lit(0.0), lambda a, x: a + x)
