"""Similarity and decay as column expressions. Double throughout."""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEK_MS = 7 * 24 * 3600 * 1000
#: Weights of the five signals. Fixed values.
WEIGHTS = {"structural": 0.30, "semantic": 0.30, "temporal": 0.15, "importance": 0.15, "confidence": 0.10}
PROFILE = "v1-default"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """(cosine + 1) / 2; null if either is empty or of norm zero, or if their lengths differ."""
    norm = sqrt(sum(x * x for x in query))
    if not query or norm == 0:
        return F.lit(None).cast("double")
    literal = F.array(*(F.lit(float(x)) for x in query))
    own = F.sqrt(dot(vector, vector))
    return F.when((F.size(vector) == len(query)) & (own > 0), (dot(vector, literal) / (own * norm) + 1) / 2)


def distance_score(distance: Column) -> Column:
    return F.lit(1.0) / (distance + 1)


def recency(timestamp_ms: Column, now_ms: int) -> Column:
    """0 without a timestamp, 1 from now on, else hyperbolic with a half at one week."""
    age = (F.lit(now_ms) - timestamp_ms).cast("double")
    return F.when(timestamp_ms.isNull(), 0.0).when(timestamp_ms >= now_ms, 1.0).otherwise(1.0 / (1.0 + age / WEEK_MS))


def signal(x: Column) -> Column:
    """Clamped to 0..1; 0.5 where missing."""
    return F.least(F.greatest(F.coalesce(x, F.lit(0.5)), F.lit(0.0)), F.lit(1.0))


def blended() -> Column:
    return sum((F.lit(w) * F.col(name) for name, w in WEIGHTS.items()), F.lit(0.0))


def score_band(score: Column) -> Column:
    return F.when(score < 0.25, "low").when(score < 0.5, "medium").when(score < 0.75, "high").otherwise("top")


def latency_band(ms: Column) -> Column:
    return F.when(ms <= 10, "le_10").when(ms <= 50, "le_50").when(ms <= 250, "le_250").when(ms <= 1000, "le_1000").otherwise("gt_1000")
