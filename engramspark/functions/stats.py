"""Exact order statistics by counting."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError

BINS = 4096


def nearest_rank(rows: DataFrame, column: str, percents: Sequence[float]) -> DataFrame:
    """percent, value: the smallest value that at least percent of the rows do not exceed; nulls and NaN do not count, no rows give no rows.

    Exact and without a sort: each pass counts the rows of an interval in BINS bins and goes on in the bin that has the rank, between that
    bin's own smallest and largest value, so that a few passes do whatever the number of rows, and the driver gets a row a bin."""
    if any(not 0 < p <= 100 for p in percents):
        raise ValidationError("percents are above 0 and at most 100")
    spark, x = rows.sparkSession, rows.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    first = x.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    out = [(float(p), _select(x, max(1, ceil(p / 100 * first["n"])), first["lo"], first["hi"])) for p in percents] if first["n"] else []
    return spark.createDataFrame(out, "percent double, value double")


def _select(x: DataFrame, rank: int, lo: float, hi: float) -> float:
    while lo < hi:
        bin_of = F.least(F.floor((F.col("x") - lo) / F.lit(hi - lo) * BINS), F.lit(BINS - 1))
        bins = x.where(F.col("x").between(lo, hi)).groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("bin").collect()
        for r in bins:
            if rank <= r["n"]:
                if (lo, hi) == (r["lo"], r["hi"]):  # the interval is too narrow for bins: its values are its ends
                    low = x.where(F.col("x") == lo).count()
                    return lo if rank <= low else hi
                lo, hi = r["lo"], r["hi"]
                break
            rank -= r["n"]
    return lo
