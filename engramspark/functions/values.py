"""Property values as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LONG = float(2**63)


def as_double(v: Column) -> Column:
    """Integer or Float as a double; else null."""
    return F.when(v["kind"] == "Integer", v["i"].cast("double")).when(v["kind"] == "Float", v["f"])


def as_long(v: Column) -> Column:
    """Integer, or Float cut towards zero, clamped to the range, NaN as 0; else null."""
    f = v["f"]
    inside = F.when((f < _LONG) & (f > -_LONG), f).cast("long")
    return F.when(v["kind"] == "Integer", v["i"]).when(
        v["kind"] == "Float", F.when(F.isnan(f), F.lit(0).cast("long")).when(f >= _LONG, F.lit(2**63 - 1)).when(f <= -_LONG, F.lit(-(2**63))).otherwise(inside)
    )
