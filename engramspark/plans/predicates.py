"""Predicate trees compiled to columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil, floor

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.values import as_double
from ..model import KINDS, wrap

COMPARISONS = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}
#: Fields with a plain column for their numeric value.
PLAIN = {"importance": "importance", "confidence": "confidence"}
#: The timestamp's plain column is whole milliseconds, so it bounds a comparison, and reaches the scan, but does not decide it.
MILLISECONDS = float(2**53)


@dataclass(frozen=True)
class Predicate:
    """op is eq, gt, gte, lt, lte (field, value) or and, or (conditions)."""

    op: str
    field: str = ""
    value: object = None
    conditions: tuple[Predicate, ...] = ()

    @staticmethod
    def parse(tree: dict) -> Predicate:
        if "op" not in tree:
            raise ValidationError("a filter needs an op")
        return Predicate(tree["op"], tree.get("field", ""), tree.get("value"), tuple(map(Predicate.parse, tree.get("conditions", ()))))

    def validate(self) -> Predicate:
        if self.op in ("and", "or"):
            if not self.conditions:
                raise ValidationError(f"{self.op} needs at least one condition")
            for x in self.conditions:
                x.validate()
        elif self.op in ("eq", *COMPARISONS):
            if not self.field or not self.field.strip():
                raise ValidationError("filter field cannot be empty")
            if self.op != "eq" and wrap(self.value)["kind"] not in ("Integer", "Float"):
                raise ValidationError(f"{self.op} needs a numeric value")
            wrap(self.value)
        else:
            raise ValidationError(f"unknown filter op: {self.op}")
        return self

    def leaves(self) -> int:
        return sum(x.leaves() for x in self.conditions) if self.op in ("and", "or") else 1

    def _bounded(self, compared: Column, content: float) -> Column:
        """A condition on the timestamp with one on its plain column, which is within 1 of it for numbers in range."""
        if self.field != "timestamp" or not abs(content) < MILLISECONDS:
            return compared
        at, low, high = F.col("timestamp_ms"), F.lit(floor(content) - 1), F.lit(ceil(content) + 1)
        near = at.between(low, high) if self.op == "eq" else at >= low if self.op in ("gt", "gte") else at <= high
        return compared & near

    def compile(self) -> Column:
        """True or false, never null: a missing property matches nothing."""
        if self.op in ("and", "or"):
            return reduce((lambda a, b: a & b) if self.op == "and" else (lambda a, b: a | b), [x.compile() for x in self.conditions])
        literal, prop = wrap(self.value), F.col("properties")[self.field]
        content = literal[KINDS[literal["kind"]]]
        if self.op != "eq":
            number = F.col(PLAIN[self.field]) if self.field in PLAIN else as_double(prop)
            compared = self._bounded(COMPARISONS[self.op](number, F.lit(float(content))) & ~F.isnan(number), float(content))
            return F.lit(False) if content != content else F.coalesce(compared, F.lit(False))
        if literal["kind"] in ("Integer", "Float"):
            number = F.col(PLAIN[self.field]) if self.field in PLAIN else as_double(prop)
            same = self._bounded(number == F.lit(float(content)), float(content)) if content == content else F.lit(False)
        elif literal["kind"] == "String" and self.field == "unique_key":
            same = F.col("unique_key") == F.lit(content)
        else:
            expected = F.array(*map(F.lit, content)).cast("array<string>" if literal["kind"] == "StringList" else "array<float>") if isinstance(content, list) else F.lit(content)
            same = (prop["kind"] == literal["kind"]) & (prop[KINDS[literal["kind"]]] == expected)
        same = F.coalesce(same, F.lit(False))
        record = {"id": "id", "label": "node_type"}.get(self.field)
        if record and literal["kind"] == "String":
            same = F.coalesce(F.col(record) == F.lit(content), F.lit(False)) | same
        return same


def eq(field: str, value: object) -> Predicate:
    return Predicate("eq", field, value)


def gt(field: str, value: object) -> Predicate:
    return Predicate("gt", field, value)


def gte(field: str, value: object) -> Predicate:
    return Predicate("gte", field, value)


def lt(field: str, value: object) -> Predicate:
    return Predicate("lt", field, value)


def lte(field: str, value: object) -> Predicate:
    return Predicate("lte", field, value)


def all_of(*conditions: Predicate) -> Predicate:
    return Predicate("and", conditions=conditions)


def any_of(*conditions: Predicate) -> Predicate:
    return Predicate("or", conditions=conditions)
