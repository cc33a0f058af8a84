"""A strictly typed predicate tree over top-level columns, compiled to Spark columns.

No literal is coerced. NULL follows Kleene logic. -0.0 and 0.0 differ, and a NaN in a column is above
every number; both are rewritten, since neither Spark's comparison nor its row-group statistics agree.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.errors import UnsupportedPredicate

#: Operators and what they become when negated or with sides exchanged.
NEGATED = {"=": "!=", "!=": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
EXCHANGED = {"=": "=", "!=": "!=", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


@dataclass(frozen=True)
class Scalar:
    """A literal of one exact type: kind is a Spark type name, or fixed_binary(n)."""

    kind: str
    value: object
    size: int | None = None

    @staticmethod
    def decimal(value: str | decimal.Decimal, precision: int, scale: int) -> Scalar:
        return Scalar(f"decimal({precision},{scale})", decimal.Decimal(value))

    def problem(self) -> str | None:
        """The reason for which the literal itself is refused."""
        if self.kind in ("float", "double") and not math.isfinite(self.value):
            return "non_finite_float"
        if self.kind.startswith("decimal("):
            p, s = map(int, self.kind[8:-1].split(","))
            if not 1 <= p <= 38 or s > p or not self.value.is_finite():
                return "invalid_decimal"
            shifted = self.value.scaleb(s)
            if shifted != shifted.to_integral_value() or abs(shifted) >= 10**p:
                return "invalid_decimal"
        if self.kind == "fixed_binary" and (self.size is None or self.size < 0 or len(self.value) != self.size):
            return "invalid_fixed_size_binary"
        return None

    def signed_zero(self) -> bool:
        return self.kind in ("float", "double") and self.value == 0

    def column(self) -> Column:
        if self.kind == "fixed_binary":
            return F.lit(bytearray(self.value))
        if self.kind == "binary":
            return F.lit(bytearray(self.value))
        if self.kind == "timestamp":
            value = self.value
            utc = value.replace(tzinfo=dt.UTC) if value.tzinfo is None else value.astimezone(dt.UTC)
            return F.timestamp_micros(F.lit(round((utc - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) / dt.timedelta(microseconds=1))))
        if self.kind == "timestamp_ntz":
            return F.lit(self.value.isoformat(sep=" ")).cast("timestamp_ntz")
        return F.lit(self.value).cast(self.kind)


class Predicate:
    """Base of the tree; combine with &, | and ~."""

    def __and__(self, other: Predicate) -> Predicate:
        return And((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)


@dataclass(frozen=True)
class Boolean(Predicate):
    value: bool


@dataclass(frozen=True)
class Compare(Predicate):
    column: str
    op: str
    literal: Scalar


@dataclass(frozen=True)
class IsNull(Predicate):
    column: str


@dataclass(frozen=True)
class IsNotNull(Predicate):
    column: str


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...] = field(default=())


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple[Predicate, ...] = field(default=())


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate


def between(column: str, low: Scalar, high: Scalar) -> Predicate:
    return And((Compare(column, ">=", low), Compare(column, "<=", high)))


def is_in(column: str, literals: list[Scalar]) -> Predicate:
    """No literal: no row."""
    if not literals:
        return And((Boolean(False), IsNotNull(column)))
    return Or(tuple(Compare(column, "=", x) for x in literals))


def not_in(column: str, literals: list[Scalar]) -> Predicate:
    """No literal: every row whose column is not NULL."""
    return And(tuple(Compare(column, "!=", x) for x in literals)) if literals else IsNotNull(column)


def leaves(p: Predicate):
    """Every node without parts, in order."""
    if isinstance(p, (And, Or)):
        for x in p.parts:
            yield from leaves(x)
    elif isinstance(p, Not):
        yield from leaves(p.part)
    else:
        yield p


def columns_of(p: Predicate) -> list[str]:
    """Names in order of appearance."""
    return list(dict.fromkeys(x.column for x in leaves(p) if not isinstance(x, Boolean)))


def type_kind(kind: T.DataType) -> str:
    return kind.simpleString()


def validate(p: Predicate, schema: T.StructType) -> None:
    """Check every branch; raise for the first that is refused."""
    for x in leaves(p):
        if isinstance(x, Boolean):
            continue
        if not x.column or "." in x.column:
            raise UnsupportedPredicate("invalid_column_reference")
        found = [f for f in schema.fields if f.name == x.column]
        if len(found) != 1:
            raise UnsupportedPredicate("column_not_found" if not found else "ambiguous_column")
        if not isinstance(x, Compare):
            continue
        if x.op not in NEGATED:
            raise UnsupportedPredicate("unsupported_operator")
        if problem := x.literal.problem():
            raise UnsupportedPredicate(problem)
        kind, own = type_kind(found[0].dataType), x.literal.kind
        if {kind, own} == {"timestamp", "timestamp_ntz"}:
            raise UnsupportedPredicate("invalid_timestamp_timezone")
        aware = own == "timestamp" and x.literal.value.tzinfo is not None and x.literal.value.utcoffset() != dt.timedelta(0)
        if own == "timestamp_ntz" and x.literal.value.tzinfo is not None or aware:
            raise UnsupportedPredicate("invalid_timestamp_timezone")
        if kind != own and not (kind == "binary" and own == "fixed_binary"):
            raise UnsupportedPredicate("scalar_type_mismatch")


def pushed_down(p: Predicate, negate: bool = False) -> Predicate:
    """The same predicate without Not: negation moved to the leaves, which keeps three-valued results."""
    if isinstance(p, Not):
        return pushed_down(p.part, not negate)
    if isinstance(p, (And, Or)):
        kind = type(p) if not negate else (Or if isinstance(p, And) else And)
        return kind(tuple(pushed_down(x, negate) for x in p.parts))
    if not negate:
        return p
    if isinstance(p, Boolean):
        return Boolean(not p.value)
    if isinstance(p, Compare):
        return Compare(p.column, NEGATED[p.op], p.literal)
    return IsNotNull(p.column) if isinstance(p, IsNull) else IsNull(p.column)


def compare(v: Column, op: str, literal: Scalar) -> Column:
    """One comparison, with signed zeros told apart and NaN above all numbers."""
    floating = literal.kind in ("float", "double")
    if floating and literal.value == 0:
        text = v.cast("string")
        negative = math.copysign(1, literal.value) < 0
        nz, pz, below, above = text == "-0.0", text == "0.0", v < 0, (v > 0) | F.isnan(v)
        nulls = F.when(v.isNull(), F.lit(None).cast("boolean"))
        table = {
            "=": nz if negative else pz,
            "!=": ~(nz if negative else pz),
            "<": below if negative else below | nz,
            "<=": below | nz if negative else below | nz | pz,
            ">": above | pz if negative else above,
            ">=": above | nz | pz if negative else above | pz,
        }
        return nulls.otherwise(table[op])
    lit = literal.column()
    plain = {"=": v == lit, "!=": v != lit, "<": v < lit, "<=": v <= lit, ">": v > lit, ">=": v >= lit}[op]
    if floating and op in (">", ">=", "!="):
        return plain | F.isnan(v) & v.isNotNull()
    return plain


def to_column(p: Predicate, named=F.col) -> Column:
    """The predicate as a Spark column; named maps a column's name to its value."""
    if isinstance(p, Boolean):
        return F.lit(p.value)
    if isinstance(p, Compare):
        return compare(named(p.column), p.op, p.literal)
    if isinstance(p, IsNull):
        return named(p.column).isNull()
    if isinstance(p, IsNotNull):
        return named(p.column).isNotNull()
    if isinstance(p, Not):
        return ~to_column(p.part, named)
    parts = [to_column(x, named) for x in p.parts]
    if not parts:
        return F.lit(isinstance(p, And))
    return reduce(lambda a, b: a & b if isinstance(p, And) else a | b, parts)
