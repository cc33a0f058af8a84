"""Which files can hold rows that satisfy a predicate, decided over the log alone.

A predicate becomes a condition on a file's partition values and statistics. What can't be told keeps
the file; a partition value of NULL fails a comparison, as it would fail the row filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.predicate import And, Boolean, Compare, IsNotNull, IsNull, Or, Predicate, compare, pushed_down

#: Statistics may be cut to milliseconds; a maximum may thus be this much too small.
TIMESTAMP_SLACK_MICROS = 999

_STATS_TYPES = (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType, T.NumericType)


def partition_value(values: Column, name: str, kind: T.DataType) -> Column:
    """A file's typed partition value; missing, null and empty are all NULL, as is what can't be parsed."""
    text = F.nullif(values[name], F.lit(""))
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.BinaryType):
        return text.cast("binary")
    if isinstance(kind, T.TimestampType):
        zoned = F.when(text.rlike(r"(Z|UTC|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
        return zoned.try_cast("timestamp")
    return text.try_cast(kind)


def convertible(p: Predicate, schema: T.StructType) -> bool:
    """Whether a leaf can be decided on statistics or partition values."""
    if not isinstance(p, Compare):
        return True
    if p.literal.signed_zero() or p.literal.problem():
        return False
    return not (p.literal.kind.startswith("decimal(") and p.literal.kind.split(",")[1].startswith("-"))


def pruning_form(p: Predicate, schema: T.StructType) -> tuple[Predicate | None, bool]:
    """(what of the predicate can decide on files, whether that is all of it).

    A conjunction keeps the parts that can; a disjunction needs all of them.
    """
    return _prunable(pushed_down(p), schema)


def _prunable(p: Predicate, schema: T.StructType) -> tuple[Predicate | None, bool]:
    if isinstance(p, (And, Or)):
        done = [_prunable(x, schema) for x in p.parts]
        exact = all(e for _, e in done)
        kept = tuple(x for x, _ in done if x is not None)
        if isinstance(p, Or):
            return (Or(kept), exact) if len(kept) == len(p.parts) else (None, False)
        return (And(kept), exact) if kept or not p.parts else (None, False)
    return (p, True) if convertible(p, schema) else (None, False)


def stats_schema(fields: list[T.StructField], physical: dict[str, str]) -> T.StructType:
    """The shape of the statistics JSON for the columns that a predicate names."""
    typed = [T.StructField(physical[f.name], f.dataType) for f in fields if isinstance(f.dataType, _STATS_TYPES)]
    bounds = T.StructType([f for f in typed if not isinstance(f.dataType, T.BooleanType)])
    counts = T.StructType([T.StructField(physical[f.name], T.LongType()) for f in fields])
    parts = [T.StructField("numRecords", T.LongType()), T.StructField("nullCount", counts)]
    if bounds.fields:
        parts += [T.StructField("minValues", bounds), T.StructField("maxValues", bounds)]
    return T.StructType(parts)


def may_match(p: Predicate, schema: T.StructType, partition_columns: tuple[str, ...], physical: dict[str, str]) -> Column:
    """The condition on (partition_values, s: parsed statistics) under which a file is kept.

    p is a pruning form: without Not, and all its leaves convertible.
    """
    types = {f.name: f.dataType for f in schema.fields}
    if isinstance(p, Boolean):
        return F.lit(p.value)
    if isinstance(p, (And, Or)):
        parts = [may_match(x, schema, partition_columns, physical) for x in p.parts]
        return reduce(lambda a, b: a & b if isinstance(p, And) else a | b, parts) if parts else F.lit(isinstance(p, And))
    name, kind = p.column, types[p.column]
    if name in partition_columns:
        value = partition_value(F.col("partition_values"), physical[name], kind)
        if isinstance(p, IsNull):
            return value.isNull()
        if isinstance(p, IsNotNull):
            return value.isNotNull()
        return F.coalesce(compare(value, p.op, p.literal), F.lit(False))
    nulls, rows = F.col("s")["nullCount"][physical[name]], F.col("s.numRecords")
    if isinstance(p, IsNull):
        return F.coalesce(nulls > 0, F.lit(True))
    if isinstance(p, IsNotNull):
        return F.coalesce(nulls < rows, F.lit(True))
    some = F.coalesce(nulls < rows, F.lit(True))  # a file of NULLs alone satisfies no comparison
    if not isinstance(kind, _STATS_TYPES) or isinstance(kind, T.BooleanType):
        return some
    low, high, lit = F.col("s")["minValues"][physical[name]], F.col("s")["maxValues"][physical[name]], p.literal.column()
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        high = high + F.expr(f"INTERVAL {TIMESTAMP_SLACK_MICROS} MICROSECONDS")
        if p.op == "!=":
            return some
    if isinstance(kind, (T.FloatType, T.DoubleType)) and p.op in (">", ">=", "!="):
        return some  # NaN is above every maximum, and not in the statistics
    fits = {
        "=": F.coalesce(low <= lit, F.lit(True)) & F.coalesce(high >= lit, F.lit(True)),
        "!=": F.coalesce(~((low == lit) & (high == lit)), F.lit(True)),
        "<": F.coalesce(low < lit, F.lit(True)),
        "<=": F.coalesce(low <= lit, F.lit(True)),
        ">": F.coalesce(high > lit, F.lit(True)),
        ">=": F.coalesce(high >= lit, F.lit(True)),
    }
    return some & fits[p.op]


def kept_files(files: DataFrame, p: Predicate | None, schema: T.StructType, partition_columns: tuple[str, ...], physical: dict[str, str]) -> DataFrame:
    """The live files that may hold rows satisfying the predicate."""
    form = pruning_form(p, schema)[0] if p is not None else None
    if form is None:
        return files
    from siltstone.functions.predicate import columns_of

    named = [f for f in schema.fields if f.name in columns_of(form) and f.name not in partition_columns]
    if named:
        files = files.withColumn("s", F.from_json("stats", stats_schema(named, physical), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX"}))
    else:
        files = files.withColumn("s", F.lit(None))
    return files.filter(may_match(form, schema, partition_columns, physical)).drop("s")
