"""Runtime partition pruning: files are admitted by the keys that a join's other side turns out to have."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.errors import UnsupportedPredicate
from siltstone.plans.skipping import partition_value


class Verdict(Enum):
    """Whether a join key can prune, or why not."""

    ACCEPTED = "accepted"
    NO_REFERENCED_COLUMNS = "no_referenced_columns"
    INTERNAL_COLUMN = "internal_column"
    UNKNOWN_COLUMN = "unknown_column"
    DATA_COLUMN = "data_column"
    MIXED_PARTITION_AND_DATA = "mixed_partition_and_data"


@dataclass
class PruningCounters:
    """What runtime pruning did."""

    filters_received: int = 0
    filters_accepted: int = 0
    filters_unsupported: int = 0
    files_kept: int = 0
    files_pruned: int = 0
    key_snapshots: int = 0
    files_without_value: int = 0
    expressions_unsupported: int = 0


def classify(table, columns: list[str]) -> Verdict:
    """Whether a filter over these columns can prune files."""
    names = {f.name for f in table.schema.fields}
    if not columns:
        return Verdict.NO_REFERENCED_COLUMNS
    if any(c.startswith("__siltstone_") for c in columns):
        return Verdict.INTERNAL_COLUMN
    if any(c not in names for c in columns):
        return Verdict.UNKNOWN_COLUMN
    parts = [c in table.partition_columns for c in columns]
    if all(parts):
        return Verdict.ACCEPTED
    return Verdict.MIXED_PARTITION_AND_DATA if any(parts) else Verdict.DATA_COLUMN


def admitted(files: DataFrame, table, column: str, keys: DataFrame) -> DataFrame:
    """The files whose partition value is among the keys; an unknown value keeps its file.

    Keys are joined, not collected; only the log's rows meet them.
    """
    if classify(table, [column]) is not Verdict.ACCEPTED:
        raise UnsupportedPredicate("runtime_filter_unsupported")
    kind = table.schema[column].dataType
    value = partition_value(F.col("partition_values"), table.physical_names()[column], kind)
    known = keys.select(F.col(keys.columns[0]).cast(kind).alias("__key")).filter("__key IS NOT NULL").distinct()
    rows = files.withColumn("__value", value).join(known, F.col("__value") == F.col("__key"), "left")
    return rows.filter("__value IS NULL OR __key IS NOT NULL").drop("__value", "__key")


def join_pruned(table, keys: DataFrame, column: str, projection: list[str] | None = None, counters: PruningCounters | None = None) -> DataFrame:
    """Inner join of the table with `keys` on a same-named column, reading only files that can match."""
    counters = counters if counters is not None else PruningCounters()
    counters.filters_received += 1
    builder = table.scan()
    if projection is not None:
        builder = builder.with_projection(list(dict.fromkeys([*projection, column])))
    if classify(table, [column]) is Verdict.ACCEPTED:
        counters.filters_accepted += 1
        builder = builder.with_partition_keys(column, keys.select(column))
    else:
        counters.filters_unsupported += 1
        counters.expressions_unsupported += column not in table.schema.fieldNames()
    scan = builder.build()
    now = scan.metrics.snapshot()
    counters.files_kept += now.files_planned
    counters.files_pruned += now.files_filtered_during_planning or 0
    if classify(table, [column]) is Verdict.ACCEPTED:
        counters.key_snapshots += 1
        counters.files_without_value += sum(not t.partition_values.get(table.physical_names()[column]) for t in scan.tasks)
    return scan.execute().join(keys, column)
