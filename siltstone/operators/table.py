"""Loading a table version and scanning it: projection, predicate and limit over pruned files."""

from __future__ import annotations

import logging
from collections import defaultdict
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.errors import DataFileRead, InvalidConfiguration, InvalidProjection, ReaderError, ScanPlanning, SchemaConversion, StorageInitialization, UnsupportedBackend
from siltstone.functions.predicate import Predicate, columns_of, to_column, validate
from siltstone.metrics import MetricsHandle, ReadMetrics
from siltstone.options import Backend, ExecutionOptions, Repartitioning
from siltstone.plans.partitioning import Target, host_diagnostics, ranges, target_partitions, total
from siltstone.plans.skipping import kept_files, partition_value
from siltstone.sources import log
from siltstone.sources.deletion_vectors import deleted_rows
from siltstone.sources.files import data_file, file_key, normalized_uri
from siltstone.sources.protocol import ProtocolInfo
from siltstone.sources.reconcile import footers, read_plan

_LOG = logging.getLogger("siltstone")

#: Up to so many distinct partition tuples become literals, which Catalyst folds; more are joined.
LITERAL_TUPLES = 32
#: Rows of file metadata, and of deleted rows, up to which a join is told to broadcast them.
BROADCAST_FILES = 20_000
BROADCAST_DELETED = 1_000_000
KEY, ROW = "__siltstone_file", "__siltstone_row"


class TableBuilder:
    """Collects what is needed to load a table."""

    def __init__(self, spark: SparkSession, uri: str):
        self._spark, self._uri = spark, uri
        self._storage: dict[str, str] = {}
        self._version: int | None = None
        self._execution = ExecutionOptions()

    def with_storage_options(self, options: dict[str, str]) -> TableBuilder:
        """Hadoop configuration keys for the table's file system."""
        self._storage = dict(options)
        return self

    def with_version(self, version: int | None) -> TableBuilder:
        """An exact version, or None for the latest."""
        if version is not None and version < 0:
            raise InvalidConfiguration("snapshot_version_must_not_be_negative")
        self._version = version
        return self

    def with_execution_options(self, options: ExecutionOptions) -> TableBuilder:
        self._execution = options
        return self

    def load_snapshot(self) -> TableSnapshot:
        """Replay the log; protocol and metadata can be looked at before the schema is built."""
        uri = normalized_uri(self._uri)
        if any(not isinstance(x, str) for pair in self._storage.items() for x in pair):
            raise StorageInitialization("storage_options_invalid")
        _LOG.debug("snapshot_load.started")
        try:
            found = log.load(self._spark, uri, self._version, self._storage)
        except ReaderError as error:
            _LOG.debug("snapshot_load.failed kind=%s", error.kind)
            raise
        _LOG.debug("snapshot_load.completed version=%d", found.version)
        return TableSnapshot(self._spark, found, self._execution)

    def load(self) -> Table:
        return self.load_snapshot().into_table()

    def load_async(self) -> Future[Table]:
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(self.load)
        finally:
            pool.shutdown(wait=False)


class TableSnapshot:
    """A loaded version whose schema has not been built yet."""

    def __init__(self, spark: SparkSession, snapshot: log.Snapshot, execution: ExecutionOptions):
        self._spark, self._snapshot, self._execution = spark, snapshot, execution

    @property
    def version(self) -> int:
        return self._snapshot.version

    @property
    def protocol(self) -> ProtocolInfo:
        return self._snapshot.protocol

    def into_table(self) -> Table:
        try:
            schema = self._snapshot.schema()
        except Exception as error:
            raise SchemaConversion("schema_conversion_failed") from error
        return Table(self._spark, self._snapshot, schema, self._execution)


@dataclass(frozen=True)
class Table:
    """An immutable version of a table."""

    spark: SparkSession
    snapshot: log.Snapshot
    schema: T.StructType
    execution: ExecutionOptions

    @property
    def version(self) -> int:
        return self.snapshot.version

    @property
    def protocol(self) -> ProtocolInfo:
        return self.snapshot.protocol

    @property
    def partition_columns(self) -> tuple[str, ...]:
        return self.snapshot.partition_columns

    def physical_names(self) -> dict[str, str]:
        """Logical to physical names of top-level columns."""
        mapped = self.snapshot.mapping_mode in ("name", "id")
        return {f.name: (f.metadata or {}).get("delta.columnMapping.physicalName", f.name) if mapped else f.name for f in self.schema.fields}

    def scan(self) -> ScanBuilder:
        return ScanBuilder(self)

    def to_df(self) -> DataFrame:
        return self.scan().build().execute()


@dataclass(frozen=True)
class FileTask:
    """One file to read."""

    path: str
    size: int
    partition_values: dict[str, str | None]
    records: int | None
    dv: dict | None


class ScanBuilder:
    """Projection, predicate and limit of a scan."""

    def __init__(self, table: Table):
        self._table = table
        self._projection: list[str] | None = None
        self._predicate: Predicate | None = None
        self._limit: int | None = None
        self._target: int | None = None
        self._execution = table.execution
        self._repartitioning: Repartitioning | None = None
        self._keys: list[tuple[str, DataFrame]] = []

    def with_projection(self, columns: list[str]) -> ScanBuilder:
        self._projection = list(columns)
        return self

    def with_projection_indexes(self, indexes: list[int]) -> ScanBuilder:
        """As with_projection, by places in the schema."""
        names = self._table.schema.fieldNames()
        if any(not 0 <= i < len(names) for i in indexes):
            raise InvalidProjection("projection_index_out_of_bounds")
        return self.with_projection([names[i] for i in indexes])

    def with_predicate(self, predicate: Predicate | None) -> ScanBuilder:
        self._predicate = predicate
        return self

    def with_limit(self, limit: int | None) -> ScanBuilder:
        self._limit = limit
        return self

    def with_target_partitions(self, target: int | None) -> ScanBuilder:
        """At most so many tasks; with rebalancing just so many."""
        self._target = target
        return self

    def with_repartitioning(self, policy: Repartitioning | None) -> ScanBuilder:
        """Rebalancing deals the rows evenly among the target's partitions, by a shuffle; else files are only put together."""
        self._repartitioning = policy
        return self

    def with_execution_options(self, options: ExecutionOptions) -> ScanBuilder:
        self._execution = options
        return self

    def with_partition_keys(self, column: str, keys: DataFrame) -> ScanBuilder:
        """Read only files whose value of the partition column is among the keys (one column), or unknown."""
        self._keys.append((column, keys))
        return self

    def build(self) -> Scan:
        """Validate, prune and list the files; no data file is read."""
        table = self._table
        table.protocol.validate()
        names = [f.name for f in table.schema.fields]
        check_backend(table.spark, self._execution.reader_backend)
        projection = names if self._projection is None else self._projection
        if len(set(projection)) != len(projection):
            raise InvalidProjection("duplicate_column")
        if any(c not in names for c in projection):
            raise InvalidProjection("column_not_found")
        if self._limit is not None and self._limit < 0:
            raise InvalidConfiguration("limit_must_not_be_negative")
        if self._predicate is not None:
            validate(self._predicate, table.schema)
        physical = table.physical_names()
        _LOG.debug("scan_plan.started version=%d", table.version)
        seen = Observation()
        files = table.snapshot.files.observe(seen, F.count(F.lit(1)).alias("files"))  # the log is replayed once
        kept = kept_files(files, self._predicate, table.schema, table.partition_columns, physical)
        for column, keys in self._keys:
            from siltstone.operators.dynamic import admitted

            kept = admitted(kept, table, column, keys)
        try:
            rows = kept.select("path", "size", "partition_values", F.get_json_object("stats", "$.numRecords").cast("long").alias("records"), "dv").collect()
            rows.sort(key=lambda r: r["path"])
            found = observed(seen, "files")  # nothing where the predicate admits no file at all
            pruned = (table.snapshot.files.count() if found is None else found) - len(rows)
        except Exception as error:
            _LOG.debug("scan_plan.failed")
            raise ScanPlanning("scan_metadata_failed") from error
        if any(r["size"] is None or r["size"] < 0 for r in rows):
            raise ScanPlanning("negative_file_size")
        tasks = [FileTask(r["path"], r["size"], dict(r["partition_values"] or {}), r["records"], r["dv"].asDict() if r["dv"] else None) for r in rows]
        host = host_diagnostics()
        target = target_partitions(explicit=self._target, parallelism=table.spark.sparkContext.defaultParallelism, file_descriptors=host["file_descriptors"], memory_bytes=host["memory_bytes"])
        metrics = ReadMetrics(
            table.version,
            self._execution.reader_backend,
            scan_metadata_exhausted=True,
            scan_partitions_planned=min(target.target_partitions, len(tasks)),
            files_planned=len(tasks),
            files_filtered_during_planning=pruned,
            estimated_rows=total([t.records for t in tasks]),
            estimated_bytes=total([t.size for t in tasks]),
        )
        _LOG.debug("scan_plan.completed files=%d pruned=%d", len(tasks), pruned)
        return Scan(table, projection, self._predicate, self._limit, tasks, MetricsHandle(metrics), self._execution, target, self._repartitioning or Repartitioning.FILL_MISSING_PARALLELISM)


@dataclass(frozen=True)
class Scan:
    """A planned scan. execute() gives a lazy DataFrame."""

    table: Table
    projection: list[str]
    predicate: Predicate | None
    limit: int | None
    tasks: list[FileTask]
    metrics: MetricsHandle
    execution: ExecutionOptions
    target: Target
    repartitioning: Repartitioning

    def partition_plan(self) -> list[list[tuple[int, int, int]]]:
        """How the files' bytes fall into the target's partitions: (task, start, end); Spark packs by its own rule."""
        return ranges([t.size for t in self.tasks], self.target.target_partitions, self.repartitioning is Repartitioning.REBALANCE)

    @property
    def schema(self) -> T.StructType:
        by_name = {f.name: f for f in self.table.schema.fields}
        return T.StructType([by_name[c] for c in self.projection])

    def execute(self, observe: bool = False) -> DataFrame:
        """The rows. With observe, metrics tell the rows produced after an action on the DataFrame.

        Files that differ in shape, and those with deletion vectors, are read apart and put together.
        """
        spark, table = self.table.spark, self.table
        needed = list(dict.fromkeys([*self.projection, *(columns_of(self.predicate) if self.predicate is not None else [])]))
        fields = [f for f in table.schema.fields if f.name in needed]
        tasks = [] if self.limit == 0 else self.tasks
        _LOG.debug("scan.started files=%d", len(tasks))
        counts: list[tuple[Observation, Observation]] = []
        if not tasks:
            frame = spark.createDataFrame([], T.StructType([replace_nullable(f) for f in fields]))
        else:
            frame = self._read(fields, tasks, counts if observe else None)
        if self.target.source == "explicit_override" and tasks:
            wanted = self.target.target_partitions
            frame = frame.repartition(wanted) if self.repartitioning is Repartitioning.REBALANCE else frame.coalesce(wanted)
        frame = frame.select(*[F.col(_quoted(c)) for c in self.projection])
        if self.limit is not None:
            frame = frame.limit(self.limit)
        if observe:
            seen = Observation()
            frame = frame.observe(seen, F.count(F.lit(1)).alias("rows"))
            object.__setattr__(self, "_seen", (seen, counts, len(tasks)))
        return frame

    def finish(self) -> ReadMetrics:
        """Metrics after an action on the observed DataFrame (waits for one)."""
        seen, counts, files = self._seen
        rows = observed(seen, "rows") or 0
        deleted = sum((observed(before, "rows") or 0) - (observed(after, "rows") or 0) for before, after in counts)
        whole = files if not self.limit else None  # a limit may stop before all files are read
        vectors = sum(1 for t in self.tasks if t.dv) if files else 0
        self.metrics.update(rows_produced=rows, files_started=whole, files_completed=whole, deletion_vectors_applied=vectors if whole is not None else None, deletion_vector_rows_deleted=deleted)
        _LOG.debug("scan.completed rows=%d", rows)
        return self.metrics.snapshot()

    def _read(self, fields: list[T.StructField], tasks: list[FileTask], counts: list | None) -> DataFrame:
        spark, table = self.table.spark, self.table
        physical = table.physical_names()
        mapped = table.snapshot.mapping_mode in ("name", "id")
        own = [f if mapped else T.StructField(f.name, f.dataType, f.nullable) for f in fields]
        data = [f for f in own if f.name not in table.partition_columns]
        parts = [f for f in own if f.name in table.partition_columns]
        resolved = {t.path: data_file(table.snapshot.uri, t.path) for t in tasks}
        shapes = dict(zip([t.path for t in tasks], footers(spark, [resolved[t.path][0] for t in tasks], table.snapshot.storage, table.snapshot.shapes), strict=True))
        tuple_of = lambda t: tuple(t.partition_values.get(physical[f.name]) or None for f in parts)
        literal = len({tuple_of(t) for t in tasks}) <= LITERAL_TUPLES
        groups: dict[tuple, list[FileTask]] = defaultdict(list)
        for t in tasks:
            groups[shapes[t.path], tuple_of(t) if literal else None, t.dv is not None].append(t)
        gone = self._deleted(tasks, resolved)
        frames = []
        for (shape, values, with_dv), members in groups.items():
            plan = read_plan(data, shape)
            keyed = with_dv or (parts and not literal)
            try:
                rows = spark.read.options(**table.snapshot.storage).schema(plan.read_schema).parquet(*dict.fromkeys(resolved[t.path][0] for t in members))
            except Exception as error:
                raise DataFileRead("data_file_read_failed") from error
            marks = [file_key().alias(KEY), F.col("_metadata.row_index").alias(ROW)] if keyed else []
            rows = rows.select(*plan.columns, *marks)
            if parts and literal:
                known = F.create_map(*[x for f, v in zip(parts, values, strict=True) for x in (F.lit(physical[f.name]), F.lit(v).cast("string"))])
                rows = rows.select("*", *[partition_value(known, physical[f.name], f.dataType).alias(f.name) for f in parts])
            elif parts:
                rows = rows.join(self._file_values(parts, members, resolved, physical), KEY)
            if self.predicate is not None:
                rows = rows.filter(to_column(self.predicate, lambda c: F.col(_quoted(c))))
            if with_dv:
                sides = (Observation(), Observation())
                if counts is not None:
                    counts.append(sides)
                    rows = rows.observe(sides[0], F.count(F.lit(1)).alias("rows"))
                rows = rows.join(gone, [KEY, ROW], "left_anti")
                if counts is not None:
                    rows = rows.observe(sides[1], F.count(F.lit(1)).alias("rows"))
            frames.append(rows.select(*[F.col(_quoted(f.name)) for f in fields]))
        return reduce(DataFrame.unionAll, frames)

    def _file_values(self, parts: list[T.StructField], members: list[FileTask], resolved: dict, physical: dict[str, str]) -> DataFrame:
        """(file, typed partition values) of many files; told to broadcast up to a checked number."""
        rows = [(resolved[t.path][1], {physical[f.name]: t.partition_values.get(physical[f.name]) for f in parts}) for t in members]
        values = self.table.spark.createDataFrame(rows, f"{KEY} string, v map<string,string>")
        typed = values.select(KEY, *[partition_value(F.col("v"), physical[f.name], f.dataType).alias(f.name) for f in parts])
        return F.broadcast(typed) if len(rows) <= BROADCAST_FILES else typed

    def _deleted(self, tasks: list[FileTask], resolved: dict) -> DataFrame | None:
        vectors = [t.dv | {"file_key": resolved[t.path][1], "num_records": t.records} for t in tasks if t.dv]
        if not vectors:
            return None
        try:
            rows = deleted_rows(self.table.spark, self.table.snapshot.uri, vectors, self.table.snapshot.storage)
        except ReaderError:
            self.metrics.update(deletion_vector_failures=self.metrics.snapshot().deletion_vector_failures + 1)
            raise
        known = [v["cardinality"] if v["cardinality"] is not None else v["num_records"] for v in vectors]
        count = sum(known) if None not in known else BROADCAST_DELETED + 1
        self.metrics.update(deletion_vector_payloads_loaded=len(vectors))
        rows = rows.select(F.col("file_key").alias(KEY), F.col("row_index").alias(ROW))
        return F.broadcast(rows) if count <= BROADCAST_DELETED else rows


def observed(seen: Observation, name: str) -> int | None:
    """What an observation counted in an action that is over; None if the optimizer left its part of the plan out."""
    try:
        return seen.get[name]
    except Py4JJavaError:
        return None


def replace_nullable(field: T.StructField) -> T.StructField:
    return T.StructField(field.name, field.dataType, True)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def check_backend(spark: SparkSession, backend: Backend) -> None:
    """The row-at-a-time backend is the session's own reader and must have been switched on by row_reader."""
    if backend is Backend.OFFICIAL_KERNEL and spark.conf.get("spark.sql.parquet.enableVectorizedReader") == "true":
        raise UnsupportedBackend("official_kernel_backend_not_enabled")


def batch_size(spark: SparkSession, rows: int) -> None:
    """Rows that Spark's vectorised Parquet reader decodes at once."""
    if rows < 1:
        raise InvalidConfiguration("batch_size_must_be_positive")
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(rows))


def row_reader(spark: SparkSession, on: bool = True) -> None:
    """Have Spark decode Parquet row by row (the OFFICIAL_KERNEL backend's way), or vectorised again."""
    spark.conf.set("spark.sql.parquet.enableVectorizedReader", str(not on).lower())


__all__ = ["Backend", "Scan", "ScanBuilder", "Table", "TableBuilder", "TableSnapshot", "batch_size", "row_reader"]
