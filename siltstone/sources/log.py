"""Replay of the transaction log as DataFrames: the newest action on each file wins."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.errors import SnapshotLoad
from siltstone.sources.files import Folder, s3_auth_mode
from siltstone.sources.protocol import ProtocolInfo

_DV = "struct<storageType:string,pathOrInlineDv:string,offset:int,sizeInBytes:int,cardinality:bigint>"
_ADD = f"struct<path:string,partitionValues:map<string,string>,size:bigint,modificationTime:bigint,stats:string,deletionVector:{_DV}>"
_REMOVE = f"struct<path:string,deletionVector:{_DV}>"
_PROTOCOL = "struct<minReaderVersion:int,minWriterVersion:int,readerFeatures:array<string>,writerFeatures:array<string>>"
_META = "struct<id:string,name:string,schemaString:string,partitionColumns:array<string>,configuration:map<string,string>>"
ACTIONS = f"add {_ADD}, remove {_REMOVE}, protocol {_PROTOCOL}, metaData {_META}"
_SIDECAR = "sidecar struct<path:string,sizeInBytes:bigint>"

_COMMIT = re.compile(r"(\d{20})\.json")
_CLASSIC = re.compile(r"(\d{20})\.checkpoint\.parquet")
_PART = re.compile(r"(\d{20})\.checkpoint\.(\d{10})\.(\d{10})\.parquet")
_V2 = re.compile(r"(\d{20})\.checkpoint\.[0-9a-fA-F-]{36}\.(json|parquet)")


@dataclass(frozen=True)
class Segment:
    """The log files that make up one version."""

    version: int
    checkpoint_version: int | None
    checkpoint_files: tuple[str, ...]
    commits: tuple[str, ...]


def segment(names: list[str], version: int | None = None) -> Segment:
    """The newest complete checkpoint up to the version, and the commits after it; gaps are errors."""
    commits = {int(m[1]): m[0] for n in names if (m := _COMMIT.fullmatch(n))}
    complete: dict[int, tuple[str, ...]] = {}
    parts: dict[tuple[int, int], dict[int, str]] = {}
    for n in names:
        if m := _PART.fullmatch(n):
            parts.setdefault((int(m[1]), int(m[3])), {})[int(m[2])] = n
        elif m := _V2.fullmatch(n):
            complete.setdefault(int(m[1]), (n,))
    for (v, count), found in parts.items():
        if sorted(found) == list(range(1, count + 1)):
            complete[v] = tuple(found[i] for i in range(1, count + 1))
    for n in names:
        if m := _CLASSIC.fullmatch(n):
            complete[int(m[1])] = (n,)
    known = [*commits, *complete]
    if not known:
        raise SnapshotLoad("snapshot_load_failed")
    last = max(known) if version is None else version
    base = max((v for v in complete if v <= last), default=None)
    needed = range(0 if base is None else base + 1, last + 1)
    if last < 0 or any(v not in commits for v in needed):
        raise SnapshotLoad("snapshot_load_failed")
    return Segment(last, base, complete.get(base, ()) if base is not None else (), tuple(commits[v] for v in needed))


def _of_commits(spark: SparkSession, log: str, names: tuple[str, ...], options: dict[str, str]) -> DataFrame:
    rows = spark.read.options(**options).schema(ACTIONS).json([f"{log}/{n}" for n in names])
    version = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d{20})", 1).cast("long")
    return rows.select(version.alias("version"), "*")


def _of_checkpoint(spark: SparkSession, log: str, part: Segment, options: dict[str, str]) -> DataFrame:
    def read(paths: list[str], schema: str) -> DataFrame:
        reader = spark.read.options(**options).schema(schema)
        return reader.json(paths) if paths[0].endswith(".json") else reader.parquet(*paths)

    main = [f"{log}/{n}" for n in part.checkpoint_files]
    rows = read(main, ACTIONS)
    if _V2.fullmatch(part.checkpoint_files[0]):
        found = [r[0] for r in read(main, _SIDECAR).filter("sidecar.path IS NOT NULL").select("sidecar.path").distinct().collect()]
        if found:  # as many as the checkpoint has pieces
            rows = rows.unionByName(spark.read.options(**options).schema(ACTIONS).parquet(*[p if "/" in p else f"{log}/_sidecars/{p}" for p in sorted(found)]))
    return rows.select(F.lit(part.checkpoint_version).cast("long").alias("version"), "*")


@dataclass(frozen=True)
class Snapshot:
    """One version's protocol, metadata and (as a lazy DataFrame) live files."""

    uri: str
    version: int
    protocol: ProtocolInfo
    schema_string: str
    partition_columns: tuple[str, ...]
    configuration: dict[str, str]
    files: DataFrame
    storage: dict[str, str] = field(default_factory=dict)
    shapes: dict[str, str] = field(default_factory=dict, compare=False, repr=False)  # footers read so far, by file

    @property
    def mapping_mode(self) -> str:
        return self.configuration.get("delta.columnMapping.mode", "none").lower()

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema_string))


def load(spark: SparkSession, uri: str, version: int | None = None, options: dict[str, str] | None = None) -> Snapshot:
    """Replay the log of the table at the (normalised) address."""
    log, own = f"{uri}/_delta_log", dict(options or {})
    try:
        part = segment(Folder(spark, log, own).names(), version)
        sources = [_of_commits(spark, log, part.commits, own)] if part.commits else []
        if part.checkpoint_files:
            sources.append(_of_checkpoint(spark, log, part, own))
        actions = reduce(DataFrame.unionByName, sources)
        head = actions.agg(
            F.max_by("protocol", F.when(F.col("protocol").isNotNull(), F.col("version"))).alias("protocol"),
            F.max_by("metaData", F.when(F.col("metaData").isNotNull(), F.col("version"))).alias("meta"),
        ).first()
    except SnapshotLoad as error:
        raise SnapshotLoad(_reason(uri, options)) from error
    except Exception as error:
        raise SnapshotLoad(_reason(uri, options)) from error
    if head.protocol is None or head.meta is None:
        raise SnapshotLoad("snapshot_load_failed")
    protocol = ProtocolInfo(part.version, head.protocol.minReaderVersion, head.protocol.minWriterVersion, tuple(head.protocol.readerFeatures or ()), tuple(head.protocol.writerFeatures or ()))
    if protocol.min_reader_version > 3 and protocol.min_writer_version >= 7:
        raise SnapshotLoad("snapshot_load_failed")  # such a protocol can't even be looked at
    return Snapshot(uri, part.version, protocol, head.meta.schemaString, tuple(head.meta.partitionColumns or ()), dict(head.meta.configuration or {}), live_files(actions), own)


def _reason(uri: str, options: dict[str, str] | None) -> str:
    implicit = s3_auth_mode(uri, options or {}) == "implicit_provider_chain"
    return "snapshot_load_failed_with_implicit_s3_credentials" if implicit else "snapshot_load_failed"


def live_files(actions: DataFrame) -> DataFrame:
    """One row per live file: path, partition_values, size, stats (JSON), dv.

    Actions on a file with one deletion vector, or with none, replace each other; one shuffle with
    partial aggregation finds the newest.
    """
    change = F.coalesce(F.col("add.path"), F.col("remove.path"))
    dv = F.coalesce(F.col("add.deletionVector"), F.col("remove.deletionVector"))
    dv_key = F.when(dv.isNotNull(), F.concat(dv["storageType"], dv["pathOrInlineDv"], F.coalesce(F.concat(F.lit("@"), dv["offset"].cast("string")), F.lit(""))))
    keyed = actions.select("version", change.alias("path"), F.coalesce(dv_key, F.lit("")).alias("dv_key"), F.struct("add").alias("state")).filter("path IS NOT NULL")
    newest = keyed.groupBy("path", "dv_key").agg(F.max_by("state", "version").alias("state")).filter("state.add IS NOT NULL")
    add = F.col("state.add")
    return newest.select("path", add["partitionValues"].alias("partition_values"), add["size"].alias("size"), add["stats"].alias("stats"), add["deletionVector"].alias("dv"))
