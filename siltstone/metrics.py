"""Counters of a scan: those of planning are exact, those of execution filled in after an action; and of a plan's scans."""

from __future__ import annotations

import threading
from dataclasses import dataclass, replace

from siltstone.options import Backend


@dataclass(frozen=True)
class ReadMetrics:
    """One moment's counters; None where Spark does not tell."""

    snapshot_version: int
    reader_backend: Backend
    scan_metadata_exhausted: bool | None = None
    scan_partitions_planned: int = 0
    files_planned: int = 0
    files_filtered_during_planning: int | None = None
    estimated_rows: int | None = None
    estimated_bytes: int | None = None
    scan_partitions_started: int | None = None
    scan_partitions_completed: int | None = None
    files_started: int | None = 0
    files_completed: int | None = 0
    batches_produced: int | None = None
    rows_produced: int = 0
    deletion_vector_payloads_loaded: int = 0
    deletion_vectors_applied: int | None = 0
    deletion_vector_rows_deleted: int = 0
    deletion_vector_failures: int = 0
    deletion_vector_rejections: int = 0
    parquet_data_file_range_get_operations: int | None = None
    parquet_data_file_full_get_operations: int | None = None
    parquet_data_file_bytes_received: int | None = None
    parquet_data_file_opened_bytes: int | None = None


class MetricsHandle:
    """A live handle that several holders may share."""

    def __init__(self, start: ReadMetrics):
        self._now, self._lock = start, threading.Lock()

    def update(self, **values) -> None:
        with self._lock:
            self._now = replace(self._now, **values)

    def snapshot(self) -> ReadMetrics:
        with self._lock:
            return self._now


@dataclass(frozen=True)
class PlanScan:
    """What Spark counted for one file scan of a plan that has run."""

    files: int
    bytes: int
    rows: int


def plan_scans(frame) -> list[PlanScan]:
    """The file scans in the plan of a DataFrame, with their counts after an action on that DataFrame."""

    def value(node, name: str) -> int:
        found = node.metrics().get(name)
        return int(found.get().value()) if found.isDefined() else 0

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            yield from walk(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            yield from walk(node.plan())
        elif kind == "FileSourceScanExec":
            yield PlanScan(value(node, "numFiles"), value(node, "filesSize"), value(node, "numOutputRows"))
        children = node.children()
        for i in range(children.size()):
            yield from walk(children.apply(i))

    return list(walk(frame._jdf.queryExecution().executedPlan()))
