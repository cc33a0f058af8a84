"""Failures by kind, phase and fixed reason. Messages never hold paths, names or values."""

from __future__ import annotations


class ReaderError(Exception):
    """Base of all failures; str() and repr() show the kind and reason alone."""

    kind = "reader_error"
    phase = "execution"

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason

    def __str__(self) -> str:
        return f"{self.kind} in {self.phase}: {self.reason}"

    __repr__ = __str__


class InvalidConfiguration(ReaderError):
    kind, phase = "invalid_configuration", "configuration"


class InvalidTableUri(ReaderError):
    kind, phase = "invalid_table_uri", "table_uri"


class StorageInitialization(ReaderError):
    kind, phase = "storage_initialization", "storage"


class SnapshotLoad(ReaderError):
    kind, phase = "snapshot_load", "snapshot"


class UnsupportedProtocol(ReaderError):
    kind, phase = "unsupported_protocol", "protocol"


class SchemaConversion(ReaderError):
    kind, phase = "schema_conversion", "schema"


class InvalidProjection(ReaderError):
    kind, phase = "invalid_projection", "scan_planning"


class UnsupportedPredicate(ReaderError):
    kind, phase = "unsupported_predicate", "scan_planning"


class ScanPlanning(ReaderError):
    kind, phase = "scan_planning", "scan_planning"


class ScanPartitionPlanning(ReaderError):
    kind, phase = "scan_partition_planning", "scan_planning"


class UnsupportedBackend(ReaderError):
    kind, phase = "unsupported_backend", "configuration"


class DataFileRead(ReaderError):
    """field: dotted path of a missing required field, for callers; never part of the message."""

    kind, phase = "data_file_read", "data_file_read"

    def __init__(self, reason: str, field: str | None = None):
        super().__init__(reason)
        self.field = field


class DeletionVectorRead(ReaderError):
    kind, phase = "deletion_vector_read", "deletion_vector"


class PhysicalToLogicalTransform(ReaderError):
    kind, phase = "physical_to_logical_transform", "transform"


class Cancelled(ReaderError):
    kind, phase = "cancelled", "execution"


class SqlAdapter(ReaderError):
    kind, phase = "data_fusion_adapter", "data_fusion"


PHASES = (
    "configuration", "table_uri", "storage", "snapshot", "protocol", "schema", "scan_planning", "data_file_read",
    "deletion_vector", "transform", "execution", "data_fusion",
)
