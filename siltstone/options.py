"""What a caller may set, validated at once."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum

from siltstone.errors import InvalidConfiguration


class Backend(Enum):
    """How data files are decoded: Spark's vectorised Parquet reader, or its row-at-a-time one."""

    NATIVE_ASYNC = "native_async"
    OFFICIAL_KERNEL = "official_kernel"


class Repartitioning(Enum):
    """Whether files are split only where partitions are fewer than wanted, or evened out anyway."""

    FILL_MISSING_PARALLELISM = "fill_missing_parallelism"
    REBALANCE = "rebalance"


#: Options that must be positive; those that may also be None.
_POSITIVE = ("max_concurrent_file_reads_per_partition", "output_buffer_capacity_per_partition")
_POSITIVE_OR_NONE = ("max_concurrent_file_reads_per_scan", "parquet_metadata_size_hint", "parquet_full_file_read_threshold")


@dataclass(frozen=True)
class ExecutionOptions:
    """Limits of the reader.

    Spark's task slots bound concurrent reads, so only the backend acts, see check_backend; the other fields
    are validated and carried.
    """

    reader_backend: Backend = Backend.NATIVE_ASYNC
    max_concurrent_file_reads_per_scan: int | None = None
    max_concurrent_file_reads_per_partition: int = 3
    output_buffer_capacity_per_partition: int = 1
    native_async_prefetch_file_count_per_partition: int = 2
    parquet_metadata_size_hint: int | None = 64 * 1024
    parquet_full_file_read_threshold: int | None = None

    def __post_init__(self) -> None:
        if not isinstance(self.reader_backend, Backend):
            raise InvalidConfiguration("reader_backend_unknown")
        for name in (*_POSITIVE, *_POSITIVE_OR_NONE):
            value = getattr(self, name)
            if value is None and name in _POSITIVE_OR_NONE:
                continue
            if not isinstance(value, int) or value < 1:
                raise InvalidConfiguration(f"{name}_must_be_positive")
        if self.native_async_prefetch_file_count_per_partition < 0:
            raise InvalidConfiguration("native_async_prefetch_file_count_per_partition_must_not_be_negative")

    def with_(self, **changes) -> ExecutionOptions:
        return replace(self, **changes)

    def reads_per_scan(self, target_partitions: int) -> int:
        """The scan-wide limit, by default the partitions' limits together."""
        if self.max_concurrent_file_reads_per_scan is not None:
            return self.max_concurrent_file_reads_per_scan
        return max(1, target_partitions * self.max_concurrent_file_reads_per_partition)


@dataclass(frozen=True)
class ScanOptions:
    """Options of a registered table."""

    execution: ExecutionOptions = ExecutionOptions()
    target_partitions: int | None = None
    repartitioning: Repartitioning = Repartitioning.FILL_MISSING_PARALLELISM

    def __post_init__(self) -> None:
        if self.target_partitions is not None and self.target_partitions < 1:
            raise InvalidConfiguration("explicit_target_partitions_must_be_positive")
