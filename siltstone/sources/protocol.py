"""What a table's protocol asks of its readers."""

from __future__ import annotations

from dataclasses import dataclass

from siltstone.errors import UnsupportedProtocol

# Reader versions and features that scans support.
READER_VERSIONS = (1, 2, 3)
READER_FEATURES = ("timestampNtz", "deletionVectors", "columnMapping", "v2Checkpoint", "vacuumProtocolCheck", "typeWidening", "typeWidening-preview")


@dataclass(frozen=True)
class ProtocolInfo:
    """A snapshot's protocol. A table may be loaded and looked at though it can't be scanned."""

    snapshot_version: int
    min_reader_version: int
    min_writer_version: int
    reader_features: tuple[str, ...] = ()
    writer_features: tuple[str, ...] = ()

    def first_unsupported_reader_feature(self) -> str | None:
        return next((f for f in self.reader_features if f not in READER_FEATURES), None)

    def validate(self) -> None:
        """Raise unless scans are possible."""
        if self.min_reader_version not in READER_VERSIONS:
            raise UnsupportedProtocol("unsupported_reader_version")
        if self.first_unsupported_reader_feature() is not None:
            raise UnsupportedProtocol("unsupported_reader_feature")
