"""Deletion vectors: rows of a data file that no longer count, as (file, row index) pairs."""

from __future__ import annotations

import base64
import re
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.errors import DeletionVectorRead
from siltstone.sources.files import data_file
from siltstone.sources.shipping import ship

_MAGIC = 1681511377
_NO_RUNS, _RUNS = 12346, 12347
#: Payload bytes that the driver decodes itself, which makes failures show while planning.
DRIVER_BYTES = 16 << 20


def z85_decode(text: str) -> bytes:
    return base64.z85decode(text.encode())


def payload_path(table: str, kind: str, text: str) -> str | None:
    """The file of a stored vector, or None for an inline one."""
    if kind == "i":
        return None
    if kind == "p":
        return text
    if kind != "u" or len(text) < 20:
        raise DeletionVectorRead("deletion_vector_descriptor_invalid")
    prefix, name = text[:-20], uuid.UUID(bytes=z85_decode(text[-20:]))
    return f"{table}/{prefix}/deletion_vector_{name}.bin" if prefix else f"{table}/deletion_vector_{name}.bin"


def stored_payload(content: bytes, offset: int, size: int) -> bytes:
    """One vector's bitmap out of a file of vectors, its length and checksum verified."""
    try:
        if content[0] != 1:
            raise DeletionVectorRead("deletion_vector_format_unsupported")
        (found,) = struct.unpack_from(">i", content, offset)
        data = content[offset + 4 : offset + 4 + size]
        (crc,) = struct.unpack_from(">I", content, offset + 4 + size)
    except (struct.error, IndexError) as error:
        raise DeletionVectorRead("deletion_vector_payload_truncated") from error
    if found != size or len(data) != size:
        raise DeletionVectorRead("deletion_vector_size_mismatch")
    if zlib.crc32(data) != crc:
        raise DeletionVectorRead("deletion_vector_checksum_mismatch")
    return data


def _bitmap32(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """Values of a 32-bit bitmap in its portable form, and where it ends."""
    (cookie,) = struct.unpack_from("<I", data, at)
    at += 4
    if cookie & 0xFFFF == _RUNS:
        n = (cookie >> 16) + 1
        flags = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), bitorder="little")[:n]
        at += (n + 7) // 8
    elif cookie == _NO_RUNS:
        (n,) = struct.unpack_from("<I", data, at)
        at += 4
        flags = np.zeros(n, np.uint8)
    else:
        raise DeletionVectorRead("deletion_vector_bitmap_invalid")
    heads = np.frombuffer(data, "<u2", 2 * n, at).reshape(n, 2).astype(np.int64)
    at += 4 * n
    if not flags.any() or n >= 4:
        at += 4 * n  # container offsets; containers follow in order
    found = []
    for (high, less), run in zip(heads.tolist(), flags.tolist(), strict=True):
        if run:
            (count,) = struct.unpack_from("<H", data, at)
            runs = np.frombuffer(data, "<u2", 2 * count, at + 2).reshape(count, 2).astype(np.int64)
            at += 2 + 4 * count
            size = runs[:, 1] + 1
            low = np.repeat(runs[:, 0], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        elif less + 1 <= 4096:
            low = np.frombuffer(data, "<u2", less + 1, at).astype(np.int64)
            at += 2 * (less + 1)
        else:
            low = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, 8192, at), bitorder="little"))
            at += 8192
        found.append(low + (high << 16))
    return (np.concatenate(found) if found else np.zeros(0, np.int64)), at


def decode(data: bytes) -> np.ndarray:
    """Sorted, distinct row indexes of a 64-bit bitmap."""
    try:
        magic, buckets = struct.unpack_from("<IQ", data)
        if magic != _MAGIC:
            raise DeletionVectorRead("deletion_vector_magic_mismatch")
        at, found = 12, []
        for _ in range(buckets):
            (high,) = struct.unpack_from("<I", data, at)
            low, at = _bitmap32(data, at + 4)
            found.append(low + (high << 32))
    except (struct.error, ValueError) as error:
        raise DeletionVectorRead("deletion_vector_payload_truncated") from error
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _checked(rows: np.ndarray, cardinality: int | None, records: int | None) -> np.ndarray:
    if cardinality is not None and len(rows) != cardinality:
        raise DeletionVectorRead("deletion_vector_cardinality_mismatch")
    if records is not None and len(rows) and rows[-1] >= records:
        raise DeletionVectorRead("deletion_vector_row_out_of_range")
    return rows


def deleted_rows(spark: SparkSession, table: str, vectors: list[dict], options: dict[str, str] | None = None) -> DataFrame:
    """(file_key, row_index) of every deleted row; vectors: file_key, dv fields and num_records of each file.

    Small payloads are decoded by the driver, so that a missing or damaged one fails the plan; large ones
    on executors, where it fails the query. Nothing is returned in part.
    """
    inline = [v for v in vectors if v["storageType"] == "i"]
    stored = [v for v in vectors if v["storageType"] != "i"]
    schema = "file_key string, row_index long"
    frames = []
    for v in inline:
        rows = _checked(decode(z85_decode(v["pathOrInlineDv"])[: v["sizeInBytes"]]), v["cardinality"], v["num_records"])
        frames.append(pd.DataFrame({"file_key": v["file_key"], "row_index": rows}))
    out = spark.createDataFrame(pd.concat(frames), schema) if frames else spark.createDataFrame([], schema)
    if not stored:
        return out
    paths: dict[str, list[dict]] = {}
    keys: dict[str, str] = {}
    for v in stored:
        name = payload_path(table, v["storageType"], v["pathOrInlineDv"])
        plain, key = data_file(table, name)
        paths.setdefault(plain, []).append(v)
        keys[plain] = key
    try:
        content = spark.read.options(**(options or {})).format("binaryFile").load(sorted(paths)).select("path", "content")
    except Exception as error:
        raise DeletionVectorRead("deletion_vector_payload_missing") from error
    asked = {keys[p]: own for p, own in paths.items()} | {re.sub(r"^([A-Za-z][A-Za-z0-9+.-]*):///", r"\1:/", p): own for p, own in paths.items()}

    def rows_of(path: str, data: bytes) -> pd.DataFrame:
        own = asked[re.sub(r"^([A-Za-z][A-Za-z0-9+.-]*):///", r"\1:/", path)]
        parts = [(v["file_key"], _checked(decode(stored_payload(data, v["offset"] or 1, v["sizeInBytes"])), v["cardinality"], v["num_records"])) for v in own]
        return pd.DataFrame({"file_key": np.repeat([k for k, _ in parts], [len(r) for _, r in parts]), "row_index": np.concatenate([r for _, r in parts])})

    if sum(v["sizeInBytes"] for v in stored) <= DRIVER_BYTES:
        try:
            found = [rows_of(r.path, bytes(r.content)) for r in content.collect()]
        except DeletionVectorRead:
            raise
        except Exception as error:
            raise DeletionVectorRead("deletion_vector_read_failed") from error
        return out.unionByName(spark.createDataFrame(pd.concat(found), schema))

    ship(spark)

    def each(batches):
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                yield rows_of(path, data)

    return out.unionByName(content.mapInPandas(each, schema).select("file_key", F.col("row_index")))
