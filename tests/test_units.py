"""Pure functions: addresses, options, protocol, log segments, bitmaps, partition targets, errors."""

import base64
import datetime as dt
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import delta_fixtures as fx
from siltstone import errors
from siltstone.errors import DeletionVectorRead, InvalidConfiguration, InvalidTableUri, SnapshotLoad, UnsupportedProtocol
from siltstone.options import Backend, ExecutionOptions, ScanOptions
from siltstone.plans import partitioning
from siltstone.sources import deletion_vectors, files, log
from siltstone.sources.protocol import ProtocolInfo


@pytest.mark.parametrize(
    "given_, want",
    [("/a/b/", "file:///a/b"), ("/a b/c%d", "file:///a%20b/c%25d"), ("s3a://bucket/t/", "s3a://bucket/t"), ("file:/x/y", "file:///x/y"), ("file:///x/y", "file:///x/y")],
)
def test_addresses(given_, want):
    assert files.normalized_uri(given_) == want


@pytest.mark.parametrize("bad", ["", "  "])
def test_empty_address(bad):
    with pytest.raises(InvalidTableUri) as e:
        files.normalized_uri(bad)
    assert (e.value.reason, e.value.phase, e.value.kind) == ("empty_table_uri", "table_uri", "invalid_table_uri")


def test_data_files():
    assert files.data_file("file:///t", "a%20b/c%2520d=1.parquet") == ("file:///t/a b/c%20d=1.parquet", "file:/t/a%20b/c%2520d=1.parquet")
    assert files.data_file("s3a://k/t", "x.parquet") == ("s3a://k/t/x.parquet", "s3a://k/t/x.parquet")
    assert files.data_file("file:///t", "s3a://k/y%3D.parquet") == ("s3a://k/y=.parquet", "s3a://k/y=.parquet")


@pytest.mark.parametrize(
    "uri, options, want",
    [
        ("file:///t", {}, None),
        ("s3://b/t", {}, "implicit_provider_chain"),
        ("s3://b/t", {"region": "x"}, "implicit_provider_chain"),
        ("s3a://b/t", {"AWS_ACCESS_KEY_ID": "a", "secret_access_key": "b"}, "explicit_static"),
        ("s3a://b/t", {"access_key_id": "a"}, "other_explicit"),
        ("s3://b/t", {"aws_web_identity_token_file": "a", "role_arn": "b"}, "explicit_web_identity"),
        ("s3://b/t", {"container_credentials_relative_uri": "a"}, "explicit_container"),
        ("s3://b/t", {"container_credentials_full_uri": "a"}, "other_explicit"),
        ("s3://b/t", {"container_credentials_full_uri": "a", "container_authorization_token_file": "b"}, "explicit_container"),
        ("https://x.s3.amazonaws.com/t", {"skip_signature": "1"}, "other_explicit"),
        ("https://example.org/t", {}, None),
    ],
)
def test_s3_auth_modes(uri, options, want):
    assert files.s3_auth_mode(uri, options) == want


@pytest.mark.parametrize("field", ["max_concurrent_file_reads_per_scan", "max_concurrent_file_reads_per_partition", "output_buffer_capacity_per_partition", "parquet_metadata_size_hint", "parquet_full_file_read_threshold"])
def test_zero_options_are_refused(field):
    with pytest.raises(InvalidConfiguration) as e:
        ExecutionOptions().with_(**{field: 0})
    assert e.value.reason == f"{field}_must_be_positive"


def test_options():
    options = ExecutionOptions().with_(native_async_prefetch_file_count_per_partition=0, reader_backend=Backend.OFFICIAL_KERNEL)
    assert options.reads_per_scan(4) == 12 and options.with_(max_concurrent_file_reads_per_scan=5).reads_per_scan(4) == 5
    with pytest.raises(InvalidConfiguration):
        ScanOptions(target_partitions=0)


@pytest.mark.parametrize("reader, features, reason", [(1, (), None), (2, (), None), (3, ("deletionVectors", "v2Checkpoint"), None), (3, ("deletionVectors", "variantType"), "unsupported_reader_feature"), (4, (), "unsupported_reader_version"), (0, (), "unsupported_reader_version")])
def test_protocols(reader, features, reason):
    info = ProtocolInfo(0, reader, 7, features)
    if reason is None:
        return info.validate()
    with pytest.raises(UnsupportedProtocol) as e:
        info.validate()
    assert e.value.reason == reason


def commit(v):
    return f"{v:020d}.json"


def point(v):
    return f"{v:020d}.checkpoint.parquet"


def test_log_segments():
    names = [commit(v) for v in range(6)] + [point(2), f"{4:020d}.checkpoint.{1:010d}.{2:010d}.parquet"]
    assert log.segment(names) == log.Segment(5, 2, (point(2),), tuple(commit(v) for v in (3, 4, 5)))
    assert log.segment(names, 1) == log.Segment(1, None, (), (commit(0), commit(1)))
    whole = [*names, f"{4:020d}.checkpoint.{2:010d}.{2:010d}.parquet"]
    assert log.segment(whole).checkpoint_version == 4 and len(log.segment(whole).checkpoint_files) == 2
    v2 = f"{5:020d}.checkpoint.{uuid.uuid4()}.json"
    assert log.segment([*whole, v2]) == log.Segment(5, 5, (v2,), ())
    assert log.segment([point(3)]).version == 3
    assert log.segment([*names, "_last_checkpoint", "x.crc"]).version == 5


@pytest.mark.parametrize("names, version", [([], None), ([commit(1)], None), ([commit(0), commit(2)], None), ([commit(0)], 1), ([commit(0)], -1), ([point(3), commit(5)], None)])
def test_log_gaps(names, version):
    with pytest.raises(SnapshotLoad):
        log.segment(names, version)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 200), st.integers(0, 300_000), st.integers(2**32, 2**32 + 70_000)), max_size=200), st.booleans())
def test_bitmaps_round_trip(rows, runs):
    assert deletion_vectors.decode(fx.bitmap(rows, runs)).tolist() == sorted(set(rows))


def test_dense_and_many_containers():
    rows = [*range(5_000), *(k << 16 for k in range(1, 9)), *range(9 << 16, (9 << 16) + 70_000, 2)]
    for runs in (False, True):
        assert deletion_vectors.decode(fx.bitmap(rows, runs)).tolist() == rows


def test_payloads():
    assert deletion_vectors.z85_decode("vBn[lx{q8@P<9BNH/isA") == uuid.UUID("61d16c75-6994-46b7-a15b-8b538852e50e").bytes
    name = "vBn[lx{q8@P<9BNH/isA"
    assert deletion_vectors.payload_path("file:///t", "u", "ab" + name) == "file:///t/ab/deletion_vector_61d16c75-6994-46b7-a15b-8b538852e50e.bin"
    assert deletion_vectors.payload_path("file:///t", "p", "s3://x/y.bin") == "s3://x/y.bin" and deletion_vectors.payload_path("file:///t", "i", "") is None
    good = fx.bitmap([1, 5])
    import struct
    import zlib

    stored = b"\x01" + struct.pack(">i", len(good)) + good + struct.pack(">I", zlib.crc32(good))
    assert deletion_vectors.stored_payload(stored, 1, len(good)) == good
    for broken, reason in (
        (b"\x02" + stored[1:], "format_unsupported"),
        (stored[:-1], "payload_truncated"),
        (stored[:8] + b"\xff" + stored[9:], "checksum_mismatch"),
        (stored[:4] + b"\xff" + stored[5:], "size_mismatch"),
    ):
        with pytest.raises(DeletionVectorRead) as e:
            deletion_vectors.stored_payload(broken, 1, len(good))
        assert e.value.reason == f"deletion_vector_{reason}"
    with pytest.raises(DeletionVectorRead):
        deletion_vectors.decode(b"1234" + good[4:])
    with pytest.raises(DeletionVectorRead):
        deletion_vectors.decode(good[:-2])
    with pytest.raises(DeletionVectorRead):
        deletion_vectors._checked(np.array([1, 5]), 3, None)
    with pytest.raises(DeletionVectorRead):
        deletion_vectors._checked(np.array([1, 5]), 2, 5)
    assert base64.z85decode(fx.inline_vector([3])["pathOrInlineDv"])[:4] == good[:4]


def test_targets():
    f = partitioning.target_partitions
    assert f(explicit=500, parallelism=4).target_partitions == 500
    assert f(parallelism=16) == partitioning.Target(16, "available_parallelism_fallback")
    assert f(parallelism=16, engine_target=6, file_descriptors=1024, memory_bytes=2**31).target_partitions == 6
    assert f(parallelism=16, file_descriptors=32).target_partitions == 2 and f(parallelism=16, file_descriptors=3).target_partitions == 1
    assert f(parallelism=16, memory_bytes=2**30).target_partitions == 4 and f().source == "static_fallback"
    with pytest.raises(InvalidConfiguration):
        f(explicit=0)
    with pytest.raises(InvalidConfiguration):
        partitioning.TargetPolicy(min_partitions=0)


def test_grouping():
    assert partitioning.grouped([10, 1, 8, 3, 2], 2) == [[0, 4], [2, 3, 1]]
    loads = [sum([10, 1, 8, 3, 2][i] for i in g) for g in partitioning.grouped([10, 1, 8, 3, 2], 2)]
    assert sorted(loads) == [12, 12]
    assert partitioning.grouped([1, None, 1, 1, 1], 2) == [[0, 1, 2], [3, 4]] and partitioning.grouped([0, 0, 0], 2) == [[0, 1], [2]]
    assert partitioning.grouped([], 3) == [] and partitioning.grouped([5], 3) == [[0]]
    assert partitioning.total([1, 2]) == 3 and partitioning.total([1, None]) is None
    with pytest.raises(errors.ScanPartitionPlanning):
        partitioning.total([2**63, 2**63])


@pytest.mark.parametrize("sizes, target, rebalance", [([10, 1, 8, 3, 2], 2, True), ([100], 7, False), ([5, 5], 2, False), ([0, 3], 4, False), ([0], 2, True), ([], 2, True)])
def test_ranges_hold_every_byte_once(sizes, target, rebalance):
    found = partitioning.ranges(sizes, target, rebalance)
    assert len(found) <= max(target, 1)
    for i, size in enumerate(sizes):
        own = sorted((a, b) for group in found for f, a, b in group if f == i)
        assert [a for a, _ in own[1:]] == [b for _, b in own[:-1]] and (not size or (own[0][0], own[-1][1]) == (0, size))


def test_errors_tell_nothing():
    for kind in errors.ReaderError.__subclasses__():
        error = kind("some_reason")
        assert error.phase in errors.PHASES and str(error) == repr(error) == f"{error.kind} in {error.phase}: some_reason"
    assert "secret" not in str(errors.DataFileRead("required_field_missing", "secret.path"))
    assert dt.UTC
