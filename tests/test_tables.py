"""Tables end to end: rows, schemas, predicates, skipping, deletion vectors, versions, SQL."""

import datetime as dt
import decimal
import json
import math

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

import delta_fixtures as fx
import table_queries
from siltstone import metrics
from siltstone.errors import Cancelled, DataFileRead, DeletionVectorRead, InvalidConfiguration, InvalidProjection, PhysicalToLogicalTransform, ReaderError, ScanPlanning, SnapshotLoad, SqlAdapter, UnsupportedBackend, UnsupportedPredicate, UnsupportedProtocol
from siltstone.functions.predicate import And, Boolean, Compare, IsNotNull, IsNull, Not, Or, Scalar, is_in, not_in
from siltstone.operators import dynamic, sql
from siltstone.operators.cancel import Cancellation
from siltstone.operators.table import TableBuilder, batch_size, row_reader
from siltstone.options import Backend, ExecutionOptions, Repartitioning
from siltstone.plans import pushdown

PROTOCOL = fx.features("deletionVectors", "columnMapping", "timestampNtz", "typeWidening", "v2Checkpoint")
DEFAULT = "id int not null, customer_name string"
PEOPLE = pa.table({"id": pa.array([1, 2, 3], pa.int32()), "customer_name": ["alice", "bob", None]})


class Builder:
    """A table of given Arrow files under a logical schema."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.uri = spark, folder, fx.local_address(str(folder))

    def make(self, schema, files, partitions=(), configuration=None, protocol=PROTOCOL, version=0):
        if not schema.startswith("{"):
            schema = T.StructType.fromDDL(schema).json()
        actions = [{"protocol": protocol}, fx.metadata(schema, list(partitions), configuration)]
        for i, item in enumerate(files):
            item = item if isinstance(item, dict) else {"data": item}
            name = item.get("name", f"part-{i}.parquet")
            pq.write_table(item["data"], self.folder / name, row_group_size=item.get("rows"), use_dictionary=item.get("dictionary", True), store_schema=item.get("store_schema", True))
            stats = item.get("stats", {"numRecords": item["data"].num_rows})
            actions.append(fx.add(item.get("path", name), (self.folder / name).stat().st_size, item.get("values"), stats, item.get("dv")))
        fx.commit(self.spark, self.uri, version, actions)
        return self.load()

    def load(self, version=None):
        return TableBuilder(self.spark, self.uri).with_version(version).load()


@pytest.fixture
def build(spark, tmp_path):
    return Builder(spark, tmp_path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def ids(df):
    return sorted(r["id"] for r in df.collect())


# ---- shapes of files -----------------------------------------------------------------------------------


def test_default_rows_both_readers(build, spark):
    table = build.make(DEFAULT, [PEOPLE])
    for slow in (False, True):
        row_reader(spark, slow)
        assert rows(table.to_df()) == [(1, "alice"), (2, "bob"), (3, None)]
    row_reader(spark, False)
    assert table.version == 0 and table.protocol.min_reader_version == 3 and table.schema.fieldNames() == ["id", "customer_name"]


def test_names_with_spaces_and_percent(build):
    table = build.make(DEFAULT + ", region string", [{"data": PEOPLE, "name": "a b%20c.parquet", "path": "a%20b%2520c.parquet", "values": {"region": "x y"}, "dv": fx.inline_vector([1])}], ["region"])
    assert rows(table.to_df()) == [(1, "alice", "x y"), (3, None, "x y")]


def test_missing_columns(build):
    assert rows(build.make(DEFAULT + ", loyalty_tier string", [PEOPLE]).to_df())[0] == (1, "alice", None)


@pytest.mark.parametrize(
    "ddl, field",
    [
        ("required_code string not null", "required_code"),
        ("profile struct<age:int,required_code:string not null>", "profile.required_code"),
        ("addresses array<struct<zip:int,required_country:string not null>>", "addresses.element.required_country"),
        ("attributes map<string,struct<zip:int,required_country:string not null>>", "attributes.value.required_country"),
    ],
)
def test_missing_required_fields(build, ddl, field):
    zips = pa.struct([("zip", pa.int32())])
    data = PEOPLE.append_column("profile", pa.array([{"age": 1}] * 3, pa.struct([("age", pa.int32())])))
    data = data.append_column("addresses", pa.array([[{"zip": 1}]] * 3, pa.list_(zips))).append_column("attributes", pa.array([[("k", {"zip": 1})]] * 3, pa.map_(pa.string(), zips)))
    table = build.make(f"{DEFAULT}, {ddl}", [data])
    with pytest.raises(DataFileRead) as e:
        table.to_df()
    assert e.value.field == field and field not in str(e.value)


def test_all_types(build):
    when = dt.datetime(2024, 1, 2, 3, 4, 5, 678901)
    data = pa.table(
        {
            "id": pa.array([1, 2], pa.int32()),
            "active": [True, None],
            "payload": pa.array([b"\x00\xff", None], pa.binary()),
            "event_date": pa.array([dt.date(2024, 1, 2), None]),
            "event_ts": pa.array([when, None], pa.timestamp("us", "UTC")),
            "plain_ts": pa.array([when, None], pa.timestamp("us")),
            "amount": pa.array([decimal.Decimal("12.34"), None], pa.decimal128(10, 2)),
            "score": pa.array([1.5, None], pa.float32()),
            "attributes": pa.array([{"level": 1, "label": "x"}, None], pa.struct([("level", pa.int32()), ("label", pa.string())])),
            "tags": pa.array([[1, None], None], pa.list_(pa.int32())),
        }
    )
    ddl = "id int not null, active boolean, payload binary, event_date date, event_ts timestamp, plain_ts timestamp_ntz, amount decimal(10,2), score float, attributes struct<level:int,label:string>, tags array<int>"
    found = build.make(ddl, [data]).to_df().selectExpr("id", "active", "hex(payload)", "string(event_date)", "string(event_ts)", "string(plain_ts)", "string(amount)", "score", "attributes.label", "tags").collect()
    assert tuple(found[0]) == (1, True, "00FF", "2024-01-02", "2024-01-02 03:04:05.678901", "2024-01-02 03:04:05.678901", "12.34", 1.5, "x", [1, None])
    assert set(tuple(found[1])[1:]) == {None}


WIDENED = [
    (pa.int8(), 5, "smallint", 5), (pa.int8(), 5, "double", 5.0), (pa.int16(), 5, "bigint", 5), (pa.int32(), 5, "bigint", 5), (pa.int32(), 5, "double", 5.0),
    (pa.float32(), 1.5, "double", 1.5), (pa.int8(), 5, "decimal(5,2)", decimal.Decimal("5.00")), (pa.int16(), 5, "decimal(7,2)", decimal.Decimal("5.00")),
    (pa.int32(), 5, "decimal(12,2)", decimal.Decimal("5.00")), (pa.int64(), 5, "decimal(22,2)", decimal.Decimal("5.00")),
    (pa.decimal128(5, 2), decimal.Decimal("1.25"), "decimal(8,3)", decimal.Decimal("1.250")), (pa.date32(), dt.date(2024, 1, 2), "timestamp_ntz", dt.datetime(2024, 1, 2)),
    (pa.int32(), 19724, "date", dt.date(2024, 1, 2)), (pa.int64(), 1704164645000001, "timestamp_ntz", dt.datetime(2024, 1, 2, 3, 4, 5, 1)),
    (pa.timestamp("ns"), 1704164645000001999, "timestamp_ntz", dt.datetime(2024, 1, 2, 3, 4, 5, 1)), (pa.timestamp("us", "UTC"), 1704164645000001, "timestamp_ntz", dt.datetime(2024, 1, 2, 3, 4, 5, 1)),
]


@pytest.mark.parametrize("kind, value, wanted, result", WIDENED)
def test_widening(build, kind, value, wanted, result):
    table = build.make(f"id int, v {wanted}", [pa.table({"id": pa.array([1, 2], pa.int32()), "v": pa.array([value, None], kind)})])
    assert rows(table.to_df()) == [(1, result), (2, None)]


@pytest.mark.parametrize("kind, unit", [(pa.int64(), 1), (pa.timestamp("ns", "UTC"), 1000), (pa.timestamp("ns"), 1000), (pa.timestamp("us"), 1)])
@pytest.mark.parametrize("micros", [1704164645000001, -1])
def test_instants(build, kind, unit, micros):
    table = build.make("id int, v timestamp", [pa.table({"id": pa.array([1], pa.int32()), "v": pa.array([micros * unit], kind)})])
    assert rows(table.to_df().selectExpr("unix_micros(v)")) == [(micros,)]


@pytest.mark.parametrize("kind, value, wanted", [(pa.decimal128(5, 2), decimal.Decimal("1.25"), "decimal(6,4)"), (pa.int64(), 1, "int"), (pa.int32(), 1, "string"), (pa.string(), "1", "int"), (pa.float64(), 1.0, "float"), (pa.int64(), 1, "double")])
def test_refused_conversions(build, kind, value, wanted):
    with pytest.raises(PhysicalToLogicalTransform):
        build.make(f"v {wanted}", [pa.table({"v": pa.array([value], kind)})]).to_df()


def test_list_elements_are_not_widened(build):
    with pytest.raises(PhysicalToLogicalTransform):
        build.make("v array<bigint>", [pa.table({"v": pa.array([[1]], pa.list_(pa.int32()))})]).to_df()


def test_nested_reshaping(build):
    person = pa.struct([("first_name", pa.string()), ("age", pa.int32())])
    place = pa.struct([("city", pa.string()), ("zip", pa.int32())])
    data = pa.table(
        {
            "id": pa.array([1, 2], pa.int32()),
            "profile": pa.array([{"first_name": "a", "age": 7}, None], person),
            "places": pa.array([[{"city": "c", "zip": 9}, None], None], pa.list_(place)),
            "byname": pa.array([[("k", {"city": "c", "zip": 9})], None], pa.map_(pa.string(), place)),
            "bykey": pa.array([[(3, "x")], None], pa.map_(pa.int32(), pa.string())),
        }
    )
    ddl = "id int, profile struct<age:bigint,tier:string,first_name:string>, places array<struct<zip:bigint,city:string>>, byname map<string,struct<zip:bigint,city:string,country:string>>, bykey map<bigint,string>"
    found = rows(build.make(ddl, [data]).to_df())
    assert found[0] == (1, (7, None, "a"), [(9, "c"), None], {"k": (9, "c", None)}, {3: "x"}) and found[1] == (2, None, None, None, None)


def test_map_with_nested_keys_reads_as_arrow(build):
    place = pa.struct([("zip", pa.int32()), ("city", pa.string())])
    data = pa.table({"id": pa.array([1], pa.int32()), "m": pa.array([[([(1)], "v")]], pa.map_(pa.list_(pa.int32()), pa.string()))})
    assert build.make("id int, m map<array<int>,string>", [data]).to_df().toArrow().column("m").to_pylist() == [[([1], "v")]]
    assert place


def field(name, kind, number, physical, **more):
    return {"name": name, "type": kind, "nullable": True, "metadata": {"delta.columnMapping.id": number, "delta.columnMapping.physicalName": physical}} | more


def with_id(name, kind, number):
    return pa.field(name, kind, metadata={"PARQUET:field_id": str(number)})


def test_column_mapping(build):
    inner = pa.struct([with_id("stale_age", pa.int32(), 4), with_id("stale_name", pa.string(), 5)])
    by_id = pa.table([pa.array([1], pa.int32()), pa.array([{"stale_age": 7, "stale_name": "a"}], inner)], schema=pa.schema([with_id("old_id", pa.int32(), 1), with_id("old_profile", inner, 3)]))
    by_name = pa.table({"phys_id": pa.array([2], pa.int32()), "phys_profile": pa.array([{"phys_age": 8, "phys_name": "b"}], pa.struct([("phys_age", pa.int32()), ("phys_name", pa.string())]))})
    profile = {"type": "struct", "fields": [field("name", "string", 5, "phys_name"), field("age", "integer", 4, "phys_age")]}
    schema = json.dumps({"type": "struct", "fields": [field("id", "integer", 1, "phys_id"), field("profile", profile, 3, "phys_profile")]})
    table = build.make(schema, [by_id, by_name], configuration={"delta.columnMapping.mode": "id"})
    assert sorted(rows(table.to_df())) == [(1, ("a", 7)), (2, ("b", 8))]


def test_mapped_partitions_and_statistics(build):
    schema = json.dumps({"type": "struct", "fields": [field("id", "integer", 1, "c1"), field("region", "string", 2, "c2")]})
    one = lambda k, r: {"data": pa.table({"c1": pa.array([k], pa.int32())}), "values": {"c2": r}, "stats": {"numRecords": 1, "minValues": {"c1": k}, "maxValues": {"c1": k}, "nullCount": {"c1": 0}}}
    table = build.make(schema, [one(1, "west"), one(2, "east"), one(3, "east")], ["region"], {"delta.columnMapping.mode": "name"})
    scan = table.scan().with_predicate(And((Compare("region", "=", Scalar("string", "east")), Compare("id", ">", Scalar("int", 2))))).build()
    assert scan.metrics.snapshot().files_planned == 1 and rows(scan.execute()) == [(3, "east")]


def test_repeated_field_ids_are_refused(build):
    data = pa.table([pa.array([1], pa.int32())] * 2, schema=pa.schema([with_id("a", pa.int32(), 1), with_id("b", pa.int32(), 1)]))
    table = build.make(json.dumps({"type": "struct", "fields": [field("id", "integer", 1, "p")]}), [data], configuration={"delta.columnMapping.mode": "id"})
    with pytest.raises(DataFileRead):
        table.to_df()


# ---- projection, limits, errors ------------------------------------------------------------------------


def test_projection_and_limits(build):
    table = build.make(DEFAULT, [PEOPLE])
    assert rows(table.scan().with_projection(["customer_name", "id"]).with_limit(2).build().execute()) == [("alice", 1), ("bob", 2)]
    empty = table.scan().with_projection([]).with_predicate(Compare("id", ">", Scalar("int", 1))).build().execute()
    assert empty.columns == [] and empty.count() == 2
    zero = table.scan().with_limit(0).build()
    assert rows(zero.execute()) == [] and zero.schema.fieldNames() == ["id", "customer_name"]
    for bad, reason in ((["id", "id"], "duplicate_column"), (["ID"], "column_not_found")):
        with pytest.raises(InvalidProjection) as e:
            table.scan().with_projection(bad).build()
        assert e.value.reason == reason
    with pytest.raises(InvalidConfiguration):
        table.scan().with_limit(-1).build()


def test_metrics(build):
    scan = build.make(DEFAULT, [PEOPLE, {"data": PEOPLE, "dv": fx.inline_vector([0])}]).scan().build()
    assert scan.execute(observe=True).count() == 5
    found = scan.finish()
    assert (found.rows_produced, found.files_planned, found.estimated_rows, found.deletion_vector_payloads_loaded, found.parquet_data_file_range_get_operations) == (5, 2, 6, 1, None)
    assert found.estimated_bytes > 0 and found.reader_backend is Backend.NATIVE_ASYNC
    assert (found.files_started, found.files_completed, found.deletion_vectors_applied, found.deletion_vector_rows_deleted) == (2, 2, 1, 1)
    some = build.load().scan().with_predicate(Compare("id", ">", Scalar("int", 1))).build()
    assert some.execute(observe=True).count() == 4 and some.finish().deletion_vector_rows_deleted == 0  # filtered before
    one = build.load().scan().with_limit(1).build()
    assert one.execute(observe=True).count() == 1
    assert (one.finish().files_completed, one.finish().scan_partitions_completed) == (None, None)


def test_scans_of_a_plan(build):
    frame = build.make(DEFAULT, [PEOPLE, PEOPLE]).to_df()
    assert len(frame.collect()) == 6
    found = metrics.plan_scans(frame)
    assert sum(s.files for s in found) == 2 and sum(s.rows for s in found) == 6 and sum(s.bytes for s in found) > 0


def test_backends_batches_and_targets(build, spark):
    table = build.make(DEFAULT, [PEOPLE] * 6)
    kernel = ExecutionOptions(reader_backend=Backend.OFFICIAL_KERNEL)
    with pytest.raises(UnsupportedBackend):
        table.scan().with_execution_options(kernel).build()
    row_reader(spark)
    assert table.scan().with_execution_options(kernel).build().execute().count() == 18
    row_reader(spark, False)
    old = spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
    batch_size(spark, 2)
    assert table.to_df().count() == 18
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", old)
    with pytest.raises(InvalidConfiguration):
        batch_size(spark, 0)
    few = table.scan().with_target_partitions(2).build()
    assert few.execute().rdd.getNumPartitions() <= 2 and len(few.partition_plan()) == 2
    even = table.scan().with_target_partitions(5).with_repartitioning(Repartitioning.REBALANCE).build().execute()
    assert even.rdd.getNumPartitions() == 5 and even.count() == 18
    assert table.scan().with_projection_indexes([1, 0]).build().execute().columns == ["customer_name", "id"]
    for bad, reason in (([2], "projection_index_out_of_bounds"), ([-1], "projection_index_out_of_bounds")):
        with pytest.raises(InvalidProjection) as e:
            table.scan().with_projection_indexes(bad)
        assert e.value.reason == reason
    with pytest.raises(InvalidProjection):
        table.scan().with_projection_indexes([0, 0]).build()


def test_cancellation(spark):
    import threading
    import time

    stop = Cancellation(spark)
    slow = spark.range(4).repartition(4).rdd.map(lambda x: time.sleep(30))
    threading.Timer(2, stop.cancel).start()
    start = time.monotonic()
    with pytest.raises(Cancelled):
        stop.run(slow.count)
    assert time.monotonic() - start < 25
    with pytest.raises(Cancelled):
        stop.run(spark.range(1).count)
    assert Cancellation(spark).run(spark.range(3).count) == 3


def test_a_file_system_that_only_hadoop_reads(build, spark, tmp_path):
    build.make(DEFAULT, [PEOPLE, {"data": PEOPLE, "dv": fx.stored_vectors(spark, build.uri, [[0]])[0]}])
    options = {"fs.viewfs.mounttable.mount.link./data": str(build.uri)}
    table = TableBuilder(spark, "viewfs://mount/data").with_storage_options(options).load()
    assert ids(table.to_df()) == [1, 2, 2, 3, 3]
    assert spark._jsc.hadoopConfiguration().get("fs.viewfs.mounttable.mount.link./data") is None


def test_planning_jobs(build, spark):
    table = build.make(DEFAULT, [PEOPLE, PEOPLE])
    context = spark.sparkContext
    context.setJobGroup("planning", "planning")
    try:
        table.scan().with_predicate(Compare("id", ">", Scalar("int", 1))).build()
        assert len(context.statusTracker().getJobIdsForGroup("planning")) <= 3
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_failures_are_told_by_phase(build, spark, tmp_path):
    with pytest.raises(SnapshotLoad) as e:
        TableBuilder(spark, str(tmp_path / "nothing")).load()
    assert e.value.reason == "snapshot_load_failed" and "nothing" not in str(e.value)
    table = build.make(DEFAULT, [{"data": PEOPLE, "path": "gone.parquet", "name": "here.parquet"}])
    with pytest.raises(ReaderError) as e:
        table.to_df().collect()
    assert e.value.phase == "data_file_read"
    with pytest.raises(SnapshotLoad):
        build.load(7)
    assert TableBuilder(spark, build.uri).load_async().result().version == 0


@pytest.mark.parametrize("protocol, loads", [({"minReaderVersion": 4, "minWriterVersion": 2}, True), ({"minReaderVersion": 4, "minWriterVersion": 7}, False), (fx.features("somethingNew"), True)])
def test_unsupported_protocols_load_but_do_not_scan(build, spark, protocol, loads):
    if not loads:
        with pytest.raises(SnapshotLoad):
            build.make(DEFAULT, [PEOPLE], protocol=protocol)
        return
    table = build.make(DEFAULT, [PEOPLE], protocol=protocol)
    assert TableBuilder(spark, build.uri).load_snapshot().protocol == table.protocol
    with pytest.raises(UnsupportedProtocol):
        table.scan().build()


# ---- predicates ------------------------------------------------------------------------------------------


def test_predicate_validation(build):
    ddl = "b boolean, i int, l bigint, f float, d double, m decimal(10,2), s string, y binary, t timestamp, n timestamp_ntz, q struct<x:int>"
    table = build.make(ddl, [])
    naive, aware = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    good = [Scalar("boolean", True), Scalar("int", 1), Scalar("bigint", 1), Scalar("float", 1.5), Scalar("double", -0.0), Scalar.decimal("1.25", 10, 2), Scalar("string", ""), Scalar("binary", b"x"), Scalar("timestamp", aware), Scalar("timestamp_ntz", naive)]
    for name, literal in zip("bilfdmsytn", good, strict=True):
        table.scan().with_predicate(Compare(name, "=", literal)).build()
    table.scan().with_predicate(And((IsNull("q"), IsNotNull("q")))).build()
    bad = [
        (Compare("i", "=", Scalar("bigint", 1)), "scalar_type_mismatch"),
        (Compare("q", "=", Scalar("int", 1)), "scalar_type_mismatch"),
        (Compare("q.x", "=", Scalar("int", 1)), "invalid_column_reference"),
        (Compare("I", "=", Scalar("int", 1)), "column_not_found"),
        (Compare("d", "=", Scalar("double", math.nan)), "non_finite_float"),
        (Compare("f", "<", Scalar("float", math.inf)), "non_finite_float"),
        (Compare("m", "=", Scalar.decimal("1.255", 10, 2)), "invalid_decimal"),
        (Compare("m", "=", Scalar.decimal("1", 39, 2)), "invalid_decimal"),
        (Compare("m", "=", Scalar.decimal("1.2", 10, 1)), "scalar_type_mismatch"),
        (Compare("y", "=", Scalar("fixed_binary", b"xy", 3)), "invalid_fixed_size_binary"),
        (Compare("t", "=", Scalar("timestamp_ntz", naive)), "invalid_timestamp_timezone"),
        (Compare("n", "=", Scalar("timestamp", aware)), "invalid_timestamp_timezone"),
        (Or((Boolean(True), Not(Compare("x", "=", Scalar("int", 1))))), "column_not_found"),
    ]
    for p, reason in bad:
        with pytest.raises(UnsupportedPredicate) as e:
            table.scan().with_predicate(p).build()
        assert e.value.reason == reason


def test_three_valued_logic(build):
    data = pa.table({"id": pa.array([1, 2, 3], pa.int32()), "b": [True, False, None]})
    table = build.make("id int, b boolean", [data])
    b = Compare("b", "=", Scalar("boolean", True))
    for p, want in (
        (b, [1]), (Not(b), [2]), (Or((b, Boolean(True))), [1, 2, 3]), (And((b, Boolean(False))), []), (Not(And((b, Boolean(False)))), [1, 2, 3]), (And(()), [1, 2, 3]),
        (Or(()), []), (Not(IsNull("b")), [1, 2]), (is_in("b", []), []), (not_in("b", []), [1, 2]), (Not(Or((b, Not(b)))), []),
    ):
        assert ids(table.scan().with_predicate(p).build().execute()) == want


ZEROS = [-1.0, -0.0, 0.0, 1.0, None, math.nan]


def total(x):
    return (1, 0) if math.isnan(x) else (0, x, math.copysign(1, x))


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("dictionary", [True, False])
def test_signed_zeros_and_nan(build, kind, dictionary):
    arrow = pa.float32() if kind == "float" else pa.float64()
    files = [{"data": pa.table({"v": pa.array(v, arrow), "id": pa.array([i * 10 + k for k in range(len(v))], pa.int32())}), "dictionary": dictionary} for i, v in enumerate([ZEROS, [0.0] * 4, [-0.0] * 4])]
    table = build.make(f"v {kind}, id int", files)
    values = {i * 10 + k: x for i, v in enumerate([ZEROS, [0.0] * 4, [-0.0] * 4]) for k, x in enumerate(v)}
    compare = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    for op, f in compare.items():
        for literal in (0.0, -0.0, 0.5):
            want = sorted(i for i, x in values.items() if x is not None and f(total(x), total(literal)))
            assert ids(table.scan().with_predicate(Compare("v", op, Scalar(kind, literal))).build().execute()) == want, (op, literal)


# ---- skipping ----------------------------------------------------------------------------------------------

PARTITIONS = [
    ("string", ["a", "b", "c"], Scalar("string", "b")),
    ("boolean", ["true", "false"], Scalar("boolean", True)),
    ("date", ["2024-01-01", "2024-01-02", "2024-01-03"], Scalar("date", dt.date(2024, 1, 2))),
    ("decimal(10,2)", ["-1.50", "1.25", "10.00"], Scalar.decimal("1.25", 10, 2)),
    ("double", ["-1.5", "1.25", "10.0"], Scalar("double", 1.25)),
    ("float", ["-1.5", "1.25", "10.0"], Scalar("float", 1.25)),
    ("binary", ["a", "b", "c"], Scalar("binary", b"b")),
    ("timestamp", ["2024-01-01 00:00:00", "2024-01-02 00:00:00.000001", "2024-01-02T00:00:00.000002Z"], Scalar("timestamp", dt.datetime(2024, 1, 2, 0, 0, 0, 1))),
    ("timestamp_ntz", ["2024-01-01 00:00:00", "2024-01-02 00:00:00.000001", "2024-01-03 00:00:00"], Scalar("timestamp_ntz", dt.datetime(2024, 1, 2, 0, 0, 0, 1))),
    *[(k, ["-5", "7", "9"], Scalar(k, 7)) for k in ("tinyint", "smallint", "int", "bigint")],
]


@pytest.mark.parametrize("kind, values, middle", PARTITIONS, ids=[p[0] for p in PARTITIONS])
def test_partition_pruning(build, kind, values, middle):
    one = pa.table({"id": pa.array([1], pa.int32())})
    table = build.make(f"id int, p {kind}", [{"data": one, "values": {"p": v}} for v in values] + [{"data": one, "values": {"p": None}}, {"data": one, "values": {"p": ""}}, {"data": one, "values": {}}], ["p"])
    names = [f"part-{i}.parquet" for i in range(len(values))]
    at = values.index({"boolean": "true"}.get(kind, values[0 if kind == "boolean" else 1]))

    def kept(p):
        return [t.path for t in table.scan().with_predicate(p).build().tasks]

    assert kept(Compare("p", "=", middle)) == [names[at]]
    assert kept(Compare("p", "!=", middle)) == [n for i, n in enumerate(names) if i != at]
    assert kept(Not(Compare("p", "=", middle))) == kept(Compare("p", "!=", middle))
    if kind != "boolean":
        assert kept(Compare("p", "<", middle)) == names[:at] and kept(Compare("p", "<=", middle)) == names[: at + 1]
        assert kept(Compare("p", ">", middle)) == names[at + 1 :] and kept(Compare("p", ">=", middle)) == names[at:]
    assert len(kept(IsNull("p"))) == 3 and kept(IsNotNull("p")) == names
    assert kept(Or((Compare("p", "=", middle), IsNull("p")))) == sorted([names[at], *kept(IsNull("p"))])
    assert len(kept(Or((Compare("p", "=", middle), Boolean(True))))) == len(values) + 3


STATS = [
    ("int", 1, 5, 9, Scalar("int", 5), pa.int32()), ("bigint", 1, 5, 9, Scalar("bigint", 5), pa.int64()), ("double", 1.0, 5.0, 9.0, Scalar("double", 5.0), pa.float64()),
    ("string", "a", "m", "z", Scalar("string", "m"), pa.string()), ("date", "2024-01-01", "2024-01-05", "2024-01-09", Scalar("date", dt.date(2024, 1, 5)), pa.date32()),
    ("decimal(10,2)", 1.0, 5.0, 9.0, Scalar.decimal("5.00", 10, 2), pa.decimal128(10, 2)),
    ("timestamp", "2024-01-01T00:00:00.000Z", "2024-01-05T00:00:00.000Z", "2024-01-09T00:00:00.000Z", Scalar("timestamp", dt.datetime(2024, 1, 5)), pa.timestamp("us", "UTC")),
    ("timestamp_ntz", "2024-01-01T00:00:00.000", "2024-01-05T00:00:00.000", "2024-01-09T00:00:00.000", Scalar("timestamp_ntz", dt.datetime(2024, 1, 5)), pa.timestamp("us")),
]


@pytest.mark.parametrize("kind, low, middle, high, literal, arrow", STATS, ids=[s[0] for s in STATS])
def test_statistics_skipping(build, kind, low, middle, high, literal, arrow):
    data = pa.table({"v": pa.array([None], arrow)})
    stats = lambda a, b, nulls=0, n=2: {"numRecords": n, "minValues": {"v": a}, "maxValues": {"v": b}, "nullCount": {"v": nulls}}
    given_ = {
        "below": stats(low, low), "point": stats(middle, middle), "above": stats(high, high), "range": stats(low, high), "nulls": {"numRecords": 2, "minValues": {}, "maxValues": {}, "nullCount": {"v": 2}},
        "some_nulls": stats(middle, middle, 1), "min_only": {"numRecords": 2, "minValues": {"v": high}}, "max_only": {"numRecords": 2, "maxValues": {"v": low}}, "count_only": {"numRecords": 2}, "none": None,
    }
    table = build.make(f"v {kind}", [{"data": data, "name": f"{n}.parquet", "stats": s} for n, s in given_.items()])

    def kept(p):
        return {t.path.split(".")[0] for t in table.scan().with_predicate(p).build().tasks}

    unknown, floating, instant = {"count_only", "none"}, kind == "double", kind.startswith("timestamp")
    c = lambda op: Compare("v", op, literal)
    assert kept(c("=")) == {"point", "range", "some_nulls"} | unknown
    assert kept(c("<")) == {"below", "range", "max_only"} | unknown
    assert kept(c("<=")) == {"below", "range", "point", "some_nulls", "max_only"} | unknown
    bounded = {"above", "range", "min_only"} | unknown
    assert kept(c(">")) == (set(given_) - {"nulls"} if floating else bounded | ({"point", "some_nulls"} if instant else set()))
    assert kept(c(">=")) == (set(given_) - {"nulls"} if floating else bounded | {"point", "some_nulls"})
    assert kept(c("!=")) == set(given_) - {"nulls"} - (set() if floating or instant else {"point", "some_nulls"})
    assert kept(IsNull("v")) == {"nulls", "some_nulls", "min_only", "max_only"} | unknown
    assert kept(IsNotNull("v")) == set(given_) - {"nulls"}


def test_statistics_never_drop_signed_zeros(build):
    data = pa.table({"v": pa.array([0.0], pa.float64())})
    table = build.make("v double", [{"data": data, "stats": {"numRecords": 1, "minValues": {"v": 5.0}, "maxValues": {"v": 5.0}, "nullCount": {"v": 0}}}])
    assert len(table.scan().with_predicate(Compare("v", "=", Scalar("double", 0.0))).build().tasks) == 1


def test_statistics_keep_deletion_vectors(build):
    stats = {"numRecords": 3, "minValues": {"id": 1}, "maxValues": {"id": 3}, "nullCount": {"id": 0}}
    table = build.make(DEFAULT, [{"data": PEOPLE, "stats": stats, "dv": fx.inline_vector([1])}, {"data": PEOPLE, "stats": stats | {"minValues": {"id": 9}, "maxValues": {"id": 9}}}])
    scan = table.scan().with_predicate(Compare("id", "<", Scalar("int", 3))).build()
    assert [t.records for t in scan.tasks] == [3] and scan.metrics.snapshot().files_filtered_during_planning == 1
    assert ids(scan.execute()) == [1]


# ---- deletion vectors --------------------------------------------------------------------------------------


@pytest.mark.parametrize("gone", [[1], [0, 1, 2], [], [0, 2999, 3000, 5999]])
def test_deletion_vectors(build, spark, gone):
    data = pa.table({"id": pa.array(range(6000), pa.int32())})
    for v in (fx.inline_vector(gone), fx.stored_vectors(spark, build.uri, [[5], gone])[1]):
        table = build.make("id int", [{"data": data, "rows": 3000, "dv": v}])
        assert ids(table.to_df()) == [i for i in range(6000) if i not in gone]
        some = table.scan().with_predicate(Compare("id", ">=", Scalar("int", 2999))).build().execute()
        assert ids(some) == [i for i in range(2999, 6000) if i not in gone]


def test_broken_deletion_vectors_fail_closed(build, spark):
    good = fx.stored_vectors(spark, build.uri, [[1]])[0]
    for bad in (good | {"cardinality": 2}, good | {"offset": 3}, good | {"sizeInBytes": 3}, good | {"pathOrInlineDv": "vBn[lx{q8@P<9BNH/isA"}, good | {"storageType": "x"}, fx.inline_vector([3])):
        with pytest.raises(DeletionVectorRead):
            build.make(DEFAULT, [{"data": PEOPLE, "dv": bad}]).to_df().collect()


def test_many_files_with_partitions_and_vectors(build, monkeypatch):
    from siltstone.operators import table as module

    monkeypatch.setattr(module, "LITERAL_TUPLES", 2)
    files = [{"data": pa.table({"id": pa.array([i * 2, i * 2 + 1], pa.int32())}), "values": {"p": f"v{i}"}, "dv": fx.inline_vector([0]) if i % 2 else None} for i in range(6)]
    table = build.make("id int, p string", files, ["p"])
    want = sorted((i * 2 + k, f"v{i}") for i in range(6) for k in range(2) if not (i % 2 and k == 0))
    assert sorted(rows(table.to_df())) == want
    some = table.scan().with_predicate(Or((Compare("p", "=", Scalar("string", "v1")), Compare("id", "=", Scalar("int", 8))))).build().execute()
    assert sorted(rows(some)) == [(3, "v1"), (8, "v4")]


# ---- versions ----------------------------------------------------------------------------------------------


def test_versions_checkpoints_and_removes(build, spark):
    one = lambda k: pa.table({"id": pa.array([k], pa.int32())})
    for k in range(5):
        pq.write_table(one(k), build.folder / f"f{k}.parquet")
    head = [{"protocol": PROTOCOL}, fx.metadata(T.StructType.fromDDL("id int").json())]
    fx.commit(spark, build.uri, 0, [*head, fx.add("f0.parquet")])
    fx.commit(spark, build.uri, 1, [fx.add("f1.parquet"), fx.add("f2.parquet")])
    fx.commit(spark, build.uri, 2, [fx.remove("f1.parquet")])
    assert [ids(build.load(v).to_df()) for v in (0, 1, 2, None)] == [[0], [0, 1, 2], [0, 2], [0, 2]]
    fx.checkpoint(spark, build.uri, 2, [*head, fx.add("f0.parquet"), fx.add("f2.parquet"), fx.remove("f1.parquet")])
    for v in (0, 1):
        (build.folder / "_delta_log" / f"{v:020d}.json").unlink()
    fx.commit(spark, build.uri, 3, [fx.add("f1.parquet"), fx.remove("f0.parquet")])
    assert ids(build.load().to_df()) == [1, 2] and ids(build.load(2).to_df()) == [0, 2]
    with pytest.raises(SnapshotLoad):
        build.load(1)
    # a new vector on a file replaces the old state of the file
    fx.commit(spark, build.uri, 4, [fx.remove("f2.parquet"), fx.add("f2.parquet", stats={"numRecords": 1}, dv=fx.inline_vector([0]))])
    assert ids(build.load().to_df()) == [1]


def test_checkpoint_with_sidecars(build, spark):
    pq.write_table(PEOPLE, build.folder / "f.parquet")
    fx.commit(spark, build.uri, 1, [{"txn": {"appId": "x", "version": 1}}])
    fx.checkpoint(spark, build.uri, 7, [fx.add("f.parquet")])
    log = build.folder / "_delta_log"
    (log / "_sidecars").mkdir()
    (log / f"{7:020d}.checkpoint.parquet").rename(log / "_sidecars" / "s.parquet")
    (log / f"{1:020d}.json").unlink()
    head = [{"checkpointMetadata": {"version": 7}}, {"protocol": PROTOCOL}, fx.metadata(T.StructType.fromDDL(DEFAULT).json()), {"sidecar": {"path": "s.parquet", "sizeInBytes": 1}}]
    (log / f"{7:020d}.checkpoint.3a0d65cd-4056-49b8-937b-95f9e3ee90e5.json").write_text("\n".join(map(json.dumps, head)))
    assert build.load().version == 7 and ids(build.load().to_df()) == [1, 2, 3]


# ---- SQL, pushdown, runtime pruning -------------------------------------------------------------------------


@pytest.fixture
def regions(build):
    one = lambda *k: pa.table({"id": pa.array(k, pa.int32()), "name": pa.array([f"n{x}" for x in k])})
    stats = lambda a, b: {"numRecords": b - a + 1, "minValues": {"id": a}, "maxValues": {"id": b}, "nullCount": {"id": 0}}
    files = [{"data": one(1, 2), "values": {"region": "west"}, "stats": stats(1, 2)}, {"data": one(3, 4), "values": {"region": "east"}, "stats": stats(3, 4)}, {"data": one(5), "values": {"region": None}, "stats": stats(5, 5)}]
    return build.make("id int, name string, region string", files, ["region"])


def test_sql(regions, spark):
    sql.register(spark, "regions_t", regions)
    try:
        assert rows(sql.query(spark, "SELECT count(*), sum(id) FROM regions_t")) == [(5, 15)]
        pruned = sql.query(spark, "SELECT r.name FROM regions_t AS r WHERE r.region = 'west' AND r.id + 1 > 2")
        assert rows(pruned) == [("n2",)] and len(pruned.inputFiles()) == 1
        both = sql.query(spark, "SELECT a.id FROM regions_t a JOIN regions_t b ON a.id = b.id WHERE a.region = 'west' LIMIT 1")
        assert both.count() == 1
        assert rows(sql.query(spark, "SELECT id FROM regions_t WHERE id > 1 ORDER BY id DESC LIMIT 2")) == [(5,), (4,)]
        assert spark.table("regions_t").count() == 5
        with pytest.raises(SqlAdapter) as e:
            sql.register(spark, "REGIONS_T", regions)
        assert e.value.reason == "table_registration_failed"
    finally:
        sql.unregister(spark, "regions_t")
    for bad, reason in (("", "table_registration_name_empty"), ("select", "table_registration_name_invalid"), ("line-items", "table_registration_name_invalid"), ("1a", "table_registration_name_invalid")):
        with pytest.raises(SqlAdapter) as e:
            sql.register(spark, bad, regions)
        assert e.value.reason == reason


@pytest.mark.parametrize(
    "condition, exact, kernel",
    [
        ("region = 'west'", "exact", "exact"), ("'west' = region", "exact", "exact"), ("region IN ('a', 'b')", "exact", "exact"), ("region NOT IN ('a')", "exact", "exact"),
        ("region BETWEEN 'a' AND 'b'", "exact", "exact"), ("region IS NULL", "exact", "exact"), ("NOT region = 'a' OR region IS NULL", "exact", "exact"), ("id > 3", "exact", "inexact"),
        ("3 < id", "exact", "inexact"), ("id <> 3", "exact", "inexact"), ("name IS NULL", "exact", "inexact"), ("id IS NULL", "unsupported", "unsupported"),
        ("id IN (1, 2)", "unsupported", "unsupported"), ("id BETWEEN 1 AND 2", "unsupported", "unsupported"), ("id + 1 > 3", "unsupported", "unsupported"), ("name LIKE 'n%'", "unsupported", "unsupported"),
        ("region = 'west' AND id > 3", "inexact", "inexact"), ("region = 'west' AND id IN (1, 2)", "inexact", "inexact"), ("region = 'west' AND id + 1 > 3", "unsupported", "unsupported"),
        ("region = 'west' OR id > 3", "unsupported", "unsupported"), ("1 = 1", "unsupported", "unsupported"), ("__siltstone_x = 1", "unsupported", "unsupported"), ("t.region = 'west'", "exact", "exact"),
        ("id > 3 AND id < 9", "inexact", "inexact"),
    ],
)
def test_pushdown_classes(regions, spark, condition, exact, kernel):
    assert pushdown.classify(spark, regions, condition).pushdown.value == exact
    assert pushdown.classify(spark, regions, condition, Backend.OFFICIAL_KERNEL).pushdown.value == kernel


def test_inexact_conditions_need_their_columns(regions, spark):
    found = pushdown.classify(spark, regions, "region = 'west' AND id > 3")
    pushdown.check_residual(found, ["id", "region"])
    with pytest.raises(ScanPlanning):
        pushdown.check_residual(found, ["id"])


@pytest.fixture
def registered(regions, spark):
    sql.register(spark, "regions_t", regions)
    spark.createDataFrame([("west", 1), ("nowhere", 2)], "region string, k int").createOrReplaceTempView("keys_t")
    spark.sql("CREATE OR REPLACE TEMP VIEW over_regions AS SELECT * FROM regions_t")
    yield
    sql.unregister(spark, "regions_t")
    spark.catalog.dropTempView("over_regions")
    spark.catalog.dropTempView("keys_t")


SQL_TEXTS = [
    ("SELECT count(*), (SELECT count(*) FROM over_regions) FROM regions_t WHERE region = 'west'", None),
    ("SELECT count(*), (SELECT count(*) FROM regions_t) FROM regions_t WHERE region = 'west'", None),
    ("SELECT a.id, b.id FROM regions_t a JOIN regions_t b ON a.id = b.id + 2 WHERE a.region = 'east' AND b.region = 'west' ORDER BY 1", 2),
    ("SELECT regions_t.id FROM regions_t WHERE regions_t.region = 'west' ORDER BY regions_t.id", 1),
    ("WITH regions_t AS (SELECT 7 AS id, 'west' AS region) SELECT id FROM regions_t WHERE region = 'west'", 0),
    ("SELECT id FROM (SELECT * FROM regions_t) s WHERE s.region = 'east' ORDER BY id", 1),
    ("SELECT a.id, k FROM regions_t a LEFT JOIN keys_t USING (region) WHERE a.region = 'east' ORDER BY 1", 1),
    ("SELECT k, id FROM keys_t LEFT JOIN regions_t a ON keys_t.region = a.region AND a.id > 1 ORDER BY 1, 2", None),
    ("SELECT id, k FROM regions_t JOIN keys_t ON regions_t.region = keys_t.region ORDER BY id", 2),
    ("SELECT id FROM regions_t WHERE region = 'west' UNION ALL SELECT id FROM regions_t WHERE region = 'east' ORDER BY id", 2),
    ("SELECT id FROM regions_t r WHERE EXISTS (SELECT 1 FROM regions_t q WHERE q.region = 'west' AND q.id = r.id + 1) ORDER BY id", None),
    ("SELECT id FROM (SELECT * FROM regions_t ORDER BY id DESC LIMIT 2) WHERE region = 'east'", 3),
    ("SELECT 'regions_t' AS n, `id` FROM `regions_t` WHERE `region` = 'west' -- regions_t\n ORDER BY id", 1),
    ("SELECT region, count(*) FROM regions_t GROUP BY region HAVING region = 'west'", None),
]


@pytest.mark.parametrize("text, files", SQL_TEXTS)
def test_sql_gives_what_spark_gives(registered, spark, text, files):
    found = sql.query(spark, text)
    assert rows(found) == rows(spark.sql(text))
    if files is not None:
        assert len([f for f in found.inputFiles() if f.endswith(".parquet")]) == files
    assert spark.table("regions_t").count() == 5 and not [t.name for t in spark.catalog.listTables() if t.name.startswith("t_")]


def test_sql_from_many_threads(registered, spark):
    from concurrent.futures import ThreadPoolExecutor

    def one(i):
        if i % 2:
            return rows(sql.query(spark, "SELECT count(*), sum(id) FROM regions_t WHERE region = 'west'")) == [(2, 3)]
        return rows(sql.query(spark, "SELECT count(*) FROM regions_t")) == [(5,)] and spark.table("over_regions").count() == 5

    with ThreadPoolExecutor(8) as pool:
        assert all(pool.map(one, range(40)))


def test_sql_leaves_a_view_that_took_the_name(registered, spark):
    import time

    time.sleep(0.01)
    spark.createDataFrame([(1, "west")], "id int, region string").createOrReplaceTempView("regions_t")
    assert rows(sql.query(spark, "SELECT id FROM regions_t WHERE region = 'west'")) == [(1,)]


def test_runtime_pruning(regions, spark):
    keys = spark.createDataFrame([("west",), ("nowhere",)], "region string")
    counters = dynamic.PruningCounters()
    assert sorted(r.id for r in dynamic.join_pruned(regions, keys, "region", ["id"], counters).collect()) == [1, 2]
    assert counters == dynamic.PruningCounters(1, 1, 0, 2, 1, 1, 1, 0)  # the file without a value is kept
    other = spark.createDataFrame([(1,)], "id int")
    assert dynamic.join_pruned(regions, other, "id", ["name"], counters).count() == 1 and counters.filters_unsupported == 1
    verdicts = {("region",): "accepted", (): "no_referenced_columns", ("id",): "data_column", ("id", "region"): "mixed_partition_and_data", ("x",): "unknown_column", ("__siltstone_a",): "internal_column"}
    assert {k: dynamic.classify(regions, list(k)).value for k in verdicts} == verdicts


def test_window_and_sets_cover_all_orders(spark, tmp_path):
    orders = [(k, k % 300, decimal.Decimal(k * 37 % 101)) for k in range(1, 1001)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice decimal(12,2)").coalesce(1).write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("part-*.parquet")).rename(tmp_path / "orders.parquet")
    wanted = [(c, min(k for k, o, _ in orders if o == c), 0) for c in range(300)]
    for c in range(300):
        ranked = sorted((-p, k) for k, o, p in orders if o == c)
        wanted += [(c, k, place) for place, (_, k) in enumerate(ranked, 1)]
    assert sorted(tuple(r) for r in table_queries.QUERIES["sql_window_and_sets"](spark, str(tmp_path)).collect()) == sorted(wanted)
