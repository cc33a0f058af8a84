"""Queries over tables with a transaction log made from the driver's Parquet, each with its SQL."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import delta_fixtures as fx
from siltstone.functions.predicate import And, Boolean, Compare, IsNotNull, IsNull, Not, Or, Predicate, Scalar, between, is_in, not_in
from siltstone.operators import dynamic, sql
from siltstone.operators.table import Table, TableBuilder
from siltstone.options import Repartitioning
from siltstone.sources.files import data_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_MADE: dict[tuple, str] = {}

BIG, TEXT, DOUBLE, NTZ = "bigint", "string", "double", "timestamp_ntz"


def cached(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], str]) -> str:
    """A fixture's address; made once for each session and input."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def load(spark: SparkSession, address: str, version: int | None = None) -> Table:
    return TableBuilder(spark, address).with_version(version).load()


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(spark: SparkSession, sf_dir: str, name: str) -> Table:
    return load(spark, cached(spark, sf_dir, name, lambda: fx.over_parquet(spark, f"{sf_dir}/{name}.parquet")))


def by_priority(spark: SparkSession, sf_dir: str) -> Table:
    """orders with a file or more for each priority, NULL for one of them, and statistics."""

    def make() -> str:
        df = source(spark, sf_dir, "orders").withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))
        return fx.partitioned(spark, df, "o_orderpriority", ["o_orderkey", "o_totalprice"])

    return load(spark, cached(spark, sf_dir, "by_priority", make))


def by_key_range(spark: SparkSession, sf_dir: str) -> Table:
    """orders in files of disjoint key ranges, with statistics."""

    def make() -> str:
        df = source(spark, sf_dir, "orders")
        top = df.agg(F.max("o_orderkey")).first()[0] or 1
        return fx.partitioned(spark, df.withColumn("part", F.floor(F.col("o_orderkey") * 8 / F.lit(top + 1)).cast("int")), "part", ["o_orderkey", "o_totalprice"])

    return load(spark, cached(spark, sf_dir, "by_key_range", make))


def without_some(spark: SparkSession, sf_dir: str, kind: str) -> Table:
    """orders whose keys divisible by 97 are deleted by vectors: stored, inline, or one for each of many files."""

    def make() -> str:
        if kind == "many":
            table = cached(spark, sf_dir, "by_priority_for_vectors", lambda: fx.partitioned(spark, source(spark, sf_dir, "orders"), "o_orderpriority"))
            old = load(spark, table)
            files = old.snapshot.files.collect()
            rows = spark.read.schema("o_orderkey long").parquet(*[data_file("", r.path)[0] for r in files])
        else:
            table = fx.over_parquet(spark, f"{sf_dir}/orders.parquet")
            files = load(spark, table).snapshot.files.collect()
            rows = source(spark, sf_dir, "orders")
        gone: dict[str, list[int]] = {}
        marked = rows.filter("o_orderkey % 97 = 0").select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
        for r in marked.collect():
            gone.setdefault(r.f.replace("file:///", "file:/"), []).append(r.i)
        actions = [{"protocol": fx.features("deletionVectors", "timestampNtz")}]
        hit = [r for r in files if r.path.replace("file:///", "file:/") in gone]
        lists = [gone[r.path.replace("file:///", "file:/")] for r in hit]
        vectors = [fx.inline_vector(rows) for rows in lists] if kind == "inline" else fx.stored_vectors(spark, table, lists)
        for r, v in zip(hit, vectors, strict=True):
            actions += [fx.remove(r.path), fx.add(r.path, r.size, dict(r.partition_values), json.loads(r.stats) if r.stats else None, v)]
        fx.commit(spark, table, 1, actions)
        return table

    return load(spark, cached(spark, sf_dir, f"without_{kind}", make))


def written(spark: SparkSession, sf_dir: str, name: str, frames: Callable[[], list[DataFrame]], schema_json: Callable[[list[DataFrame]], str], configuration: dict | None = None, features: tuple = ("timestampNtz",)) -> Table:
    """A table whose files are the frames, each written by itself, under the given logical schema."""

    def make() -> str:
        table, made = fx.scratch(spark), frames()
        actions: list[dict] = [{"protocol": fx.features(*features)}, fx.metadata(schema_json(made), configuration=configuration)]
        for i, df in enumerate(made):
            df.write.parquet(f"{table}/part{i}")
            actions += [fx.add(f) for f in fx.files_of(spark.read.parquet(f"{table}/part{i}"))]
        fx.commit(spark, table, 0, actions)
        return table

    return load(spark, cached(spark, sf_dir, name, make))


def query(name: str, oracle: str) -> Callable:
    def keep(make: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name], ORACLES[name] = make, oracle
        return make

    return keep


def over_orders(name: str, predicate: Predicate | None, where: str, columns: tuple[str, ...] = ("o_orderkey", "o_totalprice")) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(spark, sf_dir, "orders").scan().with_projection(list(columns)).with_predicate(predicate).build().execute()

    query(name, f"SELECT {', '.join(columns)} FROM orders WHERE {where}")(run)


def key(op: str, value: int) -> Compare:
    return Compare("o_orderkey", op, Scalar(BIG, value))


def price(op: str, value: float) -> Compare:
    return Compare("o_totalprice", op, Scalar(DOUBLE, value))


# ---- projection and predicates -----------------------------------------------------------------------


@query("scan_full", "SELECT * FROM orders")
def scan_full(spark, sf_dir):
    return plain(spark, sf_dir, "orders").to_df()


@query("scan_lineitem", "SELECT * FROM lineitem")
def scan_lineitem(spark, sf_dir):
    return plain(spark, sf_dir, "lineitem").to_df()


over_orders("project_reordered", None, "TRUE", ("o_orderdate", "o_custkey", "o_orderkey"))
over_orders("filter_eq", key("=", 42), "o_orderkey = 42")
over_orders("filter_ne", key("!=", 42), "o_orderkey <> 42")
over_orders("filter_lt", price("<", 50_000.0), "o_totalprice < 50000")
over_orders("filter_le", key("<=", 1_000), "o_orderkey <= 1000")
over_orders("filter_gt", price(">", 250_000.0), "o_totalprice > 250000")
over_orders("filter_ge", key(">=", 7_000), "o_orderkey >= 7000")
over_orders("filter_is_null", IsNull("o_orderstatus"), "o_orderstatus IS NULL")
over_orders("filter_is_not_null", IsNotNull("o_orderstatus"), "o_orderstatus IS NOT NULL")
over_orders(
    "filter_and_or_not",
    Or((And((key("<", 500), Not(price(">", 100_000.0)))), Compare("o_orderstatus", "=", Scalar(TEXT, "P")))),
    "(o_orderkey < 500 AND NOT o_totalprice > 100000) OR o_orderstatus = 'P'",
)
over_orders("filter_in", is_in("o_orderkey", [Scalar(BIG, v) for v in (1, 7, 99, 5_000)]), "o_orderkey IN (1, 7, 99, 5000)")
over_orders("filter_not_in", not_in("o_orderstatus", [Scalar(TEXT, v) for v in ("F", "O")]), "o_orderstatus NOT IN ('F', 'O')")
over_orders("filter_not_in_nothing", not_in("o_orderstatus", []), "o_orderstatus IS NOT NULL")
over_orders("filter_between", between("o_orderkey", Scalar(BIG, 100), Scalar(BIG, 900)), "o_orderkey BETWEEN 100 AND 900")
over_orders("filter_not_between", Not(between("o_totalprice", Scalar(DOUBLE, 10_000.0), Scalar(DOUBLE, 400_000.0))), "o_totalprice NOT BETWEEN 10000 AND 400000")
over_orders("filter_string", Compare("o_orderpriority", ">=", Scalar(TEXT, "3")), "o_orderpriority >= '3'", ("o_orderkey", "o_orderpriority"))
over_orders("filter_hidden_column", Compare("o_orderstatus", "=", Scalar(TEXT, "F")), "o_orderstatus = 'F'", ("o_custkey",))
over_orders("filter_timestamp_ntz", Compare("o_orderdate", "<", Scalar(NTZ, dt.datetime(1995, 3, 15))), "o_orderdate < TIMESTAMP '1995-03-15'", ("o_orderkey", "o_orderdate"))
over_orders("filter_empty_and", And(()), "TRUE")
over_orders("filter_empty_or", Or(()), "FALSE")
over_orders("filter_false", Boolean(False), "FALSE")
over_orders("filter_signed_zero", price("=", -0.0), "FALSE")


@query("filter_decimal", "SELECT o_orderkey, CAST(floor(o_totalprice) AS DOUBLE) AS amount FROM orders WHERE floor(o_totalprice) > 123456.78")
def filter_decimal(spark, sf_dir):
    frames = lambda: [source(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").cast("decimal(12,2)").alias("amount"))]
    table = written(spark, sf_dir, "decimals", frames, lambda made: made[0].schema.json())
    return table.scan().with_predicate(Compare("amount", ">", Scalar.decimal("123456.78", 12, 2))).build().execute().withColumn("amount", F.col("amount").cast("double"))


@query("empty_projection_count", "SELECT count(*) AS n FROM orders WHERE o_orderkey > 100")
def empty_projection_count(spark, sf_dir):
    return plain(spark, sf_dir, "orders").scan().with_projection([]).with_predicate(key(">", 100)).build().execute().agg(F.count(F.lit(1)).alias("n"))


# ---- limits ----------------------------------------------------------------------------------------


@query("limit_ordered", "SELECT o_orderkey FROM orders WHERE o_orderkey > 10 ORDER BY o_orderkey LIMIT 25")
def limit_ordered(spark, sf_dir):
    return plain(spark, sf_dir, "orders").scan().with_projection(["o_orderkey"]).with_predicate(key(">", 10)).build().execute().orderBy("o_orderkey").limit(25)


@query("limit_count", "SELECT least(count(*), 40) AS n FROM orders WHERE o_orderkey > 10")
def limit_count(spark, sf_dir):
    return plain(spark, sf_dir, "orders").scan().with_predicate(key(">", 10)).with_limit(40).build().execute().agg(F.count(F.lit(1)).alias("n"))


@query("limit_zero", "SELECT o_orderkey FROM orders LIMIT 0")
def limit_zero(spark, sf_dir):
    return plain(spark, sf_dir, "orders").scan().with_projection(["o_orderkey"]).with_limit(0).build().execute()


# ---- file skipping -----------------------------------------------------------------------------------

_PARTS = "(SELECT * REPLACE (nullif(o_orderpriority, '5-LOW') AS o_orderpriority) FROM orders)"


def over_parts(name: str, predicate: Predicate, where: str) -> None:
    columns = ["o_orderkey", "o_orderpriority", "o_totalprice"]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return by_priority(spark, sf_dir).scan().with_projection(columns).with_predicate(predicate).build().execute()

    query(name, f"SELECT {', '.join(columns)} FROM {_PARTS} WHERE {where}")(run)


def priority(op: str, value: str) -> Compare:
    return Compare("o_orderpriority", op, Scalar(TEXT, value))


over_parts("partition_eq", priority("=", "1-URGENT"), "o_orderpriority = '1-URGENT'")
over_parts("partition_range", And((priority(">", "1"), priority("<", "3"))), "o_orderpriority > '1' AND o_orderpriority < '3'")
over_parts("partition_null", IsNull("o_orderpriority"), "o_orderpriority IS NULL")
over_parts("partition_not_null", IsNotNull("o_orderpriority"), "o_orderpriority IS NOT NULL")
over_parts("partition_not_in", not_in("o_orderpriority", [Scalar(TEXT, "1-URGENT")]), "o_orderpriority NOT IN ('1-URGENT')")
over_parts("partition_and_stats", And((priority("=", "2-HIGH"), key("<", 2_000))), "o_orderpriority = '2-HIGH' AND o_orderkey < 2000")
over_parts("partition_or_data", Or((priority("=", "2-HIGH"), price(">", 300_000.0))), "o_orderpriority = '2-HIGH' OR o_totalprice > 300000")


@query("stats_skip_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 10 AND 400")
def stats_skip_range(spark, sf_dir):
    return by_key_range(spark, sf_dir).scan().with_projection(["o_orderkey", "o_totalprice"]).with_predicate(between("o_orderkey", Scalar(BIG, 10), Scalar(BIG, 400))).build().execute()


@query("scan_metrics", "SELECT count(*) AS estimated_rows, CAST(5 AS BIGINT) AS files_total FROM orders WHERE o_orderpriority = '1-URGENT'")
def scan_metrics(spark, sf_dir):
    found = by_priority(spark, sf_dir).scan().with_predicate(priority("=", "1-URGENT")).build().metrics.snapshot()
    return spark.createDataFrame([(found.estimated_rows, found.files_planned + found.files_filtered_during_planning)], "estimated_rows long, files_total long")


# ---- deletion vectors --------------------------------------------------------------------------------


@query("dv_scan", "SELECT * FROM orders WHERE o_orderkey % 97 <> 0")
def dv_scan(spark, sf_dir):
    return without_some(spark, sf_dir, "stored").to_df()


@query("dv_inline", "SELECT o_orderkey FROM orders WHERE o_orderkey % 97 <> 0")
def dv_inline(spark, sf_dir):
    return without_some(spark, sf_dir, "inline").scan().with_projection(["o_orderkey"]).build().execute()


@query("dv_filter", "SELECT o_orderkey FROM orders WHERE o_orderkey % 97 <> 0 AND o_totalprice > 200000")
def dv_filter(spark, sf_dir):
    return without_some(spark, sf_dir, "stored").scan().with_projection(["o_orderkey"]).with_predicate(price(">", 200_000.0)).build().execute()


@query("dv_multi_file", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderpriority = '3-MEDIUM'")
def dv_multi_file(spark, sf_dir):
    return without_some(spark, sf_dir, "many").scan().with_projection(["o_orderkey", "o_orderpriority"]).with_predicate(priority("=", "3-MEDIUM")).build().execute()


# ---- schemas -----------------------------------------------------------------------------------------


def _mapped_schema(logical: list[tuple[str, str]]) -> str:
    fields = [{"name": n, "type": t, "nullable": True, "metadata": {"delta.columnMapping.id": i + 1, "delta.columnMapping.physicalName": f"col-{i + 1}"}} for i, (n, t) in enumerate(logical)]
    return json.dumps({"type": "struct", "fields": fields})


_CUSTOMER = [("key", "long"), ("full name", "string"), ("balance", "double")]
_CUSTOMER_SQL = 'SELECT c_custkey AS key, c_name AS "full name", c_acctbal AS balance FROM customer'


def _customer(spark, sf_dir, names, ids=False):
    df = source(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").toDF(*names)
    return df.select(*[F.col(f"`{n}`").alias(n, metadata={"parquet.field.id": i + 1}) for i, n in enumerate(names)]) if ids else df


@query("column_mapping_name", _CUSTOMER_SQL + " WHERE c_acctbal > 0.5")
def column_mapping_name(spark, sf_dir):
    frames = lambda: [_customer(spark, sf_dir, ["col-1", "col-2", "col-3"])]
    table = written(spark, sf_dir, "mapped_name", frames, lambda _: _mapped_schema(_CUSTOMER), {"delta.columnMapping.mode": "name"}, ("columnMapping",))
    return table.scan().with_predicate(Compare("balance", ">", Scalar(DOUBLE, 0.5))).build().execute()


@query("column_mapping_id", _CUSTOMER_SQL)
def column_mapping_id(spark, sf_dir):
    frames = lambda: [_customer(spark, sf_dir, ["stale_a", "stale_b", "stale_c"], ids=True)]
    return written(spark, sf_dir, "mapped_id", frames, lambda _: _mapped_schema(_CUSTOMER), {"delta.columnMapping.mode": "id"}, ("columnMapping",)).to_df()


@query("schema_evolution_null_fill", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS p_name FROM part")
def schema_evolution_null_fill(spark, sf_dir):
    def frames():
        part = source(spark, sf_dir, "part").select("p_partkey", "p_name")
        return [part.filter("p_partkey % 2 = 0"), part.filter("p_partkey % 2 = 1").select("p_partkey")]

    return written(spark, sf_dir, "evolved", frames, lambda made: made[0].schema.json()).to_df()


@query("type_widening", "SELECT p_partkey, CAST(p_size AS BIGINT) AS wide, CAST(p_size AS DOUBLE) AS real FROM part WHERE p_size > 10")
def type_widening(spark, sf_dir):
    def frames():
        part = source(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("wide"), F.col("p_size").alias("real"))
        even = part.filter("p_partkey % 2 = 0").select("p_partkey", F.col("wide").cast("smallint").alias("wide"), "real")
        return [even, part.filter("p_partkey % 2 = 1")]

    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("p_partkey bigint, wide bigint, real double").json()
    return written(spark, sf_dir, "widened", frames, lambda _: schema, features=("typeWidening",)).scan().with_predicate(Compare("wide", ">", Scalar(BIG, 10))).build().execute()


@query("nested_struct", "SELECT c_custkey, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation, CAST(NULL AS VARCHAR) AS tier FROM customer")
def nested_struct(spark, sf_dir):
    from pyspark.sql.types import StructType

    frames = lambda: [source(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name")).alias("profile"))]
    schema = StructType.fromDDL("c_custkey bigint, profile struct<name:string,nation:bigint,tier:string>").json()
    df = written(spark, sf_dir, "nested_struct", frames, lambda _: schema).to_df()
    return df.select("c_custkey", "profile.name", "profile.nation", "profile.tier")


@query("nested_array", "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS first_key, o_orderstatus AS last_status FROM orders")
def nested_array(spark, sf_dir):
    from pyspark.sql.types import StructType

    item = lambda k: F.struct(F.col("o_orderstatus").alias("status"), k.cast("int").alias("key"))
    frames = lambda: [source(spark, sf_dir, "orders").select("o_orderkey", F.array(item(F.col("o_custkey")), item(F.col("o_orderkey"))).alias("items"))]
    schema = StructType.fromDDL("o_orderkey bigint, items array<struct<key:double,status:string>>").json()
    df = written(spark, sf_dir, "nested_array", frames, lambda _: schema).to_df()
    return df.select("o_orderkey", F.col("items")[0]["key"].alias("first_key"), F.col("items")[1]["status"].alias("last_status"))


@query("nested_map", "SELECT n_nationkey, n_name AS name FROM nation")
def nested_map(spark, sf_dir):
    from pyspark.sql.types import StructType

    frames = lambda: [source(spark, sf_dir, "nation").select("n_nationkey", F.create_map("n_nationkey", F.struct(F.col("n_name").alias("name"))).alias("by_key"))]
    schema = StructType.fromDDL("n_nationkey int, by_key map<bigint,struct<name:string,note:string>>").json()
    df = written(spark, sf_dir, "nested_map", frames, lambda _: schema).to_df()
    return df.select("n_nationkey", F.col("by_key")[F.col("n_nationkey").cast("bigint")]["name"].alias("name"))


# ---- versions ----------------------------------------------------------------------------------------


def changing(spark: SparkSession, sf_dir: str, version: int | None = None) -> Table:
    """Version 0: even keys; 1: odd keys added; 2: a checkpoint of the same; 3: the even keys removed."""

    def make() -> str:
        table, df = fx.scratch(spark), source(spark, sf_dir, "supplier")
        df.filter("s_suppkey % 2 = 0").write.parquet(f"{table}/even")
        df.filter("s_suppkey % 2 = 1").write.parquet(f"{table}/odd")
        even, odd = (fx.files_of(spark.read.parquet(f"{table}/{x}")) for x in ("even", "odd"))
        head = [{"protocol": fx.LEGACY}, fx.metadata(df.schema.json())]
        fx.commit(spark, table, 0, [*head, *[fx.add(f) for f in even]])
        fx.commit(spark, table, 1, [fx.add(f) for f in odd])
        fx.commit(spark, table, 2, [{"txn": {"appId": "a", "version": 1}}])
        fx.checkpoint(spark, table, 2, [*head, *[fx.add(f) for f in (*even, *odd)]])
        fx.commit(spark, table, 3, [fx.remove(f) for f in even])
        return table

    return load(spark, cached(spark, sf_dir, "changing", make), version)


@query("time_travel_v0", "SELECT * FROM supplier WHERE s_suppkey % 2 = 0")
def time_travel_v0(spark, sf_dir):
    return changing(spark, sf_dir, 0).to_df()


@query("checkpoint_replay", "SELECT * FROM supplier")
def checkpoint_replay(spark, sf_dir):
    return changing(spark, sf_dir, 2).to_df()


@query("latest_after_remove", "SELECT * FROM supplier WHERE s_suppkey % 2 = 1")
def latest_after_remove(spark, sf_dir):
    return changing(spark, sf_dir).to_df()


# ---- SQL over registered tables ------------------------------------------------------------------------


def over_sql(name: str, tables: dict[str, Callable[[SparkSession, str], Table]], text: str, oracle: str | None = None) -> None:
    """text uses {name} for each table; the oracle is the same text over the driver's tables unless given."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = {}
        for t, make in tables.items():
            names[t] = sql.scan_name()
            sql.register(spark, names[t], make(spark, sf_dir))
        return sql.query(spark, text.format(**names))

    query(name, oracle or text.format(**{t: t for t in tables}))(run)


def _plain(name: str) -> Callable[[SparkSession, str], Table]:
    return lambda spark, sf_dir: plain(spark, sf_dir, name)


over_sql("join_inner", {"orders": _plain("orders"), "customer": _plain("customer")}, "SELECT o.o_orderkey, c.c_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000")
over_sql(
    "join_two_registrations",
    {"orders": _plain("orders"), "lineitem": _plain("lineitem")},
    "SELECT o_orderpriority, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderpriority",
)
over_sql("agg_count_sum", {"orders": _plain("orders")}, "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM {orders} WHERE o_orderstatus = 'F'")
over_sql("like_residual", {"customer": _plain("customer")}, "SELECT c_custkey, c_name FROM {customer} WHERE c_name LIKE '%1%' AND c_custkey > 20")
over_sql("arith_residual", {"orders": _plain("orders")}, "SELECT o_orderkey FROM {orders} WHERE o_orderkey + 1 > 3000")
over_sql("topk", {"orders": _plain("orders")}, "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
over_sql("sql_qualified", {"orders": _plain("orders")}, "SELECT o.o_custkey, o.o_orderkey FROM {orders} AS o WHERE o.o_totalprice BETWEEN 1000 AND 90000 AND o.o_orderstatus IN ('F', 'P')")
over_sql(
    "sql_partition_prune",
    {"orders": by_priority},
    "SELECT o_orderkey, o_orderpriority FROM {orders} WHERE o_orderpriority = '2-HIGH' AND o_orderkey < 3000",
    f"SELECT o_orderkey, o_orderpriority FROM {_PARTS} WHERE o_orderpriority = '2-HIGH' AND o_orderkey < 3000",
)
over_sql(
    "sql_partition_functions",
    {"orders": by_priority},
    "SELECT o_orderpriority, count(*) AS n FROM {orders} WHERE startswith(o_orderpriority, '1') OR contains(o_orderpriority, 'HIGH') OR endswith(o_orderpriority, 'FIED') GROUP BY o_orderpriority",
    f"SELECT o_orderpriority, count(*) AS n FROM {_PARTS} WHERE starts_with(o_orderpriority, '1') OR contains(o_orderpriority, 'HIGH') OR suffix(o_orderpriority, 'FIED') GROUP BY o_orderpriority",
)
over_sql(
    "sql_window_and_sets",
    {"orders": _plain("orders")},
    "SELECT o_custkey, o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM {orders} UNION SELECT o_custkey, min(o_orderkey), CAST(0 AS BIGINT) FROM {orders} GROUP BY o_custkey",
)
over_sql(
    "sql_left_semi_anti",
    {"orders": _plain("orders"), "customer": _plain("customer")},
    "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 100000) EXCEPT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P'",
)


over_sql(
    "sql_join_filter_prune",
    {"orders": by_priority, "customer": _plain("customer")},
    "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND c_acctbal > 0",
    f"SELECT o_orderkey, c_name FROM {_PARTS} JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND c_acctbal > 0",
)


@query("sql_view_and_prune", f"SELECT count(*) AS urgent, (SELECT count(*) FROM orders) AS whole FROM {_PARTS} WHERE o_orderpriority = '1-URGENT'")
def sql_view_and_prune(spark, sf_dir):
    name, over = sql.scan_name(), sql.scan_name()
    sql.register(spark, name, by_priority(spark, sf_dir))
    spark.sql(f"CREATE TEMP VIEW {over} AS SELECT * FROM {name}")
    return sql.query(spark, f"SELECT count(*) AS urgent, (SELECT count(*) FROM {over}) AS whole FROM {name} WHERE o_orderpriority = '1-URGENT'")


@query("sql_concurrent", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY o_orderpriority")
def sql_concurrent(spark, sf_dir):
    """One table under one name, asked for each of its partitions by threads of their own."""
    from concurrent.futures import ThreadPoolExecutor

    name = sql.scan_name()
    sql.register(spark, name, by_priority(spark, sf_dir))
    asked = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
    with ThreadPoolExecutor(4) as pool:
        parts = list(pool.map(lambda p: sql.query(spark, f"SELECT o_orderpriority, count(*) AS n FROM {name} WHERE o_orderpriority = '{p}' GROUP BY o_orderpriority"), asked))
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("sql_join_key_prune", f"SELECT o_orderkey, label FROM {_PARTS} JOIN (VALUES ('1-URGENT', 'a'), ('4-NOT SPECIFIED', 'b')) AS k(p, label) ON o_orderpriority = p")
def sql_join_key_prune(spark, sf_dir):
    name = sql.scan_name()
    sql.register(spark, name, by_priority(spark, sf_dir))
    return sql.query(spark, f"SELECT o_orderkey, label FROM {name} JOIN (VALUES ('1-URGENT', 'a'), ('4-NOT SPECIFIED', 'b')) AS k(p, label) ON o_orderpriority = p")


@query("dv_metrics", "SELECT count(*) AS rows_produced, CAST((SELECT count(*) FROM orders WHERE o_orderkey % 97 = 0 AND o_totalprice > 200000) AS BIGINT) AS rows_deleted FROM orders WHERE o_orderkey % 97 <> 0 AND o_totalprice > 200000")
def dv_metrics(spark, sf_dir):
    scan = without_some(spark, sf_dir, "many").scan().with_predicate(price(">", 200_000.0)).build()
    scan.execute(observe=True).count()
    found = scan.finish()
    return spark.createDataFrame([(found.rows_produced, found.deletion_vector_rows_deleted)], "rows_produced long, rows_deleted long")


@query("project_by_index", "SELECT o_totalprice, o_orderkey FROM orders")
def project_by_index(spark, sf_dir):
    table = plain(spark, sf_dir, "orders")
    names = table.schema.fieldNames()
    return table.scan().with_projection_indexes([names.index("o_totalprice"), names.index("o_orderkey")]).build().execute()


@query("rebalanced_scan", "SELECT o_orderkey FROM orders")
def rebalanced_scan(spark, sf_dir):
    return plain(spark, sf_dir, "orders").scan().with_projection(["o_orderkey"]).with_target_partitions(3).with_repartitioning(Repartitioning.REBALANCE).build().execute()


@query("join_dynamic_prune", "SELECT o_orderpriority, o_orderkey, label FROM orders JOIN (VALUES ('1-URGENT', 'a'), ('4-NOT SPECIFIED', 'b')) AS k(o_orderpriority, label) USING (o_orderpriority)")
def join_dynamic_prune(spark, sf_dir):
    keys = spark.createDataFrame([("1-URGENT", "a"), ("4-NOT SPECIFIED", "b")], "o_orderpriority string, label string")
    return dynamic.join_pruned(by_priority(spark, sf_dir), keys, "o_orderpriority", ["o_orderkey"])
