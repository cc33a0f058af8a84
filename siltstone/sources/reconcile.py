"""Read-time reconciliation: the columns of a data file reshaped to the table's schema.

Files are grouped by the shape of their footers. In each group every field is matched by field id where
the table has one, else by exact name; what is missing becomes NULL or fails; narrower types are widened.
A field that needs nothing is read as it is, so that pushdown and pruning reach it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.errors import DataFileRead, PhysicalToLogicalTransform
from siltstone.sources.files import hadoop_conf

#: Footers read at a time by the driver.
THREADS = 32


# ---- footers -------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[{};=]|[^\s{};=()]+(?:\((?:[^()]|\([^()]*\))*\))?|\((?:[^()]|\([^()]*\))*\)")


def described(message: str) -> list[dict]:
    """A Parquet schema in its text form as fields: name, field id, type and children of each."""
    tokens = iter(_TOKEN.findall(message[message.index("{") + 1 :]))

    def fields() -> list[dict]:
        out = []
        for repetition in tokens:
            if repetition == "}":
                break
            kind, name, mark, number = next(tokens), next(tokens), "", None
            while (token := next(tokens)) not in (";", "{"):
                if token == "=":
                    number = int(next(tokens))
                else:
                    mark = token[1:-1]
            own = {"name": name, "id": number, "repeated": repetition == "repeated"}
            out.append(own | (_group(mark, fields()) if token == "{" else {"type": _named(kind, mark)}))
        return out

    return fields()


def _group(mark: str, children: list[dict]) -> dict:
    if mark == "LIST" and len(children) == 1 and children[0]["repeated"]:
        inner = children[0]
        nested = inner["type"] == "struct" and len(inner["children"]) == 1 and inner["name"] != "array"
        return {"type": "list", "children": inner["children"] if nested else [inner]}
    if mark in ("MAP", "MAP_KEY_VALUE") and len(children) == 1:
        return {"type": "map", "children": children[0]["children"]}
    return {"type": "struct", "children": children}


def _named(kind: str, mark: str) -> str:
    """A primitive's type by the name that _leaf knows."""
    if found := re.fullmatch(r"DECIMAL\((\d+),(-?\d+)\)", mark):
        return f"decimal128({found[1]}, {found[2]})"
    if found := re.fullmatch(r"TIMESTAMP\((\w+),(\w+)\)", mark):
        return f"timestamp[{ {'MILLIS': 'ms', 'MICROS': 'us', 'NANOS': 'ns'}[found[1]] }{', tz=UTC' if found[2] == 'true' else ''}]"
    if found := re.fullmatch(r"INTEGER\((\d+),(\w+)\)", mark):
        return f"{'int' if found[2] == 'true' else 'uint'}{found[1]}"
    fixed = re.fullmatch(r"fixed_len_byte_array\((\d+)\)", kind)
    if fixed:
        return f"fixed_size_binary[{fixed[1]}]"
    if mark in ("TIMESTAMP_MILLIS", "TIMESTAMP_MICROS"):
        return f"timestamp[{'ms' if mark.endswith('LLIS') else 'us'}, tz=UTC]"
    # Annotations, and physical types without one.
    marks = {"STRING": "string", "UTF8": "string", "ENUM": "string", "JSON": "string", "DATE": "date32[day]", "INT_8": "int8", "INT_16": "int16", "INT_32": "int32", "INT_64": "int64"}
    plain = {"boolean": "bool", "int32": "int32", "int64": "int64", "float": "float", "double": "double", "binary": "binary", "int96": "timestamp[us]"}
    return marks.get(mark) or plain.get(kind, kind) if not mark or mark in marks else f"{kind} {mark}"


def footers(spark: SparkSession, paths: list[str], options: dict[str, str] | None = None, known: dict[str, str] | None = None) -> list[str]:
    """The fields of each file as JSON, in order, read through Hadoop with the table's options; known ones are not read again."""
    known = {} if known is None else known
    new = [p for p in dict.fromkeys(paths) if p not in known]
    if new:
        reader, path_of = spark._jvm.org.apache.parquet.hadoop.ParquetFileReader, spark._jvm.org.apache.hadoop.fs.Path
        conf, shapes = hadoop_conf(spark, options), {}

        def read(path: str) -> str:
            message = reader.readFooter(conf, path_of(path)).getFileMetaData().getSchema().toString()
            return shapes.setdefault(message, message)

        try:
            with ThreadPoolExecutor(min(THREADS, len(new))) as pool:
                found = list(pool.map(read, new))
            by_message = {m: json.dumps(described(m)) for m in shapes}
        except Exception as error:
            raise DataFileRead("data_file_footer_read_failed") from error
        known.update((p, by_message[m]) for p, m in zip(new, found, strict=True))
    return [known[p] for p in paths]


# ---- plans ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Shape:
    """How one field is read: its type for the reader, and what makes it logical (None: nothing)."""

    read: T.DataType
    turn: Callable[[Column], Column] | None


_INTS = {"int8": (T.ByteType(), 3), "int16": (T.ShortType(), 5), "int32": (T.IntegerType(), 10), "int64": (T.LongType(), 20)}
_PLAIN = {
    "bool": T.BooleanType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "large_string": T.StringType(),
    "string_view": T.StringType(), "binary": T.BinaryType(), "large_binary": T.BinaryType(), "date32[day]": T.DateType(),
}


def _leaf(kind: str, wanted: T.DataType) -> Shape:
    whole = _INTS.get(kind)
    if kind.startswith("timestamp[") and isinstance(wanted, (T.TimestampType, T.TimestampNTZType)):
        if kind.startswith("timestamp[ns"):
            return Shape(T.LongType(), lambda c: _from_nanos(c, wanted))
        return Shape(wanted, None)
    if _PLAIN.get(kind) == wanted or whole and whole[0] == wanted:
        return Shape(wanted, None)
    if kind.startswith("fixed_size_binary") and isinstance(wanted, T.BinaryType):
        return Shape(wanted, None)
    decimal = re.fullmatch(r"decimal(?:32|64|128)\((\d+), (-?\d+)\)", kind)
    if isinstance(wanted, T.DecimalType) and (decimal or whole):
        p, s = (int(decimal[1]), int(decimal[2])) if decimal else (whole[1], 0)
        if (p, s) == (wanted.precision, wanted.scale):
            return Shape(wanted, None)
        if wanted.precision >= p and wanted.scale >= s and wanted.precision - p >= wanted.scale - s:
            own = T.DecimalType(p, s) if decimal else T.IntegerType() if kind in ("int8", "int16") else whole[0]
            return Shape(own, lambda c: c.cast(wanted))
    elif whole and isinstance(wanted, (T.ShortType, T.IntegerType, T.LongType)) and _rank(whole[0]) < _rank(wanted):
        return Shape(whole[0], lambda c: c.cast(wanted))
    elif kind in ("int8", "int16", "int32") and isinstance(wanted, T.DoubleType) or kind == "float" and isinstance(wanted, T.DoubleType):
        own = whole[0] if whole else T.FloatType()
        return Shape(own, lambda c: c.cast("double"))
    elif kind == "date32[day]" and isinstance(wanted, T.TimestampNTZType):
        return Shape(T.DateType(), lambda c: c.cast("timestamp_ntz"))
    elif kind == "int32" and isinstance(wanted, T.DateType):
        return Shape(wanted, None)
    elif kind == "int64" and isinstance(wanted, (T.TimestampType, T.TimestampNTZType)):
        return Shape(T.LongType(), lambda c: _from_micros(c, wanted))
    raise PhysicalToLogicalTransform("unsupported_type_conversion")


def _rank(kind: T.DataType) -> int:
    return [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()].index(kind)


def _from_micros(c: Column, wanted: T.DataType) -> Column:
    if isinstance(wanted, T.TimestampType):
        return F.timestamp_micros(c)
    return F.make_timestamp_ntz(*(F.lit(x) for x in (1970, 1, 1, 0, 0)), F.lit(0).cast("decimal(16,6)")) + F.make_dt_interval(secs=(c / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(18,6)"))


def _from_nanos(c: Column, wanted: T.DataType) -> Column:
    return _from_micros(F.floor(c.cast("decimal(20,0)") / 1000).cast("bigint"), wanted)


def _ids(field: T.StructField) -> tuple[int | None, str]:
    meta = field.metadata or {}
    return meta.get("delta.columnMapping.id"), meta.get("delta.columnMapping.physicalName", field.name)


def _match(field: T.StructField, children: list[dict]) -> dict | None:
    number, name = _ids(field)
    if number is not None:
        same = [c for c in children if c["id"] == number]
        if len(same) > 1:
            raise DataFileRead("ambiguous_field_id")
        if same:
            return same[0]
    return next((c for c in children if c["name"] == name), None)


def _shape(wanted: T.DataType, found: dict, path: str) -> Shape:
    if isinstance(wanted, T.StructType):
        return _struct(wanted, found, path)
    if isinstance(wanted, T.ArrayType):
        if found["type"] != "list":
            raise PhysicalToLogicalTransform("unsupported_type_conversion")
        inner = _shape(wanted.elementType, found["children"][0], f"{path}.element")
        if inner.turn is None:
            return Shape(T.ArrayType(inner.read), None)
        if found["children"][0]["type"] not in ("struct", "list", "map"):
            raise PhysicalToLogicalTransform("unsupported_list_element_conversion")
        return Shape(T.ArrayType(inner.read), lambda c: F.transform(c, inner.turn))
    if isinstance(wanted, T.MapType):
        if found["type"] != "map":
            raise PhysicalToLogicalTransform("unsupported_type_conversion")
        key, value = (_shape(k, f, f"{path}.{n}") for k, f, n in zip((wanted.keyType, wanted.valueType), found["children"], ("key", "value"), strict=True))
        read = T.MapType(key.read, value.read)
        if key.turn is None and value.turn is None:
            return Shape(read, None)
        keys = lambda c: F.map_keys(c) if key.turn is None else F.transform(F.map_keys(c), key.turn)
        values = lambda c: F.map_values(c) if value.turn is None else F.transform(F.map_values(c), value.turn)
        return Shape(read, lambda c: F.map_from_arrays(keys(c), values(c)))
    if found["type"] in ("struct", "list", "map"):
        raise PhysicalToLogicalTransform("unsupported_type_conversion")
    return _leaf(found["type"], wanted)


def _struct(wanted: T.StructType, found: dict, path: str) -> Shape:
    if found["type"] != "struct":
        raise PhysicalToLogicalTransform("unsupported_type_conversion")
    reads, parts, same = [], [], True
    for f in wanted.fields:
        own = _match(f, found["children"])
        if own is None:
            if not f.nullable:
                raise DataFileRead("required_field_missing", f"{path}.{f.name}")
            same = False
            parts.append((f, None, None))
            continue
        inner = _shape(f.dataType, own, f"{path}.{f.name}")
        same = same and own["name"] == f.name and inner.turn is None
        reads.append(T.StructField(own["name"], inner.read))
        parts.append((f, own["name"], inner))
    if not reads:  # read some field, else Spark can't tell a NULL struct
        first = next((c for c in found["children"] if c["type"] in _PLAIN or c["type"] in _INTS), None)
        if first is None:
            raise DataFileRead("struct_without_known_fields")
        reads.append(T.StructField(first["name"], _PLAIN.get(first["type"]) or _INTS[first["type"]][0]))
    if same:
        return Shape(T.StructType(reads), None)

    def turn(c: Column) -> Column:
        made = [(F.lit(None).cast(f.dataType) if inner is None else c[name] if inner.turn is None else inner.turn(c[name])).alias(f.name) for f, name, inner in parts]
        return F.when(c.isNotNull(), F.struct(*made))

    return Shape(T.StructType(reads), turn)


@dataclass(frozen=True)
class ReadPlan:
    """The schema for Spark's reader, and the logical columns as expressions over it."""

    read_schema: T.StructType
    columns: list[Column]


def read_plan(fields: list[T.StructField], footer_json: str) -> ReadPlan:
    """How a group of files with this footer gives the table's (data) fields."""
    children = json.loads(footer_json)
    reads: dict[str, T.StructField] = {}
    columns = []
    for f in fields:
        found = _match(f, children)
        if found is None:
            if not f.nullable:
                raise DataFileRead("required_field_missing", f.name)
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        shape = _shape(f.dataType, found, f.name)
        reads[found["name"]] = T.StructField(found["name"], shape.read)
        own = F.col("`" + found["name"].replace("`", "``") + "`")
        columns.append((own if shape.turn is None else shape.turn(own)).alias(f.name))
    return ReadPlan(T.StructType(list(reads.values())), columns)
