"""The change event, its kinds, and how source types are stored."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# The numbers of the event kinds, never renumbered.
EVENT_TYPES = {"INSERT": 1, "UPDATE": 2, "DELETE": 3, "DDL": 4, "GTID": 5, "SNAPSHOT": 6}

POSITION = T.DecimalType(20, 0)  # unsigned 64-bit positions don't fit a long

CHANGE = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("binlog_file", T.StringType()),
    T.StructField("start_pos", POSITION),
    T.StructField("end_pos", POSITION),
    T.StructField("event_timestamp", T.TimestampNTZType()),
    T.StructField("gtid", T.StringType()),
    T.StructField("connection_id", T.LongType()),
    T.StructField("schema_name", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("event_type", T.IntegerType()),
    T.StructField("pk_values", T.StringType()),
    T.StructField("changed_columns", T.StringType()),
    T.StructField("row_before", T.StringType()),
    T.StructField("row_after", T.StringType()),
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("query_text", T.StringType()),
    T.StructField("query_hash", T.StringType()),
    T.StructField("commit_ts_us", T.LongType()),
])

_PLAIN = {
    T.IntegerType(): "tinyint smallint mediumint year int integer",
    T.LongType(): "bigint",
    T.FloatType(): "float",
    T.DoubleType(): "double real",
    T.TimestampNTZType(): "datetime timestamp",
    T.DateType(): "date",
    T.BinaryType(): "bit binary varbinary tinyblob blob mediumblob longblob geometry point vector",
    T.StringType(): "char varchar tinytext text mediumtext longtext enum set json time uuid inet4 inet6",
}
_BY_NAME = {name: kind for kind, names in _PLAIN.items() for name in names.split()}


def column_type(declared: str) -> T.DataType:
    """The Spark type of a declared source type. Decimals of more than 38 digits stay text; unknown types are an error."""
    m = re.match(r"\s*([a-z0-9]+)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?(.*)", declared.lower())
    if not m:
        raise ValueError(f"not a type: {declared!r}")
    name, precision, scale, rest = m[1], m[2], m[3], m[4]
    if name in ("decimal", "numeric"):
        p, s = int(precision or 10), int(scale or 0)
        return T.DecimalType(p, s) if p <= 38 else T.StringType()
    if name not in _BY_NAME:
        raise ValueError(f"unknown type: {declared!r}")
    if "unsigned" in rest:
        return {"int": T.LongType(), "integer": T.LongType(), "bigint": T.DecimalType(20, 0)}.get(name, _BY_NAME[name])
    return _BY_NAME[name]


def table_schema(columns: list[tuple[str, str]]) -> T.StructType:
    """(name, declared type) pairs of one schema epoch as a StructType, for typed reading of row images."""
    return T.StructType([T.StructField(name, column_type(kind)) for name, kind in columns])
