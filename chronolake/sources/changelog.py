"""Where changes come from: live tables, hourly archives, baselines read as changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.operators.predicates import ChangeFilter

SNAPSHOT_ID = 1 << 62


def archive(spark: SparkSession, path: str, wanted: ChangeFilter | None = None, sources: list[str] | None = None, mixed_columns: bool = False, source_column: str = "source_id") -> DataFrame:
    """An archive laid out as <source_column>=/event_date=/event_hour=; the filter's window prunes partitions, sources its ids.

    mixed_columns merges the files' schemas (reading every footer): only for archives whose files differ in columns.
    """
    df = spark.read.option("mergeSchema", str(mixed_columns).lower()).parquet(path)
    if sources is not None:
        df = df.where(F.col(source_column).cast("string").isin(*sources))
    if wanted is not None:
        df = wanted.apply(df.where(wanted.partition_condition()))
    return df


def by_column_set(groups: list[DataFrame]) -> DataFrame:
    """Files grouped by their columns, as one table; columns that a group lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), groups)


def id_range(changes: DataFrame, above: int, upto: int, page: int | None = None, tables: list[str] | None = None) -> DataFrame:
    """Changes with above < event_id <= upto, in id order: what a tail reads next."""
    out = changes.where((F.col("event_id") > above) & (F.col("event_id") <= upto))
    if tables is not None:
        out = out.where(F.col("table_name").isin(*tables))
    out = out.orderBy("event_id")
    return out.limit(page) if page is not None else out


def snapshot_changes(baseline: DataFrame, keys: list[str], schema_name: str, table_name: str) -> DataFrame:
    """A baseline's rows as changes of kind SNAPSHOT. Their ids are 2^62 and a number that no other row of the baseline has, equal
    rows included; numbers go by the rows' places in the baseline's files and have gaps."""
    from chronolake.functions.keys import join

    columns = sorted(baseline.columns)
    return baseline.select(
        (F.lit(SNAPSHOT_ID) + F.monotonically_increasing_id()).alias("event_id"),
        F.lit(schema_name).alias("schema_name"),
        F.lit(table_name).alias("table_name"),
        F.lit(6).alias("event_type"),
        join(*[F.col(k) for k in keys]).alias("pk_values"),
        F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("row_after"),
    )


def newest_snapshot(snapshots: DataFrame, at: str | None = None) -> DataFrame:
    """(table_name, snapshot_time, path): each table's newest complete snapshot at or before an instant."""
    there = snapshots.where("complete")
    if at is not None:
        there = there.where(F.col("snapshot_time") <= F.lit(at).cast("timestamp_ntz"))
    return there.groupBy("table_name").agg(F.max("snapshot_time").alias("snapshot_time"), F.max_by("path", "snapshot_time").alias("path"))


def events_log(events: DataFrame) -> DataFrame:
    """The table events as a change log of the table users: one user's events are the changes of one row.

    Signup inserts, an error deletes, all else updates; each image is the event it comes with. Times are cut to seconds, three
    events in a row share a transaction, and positions count the events of a day's file.
    """
    sql = log_sql("cast(date_trunc('second', ts) as timestamp_ntz)").replace("{", "{{").replace("}", "}}").replace("from events", "from {events}")
    return events.sparkSession.sql(sql, events=events)


def log_sql(seconds: str = "date_trunc('second', ts)") -> str:
    """The change log as SQL over events, for any engine; seconds is that engine's cut to seconds."""
    image = """concat('{"kind":"', event_type, '","cents":', cast(cast(floor(value * 100) as bigint) as string), '}')"""
    return LOG_SQL.replace("SECONDS", seconds).replace("IMAGE", image)


#: SECONDS stands for the event's time cut to seconds, IMAGE for its row image.
LOG_SQL = """
select event_id + 1 as event_id,
  concat('binlog.', lpad(cast(extract(doy from ts) as string), 6, '0')) as binlog_file,
  cast(row_number() over (partition by extract(doy from ts) order by ts, event_id) * 100 as bigint) as start_pos,
  SECONDS as event_timestamp,
  concat('g-', cast(cast(floor(event_id / 3) as bigint) as string)) as gtid,
  'app' as schema_name, 'users' as table_name,
  case event_type when 'signup' then 1 when 'error' then 3 else 2 end as event_type,
  cast(user_id as string) as pk_values,
  case when event_type <> 'error' then IMAGE end as row_after,
  lag(case when event_type <> 'error' then IMAGE end) over (partition by user_id order by ts, event_id) as row_before
from events
"""
