"""All queries of the library over the driver's tables, and their SQL for DuckDB.

The change log is derived from the table events (sources.changelog.events_log), by one SQL text for both engines.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolake.functions import dialect, images, keys
from chronolake.operators import compare, deltas, fold, merge, ordering, recover
from chronolake.operators.predicates import ChangeFilter, flagged
from chronolake.plans import coverage, timetravel
from chronolake.sources import changelog, writers
from chronolake.streaming import changes as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LOG = f"log as ({changelog.log_sql()})"
AT = datetime(2024, 1, 15, 12)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.events_log(table(spark, sf_dir, "events"))


def query(sql: str | None = None, logged: bool = True):
    """Registers a query under its function's name, with its SQL over the tables (and log)."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"with {LOG}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}" if logged else sql
        return f

    return put


# --- scans -------------------------------------------------------------------------------------------------------------


def halves(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The log as a live index (later events) and an archive (earlier ones, and a stretch that both have)."""
    changes = log(spark, sf_dir)
    edge, overlap = datetime(2024, 1, 15), datetime(2024, 1, 17)
    live = changes.where(F.col("event_timestamp") >= F.lit(edge).cast("timestamp_ntz"))
    old = changes.where(F.col("event_timestamp") < F.lit(overlap).cast("timestamp_ntz")).withColumn("row_after", F.when(F.col("event_id") % 97 == 0, F.lit("{}")).otherwise(F.col("row_after")))
    return [live, old]


HALVES = """
live as (select *, 0 as src from log where event_timestamp >= timestamp '2024-01-15'),
old as (select * replace (case when event_id % 97 = 0 then '{}' else row_after end as row_after), 1 as src from log where event_timestamp < timestamp '2024-01-17'),
merged as (select * from (select *, row_number() over (partition by event_id order by src) as k from (select * from live union all select * from old)) where k = 1)
"""


@query("select event_id, event_timestamp, pk_values, event_type, row_after from log where event_id > 1000 and event_id <= 2000 order by event_id limit 300")
def id_range_scan(spark, sf_dir):
    found = changelog.id_range(log(spark, sf_dir), 1000, 2000, 300, ["users"])
    return found.select("event_id", "event_timestamp", "pk_values", "event_type", "row_after")


@query("select event_id, pk_values, event_type, row_before, row_after from log where event_id = 4321")
def event_by_id(spark, sf_dir):
    return ChangeFilter(event_id=4321).apply(log(spark, sf_dir)).select("event_id", "pk_values", "event_type", "row_before", "row_after")


@query("""+a as (select event_id, pk_values, event_type from log where event_id % 3 = 0), b as (select event_id, pk_values, gtid from log where event_id % 3 = 1)
select event_id, pk_values, cast(event_type as varchar) as event_type, cast(null as varchar) as gtid from a union all select event_id, pk_values, null, gtid from b""")
def archive_column_groups(spark, sf_dir):
    changes = log(spark, sf_dir)
    return changelog.by_column_set([changes.where("event_id % 3 = 0").select("event_id", "pk_values", "event_type"), changes.where("event_id % 3 = 1").select("event_id", "pk_values", "gtid")]).withColumn("event_type", F.col("event_type").cast("string"))


@query("select 'app' as schema_name, 'nation' as table_name, 6 as event_type, cast(n_nationkey as varchar) as pk_values, n_name from nation", logged=False)
def snapshot_as_changes(spark, sf_dir):
    found = changelog.snapshot_changes(table(spark, sf_dir, "nation"), ["n_nationkey"], "app", "nation")
    return found.select("schema_name", "table_name", "event_type", "pk_values", images.text(F.col("row_after"), "n_name").alias("n_name"))


@query("""+a as (select event_id, '{"kind":"k","cents":' || event_id || '}' as x, '{"cents":' || event_id || (case when event_id % 5 = 0 then '.5' else '' end) || ',"kind":"k"}' as y from log)
select event_id, cast(2 as bigint) as copies, x <> '{"kind":"k",' || replace(replace(y, '{', ''), ',"kind":"k"', '') as diverges from a""")
def divergence_of_reordered_images(spark, sf_dir):
    changes = log(spark, sf_dir)
    one = changes.select("event_id", F.concat(F.lit('{"kind":"k","cents":'), "event_id", F.lit("}")).alias("row_after"))
    half = F.when(F.col("event_id") % 5 == 0, ".5").otherwise("")
    other = changes.select("event_id", F.concat(F.lit('{"cents":'), "event_id", half, F.lit(',"kind":"k"}')).alias("row_after"))
    return merge.divergence([one, other], ["row_after"])


@query("select event_id, pk_values from (select *, row_number() over (partition by pk_values order by event_timestamp desc, event_id desc) as k from log where event_timestamp <= timestamp '2024-01-20') where k = 1 and event_type <> 3 and row_after like '%\"kind\":\"purchase\"%'")
def time_travel_where_column(spark, sf_dir):
    asked = timetravel.parse("SELECT event_id, pk_values FROM _flashback.users AS OF '2024-01-20' WHERE kind = 'purchase'", datetime(2024, 2, 1))
    return timetravel.run(asked, log(spark, sf_dir))


@query("select count(*) as n, count(*) as ids, min(l_orderkey) is not null as there from lineitem", logged=False)
def snapshot_ids(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")  # with equal rows
    found = changelog.snapshot_changes(lines, ["l_orderkey"], "app", "lineitem")
    return found.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), (F.min("event_id") >= changelog.SNAPSHOT_ID).alias("there"))


@query("""+hits as (select * from log where (length(binlog_file), binlog_file, start_pos) < (13, 'binlog.000004', 5000))
select count(*) as n, arg_min(event_id, event_id) as first_id, min(event_timestamp) as first_at, (select event_id from hits order by event_timestamp desc, event_id desc limit 1) as last_id, max(event_timestamp) as last_at from hits""")
def first_below_mark(spark, sf_dir):
    below = ordering.position(F.col("binlog_file"), F.col("start_pos")) < ordering.position(F.lit("binlog.000004"), F.lit(5000))
    return merge.first_and_last(log(spark, sf_dir), below)


@query("""+snaps as (select schema_t as table_name, cast(t as timestamp) as snapshot_time, ok from (values ('a','2024-01-01',true),('a','2024-01-09',true),('a','2024-01-12',false),('b','2024-01-03',true),('b','2024-02-01',true)) v(schema_t, t, ok))
select table_name, max(snapshot_time) as snapshot_time, table_name || '/' || strftime(max(snapshot_time), '%Y-%m-%d') as path from snaps where ok and snapshot_time <= timestamp '2024-01-15' group by table_name""")
def newest_snapshots(spark, sf_dir):
    rows = [("a", "2024-01-01", True), ("a", "2024-01-09", True), ("a", "2024-01-12", False), ("b", "2024-01-03", True), ("b", "2024-02-01", True)]
    snaps = spark.createDataFrame(rows, "table_name string, t string, complete boolean").select("table_name", F.col("t").cast("timestamp_ntz").alias("snapshot_time"), "complete", F.concat_ws("/", "table_name", "t").alias("path"))
    return changelog.newest_snapshot(snaps, "2024-01-15 00:00:00")


# --- filters -----------------------------------------------------------------------------------------------------------

SHOWN = ["event_id", "event_timestamp", "pk_values", "event_type"]
SHOWN_SQL = "select event_id, event_timestamp, pk_values, event_type from log where "


def filtered(name: str, wanted: ChangeFilter, sql: str) -> None:
    def run(spark, sf_dir):
        return wanted.apply(log(spark, sf_dir)).select(*SHOWN)

    run.__name__ = name
    query(SHOWN_SQL + sql)(run)


filtered("filter_pk", ChangeFilter(schema="app", table="users", pk="42"), "pk_values = '42'")
filtered("filter_pk_in", ChangeFilter(pk_in=("7", "8", "no such")), "pk_values in ('7', '8', 'no such')")
filtered("filter_pk_range", ChangeFilter(pk_range=(5, 9)), "regexp_full_match(pk_values, '0|-?[1-9][0-9]*') and cast(pk_values as decimal(20,0)) between 5 and 9")
filtered("filter_event_type", ChangeFilter(event_type=3), "event_type = 3")
filtered("filter_gtid", ChangeFilter(gtid="g-77"), "gtid = 'g-77'")
filtered("filter_window", ChangeFilter(since=datetime(2024, 1, 5), until=datetime(2024, 1, 6, 12, 0, 0)), "event_timestamp between timestamp '2024-01-05' and timestamp '2024-01-06 12:00:00'")
filtered("filter_after_event", ChangeFilter(after_event=(datetime(2024, 1, 29), 5)), "(event_timestamp, event_id) > (timestamp '2024-01-29', 5)")
filtered("filter_before_event", ChangeFilter(before_event=(datetime(2024, 1, 2), 5)), "(event_timestamp, event_id) < (timestamp '2024-01-02', 5)")
filtered("filter_positions", ChangeFilter(since_position=("binlog.000003", 400), until_position=("binlog.000003", 9000)), "binlog_file = 'binlog.000003' and start_pos between 400 and 9000")
filtered("filter_column_equals", ChangeFilter(column_equals=("kind", "purchase")), "row_before like '%\"kind\":\"purchase\"%' or row_after like '%\"kind\":\"purchase\"%'")
filtered("filter_deny_allow", ChangeFilter(deny_tables=("ORDERS",), allow_tables=("users",), pk="3"), "pk_values = '3'")


@query("select event_id, '{\"kind\":null,\"cents\":' || regexp_extract(row_after, '\"cents\":(-?\\d+)', 1) || '}' as wanted from log where pk_values = '11' and event_type <> 3")
def filter_redacted(spark, sf_dir):
    return ChangeFilter(pk="11", redact=("kind",)).apply(log(spark, sf_dir)).where("event_type <> 3").select("event_id", F.col("row_after").alias("wanted"))


@query("select event_id, event_timestamp, pk_values, event_type from log")
def filter_flagged(spark, sf_dir):
    flags = spark.createDataFrame([("app", "users", "pii"), ("app", "orders", "big")], "schema_name string, table_name string, flag string")
    return flagged(log(spark, sf_dir), flags, "pii").select(*SHOWN)


# --- merging and order -------------------------------------------------------------------------------------------------


@query(f"+{HALVES} select event_id, event_timestamp, pk_values, event_type, row_after from merged")
def merge_dedup(spark, sf_dir):
    return merge.dedup(halves(spark, sf_dir)).select("event_id", "event_timestamp", "pk_values", "event_type", "row_after")


@query(f"""+{HALVES} select l.event_id, cast(2 as bigint) as copies, coalesce(l.row_after, '') <> coalesce(o.row_after, '') as diverges from live l join old o on l.event_id = o.event_id""")
def merge_divergence(spark, sf_dir):
    # a deleted row's image is null; its SQL tells that from an image without fields
    return merge.divergence(halves(spark, sf_dir), ["event_timestamp", "pk_values", "event_type", "row_after", "gtid"], null_is_empty=False)


@query("select event_id, event_timestamp, pk_values, event_type from (select *, row_number() over (partition by pk_values order by event_timestamp desc, event_id desc) as k from log) where k <= 3")
def limit_per_pk(spark, sf_dir):
    return merge.limit_per_pk(log(spark, sf_dir), 3).select(*SHOWN)


@query(f"+{HALVES} select event_id, event_timestamp, pk_values, event_type from (select *, row_number() over (partition by pk_values order by event_timestamp desc, event_id desc) as n from merged) where n <= 2 order by event_timestamp desc, event_id desc limit 50")
def merge_and_trim(spark, sf_dir):
    return merge.merge_and_trim(halves(spark, sf_dir), 2, 50, descending=True).select(*SHOWN)


def shuffled(changes: DataFrame) -> DataFrame:
    """The log with statement times that run behind for some transactions, as slow ones have."""
    slow = F.col("event_id") % 7 == 0
    return changes.withColumn("event_timestamp", F.when(slow, F.col("event_timestamp") - F.expr("interval 6 hours")).otherwise(F.col("event_timestamp")))


SLOW = "slow as (select * replace (case when event_id % 7 = 0 then event_timestamp - interval 6 hour else event_timestamp end as event_timestamp) from log)"


@query(f"""+{SLOW}, c as (select *, row_number() over (partition by pk_values order by event_timestamp desc, event_id desc) as t, row_number() over (partition by pk_values order by event_id desc) as i from slow),
j as (select *, bool_and((t <= 2) = (i <= 2)) over (partition by pk_values) as agreed, row_number() over (partition by pk_values order by length(binlog_file) desc, binlog_file desc, start_pos desc, event_id desc) as p from c)
select event_id, pk_values, case when agreed then 'agrees' else 'sorted' end as decision from j where case when agreed then t else p end <= 2""")
def latest_per_pk(spark, sf_dir):
    return merge.latest_per_pk(shuffled(log(spark, sf_dir)), 2).select("event_id", "pk_values", "decision")


@query(f"""+{SLOW}, m as (select *, event_id < lag(event_id) over (partition by pk_values order by event_timestamp, event_id) as late from slow)
select pk_values, case when bool_or(coalesce(late, false)) then 'sorted' else 'agrees' end as decision from m group by pk_values""")
def order_proof(spark, sf_dir):
    return ordering.order_proof(shuffled(log(spark, sf_dir)), ["pk_values"])


@query("select event_id, pk_values, min(start_pos) over (partition by pk_values, binlog_file) as low, max(start_pos) over (partition by pk_values, binlog_file) as high from log")
def key_span(spark, sf_dir):
    own = Window.partitionBy("pk_values", "binlog_file")
    return log(spark, sf_dir).select("event_id", "pk_values", F.min("start_pos").over(own).alias("low"), F.max("start_pos").over(own).alias("high"))


@query("select event_id, binlog_file, start_pos from log order by length(binlog_file) desc, binlog_file desc, start_pos desc, event_id desc limit 100")
def binlog_sorted(spark, sf_dir):
    return ordering.binlog_sorted(log(spark, sf_dir), descending=True).limit(100).select("event_id", "binlog_file", "start_pos")


# --- coverage ----------------------------------------------------------------------------------------------------------

BUSY = "busy as (select date_trunc('hour', event_timestamp) as hour from log group by 1 having count(*) >= 16)"


def busy_hours(spark, sf_dir) -> DataFrame:
    return log(spark, sf_dir).groupBy(F.date_trunc("hour", "event_timestamp").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n")).where("n >= 16").select("hour")


@query(f"+{BUSY} select hour from (select unnest(range(timestamp '2024-01-03', timestamp '2024-01-08', interval 1 hour)) as hour) where hour not in (select hour from busy)")
def coverage_gaps(spark, sf_dir):
    window = spark.sql("select timestamp_ntz '2024-01-03' as start, timestamp_ntz '2024-01-08' as end")
    return coverage.gap_hours(window, busy_hours(spark, sf_dir))


@query(f"+{BUSY}, i as (select hour, hour - interval 1 hour * row_number() over (order by hour) as island from busy) select min(hour) as start, max(hour) + interval 1 hour as \"end\", count(*) as hours from i group by island")
def contiguous_ranges(spark, sf_dir):
    return coverage.contiguous(busy_hours(spark, sf_dir))


@query("""+laid as (select *, cast(event_timestamp as date) as event_date, cast(extract(hour from event_timestamp) as integer) as event_hour from log)
select 'src' as source_id, cast(event_date as varchar) as event_date, event_hour, count(*) as rows, min(event_timestamp) as min_ts, max(event_timestamp) as max_ts, max(event_id) as max_id from laid group by all""")
def partition_figures(spark, sf_dir):
    laid = log(spark, sf_dir).withColumns({"source_id": F.lit("src"), "event_date": F.to_date("event_timestamp"), "event_hour": F.hour("event_timestamp")})
    return writers.partition_figures(laid).withColumn("event_date", F.col("event_date").cast("string"))


@query("""+r as (select strftime(event_timestamp, 'p_%Y%m%d') as partition_name, 's' as source_id, count(*) as rows from log where event_timestamp < timestamp '2024-01-20' group by all),
f as (select strftime(event_timestamp, 'p_%Y%m%d') as partition_name, 's' as source_id, count(*) + case when extract(day from min(event_timestamp)) = 7 then 1 else 0 end as rows from log where event_timestamp >= timestamp '2024-01-05' group by all)
select coalesce(r.partition_name, f.partition_name) as partition_name, 's' as source_id, case when r.rows is null then 'insert' when f.rows is null then 'prune' when r.rows <> f.rows then 'update' else 'same' end as verdict from r full join f on r.partition_name = f.partition_name""")
def reconcile_archive(spark, sf_dir):
    by_day = log(spark, sf_dir).groupBy(F.concat(F.lit("p_"), F.date_format("event_timestamp", "yyyyMMdd")).alias("partition_name"), F.lit("s").alias("source_id"), F.to_date("event_timestamp").alias("day")).agg(F.count("*").alias("rows"))
    registry = by_day.where("day < date '2024-01-20'")
    files = by_day.where("day >= date '2024-01-05'").withColumn("rows", F.col("rows") + F.when(F.dayofmonth("day") == 7, 1).otherwise(0))
    return writers.reconcile(registry, files)


# --- time travel -------------------------------------------------------------------------------------------------------

STATE = "select pk_values, row_after, event_id from (select *, row_number() over (partition by pk_values order by event_timestamp desc, event_id desc) as k from {}) where k = 1 and event_type <> 3"


@query(STATE.format("log"))
def state_at_latest(spark, sf_dir):
    return fold.state_at(log(spark, sf_dir))


@query(STATE.format("log where event_timestamp <= timestamp '2024-01-15 12:00:00'"))
def state_at_instant(spark, sf_dir):
    return fold.state_at(log(spark, sf_dir), AT)


@query(f"+{SLOW} select pk_values, row_after, event_id from (select *, row_number() over (partition by pk_values order by length(binlog_file) desc, binlog_file desc, start_pos desc, event_id desc) as k from slow) where k = 1 and event_type <> 3")
def state_by_position(spark, sf_dir):
    return fold.state_at(shuffled(log(spark, sf_dir)), by_position=True)


@query("""+base as (select cast(c_custkey as varchar) as pk_values, c_mktsegment as row_after from customer),
last as (select * from (select *, row_number() over (partition by pk_values order by event_timestamp desc, event_id desc) as k from log where event_timestamp <= timestamp '2024-01-15 12:00:00') where k = 1)
select coalesce(b.pk_values, l.pk_values) as pk_values, case when l.pk_values is null then b.row_after else l.row_after end as row_after from base b full join last l on b.pk_values = l.pk_values where l.pk_values is null or l.event_type <> 3""")
def snapshot_as_of(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("pk_values"), F.col("c_mktsegment").alias("row_after"))
    return fold.snapshot_at(base, log(spark, sf_dir), AT)


@query("select cast(row_number() over (order by event_timestamp, event_id) as integer) as step, event_id, event_timestamp, event_type, case when event_type <> 3 then row_after end as state from log where pk_values = '17'")
def row_history(spark, sf_dir):
    return fold.history(log(spark, sf_dir), "17")


@query("select event_id, event_timestamp, pk_values, event_type from log where pk_values = '9' and event_timestamp between timestamp '2024-01-04' and timestamp '2024-01-20'")
def row_diff(spark, sf_dir):
    asked = timetravel.parse("SELECT event_id, event_timestamp, pk_values, event_type FROM _diff.users BETWEEN '2024-01-04' AND '2024-01-20' WHERE id = 9", datetime(2024, 2, 1))
    return timetravel.run(asked, log(spark, sf_dir))


@query(STATE.format("log where event_timestamp <= timestamp '2024-01-25 00:00:00'"))
def flashback_statement(spark, sf_dir):
    return timetravel.run(timetravel.parse("SELECT * FROM _flashback.users AS OF '7 days ago'", datetime(2024, 2, 1)), log(spark, sf_dir))


@query(STATE.format("log where event_timestamp <= timestamp '2024-01-10 00:00:00' and pk_values = '12'").replace(", event_id from", " from", 1))
def hint_statement(spark, sf_dir):
    return timetravel.run(timetravel.parse("SELECT /*+ TRAVEL_AT='2024-01-10 00:00:00' */ pk_values, row_after FROM users WHERE id = 12", datetime(2024, 2, 1)), log(spark, sf_dir))


@query("""+cut as (select timestamp '2024-01-15 12:00:00' as t), up as (select * from log where event_timestamp <= (select t from cut)),
lastg as (select gtid from up order by event_timestamp desc, event_id desc limit 1), on_after as (select distinct gtid from log where event_timestamp > (select t from cut))
select event_id, gtid from up where gtid not in (select gtid from lastg where gtid in (select gtid from on_after))""")
def trim_partial_transaction(spark, sf_dir):
    return fold.trim_partial_transaction(log(spark, sf_dir), AT).select("event_id", "gtid")


MOVED = "case when event_type = 2 and event_id % 11 = 0 then cast(cast(pk_values as integer) + 1000 as varchar) end"


@query(f"""+m as (select *, {MOVED} as key_after from log),
s as (select event_id, 0 as part, pk_values, case when key_after is null then event_type else 3 end as event_type, case when key_after is null then row_after end as row_after, event_timestamp from m
      union all select event_id, 1, key_after, 1, row_after, event_timestamp from m where key_after is not null)
select pk_values, row_after, event_id from (select *, row_number() over (partition by pk_values order by event_timestamp desc, event_id desc, part desc) as k from s) where k = 1 and event_type <> 3""")
def key_change_state(spark, sf_dir):
    moved = F.when((F.col("event_type") == 2) & (F.col("event_id") % 11 == 0), (F.col("pk_values").cast("int") + 1000).cast("string"))
    return fold.state_at(fold.split_key_changes(log(spark, sf_dir), moved))


@query("""+net as (select *, row_number() over (partition by pk_values order by length(binlog_file) desc, binlog_file desc, start_pos desc, event_id desc) as k, min(event_id) over (partition by pk_values) as first_touch from log where event_timestamp >= timestamp '2024-01-20')
select pk_values, case when event_type = 3 then 'delete' else 'put' end as op, case when event_type <> 3 then row_after end as row_after, first_touch from net where k = 1""")
def net_changes(spark, sf_dir):
    return fold.net_changes(ChangeFilter(since=datetime(2024, 1, 20)).apply(log(spark, sf_dir)))


@query("""+u as (select *, case when event_id % 5 = 0 and event_type = 2 then null else regexp_extract(row_after, '"kind":"([a-z]+)"', 1) end as sent from log where event_type <> 3 or true),
l as (select *, coalesce(sum(case when event_type = 3 then 1 else 0 end) over (partition by pk_values order by event_timestamp, event_id rows between unbounded preceding and 1 preceding), 0) as life from u)
select event_id, last_value(case when event_type <> 3 then sent end ignore nulls) over (partition by pk_values, life order by event_timestamp, event_id rows between unbounded preceding and current row) as kind_value from l qualify event_type <> 3""")
def carry_unsent(spark, sf_dir):
    marker = F.lit('{"kind":{"%s":true}}' % images.UNCHANGED)
    unsent = log(spark, sf_dir).withColumn("row_after", F.when((F.col("event_id") % 5 == 0) & (F.col("event_type") == 2), marker).otherwise(F.col("row_after")))
    return fold.carry_unsent(unsent, "kind").where("event_type <> 3").select("event_id", "kind_value")


EPOCHS = [(1, "2023-12-01"), (2, "2024-01-08"), (3, "2024-01-21")]


@query("select event_id, case when event_timestamp >= timestamp '2024-01-21' then 3 when event_timestamp >= timestamp '2024-01-08' then 2 else 1 end as epoch from log")
def epoch_as_of(spark, sf_dir):
    epochs = spark.createDataFrame(EPOCHS, "epoch int, t string").select("epoch", F.col("t").cast("timestamp_ntz").alias("epoch_from"))
    return fold.as_of_epoch(log(spark, sf_dir), epochs).select("event_id", "epoch")


# --- deltas ------------------------------------------------------------------------------------------------------------


def order_chain(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderkey").alias("row_index"))
    dead = [base.where(f"o_orderkey % {n} = 0").select("row_index") for n in (10, 15)]
    upserts = [
        base.where(f"o_orderkey % {n} = 0").select("o_orderkey", F.lit(status).alias("o_orderstatus"), (F.col("o_totalprice") + n).alias("o_totalprice"), F.lit(seq).alias("seq"), (F.col("o_orderkey") % gone == 0).alias("deleted"))
        for seq, (n, status, gone) in enumerate(((10, "X", 100), (15, "Y", 90)))
    ]
    return base, dead, upserts


CHAIN = """
alive as (select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey % 10 <> 0 and o_orderkey % 15 <> 0),
ups as (select o_orderkey, 'X' as o_orderstatus, o_totalprice + 10 as o_totalprice, 0 as seq, o_orderkey % 100 = 0 as deleted from orders where o_orderkey % 10 = 0
  union all select o_orderkey, 'Y', o_totalprice + 15, 1, o_orderkey % 90 = 0 from orders where o_orderkey % 15 = 0),
newest as (select * from (select *, row_number() over (partition by o_orderkey order by seq desc) as k from ups) where k = 1)
"""
CHAIN_STATE = f"with {CHAIN} select * from alive union all select o_orderkey, o_orderstatus, o_totalprice from newest where not deleted"


@query(CHAIN_STATE, logged=False)
def delta_chain_state(spark, sf_dir):
    base, dead, upserts = order_chain(spark, sf_dir)
    return deltas.chain_state(base, dead[0].unionByName(dead[1]), upserts[0].unionByName(upserts[1]), ["o_orderkey"], ["row_index"])


@query(CHAIN_STATE, logged=False)
def delta_chain_compacted(spark, sf_dir):
    base, dead, upserts = order_chain(spark, sf_dir)
    return deltas.chain_state(base, *deltas.compact(dead, upserts, ["o_orderkey"]), ["o_orderkey"], ["row_index"])


@query("select o_orderkey >> 6 as block, bit_or(case when o_orderkey & 63 = 63 then (-9223372036854775807 - 1)::bigint else 1::bigint << (o_orderkey & 63)::integer end) as bits from orders where o_orderkey % 10 = 0 group by 1", logged=False)
def dead_bitmap(spark, sf_dir):
    return deltas.dead_bitmap(table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("row_index")))


@query("select * from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 49)", logged=False)
def locate_changed(spark, sf_dir):
    changed = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return deltas.locate(table(spark, sf_dir, "orders"), changed, ["o_orderkey"])


@query(STATE.format("log").replace(", event_id from", " from", 1))
def incremental_export(spark, sf_dir):
    changes = log(spark, sf_dir)
    first = writers.export(None, changes.where("event_timestamp < timestamp_ntz '2024-01-16'"))
    return writers.export(first, changes.where("event_timestamp >= timestamp_ntz '2024-01-16'"))


@query("select event_id, gtid, event_type, sha256(pk_values) as pk_hash from log")
def split_payload(spark, sf_dir):
    return writers.split_payload(log(spark, sf_dir))[0].select("event_id", "gtid", "event_type", "pk_hash")


# --- recovery ----------------------------------------------------------------------------------------------------------



@query("""+i as (select *, regexp_extract(row_after, '"kind":"([a-z]+)"', 1) as ka, regexp_extract(row_after, '"cents":(-?\\d+)', 1) as ca, regexp_extract(row_before, '"kind":"([a-z]+)"', 1) as kb, regexp_extract(row_before, '"cents":(-?\\d+)', 1) as cb from log),
q as (select *, case when row_before is null then 'NULL' else '''' || kb || '''' end as kq, case when row_before is null then 'NULL' else '''' || cb || '''' end as cq from i)
select event_id, case event_type when 1 then 'DELETE FROM `users` WHERE `kind` = ''' || ka || ''' AND `cents` = ''' || ca || ''';'
 when 3 then 'INSERT INTO `users` (`kind`, `cents`) VALUES (' || kq || ', ' || cq || ');'
 else 'UPDATE `users` SET `kind` = ' || kq || ', `cents` = ' || cq || ' WHERE `kind` = ''' || ka || ''' AND `cents` = ''' || ca || ''';' end as statement from q""")
def reversal_statements(spark, sf_dir):
    return recover.reversal_sql(log(spark, sf_dir), ["kind", "cents"], "users")


@query("""+b as (select * replace (case when event_id % 50 = 0 then '{}' else row_before end as row_before) from log),
m as (select *, lag(row_after) over w as was, row_number() over w as n from b window w as (partition by pk_values order by event_timestamp, event_id))
select event_id, pk_values from m where n > 1 and row_before is distinct from was""")
def chain_check(spark, sf_dir):
    broken = log(spark, sf_dir).withColumn("row_before", F.when(F.col("event_id") % 50 == 0, F.lit("{}")).otherwise(F.col("row_before")))
    return recover.chain_check(broken)


FKS = [("region", "nation", "CASCADE", "RESTRICT"), ("nation", "customer", "CASCADE", "RESTRICT"), ("nation", "supplier", "RESTRICT", "RESTRICT"), ("customer", "orders", "SET NULL", "RESTRICT"), ("orders", "lineitem", "CASCADE", "CASCADE"), ("supplier", "part", "CASCADE", "RESTRICT"), ("lineitem", "orders", "CASCADE", "RESTRICT")]
FK_VALUES = ", ".join(str(x) for x in FKS)


@query(f"""with recursive fk as (select * from (values {FK_VALUES}) v(parent, child, delete_rule, update_rule)),
reach(t) as (select 'region' union select child from reach join fk on parent = t where delete_rule in ('CASCADE', 'SET NULL') or update_rule = 'CASCADE')
select fk.* from fk where parent in (select t from reach)""", logged=False)
def foreign_key_closure(spark, sf_dir):
    return recover.affected_tables(spark.createDataFrame(FKS, "parent string, child string, delete_rule string, update_rule string"), "region")


@query("select *, 'insert' as action from orders where o_custkey in (select c_custkey from customer where c_nationkey = 7)", logged=False)
def cascade_victims(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_nationkey = 7")
    return recover.cascade_victims(gone, table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "CASCADE")


# --- comparison --------------------------------------------------------------------------------------------------------

ROW_TEXT = "concat_ws('|', coalesce(length(cast(n_name as varchar)) || ':' || n_name, '-'), coalesce(length(cast(n_nationkey as varchar)) || ':' || n_nationkey, '-'), coalesce(length(cast(n_regionkey as varchar)) || ':' || n_regionkey, '-'))"


@query(f"select count(*) as rows, cast(sum(cast(('0x' || substr(sha256({ROW_TEXT}), 1, 15))::bigint as hugeint)) as varchar) as digest from nation", logged=False)
def table_digest(spark, sf_dir):
    return compare.digest(table(spark, sf_dir, "nation")).withColumn("digest", F.col("digest").cast("string"))


@query("""with a as (select o_orderstatus, o_orderpriority from orders where o_orderkey % 3 <> 0), b as (select o_orderstatus, o_orderpriority from orders where o_orderkey % 3 <> 1),
n as (select o_orderstatus, o_orderpriority, sum(x) as n from (select *, 1 as x from a union all select *, -1 from b) group by all having sum(x) <> 0)
select o_orderstatus, o_orderpriority, cast(greatest(n, 0) as bigint) as only_a, cast(greatest(-n, 0) as bigint) as only_b from n""", logged=False)
def multiset_difference(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    a, b = (orders.where(f"o_orderkey % 3 <> {k}").select("o_orderstatus", "o_orderpriority") for k in (0, 1))
    return compare.multiset_difference(a, b)


@query("""select o_orderkey, case when o_orderkey % 20 = 0 then 'only_b' when o_orderkey % 21 = 0 then 'only_a' else 'differs' end as verdict from orders
where (o_orderkey % 20 = 0) <> (o_orderkey % 21 = 0) or (o_orderkey % 20 <> 0 and o_orderkey % 21 <> 0 and o_orderkey % 22 = 0 and o_orderstatus <> 'Z')""", logged=False)
def version_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    other = orders.where("o_orderkey % 21 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 22 == 0, F.lit("Z")).otherwise(F.col("o_orderstatus")))
    return compare.by_key(orders.where("o_orderkey % 20 <> 0"), other, ["o_orderkey"])


from chronolake import analytics  # noqa: E402, F401  registers its queries here
