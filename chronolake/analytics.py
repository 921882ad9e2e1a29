"""Analytical queries over the star tables: aggregates, joins, windows, sets, functions and reports.

Importing this module registers them with those of chronolake.queries.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolake.functions import dialect
from chronolake.queries import log, query, table

plain = partial(query, logged=False)


def cents(c: str):
    """A price column as an exact decimal, so that sums don't depend on their order."""
    return F.col(c).cast("decimal(18,2)")


def exact(c: str) -> str:
    return f"cast({c} as decimal(18,2))"


# --- aggregates --------------------------------------------------------------------------------------------------------


@plain(f"""select l_returnflag, l_linestatus, cast(sum({exact('l_quantity')}) as varchar) as sum_qty, cast(sum({exact('l_extendedprice')}) as varchar) as sum_price, count(*) as n, count(distinct l_suppkey) as suppliers,
min(l_shipdate) as first_ship, max(l_shipdate) as last_ship, count(*) filter (where l_discount > 0.05) as discounted from lineitem where l_shipdate <= timestamp '2001-01-01' group by all""")
def pricing_summary(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '2001-01-01'")
    return items.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(cents("l_quantity")).cast("string").alias("sum_qty"), F.sum(cents("l_extendedprice")).cast("string").alias("sum_price"), F.count("*").alias("n"),
        F.count_distinct("l_suppkey").alias("suppliers"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"),
    )


@plain("select l_suppkey, cast(cast(round(cast(sum(cast(l_quantity as bigint)) as decimal(30,0)) / count(*), 4) as decimal(30,4)) as varchar) as avg_qty from lineitem group by l_suppkey having count(*) > 1 and sum(cast(l_quantity as bigint)) * 100000 % count(*) >= 0 order by 1")
def exact_average(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("bigint"))
    return items.groupBy("l_suppkey").agg(dialect.exact_average(F.col("q")).cast("string").alias("avg_qty"), F.count("*").alias("n")).where("n > 1").drop("n")


@plain("select o_orderpriority, cast((sum(o_custkey) * 2 * 100 + count(*)) // (2 * count(*)) as bigint) as hundredths from orders group by 1")
def rounded_ratio(spark, sf_dir):
    r = dialect.ratio(F.sum("o_custkey"), F.count("*"), 2)
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg((r * 100).cast("bigint").alias("hundredths"))


@plain("select o_orderstatus, median(o_totalprice) as mid, quantile_disc(o_totalprice, 0.25) as low, arg_min(o_orderkey, (o_totalprice, o_orderkey)) as cheapest, arg_max(o_orderkey, (o_totalprice, o_orderkey)) as dearest from orders group by 1")
def quantiles_and_extremes(spark, sf_dir):
    at = F.struct("o_totalprice", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.median("o_totalprice").alias("mid"), F.expr("percentile_disc(0.25) within group (order by o_totalprice)").alias("low"), F.min_by("o_orderkey", at).alias("cheapest"), F.max_by("o_orderkey", at).alias("dearest")
    )


GROUPED = "select coalesce(o_orderstatus, '*') as status, coalesce(o_orderpriority, '*') as priority, count(*) as n from orders group by {} (o_orderstatus, o_orderpriority)"


@plain(GROUPED.format("rollup"))
def rollup_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n")


@plain(GROUPED.format("cube"))
def cube_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n")


@plain(GROUPED.format("grouping sets").replace("(o_orderstatus, o_orderpriority)", "((o_orderstatus), (o_orderpriority))"))
def grouping_set_counts(spark, sf_dir):
    grouped = table(spark, sf_dir, "orders").groupingSets([["o_orderstatus"], ["o_orderpriority"]], "o_orderstatus", "o_orderpriority")
    return grouped.agg(F.count("*").alias("n")).select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n")


@plain("select p_brand, string_agg(distinct p_type, ',' order by p_type) as types, array_to_string(list_sort(list(distinct p_size)), ',') as sizes from part group by 1")
def ordered_lists(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"), F.array_join(F.array_sort(F.collect_set("p_size")).cast("array<string>"), ",").alias("sizes"))


@plain("select bit_or(o_orderkey) as ors, bit_and(o_orderkey) as ands, bool_or(o_orderstatus = 'F') as any_f, bool_and(o_totalprice > 0) as all_paid, count(distinct (o_custkey, o_orderstatus)) as pairs from orders")
def bit_and_boolean(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.bit_or("o_orderkey").alias("ors"), F.bit_and("o_orderkey").alias("ands"), F.bool_or(F.col("o_orderstatus") == "F").alias("any_f"), F.bool_and(F.col("o_totalprice") > 0).alias("all_paid"), F.count_distinct("o_custkey", "o_orderstatus").alias("pairs"))


@plain()
def approximate_counts(spark, sf_dir):
    """No SQL: sketches differ from engine to engine."""
    return table(spark, sf_dir, "lineitem").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_extendedprice", 0.5).alias("mid"))


# --- joins -------------------------------------------------------------------------------------------------------------


@plain(f"""select n_name, cast(sum({exact('o_totalprice')}) as varchar) as total, count(*) as n from customer join orders on c_custkey = o_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' group by 1""")
def inner_join_chain(spark, sf_dir):
    customer, orders, nation, region = (table(spark, sf_dir, t) for t in ("customer", "orders", "nation", "region"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey).join(region.where("r_name = 'ASIA'"), nation.n_regionkey == region.r_regionkey)
    return joined.groupBy("n_name").agg(F.sum(cents("o_totalprice")).cast("string").alias("total"), F.count("*").alias("n"))


@plain("select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'F' group by 1")
def left_join_counts(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return customer.join(orders, customer.c_custkey == orders.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@plain("select c_custkey, s_suppkey from customer full join supplier on c_custkey = s_suppkey and c_nationkey = s_nationkey")
def full_join(spark, sf_dir):
    a, b = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return a.join(b, (a.c_custkey == b.s_suppkey) & (a.c_nationkey == b.s_nationkey), "full_outer").select("c_custkey", "s_suppkey")


@plain("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def semi_join(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    customer = table(spark, sf_dir, "customer")
    return customer.join(big, customer.c_custkey == big.o_custkey, "left_semi").select("c_custkey")


@plain("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def anti_join(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return customer.join(orders, customer.c_custkey == orders.o_custkey, "left_anti").select("c_custkey")


@plain("select r_name, n_name from region, nation where r_regionkey <> n_regionkey")
def theta_join(spark, sf_dir):
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    return region.join(nation, region.r_regionkey != nation.n_regionkey).select("r_name", "n_name")


@plain("select c_custkey, o_orderkey, o_totalprice from customer, lateral (select o_orderkey, o_totalprice from orders where o_custkey = c_custkey order by o_totalprice desc, o_orderkey limit 2) t")
def lateral_top(spark, sf_dir):
    """The lateral form's meaning as a window: one shuffle by customer instead of a query for each."""
    best = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    orders = table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(best)).where("k <= 2")
    customer = table(spark, sf_dir, "customer")
    return customer.join(orders, customer.c_custkey == orders.o_custkey).select("c_custkey", "o_orderkey", "o_totalprice")


@plain("select l.l_orderkey, l.l_linenumber, l.l_shipdate, max(o.o_orderdate) as last_order from lineitem l join orders k on l.l_orderkey = k.o_orderkey left join orders o on o.o_custkey = k.o_custkey and o.o_orderdate <= l.l_shipdate group by l.l_orderkey, l.l_linenumber, l.l_shipdate")
def as_of_join(spark, sf_dir):
    """Each item's customer's newest order at or before its shipping: both sides in one sorted pass by customer."""
    orders = table(spark, sf_dir, "orders")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").distinct()
    left = items.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select("o_custkey", F.col("l_shipdate").alias("at"), F.lit(1).alias("side"), "l_orderkey", "l_linenumber", F.lit(None).cast("timestamp_ntz").alias("date"))
    right = orders.select("o_custkey", F.col("o_orderdate").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("l_orderkey"), F.lit(None).cast("int").alias("l_linenumber"), F.col("o_orderdate").alias("date"))
    upto = Window.partitionBy("o_custkey").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right).withColumn("last_order", F.last("date", ignorenulls=True).over(upto)).where("side = 1").select("l_orderkey", "l_linenumber", F.col("at").alias("l_shipdate"), "last_order")


@plain("select o_orderkey, p_partkey from orders join part on o_totalprice between p_retailprice * 300 and p_retailprice * 300 + 30")
def range_join(spark, sf_dir):
    """Prices within a range, by buckets of its width: an equi-join on the bucket and its neighbour, then the exact test."""
    width = 30.0
    orders = table(spark, sf_dir, "orders").withColumn("b", F.floor(F.col("o_totalprice") / width))
    part = table(spark, sf_dir, "part").withColumn("low", F.col("p_retailprice") * 300)
    part = part.withColumn("b", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("low") + width) / width))))
    return orders.join(part, "b").where((F.col("o_totalprice") >= F.col("low")) & (F.col("o_totalprice") <= F.col("low") + width)).select("o_orderkey", "p_partkey")


# --- windows -----------------------------------------------------------------------------------------------------------


@plain("""select o_orderkey, row_number() over w as rn, rank() over r as rk, dense_rank() over r as dr, ntile(4) over w as quarter, lag(o_orderkey) over w as before, lead(o_orderkey) over w as after
from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey), r as (partition by o_custkey order by o_orderstatus)""")
def window_ranks(spark, sf_dir):
    w, r = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderstatus")
    long = lambda c: c.cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", long(F.row_number().over(w)).alias("rn"), long(F.rank().over(r)).alias("rk"), long(F.dense_rank().over(r)).alias("dr"), long(F.ntile(4).over(w)).alias("quarter"), F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"))


@plain(f"select o_orderkey, cast(sum({exact('o_totalprice')}) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row) as varchar) as recent, count(*) over (partition by o_custkey order by o_orderdate range between interval 90 days preceding and current row) as quarter from orders")
def window_frames(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("day", F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")))
    recent = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    quarter = Window.partitionBy("o_custkey").orderBy("day").rangeBetween(-90, 0)
    return orders.select("o_orderkey", F.sum(cents("o_totalprice")).over(recent).cast("string").alias("recent"), F.count("*").over(quarter).alias("quarter"))


@plain("select o_orderkey, median(o_totalprice) over (partition by o_custkey) as mid from orders")
def window_median(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.median("o_totalprice").over(Window.partitionBy("o_custkey")).alias("mid"))


@query("select event_id, start_pos < lag(start_pos) over (partition by binlog_file order by event_id) as back from log")
def monotone_positions(spark, sf_dir):
    own = Window.partitionBy("binlog_file").orderBy("event_id")
    return log(spark, sf_dir).select("event_id", (F.col("start_pos") < F.lag("start_pos").over(own)).alias("back"))


# --- order and limits --------------------------------------------------------------------------------------------------


@plain("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey, l_suppkey limit 20 offset 5000")
def deep_offset(spark, sf_dir):
    order = [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return table(spark, sf_dir, "lineitem").orderBy(*order).offset(5000).limit(20).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@plain("select * from nation order by n_name, n_nationkey, n_regionkey limit 7")
def order_by_all(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return nation.orderBy(*sorted(nation.columns)).limit(7)


@query("select event_id, event_timestamp from log where (event_timestamp, event_id) > (timestamp '2024-01-10', 3000) order by event_timestamp, event_id limit 40")
def keyset_page(spark, sf_dir):
    from datetime import datetime

    from chronolake.operators.predicates import ChangeFilter

    return ChangeFilter(after_event=(datetime(2024, 1, 10), 3000)).apply(log(spark, sf_dir)).orderBy("event_timestamp", "event_id").limit(40).select("event_id", "event_timestamp")


# --- sets --------------------------------------------------------------------------------------------------------------


@plain("select c_nationkey as k from customer intersect select s_nationkey from supplier where s_acctbal > 5000")
def set_intersect(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")))


@plain("select c_custkey % 50 as k from customer except all select s_suppkey % 40 from supplier")
def set_except_all(spark, sf_dir):
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") % 50).alias("k")).exceptAll(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 40).alias("k")))


@plain("select lower(c_mktsegment) as k from customer union select lower(p_type) from part")
def set_union_folded(spark, sf_dir):
    """Texts that differ by case alone are one, as under the source's collation."""
    both = table(spark, sf_dir, "customer").select(F.collate("c_mktsegment", "UTF8_LCASE").alias("k")).union(table(spark, sf_dir, "part").select(F.collate(F.lower("p_type"), "UTF8_LCASE").alias("k")))
    return both.distinct().select(F.lower(F.col("k").cast("string")).alias("k"))


@plain("with recursive r(n, total) as (select 1, 1::bigint union all select n + 1, total + n + 1 from r where n < 60) select n, total from r")
def recursive_sums(spark, sf_dir):
    return spark.sql("with recursive r(n, total) as (select 1, 1L union all select n + 1, total + n + 1 from r where n < 60) select n, total from r")


# --- functions ---------------------------------------------------------------------------------------------------------


@plain("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') as text, datediff('day', date '1996-02-29', cast(o_orderdate as date)) as days, year(o_orderdate) as y, quarter(o_orderdate) as q, dayofyear(o_orderdate) as doy from orders")
def date_functions(spark, sf_dir):
    at = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", dialect.date_format(at, "%Y-%m-%d %H:%i").alias("text"), dialect.datediff(at, F.lit("1996-02-29")).cast("long").alias("days"), F.year(at).cast("long").alias("y"), F.quarter(at).cast("long").alias("q"), F.dayofyear(at).cast("long").alias("doy"))


@plain("select o_orderkey, datesub('month', timestamp '1997-01-15 10:00:00', o_orderdate) as months, datesub('hour', timestamp '1997-01-15 10:00:00', o_orderdate) as hours from orders")
def timestamp_differences(spark, sf_dir):
    start, at = F.lit("1997-01-15 10:00:00").cast("timestamp_ntz"), F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", dialect.timestampdiff("MONTH", start, at).alias("months"), dialect.timestampdiff("HOUR", start, at).alias("hours"))


@plain("select o_orderkey, o_orderdate + interval 1 month as later, o_orderdate - interval 13 month as earlier, cast(epoch(o_orderdate) as bigint) as seconds from orders")
def date_arithmetic(spark, sf_dir):
    at = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", dialect.date_add_months(at, 1).alias("later"), dialect.date_add_months(at, -13).alias("earlier"), dialect.unix_timestamp(at).alias("seconds"))


@plain("select p_partkey, length(p_name) as chars, strlen(p_name) as bytes, upper(p_name) as up, substring(p_name, 2, 3) as mid, concat(p_brand, '/', p_type) as both, p_name ilike '%RED%' as red, replace(p_name, ' ', '_') as snake from part")
def text_functions(spark, sf_dir):
    c = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.char_length(c).cast("long").alias("chars"), F.octet_length(c).cast("long").alias("bytes"), F.upper(c).alias("up"), dialect.substring(c, 2, 3).alias("mid"), F.concat("p_brand", F.lit("/"), "p_type").alias("both"), dialect.like(c, "%RED%").alias("red"), F.replace(c, F.lit(" "), F.lit("_")).alias("snake"))


@plain("select p_partkey, case when p_size % 7 = 0 then null else least(p_size, 20) end as low, case when p_size % 7 = 0 then null else greatest(p_size, 20) end as high, p_size % 5 as m, p_size // 3 as d, abs(p_size - 25) as a from part")
def null_and_number_functions(spark, sf_dir):
    size = F.col("p_size")
    gap = F.when(size % 7 != 0, size)
    return table(spark, sf_dir, "part").select("p_partkey", dialect.least(gap, F.lit(20)).alias("low"), dialect.greatest(gap, F.lit(20)).alias("high"), (size % 5).alias("m"), F.expr("cast(p_size div 3 as int)").alias("d"), F.abs(size - 25).alias("a"))


@plain("select event_id, cast(props->>'k' as integer) as k from events")
def json_functions(spark, sf_dir):
    from chronolake.functions import images

    return table(spark, sf_dir, "events").select("event_id", images.text(F.col("props"), "k").cast("int").alias("k"))


@query("select pk_values as joined, pk_values as only_part, sha256(pk_values) as hash, cast(true as boolean) as canonical from log")
def key_functions(spark, sf_dir):
    from chronolake.functions import keys

    c = F.col("pk_values")
    return log(spark, sf_dir).select(keys.join(keys.split(c)[0]).alias("joined"), keys.split(c)[0].alias("only_part"), keys.pk_hash(c).alias("hash"), keys.is_canonical_integer(c).alias("canonical"))


# --- reports -----------------------------------------------------------------------------------------------------------


@plain("select l_partkey % 100 as bucket, count(*) as n, cast(sum(length(l_returnflag || l_linestatus)) as bigint) as chars from lineitem group by 1")
def report_buckets(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 100).alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.length(F.concat("l_returnflag", "l_linestatus"))).alias("chars"))


@plain(f"select l_suppkey, count(*) as n, cast(sum({exact('l_extendedprice')}) as varchar) as total from lineitem where l_quantity between 10 and 30 and l_shipdate >= timestamp '1998-01-01' group by 1")
def report_filtered(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").where("l_quantity between 10 and 30 and l_shipdate >= timestamp_ntz '1998-01-01'")
    return items.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(cents("l_extendedprice")).cast("string").alias("total"))


@plain(f"select o_orderkey, o_orderdate, cast(sum({exact('l_extendedprice')}) as varchar) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where c_mktsegment = 'BUILDING' and o_orderdate < timestamp '1998-03-15' and l_shipdate > timestamp '1998-03-15' group by 1, 2")
def shipping_priority(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = table(spark, sf_dir, "orders").where("o_orderdate < timestamp_ntz '1998-03-15'").select("o_orderkey", "o_custkey", "o_orderdate")
    items = table(spark, sf_dir, "lineitem").where("l_shipdate > timestamp_ntz '1998-03-15'").select("l_orderkey", "l_extendedprice")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey, "left_semi").join(items, orders.o_orderkey == items.l_orderkey)
    return joined.groupBy("o_orderkey", "o_orderdate").agg(F.sum(cents("l_extendedprice")).cast("string").alias("revenue"))


# --- streams -----------------------------------------------------------------------------------------------------------


def events_stream(spark, sf_dir):
    """The table events as a stream of one file, with the columns that stream operators name."""
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet")
    return raw.withColumns({"event_time": F.col("ts").cast("timestamp"), "event_timestamp": F.col("ts"), "pk_values": F.col("user_id").cast("string")})


@plain("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by all")
def hourly_windows(spark, sf_dir):
    from chronolake.streaming import changes as stream

    events = table(spark, sf_dir, "events").withColumn("event_time", F.col("ts").cast("timestamp"))
    return stream.windows(events, "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@plain("""with m as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hour then 0 else 1 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts) as k from m)
select cast(user_id as varchar) as pk_values, min(ts) as start, max(ts) + interval 2 hour as "end", count(*) as n from s group by user_id, k""")
def user_sessions(spark, sf_dir):
    from chronolake.streaming import changes as stream

    events = table(spark, sf_dir, "events").withColumns({"event_time": F.col("ts").cast("timestamp"), "pk_values": F.col("user_id").cast("string")})
    found = stream.sessions(events, "2 hours")
    return found.select("pk_values", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@plain("select cast(user_id as varchar) as pk_values, arg_max(event_id, (ts, event_id)) as event_id, max(ts) as event_timestamp, arg_max(event_type, (ts, event_id)) as event_type from events group by user_id")
def stream_tail(spark, sf_dir):
    """The newest change of each key, kept by micro-batches: every batch folds into the table that the last one left."""
    import uuid

    from chronolake.streaming import changes as stream

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or "/tmp"
    home = f"{base}/tail-{uuid.uuid4().hex}"
    columns = ["pk_values", "event_id", "event_timestamp", "event_type"]

    def each(batch, n: int) -> None:
        before = spark.read.parquet(f"{home}/{n - 1}") if n else batch.select(*columns).limit(0)
        stream.upsert_tail(before, batch).write.mode("overwrite").parquet(f"{home}/{n}")

    done = stream.run_batches(events_stream(spark, sf_dir), each, f"{home}/at")
    last = done.lastProgress.batchId if done.lastProgress else 0
    return spark.read.parquet(f"{home}/{last}")
