"""Commit order: positions, their proof, and what to do without one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def position(file: Column, pos: Column) -> Column:
    """Comparable: shorter file names first, then by name, then by position."""
    return F.struct(F.length(file).alias("length"), file.alias("file"), pos.cast("decimal(20,0)").alias("pos"))


def lsn_position(pos: Column) -> Column:
    return pos.cast("decimal(20,0)")


def is_lsn(file: Column) -> Column:
    return F.contains(file, F.lit("/"))


def base_name(file: Column) -> Column:
    """A file name without its number."""
    return F.regexp_replace(file, r"\.\d+$", "")


def order_proof(changes: DataFrame, by: list[str], ids_proven: bool = True) -> DataFrame:
    """(by..., decision) for each group: whether its commit order is known, and why not.

    postgres: positions are log sequence numbers, ordered by themselves. no_coordinate: a file or position is missing.
    several_base_names: files of more than one series. ids_unproven: writers may have numbered at the same time. renumbered:
    a position goes back as ids go up. agrees: time order is that order already; sorted: it differs, and position order holds.
    """
    here, by_id = position(F.col("binlog_file"), F.col("start_pos")), Window.partitionBy(*by).orderBy("event_id")
    by_time = Window.partitionBy(*by).orderBy("event_timestamp", "event_id")
    marked = changes.select(*by, "event_id", "event_timestamp", "binlog_file", "start_pos", here.alias("here"))
    marked = marked.withColumn("back", F.col("here") < F.lag("here").over(by_id)).withColumn("late", F.col("event_id") < F.lag("event_id").over(by_time))
    facts = marked.groupBy(*by).agg(
        F.bool_or(F.col("binlog_file").isNull() | F.col("start_pos").isNull() | (F.col("binlog_file") == "")).alias("missing"),
        F.bool_and(is_lsn(F.col("binlog_file"))).alias("lsn"),
        F.count_distinct(base_name(F.col("binlog_file"))).alias("bases"),
        F.bool_or(F.coalesce("back", F.lit(False))).alias("back"),
        F.bool_or(F.coalesce("late", F.lit(False))).alias("late"),
    )
    decision = (
        F.when(F.col("missing"), "no_coordinate").when(F.col("lsn"), "postgres").when(F.col("bases") > 1, "several_base_names")
        .when(F.lit(not ids_proven), "ids_unproven").when(F.col("back"), "renumbered").when(F.col("late"), "sorted").otherwise("agrees")
    )
    return facts.select(*by, decision.alias("decision"))


def binlog_sorted(changes: DataFrame, descending: bool = False) -> DataFrame:
    here = position(F.col("binlog_file"), F.col("start_pos"))
    keys = [here, F.col("event_id")]
    return changes.orderBy(*[k.desc() if descending else k.asc() for k in keys])
