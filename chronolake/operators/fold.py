"""State from changes: the last image of each key at an instant, histories, net changes, table versions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolake.functions import images
from chronolake.operators.ordering import position

DELETE = 3


def at_or_before(changes: DataFrame, at: datetime) -> DataFrame:
    """The changes up to an instant: cut first, ordered after."""
    return changes.where(F.col("event_timestamp") <= F.lit(at).cast("timestamp_ntz"))


def trim_partial_transaction(changes: DataFrame, at: datetime) -> DataFrame:
    """changes at the instant without its last transaction, if that goes on after the instant's second."""
    end = F.lit(at).cast("timestamp_ntz")
    upto = changes.where(F.col("event_timestamp") <= end)
    last = upto.where("gtid is not null").agg(F.max_by("gtid", F.struct("event_timestamp", "event_id")).alias("gtid"))
    on = changes.where(F.col("event_timestamp") > end).select("gtid").distinct()
    return upto.join(F.broadcast(last.join(on, "gtid", "left_semi")), "gtid", "left_anti").select(changes.columns)


def commit_order(by_position: bool) -> Column:
    return F.struct(position(F.col("binlog_file"), F.col("start_pos")), F.col("event_id")) if by_position else F.struct("event_timestamp", "event_id")


def split_key_changes(changes: DataFrame, key_after: Column) -> DataFrame:
    """Each update that changes its key as two changes: the old key's delete, then the new key's insert.

    pk_values is the key before; key_after the key after an update, null or equal where it stays. Column part orders the two.
    """
    moves = (F.col("event_type") == 2) & key_after.isNotNull() & (key_after != F.col("pk_values"))
    two = F.array(
        F.struct(F.lit(0).alias("part"), F.col("pk_values").alias("pk"), F.lit(DELETE).alias("kind"), F.col("row_before").alias("before"), F.lit(None).cast("string").alias("after")),
        F.struct(F.lit(1).alias("part"), key_after.alias("pk"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("before"), F.col("row_after").alias("after")),
    )
    one = F.array(F.struct(F.lit(0).alias("part"), F.col("pk_values").alias("pk"), F.col("event_type").alias("kind"), F.col("row_before").alias("before"), F.col("row_after").alias("after")))
    out = changes.withColumn("_c", F.explode(F.when(moves, two).otherwise(one)))
    keep = [c for c in changes.columns if c not in ("pk_values", "event_type", "row_before", "row_after")]
    return out.select(*keep, F.col("_c.part").alias("part"), F.col("_c.pk").alias("pk_values"), F.col("_c.kind").alias("event_type"), F.col("_c.before").alias("row_before"), F.col("_c.after").alias("row_after"))


def last_changes(changes: DataFrame, by_position: bool = False) -> DataFrame:
    """(pk_values, event_type, row_after, event_id): the last change of each key; one combined aggregate."""
    order = F.struct(commit_order(by_position).alias("o"), F.col("part") if "part" in changes.columns else F.lit(0).alias("part"))
    last = changes.groupBy("pk_values").agg(F.max_by(F.struct("event_type", "row_after", "event_id"), order).alias("c"))
    return last.select("pk_values", "c.event_type", "c.row_after", "c.event_id")


def state_at(changes: DataFrame, at: datetime | None = None, by_position: bool = False) -> DataFrame:
    """(pk_values, row_after, event_id): the rows that exist at the instant, as their last change left them."""
    return last_changes(changes if at is None else at_or_before(changes, at), by_position).where(F.col("event_type") != DELETE).drop("event_type")


def snapshot_at(baseline: DataFrame, changes: DataFrame, at: datetime | None = None, by_position: bool = False) -> DataFrame:
    """(pk_values, row_after): a baseline (pk_values, row_after) with the changes after it folded in."""
    last = last_changes(changes if at is None else at_or_before(changes, at), by_position).select("pk_values", "event_type", F.col("row_after").alias("new"))
    both = baseline.select("pk_values", "row_after").join(last, "pk_values", "full_outer")
    return both.where(F.col("event_type").isNull() | (F.col("event_type") != DELETE)).select("pk_values", F.when(F.col("event_type").isNull(), F.col("row_after")).otherwise(F.col("new")).alias("row_after"))


def history(changes: DataFrame, pk: str, baseline: DataFrame | None = None) -> DataFrame:
    """(step, event_id, event_timestamp, event_type, state): a row's state after each change; step 0 is its baseline."""
    own = changes.where(F.col("pk_values") == pk)
    steps = own.select(F.row_number().over(Window.partitionBy("pk_values").orderBy("event_timestamp", "event_id")).alias("step"), "event_id", "event_timestamp", "event_type", F.when(F.col("event_type") != DELETE, F.col("row_after")).alias("state"))
    if baseline is None:
        return steps
    first = baseline.where(F.col("pk_values") == pk).select(F.lit(0).alias("step"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("timestamp_ntz").alias("event_timestamp"), F.lit(6).alias("event_type"), F.col("row_after").alias("state"))
    return first.unionByName(steps)


def diff(changes: DataFrame, since: datetime, until: datetime, pk: str | None = None) -> DataFrame:
    """Every change between two instants, both included, in order."""
    hit = changes.where(F.col("event_timestamp").between(F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz")))
    return (hit.where(F.col("pk_values") == pk) if pk is not None else hit).orderBy("event_timestamp", "event_id")


def net_changes(changes: DataFrame) -> DataFrame:
    """(pk_values, op, row_after, first_touch): one put or delete per key of a window of changes, by commit order."""
    order = commit_order(True)
    net = changes.groupBy("pk_values").agg(F.max_by(F.struct("event_type", "row_after"), order).alias("c"), F.min("event_id").alias("first_touch"))
    return net.select("pk_values", F.when(F.col("c.event_type") == DELETE, "delete").otherwise("put").alias("op"), F.when(F.col("c.event_type") != DELETE, F.col("c.row_after")).alias("row_after"), "first_touch")


def carry_unsent(changes: DataFrame, column: str) -> DataFrame:
    """changes with <column>_value: the field's text, where it was not sent the one of the key's latest change that has it.

    A delete ends what may be carried.
    """
    order = Window.partitionBy("pk_values").orderBy("event_timestamp", "event_id")
    life = F.sum(F.when(F.col("event_type") == DELETE, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    sent = F.when(~images.is_unchanged_marker(F.col("row_after"), column), F.struct(images.text(F.col("row_after"), column).alias("v")))
    lived = changes.withColumn("_life", F.coalesce(life, F.lit(0))).withColumn("_sent", sent)
    over = Window.partitionBy("pk_values", "_life").orderBy("event_timestamp", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return lived.withColumn(f"{column}_value", F.last("_sent", ignorenulls=True).over(over)["v"]).drop("_life", "_sent")


def as_of_epoch(changes: DataFrame, epochs: DataFrame) -> DataFrame:
    """changes with the newest epoch (epoch, epoch_from) at or before each. Epochs are schema versions: few, and their
    ranges never overlap, so the join is on a range each change falls into once."""
    to = F.lead("epoch_from").over(Window.orderBy("epoch_from"))
    ranges = epochs.select("epoch", "epoch_from", to.alias("epoch_to"))
    inside = (F.col("event_timestamp") >= F.col("epoch_from")) & (F.col("epoch_to").isNull() | (F.col("event_timestamp") < F.col("epoch_to")))
    return changes.join(ranges, inside, "left").drop("epoch_from", "epoch_to")
