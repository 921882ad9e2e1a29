"""Merging what several sources say: one row per event, newest rows per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolake.functions import images
from chronolake.functions.keys import grouping_key
from chronolake.operators.ordering import order_proof, position

# content that two copies of an event may lack, and is compared only where both have it
OPTIONAL = ("query_text", "query_hash", "commit_ts_us", "connection_id", "gtid")


def ranked(sources: list[DataFrame]) -> DataFrame:
    """The sources' rows with their rank in column source_rank; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)])


def dedup(sources: list[DataFrame]) -> DataFrame:
    """One row per event_id, of the first source that has it. Combined before the shuffle: no window, no sort."""
    both = ranked(sources)
    columns = [c for c in both.columns if c not in ("source_rank", "event_id")]
    best = both.groupBy("event_id").agg(F.min_by(F.struct(*columns), F.col("source_rank")).alias("row"))
    return best.select("event_id", *[F.col(f"row.{c}").alias(c) for c in columns]).select([c for c in both.columns if c != "source_rank"])


def divergence(sources: list[DataFrame], content: list[str], null_is_empty: bool = True) -> DataFrame:
    """(event_id, copies, diverges): events that several sources have, and whether their content disagrees.

    Images are compared as what they say: the order of their fields doesn't matter, and a null image is an empty one. Without
    null_is_empty a null image disagrees with one that has no fields; then it is an empty text.
    """
    both = ranked(sources)

    def differs(c: str) -> Column:
        if c in OPTIONAL:
            return F.min(c) != F.max(c)
        shown = images.canonical(F.col(c), "{}" if null_is_empty else "") if c in ("row_before", "row_after") else F.coalesce(F.col(c).cast("string"), F.lit("\0"))
        return F.min(shown) != F.max(shown)

    any_differs = reduce(lambda a, b: a | b, [F.coalesce(differs(c), F.lit(False)) for c in content])
    return both.groupBy("event_id").agg(F.count("*").alias("copies"), any_differs.alias("diverges")).where("copies > 1")


def by_time(descending: bool = False) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in ("event_timestamp", "event_id")]


def limit_per_pk(changes: DataFrame, n: int) -> DataFrame:
    """The newest n changes of each key by (time, id); rows with an empty key are each their own group."""
    own = Window.partitionBy(grouping_key(F.col("pk_values"), F.col("event_id"))).orderBy(*by_time(True))
    return changes.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= n).drop("_n")


def merge_and_trim(sources: list[DataFrame], per_pk: int | None = None, limit: int | None = None, descending: bool = False) -> DataFrame:
    """Dedup, then the limit per key, then the order, then the limit: in this order, or answers change."""
    out = dedup(sources)
    if per_pk is not None:
        out = limit_per_pk(out, per_pk)
    out = out.orderBy(*by_time(descending))
    return out.limit(limit) if limit is not None else out


def latest_per_pk(changes: DataFrame, n: int, ids_proven: bool = True) -> DataFrame:
    """The newest n changes of each key, and the decision on their order.

    The candidates are the newest n by (time, id) and the newest n by id. Where both agree the order is settled. Where they
    don't, a proof of the key's commit order lets the newest n by position win; refused keys keep time order.
    """
    key = grouping_key(F.col("pk_values"), F.col("event_id"))
    here = position(F.col("binlog_file"), F.col("start_pos"))
    keyed = changes.withColumn("_key", key)
    own = Window.partitionBy("_key")
    keyed = keyed.withColumns({
        "_t": F.row_number().over(own.orderBy(*by_time(True))),
        "_i": F.row_number().over(own.orderBy(F.col("event_id").desc())),
        "_p": F.row_number().over(own.orderBy(here.desc(), F.col("event_id").desc())),
    })
    agreed = F.bool_and((F.col("_t") <= n) == (F.col("_i") <= n)).over(own)
    keyed = keyed.withColumn("_agreed", agreed)
    proof = order_proof(keyed.where("not _agreed"), ["_key"], ids_proven)
    judged = keyed.join(proof, "_key", "left").withColumn("decision", F.coalesce("decision", F.lit("agrees")))
    sorted_ = F.col("decision").isin("sorted", "postgres") & ~F.col("_agreed")
    return judged.where(F.when(sorted_, F.col("_p")).otherwise(F.col("_t")) <= n).drop("_key", "_t", "_i", "_p", "_agreed")


def first_and_last(changes: DataFrame, condition: Column) -> DataFrame:
    """How many changes meet the condition, and the first and last of them by (time, id), in one pass."""
    at, row = F.struct("event_timestamp", "event_id"), F.struct("event_id", "event_timestamp", "binlog_file", "start_pos")
    hit = changes.where(condition).agg(F.count("*").alias("n"), F.min_by(row, at).alias("first"), F.max_by(row, at).alias("last"))
    return hit.select("n", F.col("first.event_id").alias("first_id"), F.col("first.event_timestamp").alias("first_at"), F.col("last.event_id").alias("last_id"), F.col("last.event_timestamp").alias("last_at"))
