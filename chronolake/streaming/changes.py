"""Changes as a stream: whole transactions, newest state per key, late rows kept, losses counted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet change files as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def exactly_once(changes: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Changes with repeats of an event_id dropped, as a replayed source sends them; state is kept as long as lateness."""
    return changes.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["event_id"])


def screened(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes that can be used, and those that can't with the reason: nothing is skipped without a trace."""
    reason = F.when(F.col("event_id").isNull(), "no_id").when(F.col("event_timestamp").isNull(), "no_time").when(~F.col("event_type").isin(1, 2, 3, 4, 5, 6) | F.col("event_type").isNull(), "unknown_kind").when((F.col("event_type").isin(1, 2)) & F.col("row_after").isNull(), "no_image")
    marked = changes.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def on_time(changes: DataFrame, seen_upto) -> tuple[DataFrame, DataFrame]:
    """Changes at or after a time already reported, and late ones, which are kept beside."""
    late = F.col("event_timestamp") < F.lit(seen_upto).cast("timestamp_ntz")
    return changes.where(~late), changes.where(late)


def whole_transactions(held: DataFrame, arrived: DataFrame, ended: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(visible, still held) after a batch: a transaction's changes show together once its end (gtid) has come."""
    both = held.unionByName(arrived)
    done = ended.select("gtid").distinct()
    alone = F.col("gtid").isNull()
    return both.where(~alone).join(done, "gtid", "left_semi").select(both.columns).unionByName(both.where(alone)), both.where(~alone).join(done, "gtid", "left_anti").select(both.columns)


def upsert_tail(tail: DataFrame, batch: DataFrame) -> DataFrame:
    """The newest change of each key after a micro-batch; applying a batch twice changes nothing."""
    columns = tail.columns
    rest = [c for c in columns if c != "pk_values"]
    both = tail.unionByName(batch.select(*columns))
    return both.groupBy("pk_values").agg(F.max_by(F.struct(*rest), F.struct("event_timestamp", "event_id")).alias("c")).select("pk_values", *[F.col(f"c.{c}").alias(c) for c in rest]).select(*columns)


def prune_tail(tail: DataFrame, cut) -> DataFrame:
    """The tail without what a new cut of the baseline has taken in."""
    return tail.where(F.col("event_timestamp") > F.lit(cut).cast("timestamp_ntz"))


def lag_figures(batch: DataFrame, read_at: str = "read_at", committed: str = "commit_ts_us") -> DataFrame:
    """(max_lag_s): how far behind the slowest change of a batch is, not below 0; changes without a read time don't count."""
    lag = F.unix_micros(F.col(read_at)) / 1e6 - F.col(committed) / 1e6
    return batch.where(F.col(read_at).isNotNull() & (F.col(committed) > 0)).agg(F.greatest(F.max(lag), F.lit(0.0)).alias("max_lag_s"))


def windows(changes: DataFrame, size: str, slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """(start, event_type, n): changes by time window; batch or stream."""
    at = F.window("event_time", size, slide) if slide else F.window("event_time", size)
    marked = changes.withWatermark("event_time", lateness) if changes.isStreaming else changes
    return marked.groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(changes: DataFrame, gap: str, lateness: str = "10 minutes") -> DataFrame:
    """(pk_values, start, end, n): runs of a key's changes with no pause of gap or more; batch or stream."""
    marked = changes.withWatermark("event_time", lateness) if changes.isStreaming else changes
    grouped = marked.groupBy("pk_values", F.session_window("event_time", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("pk_values", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Every micro-batch of what is there now through each, with the position kept in checkpoint."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
