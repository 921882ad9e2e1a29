"""Which changes a question is about: one condition, all parts of which must hold."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.functions import images, keys
from chronolake.operators.ordering import position


@dataclass(frozen=True)
class ChangeFilter:
    schema: str | None = None
    table: str | None = None
    pk: str | None = None
    pk_in: tuple[str, ...] = ()
    pk_range: tuple[int | None, int | None] | None = None
    event_type: int | None = None
    gtid: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    query_hash: str | None = None
    changed_column: str | None = None
    column_equals: tuple[str, str] | None = None
    deny_tables: tuple[str, ...] = ()
    allow_tables: tuple[str, ...] = ()
    after_event: tuple[datetime, int] | None = None
    before_event: tuple[datetime, int] | None = None
    since_position: tuple[str, int] | None = None
    until_position: tuple[str, int] | None = None
    event_id: int | None = None
    redact: tuple[str, ...] = field(default=())

    def condition(self) -> Column:
        c, parts = F.col, []
        for name, value in (("schema_name", self.schema), ("table_name", self.table), ("pk_values", self.pk), ("event_type", self.event_type), ("gtid", self.gtid), ("event_id", self.event_id)):
            if value is not None:
                parts.append(c(name) == value)
        if self.pk_in:
            parts.append(c("pk_values").isin(*self.pk_in))
        if self.pk_range is not None:
            parts.append(keys.in_range(c("pk_values"), *self.pk_range))
        if self.since is not None:
            parts.append(c("event_timestamp") >= F.lit(self.since).cast("timestamp_ntz"))
        if self.until is not None:
            parts.append(c("event_timestamp") <= F.lit(self.until).cast("timestamp_ntz"))
        if self.query_hash is not None:
            parts.append(F.lower("query_hash") == self.query_hash.lower())
        if self.changed_column is not None:
            parts.append(F.array_contains(F.from_json("changed_columns", "array<string>"), self.changed_column))
        if self.column_equals is not None:
            parts.append(images.column_equals(c("row_before"), c("row_after"), *self.column_equals))
        if self.deny_tables:
            parts.append(~F.lower("table_name").isin(*[t.lower() for t in self.deny_tables]))
        if self.allow_tables:
            parts.append(c("table_name").isin(*self.allow_tables))
        at = F.struct("event_timestamp", "event_id")
        cursor = lambda x: F.struct(F.lit(x[0]).cast("timestamp_ntz").alias("event_timestamp"), F.lit(x[1]).cast("long").alias("event_id"))
        if self.after_event is not None:
            parts.append(at > cursor(self.after_event))
        if self.before_event is not None:
            parts.append(at < cursor(self.before_event))
        here = position(c("binlog_file"), c("start_pos"))
        spot = lambda x: position(F.lit(x[0]), F.lit(x[1]).cast("decimal(20,0)"))
        if self.since_position is not None:
            parts.append(here >= spot(self.since_position))
        if self.until_position is not None:
            parts.append(here <= spot(self.until_position))
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def partition_condition(self) -> Column:
        """The same bounds on event_date and event_hour, for archives: only these prune partitions."""
        parts = []
        for bound, compare in ((self.since, "__ge__"), (self.until, "__le__")):
            if bound is not None:
                there = F.struct(F.col("event_date").cast("date").alias("d"), F.col("event_hour").cast("int").alias("h"))
                day = F.col("event_date").cast("date")
                parts.append(getattr(day, compare)(F.lit(bound.date())))
                parts.append(getattr(there, compare)(F.struct(F.lit(bound.date()).alias("d"), F.lit(bound.hour).alias("h"))))
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def apply(self, changes: DataFrame) -> DataFrame:
        """The changes that meet the condition, with redacted columns nulled and, under redaction, no statement text."""
        out = changes.where(self.condition())
        if self.redact:
            hidden = list(self.redact)
            out = out.withColumns({"row_before": images.redacted(F.col("row_before"), hidden), "row_after": images.redacted(F.col("row_after"), hidden)})
            if "query_text" in out.columns:
                out = out.withColumn("query_text", F.lit(None).cast("string"))
        return out


def flagged(changes: DataFrame, flags: DataFrame, flag: str) -> DataFrame:
    """Changes of tables that carry the flag."""
    own = flags.where(F.col("flag") == flag).select("schema_name", "table_name").distinct()
    return changes.join(own, ["schema_name", "table_name"], "left_semi")
