"""Tables as a base and a chain of deltas: dead base rows by position, newest row per key above."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_positions(base: DataFrame) -> DataFrame:
    """A base read from files, with each row's file and number there."""
    return base.select("*", F.col("_metadata.file_path").alias("base_file"), F.col("_metadata.row_index").alias("row_index"))


def newest_upserts(upserts: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key with the greatest seq; keys compare as bytes."""
    rest = [c for c in upserts.columns if c not in keys]
    best = upserts.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("seq")).alias("row"))
    return best.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def chain_state(base: DataFrame, dead: DataFrame, upserts: DataFrame, keys: list[str], position: list[str]) -> DataFrame:
    """The table: base rows whose position is not dead, and the newest upsert of each key that isn't a delete.

    upserts has the base's columns, seq, and deleted; dead has the columns position, which are the base's as well.
    """
    columns = [c for c in base.columns if c not in position]
    alive = base.join(dead.select(*position).distinct(), position, "left_anti").select(columns)
    above = newest_upserts(upserts, keys).where(~F.col("deleted")).select(columns)
    return alive.unionByName(above)


def compact(dead: list[DataFrame], upserts: list[DataFrame], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """One pair (dead positions, newest upserts) that says the same as the chain of pairs."""
    all_dead, all_upserts = dead[0], upserts[0]
    for d, u in zip(dead[1:], upserts[1:], strict=True):
        all_dead, all_upserts = all_dead.unionByName(d), all_upserts.unionByName(u)
    return all_dead.distinct(), newest_upserts(all_upserts, keys)


def dead_bitmap(dead: DataFrame, position: str = "row_index") -> DataFrame:
    """(block, bits): dead positions as one 64-bit mask for each block of 64."""
    bit = F.expr(f"shiftleft(1L, cast({position} & 63 as int))")
    return dead.groupBy(F.shiftright(F.col(position), 6).alias("block")).agg(F.bit_or(bit).alias("bits"))


def locate(base: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """The base rows of the changed keys."""
    return base.join(changed.select(*keys).distinct(), keys, "left_semi")
