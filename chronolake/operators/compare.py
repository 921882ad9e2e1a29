"""Comparing versions of a table: digests, multisets, fingerprints by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_text(columns: list[str]) -> Column:
    """An unambiguous text of a row: nulls and lengths are told apart."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.concat_ws("|", *parts)


def fingerprint(columns: list[str]) -> Column:
    return F.sha2(row_text(columns), 256)


def hash_number(columns: list[str]) -> Column:
    """60 bits of the fingerprint as a decimal, for sums that don't depend on order."""
    return F.conv(F.substring(fingerprint(columns), 1, 15), 16, 10).cast("decimal(38,0)")


def digest(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(rows, digest): one pass, the same for any order of rows, different where a row is more or less often there."""
    columns = sorted(columns or table.columns)
    return table.agg(F.count("*").alias("rows"), F.coalesce(F.sum(hash_number(columns)), F.lit(0)).cast("decimal(38,0)").alias("digest"))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows with how often a has them more than b (only_a) or b more than a (only_b); one grouped pass over both."""
    columns = a.columns
    both = a.select(*columns, F.lit(1).alias("_n")).unionByName(b.select(*columns, F.lit(-1).alias("_n")))
    net = both.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return net.select(*columns, F.greatest("_n", F.lit(0)).cast("long").alias("only_a"), F.greatest(-F.col("_n"), F.lit(0)).cast("long").alias("only_b"))


def by_key(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., verdict): rows that only one version has, or that differ. Only keys and fingerprints are shuffled."""
    columns = sorted(c for c in a.columns if c not in keys)
    x, y = (t.select(*keys, fingerprint(columns).alias(n)) for t, n in ((a, "fa"), (b, "fb")))
    both = x.join(y, keys, "full_outer")
    verdict = F.when(F.col("fb").isNull(), "only_a").when(F.col("fa").isNull(), "only_b").when(F.col("fa") != F.col("fb"), "differs")
    return both.withColumn("verdict", verdict).where("verdict is not null").select(*keys, "verdict")


def verdict(a: DataFrame, b: DataFrame) -> str:
    """EQUAL, or DIFFERENT and the first kind that tells: columns, rows, or values."""
    if a.columns != b.columns:
        return "DIFFERENT(columns)"
    x, y = digest(a).first(), digest(b).first()
    if x.rows != y.rows:
        return "DIFFERENT(rows)"
    return "EQUAL" if x.digest == y.digest else "DIFFERENT(values)"
