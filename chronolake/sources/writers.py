"""Where changes and tables go: hourly archives, baselines, exports, scripts; and whether what is written is right."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.functions.keys import pk_hash
from chronolake.operators.compare import digest
from chronolake.operators.fold import net_changes


def write_archive(changes: DataFrame, path: str, source_id: str, mode: str = "append", source_column: str = "source_id") -> DataFrame:
    """Changes as <source_column>=/event_date=/event_hour= partitions in id order, and each partition's figures."""
    laid = changes.withColumns({source_column: F.lit(source_id), "event_date": F.to_date("event_timestamp"), "event_hour": F.hour("event_timestamp")})
    keys = [source_column, "event_date", "event_hour"]
    # an hour with very many changes is dealt to several files rather than to one task
    laid.repartition(F.col("event_date"), F.col("event_hour"), F.pmod(F.xxhash64("event_id"), F.lit(4))).sortWithinPartitions(*keys, "event_id").write.mode(mode).partitionBy(*keys).parquet(path)
    return partition_figures(laid, source_column)


def partition_figures(laid: DataFrame, source_column: str = "source_id") -> DataFrame:
    """(source_column, event_date, event_hour, rows, min_ts, max_ts, max_id) of each partition."""
    return laid.groupBy(source_column, "event_date", "event_hour").agg(F.count("*").alias("rows"), F.min("event_timestamp").alias("min_ts"), F.max("event_timestamp").alias("max_ts"), F.max("event_id").alias("max_id"))


def restore(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """An archive's changes without the partition columns, for a live table."""
    return spark.read.parquet(path).select(*columns)


def reconcile(registry: DataFrame, files: DataFrame) -> DataFrame:
    """(partition_name, source_id, verdict): insert what only files have, prune what only the registry has, update where row
    counts differ, unverified where a file's count isn't known. An empty scan of files is an error, not a reason to prune all."""
    if files.isEmpty():
        raise ValueError("no files were found; nothing is pruned on that evidence")
    both = registry.select("partition_name", "source_id", F.col("rows").alias("r"), F.lit(True).alias("in_r")).join(
        files.select("partition_name", "source_id", F.col("rows").alias("f"), F.lit(True).alias("in_f")), ["partition_name", "source_id"], "full_outer"
    )
    verdict = F.when(F.col("in_r").isNull(), "insert").when(F.col("in_f").isNull(), "prune").when(F.col("f").isNull(), "unverified").when(~F.col("r").eqNullSafe(F.col("f")), "update").otherwise("same")
    return both.select("partition_name", "source_id", verdict.alias("verdict"))


def write_baseline(table: DataFrame, path: str, anchor: dict | None = None) -> dict:
    """A table with its columns by name, and beside it a manifest of its digest and the position it was taken at."""
    ordered = table.select(*sorted(table.columns))
    ordered.write.mode("overwrite").option("compression", "zstd").parquet(path)
    figures = digest(ordered).first()
    manifest = {"rows": figures.rows, "digest": str(figures.digest), "columns": ordered.columns, "anchor": anchor or {}}
    table.sparkSession.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}_manifest")
    return manifest


def verified_baseline(spark: SparkSession, path: str) -> DataFrame:
    """A baseline, after its rows have met its manifest; an error where they don't."""
    manifest = json.loads(spark.read.text(f"{path}_manifest").first()[0])
    table = spark.read.parquet(path)
    figures = digest(table).first()
    if (figures.rows, str(figures.digest)) != (manifest["rows"], manifest["digest"]):
        raise ValueError(f"{path} is not what its manifest says")
    return table


def _crc32c_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0x82F63B78 if n & 1 else 0)  # the reversed Castagnoli polynomial
        table.append(n)
    return table


_CRC32C = _crc32c_table()


def checksum(data: bytes) -> int:
    """CRC-32C of a file's bytes."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc = _CRC32C[(crc ^ byte) & 0xFF] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


def export(target: DataFrame | None, changes: DataFrame, keys: str = "pk_values") -> DataFrame:
    """The exported table (pk_values, row_after) after a window of changes: each key's net change put or deleted."""
    net = net_changes(changes)
    puts = net.where("op = 'put'").select(keys, "row_after")
    return puts if target is None else target.join(net.select(keys), keys, "left_anti").select(keys, "row_after").unionByName(puts)


def split_payload(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What may leave and what stays: metadata with a key hash and no values, and the payload by event id."""
    kept_back = ("pk_values", "row_before", "row_after", "query_text")
    meta = changes.withColumn("pk_hash", pk_hash(F.col("pk_values"))).select(*[c for c in changes.columns if c not in kept_back], "pk_hash")
    return meta, changes.select("event_id", *[c for c in kept_back if c in changes.columns])


def dump_rows(table: DataFrame, name: str, dialect: str = "mysql") -> DataFrame:
    """(line): one INSERT for each row, numbers bare, texts quoted, null as NULL, in either dialect."""
    quote = '"' if dialect == "postgres" else "`"
    cells = []
    for field in table.schema:
        text = F.col(field.name).cast("string")
        if field.dataType.simpleString() not in ("int", "bigint", "smallint", "tinyint", "float", "double") and not field.dataType.simpleString().startswith("decimal"):
            safe = F.replace(text, F.lit("'"), F.lit("''"))
            safe = F.replace(safe, F.lit("\\"), F.lit("\\\\")) if dialect == "mysql" else safe
            text = F.concat(F.lit("'"), safe, F.lit("'"))
        cells.append(F.coalesce(text, F.lit("NULL")))
    names = ", ".join(f"{quote}{c}{quote}" for c in table.columns)
    return table.select(F.concat(F.lit(f"INSERT INTO {quote}{name}{quote} ({names}) VALUES ("), F.concat_ws(", ", *cells), F.lit(");")).alias("line"))
