"""Undoing changes: reversal statements, the chain check, and what foreign keys drag along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolake.functions import images
from chronolake.functions.dialect import Refused
from chronolake.operators.ordering import position


def literal(text: Column) -> Column:
    """A text as a quoted SQL literal, NULL for null; quotes, backslashes and line breaks are escaped."""
    safe = text
    for raw, escaped in (("\\", "\\\\"), ("'", "''"), ("\n", "\\n"), ("\r", "\\r")):
        safe = F.replace(safe, F.lit(raw), F.lit(escaped))
    return F.coalesce(F.concat(F.lit("'"), safe, F.lit("'")), F.lit("NULL"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def comment(text: str) -> str:
    """One comment line of a script; a line break can't end it."""
    return "-- " + " ".join(text.splitlines())


def reversal_sql(changes: DataFrame, columns: list[str], table: str) -> DataFrame:
    """(event_id, statement) for each change, newest by position first: inserts are deleted, deletes inserted again,
    updates set back where the row still is as they left it. An image with a value that was not sent is refused."""
    value = lambda image, c: literal(images.text(F.col(image), c))
    equals = lambda image: F.concat_ws(" AND ", *[F.when(images.text(F.col(image), c).isNull(), F.lit(f"{quoted(c)} IS NULL")).otherwise(F.concat(F.lit(f"{quoted(c)} = "), value(image, c))) for c in columns])
    values = F.concat_ws(", ", *[value("row_before", c) for c in columns])
    sets = F.concat_ws(", ", *[F.concat(F.lit(f"{quoted(c)} = "), value("row_before", c)) for c in columns])
    names = ", ".join(map(quoted, columns))
    statement = (
        F.when(F.col("event_type") == 1, F.concat(F.lit(f"DELETE FROM {quoted(table)} WHERE "), equals("row_after"), F.lit(";")))
        .when(F.col("event_type") == 3, F.concat(F.lit(f"INSERT INTO {quoted(table)} ({names}) VALUES ("), values, F.lit(");")))
        .when(F.col("event_type") == 2, F.concat(F.lit(f"UPDATE {quoted(table)} SET "), sets, F.lit(" WHERE "), equals("row_after"), F.lit(";")))
    )
    partial = images.has_marker(F.col("row_before")) | images.has_marker(F.col("row_after"))
    checked = F.when(partial, F.raise_error(F.lit("an image has a value that was not captured"))).otherwise(statement)
    here = position(F.col("binlog_file"), F.col("start_pos"))
    return changes.where(F.col("event_type").isin(1, 2, 3)).orderBy(here.desc(), F.col("event_id").desc()).select("event_id", checked.alias("statement"))


def chain_check(changes: DataFrame) -> DataFrame:
    """(event_id, pk_values): changes whose row before isn't the row after of their key's change before."""
    own = Window.partitionBy("pk_values").orderBy("event_timestamp", "event_id")
    marked = changes.withColumn("_was", F.lag("row_after").over(own)).withColumn("_n", F.row_number().over(own))
    return marked.where((F.col("_n") > 1) & ~F.col("row_before").eqNullSafe(F.col("_was"))).select("event_id", "pk_values")


def affected_tables(edges: DataFrame, root: str, max_depth: int = 64) -> DataFrame:
    """(parent, child, delete_rule, update_rule): foreign keys reached from a table.

    Only rules that act (CASCADE, SET NULL, SET DEFAULT on delete; CASCADE on update) lead further; others are returned but end
    there. Cycles end. The graph is a schema's, not data, so its closure is walked on the driver.
    """
    known = {(e.parent, e.child, e.delete_rule, e.update_rule) for e in edges.select("parent", "child", "delete_rule", "update_rule").distinct().toLocalIterator()}
    seen, frontier, found = {root}, {root}, set()
    for _ in range(max_depth):
        here = {e for e in known if e[0] in frontier}
        found |= here
        frontier = {e[1] for e in here if e[2] in ("CASCADE", "SET NULL", "SET DEFAULT") or e[3] == "CASCADE"} - seen
        if not frontier:
            break
        seen |= frontier
    return edges.sparkSession.createDataFrame(sorted(found), "parent string, child string, delete_rule string, update_rule string")


def key_moved(before: Column, after: Column) -> Column:
    """Whether a referenced key changed: by null-ness or by its text."""
    return ~before.eqNullSafe(after)


def cascade_victims(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, rule: str) -> DataFrame:
    """The children of deleted parents with what undoes the rule: a re-insert after CASCADE, a restored key after SET NULL."""
    if rule not in ("CASCADE", "SET NULL", "RESTRICT", "NO ACTION"):
        raise Refused(f"rule {rule}")
    if rule in ("RESTRICT", "NO ACTION"):
        return children.limit(0).withColumn("action", F.lit("none"))
    gone = parents.select(F.col(parent_key).alias("_gone")).distinct()
    hit = children.join(gone, F.col(child_key) == F.col("_gone"), "left_semi")
    return hit.withColumn("action", F.lit("insert" if rule == "CASCADE" else "restore_key"))


def cascade_script(parents: DataFrame, victims: DataFrame) -> DataFrame:
    """(step, statement): checks off, parents, then children, checks on. Both inputs have a column statement and order columns first."""
    spark = parents.sparkSession
    edge = lambda n, s: spark.createDataFrame([(n, s)], "step int, statement string")
    return edge(0, "SET FOREIGN_KEY_CHECKS = 0;").unionByName(parents.select(F.lit(1).alias("step"), "statement")).unionByName(victims.select(F.lit(2).alias("step"), "statement")).unionByName(edge(3, "SET FOREIGN_KEY_CHECKS = 1;"))
