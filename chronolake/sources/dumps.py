"""Reading dumps: INSERT statements and tab-separated rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# The letters after a backslash in a dump's strings.
_ESCAPES = {"0": "\0", "n": "\n", "r": "\r", "t": "\t", "b": "\b", "Z": "\x1a"}


def tuples(line: str) -> Iterator[list[str | None]]:
    """The rows of one INSERT statement; strings unescaped, NULL as None, 0x... as it stands."""
    at = line.upper().find(" VALUES")
    if at < 0:
        return
    at += len(" VALUES")
    row: list[str | None] = []
    cell, quoted, inside = "", False, False
    while at < len(line):
        ch = line[at]
        if not inside:
            inside = ch == "("
            row, cell, quoted = [], "", False
        elif ch == "'":
            cell, quoted, at = "", True, at + 1
            while line[at] != "'" or line[at : at + 2] == "''":
                if line[at] == "\\":
                    cell += _ESCAPES.get(line[at + 1], line[at + 1])
                    at += 2
                else:
                    cell += line[at]
                    at += 2 if line[at] == "'" else 1
        elif ch in ",)":
            row.append(cell if quoted else None if cell.strip().upper() == "NULL" else cell.strip())
            cell, quoted = "", False
            if ch == ")":
                inside = False
                yield row
        elif not quoted:
            cell += ch
        at += 1


def read_sql(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The rows of a dump's INSERT statements, one statement to a line, as texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for line in batch.column(0).to_pylist() if line and line.lstrip().upper().startswith("INSERT") for r in tuples(line)]
            cols = list(zip(*rows, strict=True)) or [[]] * len(columns)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], columns)

    return spark.read.text(path).mapInArrow(run, ", ".join(f"`{c}` string" for c in columns))


def read_tab(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    r"""Tab-separated rows as texts; \N is null."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("sep", "\t").option("nullValue", "\\N").option("quote", "").csv(path)
