"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's spark.checkpoint.dir; set one of our own only where none is set, as in tests."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="chronolake-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, without its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Free memory of this process goes back to the system: Spark keeps it for later tasks, beside others that need the memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def uncollected(f: Callable) -> Callable:
    """f with the cycle collector off: it makes many small objects and no cycles, and collections would walk them all.

    Afterwards Arrow's free memory goes back to the system, as other processes of the executor need it.
    """

    @functools.wraps(f)
    def run(*args, **kwargs):
        was = gc.isenabled()
        gc.disable()
        try:
            return f(*args, **kwargs)
        finally:
            if was:
                gc.enable()
            pa.default_memory_pool().release_unused()

    return run


def runs(ids: np.ndarray) -> list[tuple[int, slice]]:
    """The different values of a sorted array, each with the stretch that has it."""
    if not len(ids):
        return []
    starts = np.concatenate([[0], np.nonzero(ids[1:] != ids[:-1])[0] + 1])
    return [(int(ids[a]), slice(int(a), int(b))) for a, b in zip(starts, np.append(starts[1:], len(ids)), strict=True)]


def fold_of(id_col: str, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo parts."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts))


def id_and_bytes(batch: pa.RecordBatch, id_at: int = 0, text_at: int = 1) -> tuple[pa.Array, list[bytes]]:
    """The ids of a batch and its texts as UTF-8 bytes; a null text is empty."""
    texts = batch.column(text_at)
    if not pa.types.is_binary(texts.type):
        texts = texts.cast(pa.binary())
    return batch.column(id_at), [t or b"" for t in texts.to_pylist()]


def strings(column: pa.Array) -> pa.Array:
    """Texts as an Arrow string array; a null text is empty. Bytes that are no UTF-8 stay as they are."""
    if not pa.types.is_string(column.type):
        column = pc.cast(column, options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))
    return pc.fill_null(column, "") if column.null_count else column


def coded_words(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(offsets, codes, words): of all texts the words between ASCII white space as places in the array of different words.

    Where a text begins or ends with white space it has the empty word there; a text without words is one empty word.
    """
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    return lists.offsets, coded.indices, coded.dictionary.cast(pa.binary())


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many rows, which bounds what a task holds at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def components_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, components): the smallest node reachable from each node of the edges a[k], b[k]."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        p, q = root[x], root[y]
        np.minimum.at(root, p, q)
        np.minimum.at(root, q, p)
        while ((up := root[root]) != root).any():
            root = up
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
    return nodes, nodes[root]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, alone: int = 0) -> DataFrame:
    """The smallest node reachable from each node, by alternating large-star and small-star steps.

    edges has two long columns; direction, repeats and self-loops don't matter. Returns (node, component)
    for each node that has an edge to another one. Each step is a grouped minimum (combined before the
    shuffle) and an equi-join, so a hub's edges never meet in one task; the steps' results are cut with
    checkpoint(). The number of rounds grows with the logarithm of the longest path. Up to alone different edges
    go to one task instead, which holds them all: a step's many small tasks would cost far more than they do.
    """

    def joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [np.zeros((2, 0), np.int64)] + [np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) for batch in batches]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in components_of(*np.concatenate(ends, axis=1))], ["node", "component"])

    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def step(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        hung = joined.select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x"))
        return hung.select("x.a", F.col("x.m").alias("b")).where("a <> b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = mark(now)
    if seen[0] <= alone:
        return now.repartition(1).mapInArrow(joined_up, "node long, component long")
    if seen[0]:
        for _ in range(max_rounds):
            now = cut(step(step(now, True), False))
            new = mark(now)
            if new == seen:
                break
            seen = new
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def blocks_of_links(mask: np.ndarray) -> np.ndarray:
    """The component of each row and column (rows first) of a boolean block of links, as small integers."""
    rows, cols = mask.shape
    label_r, label_c = np.arange(rows), np.full(cols, rows + cols)
    own_c = rows + np.arange(cols)
    big = rows + cols
    while True:
        new_c = np.minimum(np.where(mask, label_r[:, None], big).min(0, initial=big), np.minimum(label_c, own_c))
        new_r = np.minimum(np.where(mask, new_c[None, :], big).min(1, initial=big), label_r)
        if (new_r == label_r).all() and (new_c == label_c).all():
            return np.concatenate([new_r, new_c])
        label_r, label_c = new_r, new_c


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written as a table in the shared checkpoint folder and read again: what later steps read more than once."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
