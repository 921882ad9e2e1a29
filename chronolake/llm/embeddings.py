"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within them, one representative per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_of_links, connected_components, cut, slices

COSINE = 0.93
#: Different vectors for each cell, and the most cells; beyond that cells grow, and are compared in blocks all the same.
CELL_ROWS, MOST_CELLS = 2048, 4096
#: About so many vectors fit the cells; the bound of the fitting sample.
FIT_ROWS, FIT_ROUNDS = 20_000, 10
#: A vector is also a guest in each cell whose centre is nearly as close as the closest one's, by so much cosine.
MARGIN = 0.12
BLOCK_ROWS = 2048


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by the largest component first, so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def spherical_kmeans(x: np.ndarray, cells: int, seed: int = 9) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(FIT_ROUNDS):
        cell = np.concatenate([(x[at : at + 4096] @ centres.T).argmax(1) for at in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        norms = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    return centres


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _centres(classes: DataFrame, dim: int, n: int) -> np.ndarray:
    """Cell centres for the vectors of one dimension, fitted on an executor."""
    cells = min(MOST_CELLS, -(-n // CELL_ROWS))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_matrix(b.column(0)) for b in batches if b.num_rows]
        x = unit(np.concatenate(parts)) if parts else np.ones((1, dim))
        yield pa.RecordBatch.from_arrays([pa.array([spherical_kmeans(x, cells).tobytes()], pa.binary())], ["centres"])

    sample = classes.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("node", F.lit("fit")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, FIT_ROWS / n)) + 1))
    raw = sample.select("vector", "node").repartition(1).sortWithinPartitions("node").select("vector").mapInArrow(fit, "centres binary").first()[0]
    return np.frombuffer(bytes(raw), np.float64).reshape(-1, dim)


def linked_rows(cell: int, a: dict, b: dict | None, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links, root) of the rows of two blocks of a cell, or of one with itself, that have a link here.

    A link between two rows may show in several cells. It counts where one of them is at home: in the home they share,
    or else in the smaller-numbered home of those where both are.
    """
    other = a if b is None else b
    mask = a["x"] @ other["x"].T >= cosine
    if b is None:
        mask &= ~np.tri(len(mask), dtype=bool)
    home_a, home_b = a["home"] == cell, other["home"] == cell
    mask &= home_a[:, None] | home_b[None, :]
    i, j = np.nonzero(mask & (home_a[:, None] != home_b[None, :]))
    if len(i):
        there = home_a[i]
        guest_home = np.where(there, other["home"][j], a["home"][i])
        host = [(a["cells"][x] if t else other["cells"][y]) for x, y, t in zip(i.tolist(), j.tolist(), there.tolist(), strict=True)]
        elsewhere = np.array([g < cell and g in h for g, h in zip(guest_home.tolist(), host, strict=True)])
        mask[i[elsewhere], j[elsewhere]] = False
    links = np.concatenate([mask @ other["copies"].astype(np.float64), mask.T @ a["copies"].astype(np.float64)]).astype(np.int64)
    nodes = np.concatenate([a["node"], other["node"]])
    if b is None:  # rows and columns are the same vectors
        group = blocks_of_links(mask | mask.T | np.eye(len(mask), dtype=bool))[: len(a["node"])]
        links, nodes = links[: len(group)] + links[len(group) :], a["node"]
    else:
        group = blocks_of_links(mask)
    order = np.argsort(group, kind="stable")
    starts = np.concatenate([[0], np.nonzero(np.diff(group[order]))[0] + 1])
    root = np.empty(len(nodes), np.int64)
    root[order] = np.repeat(np.minimum.reduceat(nodes[order], starts), np.diff(np.append(starts, len(order))))
    linked = links > 0
    return nodes[linked], links[linked], root[linked]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept): links join vectors of one label whose cosine is at least cosine.

    Equal vectors of a label are one node with a number of copies, so copies cost nothing. n_links counts the other rows
    linked directly, component_id is the smallest id reachable, kept whether that is the row's own. Null labels and
    vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
    length never link. Repeated rows each have their row and link with each other; a row with a null id is left out of
    the groups. An empty table gives an empty result. Other columns are not read.

    Pairs are found when one's home cell is a cell of the other, which nearly all are (tests hold the recall against
    brute force); none below the threshold is linked.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    sound = "id is not null and label is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)"
    rows = rows.withColumn("sound", F.coalesce(F.expr(sound), F.lit(False)))
    classes = cut(rows.where("sound").groupBy("label", "vector").agg(F.min("id").alias("node"), F.count("*").alias("copies")).withColumn("dim", F.size("vector")))
    sizes = {r.dim: r.n for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    centres = {dim: _centres(classes, dim, n) for dim, n in sizes.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            dims, vectors = batch.column(1).to_numpy(), batch.column(2)
            home, cells = np.zeros(len(dims), np.int32), [[]] * len(dims)
            for dim in np.unique(dims).tolist():
                at = np.nonzero(dims == dim)[0]
                near = unit(_matrix(vectors.take(pa.array(at)))) @ centres[dim].T
                home[at] = near.argmax(1)
                for i, own in zip(at.tolist(), near >= near.max(1, keepdims=True) - MARGIN, strict=True):
                    cells[i] = np.nonzero(own)[0].tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(home), pa.array(cells, pa.list_(pa.int32()))], ["c", "home", "cells"])

    placed = classes.select(F.struct("label", "vector", "node", "copies", "dim").alias("c"), "dim", "vector")
    kind = classes.schema["label"].dataType.simpleString()
    cells = placed.mapInArrow(assign, f"c struct<label:{kind},vector:array<double>,node:bigint,copies:bigint,dim:int>, home int, cells array<int>")
    cells = cells.select("c.label", "c.dim", "c.node", "c.copies", "c.vector", "home", "cells", F.explode("cells").alias("cell"))
    blocks = cells.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")).where("blocks > 1")
    dealt = cells.join(blocks, ["label", "dim", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "with")).withColumn("high", F.greatest("block", "with"))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        cell, low, high = key[2].as_py(), key[3].as_py(), key[4].as_py()
        data = {k: table.column(k).to_numpy() for k in ("node", "copies", "home", "block")} | {"x": unit(_matrix(table.column("vector")))}
        sets = [set(x) for x in table.column("cells").to_pylist()]

        def block(n: int) -> dict:
            at = np.nonzero(data["block"] == n)[0]
            return {k: data[k][at] for k in ("node", "copies", "home", "x")} | {"cells": [sets[i] for i in at]}

        a, b = block(low), block(high) if high != low else None
        node, links, root = linked_rows(cell, a, b, cosine) if len(a["node"]) and (b is None or len(b["node"])) else (np.zeros(0, np.int64),) * 3
        return pa.table({"node": pa.array(node), "links": pa.array(links), "root": pa.array(root)})

    found = cut(dealt.groupBy("label", "dim", "cell", "low", "high").applyInArrow(compare, "node long, links long, root long"))
    groups = connected_components(found, "node", "root")
    linked = found.groupBy("node").agg(F.sum("links").alias("links")).join(groups, "node", "left")
    by_class = classes.join(linked, "node", "left").select("label", "vector", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = rows.join(by_class, ["label", "vector"], "left")
    own = F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", F.when(F.col("sound"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("id"), F.lit(True)).alias("kept"))
