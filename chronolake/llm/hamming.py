"""Exact k nearest binary codes by incremental multi-index hashing.

A 64-bit code is four 16-bit segments, each with an index of its own. A query looks up all segment values within radius
0, then 1, then 2 ... of its own segments. After radius s every code within 4 (s + 1) - 1 bits has been met (pigeonhole),
so the search ends when the k-th distance found is no more than that.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEGMENTS, BITS = 4, 16
#: Different codes for each index, and queries for each block; a task holds one of each.
SHARD_CODES, BLOCK_QUERIES = 32_768, 1024
SALTS = 64


def sign_code(vector: str) -> Column:
    """Bit i of the code is whether component i (of the first 64) is above zero; null components are not."""
    return F.expr(f"aggregate(transform(slice({vector}, 1, 64), (x, i) -> if(x > 0 and not isnan(x), shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)")


@lru_cache(1)
def _masks() -> list[np.ndarray]:
    every = np.arange(1 << BITS, dtype=np.int64)
    return [every[np.bitwise_count(every) == s] for s in range(BITS + 1)]


class CodeIndex:
    """Different codes with the ids of each, smallest first, and an index of each segment."""

    def __init__(self, codes: np.ndarray, ids: list[np.ndarray]):
        self.codes, self.ids = codes, ids
        self.order, self.starts = [], []
        for j in range(SEGMENTS):
            segment = ((codes >> np.uint64(BITS * j)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
            order = np.argsort(segment, kind="stable")
            self.order.append(order)
            self.starts.append(np.searchsorted(segment[order], np.arange((1 << BITS) + 1)))

    def nearest(self, code: np.uint64, own: int, k: int) -> list[tuple[int, int]]:
        """The k (distance, id) of smallest distance, then id, without the query's own id."""
        met = np.zeros(len(self.codes), bool)
        found: list[np.ndarray] = []
        for radius in range(BITS + 1):
            for j in range(SEGMENTS):
                values = int((code >> np.uint64(BITS * j)) & np.uint64((1 << BITS) - 1)) ^ _masks()[radius]
                low, high = self.starts[j][values], self.starts[j][values + 1]
                full = high > low
                low, count = low[full], (high - low)[full]
                if len(low):
                    at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    rows = self.order[j][at]
                    rows = rows[~met[rows]]
                    met[rows] = True
                    found.append(rows)
            rows = np.concatenate(found) if found else np.zeros(0, np.int64)
            distance = np.bitwise_count(self.codes[rows] ^ code).astype(np.int64)
            sure = distance <= SEGMENTS * (radius + 1) - 1
            held = sum(len(self.ids[r]) - (own in self.ids[r]) for r in rows[sure])
            if held >= k or len(rows) == len(self.codes):
                break
        out = sorted((int(d), int(i)) for r, d in zip(rows, distance, strict=True) if held < k or d <= SEGMENTS * (radius + 1) - 1 for i in self.ids[r] if i != own)
        return out[:k]


def top_k(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", code: Column | None = None) -> DataFrame:
    """(query_id, rank, id, distance): for each row that meets the condition queries its k nearest other rows.

    Nearness is the Hamming distance of the codes (by default sign_code of the column embedding), then the smaller id.
    Equal codes are one entry of the index with its k + 1 smallest ids: no result can need more of them. Ids are taken
    as different; a repeated id counts once. Rows whose id or vector is null are neither queries nor results. With fewer than k
    other rows all are returned; an empty table gives an empty result. Every shard of codes is searched by every block
    of queries.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), (sign_code("embedding") if code is None else code).alias("code"), F.coalesce(queries, F.lit(False)).alias("query"))
    rows = rows.where("id is not null and code is not null")
    salted = Window.partitionBy("code", "salt").orderBy("id")
    once = rows.select("code", "id").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    few = once.withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1)
    least = few.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k + 1)
    entries = least.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = rows.where("query").select("id", "code").distinct()
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("query").alias("q")).first()
    shards, blocks = max(1, -(-sizes.n // SHARD_CODES)), max(1, -(-sizes.q // BLOCK_QUERIES))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = entries.select(F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int").alias("shard"), spread(blocks).alias("block"), "code", "ids")
    wanted = asked.select(spread(shards).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "code")

    def search(entries: pa.Table, asked: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if entries.num_rows and asked.num_rows:
            index = CodeIndex(entries.column("code").to_numpy().view(np.uint64), [np.array(x) for x in entries.column("ids").to_pylist()])
            for own, code in zip(asked.column("id").to_pylist(), asked.column("code").to_numpy().view(np.uint64), strict=True):
                rows += [(own, i, d) for d, i in index.nearest(code, own, k)]
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "id", "distance"), cols, (pa.int64(), pa.int64(), pa.int32()), strict=True)})

    met = index.groupBy("shard", "block").cogroup(wanted.groupBy("shard", "block")).applyInArrow(search, "query_id long, id long, distance int")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return met.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
