"""Follow-the-regularised-leader updates and the fitting sample that the two classifiers share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_bytes


#: The ids of rejected rows, under a name that no table has.
REJECTED = "__rejected_id_of_a_classifier__"


class Ftrl:
    """Per-coordinate FTRL-proximal weights."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n, self.args = np.zeros(size), np.zeros(size), (alpha, beta, l1, l2)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        alpha, beta, l1, l2 = self.args
        z = self.z[at]
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(self.n[at])) / alpha + l2))

    def update(self, at: np.ndarray, gradient: np.ndarray) -> None:
        """One step on different coordinates at."""
        n = self.n[at]
        grown = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(grown) - np.sqrt(n)) / self.args[0] * self.weights(at)
        self.n[at] = grown


class Codes(dict):
    """token -> integer code, worked out once per token; emptied when it holds more than so many tokens."""

    def __init__(self, code: Callable[[bytes], int], most: int = 300_000):
        super().__init__()
        self.code, self.most = code, most

    def __missing__(self, token: bytes) -> int:
        self[token] = c = self.code(token)
        return c

    def of(self, tokens: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


def fitting_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of about most labelled documents, chosen by a hash of the id; all of them if there are fewer.

    usable is a condition on the id column. Labels that are null are skipped; repeated ones count once, as 1 if any is.
    Of texts with one id the greatest counts; a null text is empty. Without labels, or in an empty table, nothing is chosen.
    """
    known = labels.where(usable & F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label) > 0).cast("int").alias("y"))
    there = max(1, known.count())
    chosen = known.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / there)) + 1)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(chosen, "id").groupBy("id").agg(F.max("text").alias("text"), F.max("y").alias("y"))


def fit_in_one_task(sample: DataFrame, fit: Callable[[list[bytes], np.ndarray], bytes]) -> bytes:
    """What fit makes of the bounded sample, worked out on an executor; rows come in the order of a hash of the id.

    An empty sample has no task there; what fit makes of nothing is worked out here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ys = [], []
        for batch in batches:
            texts += id_and_bytes(batch)[1]
            ys += batch.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([fit(texts, np.array(ys, np.float64))], pa.binary())], ["model"])

    ordered = sample.select("id", "text", "y").repartition(1).sortWithinPartitions(F.xxhash64("id", F.lit("order")), "id")
    model = ordered.mapInArrow(run, "model binary").first()
    return bytes(model[0]) if model else fit([], np.zeros(0))
