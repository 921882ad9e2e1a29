"""Quality classifier: hashed word n-gram logistic regression trained with FTRL updates.

Features of a text are its words, the pairs of neighbouring words, and the pairs of neighbouring words' shapes (letters and
digits reduced to their kind, other characters kept), each kind hashed to 2^19 places; each kind counts as the mean over the
text, so a score doesn't depend on the length. A score is one sparse dot product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_bytes, slices
from .linear import REJECTED, Codes, Ftrl, fit_in_one_task, fitting_sample

#: Places of each kind of feature, as a power of two.
BITS = 19
PLACES = 3 << BITS
SCALE = 20.0
#: About so many labelled documents are used to fit; the bound of the fitting sample.
FIT_ROWS = 12_000
EPOCHS = 3
THRESHOLD = 0.7
_KINDS = ((re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0"))


def word_code(word: bytes) -> int:
    """The place of the word in the low bits, 40 bits of its shape's hash above."""
    shape = word
    for kind, mark in _KINDS:
        shape = kind.sub(mark, shape)
    return (xxhash.xxh64_intdigest(shape) >> 24) << BITS | (xxhash.xxh64_intdigest(word.lower()) & ((1 << BITS) - 1))


def features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the words, of the pairs of words and of the pairs of shapes of a text's word codes."""
    words, shapes = codes & ((1 << BITS) - 1), codes >> BITS
    place = lambda x, kind: (kind << BITS) + (((x[:-1] * np.int64(1000003) + x[1:]) * np.int64(0x5851F42D4C957F2D) >> 30) & ((1 << BITS) - 1))
    return words, place(words, 1), place(shapes, 2)


def weighed(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different places of a text and their values, the bias last."""
    at, value = [], []
    for kind in features(codes):
        places, count = np.unique(kind, return_counts=True)
        at.append(places)
        value.append(SCALE * count / max(1, len(kind)))
    return np.append(np.concatenate(at), PLACES), np.append(np.concatenate(value), 1.0)


def fit(texts: list[bytes], ys: np.ndarray) -> bytes:
    model, coded = Ftrl(PLACES + 1, 0.3, 1.0, 0.002, 1e-4), Codes(word_code)
    rows = [weighed(coded.of(t.split())) for t in texts]
    for _ in range(EPOCHS):
        for (at, x), y in zip(rows, ys, strict=True):
            p = 1 / (1 + np.exp(-np.clip(model.weights(at) @ x, -35, 35)))
            model.update(at, (p - y) * x)
    return model.weights().astype(np.float32).tobytes()


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """The weights fitted to about fit_rows labelled documents whose id meets the condition usable."""
    return fit_in_one_task(fitting_sample(docs, labels, label, usable, fit_rows, id_col, text_col), fit)


def score(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the probability that a text's label is 1.

    Null and empty texts and texts of white space score as the bias alone. Repeated rows and null ids are
    scored like any other row; an empty table gives an empty result. Other columns of docs are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, coded = np.frombuffer(model, np.float32).astype(np.float64), Codes(word_code)
        for batch in slices(batches, 1000):
            ids, texts = id_and_bytes(batch)
            out = np.full(len(texts), w[PLACES])
            for i, t in enumerate(texts):
                codes = coded.of(t.split())
                out[i] += SCALE * sum(w[kind].mean() for kind in features(codes) if len(kind))
            yield pa.RecordBatch.from_arrays([ids, pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(run, "id long, score double")


def accepted(docs: DataFrame, model: bytes, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs that score at least threshold, with all their columns, whatever their names.

    Null and empty texts go by the bias. Of rows with one id all go if one is rejected; rows with null ids stay. An empty table
    stays empty.
    """
    low = score(docs, model, id_col, text_col).where(F.col("score") < threshold).select(F.col("id").alias(REJECTED)).distinct()
    return docs.join(low, docs[id_col].cast("long") == low[REJECTED], "left_anti")
