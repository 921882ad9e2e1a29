"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's logit is an offset and the sum of the hashed weights of its different
words and of their first four and five bytes, which carry what a word was not seen with in fitting; the document's probability is the noisy-or of its sentences'. Only document labels are needed: their log-loss is
carried back through the noisy-or to the sentences, whose scores then locate what offends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_bytes, slices
from .linear import REJECTED, Codes, Ftrl, fit_in_one_task, fitting_sample

BITS = 20
#: Where a sentence's logit starts from; sentences are clean unless a word says otherwise.
OFFSET = -6.0
#: About so many labelled documents are used to fit; the bound of the fitting sample.
FIT_ROWS = 16_000
EPOCHS = 4
THRESHOLD = 0.5
_EDGE = b".,;:!?\"'()[]{}<>*%$&#|-_"


def word_code(word: bytes) -> int:
    """One bit: whether a sentence ends with the word; above it the places of the bare word and of its two heads."""
    ends, bare = word.rstrip(b"\"')]}").endswith((b".", b"!", b"?")), word.strip(_EDGE)
    places = [xxhash.xxh64_intdigest(part, seed) & ((1 << BITS) - 1) for seed, part in enumerate((bare, bare[:4], bare[:5]))]
    return ((places[2] << BITS | places[1]) << BITS | places[0]) << 1 | ends


def sentences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentence number, place) of each different word and head of each sentence of a text."""
    ends = codes & 1
    number = np.cumsum(ends) - ends
    places = [(codes >> at) & ((1 << BITS) - 1) for at in (1, 1 + BITS, 1 + 2 * BITS)]
    both = np.unique(np.concatenate([(number << BITS) | p for p in places]))
    return both >> BITS, both & ((1 << BITS) - 1)


def fit(texts: list[bytes], ys: np.ndarray) -> bytes:
    model, coded = Ftrl((1 << BITS) + 1, 0.5, 1.0, 0.5, 1e-3), Codes(word_code)
    rows = [sentences(coded.of(t.lower().split())) for t in texts]
    for _ in range(EPOCHS):
        for (sentence, at), y in zip(rows, ys, strict=True):
            if not len(at):
                continue
            bias = model.weights(np.array([1 << BITS]))[0]
            z = np.clip(OFFSET + bias + np.bincount(sentence, model.weights(at)), -30, 30)
            p = 1 / (1 + np.exp(-z))
            clean = np.logaddexp(0, z).sum()  # -log of the chance that no sentence is toxic
            g = -p * (np.exp(-clean) / max(-np.expm1(-clean), 1e-12)) if y else p
            places, where = np.unique(at, return_inverse=True)
            model.update(places, np.bincount(where, g[sentence]))
            model.update(np.array([1 << BITS]), np.array([np.clip(g.sum(), -1, 1) * 0.1]))
    return model.weights().astype(np.float32).tobytes()


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """The weights fitted to about fit_rows labelled documents whose id meets the condition usable."""
    return fit_in_one_task(fitting_sample(docs, labels, label, usable, fit_rows, id_col, text_col), fit)


def _logits(w: np.ndarray, codes: np.ndarray) -> np.ndarray:
    sentence, at = sentences(codes)
    return OFFSET + w[1 << BITS] + np.bincount(sentence, w[at])


def score(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the noisy-or of a text's sentences.

    Null and empty texts and texts of white space have no sentence and score 0. Repeated rows and null ids are
    scored like any other row; an empty table gives an empty result. Other columns of docs are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, coded = np.frombuffer(model, np.float32).astype(np.float64), Codes(word_code)
        for batch in slices(batches, 1000):
            ids, texts = id_and_bytes(batch)
            out = np.zeros(len(texts))
            for i, t in enumerate(texts):
                codes = coded.of(t.lower().split())
                if len(codes):
                    out[i] = -np.expm1(-np.logaddexp(0, _logits(w, codes)).sum())
            yield pa.RecordBatch.from_arrays([ids, pa.array(out)], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(run, "id long, score double")


def offending_sentences(docs: DataFrame, model: bytes, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sentence, score, words): sentences that by themselves reach the threshold, numbered from 0 in their text.

    Null and empty texts and texts of white space have no sentence. Rows with one id or a null one each have their sentences. An
    empty table gives an empty result. Other columns of docs are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, coded = np.frombuffer(model, np.float32).astype(np.float64), Codes(word_code)
        for batch in slices(batches, 1000):
            ids, texts = id_and_bytes(batch)
            rows = []
            for key, t in zip(ids.to_pylist(), texts, strict=True):
                words = t.split()
                codes = coded.of([x.lower() for x in words])
                if not len(codes):
                    continue
                p = 1 / (1 + np.exp(-_logits(w, codes)))
                ends = np.append(np.nonzero(codes & 1)[0] + 1, len(words))
                for s in np.nonzero(p >= threshold)[0].tolist():
                    start = int(ends[s - 1]) if s else 0
                    rows.append((key, s, float(p[s]), b" ".join(words[start : int(ends[s])]).decode("utf-8", "replace")))
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "sentence", "score", "words"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(run, "id long, sentence long, score double, words string")


def accepted(docs: DataFrame, model: bytes, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs that score below threshold, with all their columns, whatever their names.

    Null and empty texts score 0 and stay. Of rows with one id all go if one is rejected; rows with null ids stay. An empty
    table stays empty.
    """
    high = score(docs, model, id_col, text_col).where(F.col("score") >= threshold).select(F.col("id").alias(REJECTED)).distinct()
    return docs.join(high, docs[id_col].cast("long") == high[REJECTED], "left_anti")
