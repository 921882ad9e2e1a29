"""Lexical retrieval packing: documents fill training windows together with their BM25 neighbours.

Documents are ordered by their token that the vocabulary took in last (the rarest, as a rule), so that related ones meet, and dealt by ranges of that order to
tasks; each run of shard_docs documents there is one shard with an inverted index of its own. Token statistics
(document frequencies, mean length) are those of the whole corpus; they are one number per vocabulary entry. Each
window starts from a seed, and the seed's unused neighbours fill it in the order of their scores. The last one is
cut where the window ends, and its rest seeds the next window.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import coded_words, give_back, slices, strings, uncollected, written

WINDOW = 2048
END_ID = 1
SHARD_DOCS = 4096
K1, B = 1.2, 0.75
#: Seeds whose frequent terms are scored in one product.
SEEDS = 256
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


#: Words that an executor's process keeps the ids of; the table is emptied when it holds more.
KNOWN_WORDS = 900_000
#: Words of these characters only are lowered one by one, and normal form C leaves them as they are.
_PLAIN = r"^[\x00-\x{12f}\x{131}-\x{24f}]*$"
#: Letters with ASCII punctuation after them.
_LETTERS = r"^(?P<letters>\pL*)(?P<marks>[!-/:-@\[-`{-~]*)$"


class Words:
    """Ids of the stretches between white space, each encoded once, as little-endian 16-bit integers.

    This tokenizer's pieces never reach over ASCII white space, and never over the border of letters and what follows.
    So plain letters with punctuation after them are encoded as two known pieces, by the tokenizer's merges alone, which
    is much faster; anything else goes through the whole tokenizer.
    """

    def __init__(self, path: str, most: int):
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.lowered, self.merges = (Tokenizer.from_file(path) for _ in range(3))
        self.lowered.normalizer = None
        self.merges.normalizer, self.merges.pre_tokenizer = None, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.last = np.zeros(1 << 16, bool)  # a word's last id, and no other, is one with the mark of a word's end
        self.last[[i for word, i in self.whole.get_vocab().items() if word.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {b"": b""}
        self.pieces: dict[str, bytes] = {"": b""}

    def _merge(self, pieces: list[str]) -> None:
        groups = [pieces[at : at + 1000] for at in range(0, len(pieces), 1000)]
        for group, coded in zip(groups, self.merges.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, "<u2")
            ends = (2 * np.nonzero(self.last[ids])[0] + 2).tolist()
            raw = ids.tobytes()
            self.pieces.update(zip(group, [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))

    def learn(self, fresh: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words that aren't known yet."""
        raw = pa.array(fresh, pa.binary())
        texts = pc.cast(raw, options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))
        simple = pc.and_not(pc.match_substring_regex(texts, _PLAIN), pc.match_substring(texts, "<|"))
        low = pc.utf8_lower(pc.if_else(simple, texts, ""))
        parts = pc.extract_regex(low, _LETTERS)
        plain = pc.and_(simple, parts.is_valid())
        new = self._rest(self.whole, raw.filter(pc.invert(simple)), [w.decode("utf-8", "replace") for w in raw.filter(pc.invert(simple)).to_pylist()])
        odd = pc.and_not(simple, plain)
        new |= self._rest(self.lowered, raw.filter(odd), low.filter(odd).to_pylist())
        parts = parts.filter(plain)
        both = []
        for name in ("letters", "marks"):
            coded = pc.struct_field(parts, name).dictionary_encode()
            pieces = coded.dictionary.to_pylist()
            self._merge([x for x in pieces if x not in self.pieces])
            both.append(pa.array([self.pieces[x] for x in pieces], pa.binary()).take(coded.indices))
        words = raw.filter(plain).to_pylist()
        new.update(zip(words, pc.binary_join_element_wise(*both, b"").to_pylist(), strict=True))
        return new

    def forget(self) -> None:
        self.known, self.pieces = {b"": b""}, {"": b""}

    def _rest(self, tokenizer, raw: pa.Array, texts: list[str]) -> dict[bytes, bytes]:
        words, new = raw.to_pylist(), {}
        for at in range(0, len(words), 10_000):
            coded = tokenizer.encode_batch_fast(texts[at : at + 10_000], add_special_tokens=False)
            new.update(zip(words[at : at + 10_000], [np.array(c.ids, "<u2").tobytes() for c in coded], strict=True))
        return new

    @uncollected
    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text as a binary."""
        if len(self.known) > self.most:
            self.forget()
        offsets, codes, words = coded_words(texts)
        words = words.to_pylist()
        found = list(map(self.known.get, words))
        if fresh := [i for i, x in enumerate(found) if x is None]:
            new = self.learn([words[i] for i in fresh])
            self.known.update(new)
            for i in fresh:
                found[i] = new[words[i]]
        ids = pa.array(found, pa.binary())
        offsets = pc.subtract(offsets, offsets[0]) if len(offsets) and offsets[0].as_py() else offsets
        return pc.binary_join(pa.ListArray.from_arrays(offsets, ids.take(codes)), b"")


@lru_cache(1)
def words_of(path: str, most: int = KNOWN_WORDS) -> Words:
    return Words(path, most)


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, window: int = WINDOW, known_words: int = KNOWN_WORDS, forget: bool = False, size: int = 1 << 16) -> DataFrame:
    """(doc_id, doc_tokens, last, ids): each document's ids with end_id after them, as 16-bit integers in a binary. last
    is the greatest id after the document's whole windows, -1 if nothing is left there.

    forget empties the executor's table of words after each task and gives free memory back to the system. Each task adds a row with doc_tokens -1 whose ids are its counts (64-bit): for each of size ids the documents that
    have it, then all documents, then all ids.
    """
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if forget:  # what this process had for other stages
            give_back()
        names, seen, there = ["doc_id", "doc_tokens", "last", "ids"], np.zeros(size + 2, np.int64), np.zeros((64, size), np.uint8)
        for batch in slices(batches, 4000):
            ids = pc.binary_join_element_wise(words_of(path, known_words).encode(strings(batch.column(1))), end, b"")
            ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64) // 2
            flat = np.frombuffer(ids.buffers()[2], "<u2")
            lengths = np.diff(ends)
            for low in range(0, len(ids), 64):
                some = lengths[low : low + 64]
                own = np.repeat(np.arange(0, len(some) * size, size), some) + flat[ends[low] : ends[low] + some.sum()]
                there.ravel()[own] = 1
                seen[:size] += np.add.reduce(there, axis=0, dtype=np.uint8)
                there.ravel()[own] = 0
            seen[size:] += len(ids), lengths.sum()
            last = np.full(len(ids), -1)
            begins = np.stack([ends[1:] - lengths % window, ends[1:]], 1)[lengths % window > 0]
            if len(begins):
                last[lengths % window > 0] = np.maximum.reduceat(np.append(flat[: ends[-1]], 0), begins.ravel())[::2]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(lengths), pa.array(last, pa.int32()), ids], names)
        if forget:
            words_of(path, known_words).forget()
            give_back()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([-1], pa.int32()), pa.array([seen.tobytes()], pa.binary())], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, doc_tokens long, last int, ids binary")


def document_frequencies(tokens: DataFrame, size: int = 1 << 16) -> tuple[np.ndarray, int, float]:
    """(documents with each id, documents, mean number of ids), from the tasks' counts; size bounds what comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size + 2, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                seen += np.frombuffer(raw, np.int64)
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["token", "n"])

    rows = tokens.where("doc_tokens < 0").select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size + 2, np.int64)
    out[rows.token.to_numpy(np.int64)] = rows.n.to_numpy(np.int64)
    n = int(out[size])
    return out[:size], n, float(out[size + 1]) / max(1, n)


class Shard:
    """A BM25 inverted index of one shard's documents, from which used ones are taken out.

    Terms of many documents have a row of weights for all of them, others a list of postings.
    """

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray, mean: float):
        n = len(texts)
        self.lengths = np.array([len(x) for x in texts], np.int64)
        key = (np.repeat(np.arange(n, dtype=np.int32), self.lengths) << 16) | np.concatenate(texts).astype(np.int32)
        key, count = np.unique(key, return_counts=True)
        doc, term = (key >> 16).astype(np.int64), (key & 0xFFFF).astype(np.int64)
        kinds, self.term = np.unique(term, return_inverse=True)
        self.at_doc = np.searchsorted(doc, np.arange(n + 1))
        norm = K1 * (1 - B + B * self.lengths / mean)
        weight = idf[term] * count * (K1 + 1) / (count + norm[doc])
        often = np.bincount(self.term) * 16 > n
        self.row_of = np.where(often, np.cumsum(often) - 1, -1)
        own = self.row_of[self.term]
        self.rows = np.zeros((int(often.sum()), n))
        self.rows[own[own >= 0], doc[own >= 0]] = weight[own >= 0]
        order = np.argsort(self.term, kind="stable")
        order = order[own[order] < 0]
        self.post_doc, self.post_weight = doc[order], weight[order]
        self.at_term = np.searchsorted(self.term[order], np.arange(len(kinds) + 1))
        self.unused, self.listed = np.ones(n, bool), np.arange(n)
        self.together: dict[int, np.ndarray] = {}  # what the rows add to the scores, for blocks of seeds

    def _drop_used(self) -> None:
        """Takes the used documents out of the index; nothing that can be found is lost."""
        left = self.unused[self.listed]
        place = np.cumsum(left) - 1
        live = left[self.post_doc]
        before = np.concatenate([[0], np.cumsum(live)])
        self.post_doc, self.post_weight, self.at_term = place[self.post_doc[live]], self.post_weight[live], before[self.at_term]
        self.rows, self.listed = np.ascontiguousarray(self.rows[:, left]), self.listed[left]
        self.together = {k: x[:, left] for k, x in self.together.items()}

    def _by_rows(self, seed: int) -> np.ndarray:
        """What the terms with a row add to the scores of the listed documents; worked out for SEEDS documents in one product."""
        block = seed // SEEDS
        if block not in self.together:
            low, high = block * SEEDS, min((block + 1) * SEEDS, len(self.lengths))
            own = slice(self.at_doc[low], self.at_doc[high])
            row, doc = self.row_of[self.term[own]], np.repeat(np.arange(high - low), np.diff(self.at_doc[low : high + 1]))
            there = np.zeros((high - low, len(self.rows)))
            there[doc[row >= 0], row[row >= 0]] = 1
            self.together[block] = there @ self.rows
        return self.together[block][seed - block * SEEDS].copy()

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents that share any of the seed's terms, scored with all of them, best first; ties in their given order."""
        if 2 * self.unused.sum() < len(self.listed):
            self._drop_used()
        terms = self.term[self.at_doc[seed] : self.at_doc[seed + 1]]
        terms = terms[self.row_of[terms] < 0]
        scores = self._by_rows(seed)
        spans = [slice(a, b) for a, b in zip(self.at_term[terms].tolist(), self.at_term[terms + 1].tolist(), strict=True)]
        if spans:
            docs = np.concatenate([self.post_doc[s] for s in spans])
            scores += np.bincount(docs, np.concatenate([self.post_weight[s] for s in spans]), minlength=len(scores))
        scores[~self.unused[self.listed]] = 0
        scores = scores.round(9)  # sums that should be equal are
        found = np.nonzero(scores)[0]
        if len(found) > 32:  # a window mostly takes few: those first
            least = np.partition(scores[found], -8)[-8]
            top = found[scores[found] >= least]
            yield from self.listed[top[np.lexsort((top, -scores[top]))]].tolist()
            found = found[scores[found] < least]
        yield from self.listed[found[np.lexsort((found, -scores[found]))]].tolist()


def fill(lengths: np.ndarray, shard: Shard, window: int) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start, length); all full but for the last, which is split at powers of two."""
    windows: list[list[tuple[int, int, int]]] = [[]]
    room, rest, first = window, None, 0

    def put(doc: int, start: int) -> tuple[int, int] | None:
        nonlocal room
        take = min(room, int(lengths[doc]) - start)
        windows[-1].append((doc, start, take))
        room -= take
        return (doc, start + take) if start + take < lengths[doc] else None

    while True:
        if rest is None:
            while first < len(lengths) and not shard.unused[first]:
                first += 1
            if first == len(lengths):
                break
            rest = (first, 0)
            shard.unused[first] = False
        seed = rest[0]
        rest = put(*rest)
        for doc in shard.neighbours(seed) if room else ():
            shard.unused[doc] = False
            rest = put(doc, 0)
            if not room:
                break
        if not room:
            windows.append([])
            room = window
    last = windows.pop()
    left, sizes = window - room, []
    while left:
        sizes.append(1 << (left.bit_length() - 1))
        left -= sizes[-1]
    for size in sizes:
        windows.append([])
        while size:
            doc, start, length = last.pop(0)
            take = min(size, length)
            windows[-1].append((doc, start, take))
            size -= take
            if take < length:
                last.insert(0, (doc, start + take, length - take))
    return windows


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], _NAMES)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, shard_docs: int = SHARD_DOCS, known_words: int = KNOWN_WORDS, forget: bool = False) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Whole windows of a document are sequences of their own; what is left of it, shorter than a window, is packed with
    its neighbours. A sequence is a full window, or else its length is a power of two, so nothing is padded. Null and
    empty texts are the end id alone. Repeated rows, and rows with the same or a null id, are packed each for itself.
    An empty table gives no pieces. Other columns of docs are not read. The tokenizer's ids must be below 2^16.
    known_words bounds the words that an executor's process keeps encoded, and so its memory; with forget none are kept after
    a task. Neighbours come from the own run of shard_docs documents.
    """
    tokens = written(tokenized(docs, path, id_col, text_col, end_id, window, known_words, forget), "tokens", "snappy")
    frequency, n, mean = document_frequencies(tokens)
    tokens = tokens.where("doc_tokens > 0")
    idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 34
        for batch in slices(batches, 1000):
            rows = []
            for doc, total, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(raw, "<u2")
                for start in range(0, total - window + 1, window):
                    rows.append((doc, start, window, _crc(ids[start : start + window]), total, number, 0))
                    number += 2
            yield _pieces(rows)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() << 34) | 1
        held: list[tuple] = []

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal number
            texts = [np.frombuffer(raw, "<u2") for _, _, raw in rows]
            shard, out = Shard(texts, idf, mean), []
            for pieces in fill(shard.lengths, shard, window):
                offset = 0
                for d, start, length in pieces:
                    doc, total, _ = rows[d]
                    out.append((doc, total - len(texts[d]) + start, length, _crc(texts[d][start : start + length]), total, number, offset))
                    offset += length
                number += 2
            return _pieces(out)

        for batch in slices(batches, shard_docs):
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= shard_docs:
                yield flush(held[:shard_docs])
                held = held[shard_docs:]
        if held:
            yield flush(held)

    parts = max(1, -(-n // (2 * shard_docs)))
    rest = F.substring("ids", (F.col("doc_tokens") - F.col("doc_tokens") % window) * 2 + 1, F.lit(2 * window))
    tails = tokens.where("last >= 0").select("last", "doc_id", "doc_tokens", rest.alias("ids"))
    dealt = tails.repartitionByRange(parts, "last", "doc_id").sortWithinPartitions("last", "doc_id", "ids")
    from_whole = tokens.where(F.col("doc_tokens") >= window).select("doc_id", "doc_tokens", "ids").mapInArrow(whole, PIECE)
    return from_whole.unionByName(dealt.select("doc_id", "doc_tokens", "ids").mapInArrow(packed, PIECE))
