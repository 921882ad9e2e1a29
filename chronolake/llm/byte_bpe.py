"""Byte-level BPE: encoding by Spark higher-order functions over the corpus' distinct words, decoding by concatenation.

1. Senders: texts are cut into words by the pattern, some megabytes of text at a time. Each sender's distinct words go to
   shards by their hash, as one compressed block for each shard; its texts are kept as one compressed block.
2. Shards: each distinct word is folded once, as an array of its bytes. In each step of an aggregate the neighbouring pair of
   smallest rank becomes one piece, until no pair has a rank. The ranks are a literal map from pairs of pieces to the rank of
   both together, kept in buckets by a hash of the pair. The ids go back to the senders as blocks in the order of their words.
3. Senders: each text's ids are those of its words in turn; decoding concatenates the bytes that the ids stand for.

The fold's state is copied in each step, so its time grows with the square of a word's length. Words of more than LONG_WORD
bytes, of which real texts have next to none, are folded with a heap of pairs instead, in n log n.

Most texts are cut at single spaces first, as the pattern never joins two stretches between such spaces; each different stretch
is matched once, with the space before it. Texts with white space before a space and after it, or the text's end after it, are
matched as a whole.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, strings, uncollected

BUCKETS = 1 << 15
#: Bytes of text that a sender works on at once.
SENDER_BYTES = 12 << 20
#: Senders that one task puts together, one after the other.
SENDERS_A_TASK = 1
#: Longer words (in bytes) are folded with a heap.
LONG_WORD = 128
#: Words that are folded in one row.
CHUNK = 5_000
_NONE = 2147483647  # the rank of a pair that has none
#: White space (and control characters) as the pattern knows it or more; stretches without any can be matched together.
_SPACE = r"\x00-\x20\x7f-\xa0\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{3000}\x{feff}"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def pieces_of(ranks: dict[bytes, int]) -> list[bytes]:
    """What each id stands for, by id."""
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    return pieces


def rank_map(ranks: dict[bytes, int]) -> str:
    """The literal: for each bucket its default, then pair and rank in turn; a pair is -1 - (left id * 65536 + right id)."""
    buckets: list[list[int]] = [[_NONE] for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        for at in range(1, len(token)):
            left, right = ranks.get(token[:at]), ranks.get(token[at:])
            if left is not None and right is not None:
                buckets[(left * 40503 + right * 30011) % BUCKETS] += [-1 - (left * 65536 + right), rank]
    return f"from_json('{json.dumps(buckets, separators=(',', ':'))}', 'array<array<bigint>>')"


def folded_words(words: str, ranks: dict[bytes, int]) -> str:
    """SQL for the ids of each of the arrays of bytes in the array words. The literal is bound to a variable, so the plan has it once."""
    return f"transform(array({rank_map(ranks)}), rank_table -> transform({words}, w -> {fold('w', ranks)}))[0]"


def fold(word: str, ranks: dict[bytes, int]) -> str:
    """SQL for the ids of the array of bytes word; rank_table is the literal.

    The state has an element for each piece: the rank of the pair that begins there (also the id of that pair's piece), above
    16 bits of its own id. The smallest element is the next merge, of equal ones the first. Where a word is one token as a
    whole, its merges lead there as well, as they do for the tokens of a trained vocabulary.
    """
    first = "array(" + ",".join(f"{ranks[bytes([b])]}L" for b in range(256)) + ")"
    empty, none = "cast(array() as array<bigint>)", f"{_NONE}L"
    own = lambda x: f"({x} & 65535)"

    def element(piece: str, following: str, there: str) -> str:
        bucket = f"get(rank_table, cast(({piece} * 40503 + {following} * 30011) & {BUCKETS - 1} as int))"
        rank = f"get({bucket}, cast(array_position({bucket}, -1 - ({piece} * 65536 + {following})) as int))"
        return f"shiftleft(if({there}, {rank}, {none}), 16) | {piece}"

    new = "shiftright(get(s, p - 1), 16)"
    merged = f"""transform(array(cast(array_position(s, array_min(s)) as int)), p -> concat(
        if(p > 1, slice(s, 1, greatest(p - 2, 0)), {empty}),
        if(p > 1, array({element(own("get(s, p - 2)"), new, "true")}), {empty}),
        array({element(new, own("get(s, p + 1)"), "p + 1 < size(s)")}),
        slice(s, p + 2, size(s))))[0]"""
    start = f"transform(array(transform({word}, b -> get({first}, b))), q -> transform(q, (a, i) -> {element('a', 'get(q, i + 1)', 'i + 1 < size(q)')}))[0]"
    folded = f"aggregate(sequence(1, greatest(size({word}) - 1, 1)), {start}, (s, i) -> if(array_min(s) < {_NONE << 16}L, {merged}, s))"
    return f"transform({folded}, x -> x & 65535)"


def heap_fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a long word: a heap of (rank, place) over linked pieces."""
    n = len(word)
    end, following, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    gone = bytearray(n)
    heap = [(ranks[pair], at, at + 2) for at in range(n - 1) if (pair := word[at : at + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, at, upto = heapq.heappop(heap)
        other = following[at]
        if gone[at] or other >= n or end[other] != upto:  # one of the two pieces has changed since
            continue
        gone[other], end[at], following[at] = 1, upto, following[other]
        if following[at] < n:
            before[following[at]] = at
        for left in (before[at], at):
            if left >= 0 and following[left] < n:
                pair = word[left : end[following[left]]]
                if pair in ranks:
                    heapq.heappush(heap, (ranks[pair], left, left + len(pair)))
    return [ranks[word[at : end[at]]] for at in range(n) if not gone[at]]


class Cutter:
    """Texts to units (stretches with the space before them; first stretches; whole texts) and units to words."""

    def __init__(self, pattern: str):
        self.words = regex.compile(pattern).findall

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """(offsets, units, words, counts): the units of each text, and of each unit its words, one unit's after the other's."""
        whole = pc.match_substring_regex(texts, f"[{_SPACE}] (?:[{_SPACE}]|\\z)")
        lists = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        values = lists.flatten()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        spaced = values.dictionary_encode()
        units, known = spaced.indices.to_numpy().astype(np.int64), spaced.dictionary
        first = pc.if_else(whole, texts, values.take(pa.array(offsets[:-1]))).dictionary_encode()
        units[offsets[:-1]] = len(known) + first.indices.to_numpy()
        own = [self.words(t) for t in first.dictionary.to_pylist()]
        simple = pc.match_substring_regex(known, f"^[^{_SPACE}]+$").to_numpy(zero_copy_only=False)
        together = known.filter(pa.array(simple)).to_pylist()
        words = self.words(" " + " ".join(together)) if together else []
        reach = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        ends = np.cumsum(np.fromiter(map(len, together), np.int64, len(together)) + 1)
        counts = np.zeros(len(known), np.int64)
        counts[simple] = np.diff(np.searchsorted(reach, ends, "right"), prepend=0)
        if not simple.all():
            others = [self.words(" " + t) for t in known.filter(pa.array(~simple)).to_pylist()]
            counts[~simple] = [len(x) for x in others]
            mixed, own_words, rest = [], iter(words), iter(others)
            for easy, n in zip(simple.tolist(), counts.tolist(), strict=True):
                mixed += [next(own_words) for _ in range(n)] if easy else next(rest)
            words = mixed
        words += [w for x in own for w in x]
        return offsets, units, words, np.append(counts, np.array([len(x) for x in own], np.int64))


def by_shard(words: pa.Array, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of words by shard, and the shard of each in that order."""
    at = np.fromiter(map(xxhash.xxh64_intdigest, words.cast(pa.binary()).to_pylist()), np.uint64, len(words)) % np.uint64(shards)
    order = np.argsort(at, kind="stable")
    return order, at[order].astype(np.int64)


def squeeze(array: pa.Array) -> bytes:
    """A binary array as one compressed block."""
    array = pa.concat_arrays([array.cast(pa.binary())])  # its own buffers from the start
    sizes = np.diff(np.frombuffer(array.buffers()[1], np.int32)[: len(array) + 1]).astype(np.uint32)
    planes = np.ascontiguousarray(sizes.view(np.uint8).reshape(-1, 4).T).tobytes()
    data = array.buffers()[2].to_pybytes() if array.buffers()[2] else b""
    return len(sizes).to_bytes(4, "little") + zstandard.compress(planes + data[: int(sizes.sum())], 1)


def unsqueeze(block: bytes) -> pa.Array:
    n = int.from_bytes(block[:4], "little")
    raw = zstandard.decompress(block[4:])
    sizes = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n).reshape(4, n).T).reshape(-1).view(np.uint32)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw[4 * n :])])


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded): ids are the decimal ids of a text joined by one space, decoded the bytes they stand for.

    Null and empty texts have no ids. Repeated rows and null ids are rows like any other; an empty table gives an empty
    result. Other columns of docs are not read. path is a file of tokens in base64 with their ranks, which are below 65536.
    """
    ranks = read_ranks(path)
    pieces = pieces_of(ranks)
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    parts = max(8, -(-total // (SENDER_BYTES * SENDERS_A_TASK)))
    # distinct words grow slower than the text (Heaps' law), and shards with them
    shards = max(8, int((total / (4 << 20)) ** 0.7))

    @uncollected
    def sender(ids: list[pa.Array], texts: list[pa.Array], number: int) -> pa.RecordBatch:
        column = pa.concat_arrays(texts)
        _, _, words, _ = Cutter(pattern).units(column)
        distinct = pa.array(words, pa.string()).dictionary_encode().dictionary
        order, at = by_shard(distinct, shards)
        distinct = distinct.take(pa.array(order))
        cuts = np.append(np.nonzero(np.diff(at, prepend=-1))[0], len(at))
        blocks = [squeeze(distinct.slice(a, b - a)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        rows = pa.concat_arrays(ids)
        columns = [pa.array([number], pa.int64()), _lists(np.array([len(rows)]), rows), pa.array([squeeze(column)], pa.binary()), _lists(np.array([len(blocks)]), pa.array(at[cuts[:-1]], pa.int32())), _lists(np.array([len(blocks)]), pa.array(blocks, pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, ["sender", "ids", "texts", "shards", "words"])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 24, [], [], 0
        for batch in slices(batches, 20):
            ids.append(batch.column(0).cast(pa.int64()))
            texts.append(strings(batch.column(1)))
            size += pc.sum(pc.binary_length(texts[-1])).as_py() or 0
            if size >= SENDER_BYTES:
                yield sender(ids, texts, number)
                ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield sender(ids, texts, number)

    def dealt_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, at, words in zip(batch.column(0).to_pylist(), batch.column(3), batch.column(4), strict=True):
                yield pa.RecordBatch.from_arrays([at.values, pa.array([number] * len(at), pa.int64()), words.values], ["shard", "sender", "words"])

    @uncollected
    def distinct(table: pa.Table) -> pa.Table:
        senders = table.column("sender").to_pylist()
        blocks = [unsqueeze(x) for x in table.column("words").to_pylist()]
        sizes = [len(x) for x in blocks]
        coded = pa.concat_arrays(blocks).dictionary_encode()
        del blocks
        which, words = coded.indices.to_numpy().astype(np.uint32), coded.dictionary
        ends = np.cumsum(sizes)
        long = pc.greater(pc.binary_length(words), LONG_WORD).to_numpy(zero_copy_only=False)
        short = words.filter(pa.array(~long))
        # ids of words come back in this order: short ones, then long ones
        place = np.empty(len(words), np.uint32)
        place[np.concatenate([np.nonzero(~long)[0], np.nonzero(long)[0]])] = np.arange(len(words), dtype=np.uint32)
        own = [place[which[e - n : e]].tobytes() for n, e in zip(sizes, ends.tolist(), strict=True)]
        starts = list(range(0, len(short), CHUNK))
        arrays = []
        for at in starts:
            part = pa.concat_arrays([short.slice(at, CHUNK)])
            flat = np.frombuffer(part.buffers()[2], np.uint8).astype(np.int16) if part.buffers()[2] else np.zeros(0, np.int16)
            ends_ = np.frombuffer(part.buffers()[1], np.int32)[: len(part) + 1]
            arrays.append(pa.ListArray.from_arrays(pa.array(ends_), pa.array(flat[: ends_[-1]])))
        n = len(starts)
        kind = pa.list_(pa.int16())
        folded = [heap_fold(w, ranks) for w in words.filter(pa.array(long)).to_pylist()]
        return pa.table({
            "shard": pa.array(table.column("shard").to_pylist()[:1] * (n + 1), pa.int32()),
            "chunks": pa.array([n] + [-1] * n, pa.int32()),
            "senders": pa.array([senders] + [[]] * n, pa.list_(pa.int64())),
            "which": pa.array([own] + [[]] * n, pa.list_(pa.binary())),
            "long": pa.array([folded] + [[]] * n, pa.list_(pa.list_(pa.int64()))),
            "words": pa.concat_arrays([pa.array([[]], pa.list_(kind))] + [_lists(np.array([len(a)]), a) for a in arrays]),
        })

    def sent_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(ids: pa.Array) -> pa.Array:
            """Lists of ids as one binary each, 16 bits an id."""
            ids = pa.concat_arrays([ids])
            ends = np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1]
            flat = ids.values.to_numpy()[: ends[-1]].astype("<u2")
            return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((ends * 2).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])

        head, got = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                shard, chunks, senders, which, long, coded = (batch.column(k)[i] for k in range(6))
                if chunks.as_py() >= 0:
                    head, got = (shard.as_py(), chunks.as_py(), senders.values, which.as_py(), block(long.values)), []
                else:
                    got.append(block(coded.values))
                if head is not None and len(got) == head[1]:
                    ids = pa.concat_arrays([*got, head[4]])
                    blocks = [squeeze(ids.take(pa.array(np.frombuffer(x, np.uint32)))) for x in head[3]]
                    yield pa.RecordBatch.from_arrays([head[2], pa.array([head[0]] * len(blocks), pa.int32()), pa.array(blocks, pa.binary())], ["sender", "shard", "ids"])
                    head, got = None, []

    @uncollected
    def put_together(mine: pa.Table, found: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "ids": pa.array([], pa.binary()), "decoded": pa.array([], pa.binary())})
        rows = mine.column("ids").combine_chunks().flatten()
        texts = unsqueeze(mine.column("texts")[0].as_py())
        offsets, units, words, counts = Cutter(pattern).units(strings(texts))
        coded = pa.array(words, pa.string()).dictionary_encode()
        del words, texts
        order, _ = by_shard(coded.dictionary, shards)
        by = np.argsort(found.column("shard").to_numpy(), kind="stable")
        blocks = found.column("ids").to_pylist()
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        own = pa.concat_arrays([unsqueeze(blocks[k]) for k in by.tolist()] or [pa.array([], pa.binary())])
        # the ids of each unit: those of its words in turn
        word = pa.array(back[coded.indices.to_numpy()])
        raw = pc.binary_join(_lists(counts, own.take(word)), b"")
        sizes = pc.binary_length(raw).to_numpy().astype(np.int64) // 2
        flat = np.frombuffer(raw.buffers()[2], "<u2")[: sizes.sum()] if raw.buffers()[2] else np.zeros(0, "<u2")
        ids = pa.array(flat.astype(np.int32))
        shown = pc.binary_join(_lists(sizes, numbers.take(ids)), b" ")
        meant = pc.binary_join(_lists(sizes, table.take(ids)), b"")
        # a unit without ids (an empty first stretch) adds nothing, not even a space
        there = sizes[units] > 0
        per_text = np.diff(np.concatenate([[0], np.cumsum(there)])[offsets])
        at = pa.array(units[there])
        total = np.diff(np.concatenate([[0], np.cumsum(sizes[units])])[offsets])
        return pa.table({"id": rows, "n_tokens": pa.array(total), "ids": pc.binary_join(_lists(per_text, shown.take(at)), b" "), "decoded": pc.binary_join(_lists(per_text, meant.take(at)), b"")})

    table, numbers = pa.array(pieces, pa.binary()), pa.array([b"%d" % i for i in range(len(pieces))], pa.binary())
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    dealt = rows.mapInArrow(cut_up, "sender long, ids array<bigint>, texts binary, shards array<int>, words array<binary>").repartition(parts, "sender")
    per_shard = dealt.mapInArrow(dealt_words, "shard int, sender long, words binary").repartition(min(shards, parts), "shard")
    words = per_shard.groupBy("shard").applyInArrow(lambda t: distinct(t), "shard int, chunks int, senders array<bigint>, which array<binary>, long array<array<bigint>>, words array<array<smallint>>")
    folded = words.withColumn("words", F.expr(folded_words("words", ranks)))
    back = folded.mapInArrow(sent_back, "sender long, shard int, ids binary").repartition(parts, "sender")
    return dealt.groupBy("sender").cogroup(back.groupBy("sender")).applyInArrow(lambda a, b: put_together(a, b), "id long, n_tokens long, ids binary, decoded binary")


def decoded(ids: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """ids with a column decoded added: the binary pieces of the array of ids in ids_col, concatenated.

    Null arrays give null; unknown and null ids add nothing. Other columns stay as they are; one named decoded is replaced.
    """
    hexes = json.dumps([p.hex() for p in pieces_of(read_ranks(path))])
    piece = f"get(from_json('{hexes}', 'array<string>'), cast(x as int))"
    return ids.withColumn("decoded", F.expr(f"unhex(array_join(transform({ids_col}, x -> {piece}), ''))"))
