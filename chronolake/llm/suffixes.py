"""Removal of long byte strings that repeat from document to document, by a hash-compared suffix sort.

1. Each string of length bytes holds an anchor: the string's smallest k-gram hash. Equal strings have equal anchors, so
   an anchor that only one document has needs no further look. Anchors are dealt to shards by their hash.
2. The bytes around each shared anchor go to that anchor's shard, from each sender equal surroundings once, for the
   smallest document that has them (they cover all its others). There the suffixes that start in them are sorted by a mergesort that compares two suffixes by binary search for their common extension over prefix
   polynomial hashes. Runs of suffixes with a common extension of length bytes are verified byte by byte; the smallest
   document id of each run decides which of its members are removed.
3. The removed spans go back to their documents.

An anchor that very many documents have would bring all their surroundings to one shard. Instead each string that holds
it goes to a shard by its own hash: strings within a common passage are equal, so each sender has one of each, and those
that reach over its ends differ and so spread over all shards.

Anchors, surroundings and spans travel as compressed blocks, one for each sender and shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_bytes, runs, slices, uncollected

LENGTH = 50
GRAM = 26
#: Bytes of text for each shard and for each batch of documents that one task holds.
SHARD_BYTES = 4 << 20
#: Shards, or batches of documents, that one task works on, one after the other.
SHARDS_A_TASK = 4
#: Documents with one anchor, beyond which its strings are dealt by their own hashes.
HOT_DOCS = 20_000
#: Bytes whose anchors are worked out at once.
PIECE = 256 << 10
#: Surroundings whose suffixes are sorted at once.
SORT_ROWS = 5_000
#: Bytes of text whose anchors a sender gathers before it sends them.
SEND_BYTES = 12 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_BYTE = np.random.default_rng(50).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def pack(values: np.ndarray) -> bytes:
    """An integer array as compressed byte planes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash) of the anchors of all strings of length bytes in these texts.

    Worked on in stretches of about PIECE bytes: short texts together, long ones in parts that overlap so that each string
    is wholly in one.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held: list[tuple[int, int, bytes]] = []
    size, cut = 0, False

    def flush() -> None:
        part, pos, h = _anchors([t for _, _, t in held], length, gram)
        number, start = np.array([(n, at) for n, at, _ in held], np.int64).T
        found.append((number[part], pos + start[part], h))

    for n, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), PIECE):
            held.append((n, at, text[at : at + PIECE + length - 1] if len(text) > PIECE else text))
            size += len(held[-1][2])
            cut |= at > 0
            if size >= PIECE:
                flush()
                held, size = [], 0
    if held:
        flush()
    if not found:
        return _anchors([], length, gram)
    number, pos, h = (np.concatenate(x) for x in zip(*found, strict=True))
    if cut:  # an anchor of strings in two parts was found twice
        order = np.lexsort((pos, number))
        number, pos, h = number[order], pos[order], h[order]
        once = np.concatenate([[True], (number[1:] != number[:-1]) | (pos[1:] != pos[:-1])]) if len(h) else np.zeros(0, bool)
        number, pos, h = number[once], pos[once], h[once]
    return number, pos, h


def _anchors(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n, width = len(data), length - gram + 1
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    powers, at, reach, whole = {1: _BYTE[data]}, 0, 1, None
    while reach * 2 <= gram:
        h = powers[reach]
        powers[reach * 2] = h[:-reach] * _power(reach) + h[reach:]
        reach *= 2
    for part in sorted(powers, reverse=True):
        if gram - at >= part:
            h = powers[part][at : at + n - gram + 1]
            whole = h if whole is None else whole * _power(part) + h
            at += part
    whole = (whole ^ (whole >> np.uint64(31))) * _BASE
    whole ^= whole >> np.uint64(29)
    whole |= np.uint64(1)
    grams = np.ones(len(whole), bool)
    strings = np.ones(n - length + 1, bool)
    for e in ends[:-1].tolist():  # nothing reaches over the end of a text
        grams[max(0, e - gram + 1) : e] = False
        strings[max(0, e - length + 1) : e] = False
    whole[~grams] = _TOP

    def sliding(a: np.ndarray, of) -> np.ndarray:
        reach, now = 1, a
        while reach * 2 <= width:
            now = of(now[:-reach], now[reach:])
            reach *= 2
        return of(now[: len(a) - width + 1], now[width - reach : width - reach + len(a) - width + 1]) if reach < width else now

    least = sliding(whole, np.minimum)
    least[~strings] = 0
    padded = np.zeros(len(whole) + width - 1, np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    where = np.nonzero((sliding(padded, np.maximum) == whole) & grams)[0]
    text = np.searchsorted(ends, where, "right")
    return text, where - (ends - sizes)[text], whole[where]


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Even shares of hashes that are spread evenly; greater hashes never come to a lesser shard."""
    return (((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def anchor_shard(hashes: np.ndarray, shards: int, length: int, gram: int) -> np.ndarray:
    """Even shares of anchors; greater hashes never come to a lesser shard.

    An anchor is the least of width hashes, so small ones are many: a gram whose hash is x (of 1) is an anchor with the chance
    (1 - x)^(width - 1) * (1 + (width - 1) x). The shard goes by the share of all anchors that are below.
    """
    n = length - gram
    above = 1 - (hashes >> np.uint64(11)) * 2.0**-53
    below = 1 - ((n + 2) * above ** (n + 1) - n * above ** (n + 2)) / 2
    return np.clip((below * shards).astype(np.int64), 0, shards - 1)


def numbered(raw: bytes, data: np.ndarray, begin: np.ndarray, size: np.ndarray, left: np.ndarray) -> np.ndarray:
    """A number for each string raw[begin : begin + size], the same for equal strings with an equal left, else different."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(raw[b : b + s], 50) for b, s in zip(begin.tolist(), size.tolist(), strict=True)), np.uint64, len(begin))
    order = np.lexsort((h, size, left))
    x, y = order[:-1], order[1:]
    alike = (h[x] == h[y]) & (size[x] == size[y]) & (left[x] == left[y])
    for n in np.unique(size[x[alike]]).tolist():
        at = np.nonzero(alike & (size[x] == n))[0]
        span = np.arange(n)
        for low in range(0, len(at), 100_000):
            part = at[low : low + 100_000]
            if not (data[begin[x[part], None] + span] == data[begin[y[part], None] + span]).all():
                names: dict[tuple[int, bytes], int] = {}  # different strings with one hash: by their bytes
                return np.array([names.setdefault((k, raw[b : b + s]), len(names)) for k, b, s in zip(left.tolist(), begin.tolist(), size.tolist(), strict=True)], np.int64)
    out = np.empty(len(h), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], ~alike])) if len(h) else 0
    return out


def string_hash(string: bytes) -> int:
    return xxhash.xxh64_intdigest(string, 50)


class Extensions:
    """Common extensions of suffixes of one buffer, by prefix polynomial hashes and binary search."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(data), _BASE)]))
        self.down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(data), inverse)]))
        self.prefix = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * up[:-1], dtype=np.uint64)])

    def hashes(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.prefix[start + size] - self.prefix[start]) * self.down[start]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes, length at most, the suffixes at a and b have in common."""
        low = np.where(self.hashes(a, self.length) == self.hashes(b, self.length), self.length, 0)
        open_ = np.nonzero(low == 0)[0]
        x, y, lo, hi = a[open_], b[open_], np.zeros(len(open_), np.int64), np.full(len(open_), self.length - 1)
        for _ in range(self.length.bit_length()):
            mid = (lo + hi + 1) >> 1
            same = self.hashes(x, mid) == self.hashes(y, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        low[open_] = lo
        return low

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether the suffix at a comes before that at b (or equals it, where that counts)."""
        size = self.common(a, b)
        at = np.minimum(size, self.length - 1)
        return np.where(size == self.length, or_equal, self.data[a + at] < self.data[b + at])

    def equal_bytes(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        out, span = np.ones(len(a), bool), np.arange(size)
        for at in range(0, len(a), 100_000):
            part = slice(at, at + 100_000)
            out[part] = (self.data[a[part, None] + span] == self.data[b[part, None] + span]).all(1)
        return out


def merge_sort(suffix: np.ndarray, segment: np.ndarray, ext: Extensions) -> np.ndarray:
    """The order that sorts the suffixes within each segment; segments are consecutive. All runs of a level are merged
    at once: each suffix finds its place in the neighbouring run by binary search."""
    n = len(suffix)
    order = np.arange(n)
    if not n:
        return order
    first = np.concatenate([[True], segment[1:] != segment[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    size = np.bincount(np.cumsum(first) - 1)[np.cumsum(first) - 1]
    width = 1
    while (active := np.nonzero(size > width)[0]).size:
        local = active - start[active]
        left = (local // width) % 2 == 0
        run = local // width * width
        other = np.where(left, run + width, run - width)
        lo = np.minimum(other, size[active])
        hi = np.minimum(other + width, size[active])
        base, mine = lo.copy(), suffix[order[active]]
        while (going := np.nonzero(lo < hi)[0]).size:
            mid = (lo[going] + hi[going]) >> 1
            theirs = suffix[order[start[active[going]] + mid]]
            # one of the left run goes before its equals in the right run
            less = ext.before(theirs, mine[going], ~left[going])
            lo[going] = np.where(less, mid + 1, lo[going])
            hi[going] = np.where(less, hi[going], mid)
        place = np.where(left, run, run - width) + (local - run) + (lo - base)
        new = order.copy()
        new[start[active] + place] = order[active]
        order = new
        width *= 2
    return order


def smallest_sources(data: np.ndarray, begin: np.ndarray, size: np.ndarray, left: np.ndarray, group: np.ndarray, doc: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For surroundings (begin, size) of anchors left bytes in, of different bytes within their group, and the smallest
    document that has each: the smallest document of each string, by its start's distance before the anchor. Groups are consecutive."""
    reach = length - gram + 1
    most = np.iinfo(np.int64).max
    out = np.full((len(begin), reach), most, np.int64)
    back = np.arange(reach)
    there = (back <= left[:, None]) & (length - back <= (size - left)[:, None])
    out[there] = np.broadcast_to(doc[:, None], out.shape)[there]
    starts = np.concatenate([[0], np.nonzero(group[1:] != group[:-1])[0] + 1, [len(group)]])
    many = np.diff(starts) > 1
    where = np.repeat(np.arange(len(many)), np.diff(starts))
    there &= many[where][:, None]
    if not there.any():
        return out
    at = 0
    while at < len(begin):  # whole groups at a time
        end = max(int(starts[np.searchsorted(starts, at + SORT_ROWS, "right") - 1]), int(starts[where[at] + 1]))
        part, sizes = slice(at, end), size[at:end]
        ahead = np.cumsum(sizes) - sizes
        own = data[np.repeat(begin[part] - ahead, sizes) + np.arange(sizes.sum())]
        _sort_part(there[part], where[part], ahead, left[part], doc[part], Extensions(own, length), out[part])
        at = end
    return out


def _sort_part(there: np.ndarray, where: np.ndarray, begin: np.ndarray, left: np.ndarray, doc: np.ndarray, ext: Extensions, out: np.ndarray) -> None:
    """smallest_sources for some whole groups, written to out."""
    length, data, reach = ext.length, ext.data, there.shape[1]
    row, off = np.nonzero(there)
    if not len(row):
        return
    by = np.lexsort((off, where[row]))
    row, off = row[by], off[by]
    segment = where[row] * reach + off
    suffix = begin[row] + left[row] - off
    # of suffixes that agree by hash one goes through the sort for all
    here = ext.hashes(suffix, length)
    order = np.lexsort((here, segment))
    fresh = np.concatenate([[True], (segment[order][1:] != segment[order][:-1]) | (here[order][1:] != here[order][:-1])])
    begins = np.nonzero(fresh)[0]
    counts = np.diff(np.append(begins, len(order)))
    one = order[begins]
    sorted_ = merge_sort(suffix[one], segment[one], ext)
    begins, counts = begins[sorted_], counts[sorted_]
    order = order[np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(len(order))]
    row, off, suffix = row[order], off[order], suffix[order]
    a, b = suffix[:-1], suffix[1:]
    same = (segment[1:] == segment[:-1]) & (ext.hashes(a, length) == ext.hashes(b, length))
    at = np.nonzero(same)[0]
    false = at[~ext.equal_bytes(a[at], b[at], length)]
    if len(false):  # different strings with one hash: sort their segments by their bytes
        for s in np.unique(segment[false]).tolist():
            members = np.nonzero(segment == s)[0]
            text = [data[x : x + length].tobytes() for x in suffix[members]]
            by_bytes = sorted(range(len(text)), key=text.__getitem__)
            row[members], off[members], suffix[members] = (x[members[by_bytes]] for x in (row, off, suffix))
            same[members[:-1]] = [text[i] == text[j] for i, j in zip(by_bytes, by_bytes[1:], strict=False)]
    starts = np.concatenate([[0], np.nonzero(~same)[0] + 1])
    least = np.minimum.reduceat(doc[row], starts)
    out[row, off] = np.repeat(least, np.diff(np.append(starts, len(row))))


def _rows(table: pa.Table) -> tuple[list[int | None], list[bytes], list[int]]:
    """Ids and texts of a batch of documents in an order that doesn't depend on how they arrived, and that order."""
    ids, texts = table.column("id").to_pylist(), [t or b"" for t in table.column("text").to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order], order


def _nullable(column: pa.ChunkedArray) -> pa.Array:
    """A struct column whose fields may all be null, as Spark's schemas have them."""
    whole = column.combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    return pa.StructArray.from_arrays(whole.flatten(), fields=[pa.field(f.name, f.type) for f in whole.type])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, carry: list[str] | None = None) -> DataFrame:
    """(id, text, kept, n_removed, n_spans, starts, ends, carried): text as bytes, and what is left of it when each byte covered by
    a string of length bytes that also starts in a document with a smaller id is removed; starts and ends of the
    removed runs; carried is a struct of the columns named in carry, by their places there. Where carry is given and something
    is removed, shown is kept without what is left of characters that are cut.

    Strings are judged on the input. Null texts are empty; texts shorter than length are kept whole. Rows with one id
    never remove from each other; a row with a null id is kept whole and removes nothing. Repeated rows each have their
    row. An empty table gives an empty result. Columns other than the id's, the text's and
    carry's are not read.
    """
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    shards = batches = max(16, -(-total // SHARD_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), F.struct(F.lit(True).alias("here"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry or [])]).alias("carried"))
    carried = rows.schema["carried"].dataType.simpleString()
    rows = rows.withColumn("batch", F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.crc32("text"))), F.lit(batches)).cast("int"))

    def sent(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        batch_of: list[np.ndarray] = []
        size = texts_held = 0

        def flush() -> pa.RecordBatch:
            h, text = (np.concatenate(x) for x in zip(*found, strict=True))
            of = np.concatenate(batch_of)
            rank = np.empty(len(of), np.int64)
            rank[np.argsort(of, kind="stable")] = np.arange(len(of))
            order = np.argsort(h)
            h, text = h[order], rank[text[order]]
            again = np.concatenate([[False], h[1:] == h[:-1]])
            tied = np.nonzero(again | np.append(again[1:], False))[0]  # hashes that are here more than once
            text[tied] = text[tied[np.lexsort((text[tied], h[tied]))]]
            first = ~np.concatenate([[False], (h[1:] == h[:-1]) & (text[1:] == text[:-1])])
            h, batch = h[first], np.sort(of)[text[first]]
            starts = np.nonzero(~np.concatenate([[False], (h[1:] == h[:-1]) & (batch[1:] == batch[:-1])]))[0]
            h, batch, many = h[starts], batch[starts].astype(np.uint32), np.diff(np.append(starts, len(h))).astype(np.uint16)
            parts = runs(anchor_shard(h, shards, length, gram))
            full, spans = [s for s, _ in parts], [x for _, x in parts]
            columns = [[pack(np.diff(h[x], prepend=np.uint64(0))) for x in spans], [pack(batch[x]) for x in spans], [pack(many[x]) for x in spans]]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32())] + [pa.array(c, pa.binary()) for c in columns], ["shard", "hashes", "batches", "docs"])

        for part in slices(incoming, 100):
            ids, texts = id_and_bytes(part)
            texts = [t if i is not None else b"" for i, t in zip(ids.to_pylist(), texts, strict=True)]
            text, _, h = anchors(texts, length, gram)
            found.append((h, text + texts_held))
            batch_of.append(part.column(2).to_numpy().astype(np.int64))
            size += sum(map(len, texts))
            texts_held += len(texts)
            if size > SEND_BYTES or texts_held > 60_000:
                yield flush()
                found.clear()
                batch_of.clear()
                size = texts_held = 0
        if found:
            yield flush()

    @uncollected
    def shared(table: pa.Table) -> pa.Table:
        h = np.concatenate([np.cumsum(unpack(x, "<u8"), dtype=np.uint64) for x in table.column("hashes").to_pylist()])
        batch, docs = (np.concatenate([unpack(x, kind) for x in table.column(k).to_pylist()]).astype(np.int64) for k, kind in (("batches", "<u4"), ("docs", "<u2")))
        order = np.argsort(h, kind="stable")
        h, batch, docs = h[order], batch[order], docs[order]
        starts = np.concatenate([[0], np.nonzero(h[1:] != h[:-1])[0] + 1]) if len(h) else np.zeros(0, np.int64)
        there = np.repeat(np.add.reduceat(docs, starts), np.diff(np.append(starts, len(h)))) if len(h) else docs
        flagged = there > 1
        h, batch, hot = h[flagged], batch[flagged], there[flagged] > HOT_DOCS
        order = np.lexsort((h, batch))
        h, batch, hot = h[order], batch[order], hot[order]
        parts = runs(batch)
        full, spans = [b for b, _ in parts], [x for _, x in parts]
        columns = {"hashes": [pack(np.diff(h[x], prepend=np.uint64(0))) for x in spans], "hot": [pack(hot[x].view(np.uint8)) for x in spans]}
        return pa.table({"batch": pa.array(full, pa.int32())} | {k: pa.array(v, pa.binary()) for k, v in columns.items()})

    @uncollected
    def surroundings(mine: pa.Table, flags: pa.Table) -> pa.Table:
        ids, texts, _ = _rows(mine)
        names = ("hashes", "docs", "rows", "at", "which", "left", "sizes", "data", "local")
        out: dict[str, list] = {k: [] for k in ("shard", "batch", *names)}
        known = np.concatenate([np.zeros(0, np.uint64), *[np.cumsum(unpack(x, "<u8"), dtype=np.uint64) for x in flags.column("hashes").to_pylist()]])
        hot = np.concatenate([np.zeros(0, np.uint8), *[unpack(x, "u1") for x in flags.column("hot").to_pylist()]]).astype(bool)
        by = np.argsort(known, kind="stable")
        known, hot = known[by], hot[by]
        reach = length - gram
        # what is around an anchor (how far in it lies, bytes) -> its number and first row; rows go by id
        around: dict[tuple[int, bytes], tuple[int, int]] = {}
        sent_on: list[tuple[int, int, int, int, bool]] = []
        local: list[tuple[int, int, int]] = []
        doc = [-1 if i is None else i for i in ids]
        for low in range(0, len(texts) if len(known) else 0, 100):
            part = [t if i is not None else b"" for i, t in zip(ids[low : low + 100], texts[low : low + 100], strict=True)]
            text, pos, h = anchors(part, length, gram)
            spot = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[spot] == h
            for t, p, x, many in zip((text[hit] + low).tolist(), pos[hit].tolist(), h[hit].tolist(), hot[spot[hit]].tolist(), strict=True):
                s = texts[t]
                if many:
                    strings = [(p - at, s[at : at + length]) for at in range(max(0, p - reach), min(p, len(s) - length) + 1)]
                else:
                    strings = [(min(p, reach), s[max(0, p - reach) : p + length])]
                for left, string in strings:
                    if len(string) >= length:
                        number, row = around.setdefault((left, string), (len(around), t))
                        if doc[row] < doc[t]:
                            local.append((t, p - left, p - left + len(string)))
                        else:
                            sent_on.append((string_hash(string) if many else x, number, t, p, many))
        batch = mine.column("batch")[0].as_py() if mine.num_rows else 0
        if around:
            h, number, row, at, own = (np.array(x, kind) for x, kind in zip(zip(*sent_on, strict=True), (np.uint64, np.int64, np.uint32, np.uint32, bool), strict=True))
            sent_on.clear()
            keys = list(around)
            del around
            shard = np.where(own, shard_of(h, shards), anchor_shard(h, shards, length, gram))
            order = np.lexsort((number, h, shard))
            h, number, row, at, shard = h[order], number[order], row[order], at[order], shard[order]
            numbers = np.array(doc, np.int64)[row]
            for n, (s, x) in enumerate(runs(shard)):
                own, which = np.unique(number[x], return_inverse=True)
                strings = [keys[i] for i in own.tolist()]
                columns = [np.diff(h[x], prepend=np.uint64(0)), numbers[x], row[x], at[x], which.astype(np.uint32), np.array([k for k, _ in strings], np.uint16), np.array([len(k) for _, k in strings], np.uint16)]
                mine_too = np.array(local if n == 0 else [], np.uint32).reshape(-1, 3)
                for name, value in zip(("shard", "batch", *names), (s, batch, *map(pack, columns), zstandard.compress(b"".join(k for _, k in strings), 3), pack(mine_too.ravel())), strict=True):
                    out[name].append(value)
        kinds = {"shard": pa.int32(), "batch": pa.int32()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})

    @uncollected
    def decided(table: pa.Table) -> pa.Table:
        def each(name: str, kind: str) -> list[np.ndarray]:
            return [unpack(x, kind) for x in table.column(name).to_pylist()]

        h = np.concatenate(hashes := [np.cumsum(x, dtype=np.uint64) for x in each("hashes", "<u8")])
        batch = np.repeat(np.array(table.column("batch").to_pylist(), np.int64), [len(x) for x in hashes])
        doc, row, at = (np.concatenate(each(k, kind)).astype(np.int64) for k, kind in (("docs", "<i8"), ("rows", "<u4"), ("at", "<u4")))
        lefts = each("left", "<u2")
        ahead = np.cumsum([0] + [len(x) for x in lefts])
        which = np.concatenate([x.astype(np.int64) + a for x, a in zip(each("which", "<u4"), ahead, strict=False)])
        left, size = np.concatenate(lefts).astype(np.int64), np.concatenate(each("sizes", "<u2")).astype(np.int64)
        raw = b"".join(zstandard.decompress(x) for x in table.column("data").to_pylist())
        data, begin = np.frombuffer(raw, np.uint8), np.cumsum(size) - size
        # surroundings that are the same from several senders count as one
        same = numbered(raw, data, begin, size, left)
        del raw
        first = np.unique(same, return_index=True)[1]
        kind = same[which]
        least, group = np.full(len(first), np.iinfo(np.int64).max), np.zeros(len(first), np.uint64)
        np.minimum.at(least, kind, doc)
        group[kind] = h
        by = np.argsort(group, kind="stable")
        first, least, group = first[by], least[by], group[by]
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        kind = place[kind]
        order = np.argsort(kind, kind="stable")
        batch, row, at, doc, kind = batch[order], row[order], at[order], doc[order], kind[order]
        ends = np.append(np.nonzero(group[1:] != group[:-1])[0] + 1, len(group))
        spans, low = [], 0
        while low < len(group):  # some whole groups at a time
            high = int(ends[min(np.searchsorted(ends, low + 2 * SORT_ROWS), len(ends) - 1)])
            part, own = slice(low, high), slice(*np.searchsorted(kind, [low, high]))
            source = smallest_sources(data, begin[first[part]], size[first[part]], left[first[part]], group[part], least[part], length, gram)
            for some in range(own.start, own.stop, 50_000):
                x = slice(some, min(some + 50_000, own.stop))
                covered = source[kind[x] - low] < doc[x, None]
                hit = np.nonzero(covered.any(1))[0]
                nearest, farthest = covered[hit].argmax(1), length - gram - covered[hit][:, ::-1].argmax(1)
                spans.append(np.stack([batch[x][hit], row[x][hit], at[x][hit] - farthest, at[x][hit] - nearest + length], 1))
            low = high
        for b, x in zip(table.column("batch").to_pylist(), each("local", "<u4"), strict=True):
            x = x.reshape(-1, 3).astype(np.int64)
            spans.append(np.concatenate([np.full((len(x), 1), b), x], 1))
        spans = np.concatenate(spans) if spans else np.zeros((0, 4), np.int64)
        b, row, s, e = spans[np.lexsort(spans.T[[2, 1, 0]])].T
        if len(b):  # spans that overlap or touch become one; a row's come by their start
            key = b << 32 | row
            new = np.concatenate([[True], key[1:] != key[:-1]])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(b)), 0))
            shift = lead << 33
            end = np.maximum.accumulate(e + shift) - shift
            starts = np.nonzero(new | np.concatenate([[True], s[1:] > end[:-1]]))[0]
            b, row, s, e = b[starts], row[starts], s[starts], end[np.append(starts[1:], len(end)) - 1]
        parts = runs(b)
        full = [i for i, _ in parts]
        blocks = {k: pa.array([pack(x[own].astype(np.uint32)) for _, own in parts], pa.binary()) for k, x in (("rows", row), ("starts", s), ("ends", e))}
        return pa.table({"batch": pa.array(full, pa.int32()), **blocks})

    @uncollected
    def removed(mine: pa.Table, spans: pa.Table) -> pa.Table:
        ids, texts, order_in = _rows(mine)
        row, s, e = (np.concatenate([np.zeros(0, np.int64), *[unpack(x, "<u4").astype(np.int64) for x in spans.column(k).to_pylist()]]) for k in ("rows", "starts", "ends"))
        order = np.lexsort((s, row))
        row, s, e = row[order], s[order], e[order]
        cuts = np.searchsorted(row, np.arange(len(texts) + 1))
        starts, ends, kept = [], [], []
        for i, text in enumerate(texts):
            a, b = s[cuts[i] : cuts[i + 1]], np.maximum.accumulate(e[cuts[i] : cuts[i + 1]])
            fresh = np.concatenate([[True], a[1:] > b[:-1]]) if len(a) else np.zeros(0, bool)
            a, b = a[fresh].tolist(), b[np.append(fresh[1:], True)].tolist() if len(a) else []
            starts.append(a)
            ends.append(b)
            kept.append(b"".join(text[x:y] for x, y in zip([0, *b], [*a, len(text)], strict=True)))
        gone = [len(t) - len(k) for t, k in zip(texts, kept, strict=True)]
        shown = [k.decode("utf-8", "ignore") if n and carry is not None else None for k, n in zip(kept, gone, strict=True)]
        columns = (("shown", shown, pa.string()), ("id", ids, pa.int64()), ("text", texts, pa.binary()), ("kept", kept, pa.binary()), ("n_removed", gone, pa.int64()), ("n_spans", [len(a) for a in starts], pa.int64()), ("starts", starts, pa.list_(pa.int64())), ("ends", ends, pa.list_(pa.int64())))
        return pa.table({k: pa.array(v, t) for k, v, t in columns} | {"carried": _nullable(mine.column("carried").take(pa.array(order_in, pa.int64())))})

    # partitions grow with the shards, so a task's share doesn't grow with the input
    parts = min(shards, max(16, -(-shards // SHARDS_A_TASK)))
    dealt = rows.repartition(parts, "batch")
    flags = rows.select("id", "text", "batch").mapInArrow(sent, "shard int, hashes binary, batches binary, docs binary").repartition(parts, "shard").groupBy("shard").applyInArrow(lambda table: shared(table), "batch int, hashes binary, hot binary")
    block = "shard int, batch int, hashes binary, docs binary, rows binary, at binary, which binary, left binary, sizes binary, data binary, local binary"
    around = dealt.groupBy("batch").cogroup(flags.repartition(parts, "batch").groupBy("batch")).applyInArrow(lambda mine, flags: surroundings(mine, flags), block)
    spans = around.repartition(parts, "shard").groupBy("shard").applyInArrow(lambda table: decided(table), "batch int, rows binary, starts binary, ends binary")
    return dealt.groupBy("batch").cogroup(spans.repartition(parts, "batch").groupBy("batch")).applyInArrow(lambda mine, spans: removed(mine, spans), f"shown string, id long, text binary, kept binary, n_removed long, n_spans long, starts array<long>, ends array<long>, carried {carried}")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with the removed bytes taken out of their texts, all other columns as they were but n_chars, which follows the text.

    A character of which only some bytes are removed is removed as a whole. Documents of which nothing is left have an empty
    text, and so have null ones. Repeated rows stay repeated.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    found = repeated_spans(docs, id_col, text_col, length, gram, others)
    text = F.when(F.col("n_removed") > 0, F.col("shown")).otherwise(F.col("text").cast("string"))
    out = {id_col: F.col("id").cast(docs.schema[id_col].dataType), text_col: text} | {c: F.col(f"carried.c{i}") for i, c in enumerate(others)}
    if "n_chars" in others:
        out["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return found.select(*[out[c].alias(c) for c in docs.columns])
