"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint's 64 bits fall into three segments of 22, 21 and 21 bits. Two fingerprints that differ in at
most two bits agree wholly in one segment (pigeonhole) and differ in at most two bits in the next one. The
binary Golay code [23, 12, 7] is perfect: every 23-bit word lies within three bits of one codeword. The
codewords reached by decoding a segment and its one-bit neighbours (one or six of them) are therefore shared
by any two segments at most two bits apart: the word midway between them decodes to one codeword for both.
So the keys (whole segment, codeword index of the next segment) lose no link.

Similar texts (similar_texts) are further apart: five-word shingles that agree to 0.8 leave 5 to 15 of 64 bits different,
mostly bits that were nearly even. Each segment is decoded after flipping any of its least certain bits, and the keys are the
codeword indices of two segments at a time: a pair of texts is found if two of its three segments, each with some of its doubtful
bits flipped on either side, decode alike (errors that don't fit into two segments, the third one may have). Candidates
are verified by the similarity of their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, give_back, id_and_bytes, slices, written

# The generator polynomial of the binary Golay code [23, 12, 7], x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY_POLYNOMIAL = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_BITS = 2
#: Buckets of more fingerprints than this are searched by looking up each one's neighbours, in linear time.
SMALL_BUCKET = 512


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """The hashes of a text's word shingles, repeats included; of fewer words the hash of all, of none nothing."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(words))
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], seed) for s, e in zip(first, last, strict=True)], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """In how many of the hashes each of the 64 bits is set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return ones


def majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles; 0 for a text without words."""
    hashes = shingle_hashes(text, shingle, seed)
    return majority(bit_counts(hashes), len(hashes))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): fp is the 64-bit fingerprint as a signed long. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            ids, texts = id_and_bytes(batch)
            fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(fps)], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "id long, fp long")


@lru_cache(1)
def golay_index() -> np.ndarray:
    """For each 23-bit word the index of the codeword within three bits of it."""
    data = np.arange(1 << 12, dtype=np.int64)
    code = data << 11
    rest = code.copy()
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1 == 1, rest ^ (GOLAY_POLYNOMIAL << (bit - 11)), rest)
    code |= rest
    index = np.zeros(1 << 23, np.uint16)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            index[code ^ sum(1 << b for b in bits)] = data
    return index


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all fingerprints (uint64): each row gets the keys that any link of it shares with it."""
    index, rows, keys = golay_index(), [], []
    for i, (at, width) in enumerate(SEGMENTS):
        near_at, near_width = SEGMENTS[(i + 1) % 3]
        whole = (fps >> np.uint64(at)) & np.uint64((1 << width) - 1)
        near = ((fps >> np.uint64(near_at)) & np.uint64((1 << near_width) - 1)).astype(np.int64)
        words = np.concatenate([index[near][:, None]] + [index[near ^ (1 << b)][:, None] for b in range(near_width)], axis=1)
        words.sort(axis=1)
        fresh = np.ones(words.shape, bool)
        fresh[:, 1:] = words[:, 1:] != words[:, :-1]
        r, c = np.nonzero(fresh)
        rows.append(r)
        keys.append((np.int64(i) << 40) | (whole[r].astype(np.int64) << 12) | words[r, c].astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def _pairs_within(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs i < j inside consecutive runs of these (small) lengths."""
    starts = np.cumsum(counts) - counts
    left, right = [], []
    for size in np.unique(counts[counts > 1]):
        i, j = np.triu_indices(size, 1)
        at = starts[counts == size][:, None]
        left.append((at + i).ravel())
        right.append((at + j).ravel())
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def links_in_bucket(nodes: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among the different fingerprints of one large bucket: each one's neighbours within two bits are
    looked up in the sorted bucket, so the time grows in proportion to the bucket."""
    order = np.argsort(fps, kind="stable")
    nodes, fps = nodes[order], fps[order]
    a, b = [], []
    masks = [1 << i for i in range(64)] + [(1 << i) | (1 << j) for i, j in combinations(range(64), 2)]
    for mask in masks:
        other = fps ^ np.uint64(mask)
        at = np.searchsorted(fps, other)
        at[at == len(fps)] = 0
        hit = np.nonzero((fps[at] == other) & (other > fps))[0]
        if len(hit):
            a.append(nodes[hit])
            b.append(nodes[at[hit]])
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links(reps: DataFrame, partitions: int) -> DataFrame:
    """(a, b): node pairs of linked fingerprints. reps has one row (node, fp) per different fingerprint."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 20_000):
            node, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            row, key = fuzzy_keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[row]), pa.array(fp[row])], ["key", "node", "fp"])

    def found(key: np.ndarray, node: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]])
        counts = np.diff(starts)
        large = counts > SMALL_BUCKET
        small = np.repeat(~large, counts)
        n, f = node[small], fp[small]
        i, j = _pairs_within(counts[~large])
        ok = np.bitwise_count(f[i] ^ f[j]) <= MAX_BITS
        parts = [(n[i[ok]], n[j[ok]])] + [links_in_bucket(node[s:e], fp[s:e]) for s, e in zip(starts[:-1][large], starts[1:][large], strict=True)]
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = part if held is None else [np.concatenate(x) for x in zip(held, part, strict=True)]
            if not len(held[0]):
                continue
            ends = np.searchsorted(held[0], held[0][-1])  # the last bucket may go on in the next batch
            if ends:
                yield from found(held[0][:ends], held[1][:ends], held[2][:ends].view(np.uint64))
                held = [x[ends:] for x in held]
        if held is not None and len(held[0]):
            yield from found(held[0], held[1], held[2].view(np.uint64))

    keys = reps.select("node", "fp").mapInArrow(keyed, "key long, node long, fp long")
    dealt = keys.repartition(partitions, "key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(verified, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id reachable over links, its own included.

    Documents with equal fingerprints are one node (its smallest id), grouped with a combined minimum before
    anything else, so a group of copies of any size costs one row. Null and empty texts and texts of white
    space have fingerprint 0 and are linked like any other. An empty table gives an empty result. Repeated
    rows are kept as they are. Other columns of docs are not read. A row with a null id is linked to nothing.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reps = fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("node"))
    groups = connected_components(links(reps, parts))
    by_fp = reps.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(by_fp, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


#: Least certain bits of each segment that are flipped in any combination before decoding.
DOUBTFUL = 3
#: Candidates differ in at most so many of 64 bits; texts whose shingles agree to 0.8 rarely differ in more.
CANDIDATE_BITS = 16
#: Candidates in one bucket that are compared with each other at once; larger buckets are first worked on in blocks of so many.
PAIRED_BUCKET = 64
#: Each class's nearest candidates that are verified first.
PARTNERS = 4
#: Pairs verified at once.
CELL_PAIRS = 20_000
#: Candidates of the last round that are sifted at once.
SIFTED = 1 << 14
#: So many different links are joined up in one task (4 MB); more go by steps over the cluster.
LINKS_ALONE = 1 << 18
LATER = "__later_id_of_a_near_copy__"


def doubtful_words(fps: np.ndarray, doubt: np.ndarray, doubtful: int = DOUBTFUL) -> np.ndarray:
    """[row, segment, choice]: the codeword indices of each segment. doubt holds for each row the 64 bits' distances from a tie."""
    index, found = golay_index(), []
    for at, width in SEGMENTS:
        value = ((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)[:, None]
        flips = np.int64(1) << np.argsort(doubt[:, at : at + width], axis=1, kind="stable")[:, :doubtful]
        for k in range(flips.shape[1]):
            value = np.concatenate([value, value ^ flips[:, k : k + 1]], axis=1)
        found.append(index[value].astype(np.int16))
    return np.stack(found, axis=1)


def doubtful_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the codeword indices of two segments at a time."""
    rows, keys = [], []
    for i in range(3):
        a, b = (words[:, k % 3].astype(np.int64) for k in (i, i + 1))
        both = ((a[:, :, None] << 12) | b[:, None, :]).reshape(len(a), -1)
        both.sort(axis=1)
        fresh = np.ones(both.shape, bool)
        fresh[:, 1:] = both[:, 1:] != both[:, :-1]
        r, c = np.nonzero(fresh)
        rows.append(r)
        keys.append((np.int64(i) << 24) | both[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def least_key(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The least key that both rows of codeword indices have (doubtful_words), where they have any."""
    none, least = 1 << 13, []
    for k in range(3):
        x = one[:, k].astype(np.int64)
        least.append(np.where((x[:, :, None] == other[:, k].astype(np.int64)[:, None, :]).any(2), x, none).min(1))
    out = np.full(len(one), -1)
    for k in (2, 1, 0):
        a, b = least[k], least[(k + 1) % 3]
        out = np.where((a < none) & (b < none), (k << 24) | (a << 12) | b, out)
    return out


#: The hashes' top bits deal a text's shingles to so many bins; a sketch has one bit of each bin's least hash.
BINS = 128
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(two 64-bit words, 64 bytes): of each bin the lowest bit of its least hash and its lowest four, 0 for an empty bin.
    hashes are sorted."""
    padded = np.append(hashes, np.uint64(0))
    at = np.searchsorted(hashes, _EDGES)
    least = np.where(np.append(at[1:], len(hashes)) > at, padded[at] & np.uint64(15), np.uint64(0)).astype(np.uint8)
    return np.packbits(least & 1, bitorder="little").view(np.uint64), least[::2] << 4 | least[1::2]


def still_near(one: np.ndarray, other: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows of four bits a bin differ in no more bins than similar texts do, by two and a half deviations."""
    different = one ^ other
    different = ((different & 15) > 0).sum(1) + ((different >> 4) > 0).sum(1)
    filled, chance = BINS * (1 - np.exp(-sizes / BINS)), (1 - similarity) * 15 / 16
    return different <= 1 + chance * filled + 2.5 * np.sqrt(chance * (1 - chance) * filled)


def near_enough(one: tuple[np.ndarray, ...], other: tuple[np.ndarray, ...], similarity: float) -> np.ndarray:
    """Which (fp, number of shingles, two words of the sketch) may be similar: few different bits of the fingerprints, numbers of
    shingles that allow it, and no more different bits of the sketches than similar texts have, by two and a half deviations."""
    fps, sizes, x, y = one
    other_fps, other_sizes, other_x, other_y = other
    near = (np.bitwise_count(fps ^ other_fps) <= CANDIDATE_BITS) & (np.minimum(sizes, other_sizes) >= similarity * np.maximum(sizes, other_sizes))
    filled = BINS * (1 - np.exp(-np.maximum(sizes, other_sizes) / BINS))
    chance = (1 - similarity) / 2
    different = np.bitwise_count(x ^ other_x).astype(np.int64) + np.bitwise_count(y ^ other_y)
    return near & (different <= 1 + chance * filled + 2.5 * np.sqrt(chance * (1 - chance) * filled))


def sketch_bits(one: tuple[np.ndarray, ...], other: tuple[np.ndarray, ...]) -> np.ndarray:
    """In how many bits the sketches of (fp, number of shingles, two words of the sketch) differ."""
    return np.bitwise_count(one[2] ^ other[2]).astype(np.int64) + np.bitwise_count(one[3] ^ other[3])


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of some whole buckets at a time; rows come sorted by the first column, the key."""
    held = None
    for batch in chain(batches, [None]):
        if batch is not None:
            part = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = part if held is None else [np.concatenate(x) for x in zip(held, part, strict=True)]
        if held is None or not len(held[0]):
            continue
        # the last bucket may go on in the next batch
        upto = len(held[0]) if batch is None else int(np.searchsorted(held[0], held[0][-1]))
        if upto:
            yield [x[:upto] for x in held]
            held = [x[upto:] for x in held]


def bucket_sizes(key: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]]))


def partners(key: np.ndarray, node: np.ndarray, group: np.ndarray, marks: tuple[np.ndarray, ...], similarity: float) -> np.ndarray:
    """(node, bits, other): near partners of other groups; each node of a small bucket that has one there is in the result.

    Large buckets are dealt by hash into blocks of PAIRED_BUCKET, so the work grows with the bucket, not with its square; each of
    their nodes is also there with itself, as it may have partners in other blocks.
    """
    counts = bucket_sizes(key)
    starts = np.repeat(np.cumsum(counts) - counts, counts)
    large = np.repeat(counts > PAIRED_BUCKET, counts)
    mix = (node ^ (key << 20)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.lexsort((mix, key))
    block = starts + (np.arange(len(key)) - starts) // PAIRED_BUCKET * PAIRED_BUCKET
    i, j = (order[x] for x in _pairs_within(bucket_sizes(block)))
    differ = group[i] != group[j]
    i, j = i[differ], j[differ]
    near = near_enough(tuple(m[i] for m in marks), tuple(m[j] for m in marks), similarity)
    i, j = i[near], j[near]
    bits, own = sketch_bits(tuple(m[i] for m in marks), tuple(m[j] for m in marks)), node[large]
    return np.concatenate([np.stack([node[i], bits, node[j]], 1), np.stack([node[j], bits, node[i]], 1), np.stack([own, np.full(len(own), 1 << 20), own], 1)])


def first_of_each(rows: np.ndarray) -> np.ndarray:
    """Of each first column's rows the least."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])] if len(rows) else rows


def pairs_across(node: np.ndarray, group: np.ndarray, marks: tuple[np.ndarray, ...], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of all near pairs of different groups in one large bucket. The greatest group's nodes aren't compared with each
    other, so the work goes by the nodes outside it."""
    _, kind, sizes = np.unique(group, return_inverse=True, return_counts=True)
    order = np.lexsort((node, kind == sizes.argmax()))  # the greatest group last
    kind, marks = kind[order], tuple(m[order] for m in marks)
    outside, rows = len(node) - int(sizes.max()), max(1, (1 << 18) // len(node))
    for at in range(0, outside, rows):
        upto = min(outside, at + rows)
        one, other = tuple(m[at:upto, None] for m in marks), tuple(m[None, at:] for m in marks)
        i, j = np.nonzero(near_enough(one, other, similarity) & (kind[at:upto, None] != kind[None, at:]) & (np.arange(upto - at)[:, None] < np.arange(len(node) - at)))
        yield order[at + i], order[at + j]


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id): the smallest id reachable over texts whose sets of word shingles have a Jaccard similarity of at least similarity.

    Words are lower-cased (A-Z); a text of fewer words has one shingle, all of them. Texts with the same shingles are one class
    (their smallest id), found by a grouped minimum first, so a group of copies of any size costs one row. Null and empty texts
    and texts of white space have no shingle and are one class. Candidates come by doubtful_keys, are sifted by near_enough and verified by
    all their shingles (32 bits of each one's hash): first each class with its nearest ones, then all that are in different groups
    after that, so a large group doesn't cost the square of its size. Of two classes that differ in many bits the keys may miss a link (README has the recall); no pair below
    the similarity is linked. Rows with null ids are linked to
    nothing; repeated rows are kept as they are; an empty table gives an empty result. Other columns of docs are not read.
    """

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            ids, texts = id_and_bytes(batch)
            same, sizes, fps, bits = [], [], np.zeros(len(texts), np.uint64), np.zeros((len(texts), 2), np.uint64)
            least = np.zeros((len(texts), BINS // 2), np.uint8)
            doubt = np.zeros((len(texts), 64), np.float32)
            for n, t in enumerate(texts):
                hashes = shingle_hashes(t, shingle)
                ones = bit_counts(hashes)
                fps[n], doubt[n] = majority(ones, len(hashes)), np.abs(ones * 2 - len(hashes)) / max(1, len(hashes))
                kinds = np.unique(hashes)
                sizes.append(len(kinds))
                bits[n], least[n] = sketch(kinds)
                same.append(xxhash.xxh3_128_digest(kinds.tobytes()))
            words = doubtful_words(fps, doubt)
            row, key = doubtful_keys(words)
            order = np.argsort(row, kind="stable")
            counts = np.bincount(row, minlength=len(texts))
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(key[order].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(same, pa.binary()), pa.array(fps.view(np.int64)), keys, pa.array(sizes, pa.int32()), *[pa.array(bits[:, k].copy().view(np.int64)) for k in (0, 1)], *[pa.array(list(map(bytes, m)), pa.binary()) for m in (least, words)]], ["id", "same", "fp", "keys", "n", "x", "y", "bins", "words"])
        give_back()

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [np.zeros((0, 3), np.int64)]

        def sent() -> pa.RecordBatch:
            rows = first_of_each(np.concatenate(got))
            return pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(3)], ["node", "bits", "other"])

        for key, node, fp, size, x, y, group in whole_buckets(batches):
            got.append(partners(key, node, group, (fp.view(np.uint64), size.astype(np.float64), x.view(np.uint64), y.view(np.uint64)), similarity))
            if sum(map(len, got)) > 1_000_000:
                got = [first_of_each(np.concatenate(got))]
            if len(got[0]) > 500_000:
                yield sent()
                got = [np.zeros((0, 3), np.int64)]
        yield sent()

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, fp, size, x, y, group, bins, words in whole_buckets(batches):
            marks, counts = (fp.view(np.uint64), size.astype(np.float64), x.view(np.uint64), y.view(np.uint64)), bucket_sizes(key)
            small, starts = counts <= PAIRED_BUCKET, np.cumsum(counts) - counts

            def sent(i: np.ndarray, j: np.ndarray, key=key, node=node, size=size, bins=bins, words=words) -> pa.RecordBatch:
                rows = lambda c, at, kind, width: np.frombuffer(b"".join(c[at]), kind).reshape(len(at), width)
                near = still_near(rows(bins, i, np.uint8, BINS // 2), rows(bins, j, np.uint8, BINS // 2), np.maximum(size[i], size[j]), similarity)
                i, j = i[near], j[near]
                # of all buckets that have both, the one of the least key tells
                one, other = (rows(words, at, np.int16, 3 << DOUBTFUL).reshape(len(at), 3, 1 << DOUBTFUL) for at in (i, j))
                here = least_key(one, other) == key[i]
                a, b = node[i[here]], node[j[here]]
                return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

            def parted(i: np.ndarray, j: np.ndarray, sent=sent) -> Iterator[pa.RecordBatch]:
                for at in range(0, len(i), SIFTED):
                    yield sent(i[at : at + SIFTED], j[at : at + SIFTED])

            own = np.nonzero(np.repeat(small, counts))[0]
            i, j = (own[p] for p in _pairs_within(counts[small]))
            differ = group[i] != group[j]
            i, j = i[differ], j[differ]
            near = near_enough(tuple(m[i] for m in marks), tuple(m[j] for m in marks), similarity)
            yield from parted(i[near], j[near])
            for s, n in zip(starts[~small].tolist(), counts[~small].tolist(), strict=True):
                own = slice(s, s + n)
                for i, j in pairs_across(node[own], group[own], tuple(m[own] for m in marks), similarity):
                    yield from parted(s + i, s + j)
        give_back()

    def verified(pairs: pa.Table, there: pa.Table) -> pa.Table:
        ids, sets = there.column("id").to_numpy(), there.column("shingles").to_pylist()
        place = {n: np.frombuffer(x, np.uint32) for n, x in zip(ids.tolist(), sets, strict=True)}
        ok = np.zeros(pairs.num_rows, bool)
        for k, (a, b) in enumerate(zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True)):
            x, y = place[a], place[b]
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok[k] = both >= similarity * (len(x) + len(y) - both)
        return pairs.select(["a", "b"]).filter(pa.array(ok))

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    sketches = written(rows.select("id", "text").mapInArrow(sketched, "id long, same binary, fp long, keys array<int>, n int, x long, y long, bins binary, words binary"), "sketches")
    classes = sketches.where("id is not null").groupBy("same").agg(F.min_by(F.struct("id", "fp", "keys", "n", "x", "y", "bins", "words"), "id").alias("x"))
    classes = written(classes.select("same", "x.*").withColumnRenamed("id", "node"), "classes")
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            ids, own = id_and_bytes(batch)
            yield pa.RecordBatch.from_arrays([ids, pa.array([np.unique(shingle_hashes(t, shingle) >> np.uint64(32)).astype(np.uint32).tobytes() for t in own], pa.binary())], ["id", "shingles"])

    def dealt(keyed: DataFrame) -> DataFrame:
        return keyed.repartition(parts, "key").sortWithinPartitions("key", "node")

    def linked(pairs: DataFrame) -> DataFrame:
        """Those pairs whose shingles are similar. Pairs are dealt to cells by the hashes of both ends; a class's shingles go once to
        each cell that has it, at most 2 * side of them, whatever the number of its pairs."""
        side = max(8, math.isqrt(pairs.count() // CELL_PAIRS) + 1)
        at = [F.pmod(F.xxhash64(F.col(c)), F.lit(side)) for c in ("a", "b")]
        placed = pairs.withColumn("cell", at[0] * side + at[1])
        needed = placed.select(F.col("cell").alias("of"), F.col("a").alias("id")).unionByName(placed.select(F.col("cell").alias("of"), F.col("b").alias("id"))).distinct()
        return placed.groupBy("cell").cogroup(needed.join(sets, "id").groupBy("of")).applyInArrow(verified, "a long, b long")

    def nearest_of(grouped: DataFrame) -> DataFrame:
        best = dealt(grouped).mapInArrow(nearest, "node long, bits long, other long")
        return cut(best.groupBy("node").agg(F.slice(F.array_sort(F.collect_set(F.struct("bits", "other"))), 1, PARTNERS).alias("near")))

    def pairs_of(met: DataFrame) -> DataFrame:
        chosen = met.select("node", F.explode("near.other").alias("other")).where("node <> other")
        return cut(chosen.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct())

    def keyed(some: DataFrame, *more: str) -> DataFrame:
        return some.select(F.explode("keys").alias("key"), "node", "fp", "n", "x", "y", "group", *more)

    met = nearest_of(keyed(classes.withColumn("group", F.col("node"))))
    # the shingles of the texts that may have a partner, once for each class
    texts = rows.join(met.select(F.col("node").alias("id")), "id").groupBy("id").agg(F.max("text").alias("text"))
    sets = written(texts.select("id", "text").mapInArrow(listed, "id long, shingles binary"), "shingles", "none")
    candidates = cut(classes.join(met.select("node"), "node"))
    links = linked(pairs_of(met))
    for last in (False, True):
        # then the nearest of other groups, then every near pair of which the groups don't say already that it is linked
        groups = cut(connected_components(links, alone=LINKS_ALONE))
        grouped = candidates.join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
        if last:
            grouped = grouped.join(met.select("node"), "node")
            pairs = cut(dealt(keyed(grouped, "bins", "words")).mapInArrow(across, "a long, b long"))
        else:
            met = nearest_of(keyed(grouped))
            pairs = pairs_of(met)
        links = groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(linked(pairs))
    groups = connected_components(links, alone=LINKS_ALONE)
    component = classes.join(groups, "node", "left").select("same", F.coalesce("component", "node").alias("component_id"))
    return sketches.select("id", "same").join(component, "same", "left").select("id", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without those that have a smaller id in their group of similar texts, by similar_texts.

    Rows with null ids stay, and so do all rows with the id that stays. All columns of docs stay, whatever their names.
    """
    later = similar_texts(docs, id_col, text_col, shingle, similarity).where("id <> component_id").select(F.col("id").alias(LATER)).distinct()
    return docs.join(later, docs[id_col].cast("long") == later[LATER], "left_anti")
