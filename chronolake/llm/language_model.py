"""Scores of texts under a hierarchical Pitman-Yor language model.

The model has three levels. Each context (the token before) is a restaurant whose customers are the tokens that follow it
in the training texts. The restaurants of one group of contexts share a parent restaurant, whose customers are their
tables; its base is the corpus-wide distribution of single tokens: (c + 1) / (N + V + 1) for
every known token, and 1 / (N + V + 1) for all unknown ones together. Shards get the counts of the tokens that occur there
and aren't in the table of frequent ones. Seatings are sampled by Gibbs: a round draws the number of tables of each
dish anew, given its count (in Metropolis steps where there are many customers). The
parent's seating goes on from sample to sample. A token's probability is the mean over the samples after burn-in.

A context that makes up much of a shard is split by its tokens' hash into several restaurants, each weighed with the share
of its tokens; so the distribution stays proper (rare tokens' mass counts as evenly spread over the parts) and no shard gets
a hot context whole. Discount and strength of each level
are chosen per shard (and per size of restaurant) by the leave-one-out likelihood of the training customers.

Shards get (context, token, document) as compressed blocks, one for each sender; documents get the sums of their parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import coded_words, runs, slices, strings, uncollected, written
from .suffixes import pack, unpack

#: Most entries of the table of frequent tokens that every task gets (12 bytes each).
FREQUENT = 1 << 18
#: About so many tokens for each shard.
SHARD_TOKENS = 2_500_000
#: Each shard's contexts are dealt to so many parents, which are worked on one after the other to bound memory.
PARENTS = 3
#: Gibbs rounds between samples, samples thrown away, samples kept.
ROUNDS, BURN_IN, SAMPLES = 6, 2, 3
#: The number of tables of dishes with at most so many customers is drawn from its whole distribution; that of others moves.
DRAWN = 64
#: Greatest steps of those moves in a round, and the customers and tables up to which their weights are worked out.
MOVES = (1000, 300, 100, 30, 10, 3, 1, 100, 30, 10, 3, 1)
SHAPED, SHAPED_TABLES = 20_000, 4_096
DISCOUNTS = (0.5, 0.7, 0.85, 0.95)
STRENGTHS = (0.5, 2.0, 10.0, 50.0, 250.0, 2000.0)
PARENT_STRENGTHS = (1e3, 1e4, 1e5, 1e6, 1e7, 1e8)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) >> 1


#: The token after the last word; white space, so no word is like it.
END = word_hash(b"\n")


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(different words, places, sizes): each text's words as places among the different ones; A-Z in lower case."""
    offsets, places, words = coded_words(pc.ascii_lower(texts))
    ends, places = offsets.to_numpy().astype(np.int64), places.to_numpy()
    there = (pc.binary_length(words).to_numpy() > 0)[places]
    sizes = np.diff(np.concatenate([[0], np.cumsum(there)])[ends - ends[0]])
    return words, places[there], sizes


def hashes_of(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(word_hash, words.to_pylist()), np.int64, len(words))


def training_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(h, c): how often each token is in these texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            h, c = (np.concatenate(x) for x in zip(*held, strict=True))
            kinds, of = np.unique(h, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.bincount(of, c, len(kinds)).astype(np.int64))], ["h", "c"])

        for batch in slices(batches, 4000):
            words, places, sizes = words_of(strings(batch.column(0)))
            held.append((np.append(hashes_of(words), END), np.append(np.bincount(places, minlength=len(words)), len(sizes))))
            if sum(len(h) for h, _ in held) > 1_500_000:
                yield flush()
                held.clear()
        if held:
            yield flush()

    return docs.select(text_col).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c > 0")


class Vocabulary:
    """The most frequent tokens' counts, and the base distribution."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tokens: int, types: int):
        order = np.lexsort((hashes, -counts))
        self.counts = counts[order]  # by rank
        by = np.argsort(hashes[order])
        self.hashes, self.ranks = hashes[order][by], by
        self.tokens, self.types = tokens, types
        whole = tokens + types + 1
        self.base = (self.counts + 1) / whole
        rest = types - len(counts)
        self.rare = (tokens - int(counts.sum()) + rest + 1) / (rest + 1) / whole
        self.rare_mass = self.rare * (rest + 1)

    def code(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of frequent tokens; -1 - hash of all others."""
        if not len(self.hashes):
            return -1 - hashes
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ranks[at], -1 - hashes)

    @uncollected
    def codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the texts' tokens, ends included, and each text's number of them."""
        words, places, sizes = words_of(texts)
        own = self.code(hashes_of(words))
        sizes = sizes + 1
        out = np.full(int(sizes.sum()), int(self.code(np.array([END]))[0]))
        inner = np.ones(len(out), bool)
        inner[np.cumsum(sizes) - 1] = False
        out[inner] = own[places]
        return out, sizes

    def base_of(self, codes: np.ndarray, rare: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """The base probability of each token. rare: sorted hashes and counts of all others that are known among these;
        without it they share their mass evenly."""
        out = np.full(len(codes), self.rare)
        if rare is not None:
            hashes, counts = rare
            other, c = -1 - codes[codes < 0], np.zeros((codes < 0).sum(), np.int64)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, other), len(hashes) - 1)
                c = np.where(hashes[at] == other, counts[at], 0)
            out[codes < 0] = (c + 1) / (self.tokens + self.types + 1)
        out[codes >= 0] = self.base[codes[codes >= 0]]
        return out

    def parts(self, contexts: np.ndarray, quota: float) -> np.ndarray:
        """Into how many restaurants (as a power of two) each context is split."""
        c = np.zeros(len(contexts))
        c[contexts >= 0] = self.counts[contexts[contexts >= 0]]
        return np.ceil(np.log2(np.maximum(c / quota, 1))).astype(np.int64)


def mixed(codes: np.ndarray, seed: int = 1) -> np.ndarray:
    h = (codes.astype(np.uint64) + np.uint64(seed)) * _MIX
    h ^= h >> np.uint64(32)
    return h * _MIX


def bucket(codes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The first so many bits of a token's hash."""
    return ((mixed(codes, 7) >> np.uint64(32)) >> (np.uint64(32) - bits.astype(np.uint64))).astype(np.int64)


@lru_cache(64)
def log_arrangements(discount: float, most: int) -> np.ndarray:
    """[c, t]: log of the weight of all ways to seat c customers at t tables (generalised Stirling numbers)."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    t = np.arange(1, most + 1)
    with np.errstate(divide="ignore"):
        for c in range(most):
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], out[c, 1:] + np.log(np.maximum(c - discount * t, 0)))
    return out


def contexts_of(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each; a text begins after an end."""
    ends = np.cumsum(sizes)
    u = np.empty_like(codes)
    u[1:] = codes[:-1]
    u[ends - sizes] = codes[ends - 1]
    return u


def shard_of(u: np.ndarray, codes: np.ndarray, vocabulary: Vocabulary, quota: float, shards: int) -> np.ndarray:
    key = mixed(u) ^ mixed(bucket(codes, vocabulary.parts(u, quota)), 3)
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


@lru_cache(8)
def log_shapes(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """(customers, log shapes): for customers in steps of two hundredths up to SHAPED, how the weight of t tables (first column
    one table) goes beside (weight of a table / discount)^t / gamma(t). Worked out by the recursion over customers."""
    steps = np.unique(np.concatenate([np.arange(1, 65), (64 * 1.02 ** np.arange(0, np.log(SHAPED / 64) / np.log(1.02))).astype(np.int64), [SHAPED]]))
    t = np.arange(1, SHAPED_TABLES + 1)
    row, out, at = np.zeros(SHAPED_TABLES), np.empty((len(steps), SHAPED_TABLES), np.float32), 0
    row[0] = 1
    joins = discount * (t[1:] - 1)
    with np.errstate(divide="ignore"):
        for c in range(1, SHAPED + 1):
            if c == steps[at]:
                out[at] = np.log(row)
                at += 1
            stay = row * np.maximum(c - discount * t, 0)
            stay[1:] += row[:-1] * joins
            row = stay / c
    return steps, out


_LOG_FACTORIAL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 1 << 16)))])


def log_gamma(t: np.ndarray) -> np.ndarray:
    """Of whole numbers from 1 on."""
    x = t - 1.0
    return np.where(x < len(_LOG_FACTORIAL), _LOG_FACTORIAL[np.minimum(t - 1, len(_LOG_FACTORIAL) - 1)], x * np.log(np.maximum(x, 1)) - x + 0.5 * np.log(2 * np.pi * np.maximum(x, 1)))


class Seating:
    """The number of tables of each dish; a dish of one customer has one table. One table each at first.

    All seatings of a dish with the same number of tables weigh their arrangements' generalised Stirling number together, so the
    number is all that is kept. A round draws it given the dish's customers: for at most drawn customers from its
    whole distribution, for more by Metropolis steps of several sizes on that distribution.
    """

    def __init__(self, counts: np.ndarray, restaurant: np.ndarray, restaurants: int, rng: np.random.Generator, drawn: int = 0):
        self.rng, self.restaurants, self.drawn, self.restaurant = rng, restaurants, drawn, restaurant
        self._place(counts)
        self.t = np.ones(len(self.at), np.int64)
        self._count()

    def _place(self, counts: np.ndarray) -> None:
        self.counts, self.at = counts, np.nonzero(counts > 1)[0]
        self.c = counts[self.at]
        self.few, self.many = np.nonzero(self.c <= self.drawn)[0], np.nonzero(self.c > self.drawn)[0]

    def _count(self) -> None:
        self.tables = (self.counts > 0).astype(np.int64)
        self.tables[self.at] = self.t
        self.totals = np.bincount(self.restaurant, self.tables, self.restaurants)

    def change(self, counts: np.ndarray) -> None:
        """Goes on with other counts: who is too many leaves; who is new shares a table until the next round."""
        tables = self.tables
        self._place(counts)
        self.t = np.clip(tables[self.at], 1, self.c)
        self._count()

    def round(self, parent: np.ndarray, discount: np.ndarray, strength: np.ndarray) -> None:
        """All customers are seated anew. discount and strength: by restaurant.

        Given a gamma variable for each restaurant its dishes don't depend on each other: a table then weighs discount
        times that variable times its dish's probability in the parent.
        """
        if not len(self.at):
            return
        mass = self.rng.gamma(np.maximum(strength / discount + self.totals, 1e-9))
        r = self.restaurant[self.at]
        d = discount[r]
        weight = np.maximum(d * mass[r] * parent[self.at], 1e-300)
        kinds, kind = np.unique(d, return_inverse=True)
        if len(few := self.few):
            key = kind[few] * (self.drawn + 1) + self.c[few]
            few, key = few[order := np.argsort(key, kind="stable")], key[order]
            for k, own in runs(key):
                c, at = k % (self.drawn + 1), few[own]
                if c == 2:  # one table by 1 - discount, two by the weight
                    self.t[at] = 1 + (self.rng.random(len(at)) * (weight[at] + 1 - kinds[k // (self.drawn + 1)]) < weight[at])
                    continue
                p = log_arrangements(float(kinds[k // (self.drawn + 1)]), self.drawn)[c, 1 : c + 1] + np.log(weight[at])[:, None] * np.arange(1, c + 1)
                p = np.cumsum(np.exp(p - p.max(1, keepdims=True)), axis=1)
                self.t[at] = 1 + (p[:, :-1] < (self.rng.random(len(at)) * p[:, -1])[:, None]).sum(1)
        for k in np.unique(kind[self.many]).tolist():
            at = self.many[kind[self.many] == k]
            self.t[at] = self._moved(self.t[at], self.c[at], float(kinds[k]), np.log(weight[at]))
        self._count()

    def _moved(self, t: np.ndarray, c: np.ndarray, d: float, log_weight: np.ndarray) -> np.ndarray:
        """The numbers of tables after some Metropolis steps."""
        steps, shapes = log_shapes(d)
        row = np.minimum(np.searchsorted(steps, c), len(steps) - 1)
        row -= (row > 0) & (c < SHAPED) & (c - steps[np.maximum(row - 1, 0)] < steps[row] - c)
        scale = np.minimum(1.0, SHAPED / c) ** d  # beyond, the shape is that of as many tables in proportion

        def log_target(t: np.ndarray) -> np.ndarray:
            place = np.maximum(np.rint(t * scale).astype(np.int64), 1)
            shape = np.where(place <= SHAPED_TABLES, shapes[row, np.minimum(place, SHAPED_TABLES) - 1], -np.inf)
            return shape + t * (log_weight - np.log(d)) - log_gamma(t)

        now = log_target(t)
        for size in MOVES:
            other = t + self.rng.integers(1, size + 1, len(t)) * self.rng.choice((-1, 1), len(t))
            inside = (other >= 1) & (other <= c)
            there = log_target(np.where(inside, other, t))
            go = inside & (np.log(self.rng.random(len(t))) < there - now)
            t, now = np.where(go, other, t), np.where(go, there, now)
        return t


def best(grid: list[tuple[float, float]], likelihood, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """The (discount, strength) of the grid with the greatest likelihood, for each band."""
    scores = np.array([likelihood(d, s) for d, s in grid])
    chosen = scores.argmax(0)
    return np.array([grid[i][0] for i in chosen]), np.array([grid[i][1] for i in chosen])


def shard_probabilities(u: np.ndarray, w: np.ndarray, train: np.ndarray, vocabulary: Vocabulary, quota: float, seed: int, rare: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The averaged predictive probability of each occurrence (context code u, token code w) of one shard."""
    rng = np.random.default_rng(seed)
    contexts, u = np.unique(u, return_inverse=True)
    dishes, w = np.unique(w, return_inverse=True)
    bits = vocabulary.parts(contexts, quota)
    part = bucket(dishes[w], bits[u])
    keys, restaurant = np.unique((u << 31) | part, return_inverse=True)
    of_context, of_part = keys >> 31, keys & 0x7FFFFFFF
    pairs, occurrence = np.unique((restaurant << 32) | w, return_inverse=True)
    del u, w, part, restaurant
    r, dish = pairs >> 32, pairs & 0xFFFFFFFF
    c = np.bincount(occurrence, train, len(pairs)).astype(np.int64)
    n_r = len(keys)
    c_r, kinds = np.bincount(r, c, n_r), np.bincount(r, c > 0, n_r)
    base = vocabulary.base_of(dishes, rare)
    # the base's share of each part of the token space, for contexts that are split
    share = np.ones(n_r)
    for b in np.unique(bits[bits > 0]):
        frequent = np.arange(len(vocabulary.base))
        mass = np.bincount(bucket(frequent, np.full(len(frequent), b)), vocabulary.base, 1 << b) + vocabulary.rare_mass / (1 << b)
        split = bits[of_context] == b
        share[split] = mass[of_part[split]]
    # hyperparameters by leave-one-out likelihood
    band = np.minimum(np.log2(np.maximum(c_r, 1)) // 2, 9).astype(np.int64)
    trained = np.nonzero(c > 0)[0]
    rc, rr = c[trained], r[trained]
    less, tables = c_r[rr] - 1, kinds[rr] - (rc == 1)
    low = base[dish[trained]] / share[rr]

    def of_contexts(d: float, s: float) -> np.ndarray:
        p = (np.maximum(rc - 1 - d, 0) + (s + d * tables) * low) / (s + less)
        return np.bincount(band[rr], rc * np.log(np.maximum(p, 1e-300)), 10)

    discount, strength = (x[band] for x in best([(d, s) for d in DISCOUNTS for s in STRENGTHS], of_contexts, 10))
    n_w = len(dishes)
    seats, upper = Seating(c, r, n_r, rng, DRAWN), None
    lower = np.nonzero(np.bincount(dish, c, n_w) > 0)[0]
    parent, parent_share, out = base.copy(), share.copy(), np.zeros(len(pairs))
    one = np.zeros(n_w, np.int64)
    for sample in range(BURN_IN + SAMPLES):
        for _ in range(ROUNDS):
            seats.round(parent[dish] / parent_share[r], discount, strength)
        totals = seats.totals
        # the parent restaurant: its customers are the tables
        customers = np.bincount(dish, seats.tables, n_w).astype(np.int64)
        whole, served = int(customers.sum()), int((customers > 0).sum())
        if whole:
            k, kb = customers[lower], base[lower]

            def of_parent(d: float, s: float, k=k, kb=kb, whole=whole, served=served) -> np.ndarray:
                p = (np.maximum(k - 1 - d, 0) + (s + d * (served - (k == 1))) * kb) / (s + whole - 1)
                return np.array([(k * np.log(np.maximum(p, 1e-300))).sum()])

            if sample == 0:
                d1, s1 = best([(d, s) for d in DISCOUNTS for s in PARENT_STRENGTHS], of_parent, 1)
            if upper is None:
                upper = Seating(customers, one, 1, rng, DRAWN)
            else:
                upper.change(customers)
            for _ in range(ROUNDS):
                upper.round(base, d1, s1)
            rest = (s1[0] + d1[0] * upper.totals[0]) / (s1[0] + whole)
            own = np.maximum(customers - d1[0] * upper.tables, 0) / (s1[0] + whole)
            parent = own + rest * base
            parent_share = np.ones(n_r)
            for b in np.unique(bits[bits > 0]):
                mass = np.bincount(bucket(dishes, np.full(n_w, b)), own, 1 << b)
                split = bits[of_context] == b
                parent_share[split] = mass[of_part[split]] + rest * share[split]
        if sample >= BURN_IN:
            below = strength + c_r
            own = np.maximum(c - discount[r] * seats.tables, 0) / below[r]
            out += (own + ((strength + discount * totals) / below)[r] * parent[dish] / parent_share[r]) / SAMPLES
    # a split context's part is chosen first, by the customers there
    split = bits[of_context] > 0
    if split.any():
        of_u = vocabulary.counts[contexts[of_context[split]]]
        weight = np.ones(n_r)
        weight[split] = (c_r[split] + 16 * share[split]) / (of_u + 16)
        out *= weight[r]
    return out[occurrence]


def scores(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every text.

    training is a condition on docs' columns: the texts to learn from. Tokens are words between white space, A-Z in lower
    case, and one end. base_score and n_known go by exact counts. Null and empty texts and texts of white space are the end
    alone. Without training texts every token is unknown. Repeated rows and rows with the same or a null id each have their
    row. An empty table gives an empty result. Columns other than the id's, the text's and training's are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    counts = written(training_counts(rows.where("train"), "text"), "token-counts")
    by_size = counts.groupBy(F.floor(F.log2("c") * 8).alias("size")).agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.min("c").alias("least")).orderBy(F.desc("size")).collect()
    tokens, types = sum(x.c for x in by_size), sum(x.n for x in by_size)
    least, room = None, FREQUENT
    for x in by_size:
        room -= x.n
        if room < 0:
            break
        least = x.least
    top = counts.where(F.col("c") >= (least or 1 << 62)).toPandas()
    vocabulary = Vocabulary(top.h.to_numpy(np.int64), top.c.to_numpy(np.int64), tokens, types)
    shards = max(16, -(-tokens // SHARD_TOKENS))
    quota = max(1000.0, tokens / shards / 8)
    shared = spark.sparkContext.broadcast(vocabulary)
    log_whole = float(np.log10(tokens + types + 1))

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in slices(batches, 1000):
            ids, texts = batch.column(0).cast(pa.int64()), strings(batch.column(1))
            codes, sizes = v.codes(texts)
            text = np.repeat(np.arange(len(texts)), sizes)
            often = codes >= 0
            known = np.bincount(text[often], minlength=len(texts))
            base = np.bincount(text[often], np.log10(v.counts[codes[often]] + 1) - log_whole, len(texts)) - 0.0
            twin = np.fromiter(map(xxhash.xxh32_intdigest, texts.cast(pa.binary()).to_pylist()), np.int64, len(texts))
            of, h, at = text[~often], -1 - codes[~often], shard_of(contexts_of(codes, sizes)[~often], codes[~often], v, quota, shards)
            order = np.lexsort((at, h, of))
            of, h, at = of[order], h[order], at[order]
            first = np.nonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (h[1:] != h[:-1]) | (at[1:] != at[:-1])]))[0] if len(h) else np.zeros(0, np.int64)
            times, of, h, at = np.diff(np.append(first, len(h))), of[first], h[first], at[first]
            rare = pa.array(of)
            n, m = len(texts), len(times)
            columns = [
                pa.concat_arrays([ids.cast(pa.int64()), ids.cast(pa.int64()).take(rare)]), pa.array(np.append(twin, twin[of])),
                pa.array(np.append(mixed(twin * 31 + np.arange(n)).view(np.int64), h)), pa.array(np.append(np.ones(n, np.int64), np.zeros(m, np.int64))),
                pa.array(np.append(sizes, times)), pa.array(np.append(known, np.zeros(m, np.int64))), pa.array(np.append(base, np.zeros(m))),
                pa.array(np.append(np.full(n, -1), at), pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "twin", "h", "doc", "n", "known", "base", "shard"])

    rare = counts.where(F.col("c") < (least or 1 << 62))
    parts = rows.select("id", "text").mapInArrow(plain, "id long, twin long, h long, doc long, n long, known long, base double, shard int")
    met = parts.join(rare, "h", "left").withColumn("c", F.when(F.col("doc") == 0, F.coalesce("c", F.lit(0))))
    met = written(met, "token-parts")
    plainly = met.groupBy("id", "twin").agg(
        F.sum("doc").alias("same"),
        F.sum(F.when(F.col("doc") == 1, F.col("n"))).alias("n_tokens"),
        F.sum(F.when(F.col("doc") == 1, F.col("known")).when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.when(F.col("doc") == 1, F.col("base")).otherwise(F.col("n") * (F.log10(F.col("c") + 1) - log_whole))).alias("base_score"),
    )

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, held, size = shared.value, [], 0
        sender = TaskContext.get().partitionId() << 24

        def flush() -> pa.RecordBatch:
            ids, twins, trains, sizes, codes = (np.concatenate(x) for x in zip(*held, strict=True))
            u = contexts_of(codes, sizes)
            doc = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
            shard = shard_of(u, codes, v, quota, shards)
            order = np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")
            rows = []
            for s, own in runs(shard[order]):
                span = order[own]
                own = doc[span]  # in order
                fresh = np.concatenate([[True], own[1:] != own[:-1]])
                which, local = own[fresh], np.cumsum(fresh) - 1
                rows.append((s, sender, pack(ids[which]), pack(twins[which].astype(np.uint32)), pack(trains[which].astype(np.uint8)), pack(np.diff(local, prepend=0).astype(np.uint16)), pack(u[span]), pack(codes[span])))
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64())] + [pa.array(c, pa.binary()) for c in cols[2:]], ["shard", "sender", "ids", "twins", "trains", "docs", "contexts", "tokens"])

        for batch in slices(batches, 1000):
            ids, texts = batch.column(0).cast(pa.int64()), strings(batch.column(1))
            codes, sizes = v.codes(texts)
            twin = np.fromiter(map(xxhash.xxh32_intdigest, texts.cast(pa.binary()).to_pylist()), np.int64, len(texts))
            held.append((ids.fill_null(np.iinfo(np.int64).min).to_numpy(), twin, batch.column(2).to_numpy(zero_copy_only=False), sizes, codes))
            size += len(codes)
            if size > 2_000_000 or len(held) >= 60:
                yield flush()
                held.clear()
                size = 0
                sender += 1
        if held:
            yield flush()

    @uncollected
    def seated(key: tuple, table: pa.Table, there: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"sender": pa.array([], pa.int64())} | {k: pa.array([], pa.binary()) for k in ("ids", "twins", "parts")})
        hashes, first = np.unique(there.column("h").to_numpy(), return_index=True)
        rare = hashes, there.column("c").to_numpy()[first]

        def each(name: str, kind: str) -> list[np.ndarray]:
            return [unpack(x, kind) for x in table.column(name).to_pylist()]

        ids = each("ids", "<i8")
        ahead = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        doc = np.concatenate([np.cumsum(x, dtype=np.int64) + a for x, a in zip(each("docs", "<u2"), ahead, strict=False)])
        trains = np.concatenate(each("trains", "u1"))
        u, w = np.concatenate(each("contexts", "<i8")), np.concatenate(each("tokens", "<i8"))
        # sampled over the sorted counts, so the order in which blocks came doesn't matter
        p, parent = np.empty(len(u)), ((mixed(u, 11) >> np.uint64(32)) % np.uint64(PARENTS)).astype(np.uint8)
        for n in range(PARENTS):
            own = np.nonzero(parent == n)[0]
            if len(own):
                p[own] = shard_probabilities(u[own], w[own], trains[doc[own]].astype(bool), shared.value, quota, key[0].as_py() * PARENTS + n, rare)
        sums = np.bincount(doc, np.log10(p), int(ahead[-1]))
        parts = [pack(sums[a:b]) for a, b in zip(ahead[:-1], ahead[1:], strict=True)]
        return pa.table({"sender": table.column("sender"), "ids": table.column("ids"), "twins": table.column("twins"), "parts": pa.array(parts, pa.binary())})

    def summed(table: pa.Table) -> pa.Table:
        ids, twins, parts = (np.concatenate([unpack(x, kind) for x in table.column(k).to_pylist()]) for k, kind in (("ids", "<i8"), ("twins", "<u4"), ("parts", "<f8")))
        order = np.lexsort((parts, twins, ids))
        ids, twins, parts = ids[order], twins[order].astype(np.int64), parts[order]
        first = np.nonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (twins[1:] != twins[:-1])]))[0]
        own = ids[first]
        return pa.table({"id": pa.array(own, mask=own == np.iinfo(np.int64).min), "twin": pa.array(twins[first]), "part": pa.array(np.add.reduceat(parts, first))})

    blocks = rows.mapInArrow(sent, "shard int, sender long, ids binary, twins binary, trains binary, docs binary, contexts binary, tokens binary")
    needed = met.where("doc = 0 and c > 0").select("shard", "h", "c")
    parts_of = blocks.groupBy("shard").cogroup(needed.groupBy("shard")).applyInArrow(lambda key, table, there: seated(key, table, there), "sender long, ids binary, twins binary, parts binary")
    modelled = parts_of.groupBy("sender").applyInArrow(summed, "id long, twin long, part double").groupBy("id", "twin").agg(F.sum("part").alias("score"))
    both = plainly.alias("a").join(modelled.alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.twin") == F.col("b.twin")))
    one = lambda c: (F.col(c) / F.col("same")).alias(c)  # noqa: E731  rows that are wholly the same were summed
    whole = lambda c: F.expr(f"{c} div same").alias(c)
    return both.select(F.col("a.id").alias("id"), "same", whole("n_tokens"), whole("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), one("base_score"), one("score")).withColumn(
        "same", F.explode(F.sequence(F.lit(1), F.col("same").cast("int")))
    ).drop("same")
