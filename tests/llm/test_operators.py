"""Each operator against a brute-force version, on texts that hold the awkward cases."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronolake.llm import byte_bpe, common, embeddings, hamming, language_model, packing, quality, simhash, suffixes, toxicity, url_trust

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, fp long, id long, score double, batch string, label int"


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(7)
    words = ["the", "of", "Wort", "été,", "niño", "x" * 40, "it's", "don't!", "日本", "a b", "12", "3.5", "|", "İ", "Σας"]
    prose = lambda n: " ".join(rng.choice(words) + (str(rng.randrange(50)) if rng.random() < 0.5 else "") for _ in range(n))
    base = [prose(n) for n in (1, 2, 3, 8, 40, 120, 400)]
    passage = prose(60)
    out = base + [base[5], base[5] + " end", passage, "before " + passage + " after", passage + passage, "ab " * 100, "", " \t\n ", "a", "A\n \nb  c   d\n\n e ", " lead", "trail ", prose(9000), "　wide space   x", "<|endoftext|> y"]
    rows: list[tuple[int | None, str | None]] = [(i, t) for i, t in enumerate(out)]
    return rows + [(100, None), (101, passage), (101, passage), (None, base[4]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, 2, 0.5, "z", 1) for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_bytes(t: str | None) -> bytes:
    return (t or "").encode()


def test_byte_bpe(docs, empty):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_BPE, "rb"))}
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted(map(tuple, byte_bpe.encoded(docs, BYTE_BPE, public_tokenizers.PATTERN).collect()), key=repr)
    want = [(i, len(ids := whole.encode_ordinary(t or "")), bytearray(" ".join(map(str, ids)).encode()), bytearray(as_bytes(t))) for i, t in texts()]
    assert got == sorted(want, key=repr)
    assert byte_bpe.encoded(empty, BYTE_BPE, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_by_several_senders_and_decoded(spark, docs, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SENDER_BYTES", 300)
    monkeypatch.setattr(byte_bpe, "CHUNK", 3)
    monkeypatch.setattr(byte_bpe, "LONG_WORD", 6)
    ids = byte_bpe.encoded(docs, BYTE_BPE, public_tokenizers.PATTERN).select("decoded", F.expr("case when n_tokens > 0 then transform(split(cast(ids as string), ' '), x -> cast(x as bigint)) else cast(array() as array<bigint>) end").alias("ids"))
    again = byte_bpe.decoded(ids.withColumnRenamed("decoded", "was"), BYTE_BPE)
    assert again.where("decoded <> was").count() == 0


def test_byte_bpe_long_words():
    ranks = byte_bpe.read_ranks(BYTE_BPE)
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeinrst", k=n)) for n in (1, 2, 3, 50, 500, 40_000)] + ["ab" * 300, "a" * 777, "\u4e2d\u6587" * 2_000]
    for w in words:
        assert byte_bpe.heap_fold(w.encode(), ranks) == whole.encode_ordinary(w)


def test_byte_bpe_units():
    import pyarrow as pa
    import regex

    cutter, find = byte_bpe.Cutter(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN).findall
    rng = random.Random(5)
    texts = ["".join(rng.choices(["a", "B", "1", ".", "'s", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\u00e9", "\x1c", "\x85", "\u200b"], k=rng.randrange(12))) for _ in range(3_000)]
    offsets, units, words, counts = cutter.units(pa.array(texts))
    ends = np.cumsum(counts)
    own = [words[e - n : e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
    for i, t in enumerate(texts):
        assert [w for u in units[offsets[i] : offsets[i + 1]].tolist() for w in own[u]] == find(t), repr(t)


def test_language_model(docs, empty):
    got = language_model.scores(docs, F.col("doc_id") % 3 != 0).collect()
    train, rows = Counter(), texts()
    for i, t in rows:
        if i is not None and i % 3 != 0:
            train.update(as_bytes(t).lower().split())
            train["end"] += 1
    n, v = sum(train.values()), len(train)
    want = Counter()
    for i, t in rows:
        tokens = as_bytes(t).lower().split() + ["end"]
        want[i, len(tokens), sum(train[w] > 0 for w in tokens), n, round(sum(np.log10((train[w] + 1) / (n + v + 1)) for w in tokens), 6)] += 1
    assert Counter((r.id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert language_model.scores(empty, F.col("doc_id") > 0).count() == 0


def test_language_model_is_a_distribution():
    rng = np.random.default_rng(3)
    counts = np.sort(rng.integers(1, 30, 50))[::-1]
    hashes = rng.permutation(10_000)[:50].astype(np.int64)
    v = language_model.Vocabulary(hashes[:40], counts[:40], int(counts.sum()), 50)
    codes = np.concatenate([np.arange(40), -1 - hashes[40:], [-1 - 20_000]])  # frequent ones, rare ones, one that is unknown
    assert np.isclose(v.base_of(codes).sum(), 1)
    u, w = rng.choice(codes, 3000), rng.choice(codes, 3000)
    train = rng.random(3000) < 0.8
    v.counts = np.array([np.sum(train & (u == c)) for c in range(40)])  # contexts are as often followed as they are there
    every = np.arange(len(codes))
    for quota, close in ((1e9, 1e-9), (5, 0.02)):  # whole contexts; split ones, where rare tokens count as evenly spread
        for c in (0, 20, -1 - hashes[45]):
            p = language_model.shard_probabilities(np.append(u, np.full(len(codes), c)), np.append(w, codes[every]), np.append(train, np.zeros(len(codes), bool)), v, quota, 1)
            assert np.isclose(p[-len(codes) :].sum(), 1, atol=close)


def test_seating_keeps_its_counts():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 9, 200)
    s = language_model.Seating(counts, rng.integers(0, 5, 200), 5, rng)
    for _ in range(60):
        s.round(np.full(200, 0.02), np.full(5, 0.7), np.full(5, 2.0))
        assert ((s.t >= 1) & (s.t <= s.c)).all()
        assert (s.totals == np.bincount(s.restaurant, s.tables, 5)).all()
    assert s.t.max() > 1


def test_language_model_keeps_the_base_of_rare_tokens(docs, monkeypatch):
    v = language_model.Vocabulary(np.array([5, 9]), np.array([8, 7]), 20, 4)
    codes, rare = np.array([0, 1, -1 - 3, -1 - 4, -1 - 6]), (np.array([3, 6]), np.array([2, 3]))  # 4 is unknown
    want = np.array([9, 8, 3, 1, 4]) / 25
    assert np.allclose(v.base_of(codes, rare), want)
    p = language_model.shard_probabilities(np.full(5, -1 - 77), codes, np.zeros(5, bool), v, 1e9, 1, rare)  # an unseen context
    assert np.allclose(p, want)
    whole = {(r.id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in language_model.scores(docs, F.col("doc_id") % 3 != 0).collect()}
    monkeypatch.setattr(language_model, "FREQUENT", 5)
    few = language_model.scores(docs, F.col("doc_id") % 3 != 0).collect()
    assert {(r.id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in few} == whole and all(np.isfinite(r.score) for r in few)


def test_hyperparameters_go_by_all_pairs(monkeypatch):
    seen, real = [], language_model.best
    monkeypatch.setattr(language_model, "best", lambda grid, likelihood, bands: (seen.append(likelihood(0.5, 2.0).sum()), real(grid, likelihood, bands))[1])
    u, w = (x.ravel() for x in np.meshgrid(-1 - np.arange(1000), -10_001 - np.arange(250)))
    v = language_model.Vocabulary(np.zeros(0, np.int64), np.zeros(0, np.int64), len(u), 250)
    language_model.shard_probabilities(u, w, np.ones(len(u), bool), v, 1e9, 1)
    assert np.isclose(seen[0], len(u) * np.log((2 + 0.5 * 249) * v.rare / (2 + 249)))  # each context has 250 tokens once


@pytest.mark.parametrize("drawn", [0, 64])
def test_seating_visits_all_customers(drawn):
    """The number of tables of a frequent dish against its exact distribution, by counts and by seats."""
    rng = np.random.default_rng(2)
    d, strength, p, c = 0.7, 20.0, 0.3, 60
    s = language_model.Seating(np.array([c]), np.zeros(1, np.int64), 1, rng, drawn)
    stirling = [[1.0]]
    for n in range(c):  # weights in floats, by the recursion
        row = stirling[-1] + [0.0]
        stirling.append([(row[t - 1] if t else 0.0) + (row[t] * (n - d * t) if t <= n else 0.0) for t in range(n + 2)])
    w = np.array([np.log(stirling[c][t]) + t * np.log(p) + np.log(strength + d * np.arange(1, t)).sum() for t in range(1, c + 1)])
    w = np.exp(w - w.max())
    want = (w * np.arange(1, c + 1)).sum() / w.sum()
    seen = []
    for _ in range(800):
        s.round(np.full(1, p), np.full(1, d), np.full(1, strength))
        seen.append(s.t[0])
    assert seen[0] > 2  # with one moved customer a round there were two tables at most
    assert abs(np.mean(seen[100:]) - want) < 0.05 * want


def test_seating_of_very_frequent_dishes():
    """Moves against the exact distribution, for counts that lie between the steps of the table of weights."""
    rng = np.random.default_rng(8)
    for d, w, c in ((0.5, 30.0, 3_333), (0.85, 300.0, 2_222)):
        row = np.zeros(2_000)  # weights by the recursion, each row scaled
        row[0], t = 1, np.arange(1, 2_001)
        logs = 0.0
        for n in range(1, c):
            new = row * np.maximum(n - d * t, 0)
            new[1:] += row[:-1] * w
            logs, row = logs + np.log(new.max()), new / new.max()
        want = (row * t).sum() / row.sum()
        s = language_model.Seating(np.array([c]), np.zeros(1, np.int64), 1, rng, 64)
        got, now = [], s.t
        for _ in range(600):
            now = s._moved(now, s.c, d, np.log(np.array([w])))
            got.append(now[0])
        assert abs(np.mean(got[100:]) - want) < 0.04 * want


def test_seating_goes_on_with_other_counts():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 200, 100)
    s = language_model.Seating(counts, np.zeros(100, np.int64), 1, rng, 64)
    for _ in range(10):
        s.round(np.full(100, 0.01), np.full(1, 0.7), np.full(1, 50.0))
        before, was = s.tables.copy(), counts
        counts = np.maximum(was + rng.integers(-9, 10, 100), 0)
        s.change(counts)
        assert ((s.tables <= counts) & ((s.tables > 0) == (counts > 0))).all() and s.totals[0] == s.tables.sum()
        assert abs(s.tables.sum() - before.sum()) < 0.2 * before.sum()
    assert s.tables.max() > 1


def test_packing(docs, empty, monkeypatch):
    pieces = packing.pack(docs, WORD_BPE, shard_docs=7).toPandas()
    whole = Tokenizer.from_file(WORD_BPE)
    want = Counter((-1 if i is None else i, tuple(whole.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in texts())
    by_crc = {}
    for (i, ids), _ in want.items():
        for s in range(len(ids)):
            by_crc.setdefault((i, len(ids)), []).append(np.array(ids, "<u4"))
            break
    covered = Counter()
    for r in pieces.fillna({"doc_id": -1}).itertuples():
        fits = [x for x in by_crc[int(r.doc_id), r.doc_tokens] if zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32]
        assert fits
        covered[int(r.doc_id), r.doc_tokens] += r.length
    assert covered == Counter({(i, len(ids)): 0 for i, ids in want}) + Counter([x for (i, ids), n in want.items() for x in [(i, len(ids))] * (len(ids) * n)])
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        ends = g.offset + g.length
        assert g.offset.tolist() == [0, *ends.tolist()[:-1]]
        total = int(ends.iloc[-1])
        assert total == 2048 or total & (total - 1) == 0
    assert packing.pack(empty, WORD_BPE).count() == 0


def test_packing_puts_neighbours_together():
    rng = np.random.default_rng(5)
    topics = [rng.integers(1000 * k, 1000 * k + 300, 400) for k in range(1, 9)]
    documents = [rng.permutation(topics[k % 8])[:200].astype("<u2") for k in range(64)]
    shard = packing.Shard(documents, np.full(1 << 16, 2.0), 200.0)
    assert {next(shard.neighbours(0)) % 8} == {0}


def test_packing_scores_with_all_terms():
    idf = np.full(1 << 16, 3.0)
    idf[100:] = 1.0
    seed, light = np.arange(60, 160, dtype="<u2"), np.arange(150, 160, dtype="<u2")  # 40 heavy terms, 60 light ones
    rng = np.random.default_rng(7)
    documents = [seed, light, np.array([60, 61], "<u2"), np.array([9], "<u2")] + [rng.integers(50, 200, 30).astype("<u2") for _ in range(40)]
    mean = float(np.mean([len(x) for x in documents]))
    shard = packing.Shard(documents, idf, mean)

    def score(d: np.ndarray) -> float:
        norm = packing.K1 * (1 - packing.B + packing.B * len(d) / mean)
        return sum(idf[t] * (d == t).sum() * (packing.K1 + 1) / ((d == t).sum() + norm) for t in np.unique(seed))

    shard.unused[0] = False
    for used in (0, 5, 30, 38):  # postings are also right once used documents are taken out of them
        shard.unused[4 : 4 + used] = False
        left = [d for d in range(1, len(documents)) if shard.unused[d]]
        want = sorted((d for d in left if score(documents[d]) > 0), key=lambda d: (-round(score(documents[d]), 9), d))
        got = list(shard.neighbours(0))
        assert 1 in got and 3 not in got and got == want


def test_least_key_is_that_of_all_shared_keys():
    """Of all buckets that two texts share, exactly one tells of the pair."""
    rng = np.random.default_rng(3)
    words = rng.integers(0, 12, (40, 3, 4)).astype(np.int16)
    rows, keys = simhash.doubtful_keys(words)
    own = [set(keys[rows == n].tolist()) for n in range(40)]
    i, j = np.triu_indices(40, 1)
    want = [min(own[a] & own[b], default=-1) for a, b in zip(i, j, strict=True)]
    assert simhash.least_key(words[i], words[j]).tolist() == want and -1 in want


@pytest.mark.parametrize("groups", [1, 3, 200])
def test_pairs_across_groups_of_a_large_bucket(groups):
    rng = np.random.default_rng(groups)
    n = 300
    node, group = rng.permutation(n).astype(np.int64), rng.integers(0, groups, n)
    fps = rng.integers(0, 1 << 20, n).astype(np.uint64)
    words = rng.integers(0, 1 << 10, (2, n)).astype(np.uint64)
    marks = (fps, rng.integers(80, 120, n).astype(np.float64), words[0], words[1])
    i, j = np.triu_indices(n, 1)
    near = simhash.near_enough(tuple(m[i] for m in marks), tuple(m[j] for m in marks), 0.8) & (group[i] != group[j])
    want = {frozenset(x) for x in zip(i[near].tolist(), j[near].tolist(), strict=True)}
    got = [frozenset(x) for a, b in simhash.pairs_across(node, group, marks, 0.8) for x in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want and (groups == 1 or want)
    found = simhash.partners(np.zeros(n, np.int64), node, group, marks, 0.8)
    place = {int(v): k for k, v in enumerate(node)}
    linked = found[found[:, 0] != found[:, 2]]
    assert set(found[found[:, 0] == found[:, 2], 0].tolist()) == set(range(n))  # all of a large bucket are looked at again
    assert all(frozenset((place[a], place[b])) in want for a, _, b in linked.tolist())


@pytest.mark.parametrize("paired", [64, 3])
def test_similar_texts(spark, empty, monkeypatch, paired):
    """Groups by five-word shingles against brute force: nothing joined that isn't similar, next to nothing lost."""
    monkeypatch.setattr(simhash, "PAIRED_BUCKET", paired)
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(3000)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    made = []
    for _ in range(60):
        words = prose(rng.randrange(60, 400))
        made.append(words)
        for _ in range(rng.choice((0, 0, 1, 5))):  # near copies, some too far
            copy = list(words)
            for _ in range(rng.randrange(0, max(2, len(words) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            made.append(copy)
    rows = [(i, " ".join(w)) for i, w in enumerate(made)] + [(900, ""), (901, None), (902, " \n"), (903, "one two"), (904, "One  two"), (None, " ".join(made[0])), (3, " ".join(made[3]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("fp", F.lit(2)).repartition(3)
    got = {r.id: r.component_id for r in simhash.similar_texts(docs).collect() if r.id is not None}
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []) for i, t in rows if i is not None and (w := (t or "").lower().split()) is not None}
    group = {i: i for i in sets}

    def root(i: int) -> int:
        while group[i] != i:
            i = group[i]
        return i

    linked = 0
    for i in sets:
        for j in sets:
            if j < i and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                linked += 1
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    want = {i: root(i) for i in sets}
    assert linked > 50 and all(want[i] == want[c] for i, c in got.items())
    assert sum(got[i] == want[i] for i in sets) >= 0.98 * len(sets)
    assert got[902] == got[901] == 900 and got[904] == 903
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None} | {i for i, c in got.items() if i == c}
    assert simhash.similar_texts(empty).count() == 0


def test_quality_and_toxicity(spark, empty):
    rng = random.Random(2)
    common_words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(common_words) for _ in range(rng.randrange(20, 90))]
        bad, rude = rng.random() < 0.2, rng.random() < 0.3
        if rude:
            words[rng.randrange(len(words))] = rng.choice(["zgrobian", "zgrobe", "zgrobst"]) + rng.choice(["", "ly", "ness"])
        ends = [w + ("." if rng.random() < 0.1 else "") for w in words]
        rows.append((i, " ".join(w.upper() + "!!" for w in ends) if bad else " ".join(ends)))
        labels.append((i, int(not bad), int(rude)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = common.fold_of("doc_id", 4) == 2
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        model = module.train(docs, marks, ~held, label)
        scored = module.score(docs, model).withColumnRenamed("id", "doc_id").join(marks, "doc_id").where(held)
        right = scored.select(F.avg(((F.col("score") >= module.THRESHOLD).cast("int") == F.col(label)).cast("double"))).first()[0]
        assert right > 0.93, label
        odd = docs.unionByName(spark.createDataFrame([(None, None), (5000, ""), (5000, "")], "doc_id long, text string"))
        assert module.score(odd, model).count() == 903 and module.score(empty, model).count() == 0
        assert module.accepted(odd, model).columns == odd.columns
    model = toxicity.train(docs, marks, ~held)
    found = toxicity.offending_sentences(docs, model).collect()
    assert len(found) > 150 and sum("zgrob" in r.words for r in found) > 0.7 * len(found)


def test_no_labels_leaves_everything_scored(spark, docs):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.train(docs, marks, F.lit(True))).where("score is null").count() == 0


def brute_fingerprint(t: str | None) -> int:
    words = as_bytes(t).lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n: int, linked) -> list[int]:
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            low = min(root[i], root[j])
            if root[i] != low or root[j] != low:
                root[i] = root[j] = low
                changed = True
    return root


def test_simhash(docs, empty):
    rows = [(i, t) for i, t in texts()]
    got = Counter((r.id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    fps = [brute_fingerprint(t) for _, t in rows]
    known = [k for k, (i, _) in enumerate(rows) if i is not None]
    root = components(len(rows), [(a, b) for a in known for b in known if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    least = defaultdict(lambda: 10**9)
    for k in known:
        least[root[k]] = min(least[root[k]], rows[k][0])
    assert got == Counter((i, fp, None if i is None else least[root[k]]) for k, ((i, _), fp) in enumerate(zip(rows, fps, strict=True)))
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_first(docs).columns == docs.columns


@pytest.mark.parametrize("small", [512, 1])
def test_golay_keys_lose_no_link(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 1 << 63, 60, np.uint64)
    for _ in range(6):  # chains of small steps, and dense groups
        flips = [np.uint64(1) << rng.integers(0, 64, len(fps[:200]), np.uint64) for _ in range(2)]
        fps = np.unique(np.concatenate([fps, fps[:200] ^ flips[0] ^ np.where(rng.random(len(flips[0])) < 0.5, flips[1], np.uint64(0))]))
    reps = spark.createDataFrame([(i, int(x)) for i, x in enumerate(fps.view(np.int64))], "node long, fp long")
    got = {(r.b, r.a) for r in simhash.links(reps, 4).collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)}


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (7, 7), (2000, 1500), (1500, 1800), (301, 305)]
    got = dict(common.connected_components(spark.createDataFrame(edges, "a long, b long")).distinct().collect())
    assert {got[i] for i in range(301)} == {0} and got[1001] == 1000 and got[2000] == got[1800] == 1500 and got[305] == 301


@pytest.mark.parametrize("n", [0, 1, 40, 400])
def test_components_in_one_task(spark, n):
    """Few edges are joined up in one task, with the result of the steps over the cluster, and without their many jobs."""
    rng = random.Random(n)
    edges = [(rng.randrange(300) * 10**12, rng.randrange(300) * 10**12) for _ in range(n)] + [(i, i + 1) for i in range(min(n, 60))]
    given = spark.createDataFrame(edges, "a long, b long")
    want = common.connected_components(given).distinct().collect()
    spark.sparkContext.setJobGroup(f"alone-{n}", "")
    got = common.connected_components(given, alone=1000).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"alone-{n}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(got) == sorted(want) and jobs <= 12
    assert sorted(common.connected_components(given, alone=max(0, n - 1)).distinct().collect()) == sorted(want)


def test_repeats_are_cut_out_by_one_python_process_a_task(spark, docs):
    """No second process beside that of the spans; an executor would keep both for the tasks that follow."""
    plan = suffixes.without_repeats(docs)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "ArrowEvalPython" not in plan


def brute_repeats(rows, length=50):
    first: dict[bytes, int] = {}
    for i, t in rows:
        s = as_bytes(t)
        for at in range(len(s) - length + 1) if i is not None else ():
            first[s[at : at + length]] = min(i, first.get(s[at : at + length], i))
    out = Counter()
    for i, t in rows:
        s = as_bytes(t)
        gone = np.zeros(len(s) + 1, bool)
        for at in range(len(s) - length + 1) if i is not None else ():
            if first[s[at : at + length]] < i:
                gone[at : at + length] = True
        kept = bytes(np.frombuffer(s, np.uint8)[~gone[: len(s)]])
        out[i, len(s), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot, piece", [(20_000, 1 << 18), (1, 1 << 18), (20_000, 70)])
def test_suffixes(docs, empty, monkeypatch, hot, piece):
    monkeypatch.setattr(suffixes, "HOT_DOCS", hot)
    monkeypatch.setattr(suffixes, "PIECE", piece)
    found = suffixes.repeated_spans(docs).select("id", F.octet_length("text"), "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, found)) == brute_repeats(texts())
    assert suffixes.repeated_spans(empty).count() == 0


def test_suffixes_keep_other_columns(docs):
    out = suffixes.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count() and out.where("fp = 1 and score = 0.5 and batch = 'z'").count() == docs.count()


def test_merge_sort_and_collisions():
    rng = np.random.default_rng(8)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    ext = suffixes.Extensions(data, 50)
    starts, segment = rng.integers(0, 3900, 900), np.sort(rng.integers(0, 12, 900))
    order = suffixes.merge_sort(starts, segment, ext)
    for s in range(12):
        at = np.nonzero(segment == s)[0]
        got = [data[x : x + 50].tobytes() for x in starts[order[at]]]
        assert got == sorted(data[x : x + 50].tobytes() for x in starts[at])
    ext.hashes = lambda start, size: np.zeros(len(start), np.uint64)  # everything collides: bytes decide
    begin, size = np.arange(40) * 74, np.full(40, 74)
    out = np.full((40, 25), np.iinfo(np.int64).max)
    there = np.ones((40, 25), bool)
    suffixes._sort_part(there, np.zeros(40, np.int64), begin, np.full(40, 24), np.arange(40), ext, out)
    for off in range(25):
        strings = [data[b + 24 - off : b + 74 - off].tobytes() for b in begin]
        assert out[:, off].tolist() == [strings.index(x) for x in strings]
    assert size.sum() < len(data)


def test_anchors_agree_across_texts():
    rng = random.Random(1)
    shared = bytes(rng.choice(b"abc ") for _ in range(50))
    for _ in range(30):
        a, b = (bytes(rng.choice(b"abc ") for _ in range(rng.randrange(0, 90))) + shared + bytes(rng.choice(b"abc ") for _ in range(rng.randrange(0, 90))) for _ in range(2))
        (_, _, x), (_, _, y) = suffixes.anchors([b"short", a, b""]), suffixes.anchors([b])
        assert set(x.tolist()) & set(y.tolist())


def test_hamming_top_k(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(6, 64))
    vectors = np.concatenate([centre[rng.integers(0, 6, 300)] + 0.3 * rng.normal(size=(300, 64)), np.repeat(centre[:1], 60, 0), rng.normal(size=(100, 64))])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000, None), (None, vectors[0].tolist()), (1020, [None] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.distance, r.id) for r in hamming.top_k(df, F.col("vec_id") % 20 == 0, 10).collect()}
    bits = {i: np.array([x is not None and x > 0 for x in v]) for i, v in rows if i is not None and v is not None}
    for q in (i for i in bits if i % 20 == 0):
        want = sorted((int((bits[q] != b).sum()), i) for i, b in bits.items() if i != q)[:10]
        assert [got[q, k + 1] for k in range(10)] == want
    assert hamming.top_k(df.limit(0), F.lit(True)).count() == 0


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 40)
    monkeypatch.setattr(embeddings, "CELL_ROWS", 30)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 16))
    vectors = np.concatenate([base[rng.integers(0, 40, 500)] + 0.12 * rng.normal(size=(500, 16)), np.repeat(base[:1], 30, 0), base[:5] * 1e-200, base[:5] * 1e200])
    labels = [int(x) for x in rng.integers(0, 3, len(vectors))]
    rows = [(i, v.tolist(), k) for i, (v, k) in enumerate(zip(vectors, labels, strict=True))]
    odd = [(900, [0.0] * 16, 1), (901, None, 1), (902, [None] * 16, 1), (903, [float("nan")] * 16, 1), (904, rows[0][1], None), (905, [1.0, 2.0], 1), (906, [float("inf")] * 16, 1), (907, [], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    x = np.stack([v / np.abs(v).max() for v in vectors])
    x /= np.sqrt((x * x).sum(1))[:, None]
    near = (x @ x.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(near, False)
    recall = sum(got[i][0] for i in range(len(x))) / near.sum()
    assert 0.9 <= recall <= 1
    if recall == 1:
        root = components(len(x), list(zip(*np.nonzero(near), strict=True)))
        assert all(got[i] == (near[i].sum(), root[i], root[i] == i) for i in range(len(x)))
    assert all(got[i] == (0, i, True) for i in range(900, 908))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_have_no_python_limit_on_labels(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.001], "a"), (3, [1.0, 0.0], "b"), (4, [1.0, 0.0], "b"), (4, [1.0, 0.0], "b")], "vec_id long, embedding array<float>, label string")
    got = sorted(map(tuple, embeddings.near_duplicates(df).collect()))
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 2, 3, True), (4, 2, 3, False), (4, 2, 3, False)]


PAGES = [
    (1, "http://a.example.net/de/x", '<a href="http://good.site/x"><a href=//c.site>'), (2, "https://good.site/p", "<a HREF = 'https://Other.site:80/'>"), (3, "http://z.org/es/1", "x"),
    (4, "http://bad.site/q", '<a href="http://z.org/">'), (5, "http://worse.site/q", '<img src="http://bad.site/a.png"><a href="http://good.site">'), (6, None, None), (7, "no scheme", '<a href="http://z.org/">'),
    (8, "HTTP://WWW.Example.COM/en/7a?x#y", ""), (9, "http://example.com/en/8", ""), (10, "http://other.site?x=1", ""), (11, "http://z.org#f", ""), (12, "://h/p", ""), (13, "http://x.example.net/de/81", ""), (13, "http://x.example.net/de/81", ""), (None, "", ""),
]


def test_url_trust_against_sql(spark):
    import duckdb
    import pandas as pd

    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = Counter(map(tuple, url_trust.judge(df).collect()))
    con = duckdb.connect()
    con.register("given", pd.DataFrame(PAGES, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    con.execute("create view pages as select cast(page_id as bigint) as page_id, url, html from given")
    assert got == Counter(con.sql(url_trust.judge_sql()).fetchall())
    verdicts = {r[0]: (r[3], r[4]) for r in got}
    assert verdicts[8] == ("example.com/en/7", "allow") and verdicts[9] == ("com/en/", "block") and verdicts[13] == ("example.net/de/8", "block")
    assert verdicts[4] == (None, "block") and verdicts[5] == (None, "block") and verdicts[2] == (None, "allow") and verdicts[6] == (None, "allow")
    assert url_trust.judge(df.limit(0)).count() == 0
