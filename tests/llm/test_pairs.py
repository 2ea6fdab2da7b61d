"""Near-duplicates, decontamination and sharding against brute force."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, graph, neardup, sharding
from tidemark.llm.common import pick, work_folder, written
from tidemark.llm.textkernels import PUNCTUATION, shingle_set, word_hashes


def brute_components(docs):
    """{doc_id: (n, component)} by comparing all pairs of sets."""
    sets = collections.defaultdict(list)
    for doc_id, text in docs:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in re.split("[ \t-\r]+", lower) if w]
        sets[doc_id].append(frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset())
    ids = sorted(sets)
    head = {i: i for i in ids}

    def top(x):
        while head[x] != x:
            x = head[x]
        return x

    for i in ids:
        for j in ids:
            if j < i and any(a and b and 100 * len(a & b) >= 75 * len(a | b) for a in sets[i] for b in sets[j]):
                p, q = top(i), top(j)
                head[max(p, q)] = min(p, q)
    return {i: ({len(s) for s in sets[i]}, top(i)) for i in ids}


def family(seed, size, words=120):
    rnd = random.Random(seed)
    names = [f"w{i}" for i in range(3000)]
    base = [rnd.choice(names) for _ in range(words)]
    out = []
    for i in range(size):
        text = list(base)
        for _ in range(rnd.randint(0, 7)):
            text[rnd.randrange(words)] = rnd.choice(names)
        out.append((seed * 1000 + i * 7 % 997, " ".join(text)))
    return out


EDGES = [(1, None), (2, ""), (3, "  \t\n"), (4, "a b c"), (5, "A b\tC"), (6, "a b c d"), (6, "a b c d"), (7, "é É"), (8, "e " * 50), (9, "E " * 40), (10, "one"), (11, "one")]


@pytest.mark.parametrize("docs", [EDGES, family(1, 120) + family(2, 40) + family(3, 1)])
def test_near_duplicates(spark, docs, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "CELL", 16)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("signature", F.lit(1)).withColumn("ID", F.lit("x"))
    rows = neardup.near_duplicates(df).collect()
    want = brute_components(docs)
    assert len(rows) == len(docs)
    for r in rows:
        assert r.n_shingles in want[r.doc_id][0] and r.component_id == want[r.doc_id][1] and r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_null_ids_and_empty(spark):
    rows = neardup.near_duplicates(spark.createDataFrame([(None, "a b"), (3, "a b"), (2, "a b")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, rows), key=str) == [(2, 1, 2, True), (3, 1, 2, False), (None, 1, None, True)]
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_chain(spark):
    links = written(spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 200), (150, 200)], "a long, b long"), work_folder(spark), "chain")
    found = {r.id: r.label for r in graph.components(links, work_folder(spark), "t").collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}


def test_bounds_keep_true_links():
    rng, limits = np.random.default_rng(1), neardup.least_matches()
    left = rng.integers(0, 1 << 32, (4000, 128), dtype=np.uint32)
    for share, kept in ((0.75, 0.999), (0.3, 0.0)):
        right = np.where(rng.random(left.shape) < share, left, left + 1)
        assert abs(len(neardup.plausible(left, right, limits)) / len(left) - kept) < 0.002


def test_kernels():
    a, start, end = word_hashes(np.frombuffer(b" Ab  ab\ncd", np.uint8))
    assert a[0] == a[1] != a[2] and list(start) == [1, 5, 8] and list(end) == [3, 7, 10]
    long = b"x" * 3_000_000 + b" y " + b"ab " * 500_000
    words, _, _ = word_hashes(np.frombuffer(long, np.uint8))
    assert len(words) == 500_002 and words[-1] == a[0] and len(set(words.tolist())) == 3
    assert len(word_hashes(np.frombuffer(b"a,b!c", np.uint8), PUNCTUATION)[0]) == 3
    assert len(shingle_set(a)) == 1 and len(shingle_set(a[:0])) == 0


ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil magic potions near the river bank"


def test_contaminated(spark):
    rnd = random.Random(4)
    filler = [f"f{i}" for i in range(500)]
    noise = lambda n: " ".join(rnd.choice(filler) for _ in range(n))
    words = ITEM.split()
    swapped = " ".join("zz" if k % 8 == 5 else w for k, w in enumerate(words))
    docs = [(1, f"{noise(30)} {ITEM} {noise(9)}"), (2, ITEM.upper()), (3, f"{noise(5)}, {swapped}."), (4, noise(300)), (5, None), (6, ""), (7, " ".join(words[:8]) + " " + noise(50)), (8, noise(100_000) + " " + ITEM), (9, "Short item, indeed"), (1, ITEM)]
    bench = [(10, ITEM), (11, "short item indeed"), (12, None), (13, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = decontaminate.contaminated(df, spark.createDataFrame(bench, "item_id long, text string"), block_tokens=10).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(1, 10), (1, 10), (2, 10), (3, 10), (8, 10), (9, 11)]
    assert next(r for r in rows if r.doc_id == 8)[2:] == (100_000, 100_000 + len(words), len(words))
    assert decontaminate.contaminated(df, spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_substitution_recall(spark):
    rnd = random.Random(7)
    items = [(k, " ".join(f"v{rnd.randrange(4000)}" for _ in range(rnd.randint(20, 45)))) for k in range(100)]
    docs = [(k, " ".join(w if rnd.random() > 0.1 else "zz" for w in text.split())) for k, text in items]
    rows = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len({r.doc_id for r in rows}) >= 95 and all(r.doc_id == r.item_id for r in rows)


def test_every_pattern_of_substitutions(spark):
    """All ways to substitute tokens, against a search of all runs for one of 13 (or the whole item) with 80 % equal ones."""

    def counts(n, out):
        least = min(13, n)
        spoilt = np.concatenate([[0], np.cumsum([k in out for k in range(n)])])
        return any(5 * (spoilt[j] - spoilt[i]) <= j - i for i in range(n) for j in range(i + least, n + 1))

    items = [(n, " ".join(f"n{n}w{k}" for k in range(n))) for n in range(1, 21)]
    docs, want, spoilt = [], set(), {}
    for n, text in items:
        for out in (x for s in range(4) for x in itertools.combinations(range(n), s)):
            doc_id = len(docs)
            docs.append((doc_id, "a b " + " ".join("zz" if k in out else w for k, w in enumerate(text.split())) + " c"))
            if counts(n, out):
                want.add((doc_id, n))
            spoilt[doc_id] = out
    rows = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want
    for r in rows:
        inside = sum(r.first_token <= k + 2 < r.end_token for k in spoilt[r.doc_id])
        assert r.equal_tokens == r.end_token - r.first_token - inside and r.equal_tokens >= 0.8 * (r.end_token - r.first_token) and r.end_token - r.first_token >= min(13, r.item_id)
    assert len(rows) == len(want)


def test_masks_hit_all_runs():
    """Every minimal run of at least 13 tokens with 80 % equal ones has a seed."""
    for n, s in ((13, 2), (15, 3), (20, 4), (25, 5)):
        fits = [sum((c == "1") << (at + k) for k, c in enumerate(mask)) for mask in decontaminate.MASKS for at in range(n - len(mask) + 1)]
        assert all(any(not spoilt & f for f in fits) for out in itertools.combinations(range(n), s) for spoilt in [sum(1 << k for k in out)])


def test_decontamination_by_brute_force(spark, sf_dir):
    """Every document with a whole item in it is found, and nothing without a long common run."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    tokens = lambda t: re.findall("[^\x00-/:-@\\[-`{-\x7f]+", t.lower())
    items = {r.item_id: tokens(r.text) for r in bench.collect()}
    grams = collections.defaultdict(set)
    for i, w in items.items():
        for k in range(len(w) - 12):
            grams[tuple(w[k : k + 13])].add(i)
    exact = {(r.doc_id, i) for r in docs.collect() for w in [tokens(r.text)] for k in range(len(w) - 12) for i in grams.get(tuple(w[k : k + 13]), ())}
    assert exact <= found and len(found) <= len(exact) + 5


def published_jump(key, n):
    b, j, key = -1, 0, key % (1 << 64)
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(spark):
    docs = [(i * 7919 - 3000, f"t{i % 5}") for i in range(900)] + [(5, None), (5, None), (None, "é"), (2**62, ""), (-(2**63), "x")]
    rows = sharding.assign_shards(spark.createDataFrame(docs, "doc_id long, text string").withColumn("shard", F.lit(1)), 24).collect()
    assert len(rows) == len(docs)
    for r in rows:
        key = -1 if r.doc_id is None else r.doc_id
        assert (r.shard, r.grown_shard, r.law) == (published_jump(key, 24), published_jump(key, 25), "key") and r.grown_shard in (r.shard, 24)
    by_id = {i: t for i, t in docs}
    assert all(r["size"] == 8 + len((by_id[r.doc_id] or "").encode()) and r.text_crc32 == zlib.crc32((by_id[r.doc_id] or "").encode()) for r in rows)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pick(spark):
    df = spark.createDataFrame([(1, "x", "y")], ["doc_id", "text", "TEXT"])
    assert pick(df, id="doc_id", t="text").first() == (1, "x")
    with pytest.raises(ValueError):
        pick(df, a="nothing")


def thue_morse(length):
    a, b = "a", "b"
    while len(a) < length:
        a, b = a + b, b + a
    return a[:length], b[:length]


def test_words_of_one_polynomial_are_apart(spark):
    """Words that any polynomial modulo 2**64 takes for equal, in documents that are otherwise equal."""
    for length in (256, 1024, 4096):
        a, b = (word_hashes(np.frombuffer(x.encode(), np.uint8))[0][0] for x in thue_morse(length))
        assert a != b
    a, b = thue_morse(1024)
    docs = [(1, f"{a} one two three four"), (2, f"{b} one two three four"), (3, f"{a.upper()}  one\ttwo three four")]
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == {1: 1, 2: 2, 3: 1}


def test_equal_hashes_are_not_links(spark, monkeypatch):
    """With hashes that take all words for one, only the words themselves keep documents apart."""
    monkeypatch.setattr(neardup, "shingle_set", lambda words, size: shingle_set(words, size) * 0 + 7)
    texts = {f"d{k}": neardup.numbered_shingles([f"a{k} b c d e f", "a0 b c d e f"]) for k in range(3)}
    assert [neardup.linked(*pair, 75) for pair in texts.values()] == [True, False, False]
    batch = neardup.pa.RecordBatch.from_pylist([{"a": 1, "part": 0, "b": None, "text": "x b c d e f"}, {"a": 1, "part": 0, "b": 2, "text": "y b c d e f"}, {"a": 1, "part": 0, "b": 3, "text": "X b c d e f"}])
    out = [r for found in neardup.verify_sets(5, 75)(iter([batch])) for r in found.to_pylist()]
    assert out == [{"a": 1, "b": 3}]


def test_numbered_shingles():
    rnd = random.Random(1)
    for _ in range(200):
        texts = [" ".join(rnd.choice("abcD") for _ in range(rnd.randint(0, 12))) for _ in range(5)]
        sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in texts]
        numbers = neardup.numbered_shingles(texts)
        for i, j in itertools.product(range(5), repeat=2):
            assert len(numbers[i]) == len(sets[i]) and len(np.intersect1d(numbers[i], numbers[j])) == len(sets[i] & sets[j])


def plain_overlap(tokens, item, least=13, share=0.8):
    """The best run by trying all diagonals and all runs: (equal tokens, -first, -length)."""
    need, best = min(least, len(item)), None
    for d in range(-len(item) + 1, len(tokens)):
        low, high = max(0, -d), min(len(item), len(tokens) - d)
        sums = np.concatenate([[0], np.cumsum(tokens[low + d : high + d] == item[low:high])])
        for i in range(high - low):
            for j in range(i + need, high - low + 1):
                n = int(sums[j] - sums[i])
                if n >= share * (j - i) - 1e-9 and (best is None or (n, -(low + d + i), i - j) > best):
                    best = (n, -(low + d + i), i - j)
    return best and (-best[1], -best[1] - best[2], best[0])


def test_best_overlap_by_brute_force():
    rng = np.random.default_rng(3)
    for words in (2, 3, 6, 40):
        for _ in range(40):
            tokens, item = rng.integers(1, words + 1, rng.integers(1, 50)).astype(np.uint64), rng.integers(1, words + 1, rng.integers(1, 25)).astype(np.uint64)
            got, want = decontaminate.best_overlap(tokens, np.argsort(tokens, kind="stable"), item), plain_overlap(tokens, item)
            assert (got and got[2]) == (want and want[2]) and (got is None or got[0] == want[0]), (tokens, item, got, want)


def test_a_token_that_repeats(spark):
    """A text and an item that repeat one word take bounded memory and give one row."""
    docs, items = [(1, "spam " * 100_000), (2, "spam " * 900 + "egg"), (3, "egg ham")], [(7, "spam " * 1000), (8, "spam " * 800 + "ham")]
    rows = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.first_token, r.end_token, r.equal_tokens) for r in rows} == {(1, 7): (0, 1000, 1000), (1, 8): (0, 800, 800), (2, 7): (0, 900, 900), (2, 8): (0, 800, 800)} and len(rows) == 4


def test_many_items(spark, monkeypatch):
    """Thousands of items, joined by shuffling with salts, each found in its own document; others share all but a few of their tokens."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_MB", 0)
    items = [(k, " ".join(f"v{k}x{j}" for j in range(14))) for k in range(1500)] + [(None, "only this one item lacks an id but it counts like any other item")] * 2
    docs = [(k, f"before it {text} after") for k, text in items[:1500:3]] + [(5000, " ".join(t for _, t in items[:300])), (None, items[4][1]), (6000, items[-1][1])]
    rows = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit(1)), spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit(1)), block_tokens=1000).collect()
    want = [(k, k) for k in range(0, 1500, 3)] + [(5000, k) for k in range(300)] + [(None, 4), (6000, None), (6000, None)]
    assert collections.Counter((r.doc_id, r.item_id) for r in rows) == collections.Counter(want)


def test_folders_on_a_cluster(spark, monkeypatch):
    class Cluster:
        master = "spark://there:7077"

    class Session:
        sparkContext = Cluster()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError, match="checkpoint"):
        work_folder(Session())
