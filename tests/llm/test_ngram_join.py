import random
import re

import numpy as np
import pytest
from conftest import prose

from refminer.llm import batches, ngram_join


def grams(text, n=3):
    w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def corpus(seed, n):
    rng = random.Random(seed)
    shared = prose(rng, 25)
    texts = []
    for _ in range(n):
        pick = rng.random()
        if pick < 0.3 and texts:
            w = rng.choice(texts).split() or ["alone"]
            for _ in range(max(1, int(len(w) * rng.choice([0.0, 0.02, 0.05, 0.1, 0.2])))):
                w[rng.randrange(len(w))] = rng.choice(["", "edit", "other thing"])
            texts.append(" ".join(w))
        elif pick < 0.45 and texts:
            texts.append(rng.choice(texts))
        else:
            texts.append(prose(rng, rng.choice([1, 2, 3, 20, 60, 150])) + (" " + shared if rng.random() < 0.3 else ""))
    return texts


def brute(texts, t):
    sets = [grams(x) for x in texts]
    return {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and b and len(a & b) / len(a | b) >= t - 1e-12}


def expanded(rows):
    """All pairs, from the pairs of representatives and the copies of each."""
    rows = [(r.doc_a, r.doc_b, r.jaccard) for r in rows]
    copies = {}
    for a, b, j in rows:
        if j == 1:
            copies.setdefault(a, [a]).append(b)
    out = {}
    for a, b, j in rows:
        assert a < b
        for x in copies.get(a, [a]):
            for y in copies.get(b, [b]):
                if x != y:
                    assert out.setdefault((min(x, y), max(x, y)), j) == j
    for own in copies.values():
        out |= {(x, y): 1.0 for x in own for y in own if x < y}
    return out


def classes(pairs):
    """doc_id -> (class_id, n_links)"""
    root = {k: k for p in pairs for k in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {k: (find(k), sum(k in p for p in pairs)) for k in root}


@pytest.mark.parametrize("t", [0.5, 0.8])
def test_pairs_equal_brute_force(make_docs, t):
    texts = corpus(7, 150)
    found, want = expanded(ngram_join.similar_documents(make_docs(texts), threshold=t).collect()), brute(texts, t)
    assert want and found.keys() == want.keys()
    assert all(found[k] == pytest.approx(v) for k, v in want.items())


def test_many_buckets_give_the_same(make_docs, monkeypatch):
    texts = corpus(8, 120)
    monkeypatch.setattr(ngram_join, "BUCKET_ENTRIES", 200)
    monkeypatch.setattr(ngram_join, "PAIRS_AT_ONCE", 50)
    monkeypatch.setattr(ngram_join, "COLUMNS", 8)
    docs, want = make_docs(texts), brute(texts, 0.5)
    monkeypatch.setattr(ngram_join, "TILE_GRAMS", 1500)
    found = ngram_join.similarity_classes(docs).collect()
    assert len(found) == len({r.doc_id for r in found}) and {r.doc_id: (r.class_id, r.n_links) for r in found} == classes(want)


def test_a_cluster_larger_than_a_tile(make_docs):
    """A thousand copies with an edit or two each, as in a hot source: every link is counted, in many tiles."""
    rng = random.Random(13)
    words = prose(rng, 120).split()
    texts = []
    for k in range(1000):
        own = list(words)
        for _ in range(rng.choice([1, 2, 6])):
            own[rng.randrange(len(own))] = f"edit{rng.randrange(40)}"
        texts.append(" ".join(own))
    sets = [grams(x) for x in texts]
    want = [sum(2 * len(a & b) >= len(a | b) for b in sets) - 1 for a in sets]
    found = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similarity_classes(make_docs(texts)).collect()}
    assert found == {k: (0, n) for k, n in enumerate(want)}


def test_prefix_blobs_are_read_back():
    rng = np.random.default_rng(5)
    rows = [(k, np.unique(rng.integers(0, 1 << 62, rng.integers(1, 60)).astype(np.uint64))) for k in range(40)]
    names, blobs = ngram_join._packed(iter(rows), 3, 0.5, np.uint64(1 << 61))
    entries = set()
    for b, blob in zip(names, blobs, strict=True):
        ids, low, high, hashes, refs = ngram_join._unpacked(blob)
        assert (low[refs] > 0).all() and (high >= low).all()
        entries |= {(b, h, i) for h, i in zip(hashes.tolist(), ids[refs].tolist(), strict=True)}
    want = set()
    for _, keys in rows:
        for v in batches.mix(keys[: ngram_join.prefix_length(len(keys), 0.5)]).tolist():
            want.add((v % 3, v >> 34, ngram_join._block(keys, np.uint64(1 << 61))))
    assert entries == want


@pytest.mark.parametrize("buckets", [1, 3, 7, 40])
def test_pairs_that_share_too_little_stay_in_their_bucket(spark, monkeypatch, buckets):
    """Of many sets that share a rare n-gram or two by chance, hardly a pair leaves its bucket; all that reach the threshold, often just so, are possible."""
    rng = np.random.default_rng(buckets)
    sets = []
    for k in range(200):
        if k % 4 == 3:
            a, b = sets[-1], rng.integers(0, 1 << 62, 90).astype(np.uint64)
            sets.append(np.unique(np.concatenate([rng.permutation(a)[: len(a) * rng.integers(60, 80) // 100], b[: rng.integers(10, 60)]])))
        else:
            sets.append(np.unique(np.concatenate([rng.integers(0, 1 << 62, rng.integers(60, 150)).astype(np.uint64), rng.integers(0, 120, 2).astype(np.uint64)])))
    monkeypatch.setattr(ngram_join, "ENTRIES_AT_ONCE", 700)
    heavy, held = np.uint64(0), {}
    for k in range(0, 200, 50):
        for b, blob in zip(*ngram_join._packed(iter(list(enumerate(sets))[k : k + 50]), buckets, 0.5, heavy), strict=True):
            held.setdefault(b, []).append(blob)
    joined = [ngram_join.join_bucket(blobs, 0.5, buckets) for blobs in held.values()]
    rows = [r for j in joined for r in zip(*(j[c].tolist() for c in ("b1", "b2", "low1", "high1", "low2", "high2", "shared")), strict=True)]
    by_pair = {}
    for r in rows:
        by_pair.setdefault(r[:2], []).append(r[2:])
    merged = [(*p, min(r[0] for r in v), max(r[1] for r in v), min(r[2] for r in v), max(r[3] for r in v), sum(r[4] for r in v), len(v)) for p, v in by_pair.items()]
    frame = spark.createDataFrame(merged, "b1 bigint, b2 bigint, low1 int, high1 int, low2 int, high2 int, shared int, n int")
    left = {(r.b1, r.b2) for r in frame.filter(ngram_join._possible(0.5, buckets)).collect()}
    block = [ngram_join._block(s, heavy) for s in sets]
    near = [(i, j) for i in range(200) for j in range(i) if 2 * len(np.intersect1d(sets[i], sets[j])) >= len(np.union1d(sets[i], sets[j]))]
    want = {(min(block[i], block[j]), max(block[i], block[j])) for i, j in near if block[i] != block[j]}
    assert len(near) > 10 and want <= left
    # of sizes that are alike, groups must share a ninth of the larger; where one is half as large as the other, a single n-gram may do
    few = {(min(block[i], block[j]), max(block[i], block[j])) for i in range(200) for j in range(i) if 0 < len(np.intersect1d(sets[i], sets[j])) < 5 and 5 / 6 < len(sets[i]) / len(sets[j]) < 6 / 5}
    assert len(few) > 100 and (buckets > 7 or sum(r[:2] in few for r in rows) < 10)


def test_long_texts_about_the_threshold(make_docs, monkeypatch):
    rng = random.Random(21)
    texts = []
    for k in range(90):
        own = prose(rng, 200).split() if k % 3 == 0 else texts[k - k % 3].split()
        for at in rng.sample(range(200), [0, 18, 25][k % 3]):
            own[at] = f"edit{rng.randrange(1000)}"
        texts.append(" ".join(own))
    monkeypatch.setattr(ngram_join, "BUCKET_ENTRIES", 1500)
    want = classes(brute(texts, 0.5))
    assert len(want) > 20
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similarity_classes(make_docs(texts)).collect()} == want


def test_sketch_grows_with_the_corpus(make_docs):
    assert [ngram_join._sketch_bits(c) for c in (0, 1_000_000, 200_000_000, 10_000_000_000)] == [20, 20, 22, 24]
    texts = [prose(random.Random(1), 30)] * 600 + [prose(random.Random(2), 30)] * 3
    ranks, total = ngram_join.gram_sketch(make_docs(texts), 3, 22)
    assert len(ranks) == 1 << 22 and total == 603 * 28
    assert sorted(ranks[ranks > 0].tolist()) == sorted(ngram_join._rank(np.repeat([600, 3], 28)).tolist())


def test_one_of_each_group_stays(make_docs):
    texts = corpus(9, 150)
    root = list(range(150))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute(texts, 0.5):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    kept = {r.doc_id for r in ngram_join.drop_similar(make_docs(texts)).collect()}
    assert kept == {k for k in range(150) if find(k) == k}


def test_thousands_of_copies_and_a_chain(spark, make_docs):
    rng = random.Random(11)
    text = prose(rng, 40)
    docs = make_docs([text] * 2000 + [prose(rng, 40)])
    assert {tuple(r) for r in ngram_join.similar_documents(docs).collect()} == {(0, k, 1.0) for k in range(1, 2000)}
    assert {tuple(r) for r in ngram_join.similarity_classes(docs).collect()} == {(k, 0, 1999) for k in range(2000)}
    n = 60
    chain = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    assert {tuple(r) for r in ngram_join.components(chain).collect()} == {(k, 0) for k in range(n + 1)} | {(100, 100), (101, 100)}
    assert ngram_join.components(chain.limit(0)).collect() == []


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = set(rng.integers(0, 60, rng.integers(1, 40)).tolist())
        b = set(rng.permutation(list(a))[: rng.integers(1, len(a) + 1)].tolist()) | set(rng.integers(0, 60, rng.integers(0, 8)).tolist())
        for t in (0.5, 0.7, 0.9):
            if len(a & b) / len(a | b) >= t:
                assert set(sorted(a)[: ngram_join.prefix_length(len(a), t)]) & set(sorted(b)[: ngram_join.prefix_length(len(b), t)])
