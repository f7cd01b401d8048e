import os
import random

import numpy as np
import pytest

from linkloom.llm import minhash
from linkloom.llm.minhash import Forest, band_keys, linked_pairs, mix64, near_duplicates, op5_query, shingle_set, super_minhash


def plain_super_minhash(elements, m):
    """The published loop with a real permutation, drawing the same numbers."""
    best = [2**64 - 1] * m
    for e in elements:
        p = list(range(m))
        for j in range(m):
            x = int(mix64(np.array([(int(e) + 0x9E3779B97F4A7C15 * (j + 1)) % 2**64], np.uint64))[0])
            k = j + (((x >> 32) * (m - j)) >> 32)
            p[j], p[k] = p[k], p[j]
            best[p[j]] = min(best[p[j]], (j << 32) | (x & 0xFFFFFFFF))
    return best


def test_signature_is_that_of_the_plain_loop():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 2, 7, 0, 40, 300)]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    got = super_minhash(np.concatenate(sets), owner, len(sets), 24)
    for s, row in zip(sets, got, strict=True):
        assert row.tolist() == plain_super_minhash(s, 24)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200, dtype=np.uint64)])
    sig = super_minhash(np.concatenate([a, b]), np.repeat([0, 1], 1000), 2, 512)
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.08
    assert band_keys(sig, 32).shape == (2, 32)


def brute(texts, k, percent):
    sets = []
    for t in texts:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        words = lowered.encode().split()
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    forest = Forest(len(texts))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                forest.join(i, j)
    return [(len(s), forest.root(i)) for i, s in enumerate(sets)]


def corpus(n_groups=12, seed=3):
    rng = random.Random(seed)
    texts = [None, "", "  \n", "one", "ONE", "one two", "one  two", "Ä", "ä"]
    for _ in range(n_groups):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randint(3, 150))]
        for _ in range(rng.randint(1, 8)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("chunk", [1500, 5])
def test_components_match_brute_force(spark, make_docs, chunk):
    texts = corpus()
    rows = near_duplicates(make_docs(texts), 3, 85, chunk=chunk).orderBy("doc_id").collect()
    want = brute(texts, 3, 85)
    assert [(r.n_shingles, r.component_id) for r in rows] == want
    assert [r.kept for r in rows] == [i == c for i, (_, c) in enumerate(want)]


def test_chain_of_near_copies_in_small_chunks(spark, make_docs):
    """Neighbours are linked, ends are not: only the chain makes one component."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[i * 6 : i * 6 + 200]) for i in range(30)]
    rows = near_duplicates(make_docs(texts), 3, 85, chunk=4).collect()
    assert {r.component_id for r in rows} == {r for _, r in brute(texts, 3, 85)}


def test_linked_pairs_dense_and_sparse():
    rng = random.Random(4)
    base = rng.sample(range(10**6), 60)
    sets = [np.array(sorted(set(base[rng.randint(0, 12) :] + rng.sample(range(10**6), rng.randint(1, 8)))), np.uint64) for _ in range(90)]
    got = {(int(i), int(j)) for i, j in linked_pairs(sets, 80)}
    py = [set(s.tolist()) for s in sets]
    assert got == {(i, j) for i in range(90) for j in range(90) if i != j and 100 * len(py[i] & py[j]) >= 80 * len(py[i] | py[j])}


def test_repeated_rows_null_ids_extra_columns_and_empty_table(spark):
    text = "a b c d e f g h i j"
    docs = spark.createDataFrame([(1, text, 0), (1, text, 0), (None, text, 0), (2, text.upper(), 0)], "doc_id long, text string, kept int")
    rows = near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.component_id) for r in rows if r.doc_id), key=str) == [(1, 1), (1, 1), (2, 1)]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    """Every row of the smallest tables."""
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("needs the driver's tables")
    docs = spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect()
    want = brute([r.text for r in docs], 3, 85)
    rows = op5_query(spark, d).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows] == [(doc.doc_id, n, docs[c].doc_id, i == c) for i, (doc, (n, c)) in enumerate(zip(docs, want, strict=True))]


def test_long_texts_and_text_ids(spark, make_docs):
    rng = random.Random(9)
    words = [f"w{rng.randrange(5000)}" for _ in range(150_000)]
    other = list(words)
    other[70_000] = "changed"
    rows = near_duplicates(make_docs([" ".join(words), " ".join(other), "short text"])).orderBy("doc_id").collect()
    assert [r.component_id for r in rows] == [0, 0, 2]
    with pytest.raises(TypeError, match="whole number"):
        near_duplicates(spark.createDataFrame([("a", "text")], "doc_id string, text string"))


def test_shingles_of_short_texts():
    assert len(shingle_set(None, 3)) == 0 and len(shingle_set("a b", 3)) == 1
    assert shingle_set("a b", 3) != shingle_set("ab", 3)


@pytest.mark.parametrize("edges", [1_000_000, 3])
def test_components_across_tasks(spark, monkeypatch, edges):
    """A long path, a star and a clique, in one task and in many."""
    monkeypatch.setattr(minhash, "EDGES", edges)
    rng = random.Random(6)
    path = [(i, i + 1) for i in range(100, 130)]
    pairs = path + [(200, 200 + i) for i in range(1, 12)] + [(i, j) for i in range(300, 306) for j in range(300, i)] + [(7, 7)]
    rng.shuffle(pairs)
    nodes = spark.createDataFrame([(i,) for i in [7, 9, *range(100, 131), *range(200, 212), *range(300, 306)]], "id long")
    got = {r.id: r.component for r in minhash.components(nodes, spark.createDataFrame(pairs, "a long, b long").repartition(4)).collect()}
    assert got == {i: i if i < 100 else i // 100 * 100 for i in got}
