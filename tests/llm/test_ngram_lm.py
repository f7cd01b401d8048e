import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkloom.llm.ngram_lm import Filter, NgramModel, Settings, _build, _packed, _unpacked, meant, op3_query, thresholds, unigram


def test_levels_come_back_by_probing():
    rng = np.random.default_rng(1)
    how = Settings()
    tags, counts = np.unique(rng.integers(0, 2**40, 5000, dtype=np.uint64)), None
    counts = rng.integers(1, 3000, len(tags)).astype("<u4")
    built = _build(how)(pa.table({"segment": [0], "tags": [_packed(tags)], "counts": [counts.tobytes()]}))
    bits = built.column("bits")[0].as_py()
    held = Filter([(0, bits)], len(bits), 64, how.probes)
    want = np.searchsorted(thresholds(how.base), counts, side="right")
    got = held.levels(tags)
    assert (got >= want).all() and (got == want).mean() > 0.98
    assert (held.levels(rng.integers(0, 2**40, 5000, dtype=np.uint64)) == 0).mean() > 0.98
    assert (_unpacked(_packed(tags)) == tags).all()


def test_quantiser():
    assert thresholds(1.5)[:5].tolist() == [1, 2, 3, 4, 6] and meant(1.5)[:6].tolist() == [0, 1, 2, 3, 4.5, 6.5]


def texts(n=120):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return [*made, None, "", "UPPER upper Ä ä", "x" * 200, made[0]]


def brute(rows, how):
    """Exact counts, quantised, without a filter."""
    least, stands = thresholds(how.base), meant(how.base)
    q = lambda c: stands[np.searchsorted(least, c, side="right")]
    seq = {i: [*"".join(c.lower() if c.isascii() else c for c in t or "").split(), None] for i, t in rows}
    train = [s for i, s in seq.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    one = Counter(w for s in train for w in s)
    two = Counter(p for s in train for p in zip(["<s>", *s], s))
    n, v = sum(one.values()), len(one)
    out = {}
    for i, s in seq.items():
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in s)
        score = 0.0
        for h, w in zip(["<s>", *s], s):
            q_h = q(len(train)) if h == "<s>" else q(one[h])
            mu = 1 + how.mu * q_h**how.mu_power
            score += math.log10((min(q(two[h, w]), q_h) + mu * (q(one[w]) + 1) / (n + v + 1)) / (q_h + mu))
        out[i] = (len(s), sum(one[w] > 0 for w in s), n, base, score)
    return out


@pytest.mark.parametrize("how", [Settings(bits_per_entry=60), Settings(bits_per_entry=60, head_words=5), Settings(bits_per_entry=60, max_filter_bytes=0)])
def test_scores_match_brute_force(spark, tmp_path, make_docs, how):
    docs = make_docs(texts())
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = brute(list(enumerate(texts())), how)
    rows = op3_query(spark, str(tmp_path), how).collect()
    assert len(rows) == len(want)
    for r in rows:
        n_tokens, known, n, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, known, n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_production_settings_against_exact_scores(spark, tmp_path, make_docs):
    """With ten bits an entry some unseen n-grams are found: most texts score as by exact counts, none less, and few more by much."""
    docs = make_docs(texts(600))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = brute(list(enumerate(texts(600))), Settings())
    rows = op3_query(spark, str(tmp_path)).collect()
    off = np.array([(r.score - want[r.doc_id][4]) / want[r.doc_id][0] for r in rows])
    assert all(r.base_score == pytest.approx(want[r.doc_id][3]) for r in rows)
    assert (np.abs(off) < 1e-9).mean() > 0.5 and off.mean() < 0.02 and np.abs(off).max() < 0.5


def test_most_held_out_texts_beat_the_base(spark):
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("needs the driver's tables")
    rows = [r for r in op3_query(spark, d).collect() if r.held_out]
    assert sum(r.score > r.base_score for r in rows) > 0.85 * len(rows) and sum(r.score for r in rows) > sum(r.base_score for r in rows) * 0.95


def test_long_text_and_clashing_names(spark, make_docs):
    names = "known more word n times row segment block tags".split()
    docs = make_docs(["a b c", "a b " * 400_000, None]).select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    for how in (Settings(), Settings(max_filter_bytes=0), Settings(head_words=1)):
        rows = {r.doc_id: r for r in NgramModel(docs, how=how).score(docs).collect()}
        assert all(r[n] == f"own {n}" for r in rows.values() for n in names)
        assert rows[1].lm_n_tokens == 800_001 and rows[1].lm_n_known == 800_001


def test_empty_tables_repeated_rows_and_extra_columns(spark, make_docs):
    docs = make_docs(["a b", "a b", None]).selectExpr("1 AS doc_id", "text", "'x' AS lm_score", "2 AS other")
    model = NgramModel(docs)
    rows = model.score(docs).collect()
    assert len(rows) == 3 and all(r.other == 2 for r in rows)
    assert model.score(docs.limit(0)).count() == 0
    nothing = NgramModel(docs.limit(0))
    assert nothing.n == 0 and all(r.lm_n_known == 0 and r.lm_score < 0.1 for r in nothing.score(docs).collect())


def test_asks_follow_shelves_and_not_segments(spark, make_docs, monkeypatch):
    """With very many segments a block asks each shelf once, and the scores are those of the broadcast."""
    from linkloom.llm import ngram_lm

    monkeypatch.setattr(ngram_lm, "SEGMENT", 32)
    monkeypatch.setattr(ngram_lm, "SHELF", 1 << 12, raising=False)
    made, cut = {}, ngram_lm.cut
    monkeypatch.setattr(ngram_lm, "cut", lambda df, label: made.setdefault(label, cut(df, label)))
    docs = make_docs(texts(300))
    want = {r.doc_id: r for r in NgramModel(docs).score(docs).collect()}
    made.clear()
    model = NgramModel(docs, how=Settings(max_filter_bytes=0))
    got = {r.doc_id: r for r in model.score(docs).collect()}
    assert got == want and model.segments.count() > 100
    told = made["dealt"].selectExpr("count(*) AS blocks", "sum(size(asks)) AS asks", "max(size(asks)) AS most").first()
    assert 2 < told.most <= 16 and told.asks <= told.blocks * told.most


def test_levels_of_frequent_words_are_read_once():
    rng = np.random.default_rng(2)
    how = Settings()
    hashes = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    keys = np.unique(unigram(hashes) & np.uint64(2**40 - 1))
    built = _build(how)(pa.table({"segment": [0], "tags": [_packed(keys)], "counts": [rng.integers(1, 900, len(keys)).astype("<u4").tobytes()]}))
    bits = built.column("bits")[0].as_py()
    held = Filter([(0, bits)], len(bits), 64, how.probes)
    asked = rng.permutation(hashes)
    want = held.levels(unigram(asked))
    assert want.min() > 0
    assert (held.word_levels(asked) == want).all()
    held.remember(hashes[1000:])
    assert (held.word_levels(asked) == want).all() and not len(held.word_levels(asked[:0]))
    held.bits[:] = 0  # so what is still known was not probed for
    assert (held.word_levels(hashes[1000:]) == held.known_levels[np.searchsorted(held.known, hashes[1000:])]).all()
    assert (held.word_levels(hashes[:1000]) == 0).all()
