import hashlib
import os
import random
import re

import numpy as np
import pytest

from linkloom.llm import suffix_dedup
from linkloom.llm.suffix_dedup import SuffixIndex, merge_scan, remove_repeats, suffix_array


def brute(texts, length):
    """Removed runs of each text, from a table of all strings of that length."""
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(bytes(b for b, g in zip(r, gone, strict=True) if not g))
    return out


def brute_passages(texts, passage):
    """Words of each text in runs of ``passage`` words that another row has too."""
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for t in texts]
    owners = {}
    for i, ws in enumerate(words):
        for k in range(len(ws) - passage + 1):
            owners.setdefault(tuple(ws[k : k + passage]), set()).add(i)
    out = []
    for ws in words:
        inside = set()
        for k in range(len(ws) - passage + 1):
            if len(owners[tuple(ws[k : k + passage])]) > 1:
                inside.update(range(k, k + passage))
        out.append(len(inside))
    return out


def corpus(length, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(rng.randint(length // 6, length)) for _ in range(6)]
    texts = [None, "", "short", "a" * (length * 3), "ab" * length, "a" * length, "xyz" * length + "q"]
    for _ in range(25):
        parts = [prose(rng.randint(0, length // 2))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 3)
            parts += [s[a : len(s) - rng.randint(0, len(s) // 3)], rng.choice([" ", "", "x"]), prose(rng.randint(0, length // 3))]
        texts.append("".join(parts))
    edited = list(texts[-1] or "x")
    edited[len(edited) // 2] = "Z"
    return [*texts, texts[-1], texts[-2], "".join(edited), texts[-3] + texts[-4]]


def held(rows, texts, length, passage):
    for r, want, n_words in zip(rows, brute(texts, length), brute_passages(texts, passage), strict=True):
        assert bytes(r.kept_bytes) == want, (r.doc_id, texts[r.doc_id])
        assert sum(p.end - p.start for p in r.passages) == n_words, (r.doc_id, texts[r.doc_id])
        assert all(a.end < b.start for runs in (r.removed, r.passages) for a, b in zip(runs, runs[1:]))


@pytest.mark.parametrize(
    ("length", "passage", "seed", "piece", "bucket", "segment"), [(50, 9, 2, 2_000_000, 20_000, 1 << 20), (20, 8, 3, 64, 2, 100), (400, 51, 4, 2_000_000, 20_000, 1 << 20), (50, 6, 5, 2_000_000, 2, 50)]
)
def test_removal_matches_brute_force(spark, make_docs, monkeypatch, length, passage, seed, piece, bucket, segment):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    monkeypatch.setattr(suffix_dedup, "BUCKET_ENTRIES", bucket)
    texts = corpus(length, seed)
    held(remove_repeats(make_docs(texts), length, batches=3, passage=passage).orderBy("doc_id").collect(), texts, length, passage)


def test_batches_of_separate_runs_equal_one_run(spark, make_docs, tmp_path):
    """Three batches, each through an index opened anew; the levels merge geometrically; later batches change what earlier ones lose."""
    texts = corpus(20, 7)
    docs, path, levels = make_docs(texts), f"{tmp_path}/index", []
    for b in range(3):
        index = SuffixIndex(spark, path, 20, 5)
        index.add(docs.where(f"doc_id % 3 = {b}"))
        levels.append(sorted(index.state["levels"]))
    assert levels == [["0"], ["1"], ["0", "1"]]
    again = SuffixIndex(spark, path, 20, 5)
    spans = {bytes(r.digest): r.spans for r in again.spans().collect()}
    for t, want, n_words in zip(texts, brute(texts, 20), brute_passages(texts, 5), strict=True):
        raw = (t or "").encode()
        found = spans.get(hashlib.md5(raw).digest(), [])
        runs = lambda words, size: list(zip(*suffix_dedup.merged(*np.array([(s.start, s.end) for s in found if s.words == words], np.int64).reshape(-1, 2).T, size), strict=True))
        gone = {i for a, b in runs(False, len(raw)) for i in range(a, b)} if len(raw) >= 20 else set()
        assert bytes(b for i, b in enumerate(raw) if i not in gone) == want
        count = len(suffix_dedup._words(raw))
        assert sum(b - a for a, b in runs(True, count)) * (count >= 5) == n_words
    with pytest.raises(ValueError):
        SuffixIndex(spark, path, 30, 5)


def test_two_runs_can_not_add_the_same_batch(spark, make_docs, tmp_path):
    path = f"{tmp_path}/index"
    first, second = SuffixIndex(spark, path, 20, 5), SuffixIndex(spark, path, 20, 5)
    first.add(make_docs(["a" * 50]))
    with pytest.raises(Exception, match="manifest"):
        second.add(make_docs(["b" * 50]))
    assert SuffixIndex(spark, path, 20, 5).state == first.state


def test_suffix_array_and_merge_scan():
    order, common = suffix_array([1, 1, 1, 2], [b"abd", b"ab", b"abc", b"abc"])
    assert order.tolist() == [1, 2, 0, 3] and common.tolist() == [-1, 2, 2, -1]
    # Windows of 4 with a gram of 2, "gg": offset 0 needs two bytes after the gram, offset 1 one on each side, offset 2 two before.
    entries = [(1, 10, b"xy", b"ggab", 0, 2, 10, 10, 1), (1, 11, b"zy", b"ggabcd", 0, 2, 11, 11, 1), (1, 12, b"xy", b"ggcd", 0, 2, 12, 12, 1), (2, 13, b"xy", b"ggab", 0, 2, 13, 13, 2)]
    assert sorted(merge_scan(entries, 4)) == [(1, 10, 0, 2), (1, 11, 0, 1), (1, 12, 2, 2)]
    # Entries of one document do not match in words.
    assert merge_scan([(*e[:6], 5, 5, e[8]) for e in entries], 4) == []


def test_extra_columns_and_empty_table(spark, make_docs):
    docs = make_docs(["abc" * 200, "abc" * 200]).selectExpr("*", "1 AS digest", "2 AS removed", "3 AS other", "4 AS spans", "5 AS gram", "6 AS context", "7 AS fresh", "8 AS words", "9 AS doc", "10 AS a")
    rows = remove_repeats(docs).collect()
    assert all(bytes(r.kept_bytes) == b"" and r.n_bytes == 600 and (r.digest, r.other, r.spans, r.gram, r.context, r.fresh, r.words, r.doc, r.a) == (1, 3, 4, 5, 6, 7, 8, 9, 10) for r in rows)
    assert remove_repeats(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    """The contract's columns of every row on the smallest tables."""
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("needs the driver's tables")
    docs = spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect()
    texts = [r.text for r in docs]
    kept, words = brute(texts, 400), brute_passages(texts, 51)
    rows = suffix_dedup.op8_query(spark, d).orderBy("doc_id").collect()
    for r, doc, left, n_words in zip(rows, docs, kept, words, strict=True):
        size = len((doc.text or "").encode())
        assert (r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256, r.n_passage_words, r.has_passage) == (doc.doc_id, size, size - len(left), hashlib.sha256(left).hexdigest(), n_words, n_words > 0)
        assert (r.n_spans > 0) == (r.n_removed > 0)
