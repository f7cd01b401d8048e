"""The five stages against brute force on a small corpus."""

import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from linkloom.llm import mixing, quality
from linkloom.llm.common import cut

from .test_minhash import brute as near_groups
from .test_native import spans_by_definition


def corpus():
    rng = random.Random(8)
    words = ["the", "house", "river", "garden", "stone", "morning", "winter", "letter", "window", "mountain", "little", "children", "walked", "under", "bright", "silver", "paper", "road", "after", "before"]
    prose = lambda n: " ".join(rng.choice(words) + (str(rng.randrange(400)) if rng.random() < 0.3 else "") for _ in range(n))
    texts = [prose(rng.randint(60, 160)) for _ in range(30)]
    near = texts[0].split()
    near[10] = "changed"
    texts += [texts[1], " ".join(near), prose(20), "x y z " * 60, None, "", prose(80) + " password=abcdefghij1234567 " + prose(10), "|".join("#" * 3 for _ in range(300))]
    return [(i, t, rng.choice(["en", "de"]), f"src{rng.randrange(4)}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(rows in, rows out) of every stage, each written and read again."""
    spark_rows = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    root = str(tmp_path_factory.mktemp("sf"))
    spark_rows.write.parquet(f"{root}/documents.parquet")
    docs, out = spark.read.parquet(f"{root}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = cut(stage(spark, docs, root), name)
        out[name] = (docs.collect(), after.collect(), after.columns)
        docs = after
    out["run"] = corpus_pipeline.run(spark, root).collect()
    return out


def test_all_but_the_last_return_the_columns_of_documents(stages):
    assert all(stages[n][2] == corpus_pipeline.COLUMNS for n, _ in corpus_pipeline.STAGES[:-1])


def test_quality_stage(stages):
    before, after, _ = stages["quality_rules"]
    rules = quality.production_rules()
    meter = quality.Meter(rules)
    want = set()
    for r in before:
        words, *counts = quality.base_counts(r.text or "")
        meter.learn(set(words))
        band = quality.LANGUAGE_BANDS[r.lang]
        if len(words) >= 50 and 2 * counts[3] <= len(words) and quality.verdict(band, rules, *meter.measure(words, counts[0])) is None:
            want.add(r.doc_id)
    assert {r.doc_id for r in after} == want and len(want) >= 30 and {33, 34, 35}.isdisjoint(want)


def test_near_copy_stage(stages):
    before, after, _ = stages["near_dedup"]
    before = sorted(before, key=lambda r: r.doc_id)
    want = {before[i].doc_id for i, (_, root) in enumerate(near_groups([r.text for r in before], 5, 80)) if root == i}
    assert {r.doc_id for r in after} == want and not {30, 31} & want


def test_secret_stage(stages):
    before, after, _ = stages["secret_scans"]
    out = {r.doc_id: r for r in after}
    assert set(out) == {r.doc_id for r in before}
    for r in before:
        text, shift = r.text, 0
        for s in spans_by_definition(r.text):
            kind, a, b = s.split(":")
            text = text[: int(a) + shift] + f"[{kind}]" + text[int(b) + shift :]
            shift += len(kind) + 2 - (int(b) - int(a))
        assert out[r.doc_id].text == text and out[r.doc_id].n_chars == len(text)
    assert any("[assign]" in r.text for r in after)


def fill(total, children):
    """Shares of (name, weight, capacity) by repeated passes: who is full leaves, the rest is shared again."""
    got, left, open_ = {}, total, dict((n, (w, c)) for n, w, c in children)
    while open_:
        weights = sum(w for w, _ in open_.values())
        full = [n for n, (w, c) in open_.items() if c * weights <= left * w]
        if not full:
            return got | {n: left * w / weights for n, (w, _) in open_.items()}
        for n in full:
            got[n] = open_[n][1]
        left -= sum(open_.pop(n)[1] for n in full)
    return got


def test_mixing_stage(stages):
    before, after, _ = stages["mixing"]
    mix, leaves = mixing.PRODUCTION, {}
    domain = lambda s: next((d for d, names in mixing.DOMAINS.items() if s in names), "other")
    n_words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    for r in before:
        key = (domain(r.source), r.lang, r.source)
        leaves[key] = leaves.get(key, 0) + n_words(r.text)
    quota = {(): sum(leaves.values()) * mix.budget_percent // 100}
    for depth in (1, 2, 3):
        for parent in [p for p in list(quota) if len(p) == depth - 1]:
            below = {}
            for key, n in leaves.items():
                if key[: depth - 1] == parent:
                    below[key[:depth]] = below.get(key[:depth], 0) + n * mix.max_epochs
            quota |= fill(quota[parent], [(k, mix.weights.get(k, 1), c) for k, c in below.items()])
    taken = {}
    for r in after:
        key = (domain(r.source), r.lang, r.source)
        taken.setdefault(key, []).append(n_words(r.text))
    for key, n in leaves.items():
        # Whole documents: the one in which the prefix ends may overshoot, and shares are whole tokens.
        assert quota[key] - 3 <= sum(taken.get(key, [])) < quota[key] + max(taken.get(key, [0])) + 3, key


def test_encoding_stage_and_run(stages):
    before, after, _ = stages["bpe"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r.doc_id, b"".join(i.to_bytes(4, "little") for i in library.encode(r.text, add_special_tokens=False).ids)) for r in before)
    assert sorted((r.doc_id, bytes(r.ids)) for r in after) == want and all(r.n_tokens * 4 == len(r.ids) for r in after)
    assert sorted(map(str, stages["run"])) == sorted(map(str, after))


def test_stages_with_nulls_repeats_clashing_names_and_empty_tables(spark, tmp_path):
    """Null ids, languages and sources, repeated rows, a long text and columns with the names that stages work with: every stage runs and returns its columns."""
    prose = corpus()[2][1]
    rows = [(None, prose, None, None, None), (1, None, "en", "src0", 0), (2, "", None, "src1", 0), (3, corpus()[3][1], "en", None, 5), (3, corpus()[3][1], "en", None, 5), (4, "the house " * 50_000 + corpus()[5][1], "de", "src2", 9), (5, corpus()[7][1] + " password=abcdefghij1234567", "xx", "src2", 9)]
    names = "kept spans blob epoch take_tokens domain key component_id id bands digest bpe_ids n_words pending".split()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"'own' AS {n}" for n in names])
    for name, stage in corpus_pipeline.STAGES:
        after = cut(stage(spark, docs, str(tmp_path)), name)
        assert after.count() >= (1 if name != "quality_rules" else 2), name
        if name != "bpe":
            assert after.columns == corpus_pipeline.COLUMNS
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert (None, prose) in kept and (1, None) in kept and (2, "") in kept and len(kept) == 6
    redacted = {r.doc_id: r for r in corpus_pipeline.redact_secrets(spark, docs, "").collect()}
    assert redacted[5].text.endswith("[assign]") and redacted[5].n_chars == len(redacted[5].text) and redacted[1].text is None
