import math
import random

import pytest

from linkloom.llm.toxicity import Memo, Model, Training, features, fold, labelled_sample, op9_query, score_text, score_toxicity, sentences, train


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lon", "mit", "ser", "tal")]
    rows = []
    for i in range(n):
        said = [[rng.choice(plain) for _ in range(rng.randint(3, 9))] for _ in range(rng.randint(1, 12))]
        if i % 4 == 0:
            said[rng.randrange(len(said))].insert(1, rng.choice(["vilely", "rotten", "mucky"]))
        rows.append((". ".join(" ".join(s) for s in said) + ".", int(i % 4 == 0)))
    return rows


def learnt(spark, rows):
    return train(spark.createDataFrame(rows, "text string, toxic int"))


def test_held_out_accuracy_and_located_sentences(spark):
    model = learnt(spark, corpus())
    assert learnt(spark, corpus()[::-1]) == model
    word = Memo(model.word, 1000).__getitem__
    fresh = corpus(200, 2)
    scored = [score_text(t, word, model.bias) for t, _ in fresh]
    assert sum((p >= 0.5) == bool(y) for (p, _), (_, y) in zip(scored, fresh, strict=True)) >= 196
    for (_, found), (text, y) in zip(scored, fresh, strict=True):
        if y and found:
            assert any(w in text[a:b] for a, b, _ in found for w in ("vilely", "rotten", "mucky"))


def test_noisy_or_is_that_of_its_sentences():
    model = Model(-1.0, {"bad": 2.0, "worse": 3.0, "fine": -1.0})
    text = "a bad day. nothing here! worse\nfine (bad), Bad"
    each = [1 / (1 + math.exp(-(model.bias + z))) for z in (2.0, 3.0, 3.0)]
    want = 1 - math.prod(1 - p for p in each)
    score, found = score_text(text, model.word, model.bias)
    assert score == pytest.approx(want)
    assert [text[a:b].strip() for a, b, _ in found] == ["a bad day", "worse", "fine (bad), Bad"]


def test_features_and_sentences():
    assert features("(Rotten,") == ["rotten", "^rott", "^rotte", "^rotten"] and features("--") == []
    assert sentences(" . \n") == []


def test_without_labels_of_both_kinds_nothing_is_toxic(spark):
    assert learnt(spark, []).weights == {} and learnt(spark, [("some text", 0), (None, 0)]).weights == {}


def test_sample_is_bounded_and_takes_whole_texts(spark):
    docs = spark.createDataFrame([(i, "a bad day. " * (i + 1)) for i in range(20)] + [(3, "a"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(5, 0), (6, 9)], "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, Training(sample_toxic=4, sample_clean=100, sample_bytes=165)).collect()
    assert sum(r.toxic for r in rows) <= 4 and all(len(r.text or "") <= 165 for r in rows) and len({(r.doc_id, r.toxic) for r in rows}) == len(rows)
    assert {r.doc_id: r.text for r in rows if r.toxic == 0}[4] == "a bad day. " * 5 and (5, 0) in {(r.doc_id, r.toxic) for r in rows}


def test_long_text_and_repeated_rows(spark, make_docs):
    model = Model(-1.0, {"bad": 5.0})
    texts = ["fine words here. " * 200_000 + "bad", "bad", "bad", "x" * 3_000_000]
    rows = score_toxicity(make_docs(texts), model).orderBy("doc_id").collect()
    assert [r.toxicity > 0.5 for r in rows] == [True, True, True, False] and rows[0].offending[0].start == len(texts[0]) - 4


def test_nulls_extra_columns_and_empty_table(spark, make_docs):
    model = Model(-1.0, {"bad": 5.0})
    docs = make_docs([None, "", "bad", "good"]).selectExpr("*", "'x' AS toxicity")
    rows = score_toxicity(docs, model).orderBy("doc_id").collect()
    assert [r.toxicity > 0.5 for r in rows] == [False, False, True, False] and rows[2].offending[0].end == 3
    assert score_toxicity(docs.limit(0), model).count() == 0


def test_query_uses_the_asked_fold(spark, tmp_path):
    import zlib

    texts = corpus(300)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = op9_query(spark, str(tmp_path)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and len(rows) == 300
    assert sum(r.predicted == texts[r.doc_id][1] for r in rows) > 290
    assert fold is not None
