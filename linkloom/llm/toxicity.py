"""Toxicity by multiple-instance learning.

A document is a bag of sentences; labels are known for documents only. A sentence's score is a
logistic function of its words; a document's is the noisy-or of its sentences: it is toxic unless
none of them is. The gradient of the documents' likelihood reaches the sentences through the
noisy-or: a sentence of a toxic document counts as toxic as far as no other explains the label. So the
trained sentence scores also tell which sentences offend.

Features of a word are the word and its first 4, 5 and 6 letters. A word's weights are summed once
and cached, so scoring a text is a lookup per word; rows are independent and nothing is shuffled.

Training takes a bounded sample of labelled rows (``sample_toxic`` and ``sample_clean``, the rows that come
first by hash, of texts up to ``sample_bytes``). Their texts stay on the executors; the driver gets numbers of documents by feature,
and then the places of the chosen features. The candidate features are those seen in at
least ``min_docs`` toxic documents and ``min_lift`` times as often there as in clean ones; an L1
penalty then keeps few of them. A sentence without any of them is no evidence and scores 0, so that
the mere number of sentences makes no document toxic. The model that is broadcast has at most ``max_features`` weights.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, cut, steady, text_blocks, tune

_SENTENCE = re.compile(r"[^.!?\n]+")
_EDGES = "\"'`,;:()[]{}<>|*#-_+=~/\\&%$@^"


@dataclass(frozen=True)
class Training:
    sample_toxic: int = 4000
    sample_clean: int = 8000
    sample_bytes: int = 1_000_000
    min_docs: int = 3
    min_lift: float = 4.0
    max_features: int = 50_000
    penalty: float = 0.4
    rounds: int = 300


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]

    def word(self, token: str) -> float:
        """The sum of the weights of a token's features."""
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(token))


def features(token: str) -> list[str]:
    """The lower-cased word without marks around it, and its first letters."""
    word = token.lower().strip(_EDGES)
    return [word, *[f"^{word[:n]}" for n in (4, 5, 6) if len(word) >= n]] if word else []


def sentences(text: str) -> list[tuple[int, int]]:
    """Code point spans of the sentences that have a word."""
    return [m.span() for m in _SENTENCE.finditer(text) if not m.group().isspace()]


def chosen_features(in_toxic: dict[str, int], in_clean: dict[str, int], n_toxic: int, n_clean: int, how: Training = Training()) -> list[str]:
    """The features that a model may weigh, from the numbers of toxic and clean documents that have them."""
    lift = {f: (n / max(1, n_toxic)) / ((in_clean.get(f, 0) + 0.5) / (n_clean + 1)) for f, n in in_toxic.items() if n >= how.min_docs}
    return sorted((f for f, x in lift.items() if x >= how.min_lift), key=lambda f: (-in_toxic[f], f))[: how.max_features]


def placed_features(text: str, placed) -> list[list[int]]:
    """The chosen features of each sentence that has any, as sorted places."""
    found = ({i for t in text[a:b].split() for i in placed[t]} for a, b in sentences(text))
    return [sorted(x) for x in found if x]


def places(chosen: list[str]) -> Memo:
    place = {f: i for i, f in enumerate(chosen)}
    return Memo(lambda t: tuple(place[f] for f in features(t) if f in place), 200_000)


def fit(chosen: list[str], bags: list[tuple[int, list[list[int]]]], how: Training = Training()) -> Model:
    """Weights from (label, placed features of its sentences) of each document, by the noisy-or's gradient."""
    if not chosen:
        return Model(-8.0, {})
    owner, row_of, col = array("q"), array("q"), array("q")
    for d, (_, bag) in enumerate(bags):
        for here in bag:
            row_of.extend([len(owner)] * len(here))
            col.extend(here)
            owner.append(d)
    label = np.array([y for y, _ in bags], float)
    owner, row_of, col = (np.array(x, np.int64) for x in (owner, row_of, col))
    n, width = len(owner), len(chosen)
    weight, bias = np.zeros(width), -4.0
    per_sentence = max(1.0, len(col) / n)
    scale = 1.0 / (0.25 * per_sentence * np.bincount(col, minlength=width) + 1.0)
    for _ in range(how.rounds):
        z = bias + np.bincount(row_of, weight[col], n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-9)), len(bags)))
        pull = np.where(label[owner] == 1, p * (none / np.maximum(1 - none, 1e-9))[owner], -p)
        gradient = np.bincount(col, pull[row_of], width)
        weight += scale * gradient
        weight = np.sign(weight) * np.maximum(np.abs(weight) - how.penalty * scale, 0)
        bias = float(np.clip(bias + pull.sum() / (0.25 * n + 1), -12.0, -1.0))
    return Model(bias, {f: float(w) for f, w in zip(chosen, weight, strict=True) if w})


def train(sample: DataFrame, how: Training = Training(), text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from rows (text, label 0 or 1). Without rows of both labels every sentence scores low.

    Texts stay on the executors: they are read there for the numbers of documents per feature, and again for the chosen features' places, which
    are all that the driver gets. Null texts and texts without a sentence don't count; the order of rows has no say.
    """
    tune(sample.sparkSession)
    rows = sample.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("toxic"))

    def counted(batches):
        known = Memo(features, 200_000)
        for batch in batches:
            held = (Counter(), Counter())
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if tokens := {t for a, b in sentences(text) for t in text[a:b].split()}:
                    held[y].update({f for t in tokens for f in known[t]})
                    held[y][""] += 1  # no feature is empty: the documents themselves
            flat = [(f, n if y else 0, 0 if y else n) for y in (0, 1) for f, n in held[y].items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["feature", "n_toxic", "n_clean"])

    counts = rows.mapInArrow(counted, "feature string, n_toxic long, n_clean long").groupBy("feature").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))
    # The features that may be chosen are a share of the vocabulary: the least numbers are asked for before anything moves to the driver.
    some = counts.where((F.col("feature") == "") | (F.col("n_toxic") >= how.min_docs)).orderBy(F.col("feature") != "", F.desc("n_toxic"), "feature")
    totals = some.limit(1).where("feature = ''").first()
    if totals is None:
        return Model(-8.0, {})
    lift = F.expr(f"(n_toxic / {max(1, totals.n_toxic)}D) / ((n_clean + 0.5D) / {totals.n_clean + 1}D)")
    found = some.where((F.col("feature") != "") & (lift >= how.min_lift)).limit(how.max_features).collect()
    chosen = chosen_features({r.feature: r.n_toxic for r in found}, {r.feature: r.n_clean for r in found}, totals.n_toxic, totals.n_clean, how)

    def bagged(batches):
        placed = places(chosen)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            bags = [placed_features(t, placed) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(bags, pa.list_(pa.list_(pa.int32())))], names=["toxic", "bag"])

    bags = rows.mapInArrow(bagged, "toxic int, bag array<array<int>>").where("size(bag) > 0").toArrow()
    pairs = zip(bags.column("toxic").to_pylist(), bags.column("bag").to_pylist(), strict=True)
    return fit(chosen, sorted(pairs), how)


def score_text(text: str, word, bias: float) -> tuple[float, list[tuple[int, int, float]]]:
    """Noisy-or of the sentences, and (start, end, score) of each sentence with a score of a half or more."""
    quiet, found = 0.0, []
    for a, b in sentences(text):
        z = sum(map(word, text[a:b].split()))
        if not z:
            continue
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + z))))
        quiet += math.log1p(-min(p, 1 - 1e-12))
        if p >= 0.5:
            found.append((a, b, p))
    return abs(math.expm1(quiet)), found


_LOCATED = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
_ARROW_LOCATED = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds ``toxicity`` (0 to 1) and ``offending`` (array of start, end, score) to every row; columns of those names are replaced.

    Null and empty texts have no sentences and score 0. Rows are independent: repeated rows and ids each get their own score, and very long
    texts are read by sentence. An empty table gives none. The model is bounded by its training parameters.
    """
    tune(docs.sparkSession)
    docs = docs.drop("toxicity", "offending")
    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType()), T.StructField("offending", _LOCATED)])
    place = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    def run(batches):
        bias, weights = sent.value
        word = Memo(Model(bias, weights).word, 400_000).__getitem__
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            for a, b in text_blocks(texts):
                with steady():
                    scored = [score_text(t, word, bias) for t in texts[a:b]]
                located = [[{"start": x, "end": y, "score": p} for x, y, p in found] for _, found in scored]
                columns = [*batch.slice(a, b - a).columns, pa.array([s for s, _ in scored], pa.float64()), pa.array(located, _ARROW_LOCATED)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, how: Training) -> DataFrame:
    """(doc_id, text, toxic) of the sampled rows: chosen by id among the labels, then read from the documents.

    The ids are at most ``sample_toxic + sample_clean``, so they may be broadcast. Of rows that repeat an id the least text
    counts; an id with both labels comes with each.
    """
    ranked = labels.where("toxic IN (0, 1)").select("doc_id", "toxic").distinct().withColumn("turn", F.xxhash64("doc_id"))
    some = [ranked.where(F.col("toxic") == y).orderBy("turn", "doc_id").limit(n) for y, n in ((1, how.sample_toxic), (0, how.sample_clean))]
    chosen = some[0].union(some[1]).select("doc_id", "toxic")
    rows = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= how.sample_bytes).join(F.broadcast(chosen), "doc_id")
    return cut(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "sample")


def op9_query(spark, sf_dir: str, how: Training = Training()) -> DataFrame:
    """Scores every document with a model learnt from labelled rows outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), 5) != 0)
    model = train(labelled_sample(docs, labels, how), how)
    scored = score_toxicity(docs, model)
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        F.size("offending").cast("long").alias("n_offending"),
    )
