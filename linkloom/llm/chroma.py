"""Chroma fingerprints of recordings, and their alignment.

Fingerprint. Overlapping frames of a recording are folded onto the twelve pitch classes. Over this
image of 12 rows, sixteen filters compare areas by sums from an integral image; each answer is cut at
three thresholds into two Gray-coded bits, and the sixteen make one 32-bit integer per place.

Alignment. Recordings with one and the same fingerprint are a class, and only classes are compared. A place's key is its
integer and the first eight bits of the next one, which chance shares far less often than the integer alone. A key that places of a query's class and of another
class share votes for the offset between the two places. Every offset with a vote is judged by the share of differing bits over the whole overlap, and the best one counts.

Fingerprints are made row by row in Python; classes, votes and bit errors are joins and aggregates. A
value that very many classes hold is a skewed key of a join whose two sides are written tables, so that
Spark can split it; copies do not add to it, as they are one class.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, tune


@dataclass(frozen=True)
class Chroma:
    """Frames of ``frame`` samples every ``hop``; pitches between ``low`` and ``high`` Hz count."""

    rate: int = 5512
    frame: int = 2048
    hop: int = 683
    low: float = 60.0
    high: float = 2400.0
    widest: int = 16
    threshold: float = 0.25


def filters(how: Chroma) -> list[tuple[int, int, int, int]]:
    """(kind, first row, rows, columns) of the sixteen filters, by rule: kinds in turn, rows spread by fifths, widths from 3 to the widest."""
    out = []
    for i in range(16):
        kind = 1 + i % 5
        rows = 3 + (i * 2) % 10 if kind != 4 else 3 + 3 * (i % 3)
        rows = max(2, rows)
        out.append((kind, (i * 7) % (12 - rows + 1), rows, 3 + (i * 4) % (how.widest - 2)))
    return out


def chroma_image(samples: np.ndarray, how: Chroma) -> np.ndarray:
    """Rows of pitch classes of length one per frame; silence gives zero rows."""
    if len(samples) < how.frame:
        return np.zeros((0, 12))
    window, first, last, fold = _folding(how)
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), how.frame)[:: how.hop]
    image = np.empty((len(frames), 12))
    for a in range(0, len(frames), 256):
        spectrum = np.fft.rfft(frames[a : a + 256] * window, axis=1)[:, first:last]
        image[a : a + 256] = np.sqrt((spectrum.real**2 + spectrum.imag**2).astype(np.float64) @ fold)
    size = np.linalg.norm(image, axis=1, keepdims=True)
    return np.where(size > 1e-6, image / np.maximum(size, 1e-6), 0.0)


@functools.cache
def _folding(how: Chroma) -> tuple[np.ndarray, int, int, np.ndarray]:
    """The window, the spectrum's used places, and which pitch class each belongs to."""
    pitch = np.fft.rfftfreq(how.frame, 1 / how.rate)
    use = np.flatnonzero((pitch >= how.low) & (pitch <= how.high))
    fold = np.zeros((len(use), 12))
    fold[np.arange(len(use)), np.round(12 * np.log2(pitch[use] / 440.0)).astype(int) % 12] = 1
    return np.hanning(how.frame).astype(np.float32), int(use[0]), int(use[-1]) + 1, fold


def fingerprint(image: np.ndarray, how: Chroma) -> np.ndarray:
    """One unsigned 32-bit integer per place where the widest filter fits."""
    n = len(image) - how.widest + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t0: int, y0: int, t1: int, y1: int) -> np.ndarray:
        return total[at + t1, y1] - total[at + t0, y1] - total[at + t1, y0] + total[at + t0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, rows, width in filters(how):
        h, w = rows // 2, width // 2
        if kind == 1:  # upper against lower rows
            part, cells = area(0, y, width, y + h), h * width
        elif kind == 2:  # earlier against later columns
            part, cells = area(0, y, w, y + rows), w * rows
        elif kind == 3:  # opposite quarters
            part, cells = area(0, y, w, y + h) + area(w, y + h, width, y + rows), w * h + (width - w) * (rows - h)
        elif kind == 4:  # middle rows against the rest
            part, cells = area(0, y + rows // 3, width, y + rows - rows // 3), (rows - 2 * (rows // 3)) * width
        else:  # middle columns against the rest
            part, cells = area(width // 3, y, width - width // 3, y + rows), (width - 2 * (width // 3)) * rows
        rest = area(0, y, width, y + rows) - part
        answer = np.log(np.maximum(part, 0) / cells + 0.01) - np.log(np.maximum(rest, 0) / (rows * width - cells) + 0.01)
        level = (answer > -how.threshold).astype(np.uint32) + (answer > 0) + (answer > how.threshold)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1))).astype(np.uint32)
    return out


def fingerprint_audio(recordings: DataFrame, how: Chroma = Chroma(), pcm_col: str = "pcm") -> DataFrame:
    """Replaces the column of little-endian signed 16-bit mono samples by ``prints`` (array of int, as signed 32-bit).

    Null, empty and too short recordings have no integers. Rows are independent; a column named prints is replaced.
    """
    tune(recordings.sparkSession)
    recordings = recordings.drop("prints")
    place = recordings.columns.index(pcm_col)
    kept = recordings.drop(pcm_col)
    schema = T.StructType([*kept.schema.fields, T.StructField("prints", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            found = []
            for raw in batch.column(place).to_pylist():
                raw = raw or b""
                samples = np.frombuffer(raw[: len(raw) // 2 * 2], "<i2")
                found.append(fingerprint(chroma_image(samples, how), how).view(np.int32).tolist())
            columns = [c for i, c in enumerate(batch.columns) if i != place]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(pa.int32()))], names=schema.names)

    return recordings.mapInArrow(run, schema)


def align_recordings(printed: DataFrame, is_query: Column, id_col: str = "rec_id", min_votes: int = 1, min_overlap: int = 20, max_error: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """(members, matches) from rows (id_col, prints).

    ``members``: id_col, class_id (the smallest id with the same fingerprint), n_prints, of every row; an id that repeats comes once per row.
    ``matches``: query_class, class_id, offset (places that the class starts after the query), overlap, votes, bit_errors, error_rate: of
    every class with a query against every other class, at the offset with the least error rate (then the longest overlap, the least offset).
    Rows without integers, and with a null id, are members of no class. Other columns than id_col and prints are not read, so their names can't clash.
    A pair within max_error without min_votes equal keys at its offset is missed; tests measure that against all offsets.
    """
    rows = printed.select(F.col(id_col).alias("rec"), "prints", F.coalesce(is_query, F.lit(False)).alias("asked"), F.when((F.size("prints") > 0) & F.col(id_col).isNotNull(), F.sha2(F.array_join("prints", ","), 256)).alias("digest"))
    rows = cut(rows, "prints")
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("rec").alias("class_id"), F.max("asked").alias("asked"), F.first("prints").alias("prints"))
    classes = cut(classes, "classes")
    members = rows.join(classes.select("digest", "class_id"), "digest", "left").select(F.col("rec").alias(id_col), "class_id", F.size("prints").cast("long").alias("n_prints"))
    # Silence repeats one value: of a run of equal values the first place votes.
    unsigned = lambda x: x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    key = lambda x, i: F.shiftleft(unsigned(x), 8).bitwiseOR(F.shiftright(unsigned(F.element_at("prints", F.least(i + 2, F.size("prints")))), 24))
    places = classes.select("class_id", "asked", F.posexplode(F.transform("prints", lambda x, i: F.when((i == 0) | (x != F.element_at("prints", F.greatest(i, F.lit(1)))), key(x, i)))).alias("at", "value")).where("value IS NOT NULL")
    held = cut(places.select("class_id", "asked", "at", "value"), "places")
    asked = held.where("asked").select(F.col("class_id").alias("query_class"), F.col("at").alias("query_at"), "value")
    votes = held.select("class_id", "at", "value").join(asked, "value").where("class_id <> query_class")
    counted = votes.groupBy("query_class", "class_id", (F.col("query_at") - F.col("at")).alias("offset")).agg(F.count("*").alias("votes")).where(F.col("votes") >= min_votes)
    pairs = counted.join(classes.select(F.col("class_id").alias("query_class"), F.col("prints").alias("q")), "query_class").join(classes.select("class_id", F.col("prints").alias("r")), "class_id")
    start_q, start_r = F.greatest("offset", F.lit(0)), F.greatest(-F.col("offset"), F.lit(0))
    overlap = F.least(F.size("q") - start_q, F.size("r") - start_r)
    judged = pairs.withColumn("overlap", overlap).where(F.col("overlap") >= min_overlap)
    both = F.arrays_zip(F.slice("q", start_q + 1, F.col("overlap")).alias("a"), F.slice("r", start_r + 1, F.col("overlap")).alias("b"))
    errors = F.aggregate(both, F.lit(0).cast("long"), lambda n, x: n + F.bit_count(x["a"].bitwiseXOR(x["b"]).cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))))
    judged = judged.withColumn("bit_errors", errors).withColumn("error_rate", F.col("bit_errors") / (F.col("overlap") * 32)).where(F.col("error_rate") <= max_error)
    best = judged.groupBy("query_class", "class_id").agg(F.min(F.struct("error_rate", (-F.col("overlap")).alias("longest"), "offset", "overlap", "votes", "bit_errors")).alias("b"))
    return members, best.select("query_class", "class_id", *[f"b.{c}" for c in ("offset", "overlap", "votes", "bit_errors", "error_rate")])


@functools.cache
def _tones(how: Chroma, n: int) -> np.ndarray:
    t = np.arange(n) / how.rate
    return (np.sin(2 * np.pi * 220.0 * 2 ** (np.arange(36)[:, None] / 12) * t[None, :]) * 9000).astype("<i2")


def play(vector: np.ndarray, how: Chroma = Chroma()) -> bytes:
    """A vector as a recording: each value a tone of two hops, its rank among the values choosing one of 36 semitones."""
    if not len(vector):
        return b""
    steps = np.argsort(np.argsort(vector, kind="stable"), kind="stable") * 36 // len(vector)
    return _tones(how, 2 * how.hop)[steps].tobytes()


def rerecorded(pcm: bytes, seed: int, how: Chroma = Chroma()) -> bytes:
    """The recording as another microphone has it: from a later place, cut short, softer or louder, with noise; all by the seed."""
    samples = np.frombuffer(pcm, "<i2").astype(np.float32)
    rng = np.random.default_rng(seed)
    late = int(rng.integers(0, 20)) * how.hop + int(rng.integers(0, how.hop // 8))
    early = int(rng.integers(0, 20)) * how.hop
    some = samples[late : max(late, len(samples) - early)]
    heard = some * rng.uniform(0.4, 1.2) + rng.normal(0, rng.uniform(100, 1500), len(some))
    return np.clip(heard, -32768, 32767).astype("<i2").tobytes()


def op7_query(spark, sf_dir: str) -> DataFrame:
    """Every row of ``embeddings`` played as a recording; every row with an id divisible by 50 also as a second recording, later, cut, softer and noisy.

    All are fingerprinted and put in classes; rows with an id divisible by 50 are searched for in all. One row per recording
    (part 'member'; second recordings have vec_id -1 - id), one per pair of aligned classes (part 'match'), and one (part 'recall') with the
    number of second recordings long enough to be aligned (n_prints) and of those aligned with the first one (overlap), also as a share.
    """
    tune(spark)

    def played(batches):
        for batch in batches:
            ids, vectors = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(vectors), 64):
                rows = []
                for i, v in zip(ids[a : a + 64], vectors[a : a + 64], strict=True):
                    pcm = play(np.array([x or 0.0 for x in v or ()]))
                    rows.append((i, pcm))
                    if i is not None and i % 50 == 0:
                        rows.append((-1 - i, rerecorded(pcm, abs(i))))
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.binary())], names=["vec_id", "pcm"])

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    printed = fingerprint_audio(vectors.mapInArrow(played, "vec_id long, pcm binary"))
    members, matches = align_recordings(printed, (F.col("vec_id") >= 0) & (F.col("vec_id") % 50 == 0), "vec_id")
    members, matches = cut(members, "members"), cut(matches, "matches")
    second = members.where("vec_id < 0 AND n_prints >= 20").select("class_id", (-1 - F.col("vec_id")).alias("vec_id"))
    found = second.join(members.select("vec_id", F.col("class_id").alias("query_class")), "vec_id").join(matches.select("query_class", "class_id", F.lit(1).alias("hit")), ["query_class", "class_id"], "left")
    none = F.lit(None)
    one = members.select(F.lit("member").alias("part"), "vec_id", "class_id", "n_prints", none.cast("long").alias("query_class"), none.cast("int").alias("offset"), none.cast("int").alias("overlap"), none.cast("long").alias("bit_errors"), none.cast("double").alias("share"))
    two = matches.select(F.lit("match").alias("part"), none.cast("long").alias("vec_id"), "class_id", none.cast("long").alias("n_prints"), "query_class", "offset", "overlap", "bit_errors", none.cast("double").alias("share"))
    hits = F.count_if((F.col("hit") == 1) | (F.col("query_class") == F.col("class_id")))
    three = found.agg(F.count("*").alias("n_prints"), hits.cast("int").alias("overlap")).select(
        F.lit("recall").alias("part"), none.cast("long").alias("vec_id"), none.cast("long").alias("class_id"), "n_prints", none.cast("long").alias("query_class"), none.cast("int").alias("offset"), "overlap", none.cast("long").alias("bit_errors"), (F.col("overlap") / F.nullif("n_prints", F.lit(0))).alias("share")
    )
    return one.unionByName(two).unionByName(three)
