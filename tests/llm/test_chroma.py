import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm.chroma import Chroma, align_recordings, chroma_image, filters, fingerprint, fingerprint_audio, op7_query, play, rerecorded


def test_integral_image_matches_plain_sums():
    how = Chroma()
    image = np.random.default_rng(1).random((24, 12))
    got = fingerprint(image, how)
    for t in range(len(got)):
        value = 0
        for kind, y, rows, width in filters(how):
            box = image[t : t + width, y : y + rows]
            inside = np.zeros(box.shape, bool)
            h, w = rows // 2, width // 2
            if kind == 1:
                inside[:, :h] = True
            elif kind == 2:
                inside[:w] = True
            elif kind == 3:
                inside[:w, :h] = inside[w:, h:] = True
            elif kind == 4:
                inside[:, rows // 3 : rows - rows // 3] = True
            else:
                inside[width // 3 : width - width // 3] = True
            x = np.log(box[inside].mean() + 0.01) - np.log(box[~inside].mean() + 0.01)
            level = int(x > -how.threshold) + int(x > 0) + int(x > how.threshold)
            value = (value << 2) | (level ^ (level >> 1))
        assert value == int(got[t])


def test_pitch_class_of_a_tone():
    how = Chroma()
    t = np.arange(how.rate) / how.rate
    for semitone in range(12):
        image = chroma_image(np.sin(2 * np.pi * 440 * 2 ** (semitone / 12) * t) * 9000, how)
        assert (image.argmax(axis=1) == semitone).all()


def least_errors(a, b, overlap=20):
    """The least share of differing bits over all offsets."""
    best = 1.0
    for off in range(-len(b) + overlap, len(a) - overlap + 1):
        x, y = a[max(off, 0) :], b[max(-off, 0) :]
        n = min(len(x), len(y))
        if n >= overlap:
            best = min(best, int(np.bitwise_count(x[:n] ^ y[:n]).sum()) / (32 * n))
    return best


def test_recall_against_brute_force(spark):
    """Second recordings from faint to very noisy, and strangers: the pairs found by votes are nearly all that an exhaustive alignment finds, also near the limit."""
    how, rng = Chroma(), np.random.default_rng(3)
    vectors = [rng.random(64) for _ in range(40)]
    audio = [np.frombuffer(play(v), "<i2").astype(float) for v in vectors]
    for i in range(40):
        cut = audio[i][how.hop * (i % 4) * 2 :]
        audio.append(cut + rng.normal(0, 300 * 1.08 ** i, len(cut)))
    audio.append(audio[0])
    rows = [(i, bytearray(np.clip(a, -32768, 32767).astype("<i2").tobytes())) for i, a in enumerate(audio)] + [(98, None), (99, bytearray(b"ab"))]
    printed = fingerprint_audio(spark.createDataFrame(rows, "rec_id long, pcm binary").selectExpr("*", "1 AS votes", "2 AS class_id", "3 AS digest")).cache()
    members, matches = align_recordings(printed, F.col("rec_id") < 40)
    assert {r.rec_id: r.class_id for r in members.collect() if r.rec_id in (0, 80, 98, 99)} == {0: 0, 80: 0, 98: None, 99: None}
    prints = {r.rec_id: np.array(r.prints, np.int64).astype(np.uint32) for r in printed.collect()}
    least = {(q, r): least_errors(prints[q], prints[r]) for q in range(40) for r in range(80) if q != r}
    want = {pair for pair, e in least.items() if e <= 0.15}
    near = {pair for pair in want if least[pair] > 0.08}
    got = {(r.query_class, r.class_id): r for r in matches.collect()}
    print("pairs", len(want), "found", len(want & set(got)), "near the limit", len(near), "found", len(near & set(got)))
    assert len(want) >= 20 and len(near) >= 5 and set(got) <= want
    assert len(want & set(got)) >= 0.95 * len(want) and len(near & set(got)) >= 0.8 * len(near)
    for (q, r), row in got.items():
        assert row.error_rate == pytest.approx(least[q, r])
        if r == 40 + q and row.error_rate < 0.1:
            assert abs(row.offset - (q % 4) * 2) <= 1


def test_query_aligns_second_recordings(spark, tmp_path):
    """Recall as the query reports it, held against an alignment of every query with every recording."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.random(64)]) for i in range(0, 400, 10)] + [(7, None), (9, []), (11, [1.0] * 64), (13, [1.0] * 64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = op7_query(spark, str(tmp_path)).collect()
    recall = next(r for r in found if r.part == "recall")
    assert recall.n_prints == 8 and recall.share == recall.overlap / 8 >= 0.9
    class_of = {r.vec_id: r.class_id for r in found if r.part == "member"}
    assert len(class_of) == 44 + 8 and class_of[7] is None and class_of[13] == 11
    pairs = {(r.query_class, r.class_id) for r in found if r.part == "match"}
    audio = {i: play(np.array(v or [])) for i, v in rows}
    audio |= {-1 - i: rerecorded(audio[i], i) for i in list(audio) if i % 50 == 0}
    prints = {i: fingerprint(chroma_image(np.frombuffer(p, "<i2"), Chroma()), Chroma()) for i, p in audio.items() if len(p)}
    want = {(q, r) for q in prints for r in prints if q >= 0 and q % 50 == 0 and q != r and r != 13 and least_errors(prints[q], prints[r]) <= 0.15}
    assert pairs <= want and len(pairs) >= 0.9 * len(want) and len(want) >= 7


def test_long_recording(spark):
    """Ten minutes of sound in blocks of frames."""
    samples = np.tile(np.frombuffer(play(np.arange(64.0)), "<i2"), 38)
    rows = fingerprint_audio(spark.createDataFrame([(1, bytearray(samples.tobytes()))], "rec_id long, pcm binary")).collect()
    assert len(rows[0].prints) == len(chroma_image(samples, Chroma())) - Chroma().widest + 1 > 4000


def test_empty_table(spark):
    printed = fingerprint_audio(spark.createDataFrame([], "rec_id long, pcm binary, prints int"))
    members, matches = align_recordings(printed, F.lit(True))
    assert members.count() == 0 and matches.count() == 0
