import hashlib
import os
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkloom.llm.bpe import RankArrayBPE, TextCodec, decode_bpe, encode_bpe, op10_query

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(5)
    pools = ["abcdefgh ", "aeiou tnsr'\n", "äöüßéèñ çÉÄ ", "0123456789 .,;|", "жщя ΑΣσΩ İıǅ", "日本語 テキスト", "\x00\x1c\x1f\x85  ​﻿ ab", "éä̸<> ", "\U0001f600\U00010348 👍🏽"]
    made = ["", " ", "\n\t ", "don't we'll I'VE 'street", "<|endoftext|>", "a<|startoftext|>B<|endoftext|><|endoftext|", "x" * 300, "ab" * 5000, "ΑΣ Σ ΣΑΣ", "ﬁ ½ ²"]
    for _ in range(400):
        pool = "".join(rng.sample(pools, rng.randint(1, 3)))
        made.append("".join(rng.choice(pool) for _ in range(rng.randint(1, 200))))
    return made


def test_ids_and_decoded_text_match_the_library(library):
    codec = TextCodec(PATH)
    for text, ids in zip(texts(), codec.run(texts()), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        got = [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)]
        assert got == want, repr(text)
        assert codec.bpe.decoder.text(ids) == library.decode(want, skip_special_tokens=False), repr(text)


def test_heap_and_matrix_agree():
    bpe = RankArrayBPE(PATH)
    rng = random.Random(3)
    for _ in range(200):
        word = "".join(rng.choice("thenaioär") for _ in range(rng.randint(1, 40))).encode()
        assert bpe._short([word])[0] == bpe._long(word)


def test_rows_nulls_extra_columns_and_empty_table(spark, make_docs, library):
    docs = make_docs([None, "", "Same text", "Same text"]).selectExpr("*", "'old' AS bpe_ids", "1 AS extra")
    rows = decode_bpe(encode_bpe(docs, PATH).withColumn("bpe_decoded", F.lit(1)), PATH).orderBy("doc_id").collect()
    assert [r.bpe_n_tokens for r in rows] == [0, 0, 2, 2]
    assert [r.bpe_decoded for r in encode_bpe(docs, PATH, decode=True).orderBy("doc_id").collect()] == [r.bpe_decoded for r in rows]
    assert rows[0].bpe_ids == b"" and rows[0].bpe_decoded == "" and rows[2].extra == 1
    want = b"".join(i.to_bytes(4, "little") for i in library.encode("Same text", add_special_tokens=False).ids)
    assert hashlib.sha256(bytes(rows[2].bpe_ids)).digest() == hashlib.sha256(want).digest()
    assert decode_bpe(encode_bpe(docs.limit(0), PATH), PATH).count() == 0


def test_stored_ids_decode(spark, library):
    """Ids from elsewhere: null, a cut id, ids beyond the vocabulary, a long text."""
    long = library.encode("the thing " * 30_000, add_special_tokens=False).ids
    packs = [None, b"", b"\x05", *[b"".join(i.to_bytes(4, "little") for i in ids) for ids in ([5, 4_000_000_000, 6], long)]]
    rows = spark.createDataFrame([(i, bytearray(p) if p is not None else None) for i, p in enumerate(packs)], "n int, ids binary")
    got = [r.bpe_decoded for r in decode_bpe(rows, PATH, "ids").orderBy("n").collect()]
    assert got == ["", "", "", library.decode([5, 6], skip_special_tokens=False), library.decode(long, skip_special_tokens=False)]


def test_query_matches_the_library(spark, library):
    """Every row of the smallest tables."""
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("needs the driver's tables")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op10_query(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
