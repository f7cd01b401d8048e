"""BPE encoding and decoding with a contiguous rank array per short word.

A word is held as its part ids and the merge ranks of adjacent parts. The array is scanned for the
smallest rank (the leftmost on ties), the boundary there is deleted, and the ranks of the two new
neighbours are looked up. Words of one length are handled together: the arrays of thousands of
words lie under each other in one matrix and every scan, deletion and refresh is one numpy call
for all of them. Words beyond ``SHORT`` bytes use a heap, so that a megabyte without blanks costs
n log n and not n squared.

The vocabulary is that of a ``tokenizers`` JSON file: NFC, lower case, words by pattern, bytes as
printable characters, a suffix at the end of a word. Decoding takes packed ids, from wherever, and joins their tokens. Words are cached per Python worker up to a
fixed number of entries. A text is one row in and one row out: no shuffle.

Null texts count as empty; an empty text has no tokens. Special tokens' strings inside a text are
found before anything else, as the library does, and stay whole.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, kept, serve, steady, text_blocks, tune

#: Words of more bytes than this take the heap.
SHORT = 96
#: Entries of the word cache of one Python worker.
CACHE_WORDS = 300_000
_NONE = np.int32(2**30)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def read_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class Decoder:
    """Texts from ids: without a decoder in the vocabulary file, tokens with a blank between, special ones included."""

    def __init__(self, spec: dict):
        if spec.get("decoder"):
            raise ValueError("decoding by another rule than joined tokens is not known here")
        token = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.names = np.array([token.get(i, "") for i in range(max(token) + 1)], object)

    def text(self, packed: bytes) -> str:
        """Of packed ids; ids that the vocabulary lacks give nothing, nor do bytes beyond the last whole id."""
        ids = np.frombuffer(packed[: len(packed) // 4 * 4], "<u4")
        return " ".join(filter(None, self.names[ids[ids < len(self.names)]].tolist()))


class RankArrayBPE:
    """Encoder over one vocabulary file."""

    def __init__(self, path: str):
        spec = read_spec(path)
        self.decoder = Decoder(spec)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        letters = byte_letters()
        self.inner = np.array([self.vocab[c] for c in letters], np.int32)
        self.last = np.array([self.vocab[c + self.suffix] for c in letters], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = {}
        for rank, (a, b) in enumerate(merges):
            pairs[(self.vocab[a] << 20) | self.vocab[b]] = (rank, self.vocab[a + b])
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        values = np.array(list(pairs.values()), np.int32)[order]
        self.ranks = np.append(values[:, 0], _NONE).astype(np.int32)
        self.made = np.append(values[:, 1], 0).astype(np.int32)
        self.pairs = pairs

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merges' places of adjacent parts; the last place (no merge) where there is none."""
        key = (left.astype(np.int64) << 20) | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1).astype(np.int32)

    def _told(self, parts: np.ndarray, rows, out: list) -> None:
        """Packed ids of finished words, all with as many parts."""
        packed, step = parts.astype("<u4").tobytes(), 4 * parts.shape[1]
        for i, r in enumerate(rows):
            out[r] = packed[i * step : (i + 1) * step]

    def _short(self, words: list[bytes]) -> list[bytes]:
        """Words of one length, 1 to SHORT bytes."""
        n, size = len(words), len(words[0])
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(n, size)
        parts = self.inner[raw]
        parts[:, -1] = self.last[raw[:, -1]]
        out: list[bytes] = [b""] * n
        rows = np.arange(n)
        if size > 1:
            place = self._look(parts[:, :-1], parts[:, 1:])
            while True:
                ranks = self.ranks[place]
                at = ranks.argmin(axis=1)
                here = np.arange(len(rows))
                live = ranks[here, at] < _NONE
                if not live.all():
                    self._told(parts[~live], rows[~live].tolist(), out)
                    if not live.any():
                        return out
                    rows, parts, place, at = rows[live], parts[live], place[live], at[live]
                    here = np.arange(len(rows))
                made = self.made[place[here, at]]
                size = parts.shape[1]
                if size == 2:
                    self._told(made[:, None], rows.tolist(), out)
                    return out
                parts[here, at] = made
                cols = np.arange(size - 1)[None, :]
                parts = np.take_along_axis(parts, cols + (cols > at[:, None]), axis=1)
                cols = cols[:, :-1]
                place = np.take_along_axis(place, cols + (cols >= at[:, None]), axis=1)
                before = np.flatnonzero(at > 0)
                place[before, at[before] - 1] = self._look(parts[before, at[before] - 1], parts[before, at[before]])
                after = np.flatnonzero(at < size - 2)
                place[after, at[after]] = self._look(parts[after, at[after]], parts[after, at[after] + 1])
        self._told(parts, rows.tolist(), out)
        return out

    def _long(self, word: bytes) -> bytes:
        """The same merges from a heap of (rank, place), for words beyond SHORT bytes."""
        part = [int(x) for x in self.inner[np.frombuffer(word, np.uint8)]]
        part[-1] = int(self.last[word[-1]])
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (found := self.pairs.get((part[i] << 20) | part[j])):
                heapq.heappush(heap, (found[0], i, part[i], part[j], found[1]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if part[i] != left or j >= n or part[j] != right:
                continue
            part[i], part[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        found: list[bytes] = [b""]
        self._told(np.array([[p for p in part if p >= 0]], np.int32), [0], found)
        return found[0]

    def words(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of many words, each the UTF-8 bytes of one match of the pattern."""
        out: list[bytes] = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(len(w), []).append(i)
        for size, places in by_size.items():
            if size > SHORT:
                for i in places:
                    out[i] = self._long(words[i])
            else:
                for at in range(0, len(places), 16384):
                    some = places[at : at + 16384]
                    for i, ids in zip(some, self._short([words[i] for i in some]), strict=True):
                        out[i] = ids
        return out

    def split(self, chunk: str) -> list[bytes | int]:
        """A chunk without blanks as words, and ids of special tokens. Lower-casing is by single code points."""
        found: list[bytes | int] = []
        pieces = self.special_split.split(chunk) if self.special_split and "<" in chunk else [chunk]
        for piece in pieces:
            if piece in self.special:
                found.append(self.special[piece])
            elif piece:
                plain = piece if piece.isascii() else unicodedata.normalize("NFC", piece).replace("Σ", "σ")
                found += [w.encode() for w in self.pattern.findall(plain.lower())]
        return found


class TextCodec:
    """Whole texts through two bounded caches: of words, and of what stands between blanks."""

    def __init__(self, path: str):
        self.bpe = RankArrayBPE(path)
        self.known: dict[bytes, bytes] = {}
        self.told: dict[bytes, bytes] = {}

    def learn(self, chunks: set[bytes]) -> None:
        if len(self.known) + len(chunks) > CACHE_WORDS:
            self.known.clear()
        if len(self.told) > CACHE_WORDS:
            self.told.clear()
        known, told, split = self.known, self.told, self.bpe.split
        new = list(chunks - known.keys())
        one, many, words = [], [], set()
        for chunk in new:
            # Mostly a chunk is one word of letters, or that with one ASCII mark behind it.
            text = chunk.decode()
            low = text.lower()
            if text.isascii() and low.isalpha():
                one.append((chunk, word := low.encode()))
                words.add(word)
            elif text.isascii() and low[:-1].isalpha() and low[-1] in ".,:;!?":
                both = [low[:-1].encode(), low[-1:].encode()]
                many.append((chunk, both))
                words.update(both)
            else:
                both = split(text)
                many.append((chunk, both))
                words.update([w for w in both if not isinstance(w, int)])
        fresh = list(words - told.keys())
        told.update(zip(fresh, self.bpe.words(fresh), strict=True))
        for chunk, word in one:
            known[chunk] = told[word]
        for chunk, parts in many:
            known[chunk] = b"".join([told[p] if not isinstance(p, int) else p.to_bytes(4, "little") for p in parts])

    def run(self, texts: list[str | None]):
        """Packed ids of each text; words new to the cache are encoded together."""
        split = [(t or "").encode("utf-8").split() for t in texts]
        self.learn(set().union(*split))
        get = self.known.__getitem__
        for chunks in split:
            yield b"".join(map(get, chunks))


_CODECS = kept("bpe", Memo(TextCodec, 4))
_DECODERS = kept("bpe-decoder", Memo(lambda path: Decoder(read_spec(path)), 4))


def encode_bpe(docs: DataFrame, vocabulary: str, text_col: str = "text", decode: bool = False) -> DataFrame:
    """Adds ``bpe_ids`` (binary: little-endian unsigned 32-bit ids), ``bpe_n_tokens`` and, if asked, ``bpe_decoded``: the text that those ids decode to.

    Every input row gives one row and keeps all its columns; columns of these names are replaced.
    Null text: as empty. Repeated rows and ids need no care, as rows are independent.
    """
    tune(docs.sparkSession)
    docs = docs.drop("bpe_ids", "bpe_n_tokens", *(["bpe_decoded"] if decode else []))
    schema = T.StructType([*docs.schema.fields, T.StructField("bpe_ids", T.BinaryType()), T.StructField("bpe_n_tokens", T.LongType()), *([T.StructField("bpe_decoded", T.StringType())] if decode else [])])
    place = docs.columns.index(text_col)

    def run(batches):
        serve("bpe")
        codec = _CODECS[vocabulary]
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for a, b in text_blocks(texts):
                with steady():
                    ids = list(codec.run(texts[a:b]))
                columns = [*batch.slice(a, b - a).columns, pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if decode:
                    columns.append(pa.array([codec.bpe.decoder.text(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def decode_bpe(coded: DataFrame, vocabulary: str, ids_col: str = "bpe_ids") -> DataFrame:
    """Adds ``bpe_decoded``: the text of packed ids, as ``encode_bpe`` makes them or from storage.

    Null and empty: the empty text. Every row keeps its columns; one named bpe_decoded is replaced. Bytes beyond the last whole id don't count.
    """
    tune(coded.sparkSession)
    coded = coded.drop("bpe_decoded")
    schema = T.StructType([*coded.schema.fields, T.StructField("bpe_decoded", T.StringType())])
    place = coded.columns.index(ids_col)

    def run(batches):
        serve("bpe-decoder")
        decoder = _DECODERS[vocabulary]
        for batch in batches:
            told = [decoder.text(x or b"") for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, pa.string())], names=schema.names)

    return coded.mapInArrow(run, schema)


def op10_query(spark, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text of ``documents`` and gives digests of both."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode_bpe(docs, public_tokenizers.path("word_bpe_49k.json"), decode=True)
    return coded.select(
        "doc_id",
        F.col("bpe_n_tokens").alias("n_tokens"),
        F.sha2("bpe_ids", 256).alias("ids_sha256"),
        F.sha2("bpe_decoded", 256).alias("decoded_sha256"),
    )
