"""Language-model scores from a log-frequency Bloom filter.

Counting. Tasks count words and bigrams of the training texts, combine them, and ship bigrams as sorted
5-byte tags by segment (the top bits of their hash; segments hold about a million n-grams, so there are
as many as the text asks for). Per segment one task sums the counts, quantises each to
1 + floor(log_base(count)) and sets, for an n-gram of level L, the bits of (n-gram, 1) .. (n-gram, L)
(Talbot and Osborne, 2007). A segment's bits follow the number of its entries.

Scoring. An n-gram's level is read by probing (n-gram, 1), (n-gram, 2), .. until one is missing. With
the counts q that the levels stand for, P(w | h) = (q(hw) + mu(h) * P(w)) / (q(h) + mu(h)) and
P(w) = (q(w) + 1) / (N + V + 1). mu(h) = 1 + mu * q(h)^power stands for the number of different words that follow h, which grows
as a power of its count (Heaps), as in Witten and Bell's smoothing; so frequent histories don't starve words not seen behind them. A text's tokens are its words and one end; the first follows a start.

The filter's size is known before it moves. Up to ``max_filter_bytes`` it is broadcast. Beyond, nothing
is: texts are dealt into blocks, a block's distinct n-grams go to the shelves of segments, and the
levels come back to the block. Both ways give the same numbers.

Beside the model stands an exact unigram score. The ``head_words`` most frequent words are broadcast (a
fixed number of words of at most 64 bytes); the rest of a text's words meet their counts in a join,
in which no word is frequent.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import cut, let_go, mix64, steady, text_blocks, tune

_TAG = np.uint64(2**40 - 1)
_LOW = np.uint64(0xFFFFFFFF)
_START, _END = np.uint64(0x51A27), np.uint64(0xE4D)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: N-grams that a segment is meant to hold.
SEGMENT = 1 << 20
#: Characters of text that are worked on at once.
PIECE = 1_000_000
#: Words, with repeats from block to block, that a task holds before it ships them.
HELD = 600_000
#: Bytes of the filter that a shelf holds, about, where the filter is not broadcast.
SHELF = 8 << 20
#: Tokens whose bigrams a task combines at once.
TOKENS = 1_500_000


@dataclass(frozen=True)
class Settings:
    base: float = 1.5
    bits_per_entry: int = 10
    probes: int = 6
    mu: float = 2.0
    mu_power: float = 0.85
    head_words: int = 1 << 18
    head_word_bytes: int = 64
    max_filter_bytes: int = 256 << 20


def thresholds(base: float) -> np.ndarray:
    """The least count of each level, from level 1 on."""
    return np.unique(np.ceil(np.power(base, np.arange(0, 110)) - 1e-9))


def meant(base: float) -> np.ndarray:
    """The count that a level stands for: the middle of those quantised to it; 0 for level 0."""
    least = thresholds(base)
    return np.concatenate([[0.0], (least[:-1] + np.maximum(least[:-1], least[1:] - 1)) / 2])


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LETTER = mix64(np.arange(1, 257, dtype=np.uint64))
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_powers: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, kept for the longest block so far."""
    if len(_powers[0]) < n:
        for i, x in enumerate((_BASE, _INVERSE)):
            row = np.full(n, x)
            row[0] = 1
            _powers[i] = np.cumprod(row)
    return [x[:n] for x in _powers]


class Block:
    """Some texts as places in the list of their distinct words; the end and the start stand behind the words.

    Words are found and hashed (64-bit polynomials over random letters) on the bytes of all texts at once.
    A word is known by its hash; its bytes are cut out only where they are asked for.
    """

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").encode("utf-8") for t in texts]
        self.raw = b"\n".join([*parts, b""]).lower()
        letters = np.frombuffer(self.raw, np.uint8)
        up, down = _power(len(letters) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[letters] * up[: len(letters)])])
        gap = np.concatenate([[True], _SPACE[letters], [True]])
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        starts, stops = edge[::2], edge[1::2]
        hashes = mix64((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
        order = hashes.argsort()
        ranked = hashes[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
        place = np.empty(len(hashes), np.int64)
        place[order] = np.cumsum(new) - 1
        self._starts, self._stops = starts[order[new]], stops[order[new]]
        self.end, self.begin = int(new.sum()), int(new.sum()) + 1
        self.hashes = np.append(ranked[new], [_END, _START])
        text_ends = np.cumsum([len(p) + 1 for p in parts])
        self.sizes = np.diff(np.searchsorted(starts, text_ends), prepend=0)
        ends = np.cumsum(self.sizes + 1)
        self.token = np.full(int(ends[-1]) if len(ends) else 0, self.end, np.int64)
        inner = np.ones(len(self.token), bool)
        inner[ends - 1] = False
        self.token[inner] = place
        self.history = np.empty_like(self.token)
        self.history[1:] = self.token[:-1]
        self.history[ends - self.sizes - 1] = self.begin
        self.owner = np.repeat(np.arange(len(texts)), self.sizes + 1)

    def words(self, places: np.ndarray) -> list[bytes]:
        raw = self.raw
        return [raw[a:b] for a, b in zip(self._starts[places].tolist(), self._stops[places].tolist(), strict=True)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the distinct bigrams, and which of them stands at each token."""
        found, at = np.unique(self.history * (self.begin + 1) + self.token, return_inverse=True)
        return bigram(self.hashes[found // (self.begin + 1)], self.hashes[found % (self.begin + 1)]), at


def unigram(token: np.ndarray) -> np.ndarray:
    return mix64(token + _STEP)


def bigram(history: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix64(mix64(history * _STEP + np.uint64(7)) + token)


def _count_words(batches):
    """Words and their counts, combined within a task up to HELD words at a time."""
    held: list[tuple] = []

    def rows():
        hashes = np.concatenate([h for h, *_ in held])
        sizes = [len(h) for h, *_ in held]
        whose, first = np.repeat(np.arange(len(held)), sizes), np.cumsum([0, *sizes])
        order = hashes.argsort()
        new = np.flatnonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])) if len(order) else order
        total = np.add.reduceat(np.concatenate([n for _, n, *_ in held])[order], new) if len(order) else order
        one = order[new]  # an occurrence of each word
        back = np.argsort(one)
        one, total = one[back], total[back]
        words = []
        for i, (_, _, raw, starts, stops) in enumerate(held):
            at = one[whose[one] == i] - first[i]
            words += [raw[a:b] for a, b in zip(starts[at].tolist(), stops[at].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(total, pa.int64())], names=["word", "n"])

    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a, b in text_blocks(texts, PIECE):
            block = Block(texts[a:b])
            held.append((block.hashes[: block.end], np.bincount(block.token, minlength=block.begin)[: block.end], block.raw, block._starts, block._stops))
            if sum(len(h) for h, *_ in held) >= HELD:
                yield rows()
                held.clear()
    if held:
        yield rows()
    held.clear()
    let_go()


def _packed(tags: np.ndarray, width: int = 5) -> bytes:
    return tags.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(raw: bytes, width: int = 5) -> np.ndarray:
    wide = np.zeros((len(raw) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return wide.view("<u8").reshape(-1).astype(np.uint64)


def _by_segment(keys: np.ndarray, shift: int):
    """Runs of sorted keys that share a segment: (segment, first, end)."""
    segment = (keys >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
    cuts = np.flatnonzero(np.diff(segment)) + 1
    for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]]), strict=True):
        yield int(segment[a]), int(a), int(b)


def _count_ngrams(shift: int):
    """N-grams of a task's texts as (segment, tags, counts); bigrams are combined over TOKENS at a time."""

    def rows(keys: np.ndarray, n: np.ndarray):
        found = [(s, _packed(keys[a:b] & _TAG), n[a:b].astype("<u4").tobytes()) for s, a, b in _by_segment(keys, shift)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["segment", "tags", "counts"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in text_blocks(texts, PIECE):
                with steady():
                    block = Block(texts[a:b])
                keys = unigram(block.hashes)
                n = np.bincount(block.token, minlength=len(keys))
                n[block.begin] = b - a
                order = np.flatnonzero(n)
                order = order[np.argsort(keys[order])]
                yield rows(keys[order], n[order])
                held.append(bigram(block.hashes[block.history], block.hashes[block.token]))
                size += len(block.token)
                if size >= TOKENS:
                    yield rows(*np.unique(np.concatenate(held), return_counts=True))
                    held, size = [], 0
        if size:
            yield rows(*np.unique(np.concatenate(held), return_counts=True))
        held = []
        let_go()

    return run


def _places(tags: np.ndarray, level: int, n_bits: int, probes: int):
    """The bits of (n-gram, level) in a segment, probe by probe."""
    low, step = _probe(tags, level)
    for _ in range(probes):
        yield ((low * np.uint64(n_bits)) >> np.uint64(32)).astype(np.int64)
        low += step


def _probe(tags: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Of (n-gram, level): the first probe as a share of 2^32, and the step to the next one."""
    y = mix64(tags + np.uint64(level * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
    return y.astype(np.uint32), (y >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _build(how: Settings):
    def run(table: pa.Table) -> pa.Table:
        tags = np.concatenate([_unpacked(x) for x in table.column("tags").to_pylist()])
        n = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()])
        tags, place = np.unique(tags, return_inverse=True)
        levels = np.searchsorted(thresholds(how.base), np.bincount(place, n), side="right")
        n_bits = max(64, -(-int(levels.sum()) * how.bits_per_entry // 64) * 64)
        bits = np.zeros(n_bits, bool)
        for level in range(1, int(levels.max()) + 1):
            here = tags[levels >= level]
            for at in _places(here, level, n_bits, how.probes):
                bits[at] = True
        return pa.table({"segment": table.column("segment").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    return run


class Filter:
    """Segments of the filter held in one array of ``size`` bytes."""

    def __init__(self, segments: Iterable[tuple[int, bytes]], size: int, shift: int, probes: int):
        self.shift, self.probes = shift, probes
        self.bits = np.empty(size, np.uint8)
        places, at = {}, 0
        for s, raw in segments:
            self.bits[at : at + len(raw)] = np.frombuffer(raw, np.uint8)
            places[s] = (len(raw) * 8, at * 8)
            at += len(raw)
        top = max(places, default=0) + 1
        self.n_bits, self.start = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        for s, (n, first) in places.items():
            self.n_bits[s], self.start[s] = n, first
        self.known, self.known_levels = np.empty(0, np.uint64), np.empty(0, np.int16)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each n-gram, by repeated membership probes; 0 for one not held."""
        segment = (keys >> np.uint64(self.shift)).astype(np.int64) if self.shift < 64 else np.zeros(len(keys), np.int64)
        live = np.flatnonzero(segment < len(self.start))
        live = live[self.n_bits[segment[live]] > 0]
        out = np.zeros(len(keys), np.int16)
        tags, start, n_bits = keys[live] & _TAG, self.start[segment[live]], self.n_bits[segment[live]]
        level = 1
        while len(live):
            low, step = _probe(tags, level)
            hit = True
            for probe in range(self.probes):
                at = ((low * n_bits) >> np.uint64(32)).view(np.int64)
                at += start
                hit &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                # Most of what is not held is told by two probes; narrowing costs more than it saves between the later ones.
                if probe in (0, 1, self.probes - 1):
                    if not hit.all():
                        kept = np.flatnonzero(hit)
                        live, tags, start, n_bits, low, step = (x[kept] for x in (live, tags, start, n_bits, low, step))
                    hit = True
                low += step
            out[live] = level
            level += 1
        return out

    def remember(self, hashes: np.ndarray) -> None:
        """Reads the levels of words once, for ``word_levels``."""
        self.known = np.sort(hashes)
        self.known_levels = self.levels(unigram(self.known))

    def word_levels(self, hashes: np.ndarray) -> np.ndarray:
        """The levels of words by their hashes; only those not remembered are probed."""
        if not len(self.known):
            return self.levels(unigram(hashes))
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        out = self.known_levels[at]
        rest = np.flatnonzero(self.known[at] != hashes)
        out[rest] = self.levels(unigram(hashes[rest]))
        return out


def log_probabilities(q_h: np.ndarray, q_w: np.ndarray, q_hw: np.ndarray, n: int, v: int, how: Settings) -> np.ndarray:
    """log10 P(w | h) of each token from the three counts; a bigram can't be more frequent than its history."""
    p_w = (q_w + 1) / (n + v + 1)
    mu = 1 + how.mu * q_h**how.mu_power
    return np.log10((np.minimum(q_hw, q_h) + mu * p_w) / (q_h + mu))


def score_block(texts: list[str | None], levels_of, counts: np.ndarray, exact: Exact, n: int, v: int, how: Settings) -> list[pa.Array]:
    """The columns ADDED of some texts; ``levels_of`` maps the hashes of words and the keys of bigrams to levels."""
    block = Block(texts)
    keys, at = block.pairs()
    words, pairs = levels_of(block.hashes, keys)
    q = counts[words]
    logs = log_probabilities(q[block.history], q[block.token], counts[pairs][at], n, v, how)
    score = np.bincount(block.owner, logs, len(texts))
    # Exact: what the head knows is summed here, the other words of a text go along with their counts.
    known = np.append(exact.of(block.hashes[: block.end]), exact.end)
    in_head = known >= 0
    here = in_head[block.token]
    base = np.bincount(block.owner[here], known[block.token[here]], len(texts))
    n_known = np.bincount(block.owner[here], minlength=len(texts)) - (exact.ends == 0)
    rest, times = np.unique(block.owner[~here] * (block.end + 1) + block.token[~here], return_counts=True)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rest // (block.end + 1), minlength=len(texts)))])
    asked, which = np.unique(rest % (block.end + 1), return_inverse=True)
    tail = pa.StructArray.from_arrays([pa.array(block.words(asked), pa.binary()).take(pa.array(which)), pa.array(times, pa.int64())], names=["word", "n"])
    return [pa.array(block.sizes + 1), pa.array(n_known, pa.int64()), pa.array(base), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tail), pa.array(score)]


class Exact:
    """log10(count + 1) of the head's words, by their hashes, and of the end."""

    def __init__(self, head: list[tuple[bytes, int]], ends: int):
        self.ends, self.end = ends, float(np.log10(ends + 1))
        words = Block([w.decode("utf-8") for w, _ in head])
        count = dict(head)
        self.hashes = words.hashes[: words.end]
        self.logs = np.log10(np.array([count[w] for w in words.words(np.arange(words.end))], np.float64) + 1)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """-1 for words that the head does not hold."""
        if not len(self.hashes):
            return np.full(len(hashes), -1.0)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.logs[at], -1.0)


class NgramModel:
    """Counts and filter learnt from a table's texts; ``n`` tokens, ``v`` distinct."""

    def __init__(self, training: DataFrame, text_col: str = "text", how: Settings = Settings()):
        tune(training.sparkSession)
        self.how, self.spark = how, training.sparkSession
        texts = training.select(F.col(text_col).alias("text"))
        self.words = cut(texts.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
        told = self.words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
        self.ends = texts.count()
        self.n, self.v = (told.n or 0) + self.ends, told.v + (self.ends > 0)
        parts = max(0, (2 * self.n // SEGMENT).bit_length())
        self.shift = 64 - parts
        counted = texts.mapInArrow(_count_ngrams(self.shift), "segment long, tags binary, counts binary")
        self.segments = cut(counted.groupBy("segment").applyInArrow(_build(how), "segment long, bits binary"), "filter")
        self.bytes = self.segments.agg(F.sum(F.length("bits"))).first()[0] or 0

    def head(self) -> DataFrame:
        """The most frequent words: a fixed number, each of bounded length."""
        return self.words.where(F.length("word") <= self.how.head_word_bytes).orderBy(F.desc("n"), "word").limit(self.how.head_words)

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """Adds ``lm_n_tokens``, ``lm_n_known``, ``lm_base`` and ``lm_score`` to every row; columns lm_* are replaced.

        Null and empty texts have one token, the end. Repeated rows each keep their row.
        """
        tune(self.spark)
        docs = docs.drop(*[c for c in docs.columns if c.startswith("lm_")])
        rows = docs.withColumn("lm_row", F.monotonically_increasing_id())
        scored = self._broadcast(rows, text_col) if self.bytes <= self.how.max_filter_bytes else self._dealt(rows, text_col)
        scored = cut(scored, "scored")
        tail = scored.select("lm_row", F.explode("lm_tail").alias("t")).select("lm_row", F.col("t.word").alias("word"), F.col("t.n").alias("times"))
        met = tail.join(self.words, "word").groupBy("lm_row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("lm_more"), F.sum("times").alias("lm_known"))
        whole = scored.drop("lm_tail").join(met, "lm_row", "left")
        floor = float(np.log10(self.n + self.v + 1))
        base = F.col("lm_base") + F.coalesce("lm_more", F.lit(0.0)) - F.col("lm_n_tokens") * F.lit(floor)
        known = F.col("lm_n_known") + F.coalesce("lm_known", F.lit(0))
        return whole.withColumn("lm_base", base).withColumn("lm_n_known", known).drop("lm_row", "lm_more", "lm_known")

    def _exact(self) -> Exact:
        head = self.head().toArrow()
        return Exact(list(zip(head.column("word").to_pylist(), head.column("n").to_pylist(), strict=True)), self.ends)

    _ADDED = ("lm_n_tokens", "lm_n_known", "lm_base", "lm_tail", "lm_score")
    _DDL = "lm_n_tokens long, lm_n_known long, lm_base double, lm_tail array<struct<word: binary, n: long>>, lm_score double"

    def _broadcast(self, rows: DataFrame, text_col: str) -> DataFrame:
        how, n, v, shift, counts = self.how, self.n, self.v, self.shift, meant(self.how.base)
        exact = self._exact()
        held = Filter(((r.segment, r.bits) for r in self.segments.toLocalIterator()), self.bytes, shift, how.probes)
        held.remember(np.append(exact.hashes, [_END, _START]))  # most words of any text, and those with most levels
        exact_sent, sent = self.spark.sparkContext.broadcast(exact), self.spark.sparkContext.broadcast(held)
        place = rows.columns.index(text_col)
        others = [i for i in range(len(rows.columns)) if i != place]
        added = self._ADDED

        def run(batches):
            held, exactly = sent.value, exact_sent.value
            for batch in batches:
                texts = batch.column(place).to_pylist()
                for a, b in text_blocks(texts, PIECE):
                    with steady():
                        columns = score_block(texts[a:b], lambda words, pairs: (held.word_levels(words), held.levels(pairs)), counts, exactly, n, v, how)
                    yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in others], *columns], names=[*[batch.schema.names[i] for i in others], *added])
            del held, exactly
            let_go(sent, exact_sent)

        kept = rows.drop(text_col)
        schema = kept.schema
        for f in self.spark.createDataFrame([], self._DDL).schema.fields:
            schema = schema.add(f)
        return rows.mapInArrow(run, schema)

    def _dealt(self, rows: DataFrame, text_col: str) -> DataFrame:
        """As _broadcast, with the n-grams sent to shelves of segments and the levels sent back, a byte each.

        A block asks a shelf once, so there are blocks times shelves asks, and not times segments. Shelf by shelf the answers are in the
        order of the block's sorted n-grams, which it finds again; so they need no keys.
        """
        how, n, v, shift, counts = self.how, self.n, self.v, self.shift, meant(self.how.base)
        exact_sent = self.spark.sparkContext.broadcast(self._exact())
        place, names = rows.columns.index(text_col), rows.columns
        others = [i for i in range(len(names)) if i != place]
        wide = min(64 - shift, (self.bytes // SHELF).bit_length())  # the bits of a shelf's number, and those of a segment's within it
        narrow = 64 - shift - wide
        width, inner = -(-(40 + narrow) // 8), np.uint64((1 << narrow) - 1)

        def asked_of(keys: np.ndarray) -> np.ndarray:
            """What a shelf must know of its n-grams: the place of the segment and the tag."""
            return (keys & _TAG) | ((keys >> np.uint64(shift) & inner) << np.uint64(40)) if shift < 64 else keys & _TAG

        def deal(batches):
            """A row for each block: its rows, and what it asks of each shelf."""
            number = TaskContext.get().partitionId() << 33
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            for batch in batches:
                texts = batch.column(place).to_pylist()
                for a, b in text_blocks(texts, PIECE):
                    with steady():
                        block = Block(texts[a:b])
                        keys = np.unique(np.concatenate([unigram(block.hashes), block.pairs()[0]]))
                    found = [(s, _packed(asked_of(keys[i:j]), width)) for s, i, j in _by_segment(keys, 64 - wide)]
                    asks = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.binary()), strict=True)], names=["shelf", "keys"])
                    held = pa.StructArray.from_arrays([c.slice(a, b - a) for c in batch.columns], names=names)
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), whole(held), whole(asks)], names=["block", "held", "asks"])
                    number += 1
            let_go()

        def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
            bits = held.column("bits").to_pylist()
            part = Filter(zip(held.column("segment").to_pylist(), bits, strict=True), sum(map(len, bits)), shift, how.probes)
            raw, told, at = asked.column("keys").to_pylist(), [], 0
            top = np.uint64(asked.column("shelf")[0].as_py() << narrow if raw else 0)
            while at < len(raw):  # some at a time, so that the arrays of a shelf stay small
                end, size = at, 0
                while end < len(raw) and size < 500_000:
                    size += len(raw[end]) // width
                    end += 1
                wanted = _unpacked(b"".join(raw[at:end]), width)
                keys = (wanted & _TAG) | ((top | wanted >> np.uint64(40)) << np.uint64(shift)) if shift < 64 else wanted
                levels = part.levels(keys).astype(np.uint8).tobytes()
                ends = np.cumsum([0, *[len(x) // width for x in raw[at:end]]]).tolist()
                told += [levels[i:j] for i, j in zip(ends, ends[1:], strict=False)]
                at = end
            return pa.table({"block": asked.column("block"), "shelf": asked.column("shelf"), "levels": pa.array(told, pa.binary())})

        def settle(told: pa.Table, answers: pa.Table) -> pa.Table:
            held = told.column("held").chunk(0).flatten()
            by_shelf = sorted(zip(answers.column("shelf").to_pylist(), answers.column("levels").to_pylist(), strict=True))
            levels = np.frombuffer(b"".join(x for _, x in by_shelf), np.uint8)

            def levels_of(words: np.ndarray, pairs: np.ndarray):
                keys, at = np.unique(np.concatenate([unigram(words), pairs]), return_inverse=True)
                if len(keys) != len(levels):
                    raise ValueError(f"{len(levels)} answers to {len(keys)} n-grams")
                return levels[at[: len(words)]], levels[at[len(words) :]]

            columns = score_block(held.field(place).to_pylist(), levels_of, counts, exact_sent.value, n, v, how)
            return pa.table([*[held.field(i) for i in others], *columns], names=[*[names[i] for i in others], *NgramModel._ADDED])

        shape = StructType().add("block", "long").add("held", ArrayType(rows.schema)).add("asks", ArrayType(StructType().add("shelf", "long").add("keys", "binary")))
        dealt = cut(rows.mapInArrow(deal, shape), "dealt")
        asked = dealt.select("block", F.explode("asks").alias("a")).select("block", F.col("a.shelf").alias("shelf"), F.col("a.keys").alias("keys"))
        shelves = self.segments.select(F.shiftright("segment", narrow).alias("shelf"), "segment", "bits")
        # Shelves without segments answer as well: with no level.
        answered = asked.groupBy("shelf").cogroup(shelves.groupBy("shelf")).applyInArrow(answer, "block long, shelf long, levels binary")
        schema = StructType([rows.schema[i] for i in others])
        for f in self.spark.createDataFrame([], self._DDL).schema.fields:
            schema = schema.add(f)
        return dealt.select("block", "held").groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(settle, schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2


def op3_query(spark, sf_dir: str, how: Settings = Settings()) -> DataFrame:
    """Scores every document with a model of those outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = NgramModel(docs.where(~held_out(F.col("doc_id"))), how=how)
    return model.score(docs).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("lm_n_tokens").alias("n_tokens"),
        F.col("lm_n_known").alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        F.col("lm_base").alias("base_score"),
        F.col("lm_score").alias("score"),
    )
