"""Exact removal of long repeated passages with a logarithmic family of sparse suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Texts are bytes;
matches stay inside documents. In the same pass words that stand in a run of ``passage`` words which another
document has too are counted: the same index over hashes of words instead of bytes.

Sparse suffixes. In every window of ``length`` units one gram (half the length of bytes, a quarter of words) is chosen by the least
hash, the leftmost on ties (winnowing). Equal windows choose the same place, so windows need to be
compared only where their chosen grams (anchors) are equal. The windows that choose one anchor are neighbours:
their offsets to it run from lo to hi, and the units they cover are the anchor's context.

The index (``SuffixIndex``) lives below a path and is added to in batches of documents, in one run or in many. A level is the sorted
array of its anchors' grams, in segments of bounded size, each gram once with a mark if it has several members, so a passage in
a third of all texts is one entry. A batch is sorted into such an array and merge-scanned with the levels that exist: what it shares with them, or
has twice itself, are the grams of interest. It enters at level 0; two levels of one size merge into the next, so n batches make log n
levels and an entry is rewritten log n times.

Only anchors of these grams are looked at further, in whichever batch they are: a Bloom filter of bounded size picks texts by the grams that are stored
with them. Anchors of one gram and one context, 128 bits together, are a class. All windows of a class with
two members or more are repeated; of a gram with one class and one member none is. Classes of grams with several
classes send their bytes, each class once, from one document, however many copies there are; from these come suffix arrays of right contexts and of
reversed left contexts, and in sorted order the common prefixes of neighbours say which windows at which offsets are equal. Whole texts that
occur more than once are settled by their digests.

Grams that too many classes share (what stands around a very common passage) are lengthened on one side or the
other, so that no task holds an unbounded group.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bloom, cut, drop_scratch, mix64, scratch_path, tune

_POS = np.uint64(2**28 - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64))
_BREAK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Bytes of text that are worked on at once, so that arrays stay in a core's cache. Longer texts are cut into pieces that overlap by a window.
PIECE = 200_000
#: Entries of one gram that one task holds.
BUCKET_ENTRIES = 8_000
#: Grams of a segment of an array.
SEGMENT = 1 << 20
#: Words of a passage: over fifty.
PASSAGE = 51
#: End of a span that reaches to the end of its text.
_ALL = 2**62


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, kept for the longest block so far."""
    if len(_powers[0]) < n:
        for i, x in enumerate((_BASE, _INVERSE)):
            row = np.full(2 * n, x)
            row[0] = 1
            _powers[i] = np.cumprod(row)
    return [x[:n] for x in _powers]


def _sums(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums before every place and a factor by which the hash of a stretch no longer depends on where it is."""
    up, down = _power(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[:-1], out=sums[1:])
    return sums, down


def anchors(symbols: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """(piece, place, lo, hi, gram hash) of the anchors of pieces of symbols that end at ``ends``."""
    windows = length - gram + 1
    if len(symbols) < length:
        return (*[np.zeros(0, np.int64)] * 4, np.zeros(0, np.uint64))
    sums, down = _sums(symbols)
    grams = (sums[gram:] - sums[:-gram]) * down[: len(symbols) - gram + 1]
    least = mix64(grams)
    least &= ~_POS
    least |= np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size * 2 <= windows:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if rest := windows - size:
        least = np.minimum(least[:-rest], least[rest:])
    # Windows that would reach beyond their piece don't count; those of different pieces never choose one place.
    edges = np.zeros(len(least) + 1, np.int32)
    starts = np.concatenate([[0], ends[:-1]])
    np.add.at(edges, np.clip(np.maximum(ends - length + 1, starts), 0, len(least)), 1)
    np.add.at(edges, np.clip(ends, 0, len(least)), -1)
    start = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
    if not len(start):
        return (*[np.zeros(0, np.int64)] * 4, np.zeros(0, np.uint64))
    place = (least[start] & _POS).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [len(start)]]) - 1
    at = place[first]
    return np.searchsorted(ends, start[first], side="right"), at, at - start[last], at - start[first], grams[at]


def word_symbols(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of some texts, and the number of words of each text."""
    text = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    gap = _BREAK[text]
    before = np.concatenate([[True], gap[:-1]])
    starts, stops = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
    sums, down = _sums(_TABLE[text])
    symbols = mix64((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    ends = np.cumsum([len(r) + 1 for r in raws])
    return symbols, np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(raws))


def _words(raw: bytes) -> np.ndarray:
    """The word hashes of a long text, cut between words."""
    parts, a = [], 0
    while a < len(raw):
        b = min(a + PIECE, len(raw))
        while b < len(raw) and not _BREAK[raw[b]]:
            b += 1
        parts.append(word_symbols([raw[a:b]])[0])
        a = b
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _blocks(batches, length: int, passage: int, wanted=None):
    """Per block of texts: (unit, number of each piece's text, offset of each piece in it, anchors, content, starts of pieces), and the texts' digests.

    Unit 1 is bytes, unit 8 words as 64-bit hashes. The low bit of a gram tells the unit. A digest counts once per task; texts without
    a gram that may be in the filter ``wanted`` are left out, as are the anchors of other grams.
    """
    seen: set[bytes] = set()
    raws, whose, held = [], [], 0

    def found(unit, symbols, ends, content, numbers, offsets):
        piece, at, lo, hi, gram = anchors(symbols, ends, *((length, length // 2) if unit == 1 else (passage, passage // 4)))
        gram = (gram & ~np.uint64(1)) | np.uint64(unit == 8)
        if wanted is not None:
            some = np.flatnonzero(wanted.has(gram))
            piece, at, lo, hi, gram = (x[some] for x in (piece, at, lo, hi, gram))
        return unit, whose, np.array(numbers, np.int64), np.array(offsets, np.int64), (piece, at, lo, hi, gram), content, np.concatenate([[0], ends[:-1]])

    def in_bytes(pieces, numbers, offsets):
        content = b"".join(pieces)
        return found(1, _TABLE[np.frombuffer(content, np.uint8)], np.cumsum([len(p) for p in pieces]), content, numbers, offsets)

    def done():
        pieces, numbers, offsets, size = [], [], [], 0
        for i, raw in enumerate(raws):
            for a in range(0, len(raw) - length + 1, PIECE):
                pieces.append(raw[a : a + PIECE + length - 1])
                numbers.append(i)
                offsets.append(a)
                size += len(pieces[-1])
                if size >= PIECE:
                    yield in_bytes(pieces, numbers, offsets)
                    pieces, numbers, offsets, size = [], [], [], 0
        if pieces:
            yield in_bytes(pieces, numbers, offsets)
        if passage:
            if len(raws) == 1:
                symbols = _words(raws[0])
                counts = np.array([len(symbols)])
            else:
                symbols, counts = word_symbols(raws)
            yield found(8, symbols, np.cumsum(counts), symbols.tobytes(), np.arange(len(raws)), [0] * len(raws))

    for batch in batches:
        digests = batch.column("digest").to_pylist()
        live = range(len(digests))
        if wanted is not None:
            packed = batch.column("grams").to_pylist()
            ends = np.cumsum([len(p) // 8 for p in packed])
            hits = np.concatenate([[0], np.cumsum(wanted.has(np.frombuffer(b"".join(packed), np.uint64)))])
            live = np.flatnonzero(hits[ends] > hits[np.concatenate([[0], ends[:-1]])]).tolist()
        texts = batch.column("text")
        for i in live:
            if digests[i] in seen:
                continue
            seen.add(digests[i])
            raw = texts[i].as_py().encode("utf-8")
            if raws and held + len(raw) > PIECE:
                yield from done()
                raws, whose, held = [], [], 0
            raws.append(raw)
            whose.append(digests[i])
            held += len(raw)
    if raws:
        yield from done()


def _contexts(unit: int, found, content: bytes, length: int) -> np.ndarray:
    """A hash of each anchor's context and of where the anchor is in it."""
    _, at, lo, hi, _ = found
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(content[(p - h) * unit : (p - l + length) * unit], h * 1_000_003 + l) for p, l, h in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True)), np.uint64, len(at))


_ANCHOR = "digest binary, place long, until long, n long, gram long, context long, lo int, hi int"
_SUFFIX = "gram long, context long, before binary, after binary, lo long, hi long"
_MATCH = "gram long, context long, first long, last long"
_MATCH_ARROW = pa.schema([(c, pa.int64()) for c in ("gram", "context", "first", "last")])
_ARRAY = "segment long, grams binary, many binary"
_ARRAY_ARROW = pa.schema([("segment", pa.int64()), ("grams", pa.binary()), ("many", pa.binary())])


def _gram_rows(length: int, passage: int):
    """(digest, text, grams): every text with the grams of its anchors, sorted, none more than twice. Empty for repeats of a text within a task."""

    def run(batches):
        for batch in batches:
            digests = batch.column("digest").to_pylist()
            packed = dict.fromkeys(digests, b"")
            told: dict[bytes, list] = {}
            for _, whose, numbers, _, (piece, _, _, _, gram), _, _ in _blocks([batch], length, passage):
                text = numbers[piece]
                order = np.lexsort((gram, text))
                text, gram = text[order], gram[order]
                third = np.zeros(len(gram), bool)
                third[2:] = (gram[2:] == gram[:-2]) & (text[2:] == text[:-2])
                text, gram = text[~third], gram[~third]
                edges = np.searchsorted(text, np.arange(len(whose) + 1)) * 8
                raw = gram.tobytes()
                for i, digest in enumerate(whose):
                    told.setdefault(digest, []).append(raw[edges[i] : edges[i + 1]])
            packed.update((d, b"".join(p)) for d, p in told.items())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("text"), pa.array([packed[d] for d in digests], pa.binary())], names=["digest", "text", "grams"])

    return run


def _merged(grams: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order, and which of them have several members."""
    order = np.argsort(grams, kind="stable")
    grams, many = grams[order], many[order]
    if not len(grams):
        return grams, many
    heads = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    sizes = np.diff(np.concatenate([heads, [len(grams)]]))
    return grams[heads], (sizes > 1) | np.maximum.reduceat(many, heads)


def _dealt(grams: np.ndarray, many: np.ndarray, shift: int):
    """Rows (segment, grams, many) of sorted distinct grams, by their top bits."""
    segment = (grams >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(grams), np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(segment)) + 1, [len(grams)]]) if len(grams) else np.zeros(1, np.int64)
    rows = [(int(segment[a]), grams[a:b].tobytes(), many[a:b].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["segment", "grams", "many"])


def _array_rows(shift: int):
    """Sorted runs of the grams of some texts, each text's digest once per task."""

    def run(batches):
        seen, held, size = set(), [], 0
        for batch in batches:
            for digest, raw in zip(batch.column("digest").to_pylist(), batch.column("grams").to_pylist(), strict=True):
                if raw and digest not in seen:
                    seen.add(digest)
                    held.append(np.frombuffer(raw, np.uint64))
                    size += len(raw) // 8
            if size >= 2_000_000:
                grams = np.concatenate(held)
                yield _dealt(*_merged(grams, np.zeros(len(grams), bool)), shift)
                held, size = [], 0
        if held:
            grams = np.concatenate(held)
            yield _dealt(*_merged(grams, np.zeros(len(grams), bool)), shift)

    return run


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(table.column("grams").to_pylist()), np.uint64), np.frombuffer(b"".join(table.column("many").to_pylist()), bool)


def _redealt(shift: int):
    """A level's rows by other segments."""

    def run(batches):
        for batch in batches:
            for grams, many in zip(batch.column("grams").to_pylist(), batch.column("many").to_pylist(), strict=True):
                yield _dealt(np.frombuffer(grams, np.uint64), np.frombuffer(many, bool), shift)

    return run


def _one_array(table: pa.Table) -> pa.Table:
    grams, many = _merged(*_unpacked(table))
    return pa.table([table.column("segment").slice(0, 1), pa.array([grams.tobytes()], pa.binary()), pa.array([many.tobytes()], pa.binary())], schema=_ARRAY_ARROW)


def _scanned(new: pa.Table, old: pa.Table) -> pa.Table:
    """The grams that a new array has twice, or shares with an old one."""
    grams, many = _unpacked(new)
    before = np.unique(_unpacked(old)[0])
    at = np.minimum(np.searchsorted(before, grams), max(0, len(before) - 1))
    shared = before[at] == grams if len(before) else np.zeros(len(grams), bool)
    return pa.table([pa.array([grams[many | shared].tobytes()], pa.binary())], names=["grams"])


def _anchor_rows(length: int, passage: int, wanted):
    """Anchors of grams that may be wanted. Those of one class and document whose windows overlap from one to the next, as in texts that repeat themselves, are one row, from place to until."""

    def run(batches):
        for unit, whose, numbers, offset, found, content, starts in _blocks(batches, length, passage, wanted.value):
            piece, at, lo, hi, gram = found
            size = passage if unit == 8 else length
            context = _contexts(unit, found, content, size)
            text, place = numbers[piece], at - starts[piece] + offset[piece]
            order = np.lexsort((place, context, gram, text))
            text, place, gram, context, lo, hi = (x[order] for x in (text, place, gram, context, lo, hi))
            same = (text[1:] == text[:-1]) & (gram[1:] == gram[:-1]) & (context[1:] == context[:-1]) & (place[1:] - place[:-1] <= size)
            heads = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else order
            ends = np.concatenate([heads[1:], [len(order)]]) - 1 if len(order) else order
            digests = pa.array(whose, pa.binary()).take(pa.array(text[heads]))
            columns = [place[heads], place[ends], ends - heads + 1, gram[heads].view(np.int64), context[heads].view(np.int64), lo[heads].astype(np.int32), hi[heads].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([digests, *map(pa.array, columns)], names=["digest", "place", "until", "n", "gram", "context", "lo", "hi"])

    return run


def _suffix_rows(length: int, passage: int, grams, contexts):
    """(gram, context, before, after, lo, hi): the units left of an anchor, and those from it on, of classes that may be wanted; once per task."""

    def run(batches):
        sent: set[tuple[int, int]] = set()
        for unit, _, _, _, found, content, _ in _blocks(batches, length, passage, grams.value):
            size, rows = passage if unit == 8 else length, []
            context = _contexts(unit, found, content, size)
            for i in np.flatnonzero(contexts.value.has(context)).tolist():
                key = (int(found[4][i].view(np.int64)), int(context[i].view(np.int64)))
                if key not in sent:
                    sent.add(key)
                    p, lo, hi = int(found[1][i]), int(found[2][i]), int(found[3][i])
                    rows.append((*key, content[(p - hi) * unit : p * unit], content[p * unit : (p - lo + size) * unit], lo, hi))
            if rows:
                types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["gram", "context", "before", "after", "lo", "hi"])

    return run


def _picked(column: str, wanted):
    """Rows whose column may be in a Bloom filter."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(wanted.value.has(np.asarray(batch.column(column)).view(np.uint64))))

    return run


def suffix_array(grams: list[int], strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order by (gram, string), and the common prefix in bytes of each with the one before it (-1 where the gram changes).

    Runs that are sorted already, as levels are, merge in linear time.
    """
    order = sorted(range(len(strings)), key=lambda i: (grams[i], strings[i]))
    width = max(map(len, strings), default=0) + 1
    table = np.zeros((len(strings), width), np.uint8)
    sizes = np.array([len(strings[i]) for i in order], np.int64)
    for row, i in enumerate(order):
        table[row, : sizes[row]] = np.frombuffer(strings[i], np.uint8)
    common = np.full(len(order), -1, np.int64)
    if len(order) > 1:
        differ = table[1:] != table[:-1]
        differ[:, -1] = True
        common[1:] = np.minimum(differ.argmax(axis=1), np.minimum(sizes[1:], sizes[:-1]))
        by = np.array([grams[i] for i in order], np.int64)
        common[1:][by[1:] != by[:-1]] = -1
    return np.array(order, np.int64), common


def merge_scan(every: list[tuple], length: int, unit: int = 1) -> list[tuple[int, int, int, int]]:
    """Windows that an entry shares with an entry of another document: (owner, context, first offset, last offset).

    Entries are (gram, context, before, after, lo, hi, a, z, owner): a and z the least and the largest document of the class (for bytes, which
    may repeat within a document, both the class itself). A window at offset o is equal in two entries if the last o units before
    and the first length - o units from the anchor on agree: if in both arrays no smaller common prefix stands between them.
    """
    if len(every) < 2:
        return []
    grams = [e[0] for e in every]
    after, after_common = suffix_array(grams, [e[3] for e in every])
    reverse = (lambda b: b[::-1]) if unit == 1 else (lambda b: np.frombuffer(b, np.uint64)[::-1].tobytes())
    before, before_common = suffix_array(grams, [reverse(e[2]) for e in every])
    after_common, before_common = after_common // unit, before_common // unit  # -1 stays -1
    lo, hi, a, z = (np.array([e[i] for e in every], np.int64) for i in (4, 5, 6, 7))
    marked = np.zeros((len(every), length + 1), bool)
    right, left = np.empty(len(every), np.int64), np.empty(len(every), np.int64)
    for o in range(int(lo.min()), int(hi.max()) + 1):
        live = np.flatnonzero((lo <= o) & (o <= hi))
        if not len(live):
            continue
        right[after] = np.cumsum(after_common < length - o)
        left[before] = np.cumsum(before_common < o)
        key = right[live] * (len(every) + 1) + left[live]
        by = np.argsort(key, kind="stable")
        ranked = live[by]
        heads = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
        other = np.minimum.reduceat(a[ranked], heads) != np.maximum.reduceat(z[ranked], heads)
        marked[ranked, o] = np.repeat(other, np.diff(np.concatenate([heads, [len(ranked)]])))
    rows = []
    for i in np.flatnonzero(marked.any(axis=1)):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], marked[i].view(np.int8), [0]])))
        rows += [(every[i][8], every[i][1], int(x), int(y) - 1) for x, y in zip(edges[::2], edges[1::2], strict=True)]
    return rows


class SuffixIndex:
    """A family of levels below ``path``, added to in batches of documents; opening the path again goes on where the last run ended.

    Tables of a batch: texts (digest, text and the grams of its anchors; digests may repeat) and spans. Tables of a level: arrays, sorted
    grams by segment. What counts is named by the newest manifest, which is written last and never over another one: a run that fails leaves the
    index as it was, and of two runs that add at once one fails. Adding reads the grams of all texts and the texts with a gram of interest; it
    shuffles the batch's grams, the levels' grams and what belongs to grams of interest.
    """

    def __init__(self, spark: SparkSession, path: str, length: int = 400, passage: int = PASSAGE):
        self.spark, self.path, self.length, self.passage = spark, path.rstrip("/"), length, passage
        self.state = self._read() or {"version": 0, "length": length, "passage": passage, "batches": [], "levels": {}}
        if (self.state["length"], self.state["passage"]) != (length, passage):
            raise ValueError("the index was made with other lengths")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _read(self) -> dict | None:
        _, fs, at = self._fs()
        if not fs.exists(at):
            return None
        names = sorted(f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName().startswith("manifest-"))
        if not names:
            return None
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/{names[-1]}").collect()))

    def _commit(self, state: dict) -> None:
        jvm, fs, _ = self._fs()
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-{state['version']:09d}.json"), False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        self.state = state

    def _put(self, df: DataFrame, name: str) -> DataFrame:
        """Written once and read back."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self._get(name)

    def _get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _drop(self, *names: str) -> None:
        jvm, fs, _ = self._fs()
        for name in names:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)

    def _every(self, kind: str, *more: str) -> DataFrame | None:
        names = [f"{kind}-{b}" for b in (self.state["levels"].values() if kind == "arrays" else self.state["batches"])]
        return self.spark.read.parquet(*[f"{self.path}/{n}" for n in (*names, *more)]) if names or more else None

    def add(self, docs: DataFrame, text_col: str = "text") -> None:
        """A batch of documents: matched with itself and with all levels, then part of the family."""
        version = self.state["version"] + 1
        tag = f"{version:06d}-{uuid.uuid4().hex[:8]}"
        texts = docs.select(digest_of(text_col).alias("digest"), F.col(text_col).alias("text")).where(F.octet_length("text") >= self._shortest())
        texts = self._put(texts.mapInArrow(_gram_rows(self.length, self.passage), "digest binary, text string, grams binary"), f"texts-{tag}")
        size = (texts.agg(F.sum(F.octet_length("grams"))).first()[0] or 0) // 8
        shift = 64 - max(0, (size // SEGMENT).bit_length())
        array = texts.select("digest", "grams").mapInArrow(_array_rows(shift), _ARRAY).groupBy("segment").applyInArrow(_one_array, _ARRAY)
        array = self._put(array, f"arrays-{tag}")
        old = self._every("arrays")
        old = array.limit(0) if old is None else old.mapInArrow(_redealt(shift), _ARRAY)
        grams = cut(array.groupBy("segment").cogroup(old.groupBy("segment")).applyInArrow(_scanned, "grams binary").where("octet_length(grams) > 0"), "grams")
        self._settle(grams, tag)
        levels, at, carry = dict(self.state["levels"]), 0, tag
        while str(at) in levels:
            other = levels.pop(str(at))
            merged = f"{other.split('.')[0]}.{tag}"
            both = self.spark.read.parquet(*[f"{self.path}/arrays-{t}" for t in (other, carry)])
            total = (both.agg(F.sum(F.octet_length("grams"))).first()[0] or 0) // 8
            both = both.mapInArrow(_redealt(64 - max(0, (total // SEGMENT).bit_length())), _ARRAY)
            self._put(both.groupBy("segment").applyInArrow(_one_array, _ARRAY), f"arrays-{merged}")
            at, carry = at + 1, merged
        gone = [t for t in (*self.state["levels"].values(), tag) if t not in (*levels.values(), carry)]
        self._commit({**self.state, "version": version, "batches": [*self.state["batches"], tag], "levels": {**levels, str(at): carry}})
        self._drop(*[f"arrays-{t}" for t in gone])

    def _shortest(self) -> int:
        return min(self.length, 2 * self.passage - 1) if self.passage else self.length

    def _settle(self, grams: DataFrame, tag: str) -> None:
        """Spans of the windows that are repeated at anchors of these grams, of all documents that have them, old ones included."""
        wanted = self.spark.sparkContext.broadcast(bloom(grams, "grams"))
        texts = self._every("texts", f"texts-{tag}")
        placed = cut(texts.mapInArrow(_anchor_rows(self.length, self.passage, wanted), _ANCHOR), "placed")
        doc = F.xxhash64("digest")
        classes = cut(placed.groupBy("gram", "context").agg(F.sum("n").alias("n"), F.min(doc).alias("a"), F.max(doc).alias("z")), "classes")
        sizes = classes.groupBy("gram").agg(F.sum("n").alias("members"), F.count("*").alias("contexts")).where("members > 1")
        touched = cut(classes.join(sizes.select("gram", "contexts"), "gram"), "touched")
        drop_scratch(classes)
        found = self._matches(texts, touched.where("contexts > 1").select("gram", "context", "a", "z"), wanted)
        # All windows of a class with a second member: for words, one in another document.
        whole = touched.where("CASE WHEN gram & 1 = 0 THEN n > 1 ELSE a <> z END").select("gram", "context")
        some = self.spark.sparkContext.broadcast(bloom(whole.union(found.select("gram", "context").distinct()), "context"))
        near = placed.mapInArrow(_picked("context", some), placed.schema)
        words = F.col("gram").bitwiseAND(F.lit(1)) == 1
        long = F.when(words, self.passage).otherwise(self.length)
        full = near.join(whole, ["gram", "context"]).select("digest", words.alias("words"), (F.col("place") - F.col("hi")).alias("start"), (F.col("until") - F.col("lo") + long).alias("end"))
        part = near.join(found, ["gram", "context"]).select("digest", words.alias("words"), (F.col("place") - F.col("last")).alias("start"), (F.col("until") - F.col("first") + long).alias("end"))
        self._put(full.union(part), f"spans-{tag}")
        drop_scratch(placed, touched)

    def _matches(self, texts: DataFrame, mixed: DataFrame, wanted) -> DataFrame:
        """(gram, context, first, last): repeated windows of classes whose gram has several classes."""
        n = mixed.count()
        if not n:
            return self.spark.createDataFrame([], _MATCH)
        # A class is read from its least document: only texts that are one for some class are worked on.
        docs = self.spark.sparkContext.broadcast(bloom(mixed, "a"))
        contexts = self.spark.sparkContext.broadcast(bloom(mixed, "context"))
        texts = texts.withColumn("doc", F.xxhash64("digest"))
        some = texts.mapInArrow(_picked("doc", docs), texts.schema)
        shipped = some.mapInArrow(_suffix_rows(self.length, self.passage, wanted, contexts), _SUFFIX)
        entries = shipped.groupBy("gram", "context").agg(*[F.first(c).alias(c) for c in ("before", "after", "lo", "hi")]).join(mixed, ["gram", "context"])
        # Bytes may repeat within a document, so each class is its own; words only count between documents.
        own = F.col("gram").bitwiseAND(F.lit(1)) == 0
        entries = entries.withColumns({"a": F.when(own, F.col("context")).otherwise(F.col("a")), "z": F.when(own, F.col("context")).otherwise(F.col("z")), "owner": F.col("gram")})
        entries, found = self._lengthened(cut(entries, "entries"))
        length, passage = self.length, self.passage
        fields = ("gram", "context", "before", "after", "lo", "hi", "a", "z", "owner")

        def scan(table: pa.Table) -> pa.Table:
            rows = list(zip(*[table.column(c).to_pylist() for c in fields], strict=True))
            out = merge_scan([r for r in rows if not r[8] & 1], length) + merge_scan([r for r in rows if r[8] & 1], passage, 8)
            return pa.table([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], schema=_MATCH_ARROW)

        dealt = entries.select(*fields, F.pmod(F.xxhash64("gram"), F.lit(max(8, n // BUCKET_ENTRIES * 4))).alias("bucket"))
        return cut(found.union(dealt.groupBy("bucket").applyInArrow(scan, _MATCH)).distinct(), "found")

    def _lengthened(self, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Entries for the scan, none of them in a gram of more than BUCKET_ENTRIES, and matches found on the way.

        Windows at offsets a to b of equal text share the last a units before the gram and the first length - b
        from it on. So a gram with too many contexts is halved by offsets, each half under a longer gram with those units,
        until few share one; entries alone in theirs go. At a single offset the longer gram is the window itself.
        """
        sizes = entries.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_ENTRIES)
        hot = cut(sizes.select("gram"), "hot")
        found = entries.sparkSession.createDataFrame([], _MATCH)
        if hot.isEmpty():
            return entries, found
        settled = entries.join(hot, "gram", "left_anti")
        names = settled.columns
        words = F.col("owner").bitwiseAND(F.lit(1)) == 1
        now = entries.join(hot, "gram").withColumns({"from": F.lit(0).cast("long"), "to": F.when(words, self.passage).otherwise(self.length).cast("long"), "unit": F.when(words, 8).otherwise(1), "size": F.when(words, self.passage).otherwise(self.length)})
        while True:
            middle = F.floor((F.col("from") + F.col("to")) / 2)
            halves = F.array(F.struct(F.col("from").alias("from"), middle.alias("to")), F.struct((middle + 1).alias("from"), F.col("to").alias("to")))
            rows = now.withColumn("r", F.explode(halves)).drop("from", "to").select("*", "r.from", "r.to").drop("r")
            longer = "substring(before, CAST((hi - from) * unit + 1 AS INT), CAST(from * unit AS INT)), substring(after, 1, CAST((size - to) * unit AS INT))"
            rows = rows.where("hi >= from AND lo <= to").withColumn("gram", F.expr(f"shiftleft(shiftright(xxhash64(owner, from, to, {longer}), 1), 1) | (owner & 1)"))
            rows = cut(rows, "longer")
            shared = rows.groupBy("gram").agg(F.count("*").alias("n"), F.min("a").alias("least"), F.max("z").alias("most")).where("least <> most")
            kept = cut(rows.join(cut(shared, "shared"), "gram"), "kept")
            few = kept.where(F.col("n") <= BUCKET_ENTRIES).withColumns(
                {"lo": F.greatest("lo", "from"), "hi": F.least("hi", "to"), "before": F.expr("substring(before, CAST(greatest(hi - to, 0) * unit + 1 AS INT), CAST(least(hi, to) * unit AS INT))")}
            )
            settled = settled.unionByName(few.select(*names))
            found = found.union(kept.where((F.col("n") > BUCKET_ENTRIES) & (F.col("from") == F.col("to"))).select(F.col("owner").alias("gram"), "context", F.col("from").alias("first"), F.col("to").alias("last")))
            now = kept.where((F.col("n") > BUCKET_ENTRIES) & (F.col("from") < F.col("to"))).drop("n", "least", "most")
            drop_scratch(rows)
            if now.isEmpty():
                return cut(settled, "settled"), found

    def spans(self) -> DataFrame:
        """(digest, spans) of every text with a repeated window: arrays of (words, start, end), words false for bytes; in any order, may overlap."""
        texts = self._every("texts")
        if texts is None:
            return self.spark.createDataFrame([], "digest binary, spans array<struct<words: boolean, start: long, end: long>>")
        copies = texts.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
        both = copies.select("digest", F.explode(F.array(F.lit(False), F.lit(True))).alias("words"), F.lit(0).cast("long").alias("start"), F.lit(_ALL).cast("long").alias("end"))
        return self._every("spans").unionByName(both).groupBy("digest").agg(F.collect_list(F.struct("words", "start", "end")).alias("spans"))


def digest_of(text_col: str):
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


#: Working columns; documents' own columns of these names are safe, as working columns are told by place or renamed.
_DIGEST, _SPANS = "__linkloom_digest", "__linkloom_spans"


def remove_repeats(docs: DataFrame, length: int = 400, text_col: str = "text", batches: int = 2, passage: int = PASSAGE, index: SuffixIndex | None = None) -> DataFrame:
    """Adds ``n_bytes``, ``removed`` (array of start, end in bytes; maximal runs), ``kept_bytes`` (binary) and ``passages`` (array of start, end in words) to every row.

    Null and texts shorter than ``length``: nothing removed. Repeated rows are different documents with one text, so
    their texts go if they have ``length`` bytes, and are passages if they have ``passage`` words. What is left need not be valid UTF-8.
    Columns of the added names are replaced, all others kept; an empty table gives none. Without an ``index`` the documents enter an
    index of this run in batches; with one they are added to it as a batch and are judged against all that it holds.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.drop("n_bytes", "removed", "kept_bytes", "passages")
    own = index is None
    if own:
        index = SuffixIndex(spark, scratch_path(spark, "suffixes"), length, passage)
        part = F.pmod(F.xxhash64(digest_of(text_col)), F.lit(batches))
        for b in range(batches):
            index.add(docs.where(part == b), text_col)
    else:
        index.add(docs, text_col)
    spans = cut(index.spans().select(F.col("digest").alias(_DIGEST), F.col("spans").alias(_SPANS)), "spans")
    if own:
        index._drop("")
    added = "n_bytes long, removed array<struct<start: long, end: long>>, kept_bytes binary, passages array<struct<start: long, end: long>>"
    schema = T.StructType([*docs.schema.fields, *spark.createDataFrame([], added).schema.fields])
    run = _removal(docs.columns.index(text_col), len(docs.columns), schema.names, index.length, index.passage)
    joined = docs.withColumn(_DIGEST, digest_of(text_col)).join(spans, _DIGEST, "left").select(*docs.columns, _SPANS)
    return joined.mapInArrow(run, schema)


def merged(start: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans, within ``size``; touching ones join."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.minimum(np.maximum.accumulate(end[order]), size)
    heads = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]])) if len(start) else order
    return start[heads], end[np.concatenate([heads[1:], [len(start)]]) - 1] if len(start) else end


def _runs_column(found: dict[int, tuple[np.ndarray, np.ndarray]], n: int) -> pa.Array:
    """Runs by row as a column of arrays of (start, end)."""
    sizes = np.zeros(n, np.int64)
    for i, (start, _) in found.items():
        sizes[i] = len(start)
    flat = [np.concatenate([np.zeros(0, np.int64), *[found[i][side] for i in sorted(found)]]) for side in (0, 1)]
    values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in flat], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _removal(at_text: int, n_columns: int, names: list[str], length: int, passage: int):
    def run(batches):
        for batch in batches:
            raws = pc.fill_null(batch.column(at_text), "").cast(pa.binary())
            # Texts without spans pass as they are, in whole columns.
            spans = batch.column(n_columns)
            has = spans.is_valid()
            offsets, values = spans.offsets.to_numpy(), spans.values
            words, start, end = (values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            removed, passages, kept = {}, {}, []
            for i in np.flatnonzero(has.to_numpy(zero_copy_only=False)).tolist():
                raw, here = raws[i].as_py(), slice(offsets[i], offsets[i + 1])
                in_words = words[here].astype(bool)
                if len(raw) >= length:
                    removed[i] = merged(start[here][~in_words], end[here][~in_words], len(raw))
                if passage and in_words.any():
                    n_words = len(_words(raw)) if (end[here][in_words] == _ALL).any() else _ALL
                    if n_words >= passage:
                        passages[i] = merged(start[here][in_words], end[here][in_words], n_words)
                runs = zip(*[x.tolist() for x in removed[i]], strict=True) if i in removed else ()
                edges = [0, *[x for r in runs for x in r], len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            left = pc.replace_with_mask(raws, has, pa.array(kept, pa.binary()))
            columns = [*batch.columns[:n_columns], pc.binary_length(raws).cast(pa.int64()), _runs_column(removed, len(batch)), left, _runs_column(passages, len(batch))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _total(runs: str):
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def op8_query(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without 400-byte strings that start anywhere else; and its words in passages of over 50 words that another document has too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cleaned = remove_repeats(docs)
    return cleaned.select(
        "doc_id", "n_bytes", _total("removed").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"),
        _total("passages").alias("n_passage_words"), (F.size("passages") > 0).alias("has_passage"),
    )
