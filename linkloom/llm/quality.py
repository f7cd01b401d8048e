"""Quality rules by tokeniser fertility.

Public vocabularies are used as measuring tools: how many characters one token covers, which share
of the tokens are bytes that the vocabulary fell back to, and how evenly the tokens are spread
(Shannon entropy over the entropy that so many tokens could have at most). Text of the kind that a
vocabulary was made for stays inside a narrow band; mojibake, encoded blobs, symbol noise and
endlessly repeated phrases leave it. Symbols strewn over words show in two measures at once, each within
its own limits: ``Band.noise``. Each language has its own bands; a row whose language has
none gets the bands of its script.

A text's tokens are those of its words, each encoded by itself. So every distinct word is encoded
once per Python worker (the cache is bounded), and a text costs a lookup per word. Rows are
independent: one pass, no shuffle, and no state between rows other than the cache.

Beside the method stand two plain rules on word counts (``base_failed``).
"""

from __future__ import annotations

import base64
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from .common import Memo, kept, serve, steady, text_blocks, tune

SYMBOLS = "#*$%&|<>"
#: Evenness is over the entropy of at most so many tokens, about the size of the piece vocabulary.
EVEN_TOKENS = 32_000
#: Entries of the word cache of one Python worker.
CACHE_WORDS = 300_000


@dataclass(frozen=True)
class Band:
    """Limits of one language or script. Characters per token: of the piece vocabulary, then of the byte vocabulary.

    ``noise``: (most characters per piece token, a, b). Evenness falls with length, so text that covers no more characters
    a token is held against a + b * log2(tokens). Symbols strewn over words lower both measures; few words often repeated lower
    only evenness, and are left to ``min_evenness``.
    """

    piece_chars: tuple[float, float]
    byte_chars: tuple[float, float]
    max_fallback: float
    min_evenness: float
    noise: tuple[float, float, float] | None = None


#: By language code. The floors of characters per token are the 0.1 % quantiles of text labelled good that passes the plain rules
#: (42,000 documents of check_l, even ids); the noise line is their least-squares line of evenness less its 0.1 % quantile, for
#: text up to the 99 % quantile of characters per token.
LANGUAGE_BANDS = {
    "en": Band((1.956, 6.5), (1.906, 6.5), 0.10, 0.44, (2.314, 1.1619, -0.0513)),
    "de": Band((1.998, 6.0), (1.842, 6.0), 0.10, 0.44, (2.343, 1.1498, -0.0515)),
    "fr": Band((1.779, 6.0), (1.703, 6.0), 0.10, 0.44, (2.103, 1.1495, -0.0520)),
    "es": Band((1.739, 6.0), (1.634, 6.0), 0.10, 0.44, (2.066, 1.1271, -0.0496)),
}
#: By script, for other languages and none. Scripts that the vocabularies hardly know fall back to bytes as a rule.
SCRIPT_BANDS = {
    "latin": Band((1.0, 7.0), (0.9, 7.0), 0.20, 0.30),
    "cyrillic": Band((0.8, 6.0), (0.4, 6.0), 0.50, 0.30),
    "cjk": Band((0.3, 3.0), (0.25, 3.0), 1.0, 0.30),
    "other": Band((0.2, 7.0), (0.2, 7.0), 1.0, 0.30),
}
#: First and last code points that count for a script, in the order tried.
SCRIPT_RANGES = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)],
    "cyrillic": [(0x400, 0x52F)],
    "cjk": [(0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF)],
}


@dataclass(frozen=True)
class QualityRules:
    """Parameters. ``min_words`` and ``max_repeat_percent`` make ``base_failed``; fewer tokens than ``min_tokens`` are not judged by evenness."""

    piece_model: str
    byte_ranks: str
    byte_pattern: str
    min_words: int = 50
    max_repeat_percent: int = 50
    min_tokens: int = 20


class Meter:
    """Token counts per word from both vocabularies, cached, and texts measured from them."""

    def __init__(self, rules: QualityRules):
        import sentencepiece
        import tiktoken

        self.piece = sentencepiece.SentencePieceProcessor(model_file=rules.piece_model)
        self.is_byte = np.array([self.piece.is_byte(i) for i in range(self.piece.vocab_size())])
        with open(rules.byte_ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = tiktoken.Encoding("byte_ranks", pat_str=rules.byte_pattern, mergeable_ranks=ranks, special_tokens={})
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.start, self.count, self.other = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, np.int32)

    def learn(self, words: set[bytes]) -> None:
        if len(self.place) + len(words) > CACHE_WORDS:
            self.clear()
        new = [w for w in words if w not in self.place]
        if not new:
            return
        plain = [w.decode("utf-8", "replace") for w in new]
        pieces = self.piece.encode(plain, num_threads=1)
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        other = np.fromiter((len(self.bytes.encode_ordinary(" " + w)) for w in plain), np.int64, len(plain))
        flat = np.fromiter((i for p in pieces for i in p), np.int32, int(counts.sum()))
        self.place.update(zip(new, range(len(self.count), len(self.count) + len(new)), strict=True))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.other = np.concatenate([self.other, other])
        self.ids = np.concatenate([self.ids, flat])

    def measure(self, words: list[bytes], chars: int):
        """(piece tokens, fallback share, evenness, characters per token of both vocabularies)."""
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        counts = self.count[at]
        n = int(counts.sum())
        if not n:
            return 0, 0.0, 1.0, 0.0, 0.0
        steps = np.arange(n) + np.repeat(self.start[at] - (np.cumsum(counts) - counts), counts)
        ids = self.ids[steps]
        seen = np.bincount(ids, minlength=len(self.is_byte))
        fallback = float(seen[self.is_byte].sum()) / n
        share = seen[seen > 0] / n
        most = np.log2(min(n, len(self.is_byte)))
        even = float(-(share * np.log2(share)).sum() / most) if n > 1 else 1.0
        return n, fallback, even, chars / n, chars / int(self.other[at].sum())


def script_of(text: str) -> str:
    """The script of most letters of a whole text."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    best, most = "other", 0
    for name, ranges in SCRIPT_RANGES.items():
        n = sum(int(((points >= a) & (points <= b)).sum()) for a, b in ranges)
        if n > most:
            best, most = name, n
    return best


def base_counts(text: str) -> tuple[list[bytes], int, int, int, int]:
    """Words and (word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    raw = text.encode("utf-8")
    words = raw.split()
    word_chars = len(text) - sum(text.count(c) for c in "\x20\x09\x0a\x0b\x0c\x0d")
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        reach = -1
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(reach, i)
                reach = i + 3
    return words, word_chars, symbols, len(lines) - len(set(lines)), repeated


def verdict(band: Band, rules: QualityRules, n: int, fallback: float, even: float, piece: float, byte: float) -> str | None:
    """The rule that rejects a text, if one does. Texts without tokens are left to the plain rules."""
    if not n:
        return None
    if not band.piece_chars[0] <= piece <= band.piece_chars[1]:
        return "piece_chars"
    if not band.byte_chars[0] <= byte <= band.byte_chars[1]:
        return "byte_chars"
    if fallback > band.max_fallback:
        return "fallback"
    if n >= rules.min_tokens and even < band.min_evenness:
        return "evenness"
    if band.noise and n >= rules.min_tokens:
        most, a, b = band.noise
        if piece <= most and even < a + b * np.log2(min(n, EVEN_TOKENS)):
            return "noise"
    return None


_METERS = kept("quality", Memo(Meter, 4))
#: Columns that quality_rules adds.
_ARROW = pa.schema(
    [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("n_tokens", pa.int64())]
    + [(c, pa.float64()) for c in ("fallback_share", "evenness", "piece_chars", "byte_chars")]
    + [("rejected_by", pa.string()), ("kept", pa.bool_())]
)


def quality_rules(docs: DataFrame, rules: QualityRules, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Adds the counts, the measures and ``kept`` to every row; columns of those names are replaced.

    Null text: no words, so ``base_failed``. Empty text: the same. Null or unknown language: the
    bands of the text's script. Repeated rows are judged alike.
    """
    tune(docs.sparkSession)
    added = from_arrow_schema(_ARROW)
    docs = docs.drop(*added.names)
    schema = T.StructType(docs.schema.fields + added.fields)
    at_text, at_lang = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches):
        serve("quality")
        meter = _METERS[rules]
        for batch in batches:
            texts, langs = [t or "" for t in batch.column(at_text).to_pylist()], batch.column(at_lang).to_pylist()
            rows = []
            for a, b in text_blocks(texts):
                with steady():
                    counted = [base_counts(t) for t in texts[a:b]]
                    meter.learn(set().union(*[words for words, *_ in counted]))
                for text, lang, (words, *counts) in zip(texts[a:b], langs[a:b], counted, strict=True):
                    n = len(words)
                    failed = n < rules.min_words or 100 * counts[3] > rules.max_repeat_percent * n
                    measured = meter.measure(words, counts[0])
                    band = LANGUAGE_BANDS.get(lang) or SCRIPT_BANDS[script_of(text)]
                    why = verdict(band, rules, *measured)
                    rows.append((n, *counts, failed, *measured, why, not failed and why is None))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)] if rows else [pa.array([], f.type) for f in _ARROW]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return docs.mapInArrow(run, schema)



def production_rules() -> QualityRules:
    import public_tokenizers

    path = public_tokenizers.path
    return QualityRules(path("piece_bpe_32k.model"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_query(spark, sf_dir: str) -> DataFrame:
    """Counts, measures and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return quality_rules(docs, production_rules()).drop("text", "lang")
