"""String columns: trimming, cleaning, escaping, parsing of booleans and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"[a-z][a-z0-9\-]*[a-z0-9]|[a-z]"

#: Date patterns of exports: with time, without, day first, month first.
DATE_PATTERNS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd", "M/d/yyyy", "d/M/yyyy", "M/d/yyyy HH:mm:ss",
)


def strip(c: Column) -> Column:
    """Trims all white space, not blanks only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def title_case(c: Column) -> Column:
    """The first letter of every run of letters in upper case, the others in lower case."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def clean(c: Column) -> Column:
    """Without NUL and CR, white space runs as one blank, trimmed; null as empty."""
    return strip(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "\x00\r", ""), r"\s+", " "))


def bound(value: Column, f) -> Column:
    """``f`` of a value that is worked out once per row. A column that stands inside a lambda would be worked out again for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def any_of(c: Column, words) -> Column:
    """Whether the text holds any of the words as a substring."""
    return bound(c, lambda x: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(x, w)))


def count_of(c: Column, words) -> Column:
    """How many of the words the text holds. A list of literals, as a sum of many terms outgrows generated code."""
    return bound(c, lambda x: F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(x, w))))


def parse_bool(c: Column, words: tuple[str, ...] = ("true", "1", "yes", "on", "enabled")) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(*words), F.lit(False))


def parse_time(c: Column, patterns=DATE_PATTERNS) -> Column:
    """The first pattern that fits; null if none does."""
    text = strip(c)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in patterns], F.try_to_timestamp(text))


def escape_html(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def escape_yaml(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(" "))


def anchor(c: Column) -> Column:
    """A Markdown anchor: lower case, blanks and slashes as hyphens, other marks gone."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[\s/]+", "-"), r"[^\w\-]", "")


def file_name(c: Column, most: int = 100) -> Column:
    """Without characters that file systems refuse; cut at a blank within ``most`` characters."""
    safe = strip(F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', ""), r"\s+", " "))
    cut = F.left(safe, F.lit(most))
    return F.coalesce(F.nullif(F.when(F.length(safe) <= most, safe).otherwise(F.regexp_replace(cut, r"\s+\S*$", "")), F.lit("")), F.lit("untitled"))


def redact(c: Column) -> Column:
    """Log text without keys, bearer tokens, passwords and e-mail addresses."""
    for pattern, put in (
        (r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]{8,}", "$1[REDACTED]"),
        (r"(?i)((?:api[_-]?key|token|secret|password|passwd)[\"']?\s*[:=]\s*[\"']?)[^\s\"',;]{4,}", "$1[REDACTED]"),
        (r"\bsk-[A-Za-z0-9-]{16,}", "[REDACTED]"),
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    ):
        c = F.regexp_replace(c, pattern, put)
    return c


def terms(c: Column, stop_words) -> Column:
    """Lower-case terms of 2 to 30 characters that are no stop words; repeats stay."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({TERM})"))
    return F.filter(found, lambda t: F.length(t).between(2, 30) & ~t.isin(*stop_words))
