"""Page columns by regular expressions: title, descriptions, language, headings, links, images, plain text, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dictionaries as D
from . import text

TITLE = r"(?is)<title[^>]*>(.*?)</title>"
_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def clean(c: Column) -> Column:
    """White space runs as one blank, curly quotes straight."""
    straight = F.translate(F.coalesce(c, F.lit("")), " “”‘’", " \"\"''")
    return text.strip(F.regexp_replace(straight, r"\s+", " "))


def bare(c: Column) -> Column:
    """Text without tags, with common entities resolved."""
    out = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for entity, char in _ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return clean(out)


def title(page: Column) -> Column:
    return bare(F.regexp_extract(page, TITLE, 1))


def meta(page: Column, name: str) -> Column:
    """The content of a meta element by name or property, whichever attribute comes first."""
    one = F.regexp_extract(page, rf"(?is)<meta[^>]*(?:name|property)\s*=\s*[\"']{name}[\"'][^>]*content\s*=\s*[\"']([^\"']*)[\"']", 1)
    two = F.regexp_extract(page, rf"(?is)<meta[^>]*content\s*=\s*[\"']([^\"']*)[\"'][^>]*(?:name|property)\s*=\s*[\"']{name}[\"']", 1)
    return clean(F.coalesce(F.nullif(one, F.lit("")), two))


def description(page: Column) -> Column:
    return F.coalesce(F.nullif(meta(page, "description"), F.lit("")), meta(page, "og:description"))


def language(page: Column) -> Column:
    return F.lower(F.regexp_extract(page, r"(?is)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z\-]+)", 1))


def plain(page: Column) -> Column:
    """The words of a page without scripts, styles and comments."""
    quiet = F.regexp_replace(page, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1>|<!--.*?-->", " ")
    return bare(quiet)


def headings(page: Column, most: int = 10) -> Column:
    """Headings by level, longer than three characters."""
    levels = [F.transform(F.regexp_extract_all(page, F.lit(rf"(?is)<h{n}\b[^>]*>(.*?)</h{n}>")), bare) for n in range(1, 7)]
    return F.slice(F.filter(F.concat(*levels), lambda h: F.length(h) > 3), 1, most)


def _absolute(base: Column, found: Column) -> Column:
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<!/)/[^/]*$", "/")
    return F.transform(
        found,
        lambda u: F.when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), u)
        .when(u.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), u))
        .when(u.startswith("/"), F.concat(root, u))
        .otherwise(F.concat(folder, u)),
    )


def links(page: Column, base: Column, most: int = 20) -> Column:
    """Targets of links, absolute, first of equal ones; anchors and scripts left out."""
    found = F.regexp_extract_all(page, F.lit(r"(?is)<a\b[^>]*?\shref\s*=\s*[\"']([^\"']+)[\"']"))
    return F.slice(F.array_distinct(_absolute(base, F.filter(found, lambda u: ~u.rlike("^(#|javascript:|mailto:)")))), 1, most)


def images(page: Column, base: Column, most: int = 10) -> Column:
    found = F.regexp_extract_all(page, F.lit(r"(?is)<img\b[^>]*?\ssrc\s*=\s*[\"']([^\"']+)[\"']"))
    return F.slice(_absolute(base, found), 1, most)


def word_count(body: Column) -> Column:
    return text.bound(text.strip(body), lambda b: F.when(b == "", F.lit(0)).otherwise(F.size(F.split(b, r"\s+"))))


def reading_minutes(words: Column) -> Column:
    """At 225 words a minute, half-even; one at least, none without words."""
    return F.when(words == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.bround(words / F.lit(225.0), 0).cast("int")))


def categories(url: Column, head: Column, body: Column) -> Column:
    """Categories with a point or more: 2 per word in the URL, 1 in the title, half in the first 1000 characters of text."""
    said = F.struct(F.lower(url).alias("url"), F.lower(head).alias("head"), F.lower(F.left(body, F.lit(1000))).alias("body"))
    listed = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*[F.lit(w) for w in words]).alias("words")) for name, words in D.CONTENT_CATEGORIES.items()])

    def found(x: Column) -> Column:
        hits = lambda part, ws: F.size(F.filter(ws, lambda w: F.contains(x[part], w)))
        enough = lambda c: hits("url", c["words"]) * 2.0 + hits("head", c["words"]) * 1.0 + hits("body", c["words"]) * 0.5 >= 1.0
        return F.transform(F.filter(listed, enough), lambda c: c["name"])

    return text.bound(said, found)


def quality(head: Column, about: Column, words: Column, n_headings: Column, lang: Column) -> Column:
    """0 to 1 from title, description, length, headings and language."""
    when = lambda c, x: F.when(c, x).otherwise(0.0)
    h, a = F.length(head), F.length(about)
    score = (
        when(h > 0, 0.2) + when(h.between(20, 100), 0.1) + when(a > 0, 0.1) + when(a.between(50, 200), 0.1) + when(words > 100, 0.2)
        + when(words > 500, 0.1) + when(n_headings > 0, 0.1) + when(n_headings >= 3, 0.1) + when(lang != "", 0.1)
    )
    return F.least(F.lit(1.0), F.round(score, 6))
