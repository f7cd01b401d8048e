"""Texts that a generator returned: clean-up, structured answers, validation, content types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dictionaries as D
from . import text


def cleaned(c: Column, most: int = 150) -> Column:
    """Without a label in front and quotes around it, one blank between words, a full stop at the end, cut to length."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)^(Summary:|Description:|Enhanced:|The text describes?:?)\s*", "")
    bare = text.strip(F.regexp_replace(bare, r"\s+", " "))
    bare = F.regexp_replace(bare, r'^"(.*)"$', "$1")
    ended = F.when((bare == "") | bare.rlike(r"[.!?]$"), bare).otherwise(F.concat(bare, F.lit(".")))
    return F.left(ended, F.lit(most))


def description(c: Column) -> Column:
    """Without the usual preambles, first letter upper case."""
    bare = text.strip(c)
    out = bare
    for words in D.PREAMBLES:
        out = F.regexp_replace(out, rf"(?i)^{words}\s*", "")
    first = F.left(out, F.lit(1))
    return F.concat(F.when(F.length(out) < F.length(bare), F.upper(first)).otherwise(first), F.substring(out, F.lit(2), F.length(out)))


def tag_list(c: Column) -> Column:
    """Lower case, letters, digits and hyphens only, two or more, the first ten different ones."""
    bare = F.transform(c, lambda t: F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}\-]", ""))
    return F.slice(F.array_distinct(F.filter(bare, lambda t: F.length(t) >= 2)), 1, 10)


ANSWER = "struct<description: string, tags: array<string>, category: string, confidence: double>"


def parsed(c: Column) -> Column:
    """An answer as struct(description, tags, category, confidence): JSON, fenced or not; any other text counts as the description."""
    raw = F.coalesce(c, F.lit(""))
    fenced = F.coalesce(F.nullif(F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.lit("")), raw)
    j = F.from_json(text.strip(fenced), ANSWER)
    told = text.strip(fenced)
    ok = F.coalesce(F.length(j["description"]).between(10, 500) & F.coalesce(j["confidence"], F.lit(0.8)).between(0.0, 1.0), F.lit(False))
    plain = F.when(F.length(told) < 10, "No description available").when(F.length(told) > 500, F.concat(F.left(told, F.lit(497)), F.lit("..."))).otherwise(told)
    none = F.array().cast("array<string>")
    good = F.struct(description(j["description"]).alias("description"), tag_list(F.coalesce(j["tags"], none)).alias("tags"), j["category"].alias("category"), F.coalesce(j["confidence"], F.lit(0.8)).alias("confidence"))
    fallback = F.struct(description(plain).alias("description"), F.array(F.lit("uncategorized")).alias("tags"), F.lit("other").alias("category"), F.lit(0.5).alias("confidence"))
    return F.when(ok, good).otherwise(fallback)


def content_type(categories: Column, given: Column, title: Column, about: Column) -> Column:
    """The first category, else the type given, else the first type whose words title or description hold, else general."""
    said = F.lower(F.concat_ws(" ", title, about))
    kind = F.lit("general")
    for name, words in reversed(D.CONTENT_TYPES.items()):
        kind = F.when(text.any_of(said, words), name).otherwise(kind)
    return F.coalesce(F.lower(F.try_element_at(categories, F.lit(1))), F.nullif(F.lower(given), F.lit("")), kind)


def simple_categories(c: Column) -> Column:
    """Of a few broad categories those with a word in the text."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.filter(F.array(*[F.when(text.any_of(low, words), F.lit(name)) for name, words in D.SIMPLE_CATEGORIES.items()]), lambda x: x.isNotNull())


def merged(page_title: Column, page_about: Column, body: Column, title: Column, note: Column, excerpt: Column) -> Column:
    """struct(title, about, body): the longer title, the excerpt where a page has no description, the note before the text."""
    blank = lambda c: F.length(F.coalesce(c, F.lit(""))) == 0
    longer = F.when(~blank(title) & (F.length(title) > F.length(F.coalesce(page_title, F.lit("")))), title).otherwise(page_title)
    about = F.when(blank(page_about) & ~blank(excerpt), excerpt).otherwise(page_about)
    noted = F.concat(F.lit("User Note: "), note)
    return F.struct(longer.alias("title"), about.alias("about"), F.when(blank(note), body).when(blank(body), noted).otherwise(F.concat(noted, F.lit(" | "), body)).alias("body"))
