"""Tag columns: three dialects of parsing, cleaning, categories, tags from URLs and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dictionaries as D
from . import text, urls


#: Words that come first among the tags of one text or bookmark.
PRIORITY = ("python", "programming", "ai", "machine", "learning", "github")


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def _array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def parse_import(c: Column) -> Column:
    """Import dialect: split at , ; |, lower case, quotes off, two letters or more, first of equal ones."""
    pieces = F.transform(F.split(text.clean(c), "[,;|]"), lambda t: F.regexp_replace(F.lower(text.strip(t)), "^[\"']+|[\"']+$", ""))
    return F.array_distinct(F.filter(pieces, lambda t: F.length(t) > 1))


def parse_stream(c: Column) -> Column:
    """Stream dialect: a quoted or plain comma list; case and repeats stay."""
    bare = F.regexp_replace(text.strip(F.coalesce(c, F.lit(""))), '^"+|"+$', "")
    return F.filter(F.transform(F.split(bare, ","), text.strip), lambda t: t != "")


def parse_existing(c: Column) -> Column:
    """Corpus dialect: the first of , ; | or blank that occurs separates; short forms are written out; sorted."""
    raw = F.lower(text.strip(F.coalesce(c, F.lit(""))))
    split = F.when(raw.contains(","), F.split(raw, ",")).when(raw.contains(";"), F.split(raw, ";")).when(raw.contains("|"), F.split(raw, r"\|")).otherwise(F.split(raw, r"\s+"))
    pieces = F.filter(F.transform(split, text.strip), lambda t: t != "")
    return F.array_sort(F.array_distinct(F.transform(pieces, lambda t: F.when(t.isin("ai", "ml", "ui", "ux"), t).otherwise(full_form(t)))))


def full_form(tag: Column) -> Column:
    return F.coalesce(F.element_at(_map(D.TAG_FORMS), tag), tag)


def synonym(tag: Column) -> Column:
    """Configured form: underscores and blanks as hyphens, synonyms replaced, protected tags left alone."""
    plain = F.regexp_replace(F.lower(text.strip(tag)), r"[_\s]+", "-")
    return F.when(plain.isin(*D.PROTECTED_TAGS), plain).otherwise(F.coalesce(F.element_at(_map(D.TAG_SYNONYMS), plain), plain))


def category(tag: Column) -> Column:
    """The field, else the content type, that lists the tag; general otherwise."""
    table = {w: "general" for w in ()}
    for group in (D.CONTENT_TYPE_INDICATORS, D.TECH_KEYWORDS):
        for name, words in reversed(group.items()):
            table.update(dict.fromkeys(words, name))
    return F.coalesce(F.element_at(_map(table), tag), F.lit("general"))


def in_hierarchy(tag: Column) -> Column:
    """The tag below the first branch that lists it; the tag itself otherwise."""
    table = {}
    for branch, words in reversed(D.TAG_HIERARCHY.items()):
        table.update({w: f"{branch}/{w}" for w in words})
    return F.coalesce(F.element_at(_map(table), tag), tag)


def cleaned(tags: Column) -> Column:
    """Without marks, long ones, stop words and numbers; written out; sorted and distinct."""
    bare = F.transform(tags, lambda t: F.regexp_replace(F.lower(text.strip(t)), r"[^\p{L}\p{N}_\-]", ""))
    kept = F.filter(bare, lambda t: F.length(t).between(2, 20) & ~t.isin(*D.STOP_WORDS) & ~t.rlike("^[0-9]+$"))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda t: F.when(F.length(t) > 2, full_form(t)).otherwise(t))))


def from_url(url: Column) -> Column:
    """Tags of the platform, of the first three path parts and of the host's labels; sorted."""
    return text.bound(F.struct(urls.domain(url).alias("host"), F.lower(urls.path(url)).alias("path")), _from_parts)


def _from_parts(u: Column) -> Column:
    host = u["host"]
    platform = F.array().cast("array<string>")
    for name, words in reversed(D.PLATFORM_TAGS.items()):
        platform = F.when(host.contains(name), _array(words)).otherwise(platform)
    parts = F.slice(F.filter(F.split(u["path"], "/"), lambda p: p != ""), 1, 3)
    words = F.flatten(
        F.transform(
            F.filter(parts, lambda p: F.length(p) > 2),
            lambda p: F.when(p.contains("-"), F.filter(F.split(p, "-"), lambda w: w.rlike(r"^\p{L}{2,}$"))).otherwise(F.filter(F.array(p), lambda w: w.rlike(r"^\p{L}+$"))),
        )
    )
    labels = F.when(host.contains("."), F.filter(F.split(host, r"\."), lambda p: (F.length(p) > 2) & ~p.isin(*D.HOST_PARTS_IGNORED))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(platform, words, labels)))


def from_text(c: Column) -> Column:
    """Fields and content types whose words the text holds (as substrings), and its words; sorted."""
    raw = F.coalesce(c, F.lit(""))
    return text.bound(F.struct(raw.alias("raw"), F.lower(raw).alias("low")), _from_words)


def _from_words(said: Column) -> Column:
    low = said["low"]
    fields = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(name).alias("field")) for name, ws in D.TECH_KEYWORDS.items() for w in ws])
    held = F.flatten(F.transform(F.filter(fields, lambda f: F.contains(low, f["word"])), lambda f: F.array(f["field"], f["word"])))
    kinds = F.array(*[F.struct(F.lit(name).alias("name"), _array(ws).alias("words")) for name, ws in D.CONTENT_TYPE_INDICATORS.items()])
    types = F.transform(F.filter(kinds, lambda k: F.exists(k["words"], lambda w: F.contains(low, w))), lambda k: k["name"])
    words = F.filter(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]+)")), lambda w: (F.length(w) >= 2) & ~w.isin(*D.STOP_WORDS) & ~w.rlike("^[0-9]+$"))
    keep = ("ai", "programming", "machine", "learning", "github")
    # Whole words of ASCII letters: a word of any letters first, as engines differ in where a word with others ends.
    whole = F.filter(F.regexp_extract_all(said["raw"], F.lit(r"([\p{L}\p{N}_]+)")), lambda w: w.rlike("^[A-Z][a-zA-Z]+$"))
    names = F.filter(F.transform(whole, F.lower), lambda w: (F.length(w) > 3) & ~w.isin(*D.STOP_WORDS))
    return F.array_sort(F.array_distinct(F.concat(held, types, F.transform(words, lambda w: F.when(w.isin(*keep), w).otherwise(full_form(w))), names)))


def _first(found: Column, wanted: Column, most: int) -> Column:
    """The wanted ones of the tags before the others, at most so many; each part in the order given."""
    is_wanted = lambda t: F.array_contains(wanted, t)
    return F.slice(F.concat(F.filter(found, is_wanted), F.filter(found, lambda t: ~is_wanted(t))), 1, most)


def of_text(c: Column, most: int = 5) -> Column:
    """Tags of a content text, priority words first."""
    return _first(cleaned(from_text(c)), _array(PRIORITY), most)


def of_bookmark(own: Column, url: Column, title: Column, note: Column, excerpt: Column, most: int = 5) -> Column:
    """Tags of one bookmark from all its fields: existing ones and priority words first."""
    raw = F.transform(F.coalesce(own, F.array().cast("array<string>")), lambda t: F.lower(text.strip(t)))
    given = F.transform(F.filter(raw, lambda t: t != ""), lambda t: F.when(t.isin("ai", "ml", "ui", "ux"), t).otherwise(full_form(t)))
    found = cleaned(F.concat(given, from_url(url), from_text(title), from_text(note), from_text(excerpt)))
    return _first(found, F.concat(raw, _array((*PRIORITY, "tutorial"))), most)


def final(tags: Column, optimized: Column, most: int = 5) -> Column:
    """The optimised tags, else the original ones: the first few, trimmed, without empty ones."""
    chosen = F.when(F.size(F.coalesce(optimized, F.array().cast("array<string>"))) > 0, optimized).otherwise(F.coalesce(tags, F.array().cast("array<string>")))
    return F.filter(F.transform(F.slice(chosen, 1, most), text.strip), lambda t: t != "")


def exported(tags: Column) -> Column:
    """As import files want them: nothing, the one tag, or a quoted list."""
    n = F.size(tags)
    return F.when(n == 0, F.lit("")).when(n == 1, F.element_at(tags, 1)).otherwise(F.concat(F.lit('"'), F.array_join(tags, ", "), F.lit('"')))


def every(tags: Column, optimized: Column, keywords: Column) -> Column:
    """All tags of a row: lower case, two letters or more, sorted."""
    none = F.array().cast("array<string>")
    both = F.concat(*[F.coalesce(c, none) for c in (tags, optimized, keywords)])
    return F.array_sort(F.array_distinct(F.filter(F.transform(both, lambda t: F.lower(text.strip(t))), lambda t: F.length(t) > 1)))
