"""Corpus-wide tags: candidates, scores, selection, assignment, co-occurrence.

Rows have url, title, note and tags; page content (url, categories, headings, body) may be joined. Candidates are
exploded once and counted with map-side combination. The dictionary side of substring joins is the selected
tags, a number that a parameter bounds, so it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import tags

#: Tags that one broadcast of a substring join holds, about.
TAG_BLOCK = 5000
#: Tags that a broadcast may hold where texts are cut into substrings: some 30 MB.
TAGS_HELD = 500_000
#: A character that no run of the texts and no cleaned tag has.
NOT_IN_RUN = r"[^\p{L}\p{N}_\-]"


def candidates(rows: DataFrame) -> DataFrame:
    """(url, tag): distinct candidate tags of each row from its tags, URL, title and note, and its page and description if rows have them."""
    has, none = set(rows.columns), F.array().cast("array<string>")
    joined = F.concat_ws(" ", "title", "note")
    found = [F.coalesce("tags", none), tags.from_url(F.col("url")), tags.from_text(joined)]
    if {"categories", "page_keywords", "headings"} <= has:
        found.append(from_content(F.coalesce("categories", none), F.col("page_keywords"), F.coalesce("headings", none)))
    if "enhanced_description" in has:
        found.append(tags.from_text(F.col("enhanced_description")))
    found = F.concat(*found)
    return rows.select("url", F.explode(tags.cleaned(found)).alias("tag")).distinct()


def frequencies(found: DataFrame) -> DataFrame:
    return found.groupBy("tag").agg(F.count("*").alias("frequency"))


def tag_quality(tag: Column, frequency: Column, total: Column) -> Column:
    often = F.least(F.lit(1.0), frequency / (total / 10))
    length = F.when(F.length(tag).between(3, 15), 1.0).otherwise(0.5)
    letters = F.when(tag.rlike(r"^\p{L}+$"), 1.0).otherwise(0.8)
    words = sorted({w for ws in D.TECH_KEYWORDS.values() for w in ws})
    return (often + length + letters) * F.when(tag.isin(*words), 1.2).otherwise(1.0) / 3.2


def scored(found: DataFrame, rows: DataFrame, content: DataFrame | None = None, min_frequency: int = 2) -> DataFrame:
    """(tag, frequency, content_score, url_score, quality_score, total_score) of tags seen often enough."""
    often = frequencies(found).where(F.col("frequency") >= min_frequency)
    total = rows.count()
    at = rows.select("url", F.lower("url").alias("said"), F.lit(1.0).alias("points"))
    in_url = occurring(at, often.select("tag")).groupBy("tag").agg(F.count("*").alias("hits"))
    out = often.join(in_url, "tag", "left").withColumn("url_score", F.coalesce("hits", F.lit(0)) / F.lit(max(1, total)))
    if content is None:
        out = out.withColumn("content_score", F.lit(0.0))
    else:
        pages = content.select("url").distinct().count()
        texts = content.select("url", "categories", F.lower(F.array_join("headings", "\n")).alias("heads"), F.lower("body").alias("body"))
        by_tag = met(texts, often).groupBy("tag").agg((F.sum("points") / max(1, pages)).alias("content_score"))
        out = out.join(by_tag, "tag", "left").withColumn("content_score", F.coalesce("content_score", F.lit(0.0)))
    out = out.withColumn("quality_score", tag_quality(F.col("tag"), F.col("frequency"), F.lit(total)))
    # Tenths by division, as 0.3 times 3 is not 0.9: scores that are equal as decimals then stay equal.
    score = F.col("frequency") * 3 / 10 + F.col("content_score") * 0.4 + F.col("url_score") * 0.2 + F.col("quality_score") * 0.1
    # Rounded, so that the order of equal scores is that of the tags and not of the sums' last bits.
    return out.withColumn("total_score", rounded(score)).drop("hits")


def rounded(score: Column) -> Column:
    """To six digits as DuckDB does: the product of doubles is rounded, where Spark's own takes the decimal that the double prints as."""
    return F.round(score * 1e6) / 1e6


def occurring(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(url, tag, points) from rows (url, said, points): the greatest points of the texts of a URL that hold the tag as a substring.

    A tag of letters, digits, _ and - lies within one run of such characters. Each distinct run of all texts is cut into substrings of the tags'
    lengths, which are looked up among the tags: where these are few enough by a broadcast, so that only hits move, else by a join of equals. Other
    tags have no key and are broadcast in blocks of bounded size.
    """
    odd_tag = F.col("tag").rlike(NOT_IN_RUN)
    plain, odd = wanted.where(~odd_tag), wanted.where(odd_tag)
    told = wanted.agg(F.collect_set(F.when(~odd_tag, F.length("tag"))).alias("lengths"), F.count_if(~odd_tag).alias("plain"), F.count_if(odd_tag).alias("odd")).first()
    found = texts.limit(0).select("url", F.lit("").alias("tag"), "points")
    if told.plain:
        runs = F.array_distinct(F.regexp_extract_all(F.coalesce("said", F.lit("")), F.lit(r"([\p{L}\p{N}_\-]+)")))
        held = texts.select("url", F.explode(runs).alias("run"), "points").groupBy("url", "run").agg(F.max("points").alias("points"))
        sized = held.select("run").distinct().withColumn("n", F.explode(F.array(*[F.lit(n) for n in sorted(told.lengths)]))).where(F.col("n") <= F.length("run"))
        parts = sized.select("run", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("run") - F.col("n") + 1), lambda i: F.substring("run", i, F.col("n"))))).alias("tag"))
        held_tags = F.broadcast(plain) if told.plain <= TAGS_HELD else plain
        found = found.union(held.join(parts.join(held_tags, "tag", "left_semi"), "run").select("url", "tag", "points"))
    blocks = -(-told.odd // TAG_BLOCK)
    for b in range(blocks):
        some = F.broadcast(odd.where(F.pmod(F.xxhash64("tag"), F.lit(blocks)) == b))
        found = found.union(texts.join(some, F.expr("contains(said, tag)")).select("url", "tag", "points"))
    return found.groupBy("url", "tag").agg(F.max("points").alias("points"))


def met(texts: DataFrame, often: DataFrame) -> DataFrame:
    """(url, tag, points): 1 where the tag is a category of the page, else 0.5 in a heading, else 0.3 in the text, as substrings."""
    both = texts.select("url", F.col("heads").alias("said"), F.lit(0.5).alias("points")).union(texts.select("url", "body", F.lit(0.3)))
    listed = texts.select("url", F.explode(F.array_distinct("categories")).alias("tag"), F.lit(1.0).alias("points")).join(often.select("tag"), "tag", "left_semi").select("url", "tag", "points")
    return occurring(both, often.select("tag")).union(listed).groupBy("url", "tag").agg(F.max("points").alias("points"))


def selected(scores: DataFrame, target: int = 150, threshold: float = 0.3) -> list[str]:
    """The corpus tags in order: best first; beyond four fifths of the target only first of a category or high scores.

    What the greedy pass can choose is among the best ``target`` tags and the best tag of each category, so the driver sees only these.
    """
    best = scores.where(F.col("total_score") >= threshold).select("tag", "total_score", tags.category(F.col("tag")).alias("category")).persist()
    top = best.orderBy(F.desc("total_score"), "tag").limit(target).collect()
    firsts = best.groupBy("category").agg(F.min(F.struct((-F.col("total_score")).alias("s"), "tag")).alias("m")).select("m.tag", (-F.col("m.s")).alias("total_score"), "category").collect()
    best.unpersist()
    chosen, seen = [], set()
    for tag, score, category in sorted({tuple(r) for r in top + firsts}, key=lambda r: (-r[1], r[0])):
        if len(chosen) >= target:
            break
        if category not in seen or score > 0.7 or len(chosen) < 0.8 * target:
            chosen.append(tag)
            seen.add(category)
    return chosen


def relevance(tag: Column, title: Column, url: Column, own: Column, categories: Column, heads: Column) -> Column:
    hit = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains(tag)
    parts = F.when(hit(title), 0.3).otherwise(0.0) + F.when(hit(url), 0.2).otherwise(0.0) + F.when(F.array_contains(categories, tag), 0.4).when(hit(heads), 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), parts + F.when(hit(F.array_join(own, " ")), 0.1).otherwise(0.0))


def assigned(rows: DataFrame, corpus: DataFrame, most: int = 5) -> DataFrame:
    """(url, tag, relevance, place): the best corpus tags of each row among its candidates; ties by tag."""
    wanted = F.broadcast(corpus.select("tag"))
    none = F.array().cast("array<string>")
    page = [F.coalesce(F.col(c), none).alias(c) if c in rows.columns else none.alias(c) for c in ("categories", "headings")]
    # Rows of a URL that don't differ in what is looked at are one; rows that do are judged one by one.
    found = candidates(rows).join(wanted, "tag", "left_semi").join(rows.select("url", "title", "tags", *page).distinct(), "url")
    score = relevance(F.col("tag"), F.col("title"), F.col("url"), F.coalesce("tags", none), F.col("categories"), F.array_join("headings", "\n"))
    ranked = found.withColumn("relevance", F.round(score, 6)).withColumn("place", F.row_number().over(W.partitionBy("url").orderBy(F.desc("relevance"), "tag")))
    return ranked.where(F.col("place") <= most).select("url", "tag", "relevance", "place")


def cooccurrence(found: DataFrame) -> DataFrame:
    """(a, b, n): rows that hold both tags, a < b; tags of one row only meet each other."""
    lists = found.groupBy("url").agg(F.array_sort(F.collect_set("tag")).alias("ts"))
    pairs = lists.select(F.explode(F.flatten(F.transform("ts", lambda a, i: F.transform(F.slice("ts", i + 2, F.size("ts")), lambda b: F.struct(a.alias("a"), b.alias("b"))))) ).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def coverage(assignments: DataFrame, total: int) -> DataFrame:
    """One row: share of rows with a tag, distinct tags used, mean tags of a row with tags."""
    by_url = assignments.groupBy("url").agg(F.count("*").alias("n"))
    used = assignments.agg(F.count_distinct("tag").alias("unique_tags")).first()[0]
    return by_url.agg((F.count("*") / max(1, total)).alias("coverage"), F.lit(used).alias("unique_tags"), F.avg("n").alias("avg_tags"))


def confidence(tag: Column, title: Column, url: Column, own: Column, frequency: Column, in_categories: Column, heads: Column | None = None) -> Column:
    """0.5 and more for each sign: title 0.2, URL 0.15, existing tags (as substrings) 0.25, categories 0.2, headings 0.1, five rows or more 0.1; protected tags 0.95."""
    hit = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower(tag))
    when = lambda c, x: F.when(c, x).otherwise(0.0)
    total = 0.5 + when(hit(title), 0.2) + when(hit(url), 0.15) + when(hit(F.array_join(own, " ")), 0.25) + when(in_categories, 0.2) + when(frequency >= 5, 0.1)
    if heads is not None:
        total = total + when(F.exists(heads, lambda h: hit(h)), 0.1)
    return F.when(tag.isin(*D.PROTECTED_TAGS), 0.95).otherwise(F.least(F.lit(1.0), total))


def similar(tag_list: DataFrame, tag: str, most: int = 10) -> DataFrame:
    """Tags that hold the tag or are held by it, or share its category; sorted."""
    t = F.lit(tag)
    near = F.col("tag").contains(t) | t.contains(F.col("tag")) | ((tags.category(F.col("tag")) == tags.category(t)) & (tags.category(t) != "general"))
    return tag_list.where((F.col("tag") != t) & near).select("tag").distinct().orderBy("tag").limit(most)


def with_max_confidence(rows: DataFrame) -> DataFrame:
    """(tag, confidence) after synonyms: the greatest confidence of each form."""
    return rows.select(tags.synonym(F.col("tag")).alias("tag"), "confidence").groupBy("tag").agg(F.max("confidence").alias("confidence"))


def from_content(categories: Column, keywords: Column, headings: Column) -> Column:
    """Tags of a page: its categories, its keywords and those of its first five headings; sorted."""
    heads = F.flatten(F.transform(F.slice(headings, 1, 5), tags.from_text))
    return F.array_sort(F.array_distinct(F.concat(categories, tags.parse_existing(keywords), heads)))


def with_confidence(rows: DataFrame, corpus: DataFrame, most: int = 5) -> DataFrame:
    """(url, tag, confidence): the corpus tags assigned to each row with how sure they are, under their branch of the hierarchy unless protected."""
    given = assigned(rows, corpus, most).select("url", "tag")
    none = F.array().cast("array<string>")
    page = [F.coalesce(F.col(c), none).alias(c) if c in rows.columns else none.alias(c) for c in ("categories", "headings")]
    joined = given.join(frequencies(candidates(rows)), "tag").join(rows.select("url", "title", "tags", *page), "url")
    sure = confidence(F.col("tag"), F.col("title"), F.col("url"), F.coalesce("tags", none), F.col("frequency"), F.array_contains("categories", F.col("tag")), F.col("headings"))
    shown = F.when(F.col("tag").isin(*D.PROTECTED_TAGS), F.col("tag")).otherwise(tags.in_hierarchy(F.col("tag")))
    return joined.select("url", shown.alias("tag"), F.round(sure, 6).alias("confidence"))


def branch(tag: Column) -> Column:
    """The top of the hierarchy that a tag is under; null for others."""
    path = tags.in_hierarchy(tag)
    return F.when(path.contains("/"), F.element_at(F.split(path, "/"), 1))
