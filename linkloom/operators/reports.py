"""Discovery, collection quality, export statistics, attention lists and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import text, urls


def vocabulary() -> list[str]:
    """All words that are built in: tags, indicators, categories and synonyms."""
    groups = [*D.CONTENT_TYPE_INDICATORS.items(), *D.TECH_KEYWORDS.items()]
    return sorted({w for name, words in groups for w in (name, *words)} | set(D.TAG_SYNONYMS.values()))


def discovered_terms(rows: DataFrame, least: int = 3, most: int = 30) -> DataFrame:
    """(term, frequency, sources, examples): frequent terms of titles, notes, URL paths and tags that are not built in.

    ``sources`` is the sorted list of where a term occurs, ``examples`` the first three titles by position.
    """
    none = F.array().cast("array<string>")
    where = {"title": text.terms(F.col("title"), D.STOP_WORDS), "note": text.terms(F.col("note"), D.STOP_WORDS), "url": urls.path_terms(F.col("url")), "tag": F.transform(F.coalesce("tags", none), F.lower)}
    marked = lambda c, source: F.transform(c, lambda t: F.struct(t.alias("term"), F.lit(source).alias("source")))
    said = F.flatten(F.array(*[marked(c, source) for source, c in where.items()]))
    known = F.broadcast(rows.sparkSession.createDataFrame([(w,) for w in sorted({*vocabulary(), *D.STOP_WORDS, *D.WEB_TERMS})], "term string"))
    found = rows.select("pos", "title", F.explode(said).alias("s")).select("pos", "title", "s.term", "s.source").join(known, "term", "left_anti")
    counted = found.groupBy("term").agg(F.count("*").alias("frequency"), F.min("pos").alias("first_pos"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return counted.where(F.col("frequency") >= least).orderBy(F.desc("frequency"), "first_pos", "term").limit(most)


def discovered_domains(rows: DataFrame, least: int = 2, most: int = 30) -> DataFrame:
    named = rows.select(urls.domain(F.col("url")).alias("domain")).where("domain <> ''")
    return named.groupBy("domain").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "domain").limit(most)


#: Parts of hosts by the folder that they suggest.
HOST_CLASSES = {
    "Code Repositories": ["github", "gitlab", "bitbucket"],
    "Blogs & Articles": ["medium", "substack", "blog"],
    "Video Content": ["youtube", "vimeo", "video"],
    "Documentation": ["docs", "documentation", "wiki"],
}


def folder_suggestions(domains: DataFrame, most: int = 10) -> DataFrame:
    """(folder, n) from (domain, n): classes of hosts, else hosts with five rows by themselves."""
    name = F.when(F.col("n") >= 5, F.concat(F.lit("From "), F.col("domain")))
    for folder, words in reversed(HOST_CLASSES.items()):
        name = F.when(text.any_of(F.col("domain"), words), folder).otherwise(name)
    return domains.select(name.alias("folder"), "n").where("folder IS NOT NULL").groupBy("folder").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "folder").limit(most)


def tag_metrics(rows: DataFrame) -> DataFrame:
    """One row: total, tagged, unique_tags, avg_tags (of tagged rows), score of 0 to 1."""
    none = F.array().cast("array<string>")
    n = F.size(F.coalesce("tags", none))
    base = rows.agg(F.count("*").alias("total"), F.count_if(n > 0).alias("tagged"), F.sum(n).alias("uses"))
    used = rows.select(F.explode(F.coalesce("tags", none)).alias("tag")).agg(F.count_distinct("tag").alias("unique_tags"))
    avg = F.when(F.col("tagged") > 0, F.col("uses") / F.col("tagged")).otherwise(0.0)
    share = F.when(F.col("total") > 0, F.col("tagged") / F.col("total")).otherwise(0.0)
    many = F.when(avg < 3, avg / 3).when(avg <= 5, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (avg - 5) / 5))
    spread = F.when(F.col("total") > 0, F.least(F.lit(1.0), F.col("unique_tags") / (F.col("total") * 0.3))).otherwise(0.0)
    both = base.join(F.broadcast(used))  # two single rows
    return both.select("total", "tagged", "unique_tags", F.round(avg, 6).alias("avg_tags"), F.round(share * 0.4 + many * 0.3 + spread * 0.3, 6).alias("score"))


def folder_metrics(rows: DataFrame) -> DataFrame:
    """One row: rows, folders, cv (population), avg_depth, score of 0 to 1."""
    sizes = rows.where(F.coalesce("folder", F.lit("")) != "").groupBy("folder").agg(F.count("*").alias("n"))
    told = sizes.agg(F.sum("n").alias("rows"), F.count("*").alias("folders"), (F.stddev_pop("n") / F.avg("n")).alias("cv"), (F.sum(F.size(F.split("folder", "/")) * F.col("n")) / F.sum("n")).alias("avg_depth"))
    f, d = F.col("folders"), F.col("avg_depth")
    number = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 0.5 * F.abs(1 - f / (2 * F.sqrt("rows")))))
    even = F.greatest(F.lit(0.0), 1 - 0.3 * F.col("cv"))
    deep = F.when(d < 2, d / 2).when(d <= 3, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (d - 3) / 3))
    return told.select("rows", "folders", F.round("cv", 6).alias("cv"), F.round("avg_depth", 6).alias("avg_depth"), F.round(F.when(f > 0, number * 0.4 + even * 0.3 + deep * 0.3).otherwise(0.0), 6).alias("score"))


def description_confidence(enhanced: Column, given: Column, excerpt: Column, note: Column, title: Column) -> Column:
    has = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    return F.when(has(enhanced), F.coalesce(given, F.lit(0.8))).when(has(excerpt), 0.7).when(has(note), 0.6).when(has(title), 0.3).otherwise(0.0)


def overall(description: Column, tag: Column, folder: Column) -> Column:
    return description * 0.4 + tag * 0.35 + folder * 0.25


def attention(rows: DataFrame, confidence: Column, invalid: Column) -> DataFrame:
    """(reason, n) over rows with a reason to look at them; a row can have several."""
    none = F.array().cast("array<string>")
    flags = {
        "low_confidence": confidence < 0.5,
        "untagged": F.size(F.coalesce("tags", none)) == 0,
        "invalid_url": invalid,
        "missing_title": F.length(F.trim(F.coalesce("title", F.lit("")))) == 0,
    }
    reasons = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in flags.items()]), lambda r: r.isNotNull())
    return rows.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def export_statistics(rows: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    said = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0
    base = rows.agg(
        F.count("*").alias("total"), F.count_distinct(F.when(said("folder"), F.col("folder"))).alias("unique_folders"), F.count_if(said("note")).alias("with_notes"),
        F.count_if(F.size(F.coalesce("tags", none)) > 0).alias("with_tags"), F.count_if(F.col("created").isNotNull()).alias("with_dates"),
    )
    used = rows.select(F.explode(F.coalesce("tags", none)).alias("tag")).agg(F.count_distinct("tag").alias("unique_tags"))
    return base.join(F.broadcast(used))  # two single rows


def health_counts(checks: DataFrame) -> DataFrame:
    """(status, n); errors count as dead."""
    return checks.groupBy(F.when(F.col("status") == "error", "dead").otherwise(F.col("status")).alias("status")).agg(F.count("*").alias("n"))


def review_list(buckets: list[tuple[str, DataFrame]], key: str = "url") -> DataFrame:
    """(key, bucket, reasons): every key of the buckets once, with the first bucket that has it and all of them in order."""
    names = [name for name, _ in buckets]
    every = None
    for i, (_, rows) in enumerate(buckets):
        part = rows.select(key, F.lit(i).alias("_i"))
        every = part if every is None else every.unionByName(part)
    listed = F.array(*[F.lit(n) for n in names])
    told = every.groupBy(key).agg(F.array_sort(F.collect_set("_i")).alias("_all"))
    reasons = F.transform("_all", lambda i: F.element_at(listed, i + 1))
    return told.select(key, F.element_at(reasons, 1).alias("bucket"), reasons.alias("reasons"))


def reorganised(rows: DataFrame, original: DataFrame, key: str = "url") -> DataFrame:
    """One row: rows with a folder whose original has another one."""
    was = original.select(key, F.col("folder").alias("_was"))
    moved = (F.coalesce("folder", F.lit("")) != "") & (F.coalesce("_was", F.lit("")) != F.col("folder")) & F.col("_known")
    return rows.join(was.withColumn("_known", F.lit(True)), key, "left").agg(F.count_if(F.coalesce(moved, F.lit(False))).alias("reorganised"))


def health_text(checks: DataFrame, most: int = 20) -> DataFrame:
    """(place, line): a report as lines, counts by status and then the first problem URLs (status, url) by URL."""
    counts = health_counts(checks).select(F.lit(1).alias("part"), F.col("status").alias("by"), F.concat("status", F.lit(": "), F.col("n").cast("string")).alias("line"))
    bad = checks.where(~F.col("status").isin("healthy", "redirected")).orderBy("url").limit(most)
    listed = bad.select(F.lit(2), F.col("url").cast("string"), F.concat(F.lit("- "), F.col("url").cast("string"), F.lit(" ("), "status", F.lit(")")))
    return counts.union(listed).orderBy("part", "by").select("part", "line")


def health_transitions(previous: DataFrame, current: DataFrame, key: str = "url") -> DataFrame:
    """(key, change): newly_dead, recovered, changed content, new, same."""
    old = previous.select(key, F.col("status").alias("was"), F.col("content_hash").alias("hash_was"))
    gone = lambda c: F.col(c).isin("dead", "error")
    both = current.join(old, key, "left")
    change = (
        F.when(F.col("was").isNull(), "new").when(gone("status") & ~gone("was"), "newly_dead").when(~gone("status") & gone("was"), "recovered")
        .when(F.coalesce(F.col("content_hash") != F.col("hash_was"), F.lit(False)), "changed").otherwise("same")
    )
    return both.select(key, change.alias("change"))
