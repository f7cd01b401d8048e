"""The enrichment of a collection: duplicates, checks, content, descriptions, tags, folders, output.

Fetching and text generation are functions of the caller; without them the offline rules apply. A stage's result
can be kept as Parquet under a work folder, and a later run of the same input with the same settings starts behind the last one
kept, unless that is older than ``max_age_days``. The input is told by ``input_id``, else by a count and hash sum of its rows; the settings by a digest of
all that can change a stage's rows (functions by their names). Hooks of plugins stand before and after the stages.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import errors, html, tags, urls
from ..operators import bookmarks, dedup, folders, tagging
from ..operators.predicates import Predicate
from ..plugins import Registry
from .tables import scratch

STAGES = ("dedup", "validation", "content", "ai", "tags", "folders")


@dataclass(frozen=True)
class Options:
    """What to do. ``now`` fixes the clock; ``fetch`` maps a DataFrame of urls to (url, html, status_code)."""

    strategy: str = "highest_quality"
    stages: tuple[str, ...] = STAGES
    wanted: Predicate | None = None
    fetch: Callable[[DataFrame], DataFrame] | None = None
    describe: Callable[[DataFrame], DataFrame] | None = None
    attempts: int = 1
    target_tags: int = 150
    tags_per_row: int = 5
    folder_limit: int = 20
    preview: int | None = None
    now: str = "2024-06-01 00:00:00"
    work: str | None = None
    input_id: str = ""
    max_age_days: int = 7
    plugins: Registry = field(default_factory=Registry)

    def only(self, *stages: str) -> Options:
        return replace(self, stages=stages)


def checked(rows: DataFrame, fetched: DataFrame | None) -> DataFrame:
    """Adds is_valid, error_type and what was fetched. Each URL is fetched once, however many rows have it."""
    safe = urls.security(F.col("url"))["is_safe"] & urls.well_formed(F.col("url")) & ~urls.skipped(F.col("url"))
    if fetched is None:
        told = F.struct(safe.alias("safe"), urls.mock_valid(F.col("url")).alias("good"), F.lit("mock_error").alias("error"))
        out = rows.withColumn("html", F.lit(None).cast("string"))
    else:
        code = F.coalesce("status_code", F.lit(0))
        told = F.struct(safe.alias("safe"), code.between(200, 399).alias("good"), errors.http_error(code).alias("error"))
        out = rows.join(fetched.select("url", "html", "status_code"), "url", "left")
    # One value per row that later filters and columns read, not three copies of the rules.
    out = out.withColumn("_told", F.explode(F.array(told)))
    c = lambda name: F.col(f"_told.{name}")
    return out.withColumns({"is_valid": c("safe") & c("good"), "error_type": F.when(~c("safe"), "unsafe").when(~c("good"), c("error"))}).drop("_told", "status_code")


def described(rows: DataFrame) -> DataFrame:
    said = bookmarks.fallback_description(F.col("title"), F.col("note"), F.col("excerpt"), F.col("url"))
    return rows.withColumn("enhanced_description", said)


def analysed(rows: DataFrame) -> DataFrame:
    page = F.coalesce("html", F.lit(""))
    out = rows.withColumns({"page_title": html.title(page), "page_description": html.description(page), "body": html.plain(page), "headings": html.headings(page), "page_keywords": html.meta(page, "keywords"), "language": html.language(page)})
    words = html.word_count(F.col("body"))
    # A row without a page has no content, so nothing of it counts as a category.
    found = F.when(F.col("html").isNotNull(), html.categories(F.col("url"), F.col("page_title"), F.col("body"))).otherwise(F.array().cast("array<string>"))
    return out.withColumns(
        {
            "word_count": words, "reading_minutes": html.reading_minutes(words), "categories": found,
            "page_quality": html.quality(F.col("page_title"), F.col("page_description"), words, F.size("headings"), F.col("language")),
        }
    )


def said(rows: DataFrame) -> Column:
    """What folders are told by beside title, note and URL: tags, the page's title and description (else the excerpt), the new description."""
    has = set(rows.columns)
    parts = [F.array_join("tags", " ")] + [F.col(c) for c in ("page_title", "enhanced_description") if c in has]
    if "page_description" in has:
        parts.append(F.coalesce(F.nullif("page_description", F.lit("")), "excerpt"))
    return F.concat_ws(" ", *parts)


def run(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """The rows of valid URLs with what the stages add; stages that are not asked for leave rows as they are."""
    spark, plugins = rows.sparkSession, options.plugins
    given = _input(rows, options)
    rows = plugins.chain("on_load", rows)
    if options.wanted is not None:
        rows = options.wanted.apply(rows)
    if options.preview is not None:
        rows = rows.orderBy("pos").limit(options.preview)
    if "dedup" in options.stages:
        rows = dedup.process(rows.withColumn("dedup_key", urls.dedup_key(F.col("url"))), options.strategy, F.lit(options.now).cast("timestamp"))
        rows = _kept(spark, options, given, "dedup", rows)
    if "validation" in options.stages:
        rows = plugins.chain("pre_validation", rows)
        fetched = fetched_with_retries(options.fetch, rows.select("url").distinct(), options.attempts) if options.fetch else None
        rows = plugins.chain("validation_filter", plugins.chain("post_validation", checked(rows, fetched))).where("is_valid")
        rows = _kept(spark, options, given, "validation", rows)
    if "content" in options.stages and "html" in rows.columns:
        rows = plugins.chain("post_content", plugins.chain("content_enhance", analysed(plugins.chain("pre_content", rows))))
    if "ai" in options.stages:
        rows = plugins.chain("pre_ai", rows)
        rows = plugins.chain("ai_process", rows) if plugins.at("ai_process") else (options.describe or described)(rows)
        rows = _kept(spark, options, given, "ai", plugins.chain("post_ai", rows))
    if "tags" in options.stages:
        rows = plugins.chain("tag_generate", plugins.chain("pre_tags", rows))
        # Used several times below: written once, so nothing is pinned in memory and a lost executor costs a reread.
        rows = _held(spark, rows, "tagged")
        found = _held(spark, tagging.candidates(rows), "candidates")
        pages = rows.where("html IS NOT NULL") if {"html", "body", "categories", "headings"} <= set(rows.columns) else None
        scores = tagging.scored(found, rows, pages)
        chosen = spark.createDataFrame([(t,) for t in tagging.selected(scores, options.target_tags)], "tag string")  # target_tags of them at most
        best = tagging.assigned(rows, chosen, options.tags_per_row).groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "tag"))), lambda t: t["tag"]).alias("optimized_tags"))
        rows = plugins.chain("post_tags", rows.join(best, "url", "left"))
    if "folders" in options.stages:
        rows = plugins.chain("pre_folders", rows)
        named = _held(spark, folders.categorised(rows.withColumn("_said", said(rows)), "_said").drop("_said"), "categorised")
        rows = plugins.chain("post_folders", folders.filed(named, options.folder_limit))
    return rows


def fetched_with_retries(fetch: Callable[[DataFrame], DataFrame], asked: DataFrame, attempts: int) -> DataFrame:
    """(url, html, status_code): what ``fetch`` gives; URLs whose answer is a passing error are asked for again, up to so many times in all."""
    done = fetch(asked).select("url", "html", "status_code")
    for _ in range(attempts - 1):
        passing = F.coalesce("status_code", F.lit(0)).isin(0, 408, 425, 429, 500, 502, 503, 504)
        done = _held(asked.sparkSession, done, "fetched")
        again = done.where(passing).select("url")
        if again.isEmpty():
            break
        done = done.where(~passing).unionByName(fetch(again).select("url", "html", "status_code"))
    return done


def _held(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    path = scratch(spark, name)
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _input(rows: DataFrame, options: Options) -> str:
    """What tells this input from others: its id, else a count and hash sum of its rows."""
    if options.work is None or options.input_id:
        return options.input_id
    told = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).cast("decimal(38,0)")).alias("sum")).first()
    return f"{told.n}-{told['sum']}"


def _digest(options: Options, stage: str) -> str:
    """Changes with every setting that has a say in the rows of a stage."""
    name = lambda f: None if f is None else f"{getattr(f, '__module__', '')}.{getattr(f, '__qualname__', repr(f))}"
    told = {
        "stages": [s for s in options.stages if STAGES.index(s) <= STAGES.index(stage)], "strategy": options.strategy, "preview": options.preview, "now": options.now, "attempts": options.attempts,
        "wanted": None if options.wanted is None else [options.wanted.name, str(options.wanted.column)], "fetch": name(options.fetch), "describe": name(options.describe),
        "plugins": sorted([p.name, p.version, p.priority, sorted(p.hooks)] for p in options.plugins.plugins.values()),
    }
    return hashlib.md5(json.dumps(told, sort_keys=True).encode()).hexdigest()[:16]


def _kept(spark: SparkSession, options: Options, given: str, stage: str, rows: DataFrame) -> DataFrame:
    """The stage's rows from the work folder if a run of this input with these settings kept them whole, else kept there now."""
    if options.work is None:
        return rows
    path = f"{options.work}/{given}/{_digest(options, stage)}/{stage}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at) or time.time() - fs.getFileStatus(at).getModificationTime() / 1000 > options.max_age_days * 86400:
        rows.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def output(rows: DataFrame, plugins: Registry | None = None) -> DataFrame:
    """Import rows with the generated description, the assigned tags and the new folder; plugins may change rows before and after."""
    plugins = plugins or Registry()
    rows = plugins.chain("pre_export", rows)
    has = set(rows.columns)
    changed = rows.withColumns(
        {
            "note": bookmarks.effective_description(*[F.col(c) for c in ("enhanced_description", "note", "excerpt") if c in has]),
            "tags": tags.final(F.col("tags"), F.col("optimized_tags")) if "optimized_tags" in has else F.col("tags"),
            "folder": F.col("path") if "path" in has else F.col("folder"),
        }
    )
    return plugins.chain("post_export", bookmarks.import_row(changed))


def results(rows: DataFrame) -> DataFrame:
    """One row: rows, tagged rows, distinct tags, folders."""
    none = F.array().cast("array<string>")
    listed = F.coalesce("optimized_tags", none) if "optimized_tags" in rows.columns else F.coalesce("tags", none)
    place = "path" if "path" in rows.columns else "folder"
    used = rows.select(F.explode(listed).alias("tag")).agg(F.count_distinct("tag").alias("unique_tags"))
    told = rows.agg(F.count("*").alias("rows"), F.count_if(F.size(listed) > 0).alias("tagged"), F.count_distinct(place).alias("folders"))
    return told.join(F.broadcast(used)).select("rows", "tagged", F.col("unique_tags").cast("int").alias("unique_tags"), "folders")  # two single rows
