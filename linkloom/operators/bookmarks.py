"""Row projections: from export rows to typed bookmarks, effective texts, export rows, change proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags, text, urls


def folder_parts(folder: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(folder, F.lit("")), "/"), text.strip), lambda p: p != "")


def typed(rows: DataFrame) -> DataFrame:
    """Export rows as bookmarks: cleaned texts, parsed tags, date and flag, keys. Rows without a URL go."""
    out = rows.select(
        *[c for c in ("pos", "source_file") if c in rows.columns],
        *[text.clean(F.col(c)).alias(c) for c in ("id", "title", "note", "excerpt", "folder", "cover", "highlights")],
        urls.clean_url(F.col("url")).alias("url"),
        tags.parse_import(F.col("tags")).alias("tags"),
        text.parse_time(F.col("created")).alias("created"),
        text.parse_bool(F.col("favorite")).alias("favorite"),
    ).where("url <> ''")
    return with_keys(out)


def with_keys(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"normalized_url": urls.identity_key(F.col("url")), "folder_hierarchy": folder_parts(F.col("folder"))})


def effective_title(title: Column, url: Column, found: Column | None = None) -> Column:
    """The title, else the page's, else the host, else the URL, else a placeholder."""
    steps = [text.blank_to_null(title), *([text.blank_to_null(found)] if found is not None else []), text.blank_to_null(urls.authority(url)), text.blank_to_null(url)]
    return F.coalesce(*steps, F.lit("Untitled Bookmark"))


def effective_description(*sources: Column) -> Column:
    """The first that is not blank: generated, note, excerpt, page description."""
    return F.coalesce(*[text.blank_to_null(c) for c in sources], F.lit(""))


def fallback_description(title: Column, note: Column, excerpt: Column, url: Column, most: int = 150) -> Column:
    said = F.coalesce(text.blank_to_null(note), text.blank_to_null(excerpt), F.concat(text.blank_to_null(title), F.lit(" from "), urls.domain(url)), F.lit(""))
    return F.when(F.length(said) > most, F.concat(F.left(said, F.lit(most - 3)), F.lit("..."))).otherwise(said)


def prompt(title: Column, note: Column, excerpt: Column, url: Column) -> Column:
    """Labelled fields for a text generator; blank ones are left out."""
    labelled = [F.concat(F.lit(f"{name}: "), text.blank_to_null(c)) for name, c in (("Title", title), ("Note", note), ("Excerpt", excerpt), ("Domain", urls.domain(url)))]
    return F.concat_ws(" | ", *labelled)


def import_row(rows: DataFrame) -> DataFrame:
    """The six columns of an import file."""
    return rows.where(F.length(F.trim("url")) > 0).select(
        "url", F.coalesce("folder", F.lit("")).alias("folder"), effective_title(F.col("title"), F.col("url")).alias("title"), F.coalesce("note", F.lit("")).alias("note"),
        tags.exported(F.col("tags")).alias("tags"), F.coalesce(F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("")).alias("created"),
    )


def with_folder_tags(tag_list: Column, folder: Column, most: int = 5) -> Column:
    """Tags with the folder's parts behind them, distinct, the first few."""
    parts = F.transform(folder_parts(folder), lambda p: F.regexp_replace(F.lower(p), r"\s+", "-"))
    return F.slice(F.array_distinct(F.concat(F.coalesce(tag_list, F.array().cast("array<string>")), parts)), 1, most)


def proposed_changes(rows: DataFrame, described: float = 0.4, tagged: float = 0.3, filed: float = 0.3) -> DataFrame:
    """Flags and weighted confidence of proposals (note, tags, folder against new_*). Tags compare as sets; no change counts as sure."""
    sure = lambda flag, c, w: F.when(F.col(flag), F.coalesce(F.col(c), F.lit(0.0))).otherwise(1.0) * w
    out = rows.withColumns(
        {
            "has_description_change": F.coalesce(F.col("new_note") != F.coalesce("note", F.lit("")), F.lit(False)),
            "has_tags_change": F.coalesce(F.array_sort(F.array_distinct("new_tags")) != F.array_sort(F.array_distinct("tags")), F.lit(False)),
            "has_folder_change": F.coalesce(F.col("new_folder") != F.coalesce("folder", F.lit("")), F.lit(False)),
        }
    )
    total = sure("has_description_change", "note_confidence", described) + sure("has_tags_change", "tags_confidence", tagged) + sure("has_folder_change", "folder_confidence", filed)
    return out.withColumn("confidence", F.round(total, 6))


def applied(rows: DataFrame, action: Column) -> DataFrame:
    """Rows with an action taken: accept, description, tags, folder; anything else keeps the row."""
    put = lambda new, old, part: F.when(action.isin("accept", part) & F.col(new).isNotNull(), F.col(new)).otherwise(F.col(old)).alias(old)
    others = [c for c in rows.columns if c not in ("note", "tags", "folder", "new_note", "new_tags", "new_folder")]
    return rows.select(*others, put("new_note", "note", "description"), put("new_tags", "tags", "tags"), put("new_folder", "folder", "folder"))


def undone(decided: DataFrame, steps: int = 1) -> DataFrame:
    """(pos, action) as they stand when the last decisions (pos, action, step) are taken back."""
    last = decided.agg(F.max("step").alias("_last"))
    kept = decided.join(F.broadcast(last)).where(F.col("step") <= F.col("_last") - steps)  # one row
    return kept.groupBy("pos").agg(F.max_by("action", "step").alias("action"))


def auto_accepted(rows: DataFrame, threshold: float = 0.8) -> DataFrame:
    return applied(rows, F.when(F.col("confidence") >= threshold, "accept").otherwise("skip"))


def status_label(s: Column) -> Column:
    """Error, Processed, Validated or Pending from a processing_status struct."""
    failed = s["url_validation_error"].isNotNull() | s["content_extraction_error"].isNotNull() | s["ai_processing_error"].isNotNull()
    return F.when(failed, "Error").when(s["ai_processed"], "Processed").when(s["url_validated"], "Validated").otherwise("Pending")
