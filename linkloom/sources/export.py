"""Sinks: JSON, Markdown, note vaults, table imports and outlines. Rows are made in parallel; only formats that are one document are put together on the driver."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import anchor, escape_html, escape_yaml, file_name
from ..operators import bookmarks, reports



def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _tags() -> Column:
    return F.coalesce("tags", F.array().cast("array<string>"))


def as_objects(rows: DataFrame, metadata: bool = True) -> DataFrame:
    more = ["note", "excerpt", "favorite"] if metadata else []
    return rows.select("url", "title", _text("folder").alias("folder"), _tags().alias("tags"), "created", *[c for c in more if c in rows.columns])


def write_json_rows(rows: DataFrame, path: str, minimal: bool = False) -> None:
    """One object per line, in parallel."""
    out = rows.select("url", "title", _tags().alias("tags")) if minimal else as_objects(rows)
    out.write.mode("overwrite").json(path)


def write_json_document(rows: DataFrame, path: str, exported_at: str) -> None:
    """One document: export_info, bookmarks, by_folder, statistics. Streamed to the file row by row."""
    stats = reports.export_statistics(rows).first().asDict()
    folders = rows.groupBy(F.coalesce(F.nullif("folder", F.lit("")), F.lit("Unsorted")).alias("folder")).count().orderBy("folder")
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"export_info": ' + json.dumps({"exported_at": exported_at, "total": stats["total"]}) + ',\n"bookmarks": [')
        for i, line in enumerate(as_objects(rows).toJSON().toLocalIterator()):
            f.write((",\n" if i else "\n") + line)
        f.write('\n],\n"by_folder": ' + json.dumps({r.folder: r["count"] for r in folders.toLocalIterator()}) + ',\n"statistics": ' + json.dumps(stats) + "}\n")


def markdown_line(links: bool = True) -> Column:
    tags = F.when(F.size(_tags()) > 0, F.concat(F.lit(" `"), F.array_join(_tags(), "` `"), F.lit("`"))).otherwise("")
    note = F.when(_text("note") != "", F.concat(F.lit("\n  "), _text("note"))).otherwise("")
    return F.concat(F.lit("- ["), bookmarks.effective_title(F.col("title"), F.col("url")), F.lit("]("), F.col("url"), F.lit(")"), tags, note)


def write_markdown(rows: DataFrame, path: str, title: str = "Bookmarks") -> None:
    """One file with a section per folder and a table of contents."""
    listed = rows.select(F.coalesce(F.nullif("folder", F.lit("")), F.lit("Unsorted")).alias("folder"), markdown_line().alias("line"), F.lower(_text("title")).alias("by"), "url")
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"# {title}\n\n")
        for r in listed.select("folder", anchor(F.col("folder")).alias("a")).distinct().orderBy("folder").toLocalIterator():
            f.write(f"- [{r.folder}](#{r.a})\n")
        here = None
        for r in listed.orderBy("folder", "by", "url").toLocalIterator():
            if r.folder != here:
                f.write(f"\n## {r.folder}\n\n")
                here = r.folder
            f.write(r.line + "\n")


def write_markdown_folders(rows: DataFrame, path: str) -> None:
    """A directory per folder, lines in parallel."""
    rows.select(F.coalesce(F.nullif("folder", F.lit("")), F.lit("Unsorted")).alias("folder"), markdown_line().alias("value")).write.mode("overwrite").partitionBy("folder").text(path)


def vault_note() -> Column:
    """A note with front matter, as notebooks keep one per link."""
    tags = F.array_join(F.transform(_tags(), lambda t: F.concat(F.lit("  - "), t)), "\n")
    front = F.concat(F.lit('---\ntitle: "'), escape_yaml(bookmarks.effective_title(F.col("title"), F.col("url"))), F.lit('"\nurl: "'), escape_yaml(F.col("url")), F.lit('"\ntags:\n'), tags, F.lit("\n---\n"))
    return F.concat(front, F.lit("\n# "), bookmarks.effective_title(F.col("title"), F.col("url")), F.lit("\n\n"), _text("note"), F.lit("\n"))


def vault_files(rows: DataFrame) -> DataFrame:
    """(path, value): every note, an index per folder, and a map with the ten most recent links."""
    name = file_name(bookmarks.effective_title(F.col("title"), F.col("url")))
    folder = F.coalesce(F.nullif("folder", F.lit("")), F.lit("Unsorted"))
    named = rows.withColumn("folder", folder).withColumn("_name", name)
    turn = F.row_number().over(W.partitionBy("folder", "_name").orderBy("url"))
    named = named.withColumn("_name", F.when(turn > 1, F.concat("_name", F.lit(" "), turn.cast("string"))).otherwise(F.col("_name")))
    notes = named.select(F.concat("folder", F.lit("/"), "_name", F.lit(".md")).alias("path"), vault_note().alias("value"))
    listed = named.groupBy("folder").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- [["), "_name", F.lit("]]")))), "\n").alias("value"))
    index = listed.select(F.concat("folder", F.lit("/_index.md")).alias("path"), F.concat(F.lit("# "), "folder", F.lit("\n\n"), "value", F.lit("\n")).alias("value"))
    recent = named.where("created IS NOT NULL").orderBy(F.desc("created"), "url").limit(10)
    mapped = recent.agg(F.transform(F.sort_array(F.collect_list(F.struct("created", "_name")), False), lambda r: F.concat(F.lit("- [["), r["_name"], F.lit("]]"))).alias("ls"))
    return notes.union(index).union(mapped.select(F.lit("_map.md"), F.concat(F.lit("# Recent\n\n"), F.array_join("ls", "\n"), F.lit("\n"))))


def write_files(files: DataFrame, root: str) -> int:
    """Writes (path, value) rows below a folder of this machine, one by one."""
    n = 0
    for n, r in enumerate(files.toLocalIterator(), 1):
        at = os.path.normpath(os.path.join(root, r.path.replace("..", "")))
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "w", encoding="utf-8") as f:
            f.write(r.value)
    return n


def table_rows(rows: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """Columns of a table import: texts cut at 2000 characters, status, related titles if given."""
    short = lambda c: F.left(_text(c), F.lit(2000))
    status = bookmarks.status_label(F.col("processing_status")) if "processing_status" in rows.columns else F.lit("Pending")
    out = rows.select(F.col("url").alias("URL"), bookmarks.effective_title(F.col("title"), F.col("url")).alias("Name"), short("note").alias("Notes"), _text("folder").alias("Folder"), F.array_join(_tags(), ", ").alias("Tags"), F.coalesce(F.date_format("created", "yyyy-MM-dd"), F.lit("")).alias("Created"), status.alias("Status"))
    return out if related is None else out.join(related.withColumnRenamed("url", "URL"), "URL", "left").fillna("", ["Related"])


def related_titles(rows: DataFrame, most: int = 5) -> DataFrame:
    """(url, Related): titles of up to five other rows that share a tag, in order of title.

    Per tag only its first titles can be among anybody's first five others, so each tag passes on six.
    """
    tagged = rows.select("url", "title", F.explode(F.array_distinct(_tags())).alias("tag")).where(F.col("title").isNotNull())
    firsts = tagged.select("tag", "title").distinct().withColumn("n", F.row_number().over(W.partitionBy("tag").orderBy("title"))).where(F.col("n") <= most + 1)
    met = tagged.select("url", F.col("title").alias("own"), "tag").join(firsts.select("tag", "title"), "tag").where("own <> title")
    best = met.groupBy("url").agg(F.slice(F.array_sort(F.collect_set("title")), 1, most).alias("t"))
    return best.select("url", F.array_join("t", ", ").alias("Related"))


def write_table(rows: DataFrame, path: str, relations: bool = False) -> None:
    table_rows(rows, related_titles(rows) if relations else None).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def outline(feeds: Column | None = None) -> Column:
    name = escape_html(bookmarks.effective_title(F.col("title"), F.col("url")))
    kind = F.concat(F.lit(' type="rss" xmlUrl="'), escape_html(feeds), F.lit('"')) if feeds is not None else F.lit(' type="link"')
    return F.concat(F.lit('<outline text="'), name, F.lit('" title="'), name, F.lit('"'), kind, F.lit(' htmlUrl="'), escape_html(F.col("url")), F.lit('"/>'))


def write_outlines(rows: DataFrame, path: str, feeds: DataFrame | None = None) -> None:
    """A flat outline document's lines in parallel; with (url, feed_url) rows, feeds only."""
    if feeds is not None:
        rows = rows.join(feeds, "url")
    rows.select(outline(F.col("feed_url") if feeds is not None else None).alias("value")).write.mode("overwrite").text(path)


def outline_document(rows: DataFrame, title: str = "Bookmarks") -> str:
    """An outline nested by folder, as one document."""
    shown = rows.select(_text("folder").alias("folder"), outline().alias("line"), F.lower(_text("title")).alias("by"), "url").orderBy("folder", "by", "url")
    out, here = ['<?xml version="1.0" encoding="UTF-8"?>', '<opml version="2.0">', f"<head><title>{title}</title></head>", "<body>"], []
    for r in shown.toLocalIterator():
        parts = [p for p in r.folder.split("/") if p]
        same = 0
        while same < min(len(here), len(parts)) and here[same] == parts[same]:
            same += 1
        out += ["</outline>"] * (len(here) - same)
        for p in parts[same:]:
            name = p.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
            out.append(f'<outline text="{name}">')
        here = parts
        out.append(r.line)
    return "\n".join([*out, *["</outline>"] * len(here), "</body>", "</opml>"]) + "\n"


def warnings(rows: DataFrame) -> list[str]:
    told = rows.agg(F.count_if(F.trim(_text("url")) == "").alias("url"), F.count_if(F.trim(_text("title")) == "").alias("title")).first()
    return [f"{n} rows without a {c}" for c, n in told.asDict().items() if n]


def write_health(report: DataFrame, path: str, kind: str = "json") -> None:
    """Check rows as JSON or CSV; as text the short report, in one part file as it is a screenful."""
    if kind == "text":
        reports.health_text(report).orderBy("part", "line").select("line").coalesce(1).write.mode("overwrite").text(path)
        return
    writer = report.write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)


def write_review(rows: DataFrame, path: str, reasons: bool = True) -> None:
    """Rows to look at (url, title, reasons array) as CSV."""
    listed = [F.array_join("reasons", "; ").alias("reasons")] if reasons else []
    rows.select("url", "title", *listed).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def render(title: str, facts: dict, style: str = "plain") -> str:
    """A small table of facts as plain text, Markdown or JSON."""
    if style == "json":
        return json.dumps({"title": title, **facts}, default=str)
    if style == "markdown":
        return "\n".join([f"# {title}", "", "| | |", "|---|---|", *[f"| {k} | {v} |" for k, v in facts.items()]])
    width = max(map(len, facts), default=0)
    return "\n".join([title, "=" * len(title), *[f"{k.ljust(width)}  {v}" for k, v in facts.items()]])
