"""Browser bookmark files: nested lists of links under headings, as rows and back."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escape_html

ROW = "pos long, url string, title string, folder string, created timestamp, source_file string"


class _Links(HTMLParser):
    """Folder path and attributes of every link, each once. The toolbar's own heading is no folder."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path: list[str] = []
        self.levels: list[bool] = []
        self.found: list[list] = []
        self.heading: str | None = None
        self.toolbar = False
        self.into: str | None = None

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "h3":
            self.into, self.heading, self.toolbar = "h3", "", (given.get("personal_toolbar_folder") or "").lower() == "true"
        elif tag == "a" and given.get("href"):
            self.into = "a"
            self.found.append([given["href"], "", "/".join(self.path), given.get("add_date")])
        elif tag == "dl":
            named = self.heading is not None and not self.toolbar
            if named:
                self.path.append((self.heading or "").strip())
            self.levels.append(named)
            self.heading, self.toolbar = None, False

    def handle_endtag(self, tag):
        if tag in ("a", "h3"):
            self.into = None
        elif tag == "dl" and self.levels:
            if self.levels.pop():
                self.path.pop()

    def handle_data(self, data):
        if self.into == "a":
            self.found[-1][1] += data
        elif self.into == "h3":
            self.heading = (self.heading or "") + data


def parse(html: str) -> list[tuple[str, str, str, str | None]]:
    """(url, title, folder, add_date) of every link in file order."""
    links = _Links()
    links.feed(html)
    links.close()
    return [(u, t.strip(), f, d) for u, t, f, d in links.found]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of one or many files; positions are in file order within a file. A file is parsed whole by one task."""

    def rows(batches):
        import pandas as pd

        for batch in batches:
            found = [(i, *link, name) for name, html in zip(batch["path"], batch["value"], strict=True) for i, link in enumerate(parse(html))]
            yield pd.DataFrame(found, columns=["pos", "url", "title", "folder", "add_date", "source_file"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    links = files.mapInPandas(rows, "pos long, url string, title string, folder string, add_date string, source_file string")
    return links.withColumn("created", F.timestamp_seconds(F.col("add_date").try_cast("long"))).drop("add_date").select("pos", "url", "title", "folder", "created", "source_file")


def generate(rows: DataFrame, title: str = "Bookmarks") -> str:
    """A file with folders in order, then links by title. A browser takes one file, so it is made on the driver, row by row."""
    shown = rows.select(F.coalesce("folder", F.lit("")).alias("folder"), "url", escape_html(F.col("url")).alias("href"), escape_html(F.coalesce("title", "url")).alias("title"), F.coalesce(F.unix_timestamp("created"), F.lit(0)).alias("added"))
    out = ["<!DOCTYPE NETSCAPE-Bookmark-file-1>", '<META HTTP-EQUIV="Content-Type" CONTENT="text/html; charset=UTF-8">', f"<TITLE>{title}</TITLE>", f"<H1>{title}</H1>", "<DL><p>"]
    here: list[str] = []
    for r in shown.orderBy("folder", F.lower("title"), "url").toLocalIterator():
        parts = [p for p in r.folder.split("/") if p]
        same = 0
        while same < min(len(here), len(parts)) and here[same] == parts[same]:
            same += 1
        out += ["</DL><p>"] * (len(here) - same)
        for p in parts[same:]:
            name = p.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
            out += [f"<DT><H3>{name}</H3>", "<DL><p>"]
        here = parts
        out.append(f'<DT><A HREF="{r.href}" ADD_DATE="{r.added}">{r.title}</A>')
    return "\n".join([*out, *["</DL><p>"] * len(here), "</DL><p>"]) + "\n"
