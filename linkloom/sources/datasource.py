"""Keyed collections: fetch with filters, point lookups, updates, additions, removals; API items and sparse updates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import bookmarks
from ..operators.predicates import Predicate

#: An item of a link service.
ITEM = "struct<_id: long, link: string, title: string, excerpt: string, note: string, type: string, cover: string, tags: array<string>, created: string, important: boolean, collectionId: long>"


class Collection:
    """An immutable collection keyed by normalised URL; every change gives a new one."""

    def __init__(self, rows: DataFrame):
        self.rows = rows if "normalized_url" in rows.columns else rows.withColumn("normalized_url", urls.identity_key(F.col("url")))

    def fetch(self, wanted: Predicate | None = None) -> DataFrame:
        return self.rows if wanted is None else wanted.apply(self.rows)

    def by_url(self, url: str) -> DataFrame:
        return self.rows.where(F.col("normalized_url") == urls.identity_key(F.lit(url))).limit(1)

    def updated(self, changes: DataFrame) -> tuple[Collection, DataFrame]:
        """With rows replaced by key (the last change by ``pos`` counts), and (normalized_url, ok) of each change."""
        changes = Collection(changes).rows
        last = changes.groupBy("normalized_url").agg(F.max_by(F.struct(*changes.columns), "pos").alias("r")).select("r.*")
        known = self.rows.select("normalized_url").distinct().withColumn("ok", F.lit(True))
        told = last.join(known, "normalized_url", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
        good = told.where("ok").select(*self.rows.columns)
        kept = self.rows.join(good.select("normalized_url"), "normalized_url", "left_anti").select(*self.rows.columns)
        return Collection(kept.unionByName(good)), told.select("normalized_url", "ok")

    def added(self, rows: DataFrame) -> Collection:
        new = Collection(rows).rows.join(self.rows.select("normalized_url"), "normalized_url", "left_anti")
        return Collection(self.rows.unionByName(new.select(*self.rows.columns)))

    def removed(self, rows: DataFrame) -> Collection:
        return Collection(self.rows.join(Collection(rows).rows.select("normalized_url"), "normalized_url", "left_anti").select(*self.rows.columns))


def items(raw: DataFrame, json_col: str, collections: DataFrame | None = None) -> DataFrame:
    """Bookmarks from JSON items; folders by (collectionId, folder) rows."""
    item = raw.select(F.from_json(json_col, ITEM).alias("i")).select("i.*")
    if collections is not None:
        item = item.join(collections, "collectionId", "left")
    folder = F.coalesce("folder", F.lit("")) if collections is not None else F.lit("")
    rows = item.select(F.col("_id").cast("string").alias("id"), F.col("link").alias("url"), "title", "note", "excerpt", "cover", folder.alias("folder"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), text.parse_time(F.col("created")).alias("created"), F.coalesce("important", F.lit(False)).alias("favorite"))
    return bookmarks.with_keys(rows.where("url IS NOT NULL"))


def sparse_update() -> Column:
    """The JSON object of a row's non-empty fields."""
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    tags = F.when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0, F.col("tags"))
    return F.to_json(F.struct(full("title").alias("title"), full("note").alias("note"), full("excerpt").alias("excerpt"), tags.alias("tags")))


def paged(spark: SparkSession, fetch: Callable[[int, int], list[str]], per_page: int = 50, most_pages: int = 200, slices: int = 8) -> DataFrame:
    """JSON items of a paged service: ``fetch(page, per_page)`` runs on the executors; a page without items ends its slice.

    A service with more than ``most_pages`` full pages is an error, not a shorter result.
    """

    def run(batches) -> Iterator:
        import pandas as pd

        for batch in batches:
            for first in batch["first"]:
                for page in range(int(first), most_pages, slices):
                    found = fetch(page, per_page)
                    if not found:
                        break
                    yield pd.DataFrame({"item": found})
                else:
                    last = range(int(first), most_pages, slices)[-1:]
                    if last and last[0] == most_pages - 1 and len(found) >= per_page:
                        raise RuntimeError(f"more than {most_pages} pages; raise most_pages")

    starts = spark.range(slices).select(F.col("id").alias("first")).repartition(slices)
    return starts.mapInPandas(run, "item string")


def since_last_run(rows: DataFrame, runs: DataFrame, source: str) -> DataFrame:
    """Rows created after the start of the last completed run of a source; all of them if there is none."""
    last = runs.where((F.col("source") == source) & F.col("completed_at").isNotNull()).agg(F.max("started_at").alias("_since"))
    return rows.join(F.broadcast(last)).where(F.col("_since").isNull() | (F.col("created") > F.col("_since"))).drop("_since")  # one row


def push(rows: DataFrame, send: Callable[[list[str]], list[bool]], batch: int = 50) -> DataFrame:
    """(url, ok): sparse updates sent in batches from the executors; a batch that fails is sent again one by one."""
    shaped = rows.select("url", sparse_update().alias("body"))

    def run(batches) -> Iterator:
        import pandas as pd

        for frame in batches:
            for a in range(0, len(frame), batch):
                some = frame.iloc[a : a + batch]
                bodies = list(some["body"])
                try:
                    ok = send(bodies)
                except OSError:
                    ok = []
                    for b in bodies:
                        try:
                            ok += send([b])
                        except OSError:
                            ok.append(False)
                yield pd.DataFrame({"url": some["url"], "ok": ok})

    return shaped.mapInPandas(run, "url string, ok boolean")


def write_backup(rows: DataFrame, path: str) -> None:
    rows.select("url", "title", "note", "folder", "tags", "created").write.mode("errorifexists").json(path)


def read_backup(spark: SparkSession, path: str) -> DataFrame:
    return bookmarks.with_keys(spark.read.schema("url string, title string, note string, folder string, tags array<string>, created timestamp").json(path))
