"""Processing state: content hashes, what is left to do, upserts, runs, history and comparisons.

Tables are Parquet folders that numbered markers add up; a lost writer leaves the table as it was.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def content_hash(rows: DataFrame) -> Column:
    """MD5 over url, title, note, excerpt, folder and the sorted tags."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")
    listed = F.array_join(F.array_sort(F.coalesce("tags", F.array().cast("array<string>"))), ",") if "tags" in rows.columns else F.lit("")
    return F.md5(F.concat_ws("|", *[text(c) for c in ("url", "title", "note", "excerpt", "folder")], listed).cast("binary"))


def unprocessed(rows: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    """Rows that are new, changed since, or failed."""
    old = done.select(key, F.col("content_hash").alias("_hash"), F.col("status").alias("_status"))
    return rows.join(old, key, "left").where("_hash IS NULL OR _hash <> content_hash OR _status = 'failed'").drop("_hash", "_status")


def upserted(table: DataFrame, changes: DataFrame, key: str = "url", order: str | None = None) -> DataFrame:
    """The table with rows replaced or added by key; of several changes of one key the last by ``order``."""
    if order:
        changes = changes.groupBy(key).agg(F.max_by(F.struct(*changes.columns), order).alias("r")).select("r.*")
    return table.join(changes.select(key), key, "left_anti").select(*table.columns).unionByName(changes.select(*table.columns))


def compared(before: DataFrame, after: DataFrame, key: str = "url") -> DataFrame:
    """(key, change): new, removed, changed, unchanged between two runs' (key, content_hash)."""
    a, b = before.select(key, F.col("content_hash").alias("a")), after.select(key, F.col("content_hash").alias("b"))
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def run_summary(runs: DataFrame) -> DataFrame:
    """Runs with success_rate (percent, two places) and duration in seconds."""
    rate = F.round(F.col("total_succeeded") / F.nullif(F.col("total_processed"), F.lit(0)) * 100, 2)
    seconds = F.unix_timestamp("completed_at") - F.unix_timestamp("started_at")
    return runs.select("*", rate.alias("success_rate"), seconds.alias("duration_seconds"))


def statistics(table: DataFrame, now: Column) -> DataFrame:
    """One row over processed rows: total, failed, last 7 days, folders, mean tags (from comma lists)."""
    n_tags = F.when(F.coalesce("tags", F.lit("")) == "", 0).otherwise(F.length("tags") - F.length(F.replace("tags", F.lit(","))) + 1)
    return table.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("processed_at") >= now - F.expr("INTERVAL 7 DAYS")).alias("recent"),
        F.count_distinct(F.nullif("folder", F.lit(""))).alias("folders"), F.round(F.avg(n_tags), 6).alias("avg_tags"),
    )


def by_date(table: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    out = table if start is None else table.where(F.col("processed_at") >= start)
    out = out if end is None else out.where(F.col("processed_at") <= end)
    return out.orderBy(F.desc("processed_at"), "url")


def by_folder(table: DataFrame, folder: str, exact: bool = False) -> DataFrame:
    return table.where(F.col("folder") == folder) if exact else table.where(F.lower("folder").startswith(folder.lower()))


def by_tag(table: DataFrame, tag: str, stored_lists: bool = False) -> DataFrame:
    """Rows whose comma list holds the tag. ``stored_lists`` repeats the old four patterns, which miss tags stored without blanks."""
    if stored_lists:
        return table.where((F.col("tags") == tag) | F.col("tags").startswith(f"{tag},") | F.col("tags").endswith(f", {tag}") | F.col("tags").contains(f", {tag},"))
    return table.where(F.array_contains(F.transform(F.split("tags", ","), F.trim), tag))


class Conflict(RuntimeError):
    """Other writers were faster, several times over."""


class StateStore:
    """The three state tables below a folder.

    A table is what its markers add up to: numbered files, each made only if no other writer has that number, that name a folder of
    Parquet to append, or folders to start again from. So readers see whole changes, and of two writers one takes the next number. Marking rows
    writes those rows, not the table: of rows appended for one URL the last counts. Every ``APPENDS`` changes the appended ones become one.
    """

    TABLES = {"processed_bookmarks": schemas.PROCESSED, "processing_runs": schemas.RUNS, "bookmark_history": schemas.HISTORY}
    APPENDS = 16
    ATTEMPTS = 20

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _live(self, table: str) -> tuple[int, list[dict]]:
        """The number of the newest marker, and the markers that count, from the last one that starts again."""
        fs, at = self._fs(f"{self.path}/{table}/_versions")
        if not fs.exists(at):
            return 0, []
        names = sorted(f.getPath().getName() for f in fs.listStatus(at))
        live: list[dict] = []
        for name in reversed(names):
            stream = fs.open(self._fs(f"{self.path}/{table}/_versions/{name}")[1])
            said = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            if said:  # a writer that was lost left an empty one
                live.append(json.loads(said))
                if live[-1]["kind"] == "start":
                    break
        return (int(names[-1]) if names else 0), live[::-1]

    def _folders(self, table: str, live: list[dict], run: int | None = None) -> list[str]:
        parts = [p for m in live for p in m["folders"] if run is None or p["run"] == run]
        return [f"{self.path}/{table}/{p['name']}" for p in parts]

    def _commit(self, table: str, number: int, told: dict) -> bool:
        """Takes the next number, unless another writer has."""
        fs, at = self._fs(f"{self.path}/{table}/_versions/{number + 1:09d}")
        try:
            out = fs.create(at, False)
        except Exception:
            if fs.exists(at):
                return False
            raise
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        return True

    def _write(self, table: str, rows: DataFrame, run: int = 0) -> dict:
        name = uuid.uuid4().hex
        columns = [f.name for f in self.spark.createDataFrame([], self.TABLES[table]).schema]
        rows.select(*columns).write.parquet(f"{self.path}/{table}/{name}")
        top = self.spark.read.schema(self.TABLES[table]).parquet(f"{self.path}/{table}/{name}").agg(F.max("id")).first()[0] if "id" in columns else None
        return {"name": name, "run": run, "top": top or 0}

    def _restarted(self, table: str, make: Callable[[DataFrame], DataFrame]) -> None:
        """The table anew from what it holds; made again if another writer came first."""
        for _ in range(self.ATTEMPTS):
            number, live = self._live(table)
            if self._commit(table, number, {"kind": "start", "folders": [self._write(table, make(self._read(table, live)))]}):
                return
        raise Conflict(table)

    def _appended(self, table: str, make: Callable[[int], DataFrame], run: int) -> None:
        """Rows made for ids above the greatest one so far; made again if another writer came first."""
        for _ in range(self.ATTEMPTS):
            number, live = self._live(table)
            part = self._write(table, make(max((p["top"] for m in live for p in m["folders"]), default=0)), run)
            if self._commit(table, number, {"kind": "append", "folders": [part]}):
                break
        else:
            raise Conflict(table)
        if len(live) + 1 >= self.APPENDS:
            if table == "bookmark_history":  # only appended to: the list of folders starts again, they stay
                self._commit(table, number + 1, {"kind": "start", "folders": [p for m in live for p in m["folders"]] + [part]})
            else:
                self._restarted(table, lambda now: now)

    def _read(self, table: str, live: list[dict]) -> DataFrame:
        folders = self._folders(table, live)
        if not folders:
            return self.spark.createDataFrame([], self.TABLES[table])
        read = self.spark.read.schema(self.TABLES[table])
        if table != "processed_bookmarks" or len(folders) == 1:
            return read.parquet(*folders)
        parts = [read.parquet(f).withColumn("_at", F.lit(i)) for i, f in enumerate(folders)]
        every = reduce(DataFrame.unionByName, parts)
        return every.groupBy("url").agg(F.max_by(F.struct(*parts[0].columns[:-1]), "_at").alias("r")).select("r.*")

    def read(self, table: str) -> DataFrame:
        return self._read(table, self._live(table)[1])

    def write(self, table: str, rows: DataFrame) -> None:
        """The table as these rows, whatever it held. Older folders stay until ``vacuum``."""
        self._restarted(table, lambda now: rows)

    def vacuum(self, hours: float = 24.0) -> None:
        """Deletes markers before the last start, and folders older than some hours that no marker counts any more."""
        for table in self.TABLES:
            number, live = self._live(table)
            fs, at = self._fs(f"{self.path}/{table}")
            if not live:
                continue
            kept = {p["name"] for m in live for p in m["folders"]} | {"_versions"}
            before = (time.time() - hours * 3600) * 1000
            for f in fs.listStatus(at):
                if f.getPath().getName() not in kept and f.getModificationTime() <= before:
                    fs.delete(f.getPath(), True)
            for f in fs.listStatus(self._fs(f"{self.path}/{table}/_versions")[1]):
                if int(f.getPath().getName()) <= number - len(live) and f.getModificationTime() <= before:
                    fs.delete(f.getPath(), False)

    def start_run(self, source: str, config_hash: str = "") -> int:
        run = 0

        def started(runs: DataFrame) -> DataFrame:
            nonlocal run
            run = (runs.agg(F.max("id")).first()[0] or 0) + 1
            new = self.spark.range(1).select(F.lit(run).cast("long").alias("id"), F.current_timestamp().alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"), F.lit(source).alias("source"), *[F.lit(0).cast("long").alias(c) for c in ("total_processed", "total_succeeded", "total_failed")], F.lit(config_hash).alias("config_hash"))
            return runs.unionByName(new)

        self._restarted("processing_runs", started)
        return run

    def complete_run(self, run: int, processed: int, succeeded: int, failed: int) -> None:
        done = F.col("id") == run
        told = {"total_processed": processed, "total_succeeded": succeeded, "total_failed": failed}
        self._restarted("processing_runs", lambda runs: runs.withColumns({"completed_at": F.when(done, F.current_timestamp()).otherwise(F.col("completed_at")), **{c: F.when(done, F.lit(n).cast("long")).otherwise(F.col(c)) for c, n in told.items()}}))

    def _history_of(self, run: int) -> DataFrame:
        """A run's history: only folders that it wrote are read."""
        folders = self._folders("bookmark_history", self._live("bookmark_history")[1], run)
        empty = self.spark.createDataFrame([], schemas.HISTORY)
        return self.spark.read.schema(schemas.HISTORY).parquet(*folders).where(F.col("run_id") == run) if folders else empty

    def run_totals(self, run: int) -> tuple[int, int, int]:
        """(processed, succeeded, failed) as the run's history tells."""
        told = self._history_of(run).agg(F.count("*").alias("n"), F.count_if(F.col("change_type") == "failed").alias("failed")).first()
        return told.n, told.n - told.failed, told.failed

    def mark(self, rows: DataFrame, run: int, status: str = "processed", engine: str = "local") -> None:
        """Appends rows (with content_hash) to the processed ones and to the history; marking the same rows again changes nothing but times."""
        table = self.read("processed_bookmarks")
        tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ",")
        text = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
        new = rows.select("url", "content_hash", F.current_timestamp().alias("processed_at"), F.lit(engine).alias("ai_engine"), text("enhanced_description").alias("description"), tags.alias("tags"), text("folder").alias("folder"), text("title").alias("title"), F.lit(status).alias("status"))
        new = new.groupBy("url").agg(F.max_by(F.struct(*new.columns), "content_hash").alias("r")).select("r.*")
        known = table.select("url", F.lit(True).alias("known"))
        change = F.when(F.lit(status == "failed"), "failed").when(F.col("known"), "updated").otherwise("created")
        added = new.join(known, "url", "left").select("url", F.lit(run).cast("long").alias("run_id"), "content_hash", "description", "tags", "folder", "title", F.col("processed_at").alias("changed_at"), change.alias("change_type"))
        seen = self._history_of(run).select("url", "content_hash")
        added = added.join(seen, ["url", "content_hash"], "left_anti")
        self._appended("bookmark_history", lambda top: added.withColumn("id", F.monotonically_increasing_id() + top + 1), run)
        self._appended("processed_bookmarks", lambda top: new, run)

    def history(self, url: str) -> DataFrame:
        runs = self.read("processing_runs").select(F.col("id").alias("run_id"), "source", "started_at")
        return self.read("bookmark_history").where(F.col("url") == url).join(runs, "run_id", "left").orderBy(F.desc("changed_at"), F.desc("id"))

    def recent_runs(self, most: int = 10, source: str | None = None) -> DataFrame:
        runs = self.read("processing_runs")
        return (runs.where(F.col("source") == source) if source else runs).orderBy(F.desc("started_at"), F.desc("id")).limit(most)

    def forget(self, older_than: Column | None = None, url: str | None = None) -> None:
        gone = F.col("url") == url if url is not None else (F.lit(True) if older_than is None else F.col("processed_at") < older_than)
        self._restarted("processed_bookmarks", lambda table: table.where(~F.coalesce(gone, F.lit(False))))

    def compare(self, first: int, second: int) -> DataFrame:
        runs = self.read("bookmark_history")
        last = lambda run: runs.where(F.col("run_id") == run).groupBy("url").agg(F.max_by("content_hash", "id").alias("content_hash"))
        return compared(last(first), last(second))

    def views(self) -> None:
        """Temporary views: failed_bookmarks, recent_bookmarks (100), run_summary."""
        table = self.read("processed_bookmarks")
        table.where("status = 'failed'").createOrReplaceTempView("failed_bookmarks")
        table.orderBy(F.desc("processed_at"), "url").limit(100).createOrReplaceTempView("recent_bookmarks")
        run_summary(self.read("processing_runs")).createOrReplaceTempView("run_summary")

    def export_state(self, path: str) -> None:
        """The three tables as JSON lines below a folder."""
        for table in self.TABLES:
            self.read(table).write.mode("overwrite").json(f"{path}/{table}")

    def import_state(self, path: str) -> None:
        """Bookmarks are upserted, runs and history appended where they are not there yet."""
        for table, ddl in self.TABLES.items():
            rows = self.spark.read.schema(ddl).json(f"{path}/{table}")
            if table == "processed_bookmarks":
                self._restarted(table, lambda now, rows=rows: upserted(now, rows))
            else:
                self._restarted(table, lambda now, rows=rows: now.unionByName(rows.join(now.select("id"), "id", "left_anti").select(*now.columns)))


def stale(rows: DataFrame, table: DataFrame, before: Column, key: str = "url") -> DataFrame:
    """Rows that were never processed, or last before a moment."""
    seen = table.select(key, F.col("processed_at").alias("_at"))
    return rows.join(seen, key, "left").where(F.col("_at").isNull() | (F.col("_at") < before)).drop("_at")
