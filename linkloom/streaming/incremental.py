"""Incremental processing as a stream: files in, unseen or changed rows through a transform, rows out, state kept.

Every micro-batch is idempotent: its output folder is named by the batch and marked once it is whole, and state is an upsert by URL. So a
batch that is replayed after a failure is not transformed again and leaves the same output and state. A run's totals are those of
its history, so they add up over batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators import bookmarks, state


def read_exports(spark: SparkSession, directory: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of export rows from CSV files that arrive in a directory."""
    stream = (
        spark.readStream.schema(schemas.EXPORT_CSV).option("header", True).option("multiLine", True).option("escape", '"')
        .option("maxFilesPerTrigger", files_per_batch).csv(directory)
    )
    return stream.fillna("", list(schemas.EXPORT_COLUMNS))


def peek(rows: DataFrame, n: int = 10) -> DataFrame:
    """The first rows by position."""
    return rows.orderBy("pos").limit(n)


def sample(rows: DataFrame, count: int = 10, skip: int = 0) -> DataFrame:
    """Some rows by position, behind those skipped."""
    return rows.orderBy("pos").offset(skip).limit(count)


def process(
    stream: DataFrame, store: state.StateStore, output: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, source: str = "stream"
) -> StreamingQuery:
    """Runs until all waiting files are through. Rows already processed with the same content are skipped.

    ``transform`` may add a column ``error``; rows with one are marked as failed.
    """
    run = store.start_run(source)
    stream_id = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def each(batch: DataFrame, number: int) -> None:
        rows = bookmarks.typed(batch.withColumn("pos", F.monotonically_increasing_id()))
        rows = rows.withColumn("content_hash", state.content_hash(rows))
        rows = rows.groupBy("url").agg(F.max_by(F.struct(*rows.columns), "pos").alias("r")).select("r.*")
        out = f"{output}/batch={number}"
        fs, whole = store._fs(f"{output}/_whole-{stream_id}-{number}")
        if not fs.exists(whole):
            done = transform(state.unprocessed(rows, store.read("processed_bookmarks")))
            if "error" not in done.columns:
                done = done.withColumn("error", F.lit(None).cast("string"))
            done.write.mode("overwrite").parquet(out)
            fs.create(whole).close()
        written = batch.sparkSession.read.parquet(out)
        fresh = state.unprocessed(written, store.read("processed_bookmarks"))  # all of them but in a replay
        told = fresh.agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("failed")).first()
        if told.n > told.failed:
            store.mark(fresh.where("error IS NULL"), run)
        if told.failed:
            store.mark(fresh.where("error IS NOT NULL"), run, status="failed")
        store.complete_run(run, *store.run_totals(run))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed_events(events: DataFrame, key: str, value: str, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """A stream without repeats of one key and value within the delay."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key, value])


def windowed(events: DataFrame, by: str, value: str, ts: str = "ts", length: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums by group and window; late rows beyond the delay are left out of a stream."""
    counted = events.withWatermark(ts, delay).groupBy(F.window(ts, length), by).agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total"))
    return counted.select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, by: str, ts: str = "ts", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    counted = events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def throughput(query: StreamingQuery) -> dict:
    """Rows, batches and mean rows a second of a query so far."""
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    seconds = sum(p["durationMs"].get("triggerExecution", 0) for p in progress) / 1000
    rows = sum(p["numInputRows"] for p in progress)
    return {"rows": rows, "batches": len(progress), "rows_per_second": rows / seconds if seconds else 0.0}
