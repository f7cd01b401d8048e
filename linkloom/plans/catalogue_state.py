"""Queries of the state store, streams, metrics and the staged enrichment, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, metrics, reports, search, state
from ..plugins import Plugin, Registry
from ..sources import csv
from ..streaming import incremental
from . import process
from .registry import query
from .tables import SQL_BOOKMARKS, SQL_DOMAIN, bookmarks, scratch, table

NOW = "2024-06-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


# The store: two runs over the rows, the second with changed notes of every fifth row and without every seventh.
def _store(spark, d) -> tuple[state.StateStore, int, int]:
    store = state.StateStore(spark, scratch(spark, "state"))
    rows = bookmarks(spark, d).withColumn("url", F.col("pos").cast("string"))
    first = rows.withColumn("content_hash", state.content_hash(rows))
    one = store.start_run("first")
    store.mark(first.where("pos % 4 <> 0"), one)
    store.mark(first.where("pos % 4 = 0"), one, status="failed")
    store.complete_run(one, *store.run_totals(one))
    changed = rows.where("pos % 7 <> 0").withColumn("note", F.when(F.col("pos") % 5 == 0, "changed").otherwise(F.col("note")))
    changed = changed.withColumn("content_hash", state.content_hash(changed))
    two = store.start_run("second")
    store.mark(state.unprocessed(changed, store.read("processed_bookmarks")), two)
    store.complete_run(two, *store.run_totals(two))
    return store, one, two


_LEFT = "pos % 7 <> 0 AND (pos % 4 = 0 OR pos % 5 = 0)"


@query("store_table", f"WITH {SQL_BOOKMARKS} SELECT pos::VARCHAR AS url, CASE WHEN pos % 4 = 0 AND pos % 7 = 0 THEN 'failed' ELSE 'processed' END AS status, array_to_string(tags, ',') AS tags, folder, title FROM b")
def store_table(spark, d):
    return _store(spark, d)[0].read("processed_bookmarks").select("url", "status", "tags", "folder", "title")


@query("store_history", f"WITH {SQL_BOOKMARKS} SELECT pos::VARCHAR AS url, 1::BIGINT AS run_id, CASE WHEN pos % 4 = 0 THEN 'failed' ELSE 'created' END AS change_type FROM b UNION ALL SELECT pos::VARCHAR, 2, 'updated' FROM b WHERE {_LEFT}")
def store_history(spark, d):
    return _store(spark, d)[0].read("bookmark_history").select("url", "run_id", "change_type")


@query("history_join", f"WITH {SQL_BOOKMARKS}, u AS (SELECT min(pos) AS pos FROM b WHERE {_LEFT}) SELECT pos::VARCHAR AS url, 'first' AS source, 1::BIGINT AS run_id FROM u UNION ALL SELECT pos::VARCHAR, 'second', 2 FROM u")
def history_join(spark, d):
    store = _store(spark, d)[0]
    first = bookmarks(spark, d).where(_LEFT).agg(F.min("pos")).first()[0]
    return store.history(str(first)).select("url", "source", "run_id")


@query("run_history", f"WITH {SQL_BOOKMARKS} SELECT 1::BIGINT AS id, 'first' AS source, count(*) AS total_processed, count(*) FILTER (pos % 4 = 0) AS total_failed FROM b UNION ALL SELECT 2, 'second', count(*) FILTER ({_LEFT}), 0 FROM b")
def run_history(spark, d):
    return _store(spark, d)[0].recent_runs(10).select("id", "source", "total_processed", "total_failed")


@query("store_compared", f"WITH {SQL_BOOKMARKS} SELECT pos::VARCHAR AS url, CASE WHEN NOT ({_LEFT}) THEN 'removed' WHEN pos % 5 = 0 AND note <> 'changed' THEN 'changed' ELSE 'unchanged' END AS change FROM b")
def store_compared(spark, d):
    store, one, two = _store(spark, d)
    return store.compare(one, two)


@query("store_views", f"WITH {SQL_BOOKMARKS} SELECT 'failed' AS name, count(*) AS n FROM b WHERE pos % 4 = 0 AND pos % 7 = 0 UNION ALL SELECT 'recent', least(100, count(*)) FROM b UNION ALL SELECT 'runs', 2")
def store_views(spark, d):
    _store(spark, d)[0].views()
    counts = [(name, spark.table(view).count()) for name, view in (("failed", "failed_bookmarks"), ("recent", "recent_bookmarks"), ("runs", "run_summary"))]
    return spark.createDataFrame(counts, "name string, n long")


@query("store_forgotten", f"WITH {SQL_BOOKMARKS}, u AS (SELECT min(pos) AS pos FROM b) SELECT 'one' AS what, count(*) - 1 AS n FROM b UNION ALL SELECT 'old', 0 UNION ALL SELECT 'stale', count(*) FROM b UNION ALL SELECT 'not stale', 0")
def store_forgotten(spark, d):
    store = _store(spark, d)[0]
    rows = bookmarks(spark, d).withColumn("url", F.col("pos").cast("string"))
    late, early = F.lit("2999-01-01").cast("timestamp"), F.lit("1999-01-01").cast("timestamp")
    told = [("not stale", state.stale(rows, store.read("processed_bookmarks"), early).count())]
    store.forget(url=str(rows.agg(F.min("pos")).first()[0]))
    told.append(("one", store.read("processed_bookmarks").count()))
    store.vacuum(hours=0)
    store.forget(older_than=late)
    told += [("old", store.read("processed_bookmarks").count()), ("stale", state.stale(rows, store.read("processed_bookmarks"), late).count())]
    return spark.createDataFrame(told, "what string, n long")


@query("store_exported", f"WITH {SQL_BOOKMARKS} SELECT 'processed_bookmarks' AS name, count(*) AS n FROM b UNION ALL SELECT 'processing_runs', 2 UNION ALL SELECT 'bookmark_history', count(*) + count(*) FILTER ({_LEFT}) FROM b")
def store_exported(spark, d):
    """Exported as JSON and imported, twice, into an empty store."""
    path = scratch(spark, "exported")
    _store(spark, d)[0].export_state(path)
    other = state.StateStore(spark, scratch(spark, "state"))
    other.import_state(path)
    other.import_state(path)
    return spark.createDataFrame([(t, other.read(t).count()) for t in other.TABLES], "name string, n long")


@query("store_by_date", f"WITH {SQL_BOOKMARKS} SELECT pos FROM b WHERE created BETWEEN TIMESTAMP '2024-02-01' AND TIMESTAMP '2024-03-01'")
def store_by_date(spark, d):
    rows = bookmarks(spark, d).withColumn("processed_at", F.col("created"))
    return state.by_date(rows, F.lit("2024-02-01").cast("timestamp"), F.lit("2024-03-01").cast("timestamp")).select("pos")


@query("store_by_stored_tag", f"WITH {SQL_BOOKMARKS}, t AS (SELECT pos, array_to_string(tags, ', ') AS ts FROM b) SELECT pos FROM t WHERE ts = 'ai' OR starts_with(ts, 'ai,') OR ends_with(ts, ', ai') OR contains(ts, ', ai,')")
def store_by_stored_tag(spark, d):
    return state.by_tag(bookmarks(spark, d).withColumn("tags", F.array_join("tags", ", ")), "ai", stored_lists=True).select("pos")


@query("stream_incremental", f"WITH {SQL_BOOKMARKS}, u AS (SELECT url, min(pos) AS pos FROM b GROUP BY url) SELECT 'processed' AS what, count(*) AS n FROM u UNION ALL SELECT 'run total', count(*) FROM u UNION ALL SELECT 'again', 0")
def stream_incremental(spark, d):
    """Export files of equal links arrive one by one; totals add up over batches, and a second run finds nothing to do."""
    src, out, checkpoint = scratch(spark, "arriving"), scratch(spark, "out"), scratch(spark, "stream")
    rows = dedup.first_of(bookmarks(spark, d), "url")  # the same row in each reading, as the numbering needs
    csv.as_export(rows).repartition(3).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(src)
    store = state.StateStore(spark, scratch(spark, "state"))
    for _ in range(2):
        incremental.process(incremental.read_exports(spark, src), store, out, checkpoint).awaitTermination()
    runs = {r.id: r.total_processed for r in store.read("processing_runs").collect()}
    return spark.createDataFrame([("processed", store.read("processed_bookmarks").count()), ("run total", runs[1]), ("again", runs[2])], "what string, n long")


@query("stream_peek", f"WITH {SQL_BOOKMARKS} (SELECT 'peek' AS what, pos FROM b ORDER BY pos LIMIT 10) UNION ALL (SELECT 'sample', pos FROM b ORDER BY pos LIMIT 5 OFFSET 20)")
def stream_peek(spark, d):
    rows = bookmarks(spark, d)
    return incremental.peek(rows).select(F.lit("peek").alias("what"), "pos").unionByName(incremental.sample(rows, 5, 20).select(F.lit("sample").alias("what"), "pos"))


# Duplicates and numbering.
@query("distinct_first", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def distinct_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("key"))
    return dedup.first_of(docs, "key", "doc_id").select("doc_id")


@query("dedup_dry_run", f"WITH {SQL_BOOKMARKS}, f AS (SELECT pos, pos % 40 AS k, created, count(*) OVER (PARTITION BY pos % 40) AS group_size, pos = min(pos) OVER (PARTITION BY pos % 40) AS first_row FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY (first_row AND created IS NULL) DESC, created DESC NULLS LAST, pos) AS n FROM f) SELECT pos, group_size, n = 1 AS kept FROM r")
def dedup_dry_run(spark, d):
    rows = bookmarks(spark, d).withColumn("dedup_key", (F.col("pos") % 40).cast("string"))
    return dedup.process(rows, "newest", _now(), dry_run=True).select("pos", "group_size", "kept")


@query("folder_parts", "SELECT p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 20 AS batch FROM part")
def folder_parts(spark, d):
    return metrics.numbered(table(spark, d, "part"), 20, "p_brand", "p_partkey").select("p_partkey", "batch")


# Metrics over events.
def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("batch_totals", "SELECT count(*) AS batches, sum(user_id % 50)::BIGINT AS items, sum(user_id % 50 // 2)::BIGINT AS succeeded, round(sum(user_id % 50 // 2) / sum(user_id % 50), 6) AS success_rate, round(sum((value * 100)::BIGINT) / sum(user_id % 50), 6) AS cost_per_item FROM events")
def batch_totals(spark, d):
    n = F.col("user_id") % 50
    rows = _events(spark, d).select(n.alias("items"), F.floor(n / 2).alias("succeeded"), (n - F.floor(n / 2)).alias("failed"), F.lit(1).alias("seconds"), F.round(F.col("value") * 100).cast("long").alias("cost"))
    return metrics.batch_statistics(rows).select("batches", "items", "succeeded", "success_rate", "cost_per_item")


@query("cost_estimates", "WITH l AS (SELECT * FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 100), g AS (SELECT * FROM l WHERE user_id % 3 <> 0 ORDER BY ts DESC, event_id DESC LIMIT 10) SELECT count(*) AS records, round(coalesce(avg(value / (1 + user_id % 4)), 0) * 500, 6) AS estimate FROM g")
def cost_estimates(spark, d):
    costs = _events(spark, d).select((F.unix_micros("ts") * 1000 + F.col("event_id") % 1000).alias("timestamp"), F.col("event_type").alias("provider"), F.col("value").alias("cost_usd"), (1 + F.col("user_id") % 4).alias("bookmark_count"), (F.col("user_id") % 3 != 0).alias("success"))
    return metrics.cost_estimate(costs, 500, "purchase")


@query("cost_recent", "WITH m AS (SELECT max(ts) AS n FROM events) SELECT count(*) AS requests, round(coalesce(sum(value), 0), 6) AS total_cost FROM events, m WHERE ts >= n - INTERVAL 10 MINUTES AND ts <= n")
def cost_recent(spark, d):
    rows = _events(spark, d)
    last = F.lit(rows.agg(F.max("ts")).first()[0])
    return metrics.usage_between(rows, last - F.expr("INTERVAL 10 MINUTES"), last, "value", "ts")


@query("cost_projection", "WITH m AS (SELECT max(ts) AS n FROM events), s AS (SELECT count(*) AS k, sum(value) AS v, min(ts) AS f FROM events, m WHERE ts >= n - INTERVAL 6000 MINUTES) SELECT round(CASE WHEN k >= 3 AND n > f THEN v / ((epoch_us(n) - epoch_us(f)) / 3.6e9) ELSE 0 END, 6)::DOUBLE AS per_hour FROM s, m")
def cost_projection(spark, d):
    rows = _events(spark, d)
    return metrics.hourly_projection(rows, F.lit(rows.agg(F.max("ts")).first()[0]), minutes=6000, cost="value", ts="ts")


@query("route_shares", "SELECT event_type, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM events), 2)::DOUBLE AS percent FROM events GROUP BY 1")
def route_shares(spark, d):
    return metrics.shares(_events(spark, d), "event_type")


@query("stage_metrics", "SELECT event_type AS stage, round(sum(user_id % 7 + 1), 6)::DOUBLE AS seconds, sum(user_id % 50)::BIGINT AS items, round(sum(user_id % 50 - user_id % 50 // 5) / sum(user_id % 50), 6)::DOUBLE AS success_rate, round(sum(user_id % 50) / sum(user_id % 7 + 1), 6)::DOUBLE AS items_per_second FROM events GROUP BY 1")
def stage_metrics(spark, d):
    n = F.col("user_id") % 50
    rows = _events(spark, d).select(F.col("event_type").alias("stage"), F.col("ts").alias("started"), F.timestamp_micros(F.unix_micros("ts") + (F.col("user_id") % 7 + 1) * 1_000_000).alias("ended"), n.alias("items"), F.floor(n / 5).alias("failed"))
    return metrics.stage_summary(rows)


@query("tuned_batches", "WITH l AS (SELECT 10 * (1 + event_id % 4) AS size, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 10), m AS (SELECT size, avg(value) AS mean FROM l GROUP BY 1 HAVING count(*) >= 2) SELECT greatest(10, least(500, first(size ORDER BY mean, size)))::BIGINT AS size FROM m")
def tuned_batches(spark, d):
    rows = _events(spark, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(10)
    return metrics.tuned_batch_size(rows.select("ts", (10 * (1 + F.col("event_id") % 4)).alias("size"), F.col("value").alias("seconds"))).select(F.col("size").cast("long").alias("size"))


@query("adapted_limits", "WITH l AS (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 5) SELECT greatest(10, least(100, CASE WHEN avg(value) / 50 < 1 THEN 60 WHEN avg(value) / 50 > 3 THEN 40 ELSE 50 END))::INT AS concurrency FROM l")
def adapted_limits(spark, d):
    rows = _events(spark, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(5)
    return metrics.adapted_concurrency(rows.select("ts", (F.col("value") / 50).alias("seconds")), 50)


@query("memory_drift", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT event_type, round(arg_min(value, n) - arg_max(value, n), 6) AS change FROM r WHERE n <= 10 GROUP BY 1")
def memory_drift(spark, d):
    return metrics.drift(_events(spark, d), "event_type", "value", order=("ts", "event_id"))


@query("health_status", "SELECT event_id, CASE WHEN (user_id % 30) / greatest(1, event_id % 100) > 0.2 THEN 'critical' WHEN (user_id % 30) / greatest(1, event_id % 100) > 0.1 THEN 'degraded' WHEN event_id % 20 > 10 AND value / 100 < 0.1 THEN 'slow' WHEN event_id % 20 > 10 AND value * 10 > 500 THEN 'memory_concern' ELSE 'healthy' END AS status FROM events")
def health_status(spark, d):
    e, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    return _events(spark, d).select("event_id", metrics.health_of(e % 100, u % 30, v / 100, e % 20, v * 10).alias("status"))


@query("progress_overall", "SELECT event_id, round(0.5 * least(1.0, value / 100) + 0.3 * least(1.0, greatest(0.0, (event_id % 7 - 1) / 4)) + 0.2 * (event_id % 2), 6)::DOUBLE AS progress FROM events")
def progress_overall(spark, d):
    done = [F.col("value") / 100, (F.col("event_id") % 7 - 1) / 4, (F.col("event_id") % 2).cast("double")]
    return _events(spark, d).select("event_id", F.round(metrics.overall_progress([0.5, 0.3, 0.2], done), 6).alias("progress"))


@query("quality_overall", "SELECT doc_id, round(0.4 * quality + 0.35 * toxic + 0.25 * 0.5, 6)::DOUBLE AS overall FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def quality_overall(spark, d):
    rows = table(spark, d, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL")
    return rows.select("doc_id", F.round(reports.overall(F.col("quality").cast("double"), F.col("toxic").cast("double"), F.lit(0.5)), 6).alias("overall"))


@query("search_fields", f"WITH {SQL_BOOKMARKS} SELECT pos FROM b WHERE contains(lower(title), 'the') OR contains(lower(note), 'the') OR contains(lower(url), 'the') ORDER BY pos LIMIT 50")
def search_fields(spark, d):
    return search.containing(bookmarks(spark, d), "THE", "title", "note", "url", most=50, order="pos").select("pos")


# The staged enrichment.
def _pages(spark, d):
    n = F.col("page_id")
    return table(spark, d, "pages").select("url", "html", F.when(n % 9 == 0, 404).when(n % 9 == 1, 503).otherwise(200).alias("status_code")).groupBy("url").agg(F.min(F.struct("status_code", "html")).alias("p")).select("url", "p.html", "p.status_code")


_FETCHED = "pg AS (SELECT url, min(CASE WHEN page_id % 9 = 0 THEN 404 WHEN page_id % 9 = 1 THEN 503 ELSE 200 END) AS code FROM pages GROUP BY url)"


@query("process_validated", f"WITH {SQL_BOOKMARKS}, {_FETCHED} SELECT pos FROM b JOIN pg USING (url) WHERE code = 200")
def process_validated(spark, d):
    """Rows whose URL was fetched well; each URL is asked for once. Checks and hooks of plugins run around the stage."""
    pages = _pages(spark, d)
    done = process.run(bookmarks(spark, d), process.Options(fetch=lambda asked: asked.join(pages, "url", "left"), now=NOW).only("validation"))
    return done.select("pos")


@query("process_retried", f"WITH {SQL_BOOKMARKS}, {_FETCHED} SELECT pos, code AS first_code FROM b JOIN pg USING (url) WHERE code IN (200, 503)")
def process_retried(spark, d):
    """URLs that answered with a passing error are asked for again, and then answer; others are not."""
    pages, calls = _pages(spark, d), []

    def fetch(asked):
        calls.append(1)
        got = asked.join(pages, "url", "left")
        return got if len(calls) == 1 else got.withColumn("status_code", F.when(F.col("status_code") == 503, 200).otherwise(F.lit(500)))

    done = process.run(bookmarks(spark, d), process.Options(fetch=fetch, now=NOW, attempts=3).only("validation"))
    return done.join(pages.select("url", F.col("status_code").alias("first_code")), "url").select("pos", "first_code")


@query("process_offline", f"WITH {SQL_BOOKMARKS} SELECT pos, coalesce(nullif(trim(note), ''), nullif(trim(excerpt), ''), nullif(trim(title), '') || ' from ' || {SQL_DOMAIN}, '') AS said FROM b WHERE NOT regexp_matches(lower(url), 'invalid|404|error|timeout')")
def process_offline(spark, d):
    done = process.run(bookmarks(spark, d), process.Options(now=NOW).only("validation", "ai"))
    return done.select("pos", F.col("enhanced_description").alias("said"))


@query("process_preview", f"WITH {SQL_BOOKMARKS} SELECT pos FROM b ORDER BY pos LIMIT 25")
def process_preview(spark, d):
    return process.run(bookmarks(spark, d), process.Options(now=NOW, preview=25).only()).select("pos")


@query("process_resumed", f"WITH {SQL_BOOKMARKS} SELECT 'first' AS run, count(DISTINCT dedup_key) AS n FROM k UNION ALL SELECT 'again', count(DISTINCT dedup_key) FROM k UNION ALL SELECT 'other input', count(DISTINCT dedup_key) FROM k WHERE pos % 2 = 0 UNION ALL SELECT 'other settings', count(DISTINCT dedup_key) FROM k")
def process_resumed(spark, d):
    """A kept stage is used by the same input with the same settings only."""
    rows, work = bookmarks(spark, d), scratch(spark, "work")
    plain = process.Options(work=work, now=NOW).only("dedup")
    told = [(name, process.run(r, o).count()) for name, r, o in (("first", rows, plain), ("again", rows, plain), ("other input", rows.where("pos % 2 = 0"), plain), ("other settings", rows, process.Options(work=work, now=NOW, strategy="oldest").only("dedup")))]
    return spark.createDataFrame(told, "run string, n long")


@query("plugin_hooks", f"WITH {SQL_BOOKMARKS} SELECT pos, 'on_load,pre_validation,post_validation,validation_filter,pre_content,content_enhance,post_content,pre_ai,ai_process,post_ai,pre_tags,tag_generate,post_tags,pre_folders,post_folders' AS seen, '!' || note AS note FROM b WHERE NOT regexp_matches(lower(url), 'invalid|404|error|timeout') AND pos % 2 = 0")
def plugin_hooks(spark, d):
    """A plugin at every hook of a run without pages: each adds its name, one filters, one describes."""
    registry = Registry()

    def note(hook):
        def run(df):
            seen = F.array_append(F.coalesce("seen", F.array().cast("array<string>")), F.lit(hook)) if "seen" in df.columns else F.array(F.lit(hook))
            df = df.withColumn("seen", seen)
            if hook == "validation_filter":
                df = df.where("pos % 2 = 0")
            return df.withColumn("enhanced_description", F.concat(F.lit("!"), F.col("note"))) if hook == "ai_process" else df

        return run

    from ..plugins import HOOKS

    registry.register(Plugin("notes", {h: note(h) for h in HOOKS if h not in ("pre_export", "post_export")}))
    done = process.run(bookmarks(spark, d), process.Options(now=NOW, plugins=registry).only("validation", "content", "ai", "tags", "folders"))
    return done.select("pos", F.array_join("seen", ",").alias("seen"), F.col("enhanced_description").alias("note"))


@query("process_results", f"WITH {SQL_BOOKMARKS} SELECT count(*) AS rows, count(*) FILTER (len(tags) > 0) AS tagged, (SELECT count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM b))::INT AS unique_tags, count(DISTINCT folder) AS folders FROM b")
def process_results(spark, d):
    return process.results(process.run(bookmarks(spark, d), process.Options(now=NOW).only()))


@query("process_output", f"""WITH {SQL_BOOKMARKS} SELECT url, folder, CASE WHEN trim(title) = '' THEN regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) ELSE title END AS title, 'said ' || pos AS note,
    CASE WHEN pos % 2 = 0 THEN '"one, two"' ELSE CASE len(tags) WHEN 0 THEN '' WHEN 1 THEN tags[1] ELSE '"' || array_to_string(tags, ', ') || '"' END END AS tags, coalesce(strftime(created, '%Y-%m-%dT%H:%M:%SZ'), '') AS created FROM b""")
def process_output(spark, d):
    rows = bookmarks(spark, d).withColumns({"enhanced_description": F.concat(F.lit("said "), F.col("pos").cast("string")), "optimized_tags": F.when(F.col("pos") % 2 == 0, F.array(F.lit("one"), F.lit("two")))})
    return process.output(rows)


@query("dedup_report", f"WITH {SQL_BOOKMARKS}, s AS (SELECT dedup_key, count(*) AS n FROM k GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS total, count(*) AS u, count(*) FILTER (n > 1) AS g FROM s) SELECT 'Duplicate report' || chr(10) || 'rows: ' || total || chr(10) || 'unique: ' || u || chr(10) || 'groups: ' || g || chr(10) || 'removed: ' || (total - u) || ' (' || printf('%.1f', 100.0 * (total - u) / total) || ' %)' AS said FROM t")
def dedup_report(spark, d):
    from .tables import keyed

    return spark.createDataFrame([(dedup.report(dedup.summary(keyed(spark, d)).first().asDict()),)], "said string")


@query("since_dates", "SELECT * FROM (VALUES ('7d', TIMESTAMP '2024-05-25'), ('2W', TIMESTAMP '2024-05-18'), (' 12h ', TIMESTAMP '2024-05-31 12:00:00'), ('2024-03-01', TIMESTAMP '2024-03-01'), ('01/02/2024', TIMESTAMP '2024-02-01'), ('2024-03-01T10:00:00', TIMESTAMP '2024-03-01 10:00:00'), ('next week', NULL)) t(said, since)")
def since_dates(spark, d):
    from datetime import datetime

    from ..functions import dates

    def at(said: str):
        try:
            return dates.since(said, datetime(2024, 6, 1))
        except ValueError:
            return None

    return spark.createDataFrame([(s, at(s)) for s in ("7d", "2W", " 12h ", "2024-03-01", "01/02/2024", "2024-03-01T10:00:00", "next week")], "said string, since timestamp_ntz")


@query("config_digests", """SELECT name, left(md5(said), 16) AS digest FROM (VALUES ('defaults', '{"batch_size": 100, "budget_usd": 10.0, "checkpoint_every": 50, "engine": "local", "folder_limit": 20, "max_concurrent": 20, "max_description": 150, "max_retries": 3, "strategy": "highest_quality", "tags_per_row": 5, "target_tags": 150, "timeout": 30.0}'),
    ('changed', '{"batch_size": 50, "budget_usd": 10.0, "checkpoint_every": 50, "engine": "local", "folder_limit": 20, "max_concurrent": 20, "max_description": 150, "max_retries": 3, "strategy": "newest", "tags_per_row": 5, "target_tags": 150, "timeout": 30.0}')) t(name, said)""")
def config_digests(spark, d):
    from .. import config

    made = {"defaults": config.Settings(), "changed": config.from_dict({"batch_size": 50, "output": {"strategy": "newest"}})}
    return spark.createDataFrame([(n, s.digest()) for n, s in made.items()], "name string, digest string")
