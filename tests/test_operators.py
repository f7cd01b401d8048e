import json
import random
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom import cli, config
from linkloom.functions import dates, generated, urls
from linkloom.operators import bookmarks, dedup, folders, metrics, pages, predicates, reports, search, state, tagging, validation
from linkloom.plans import process
from linkloom.plugins import Plugin, Registry, paywall_plugin
from linkloom.sources import csv, datasource, export
from linkloom.streaming import incremental

DDL = "pos long, url string, title string, note string, excerpt string, folder string, tags array<string>, created timestamp"
NOW = "2024-06-01 00:00:00"


def make(spark, rows):
    names = [c.split(" ")[0] for c in DDL.split(", ")]
    base = {"title": "t", "note": "", "excerpt": "", "folder": "", "tags": [], "created": None}
    made = [{**base, "pos": i, "url": f"https://x.com/{i}", **r} for i, r in enumerate(rows)]
    ddl = DDL.replace("created timestamp", "created string")
    return spark.createDataFrame([tuple(r[n] for n in names) for r in made], ddl).withColumn("created", F.col("created").cast("timestamp"))


def kept(spark, rows, strategy):
    df = make(spark, rows).withColumn("dedup_key", F.lit("k"))
    return [r.pos for r in dedup.process(df, strategy, F.lit(NOW).cast("timestamp")).collect()]


@pytest.mark.parametrize(
    ("rows", "strategy", "stays"),
    [
        ([{"created": "2024-01-01"}, {"created": "2024-02-01"}, {}], "newest", 1),
        ([{}, {"created": "2024-02-01"}], "newest", 0),
        ([{"created": "2024-02-01"}, {"created": "2024-01-01"}], "oldest", 1),
        ([{"created": "2024-02-01"}, {"created": "2024-02-01"}], "oldest", 0),
        ([{"note": "n"}, {"note": "n"}], "most_complete", 0),
        ([{"note": "n"}, {"note": "n"}], "highest_quality", 1),
        ([{"note": "x" * 60, "tags": ["a", "b", "c", "d"]}, {"note": "n", "created": "2024-05-20"}], "highest_quality", 0),
        ([{"created": "2024-01-01"}, {"created": "2024-02-01"}], "no such strategy", 1),
    ],
)
def test_strategies(spark, rows, strategy, stays):
    assert kept(spark, rows, strategy) == [stays]


def test_rows_without_a_key_stay(spark):
    df = make(spark, [{"url": ""}, {"url": ""}]).withColumn("dedup_key", F.lit(""))
    assert dedup.process(df).count() == 2
    assert dedup.summary(df).first().asDict() == {"total": 2, "unique_rows": 2, "groups": 0, "duplicates": 0, "removed": 0}
    assert "removed: 0" in dedup.report(dedup.summary(df.limit(0)).first().asDict())
    assert dedup.first_of(df.withColumn("url", F.lit("u")), "url").first().pos == 0


def test_predicates(spark):
    df = make(spark, [{"folder": "Tech/AI", "tags": ["AI"]}, {"folder": None, "tags": None}, {"created": "2024-03-01 12:00:00", "url": "https://sub.a.com:8080/x"}])
    assert [predicates.folder(p).count(df) for p in ("tech/*", "tech/a?", "*")] == [1, 1, 3]
    assert predicates.tag(["ai"]).count(df) == 1 and predicates.tag(["ai"], case_sensitive=True).count(df) == 0 and (~predicates.tag(["ai"])).count(df) == 2
    assert predicates.created_range("2024-03-01:2024-03-01").count(df) == 1 and predicates.domain(["a.com"]).count(df) == 1 and predicates.domain(["a.com"], subdomains=False).count(df) == 0
    assert predicates.every([]).count(df) == 3 and predicates.some([]).count(df) == 3
    assert predicates.custom(lambda u: u.endswith("/x")).count(df) == 1
    status = df.withColumn("processing_status", F.struct(F.lit(True).alias("url_validated"), F.lit(None).cast("string").alias("url_validation_error"), F.lit(None).cast("string").alias("content_extraction_error"), F.lit("e").alias("ai_processing_error")))
    assert predicates.status(["error"]).count(status) == 3 and predicates.status(["invalid"]).count(status) == 0


def test_predicates_reach_the_scan(spark, tmp_path):
    make(spark, [{}]).write.parquet(str(tmp_path / "p"))
    plan = predicates.created_range("2024-01-01:").apply(spark.read.parquet(str(tmp_path / "p")).select("pos", "created"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(created" in plan and "ReadSchema: struct<pos:bigint,created:timestamp>" in plan


def test_changes(spark):
    df = make(spark, [{"note": "a", "tags": ["x", "y"]}]).withColumns({"new_note": F.lit("b"), "new_tags": F.array(F.lit("y"), F.lit("x")), "new_folder": F.lit("F"), **{f"{c}_confidence": F.lit(1.0) for c in ("note", "tags", "folder")}})
    told = bookmarks.proposed_changes(df)
    assert told.select("has_description_change", "has_tags_change", "has_folder_change", "confidence").first() == (True, False, True, 1.0)
    assert bookmarks.applied(df, F.lit("folder")).select("note", "folder").first() == ("a", "F")
    assert bookmarks.auto_accepted(told).select("note").first() == ("b",)


def test_corpus_tags(spark):
    rows = make(spark, [{"url": f"https://github.com/a/{i}", "title": f"Python tool {i}", "tags": ["python"]} for i in range(6)])
    scores = tagging.scored(tagging.candidates(rows), rows)
    chosen = tagging.selected(scores, 3)
    assert len(chosen) == 3 and "python" in chosen
    best = tagging.assigned(rows, spark.createDataFrame([(t,) for t in chosen], "tag string"))
    assert best.where("place = 1").count() == 6
    by_tag = {r.tag: r for r in scores.collect()}
    assert by_tag["github"].url_score == 1.0 and by_tag["python"].url_score == 0.0 and by_tag["python"].frequency == 6
    pages = spark.createDataFrame([("u", ["python"], ["x"], "b"), ("v", [], ["About Python"], "b"), ("w", [], [], "python here"), ("x", [], [], "")], "url string, categories array<string>, headings array<string>, body string")
    assert {r.tag: round(r.content_score, 6) for r in tagging.scored(tagging.candidates(rows), rows, pages).collect()}["python"] == 0.45


def test_first_of_a_category_is_found_at_any_rank(spark):
    scores = spark.createDataFrame([(f"word{i:03d}", 0.6) for i in range(300)] + [("python", 0.4), ("docker", 0.35)], "tag string, total_score double")
    assert tagging.selected(scores, 5) == ["word000", "word001", "word002", "word003", "python"]


def test_folder_limits(spark):
    rows = make(spark, [{"url": f"https://{'ab'[i % 2]}site{i % 2}.com/{i}", "title": "python api"} for i in range(50)])
    filed = folders.filed(folders.categorised(rows), most=20)
    sizes = {r.path: r["count"] for r in filed.groupBy("path").count().collect()}
    assert max(sizes.values()) <= 20 and all(p.startswith("Development/Backend/") for p in sizes)
    tree = {r.path: r.total for r in folders.tree(filed).collect()}
    assert tree["Development"] == 50


def test_reports_on_empty_rows(spark):
    empty = make(spark, [{}]).limit(0)
    assert reports.tag_metrics(empty).first().score == 0.0 and reports.folder_metrics(empty).first().score == 0.0
    assert reports.discovered_terms(empty).count() == 0 and reports.export_statistics(empty).first().total == 0


def test_search(spark):
    rows = spark.createDataFrame([(1, "apple pie apple"), (2, "apple"), (3, "nothing here")], "id long, t string")
    got = search.bm25(search.index(rows, "id", "t"), "id", "Apple pie", 3, 2.0).collect()
    assert [r.id for r in got] == [1, 2] and search.containing(rows, "NOTH", "t", order="id").count() == 1


def test_validation(spark):
    raw = csv.sample_export(spark).withColumn("pos", F.lit(0))
    ok = validation.checked(raw, F.lit(NOW).cast("timestamp"))
    assert all(r.is_valid for r in ok.collect())
    bad = raw.withColumns({"url": F.lit("ftp"), "created": F.lit("2999-01-01"), "title": F.lit("")})
    told = validation.checked(bad, F.lit(NOW).cast("timestamp")).first()
    assert not told.is_valid and {(i.field, i.message) for i in told.issues} >= {("url", "malformed"), ("created", "in the future"), ("title", "missing")}
    fixed = validation.recovered(bad.withColumn("url", F.lit("www.news.com/x")), F.lit(NOW).cast("timestamp")).first()
    assert fixed.url == "https://www.news.com/x" and fixed.title == "News.Com" and "title recovered" in fixed.recovery
    row = spark.range(1).select(validation.encoding_issues(F.lit("caf\u00c3\u00a9 \ufffd")).alias("e"), validation.truncated(F.lit("and so...")).alias("t"), validation.paywall(F.lit("https://www.ft.com/x"), F.lit("Subscribe to continue")).alias("p"), validation.string_ok(F.lit("ab"), least=3).alias("s"), validation.number_ok(F.lit("4"), most=5, whole=True).alias("n"), validation.list_ok(F.array(F.lit(1), F.lit(1)), unique=True).alias("l")).first()
    assert (row.e, row.t, row.p, row.s, row.n, row.l) == (["replacement", "mojibake"], True, 0.95, False, True, False)


def test_metrics(spark):
    rows = spark.createDataFrame([(i, 10 if i % 2 else 20, float(i % 2 + 1)) for i in range(10)], "ts long, size int, seconds double")
    assert metrics.tuned_batch_size(rows).first().size == 20 and metrics.adapted_concurrency(rows.withColumn("seconds", F.lit(9.0)), 15).first().concurrency == 10
    costs = spark.createDataFrame([("2024-06-01 00:10:00", "p", 1.0, 2, True), ("2024-06-01 00:20:00", "p", 2.0, 2, True), ("2024-06-01 00:25:00", "p", 3.0, 2, False)], "timestamp string, provider string, cost_usd double, bookmark_count long, success boolean").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    now = F.lit("2024-06-01 00:30:00").cast("timestamp")
    assert metrics.hourly_projection(costs, now).first().per_hour == 18.0 and metrics.cost_estimate(costs, 10, "p").first().estimate == 7.5
    assert metrics.usage_between(costs, now - F.expr("INTERVAL 10 MINUTES"), now).first().requests == 2
    stages = spark.createDataFrame([("a", "2024-01-01 00:00:00", "2024-01-01 00:00:10", 100, 10)], "stage string, started string, ended string, items long, failed long").withColumns({c: F.col(c).cast("timestamp") for c in ("started", "ended")})
    assert metrics.stage_summary(stages).first()[1:] == (10.0, 100, 0.9, 10.0)


def test_state_store(spark, tmp_path):
    store = state.StateStore(spark, str(tmp_path / "s"))
    rows = make(spark, [{"note": "a"}, {}])
    rows = rows.withColumn("content_hash", state.content_hash(rows))
    one = store.start_run("test")
    store.mark(rows, one)
    store.mark(rows, one)  # again: nothing new
    store.complete_run(one, 2, 2, 0)
    assert store.read("bookmark_history").count() == 2 and state.unprocessed(rows, store.read("processed_bookmarks")).count() == 0
    changed = make(spark, [{"note": "b"}, {}, {}])
    changed = changed.withColumn("content_hash", state.content_hash(changed))
    assert state.unprocessed(changed, store.read("processed_bookmarks")).count() == 2
    two = store.start_run("test")
    store.mark(changed.where("pos <> 1"), two)
    assert {r.url[-1]: r.change for r in store.compare(one, two).collect()} == {"0": "changed", "1": "removed", "2": "new"}
    store.views()
    assert spark.table("run_summary").where("success_rate = 100.0").count() == 1 and spark.table("recent_bookmarks").count() == 3
    assert store.history("https://x.com/0").count() == 2 and store.recent_runs(1).first().id == two
    store.vacuum()
    store.forget(url="https://x.com/0")
    assert store.read("processed_bookmarks").count() == 2 and state.statistics(store.read("processed_bookmarks"), F.current_timestamp()).first().recent == 2


def test_store_with_two_writers_and_many_appends(spark, tmp_path, monkeypatch):
    """Of two writers that see the same state one takes the next number; appended rows become one table every few changes, and ids stay distinct."""
    monkeypatch.setattr(state.StateStore, "APPENDS", 3)
    store, other = state.StateStore(spark, str(tmp_path / "s")), state.StateStore(spark, str(tmp_path / "s"))
    rows = make(spark, [{"note": str(i)} for i in range(7)])
    rows = rows.withColumn("content_hash", state.content_hash(rows))
    run = store.start_run("a")
    stale, seen = store._live("processed_bookmarks"), store._live
    store.mark(rows.where("pos = 0"), run)
    calls = []
    monkeypatch.setattr(other, "_live", lambda table: (calls.append(table), stale)[1] if table == "processed_bookmarks" and len(calls) < 2 else seen(table))
    other.mark(rows.where("pos = 1"), run)
    for i in range(2, 7):
        store.mark(rows.where(f"pos = {i}"), run)
    assert store.read("processed_bookmarks").count() == 7 and len(calls) >= 1
    history = store.read("bookmark_history")
    assert history.count() == history.select("id").distinct().count() == 7 and store.run_totals(run) == (7, 7, 0)
    assert len(store._live("processed_bookmarks")[1]) <= 3 and len(store._live("bookmark_history")[1]) <= 3
    store.mark(rows.where("pos = 3").withColumn("title", F.lit("newer")).withColumn("content_hash", F.lit("x")), run)
    assert store.read("processed_bookmarks").where("title = 'newer'").count() == 1 and store.read("processed_bookmarks").count() == 7
    store.vacuum(hours=0)
    assert store.read("processed_bookmarks").count() == 7 and store.read("bookmark_history").count() == 8
    two = other.start_run("b")
    assert two == run + 1 and {r.id for r in store.recent_runs().collect()} == {run, two}


def test_replayed_batch_and_run_totals(spark, tmp_path):
    src, out, c = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    src.mkdir()
    header = "id,title,note,excerpt,url,folder,tags,created,cover,highlights,favorite\n"
    for i in range(3):
        (src / f"{i}.csv").write_text(header + "".join(f"{i}{j},T,,,https://x.com/{i}{j},,,,,,\n" for j in range(3)))
    store = state.StateStore(spark, str(tmp_path / "s"))
    incremental.process(incremental.read_exports(spark, str(src)), store, out, c).awaitTermination()
    assert store.recent_runs(1).first().total_processed == 9  # three batches add up
    # The last batch is lost after its output was written: the replay neither empties the output nor counts again.
    for f in (tmp_path / "c" / "commits").glob("*2*"):
        f.unlink()
    before = sorted(r.url for r in spark.read.parquet(out).collect())
    incremental.process(incremental.read_exports(spark, str(src)), store, out, c).awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == before and store.read("bookmark_history").count() == 9
    assert store.recent_runs(1).first().total_processed == 0 and store.read("processed_bookmarks").count() == 9


def test_filing_of_large_folders(spark, monkeypatch):
    """Any size ends within the limit, also where positions are uneven and ranked in slices."""
    monkeypatch.setattr(folders, "SLICE", 7)
    rows = spark.range(400).select((F.col("id") * F.col("id")).alias("pos"), F.concat(F.lit("https://"), F.when(F.col("id") < 300, "big").otherwise(F.concat(F.lit("h"), (F.col("id") % 40).cast("string"))), F.lit(".com/x")).alias("url"), F.lit("Science").alias("category"), F.lit("General").alias("subcategory"))
    got = folders.filed(rows, 20)
    assert got.count() == 400 and got.columns == [*rows.columns, "path"]
    sizes = {r.path: r["count"] for r in got.groupBy("path").count().collect()}
    assert max(sizes.values()) <= 20 and sizes["Science/General/Big/Part 1"] == 20 and "Science/General/Big/Part 15" in sizes
    first = {r.pos for r in got.where("path = 'Science/General/Big/Part 1'").collect()}
    assert first == {i * i for i in range(20)}


def test_sliced_frames_equal_plain_windows(spark, monkeypatch):
    """Groups cut into small slices give what windows over whole groups give, at every edge."""
    rng = random.Random(8)
    rows, at = [], 0
    for i in range(600):
        at += rng.choice([0, 0, 1, 3, 40, 400])
        rows.append((i, "hot" if i % 5 else "cold", at, float(rng.randrange(100))))
    events = spark.createDataFrame(rows, "event_id long, kind string, s long, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s").cache()
    whole = W.partitionBy("kind").orderBy("ts", "event_id")
    by_time = W.partitionBy("kind").orderBy(F.unix_micros("ts")).rangeBetween(-60_000_000, 0)
    want = events.select("event_id", F.avg("value").over(whole.rowsBetween(-8, 0)).alias("rolling"), F.count("*").over(by_time).alias("in_window"), (F.row_number().over(W.partitionBy("kind").orderBy("event_id")) - 1).alias("place"))
    want = {r.event_id: r for r in want.collect()}
    for name, n in (("RANKS", 9), ("POSITIONS", 7), ("MICROS", 70_000_000)):
        monkeypatch.setattr(metrics, name, n)
    got = metrics.rolling(events, "kind", "value", last=9, order=("ts", "event_id")).collect()
    assert len(got) == 600 and all(r.rolling == pytest.approx(want[r.event_id].rolling) for r in got)
    got = metrics.sliding_count(events, "kind").collect()
    assert len(got) == 600 and all(r.in_window == want[r.event_id].in_window for r in got)
    got = metrics.numbered(events, 4, "kind", "event_id").collect()
    assert all(r.batch == want[r.event_id].place // 4 for r in got)
    spent = {i: sum(v for j, other, _, v in rows if other == kind and j < i) for i, kind, _, _ in rows}
    got = metrics.routed(events, F.lit(500), F.lit(0.9), F.col("kind"), F.col("value"), 2000.0, "event_id", "kind", ("hot", "cold")).collect()
    assert all((r.route == "local") == (spent[r.event_id] >= 2000) for r in got) and len({r.route for r in got}) == 2


def test_paging_says_when_it_ends_early(spark):
    full = lambda page, size: ["{}"] * size
    with pytest.raises(Exception, match="more than 4 pages"):
        datasource.paged(spark, full, per_page=2, most_pages=4, slices=2).collect()
    some = lambda page, size: ["{}"] * (size if page < 3 else 1)
    assert datasource.paged(spark, some, per_page=2, most_pages=4, slices=2).count() == 7


def test_stream_equals_batch_and_replays(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    header = "id,title,note,excerpt,url,folder,tags,created,cover,highlights,favorite\n"
    for i in range(3):
        (src / f"{i}.csv").write_text(header + "".join(f"{i}{j},T,,,https://x.com/{i}{j},,,,,,\n" for j in range(4)) + "9,same,,,https://x.com/same,,,,,,\n")
    store = state.StateStore(spark, str(tmp_path / "s"))
    for _ in range(2):
        query = incremental.process(incremental.read_exports(spark, str(src)), store, out, str(tmp_path / "c"))
        query.awaitTermination()
    assert spark.read.parquet(out).count() == 13 and store.read("processed_bookmarks").count() == 13
    (src / "3.csv").write_text(header + "9,changed,,,https://x.com/same,,,,,,\n1,bad,,,https://x.com/bad,,,,,,\n")
    mark = lambda df: df.withColumn("error", F.when(F.col("title") == "bad", "x"))
    query = incremental.process(incremental.read_exports(spark, str(src)), store, out, str(tmp_path / "c"), mark)
    query.awaitTermination()
    assert store.read("processed_bookmarks").where("status = 'failed'").count() == 1 and store.read("bookmark_history").where("change_type = 'updated'").count() == 1
    assert incremental.throughput(query)["rows"] == 2


def test_event_stream_windows_equal_batch(spark, tmp_path):
    events = spark.createDataFrame([(i, i % 2, float(i)) for i in range(50)], "s long, k long, v double").withColumn("ts", F.timestamp_seconds(F.col("s") * 300))
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    query = incremental.windowed(stream, "k", "v").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("windows")) == key(incremental.windowed(events, "k", "v"))


def test_plugins(spark, tmp_path):
    registry = Registry()
    registry.register(Plugin("b", {"post_tags": lambda df: df.withColumn("n", F.col("n") * 2)}, priority=2))
    registry.register(Plugin("a", {"post_tags": lambda df: df.withColumn("n", F.col("n") + 1)}, priority=1))
    rows = spark.createDataFrame([(1,)], "n int")
    assert registry.chain("post_tags", rows).first().n == 4 and [d.first().n for d in registry.each("post_tags", rows)] == [2, 2]
    with pytest.raises(ValueError):
        registry.register(Plugin("c", {"nowhere": lambda df: df}))
    (tmp_path / "p.py").write_text("from linkloom.plugins import paywall_plugin\nplugin = paywall_plugin()\n")
    assert registry.load(str(tmp_path)) == ["paywall"] and registry.at("post_validation")
    (tmp_path / "p.py").unlink()
    assert registry.load(str(tmp_path)) == [] and "paywall" not in registry.plugins  # loaded again as the files are now
    assert not registry.at("post_validation") and paywall_plugin().hooks["post_validation"](make(spark, [{}])).first().paywall == 0.0


def test_process_and_resume(spark, tmp_path):
    rows = make(spark, [{"url": "https://a.com/x", "title": "Python api"}, {"url": "http://www.a.com/x/", "note": "n"}, {"url": "http://10.0.0.1/"}, {"url": "https://b.com/404"}])
    kept = process.Options(work=str(tmp_path / "w"), now=NOW, input_id="x")
    done = process.run(rows, kept)
    assert done.count() == 1 and process.output(done).first().folder != ""
    assert process.run(rows.limit(0), kept).count() == 1
    # Another strategy, another input by its rows, and other filters start from the beginning.
    assert process.run(rows.limit(0), replace(kept, strategy="oldest")).count() == 0
    assert process.run(rows.limit(0), replace(kept, input_id="")).count() == 0 and process.run(rows, replace(kept, input_id="")).count() == 1
    assert process.run(rows.limit(0), replace(kept, wanted=predicates.valid_row())).count() == 0
    assert not (tmp_path / "none").exists() and process.run(rows, replace(kept, work=str(tmp_path / "none"), stages=("tags",))).count() == 4
    assert not list((tmp_path / "none").rglob("dedup"))
    fetched = lambda asked: asked.withColumns({"html": F.lit("<title>T</title><h1>Head line</h1>one two"), "status_code": F.when(F.col("url").contains("b.com"), 404).otherwise(200)})
    got = process.run(rows, process.Options(fetch=fetched, now=NOW, preview=4, wanted=predicates.valid_row())).collect()
    assert len(got) == 1 and got[0].page_title == "T" and got[0].word_count == 5
    assert process.results(process.run(rows, process.Options(now=NOW).only("tags"))).first().rows == 4


def test_process_uses_pages_and_descriptions(spark):
    rows = make(spark, [{"url": f"https://a.com/{i}", "title": f"t{i}", "note": "", "tags": []} for i in range(4)])
    page = "<title>Design</title><meta name='keywords' content='quasar, x1'><h1>Zebra crossing</h1><p>typography and graphic layout, subzebras</p>"
    fetched = lambda asked: asked.withColumns({"html": F.when(F.col("url").endswith("0"), F.lit(None)).otherwise(F.lit(page)), "status_code": F.lit(200)})
    told = lambda df: df.withColumn("enhanced_description", F.lit("A walrus"))
    got = {r.url[-1]: r for r in process.run(rows, process.Options(fetch=fetched, describe=told, now=NOW, tags_per_row=50)).collect()}
    assert {"quasar", "zebra", "walrus"} <= set(got["1"].optimized_tags) and {"quasar", "zebra"}.isdisjoint(got["0"].optimized_tags) and "walrus" in got["0"].optimized_tags
    assert got["1"].category == "Design" != got["0"].category
    # The heading counts in the row's relevance, so its word comes before one of the text or the keywords alone.
    assert got["1"].optimized_tags.index("zebra") < got["1"].optimized_tags.index("quasar")


def test_content_score_of_any_tag(spark):
    pages = spark.createDataFrame([("u", ["c++"], ["Zebras"], "text"), ("v", [], ["On C++"], "zebra"), ("w", [], [], "subzebras c++ machine-learning"), ("x", [], [], "")], "url string, categories array<string>, headings array<string>, body string")
    found = spark.createDataFrame([(u, t) for u in "ab" for t in ("zebra", "c++", "learning", "none")], "url string, tag string")
    got = {r.tag: round(r.content_score, 6) for r in tagging.scored(found, make(spark, [{}, {"url": "https://b.com"}]), pages).collect()}
    assert got == {"zebra": 0.275, "c++": 0.45, "learning": 0.075, "none": 0.0}


def test_command_line(spark, tmp_path, capsys):
    src = tmp_path / "a.csv"
    src.write_text("id,title,note,excerpt,url,folder,tags,created,cover,highlights,favorite\n1,Python,,,https://a.com/x,Tech,ai,2024-01-01,,,\n2,News,,,https://b.com/y,,news,2024-02-01,,,\n")
    assert cli.main(["detect", str(src)], spark) == 0 and "csv" in capsys.readouterr().out
    cli.main(["process", str(src), str(tmp_path / "out"), "--filter-tag", "ai", "--skip-content"], spark)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 1
    cli.main(["process", str(src), str(tmp_path / "none"), "--dry-run", "--tags-only"], spark)
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1])["rows"] == 2
    for kind in ("json", "jsonl", "markdown", "vault", "table", "opml", "html", "csv"):
        cli.main(["export", str(src), str(tmp_path / f"e.{kind}"), "--format", kind], spark)
        assert (tmp_path / f"e.{kind}").exists()
    cli.main(["analyze", str(src)], spark), cli.main(["monitor", str(src)], spark), cli.main(["convert", str(src), str(tmp_path / "conv")], spark)
    assert '"healthy"' in capsys.readouterr().out


def test_configuration(tmp_path, spark, capsys):
    path = str(tmp_path / "c.toml")
    cli.main(["create-config", path])
    assert config.load(path) == config.Settings() and len(config.Settings().digest()) == 16
    cli.main(["config", path])
    assert json.loads(capsys.readouterr().out)["batch_size"] == 100
    assert config.from_dict({"network": {"timeout": 5}}).timeout == 5
    for bad in ({"batch_size": 1}, {"nothing": 1}, {"engine": "x"}):
        with pytest.raises(ValueError):
            config.from_dict(bad)


def test_enhance_backup_and_rollback(spark, tmp_path):
    src = tmp_path / "a.csv"
    src.write_text("id,title,note,excerpt,url,folder,tags,created,cover,highlights,favorite\n1,Python,,,https://a.com/x,Tech,ai,2024-01-01,,,\n2,News,,,https://b.com/y,,news,2024-02-01,,,\n")
    where = str(tmp_path / "state")
    cli.main(["enhance", str(src), str(tmp_path / "one"), "--state", where], spark)
    cli.main(["enhance", str(src), str(tmp_path / "two"), "--state", where], spark)
    read = lambda n: spark.read.option("header", True).csv(str(tmp_path / n)).count()
    assert read("one") == 2 and read("two") == 0
    store = state.StateStore(spark, where)
    store.export_state(str(tmp_path / "dump"))
    other = state.StateStore(spark, str(tmp_path / "other"))
    other.import_state(str(tmp_path / "dump"))
    other.import_state(str(tmp_path / "dump"))
    assert other.read("processed_bookmarks").count() == 2 and other.read("processing_runs").count() == 2
    assert state.stale(store.read("processed_bookmarks").select("url"), store.read("processed_bookmarks"), F.lit("2000-01-01").cast("timestamp")).count() == 0
    cli.main(["backup", str(src), str(tmp_path / "b")], spark), cli.main(["rollback", str(tmp_path / "b"), str(tmp_path / "back")], spark)
    assert read("back") == 2


def test_generated_texts(spark):
    said = ['```json\n{"description": "This is a fine long page", "tags": ["AI!", "x", "ai"], "category": "c"}\n```', "short", "plain words that are long enough", '{"description": "This is a fine", "confidence": 7}', None]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "v string").select(generated.parsed(F.col("v"))).collect()]
    assert (got[0].description, got[0].tags, got[0].confidence) == ("Fine long page", ["ai"], 0.8)
    assert got[1].description == "No description available" and got[2].tags == ["uncategorized"] and got[3].category == "other" and got[4].confidence == 0.5
    row = spark.range(1).select(generated.cleaned(F.lit('Summary:  "A  page"')).alias("c"), generated.content_type(F.array().cast("array<string>"), F.lit(""), F.lit("A study"), F.lit("")).alias("t"), generated.simple_categories(F.lit("Breaking: web")).alias("s"), generated.merged(F.lit("T"), F.lit(""), F.lit("body"), F.lit("Title"), F.lit("n"), F.lit("ex")).alias("m"), urls.sanitized(F.lit("HTTP://u@Ex.com:80/a/../b?q#f")).alias("u")).first()
    assert (row.c, row.t, row.s, tuple(row.m), row.u) == ("A page.", "research", ["news", "technology"], ("Title", "ex", "User Note: n | body"), "https://ex.com:80/a/b?q")


def test_main_text(spark):
    long = "word " * 30
    page = f"<body><nav>{long}</nav><div class='content'><p>{long}<p>more<div class='ad'>{long}</div></div><p>{long}</p></body>"
    assert pages.main_text(page) == (long.strip() + " more") and pages.main_text(f"<p>{long}<p>tiny") == long.strip() and pages.main_text(None) == ""
    assert spark.range(1).select(pages.main_content(F.lit(page)).alias("t")).first().t.startswith("word")


def test_since():
    now = datetime(2024, 6, 8)
    assert [str(dates.since(s, now))[:10] for s in ("7d", "1w", "24h", "2024-01-02", "31/12/2023")] == ["2024-06-01", "2024-06-01", "2024-06-07", "2024-01-02", "2023-12-31"]
    with pytest.raises(ValueError):
        dates.since("soon", now)


def test_more_metrics(spark):
    rows = spark.createDataFrame([(i, "a", float(i)) for i in range(12)], "ts long, k string, v double")
    assert metrics.drift(rows, "k", "v").first().change == 9.0 and metrics.numbered(rows, 5, "k", "ts").agg(F.max("batch")).first()[0] == 2
    assert metrics.shares(rows.withColumn("r", F.col("ts") % 3 == 0), "r").where("r").first().percent == 33.33
    batches = spark.createDataFrame([(10, 9, 1, 5.0, 0.1), (10, 10, 0, 5.0, 0.3)], "items long, succeeded long, failed long, seconds double, cost double")
    assert metrics.batch_statistics(batches).first()[4:] == (0.95, 2.0, 0.02)
    status = lambda *a: spark.range(1).select(metrics.health_of(*map(F.lit, a))).first()[0]
    assert [status(100, 30, 1.0, 20, 0), status(100, 15, 1.0, 20, 0), status(100, 0, 0.05, 20, 0), status(100, 0, 1.0, 20, 600), status(100, 0, 0.0, 5, 900)] == ["critical", "degraded", "slow", "memory_concern", "healthy"]


def test_more_tags_and_folders(spark):
    rows = make(spark, [{"url": "https://github.com/x", "title": "Python", "tags": ["python", "to-read"], "folder": "a/b/c/d"}, {"title": "x"}])
    sure = {r.tag.rsplit("/", 1)[-1]: r.confidence for r in tagging.with_confidence(rows, spark.createDataFrame([("python",), ("to-read",)], "tag string")).collect()}
    assert sure["to-read"] == 0.95 and sure["python"] == 0.95
    assert [r.path for r in folders.preserved(rows).orderBy("pos").collect()] == ["a/b/c", "Uncategorized"]
    row = spark.range(1).select(tagging.branch(F.lit("ml")).alias("b"), tagging.from_content(F.array(F.lit("tool")), F.lit("js, x"), F.array(F.lit("Docker"))).alias("t"), folders.reasoning(F.lit("Design"), F.lit("General"), F.lit("figma.com"), F.lit("Old")).alias("r")).first()
    assert row.b == "technology" and {"tool", "javascript", "docker"} <= set(row.t) and row.r == "category: Design; known host: figma.com; was in: Old"


def test_confidence_counts_content_categories(spark):
    rows = make(spark, [{"url": "https://a.com/x", "title": "Python"}, {"url": "https://b.com/y", "title": "Python"}])
    rows = rows.withColumn("categories", F.when(F.col("pos") == 0, F.array(F.lit("python"))).otherwise(F.array().cast("array<string>")))
    sure = {r.url: r.confidence for r in tagging.with_confidence(rows, spark.createDataFrame([("python",)], "tag string")).collect()}
    assert sure == {"https://a.com/x": 0.9, "https://b.com/y": 0.7}


def test_review_and_render(spark, tmp_path):
    rows = make(spark, [{}]).withColumn("reasons", F.array(F.lit("untagged")))
    export.write_review(rows, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).first().reasons == "untagged"
    assert export.render("T", {"a": 1}, "markdown").endswith("| a | 1 |") and json.loads(export.render("T", {"a": 1}, "json"))["a"] == 1 and "a  1" in export.render("T", {"a": 1})
