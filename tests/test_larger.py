"""Queries against their SQL on tables with more rows than one shuffle partition gets, which the smallest tables don't have."""

import duckdb
import pytest
from pyspark.sql import functions as F

from linkloom.plans import catalogue
from linkloom.sources import csv

from .test_catalogue import plain


@pytest.fixture(scope="module")
def larger(spark, tmp_path_factory):
    """60,000 pages; texts that do not compress, so that shuffles of more columns are cut otherwise than those of fewer."""
    root = tmp_path_factory.mktemp("larger")
    n = F.col("id").cast("string")
    html = F.concat(F.lit("<title>page "), F.sha2(n, 512), F.sha2(F.concat(n, F.lit("x")), 512), F.lit("</title>"))
    spark.range(0, 60_000, 1, 8).select(F.col("id").alias("page_id"), F.concat(F.lit("https://a.example.com/en/"), n).alias("url"), html.alias("html")).write.parquet(f"{root}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{root}/pages.parquet/*.parquet'")
    return str(root), con


@pytest.mark.parametrize("name", ["csv_export_ids", "csv_import_modes", "csv_quality", "csv_round_trip", "multi_file_union", "stream_incremental"])
def test_query_matches_sql_on_more_pages(spark, larger, name):
    root, con = larger
    df = catalogue.QUERIES[name](spark, root)
    names = sorted(df.columns)
    found = con.sql(catalogue.ORACLES[name])
    places = [found.columns.index(c) for c in names]
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    assert got == sorted((tuple(plain(r[i]) for i in places) for r in found.fetchall()), key=str)


def test_export_ids_with_gaps_ties_and_nulls(spark):
    """Sparse, equal and missing positions: ids are 1 to n once each, in order, also over files."""
    rows = spark.range(0, 90_000, 1, 5).selectExpr("CASE WHEN id % 1000 = 7 THEN NULL WHEN id < 40000 THEN 3 ELSE id * id * 1000 END AS pos", "sha2(string(id), 512) AS url", "array('a') AS tags")
    got = csv.as_export(rows.withColumn("note", F.col("pos").cast("string"))).select("id", "note").collect()
    assert [int(r.id) for r in got] == list(range(1, 90_001))
    assert [r.note for r in got[-90:]] == [""] * 90
    known = [int(r.note) for r in got[:-90]]
    assert known == sorted(known)
    assert csv.as_export(rows.limit(0)).count() == 0


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """40 pages twice: their rows share URL, title and tags and differ only in position; one URL a third time under another title."""
    root = tmp_path_factory.mktemp("repeated")
    rows = [(i + more, f"https://www.example.com/blog/page-{i}", f"<title>Python video {i}</title>") for more in (0, 210) for i in range(40)]
    spark.createDataFrame([*rows, (501, rows[0][1], "<title>News on the web</title>")], "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{root}/pages.parquet/*.parquet'")
    return str(root), con


@pytest.mark.parametrize("name", ["tag_surest", "tag_assignments"])
def test_query_matches_sql_on_repeated_pages(spark, repeated, name):
    test_query_matches_sql_on_more_pages(spark, repeated, name)


def test_tags_are_chosen_by_scores_that_are_equal_as_decimals(spark, tmp_path):
    """Two tags of one score that is half way at six digits, for the last place of 150: the first by name has it, though its terms are others."""
    more = " ".join(f"word{i}x" for i in range(138))
    url = lambda i: f"https://example.com/?n={i}" + ("aaa1a" if i < 6 else "zzzz" if i == 6 else "")
    rows = [(i, url(i), f"<title>{'aaa1a zzzz' if i < 12 else more}</title>") for i in range(160)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    last = con.execute(catalogue.ORACLES["tag_choice"] + " ORDER BY place DESC LIMIT 1").fetchall()
    assert last == [("aaa1a", 150)]
    test_query_matches_sql_on_more_pages(spark, (str(tmp_path), con), "tag_assignments")
