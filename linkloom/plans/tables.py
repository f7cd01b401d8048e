"""The driver's tables as the engine's tables, and the same in DuckDB SQL.

``pages`` serve as bookmarks: a title from the HTML, and notes, folders, tags and dates by rules on page_id.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, urls

FOLDERS = ("", "Development", "Development/Python", "News/World/Today", "Reading list", "/")
TAGS = ("python", "news", "ai", "design", "web", "video", "reference")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, which only local sessions may leave out."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set")
        root = tempfile.mkdtemp(prefix="linkloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def put_text(spark: SparkSession, path: str, said: str) -> str:
    """A small text file, written by Spark's file systems."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(said.encode("utf-8")))
    out.close()
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, url, title, note, excerpt, folder, tags, created) from pages."""
    n = F.col("page_id")
    title = html.title(F.col("html"))
    pick = lambda words, m: F.element_at(F.array(*[F.lit(w) for w in words]), (m % len(words) + 1).cast("int"))
    tags = F.filter(F.array(F.when(n % 2 == 0, pick(TAGS, n)), F.when(n % 3 == 0, pick(TAGS, n + 1)), F.when(n % 5 == 0, pick(TAGS, n + 3))), lambda t: t.isNotNull())
    return table(spark, sf_dir, "pages").select(
        n.alias("pos"), "url", title.alias("title"),
        F.when(n % 3 == 0, "").when(n % 3 == 1, F.concat(F.lit("see "), title)).otherwise("short note").alias("note"),
        F.when(n % 4 == 0, "an excerpt").otherwise("").alias("excerpt"),
        pick(FOLDERS, n).alias("folder"), tags.alias("tags"),
        F.when(n % 7 != 0, F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(CAST(page_id % 150 AS INT))")).alias("created"),
    )


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bookmarks(spark, sf_dir).withColumn("dedup_key", urls.dedup_key(F.col("url")))


SQL_CLEAN = r"regexp_replace(regexp_replace(regexp_replace({0}, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
SQL_TITLE = SQL_CLEAN.format(r"replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')").replace('\\"', '"')
SQL_DOMAIN = r"regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)), '^www\.', '')"
SQL_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)"
SQL_QUERY = r"regexp_extract(url, '\?([^#]*)', 1)"
#: For URLs whose parameters need no decoding, as those of the tables.
SQL_KEY = f"'https://' || {SQL_DOMAIN} || CASE WHEN {SQL_PATH} = '/' THEN '/' ELSE regexp_replace(lower({SQL_PATH}), '/+$', '') END || CASE WHEN {SQL_QUERY} = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split({SQL_QUERY}, '&')), '&') END"


def _pick(words: tuple[str, ...], n: str) -> str:
    return f"list_extract([{', '.join(repr(w) for w in words)}], ({n}) % {len(words)} + 1)"


#: A CTE list that defines b (bookmarks) and k (with dedup_key).
SQL_BOOKMARKS = f"""b AS (
  SELECT page_id AS pos, url, title, CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN 'see ' || title ELSE 'short note' END AS note,
    CASE WHEN page_id % 4 = 0 THEN 'an excerpt' ELSE '' END AS excerpt, {_pick(FOLDERS, 'page_id')} AS folder,
    list_filter([CASE WHEN page_id % 2 = 0 THEN {_pick(TAGS, 'page_id')} END, CASE WHEN page_id % 3 = 0 THEN {_pick(TAGS, 'page_id + 1')} END, CASE WHEN page_id % 5 = 0 THEN {_pick(TAGS, 'page_id + 3')} END], lambda t: t IS NOT NULL) AS tags,
    CASE WHEN page_id % 7 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_days((page_id % 150)::INT) END AS created
  FROM (SELECT page_id, url, {SQL_TITLE} AS title FROM pages)),
k AS (SELECT *, {SQL_KEY} AS dedup_key FROM b)"""
