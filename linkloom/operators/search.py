"""Full-text search over an inverted index with BM25, and substring search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TERM

K1, B = 1.2, 0.75


def index(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, term, tf, length): terms of the columns with their counts and the row's number of terms."""
    said = F.regexp_extract_all(F.lower(F.concat_ws(" ", *columns)), F.lit(f"({TERM})"))
    listed = rows.select(key, said.alias("terms")).select(key, F.size("terms").alias("length"), F.explode("terms").alias("term"))
    return listed.groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def bm25(inverted: DataFrame, key: str, query: str, rows: int, mean_length: float, most: int = 100) -> DataFrame:
    """(key, score) of the best rows that hold any term of the query; score rounded to 6 places, ties by key.

    Only postings of the query's terms are read; ``rows`` and ``mean_length`` are those of the collection.
    """
    import re

    terms = sorted(set(re.findall(TERM, query.lower())))
    hits = inverted.where(F.col("term").isin(*terms))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(1.0) + (F.lit(rows) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean_length)))
    scored = hits.join(F.broadcast(df), "term").groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))  # df has a row per query term
    return scored.orderBy(F.desc("score"), key).limit(most)


def matches(rows: DataFrame, key: str, query: str, *columns: str) -> DataFrame:
    """(key, length, hits): each row's number of terms and those that the query has, for a search without an index. One pass over the texts; hold it before ranking."""
    import re

    terms = F.array(*[F.lit(t) for t in sorted(set(re.findall(TERM, query.lower())))]).cast("array<string>")
    said = F.regexp_extract_all(F.lower(F.concat_ws(" ", *columns)), F.lit(f"({TERM})"))
    return rows.select(key, said.alias("terms")).select(key, F.size("terms").alias("length"), F.filter("terms", lambda t: F.array_contains(terms, t)).alias("hits"))


def ranked(matched: DataFrame, key: str, query: str, most: int = 100) -> DataFrame:
    """BM25 over what ``matches`` gave."""
    told = matched.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    postings = matched.where(F.size("hits") > 0).select(key, "length", F.explode("hits").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))
    return bm25(postings, key, query, told.n, told.mean or 1.0, most)


def containing(rows: DataFrame, query: str, *columns: str, most: int = 100, order: str = "url") -> DataFrame:
    """Rows where any column holds the text, case ignored."""
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(query.lower()))
    return rows.where(found).orderBy(order).limit(most)
