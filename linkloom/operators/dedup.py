"""Duplicate groups under a key and which row of a group stays.

The row of a group that stays is an aggregate, so a key with very many rows is combined in the map tasks. Rows without a key (no URL) are all kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRATEGIES = ("newest", "oldest", "most_complete", "highest_quality")


def _said(c: str) -> Column:
    return F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0


def _points(*parts: tuple[Column, int]) -> Column:
    total = F.lit(0)
    for condition, n in parts:
        total = total + F.when(condition, n).otherwise(0)
    return total


def _n_tags() -> Column:
    return F.size(F.coalesce("tags", F.array().cast("array<string>")))


def completeness() -> Column:
    folder = F.coalesce("folder", F.lit(""))
    return _points((_said("title"), 2), (_said("note"), 3), (_said("excerpt"), 1), (_n_tags() > 0, 2), (~folder.isin("", "/"), 1), (F.col("created").isNotNull(), 1))


def quality(now: Column) -> Column:
    folder = F.coalesce("folder", F.lit(""))
    age = F.date_diff(now, "created")
    recent = F.when(age < 30, 2).when(age < 90, 1).otherwise(0)
    return _points((_said("title"), 2), (_said("note"), 4), (_n_tags() > 0, 2), (F.length(F.coalesce("note", F.lit(""))) > 50, 2), (_n_tags() > 3, 1), (folder.contains("/") & (folder != "/"), 1)) + recent


def rank_of(strategy: str, now: Column, pos: str = "pos") -> Column:
    """A struct whose greatest value in a group is the row that stays; an unknown strategy counts as newest.

    By date a row without one loses and the earlier row wins ties; of equally complete rows the first stays, of equally good ones the last.
    """
    early = -F.col(pos)
    if strategy == "most_complete":
        return F.struct(completeness().alias("a"), early.alias("b"))
    if strategy == "highest_quality":
        return F.struct(quality(now).alias("a"), F.col(pos).alias("b"))
    seconds = F.unix_micros("created") * (-1 if strategy == "oldest" else 1)
    return F.struct(F.col("created").isNotNull().cast("int").alias("b"), F.coalesce(seconds, F.lit(0)).alias("c"), early.alias("d"))


def winners(rows: DataFrame, strategy: str, now: Column, row: Column, key: str = "dedup_key", pos: str = "pos") -> DataFrame:
    """(key, group_size, w) of every key that is not empty, w being ``row`` of the row that stays. Map tasks combine first; no group is sorted.

    By date, a first row without a date wins over all.
    """
    keyed = rows.where(F.coalesce(F.col(key), F.lit("")) != "")
    best = F.max_by(row, rank_of(strategy, now, pos))
    if strategy not in ("most_complete", "highest_quality"):
        first = F.min_by(F.struct(F.col("created").isNull().alias("dateless"), row.alias("row")), pos)
        return keyed.groupBy(key).agg(F.count("*").alias("group_size"), best.alias("_best"), first.alias("_first")).select(key, "group_size", F.when(F.col("_first.dateless"), F.col("_first.row")).otherwise(F.col("_best")).alias("w"))
    return keyed.groupBy(key).agg(F.count("*").alias("group_size"), best.alias("w"))


def keep_one(rows: DataFrame, strategy: str = "highest_quality", now: Column | None = None, key: str = "dedup_key", pos: str = "pos") -> DataFrame:
    """Rows with ``kept`` and ``group_size``; rows with an empty key are kept. Positions tell rows apart."""
    now = F.current_timestamp() if now is None else now
    told = winners(rows, strategy, now, F.col(pos), key, pos)
    return rows.join(told, key, "left").select(*rows.columns, F.coalesce("group_size", F.lit(1)).alias("group_size"), F.coalesce(F.col("w") == F.col(pos), F.lit(True)).alias("kept"))


def groups(rows: DataFrame, key: str = "dedup_key", pos: str = "pos") -> DataFrame:
    """(key, members, first position) of keys with more than one row."""
    return rows.where(f"{key} <> ''").groupBy(key).agg(F.count("*").alias("members"), F.min(pos).alias("first_pos")).where("members > 1")


def summary(rows: DataFrame, key: str = "dedup_key") -> DataFrame:
    """One row: total, unique, groups, duplicates (rows in groups), removed."""
    sizes = rows.groupBy(F.coalesce(F.col(key), F.lit("")).alias("k")).agg(F.count("*").alias("n"))
    alone = F.col("k") == ""
    grouped = ~alone & (F.col("n") > 1)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return sizes.agg(
        zero(F.sum("n")).alias("total"),
        zero(F.sum(F.when(alone, F.col("n")).otherwise(1))).alias("unique_rows"),
        F.count_if(grouped).alias("groups"),
        zero(F.sum(F.when(grouped, F.col("n")))).alias("duplicates"),
        zero(F.sum(F.when(grouped, F.col("n") - 1))).alias("removed"),
    )


def first_of(rows: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """The first row of every key, by position: partial maxima in the map tasks, no sort of a group."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), pos).alias("r")).select("r.*")


def process(rows: DataFrame, strategy: str = "highest_quality", now: Column | None = None, dry_run: bool = False) -> DataFrame:
    """Rows that stay, in their columns; a dry run keeps all and says which would go."""
    now = F.current_timestamp() if now is None else now
    if dry_run:
        return keep_one(rows, strategy, now)
    alone = rows.where(F.coalesce("dedup_key", F.lit("")) == "")
    return winners(rows, strategy, now, F.struct(*rows.columns)).select("w.*").unionByName(alone)


def report(stats: dict) -> str:
    """A summary row as text."""
    share = 100 * stats["removed"] / stats["total"] if stats["total"] else 0.0
    return "\n".join(["Duplicate report", f"rows: {stats['total']}", f"unique: {stats['unique_rows']}", f"groups: {stats['groups']}", f"removed: {stats['removed']} ({share:.1f} %)"])
