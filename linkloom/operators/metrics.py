"""Cost, rate, retry and progress metrics over event rows: aggregates by provider or time, frames of last samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ranges

def by_provider(costs: DataFrame, provider: str = "provider", cost: str = "cost_usd", ts: str = "timestamp") -> DataFrame:
    return costs.groupBy(provider).agg(F.count("*").alias("requests"), F.round(F.sum(cost), 6).alias("total_cost"), F.round(F.avg(cost), 6).alias("avg_cost"), F.min(ts).alias("first_used"), F.max(ts).alias("last_used"))


def by_hour(costs: DataFrame, cost: str = "cost_usd", ts: str = "timestamp") -> DataFrame:
    return costs.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(F.count("*").alias("requests"), F.round(F.sum(cost), 6).alias("total_cost"))


def by_day(costs: DataFrame, cost: str = "cost_usd", ts: str = "timestamp") -> DataFrame:
    return costs.groupBy(F.date_trunc("day", ts).alias("day")).agg(F.count("*").alias("requests"), F.round(F.sum(cost), 6).alias("total_cost"))


def peak_hour(costs: DataFrame, cost: str = "cost_usd", ts: str = "timestamp") -> DataFrame:
    """The hour of greatest cost, the earlier of equal ones."""
    return by_hour(costs, cost, ts).orderBy(F.desc("total_cost"), "hour").limit(1)


def usage_between(costs: DataFrame, start: Column, end: Column, cost: str = "cost_usd", ts: str = "timestamp") -> DataFrame:
    inside = (F.col(ts) >= start) & (F.col(ts) <= end)
    return costs.where(inside).agg(F.count("*").alias("requests"), F.round(F.coalesce(F.sum(cost), F.lit(0.0)), 6).alias("total_cost"))


def hourly_projection(costs: DataFrame, now: Column, minutes: int = 30, least: int = 3, cost: str = "cost_usd", ts: str = "timestamp") -> DataFrame:
    """Cost an hour at the rate of the last minutes; 0 with too few records."""
    seen = costs.where((F.col(ts) >= now - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col(ts) <= now)).agg(F.count("*").alias("n"), F.sum(cost).alias("spent"), F.min(ts).alias("since"))
    hours = (F.unix_micros(now) - F.unix_micros("since")) / 3.6e9
    return seen.select(F.round(F.when((F.col("n") >= least) & (hours > 0), F.col("spent") / hours).otherwise(0.0), 6).alias("per_hour"))


#: Ranks, positions and microseconds that one task holds of a group.
RANKS, POSITIONS, MICROS = 100_000, 100_000, 3_600_000_000


def rolling(samples: DataFrame, by: str, value: str, last: int = 60, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Adds the mean of the last samples of a group, its own included. The first of ``order`` is a time.

    A group is cut by time to rank its samples, then by rank, each cut with the samples before it that its first frames reach back to.
    """
    numbered = ranges.ranked(samples, [by], F.floor(F.unix_micros(F.col(order[0]).cast("timestamp")) / MICROS), list(order))
    place, size = F.col("_rank") - 1, max(RANKS, last)
    cut = ranges.with_carry(numbered, F.floor(place / size), place % size >= size - (last - 1))
    frame = W.partitionBy(by, "_slice").orderBy("_rank").rowsBetween(1 - last, W.currentRow)
    return cut.withColumn("rolling", F.avg(value).over(frame)).where("NOT _carried").select(*samples.columns, "rolling")


def sliding_count(events: DataFrame, by: str, seconds: int = 60, ts: str = "ts") -> DataFrame:
    """Adds how many events of a group fall into the window that ends with each. A group is cut by time, each cut with the seconds before it."""
    micros, width = F.unix_micros(ts), max(MICROS, seconds * 1_000_000)
    cut = ranges.with_carry(events, F.floor(micros / width), F.pmod(micros, F.lit(width)) >= width - seconds * 1_000_000)
    frame = W.partitionBy(by, "_slice").orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    return cut.withColumn("in_window", F.count("*").over(frame)).where("NOT _carried").select(*events.columns, "in_window")


def gaps(events: DataFrame, by: str, ts: str = "ts", order: tuple[str, ...] = ()) -> DataFrame:
    """Adds the microseconds since the group's event before; null for the first."""
    before = F.lag(F.unix_micros(ts)).over(W.partitionBy(by).orderBy(ts, *order))
    return events.withColumn("gap", F.unix_micros(ts) - before)


def trend(samples: DataFrame, by: str, value: str, last: int = 5, share: float = 0.1, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """(by, trend): the mean of the last samples against those before; stable within a tenth, unknown with fewer than both."""
    ranked = samples.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(*[F.desc(c) for c in order])))
    told = ranked.where(F.col("_n") <= 2 * last).groupBy(by).agg(F.count("*").alias("n"), F.avg(F.when(F.col("_n") <= last, F.col(value))).alias("now"), F.avg(F.when(F.col("_n") > last, F.col(value))).alias("before"))
    word = F.when(F.col("n") < 2 * last, "insufficient_data").when(F.col("now") > F.col("before") * (1 + share), "increasing").when(F.col("now") < F.col("before") * (1 - share), "decreasing").otherwise("stable")
    return told.select(by, word.alias("trend"))


def tuned_batch_size(samples: DataFrame, last: int = 10, least: int = 2, smallest: int = 10, largest: int = 500) -> DataFrame:
    """The size with the least mean seconds among the last samples (ts, size, seconds), of those seen often enough; clamped."""
    recent = samples.orderBy(F.desc("ts"), F.desc("size")).limit(last)
    means = recent.groupBy("size").agg(F.count("*").alias("n"), F.avg("seconds").alias("mean")).where(F.col("n") >= least)
    return means.agg(F.min(F.struct("mean", "size")).alias("b")).select(F.greatest(F.lit(smallest), F.least(F.lit(largest), F.col("b.size"))).alias("size"))


def adapted_concurrency(samples: DataFrame, now: int, last: int = 5, fast: float = 1.0, slow: float = 3.0) -> DataFrame:
    """Ten more after fast responses, ten fewer after slow ones, from 10 to 100."""
    mean = samples.orderBy(F.desc("ts")).limit(last).agg(F.avg("seconds").alias("mean"))
    return mean.select(F.greatest(F.lit(10), F.least(F.lit(100), F.when(F.col("mean") < fast, now + 10).when(F.col("mean") > slow, now - 10).otherwise(now))).alias("concurrency"))


def validation_statistics(checks: DataFrame) -> DataFrame:
    """One row over VALIDATION rows: counts, rate, mean response time."""
    return checks.agg(F.count("*").alias("total"), F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"), F.round(F.coalesce(F.avg(F.col("is_valid").cast("double")), F.lit(0.0)), 6).alias("success_rate"), F.round(F.avg("response_time"), 6).alias("avg_response"))


def counted(rows: DataFrame, *by: str) -> DataFrame:
    """Counts by class: error types, categories and severities, retry classes, statuses."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def stage_summary(stages: DataFrame) -> DataFrame:
    """Per stage (stage, started, ended, items, failed): seconds, success rate, items a second."""
    told = stages.groupBy("stage").agg(F.sum((F.unix_micros("ended") - F.unix_micros("started")) / 1e6).alias("seconds"), F.sum("items").alias("items"), F.sum("failed").alias("failed"))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return told.select("stage", F.round("seconds", 6).alias("seconds"), "items", F.round(rate(F.col("items") - F.col("failed"), F.col("items")), 6).alias("success_rate"), F.round(rate(F.col("items"), F.col("seconds")), 6).alias("items_per_second"))


def cost_estimate(costs: DataFrame, bookmarks: int, provider: str, sample: int = 10, window: int = 100) -> DataFrame:
    """Expected cost from the mean cost per bookmark of the last successful records of a provider among its latest ones."""
    recent = costs.where(F.col("provider") == provider).orderBy(F.desc("timestamp")).limit(window)
    good = recent.where("success AND bookmark_count > 0").orderBy(F.desc("timestamp")).limit(sample)
    return good.agg(F.count("*").alias("records"), F.round(F.coalesce(F.avg(F.col("cost_usd") / F.col("bookmark_count")), F.lit(0.0)) * bookmarks, 6).alias("estimate"))


def routed(rows: DataFrame, words: Column, confidence: Column, kind: Column, cost: Column, budget: float, order: str, by: str, cloud_kinds: tuple[str, ...] = ()) -> DataFrame:
    """Adds the engine of each row: local once the budget's running sum in a group is spent, for short texts and by default; cloud for kinds that need it and unsure ones.

    ``order`` is a whole number; a group is cut by it, and sums of cuts place each.
    """
    own = rows.columns
    rows = ranges.running_sum(rows.withColumns({"_words": words, "_sure": confidence, "_kind": kind, "_cost": cost}), [by], F.floor(F.col(order) / POSITIONS), [order], "_cost", "_spent")
    spent, words, confidence, kind = (F.col(c) for c in ("_spent", "_words", "_sure", "_kind"))
    route = F.when(spent >= budget, "local").when(words < 200, "local").when(kind.isin(*cloud_kinds), "cloud").when(confidence < 0.7, "cloud").otherwise("local")
    return rows.select(*own, route.alias("route"))


def overall_progress(weights: list[float], done: list[Column]) -> Column:
    total = F.lit(0.0)
    for w, d in zip(weights, done, strict=True):
        total = total + F.lit(w) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), d))
    return total


def numbered(rows: DataFrame, size: int, by: str, order: str) -> DataFrame:
    """Adds ``batch``, from 0, in batches of fixed size within a group, by a whole number."""
    numbered = ranges.ranked(rows, [by], F.floor(F.col(order) / POSITIONS), [order])
    return numbered.withColumn("batch", F.floor((F.col("_rank") - 1) / size).cast("long")).drop("_rank")


def drift(samples: DataFrame, by: str, value: str, last: int = 10, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """(by, change): the last value less the first of the last samples."""
    ranked = samples.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(*[F.desc(c) for c in order]))).where(F.col("_n") <= last)
    return ranked.groupBy(by).agg(F.round(F.min_by(value, "_n") - F.max_by(value, "_n"), 6).alias("change"))


def health_of(processed: Column, failed: Column, rate: Column, samples: Column, memory_growth: Column) -> Column:
    """critical, degraded, slow, memory_concern or healthy, in this order. ``rate`` and growth count with over ten samples."""
    errors = failed / F.greatest(processed, F.lit(1))
    return (
        F.when(errors > 0.2, "critical").when(errors > 0.1, "degraded").when((samples > 10) & (rate < 0.1), "slow")
        .when((samples > 10) & (memory_growth > 500), "memory_concern").otherwise("healthy")
    )


def shares(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, percent): how often each value occurs, of all rows."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    total = rows.count()
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / max(1, total), 2))


def batch_statistics(batches: DataFrame) -> DataFrame:
    """One row over (items, succeeded, failed, seconds, cost) per batch: totals, success rate, items a second, cost an item."""
    told = batches.agg(*[F.sum(c).alias(c) for c in ("items", "succeeded", "failed", "seconds", "cost")], F.count("*").alias("batches"))
    rate = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 6)
    return told.select("batches", "items", "succeeded", "failed", rate("succeeded", "items").alias("success_rate"), rate("items", "seconds").alias("items_per_second"), rate("cost", "items").alias("cost_per_item"))
