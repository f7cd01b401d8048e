"""Error classes, retry delays and cost arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dictionaries as D
from . import text


def http_error(code: Column) -> Column:
    """The type of an HTTP error code."""
    kind = F.when(code.between(400, 499), "client_error").when(code.between(500, 599), "server_error").otherwise("http_error")
    for n, name in D.HTTP_ERRORS.items():
        kind = F.when(code == n, name).otherwise(kind)
    return kind


def retry_class(message: Column) -> Column:
    """The class of an error message: the first whose words it holds."""
    low = F.lower(message)
    kind = F.lit("unknown")
    for name, words in reversed(D.ERROR_WORDS.items()):
        kind = F.when(text.any_of(low, words), name).otherwise(kind)
    return kind


#: Category, severity, whether trying again can help, and the words that tell it: fixed values, the first that fits counts.
CATEGORIES = (
    ("network", "medium", True, ("timeout",)),
    ("api_limit", "high", True, ("rate limit", "quota", "429")),
    ("api_auth", "critical", False, ("unauthorized", "403", "401", "api key", "authentication")),
    ("network", "medium", True, ("network", "connection", "dns")),
    ("api_error", "high", True, ("500", "502", "503")),
    ("validation", "low", False, ("validation", "invalid")),
    ("system", "high", True, ("memory", "resource")),
)


def categorized(message: Column) -> Column:
    """struct(category, severity, recoverable) of an error message."""
    low = F.lower(F.coalesce(message, F.lit("")))
    told = lambda name, severity, again: F.struct(F.lit(name).alias("category"), F.lit(severity).alias("severity"), F.lit(again).alias("recoverable"))
    out = told("processing", "medium", True)
    for name, severity, again, words in reversed(CATEGORIES):
        out = F.when(text.any_of(low, words), told(name, severity, again)).otherwise(out)
    return out


def processing_seconds(items: Column, mean_response: Column, concurrent: Column) -> Column:
    """Estimated seconds for some items: two each without history; else the mean response by the share that runs at once, a tenth of a second each, and a fifth more."""
    share = F.least(concurrent, items) / F.nullif(items, F.lit(0))
    known = items * (mean_response * share + 0.1) * 1.2
    return F.when(F.coalesce(mean_response, F.lit(0.0)) <= 0, items * 2.0).otherwise(F.coalesce(known, F.lit(0.0)))


def backoff(attempt: Column, base: float = 1.0, most: float = 60.0, factor: float = 2.0) -> Column:
    """Exponential delay without jitter."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(factor), attempt))


def linear_backoff(attempt: Column, base: float = 1.0, step: float = 1.0, most: float = 60.0) -> Column:
    return F.least(F.lit(most), F.lit(base) + F.lit(step) * attempt)


def retries(kind: Column) -> Column:
    """struct(times, first_delay) of an error class."""
    out = F.struct(F.lit(1).alias("times"), F.lit(3.0).alias("first_delay"))
    for name, (times, first) in D.RETRIES.items():
        out = F.when(kind == name, F.struct(F.lit(times).alias("times"), F.lit(first).alias("first_delay"))).otherwise(out)
    return out


def batch_cost(n: Column, base: Column) -> Column:
    """Estimated cost of a batch: overheads of 10 and 5 %, discount beyond 100 items, surcharge below 10, a least cost per item."""
    factor = 1.15 + F.when(n > 100, -0.15).when(n < 10, 0.2).otherwise(0.0)
    return F.greatest(F.lit(1e-5), base * factor) * n


def content_length(c: Column) -> Column:
    return text.strip(c).try_cast("long")
