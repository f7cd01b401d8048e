"""Composable row predicates. Each is a Column that is true or false, never null, so Catalyst pushes it down."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime, time
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls


@dataclass(frozen=True)
class Predicate:
    """A named condition; combine with & | ~."""

    column: Column
    name: str = "custom"

    def __and__(self, other: Predicate) -> Predicate:
        return Predicate(self.column & other.column, f"({self.name} and {other.name})")

    def __or__(self, other: Predicate) -> Predicate:
        return Predicate(self.column | other.column, f"({self.name} or {other.name})")

    def __invert__(self) -> Predicate:
        return Predicate(~self.column, f"not {self.name}")

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.column)

    def count(self, df: DataFrame) -> int:
        return self.apply(df).count()


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def glob_regex(pattern: str, case_sensitive: bool = False) -> str:
    """A folder glob as a full-match regular expression: * any run, ? one character."""
    body = "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in pattern)
    return f"{'' if case_sensitive else '(?i)'}^{body}$"


def folder(pattern: str, case_sensitive: bool = False, c: str = "folder") -> Predicate:
    return Predicate(F.coalesce(F.col(c), F.lit("")).rlike(glob_regex(pattern, case_sensitive)), f"folder {pattern}")


def tag(tags: Iterable[str], mode: str = "any", case_sensitive: bool = False, c: str = "tags") -> Predicate:
    wanted = list(tags) if case_sensitive else [t.lower() for t in tags]
    held = F.coalesce(F.col(c) if case_sensitive else F.transform(c, F.lower), F.array().cast("array<string>"))
    listed = F.array(*[F.lit(t) for t in wanted]).cast("array<string>")
    found = F.arrays_overlap(held, listed) if mode == "any" else F.size(F.array_except(listed, held)) == 0
    return Predicate(_sure(found), f"{mode} tag of {wanted}")


def created_between(start: datetime | None = None, end: datetime | None = None, c: str = "created") -> Predicate:
    """Both ends included; a row without a date never matches."""
    inside = F.col(c).isNotNull()
    if start is not None:
        inside = inside & (F.col(c) >= F.lit(start))
    if end is not None:
        inside = inside & (F.col(c) <= F.lit(end))
    return Predicate(inside, f"created {start}..{end}")


def created_range(text: str, c: str = "created") -> Predicate:
    """From ``start:end`` in ISO dates, either may be empty; the last day counts to its end."""
    first, _, last = text.partition(":")
    start = datetime.fromisoformat(first.strip()) if first.strip() else None
    end = datetime.combine(datetime.fromisoformat(last.strip()).date(), time.max) if last.strip() else None
    return created_between(start, end, c)


def domain(domains: Iterable[str], subdomains: bool = True, c: str = "url") -> Predicate:
    wanted = [d.lower().removeprefix("www.") for d in domains]
    host = urls.host(F.col(c))
    found = host.isin(*wanted)
    if subdomains:
        found = reduce(lambda a, d: a | host.endswith(f".{d}"), wanted, found)
    return Predicate(_sure(found), f"domain of {wanted}")


#: Conditions on the processing_status struct by name.
STATUSES: dict[str, Callable[[Column], Column]] = {
    "validated": lambda s: s["url_validated"],
    "not_validated": lambda s: ~s["url_validated"],
    "invalid": lambda s: s["url_validation_error"].isNotNull(),
    "content_extracted": lambda s: s["content_extracted"],
    "ai_processed": lambda s: s["ai_processed"],
    "not_processed": lambda s: ~s["ai_processed"],
    "tags_optimized": lambda s: s["tags_optimized"],
    "error": lambda s: s["url_validation_error"].isNotNull() | s["content_extraction_error"].isNotNull() | s["ai_processing_error"].isNotNull(),
}


def status(names: Iterable[str], c: str = "processing_status") -> Predicate:
    names = list(names)
    return Predicate(reduce(lambda a, n: a | _sure(STATUSES[n](F.col(c))), names, F.lit(False)), f"status of {names}")


def url_matches(pattern: str, ignore_case: bool = True, c: str = "url") -> Predicate:
    return Predicate(_sure(F.col(c).rlike(("(?i)" if ignore_case else "") + pattern)), f"url ~ {pattern}")


def custom(condition: Column | Callable, name: str = "custom", c: str = "url") -> Predicate:
    """A boolean Column, or a Python function of one column's value (Arrow batches)."""
    if isinstance(condition, Column):
        return Predicate(_sure(condition), name)
    checked = F.pandas_udf(lambda s: s.map(lambda v: bool(condition(v))), "boolean")
    return Predicate(_sure(checked(F.col(c))), name)


def every(predicates: Iterable[Predicate]) -> Predicate:
    return reduce(lambda a, b: a & b, predicates, Predicate(F.lit(True), "all"))


def some(predicates: Iterable[Predicate]) -> Predicate:
    """Any of them; without any, everything."""
    predicates = list(predicates)
    return reduce(lambda a, b: a | b, predicates) if predicates else Predicate(F.lit(True), "all")


def valid_row() -> Predicate:
    return Predicate(F.length(F.trim(F.coalesce("url", F.lit("")))) > 0, "valid")


def from_options(options: dict) -> Predicate:
    """From command line options: folder, tag (comma list), date, domain (comma list), status, retry_invalid."""
    found = []
    if options.get("filter_folder"):
        found.append(folder(options["filter_folder"]))
    if options.get("filter_tag"):
        found.append(tag([t.strip() for t in options["filter_tag"].split(",")]))
    if options.get("filter_date"):
        found.append(created_range(options["filter_date"]))
    if options.get("filter_domain"):
        found.append(domain([d.strip() for d in options["filter_domain"].split(",")]))
    if options.get("filter_status"):
        found.append(status([options["filter_status"]]))
    if options.get("retry_invalid"):
        found.append(status(["invalid"]))
    return every(found)
