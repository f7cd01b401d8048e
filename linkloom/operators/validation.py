"""Field and record checks as arrays of issues, and recovery of missing or malformed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import text, urls


def issue(field: str, severity: str, message: str) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(severity).alias("severity"), F.lit(message).alias("message"))


def found(*checks: tuple[Column, str, str, str]) -> Column:
    """Issues whose condition holds: (condition, field, severity, message)."""
    return F.filter(F.array(*[F.when(c, issue(f, s, m)) for c, f, s, m in checks]), lambda x: x.isNotNull())


def _size(c: str) -> Column:
    return F.length(F.coalesce(F.col(c), F.lit("")))


_MARKUP = r"<[A-Za-z/!][^>]*>"
_TRACKERS = r"[?&](utm_[a-z]+|fbclid|gclid|ref)="


def field_issues(now: Column) -> dict[str, Column]:
    """Checks by field, over text columns as in an export."""
    url, created = F.coalesce(F.col("url"), F.lit("")), text.parse_time(F.col("created"))
    n_tags = F.size(F.filter(F.split(F.coalesce("tags", F.lit("")), "[,;|]"), lambda t: text.strip(t) != ""))
    long_tag = F.exists(F.split(F.coalesce("tags", F.lit("")), "[,;|]"), lambda t: F.length(text.strip(t)) > 50)
    depth = F.size(F.filter(F.split(F.coalesce("folder", F.lit("")), "/"), lambda p: p != ""))
    return {
        "id": found((_size("id") == 0, "id", "warning", "missing"), (_size("id") > 255, "id", "error", "too long")),
        "title": found((_size("title") == 0, "title", "warning", "missing"), (_size("title") > 500, "title", "warning", "too long"), (F.coalesce("title", F.lit("")).rlike(_MARKUP), "title", "warning", "markup")),
        "note": found((_size("note") > 2000, "note", "warning", "too long")),
        "excerpt": found((_size("excerpt") > 1000, "excerpt", "warning", "too long"), (F.coalesce("excerpt", F.lit("")).rlike(_MARKUP), "excerpt", "warning", "markup")),
        "url": found(
            (F.trim(url) == "", "url", "error", "missing"), ((F.trim(url) != "") & ~urls.well_formed(F.trim(url)), "url", "error", "malformed"), (F.length(url) > 2048, "url", "warning", "too long"),
            (urls.host(url).isin("localhost", "127.0.0.1"), "url", "warning", "local host"), (urls.domain(url).rlike(":(3000|5000|8000|8080|8888)$"), "url", "info", "development port"), (url.rlike(_TRACKERS), "url", "info", "tracking parameters"),
        ),
        "folder": found((F.coalesce("folder", F.lit("")).rlike(r"\\|//"), "folder", "warning", "slashes"), (depth > 10, "folder", "warning", "too deep")),
        "tags": found((n_tags > 20, "tags", "warning", "too many"), (long_tag, "tags", "warning", "too long")),
        "created": found(
            ((_size("created") > 0) & created.isNull(), "created", "error", "unreadable"), (created > now, "created", "warning", "in the future"), (created < F.lit("1990-01-01").cast("timestamp"), "created", "error", "before 1990"),
        ),
        "cover": found(((_size("cover") > 0) & ~F.coalesce("cover", F.lit("")).rlike("^https?://"), "cover", "warning", "not a web address")),
        "highlights": found((_size("highlights") > 5000, "highlights", "warning", "too long")),
        "favorite": found(((_size("favorite") > 0) & ~F.lower(F.trim(F.coalesce("favorite", F.lit("")))).isin("true", "false", "1", "0", "yes", "no", "on", "off"), "favorite", "warning", "not a flag")),
    }


def cross_issues() -> Column:
    same = lambda a, b: (_size(a) > 0) & (F.col(a) == F.col(b))
    return found((same("title", "url"), "title", "info", "equal to url"), (same("note", "excerpt"), "note", "info", "equal to excerpt"), (same("title", "note"), "note", "info", "equal to title"))


def checked(rows: DataFrame, now: Column) -> DataFrame:
    """Adds ``issues`` (field, severity, message) and ``is_valid``: no issue of severity error or critical."""
    listed = F.concat(*field_issues(now).values(), cross_issues())
    out = rows.withColumn("issues", listed)
    return out.withColumn("is_valid", ~F.exists("issues", lambda i: i["severity"].isin("error", "critical")))


def derived_id(url: Column, title: Column, now: Column) -> Column:
    """auto_ and eight digits of the URL's MD5, else twenty characters of the title, else the seconds of the clock."""
    slug = F.left(F.regexp_replace(F.lower(title), "[^a-zA-Z0-9_-]", "_"), F.lit(20))
    by_url = F.when(F.coalesce(url, F.lit("")) != "", F.left(F.md5(url.cast("binary")), F.lit(8)))
    return F.concat(F.lit("auto_"), F.coalesce(by_url, F.when(F.coalesce(title, F.lit("")) != "", slug), F.unix_timestamp(now).cast("string")))


def derived_title(url: Column, note: Column, excerpt: Column) -> Column:
    """The domain in title case, else the note's first line (over three characters), else the excerpt's start, else a placeholder."""
    line = F.left(text.strip(F.element_at(F.split(note, "\n"), 1)), F.lit(100))
    return F.coalesce(
        F.when(F.coalesce(urls.domain(url), F.lit("")) != "", text.title_case(urls.domain(url))), F.when((F.length(note) > 5) & (F.length(line) > 3), line),
        F.when(F.length(excerpt) > 5, text.strip(F.left(excerpt, F.lit(100)))), F.lit("Untitled Bookmark"),
    )


def sanitised(c: Column, kind: str) -> Column:
    """A malformed value as its type can have it: text without control characters, URL with a scheme, list without blanks, date, flag."""
    if kind == "url":
        return urls.clean_url(F.regexp_replace(c, r"[\x00-\x1F\x7F]", ""))
    if kind == "tags":
        return F.array_join(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,;|]"), text.strip), lambda t: t != "")), ", ")
    if kind == "datetime":
        return F.date_format(text.parse_time(c), "yyyy-MM-dd'T'HH:mm:ss")
    if kind == "boolean":
        return F.when(text.parse_bool(c), "true").otherwise("false")
    return text.strip(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), r"[ \t]+", " "))


def recovered(rows: DataFrame, now: Column) -> DataFrame:
    """Fills what can be: id from URL, title or clock, title from host, note or excerpt, folder slashes, date; adds ``recovery`` messages."""
    said = lambda c: text.blank_to_null(F.col(c))
    url = urls.clean_url(F.col("url"))
    title = F.coalesce(said("title"), derived_title(url, F.col("note"), F.col("excerpt")))
    steps = {"id": said("id").isNull(), "title": said("title").isNull(), "url": F.col("url") != url, "created": (said("created").isNotNull()) & text.parse_time(F.col("created")).isNull()}
    messages = F.filter(F.array(*[F.when(c, F.lit(f"{f} recovered")) for f, c in steps.items()]), lambda m: m.isNotNull())
    out = rows.withColumn("recovery", messages)
    return out.withColumns(
        {
            "id": F.coalesce(said("id"), derived_id(url, F.col("title"), now)), "title": title, "url": url,
            "folder": F.regexp_replace(F.regexp_replace(F.coalesce("folder", F.lit("")), r"\\", "/"), "/{2,}", "/"),
            "created": F.coalesce(text.parse_time(F.col("created")), now),
        }
    )


def encoding_issues(c: Column) -> Column:
    """Kinds of damage in a text: replacement characters, UTF-8 read as Latin-1, control characters."""
    kinds = [(c.contains("�"), "replacement"), (c.rlike("Ã[\\x{80}-\\x{BF}]|â€"), "mojibake"), (c.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), "control")]
    return F.filter(F.array(*[F.when(cond, F.lit(kind)) for cond, kind in kinds]), lambda k: k.isNotNull())


#: Marks of a cut text anywhere, and its ends: fixed values.
CUT_MARKS = ("...", "\u2026", "[truncated]", "[cut off]", "(more)", ">>")
CUT_ENDS = (",", ";", "and", "or", "but", "the", "a", "an")


def truncated(c: Column) -> Column:
    """Whether a text looks cut off: a mark of it anywhere, or an end within a sentence."""
    low = F.lower(F.coalesce(c, F.lit("")))
    ends = F.exists(F.array(*[F.lit(w) for w in CUT_ENDS]), lambda w: F.endswith(c, w))
    return F.coalesce((low != "") & (text.any_of(low, CUT_MARKS) | ends), F.lit(False))


def corruption(rows: DataFrame, columns: tuple[str, ...]) -> Column:
    """Kinds of damage of a record: a URL as title, a long text as URL, equal long texts in two fields, damaged encodings; sorted."""
    url, title = F.coalesce("url", F.lit("")), F.coalesce("title", F.lit(""))
    said = F.filter(F.array(*[F.struct(F.lit(c).alias("name"), F.lower(text.strip(F.coalesce(c, F.lit("")))).alias("said")) for c in columns]), lambda x: F.length(x["said"]) > 10)
    pairs = F.flatten(F.transform(said, lambda x, i: F.transform(F.filter(F.slice(said, i + 2, F.size(said)), lambda y: y["said"] == x["said"]), lambda y: F.concat(F.lit("identical "), x["name"], F.lit(" and "), y["name"]))))
    web = lambda c: c.startswith("http://") | c.startswith("https://")
    flags = F.filter(F.array(F.when(web(title), "url in title"), F.when((url != "") & ~web(url) & (F.length(url) > 50), "text in url")), lambda x: x.isNotNull())
    damaged = [F.transform(encoding_issues(F.coalesce(c, F.lit(""))), lambda k, c=c: F.concat(F.lit(f"{c}: "), k)) for c in ("title", "note", "excerpt", "folder")]
    return F.array_sort(F.concat(flags, pairs, *damaged))


def string_ok(c: Column, required: bool = False, least: int | None = None, most: int | None = None, pattern: str | None = None, allowed: list[str] | None = None) -> Column:
    """Whether a text passes; null passes unless required."""
    ok = F.lit(True)
    bare = text.strip(c)
    if least is not None:
        ok = ok & (F.length(bare) >= least)
    if most is not None:
        ok = ok & (F.length(bare) <= most)
    if pattern is not None:
        ok = ok & bare.rlike(pattern)
    if allowed is not None:
        ok = ok & bare.isin(*allowed)
    return F.when(c.isNull(), F.lit(not required)).otherwise(ok & ((bare != "") if required else F.lit(True)))


def number_ok(c: Column, least: float | None = None, most: float | None = None, whole: bool = False) -> Column:
    value = c.try_cast("double")
    ok = value.isNotNull()
    if least is not None:
        ok = ok & (value >= least)
    if most is not None:
        ok = ok & (value <= most)
    return F.coalesce(ok & (value == F.floor(value)) if whole else ok, F.lit(False))


def datetime_ok(c: Column, required: bool = False, least: str | None = None, most: str | None = None) -> Column:
    """Whether a text is a date that an export may have, within bounds; null and blank pass unless required."""
    value, ok = text.parse_time(c), text.parse_time(c).isNotNull()
    if least is not None:
        ok = ok & (value >= F.lit(least).cast("timestamp"))
    if most is not None:
        ok = ok & (value <= F.lit(most).cast("timestamp"))
    return F.when(F.coalesce(text.strip(c), F.lit("")) == "", F.lit(not required)).otherwise(F.coalesce(ok, F.lit(False)))


def url_ok(c: Column, required: bool = False, schemes: tuple[str, ...] = ("http", "https"), secure: bool = True) -> Column:
    """Whether a text is a URL of an allowed scheme that is safe to ask for; null and blank pass unless required."""
    bare = text.strip(c)
    ok = urls.well_formed(bare) & urls.scheme(bare).isin(*schemes)
    if secure:
        ok = ok & urls.security(bare)["is_safe"]
    return F.when(F.coalesce(bare, F.lit("")) == "", F.lit(not required)).otherwise(F.coalesce(ok, F.lit(False)))


def chained(*checks: tuple[str, Column], stop_on_error: bool = False) -> Column:
    """Names of the checks (name, passes) that fail, in order; the first one only where the chain stops."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks]), lambda x: x.isNotNull())
    return F.slice(failed, 1, 1) if stop_on_error else failed


def list_ok(c: Column, least: int = 0, most: int | None = None, unique: bool = False, each=None) -> Column:
    ok = F.size(c) >= least
    if most is not None:
        ok = ok & (F.size(c) <= most)
    if unique:
        ok = ok & (F.size(F.array_distinct(c)) == F.size(c))
    return F.coalesce(ok & (F.forall(c, each) if each else F.lit(True)), F.lit(False))


def paywall(url: Column, body: Column) -> Column:
    """Confidence that a page is behind a paywall; 0.7 and more counts as one."""
    hosts = F.array_intersect(urls.host_suffixes(urls.host(url)), F.array(*[F.lit(h) for h in D.PAYWALL_HOSTS]))
    n = F.lit(0)
    for pattern in D.PAYWALL_PATTERNS:
        n = n + F.coalesce(body, F.lit("")).rlike(f"(?i){pattern}").cast("int")
    by_host = F.size(hosts) > 0
    around = url.rlike("(?i)" + "|".join(D.PAYWALL_BYPASS))
    return F.when(around, 0.0).when(by_host & (n > 0), 0.95).when(n > 0, F.least(F.lit(0.95), n * 0.15 + 0.5)).when(by_host, 0.7).otherwise(0.0)
