"""URL columns by regular expressions that engines agree on; no parsing that raises on bad URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dictionaries as D
from . import text

#: scheme, authority, path, query, fragment.
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
FORMAT = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+"


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, PARTS, n)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def authority(url: Column) -> Column:
    return part(url, 2)


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def fragment(url: Column) -> Column:
    return part(url, 5)


def domain(url: Column) -> Column:
    """The authority in lower case without a leading www."""
    return F.regexp_replace(F.lower(authority(url)), r"^www\.", "")


def host(url: Column) -> Column:
    """The domain without a port."""
    return F.element_at(F.split(domain(url), ":"), 1)


def host_suffixes(h: Column) -> Column:
    """a.b.c as [a.b.c, b.c, c], so that suffix matches are equality."""
    labels = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def _encoded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def sorted_query(q: Column) -> Column:
    """Parameters grouped and sorted by decoded name, values of one name in their order, encoded again; empty pieces go."""
    pieces = F.filter(F.split(q, "&"), lambda p: p != "")
    pairs = F.transform(
        pieces,
        lambda p, i: F.struct(
            _decoded(F.regexp_extract(p, r"^([^=]*)", 1)).alias("name"), i.alias("at"), _decoded(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("value")
        ),
    )
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(_encoded(p["name"]), F.lit("="), _encoded(p["value"]))), "&")


def _query_suffix(url: Column) -> Column:
    q = sorted_query(query(url))
    return F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q))


def dedup_key(url: Column) -> Column:
    """The key under which URLs count as duplicates; empty for an empty URL."""
    url = text.strip(F.coalesce(url, F.lit("")))
    s = scheme(url)
    s = F.when(s.isin("http", "https"), "https").otherwise(s)
    p = F.lower(path(url))
    p = F.when(p == "/", p).otherwise(F.regexp_replace(p, r"/+$", ""))
    start = F.when(s != "", F.concat(s, F.lit(":"))).otherwise(F.lit(""))
    net = domain(url)
    middle = F.when(net != "", F.concat(F.lit("//"), net)).otherwise(F.lit(""))
    return F.when(url == "", F.lit("")).otherwise(F.concat(start, middle, p, _query_suffix(url)))


def identity_key(url: Column) -> Column:
    """The normalised URL that identifies a row: scheme and path case kept, fragment kept."""
    raw = text.strip(F.coalesce(url, F.lit("")))
    special = raw.rlike(r"^(javascript:|data:|mailto:|ftp:|file:)")
    full = F.when(raw.rlike("^https?://"), raw).when(raw.startswith("www.") | raw.contains("."), F.concat(F.lit("https://"), raw))
    f = fragment(full)
    normal = F.concat(
        scheme(full), F.lit("://"), F.lower(authority(full)), F.regexp_replace(path(full), r"/+$", ""), _query_suffix(full),
        F.when(f != "", F.concat(F.lit("#"), f)).otherwise(F.lit("")),
    )
    return F.when(raw == "", F.lit("")).when(special | full.isNull(), raw).otherwise(normal)


def well_formed(url: Column) -> Column:
    return F.coalesce(url.rlike(FORMAT), F.lit(False))


def skipped(url: Column) -> Column:
    """URLs that are not fetched: other schemes, anchors, blank pages."""
    low = F.lower(text.strip(F.coalesce(url, F.lit(""))))
    found = low == ""
    for prefix in D.SKIPPED_PREFIXES:
        found = found | low.startswith(prefix)
    return found


def clean_url(c: Column) -> Column:
    """Without white space; https:// where no scheme is given."""
    raw = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    return F.when(raw == "", raw).when(raw.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), raw).otherwise(F.concat(F.lit("https://"), raw))


def main_label(url: Column) -> Column:
    """The second label from the end of the host, title-cased; Other without one."""
    labels = F.split(host(url), r"\.")
    return F.when(F.size(labels) >= 2, F.initcap(F.element_at(labels, -2))).otherwise(F.lit("Other"))


def path_terms(url: Column) -> Column:
    """Words of the path with three letters or more, lower case."""
    return F.filter(F.split(F.lower(path(url)), r"[/\-_.]"), lambda t: F.length(t) >= 3)


def mock_valid(url: Column) -> Column:
    """The offline rule for a check: no word of failure in the URL."""
    return ~F.lower(url).rlike("invalid|404|error|timeout")


def delay(url: Column) -> Column:
    """Seconds between requests to the URL's host: its own entry, else that of the longest listed suffix, else the default."""
    h = F.lower(F.element_at(F.split(authority(url), ":"), 1))
    table = F.create_map(*[F.lit(x) for kv in D.SITE_DELAYS.items() for x in kv])
    known = F.filter(F.transform(host_suffixes(h), lambda s: F.element_at(table, s)), lambda d: d.isNotNull())
    return F.when(F.size(known) > 0, F.element_at(known, 1)).otherwise(F.lit(D.DEFAULT_DELAY))


def _private(h: Column) -> Column:
    """IPv4 addresses of private, loopback, link-local, multicast and reserved ranges, and such IPv6 addresses."""
    octets = F.split(F.regexp_extract(h, r"^(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})$", 1), r"\.")
    value = F.aggregate(octets, F.lit(0).cast("long"), lambda n, o: n * 256 + F.coalesce(o.try_cast("long"), F.lit(0)))

    def listed(v: Column) -> Column:
        inside = F.lit(False)
        for block in D.PRIVATE_RANGES:
            base, bits = block.split("/")
            low = sum(int(x) << s for x, s in zip(base.split("."), (24, 16, 8, 0), strict=True))
            inside = inside | v.between(low, low + 2 ** (32 - int(bits)) - 1)
        return inside

    six = F.regexp_extract(h, r"^\[?([0-9a-f:]*:[0-9a-f:]*)\]?$", 1)
    return F.exists(F.array(value), listed) | (six == "::1") | six.rlike("^f[cd]") | six.rlike("^fe[89ab]")


def _verdict(u: Column) -> Column:
    """The security of a URL taken apart: struct(raw, scheme, net, path, query)."""
    raw, s, net, p, q = (u[c] for c in ("raw", "scheme", "net", "path", "query"))
    h = F.regexp_replace(net, r":\d*$", "")
    port = F.regexp_extract(net, r":(\d+)$", 1).try_cast("int")
    hits = F.lit(0)
    for pattern in D.SUSPICIOUS_PATTERNS:
        hits = hits + raw.rlike(f"(?i){pattern}").cast("int")
    rules = [
        (raw == "", "critical", "empty"),
        (F.length(raw) > D.MAX_URL_LENGTH, "high", "length"),
        (s == "", "high", "no scheme"),
        (s.isin(*D.BLOCKED_SCHEMES), "critical", "scheme"),
        (~s.isin("http", "https"), "high", "scheme"),
        (h == "", "high", "no host"),
        (h.isin(*D.BLOCKED_HOSTS), "critical", "host"),
        (_private(h), "critical", "private address"),
        (~h.rlike(r"^[a-z0-9]([a-z0-9\-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9\-]*[a-z0-9])?)*\.?$") & ~h.contains(":"), "medium", "host format"),
        (F.coalesce(~port.between(1, 65535), F.lit(False)), "medium", "port"),
        (p.contains("../") | p.contains("..\\"), "high", "path traversal"),
        (p.contains("\x00") | p.contains("%00"), "high", "null byte"),
        (F.size(F.split(q, "&")) > D.MAX_QUERY_PARAMS, "medium", "parameters"),
        (q.contains("\x00") | q.contains("%00"), "high", "null byte"),
        (hits > 2, "high", "patterns"),
    ]
    level = F.when(hits >= 1, "medium").when(F.coalesce(~port.isin(*D.ORDINARY_PORTS), F.lit(False)), "low").otherwise("safe")
    blocked = [F.when(c, F.struct(F.lit(False).alias("is_safe"), F.lit(risk).alias("risk_level"), F.lit(reason).alias("reason"))) for c, risk, reason in rules]
    return F.coalesce(*blocked, F.struct(F.lit(True).alias("is_safe"), level.alias("risk_level"), F.lit("").alias("reason")))


def security(url: Column) -> Column:
    """struct(is_safe, risk_level, reason) of a URL; the first rule that blocks decides. Names are not resolved.

    The parts are bound once by a one-element array; spelled out in every rule they would outgrow generated code.
    """
    raw = F.coalesce(url, F.lit(""))
    net = F.regexp_replace(F.lower(authority(raw)), r"^[^@]*@", "")
    parts = F.struct(raw.alias("raw"), scheme(raw).alias("scheme"), net.alias("net"), path(raw).alias("path"), query(raw).alias("query"))
    return F.element_at(F.transform(F.array(parts), _verdict), 1)


def sanitized(url: Column) -> Column:
    """https, host in lower case without a user, path without traversal; the query stays, the fragment goes."""
    raw = text.strip(F.coalesce(url, F.lit("")))
    net = F.regexp_replace(F.lower(authority(raw)), r"^[^@]*@", "")
    q = query(raw)
    clean_path = F.replace(F.replace(path(raw), F.lit("../"), F.lit("")), F.lit("..\\"), F.lit(""))
    return F.when(raw == "", "").otherwise(F.concat(F.lit("https://"), net, clean_path, F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))
