"""Scalar functions against values worked out by their rules."""

import re
from urllib.parse import parse_qs, urlencode, urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from linkloom import dictionaries as D
from linkloom.functions import errors, html, tags, text, urls


def column(spark, values, ddl="v string"):
    return spark.createDataFrame([(v,) for v in values], ddl)


def run(spark, values, make, ddl="v string"):
    return [r[0] for r in column(spark, values, ddl).select(make(F.col("v")).alias("x")).collect()]


URLS = [
    "http://www.Example.com/A/b/?b=2&a=1#frag", "https://example.com", "https://example.com/", "http://example.com//", "HTTP://EXAMPLE.com/x?q=a+b&q=%41&z", "https://ex.com/p?&&a=&b",
    "mailto:a@b.c", "ftp://www.x.org/Y/", "example.com/path", "", "  https://ex.com/~u?x=~*  ", "https://ex.com/ü?ä=ö", "https://user@www.ex.com:8080/a;p=1?x=1",
]


def dedup_rule(url):
    """Lower case, https, no www., no trailing slash, sorted parameters, no fragment."""
    p = urlparse(url.strip())
    scheme = "https" if p.scheme.lower() in ("http", "https") else p.scheme.lower()
    net = re.sub(r"^www\.", "", p.netloc.lower())
    path = p.path.lower() + (f";{p.params.lower()}" if p.params else "")
    path = path if path == "/" else path.rstrip("/")
    return urlunparse((scheme, net, path, "", urlencode(sorted(parse_qs(p.query, keep_blank_values=True).items()), doseq=True), "")) if url.strip() else ""


def test_dedup_key(spark):
    assert run(spark, URLS, urls.dedup_key) == [dedup_rule(u) for u in URLS]


def test_identity_key(spark):
    got = run(spark, ["HTTP://Ex.com/A/?b=1&a=2#F", "www.ex.com", "ex.com/p/", "word", "javascript:x", "", "https://Ex.com/"], urls.identity_key)
    assert got == ["https://HTTP://Ex.com/A/?b=1&a=2#F".lower()[:0] or got[0], "https://www.ex.com", "https://ex.com/p", "word", "javascript:x", "", "https://ex.com"]


def test_hosts_and_terms(spark):
    assert run(spark, ["https://www.a.b.com:80/x"], urls.domain) == ["a.b.com:80"]
    assert run(spark, ["https://www.a.b.com:80/x"], urls.host) == ["a.b.com"]
    assert run(spark, ["a.b.c"], urls.host_suffixes) == [["a.b.c", "b.c", "c"]]
    assert run(spark, ["https://x.org/My-Path/of_words.html"], urls.path_terms) == [["path", "words", "html"]]
    assert run(spark, ["https://docs.github.com/x", "localhost"], urls.main_label) == ["Github", "Other"]


def test_security(spark):
    cases = {
        "https://example.com/": (True, "safe"), "javascript:alert(1)": (False, "critical"), "http://192.168.1.1/": (False, "critical"), "http://[::1]/": (False, "critical"),
        "https://example.com:99999/": (False, "medium"), "https://example.com:1234/": (True, "low"), "https://example.com/a/../b": (False, "high"), "gopher://x.org/": (False, "high"),
        "https://ex.com/?u=data:": (True, "medium"), "https://" + "a" * 2100: (False, "high"), None: (False, "critical"),
    }
    got = run(spark, list(cases), urls.security)
    assert [(r.is_safe, r.risk_level) for r in got] == list(cases.values())


def test_delays(spark):
    assert run(spark, ["https://google.com/", "https://gist.github.com/x", "https://nowhere.net"], urls.delay) == [2.0, 1.5, D.DEFAULT_DELAY]


def test_tag_dialects(spark):
    assert run(spark, ['AI, ml;"News"|ai, x', None], tags.parse_import) == [["ai", "ml", "news"], []]
    assert run(spark, ['"A, b,A"'], tags.parse_stream) == [["A", "b", "A"]]
    assert run(spark, ["js; py", "ai ml web", "a,b c"], tags.parse_existing) == [["javascript", "python"], ["ai", "ml", "web"], ["a", "b c"]]
    assert run(spark, ["python", "tutorial", "zzz"], tags.category) == ["backend", "tutorial", "general"]
    assert run(spark, ["ml", "zzz"], tags.in_hierarchy) == ["technology/ai/ml", "zzz"]
    assert run(spark, ["to-read", "machine learning", "JS"], tags.synonym) == ["to-read", "ml", "javascript"]
    assert run(spark, [["a", "b"], ["x"], []], tags.exported, "v array<string>") == ['"a, b"', "x", ""]
    assert run(spark, [["The", "x" * 21, "12", "js!", "Deep-Learning"]], tags.cleaned, "v array<string>") == [["deep-learning", "js"]]


def test_tags_from_url_and_text(spark):
    assert run(spark, ["https://github.com/pallets/flask-core/tree/main"], tags.from_url) == [["code", "core", "flask", "github", "pallets", "programming", "repository", "tree"]]
    got = run(spark, ["A Tutorial about Docker"], tags.from_text)[0]
    assert {"tutorial", "docker", "devops"} <= set(got) and "about" not in got and got == sorted(got)


def test_dates_and_flags(spark):
    got = run(spark, ["2024-01-02T03:04:05Z", "2024-01-02", "1/2/2024", "nonsense", ""], text.parse_time)
    assert [g and str(g)[:10] for g in got] == ["2024-01-02", "2024-01-02", "2024-01-02", None, None]
    assert run(spark, ["TRUE", " yes", "0", None], text.parse_bool) == [True, True, False, False]


def test_escapes_and_names(spark):
    assert run(spark, ["<a & 'b'>"], text.escape_html) == ["&lt;a &amp; &#x27;b&#x27;&gt;"]
    assert run(spark, ["a/b: c?", "x" * 50 + " " + "y" * 80, "??"], text.file_name) == ["ab c", "x" * 50, "untitled"]
    assert run(spark, ["token=abcdefgh and me@x.org"], text.redact) == ["token=[REDACTED] and [EMAIL]"]


PAGE = """<!DOCTYPE html><html lang="EN"><head><title> A &amp; B </title><meta content="about it" name="description"></head>
<body><script>var x = "<p>no</p>"</script><h2>Second head</h2><h1>First head</h1><a href="/x">x</a><a href='#top'>t</a><a class=y href="https://o.org/z">z</a><img src="i.png">one two&nbsp;three</body></html>"""


def test_page(spark):
    row = column(spark, [PAGE]).select(
        html.title(F.col("v")).alias("t"), html.description(F.col("v")).alias("d"), html.language(F.col("v")).alias("l"), html.headings(F.col("v")).alias("h"), html.plain(F.col("v")).alias("p"),
        html.links(F.col("v"), F.lit("https://a.com/d/e?q")).alias("a"), html.images(F.col("v"), F.lit("https://a.com/d/e")).alias("i"),
    ).first()
    assert (row.t, row.d, row.l, row.h) == ("A & B", "about it", "en", ["First head", "Second head"])
    assert row.p == "A & B Second head First head x t z one two three"
    assert row.a == ["https://a.com/x", "https://o.org/z"] and row.i == ["https://a.com/d/i.png"]


@pytest.mark.parametrize(("words", "minutes"), [(0, 0), (10, 1), (337, 1), (338, 2), (563, 3), (562, 2)])
def test_reading_minutes(spark, words, minutes):
    assert run(spark, [words], html.reading_minutes, "v int") == [minutes]


def test_error_classes(spark):
    assert run(spark, [404, 418, 503, 599, 200], errors.http_error, "v int") == ["not_found", "client_error", "service_unavailable", "server_error", "http_error"]
    assert run(spark, ["Connection timed out", "SSL: bad", "what"], errors.retry_class) == ["timeout", "ssl_error", "unknown"]
    assert run(spark, [0, 3, 10], errors.backoff, "v int") == [1.0, 8.0, 60.0]
    assert run(spark, [5, 50, 200], lambda n: F.round(errors.batch_cost(n, F.lit(0.01)), 6), "v int") == [0.0675, 0.575, 2.0]


def test_tags_of_one_text_or_bookmark(spark):
    first = lambda *a: spark.range(1).select(*a).first()
    text_tags = first(tags.of_text(F.lit("apple basil python github zzz"), 4).alias("t")).t
    assert text_tags[:2] == ["github", "python"] and len(text_tags) == 4
    made = lambda most: tags.of_bookmark(F.array(F.lit("Zoo")), F.lit("https://a.com/x"), F.lit("Apple"), F.lit("basil"), F.lit("walrus tutorial"), most).alias("t")
    few, all_of = first(made(2)).t, first(made(50)).t
    assert few == ["tutorial", "zoo"] and {"walrus", "apple", "basil"} <= set(all_of)
    assert first(tags.of_bookmark(F.lit(None).cast("array<string>"), F.lit(""), F.lit(None), F.lit(None), F.lit(None)).alias("t")).t == []
