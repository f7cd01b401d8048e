"""All registered queries over the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import errors, html, tags, text, urls
from ..operators import bookmarks as B
from ..operators import dedup, folders, metrics, predicates, reports, search, state, tagging, validation
from .registry import ORACLES, QUERIES, query
from .registry import sql_list as _list
from .tables import SQL_BOOKMARKS, SQL_DOMAIN, SQL_KEY, SQL_PATH, SQL_TITLE, bookmarks, keyed, scratch, table

NOW = "2024-06-01 00:00:00"


def _now() -> Column:
    return F.lit(NOW).cast("timestamp")


def _joined(c: Column) -> Column:
    return F.array_join(F.array_sort(c), ",")


def _contains(c: str, words, weight: str = "1") -> str:
    return " + ".join(f"(CASE WHEN contains({c}, '{w}') THEN {weight} ELSE 0 END)" for w in words)


# Flagship: hosts by pages and by distinct pages.
@query(
    "flagship",
    f"""SELECT {SQL_DOMAIN} AS host, count(*) AS n_pages, count(DISTINCT {SQL_KEY}) AS n_unique, count(*) FILTER (trim({SQL_TITLE}) <> '') AS n_titled, min(page_id) AS first_page_id
    FROM pages GROUP BY 1 ORDER BY n_pages DESC, host LIMIT 20""",
)
def flagship(spark, d):
    rows = table(spark, d, "pages").select("page_id", urls.domain(F.col("url")).alias("host"), urls.dedup_key(F.col("url")).alias("key"), html.title(F.col("html")).alias("title"))
    told = rows.groupBy("host").agg(F.count("*").alias("n_pages"), F.count_distinct("key").alias("n_unique"), F.count_if(F.col("title") != "").alias("n_titled"), F.min("page_id").alias("first_page_id"))
    return told.orderBy(F.desc("n_pages"), "host").limit(20)


# URL functions.
@query("url_domain", f"SELECT page_id, {SQL_DOMAIN} AS domain, regexp_extract({SQL_DOMAIN}, '^[^:]*') AS host FROM pages")
def url_domain(spark, d):
    return table(spark, d, "pages").select("page_id", urls.domain(F.col("url")).alias("domain"), urls.host(F.col("url")).alias("host"))


@query("url_dedup_key", f"SELECT page_id, {SQL_KEY} AS dedup_key FROM pages")
def url_dedup_key(spark, d):
    return table(spark, d, "pages").select("page_id", urls.dedup_key(F.col("url")).alias("dedup_key"))


@query(
    "url_identity_key",
    rf"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) || regexp_replace({SQL_PATH}, '/+$', '')
    || CASE WHEN contains(url, '?') THEN '?' || array_to_string(list_sort(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')), '&') ELSE '' END || regexp_extract(url, '(#.*)$', 1) AS identity_key FROM pages""",
)
def url_identity_key(spark, d):
    return table(spark, d, "pages").select("page_id", urls.identity_key(F.col("url")).alias("identity_key"))


@query(
    "url_tags",
    rf"""WITH p AS (SELECT page_id, {SQL_DOMAIN} AS host, list_filter(string_split(lower({SQL_PATH}), '/'), lambda x: x <> '')[1:3] AS parts FROM pages),
    w AS (SELECT page_id, list_concat(
      {' '.join(f"CASE WHEN contains(host, '{h}') THEN [{_list(ws)}] ELSE" for h, ws in D.PLATFORM_TAGS.items())} [] {'END ' * len(D.PLATFORM_TAGS)},
      list_concat(flatten(list_transform(list_filter(parts, lambda x: len(x) > 2), lambda x: CASE WHEN contains(x, '-') THEN list_filter(string_split(x, '-'), lambda y: regexp_full_match(y, '\p{{L}}{{2,}}')) WHEN regexp_full_match(x, '\p{{L}}+') THEN [x] ELSE [] END)),
      list_filter(string_split(host, '.'), lambda x: len(x) > 2 AND x NOT IN ({_list(D.HOST_PARTS_IGNORED)})))) AS ts FROM p)
    SELECT page_id, array_to_string(list_sort(list_distinct(ts)), ',') AS tags FROM w""",
)
def url_tags(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(tags.from_url(F.col("url")), ",").alias("tags"))


@query("url_path_terms", rf"SELECT page_id, array_to_string(list_sort(list_filter(regexp_split_to_array(lower({SQL_PATH}), '[/\-_.]'), lambda t: len(t) >= 3)), ',') AS terms FROM pages")
def url_path_terms(spark, d):
    return table(spark, d, "pages").select("page_id", _joined(urls.path_terms(F.col("url"))).alias("terms"))


@query(
    "url_checks",
    rf"""SELECT page_id, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+') AS well_formed, regexp_matches(lower(trim(url)), '^(javascript:|mailto:|tel:|ftp:|file:|data:|#|about:blank)') AS skipped,
    NOT regexp_matches(lower(url), 'invalid|404|error|timeout') AS mock_valid FROM pages""",
)
def url_checks(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.well_formed(u).alias("well_formed"), urls.skipped(u).alias("skipped"), urls.mock_valid(u).alias("mock_valid"))


# Pages.
@query("html_title", f"SELECT page_id, {SQL_TITLE} AS title FROM pages")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query("html_language", r"""SELECT page_id, lower(regexp_extract(html, '(?is)<html[^>]*\slang\s*=\s*["'']?([A-Za-z\-]+)', 1)) AS language FROM pages""")
def html_language(spark, d):
    return table(spark, d, "pages").select("page_id", html.language(F.col("html")).alias("language"))


_PLAIN = r"regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<noscript\b[^>]*>.*?</noscript>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '" + '"' + r"'), '&#39;', ''''), '&amp;', '&'), '[\s\x{A0}]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query("html_words", f"SELECT page_id, n AS words, CASE WHEN n = 0 THEN 0 ELSE greatest(1, round_even(n / 225.0, 0)::INT) END AS minutes FROM (SELECT page_id, CASE WHEN p = '' THEN 0 ELSE len(string_split(p, ' ')) END::INT AS n FROM (SELECT page_id, {_PLAIN} AS p FROM pages))")
def html_words(spark, d):
    words = html.word_count(html.plain(F.col("html")))
    return table(spark, d, "pages").select("page_id", words.alias("words")).withColumn("minutes", html.reading_minutes(F.col("words")))


@query(
    "page_categories",
    "WITH p AS (SELECT page_id, lower(url) AS u, lower(" + SQL_TITLE + ") AS t FROM pages), s AS ("
    + " UNION ALL ".join(f"SELECT page_id, '{name}' AS name, 2.0 * ({_contains('u', ws)}) + ({_contains('t', ws)}) AS score FROM p" for name, ws in D.CONTENT_CATEGORIES.items())
    + ") SELECT p.page_id, coalesce(string_agg(name, ',' ORDER BY name), '') AS categories FROM p LEFT JOIN s ON s.page_id = p.page_id AND score >= 1 GROUP BY p.page_id",
)
def page_categories(spark, d):
    return table(spark, d, "pages").select("page_id", _joined(html.categories(F.col("url"), html.title(F.col("html")), F.lit(""))).alias("categories"))


# Predicates.
def _kept(spark, d, p: predicates.Predicate) -> DataFrame:
    return p.apply(bookmarks(spark, d)).select("pos", "url")


def _where(sql: str) -> str:
    return f"WITH {SQL_BOOKMARKS} SELECT pos, url FROM b WHERE {sql}"


FILTERS = {
    "filter_folder_glob": (lambda: predicates.folder("dev*/p?thon"), "regexp_full_match(lower(folder), 'dev.*/p.thon')"),
    "filter_tag_any": (lambda: predicates.tag(["Python", "ai"]), "list_has_any(tags, ['python', 'ai'])"),
    "filter_tag_all": (lambda: predicates.tag(["news", "ai"], "all"), "list_has_all(tags, ['news', 'ai'])"),
    "filter_date_range": (lambda: predicates.created_range("2024-02-01:2024-03-15"), "created >= TIMESTAMP '2024-02-01' AND created < TIMESTAMP '2024-03-16'"),
    "filter_domain": (lambda: predicates.domain(["example.org"]), f"regexp_extract({SQL_DOMAIN}, '^[^:]*') = 'example.org' OR ends_with(regexp_extract({SQL_DOMAIN}, '^[^:]*'), '.example.org')"),
    "filter_url_regex": (lambda: predicates.url_matches("BLOG\\."), "regexp_matches(url, '(?i)BLOG\\.')"),
    "filter_and": (lambda: predicates.tag(["python"]) & predicates.created_range(":2024-03-01"), "list_contains(tags, 'python') AND created < TIMESTAMP '2024-03-02'"),
    "filter_or": (lambda: predicates.tag(["video"]) | predicates.folder("News*"), "list_contains(tags, 'video') OR starts_with(lower(folder), 'news')"),
    "filter_not": (lambda: ~predicates.created_range("2024-02-01:"), "NOT coalesce(created >= TIMESTAMP '2024-02-01', false)"),
    "filter_chain": (lambda: predicates.from_options({"filter_tag": "python,web", "filter_domain": "example.com"}), f"list_has_any(tags, ['python', 'web']) AND (regexp_extract({SQL_DOMAIN}, '^[^:]*') = 'example.com' OR ends_with(regexp_extract({SQL_DOMAIN}, '^[^:]*'), '.example.com'))"),
}
for _name, (_make, _sql) in FILTERS.items():
    query(_name, _where(_sql))(lambda spark, d, make=_make: _kept(spark, d, make()))


# Projections.
@query("effective_title", f"WITH {SQL_BOOKMARKS} SELECT pos, CASE WHEN pos % 2 = 0 OR trim(title) = '' THEN regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) ELSE title END AS shown FROM b")
def effective_title(spark, d):
    rows = bookmarks(spark, d).withColumn("title", F.when(F.col("pos") % 2 == 0, " ").otherwise(F.col("title")))
    return rows.select("pos", B.effective_title(F.col("title"), F.col("url")).alias("shown"))


@query("import_rows", f"""WITH {SQL_BOOKMARKS} SELECT url, folder, CASE WHEN trim(title) = '' THEN regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) ELSE title END AS title, note,
    CASE len(tags) WHEN 0 THEN '' WHEN 1 THEN tags[1] ELSE '"' || array_to_string(tags, ', ') || '"' END AS tags, coalesce(strftime(created, '%Y-%m-%dT%H:%M:%SZ'), '') AS created FROM b""")
def import_rows(spark, d):
    return B.import_row(bookmarks(spark, d))


@query("prompt_text", f"WITH {SQL_BOOKMARKS} SELECT pos, concat_ws(' | ', CASE WHEN trim(title) <> '' THEN 'Title: ' || title END, CASE WHEN trim(note) <> '' THEN 'Note: ' || note END, CASE WHEN excerpt <> '' THEN 'Excerpt: ' || excerpt END, 'Domain: ' || {SQL_DOMAIN}) AS prompt FROM b")
def prompt_text(spark, d):
    return bookmarks(spark, d).select("pos", B.prompt(F.col("title"), F.col("note"), F.col("excerpt"), F.col("url")).alias("prompt"))


@query("proposed_changes", f"""WITH {SQL_BOOKMARKS}, p AS (SELECT pos, note, folder, tags, CASE WHEN pos % 2 = 0 THEN note ELSE 'new' END AS new_note, CASE WHEN pos % 3 = 0 THEN list_append(tags, 'extra') ELSE list_reverse(tags) END AS new_tags, 'Development' AS new_folder FROM b)
    SELECT pos, new_note <> note AS has_description_change, list_sort(list_distinct(new_tags)) <> list_sort(list_distinct(tags)) AS has_tags_change, new_folder <> folder AS has_folder_change,
    round(CASE WHEN new_note <> note THEN 0.5 ELSE 1 END * 0.4 + CASE WHEN list_sort(list_distinct(new_tags)) <> list_sort(list_distinct(tags)) THEN 0.6 ELSE 1 END * 0.3 + CASE WHEN new_folder <> folder THEN 0.7 ELSE 1 END * 0.3, 6)::DOUBLE AS confidence FROM p""")
def proposed_changes(spark, d):
    rows = bookmarks(spark, d).withColumns({"new_note": F.when(F.col("pos") % 2 == 0, F.col("note")).otherwise("new"), "new_tags": F.when(F.col("pos") % 3 == 0, F.array_append("tags", F.lit("extra"))).otherwise(F.reverse("tags")), "new_folder": F.lit("Development"), "note_confidence": F.lit(0.5), "tags_confidence": F.lit(0.6), "folder_confidence": F.lit(0.7)})
    return B.proposed_changes(rows).select("pos", "has_description_change", "has_tags_change", "has_folder_change", "confidence")


# Duplicates.
@query("dedup_groups", f"WITH {SQL_BOOKMARKS} SELECT dedup_key, count(*) AS members, min(pos) AS first_pos FROM k GROUP BY 1 HAVING count(*) > 1")
def dedup_groups(spark, d):
    return dedup.groups(keyed(spark, d))


_COMPLETE = "(CASE WHEN trim(title) <> '' THEN 2 ELSE 0 END + CASE WHEN note <> '' THEN 3 ELSE 0 END + CASE WHEN excerpt <> '' THEN 1 ELSE 0 END + CASE WHEN len(tags) > 0 THEN 2 ELSE 0 END + CASE WHEN folder NOT IN ('', '/') THEN 1 ELSE 0 END + CASE WHEN created IS NOT NULL THEN 1 ELSE 0 END)"
_GOOD = f"(CASE WHEN trim(title) <> '' THEN 2 ELSE 0 END + CASE WHEN note <> '' THEN 4 ELSE 0 END + CASE WHEN len(tags) > 0 THEN 2 ELSE 0 END + CASE WHEN len(note) > 50 THEN 2 ELSE 0 END + CASE WHEN len(tags) > 3 THEN 1 ELSE 0 END + CASE WHEN contains(folder, '/') AND folder <> '/' THEN 1 ELSE 0 END + CASE WHEN date_diff('day', created::DATE, DATE '{NOW[:10]}') < 30 THEN 2 WHEN date_diff('day', created::DATE, DATE '{NOW[:10]}') < 90 THEN 1 ELSE 0 END)"
_ORDERS = {
    "newest": "(pos = min(pos) OVER (PARTITION BY dedup_key) AND created IS NULL) DESC, created DESC NULLS LAST, pos",
    "oldest": "(pos = min(pos) OVER (PARTITION BY dedup_key) AND created IS NULL) DESC, created ASC NULLS LAST, pos",
    "most_complete": f"{_COMPLETE} DESC, pos",
    "highest_quality": f"{_GOOD} DESC, pos DESC",
}


def _few_keys(spark, d) -> DataFrame:
    """Keys shared by many rows, so that every strategy has something to choose."""
    return bookmarks(spark, d).withColumn("dedup_key", F.concat(F.lit("k"), (F.col("pos") % 40).cast("string")))


for _strategy, _order in _ORDERS.items():
    query(
        f"dedup_{_strategy}",
        f"WITH {SQL_BOOKMARKS}, f AS (SELECT * REPLACE ('k' || (pos % 40) AS dedup_key), pos = min(pos) OVER (PARTITION BY pos % 40) AS first_row FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY {_order.replace('pos = min(pos) OVER (PARTITION BY dedup_key)', 'first_row')}) AS n FROM f) SELECT pos, dedup_key FROM r WHERE n = 1",
    )(lambda spark, d, s=_strategy: dedup.process(_few_keys(spark, d), s, _now()).select("pos", "dedup_key"))


@query("dedup_summary", f"WITH {SQL_BOOKMARKS}, s AS (SELECT dedup_key, count(*) AS n FROM k GROUP BY 1) SELECT sum(n)::BIGINT AS total, count(*) AS unique_rows, count(*) FILTER (n > 1) AS groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicates, (sum(n) - count(*))::BIGINT AS removed FROM s")
def dedup_summary(spark, d):
    return dedup.summary(keyed(spark, d))


# Tags.
_TERMS = "SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9\\-]*[a-z0-9]|[a-z]'), lambda t: len(t) BETWEEN 2 AND 30 AND t NOT IN (" + _list(D.STOP_WORDS) + ")))) AS tag FROM documents"


def _doc_terms(spark, d) -> DataFrame:
    found = F.array_distinct(text.terms(F.col("text"), D.STOP_WORDS))
    return table(spark, d, "documents").select("doc_id", F.explode(found).alias("tag"))


@query("tag_frequency", f"SELECT tag, count(*) AS frequency FROM ({_TERMS}) GROUP BY 1 HAVING count(*) >= 2")
def tag_frequency(spark, d):
    return tagging.frequencies(_doc_terms(spark, d)).where("frequency >= 2")


@query("tag_quality", f"""WITH f AS (SELECT tag, count(*) AS frequency FROM ({_TERMS}) GROUP BY 1 HAVING count(*) >= 2)
    SELECT tag, round((least(1.0, frequency / ((SELECT count(*) FROM documents) * 0.1)) + CASE WHEN len(tag) BETWEEN 3 AND 15 THEN 1.0 ELSE 0.5 END + CASE WHEN regexp_full_match(tag, '[a-z]+') THEN 1.0 ELSE 0.8 END) * CASE WHEN tag IN ({_list(sorted({w for ws in D.TECH_KEYWORDS.values() for w in ws}))}) THEN 1.2 ELSE 1.0 END / 3.2, 6)::DOUBLE AS quality FROM f""")
def tag_quality(spark, d):
    total = F.lit(table(spark, d, "documents").count())
    found = tagging.frequencies(_doc_terms(spark, d)).where("frequency >= 2")
    return found.select("tag", F.round(tagging.tag_quality(F.col("tag"), F.col("frequency"), total), 6).alias("quality"))


@query("tag_top", f"SELECT tag, count(*) AS frequency FROM ({_TERMS}) GROUP BY 1 ORDER BY frequency DESC, tag LIMIT 10")
def tag_top(spark, d):
    return tagging.frequencies(_doc_terms(spark, d)).orderBy(F.desc("frequency"), "tag").limit(10)


@query("tag_cooccurrence", f"WITH {SQL_BOOKMARKS}, t AS (SELECT DISTINCT url, unnest(tags) AS tag FROM b) SELECT x.tag AS a, y.tag AS b, count(*) AS n FROM t x JOIN t y ON x.url = y.url AND x.tag < y.tag GROUP BY 1, 2")
def tag_cooccurrence(spark, d):
    return tagging.cooccurrence(bookmarks(spark, d).select("url", F.explode("tags").alias("tag")).distinct())


@query("tag_coverage", f"WITH {SQL_BOOKMARKS}, t AS (SELECT DISTINCT url, unnest(tags) AS tag FROM b), n AS (SELECT url, count(*) AS n FROM t GROUP BY 1) SELECT round(count(*) / (SELECT count(*) FROM b), 6)::DOUBLE AS coverage, (SELECT count(DISTINCT tag) FROM t) AS unique_tags, round(avg(n), 6) AS avg_tags FROM n")
def tag_coverage(spark, d):
    rows = bookmarks(spark, d)
    told = tagging.coverage(rows.select("url", F.explode("tags").alias("tag")).distinct(), rows.count())
    return told.select(F.round("coverage", 6).alias("coverage"), F.col("unique_tags").cast("long").alias("unique_tags"), F.round("avg_tags", 6).alias("avg_tags"))


@query("tag_forms", f"WITH t AS (SELECT DISTINCT unnest([{_list([*D.TAG_SYNONYMS, *D.TAG_FORMS, *D.PROTECTED_TAGS, 'other'])}]) AS tag) SELECT tag, CASE {' '.join(f'''WHEN tag = '{k}' THEN '{v}' ''' for k, v in D.TAG_SYNONYMS.items() if k not in D.PROTECTED_TAGS)} ELSE tag END AS synonym FROM t")
def tag_forms(spark, d):
    words = sorted({*D.TAG_SYNONYMS, *D.TAG_FORMS, *D.PROTECTED_TAGS, "other"})
    return spark.createDataFrame([(w,) for w in words], "tag string").select("tag", tags.synonym(F.col("tag")).alias("synonym"))


@query("tag_url_score", f"WITH {SQL_BOOKMARKS} SELECT t.tag, round(count(*) FILTER (contains(lower(b.url), t.tag)) / count(*), 6)::DOUBLE AS url_score FROM (SELECT DISTINCT unnest(tags) AS tag FROM b) t, b GROUP BY 1")
def tag_url_score(spark, d):
    rows = bookmarks(spark, d)
    found = rows.select("url", F.explode("tags").alias("tag")).distinct()
    return tagging.scored(found, rows, min_frequency=1).select("tag", F.round("url_score", 6).alias("url_score"))


# Folders.
def _category_sql() -> str:
    parts = []
    for i, (name, spec) in enumerate(D.FOLDER_CATEGORIES.items()):
        subs = [w for ws in spec["subcategories"].values() for w in ws]
        parts.append(f"SELECT pos, '{name.replace(chr(39), chr(39) * 2)}' AS name, {i} AS place, 2 * ({_contains('t', spec['keywords'])}) + CASE WHEN dom IN ({_list(spec['domains'])}) THEN 5 ELSE 0 END + ({_contains('t', subs)}) + CASE WHEN contains(lower(folder), '{name.lower()}') THEN 3 ELSE 0 END AS score FROM x")
    low = "lower(trim(split_part(folder, '/', 1)))"
    match = " ".join(f"WHEN {low} <> '' AND (contains('{n.lower()}', {low}) OR contains({low}, '{n.lower()}')) THEN '{n}'" for n in D.FOLDER_CATEGORIES)
    return f"""WITH {SQL_BOOKMARKS}, x AS (SELECT pos, folder, {SQL_DOMAIN} AS dom, lower(concat_ws(' ', title, note, url)) AS t FROM b), s AS ({' UNION ALL '.join(parts)}),
    m AS (SELECT pos, first(name ORDER BY score DESC, place) AS name, max(score) AS score FROM s GROUP BY pos)
    SELECT x.pos, CASE WHEN m.score > 0 THEN m.name ELSE CASE {match} WHEN len(trim(split_part(folder, '/', 1))) BETWEEN 3 AND 29 THEN CASE trim(split_part(folder, '/', 1)) WHEN 'Reading list' THEN 'Reading List' ELSE trim(split_part(folder, '/', 1)) END ELSE 'Uncategorized' END END AS category FROM x JOIN m USING (pos)"""


@query("folder_category", _category_sql())
def folder_category(spark, d):
    return folders.categorised(bookmarks(spark, d)).select("pos", "category")


@query("folder_tree", f"WITH {SQL_BOOKMARKS}, p AS (SELECT folder AS leaf, unnest([array_to_string(string_split(folder, '/')[1:i], '/') for i in range(1, len(string_split(folder, '/')) + 1)]) AS path FROM b WHERE folder NOT IN ('', '/')) SELECT path, count(*) FILTER (leaf = path) AS own, count(*) AS total, len(string_split(path, '/'))::INT AS depth FROM p GROUP BY path")
def folder_tree(spark, d):
    return folders.tree(bookmarks(spark, d).where("folder <> '/'"), "folder")


@query("folder_learned", f"WITH {SQL_BOOKMARKS}, c AS (SELECT {SQL_DOMAIN} AS domain, split_part(folder, '/', 1) AS folder, count(*) AS hits FROM b WHERE folder <> '' GROUP BY 1, 2 HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY hits DESC, folder) AS n FROM c) SELECT domain, folder, hits FROM r WHERE n = 1")
def folder_learned(spark, d):
    return folders.learned(bookmarks(spark, d))


@query("folder_cut", f"WITH {SQL_BOOKMARKS} SELECT array_to_string(string_split(folder, '/')[1:1], '/') AS folder, count(*) AS n FROM b GROUP BY 1")
def folder_cut(spark, d):
    return bookmarks(spark, d).groupBy(folders.cut_depth(F.col("folder"), 1).alias("folder")).agg(F.count("*").alias("n"))


# Discovery and quality.
_FOUND = f"""WITH {SQL_BOOKMARKS}, s AS (
    SELECT pos, 'title' AS source, unnest(list_filter(regexp_extract_all(lower(title), '[a-z][a-z0-9\\-]*[a-z0-9]|[a-z]'), lambda t: len(t) BETWEEN 2 AND 30 AND t NOT IN ({_list(D.STOP_WORDS)}))) AS term FROM b
    UNION ALL SELECT pos, 'note', unnest(list_filter(regexp_extract_all(lower(note), '[a-z][a-z0-9\\-]*[a-z0-9]|[a-z]'), lambda t: len(t) BETWEEN 2 AND 30 AND t NOT IN ({_list(D.STOP_WORDS)}))) FROM b
    UNION ALL SELECT pos, 'url', unnest(list_filter(regexp_split_to_array(lower({SQL_PATH}), '[/\\-_.]'), lambda t: len(t) >= 3)) FROM b
    UNION ALL SELECT pos, 'tag', unnest(tags) FROM b)"""


@query("discovery_terms", f"{_FOUND} SELECT term, count(*) AS frequency, min(pos) AS first_pos, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM s WHERE term NOT IN ({_list(sorted({*reports.vocabulary(), *D.STOP_WORDS, *D.WEB_TERMS}))}) GROUP BY 1 HAVING count(*) >= 3 ORDER BY frequency DESC, first_pos, term LIMIT 30")
def discovery_terms(spark, d):
    return reports.discovered_terms(bookmarks(spark, d))


@query("discovery_domains", f"SELECT {SQL_DOMAIN} AS domain, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, domain LIMIT 30")
def discovery_domains(spark, d):
    return reports.discovered_domains(table(spark, d, "pages"))


@query("discovery_folders", f"""WITH c AS (SELECT {SQL_DOMAIN} AS domain, count(*) AS n FROM pages GROUP BY 1), f AS (SELECT n, {' '.join(f"CASE WHEN {' OR '.join(f'''contains(domain, '{w}')''' for w in ws)} THEN '{name}' ELSE" for name, ws in reports.HOST_CLASSES.items())} CASE WHEN n >= 5 THEN 'From ' || domain END {'END ' * len(reports.HOST_CLASSES)} AS folder FROM c)
    SELECT folder, sum(n)::BIGINT AS n FROM f WHERE folder IS NOT NULL GROUP BY 1 ORDER BY n DESC, folder LIMIT 10""")
def discovery_folders(spark, d):
    named = table(spark, d, "pages").groupBy(urls.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))
    return reports.folder_suggestions(named)


@query("vocabulary_unused", f"WITH {SQL_BOOKMARKS}, v AS (SELECT unnest([{_list(reports.vocabulary())}]) AS tag) SELECT tag FROM v EXCEPT SELECT unnest(tags) FROM b")
def vocabulary_unused(spark, d):
    words = spark.createDataFrame([(w,) for w in reports.vocabulary()], "tag string")
    return words.subtract(bookmarks(spark, d).select(F.explode("tags").alias("tag")))


@query("vocabulary_used", f"WITH {SQL_BOOKMARKS}, v AS (SELECT unnest([{_list(reports.vocabulary())}]) AS tag) SELECT tag FROM v INTERSECT SELECT unnest(tags) FROM b")
def vocabulary_used(spark, d):
    words = spark.createDataFrame([(w,) for w in reports.vocabulary()], "tag string")
    return words.intersect(bookmarks(spark, d).select(F.explode("tags").alias("tag")))


@query("quality_tags", f"""WITH {SQL_BOOKMARKS}, m AS (SELECT count(*) AS total, count(*) FILTER (len(tags) > 0) AS tagged, sum(len(tags)) / count(*) FILTER (len(tags) > 0) AS a, (SELECT count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM b)) AS unique_tags FROM b)
    SELECT total, tagged, unique_tags, round(a, 6) AS avg_tags, round(0.4 * tagged / total + 0.3 * CASE WHEN a < 3 THEN a / 3 WHEN a <= 5 THEN 1 ELSE greatest(0, 1 - (a - 5) / 5) END + 0.3 * least(1, unique_tags / (0.3 * total)), 6)::DOUBLE AS score FROM m""")
def quality_tags(spark, d):
    return reports.tag_metrics(bookmarks(spark, d))


@query("quality_folders", f"""WITH {SQL_BOOKMARKS}, s AS (SELECT folder, count(*) AS n FROM b WHERE folder <> '' GROUP BY 1), m AS (SELECT sum(n)::BIGINT AS rows, count(*) AS folders, stddev_pop(n) / avg(n) AS cv, sum(len(string_split(folder, '/')) * n) / sum(n) AS dep FROM s)
    SELECT rows, folders, round(cv, 6) AS cv, round(dep, 6) AS avg_depth, round(0.4 * greatest(0, least(1, 1 - 0.5 * abs(1 - folders / (2 * sqrt(rows))))) + 0.3 * greatest(0, 1 - 0.3 * cv) + 0.3 * CASE WHEN dep < 2 THEN dep / 2 WHEN dep <= 3 THEN 1 ELSE greatest(0, 1 - (dep - 3) / 3) END, 6)::DOUBLE AS score FROM m""")
def quality_folders(spark, d):
    return reports.folder_metrics(bookmarks(spark, d))


@query("quality_descriptions", f"WITH {SQL_BOOKMARKS} SELECT CASE WHEN excerpt <> '' THEN 0.7 WHEN note <> '' THEN 0.6 WHEN trim(title) <> '' THEN 0.3 ELSE 0.0 END::DOUBLE AS confidence, count(*) AS n FROM b GROUP BY 1")
def quality_descriptions(spark, d):
    none = F.lit(None).cast("string")
    return bookmarks(spark, d).groupBy(reports.description_confidence(none, none.cast("double"), F.col("excerpt"), F.col("note"), F.col("title")).alias("confidence")).agg(F.count("*").alias("n"))


@query("quality_attention", f"""WITH {SQL_BOOKMARKS}, r AS (SELECT CASE WHEN excerpt = '' AND note = '' THEN 'low_confidence' END AS reason FROM b UNION ALL SELECT CASE WHEN len(tags) = 0 THEN 'untagged' END FROM b
    UNION ALL SELECT CASE WHEN pos % 9 = 0 THEN 'invalid_url' END FROM b UNION ALL SELECT CASE WHEN trim(title) = '' THEN 'missing_title' END FROM b) SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1""")
def quality_attention(spark, d):
    none = F.lit(None).cast("string")
    sure = reports.description_confidence(none, none.cast("double"), F.col("excerpt"), F.col("note"), F.col("title"))
    return reports.attention(bookmarks(spark, d), sure, F.col("pos") % 9 == 0)


@query("export_statistics", f"WITH {SQL_BOOKMARKS} SELECT count(*) AS total, count(DISTINCT folder) FILTER (folder <> '') AS unique_folders, count(*) FILTER (note <> '') AS with_notes, count(*) FILTER (len(tags) > 0) AS with_tags, count(created) AS with_dates, (SELECT count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM b)) AS unique_tags FROM b")
def export_statistics(spark, d):
    return reports.export_statistics(bookmarks(spark, d))


@query("related_titles", f"""WITH {SQL_BOOKMARKS}, t AS (SELECT DISTINCT url, title, unnest(tags) AS tag FROM b), m AS (SELECT DISTINCT x.url, y.title FROM t x JOIN t y ON x.tag = y.tag AND x.title <> y.title), r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY title) AS n FROM m)
    SELECT url, string_agg(title, ', ' ORDER BY title) AS "Related" FROM r WHERE n <= 5 GROUP BY 1""")
def related_titles(spark, d):
    from ..sources.export import related_titles as related

    return related(bookmarks(spark, d))


# State over orders: two runs by parity.
def _run(spark, d, odd: int) -> DataFrame:
    rows = table(spark, d, "orders").where(F.col("o_orderkey") % 4 != odd)
    hashed = F.md5(F.concat_ws("|", F.col("o_custkey").cast("string"), F.when((F.col("o_orderkey") % 5 == 0) & F.lit(odd == 1), F.lit("X")).otherwise(F.col("o_orderstatus"))).cast("binary"))
    return rows.select(F.col("o_orderkey").alias("url"), hashed.alias("content_hash"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("processed").alias("status"), F.col("o_orderdate").alias("processed_at"))


def _run_sql(odd: int) -> str:
    state_of = "CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END" if odd == 1 else "o_orderstatus"
    return f"SELECT o_orderkey AS url, md5(o_custkey || '|' || {state_of}) AS content_hash, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'processed' END AS status FROM orders WHERE o_orderkey % 4 <> {odd}"


@query("state_content_hash", f"WITH {SQL_BOOKMARKS} SELECT pos, md5(url || '|' || title || '|' || note || '|' || excerpt || '|' || folder || '|' || array_to_string(list_sort(tags), ',')) AS content_hash FROM b")
def state_content_hash(spark, d):
    rows = bookmarks(spark, d)
    return rows.select("pos", state.content_hash(rows).alias("content_hash"))


@query("state_unprocessed", f"WITH a AS ({_run_sql(1)}), z AS ({_run_sql(2)}) SELECT a.url FROM a LEFT JOIN z USING (url) WHERE z.url IS NULL OR z.content_hash <> a.content_hash OR z.status = 'failed'")
def state_unprocessed(spark, d):
    return state.unprocessed(_run(spark, d, 1), _run(spark, d, 2)).select("url")


@query("state_upsert", f"WITH a AS ({_run_sql(1)}), z AS ({_run_sql(2)}) SELECT * FROM z WHERE url NOT IN (SELECT url FROM a) UNION ALL SELECT * FROM a")
def state_upsert(spark, d):
    return state.upserted(_run(spark, d, 2).drop("processed_at"), _run(spark, d, 1).drop("processed_at"))


@query("run_compare", f"WITH a AS ({_run_sql(2)}), z AS ({_run_sql(1)}) SELECT coalesce(a.url, z.url) AS url, CASE WHEN a.url IS NULL THEN 'new' WHEN z.url IS NULL THEN 'removed' WHEN a.content_hash <> z.content_hash THEN 'changed' ELSE 'unchanged' END AS change FROM a FULL JOIN z ON a.url = z.url")
def run_compare(spark, d):
    return state.compared(_run(spark, d, 2), _run(spark, d, 1))


@query("run_summary", "WITH r AS (SELECT o_custkey AS id, min(o_orderdate) AS s, max(o_orderdate) AS e, count(*) AS p, count(*) FILTER (o_orderstatus <> 'F') AS g FROM orders GROUP BY 1) SELECT id, round(g / p * 100, 2) AS success_rate, epoch(e)::BIGINT - epoch(s)::BIGINT AS duration_seconds FROM r")
def run_summary(spark, d):
    runs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("started_at"), F.max("o_orderdate").alias("completed_at"), F.count("*").alias("total_processed"), F.count_if(F.col("o_orderstatus") != "F").alias("total_succeeded"))
    as_time = runs.withColumns({c: F.col(c).cast("timestamp") for c in ("started_at", "completed_at")})
    return state.run_summary(as_time).select("id", "success_rate", "duration_seconds")


@query("db_statistics", f"WITH {SQL_BOOKMARKS} SELECT count(*) AS total, count(*) FILTER (pos % 6 = 0) AS failed, count(*) FILTER (created >= TIMESTAMP '2024-05-25') AS recent, count(DISTINCT folder) FILTER (folder <> '') AS folders, round(avg(len(tags)), 6) AS avg_tags FROM b")
def db_statistics(spark, d):
    rows = bookmarks(spark, d).select("url", "folder", F.array_join("tags", ",").alias("tags"), F.col("created").alias("processed_at"), F.when(F.col("pos") % 6 == 0, "failed").otherwise("processed").alias("status"))
    return state.statistics(rows, _now())


@query("query_by_tag", f"WITH {SQL_BOOKMARKS} SELECT pos FROM b WHERE list_contains(tags, 'ai')")
def query_by_tag(spark, d):
    return state.by_tag(bookmarks(spark, d).withColumn("tags", F.array_join("tags", ",")), "ai").select("pos")


@query("query_by_folder", f"WITH {SQL_BOOKMARKS} SELECT pos FROM b WHERE starts_with(lower(folder), 'development')")
def query_by_folder(spark, d):
    return state.by_folder(bookmarks(spark, d), "Development").select("pos")


# Search.
_INDEX = f"WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '{text.TERM}') AS ts FROM documents), x AS (SELECT doc_id, len(ts) AS length, unnest(ts) AS term FROM t), i AS (SELECT doc_id, length, term, count(*) AS tf FROM x GROUP BY ALL)"


@query("search_bm25", f"""{_INDEX}, h AS (SELECT * FROM i WHERE term IN ('the', 'thing', 'under')), df AS (SELECT term, count(*) AS df FROM h GROUP BY 1), g AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM t)
    SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM h JOIN df USING (term), g GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 100""")
def search_bm25(spark, d):
    path = scratch(spark, "matches")
    search.matches(table(spark, d, "documents"), "doc_id", "the thing under", "text").write.parquet(path)
    return search.ranked(spark.read.parquet(path), "doc_id", "the thing under")


@query("search_index", f"{_INDEX}, h AS (SELECT * FROM i WHERE term IN ('thing', 'under')), df AS (SELECT term, count(*) AS df FROM h GROUP BY 1), g AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM t) SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM h JOIN df USING (term), g GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 100")
def search_index(spark, d):
    """The same from an inverted index that is kept and read by term."""
    docs, path = table(spark, d, "documents").select("doc_id", "text"), scratch(spark, "index")
    search.index(docs, "doc_id", "text").repartition("term").sortWithinPartitions("term").write.parquet(path)
    told = search.matches(docs, "doc_id", "", "text").agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    return search.bm25(spark.read.parquet(path), "doc_id", "thing under", told.n, told.mean or 1.0)


@query("search_containing", "SELECT doc_id FROM documents WHERE contains(lower(text), 'thing') ORDER BY doc_id LIMIT 100")
def search_containing(spark, d):
    return search.containing(table(spark, d, "documents").select("doc_id", "text"), "THING", "text", order="doc_id").select("doc_id")


@query("similar_tags", f"WITH t AS (SELECT unnest([{_list(reports.vocabulary())}]) AS tag) SELECT tag FROM t WHERE tag <> 'web' AND (contains(tag, 'web') OR contains('web', tag) OR tag IN ({_list(D.TECH_KEYWORDS['web'])})) ORDER BY tag LIMIT 10")
def similar_tags(spark, d):
    return tagging.similar(spark.createDataFrame([(w,) for w in reports.vocabulary()], "tag string"), "web")


# Metrics over events: the event type is the provider, the value the cost.
def _costs(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("provider"), F.col("value").alias("cost_usd"), "user_id")


@query("cost_by_provider", "SELECT event_type AS provider, count(*) AS requests, round(sum(value), 6) AS total_cost, round(avg(value), 6) AS avg_cost, min(ts) AS first_used, max(ts) AS last_used FROM events GROUP BY 1")
def cost_by_provider(spark, d):
    return metrics.by_provider(_costs(spark, d)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_used", "last_used")})


@query("cost_by_hour", "SELECT date_trunc('hour', ts) AS hour, count(*) AS requests, round(sum(value), 6) AS total_cost FROM events GROUP BY 1")
def cost_by_hour(spark, d):
    return metrics.by_hour(_costs(spark, d)).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("cost_by_day", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS requests, round(sum(value), 6) AS total_cost FROM events GROUP BY 1")
def cost_by_day(spark, d):
    return metrics.by_day(_costs(spark, d)).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("cost_peak_hour", "SELECT date_trunc('hour', ts) AS hour, count(*) AS requests, round(sum(value), 6) AS total_cost FROM events GROUP BY 1 ORDER BY total_cost DESC, hour LIMIT 1")
def cost_peak_hour(spark, d):
    return metrics.peak_hour(_costs(spark, d)).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("cost_trend", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events), m AS (SELECT event_type, count(*) AS n, avg(value) FILTER (n <= 5) AS a, avg(value) FILTER (n > 5) AS z FROM r WHERE n <= 10 GROUP BY 1) SELECT event_type, CASE WHEN n < 10 THEN 'insufficient_data' WHEN a > z * 1.1 THEN 'increasing' WHEN a < z * 0.9 THEN 'decreasing' ELSE 'stable' END AS trend FROM m")
def cost_trend(spark, d):
    return metrics.trend(table(spark, d, "events"), "event_type", "value", order=("ts", "event_id"))


@query("rolling_rate", "SELECT event_id, avg(round(value * 100)::BIGINT) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS rolling FROM events")
def rolling_rate(spark, d):
    # Cents, so that sums are exact in any order.
    rows = table(spark, d, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return metrics.rolling(rows, "event_type", "cents", order=("ts", "event_id")).select("event_id", "rolling")


@query("sliding_minute", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events")
def sliding_minute(spark, d):
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return metrics.sliding_count(rows, "event_type").select("event_id", "in_window")


@query("request_gap", "SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events")
def request_gap(spark, d):
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return metrics.gaps(rows, "user_id", order=("event_id",)).select("event_id", "gap")


@query("event_counts", "SELECT event_type, user_id % 3 AS severity, count(*) AS n FROM events GROUP BY 1, 2")
def event_counts(spark, d):
    return metrics.counted(table(spark, d, "events").withColumn("severity", F.col("user_id") % 3), "event_type", "severity")


@query("validation_statistics", "SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS valid, count(*) FILTER (event_type = 'error') AS invalid, round(avg((event_type <> 'error')::INT), 6) AS success_rate, round(avg(value), 6) AS avg_response FROM events")
def validation_statistics(spark, d):
    rows = table(spark, d, "events").select((F.col("event_type") != "error").alias("is_valid"), F.col("value").alias("response_time"))
    return metrics.validation_statistics(rows)


@query("routed", "WITH s AS (SELECT event_id, event_type, value, user_id, coalesce(sum(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM events) SELECT event_id, CASE WHEN spent >= 500 THEN 'local' WHEN user_id * 20 < 200 THEN 'local' WHEN event_type = 'purchase' THEN 'cloud' WHEN value / 20 < 0.7 THEN 'cloud' ELSE 'local' END AS route FROM s")
def routed(spark, d):
    rows = table(spark, d, "events")
    return metrics.routed(rows, F.col("user_id") * 20, F.col("value") / 20, F.col("event_type"), F.col("value"), 500.0, "event_id", "event_type", ("purchase",)).select("event_id", "route")


# Health over events: the last state of a user before and after a moment.
_SPLIT = "2024-01-15 00:00:00"


def _health(spark, d, late: bool) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    rows = table(spark, d, "events").where(ts >= F.lit(_SPLIT).cast("timestamp") if late else ts < F.lit(_SPLIT).cast("timestamp"))
    last = rows.groupBy(F.col("user_id").alias("url")).agg(F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("e"))
    return last.select("url", F.when(F.col("e.event_type") == "error", "dead").otherwise("healthy").alias("status"), F.md5(F.floor("e.value").cast("string").cast("binary")).alias("content_hash"))


def _health_sql(op: str) -> str:
    return f"SELECT user_id AS url, CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'dead' ELSE 'healthy' END AS status, floor(arg_max(value, (ts, event_id))) AS h FROM events WHERE ts {op} TIMESTAMP '{_SPLIT}' GROUP BY 1"


@query("health_counts", f"SELECT status, count(*) AS n FROM ({_health_sql('>=')}) GROUP BY 1")
def health_counts(spark, d):
    return reports.health_counts(_health(spark, d, True))


@query("health_transitions", f"WITH p AS ({_health_sql('<')}), c AS ({_health_sql('>=')}) SELECT c.url, CASE WHEN p.url IS NULL THEN 'new' WHEN c.status = 'dead' AND p.status <> 'dead' THEN 'newly_dead' WHEN c.status <> 'dead' AND p.status = 'dead' THEN 'recovered' WHEN c.h <> p.h THEN 'changed' ELSE 'same' END AS change FROM c LEFT JOIN p USING (url)")
def health_transitions(spark, d):
    return reports.health_transitions(_health(spark, d, False), _health(spark, d, True))


# Validation and errors.
@query("http_error_class", "WITH c AS (SELECT DISTINCT 395 + (page_id * 7) % 130 AS code FROM pages) SELECT code, CASE code " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in D.HTTP_ERRORS.items()) + " ELSE CASE WHEN code BETWEEN 400 AND 499 THEN 'client_error' WHEN code BETWEEN 500 AND 599 THEN 'server_error' ELSE 'http_error' END END AS kind FROM c")
def http_error_class(spark, d):
    codes = table(spark, d, "pages").select((F.lit(395) + F.col("page_id") * 7 % 130).alias("code")).distinct()
    return codes.select("code", errors.http_error(F.col("code")).alias("kind"))


@query("error_class", "WITH m AS (SELECT page_id, list_extract(['Read timed out', 'SSL handshake failed', 'Connection refused', 'HTTP 429', 'no route to host', 'odd'], page_id % 6 + 1) AS message FROM pages) SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'timeout' WHEN 1 THEN 'ssl_error' WHEN 2 THEN 'connection_error' WHEN 3 THEN 'rate_limited' WHEN 4 THEN 'network_error' ELSE 'unknown' END AS kind, CASE page_id % 6 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 2 ELSE 1 END AS times FROM m")
def error_class(spark, d):
    said = F.element_at(F.array(*[F.lit(m) for m in ("Read timed out", "SSL handshake failed", "Connection refused", "HTTP 429", "no route to host", "odd")]), (F.col("page_id") % 6 + 1).cast("int"))
    rows = table(spark, d, "pages").select("page_id", errors.retry_class(said).alias("kind"))
    return rows.select("page_id", "kind", errors.retries(F.col("kind"))["times"].alias("times"))


def _export_rows(spark, d) -> DataFrame:
    rows = bookmarks(spark, d)
    n = F.col("pos")
    return rows.select(
        "pos", F.when(n % 5 == 0, "").otherwise(n.cast("string")).alias("id"), F.when(n % 6 == 0, F.concat(F.lit("<b>"), "title")).otherwise(F.col("title")).alias("title"), "note", "excerpt",
        F.when(n % 10 == 3, "not a url").otherwise(F.col("url")).alias("url"), F.when(n % 8 == 0, F.lit("a//b")).otherwise(F.col("folder")).alias("folder"), F.array_join("tags", ",").alias("tags"),
        F.when(n % 9 == 0, "soon").otherwise(F.coalesce(F.date_format("created", "yyyy-MM-dd"), F.lit(""))).alias("created"), F.lit("").alias("cover"), F.lit("").alias("highlights"), F.when(n % 4 == 0, "maybe").otherwise("true").alias("favorite"),
    )


@query("record_checks", f"""WITH {SQL_BOOKMARKS}, e AS (SELECT *, CASE WHEN pos % 10 = 3 THEN 'not a url' ELSE url END AS u FROM b) SELECT pos, pos % 10 <> 3 AND pos % 9 <> 0 AS is_valid,
    ((pos % 5 = 0)::INT + (title = '' AND pos % 6 <> 0)::INT + (pos % 6 = 0)::INT + (pos % 10 = 3)::INT + regexp_matches(u, '[?&](utm_[a-z]+|fbclid|gclid|ref)=')::INT + (pos % 8 = 0)::INT + (pos % 9 = 0)::INT + (pos % 4 = 0)::INT)::INT AS n_issues FROM e""")
def record_checks(spark, d):
    return validation.checked(_export_rows(spark, d), _now()).select("pos", "is_valid", F.size("issues").alias("n_issues"))


@query("record_recovery", f"WITH {SQL_BOOKMARKS} SELECT pos, CASE WHEN pos % 5 = 0 THEN 'auto_' || left(md5(CASE WHEN pos % 10 = 3 THEN 'https://notaurl' ELSE url END), 8) ELSE pos::VARCHAR END AS id, CASE WHEN pos % 8 = 0 THEN 'a/b' ELSE folder END AS folder FROM b")
def record_recovery(spark, d):
    return validation.recovered(_export_rows(spark, d), _now()).select("pos", "id", "folder")


# Streams as batches.
@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    from ..streaming.incremental import windowed

    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed(rows, "event_type", "value").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("event_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS starts FROM events), s AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid")
def event_sessions(spark, d):
    from ..streaming.incremental import sessions

    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(rows, "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


from . import catalogue_rows, catalogue_sources, catalogue_state  # noqa: E402, F401  (they register theirs)


@query("process_pipeline", catalogue_rows.pipeline_sql(_GOOD))
def process_pipeline(spark, d):
    """The whole enrichment over pages as bookmarks, with their HTML as what was fetched."""
    from . import process

    pages = table(spark, d, "pages").groupBy("url").agg(F.min_by("html", "page_id").alias("html")).withColumn("status_code", F.lit(200))
    done = process.run(bookmarks(spark, d), process.Options(fetch=lambda asked: asked.join(pages, "url", "left"), now=NOW))
    return process.output(done)
