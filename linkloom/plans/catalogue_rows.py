"""Queries of row functions, tags, folders and pages, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import errors, generated, html, tags, text, urls
from ..operators import bookmarks as B
from ..operators import folders, pages, predicates, reports, tagging, validation
from .registry import query, sql_list
from .tables import SQL_BOOKMARKS, SQL_DOMAIN, SQL_PATH, SQL_TITLE, bookmarks, table

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_EVERY_STATUS = "pos % 2 = 0 AS url_validated, CASE WHEN pos % 7 = 0 THEN 'bad' END AS url_validation_error, pos % 3 = 0 AS content_extracted, CASE WHEN pos % 11 = 0 THEN 'no' END AS content_extraction_error, pos % 5 = 0 AS ai_processed, CASE WHEN pos % 13 = 0 THEN 'off' END AS ai_processing_error, pos % 4 = 0 AS tags_optimized"


def _with_status(spark, d):
    n = F.col("pos")
    error = lambda k, said: F.when(n % k == 0, said)
    made = F.struct(
        (n % 2 == 0).alias("url_validated"), error(7, "bad").alias("url_validation_error"), (n % 3 == 0).alias("content_extracted"), error(11, "no").alias("content_extraction_error"),
        (n % 5 == 0).alias("ai_processed"), error(13, "off").alias("ai_processing_error"), (n % 4 == 0).alias("tags_optimized"),
    )
    return bookmarks(spark, d).withColumn("processing_status", made)


# Predicates.
@query("filter_status", f"""WITH {SQL_BOOKMARKS}, s AS (SELECT pos, {_EVERY_STATUS} FROM b), u AS (
    SELECT 'validated' AS status, pos FROM s WHERE url_validated UNION ALL SELECT 'not_validated', pos FROM s WHERE NOT url_validated UNION ALL SELECT 'invalid', pos FROM s WHERE url_validation_error IS NOT NULL
    UNION ALL SELECT 'content_extracted', pos FROM s WHERE content_extracted UNION ALL SELECT 'ai_processed', pos FROM s WHERE ai_processed UNION ALL SELECT 'not_processed', pos FROM s WHERE NOT ai_processed
    UNION ALL SELECT 'tags_optimized', pos FROM s WHERE tags_optimized UNION ALL SELECT 'error', pos FROM s WHERE url_validation_error IS NOT NULL OR content_extraction_error IS NOT NULL OR ai_processing_error IS NOT NULL)
    SELECT status, pos FROM u""")
def filter_status(spark, d):
    rows = _with_status(spark, d)
    parts = [predicates.status([name]).apply(rows).select(F.lit(name).alias("status"), "pos") for name in predicates.STATUSES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("filter_valid_custom", f"WITH {SQL_BOOKMARKS} SELECT pos FROM b WHERE trim(url) <> '' AND len(title) % 2 = 1")
def filter_valid_custom(spark, d):
    odd = predicates.custom(F.length("title") % 2 == 1, "odd title")
    return (predicates.valid_row() & odd).apply(bookmarks(spark, d)).select("pos")


@query("filter_custom_function", "SELECT page_id AS pos FROM pages WHERE len(url) % 3 = 0")
def filter_custom_function(spark, d):
    return predicates.custom(lambda u: len(u) % 3 == 0).apply(table(spark, d, "pages")).select(F.col("page_id").alias("pos"))


@query("filter_counts", f"WITH {SQL_BOOKMARKS} SELECT 'any' AS name, count(*) AS n FROM b WHERE list_has_any(tags, ['ai', 'web']) UNION ALL SELECT 'none', count(*) FROM b WHERE NOT list_has_any(tags, ['ai', 'web']) UNION ALL SELECT 'empty chain', count(*) FROM b")
def filter_counts(spark, d):
    rows, wanted = bookmarks(spark, d), predicates.tag(["ai", "web"])
    told = [("any", wanted.count(rows)), ("none", (~wanted).count(rows)), ("empty chain", predicates.every([]).count(rows))]
    return spark.createDataFrame(told, "name string, n long")


@query("status_labels", f"WITH {SQL_BOOKMARKS}, s AS (SELECT pos, {_EVERY_STATUS} FROM b) SELECT pos, CASE WHEN url_validation_error IS NOT NULL OR content_extraction_error IS NOT NULL OR ai_processing_error IS NOT NULL THEN 'Error' WHEN ai_processed THEN 'Processed' WHEN url_validated THEN 'Validated' ELSE 'Pending' END AS label FROM s")
def status_labels(spark, d):
    return _with_status(spark, d).select("pos", B.status_label(F.col("processing_status")).alias("label"))


# Projections.
@query("effective_description", f"WITH {SQL_BOOKMARKS} SELECT pos, CASE WHEN pos % 6 = 0 THEN 'made' WHEN trim(note) <> '' THEN trim(note) WHEN trim(excerpt) <> '' THEN trim(excerpt) ELSE '' END AS said FROM b")
def effective_description(spark, d):
    made = F.when(F.col("pos") % 6 == 0, " made ").otherwise("  ")
    return bookmarks(spark, d).select("pos", B.effective_description(made, F.col("note"), F.col("excerpt")).alias("said"))


@query("fallback_description", f"""WITH {SQL_BOOKMARKS}, s AS (SELECT pos, coalesce(nullif(trim(note), ''), nullif(trim(excerpt), ''), nullif(trim(title), '') || ' from ' || {SQL_DOMAIN}, '') AS t FROM b)
    SELECT pos, CASE WHEN len(t) > 30 THEN t[1:27] || '...' ELSE t END AS said FROM s""")
def fallback_description(spark, d):
    return bookmarks(spark, d).select("pos", B.fallback_description(F.col("title"), F.col("note"), F.col("excerpt"), F.col("url"), most=30).alias("said"))


@query("tags_every", f"WITH {SQL_BOOKMARKS}, t AS (SELECT pos, list_concat(tags, list_concat(['AI ', 'x'], CASE WHEN pos % 2 = 0 THEN ['Key', 'word'] ELSE [] END)) AS ts FROM b) SELECT pos, array_to_string(list_sort(list_distinct(list_filter(list_transform(ts, lambda x: lower(trim(x))), lambda x: len(x) > 1))), ',') AS tags FROM t")
def tags_every(spark, d):
    words = F.when(F.col("pos") % 2 == 0, F.array(F.lit("Key"), F.lit("word")))
    return bookmarks(spark, d).select("pos", F.array_join(tags.every(F.col("tags"), F.array(F.lit("AI "), F.lit("x")), words), ",").alias("tags"))


@query("tags_final", f"WITH {SQL_BOOKMARKS} SELECT pos, array_to_string(CASE WHEN pos % 4 = 0 THEN ['one', 'two'] ELSE tags[1:2] END, ',') AS tags FROM b")
def tags_final(spark, d):
    chosen = F.when(F.col("pos") % 4 == 0, F.array(F.lit("one "), F.lit("two"), F.lit("three")))
    return bookmarks(spark, d).select("pos", F.array_join(tags.final(F.col("tags"), chosen, most=2), ",").alias("tags"))


@query("tags_with_folders", rf"WITH {SQL_BOOKMARKS}, p AS (SELECT pos, list_concat(tags, list_transform(list_filter(list_transform(string_split(folder, '/'), lambda x: trim(x)), lambda x: x <> ''), lambda x: regexp_replace(lower(x), '\s+', '-', 'g'))) AS ts FROM b), n AS (SELECT pos, unnest(ts) AS t, unnest(range(1, len(ts) + 1)) AS i FROM p), f AS (SELECT pos, t, min(i) AS i FROM n GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY i) AS k FROM f) SELECT p.pos, coalesce(string_agg(r.t, ',' ORDER BY r.i), '') AS tags FROM p LEFT JOIN r ON r.pos = p.pos AND r.k <= 3 GROUP BY p.pos")
def tags_with_folders(spark, d):
    return bookmarks(spark, d).select("pos", F.array_join(B.with_folder_tags(F.col("tags"), F.col("folder"), most=3), ",").alias("tags"))


@query("folder_parts_of", f"WITH {SQL_BOOKMARKS} SELECT pos, array_to_string(list_filter(list_transform(string_split(folder, '/'), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM b")
def folder_parts_of(spark, d):
    return B.with_keys(bookmarks(spark, d)).select("pos", F.array_join("folder_hierarchy", "|").alias("parts"))


_DECIDED = f"""WITH {SQL_BOOKMARKS}, p AS (SELECT pos, note, tags, folder, 'new ' || note AS new_note, list_append(tags, 'extra') AS new_tags, 'Moved' AS new_folder, list_extract(['accept', 'description', 'tags', 'folder', 'skip'], pos % 5 + 1) AS a FROM b)"""


def _proposed(spark, d):
    return bookmarks(spark, d).withColumns({"new_note": F.concat(F.lit("new "), F.col("note")), "new_tags": F.array_append("tags", F.lit("extra")), "new_folder": F.lit("Moved")})


@query("changes_applied", f"{_DECIDED} SELECT pos, CASE WHEN a IN ('accept', 'description') THEN new_note ELSE note END AS note, array_to_string(CASE WHEN a IN ('accept', 'tags') THEN new_tags ELSE tags END, ',') AS tags, CASE WHEN a IN ('accept', 'folder') THEN new_folder ELSE folder END AS folder FROM p")
def changes_applied(spark, d):
    action = F.element_at(F.array(*[F.lit(a) for a in ("accept", "description", "tags", "folder", "skip")]), (F.col("pos") % 5 + 1).cast("int"))
    return B.applied(_proposed(spark, d), action).select("pos", "note", F.array_join("tags", ",").alias("tags"), "folder")


@query("changes_auto_accepted", f"{_DECIDED} SELECT pos, CASE WHEN pos % 10 >= 8 THEN new_note ELSE note END AS note, CASE WHEN pos % 10 >= 8 THEN new_folder ELSE folder END AS folder FROM p")
def changes_auto_accepted(spark, d):
    return B.auto_accepted(_proposed(spark, d).withColumn("confidence", F.col("pos") % 10 / 10.0)).select("pos", "note", "folder")


@query("changes_undone", f"WITH {SQL_BOOKMARKS}, s AS (SELECT pos % 20 AS pos, 'a' || (pos % 3) AS action, pos AS step FROM b), z AS (SELECT * FROM s WHERE step <= (SELECT max(step) FROM s) - 15) SELECT pos, arg_max(action, step) AS action FROM z GROUP BY 1")
def changes_undone(spark, d):
    n = F.col("pos")
    decided = bookmarks(spark, d).select((n % 20).alias("pos"), F.concat(F.lit("a"), (n % 3).cast("string")).alias("action"), n.alias("step"))
    return B.undone(decided, 15)


# Text functions over documents and odd values of rows.
@query("text_clean", rf"SELECT doc_id, md5({STRIP.format(r"regexp_replace(replace(coalesce(text, ''), chr(13), ''), '\s+', ' ', 'g')")}) AS cleaned FROM documents")
def text_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.clean(F.col("text")).cast("binary")).alias("cleaned"))


@query("text_escaped", r"""SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS html,
    md5(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), ' ')) AS yaml FROM documents WHERE text IS NOT NULL""")
def text_escaped(spark, d):
    rows, t = table(spark, d, "documents").where("text IS NOT NULL"), F.col("text")
    return rows.select("doc_id", F.md5(text.escape_html(t).cast("binary")).alias("html"), F.md5(text.escape_yaml(t).cast("binary")).alias("yaml"))


_SAFE = STRIP.format(r"""regexp_replace(regexp_replace(title || ': ' || url, '[<>:"/\\|?*\x00-\x1f]', '', 'g'), '\s+', ' ', 'g')""")


@query("text_file_names", rf"WITH {SQL_BOOKMARKS}, s AS (SELECT pos, {_SAFE} AS t FROM b) SELECT pos, CASE WHEN len(t) <= 40 THEN t ELSE regexp_replace(t[1:40], '\s+\S*$', '') END AS name FROM s")
def text_file_names(spark, d):
    return bookmarks(spark, d).select("pos", text.file_name(F.concat("title", F.lit(": "), "url"), most=40).alias("name"))


@query("text_anchors", rf"WITH {SQL_BOOKMARKS} SELECT pos, regexp_replace(regexp_replace(lower(folder || ' ' || title), '[\s/]+', '-', 'g'), '[^0-9A-Za-z_\-]', '', 'g') AS anchor FROM b")
def text_anchors(spark, d):
    return bookmarks(spark, d).select("pos", text.anchor(F.concat("folder", F.lit(" "), "title")).alias("anchor"))


@query("text_title_case", f"WITH {SQL_BOOKMARKS} SELECT pos, array_to_string(list_transform(regexp_extract_all({SQL_DOMAIN}, '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || w[2:]), '') AS shown FROM b")
def text_title_case(spark, d):
    return bookmarks(spark, d).select("pos", text.title_case(urls.domain(F.col("url"))).alias("shown"))


_SECRETS = "CASE page_id % 5 WHEN 0 THEN 'Bearer abcdefgh12345678 used' WHEN 1 THEN 'api_key=\"k1234567\" and more' WHEN 2 THEN 'mail me.you+x@host.example.org now' WHEN 3 THEN 'key sk-' || repeat('a1', 10) ELSE 'nothing here ' || page_id END"


@query("text_redacted", rf"""WITH s AS (SELECT page_id, {_SECRETS} AS t FROM pages) SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)(bearer\s+)[A-Za-z0-9._~+/=-]{{8,}}', '\1[REDACTED]', 'g'), '(?i)((?:api[_-]?key|token|secret|password|passwd)["'']?\s*[:=]\s*["'']?)[^\s"'',;]{{4,}}', '\1[REDACTED]', 'g'),
    '\bsk-[A-Za-z0-9-]{{16,}}', '[REDACTED]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}', '[EMAIL]', 'g') AS said FROM s""")
def text_redacted(spark, d):
    return table(spark, d, "pages").select("page_id", text.redact(F.expr(_SECRETS)).alias("said"))


_DATES = "CASE page_id % 9 WHEN 0 THEN strftime(m, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(m, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(m, '%Y-%m-%d') WHEN 3 THEN strftime(m, '%-m/%-d/%Y') WHEN 4 THEN strftime(m, '%Y-%m-%dT%H:%M:%S') WHEN 5 THEN strftime(m, '%Y-%m-%dT%H:%M:%S.250000Z') WHEN 6 THEN 'soon' WHEN 7 THEN '' ELSE strftime(m, '%-m/%-d/%Y %H:%M:%S') END"


@query("text_dates", "WITH s AS (SELECT page_id, TIMESTAMP '2023-05-20 01:02:03' + to_days((page_id % 7)::INT) AS m FROM pages) SELECT page_id, CASE WHEN page_id % 9 IN (6, 7) THEN NULL WHEN page_id % 9 IN (2, 3) THEN date_trunc('day', m)::TIMESTAMP WHEN page_id % 9 = 5 THEN m + INTERVAL 250 MILLISECONDS ELSE m END AS at, page_id % 4 IN (0, 1) AS flag, page_id % 4 = 0 AS narrow FROM s")
def text_dates(spark, d):
    m = F.expr("timestamp '2023-05-20 01:02:03' + make_dt_interval(CAST(page_id % 7 AS INT))")
    shapes = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.'250000Z'", None, None, "M/d/yyyy HH:mm:ss"]
    said = F.lit("")
    for i, shape in enumerate(shapes):
        said = F.when(F.col("page_id") % 9 == i, F.date_format(m, shape) if shape else F.lit("soon" if i == 6 else "")).otherwise(said)
    flag = F.element_at(F.array(*[F.lit(x) for x in (" YES ", "enabled", "no", "")]), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", text.parse_time(said).cast("timestamp_ntz").alias("at"), text.parse_bool(flag).alias("flag"), text.parse_bool(flag, ("true", "1", "yes", "on")).alias("narrow"))


# Tags.
_RAW_TAGS = "list_extract(['\"Web Dev\", AI; js|x', 'python, Python ,web', 'one;two;  three', 'a|bb|ml', 'solo words here', ''], page_id % 6 + 1)"


def _raw_tags():
    return F.element_at(F.array(*[F.lit(x) for x in ('"Web Dev", AI; js|x', "python, Python ,web", "one;two;  three", "a|bb|ml", "solo words here", "")]), (F.col("page_id") % 6 + 1).cast("int"))


def _full_form(c: str) -> str:
    return f"CASE {' '.join(f'''WHEN {c} = '{k}' THEN '{v}' ''' for k, v in D.TAG_FORMS.items())} ELSE {c} END"


@query("tags_import_dialect", rf"""WITH s AS (SELECT page_id, {_RAW_TAGS} AS t FROM pages), p AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array({STRIP.format(r"regexp_replace(t, '\s+', ' ', 'g')")}, '[,;|]'), lambda x: regexp_replace(lower({STRIP.format('x')}), '^["'']+|["'']+$', '', 'g')), lambda x: len(x) > 1) AS ts FROM s),
    n AS (SELECT page_id, unnest(ts) AS x, unnest(range(len(ts))) AS i FROM p), f AS (SELECT page_id, x, min(i) AS i FROM n GROUP BY 1, 2) SELECT p.page_id, coalesce(string_agg(f.x, '|' ORDER BY f.i), '') AS tags FROM p LEFT JOIN f USING (page_id) GROUP BY 1""")
def tags_import_dialect(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(tags.parse_import(_raw_tags()), "|").alias("tags"))


@query("tags_stream_dialect", rf"""WITH s AS (SELECT page_id, {_RAW_TAGS} AS t FROM pages) SELECT page_id, array_to_string(list_filter(list_transform(string_split(regexp_replace({STRIP.format('t')}, '^"+|"+$', '', 'g'), ','), lambda x: {STRIP.format('x')}), lambda x: x <> ''), '|') AS tags FROM s""")
def tags_stream_dialect(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(tags.parse_stream(_raw_tags()), "|").alias("tags"))


@query("tags_corpus_dialect", rf"""WITH s AS (SELECT page_id, lower({STRIP.format(_RAW_TAGS)}) AS t FROM pages), p AS (SELECT page_id, list_filter(list_transform(CASE WHEN contains(t, ',') THEN string_split(t, ',') WHEN contains(t, ';') THEN string_split(t, ';') WHEN contains(t, '|') THEN string_split(t, '|') ELSE regexp_split_to_array(t, '\s+') END, lambda x: {STRIP.format('x')}), lambda x: x <> '') AS ts FROM s)
    SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(ts, lambda x: CASE WHEN x IN ('ai', 'ml', 'ui', 'ux') THEN x ELSE {_full_form('x')} END))), '|') AS tags FROM p""")
def tags_corpus_dialect(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(tags.parse_existing(_raw_tags()), "|").alias("tags"))


def sql_text_tags(c: str) -> str:
    """A list of the tags of a text, unsorted and with repeats."""
    fields = " || ".join(f"CASE WHEN contains(lower({c}), '{w}') THEN ['{name}', '{w}'] ELSE [] END" for name, ws in D.TECH_KEYWORDS.items() for w in ws)
    types = " || ".join(f"CASE WHEN {' OR '.join(f'''contains(lower({c}), '{w}')''' for w in ws)} THEN ['{name}'] ELSE [] END" for name, ws in D.CONTENT_TYPE_INDICATORS.items())
    stop = sql_list(D.STOP_WORDS)
    words = rf"list_transform(list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+'), lambda w: len(w) >= 2 AND w NOT IN ({stop}) AND NOT regexp_full_match(w, '[0-9]+')), lambda w: CASE WHEN w IN ('ai', 'programming', 'machine', 'learning', 'github') THEN w ELSE {_full_form('w')} END)"
    names = rf"list_filter(list_transform(list_filter(regexp_extract_all({c}, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-zA-Z]+')), lambda w: lower(w)), lambda w: len(w) > 3 AND w NOT IN ({stop}))"
    return f"(({fields}) || ({types}) || ({words}) || ({names}))"


def sql_cleaned(c: str) -> str:
    """A list of tags without marks, long ones, stop words and numbers, written out; sorted and distinct."""
    bare = rf"list_transform({c}, lambda t: regexp_replace(lower({STRIP.format('t')}), '[^\p{{L}}\p{{N}}_\-]', '', 'g'))"
    kept = f"list_filter({bare}, lambda t: len(t) BETWEEN 2 AND 20 AND t NOT IN ({sql_list(D.STOP_WORDS)}) AND NOT regexp_full_match(t, '[0-9]+'))"
    return f"list_sort(list_distinct(list_transform({kept}, lambda t: CASE WHEN len(t) > 2 THEN {_full_form('t')} ELSE t END)))"


def sql_url_tags() -> str:
    """A list of the tags of b's url, unsorted and with repeats."""
    host, parts = SQL_DOMAIN, f"list_filter(string_split(lower({SQL_PATH}), '/'), lambda x: x <> '')[1:3]"
    platform = f"{' '.join(f'''CASE WHEN contains({host}, '{h}') THEN [{sql_list(ws)}] ELSE''' for h, ws in D.PLATFORM_TAGS.items())} [] {'END ' * len(D.PLATFORM_TAGS)}"
    words = rf"flatten(list_transform(list_filter({parts}, lambda x: len(x) > 2), lambda x: CASE WHEN contains(x, '-') THEN list_filter(string_split(x, '-'), lambda y: regexp_full_match(y, '\p{{L}}{{2,}}')) WHEN regexp_full_match(x, '\p{{L}}+') THEN [x] ELSE [] END))"
    labels = f"CASE WHEN contains({host}, '.') THEN list_filter(string_split({host}, '.'), lambda x: len(x) > 2 AND x NOT IN ({sql_list(D.HOST_PARTS_IGNORED)})) ELSE [] END"
    return f"(({platform}) || ({words}) || ({labels}))"


@query("tags_of_text", f"WITH {SQL_BOOKMARKS} SELECT pos, array_to_string(list_sort(list_distinct({sql_text_tags('title')})), ',') AS tags FROM b")
def tags_of_text(spark, d):
    return bookmarks(spark, d).select("pos", F.array_join(tags.from_text(F.col("title")), ",").alias("tags"))


@query("tags_cleaned", f"WITH {SQL_BOOKMARKS} SELECT pos, array_to_string({sql_cleaned(sql_text_tags('title') + ' || ' + sql_url_tags())}, ',') AS tags FROM b")
def tags_cleaned(spark, d):
    return bookmarks(spark, d).select("pos", F.array_join(tags.cleaned(F.concat(tags.from_text(F.col("title")), tags.from_url(F.col("url")))), ",").alias("tags"))


def _first(found: str, wanted: str, most: int) -> str:
    return f"list_concat(list_filter({found}, lambda t: list_contains({wanted}, t)), list_filter({found}, lambda t: NOT list_contains({wanted}, t)))[1:{most}]"


@query("tags_of_content", f"WITH {SQL_BOOKMARKS}, t AS (SELECT pos, {sql_cleaned(sql_text_tags('title'))} AS ts FROM b) SELECT pos, array_to_string({_first('ts', f'[{sql_list(tags.PRIORITY)}]', 5)}, ',') AS tags FROM t")
def tags_of_content(spark, d):
    return bookmarks(spark, d).select("pos", F.array_join(tags.of_text(F.col("title")), ",").alias("tags"))


@query("tags_of_bookmark", f"""WITH {SQL_BOOKMARKS}, t AS (SELECT pos, tags AS raw, {sql_cleaned(f"list_transform(tags, lambda t: CASE WHEN t IN ('ai', 'ml', 'ui', 'ux') THEN t ELSE {_full_form('t')} END) || {sql_url_tags()} || {sql_text_tags('title')} || {sql_text_tags('note')} || {sql_text_tags('excerpt')}")} AS ts FROM b)
    SELECT pos, array_to_string({_first('ts', f"list_concat(raw, [{sql_list((*tags.PRIORITY, 'tutorial'))}])", 5)}, ',') AS tags FROM t""")
def tags_of_bookmark(spark, d):
    return bookmarks(spark, d).select("pos", F.array_join(tags.of_bookmark(F.col("tags"), F.col("url"), F.col("title"), F.col("note"), F.col("excerpt")), ",").alias("tags"))


def _category_of(c: str) -> str:
    table = {}
    for group in (D.CONTENT_TYPE_INDICATORS, D.TECH_KEYWORDS):
        for name, words in reversed(group.items()):
            table.update(dict.fromkeys(words, name))
    by: dict[str, list[str]] = {}
    for w, name in table.items():
        by.setdefault(name, []).append(w)
    return f"CASE {' '.join(f'''WHEN {c} IN ({sql_list(ws)}) THEN '{name}' ''' for name, ws in by.items())} ELSE 'general' END"


def _hierarchy(c: str) -> str:
    table = {}
    for branch, words in reversed(D.TAG_HIERARCHY.items()):
        table.update({w: f"{branch}/{w}" for w in words})
    return f"CASE {' '.join(f'''WHEN {c} = '{w}' THEN '{path}' ''' for w, path in table.items())} ELSE {c} END"


_WORDS = f"SELECT DISTINCT unnest(list_distinct(list_concat([{sql_list(reports.vocabulary())}], [{sql_list([*D.TAG_FORMS, *D.TAG_SYNONYMS, *(w for ws in D.TAG_HIERARCHY.values() for w in ws), 'zzz'])}]))) AS tag"


def _words(spark):
    words = {*reports.vocabulary(), *D.TAG_FORMS, *D.TAG_SYNONYMS, *(w for ws in D.TAG_HIERARCHY.values() for w in ws), "zzz"}
    return spark.createDataFrame([(w,) for w in sorted(words)], "tag string")


@query("tag_places", f"WITH w AS ({_WORDS}), h AS (SELECT tag, {_hierarchy('tag')} AS path FROM w) SELECT tag, {_full_form('tag')} AS full_form, {_category_of('tag')} AS category, path, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) END AS branch FROM h")
def tag_places(spark, d):
    t = F.col("tag")
    return _words(spark).select("tag", tags.full_form(t).alias("full_form"), tags.category(t).alias("category"), tags.in_hierarchy(t).alias("path"), tagging.branch(t).alias("branch"))


def _confidence() -> str:
    return f"CASE WHEN tag IN ({sql_list(D.PROTECTED_TAGS)}) THEN 0.95 ELSE least(1.0, 0.5 + CASE WHEN contains(lower(title), tag) THEN 0.2 ELSE 0 END + CASE WHEN contains(lower(url), tag) THEN 0.15 ELSE 0 END + CASE WHEN contains(own, tag) THEN 0.25 ELSE 0 END + CASE WHEN frequency >= 5 THEN 0.1 ELSE 0 END) END"


@query("tag_confidence", f"WITH {SQL_BOOKMARKS}, t AS (SELECT pos, url, title, array_to_string(tags, ' ') AS own, unnest(tags) AS tag FROM b), f AS (SELECT tag, count(*) AS frequency FROM t GROUP BY 1) SELECT pos, tag, round({_confidence()}, 6)::DOUBLE AS confidence FROM t JOIN f USING (tag)")
def tag_confidence(spark, d):
    rows = bookmarks(spark, d).withColumn("own", F.col("tags")).withColumn("tag", F.explode("tags"))
    both = rows.join(rows.groupBy("tag").agg(F.count("*").alias("frequency")), "tag")
    return both.select("pos", "tag", F.round(tagging.confidence(F.col("tag"), F.col("title"), F.col("url"), F.col("own"), F.col("frequency"), F.lit(False)), 6).alias("confidence"))


_SYNONYM = f"CASE {' '.join(f'''WHEN tag = '{k}' THEN '{v}' ''' for k, v in D.TAG_SYNONYMS.items() if k not in D.PROTECTED_TAGS)} ELSE tag END"


@query("tag_max_confidence", f"WITH w AS ({_WORDS}), c AS (SELECT {_SYNONYM} AS tag, len(tag) / 20 AS confidence FROM (SELECT replace(tag, ' ', '-') AS tag FROM (SELECT replace(tag, '_', '-') AS tag FROM w))) SELECT tag, max(confidence)::DOUBLE AS confidence FROM c GROUP BY 1")
def tag_max_confidence(spark, d):
    return tagging.with_max_confidence(_words(spark).withColumn("confidence", F.length("tag") / 20))


# Candidates, scores, choice and assignment over rows with tags, URL, title and note.
_CANDIDATES = f"""c AS (SELECT DISTINCT url, unnest({sql_cleaned(f"tags || {sql_url_tags()} || {sql_text_tags("concat_ws(' ', title, note)")}")}) AS tag FROM b)"""
_SCORED = f"""{_CANDIDATES}, total AS (SELECT count(*) AS n FROM b), f AS (SELECT tag, count(*) AS frequency FROM c GROUP BY 1 HAVING count(*) >= 2),
    u AS (SELECT f.tag, count(DISTINCT b.url) AS hits FROM f, b WHERE contains(lower(b.url), f.tag) GROUP BY 1),
    q AS (SELECT f.tag, frequency, coalesce(hits, 0) / n AS url_score, (least(1.0, frequency / (n * 0.1)) + CASE WHEN len(f.tag) BETWEEN 3 AND 15 THEN 1.0 ELSE 0.5 END + CASE WHEN regexp_full_match(f.tag, '\\p{{L}}+') THEN 1.0 ELSE 0.8 END)
      * CASE WHEN f.tag IN ({sql_list(sorted({w for ws in D.TECH_KEYWORDS.values() for w in ws}))}) THEN 1.2 ELSE 1.0 END / 3.2 AS quality FROM f LEFT JOIN u USING (tag), total),
    s AS (SELECT tag, frequency, round(url_score, 6) AS url_score, round(quality, 6) AS quality_score, round(frequency * 0.3 + url_score * 0.2 + quality * 0.1, 6) AS total_score FROM q)"""
#: The greedy choice keeps the best four fifths of the target, scores over 0.7, and the first of a category, up to the target.
_CHOSEN = f"""r AS (SELECT tag, total_score, row_number() OVER (ORDER BY total_score DESC, tag) AS place, row_number() OVER (PARTITION BY {_category_of('tag')} ORDER BY total_score DESC, tag) AS in_category FROM s WHERE total_score >= 0.3),
    chosen AS (SELECT tag, place FROM r WHERE place <= 120 OR total_score > 0.7 OR in_category = 1 ORDER BY place LIMIT 150)"""


@query("tag_candidates", f"WITH {SQL_BOOKMARKS}, {_CANDIDATES} SELECT url, tag FROM c")
def tag_candidates(spark, d):
    return tagging.candidates(bookmarks(spark, d))


@query("tag_scores", f"WITH {SQL_BOOKMARKS}, {_SCORED} SELECT tag, frequency, url_score::DOUBLE AS url_score, quality_score::DOUBLE AS quality_score, total_score::DOUBLE AS total_score FROM s")
def tag_scores(spark, d):
    rows = bookmarks(spark, d)
    return tagging.scored(tagging.candidates(rows), rows).select("tag", "frequency", *[F.round(c, 6).alias(c) for c in ("url_score", "quality_score", "total_score")])


@query("tag_choice", f"WITH {SQL_BOOKMARKS}, {_SCORED}, {_CHOSEN} SELECT tag, row_number() OVER (ORDER BY place) AS place FROM chosen")
def tag_choice(spark, d):
    rows = bookmarks(spark, d)
    scores = tagging.scored(tagging.candidates(rows), rows).withColumn("total_score", F.round("total_score", 6))
    return spark.createDataFrame(list(enumerate(tagging.selected(scores), 1)), "place long, tag string")


_ASSIGNED = """m AS (SELECT DISTINCT c.url, c.tag, b.title, b.tags FROM c JOIN chosen USING (tag) JOIN b USING (url)),
    v AS (SELECT url, tag, round(least(1.0, CASE WHEN contains(lower(title), tag) THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(url), tag) THEN 0.2 ELSE 0 END + CASE WHEN contains(array_to_string(tags, ' '), tag) THEN 0.1 ELSE 0 END), 6)::DOUBLE AS relevance FROM m),
    z AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY relevance DESC, tag) AS place FROM v)"""
ASSIGNMENTS_SQL = f"WITH {SQL_BOOKMARKS}, {_SCORED}, {_CHOSEN}, {_ASSIGNED} SELECT url, tag, relevance, place::INT AS place FROM z WHERE place <= 5"
_SURE_WORDS = ("ai", "python", "web", "news", "video", "blog", "page", "example")


@query("tag_surest", f"""WITH {SQL_BOOKMARKS}, {_CANDIDATES}, chosen AS (SELECT unnest([{sql_list(_SURE_WORDS)}]) AS tag), {_ASSIGNED}, fr AS (SELECT tag, count(*) AS frequency FROM c GROUP BY 1),
    j AS (SELECT z.url, z.tag, frequency, title, array_to_string(tags, ' ') AS own FROM z JOIN fr USING (tag) JOIN b ON b.url = z.url WHERE place <= 5)
    SELECT url, CASE WHEN tag IN ({sql_list(D.PROTECTED_TAGS)}) THEN tag ELSE {_hierarchy('tag')} END AS tag, round({_confidence()}, 6)::DOUBLE AS confidence FROM j""")
def tag_surest(spark, d):
    corpus = spark.createDataFrame([(w,) for w in _SURE_WORDS], "tag string")
    return tagging.with_confidence(bookmarks(spark, d), corpus)


# Folders.
def categorised_sql(source: str = "b", said: str = "concat_ws(' ', title, note, url)") -> str:
    """x with category and subcategory of each row of a source."""
    parts = []
    contains = lambda ws: " + ".join(f"(CASE WHEN contains(t, '{w}') THEN 1 ELSE 0 END)" for w in ws)
    for i, (name, spec) in enumerate(D.FOLDER_CATEGORIES.items()):
        subs = list(spec["subcategories"].items())
        total = " + ".join(f"({contains(ws)})" for _, ws in subs)
        best = f"[{', '.join(f'''{{'h': {contains(ws)}, 'at': {-j}, 'n': '{sub.replace(chr(39), chr(39) * 2)}'}}''' for j, (sub, ws) in enumerate(subs))}]"
        sub = f"CASE WHEN list_max(list_transform({best}, lambda s: s.h)) > 0 THEN list_sort({best}, 'DESC')[1].n ELSE 'General' END"
        parts.append(f"SELECT pos, '{name.replace(chr(39), chr(39) * 2)}' AS name, {i} AS place, 2 * ({contains(spec['keywords'])}) + CASE WHEN dom IN ({sql_list(spec['domains'])}) THEN 5 ELSE 0 END + {total} + CASE WHEN folder <> '' AND contains(lower(folder), '{name.lower()}') THEN 3 ELSE 0 END AS score, {sub} AS sub FROM w")
    low = "lower(trim(split_part(w.folder, '/', 1)))"
    match = " ".join(f"WHEN {low} <> '' AND (contains('{n.lower()}', {low}) OR contains({low}, '{n.lower()}')) THEN '{n}'" for n in D.FOLDER_CATEGORIES)
    return f"""w AS (SELECT pos, folder, {SQL_DOMAIN} AS dom, lower({said}) AS t FROM {source}), sc AS ({' UNION ALL '.join(parts)}),
    m AS (SELECT pos, first(name ORDER BY score DESC, place) AS name, first(sub ORDER BY score DESC, place) AS sub, max(score) AS score FROM sc GROUP BY pos),
    x AS (SELECT w.pos, w.dom, src.url, src.folder, CASE WHEN m.score > 0 THEN m.name ELSE CASE {match} WHEN len(trim(split_part(w.folder, '/', 1))) BETWEEN 3 AND 29 THEN CASE trim(split_part(w.folder, '/', 1)) WHEN 'Reading list' THEN 'Reading List' ELSE trim(split_part(w.folder, '/', 1)) END ELSE 'Uncategorized' END END AS category,
      CASE WHEN m.score > 0 THEN m.sub ELSE 'General' END AS subcategory FROM w JOIN m USING (pos) JOIN {source} src USING (pos))"""


CATEGORISED_SQL = categorised_sql()
_LABEL = f"CASE WHEN contains(regexp_extract({SQL_DOMAIN}, '^[^:]*'), '.') THEN (list_transform([string_split(regexp_extract({SQL_DOMAIN}, '^[^:]*'), '.')[-2]], lambda w: upper(w[1]) || lower(w[2:])))[1] ELSE 'Other' END"
#: Paths by windows: base, split by label, parts.
FILED = f"""cn AS (SELECT category, count(*) AS n, count(DISTINCT subcategory) AS subs FROM x GROUP BY 1),
    p0 AS (SELECT pos, category, subcategory, CASE WHEN subs > 1 OR n > 20 THEN category || '/' || subcategory ELSE category END AS path, {_LABEL} AS lab FROM x JOIN cn USING (category)),
    p1 AS (SELECT *, count(*) OVER (PARTITION BY path) AS size, count(*) OVER (PARTITION BY path, lab) AS g FROM p0),
    p2 AS (SELECT * REPLACE (CASE WHEN g < 3 THEN 'Other' ELSE lab END AS lab) FROM p1), p3 AS (SELECT *, count(*) OVER (PARTITION BY path, lab) AS h FROM p2),
    p4 AS (SELECT *, min(h) OVER (PARTITION BY path) > 20 OR h = size AS stuck, row_number() OVER (PARTITION BY path ORDER BY pos) AS i, row_number() OVER (PARTITION BY path, lab ORDER BY pos) AS j FROM p3),
    filed AS (SELECT pos, category, subcategory, CASE WHEN size <= 20 THEN path WHEN stuck THEN path || '/Part ' || ((i - 1) // 20 + 1) WHEN h > 20 THEN path || '/' || lab || '/Part ' || ((j - 1) // 20 + 1) ELSE path || '/' || lab END AS path FROM p4)"""
FILED_SQL = f"WITH {SQL_BOOKMARKS}, {CATEGORISED_SQL}, {FILED} SELECT pos, category, subcategory, path FROM filed"
SUGGESTED_SQL = f"""WITH {SQL_BOOKMARKS}, {CATEGORISED_SQL}, c AS (SELECT dom, split_part(folder, '/', 1) AS top, count(*) AS hits FROM x WHERE folder <> '' GROUP BY 1, 2 HAVING count(*) >= 2), l AS (SELECT dom, first(top ORDER BY hits DESC, top) AS known FROM c GROUP BY 1),
    s AS (SELECT x.*, known, coalesce(known, CASE WHEN subcategory = 'General' THEN category ELSE category || '/' || subcategory END) AS suggested FROM x LEFT JOIN l USING (dom))
    SELECT pos, suggested, round(least(1.0, 0.5 + CASE WHEN lower(split_part(suggested, '/', 1)) = lower(split_part(folder, '/', 1)) THEN 0.25 WHEN folder <> '' AND contains(lower(suggested), lower(folder)) THEN 0.15 ELSE 0 END
      + CASE WHEN known IS NOT NULL THEN 0.2 ELSE 0 END + CASE WHEN split_part(suggested, '/', 1) = category THEN 0.1 ELSE 0 END), 6)::DOUBLE AS confidence FROM s"""


@query("folder_reasons", f"""WITH {SQL_BOOKMARKS}, {CATEGORISED_SQL} SELECT pos, concat_ws('; ', 'category: ' || category, CASE WHEN subcategory <> 'General' THEN 'subcategory: ' || subcategory END,
    CASE WHEN {' OR '.join(f"(category = '{n}' AND dom IN ({sql_list(spec['domains'])}))" for n, spec in D.FOLDER_CATEGORIES.items())} THEN 'known host: ' || dom END, CASE WHEN folder <> '' THEN 'was in: ' || folder END) AS reason FROM x""")
def folder_reasons(spark, d):
    rows = folders.categorised(bookmarks(spark, d))
    return rows.select("pos", folders.reasoning(F.col("category"), F.col("subcategory"), urls.domain(F.col("url")), F.col("folder")).alias("reason"))


@query("folder_preserved", f"WITH {SQL_BOOKMARKS} SELECT pos, coalesce(nullif(array_to_string(string_split(folder, '/')[1:2], '/'), ''), 'Uncategorized') AS path FROM b")
def folder_preserved(spark, d):
    return folders.preserved(bookmarks(spark, d), 2).select("pos", "path")


_LEARNED_WORDS = rf"""lw AS (SELECT word, top, count(*) AS hits FROM (SELECT split_part(folder, '/', 1) AS top, unnest(list_distinct(list_filter(regexp_split_to_array(lower(trim(title)), '\s+'), lambda w: len(w) > 3) || list_transform(tags, lambda t: lower(t)))) AS word FROM b WHERE folder <> '') GROUP BY 1, 2),
    lb AS (SELECT word, first(top ORDER BY hits DESC, top) AS folder, max(hits) AS hits FROM lw GROUP BY 1 HAVING max(hits) >= 2)"""


@query("folder_learned_words", f"WITH {SQL_BOOKMARKS}, {_LEARNED_WORDS} SELECT word, folder, hits FROM lb")
def folder_learned_words(spark, d):
    return folders.learned_words(bookmarks(spark, d))


@query("folder_learned_category", f"WITH {SQL_BOOKMARKS}, {_LEARNED_WORDS}, h AS (SELECT pos, lb.folder, count(*) AS n FROM b JOIN lb ON contains(lower(concat_ws(' ', title, array_to_string(tags, ' '))), word) GROUP BY 1, 2 HAVING count(*) >= 2) SELECT pos, first(folder ORDER BY n DESC, folder) AS folder FROM h GROUP BY 1")
def folder_learned_category(spark, d):
    rows = bookmarks(spark, d)
    return folders.learned_category(rows, folders.learned_words(rows))


@query("folder_moves", f"WITH {SQL_BOOKMARKS}, o AS (SELECT url, CASE WHEN pos % 3 = 0 THEN 'Old' ELSE folder END AS was FROM (SELECT url, min(pos) AS pos, first(folder ORDER BY pos) AS folder FROM b GROUP BY url)) SELECT count(*) FILTER (folder <> '' AND was <> folder) AS reorganised FROM b JOIN o USING (url)")
def folder_moves(spark, d):
    rows = bookmarks(spark, d)
    first = rows.groupBy("url").agg(F.min("pos").alias("pos"), F.min_by("folder", "pos").alias("folder"))
    return reports.reorganised(rows, first.select("url", F.when(F.col("pos") % 3 == 0, "Old").otherwise(F.col("folder")).alias("folder")))


# URLs.
@query("url_labels", f"SELECT page_id, {_LABEL} AS label FROM pages")
def url_labels(spark, d):
    return table(spark, d, "pages").select("page_id", urls.main_label(F.col("url")).alias("label"))


@query("url_cleaned", r"SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'https://' || regexp_replace(url, '^[a-z]+://', '') ELSE '' END AS cleaned FROM pages")
def url_cleaned(spark, d):
    u = F.col("url")
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" "), u, F.lit("\n"))).when(F.col("page_id") % 3 == 1, F.regexp_replace(u, "^[a-z]+://", "")).otherwise("  ")
    return table(spark, d, "pages").select("page_id", urls.clean_url(raw).alias("cleaned"))


@query("url_sanitized", rf"SELECT page_id, 'https://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) || replace({SQL_PATH}, '../', '') || CASE WHEN contains(url, '?') THEN '?' || regexp_extract(url, '\?([^#]*)', 1) ELSE '' END AS safe FROM pages")
def url_sanitized(spark, d):
    with_user = F.regexp_replace("url", "://", "://user:pw@")
    return table(spark, d, "pages").select("page_id", urls.sanitized(F.regexp_replace(with_user, "/$", "/../")).alias("safe"))


# Pages.
_QUIET = r"regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<noscript\b[^>]*>.*?</noscript>|<!--.*?-->', ' ', 'g')"


_ENTITIES = "replace(replace(replace(replace(replace(replace(regexp_replace({0}, '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_STRAIGHT = r"""regexp_replace(regexp_replace(translate({0}, chr(160) || '“”‘’', ' ""' || chr(39) || chr(39)), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"""
SQL_BARE = _STRAIGHT.replace("{0}", _ENTITIES)


def _meta(name: str) -> str:
    one = rf"regexp_extract(html, '(?is)<meta[^>]*(?:name|property)\s*=\s*[\"'']{name}[\"''][^>]*content\s*=\s*[\"'']([^\"'']*)[\"'']', 1)"
    two = rf"regexp_extract(html, '(?is)<meta[^>]*content\s*=\s*[\"'']([^\"'']*)[\"''][^>]*(?:name|property)\s*=\s*[\"'']{name}[\"'']', 1)"
    raw = f"coalesce(nullif({one}, ''), {two})".replace('\\"', '"')
    return _STRAIGHT.replace("{0}", raw)


_ABOUT = f"coalesce(nullif({_meta('description')}, ''), {_meta('og:description')})"
_HEADINGS = " || ".join(rf"list_transform(regexp_extract_all(html, '(?is)<h{n}\b[^>]*>(.*?)</h{n}>', 1), lambda h: {SQL_BARE.format('h')})" for n in range(1, 7))
_LINKS = r"""list_filter(regexp_extract_all(html, '(?is)<a\b[^>]*?\shref\s*=\s*["'']([^"'']+)["'']', 1), lambda u: NOT regexp_matches(u, '^(#|javascript:|mailto:)'))"""


def _absolute(found: str) -> str:
    root = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)', 1)"
    bare = "regexp_replace(url, '[?#].*$', '')"
    folder = rf"CASE WHEN regexp_matches({bare}, '[^/]/[^/]*$') THEN regexp_replace({bare}, '/[^/]*$', '/') ELSE {bare} END"
    return f"list_transform({found}, lambda u: CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN u WHEN starts_with(u, '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || u WHEN starts_with(u, '/') THEN {root} || u ELSE {folder} || u END)"


CONTENT_SQL = f"""WITH g AS (SELECT page_id, url, html, {SQL_TITLE} AS page_title, {_ABOUT} AS page_description, lower(regexp_extract(html, '(?is)<html[^>]*\\slang\\s*=\\s*["'']?([A-Za-z\\-]+)', 1)) AS language, {SQL_BARE.format(_QUIET)} AS body,
      list_filter({_HEADINGS}, lambda h: len(h) > 3)[1:10] AS heads FROM pages),
    n AS (SELECT *, CASE WHEN body = '' THEN 0 ELSE len(string_split(body, ' ')) END AS words, lower(body[1:1000]) AS lb, lower(url) AS lu, lower(page_title) AS lt FROM g),
    cats AS (SELECT page_id, string_agg(name, ',' ORDER BY name) AS categories FROM ({' UNION ALL '.join(f"SELECT page_id, '{name}' AS name, 2.0 * ({' + '.join(f'contains(lu, {chr(39)}{w}{chr(39)})::INT' for w in ws)}) + ({' + '.join(f'contains(lt, {chr(39)}{w}{chr(39)})::INT' for w in ws)}) + 0.5 * ({' + '.join(f'contains(lb, {chr(39)}{w}{chr(39)})::INT' for w in ws)}) AS score FROM n" for name, ws in D.CONTENT_CATEGORIES.items())}) WHERE score >= 1 GROUP BY 1)
    SELECT page_id, page_title, page_description, language, words::INT AS word_count, CASE WHEN words = 0 THEN 0 ELSE greatest(1, round_even(words / 225.0, 0)::INT) END AS reading_minutes, coalesce(categories, '') AS categories,
      round(least(1.0, (len(page_title) > 0)::INT * 0.2 + (len(page_title) BETWEEN 20 AND 100)::INT * 0.1 + (len(page_description) > 0)::INT * 0.1 + (len(page_description) BETWEEN 50 AND 200)::INT * 0.1 + (words > 100)::INT * 0.2 + (words > 500)::INT * 0.1
        + (len(heads) > 0)::INT * 0.1 + (len(heads) >= 3)::INT * 0.1 + (language <> '')::INT * 0.1), 6)::DOUBLE AS page_quality, len(heads)::INT AS n_headings, least(20, len(list_distinct({_absolute(_LINKS)})))::INT AS n_links FROM n LEFT JOIN cats USING (page_id)"""


@query("page_meta", f"SELECT page_id, {_ABOUT} AS about, {_meta('keywords')} AS keywords FROM pages")
def page_meta(spark, d):
    return table(spark, d, "pages").select("page_id", html.description(F.col("html")).alias("about"), html.meta(F.col("html"), "keywords").alias("keywords"))


_FIRST_IMAGE = _absolute(r"""regexp_extract_all(html, '(?is)<img\b[^>]*?\ssrc\s*=\s*["'']([^"'']+)["'']', 1)""")


@query("page_images", f"SELECT page_id, array_to_string({_FIRST_IMAGE}[1:10], ' ') AS images FROM pages")
def page_images(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(html.images(F.col("html"), F.col("url")), " ").alias("images"))


@query("page_merged", f"""WITH {SQL_BOOKMARKS} SELECT pos, CASE WHEN title <> '' AND len(title) > 12 THEN title ELSE 'a page title' END AS title, CASE WHEN pos % 2 = 0 AND excerpt <> '' THEN excerpt WHEN pos % 2 = 0 THEN '' ELSE 'about' END AS about,
    CASE WHEN note = '' THEN CASE WHEN pos % 3 = 0 THEN '' ELSE 'text' END WHEN pos % 3 = 0 THEN 'User Note: ' || note ELSE 'User Note: ' || note || ' | text' END AS body FROM b""")
def page_merged(spark, d):
    n = F.col("pos")
    merged = generated.merged(F.lit("a page title"), F.when(n % 2 == 0, "").otherwise("about"), F.when(n % 3 == 0, "").otherwise("text"), F.col("title"), F.col("note"), F.col("excerpt"))
    return bookmarks(spark, d).select("pos", merged.alias("m")).select("pos", "m.title", "m.about", "m.body")


@query("text_simple_categories", f"SELECT doc_id, array_to_string(list_filter([{', '.join(f'''CASE WHEN {' OR '.join(f"contains(lower(text), '{w}')" for w in ws)} THEN '{name}' END''' for name, ws in D.SIMPLE_CATEGORIES.items())}], lambda x: x IS NOT NULL), ',') AS found FROM documents WHERE text IS NOT NULL")
def text_simple_categories(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(generated.simple_categories(F.col("text")), ",").alias("found"))


# What a generator returned.
_ANSWERS = """CASE page_id % 6 WHEN 0 THEN '```json' || chr(10) || '{"description": "A page about things", "tags": ["Web Dev!", "ai", "ai"], "category": "x", "confidence": 0.5}' || chr(10) || '```'
    WHEN 1 THEN '{"description": "short"}' WHEN 2 THEN 'Summary:   A  plain   answer' WHEN 3 THEN '"Quoted words here"' WHEN 4 THEN '' ELSE 'Ends well!' END"""


def _answers():
    n = F.col("page_id") % 6
    fenced = '```json\n{"description": "A page about things", "tags": ["Web Dev!", "ai", "ai"], "category": "x", "confidence": 0.5}\n```'
    return F.when(n == 0, fenced).when(n == 1, '{"description": "short"}').when(n == 2, "Summary:   A  plain   answer").when(n == 3, '"Quoted words here"').when(n == 4, "").otherwise("Ends well!")


@query("generated_cleaned", rf"""WITH a AS (SELECT page_id, {_ANSWERS} AS t FROM pages), s AS (SELECT page_id, regexp_replace({STRIP.format(r"regexp_replace(regexp_replace(t, '(?i)^(Summary:|Description:|Enhanced:|The text describes?:?)\s*', ''), '\s+', ' ', 'g')")}, '^"(.*)"$', '\1') AS t FROM a)
    SELECT page_id, left(CASE WHEN t = '' OR regexp_matches(t, '[.!?]$') THEN t ELSE t || '.' END, 150) AS said FROM s""")
def generated_cleaned(spark, d):
    return table(spark, d, "pages").select("page_id", generated.cleaned(_answers()).alias("said"))


@query("generated_parsed", r"""WITH a AS (SELECT page_id, page_id % 6 AS n FROM pages) SELECT page_id, CASE n WHEN 0 THEN 'A page about things' WHEN 1 THEN '{"description": "short"}' WHEN 2 THEN 'Summary:   A  plain   answer' WHEN 3 THEN '"Quoted words here"' WHEN 4 THEN 'No description available' ELSE 'Ends well!' END AS description,
    CASE n WHEN 0 THEN 'webdev,ai' ELSE 'uncategorized' END AS tags, CASE n WHEN 0 THEN 'x' ELSE 'other' END AS category, 0.5::DOUBLE AS confidence FROM a""")
def generated_parsed(spark, d):
    a = generated.parsed(_answers())
    return table(spark, d, "pages").select("page_id", a.alias("a")).select("page_id", "a.description", F.array_join("a.tags", ",").alias("tags"), "a.category", "a.confidence")


@query("generated_types", f"""WITH {SQL_BOOKMARKS} SELECT pos, CASE WHEN pos % 5 = 0 THEN 'first' WHEN pos % 5 = 1 THEN 'given' ELSE {' '.join(f"CASE WHEN {' OR '.join(f'''contains(lower(concat_ws(' ', title, note)), '{w}')''' for w in ws)} THEN '{name}' ELSE" for name, ws in D.CONTENT_TYPES.items())} 'general' {'END ' * len(D.CONTENT_TYPES)} END AS kind FROM b""")
def generated_types(spark, d):
    n = F.col("pos") % 5
    some = F.when(n == 0, F.array(F.lit("First"), F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return bookmarks(spark, d).select("pos", generated.content_type(some, F.when(n == 1, "Given").otherwise(""), F.col("title"), F.col("note")).alias("kind"))


# Errors and estimates.
_MESSAGES = ("Request timeout", "Rate limit hit", "403 Forbidden", "invalid API key", "DNS failure", "HTTP 502", "validation failed", "out of memory", "something else")


@query("error_categories", "SELECT page_id, list_extract(['network', 'api_limit', 'api_auth', 'api_auth', 'network', 'api_error', 'validation', 'system', 'processing'], page_id % 9 + 1) AS category, list_extract(['medium', 'high', 'critical', 'critical', 'medium', 'high', 'low', 'high', 'medium'], page_id % 9 + 1) AS severity, page_id % 9 NOT IN (2, 3, 6) AS recoverable FROM pages")
def error_categories(spark, d):
    said = F.element_at(F.array(*[F.lit(m) for m in _MESSAGES]), (F.col("page_id") % 9 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", errors.categorized(said).alias("e")).select("page_id", "e.category", "e.severity", "e.recoverable")


@query("error_delays", "SELECT page_id, least(60.0, 1.5 * pow(2, page_id % 9))::DOUBLE AS exponential, least(20.0, 1.0 + 2.0 * (page_id % 9))::DOUBLE AS linear FROM pages")
def error_delays(spark, d):
    attempt = F.col("page_id") % 9
    return table(spark, d, "pages").select("page_id", errors.backoff(attempt, base=1.5).alias("exponential"), errors.linear_backoff(attempt, step=2.0, most=20.0).alias("linear"))


@query("cost_of_batches", "SELECT o_orderkey, round(greatest(0.00001, o_totalprice / 1e6 * (1.15 + CASE WHEN o_custkey % 200 > 100 THEN -0.15 WHEN o_custkey % 200 < 10 THEN 0.2 ELSE 0 END)) * (o_custkey % 200), 2)::DOUBLE AS cost, round(CASE WHEN o_custkey % 3 = 0 THEN (o_custkey % 200) * 2.0 WHEN o_custkey % 200 = 0 THEN 0 ELSE (o_custkey % 200) * (0.5 * least(20, o_custkey % 200) / (o_custkey % 200) + 0.1) * 1.2 END, 6)::DOUBLE AS seconds FROM orders")
def cost_of_batches(spark, d):
    n = F.col("o_custkey") % 200
    mean = F.when(F.col("o_custkey") % 3 == 0, 0.0).otherwise(0.5)
    return table(spark, d, "orders").select("o_orderkey", F.round(errors.batch_cost(n, F.col("o_totalprice").cast("double") / 1e6), 2).alias("cost"), F.round(errors.processing_seconds(n, mean, F.lit(20)), 6).alias("seconds"))


@query("content_lengths", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE len(html) END::BIGINT AS n FROM pages")
def content_lengths(spark, d):
    said = F.when(F.col("page_id") % 3 == 0, "chunked").otherwise(F.concat(F.lit(" "), F.length("html").cast("string")))
    return table(spark, d, "pages").select("page_id", errors.content_length(said).alias("n"))


# Primitive checks.
@query("value_checks", rf"""WITH {SQL_BOOKMARKS} SELECT pos, len(trim(title)) BETWEEN 5 AND 40 AS title_ok, CASE WHEN pos % 4 = 0 THEN false ELSE len(note) BETWEEN 0 AND 10 END AS note_ok, pos % 5 <> 2 AND pos % 50 <= 30 AS number_ok, len(tags) BETWEEN 1 AND 2 AS tags_ok,
    pos % 7 <> 0 AND created >= TIMESTAMP '2024-02-01' AS date_ok, pos % 6 <> 1 AND pos % 6 <> 2 AS url_ok, CASE WHEN len(trim(title)) NOT BETWEEN 5 AND 40 THEN 'title' WHEN len(tags) NOT BETWEEN 1 AND 2 THEN 'tags' ELSE '' END AS first_failure FROM (SELECT * REPLACE (coalesce(created, TIMESTAMP '1990-01-01') AS created) FROM b)""")
def value_checks(spark, d):
    n = F.col("pos")
    note = F.when(n % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("note"))
    number = F.when(n % 5 == 2, "1.5").otherwise((n % 50).cast("string"))
    date = F.when(F.col("created").isNull(), "no date").otherwise(F.date_format("created", "yyyy-MM-dd HH:mm:ss"))
    url = F.when(n % 6 == 1, "ftp://a.example.com/x").when(n % 6 == 2, "http://127.0.0.1/").otherwise(F.col("url"))
    title_ok, tags_ok = validation.string_ok(F.col("title"), least=5, most=40), validation.list_ok(F.col("tags"), 1, 2, unique=True)
    return bookmarks(spark, d).select(
        "pos", title_ok.alias("title_ok"), F.when(note.isNull(), validation.string_ok(note, required=True)).otherwise(validation.string_ok(note, most=10)).alias("note_ok"),
        validation.number_ok(number, 0, 30, whole=True).alias("number_ok"), tags_ok.alias("tags_ok"), validation.datetime_ok(date, least="2024-02-01").alias("date_ok"), validation.url_ok(url).alias("url_ok"),
        F.coalesce(F.try_element_at(validation.chained(("title", title_ok), ("tags", tags_ok), stop_on_error=True), F.lit(1)), F.lit("")).alias("first_failure"),
    )


_DAMAGED = "CASE page_id % 8 WHEN 0 THEN 'caf' || chr(195) || chr(169) WHEN 1 THEN 'bad ' || chr(65533) WHEN 2 THEN 'and so on...' WHEN 3 THEN 'this and' WHEN 4 THEN 'x [Truncated] y' WHEN 5 THEN 'whole sentence.' WHEN 6 THEN 'a list,' ELSE '' END"


@query("text_damage", "SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'mojibake' WHEN 1 THEN 'replacement' ELSE '' END AS kinds, page_id % 8 IN (2, 3, 4, 6) AS cut FROM pages")
def text_damage(spark, d):
    texts = ("cafÃ©", "bad �", "and so on...", "this and", "x [Truncated] y", "whole sentence.", "a list,", "")
    said = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("page_id") % 8 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", F.array_join(validation.encoding_issues(said), ",").alias("kinds"), validation.truncated(said).alias("cut"))


@query("record_corruption", f"""WITH {SQL_BOOKMARKS}, e AS (SELECT pos, CASE WHEN pos % 4 = 0 THEN url ELSE title END AS title, CASE WHEN pos % 5 = 0 THEN repeat('long words ', 6) ELSE url END AS url, CASE WHEN pos % 3 = 0 THEN 'the very same text' ELSE note END AS note, CASE WHEN pos % 3 = 0 THEN ' The very same TEXT ' ELSE excerpt END AS excerpt FROM b)
    SELECT pos, array_to_string(list_sort(list_filter([CASE WHEN regexp_matches(title, '^https?://') THEN 'url in title' END, CASE WHEN pos % 5 = 0 THEN 'text in url' END, CASE WHEN pos % 3 = 0 THEN 'identical note and excerpt' END, CASE WHEN pos % 4 = 0 AND pos % 5 <> 0 AND len(url) > 10 THEN 'identical url and title' END,
      CASE WHEN pos % 3 <> 0 AND note = title AND len(trim(title)) > 10 THEN 'identical title and note' END], lambda x: x IS NOT NULL)), ', ') AS damage FROM e""")
def record_corruption(spark, d):
    n = F.col("pos")
    rows = bookmarks(spark, d).select(
        "pos", "folder", F.when(n % 4 == 0, F.col("url")).otherwise(F.col("title")).alias("title"), F.when(n % 5 == 0, "long words " * 6).otherwise(F.col("url")).alias("url"),
        F.when(n % 3 == 0, "the very same text").otherwise(F.col("note")).alias("note"), F.when(n % 3 == 0, " The very same TEXT ").otherwise(F.col("excerpt")).alias("excerpt"),
    )
    return rows.select("pos", F.array_join(validation.corruption(rows, ("url", "title", "note", "excerpt")), ", ").alias("damage"))


@query("record_derived", f"WITH {SQL_BOOKMARKS}, e AS (SELECT pos, title, CASE WHEN pos % 3 = 0 THEN url ELSE '' END AS url, note, excerpt FROM b) SELECT pos, 'auto_' || CASE WHEN url <> '' THEN left(md5(url), 8) WHEN title <> '' THEN left(regexp_replace(lower(title), '[^a-zA-Z0-9_-]', '_', 'g'), 20) ELSE '1717200000' END AS id, CASE WHEN url <> '' THEN array_to_string(list_transform(regexp_extract_all({SQL_DOMAIN}, '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || w[2:]), '') WHEN len(note) > 5 THEN trim(note)[1:100] WHEN len(excerpt) > 5 THEN excerpt ELSE 'Untitled Bookmark' END AS title FROM e")
def record_derived(spark, d):
    url = F.when(F.col("pos") % 3 == 0, F.col("url")).otherwise("")
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    return bookmarks(spark, d).select("pos", validation.derived_id(url, F.col("title"), now).alias("id"), validation.derived_title(url, F.col("note"), F.col("excerpt")).alias("title"))


@query("record_sanitised", f"WITH {SQL_BOOKMARKS} SELECT pos, regexp_replace(url, '^[a-z]+://', 'https://') AS url, array_to_string(tags, ', ') AS tags, coalesce(strftime(created, '%Y-%m-%dT%H:%M:%S'), '') AS created, (pos % 2 = 0)::VARCHAR AS favorite, trim(note) AS note FROM b")
def record_sanitised(spark, d):
    rows = bookmarks(spark, d)
    bare = F.concat(F.lit("\u0001"), F.regexp_replace("url", "^[a-z]+://", " "))
    date = F.coalesce(F.date_format("created", "M/d/yyyy HH:mm:ss"), F.lit("never"))
    ok = lambda c, kind: validation.sanitised(c, kind)
    return rows.select("pos", ok(bare, "url").alias("url"), ok(F.array_join(F.concat("tags", "tags"), " ;"), "tags").alias("tags"), F.coalesce(ok(date, "datetime"), F.lit("")).alias("created"), ok(F.when(F.col("pos") % 2 == 0, "On").otherwise("?"), "boolean").alias("favorite"), ok(F.concat(F.lit(" \u0007"), F.col("note")), "string").alias("note"))


# Whole operators: choice and filing over all rows.
@query("tag_assignments", ASSIGNMENTS_SQL)
def tag_assignments(spark, d):
    """Corpus tags by score, and the best of each row."""
    rows = bookmarks(spark, d)
    scores = tagging.scored(tagging.candidates(rows), rows).withColumn("total_score", F.round("total_score", 6))
    chosen = spark.createDataFrame([(t,) for t in tagging.selected(scores)], "tag string")
    return tagging.assigned(rows, chosen)


@query("folder_filing", FILED_SQL)
def folder_filing(spark, d):
    return folders.filed(folders.categorised(bookmarks(spark, d))).select("pos", "category", "subcategory", "path")


@query("folder_suggestions", SUGGESTED_SQL)
def folder_suggestions(spark, d):
    return folders.suggested(bookmarks(spark, d)).select("pos", "suggested", "confidence")


@query("page_content", CONTENT_SQL)
def page_content(spark, d):
    """Everything taken from a page."""
    from .process import analysed

    out = analysed(table(spark, d, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "page_title", "page_description", "language", "word_count", "reading_minutes", F.array_join(F.array_sort("categories"), ",").alias("categories"), "page_quality", F.size("headings").alias("n_headings"), F.size(html.links(F.col("html"), F.col("url"))).alias("n_links"))


@query("html_headings", f"SELECT page_id, array_to_string(list_filter({_HEADINGS}, lambda h: len(h) > 3)[1:10], '|') AS headings FROM pages")
def html_headings(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(html.headings(F.col("html")), "|").alias("headings"))


@query("html_links", f"WITH l AS (SELECT page_id, {_absolute(_LINKS)} AS ls FROM pages) SELECT page_id, least(20, len(list_distinct(ls)))::INT AS n_links, coalesce(ls[1], '') AS first_link FROM l")
def html_links(spark, d):
    rows = table(spark, d, "pages").select("page_id", html.links(F.col("html"), F.col("url")).alias("ls"))
    return rows.select("page_id", F.size("ls").alias("n_links"), F.coalesce(F.try_element_at("ls", F.lit(1)), F.lit("")).alias("first_link"))


_ODD = """CASE page_id % 12 WHEN 1 THEN replace(url, 'https://', 'ftp://') WHEN 2 THEN 'http://10.' || (page_id % 300) || '.2.3/p' WHEN 3 THEN 'http://localhost/' || page_id WHEN 4 THEN 'https://a.example.com:' || (page_id % 70000) || '/' WHEN 5 THEN url || '/../etc'
    WHEN 6 THEN 'nothing' || page_id WHEN 7 THEN 'http://172.' || (page_id % 40) || '.0.1/' WHEN 8 THEN 'https://user:pw@host' || page_id || '.example.org/?u=javascript:x&v=data:y&w=file:z' WHEN 9 THEN 'https://bad_host' || page_id || '.com/' ELSE url END"""
_SUSPICIOUS = " + ".join(f"regexp_matches(u, '(?i){p}')::INT" for p in D.SUSPICIOUS_PATTERNS)


def _ranges() -> str:
    out = []
    for block in D.PRIVATE_RANGES:
        base, bits = block.split("/")
        low = sum(int(x) << n for x, n in zip(base.split("."), (24, 16, 8, 0), strict=True))
        out.append(f"ip BETWEEN {low} AND {low + 2 ** (32 - int(bits)) - 1}")
    return " OR ".join(out)


@query("url_security", rf"""WITH o AS (SELECT page_id, {_ODD} AS u FROM pages), p AS (SELECT page_id, u, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS s, regexp_replace(lower(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)), '^[^@]*@', '') AS net,
      CASE WHEN contains(u, '://') THEN regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) ELSE '' END AS path, regexp_extract(u, '\?([^#]*)', 1) AS q, {_SUSPICIOUS} AS hits FROM o),
    h AS (SELECT *, regexp_replace(net, ':\d*$', '') AS h, TRY_CAST(nullif(regexp_extract(net, ':(\d+)$', 1), '') AS INT) AS port, string_split(regexp_extract(regexp_replace(net, ':\d*$', ''), '^(\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}})$', 1), '.') AS o FROM p),
    i AS (SELECT *, CASE WHEN len(o) = 4 THEN o[1]::BIGINT * 16777216 + o[2]::BIGINT * 65536 + o[3]::BIGINT * 256 + o[4]::BIGINT ELSE 0 END AS ip FROM h),
    v AS (SELECT page_id, CASE WHEN s = '' THEN 'high' WHEN s IN ({sql_list(D.BLOCKED_SCHEMES)}) THEN 'critical' WHEN s NOT IN ('http', 'https') THEN 'high' WHEN h = '' THEN 'high' WHEN h IN ({sql_list(D.BLOCKED_HOSTS)}) THEN 'critical' WHEN {_ranges()} THEN 'critical'
      WHEN NOT regexp_matches(h, '^[a-z0-9]([a-z0-9\-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9\-]*[a-z0-9])?)*\.?$') AND NOT contains(h, ':') THEN 'medium' WHEN port IS NOT NULL AND port NOT BETWEEN 1 AND 65535 THEN 'medium' WHEN contains(path, '../') THEN 'high' WHEN hits > 2 THEN 'high' END AS blocked,
      CASE WHEN hits >= 1 THEN 'medium' WHEN port NOT IN ({', '.join(map(str, D.ORDINARY_PORTS))}) THEN 'low' ELSE 'safe' END AS level FROM i)
    SELECT page_id, blocked IS NULL AS is_safe, coalesce(blocked, level) AS risk_level FROM v""")
def url_security(spark, d):
    odd = table(spark, d, "pages").select("page_id", F.expr(_ODD).alias("url"))
    return odd.select("page_id", urls.security(F.col("url")).alias("s")).select("page_id", "s.is_safe", "s.risk_level")


_DELAYED = f"'https://' || list_extract(['', 'www.', 'api.', 'x.y.', 'not'], page_id % 5 + 1) || list_extract([{sql_list([*D.SITE_DELAYS, 'example.com'])}], page_id % {len(D.SITE_DELAYS) + 1} + 1) || list_extract(['', ':8443', '/x'], page_id % 3 + 1)"


@query("domain_delay", rf"SELECT page_id, CASE {' '.join(f'''WHEN h = '{k}' OR ends_with(h, '.{k}') THEN {v}''' for k, v in sorted(D.SITE_DELAYS.items(), key=lambda x: -len(x[0])))} ELSE {D.DEFAULT_DELAY} END::DOUBLE AS delay FROM (SELECT page_id, regexp_extract({_DELAYED}, '^https://([^/:]*)', 1) AS h FROM pages)")
def domain_delay(spark, d):
    pick = lambda words: F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("page_id") % len(words) + 1).cast("int"))
    u = F.concat(F.lit("https://"), pick(("", "www.", "api.", "x.y.", "not")), pick([*D.SITE_DELAYS, "example.com"]), pick(("", ":8443", "/x")))
    return table(spark, d, "pages").select("page_id", urls.delay(u).alias("delay"))


_PAYWALL_HITS = " + ".join("regexp_matches(t, '(?i)" + p.replace("'", "''") + "')::INT" for p in D.PAYWALL_PATTERNS)
_PAYWALL_HOST = " OR ".join(f"h = '{h}' OR ends_with(h, '.{h}')" for h in D.PAYWALL_HOSTS).replace("h = ", "(regexp_extract(u, '^[a-z]+://([^/:?#]*)', 1)) = ").replace("ends_with(h,", "ends_with(regexp_extract(u, '^[a-z]+://([^/:?#]*)', 1),")


@query("page_paywall", rf"""WITH p AS (SELECT page_id, list_extract(['https://www.ft.com/a', 'https://x.example.org/b', 'https://news.wsj.com/gift/c', url], page_id % 4 + 1) AS u, list_extract(['', 'Please subscribe to continue', 'become a member: unlimited access', html], page_id % 5 % 4 + 1) AS t FROM pages),
    n AS (SELECT page_id, {_PAYWALL_HITS} AS n, regexp_matches(u, '(?i){'|'.join(D.PAYWALL_BYPASS)}') AS around, {_PAYWALL_HOST} AS host FROM p)
    SELECT page_id, round(CASE WHEN around THEN 0.0 WHEN host AND n > 0 THEN 0.95 WHEN n > 0 THEN least(0.95, n * 0.15 + 0.5) WHEN host THEN 0.7 ELSE 0.0 END, 6)::DOUBLE AS confidence FROM n""")
def page_paywall(spark, d):
    n = F.col("page_id")
    pick = lambda cols, m: F.element_at(F.array(*cols), (m + 1).cast("int"))
    u = pick([F.lit("https://www.ft.com/a"), F.lit("https://x.example.org/b"), F.lit("https://news.wsj.com/gift/c"), F.col("url")], n % 4)
    t = pick([F.lit(""), F.lit("Please subscribe to continue"), F.lit("become a member: unlimited access"), F.col("html")], n % 5 % 4)
    return table(spark, d, "pages").select("page_id", F.round(validation.paywall(u, t), 6).alias("confidence"))


def _existing(c: str) -> str:
    """A list of tags in the corpus dialect."""
    t = f"lower({STRIP.format(c)})"
    split = rf"CASE WHEN contains({t}, ',') THEN string_split({t}, ',') WHEN contains({t}, ';') THEN string_split({t}, ';') WHEN contains({t}, '|') THEN string_split({t}, '|') ELSE regexp_split_to_array({t}, '\s+') END"
    return f"list_transform(list_filter(list_transform({split}, lambda x: {STRIP.format('x')}), lambda x: x <> ''), lambda x: CASE WHEN x IN ('ai', 'ml', 'ui', 'ux') THEN x ELSE {_full_form('x')} END)"


_CATS = ", ".join(f"CASE WHEN 2.0 * ({' + '.join(f'contains(lower(url), {chr(39)}{w}{chr(39)})::INT' for w in ws)}) + ({' + '.join(f'contains(lower(page_title), {chr(39)}{w}{chr(39)})::INT' for w in ws)}) + 0.5 * ({' + '.join(f'contains(lower(body[1:1000]), {chr(39)}{w}{chr(39)})::INT' for w in ws)}) >= 1 THEN '{name}' END" for name, ws in D.CONTENT_CATEGORIES.items())
_FOUND_TAGS = f"tags || {sql_url_tags()} || {sql_text_tags('both_said')} || cats || {_existing('page_keywords')} || flatten(list_transform(heads[1:5], lambda h: {sql_text_tags('h')})) || {sql_text_tags('said')}"
_SAID = "concat_ws(' ', title, note, url, array_to_string(tags, ' '), page_title, said, coalesce(nullif(page_description, ''), excerpt))"


def pipeline_sql(good: str) -> str:
    """The whole enrichment: the best of each key, its page, description, tags and folder, as import rows."""
    return f"""WITH {SQL_BOOKMARKS}, dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY {good} DESC, pos DESC) AS rn FROM k) WHERE rn = 1),
    hp AS (SELECT url, arg_min(html, page_id) AS html FROM pages GROUP BY url),
    r0 AS (SELECT dd.pos, url, title, note, excerpt, folder, tags, created, concat_ws(' ', title, note) AS both_said, {SQL_TITLE} AS page_title, {_ABOUT} AS page_description, {_meta('keywords')} AS page_keywords, {SQL_BARE.format(_QUIET)} AS body, list_filter({_HEADINGS}, lambda h: len(h) > 3)[1:10] AS heads,
      coalesce(nullif(trim(note), ''), nullif(trim(excerpt), ''), nullif(trim(title), '') || ' from ' || {SQL_DOMAIN}, '') AS told FROM dd JOIN hp USING (url)),
    r1 AS (SELECT *, CASE WHEN len(told) > 150 THEN told[1:147] || '...' ELSE told END AS said, list_filter([{_CATS}], lambda x: x IS NOT NULL) AS cats FROM r0),
    c AS (SELECT DISTINCT url, unnest({sql_cleaned(_FOUND_TAGS)}) AS tag FROM r1), total AS (SELECT count(*) AS n FROM r1), f AS (SELECT tag, count(*) AS frequency FROM c GROUP BY 1 HAVING count(*) >= 2),
    u AS (SELECT f.tag, count(*) AS hits FROM f, r1 WHERE contains(lower(r1.url), f.tag) GROUP BY 1),
    ct AS (SELECT f.tag, sum(CASE WHEN list_contains(cats, f.tag) THEN 1.0 WHEN contains(lower(array_to_string(heads, chr(10))), f.tag) THEN 0.5 WHEN contains(lower(body), f.tag) THEN 0.3 ELSE 0 END) AS points FROM f, r1 GROUP BY 1),
    q AS (SELECT f.tag, frequency, coalesce(hits, 0) / n AS url_score, points / n AS content_score, (least(1.0, frequency / (n * 0.1)) + CASE WHEN len(f.tag) BETWEEN 3 AND 15 THEN 1.0 ELSE 0.5 END + CASE WHEN regexp_full_match(f.tag, '\\p{{L}}+') THEN 1.0 ELSE 0.8 END)
      * CASE WHEN f.tag IN ({sql_list(sorted({w for ws in D.TECH_KEYWORDS.values() for w in ws}))}) THEN 1.2 ELSE 1.0 END / 3.2 AS quality FROM f LEFT JOIN u USING (tag) JOIN ct USING (tag), total),
    s AS (SELECT tag, round(frequency * 0.3 + content_score * 0.4 + url_score * 0.2 + quality * 0.1, 6) AS total_score FROM q), {_CHOSEN},
    v AS (SELECT c.url, c.tag, round(least(1.0, CASE WHEN contains(lower(title), tag) THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(c.url), tag) THEN 0.2 ELSE 0 END + CASE WHEN list_contains(cats, tag) THEN 0.4 WHEN contains(lower(array_to_string(heads, chr(10))), tag) THEN 0.2 ELSE 0 END
      + CASE WHEN contains(array_to_string(tags, ' '), tag) THEN 0.1 ELSE 0 END), 6) AS relevance FROM c JOIN chosen USING (tag) JOIN r1 ON r1.url = c.url),
    z AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY relevance DESC, tag) AS place FROM v), best AS (SELECT url, list(tag ORDER BY place) AS optimized FROM z WHERE place <= 5 GROUP BY 1),
    {categorised_sql('r1', _SAID)}, {FILED}, o AS (SELECT r1.*, path, CASE WHEN len(coalesce(optimized, [])) > 0 THEN optimized ELSE tags[1:5] END AS final FROM r1 JOIN filed USING (pos) LEFT JOIN best ON best.url = r1.url)
    SELECT url, path AS folder, CASE WHEN trim(title) = '' THEN regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) ELSE title END AS title, coalesce(nullif(trim(said), ''), nullif(trim(note), ''), nullif(trim(excerpt), ''), '') AS note,
      CASE len(final) WHEN 0 THEN '' WHEN 1 THEN final[1] ELSE '"' || array_to_string(final, ', ') || '"' END AS tags, coalesce(strftime(created, '%Y-%m-%dT%H:%M:%SZ'), '') AS created FROM o"""
