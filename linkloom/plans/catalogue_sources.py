"""Queries that write the tables as files of every format and read them back, with their DuckDB SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import predicates, reports
from ..sources import csv, datasource, detect, export, netscape
from .registry import query
from .tables import SQL_BOOKMARKS, SQL_PATH, bookmarks, put_text, scratch, table

_IDENTITY = rf"""lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) || regexp_replace({SQL_PATH}, '/+$', '')
    || CASE WHEN contains(url, '?') THEN '?' || array_to_string(list_sort(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')), '&') ELSE '' END || regexp_extract(url, '(#.*)$', 1)"""


def _exported(spark, d, label: str) -> str:
    """The rows as an export file of eleven columns."""
    path = scratch(spark, label)
    csv.as_export(bookmarks(spark, d)).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return path


@query("csv_export_ids", f"WITH {SQL_BOOKMARKS} SELECT row_number() OVER (ORDER BY pos)::VARCHAR AS id, url, title, folder, array_to_string(tags, ', ') AS tags FROM b")
def csv_export_ids(spark, d):
    return csv.as_export(bookmarks(spark, d)).select("id", "url", "title", "folder", "tags")


@query("csv_round_trip", f"""WITH {SQL_BOOKMARKS} SELECT row_number() OVER (ORDER BY pos)::VARCHAR AS id, url, title, note, excerpt, folder, array_to_string(tags, '|') AS tags, created, false AS favorite, {_IDENTITY} AS normalized_url,
    len(list_filter(string_split(folder, '/'), lambda x: x <> ''))::INT AS depth FROM b""")
def csv_round_trip(spark, d):
    rows = csv.import_bookmarks(spark, _exported(spark, d, "export"), "strict").rows
    return rows.select("id", "url", "title", "note", "excerpt", "folder", F.array_join("tags", "|").alias("tags"), F.col("created").cast("timestamp_ntz").alias("created"), "favorite", "normalized_url", F.size("folder_hierarchy").alias("depth"))


_BROKEN = "CASE WHEN page_id % 10 = 3 THEN 'not a url' WHEN page_id % 10 = 4 THEN '' ELSE url END"


def _broken(spark, d, label: str) -> str:
    """An export with malformed and missing URLs, blank titles and repeated ids."""
    n = F.col("id").cast("long")
    rows = csv.as_export(bookmarks(spark, d)).withColumns({"url": F.when(n % 10 == 3, "not a url").when(n % 10 == 4, "").otherwise(F.col("url")), "title": F.when(n % 3 == 0, " ").otherwise(F.col("title")), "id": F.when(n % 5 == 0, "same").otherwise(F.col("id"))})
    path = scratch(spark, label)
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return path


_NUMBERED = f"{SQL_BOOKMARKS}, e AS (SELECT *, row_number() OVER (ORDER BY pos) AS n FROM b)"


@query("csv_quality", f"WITH {_NUMBERED} SELECT count(*) AS rows, 0::BIGINT AS blank_rows, count(*) FILTER (n % 10 = 4) AS blank_url, count(*) FILTER (n % 3 = 0 OR title = '') AS blank_title, greatest(0, count(*) FILTER (n % 5 = 0) - 1)::BIGINT AS repeated_ids, count(*) FILTER (n % 10 IN (3, 4)) AS bad_urls FROM e")
def csv_quality(spark, d):
    q = csv.quality(csv.read_export(spark, _broken(spark, d, "broken"), strict=False))
    return spark.createDataFrame([tuple(q[c] for c in ("rows", "blank_rows", "blank_url", "blank_title", "repeated_ids", "bad_urls"))], "rows long, blank_rows long, blank_url long, blank_title long, repeated_ids long, bad_urls long")


@query("csv_import_modes", f"WITH {_NUMBERED} SELECT 'best_effort' AS mode, count(*) FILTER (n % 10 <> 4) AS kept, count(*) FILTER (n % 10 = 4) AS rejected FROM e UNION ALL SELECT 'permissive', count(*) FILTER (n % 10 <> 4), count(*) FILTER (n % 10 = 4) FROM e UNION ALL SELECT 'max_errors', 0, 0 UNION ALL SELECT 'strict', 0, 0")
def csv_import_modes(spark, d):
    """Blank URLs are rejected in both lenient modes (a word gets a scheme and counts as a host); the strict one, and more bad rows than allowed, are errors."""
    path, told = _broken(spark, d, "modes"), []
    for mode, most in (("best_effort", None), ("permissive", None), ("max_errors", 1), ("strict", None)):
        try:
            got = csv.import_bookmarks(spark, path, "best_effort" if mode == "max_errors" else mode, most)
            told.append((mode, got.rows.count(), got.rejected.count()))
        except csv.ExportError:
            told.append((mode, 0, 0))
    return spark.createDataFrame(told, "mode string, kept long, rejected long")


@query("csv_diagnosis", "SELECT 'broken' AS file, true AS found, 'best_effort' AS mode, 'UTF-8' AS encoding, 0 AS structure UNION ALL SELECT 'sample', true, 'strict', 'UTF-8', 0 UNION ALL SELECT 'latin', true, 'permissive', 'ISO-8859-1', 8 UNION ALL SELECT 'gone', false, 'best_effort', '', 0")
def csv_diagnosis(spark, d):
    """Three files and a missing one: ids repeat in the broken one, which is one problem; another one lacks nine columns and has one too many."""
    sample, latin = scratch(spark, "sample"), scratch(spark, "latin")
    csv.sample_export(spark).coalesce(1).write.option("header", True).option("quoteAll", True).csv(sample)
    bookmarks(spark, d).select("url", F.lit("café").alias("title"), F.lit("x").alias("extra")).coalesce(1).write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(latin)
    told = []
    for name, path in (("broken", _broken(spark, d, "diagnosed")), ("sample", sample), ("latin", latin), ("gone", latin + "-none")):
        got = csv.diagnose(spark, path)
        told.append((name, got["exists"], csv.recommended_mode(got), got.get("encoding", ""), len([e for e in got.get("structure", []) if e.startswith("missing")]) - (len(got.get("structure", [])) > 0)))
    return spark.createDataFrame(told, "file string, found boolean, mode string, encoding string, structure int")


@query("csv_recovered", f"WITH {SQL_BOOKMARKS} SELECT url, 'café ' || pos AS title, folder, '' AS note, 0::INT AS n_tags FROM b")
def csv_recovered(spark, d):
    """A file in another encoding, separator and case, without most columns."""
    path = scratch(spark, "short")
    bookmarks(spark, d).select(F.col("url").alias(" URL"), F.concat(F.lit("café "), F.col("pos").cast("string")).alias("Title"), F.col("folder").alias("FOLDER "), F.lit("").alias("id"), F.lit("").alias("created")).write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").option("quoteAll", True).csv(path)
    rows = csv.import_bookmarks(spark, path, "permissive").rows
    return rows.select("url", "title", "folder", "note", F.size("tags").alias("n_tags"))


@query("csv_import_file", f"""WITH {SQL_BOOKMARKS} SELECT url, folder, CASE WHEN trim(title) = '' THEN regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) ELSE title END AS title, note,
    CASE len(tags) WHEN 0 THEN '' WHEN 1 THEN tags[1] ELSE '"' || array_to_string(tags, ', ') || '"' END AS tags, coalesce(strftime(created, '%Y-%m-%dT%H:%M:%SZ'), '') AS created FROM b""")
def csv_import_file(spark, d):
    path = scratch(spark, "import")
    csv.write_import(bookmarks(spark, d), path)
    return csv.read_raw(spark, path, separator=",").drop("pos")


@query("multi_file_union", f"WITH {SQL_BOOKMARKS} SELECT 'csv' AS kind, count(*) AS n, count(DISTINCT url) AS n_urls FROM b UNION ALL SELECT 'html', count(*), count(DISTINCT url) FROM b UNION ALL SELECT 'unreadable', 0, 0")
def multi_file_union(spark, d):
    """A CSV export, a browser file and a text of neither kind, found and read as one collection."""
    root = scratch(spark, "many")
    csv.as_export(bookmarks(spark, d)).coalesce(1).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(f"{root}/rows")
    put_text(spark, f"{root}/b.html", netscape.generate(bookmarks(spark, d)))
    put_text(spark, f"{root}/c.csv", "nothing of use\n")
    found = [*detect.find_files(spark, f"{root}/rows"), *detect.find_files(spark, root), f"{root}/c.csv"]
    rows, told = detect.read_many(spark, found)
    kind = F.when(F.col("source_file").endswith(".html"), "html").otherwise("csv")
    counts = rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("url").alias("n_urls"))
    return counts.unionByName(spark.createDataFrame([("unreadable", 0, 0) for t in told if not t["ok"]], "kind string, n long, n_urls long"))


@query("netscape_round_trip", rf"""WITH {SQL_BOOKMARKS} SELECT url, regexp_replace(title, '^\s+|\s+$', '', 'g') AS title, array_to_string(list_filter(string_split(folder, '/'), lambda x: x <> ''), '/') AS folder, coalesce(created, TIMESTAMP '1970-01-01') AS created FROM b""")
def netscape_round_trip(spark, d):
    path = put_text(spark, scratch(spark, "netscape") + ".html", netscape.generate(bookmarks(spark, d)))
    return netscape.read(spark, path).select("url", "title", "folder", F.col("created").cast("timestamp_ntz").alias("created"))


@query("file_formats", "SELECT 'csv' AS name, 'csv' AS kind UNION ALL SELECT 'html', 'netscape' UNION ALL SELECT 'plain.html', 'unknown' UNION ALL SELECT 'text', 'unknown'")
def file_formats(spark, d):
    root = scratch(spark, "formats")
    head = "id,title,url,folder,tags,created\n1,a,https://a.com,,,\n"
    files = {"csv": head, "html": netscape.generate(bookmarks(spark, d).limit(3)), "plain.html": "<p>no links</p>", "text": "some text\n"}
    return spark.createDataFrame([(n, detect.detect_format(spark, put_text(spark, f"{root}/{n}", said))) for n, said in files.items()], "name string, kind string")


# Collections with a key.
_KEYED = f"{SQL_BOOKMARKS}, c AS (SELECT *, {_IDENTITY} AS key FROM b)"


@query("collection_updated", f"""WITH {_KEYED}, ch AS (SELECT key, arg_max(pos, pos) AS pos FROM c WHERE pos % 3 = 0 GROUP BY key) SELECT key AS normalized_url, note FROM c WHERE key NOT IN (SELECT key FROM ch) UNION ALL SELECT key, 'changed ' || pos FROM ch""")
def collection_updated(spark, d):
    rows = bookmarks(spark, d)
    changes = rows.where("pos % 3 = 0").withColumn("note", F.concat(F.lit("changed "), F.col("pos").cast("string")))
    unknown = changes.limit(1).withColumns({"url": F.lit("https://nowhere.example/x")})
    after, told = datasource.Collection(rows).updated(changes.unionByName(unknown))
    return after.rows.select("normalized_url", "note")


@query("collection_update_report", f"WITH {_KEYED} SELECT true AS ok, count(DISTINCT key) AS n FROM c WHERE pos % 3 = 0 UNION ALL SELECT false, 1")
def collection_update_report(spark, d):
    rows = bookmarks(spark, d)
    changes = rows.where("pos % 3 = 0")
    _, told = datasource.Collection(rows).updated(changes.unionByName(changes.limit(1).withColumn("url", F.lit("https://nowhere.example/x"))))
    return told.groupBy("ok").agg(F.count("*").alias("n"))


@query("collection_added_removed", f"WITH {_KEYED}, a AS (SELECT * FROM c WHERE pos % 2 = 0), z AS (SELECT * FROM a UNION ALL SELECT * FROM c WHERE key NOT IN (SELECT key FROM a)) SELECT key AS normalized_url, pos FROM z WHERE key NOT IN (SELECT key FROM c WHERE pos % 7 = 0)")
def collection_added_removed(spark, d):
    rows = bookmarks(spark, d)
    return datasource.Collection(rows.where("pos % 2 = 0")).added(rows).removed(rows.where("pos % 7 = 0")).fetch().select("normalized_url", "pos")


@query("collection_fetched", f"WITH {_KEYED}, f AS (SELECT url FROM b ORDER BY pos LIMIT 1) SELECT key AS normalized_url, pos, 'ai' AS why FROM c WHERE list_contains(tags, 'ai') UNION ALL SELECT key, 0, 'one' FROM (SELECT DISTINCT key FROM c WHERE url = (SELECT url FROM f))")
def collection_fetched(spark, d):
    rows = bookmarks(spark, d)
    held = datasource.Collection(rows)
    first = rows.orderBy("pos").first().url
    one = held.by_url(first).select("normalized_url", F.lit(0).cast("long").alias("pos"), F.lit("one").alias("why"))
    return held.fetch(predicates.tag(["ai"])).select("normalized_url", "pos", F.lit("ai").alias("why")).unionByName(one)


@query("api_items", f"WITH {SQL_BOOKMARKS} SELECT pos::VARCHAR AS id, url, title, note, r_name AS folder, array_to_string(tags, ',') AS tags, created, pos % 2 = 0 AS favorite FROM b JOIN region ON r_regionkey = pos % 5")
def api_items(spark, d):
    n = F.col("pos")
    item = F.struct(n.alias("_id"), F.col("url").alias("link"), "title", "excerpt", "note", "tags", F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created"), (n % 2 == 0).alias("important"), (n % 5).alias("collectionId"))
    named = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("collectionId"), F.col("r_name").alias("folder"))
    rows = datasource.items(bookmarks(spark, d).select(F.to_json(item).alias("j")), "j", named)
    return rows.select("id", "url", "title", "note", "folder", F.array_join("tags", ",").alias("tags"), F.col("created").cast("timestamp_ntz").alias("created"), "favorite")


@query("api_updates", f"WITH {SQL_BOOKMARKS} SELECT pos, nullif(title, '') AS title, nullif(note, '') AS note, nullif(excerpt, '') AS excerpt, len(tags)::INT AS n_tags FROM b")
def api_updates(spark, d):
    body = F.from_json(datasource.sparse_update(), "title string, note string, excerpt string, tags array<string>")
    return bookmarks(spark, d).select("pos", body.alias("b")).select("pos", "b.title", "b.note", "b.excerpt", F.size(F.coalesce("b.tags", F.array().cast("array<string>"))).alias("n_tags"))


@query("api_pages", "SELECT i AS id, 'page ' || (i // 50) AS title FROM (SELECT unnest(range(0, 50 * least(9, (SELECT count(*) FROM region) + 2))) AS i)")
def api_pages(spark, d):
    n = table(spark, d, "region").count() + 2

    def fetch(page: int, size: int) -> list[str]:
        return [json.dumps({"_id": page * size + i, "link": f"https://a.com/{page}/{i}", "title": f"page {page}"}) for i in range(size)] if page < n else []

    rows = datasource.items(datasource.paged(spark, fetch, slices=3), "item")
    return rows.select(F.col("id").cast("long").alias("id"), "title")


@query("api_pushed", f"WITH {SQL_BOOKMARKS} SELECT pos, note <> '' AS ok FROM b")
def api_pushed(spark, d):
    """Batches that hold a row without a note fail, and are sent again one by one."""

    def send(bodies: list[str]) -> list[bool]:
        told = ["note" in json.loads(b) for b in bodies]
        if not all(told) and len(bodies) > 1:
            raise OSError("refused")
        return told

    rows = bookmarks(spark, d).withColumn("url", F.col("pos").cast("string"))
    return datasource.push(rows, send, batch=7).select(F.col("url").cast("long").alias("pos"), "ok")


@query("api_since_last_run", f"WITH {SQL_BOOKMARKS} SELECT pos FROM b WHERE created > TIMESTAMP '2024-03-01'")
def api_since_last_run(spark, d):
    day = lambda s: F.lit(s).cast("timestamp")
    runs = spark.range(3).select(F.lit("service").alias("source"), F.when(F.col("id") == 0, day("2024-02-01")).when(F.col("id") == 1, day("2024-03-01")).otherwise(day("2024-04-01")).alias("started_at"), F.when(F.col("id") < 2, day("2024-04-01")).alias("completed_at"))
    return datasource.since_last_run(bookmarks(spark, d), runs, "service").select("pos")


@query("api_backup", f"WITH {_KEYED} SELECT url, title, note, folder, array_to_string(tags, ',') AS tags, created, key AS normalized_url FROM c")
def api_backup(spark, d):
    path = scratch(spark, "backup")
    datasource.write_backup(bookmarks(spark, d), path)
    return datasource.read_backup(spark, path).select("url", "title", "note", "folder", F.array_join("tags", ",").alias("tags"), F.col("created").cast("timestamp_ntz").alias("created"), "normalized_url")


# Other formats.
@query("json_rows", f"WITH {SQL_BOOKMARKS} SELECT url, title, array_to_string(tags, ',') AS tags FROM b")
def json_rows(spark, d):
    path = scratch(spark, "json")
    export.write_json_rows(bookmarks(spark, d), path, minimal=True)
    return spark.read.schema("url string, title string, tags array<string>").json(path).select("url", "title", F.array_join("tags", ",").alias("tags"))


@query("json_objects", f"WITH {SQL_BOOKMARKS} SELECT url, title, folder, array_to_string(tags, ',') AS tags, created, note, excerpt FROM b")
def json_objects(spark, d):
    path = scratch(spark, "json")
    export.write_json_rows(bookmarks(spark, d), path)
    rows = spark.read.schema("url string, title string, folder string, tags array<string>, created timestamp, note string, excerpt string").json(path)
    return rows.withColumns({"tags": F.array_join("tags", ","), "created": F.col("created").cast("timestamp_ntz")})


_SHOWN = "CASE WHEN trim(title) = '' THEN regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) ELSE title END"


@query("markdown_folders", f"WITH {SQL_BOOKMARKS} SELECT CASE WHEN folder = '' THEN 'Unsorted' ELSE folder END AS folder, '- [' || {_SHOWN} || '](' || url || ')' || CASE WHEN len(tags) > 0 THEN ' `' || array_to_string(tags, '` `') || '`' ELSE '' END || CASE WHEN note <> '' THEN chr(10) || '  ' || note ELSE '' END AS line FROM b")
def markdown_folders(spark, d):
    return bookmarks(spark, d).select(F.coalesce(F.nullif("folder", F.lit("")), F.lit("Unsorted")).alias("folder"), export.markdown_line().alias("line"))


@query("markdown_written", f"WITH {SQL_BOOKMARKS} SELECT CASE WHEN folder = '' THEN 'Unsorted' ELSE folder END AS folder, count(*) AS n FROM b GROUP BY 1")
def markdown_written(spark, d):
    """A directory per folder, read back."""
    path = scratch(spark, "markdown")
    export.write_markdown_folders(bookmarks(spark, d), path)
    lines = spark.read.option("basePath", path).text(path).where(F.col("value").startswith("- ["))
    return lines.groupBy(F.col("folder").cast("string").alias("folder")).agg(F.count("*").alias("n"))


@query("vault_notes", rf"""WITH {SQL_BOOKMARKS}, f AS (SELECT *, {_SHOWN} AS shown FROM b) SELECT url, md5('---' || chr(10) || 'title: "' || replace(replace(replace(shown, '\', '\\'), '"', '\"'), chr(10), ' ') || '"' || chr(10) || 'url: "' || replace(replace(url, '\', '\\'), '"', '\"') || '"' || chr(10) || 'tags:' || chr(10)
    || array_to_string(list_transform(tags, lambda t: '  - ' || t), chr(10)) || chr(10) || '---' || chr(10) || chr(10) || '# ' || shown || chr(10) || chr(10) || note || chr(10)) AS note_md5 FROM f""")
def vault_notes(spark, d):
    return bookmarks(spark, d).select("url", F.md5(export.vault_note().cast("binary")).alias("note_md5"))


@query("vault_files", f"WITH {SQL_BOOKMARKS}, f AS (SELECT CASE WHEN folder = '' THEN 'Unsorted' ELSE folder END AS folder FROM b) SELECT folder || '/_index.md' AS place, count(*) AS n FROM f GROUP BY 1 UNION ALL SELECT folder || '/', count(*) FROM f GROUP BY folder UNION ALL SELECT '_map.md', least(10, (SELECT count(created) FROM b))")
def vault_files(spark, d):
    """Entries of every index and of the map, and notes of every folder; no two notes share a path."""
    files = export.vault_files(bookmarks(spark, d)).dropDuplicates(["path"])
    links = F.regexp_count("value", F.lit(r"\[\["))
    listed = files.where("path LIKE '%\\_index.md' OR path = '_map.md'").select(F.col("path").alias("place"), links.cast("long").alias("n"))
    notes = files.where("path NOT LIKE '%\\_index.md' AND path <> '_map.md'").groupBy(F.regexp_extract("path", "^(.*/)", 1).alias("place")).agg(F.count("*").alias("n"))
    return listed.unionByName(notes)


_LABELS = "CASE WHEN pos % 7 = 0 THEN 'Error' WHEN pos % 5 = 0 THEN 'Processed' WHEN pos % 2 = 0 THEN 'Validated' ELSE 'Pending' END"


@query("table_import", f"""WITH {SQL_BOOKMARKS} SELECT url AS "URL", {_SHOWN} AS "Name", note AS "Notes", folder AS "Folder", array_to_string(tags, ', ') AS "Tags", coalesce(strftime(created, '%Y-%m-%d'), '') AS "Created", {_LABELS} AS "Status" FROM b""")
def table_import(spark, d):
    n = F.col("pos")
    status = F.struct((n % 2 == 0).alias("url_validated"), F.when(n % 7 == 0, "bad").alias("url_validation_error"), F.lit(None).cast("string").alias("content_extraction_error"), (n % 5 == 0).alias("ai_processed"), F.lit(None).cast("string").alias("ai_processing_error"))
    path = scratch(spark, "table")
    export.write_table(bookmarks(spark, d).withColumn("processing_status", status), path)
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).fillna("")


_XML = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query("outline_rows", f"""WITH {SQL_BOOKMARKS}, o AS (SELECT pos, {_XML.format(_SHOWN)} AS t, {_XML.format('url')} AS u FROM b) SELECT '<outline text="' || t || '" title="' || t || '" type="link" htmlUrl="' || u || '"/>' AS line FROM o
    UNION ALL SELECT '<outline text="' || t || '" title="' || t || '" type="rss" xmlUrl="https://feed.example/' || pos || '" htmlUrl="' || u || '"/>' FROM o WHERE pos % 4 = 0""")
def outline_rows(spark, d):
    """Links, and feeds of every fourth row; feeds are looked up by URL, which gets the position so that rows stay apart."""
    rows, flat, feeds = bookmarks(spark, d), scratch(spark, "outline"), scratch(spark, "feeds")
    export.write_outlines(rows, flat)
    some = rows.where("pos % 4 = 0")
    told = F.concat(F.col("url"), F.lit("\u0001"), F.col("pos").cast("string"))
    export.write_outlines(some.withColumn("url", told), feeds, some.select(told.alias("url"), F.concat(F.lit("https://feed.example/"), F.col("pos").cast("string")).alias("feed_url")))
    lines = spark.read.text(feeds).select(F.regexp_replace("value", "\u0001[0-9]+", "").alias("value"))
    return spark.read.text(flat).unionByName(lines).select(F.col("value").alias("line"))


@query("outline_nested", f"WITH {SQL_BOOKMARKS} SELECT count(*) AS links, (SELECT count(DISTINCT p) FROM (SELECT unnest([array_to_string(ps[1:i], '/') for i in range(1, len(ps) + 1)]) AS p FROM (SELECT list_filter(string_split(folder, '/'), lambda x: x <> '') AS ps FROM b))) AS folders FROM b")
def outline_nested(spark, d):
    path = put_text(spark, scratch(spark, "nested") + ".opml", export.outline_document(bookmarks(spark, d)))
    lines = spark.read.text(path)
    return lines.agg(F.count_if(F.col("value").contains("htmlUrl=")).alias("links"), F.count_if(F.col("value").startswith("<outline") & ~F.col("value").contains("htmlUrl=")).alias("folders"))


@query("export_warnings", f"WITH {SQL_BOOKMARKS} SELECT count(*) FILTER (trim(url) = '') || ' rows without a url' AS said FROM b HAVING count(*) FILTER (trim(url) = '') > 0 UNION ALL SELECT count(*) FILTER (pos % 3 = 0 OR trim(title) = '') || ' rows without a title' FROM b HAVING count(*) FILTER (pos % 3 = 0 OR trim(title) = '') > 0")
def export_warnings(spark, d):
    rows = bookmarks(spark, d).withColumn("title", F.when(F.col("pos") % 3 == 0, " ").otherwise(F.col("title")))
    return spark.createDataFrame([(w,) for w in export.warnings(rows)], "said string")


@query("review_file", f"WITH {SQL_BOOKMARKS} SELECT url, title, CASE WHEN pos % 2 = 0 THEN 'even; checked' ELSE 'checked' END AS reasons FROM b")
def review_file(spark, d):
    path = scratch(spark, "review")
    export.write_review(bookmarks(spark, d).withColumn("reasons", F.when(F.col("pos") % 2 == 0, F.array(F.lit("even"), F.lit("checked"))).otherwise(F.array(F.lit("checked")))), path)
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).fillna("")


_CHECKS = "SELECT page_id AS url, CASE page_id % 5 WHEN 0 THEN 'dead' WHEN 1 THEN 'error' WHEN 2 THEN 'redirected' ELSE 'healthy' END AS status FROM pages"


def _checks(spark, d):
    n = F.col("page_id")
    return table(spark, d, "pages").select(n.alias("url"), F.when(n % 5 == 0, "dead").when(n % 5 == 1, "error").when(n % 5 == 2, "redirected").otherwise("healthy").alias("status"))


@query("health_report", f"WITH c AS ({_CHECKS}) SELECT CASE status WHEN 'error' THEN 'dead' ELSE status END || ': ' || count(*) AS line FROM c GROUP BY CASE status WHEN 'error' THEN 'dead' ELSE status END UNION ALL (SELECT '- ' || url || ' (' || status || ')' FROM c WHERE status IN ('dead', 'error') ORDER BY url LIMIT 20)")
def health_report(spark, d):
    path = scratch(spark, "health")
    export.write_health(_checks(spark, d), path, "text")
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("health_rows", f"{_CHECKS}")
def health_rows(spark, d):
    path = scratch(spark, "health")
    export.write_health(_checks(spark, d), path, "csv")
    return spark.read.option("header", True).schema("url long, status string").csv(path)


@query("review_union", "WITH r AS (SELECT doc_id, 1 AS i FROM documents WHERE n_chars < 500 UNION SELECT doc_id, 2 FROM labels WHERE quality = 0 UNION SELECT doc_id, 3 FROM labels WHERE toxic = 1) SELECT doc_id, list_extract(['short', 'junk', 'toxic'], min(i)) AS bucket, string_agg(list_extract(['short', 'junk', 'toxic'], i), ',' ORDER BY i) AS reasons FROM r GROUP BY 1")
def review_union(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    told = reports.review_list([("short", docs.where("n_chars < 500")), ("junk", labels.where("quality = 0")), ("toxic", labels.where("toxic = 1"))], "doc_id")
    return told.withColumn("reasons", F.array_join("reasons", ","))


@query("directory_report", "SELECT 'csv' AS kind, 2 AS n, true AS usable UNION ALL SELECT 'netscape', 1, true UNION ALL SELECT 'none', 0, false")
def directory_report(spark, d):
    root, empty = scratch(spark, "directory"), scratch(spark, "empty")
    put_text(spark, f"{empty}/a.txt", "x")
    put_text(spark, f"{root}/b.html", netscape.generate(bookmarks(spark, d).limit(3)))
    for name in ("a.csv", "c.csv"):
        put_text(spark, f"{root}/{name}", "id,title,url,folder,tags,created\n1,a,https://a.com,,,\n")
    put_text(spark, f"{root}/d.csv", "")
    told, none = detect.directory_report(spark, root), detect.directory_report(spark, empty)
    kinds = list(told["formats"].values())
    rows = [(k, kinds.count(k), told["usable"]) for k in sorted(set(kinds))] + [("none", len(none["files"]), none["usable"])]
    return spark.createDataFrame(rows, "kind string, n int, usable boolean")


@query("report_rendered", f"""WITH {SQL_BOOKMARKS}, t AS (SELECT count(*) AS n FROM b) SELECT 'plain' AS style, 'Export' || chr(10) || '======' || chr(10) || 'rows   ' || n || chr(10) || 'names  x' AS said FROM t
    UNION ALL SELECT 'markdown', '# Export' || chr(10) || chr(10) || '| | |' || chr(10) || '|---|---|' || chr(10) || '| rows | ' || n || ' |' || chr(10) || '| names | x |' FROM t UNION ALL SELECT 'json', '{{"title": "Export", "rows": ' || n || ', "names": "x"}}' FROM t""")
def report_rendered(spark, d):
    facts = {"rows": bookmarks(spark, d).count(), "names": "x"}
    return spark.createDataFrame([(style, export.render("Export", facts, style)) for style in ("plain", "markdown", "json")], "style string, said string")


@query("json_document", f"WITH {SQL_BOOKMARKS} SELECT count(*) AS total, count(DISTINCT CASE WHEN folder = '' THEN 'Unsorted' ELSE folder END)::INT AS folders, count(*)::INT AS items, count(created) AS with_dates FROM b")
def json_document(spark, d):
    """The one document, written on the driver's machine and read back there."""
    import tempfile

    with tempfile.TemporaryDirectory() as local:
        export.write_json_document(bookmarks(spark, d), f"{local}/all.json", "2024-06-01")
        with open(f"{local}/all.json", encoding="utf-8") as f:
            told = json.load(f)
    return spark.createDataFrame([(told["export_info"]["total"], len(told["by_folder"]), len(told["bookmarks"]), told["statistics"]["with_dates"])], "total long, folders int, items int, with_dates long")
