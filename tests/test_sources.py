import pytest
from pyspark.sql import functions as F

from linkloom.operators import bookmarks, predicates
from linkloom.sources import csv, datasource, detect, export, netscape

HEADER = "id,title,note,excerpt,url,folder,tags,created,cover,highlights,favorite\n"
GOOD = HEADER + (
    '1,"One, two","say ""hi""\nthere",,https://a.example.com/x,Tech/AI,"ai, ml",2024-01-01T00:00:00Z,,,true\n'
    "2,Second,,ex,http://b.example.org/,,news,2024-02-01T00:00:00Z,,,false\n"
)


@pytest.fixture
def write(tmp_path):
    def make(name, content, encoding="utf-8"):
        path = tmp_path / name
        path.write_bytes(content.encode(encoding))
        return str(path)

    return make


def test_read_export(spark, write):
    rows = csv.read_export(spark, write("a.csv", GOOD)).orderBy("pos").collect()
    assert rows[0].title == "One, two" and rows[0].note == 'say "hi"\nthere' and rows[1].folder == ""


@pytest.mark.parametrize(("encoding", "separator"), [("utf-8-sig", ","), ("utf-16", ";"), ("latin-1", "\t")])
def test_encodings_and_separators(spark, write, encoding, separator):
    content = GOOD.replace("Second", "Zwölf") if separator == "," else HEADER.replace(",", separator) + separator.join(["2", "Zwölf", "", "", "http://b.example.org/", "", "n", "", "", "", ""]) + "\n"
    got = {r.title for r in csv.import_bookmarks(spark, write("e.csv", content, encoding)).rows.collect()}
    assert "Zwölf" in got


def test_structure_and_quality_errors(spark, write):
    with pytest.raises(csv.ExportError, match="missing column"):
        csv.read_export(spark, write("s.csv", "id,title\n1,x\n"))
    with pytest.raises(csv.ExportError, match="without a URL"):
        csv.read_export(spark, write("u.csv", HEADER + "1,t,,,,,,,,,\n"))
    with pytest.raises(csv.ExportError, match="repeated ids"):
        csv.read_export(spark, write("d.csv", HEADER + "1,t,,,https://a.com,,,,,,\n1,t,,,https://b.com,,,,,,\n"))
    loose = csv.read_export(spark, write("l.csv", "id,title,url\n1,x,https://a.com\n"), strict=False)
    assert loose.first().favorite == ""


def test_modes_and_diagnosis(spark, write):
    path = write("m.csv", HEADER + "1,t,,,https://a.com,,,,,,\n2,t,,,not a url,,,,,,\n")
    best = csv.import_bookmarks(spark, path)
    assert best.rows.count() >= 1 and csv.recommended_mode(csv.diagnose(spark, path)) in ("strict", "best_effort")
    assert not csv.diagnose(spark, path + ".none")["exists"]


def test_import_file_round_trip(spark, write, tmp_path):
    rows = csv.import_bookmarks(spark, write("a.csv", GOOD)).rows
    out = str(tmp_path / "out.csv")
    assert csv.write_import_file(rows.orderBy("pos"), out) == 2
    raw = open(out, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbf") and b'"""ai, ml"""' in raw
    csv.write_import(rows, str(tmp_path / "parts"))
    assert spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "parts")).count() == 2
    assert [r.id for r in csv.as_export(rows).orderBy(F.col("id").cast("int")).collect()] == ["1", "2"]


NETSCAPE = """<!DOCTYPE NETSCAPE-Bookmark-file-1>
<DL><p><DT><H3 PERSONAL_TOOLBAR_FOLDER="true">Bar</H3><DL><p><DT><A HREF="https://a.com/" ADD_DATE="1704067200">A &amp; a</A>
<DT><H3>Sub</H3><DL><p><DT><A HREF="https://b.com/">B</A></DL><p></DL><p><DT><A HREF="https://c.com/">C</A>
<DT><H3>One</H3><DL><p><DT><H3>Two</H3><DL><p><DT><A HREF="https://d.com/">D</A></DL><p></DL><p></DL><p>"""


def test_netscape(spark, write):
    path = write("b.html", NETSCAPE)
    rows = {r.url: r for r in netscape.read(spark, path).collect()}
    assert {u: r.folder for u, r in rows.items()} == {"https://a.com/": "", "https://b.com/": "Sub", "https://c.com/": "", "https://d.com/": "One/Two"}
    assert rows["https://a.com/"].title == "A & a" and str(rows["https://a.com/"].created) == "2024-01-01 00:00:00"
    again = netscape.parse(netscape.generate(netscape.read(spark, path)))
    assert sorted((u, f) for u, _, f, _ in again) == sorted((u, r.folder) for u, r in rows.items())


def test_detect_and_many_files(spark, write, tmp_path):
    write("a.csv", GOOD), write("b.html", NETSCAPE), write("c.csv", "x\n1\n")
    files = detect.find_files(spark, str(tmp_path))
    assert [f.rsplit("/", 1)[1] for f in files] == ["a.csv", "b.html"]
    rows, told = detect.read_many(spark, [*files, str(tmp_path / "c.csv")])
    assert rows.count() == 6 and [t["ok"] for t in told] == [True, True, False]


@pytest.fixture
def rows(spark):
    data = [(0, "https://a.com/1", "A one", "note", "Tech/AI", ["ai", "ml"]), (1, "https://b.com/2", "B <two>", None, "", ["ai"]), (2, "https://c.com/3", None, "", "Tech", [])]
    made = spark.createDataFrame(data, "pos long, url string, title string, note string, folder string, tags array<string>")
    return made.withColumns({"excerpt": F.lit(""), "created": F.lit("2024-01-01").cast("timestamp"), "favorite": F.lit(False)})


def test_exports(spark, rows, tmp_path):
    import json
    import xml.etree.ElementTree as ET

    export.write_json_document(rows, str(tmp_path / "d.json"), "now")
    doc = json.load(open(tmp_path / "d.json"))
    assert doc["statistics"]["total"] == 3 and len(doc["bookmarks"]) == 3 and doc["by_folder"]["Unsorted"] == 1
    export.write_markdown(rows, str(tmp_path / "m.md"))
    assert "## Tech/AI" in open(tmp_path / "m.md").read()
    tree = ET.fromstring(export.outline_document(rows).split("\n", 1)[1])
    assert len(tree.findall(".//outline[@htmlUrl]")) == 3
    assert export.write_files(export.vault_files(rows), str(tmp_path / "vault")) == 3 + 3 + 1
    export.write_table(rows, str(tmp_path / "t"), relations=True)
    table = spark.read.option("header", True).csv(str(tmp_path / "t")).collect()
    assert {r.URL: r.Related for r in table}["https://a.com/1"] == "B <two>"
    export.write_json_rows(rows, str(tmp_path / "j"), minimal=True), export.write_markdown_folders(rows, str(tmp_path / "mf")), export.write_outlines(rows, str(tmp_path / "o"))
    assert export.warnings(rows) == ["1 rows without a title"]


def test_collection(spark, rows):
    c = datasource.Collection(rows)
    assert c.fetch(predicates.tag(["ml"])).count() == 1 and c.by_url("https://a.com/1/").count() == 1
    change = rows.limit(1).withColumn("title", F.lit("new")).unionByName(rows.limit(1).withColumn("url", F.lit("https://zzz.com")))
    after, told = c.updated(change)
    assert sorted(r.ok for r in told.collect()) == [False, True] and after.rows.where("title = 'new'").count() == 1
    assert after.added(change).rows.count() == 4 and after.removed(rows.limit(1)).rows.count() == 2


def test_items_and_push(spark, rows, tmp_path):
    raw = spark.createDataFrame([('{"_id": 7, "link": "https://x.com", "title": "T", "tags": ["a"], "created": "2024-01-01T00:00:00Z", "collectionId": 5}',)], "j string")
    got = datasource.items(raw, "j", spark.createDataFrame([(5, "Lists")], "collectionId long, folder string")).first()
    assert (got.id, got.folder, got.tags) == ("7", "Lists", ["a"])
    pages = datasource.paged(spark, lambda page, n: [f'{{"_id": {page}}}'] if page < 3 else [], slices=2)
    assert pages.count() == 3
    assert all(r.ok for r in datasource.push(rows, lambda bodies: [True] * len(bodies)).collect())
    datasource.write_backup(rows, str(tmp_path / "b"))
    assert datasource.read_backup(spark, str(tmp_path / "b")).count() == 3


def test_projections(spark, rows):
    shown = [r.t for r in rows.orderBy("pos").select(bookmarks.effective_title(F.col("title"), F.col("url")).alias("t")).collect()]
    assert shown == ["A one", "B <two>", "c.com"]
    tagged = rows.orderBy("pos").select(bookmarks.with_folder_tags(F.col("tags"), F.col("folder")).alias("t")).first().t
    assert tagged == ["ai", "ml", "tech"]
