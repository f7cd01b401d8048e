"""Link exports in CSV: probing, structure and quality checks, reading in three modes, writing import files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text, urls
from ..operators import bookmarks

ENCODINGS = ("UTF-8", "UTF-16LE", "UTF-16BE", "ISO-8859-1")
SEPARATORS = (",", ";", "\t")
#: Rows of an export that a task numbers, about, and the most ranges that they are cut into.
SLICE, MOST_SLICES = 25_000, 256


class ExportError(ValueError):
    """A file that can't be read as an export."""


def head_bytes(spark: SparkSession, path: str, most: int = 65536) -> bytes:
    """The first bytes of a file, by Spark's file systems."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise ExportError(f"no such file: {path}")
    rows = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, most).alias("head")).limit(1).collect()
    return bytes(rows[0].head) if rows else b""


def detect_encoding(head: bytes) -> str:
    """By byte order mark, else UTF-8 if it decodes, else a single-byte encoding."""
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")):
        if head.startswith(mark):
            return name
    for cut in range(4):  # the head may end within a character
        try:
            head[: len(head) - cut].decode("utf-8")
            return "UTF-8"
        except UnicodeDecodeError:
            continue
    return "ISO-8859-1"


def detect_separator(head: str) -> str:
    """The separator that gives the header most columns."""
    line = head.lstrip("﻿").split("\n", 1)[0]
    return max(SEPARATORS, key=line.count)


def read_raw(spark: SparkSession, path: str, separator: str | None = None, encoding: str | None = None) -> DataFrame:
    """All columns as text, empty text kept, names in lower case, with ``pos`` in file order."""
    head = head_bytes(spark, path)
    encoding = encoding or detect_encoding(head)
    separator = separator or detect_separator(head.decode(encoding, "replace"))
    names = [c.strip().lstrip("﻿").strip('"').lower() for c in head.decode(encoding, "replace").split("\n", 1)[0].strip("\r").split(separator)]
    schema = schemas._strings(tuple(names))
    rows = (
        spark.read.schema(schema).option("header", True).option("sep", separator).option("encoding", encoding).option("multiLine", True)
        .option("quote", '"').option("escape", '"').option("enforceSchema", True).option("nullValue", "\u0000none\u0000").option("emptyValue", "").csv(path)
    )
    rows = rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names])
    return rows.withColumn("pos", F.monotonically_increasing_id())


def structure_errors(columns: list[str]) -> list[str]:
    have, want = set(columns) - {"pos", "source_file"}, set(schemas.EXPORT_COLUMNS)
    return [f"missing column: {c}" for c in sorted(want - have)] + [f"unexpected column: {c}" for c in sorted(have - want)]


def quality(rows: DataFrame) -> dict:
    """One pass over the file: counts of rows, blank rows, blank fields, repeated ids and bad URLs."""
    blank = lambda c: text.strip(F.col(c)) == ""
    every = F.lit(True)
    for c in schemas.EXPORT_COLUMNS:
        every = every & blank(c)
    told = rows.agg(
        F.count("*").alias("rows"), F.count_if(every).alias("blank_rows"), *[F.count_if(blank(c)).alias(f"blank_{c}") for c in ("id", "title", "url")],
        (F.count("id") - F.count_distinct("id")).alias("repeated_ids"), F.count_if(~urls.well_formed(text.strip(F.col("url")))).alias("bad_urls"),
    )
    return told.first().asDict()


def quality_errors(q: dict) -> list[str]:
    n = q["rows"]
    if not n:
        return ["no rows"]
    found = [f"{q['blank_rows']} blank rows"] if q["blank_rows"] else []
    found += [f"{c} is blank in 90 % of rows or more" for c in ("id", "title", "url") if q[f"blank_{c}"] >= 0.9 * n]
    found += [f"{q['repeated_ids']} repeated ids"] if q["repeated_ids"] else []
    found += ["more than three quarters of the URLs are malformed"] if q["bad_urls"] > 0.75 * n else []
    return found


def read_export(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The eleven text columns and ``pos``. Strict: structure, blank URLs and quality raise; else columns are filled in and checks skipped."""
    rows = read_raw(spark, path)
    if errors := structure_errors(rows.columns):
        if strict:
            raise ExportError("; ".join(errors))
        empty = spark.createDataFrame([], schemas.EXPORT_CSV)
        rows = rows.unionByName(empty, allowMissingColumns=True).fillna("", list(schemas.EXPORT_COLUMNS))
    rows = rows.select("pos", *schemas.EXPORT_COLUMNS)
    if strict:
        q = quality(rows)
        if q["blank_url"]:
            raise ExportError(f"{q['blank_url']} rows without a URL")
        if errors := quality_errors(q):
            raise ExportError("; ".join(errors))
    return rows


def diagnose(spark: SparkSession, path: str) -> dict:
    """What a file looks like and what is wrong with it."""
    try:
        head = head_bytes(spark, path)
        rows = read_raw(spark, path)
        errors = structure_errors(rows.columns)
        told = quality(rows) if not errors else {"rows": rows.count()}
        return {"exists": True, "encoding": detect_encoding(head), "columns": rows.columns[:-1], "structure": errors, "quality": told, "problems": errors + (quality_errors(told) if not errors else [])}
    except ExportError as e:
        return {"exists": False, "problems": [str(e)]}


def recommended_mode(report: dict) -> str:
    n = len(report["problems"])
    return "strict" if n == 0 else "best_effort" if n <= 2 else "permissive"


@dataclass
class Imported:
    """Bookmarks and the rows that gave none."""

    rows: DataFrame
    rejected: DataFrame
    mode: str
    problems: list[str] = field(default_factory=list)


def import_bookmarks(spark: SparkSession, path: str, mode: str = "best_effort", max_errors: int | None = None) -> Imported:
    """strict raises on any problem; best_effort leaves out rows without a well-formed URL; permissive keeps all rows with a URL.

    More rejected rows than ``max_errors`` are an error in any mode.
    """
    raw = read_export(spark, path, strict=mode == "strict")
    good = urls.well_formed(urls.clean_url(F.col("url"))) if mode == "best_effort" else text.strip(F.col("url")) != ""
    if max_errors is not None and (n := raw.where(~good).limit(max_errors + 1).count()) > max_errors:
        raise ExportError(f"more than {max_errors} bad rows" if n else "no rows")
    return Imported(bookmarks.typed(raw.where(good)), raw.where(~good), mode, [] if mode == "strict" else diagnose(spark, path)["problems"])


def write_import(rows: DataFrame, path: str) -> None:
    """Six columns, all quoted, as CSV part files with headers."""
    bookmarks.import_row(rows).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("encoding", "UTF-8").csv(path)


def write_import_file(rows: DataFrame, path: str) -> int:
    """One file with a byte order mark, written row by row on the driver as the importer takes single files; returns the rows."""
    import csv

    n = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f, quoting=csv.QUOTE_ALL)
        out.writerow(schemas.IMPORT_COLUMNS)
        for n, row in enumerate(bookmarks.import_row(rows).toLocalIterator(), 1):
            out.writerow(row)
    return n


def as_export(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """Bookmarks as the eleven export columns with ids from 1 in order of position; numbered by ranges, not in one task.

    The ranges and the rows before each are fixed numbers in the plan: a shuffle that is planned a second time samples and coalesces
    on its own, so its partitions are not those of the first.
    """
    at = F.col(pos)
    n = rows.count()
    slices = max(1, min(MOST_SLICES, -(-n // SLICE)))
    cuts = [i / slices for i in range(1, slices)]
    bounds = sorted(set(rows.agg(F.percentile_approx(at, cuts, 10000)).first()[0] or [])) if cuts else []
    passed = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < at)) if bounds else F.lit(0)
    sliced = rows.withColumn("_slice", F.when(at.isNull(), len(bounds)).otherwise(passed))
    sizes = dict(sliced.groupBy("_slice").count().collect()) if bounds else {}
    before = [sum(sizes.get(j, 0) for j in range(i)) for i in range(len(bounds) + 1)]
    place = F.row_number().over(W.partitionBy("_slice").orderBy(at.asc_nulls_last()))
    ordered = sliced.repartitionByRange(len(before), "_slice")  # the rows stay in order from file to file
    numbered = ordered.withColumn("id", (F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col("_slice") + 1) + place).cast("string"))
    return numbered.select("id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns and c not in ("tags",) else F.array_join("tags", ", ").alias("tags") if c == "tags" else F.lit("").alias(c) for c in schemas.EXPORT_COLUMNS[1:]])


def sample_export(spark: SparkSession) -> DataFrame:
    rows = [("1", "A page", "a note", "an excerpt", "https://example.com/a", "Tech/AI", "ai, ml", "2024-01-01T00:00:00Z", "", "", "false"), ("2", "Another", "", "", "https://example.org/b", "", "news", "2024-02-01T00:00:00Z", "", "", "true")]
    return spark.createDataFrame(rows, schemas.EXPORT_CSV)
