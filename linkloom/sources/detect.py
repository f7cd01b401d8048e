"""Which format a file has, reading any of them, and unions of many files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bookmarks
from . import csv, netscape


def detect_format(spark: SparkSession, path: str) -> str:
    """netscape, csv or unknown: by extension, confirmed by content."""
    low = path.lower()
    head = csv.head_bytes(spark, path, 4096)
    said = head.decode(csv.detect_encoding(head), "replace").lower()
    if "netscape-bookmark-file" in said or ("<dl" in said and "<dt" in said):
        return "netscape"
    names = {c.strip().strip('"') for c in said.lstrip("﻿").split("\n", 1)[0].strip("\r").split(csv.detect_separator(said))}
    if len(names & {"id", "title", "url", "folder", "tags", "created"}) >= 5:
        return "csv"
    return "netscape" if low.endswith((".html", ".htm")) and "<a " in said else "unknown"


def read_bookmarks(spark: SparkSession, path: str, mode: str = "best_effort") -> DataFrame:
    """Bookmarks of a file of either format, with ``source_file``."""
    kind = detect_format(spark, path)
    if kind == "csv":
        return csv.import_bookmarks(spark, path, mode).rows.withColumn("source_file", F.lit(path))
    if kind == "netscape":
        rows = netscape.read(spark, path)
        empty = {c: F.lit("") for c in ("id", "note", "excerpt", "cover", "highlights")}
        return bookmarks.with_keys(rows.withColumns({**empty, "tags": F.array().cast("array<string>"), "favorite": F.lit(False), "source_file": F.lit(path)}))
    raise csv.ExportError(f"unknown format: {path}")


def find_files(spark: SparkSession, directory: str) -> list[str]:
    """Readable, non-empty export files of a directory, sorted by name."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(str(f.getPath()) for f in fs.listStatus(at) if f.isFile() and f.getLen() > 0 and f.getPath().getName().lower().endswith((".csv", ".html", ".htm")))
    return [n for n in names if detect_format(spark, n) != "unknown"]


def read_many(spark: SparkSession, paths: list[str], mode: str = "best_effort") -> tuple[DataFrame | None, list[dict]]:
    """The union of files with positions in order of files, and what became of each file; files that fail are left out."""
    union, told = None, []
    for n, path in enumerate(paths):
        try:
            rows = read_bookmarks(spark, path, mode).withColumn("pos", F.col("pos") + F.lit(n) * F.lit(1 << 55))
        except csv.ExportError as e:
            told.append({"file": path, "ok": False, "error": str(e)})
            continue
        told.append({"file": path, "ok": True, "error": ""})
        union = rows if union is None else union.unionByName(rows, allowMissingColumns=True)
    return union, told


def directory_report(spark: SparkSession, directory: str) -> dict:
    files = find_files(spark, directory)
    return {"directory": directory, "files": files, "formats": {f: detect_format(spark, f) for f in files}, "usable": bool(files)}
