"""Command line: process, export, analyze, monitor, convert and detect, over Spark's file systems."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config
from .functions import urls
from .operators import predicates, reports, state
from .plans import process
from .plugins import Registry
from .sources import csv, datasource, detect, export, netscape


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="linkloom")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: tuple[str, dict]) -> None:
        c = sub.add_parser(name)
        c.add_argument("input")
        for flag, how in flags:
            c.add_argument(flag, **how)

    yes = {"action": "store_true"}
    filters = [(f"--filter-{n}", {}) for n in ("folder", "tag", "date", "domain", "status")] + [("--retry-invalid", yes)]
    command("process", ("output", {}), ("--strategy", {"default": "highest_quality"}), ("--preview", {"type": int}), ("--work", {}), *[(f"--{n}", yes) for n in ("dry-run", "skip-validation", "skip-content", "skip-ai", "tags-only", "folders-only", "validate-only", "no-dedup")], *filters)
    command("export", ("output", {}), ("--format", {"default": "json", "choices": ["json", "jsonl", "markdown", "vault", "table", "opml", "html", "csv"]}), ("--exported-at", {"default": ""}), *filters)
    command("analyze", ("--most", {"type": int, "default": 30}))
    command("monitor")
    command("convert", ("output", {}))
    command("detect")
    command("enhance", ("output", {}), ("--state", {"required": True}), *filters)
    command("rollback", ("output", {}))
    command("backup", ("output", {}))
    command("create-config")
    command("config")
    command("plugins")
    return p


def stages(args: argparse.Namespace) -> tuple[str, ...]:
    """The stages that the mode flags leave."""
    if args.tags_only:
        return ("tags",)
    if args.folders_only:
        return ("folders",)
    if args.validate_only:
        return ("validation",)
    skipped = {"dedup": args.no_dedup, "validation": args.skip_validation, "content": args.skip_content, "ai": args.skip_ai}
    return tuple(s for s in process.STAGES if not skipped.get(s))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "create-config":
        with open(args.input, "w", encoding="utf-8") as f:
            f.write(config.template())
        return 0
    if args.command == "config":
        print(json.dumps(asdict(config.load(args.input))))
        return 0
    if args.command == "plugins":
        print(json.dumps(Registry().load(args.input)))
        return 0
    spark = spark or SparkSession.builder.appName("linkloom").getOrCreate()
    if args.command == "detect":
        print(detect.detect_format(spark, args.input))
        return 0
    if args.command == "convert":
        csv.write_import(csv.import_bookmarks(spark, args.input).rows, args.output)
        return 0
    if args.command == "rollback":
        csv.write_import(datasource.read_backup(spark, args.input), args.output)
        return 0
    rows = detect.read_bookmarks(spark, args.input)
    if hasattr(args, "filter_folder"):
        rows = predicates.from_options(vars(args)).apply(rows)
    if args.command == "process":
        done = process.run(rows, process.Options(strategy=args.strategy, stages=stages(args), preview=args.preview, work=args.work))
        if args.dry_run:
            print(json.dumps(process.results(done).first().asDict()))
        else:
            process.output(done).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(args.output)
    elif args.command == "backup":
        datasource.write_backup(rows, args.output)
    elif args.command == "enhance":
        # Only what is new, changed or failed since the state was written.
        store = state.StateStore(spark, args.state)
        rows = rows.withColumn("content_hash", state.content_hash(rows))
        run = store.start_run("enhance")
        done = process.run(state.unprocessed(rows, store.read("processed_bookmarks")), process.Options())
        process.output(done).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(args.output)
        n = done.count()
        if n:
            store.mark(done, run)
        store.complete_run(run, n, n, 0)
    elif args.command == "export":
        make = {
            "json": lambda: export.write_json_document(rows, args.output, args.exported_at), "jsonl": lambda: export.write_json_rows(rows, args.output),
            "markdown": lambda: export.write_markdown(rows, args.output), "vault": lambda: export.write_files(export.vault_files(rows), args.output),
            "table": lambda: export.write_table(rows, args.output), "csv": lambda: csv.write_import(rows, args.output),
            "opml": lambda: open(args.output, "w", encoding="utf-8").write(export.outline_document(rows)),
            "html": lambda: open(args.output, "w", encoding="utf-8").write(netscape.generate(rows)),
        }
        make[args.format]()
    elif args.command == "analyze":
        for r in reports.discovered_terms(rows, most=args.most).toLocalIterator():
            print(json.dumps(r.asDict()))
    else:
        status = rows.select(F.when(urls.mock_valid(F.col("url")), "healthy").otherwise("dead").alias("status"))
        for r in reports.health_counts(status).toLocalIterator():
            print(json.dumps(r.asDict()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
