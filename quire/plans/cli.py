"""The text modes on the command line."""

from __future__ import annotations

import argparse
import importlib
import logging
import os
import sys
import time
from dataclasses import replace

from quire.config import Config, from_environment

logger = logging.getLogger(__name__)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire", description="Page texts to clean, assembled Markdown.")
    p.add_argument("--images", help="folder or file with the sources")
    p.add_argument("--extractor", metavar="MODULE:NAME", help="what makes an extractor (see quire.sources.extract) for the pages")
    p.add_argument("--out", help="the book's file")
    p.add_argument("--method", choices=("paddleocrvl", "text", "docling"))
    p.add_argument("--unify", action="store_true", help="one book of all PDFs, not one of each")
    p.add_argument("--n-parallel", type=int, help="extractors that work at once on an executor")
    p.add_argument("--dpi", type=int, help="of page images")
    p.add_argument("--no-layout", action="store_true")
    p.add_argument("--no-resume", action="store_true")
    p.add_argument("--no-postprocess", action="store_true")
    p.add_argument("--keep-html", action="store_true")
    p.add_argument("--mode", choices=("base", "obsidian"), default="base")
    p.add_argument("--postprocess-only", action="store_true")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--rename", action="store_true")
    p.add_argument("--rename-prefix", default="page")
    p.add_argument("--rename-only", nargs="?", type=int, const=1, metavar="N")
    p.add_argument("--chapters", nargs="+")
    p.add_argument("--dir-level", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--migrate", action="store_true")
    p.add_argument("--vault-root")
    p.add_argument("--vault-path", help="the books' folder in the vault")
    p.add_argument("--vault-figures-dir")
    p.add_argument("--report", help="the run report's file")
    p.add_argument("--log", help="the log's file")
    p.add_argument("--header-pattern", nargs=2, action="append", metavar=("RE", "LEVEL"), default=[])
    return p


def to_config(args: argparse.Namespace) -> Config:
    given = {"images_dir": args.images, "output_file": args.out, "extraction_method": args.method, "vault_root": args.vault_root, "vault_path": args.vault_path}
    given |= {"vault_figures_dir": args.vault_figures_dir, "report_file": args.report, "log_file": args.log, "n_parallel": args.n_parallel, "pdf_dpi": args.dpi}
    return Config(
        **(from_environment() | {k: v for k, v in given.items() if v is not None}),
        mode=args.mode,
        rename_prefix=args.rename_prefix,
        resume=not args.no_resume,
        postprocess=not args.no_postprocess,
        keep_html=args.keep_html,
        use_layout_detection=not args.no_layout,
        verbose=args.verbose,
        header_patterns=tuple((pattern, int(level)) for pattern, level in args.header_pattern),
    )


def _logging(config: Config) -> None:
    """Messages to the console, all of them to the log's file."""
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    handlers[0].setLevel(logging.DEBUG if config.verbose else logging.INFO)
    if config.log_file:
        os.makedirs(os.path.dirname(config.log_file) or ".", exist_ok=True)
        handlers.append(logging.FileHandler(config.log_file, encoding="utf-8"))
    own = logging.getLogger("quire")
    for old in own.handlers[:]:
        own.removeHandler(old)
        old.close()
    own.setLevel(logging.DEBUG)
    own.propagate = False
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s  %(levelname)-8s  %(message)s", "%H:%M:%S"))
        own.addHandler(h)


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: wrong input; 2: done, but pages failed; 130: interrupted."""
    args = parser().parse_args(argv)
    try:
        from quire.sources.files import SourceError

        config = to_config(args)
        _logging(config)
        try:
            return _run(args, config)
        except (SourceError, ValueError) as e:
            logger.error("%s", e)
            return 1
        except Exception:
            logger.exception("the run failed")
            return 1
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return 130


def _run(args: argparse.Namespace, config: Config) -> int:
    from pyspark.sql import SparkSession

    from quire.plans import runs

    if config.mode == "obsidian" or args.migrate:
        if not (config.vault_root and config.vault_path and config.vault_figures_dir):
            raise ValueError("the vault's root, its books folder and its figures folder are needed")
        if not args.migrate:
            config = replace(config, output_file=os.path.join(config.vault_root, config.vault_path, os.path.basename(config.output_file)))
    if args.postprocess_only and config.mode != "obsidian":
        raise ValueError("--postprocess-only goes with --mode obsidian")
    spark = SparkSession.builder.appName("quire").getOrCreate()
    if args.migrate:
        logger.info("%d file(s)", runs.migrate(spark, config, dry_run=args.dry_run))
        return 0
    if args.postprocess_only:
        for r in runs.postprocess_only(spark, config, config.output_file).toLocalIterator():
            with open(config.output_file, "w", encoding="utf-8", newline="\n") as out:
                out.write(r["markdown"])
        runs.migrate(spark, config)
        return 0
    if args.rename or args.rename_only is not None:
        _rename(spark, args, config)
        if args.rename_only is not None or args.dry_run:
            return 0
    return _book(spark, args, config)


def _rename(spark, args: argparse.Namespace, config: Config) -> None:
    from quire.sources import files

    start = 1 if args.rename_only is None else args.rename_only
    if args.chapters or files.has_images_below(spark, config.images_dir, config.extensions):
        plan = files.subfolder_plan(spark, config.images_dir, config.extensions, args.chapters, config.rename_prefix, start, args.dir_level)
        files.apply_plan(plan, config.images_dir, dry_run=args.dry_run)
    else:
        files.apply_plan(files.rename_plan(spark, config.images_dir, config.extensions, config.rename_prefix, start), config.images_dir, move=True, dry_run=args.dry_run)


def _book(spark, args: argparse.Namespace, config: Config) -> int:
    """One book, or one of each PDF where there are several: all pages are read in one run."""
    from pyspark.sql import functions as F

    from quire.operators import order
    from quire.plans import runs
    from quire.sources import files

    began = time.time()
    sources = files.collect_sources(spark, config.images_dir, config.extensions, config.image_files and tuple(f if "://" in f else os.path.abspath(f) for f in config.image_files))
    several = False
    for r in order.kind_gate(sources).collect():  # a row per kind
        if r["problem"] == "more than one pdf":
            several = not args.unify
        elif r["problem"]:
            raise files.SourceError(f"{r['problem']}: {', '.join(r['preview'])}")
        elif r["kind"] == "epub":
            runs.write_epub(spark, config, sources.first()["path"])
            return 0
    if not args.extractor:
        raise ValueError("name an extractor: --extractor MODULE:NAME")
    module, _, name = args.extractor.partition(":")
    make = getattr(importlib.import_module(module), name)
    sources = sources.withColumn("doc_id", F.col("stem") if several else F.lit("book"))
    parts = (os.path.dirname(config.log_file) or ".") + "/parts"  # never beside a book in the vault
    done = runs.run(spark, config, sources, make, parts)
    if done.done or done.skipped:  # else there is no book
        places = order.with_position(done.pages, F.col("file_ord"), F.col("page")) if args.unify else done.pages
        names = files.write_books(runs.books(spark, config, places, parts), config.output_file, not several)
        written = [r["name"] for r in names.orderBy("doc_id").limit(20).collect()]  # as many as the report is to name
        config = replace(config, output_file=os.path.join(os.path.dirname(config.output_file), ", ".join(written)))
    runs.write_report(done.metrics, config, done.total, done.skipped, args.extractor, time.time() - began)
    if config.mode == "obsidian":
        runs.migrate(spark, config, page_ids=done.pages)
    return 2 if done.errors else 0


if __name__ == "__main__":
    sys.exit(main())
