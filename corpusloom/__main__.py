"""Command line: bundle a tree of files into Markdown volumes."""

from __future__ import annotations

import argparse
import sys

from corpusloom.config import load


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    p.add_argument("--input", "-i", dest="input_dir")
    p.add_argument("--output", "-o", dest="output_dir")
    p.add_argument("--timestamp-output", dest="output_timestamp", action=argparse.BooleanOptionalAction)
    p.add_argument("--max-size-mb", type=int)
    p.add_argument("--verbose", "-v", dest="log_level", action="store_const", const="DEBUG")
    p.add_argument("--no-ocr", dest="ocr_enabled", action="store_const", const=False)
    p.add_argument("--filter-mtime", dest="mtime_filter", action=argparse.BooleanOptionalAction)
    p.add_argument("--keep-intermediate", action=argparse.BooleanOptionalAction)
    p.add_argument("--with-metadata", dest="metadata", action="store_const", const=True)
    p.add_argument("--no-metadata", dest="metadata", action="store_const", const=False)
    p.add_argument("--metadata-position", choices=("toc", "body", "both", "none"))
    p.add_argument("--dedup", dest="duplicates", action=argparse.BooleanOptionalAction)
    p.add_argument("--env", dest="file")
    p.add_argument("--resume", metavar="JOURNAL", help="the journal folder of an earlier run")
    return p


def main(argv: list[str] | None = None) -> int:
    flags = vars(parser().parse_args(argv))
    file, journal = flags.pop("file"), flags.pop("resume")
    try:
        settings = load(flags, file=file)
        if not settings.input_dir or not settings.output_dir:
            raise ValueError("--input and --output (or INPUT_DIR and OUTPUT_DIR) are required")
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    from corpusloom.plans import bundle
    from corpusloom.session import local_session

    spark = local_session()
    print((bundle.resume(spark, settings, journal) if journal else bundle.run(spark, settings))["output"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
