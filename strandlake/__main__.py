"""python -m strandlake run cfg.yaml"""

from __future__ import annotations

import argparse
import logging
import sys

from strandlake import __version__


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="strandlake", description="Cohort read-depth analytics on Spark")
    parser.add_argument("-v", "--version", action="version", version=__version__)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="run the enabled steps of a configuration")
    run.add_argument("config")
    run.add_argument("--keep-going", action="store_true", help="log a step's failure and go on")
    check = commands.add_parser("check", help="check a configuration")
    check.add_argument("config")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO)

    from strandlake.config import Config

    try:
        config = Config.read(args.config)
    except OSError as e:
        print(e, file=sys.stderr)
        return 1
    report = config.validate()
    for warning in report.warnings:
        logging.warning(warning)
    for error in report.errors:
        logging.error(error)
    if args.command == "check" or report.errors:
        return int(bool(report.errors))

    from pyspark.sql import SparkSession

    from strandlake.plans.pipeline import Pipeline

    Pipeline(config, fail_fast=not args.keep_going).run(SparkSession.builder.appName("strandlake").getOrCreate())
    return 0


if __name__ == "__main__":
    sys.exit(main())
