"""python -m siftwright.cli --source TABLE [--config FILE] [--phase 1|2|3|all] [--verbose]"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from siftwright.config import Config, load_config
from siftwright.plans import phases

# The names of options and phases.
OPTIONS = {"config": "YAML settings; defaults without it", "source": "Parquet or JSON-lines table of records with row_idx and split (phase 1)"}
PHASES = ("1", "2", "3")


def _prepare(spark: SparkSession, config: Config, source: str) -> str:
    reader = spark.read.json if source.endswith((".json", ".jsonl")) else spark.read.parquet
    report = phases.prepare(spark, reader(source), config.phase1)
    return f"snapshot {report['snapshot']['snapshot_id']}, rows {report['distribution_summary']}"


def _enrich(spark: SparkSession, config: Config, source: str) -> str:
    return f"augmentation {phases.enrich(spark, config.phase2).get('augmentation')}"


def _finalize(spark: SparkSession, config: Config, source: str) -> str:
    told = phases.finalize(spark, config.phase3)
    return f"leakage audit passed: {told['leakage_audit']['passed']}, package {told['package']['zip_path']}"


STEPS = dict(zip(PHASES, (_prepare, _enrich, _finalize), strict=True))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Prepare, enrich and finalize a labelled text data set.")
    for name, told in OPTIONS.items():
        parser.add_argument(f"--{name}", help=told)
    parser.add_argument("--phase", choices=(*PHASES, "all"), default="all")
    parser.add_argument("--verbose", action="store_true")
    args = parser.parse_args(argv)
    wanted = PHASES if args.phase == "all" else (args.phase,)
    if "1" in wanted and not args.source:
        parser.error("phase 1 needs --source")
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO)
    config = load_config(args.config) if args.config else Config()
    spark = SparkSession.builder.appName("siftwright").getOrCreate()
    for phase in wanted:
        print(f"phase {phase}: {STEPS[phase](spark, config, args.source)}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
