"""Command line: python -m vellum screen RAW OUT --job FILE, or python -m vellum status OUT."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import functions as F

from vellum.functions.taxonomy import Taxonomy
from vellum.plans.outputs import STAGES, reports, stage_status, write_screening
from vellum.plans.screening import screen
from vellum.session import checkpointed, get_session
from vellum.sources.readers import read_documents, read_job, with_candidate_ids
from vellum.sources.sinks import error_lines, write_json


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="vellum", description="Screen a folder of documents on Spark.")
    out.add_argument("--master", help="Spark master; that of the environment if not given")
    commands = out.add_subparsers(dest="command", required=True)
    run = commands.add_parser("screen", help="redact, parse, rank, explain and audit a folder")
    run.add_argument("raw", help="folder of documents")
    run.add_argument("out", help="folder of result tables")
    run.add_argument("--job", help="file of the job description; without it nothing is ranked")
    run.add_argument("--taxonomy", help="Parquet table of (category, name); the built-in sample if not given")
    run.add_argument("--level", default="STRICT")
    run.add_argument("--role", default="mid")
    run.add_argument("--at", type=datetime.fromisoformat, help="clock of the run, ISO 8601; now if not given")
    run.add_argument("--keep-duplicates", action="store_true", help="rank near-duplicates of earlier documents too")
    run.add_argument("--skip", nargs="*", default=[], choices=list(STAGES), help="stages that are left out; texts are redacted and parsed where a later stage needs them")
    commands.add_parser("status", help="which stages of a folder are done").add_argument("out")
    return out


def main(args: Sequence[str] | None = None) -> int:
    told = parser().parse_args(args)
    spark = get_session(master=told.master)
    if told.command == "status":
        print(json.dumps(stage_status(spark, told.out), indent=2))
        return 0
    at = told.at or datetime.now()
    files = checkpointed(with_candidate_ids(read_documents(spark, told.raw)))
    good = files.where("status = 'OK'").select("candidate_id", "text", F.col("file_name").alias("original_filename"))
    taxonomy = Taxonomy.from_table(spark.read.parquet(told.taxonomy)) if told.taxonomy else Taxonomy()
    job = read_job(spark, told.job) if told.job else None
    run = screen(good, job, taxonomy, at, level=told.level, role=told.role, raw_files=files.count(), drop_duplicates=not told.keep_duplicates, skip=tuple(told.skip))
    write_screening(run, told.out, tuple(told.skip))
    names = files.select("candidate_id", "file_name")
    twice = None if run.duplicates is None else run.duplicates.join(names, "candidate_id")
    write_json(error_lines(files, twice), f"{told.out}/errors")
    print(reports(run, at.strftime("RUN_%Y%m%d_%H%M%S")))
    return 0


if __name__ == "__main__":
    sys.exit(main())
