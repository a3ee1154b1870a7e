"""Command line: split, fetch, evaluate, validate, store."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .config import get_config, load_dotenv
from .operators.metrics import coverage, evaluate, join_predictions
from .operators.split import run_splitter
from .operators.submission import validate
from .session import session
from .sources import assets, store
from .sources.tables import read_table
from .trace import Tracer


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("split")
    for name in ("--input", "--output-dir"):
        p.add_argument(name, required=True)
    for name in ("--target-col", "--group-col", "--id-col"):
        p.add_argument(name)
    for name, default in (("--golden-train", 5000), ("--golden-val", 1000), ("--n-splits", 5), ("--seed", 42)):
        p.add_argument(name, type=int, default=default)
    p = commands.add_parser("fetch")
    for name in ("--input", "--output-dir"):
        p.add_argument(name, required=True)
    p.add_argument("--url-col", default="image_link")
    p.add_argument("--id-col", default="index")
    p.add_argument("--concurrency", type=int, default=32)
    p.add_argument("--partitions", type=int)
    p.add_argument("--limit", type=int)
    p = commands.add_parser("evaluate")
    for name in ("--truth", "--predictions"):
        p.add_argument(name, required=True)
    p = commands.add_parser("validate")
    p.add_argument("submission")
    p.add_argument("--sample")
    p.add_argument("--test")
    for p in (commands.choices["evaluate"], commands.choices["validate"]):
        p.add_argument("--id-col", default="index")
        p.add_argument("--target-col", default="prediction")
    p = commands.add_parser("store")
    p.add_argument("action", choices=("push", "pull", "list"))
    p.add_argument("source")
    p.add_argument("target", nargs="?")
    a = parser.parse_args(argv)
    load_dotenv(".env")
    spark, tracer = session(), Tracer(a.command)
    ok = True
    try:
        with tracer.span(a.command):
            if a.command == "split":
                print(run_splitter(spark, a.input, a.output_dir, a.target_col, a.group_col, a.golden_train, a.golden_val, a.n_splits, a.seed, a.id_col))
            elif a.command == "fetch":
                df = read_table(spark, a.input)
                row = assets.tallies(assets.fetch(df.limit(a.limit) if a.limit else df, a.output_dir, a.url_col, a.id_col, a.concurrency, partitions=a.partitions)).first()
                print(f"success {row.success}, skipped {row.skipped}, failed {row.failed}")
                ok = row.failed == 0 or row.success > 0
            elif a.command == "evaluate":
                truth, given = read_table(spark, a.truth), read_table(spark, a.predictions)
                scores = evaluate(join_predictions(truth, given, a.id_col, a.target_col)).first().asDict() | coverage(truth, given, a.id_col).first().asDict()
                for k, v in scores.items():
                    print(f"{k}: {v:.4f}" if isinstance(v, float) else f"{k}: {'-' if v is None else v}")
            elif a.command == "validate":
                report = validate(spark, a.submission, a.sample, a.test, a.id_col, a.target_col)
                print("\n".join([f"rows {report.total_rows}, nulls {report.null_count}, blanks {report.empty_string_count}, id mismatches {report.id_mismatches}", *(report.errors or ["valid"])]))
                ok = report.is_valid
            elif a.action == "list":
                lines = store.listing(spark, a.source).orderBy("path").select("modified", store.size_text(F.col("length")).alias("size"), "path")
                for r in lines.toLocalIterator():
                    print(r.modified, "|", r.size, "|", r.path)
            else:
                ok = store.copy(spark, a.source, a.target, get_config().store.region)
    finally:
        tracer.finish(ok)
    return 0 if ok else 1


if __name__ == "__main__":
    raise SystemExit(main())
