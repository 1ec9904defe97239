"""Command line: ``python -m driftline VERB --data DIR [--out DIR]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

#: What each verb answers with.
VERBS = {
    "collect": "src04_feed_entries",
    "status": "stm07_diagnosis",
    "trends": "agg10_trend_candidates",
    "run": "win01_rank",
    "supervise": "set04_missed_days",
    "backfill": "agg34_dry_run",
}


def main(argv: list[str] | None = None) -> int:
    from driftline.plans import catalog, catalog_more, catalog_records, catalog_stages  # noqa: F401  (the others add their queries to the first)

    parser = argparse.ArgumentParser(prog="driftline")
    parser.add_argument("verb", choices=[*VERBS, "doctor", "query", "list"])
    parser.add_argument("--name", help="the query to run, for the verb query")
    parser.add_argument("--data", help="folder of the input tables")
    parser.add_argument("--out", help="folder for the result as Parquet; without it, rows are shown")
    args = parser.parse_args(argv)
    if args.verb == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    spark = SparkSession.builder.appName("driftline").getOrCreate()
    if args.verb == "doctor":
        ok = bool(spark.conf.get("spark.checkpoint.dir", None)) or spark.sparkContext.master.startswith("local")
        print("shared folder:", "set" if ok else "spark.checkpoint.dir is not set")
        return int(not ok)
    name = args.name if args.verb == "query" else VERBS[args.verb]
    if name not in catalog.QUERIES or not args.data:
        parser.error("a known query and --data are needed")
    result = catalog.QUERIES[name](spark, args.data)
    if args.out:
        result.write.mode("overwrite").parquet(args.out)
    else:
        result.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
