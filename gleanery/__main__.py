"""Command line: harvest, rebuild, aliases, push."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from gleanery.plans.config import read_config
from gleanery.plans.index import Index
from gleanery.plans.run import harvest, rebuild, update_aliases
from gleanery.streaming.push import Front, committed, stream


def main() -> int:
    p = argparse.ArgumentParser(prog="gleanery", description=__doc__)
    p.add_argument("command", choices=("harvest", "rebuild", "aliases", "push"))
    p.add_argument("config")
    p.add_argument("which", nargs="?", default="*", help="id of a source or index; * for all")
    p.add_argument("--root", required=True, help="directory of the index tables")
    p.add_argument("--landing", default="landing", help="push: directory of events")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8089)
    args = p.parse_args()
    spark = SparkSession.builder.appName("gleanery").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if spark.sparkContext.getCheckpointDir() is None:  # crawls write their levels there
        spark.sparkContext.setCheckpointDir(f"{args.root}/checkpoints")
    config = read_config(args.config)
    if args.command == "aliases":
        update_aliases(spark, config, args.root, args.which)
        return 0
    if args.command == "push":
        indexes = {i.name: Index(spark, args.root, i, config.pipeline) for i in config.indexes}
        query = stream(spark, config, args.root, args.landing, f"{args.root}/push-checkpoint", continuous=True)

        def commit(_: str) -> None:
            query.processAllAvailable()
            committed(config, indexes)

        front = Front({s.id for i in config.indexes for s in i.sources}, args.landing, commit, args.host, args.port).start()
        try:
            while query.isActive:
                time.sleep(1)
        finally:
            front.stop()
            commit("")
            query.stop()
        return 0
    report = (harvest if args.command == "harvest" else rebuild)(spark, config, args.root, args.which)
    for source, counts in report.counts.items():
        print(source, counts)
    for source, error in report.errors.items():
        print(source, "failed:", error)
    return int(bool(report.errors))


if __name__ == "__main__":
    raise SystemExit(main())
