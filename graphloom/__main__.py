"""python -m graphloom STAGE FOLDER [--limit N] [SHARD ...]: run a stage of the build, or all of it."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from graphloom.stages import STAGES, Build


def main() -> None:
    cli = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    cli.add_argument("stage", help=f"all, {', '.join(STAGES)}")
    cli.add_argument("folder", help="where the stages keep their tables")
    cli.add_argument("shards", nargs="*", help="Parquet files of the catalog")
    cli.add_argument("--limit", type=int, default=0, help="products to keep; 0: the default")
    args = cli.parse_args()
    Build(SparkSession.builder.getOrCreate(), args.folder, args.shards, args.limit).run(args.stage)


if __name__ == "__main__":
    main()
