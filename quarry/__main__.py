"""A console for containers: ``python -m quarry list|test|extract FOLDER``; ends with 0, 1 for a failure, 2 for wrong use."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.operators import members
from quarry.sources.files import contents


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarry")
    parser.add_argument("action", choices=("list", "test", "extract"))
    parser.add_argument("path")
    parser.add_argument("--out", help="where extract writes (key, member, name, content) as Parquet")
    options = parser.parse_args(arguments)
    if options.action == "extract" and not options.out:
        parser.error("extract needs --out")
    spark = spark or SparkSession.builder.getOrCreate()
    files = contents(spark, options.path)
    if options.action == "list":
        members.list_members(files, "path").select("path", "container", "index", "name", "uncompressed_size").orderBy("path", "index").show(1000, truncate=False)
        return 0
    found = members.extract(files, "path")
    if options.action == "extract":
        found.where("status = 'ok'").write.mode("errorifexists").parquet(options.out)
    return 1 if found.where(F.col("status") != "ok").limit(1).count() else 0


if __name__ == "__main__":
    sys.exit(main())
