"""spark-submit entry: ``python -m chronoweave QUERY SF_DIR OUT`` writes a query's result; ``--health`` tells the setup."""

from __future__ import annotations

import json
import sys

from chronoweave.plans import registry
from chronoweave.plans.pipeline import health
from chronoweave.sources.config import load, load_env_file


def main(args: list[str]) -> int:
    load_env_file()
    if args == ["--health"]:
        print(json.dumps(health(load())))
        return 0
    if len(args) != 3 or args[0] not in registry.queries():
        print(__doc__, "\nQueries:", *sorted(registry.queries()), file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("chronoweave").getOrCreate()
    registry.queries()[args[0]](spark, args[1]).write.parquet(args[2])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
