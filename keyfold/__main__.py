"""python -m keyfold QUERY [ARGUMENT...] < input.json: the input is ``stdin``, the arguments are ``argv``."""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from .api import query, run
from .sources.sinks import dumps


def main(argv: list[str]) -> int:
    if not argv:
        print(__doc__, file=sys.stderr)
        return 2
    given = "" if sys.stdin.isatty() else sys.stdin.read()
    spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    print(dumps(run(spark, query(argv[0]), stdin=json.loads(given) if given.strip() else None, argv=argv[1:]).collect()))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
