"""Command line: python -m weftline index STORE PATH... | query STORE QUESTION..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from weftline.config import from_env
from weftline.plans.pipeline import Engine
from weftline.session import session, ship
from weftline.sources.readers import read_files


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="weftline")
    sub = p.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index", help="build an index from files or folders")
    index.add_argument("store")
    index.add_argument("paths", nargs="+")
    ask = sub.add_parser("query", help="put questions to an index")
    ask.add_argument("store")
    ask.add_argument("questions", nargs="+")
    a = p.parse_args(argv)
    spark = session()
    ship(spark)
    engine = Engine(spark, a.store, from_env(), on_step=lambda s: print(f"... {s}", file=sys.stderr))
    if a.command == "index":
        print(engine.index(read_files(spark, *a.paths)))
    else:
        asked = spark.createDataFrame(list(enumerate(a.questions)), "query_id long, question string")
        engine.query(asked).select("question", "answer").show(truncate=False)
        engine.spark.read.parquet(f"{engine.run}/context").select("query_id", "rank", F.round("score", 4).alias("score"), "source", "position").orderBy("query_id", F.desc("score")).show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
