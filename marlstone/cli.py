"""python -m marlstone.cli: build a corpus, index it, search it, run a query by name."""

from __future__ import annotations

import argparse

from marlstone.session import session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="marlstone")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("build-corpus")
    p.add_argument("root")
    p.add_argument("out")
    p.add_argument("--chunk", type=int, default=512)
    p.add_argument("--overlap", type=int, default=128)
    p = sub.add_parser("build-index")
    p.add_argument("out")
    p.add_argument("--overwrite", action="store_true")
    p = sub.add_parser("search")
    p.add_argument("out")
    p.add_argument("question")
    p.add_argument("--until")
    p.add_argument("--source")
    p.add_argument("--limit", type=int, default=5)
    p = sub.add_parser("query")
    p.add_argument("name")
    p.add_argument("tables")
    a = parser.parse_args(argv)
    spark = session()
    from pyspark.sql import functions as F

    from marlstone import queries
    from marlstone.operators import retrieval
    from marlstone.plans import corpus

    if a.command == "build-corpus":
        corpus.build(spark, a.root, a.out, a.chunk, a.overlap).show(100, False)
    elif a.command == "build-index":
        if a.overwrite or not corpus.is_complete(spark, a.out):
            corpus.build_index(spark, a.out, True)
    elif a.command == "search":
        asked = spark.createDataFrame([(1, a.question, a.until)], "qid long, question string, cutoff string").withColumn("cutoff", F.to_date("cutoff"))
        hits = retrieval.search(spark.read.parquet(f"{a.out}/passages"), asked, a.limit, a.source)
        hits.orderBy("rank").select("rank", "score", "doc_id", "source", "timestamp", "title").show(a.limit, 80)
    else:
        queries.QUERIES[a.name](spark, a.tables).show(20, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
