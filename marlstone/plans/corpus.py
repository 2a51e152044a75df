"""From a snapshot to a searchable corpus: passages, statistics and a BM25 index as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators import evaluate, retrieval
from marlstone.sources import records


def passages(docs: DataFrame, size: int = retrieval.CHUNK, overlap: int = retrieval.OVERLAP) -> DataFrame:
    """Chunks of normalised records: id (record::chunkNNNN), doc_id, source, timestamp, title, content, contents, url, chunk_idx."""
    rows = retrieval.chunks(docs.withColumn("_body", F.coalesce(F.nullif(F.col("body"), F.lit("")), F.col("title"))), "_body", size, overlap)
    return rows.select(F.concat("id", F.lit("::chunk"), F.lpad(F.col("chunk_idx").cast("string"), 4, "0")).alias("id"), F.col("id").alias("doc_id"), "source", F.col("day").alias("timestamp"), "title", F.col("chunk").alias("content"), X.compose(F.col("title"), F.col("chunk")).alias("contents"), "url", "chunk_idx")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds row_index: a number for each row that rises with the order (with gaps), found by a sort in ranges."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("row_index", F.monotonically_increasing_id())


def build(spark: SparkSession, root: str, out: str, size: int = retrieval.CHUNK, overlap: int = retrieval.OVERLAP, strict: bool = False) -> DataFrame:
    """Writes out/passages, by source, and out/stats; returns the statistics."""
    rows = numbered(passages(records.normalized(records.snapshot(spark, root), strict), size, overlap), ["source", "doc_id", "chunk_idx"])
    rows.write.mode("overwrite").partitionBy("source").parquet(f"{out}/passages")
    stats = evaluate.corpus_stats(spark.read.parquet(f"{out}/passages"))
    stats.write.mode("overwrite").parquet(f"{out}/stats")
    return spark.read.parquet(f"{out}/stats")


def build_index(spark: SparkSession, out: str, overwrite: bool = False) -> None:
    """Writes out/postings (row, term, tf, dl), dealt and sorted by term so that a query reads few files, and out/index (documents, mean length)."""
    docs = spark.read.parquet(f"{out}/passages")
    mode = "overwrite" if overwrite else "errorifexists"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    retrieval.postings(docs, "row_index", X.tokens(F.col("contents"))).repartitionByRange(n, "term", "row").sortWithinPartitions("term", "row").write.mode(mode).parquet(f"{out}/postings")
    retrieval.index_stats(docs, X.tokens(F.col("contents"))).write.mode(mode).parquet(f"{out}/index")


def is_complete(spark: SparkSession, out: str) -> bool:
    """Whether the index covers as many passages as there are."""
    try:
        return spark.read.parquet(f"{out}/index").first().n_docs == spark.read.parquet(f"{out}/passages").count()
    except Exception as e:  # no table is there, or none that can be read
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise


def search_index(spark: SparkSession, out: str, queries: DataFrame, k: int = 20) -> DataFrame:
    """BM25 over a written index: the terms asked for are pushed to the scan of postings if they are few."""
    asked = queries.select("qid", F.explode(X.tokens(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    found = spark.read.parquet(f"{out}/postings")
    few = [r.term for r in asked.select("term").distinct().limit(1001).collect()]
    found = found.filter(F.col("term").isin(few)) if len(few) <= 1000 else found.join(asked.select("term").distinct(), "term", "left_semi")
    stats = spark.read.parquet(f"{out}/index").first()
    idf = found.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log(1 + (stats.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = F.col("idf") * F.col("tf") * (retrieval.K1 + 1) / (F.col("tf") + retrieval.K1 * (1 - retrieval.B + retrieval.B * F.col("dl") / stats.avgdl)) * F.col("qtf")
    return retrieval.ranked(found.join(idf, "term").join(asked, "term").groupBy("qid", "row").agg(F.sum(part).alias("score")), k)
