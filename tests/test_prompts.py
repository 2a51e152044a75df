from pyspark.sql import functions as F

from marlstone.functions import prompts as P


def test_blocks(spark):
    df = spark.createDataFrame([("Will it?", "Line one\nline two", "line one LINE two", "sports", [("T", "info/news", "2024-01-01", "c" * 900)], [("t", "d", "c")], [(None, None, "r")] * 12)], "q string, d string, c string, m string, hits array<struct<title: string, source: string, timestamp: string, content: string>>, mem array<struct<title: string, description: string, content: string>>, steps array<struct<tool: string, arguments: string, result: string>>")
    r = df.select(
        P.search_query(F.col("q"), F.col("d"), F.col("m")), P.question_block(F.col("q"), F.col("d"), F.col("c"), F.col("m")), P.documents(F.col("hits"), 20), P.memories(F.col("mem")), P.trajectory(F.col("steps")), P.source_type(F.lit(None).cast("string"), F.lit("info/news")), P.agent_system("x", F.lit(True), F.lit(False)),
    ).first()
    assert r[0] == "Will it? Line one sports"
    assert r[1] == "Question: Will it?\nDomain: sports\nDescription: Line one line two"
    assert r[2] == "[1] T | info/news | 2024-01-01\n" + "c" * 17 + "..."
    assert r[3] == "Memory 1: t\nd\nc" and r[4].count("\n") == 9 and r[4].startswith("1. answer() -> r") and r[5] == "news" and r[6].count("\n\n") == 1
