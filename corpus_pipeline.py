"""Documents for training, from raw ones, in stages: each takes (spark, docs, sf_dir) and returns the documents it keeps.

Documents predicted to be toxic go; of each group of near duplicates one stays; documents that hold a passage of the benchmark go; the texts of the rest are
encoded. All but the last stage return the columns of documents as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.byte_bpe import encode
from marlstone.llm.common import written
from marlstone.llm.decontaminate import remove_documents
from marlstone.llm.ngram_join import keep_one
from marlstone.llm.queries import toxicity_model
from marlstone.llm.toxicity import score

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the cut, by a model of those that have labels."""
    return score(docs, toxicity_model(spark, docs, sf_dir)).filter("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links of five-word runs connect, the one of smallest id."""
    return keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark's texts."""
    return remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the token ids of their whole texts."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("byte_level_bpe", tokenize),
]

#: SQL can express neither the first stage nor the last; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
