import random

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from marlstone.llm import byte_bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with planted cases: toxic ones, copies, near copies, benchmark passages; ids tell which."""
    rng = random.Random(11)
    prose = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    texts = {i: prose(80) for i in range(300)}
    for i in range(0, 300, 3):
        w = texts[i].split()
        texts[i] = " ".join([*w[:40], rng.choice(["grumblefink", "snotwarble"]), *w[40:]])
    bench = [(i, prose(30)) for i in range(5)]
    texts |= {400: texts[1], 401: texts[1].upper(), 402: " ".join(["zz", *texts[2].split()[1:]]), 403: prose(30) + " " + bench[0][1] + " " + prose(30), 404: bench[1][1], 405: "", 406: None}
    d = tmp_path_factory.mktemp("tables")
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], SCHEMA)
    df.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), texts


def test_stages(spark, tables):
    d, texts = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    clean = {i for i in range(300) if i % 3}
    want = [clean | {400, 401, 402, 403, 404, 405, 406}, clean | {403, 404, 405, 406}, clean | {405, 406}, clean | {405, 406}]
    for (name, stage), ids in zip(corpus_pipeline.STAGES, want, strict=True):
        docs = stage(spark, docs, d)
        if name != "byte_level_bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = docs.collect()
        assert {r.doc_id for r in rows} == ids, name
        assert all(r.text == texts[r.doc_id] for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
        path = f"{d}/{name}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    enc = byte_bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert all(np.frombuffer(r.token_ids, "<u4").tolist() == enc.encode_ordinary(r.text or "") for r in docs.collect())
    assert {r.doc_id for r in corpus_pipeline.run(spark, d).collect()} == want[-1]


def test_empty(spark, tables):
    d, _ = tables
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        assert docs.count() == 0
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
