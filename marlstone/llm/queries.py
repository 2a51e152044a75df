"""Queries of the corpus operators: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.ngram_join import join

    return join(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links", "n_copies")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.token_counts import count_tokens

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, _tokenizer("piece_bpe_32k.model")).drop("text")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from marlstone.llm.byte_bpe import decode, encode

    ranks = _tokenizer("byte_bpe_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = encode(docs, ranks, public_tokenizers.PATTERN).drop("text")
    return decode(ids, ranks).select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm import warc
    from marlstone.llm.common import shared_dir

    path = shared_dir(spark, "warc")
    index = warc.write(warc.plan_records(_table(spark, sf_dir, "pages")), path)
    return warc.read(index, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.quotes import link

    rows = link(_table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "turn", "position", "thread", "reply_to", "n_quotes", "n_linked", F.octet_length("clean_text").cast("bigint").alias("n_bytes"), F.sha2("clean_text", 256).alias("text_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.decontaminate import find_hits

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_hits(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.licenses import scan

    return scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.ngram_lm import held_out, score, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    return score(docs, train(docs.filter(~F.col("held_out")))).drop("text")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.topk import quantise, top_k

    rows = _table(spark, sf_dir, "embeddings").select("vec_id", quantise(F.col("embedding")).alias("v"))
    return top_k(rows.filter(F.col("vec_id") % 20 == 0), rows)


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """A model that has learned from the labels of rows whose crc32 modulo 3 isn't 1."""
    from marlstone.llm.toxicity import train

    labels = _table(spark, sf_dir, "labels").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    return train(docs, labels)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.toxicity import score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return score(docs, toxicity_model(spark, docs, sf_dir)).select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_token_counts": op2_token_counts,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_warc": op4_warc,
    "op5_quote_links": op5_quote_links,
    "op6_decontamination": op6_decontamination,
    "op7_license_scan": op7_license_scan,
    "op8_lm_scores": op8_lm_scores,
    "op9_topk": op9_topk,
    "op10_toxicity": op10_toxicity,
}

_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' ')))) END AS sh FROM d),
        k AS (SELECT sh, min(doc_id) AS rep, count(*) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
        u AS (SELECT rep, len(sh) AS n, unnest(sh) AS g FROM k),
        p AS (SELECT a.rep AS x, b.rep AS y FROM u a JOIN u b ON a.g = b.g AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
        r AS (SELECT rep AS node, rep AS root FROM k UNION SELECT p.y, r.root FROM r JOIN p ON p.x = r.node),
        g AS (SELECT node, min(root) AS class_id FROM r GROUP BY node),
        l AS (SELECT x, count(*) AS n_links FROM p GROUP BY x)
        SELECT s.doc_id, coalesce(g.class_id, s.doc_id) AS class_id, coalesce(l.n_links, 0) AS n_links, coalesce(k.n, 1) AS n_copies
        FROM s LEFT JOIN k ON k.sh = s.sh LEFT JOIN g ON g.node = k.rep LEFT JOIN l ON l.x = k.rep""",
    "op4_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        r AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM r WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM r LEFT JOIN f USING (payload_digest)""",
    "op6_decontamination": f"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_SQL_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
        starts AS (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0),
        wins AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS id, least(len(w), 10) AS n, array_to_string(w[s : s + 9], ' ') AS win FROM starts),
        sizes AS (SELECT DISTINCT n FROM wins),
        scan AS (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n),
        hits AS (SELECT rid, s, scan.n, id FROM scan JOIN wins ON scan.n = wins.n AND array_to_string(w[s : s + scan.n - 1], ' ') = win),
        spots AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY rid),
        items AS (SELECT rid, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM hits GROUP BY rid)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN spots USING (rid) LEFT JOIN items USING (rid)""",
    "op9_topk": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 20""",
}
