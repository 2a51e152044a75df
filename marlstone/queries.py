"""Queries of the library's operators on the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import html, markdown
from marlstone.functions import text as X
from marlstone.functions import times as D
from marlstone.functions import urls as U
from marlstone.functions import values as V
from marlstone.operators import evaluate, memory, retrieval, selection, series
from marlstone.plans import questions
from marlstone.sources import records
from marlstone.storage import shared_dir
from marlstone.streaming import tail

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT doc_id, sha1(concat_ws('|', 'documents', source, CAST(doc_id AS VARCHAR))) AS record_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS content, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n FROM documents")
def corpus_normalize(spark, sf):
    docs = table(spark, sf, "documents")
    content = X.clean(F.col("text"))
    return docs.select("doc_id", X.record_id(F.lit("documents"), F.col("source"), F.col("doc_id")).alias("record_id"), content.alias("content"), F.length(content).cast("bigint").alias("n"))


_CHUNK = """WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \\n\\t\\r\\f\\v]+') AS w FROM documents),
    s AS (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 512 THEN [0] ELSE generate_series(0, len(w) - 129, 384) END) AS start FROM w)
    SELECT doc_id, CAST(start / 384 AS INTEGER) AS chunk_idx, CAST(start AS INTEGER) AS start, CAST(len(w[start + 1 : start + 512]) AS INTEGER) AS n_tokens, md5(array_to_string(w[start + 1 : start + 512], ' ')) AS chunk_md5 FROM s"""


@query(_CHUNK)
def chunk_words(spark, sf):
    rows = retrieval.chunks(table(spark, sf, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "chunk_idx", "start", "n_tokens", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


_TOKENS = "list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x))"
_POSTINGS = f"d AS (SELECT doc_id, {_TOKENS} AS w FROM documents), p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL)"


@query(f"WITH {_POSTINGS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, CAST(max(tf) AS BIGINT) AS max_tf FROM tf GROUP BY term")
def bm25_index_stats(spark, sf):
    p = retrieval.postings(table(spark, sf, "documents"), "doc_id", X.tokens(F.col("text")))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


def _bm25_sql(postings: str, tokens: str, gain: str) -> str:
    return f"""WITH {postings}, st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({tokens}) AS term FROM benchmark) GROUP BY ALL),
    s AS (SELECT qid, doc_id AS "row", sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {gain} / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * qtf) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, "row") AS INTEGER) AS rank FROM s WHERE score > 0)
    SELECT qid, "row", round(score, 6) AS score, rank FROM r WHERE rank <= 20"""


@query(_bm25_sql(_POSTINGS, _TOKENS, "2.5"))
def bm25_topk(spark, sf):
    best = retrieval.bm25(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text", 20)
    return best.select("qid", "row", F.round("score", 6).alias("score"), "rank")


_DENSE = """s AS (SELECT q.vec_id AS qid, c.vec_id AS "row", list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0),
    dense AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, "row") AS INTEGER) AS rank FROM s)"""


@query(f'WITH {_DENSE} SELECT qid, "row", round(score, 6) AS score, rank FROM dense WHERE rank <= 20')
def dense_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    best = retrieval.dense(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", "vec_id", "embedding", 20)
    return best.select("qid", "row", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_DENSE}, lab AS (SELECT q.vec_id AS qid, c.vec_id AS "row", row_number() OVER (PARTITION BY q.vec_id ORDER BY c.vec_id) AS rank FROM embeddings q JOIN embeddings c USING (label) WHERE q.vec_id % 50 = 0),
    e AS (SELECT qid, "row", rank, 0 AS ranker FROM dense WHERE rank <= 20 UNION ALL SELECT qid, "row", rank, 1 FROM lab WHERE rank <= 20),
    f AS (SELECT qid, "row", sum(1.0 / (60 + rank)) AS score, min({{'a': ranker, 'b': rank}}) AS spot FROM e GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, spot, "row") AS INTEGER) AS rank FROM f)
    SELECT qid, "row", round(score, 9) AS score, rank FROM r WHERE rank <= 10""")
def hybrid_rrf(spark, sf):
    e = table(spark, sf, "embeddings")
    dense = retrieval.dense(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", "vec_id", "embedding", 20)
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "label")
    lexical = asked.join(e.select(F.col("vec_id").alias("row"), "label"), "label").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("row"))).filter("rank <= 20")
    return retrieval.fuse([dense, lexical], 10).select("qid", "row", F.round("score", 9).alias("score"), "rank")


@query("""WITH q AS (SELECT o_orderkey AS qid, o_custkey AS user_id, o_orderdate AS d FROM orders),
    m AS (SELECT DISTINCT user_id % 50 AS k, CAST(ts AS DATE) AS day FROM events)
    SELECT qid, k, CAST(day AS VARCHAR) AS day FROM q JOIN m ON q.user_id % 50 = m.k WHERE day <= DATE '2024-01-01' + CAST(qid % 30 AS INTEGER)""")
def asof_cutoff_search(spark, sf):
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("qid"), (F.col("o_custkey") % 50).alias("k"), F.date_add(F.lit("2024-01-01").cast("date"), F.expr("o_orderkey % 30").cast("int")).alias("cutoff"))
    days = table(spark, sf, "events").select((F.col("user_id") % 50).alias("k"), F.to_date("ts").alias("day")).distinct()
    return retrieval.cutoff(asked.join(days, "k"), "day", "cutoff").select("qid", "k", F.col("day").cast("string").alias("day"))


@query("""SELECT qid, source_type, rank, position FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN nth > 2 THEN 1 ELSE 0 END, rank) AS position FROM
    (SELECT *, row_number() OVER (PARTITION BY qid, source_type ORDER BY rank) AS nth FROM
    (SELECT o_custkey AS qid, o_orderstatus AS source_type, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders))) WHERE position <= 5""")
def diversify_hits(spark, sf):
    by = Window.partitionBy("qid").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    hits = table(spark, sf, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderstatus").alias("source_type"), "o_totalprice", "o_orderkey").withColumn("rank", F.row_number().over(by))
    return retrieval.diversify(hits, 5, 2).select("qid", "source_type", F.col("rank").cast("bigint").alias("rank"), F.col("position").cast("bigint").alias("position"))


_DAILY = "SELECT user_id, CAST(ts AS DATE) AS day, arg_max(value / 500, event_id) AS p FROM events WHERE value / 500 BETWEEN 0 AND 1 GROUP BY ALL"


def _daily(spark, sf):
    points = table(spark, sf, "events").select("user_id", "ts", "event_id", (F.col("value") / 500).alias("p"))
    return series.daily_last(points, "user_id", "ts", "p", "event_id")


@query(f"SELECT user_id, CAST(day AS VARCHAR) AS day, p FROM ({_DAILY})")
def daily_last_value(spark, sf):
    return _daily(spark, sf).withColumn("day", F.col("day").cast("string"))


@query(f"""WITH s AS ({_DAILY}), d AS (SELECT *, abs(p - lag(p) OVER (PARTITION BY user_id ORDER BY day)) AS c FROM s),
    v AS (SELECT user_id, day, p, coalesce(avg(c) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0) AS v FROM d),
    x AS (SELECT *, 0.6 * (1 - 2 * abs(p - 0.5)) + 0.4 * least(v / 0.05, 1) AS s FROM v)
    SELECT user_id, CAST(day AS VARCHAR) AS day, round(v, 9) AS volatility, CASE WHEN s >= 0.58 THEN 'hard' WHEN s >= 0.30 THEN 'medium' ELSE 'easy' END AS difficulty FROM x""")
def local_volatility(spark, sf):
    rows = series.volatility(_daily(spark, sf), "user_id", "day", "p")
    return rows.select("user_id", F.col("day").cast("string").alias("day"), F.round("volatility", 9).alias("volatility"), V.difficulty(F.col("p"), F.col("volatility")).alias("difficulty"))


@query("""WITH t AS (SELECT DISTINCT user_id, o AS offset_days, TIMESTAMP '2024-01-28 12:00:00' - o * INTERVAL 1 DAY AS target FROM events, (VALUES (1), (7), (26)) v(o)),
    j AS (SELECT t.user_id, offset_days, target, ts, value FROM t LEFT JOIN events e ON e.user_id = t.user_id),
    g AS (SELECT user_id, offset_days, max(CASE WHEN ts <= target THEN {'t': ts, 'v': value} END) AS b, min(CASE WHEN ts > target AND ts <= target + least(greatest(offset_days // 4, 1), 7) * INTERVAL 1 DAY THEN {'t': ts, 'v': value} END) AS f FROM j GROUP BY ALL)
    SELECT user_id, offset_days, coalesce(b.v, f.v) AS value FROM g""")
def sampled_points(spark, sf):
    e = table(spark, sf, "events")
    offsets = F.explode(F.array(F.lit(1), F.lit(7), F.lit(26))).alias("offset_days")
    targets = e.select("user_id").distinct().select("user_id", offsets).withColumn("target", F.lit("2024-01-28 12:00:00").cast("timestamp_ntz").cast("timestamp") - F.make_dt_interval("offset_days"))
    points = e.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return series.as_of(points, targets, "user_id", "ts", "value", "target", series.forward_tolerance(F.col("offset_days"))).select("user_id", "offset_days", "value")


@query("""SELECT o_orderkey, arg_max(value, {'t': ts, 'v': value}) AS value FROM orders JOIN events ON user_id = o_custkey AND ts <= TIMESTAMP '2024-01-01' + CAST(o_orderkey % 30 AS INTEGER) * INTERVAL 1 DAY GROUP BY o_orderkey""")
def asof_price(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("o_custkey"), F.col("ts").cast("timestamp").alias("ts"), "value")
    target = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval((F.col("o_orderkey") % 30).cast("int"))
    targets = table(spark, sf, "orders").select("o_orderkey", "o_custkey").withColumn("target", target)
    return series.as_of(e, targets, "o_custkey", "ts", "value", "target").filter("value is not null").select("o_orderkey", "value")


@query("SELECT o_orderkey, least(9, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) * 10 // count(*) OVER ()) AS bucket FROM orders")
def time_buckets(spark, sf):
    return series.time_buckets(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 10).select("o_orderkey", "bucket")


@query("""WITH f AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS f FROM events),
    g AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM f),
    s AS (SELECT event_id, user_id, CAST(sum(f) OVER (PARTITION BY user_id, g ORDER BY event_id) AS BIGINT) AS streak FROM g)
    SELECT event_id, streak, coalesce(max(CASE WHEN streak >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS skipped FROM s""")
def failure_streaks(spark, sf):
    e = table(spark, sf, "events")
    return series.streaks(e.select("event_id", "user_id", "event_type"), "user_id", "event_id", F.col("event_type") == "error", 3).select("event_id", "streak", "skipped")


@query("""SELECT event_id, seen, CAST(failures AS BIGINT) AS failures, seen >= 10 AND failures / seen >= 0.3 AS tripped FROM (SELECT event_id, count(*) OVER w AS seen, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS failures FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))""")
def short_circuit(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return series.short_circuit(e, "user_id", "event_id", F.col("event_type") == "error", 10, 0.3).select("event_id", "seen", "failures", "tripped")


@query("SELECT event_id, round(s, 6) AS spent, s <= 500 AS allowed FROM (SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events)")
def running_budget(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    return series.within_budget(e, "user_id", "event_id", F.col("value"), 500.0).select("event_id", F.round("spent", 6).alias("spent"), "allowed")


@query("SELECT user_id, CAST(day AS VARCHAR) AS day, round(p, 9) AS p FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS n FROM (" + _DAILY + ")) WHERE n <= 5")
def latest_points(spark, sf):
    return series.latest(_daily(spark, sf), "user_id", "day", 5).select("user_id", F.col("day").cast("string").alias("day"), F.round("p", 9).alias("p"))


@query("""SELECT c_custkey, c_mktsegment, CAST(row_number() OVER (ORDER BY n, c_mktsegment) AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) QUALIFY position <= 100""")
def round_robin_sample(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return selection.round_robin(c, ["c_mktsegment"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 100).select("c_custkey", "c_mktsegment", "position")


@query("""SELECT p_partkey, CAST(row_number() OVER (ORDER BY n, p_type, p_size) AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY p_type, p_size ORDER BY p_partkey) AS n FROM part) WHERE n <= 2 QUALIFY position <= 150""")
def round_robin_capped(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_size")
    return selection.round_robin(p, ["p_type", "p_size"], [F.col("p_partkey")], 150, 2).select("p_partkey", "position")


@query("SELECT s_suppkey, s_nationkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) AS turn, count(*) OVER (PARTITION BY s_nationkey) AS group_size, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS first_seen FROM supplier")
def interleave_domains(spark, sf):
    return selection.interleave(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", "s_suppkey").select("s_suppkey", "s_nationkey", "turn", "group_size", "first_seen")


@query()
def balanced_subset(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("domain"), F.when(F.col("p_size") < 17, "easy").when(F.col("p_size") < 34, "medium").otherwise("hard").alias("difficulty"), (F.col("p_partkey") % 4).alias("open_bucket"), (F.col("p_partkey") % 3).alias("resolve_bucket"))
    return selection.select_subset(p, "p_partkey", 60, 20260313)


@query("""WITH s AS (SELECT p_size % 3 AS horizon, p_type, p_partkey FROM part), n AS (SELECT horizon, p_type, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 5), c AS (SELECT horizon, greatest(10, floor(min(n) * 1.1)) AS cap FROM n GROUP BY horizon)
    SELECT horizon, p_type, p_partkey FROM (SELECT s.*, row_number() OVER (PARTITION BY s.horizon, s.p_type ORDER BY p_partkey) AS k FROM s JOIN n ON n.horizon = s.horizon AND n.p_type = s.p_type) JOIN c USING (horizon) WHERE k <= cap""")
def balanced_panel(spark, sf):
    p = table(spark, sf, "part").select((F.col("p_size") % 3).alias("horizon"), "p_type", "p_partkey")
    return selection.capped_panels(p, "horizon", "p_type", [F.col("p_partkey")], 1.1, 10, 5).select("horizon", "p_type", "p_partkey")


_FORECASTS = "f AS (SELECT doc_id, (doc_id * 37 % 101) / 100.0 AS p, toxic AS label, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS method, doc_id % 7 / 10.0 AS latency, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 100 END AS tokens FROM labels)"
_BINS = "b AS (SELECT *, CASE " + " ".join(f"WHEN CAST(p AS DOUBLE) >= {i} / CAST(10 AS DOUBLE) THEN {i}" for i in range(9, 0, -1)) + " ELSE 0 END AS bin FROM f)"


def _forecasts(spark, sf):
    d = F.col("doc_id")
    return table(spark, sf, "labels").select(d, ((d * 37 % 101) / 100.0).alias("predicted_prob"), F.col("toxic").alias("label"), F.when(d % 2 == 0, "a").otherwise("b").alias("method"), (d % 7 / 10.0).alias("latency_sec"), F.when(d % 3 != 0, d % 100).alias("total_tokens"), F.lit(None).cast("bigint").alias("steps_count"))


@query(f"WITH {_FORECASTS}, {_BINS} SELECT bin, count(*) AS count, round(avg(CAST(p AS DOUBLE)), 9) AS avg_pred, round(avg(label), 9) AS avg_label, round(abs(avg(CAST(p AS DOUBLE)) - avg(label)), 9) AS gap FROM b GROUP BY bin")
def ece_bins(spark, sf):
    c = evaluate.calibration(_forecasts(spark, sf), "predicted_prob", "label")
    return c.select("bin", "count", *[F.round(x, 9).alias(x) for x in ("avg_pred", "avg_label", "gap")])


@query(f"""WITH {_FORECASTS}, {_BINS}, g AS (SELECT method, bin, count(*) AS n, abs(avg(CAST(p AS DOUBLE)) - avg(label)) AS gap FROM b GROUP BY ALL), e AS (SELECT method, sum(n * gap) / sum(n) AS ece FROM g GROUP BY method)
    SELECT method, count(*) AS n, round(avg(CASE WHEN CAST(p >= 0.5 AS INTEGER) = label THEN 1.0 ELSE 0.0 END), 9) AS accuracy, round(avg(pow(CAST(p AS DOUBLE) - label, 2)), 9) AS brier, round(any_value(ece), 9) AS ece, round(avg(CAST(latency AS DOUBLE)), 9) AS latency, round(avg(tokens), 9) AS tokens FROM f JOIN e USING (method) GROUP BY method""")
def method_summary(spark, sf):
    s = evaluate.summary(_forecasts(spark, sf), ["method"])
    return s.select("method", "n", *[F.round(x, 9).alias(x) for x in ("accuracy", "brier", "ece", "latency", "tokens")])


@query("SELECT event_type, count(*) AS count FROM events GROUP BY event_type UNION ALL SELECT 'total', count(*) FROM events")
def status_counts(spark, sf):
    return evaluate.counts_with_total(table(spark, sf, "events"), "event_type")


@query("SELECT source, count(DISTINCT doc_id) AS documents, count(*) AS passages FROM documents GROUP BY source UNION ALL SELECT 'total', count(DISTINCT doc_id), count(*) FROM documents")
def corpus_stats(spark, sf):
    return evaluate.corpus_stats(table(spark, sf, "documents"))


@query("""WITH r AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, [o_orderstatus, o_orderpriority] AS subjects, o_orderkey % 1000 AS tokens FROM orders),
    e AS (SELECT 'month' AS dimension, month AS value, tokens FROM r UNION ALL SELECT 'subject', unnest(subjects), tokens FROM r)
    SELECT dimension, value, count(*) AS count, CAST(sum(tokens) AS BIGINT) AS tokens, round(avg(tokens), 2) AS avg_tokens FROM e GROUP BY ALL""")
def subject_stats(spark, sf):
    return evaluate.subject_stats(table(spark, sf, "orders"), F.date_format("o_orderdate", "yyyy-MM"), F.array("o_orderstatus", "o_orderpriority"), F.col("o_orderkey") % 1000)


@query("SELECT p_size % 3 AS horizon, p_type AS domain, p_brand AS difficulty, count(*) AS count FROM part GROUP BY GROUPING SETS ((p_size % 3, p_type), (p_size % 3, p_brand))")
def pool_availability(spark, sf):
    p = table(spark, sf, "part").select((F.col("p_size") % 3).alias("horizon"), F.col("p_type").alias("domain"), F.col("p_brand").alias("difficulty"))
    return evaluate.availability(p, "horizon", "domain", "difficulty")


@query("""WITH n AS (SELECT p_size % 3 AS horizon, p_type, count(*) AS n FROM part GROUP BY ALL)
    SELECT horizon, CAST(sum(n) AS BIGINT) AS size, count(*) FILTER (n >= 20) AS active_domains, round(max(n) FILTER (n >= 20) / CAST(min(n) FILTER (n >= 20) AS DOUBLE), 9) AS domain_ratio,
    sum(n) >= 100 AND (count(*) FILTER (n >= 20) < 2 OR coalesce(max(n) FILTER (n >= 20) / CAST(min(n) FILTER (n >= 20) AS DOUBLE), 1) <= 1.5) AS ok FROM n GROUP BY horizon""")
def panel_status(spark, sf):
    p = table(spark, sf, "part").select((F.col("p_size") % 3).alias("horizon"), "p_type")
    return evaluate.panel_status(p, "horizon", "p_type", 100, 20, 1.5).withColumn("domain_ratio", F.round("domain_ratio", 9))


@query("SELECT CASE WHEN l_quantity < 2 THEN 'small' WHEN l_discount > 0.08 THEN 'cheap' WHEN l_returnflag = 'R' THEN 'returned' END AS reject_reason, count(*) AS count FROM lineitem GROUP BY 1")
def reject_reasons(spark, sf):
    rules = [("small", F.col("l_quantity") < 2), ("cheap", F.col("l_discount") > 0.08), ("returned", F.col("l_returnflag") == "R")]
    return evaluate.reject_reasons(table(spark, sf, "lineitem"), rules).groupBy("reject_reason").agg(F.count("*").alias("count"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS count FROM orders GROUP BY 1")
def monthly_distribution(spark, sf):
    return table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("count"))


_HOST = "nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1), '')"


@query(f"SELECT page_id, {_HOST} AS host, array_to_string(list_slice(string_split({_HOST}, '.'), -2, -1), '.') AS domain, (contains(lower(url), '/en') OR NOT regexp_matches(lower(url), '/(zh|cn|fr|de|es|ja|ko)/')) AS english, 'news/' || regexp_replace({_HOST}, '^www\\.', '') AS source FROM pages")
def url_scalars(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", U.host(u).alias("host"), U.domain(u).alias("domain"), U.is_english(u).alias("english"), U.news_source(F.lit(None).cast("string"), u).alias("source"))


@query(f"""WITH p AS (SELECT page_id, url, array_to_string(list_slice(string_split({_HOST}, '.'), -2, -1), '.') AS domain FROM pages WHERE contains(lower(url), '/en') OR NOT regexp_matches(lower(url), '/(zh|cn|fr|de|es|ja|ko)/'))
    SELECT url, domain, CASE domain WHEN 'example.com' THEN 'Example' ELSE 'Example Org' END AS source_name, 'pending' AS status FROM p WHERE domain IN ('example.com', 'example.org') QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1""")
def url_pool(spark, sf):
    rows = table(spark, sf, "pages").select(F.col("page_id").alias("pos"), F.lit("20240101").alias("DATE"), F.lit("").alias("THEMES"), F.lit("").alias("SOURCES"), F.col("url").alias("SOURCEURLS"))
    whitelist = spark.createDataFrame([("example.com", "Example"), ("example.org", "Example Org")], "domain string, name string")
    return records.url_pool(rows, whitelist).select("url", "domain", "source_name", "status")


@query()
def html_main_text(spark, sf):
    return html.extract(table(spark, sf, "pages").select("page_id", "html")).select("page_id", "title", "description", "main_text", "n_blocks")


@query()
def markdown_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", markdown.body(F.col("text")).alias("body"), markdown.long_lines(F.col("text")).alias("long_lines"))


@query("SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def dedup_first_wins(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    first = docs.groupBy(F.md5("text").alias("k")).agg(F.min("doc_id").alias("doc_id"))  # keys and ids are grouped, not texts
    return docs.join(first.select("doc_id"), "doc_id", "left_semi")


@query("SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def last_row_wins(spark, sf):
    return records.last_wins(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")


@query("SELECT user_id, event_type, event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def resume_unseen(spark, sf):
    new = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    seen = table(spark, sf, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"))
    return tail.unseen(new, seen, "user_id", "event_id")


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT * FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, ts, user_id, event_type, value * 2, props FROM events WHERE event_id % 3 = 0) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def upsert_compaction(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return tail.upsert(e.filter("event_id % 3 <> 0"), e.filter("event_id % 3 = 0").withColumn("value", F.col("value") * 2), "user_id", "event_id")


@query("SELECT e.user_id, event_id FROM events e LEFT JOIN (SELECT c_custkey AS user_id, TIMESTAMP '2024-01-15' + CAST(c_custkey % 10 AS INTEGER) * INTERVAL 1 DAY AS seen FROM customer WHERE c_custkey % 2 = 0) s USING (user_id) WHERE ts > greatest(coalesce(seen, TIMESTAMP '2024-01-20'), TIMESTAMP '2024-01-20')")
def high_water_mark(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    state = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), (F.lit("2024-01-15 00:00:00").cast("timestamp") + F.make_dt_interval((F.col("c_custkey") % 10).cast("int"))).alias("last_seen"))
    return tail.high_water(e, "user_id", "ts", state, "2024-01-20 00:00:00").select("user_id", "event_id")


@query("""SELECT 'except' AS op, k FROM (SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'intersect', k FROM (SELECT o_orderkey AS k FROM orders INTERSECT SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'union', k FROM (SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer)""")
def set_ops(spark, sf):
    o, li, c = table(spark, sf, "orders"), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    keys = o.select(F.col("o_orderkey").alias("k"))
    parts = [("except", keys.subtract(li)), ("intersect", keys.intersect(li)), ("union", o.select(F.col("o_custkey").alias("k")).union(c).distinct())]
    out = None
    for name, d in parts:
        d = d.select(F.lit(name).alias("op"), "k")
        out = d if out is None else out.unionByName(d)
    return out


@query("""WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '```json' || chr(10) || '{"predicted_prob": ' || CAST(value / 1000 AS VARCHAR) || '}' || chr(10) || '```' WHEN 1 THEN 'I say probability: ' || CAST(event_id % 100 + 1 AS VARCHAR) || '%' WHEN 2 THEN '{"probability": "' || CAST(event_id % 97 + 2 AS VARCHAR) || '"}' ELSE 'nothing here' END AS x FROM events)
    SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN CASE WHEN v <= 1 THEN v WHEN v <= 100 THEN v / 100 END WHEN 1 THEN (event_id % 100 + 1) / 100.0 WHEN 2 THEN (event_id % 97 + 2) / 100.0 END, 9) AS p FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(regexp_extract(x, ': ([0-9.eE+-]+)', 1) AS DOUBLE) END AS v FROM t)""")
def prob_parse(spark, sf):
    i = F.col("event_id")
    fenced = F.concat(F.lit('```json\n{"predicted_prob": '), (F.col("value") / 1000).cast("string"), F.lit("}\n```"))
    text = F.when(i % 4 == 0, fenced).when(i % 4 == 1, F.concat(F.lit("I say probability: "), (i % 100 + 1).cast("string"), F.lit("%"))).when(i % 4 == 2, F.concat(F.lit('{"probability": "'), (i % 97 + 2).cast("string"), F.lit('"}'))).otherwise("nothing here")
    return table(spark, sf, "events").select("event_id", F.round(V.forecast_probability(text), 9).alias("p"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, sha1(concat_ws('|', event_type, '', CAST(user_id AS VARCHAR))) AS id, regexp_replace(regexp_replace(lower(event_type), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, greatest((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 8.64e10, 0) AS days FROM events""")
def scalar_functions(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    days = D.duration_days(F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return e.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"), X.record_id(F.col("event_type"), F.lit(None), F.col("user_id")).alias("id"), X.slug(F.col("event_type")).alias("slug"), D.iso(F.col("ts")).alias("iso"), days.alias("days"))


@query("SELECT doc_id, CASE WHEN length(c) <= 80 THEN c ELSE rtrim(substr(c, 1, 77)) || '...' END AS compact, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS question_key, regexp_matches(text, '[.!?。！？]') AS sentence, len(regexp_extract_all(text, '[\\p{L}\\p{N}_\\p{M}]+')) AS n_words FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM documents)")
def text_scalars(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", X.compact(t, 80).alias("compact"), X.question_key(t).alias("question_key"), X.is_sentence(t).alias("sentence"), X.token_count(t).cast("bigint").alias("n_words"))


@query("""SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS step, role = 'assistant' AND turn = max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS is_final, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 120) AS preview FROM conversations""")
def conversation_trace(spark, sf):
    c, by = table(spark, sf, "conversations"), Window.partitionBy("conv_id")
    final = (F.col("role") == "assistant") & (F.col("turn") == F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(by))
    return c.select("conv_id", "turn", "role", F.row_number().over(by.orderBy("turn")).alias("step"), F.coalesce(final, F.lit(False)).alias("is_final"), F.left(X.clean(F.col("text")), F.lit(120)).alias("preview"))


ORACLE_SQL["conversation_trace"] = ORACLE_SQL["conversation_trace"].replace("role = 'assistant' AND turn = max(", "coalesce(role = 'assistant' AND turn = max(").replace("OVER (PARTITION BY conv_id) AS is_final", "OVER (PARTITION BY conv_id), false) AS is_final")


@query("""SELECT conv_id, turn, n_before, n_before < 2 AS allowed FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id, q ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_before FROM (SELECT *, md5(trim(regexp_replace(lower(role), '[^a-z0-9]+', ' ', 'g'))) AS q FROM conversations))""")
def repeated_query_block(spark, sf):
    c = table(spark, sf, "conversations").withColumn("q", F.md5(X.question_key(F.col("role")).cast("binary")))
    before = F.count("*").over(Window.partitionBy("conv_id", "q").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    return c.select("conv_id", "turn", before.alias("n_before"), (before < 2).alias("allowed"))


_EXPERIENCES = "SELECT vec_id, embedding, label, CASE vec_id % 3 WHEN 0 THEN 'strategy' WHEN 1 THEN 'pattern' ELSE 'case' END AS level, vec_id % 30 AS resolved FROM embeddings"


def _store(spark, sf):
    e, i = table(spark, sf, "embeddings"), F.col("vec_id")
    text = lambda p: F.concat(F.lit(p), i.cast("string"))
    day = lambda n: F.concat(F.lit("2024-01-"), F.lpad((n + 1).cast("string"), 2, "0"))
    return e.select(
        F.lpad(i.cast("string"), 9, "0").alias("experience_id"), text("q").alias("source_question_id"), F.concat(F.lit("d"), F.col("label").cast("string")).alias("domain"), F.lit("golden").alias("zone"),
        F.when(i % 3 == 0, "strategy").when(i % 3 == 1, "pattern").otherwise("case").alias("level"), text("t").alias("title"), text("s").alias("summary"), text("c").alias("content"), day(i % 30).alias("created_at"),
        day(F.lit(0)).alias("source_open_time"), day(i % 30).alias("source_resolved_time"), F.lit(1).alias("outcome"), F.lit(True).alias("correctness"), F.lit(1).cast("bigint").alias("support_count"), F.array(text("q")).alias("merged_from"), F.col("embedding").cast("array<double>").alias("embedding"),
    )


@query()
def memory_merge(spark, sf):
    return memory.consolidate(_store(spark, sf), 0.5).drop("embedding")


def _asked(spark, sf):
    return table(spark, sf, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("vector"), F.concat(F.lit("d"), F.col("label").cast("string")).alias("domain"), F.lit("2024-01-15").alias("cutoff"))


_HITS = f"""WITH s AS ({_EXPERIENCES}), h AS (SELECT q.vec_id AS qid, s.vec_id, s.level, s.resolved, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[])) AS score FROM embeddings q JOIN s ON q.label = s.label WHERE q.vec_id % 50 = 0 AND s.resolved <= 14),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, resolved DESC, vec_id DESC) AS INTEGER) AS rank FROM h)"""


@query(f"{_HITS} SELECT qid, lpad(CAST(vec_id AS VARCHAR), 9, '0') AS experience_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def memory_retrieve(spark, sf):
    return memory.retrieve(_store(spark, sf), _asked(spark, sf), 5, domain="domain").select("qid", "experience_id", F.round("score", 6).alias("score"), "rank")


@query(f"{_HITS}, b AS (SELECT *, row_number() OVER (PARTITION BY qid, level ORDER BY round(score, 9) DESC, resolved DESC, vec_id DESC) AS n FROM r) SELECT qid, level, lpad(CAST(vec_id AS VARCHAR), 9, '0') AS experience_id FROM b WHERE n <= CASE level WHEN 'strategy' THEN 1 WHEN 'pattern' THEN 2 ELSE 1 END")
def memory_bundle(spark, sf):
    return memory.bundle(_store(spark, sf), _asked(spark, sf), {"strategy": 1, "pattern": 2, "case": 1}, domain="domain").select("qid", "level", "experience_id")


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1")
def stream_dedup_tail(spark, sf):
    """The events table as a stream of files, each event once, drained twice into a table: the second run finds nothing new."""
    source = table(spark, sf, "events")
    base = shared_dir(spark, "stream")
    source.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type").write.parquet(f"{base}/in")
    rows = tail.once(tail.tail(spark, f"{base}/in", "event_id bigint, ts timestamp, user_id bigint, event_type string", "parquet"), "event_id")
    for _ in range(2):
        tail.drain(rows, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select("event_id", "user_id", "event_type")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf):
    out = tail.windows(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", ["event_type"])
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT CAST(list_position([7, 3, 11, 3000000, 5], o_orderkey) - 1 AS INTEGER) AS pos, o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (7, 3, 11, 5)")
def fixed_subset(spark, sf):
    ids = spark.createDataFrame([([7, 3, 11, 5],)], "ids array<bigint>").select(F.posexplode("ids").alias("pos", "o_orderkey"))
    return ids.join(table(spark, sf, "orders"), "o_orderkey").select("pos", "o_orderkey", "o_custkey")


ORACLE_SQL["fixed_subset"] = ORACLE_SQL["fixed_subset"].replace("3000000, ", "")


_REASONS = ["Connection refused by host", "connection reset by peer", "httpx.ConnectTimeout", "timed out", "ReadTimeout after 30s", "timed out while reading", "engine_http_", "status=", "DNS lookup failed", "unknown"]


@query("SELECT event_id, ['connect', 'other', 'connect', 'other', 'read', 'read', 'http', 'http', 'connect', 'other'][CAST(event_id % 10 AS INTEGER) + 1] AS stage, CASE WHEN event_id % 10 = 6 THEN CAST(400 + event_id % 100 AS INTEGER) END AS status FROM events")
def failure_classes(spark, sf):
    i = F.col("event_id")
    reason = F.element_at(F.lit(_REASONS), (i % 10 + 1).cast("int"))
    reason = F.when(i % 10 == 6, F.concat(reason, (400 + i % 100).cast("string"))).otherwise(reason)
    return table(spark, sf, "events").select("event_id", X.failure_stage(reason).alias("stage"), X.http_status(reason).alias("status"))


@query("SELECT p_name AS question, count(*) AS n, 6.0 * (count(*) - 1) AS penalty FROM part GROUP BY p_name")
def near_duplicate_questions(spark, sf):
    p = table(spark, sf, "part").withColumn("k", X.question_key(F.col("p_name")))
    return p.groupBy("k").agg(F.count("*").alias("n")).select(F.col("k").alias("question"), "n", (6.0 * (F.col("n") - 1)).alias("penalty"))


def _markets(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("market_id"), F.col("ts").cast("timestamp").alias("t"), (F.col("value") / 500).alias("p"), F.col("event_id").alias("pos"))
    ids = e.select("market_id").distinct()
    return ids.select("market_id", F.lit("2024-01-29 00:00:00").cast("timestamp").alias("resolve_ts"), F.lit(1.0).alias("final"), F.concat(F.lit("d"), (F.col("market_id") % 5).cast("string")).alias("domain"), F.concat(F.lit("Will "), F.col("market_id").cast("string"), F.lit(" happen?")).alias("question")), e


_SAMPLES = f"""s AS ({_DAILY}), d AS (SELECT *, abs(p - lag(p) OVER (PARTITION BY user_id ORDER BY day)) AS c FROM s),
    v AS (SELECT user_id, CAST(day AS TIMESTAMP) AS t, p, coalesce(avg(c) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0) AS v FROM d),
    t AS (SELECT DISTINCT user_id, o, TIMESTAMP '2024-01-29' - o * INTERVAL 1 DAY AS target FROM s, (VALUES (30), (7), (1)) x(o)),
    g AS (SELECT t.user_id, o, max(CASE WHEN t.target >= v.t THEN {{'t': v.t, 'p': p, 'v': v}} END) AS b, min(CASE WHEN v.t > target AND v.t <= target + least(greatest(o // 4, 1), 7) * INTERVAL 1 DAY THEN {{'t': v.t, 'p': p, 'v': v}} END) AS f FROM t JOIN v ON v.user_id = t.user_id GROUP BY ALL),
    x AS (SELECT user_id, o, coalesce(b.p, f.p) AS p, coalesce(b.v, f.v) AS v FROM g WHERE b IS NOT NULL OR f IS NOT NULL)"""


@query(f"WITH {_SAMPLES} SELECT user_id AS market_id, o || 'd' AS horizon, p AS p_yes, CASE WHEN 0.6 * (1 - 2 * abs(p - 0.5)) + 0.4 * least(v / 0.05, 1) >= 0.58 THEN 'hard' WHEN 0.6 * (1 - 2 * abs(p - 0.5)) + 0.4 * least(v / 0.05, 1) >= 0.30 THEN 'medium' ELSE 'easy' END AS difficulty FROM x")
def market_samples(spark, sf):
    return questions.samples(*_markets(spark, sf))


@query()
def question_set(spark, sf):
    markets, prices = _markets(spark, sf)
    return questions.select(markets.select("market_id", "domain", "question"), questions.samples(markets, prices), {"30d": 20, "7d": 30, "1d": 30}, 40)


from marlstone import contract_queries  # noqa: E402, F401  registers further queries
