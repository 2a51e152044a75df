import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators import evaluate, memory, retrieval, selection, series
from marlstone.sources import paged, records
from marlstone.streaming import tail


def test_chunks(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(11)))), (2, "a b"), (3, ""), (4, None)], "id long, text string")
    got = {(r.id, r.chunk_idx): (r.start, r.chunk) for r in retrieval.chunks(df, size=4, overlap=1).collect()}
    assert got == {(1, 0): (0, "0 1 2 3"), (1, 1): (3, "3 4 5 6"), (1, 2): (6, "6 7 8 9"), (1, 3): (9, "9 10"), (2, 0): (0, "a b")}
    with pytest.raises(ValueError):
        retrieval.chunks(df, size=4, overlap=4)


def brute_bm25(docs, query):
    toks = {i: [w.lower() for w in __import__("re").findall("[A-Za-z0-9_]+", t or "")] for i, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(w for t in toks.values() for w in set(t))
    out = {}
    for i, t in toks.items():
        tf = Counter(t)
        s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query.lower().split() if tf[w])
        if s > 0:
            out[i] = s
    return out


def test_bm25(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(rng.randint(0, 9)))) for i in range(30)] + [(30, None)]
    got = retrieval.bm25(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame([(1, "alpha gamma alpha"), (2, "nothing")], "q long, t string"), "id", "text", "q", "t", 40).collect()
    want = brute_bm25(docs, "alpha gamma alpha")
    assert {r.row: pytest.approx(r.score) for r in got} == want and {r.qid for r in got} == {1}
    assert [r.row for r in sorted(got, key=lambda r: r["rank"])] == sorted(want, key=lambda i: (-round(want[i], 9), i))


PASSAGES = "row_index long, source string, timestamp date, contents string"


def test_search_filters(spark):
    rows = [(0, "news/a", "2026-02-15", "apple price news"), (1, "paper/x", "2026-02-01", "apple paper"), (2, "info/news", "2026-02-01", "apple price"), (3, "info/news", "2026-01-01", "pear")]
    passages = spark.createDataFrame(rows, "row_index long, source string, timestamp string, contents string").withColumn("timestamp", F.to_date("timestamp"))
    queries = spark.createDataFrame([(1, "apple price", "2026-02-01")], "qid long, question string, cutoff string").withColumn("cutoff", F.to_date("cutoff"))
    assert [r.row for r in retrieval.search(passages, queries).orderBy("rank").collect()] == [2, 1]  # the cutoff's own day counts
    assert [r.row for r in retrieval.search(passages, queries, source="news").collect()] == [2]
    assert [r.row for r in retrieval.search(passages, queries, source="news", candidates=None).collect()] == [2]
    assert retrieval.search(passages, queries, source="book").count() == 0


def test_duplicate_ids_are_two_hits(spark):
    passages = spark.createDataFrame([(0, "dup", "info/news", "same words"), (1, "dup", "kb/book", "same words")], "row_index long, doc_id string, source string, contents string").withColumn("timestamp", F.lit("2024-01-01").cast("date"))
    queries = spark.createDataFrame([(1, "same words")], "qid long, question string").withColumn("cutoff", F.lit(None).cast("date"))
    assert sorted(r.row for r in retrieval.search(passages, queries).collect()) == [0, 1]


def test_fuse_and_diversify(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qid long, row long, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 11, 2)], "qid long, row long, rank int")
    assert [r.row for r in retrieval.fuse([a, b]).orderBy("rank").collect()] == [11, 10, 12]
    hits = spark.createDataFrame([(1, i, "a" if i < 4 else "b") for i in range(1, 6)], "qid long, rank int, source_type string")
    assert [r["rank"] for r in retrieval.diversify(hits, 4, 2).orderBy("position").collect()] == [1, 2, 4, 5]


def test_ece(spark):
    df = spark.createDataFrame(list(zip([0.05, 0.15, 0.15, 0.85, 0.95], [0, 0, 1, 1, 1], strict=True)), "p double, y int")
    assert evaluate.ece(df, "p", "y").first().ece == pytest.approx(0.19)
    bins = {r.bin: r for r in evaluate.calibration(df, "p", "y").collect()}
    assert sorted(bins) == [0, 1, 8, 9] and bins[1].avg_pred == pytest.approx(0.15) and bins[1].avg_label == 0.5
    assert evaluate.ece(df.limit(0), "p", "y").first().ece == 0.0
    edge = spark.createDataFrame([(0.8999999999999999,), (1.0,)], "p double").select(evaluate.bin_of(F.col("p"), 10).alias("b"))
    assert [r.b for r in edge.collect()] == [8, 9]


def test_summary(spark):
    df = spark.createDataFrame([("m", 0.8, 1, 0.1, 15, 4)] * 3, "method string, predicted_prob double, label int, latency_sec double, total_tokens long, steps_count long")
    r = evaluate.summary(df, ["method"]).collect()
    assert evaluate.render(r).splitlines()[-1] == "| m | 1.000 | 0.0400 | 0.2000 | 0.10 | 15 | 4.0 |"


def test_series(spark):
    e = spark.createDataFrame([(1, "2024-01-01 05:00:00", 0.2, 2), (1, "2024-01-01 09:00:00", 0.9, 1), (1, "2024-01-02 01:00:00", 1.2, 3), (1, "2024-01-03 01:00:00", 0.4, 4)], "k long, t string, p double, pos long").withColumn("t", F.col("t").cast("timestamp"))
    daily = series.daily_last(e, "k", "t", "p", "pos")
    assert {str(r.day): r.p for r in daily.collect()} == {"2024-01-01": 0.2, "2024-01-03": 0.4}  # the last listed, not the latest
    whole = series.with_default(daily, spark.createDataFrame([(1, 0.0), (2, 1.0)], "k long, final double"), "k", F.lit("2024-02-01").cast("date"), F.col("final"))
    assert whole.filter("k = 2").count() == 1
    targets = spark.createDataFrame([(1, "2024-01-01 06:00:00"), (1, "2023-12-31 06:00:00"), (1, "2023-12-01 00:00:00")], "k long, target string").withColumn("target", F.col("target").cast("timestamp"))
    got = {str(r.target)[:10]: r.value for r in series.as_of(e, targets, "k", "t", "p", "target", F.lit(1)).collect()}
    assert got == {"2024-01-01": 0.2, "2023-12-31": 0.2, "2023-12-01": None}
    v = series.volatility(spark.createDataFrame([(1, i, x) for i, x in enumerate([0.1, 0.3, 0.2])], "k long, t int, p double"), "k", "t", "p").orderBy("t").collect()
    assert [r.volatility for r in v] == pytest.approx([0.0, 0.2, 0.15])


def test_time_buckets(spark):
    df = spark.range(11).select("id", (F.col("id") * -1).alias("o"))
    got = {r.id: r.bucket for r in series.time_buckets(df, ["o"], 4).collect()}
    assert got == {10 - i: min(3, i * 4 // 11) for i in range(11)}
    assert series.time_buckets(df.limit(0), ["o"], 4).count() == 0


def test_streaks(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate("FFSFFFSF")], "d string, i int, x string")
    rows = series.streaks(df, "d", "i", F.col("x") == "F", 3).orderBy("i").collect()
    assert [r.streak for r in rows] == [1, 2, 0, 1, 2, 3, 0, 1] and [r.skipped for r in rows] == [False] * 6 + [True] * 2


def test_selection_follows_targets():
    """Even targets of the buckets weigh most; domains follow the roots of their counts."""
    counts = {("big", "x", o, r): 8 for o in range(3) for r in range(3)} | {("small", "x", 0, 0): 2}
    taken = selection.choose(counts, 18, 1)
    by = lambda i: {v: sum(n for k, n in taken.items() if k[i] == v) for v in {k[i] for k in taken}}
    assert by(2) == {0: 6, 1: 6, 2: 6} and by(3) == {0: 6, 1: 6, 2: 6} and by(0) == {"big": 16, "small": 2}
    assert selection.targets(counts, 18)["domain"] == {"big": 15, "small": 3}
    assert selection.choose(counts, 100, 1) == counts


def test_lucene_fills_with_zeros(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["red apple", "the the", "green pear", "apple apple pie"])], "id long, text string")
    asked = spark.createDataFrame([(1, "apple"), (2, "nothing")], "q long, text string")
    got = {(r.qid, r["rank"]): (r.row, r.score > 0) for r in retrieval.bm25(df, asked, "id", "text", "q", "text", 3, "lucene").collect()}
    assert got == {(1, 1): (3, True), (1, 2): (0, True), (1, 3): (1, False), (2, 1): (0, False), (2, 2): (1, False), (2, 3): (2, False)}


def test_selection(spark):
    rows = [(i, f"d{i % 4}", f"x{i % 3}", i % 4, i % 3) for i in range(24)]
    df = spark.createDataFrame(rows, "id long, domain string, difficulty string, open_bucket long, resolve_bucket long")
    a, b = (sorted(r.id for r in selection.select_subset(df, "id", 12, 20260313).collect()) for _ in range(2))
    assert a == b and len(a) == 12
    picked = [rows[i] for i in a]
    assert {r[1] for r in picked} == {"d0", "d1", "d2", "d3"} and {r[2] for r in picked} == {"x0", "x1", "x2"}
    assert selection.select_subset(df, "id", 100).count() == 24 and selection.select_subset(df.limit(0), "id", 3).count() == 0
    assert selection.sqrt_targets({"a": 100, "b": 1}, 11) == {"a": 10, "b": 1}
    assert selection.sqrt_targets({"a": 9, "b": 4, "c": 1}, 7) == {"a": 4, "b": 2, "c": 1} and selection.sqrt_targets({k: 1 for k in "abcd"}, 2) == {k: 1 for k in "abcd"}
    assert selection.uniform_targets(["b", "a"], 3) == {"a": 2, "b": 1}
    assert selection.water_fill({"a": 1, "b": 9, "c": 9}, 9, 2) == {"a": 1, "b": 4, "c": 4}


def item(i, text, vector, resolved="2024-01-01"):
    return {"experience_id": i, "source_question_id": i, "domain": "d", "zone": "golden", "level": "case", "title": text, "summary": text, "content": text, "created_at": resolved, "source_open_time": resolved, "source_resolved_time": resolved, "outcome": 1, "correctness": True, "support_count": 1, "merged_from": [i], "embedding": vector}


def test_memory(spark):
    out = memory.insert_or_merge([item("1", "a", [1.0, 0.0]), item("2", "a  longer", [1.0, 0.0]), item("3", "A  Longer", [0.0, 1.0]), item("4", "b", [0.0, 1.0])])
    assert [(x["experience_id"], x["support_count"], x["title"], x["merged_from"]) for x in out] == [("1", 2, "a  longer", ["1", "2"]), ("4", 1, "b", ["4"])]
    from marlstone import schemas

    store = spark.createDataFrame([item("1", "a", [1.0, 0.0]), item("2", "aa", [1.0, 0.0]), item("3", "b", [0.0, 1.0], "2024-01-05")], schemas.EXPERIENCE)
    assert memory.consolidate(store).count() == 2
    asked = spark.createDataFrame([(7, [1.0, 0.0], "d", "2024-01-04")], "qid long, vector array<double>, domain string, cutoff string")
    assert [r.experience_id for r in memory.retrieve(store, asked, 5, domain="domain").orderBy("rank").collect()] == ["2", "1"]  # not yet resolved: 3
    text = "# Memory Item 1\n## Title\nT\n## Description\nD\n## Content\nC\n# Memory Item 2\n## Title\nonly"
    assert list(memory.blocks(text)) == [{"title": "T", "description": "D", "content": "C"}]


def test_records(spark, tmp_path):
    (tmp_path / "info/news").mkdir(parents=True)
    lines = ['{"id": "a", "kind": "info", "source": "news/cnn", "timestamp": "2024-01-02", "payload": {"title": "T", "content": ["x", "y"]}}', "not json", '{"id": "b", "kind": "kb", "source": "book/openstax", "timestamp": "bad", "payload": {"page_title": "P", "content": "c"}}', '{"id": "c", "kind": "info", "source": "sociomedia/reddit", "timestamp": "2024-01-03", "payload": {"title": "S", "subreddit": "r", "score": 0, "comments": ["one", ""]}}']
    (tmp_path / "info/news/records.jsonl").write_text("\n".join(lines) + "\n")
    rows = {r.id: r for r in records.normalized(records.snapshot(spark, str(tmp_path))).collect()}
    assert set(rows) == {"a", "c"} and rows["a"].contents == '"T"\nx\ny' and rows["a"].source == "info/news"
    assert rows["c"].body == "subreddit: r score: 0\none"
    with pytest.raises(Exception, match="not a day"):
        records.normalized(records.snapshot(spark, str(tmp_path)), strict=True).collect()


def test_gkg_and_pool(spark, tmp_path):
    row = lambda d, sources, urls: "\t".join([d, "1", "", "TH", "", "", "", "", "", sources, urls])
    (tmp_path / "a.gkg.csv").write_text("\n".join([row("20240102", "x.com", "https://a.example.com/en/1;ftp://a.example.com/2"), row("20240103", "listed.org", "https://other.net/x;https://a.example.com/en/1"), row("20240103", "", "https://a.example.com/fr/1")]) + "\n")
    rows = records.gkg(spark, str(tmp_path)).withColumn("pos", F.monotonically_increasing_id())
    pool = records.url_pool(rows, spark.createDataFrame([("example.com", "E"), ("listed.org", "L")], "domain string, name string")).orderBy("url").collect()
    assert [(r.url, r.source_name, r.gkg_date) for r in pool] == [("https://a.example.com/en/1", "E", "2024-01-02"), ("https://other.net/x", "L", "2024-01-03")]


def test_feeds(spark):
    feed = "<rss><channel><item><title>T</title><link>l</link><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate></item><item><link>m</link><pubDate>bad</pubDate></item></channel></rss>"
    assert [r.link for r in records.rss(spark.createDataFrame([(feed,), ("nope",), (None,)], "xml string")).collect()] == ["l"]
    xml = '<OAI xmlns:dc="http://purl.org/dc/elements/1.1/"><record><header><identifier>1</identifier><datestamp>2024-01-01</datestamp></header><metadata><dc:title>T</dc:title></metadata></record><record><header status="deleted"/></record><resumptionToken>t</resumptionToken></OAI>'
    rows, token = records.oai(xml)
    assert rows == [{"identifier": "1", "datestamp": "2024-01-01", "fields": {"title": ["T"]}}] and token == "t"


def test_paged_source(spark, tmp_path):
    (tmp_path / "0.json").write_text('[{"id": 1}, {"id": 2}]')
    (tmp_path / "1.json").write_text('[{"id": 2}, {"id": 3}]')
    paged.register(spark)
    assert sorted(r.id for r in spark.read.format("paged").option("listings", str(tmp_path)).load().collect()) == ["1", "2", "3"]


def test_streaming(spark, tmp_path):
    out, check, source = (str(tmp_path / x) for x in ("out", "check", "in"))
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, x string").write.json(source)
    rows = tail.once(tail.tail(spark, source, "id long, x string"), "id")
    tail.drain(rows, out, check)
    spark.createDataFrame([(2, "b"), (3, "c")], "id long, x string").write.mode("append").json(source)
    tail.drain(rows, out, check)
    tail.drain(rows, out, check)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_pool_state(spark):
    pool = spark.createDataFrame([("u1", "pending", "1"), ("u2", "pending", "0"), ("u3", "success", "0")], "url string, status string, created_at string")
    taken, marked = tail.reserve(pool, 1)
    assert [r.url for r in taken.collect()] == ["u2"] and {r.url: r.status for r in marked.collect()} == {"u1": "pending", "u2": "in_progress", "u3": "success"}
    assert tail.transition(marked, "in_progress", "pending").filter("status = 'pending'").count() == 2
    new = spark.createDataFrame([("u1", "failed", "2")], "url string, status string, created_at string")
    assert tail.upsert(pool, new, "url", "created_at").filter("url = 'u1'").first().status == "failed"
