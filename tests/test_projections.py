from datetime import date

from pyspark.sql import functions as F

from marlstone.sources import projections as P


def test_news_and_posts(spark):
    rows = spark.createDataFrame([("https://www.cnn.com", "https://www.cnn.com/a", " T ", None, "c", "bad", "2024-01-02T03:04:05Z"), (None, "u", "T", None, "c", None, None)], "source string, url string, title string, description string, content string, published_at string, pubtime string")
    got = P.news(rows).collect()
    assert [(r.source, r.timestamp, r.title) for r in got] == [("news/cnn.com", date(2024, 1, 2), "T")] and len(got[0].id) == 40
    posts = spark.createDataFrame([(None, "s", "T", "2024-01-02", "A B", "everyone", False, None, "b", None, None), ("http://x/p/y", "y", "T", "2024-01-02", "A", "only_paid", False, None, "b", None, None)], "canonical_url string, slug string, title string, post_date string, author string, audience string, is_paid boolean, paywall boolean, body string, fallback string, description string")
    assert [(r.url, r.source) for r in P.posts(posts, F.lit("http://x/")).collect()] == [("http://x/p/s", "blog/substack/a-b")]


def test_reddit(spark):
    df = spark.createDataFrame([("a", None, "1704164645", None, "/r/x/1", "u", "T", "s", "X", "3.7", None), (None, "t3_b", "1704164645", None, None, "u", "T2", None, "X", None, "2"), ("c", None, "1", None, None, None, " ", None, "X", None, None)], "id string, name string, created_utc string, full_link string, permalink string, url string, title string, selftext string, subreddit string, score string, num_comments string")
    got = {r.id: r for r in P.reddit(df).collect()}
    assert set(got) == {"a", "b"} and got["a"].url == "https://www.reddit.com/r/x/1" and got["a"].score == 3 and got["b"].url == "u" and got["a"].timestamp == date(2024, 1, 2)
    twice = spark.createDataFrame([("a", 0, 1), ("a", 1, 0), (None, 0, 0), (None, 0, 1)], "id string, p int, pos int")
    assert P.once_by_id(twice, "p", "pos").count() == 3


def test_arxiv(spark):
    df = spark.createDataFrame([("i", [("h1", "self"), ("h2", "alternate")], "T", "S", ["A"], "2024-01-02T00:00:00Z"), ("j", [], "T", "S", [], "2024-01-02")], "id string, links array<struct<href: string, rel: string>>, title string, summary string, authors array<string>, published string")
    assert [r.url for r in P.arxiv(df).orderBy("id").collect()] == ["h2", "j"]
    assert P.arxiv_query(["cs.AI"], ["x y"], "2024-01-01", "2024-01-02") == '(cat:cs.AI OR all:"x y") AND submittedDate:[202401010000 TO 202401022359]'


def test_merges(spark):
    base, detail = spark.createDataFrame([("k", "a", "b")], "key string, x string, y string"), spark.createDataFrame([("k", "", "B")], "key string, x string, y string")
    assert list(P.overlay(base, detail, "key").first()) == ["k", "a", "B"]
    assert list(P.merged(base, detail, "key").first()) == ["k", "a", "b"]


def test_picks(spark):
    row = spark.createDataFrame([(["see http://x/handle/1/2", "hdl.handle.net/3/4"], [("a.pdf", "application/pdf", 10**9), ("b.txt", "text/plain", 10), ("c.txt", "text/plain", 10)])], "t array<string>, f array<struct<name: string, mime: string, size: long>>")
    assert row.select(P.handle(F.col("t"))).first()[0] == "3/4" and row.select(P.text_file(F.col("f"))).first()[0] == "b.txt"
    got = spark.sql("select parse_json(x) item from values ('{\"proxy\": \"h:1\", \"quality\": 0.9}'), ('\"h:2\"'), ('{\"url\": \"http://h:3\", \"score\": 0.1}'), ('{\"spec\": \"h:1\"}') t(x)")
    assert {(r.spec, r.score) for r in P.proxies(got, 0.5).collect()} == {("http://h:1", 0.9), ("http://h:2", None)}
    bad = spark.createDataFrame([("a", "info", "s", "2024-01-01", "{}"), ("", "info", "s", "2024-01-01", "{}"), ("a", "x", "s", "2024-01-01", "{}"), ("a", "kb", "s", "2024", "{}")], "id string, kind string, source string, timestamp string, payload string")
    assert [r.reject_reason for r in P.rejected(bad).collect()] == [None, "id", "kind", "timestamp"]
