from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marlstone.functions import html, markdown
from marlstone.functions import text as X
from marlstone.functions import times as D
from marlstone.functions import urls as U
from marlstone.functions import values as V


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("f", "x", "y"),
    [
        (X.clean, " a 　b\n c ", "a b c"), (X.clean, None, None), (lambda c: X.compact(c, 8), "abcdefghij", "abcde..."), (X.slug, "--A b!C--", "a-b-c"), (X.slug, None, "other"),
        (X.without_site, "A long enough title | Site", "A long enough title"), (X.without_site, "Short | Site", "Short | Site"), (X.question_key, "Will X, win?", "will x win"),
        (X.task_shape, "Will it rain by March 3 2026?", "Will it rain"), (X.inline, "see ![i](u) [t](http://a.b) http://x.y www.z.q end", "see t end"), (X.failure_stage, "dns error", "connect"),
        (X.redact, "http://u:p@h:1", "http://***@h:1"), (lambda c: X.record_id(c, F.lit(None), F.lit(0)), "a", "b2b0dd4ba1e8e7c7dcf3c0e0c84e4f6b48dd8ad5"),
    ],
)
def test_text(spark, f, x, y):
    got = one(spark, f, x)
    if isinstance(y, str) and len(y) == 40 and y.isalnum() and f is not X.clean and x == "a":
        import hashlib

        y = hashlib.sha1(b"a||0").hexdigest()
    assert got == y


def test_tokens(spark):
    assert one(spark, X.tokens, "A_1 Straße x") == ["a_1", "stra", "e", "x"]
    assert one(spark, X.token_count, "Étion dé x") == 3


@pytest.mark.parametrize(
    ("x", "y"),
    [("2024-01-02", datetime(2024, 1, 2)), ("2024-01-02 03:04:05", datetime(2024, 1, 2, 3, 4, 5)), ("2024-01-02T03:04:05Z", datetime(2024, 1, 2, 3, 4, 5)), ("2024-01-02T03:04:05+02", datetime(2024, 1, 2, 1, 4, 5)), ("2024", None), ("2024-01", None), ("junk", None), (None, None), ("2024-13-40", None)],
)
def test_parse(spark, x, y):
    got = one(spark, lambda c: D.parse(c).cast("timestamp_ntz"), x)
    assert got == y


def test_days(spark):
    assert one(spark, D.gkg_day, "20240102") == "2024-01-02"
    assert one(spark, D.gkg_day, "20240102030405") == "2024-01-02"
    assert one(spark, D.gkg_day, "abcdefghij") == "abcd-ef-gh"
    assert one(spark, D.gkg_day, "") is None
    assert one(spark, lambda c: D.rfc_2822(c).cast("timestamp_ntz"), "Tue, 02 Jan 2024 03:04:05 +0000") == datetime(2024, 1, 2, 3, 4, 5)
    with pytest.raises(Exception, match="not a day"):
        one(spark, D.day_strict, "nope")


@pytest.mark.parametrize(
    ("f", "x", "y"),
    [
        (U.host, "https://u:p@WWW.A.co.uk:80/x", "www.a.co.uk"), (U.domain, "https://www.a.co.uk/x", "a.co.uk"), (U.domain, "http://a.b.example.com", "example.com"), (U.host, "nope", None), (U.is_valid, "ftp://a.b", False), (U.is_valid, None, False),
        (U.is_english, "http://a/entertainment/fr/x", True), (U.is_english, "http://a/fr/x", False), (U.post_slug, "https://a/p/some-post?x=1", "some-post"), (U.proxy_url, "h:1:u:p w", "http://u:p%20w@h:1"), (lambda c: U.news_source(F.lit(None), c), "https://www.a.com/x", "news/a.com"),
    ],
)
def test_urls(spark, f, x, y):
    assert one(spark, f, x) == y


def test_probabilities(spark):
    assert one(spark, V.forecast_probability, '90% sure ```json {"predicted_prob": 0.02} ```') == 0.02
    assert one(spark, V.forecast_probability, '"predicted_prob": 0.98, of 8.4 billion') == 0.98
    assert one(spark, V.forecast_probability, "none") is None
    assert one(spark, V.probability, "70%") == 0.7
    assert one(spark, V.probability, "-3") is None
    assert one(spark, lambda c: V.is_correct(c, F.lit(0)), 0.0, "double") is True
    assert one(spark, lambda c: V.is_correct(c, F.lit(0), compat=True), 0.0, "double") is False


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [1.0])], "a array<double>, b array<double>").select(V.dot(F.col("a"), F.col("a")), V.dot(F.col("a"), F.col("b")), V.unit(F.col("a"))).first()
    assert list(row)[:2] == [25.0, 0.0] and row[2] == pytest.approx([0.6, 0.8])


PAGE = """<html><head><title>A headline of some length | The Site</title><meta name="description" content="This is a description that says what stands on the page, in a sentence."></head>
<body><nav>menu one two</nav><article><h1>A headline of some length</h1><p>First <b>para</b>graph.</p><script>var x = "<p>no</p>";</script><p>Second &amp; last</p></article><p>outside</p></body></html>"""


def test_html():
    page = html.read(PAGE)
    assert html.pick_title(page) == "A headline of some length"
    assert html.pick_description(page).startswith("This is a description")
    assert html.main_text(page) == "A headline of some length\nFirst paragraph.\nSecond & last"
    assert html.main_text(html.read(None)) == "" and html.pick_title(html.read("")) is None
    assert html._ld(html.read('<script type="application/ld+json">{"@graph": [{"headline": "H"}]}</script>'), ("headline",)) == "H"


def test_html_rows(spark):
    rows = html.extract(spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert rows[0].n_blocks == 4 and rows[1].title is None and rows[1].main_text == ""


LONG = "This is a plain sentence of an article, and it is long enough to be taken for a paragraph of its body by every rule."


@pytest.mark.parametrize(
    ("line", "kept"),
    [
        (LONG, True), ("# " + LONG, False), ("- " + LONG, False), ("3. " + LONG, False), ("Short sentence.", False), ("Health", False), ("See all of the stories. " + LONG, False),
        (LONG + " Subscribe now.", False), (LONG.replace("plain", "green"), True), ("A green line that is a sentence but shorter than a hundred characters, mind you.", False),
        (LONG + " It has 1. one 2. two items", False), ("word " * 20 + "without an end", False), ("word " * 130 + "without an end", True), ("OpacityOpaque " + LONG, False),
        ("Fewer words but " + "x" * 80 + " long.", False), ("a | b " + "c" * 90, False),
    ],
)
def test_markdown_lines(spark, line, kept):
    assert one(spark, markdown.body, line) == (line.strip() if kept else "")


@pytest.mark.parametrize(
    ("lines", "kept"),
    [
        (["| a | b |", "|---|---|", "| 1 | 2 |"], [0, 1, 2]), (["| a | b |"], []), (["| a | b |", "| 1 | 2 |"], []), (["| a | b |", "| 1 | 2 |", "| 3 | 4 |"], [1]),
        (["| a | b |", "", "|---|---|"], [2]), (["|---|---|"], [0]), (["| a |", "|---|---|"], [1]), (["| a | b |", "Health", "|---|---|"], [0, 2]), (["|---|---|", "| a | b |", "| c | d |"], [0, 1, 2]),
    ],
)
def test_markdown_tables(spark, lines, kept):
    assert one(spark, markdown.body, "\n".join(lines)) == "\n".join(lines[i] for i in kept)


@pytest.mark.parametrize(
    ("reason", "stage"),
    [("connection reset by peer", "other"), ("ConnectTimeout", "connect"), ("All connection attempts failed", "connect"), ("NXDOMAIN", "connect"), ("timed out", "other"), ("httpx.ReadTimeout", "read"), ("status=418", "http"), ("got 503", "http"), ("404", "other"), (None, "other"), ("resolve", "other")],
)
def test_failure_stage(spark, reason, stage):
    assert one(spark, X.failure_stage, reason) == stage


def test_titles_and_descriptions():
    pick = lambda x: html.pick_title(html.read(x))
    assert pick("<h1>Privacy for all of us</h1><title>A fine day at sea | Site</title>") == "A fine day at sea"
    assert pick('<meta name="citation_title" content="The cited title here"><title>x</title>') == "The cited title here"
    assert pick("<h1>First of two headings</h1><h1>Second of two headings, longer</h1>") == "First of two headings"
    assert pick('<script type="application/ld+json">[{"title": "Told by a list of things"}]</script>') == "Told by a list of things"
    told = lambda x: html.pick_description(html.read(x))
    ld = '<script type="application/ld+json">{"description": "The description of the linked data, which is long enough. It goes on and on."}</script>'
    assert told('<meta name="dc.abstract" content="An abstract that is just about forty characters">' + ld).startswith("An abstract")
    assert told('<meta name="description" content="short">' + ld).startswith("The description of the linked")
    p = "<p>" + "a paragraph of words " * 5 + "</p>"
    assert told("<p>" + "outside " * 20 + "</p><article>" + p + "</article>").startswith("a paragraph") and told("<p>" + "outside " * 20 + "</p><main><p>x</p></main>") is None
    assert told(p).startswith("a paragraph") and told("") is None


def test_markdown(spark):
    long = "This sentence belongs to the body of the text because it is long enough to be one."
    text = "\n".join(["# Head", long, "short", "| a | b |", "|---|---|", "| 1 | 2 |", "", "Subscribe to our newsletter today and get all of the updates now please do."])
    assert one(spark, markdown.body, text) == "\n".join([long, "| a | b |", "|---|---|", "| 1 | 2 |"])
    assert one(spark, markdown.body, None) == ""
    assert one(spark, markdown.long_lines, "# A\n" + "x" * 100 + "\n# B") == "# A\n" + "x" * 100
