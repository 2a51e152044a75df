"""Raw rows of each source as text records: id, kind, source, timestamp (a day), url, payload fields. Rows without what a source requires go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.functions import times as D
from marlstone.functions import urls as U
from marlstone.functions import values as V


def some(x: Column) -> Column:
    """Text without blanks at the ends; null if nothing is left."""
    return F.nullif(F.trim(x), F.lit(""))


def first_of(*columns: Column) -> Column:
    return F.coalesce(*map(some, columns))


def news(df: DataFrame) -> DataFrame:
    """source, url, title, description, content, published_at, pubtime: the day is of the first of the two times that parses."""
    day = F.coalesce(D.day(F.col("published_at")), D.day(F.col("pubtime")))
    source = U.news_source(F.col("source"), F.col("url"))
    rows = df.select(source.alias("source"), day.alias("timestamp"), some(F.col("url")).alias("url"), X.clean_or_empty(F.col("title")).alias("title"), "description", "content")
    rows = rows.filter("timestamp is not null and url is not null")
    return rows.select(X.record_id(F.col("source"), F.col("url"), F.col("timestamp"), F.col("title")).alias("id"), F.lit("info").alias("kind"), "*")


def reddit(df: DataFrame) -> DataFrame:
    """id, name, created_utc, full_link, permalink, url, title, selftext, subreddit, score, num_comments: addresses in that order, a relative permalink made whole; a title is required."""
    key = F.coalesce(some(F.col("id")), some(F.regexp_extract("name", "^t3_(.*)$", 1)))
    link = some(F.col("permalink"))
    whole = F.when(link.startswith("/"), F.concat(F.lit("https://www.reddit.com"), link)).otherwise(link)
    rows = df.select(
        key.alias("id"), F.lit("info").alias("kind"), F.concat(F.lit("sociomedia/reddit/"), F.lower("subreddit")).alias("source"), F.to_date(F.timestamp_seconds(V.to_int(F.col("created_utc")))).alias("timestamp"),
        F.coalesce(some(F.col("full_link")), whole, some(F.col("url"))).alias("url"), X.clean(F.col("title")).alias("title"), X.clean_or_empty(F.col("selftext")).alias("content"), "subreddit", V.to_int(F.col("score")).alias("score"), V.to_int(F.col("num_comments")).alias("num_comments"),
    )
    return rows.filter("title <> '' and timestamp is not null")


def once_by_id(df: DataFrame, priority: str, pos: str) -> DataFrame:
    """Of posts that several listings have the one of smallest priority and place; posts without an id all stay."""
    nth = F.row_number().over(Window.partitionBy("id").orderBy(priority, pos))
    return df.filter("id is not null").withColumn("_n", nth).filter("_n = 1").drop("_n").unionByName(df.filter("id is null"))


def arxiv(df: DataFrame) -> DataFrame:
    """id, links (href, rel), title, summary, authors, published: the address is of the first alternate link, else the id."""
    url = F.coalesce(F.get(F.filter("links", lambda x: x["rel"] == "alternate"), F.lit(0))["href"], F.col("id"))
    rows = df.select("id", F.lit("info").alias("kind"), F.lit("paper/arxiv").alias("source"), D.day(F.col("published")).alias("timestamp"), some(url).alias("url"), X.clean_or_empty(F.col("title")).alias("title"), "authors", X.clean_or_empty(F.col("summary")).alias("content"))
    return rows.filter("title <> '' and url is not null and timestamp is not null")


def arxiv_query(categories: list[str], keywords: list[str], since: str, until: str) -> str:
    """The listing's own query: a category or a keyword, and a range of days."""
    any_of = " OR ".join([f"cat:{c}" for c in categories] + [f'all:"{k}"' for k in keywords])
    return f"({any_of}) AND submittedDate:[{since.replace('-', '')}0000 TO {until.replace('-', '')}2359]"


def post_key(df: DataFrame) -> Column:
    return first_of(F.col("canonical_url"), F.col("id").cast("string"), F.col("slug"), F.col("title"))


def is_free(df: DataFrame) -> Column:
    audience = F.lower(F.coalesce("audience", F.lit("everyone")))
    return audience.isin("everyone", "public", "free", "") & ~F.coalesce("is_paid", F.lit(False)) & ~F.coalesce("paywall", F.lit(False))


def posts(df: DataFrame, base_url: Column) -> DataFrame:
    """Free newsletter posts with a day and an address, which is made from the slug if need be."""
    url = F.coalesce(some(F.col("canonical_url")), F.concat(F.rtrim(base_url, F.lit("/")), F.lit("/p/"), some(F.col("slug"))))
    rows = df.filter(is_free(df)).select(url.alias("url"), D.day(F.col("post_date")).alias("timestamp"), X.clean_or_empty(F.col("title")).alias("title"), "author", "description", F.coalesce(some(F.col("body")), some(F.col("fallback")), F.lit("")).alias("content"))
    rows = rows.filter("url is not null and timestamp is not null")
    return rows.select(X.record_id(F.lit("substack"), F.col("url"), F.col("timestamp"), F.col("title")).alias("id"), F.lit("info").alias("kind"), F.concat(F.lit("blog/substack/"), X.slug(F.col("author"))).alias("source"), "*")


def overlay(base: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """base with the fields that detail has, where those are neither null nor empty."""
    fields = [c for c in base.columns if c != key and c in detail.columns]
    met = base.join(detail.select(key, *[F.col(c).alias(f"_{c}") for c in fields]), key, "left")
    pick = lambda c: F.coalesce(F.when(F.col(f"_{c}").cast("string") != "", F.col(f"_{c}")), F.col(c)).alias(c)
    return met.select(*[pick(c) if c in fields else F.col(c) for c in base.columns])


def merged(archive: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """Union of two listings of one thing, each key once, the archive's row first."""
    every = archive.withColumn("_p", F.lit(0)).unionByName(feed.withColumn("_p", F.lit(1)))
    return every.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_p"))).filter("_n = 1").drop("_p", "_n")


def handle(texts: Column) -> Column:
    """A repository handle in a list of texts; a handle of an earlier pattern goes before one of an earlier text."""
    patterns = [r"hdl\.handle\.net/(\d+/\d+)", r"/handle/(\d+/\d+)", r"^(\d+/\d+)$"]
    first = lambda p: F.get(F.filter(F.transform(texts, lambda t: F.regexp_extract(t, p, 1)), lambda h: h != ""), F.lit(0))
    return F.coalesce(*map(first, patterns))


def text_file(files: Column) -> Column:
    """Of files (name, mime, size) the best text: a text type for ten points, a .txt name for five, a point a KiB up to a thousand; the first of equals; never a PDF."""
    points = lambda f: F.when(F.lower(f["mime"]).startswith("text/"), 10).otherwise(0) + F.when(F.lower(f["name"]).endswith(".txt"), 5).otherwise(0) + F.least(F.greatest(f["size"] / 1024, F.lit(0)), F.lit(1000))
    fits = F.filter(files, lambda f: ~F.lower(F.concat_ws(" ", f["mime"], f["name"])).contains("pdf") & (F.lower(f["mime"]).startswith("text/") | F.lower(f["name"]).endswith(".txt")))
    scored = F.transform(fits, lambda f, i: F.struct(points(f).cast("double").alias("points"), (-i).alias("at"), f["name"].alias("name")))
    return F.array_max(scored)["name"]


def published(candidates: list[Column]) -> Column:
    """The latest of several times, those that don't parse left aside."""
    times = [D.any_format(c) for c in candidates]
    return F.greatest(*times) if len(times) > 1 else times[0]


def proxies(df: DataFrame, least: float) -> DataFrame:
    """spec and score of heterogeneous proxy rows (a variant column item): at least so good, each once, as an address."""
    text = lambda *keys: F.coalesce(*[F.try_variant_get("item", f"$.{k}", "string") for k in keys])
    spec = F.coalesce(text("proxy", "spec", "url", "address"), F.try_variant_get("item", "$", "string"))
    score = F.coalesce(*[F.try_variant_get("item", f"$.{k}", "double") for k in ("quality", "quality_score", "score", "success_rate")])
    rows = df.select(U.proxy_url(spec).alias("spec"), score.alias("score")).filter(F.col("spec").isNotNull() & (F.col("score").isNull() | (F.col("score") >= least)))
    return rows.groupBy("spec").agg(F.max("score").alias("score"))


def rejected(df: DataFrame) -> DataFrame:
    """Adds why a record is not valid: id, kind, source, timestamp or payload; null if it is."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = [("id", empty("id")), ("kind", ~F.coalesce(F.col("kind").isin("info", "kb"), F.lit(False))), ("source", empty("source")), ("timestamp", ~F.coalesce(F.col("timestamp").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))), ("payload", F.col("payload").isNull())]
    from marlstone.operators.evaluate import reject_reasons

    return reject_reasons(df, rules)
