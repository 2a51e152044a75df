"""Readers of snapshots, pools and feeds. Paths are any that Spark reads."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone import schemas
from marlstone.functions import text as X
from marlstone.functions import times as D
from marlstone.functions import urls as U


def snapshot(spark: SparkSession, root: str, strict: bool = False) -> DataFrame:
    """Every records.jsonl below root with its file and place in the order of files; malformed lines go, or fail if strict."""
    lines = spark.read.schema(schemas.RECORD).option("mode", "FAILFAST" if strict else "DROPMALFORMED").option("recursiveFileLookup", "true").option("pathGlobFilter", "records.jsonl").json(root)
    return lines.withColumn("_file", F.col("_metadata.file_path")).withColumn("_pos", F.struct("_file", F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def last_wins(df: DataFrame, key: str, pos: str) -> DataFrame:
    """One row a key: the one of largest pos."""
    best = df.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*df.columns), pos).alias("_row"))
    return best.select("_row.*")


def content_text(content: Column) -> Column:
    """Content that is a text or a list of texts."""
    return F.coalesce(F.array_join(F.try_variant_get(content, "$", "array<string>"), "\n"), F.try_variant_get(content, "$", "string"), F.lit(""))


def normalized(records: DataFrame, strict: bool = False) -> DataFrame:
    """id, source (kind/type), day, url, title, body, contents of valid records. A bad timestamp drops a record, or fails if strict; a missing one drops it."""
    p = "payload."
    kind, source = F.lower(F.trim("kind")), F.lower(F.trim("source"))
    kind_type = F.split_part(source, F.lit("/"), F.lit(1))
    opt = lambda c: F.nullif(X.clean(F.col(c)), F.lit(""))
    title = F.coalesce(opt(p + "title"), F.when(kind_type == "book", opt(p + "page_title")), F.when(kind_type == "sociomedia", opt(p + "subreddit")), F.lit(""))
    labelled = lambda label, c: F.concat(F.lit(f"{label}: "), c)
    about = F.concat_ws(
        " ", labelled("author", opt(p + "author")), labelled("authors", F.nullif(F.array_join(p + "authors", ", "), F.lit(""))),
        F.when(kind_type == "sociomedia", F.concat_ws(" ", labelled("subreddit", opt(p + "subreddit")), labelled("score", F.col(p + "score").cast("string")), labelled("num_comments", F.col(p + "num_comments").cast("string")))),
        F.when(opt(p + "page_title") != title, opt(p + "page_title")), opt(p + "description"),
    )
    comments = F.when(kind_type == "sociomedia", F.array_join(F.filter(p + "comments", lambda c: F.trim(c) != ""), "\n"))
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    body = F.concat_ws("\n", some(about), some(content_text(F.col(p + "content"))), some(comments))
    day = D.day_strict(F.col("timestamp")) if strict else D.day(F.col("timestamp"))
    rows = records.select("id", F.concat(kind, F.lit("/"), kind_type).alias("source"), day.alias("day"), "url", title.alias("title"), body.alias("body"), kind.alias("_kind"))
    ok = (F.coalesce(F.trim("id"), F.lit("")) != "") & F.col("_kind").isin("info", "kb") & F.col("source").isNotNull() & F.col("day").isNotNull()
    rows = rows.filter(ok).drop("_kind").withColumn("contents", X.compose(F.col("title"), F.col("body")))
    return rows.filter("contents <> ''")


def gkg(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated knowledge-graph files without header; only the columns that are asked for are parsed."""
    return spark.read.schema(schemas.GKG).option("sep", "\t").option("nullValue", "").option("quote", "").csv(path)


def listed(x: Column, mark: str = ";") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), mark), lambda s: F.trim(s)), lambda s: s != "")


def url_pool(rows: DataFrame, whitelist: DataFrame) -> DataFrame:
    """url, domain, source_name, gkg_date, themes, status: the first row of each valid English address whose domain, or else one of whose named sources, is listed.

    rows are of gkg() with a column pos; whitelist has domain and name, and is a configured list.
    """
    each = rows.select("pos", "THEMES", F.col("DATE"), listed(F.col("SOURCES")).alias("sources"), F.posexplode(listed(F.col("SOURCEURLS"))).alias("url_pos", "url"))
    each = each.filter(U.is_valid(F.col("url")) & U.is_english(F.col("url"))).withColumn("domain", U.domain(F.col("url"))).withColumn("_id", F.monotonically_increasing_id())
    named = F.broadcast(whitelist.select(F.col("domain"), F.col("name")))
    by_url = each.join(named, "domain", "left")
    by_source = each.select("_id", F.posexplode("sources").alias("source_pos", "source")).join(F.broadcast(whitelist.select(F.col("domain").alias("source"), F.col("name").alias("by_source"))), "source")
    first = by_source.groupBy("_id").agg(F.min_by("by_source", "source_pos").alias("by_source"))
    found = by_url.join(first, "_id", "left").withColumn("source_name", F.coalesce("name", "by_source")).filter("source_name is not null")
    nth = F.row_number().over(Window.partitionBy("url").orderBy("pos", "url_pos"))
    return found.withColumn("_n", nth).filter("_n = 1").select("url", "domain", "source_name", D.gkg_day(F.col("DATE")).alias("gkg_date"), F.col("THEMES").alias("themes"), F.lit("pending").alias("status"))


def questions(spark: SparkSession, path: str, horizon: str) -> DataFrame:
    """Flat questions of a pool file: those with a sample at the horizon, a label of 0 or 1, and times that parse; by resolve time, open time, id."""
    markets = spark.read.option("multiLine", "true").json(path).select(F.inline("markets"))
    at = F.col("sampled").getField(horizon)
    rows = markets.withColumn("_at", at).filter(F.col("_at").isNotNull() & F.col("answer").isin(0, 1))
    rows = rows.filter(D.parse(F.col("open_time")).isNotNull() & D.parse(F.col("resolve_time")).isNotNull())
    return rows.select("market_id", "question", "domain", F.coalesce("resolution_criteria", F.lit("")).alias("resolution_criteria"), "open_time", "resolve_time", F.col("_at.t").alias("sample_time"), F.col("_at.difficult").alias("difficulty"), F.col("_at.p_yes").alias("sampled_prob_yes"), F.col("answer").cast("int").alias("label"), F.lit(horizon).alias("horizon")).orderBy("resolve_time", "open_time", "market_id")


def rss(df: DataFrame, xml: str = "xml") -> DataFrame:
    """title, link, published, content of the items of feeds, one feed a row; items without a link or a date go, and so does a feed that isn't XML."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for x in b.column(0).to_pylist() for r in rss_items(x or "")]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("title", pa.string()), ("link", pa.string()), ("published", pa.timestamp("us", "UTC")), ("content", pa.string())]))

    return df.select(xml).mapInArrow(run, "title string, link string, published timestamp, content string")


def rss_items(xml: str) -> list[dict]:
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return []
    out = []
    for item in root.iter("item"):
        got = {child.tag.rpartition("}")[2]: (child.text or "").strip() for child in item}
        try:
            when = parsedate_to_datetime(got.get("pubDate", ""))
        except (TypeError, ValueError):
            continue
        if got.get("link"):
            out.append({"title": got.get("title"), "link": got["link"], "published": when, "content": got.get("encoded") or got.get("description") or ""})
    return out


def oai(xml: str) -> tuple[list[dict], str | None]:
    """Records of an OAI-PMH answer that aren't deleted (identifier, datestamp, fields as lists) and the resumption token."""
    root = ET.fromstring(xml)
    local = lambda e: e.tag.rpartition("}")[2]
    rows = []
    for record in (e for e in root.iter() if local(e) == "record"):
        header = next((e for e in record if local(e) == "header"), None)
        if header is None or header.get("status") == "deleted":
            continue
        row: dict = {local(e): (e.text or "").strip() for e in header if local(e) in ("identifier", "datestamp")}
        fields: dict[str, list[str]] = {}
        for e in record.iter():
            if "purl.org/dc" in e.tag and (e.text or "").strip() and local(e) != "dc":
                fields.setdefault(local(e), []).append(e.text.strip())
        rows.append(row | {"fields": fields})
    token = next(((e.text or "").strip() for e in root.iter() if local(e) == "resumptionToken"), None)
    return rows, token or None


def comments(bodies: Column, k: int) -> Column:
    """The first k distinct comments that are neither empty nor removed."""
    kept = F.filter(F.transform(bodies, lambda c: F.trim(c)), lambda c: ~c.isin("", "[deleted]", "[removed]"))
    return F.slice(F.array_distinct(kept), 1, k)
