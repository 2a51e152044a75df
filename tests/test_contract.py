"""Payloads, hits, experiences, books of a crawl and question pools: cases that the queries' tables don't have."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import catalogue, experience, hits, payloads
from marlstone.operators import bookkeeping
from marlstone.plans import questions


def row(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_payloads(spark):
    j = F.lit
    r = row(
        spark, listing=payloads.listing_rows(j('{"data":{"children":[{"data":{"id":"a"}},{"data":3},{}],"after":"t3"}}')), after=payloads.listing_after(j('{"data":{"after":"t3"}}')),
        bare=payloads.archive_posts(j('[{"id":1}]')), posts=payloads.archive_posts(j('{"posts":[],"items":[{"id":2}]}')), none=payloads.archive_posts(j('{"x":1}')), linked=payloads.mime(j("{}"), j('{"mimetype":"A/B"}')),
        parts=payloads.message_text(j('[{"text":"one"},{"content":"two"},{}]')), plain=payloads.message_text(j("as it is")), hits=payloads.trajectory_hits(j('{"hits":[{"content":"c","source":"s"},"bare"]}')), csv=payloads.csv_list(j(" a,, b ")),
        broken=payloads.texts(j("[1,")), empty=payloads.tool_payload(j(None).cast("string")),
    )
    assert r.listing == ['{"id":"a"}'] and r.after == "t3" and r.bare == ['{"id":1}'] and r.posts == ['{"id":2}'] and r.none == [] and r.linked == "a/b"
    assert r.parts == "one\ntwo" and r.plain == "as it is" and [tuple(h) for h in r.hits] == [("c", "s"), ("bare", None)] and r.csv == ["a", "b"] and r.broken == [] and r.empty == "{}"


def test_hits(spark):
    t = F.lit
    r = row(
        spark, rerank=hits.rerank_text(t("Title"), t("title and more")), above=hits.rerank_text(t("Title"), t("more")), only=hits.rerank_text(t(" "), t("more")), kind=hits.source_type(t(" ,Info/News , blog")), cut=hits.cutoff_of(t(" "), t("2024-01-01")),
        short=hits.truncated(t("a b  c"), 2), about=hits.description_of(t(" a\n b ")), nothing=hits.description_of(t(" ")), chars=hits.content_chars(t(" abc ")), fit=hits.chosen_markdown(t(" "), t("raw")), none=hits.chosen_markdown(t(None), t("")),
        failed=hits.is_connect_failure(t("Engine_Exception: ConnectError at x")), other=hits.is_connect_failure(t("ConnectError")), direct=hits.masked_proxy(t(None).cast("string")), signed=hits.masked_proxy(t("http://u:p@h:1")), four=hits.masked_proxy(t("h:1:u:p")), bare=hits.masked_proxy(t("h:1")),
    )
    assert (r.rerank, r.above, r.only, r.kind, r.cut, r.short) == ("title and more", "Title\nmore", "more", "news", "2024-01-01", "a b...")
    assert (r.about, r.nothing, r.chars, r.fit, r.none, r.failed, r.other) == ("a b", None, 3, "raw", "", True, False)
    assert (r.direct, r.signed, r.four, r.bare) == ("direct", "http://***:***@h:1", "h:1:***:***", "h:1")
    with pytest.raises(Exception, match="cutoff"):
        row(spark, x=hits.cutoff_of(t(""), t(None).cast("string")))


def test_experience(spark):
    t = F.lit
    r = row(spark, shape=experience.task_shape(t("Will it rain by March 3, 2026 or not ?"), t("d")), none=experience.task_shape(t("?"), t("d")), generic=experience.is_generic_title(t(" Golden  Case")), note=experience.is_generic_title(t("A case note")), fine=experience.is_generic_title(t("Rain")),
            item=experience.memory_item(t(0.9), t(0), t("d"), t(" ")), half=experience.memory_item(t(0.0), t(1), t("d"), t(" why \n so")))
    assert (r.shape, r.none, r.generic, r.note, r.fine) == ("Will it rain", "d forecasting case", True, True, False)
    assert r["item"].title == "d failure warning" and r["item"].content == experience.MEMORY_CONTENTS[1] and r.half.title == "d successful reasoning pattern" and r.half.content == "why so"


def test_catalogue(spark):
    df = spark.createDataFrame([("2024-02-03T10:00:00Z", "u", None, "p", "c"), (None, "v", "t", "p", "c")], "pubtime string, url string, title string, page_title string, content string")
    rows = catalogue.books(df).collect()
    assert [(r.timestamp, r.payload.title, r.payload.page_title, len(r.id)) for r in rows] == [("2024-02-03", "", "p", 40)]
    reports = df.withColumnRenamed("pubtime", "datestamp")
    assert catalogue.reports(reports, "2024-02-03", "2024-02-03").count() == 1 and catalogue.reports(reports, "2024-02-04", "2024-03-01").count() == 0


def test_bookkeeping(spark):
    assert bookkeeping.days(spark, "2024-01-02", "2024-01-01").count() == 0 and bookkeeping.days(spark, "2024-02-28", "2024-03-01").count() == 3
    pool = spark.createDataFrame([("a", "pending", "", "2", "t"), ("b", "done", "1", "2", "t"), ("", "pending", "1", "2", "t"), ("c", "pending", "1", "2", "t")], "url string, status string, gkg_date string, created_at string, themes string")
    assert {(r.url, r.created_at) for r in bookkeeping.pending(pool).collect()} == {("a", "2"), ("c", "1")} and bookkeeping.pending(pool, 1).count() == 1
    got = {r.url: r.status for r in bookkeeping.recovered(pool, spark.createDataFrame([("a",), ("a",)], "url string")).collect()}
    assert got == {"a": "success", "b": "done", "": "pending", "c": "pending"}
    meta = bookkeeping.with_meta(pool.select("url"), spark.createDataFrame([("a", "2024"), ("a", "2023")], "url string, published_at string"), "url", "published_at")
    assert {r.url: r.published_at for r in meta.collect()} == {"a": "2023", "b": "", "": "", "c": ""}
    none = bookkeeping.fetch_outcomes(pool.select("url"), spark.createDataFrame([], "url string, attempt int, ok boolean, reason string"))
    assert {(r.url, r.status, r.reason) for r in none.collect()} == {(u, "failed", "unknown_failure") for u in "abc"}
    assert bookkeeping.reasons_text(none.limit(0)).first().summary == "none" and bookkeeping.sampled(pool, 2, 1, "url").count() == 2


def test_question_pool(spark):
    assert questions.horizon_weights([30, 7, 1]) == {30: 1 / 3, 7: 1 / 3, 1: 1 / 3} and questions.horizon_weights([4, 1]) == pytest.approx({4: 1 / 3, 1: 2 / 3})
    assert [questions.target_count(*x) for x in ((0, 1, 9, 0.5), (100, 10, 30, 0.5), (100, 10, 90, 0.05), (5, 10, 90, 0.5))] == [0, 30, 10, 5]
    assert questions.horizon_targets([30, 7, 1], {30: 40}, 90) == {"30d": 40, "7d": 30, "1d": 30}
    assert questions.check_manifest([1, "b "], "f") == ["1", "b"]
    for ids, source in (([], "f"), (["a", "a"], "f"), (["a", " "], "f"), (["a"], " ")):
        with pytest.raises(ValueError, match="fixed subset"):
            questions.check_manifest(ids, source)
    questions.check_stats({"selected_count": 2}, {"selected_count": 2})
    with pytest.raises(ValueError, match="domains"):
        questions.check_stats({"domains": {"a": 1}}, {"domains": {}})
    series = "array(named_struct('t', '1', 'p_yes', 0.5), named_struct('t', '0', 'p_yes', 1.5))"
    sampled = "map('7d', named_struct('t', 'x', 'p_yes', 0.1, 'difficult', cast(null as string)), '9d', named_struct('t', cast(null as string), 'p_yes', 0.1, 'difficult', 'x'))"
    r = spark.range(1).select(F.expr(series).alias("s"), F.expr(sampled).alias("m"), F.lit(2).alias("a"), F.expr("array(timestamp'2024-01-01 00:00:00', timestamp'2024-01-02 12:00:00')").alias("t"))
    x = r.select(questions.schema_errors(F.col("a"), F.col("s"), F.col("m"), [7]).alias("e"), questions.span_days(F.col("t")).alias("d"), questions.dominant_difficulty(F.col("m")).alias("u")).first()
    assert (x.e, x.d, x.u) == (4, 1.5, "unknown")
    one = spark.createDataFrame([(1, "d", 10.0, 1.0), (2, "d", 10.0, 2.0), (3, "e", 0.5, 9.0)], "k int, domain string, duration_days double, volume double")
    full = spark.createDataFrame([("d", 7, 5), ("d", 1, 5)], "domain string, offset int, n int")
    assert [r.k for r in questions.next_batch(questions.deficit_scores(one, full, [7, 1], 5), 2, "k").collect()] == [2, 1]  # nothing lacks: all may come
