"""Further queries of the library on the driver's tables, with their SQL: payloads, hits, experiences, books of a crawl, question pools, search end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import catalogue, experience, hits, payloads
from marlstone.functions import text as X
from marlstone.operators import bookkeeping, retrieval
from marlstone.plans import questions
from marlstone.queries import _POSTINGS, _TOKENS, query, table


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END AS n_outcomes, p_partkey % 5 = 1 AS is_binary, CASE WHEN p_partkey % 5 <> 3 THEN CAST(p_partkey % 100 >= 50 AS INTEGER) END AS answer,
    (p_partkey % 7 = 0) OR (p_partkey % 2 = 0 AND p_partkey % 5 <> 3 AND (p_partkey % 100 >= 95 OR p_partkey % 100 <= 4)) AS resolved, CASE WHEN p_partkey % 5 = 1 THEN 'Yes' WHEN p_partkey % 5 = 2 THEN 'A' END AS token FROM part""")
def market_payloads(spark, sf):
    k = F.col("p_partkey")
    two = lambda x: F.concat(F.lit("0."), F.lpad(x.cast("string"), 2, "0"))
    out = F.when(k % 5 == 0, "no json").when(k % 5 == 1, '["Yes", "No "]').when(k % 5 == 2, ' ["A","B","C"]').when(k % 5 == 3, "[]")
    prices = payloads.prices(F.when(k % 5 == 3, '["x", "0.5"]').otherwise(F.concat(F.lit('["'), two(k % 100), F.lit('", '), two(99 - k % 100), F.lit("]"))))
    resolved = payloads.is_resolved(F.when(k % 7 == 0, " Resolved"), k % 2 == 0, prices)
    return table(spark, sf, "part").select("p_partkey", F.size(payloads.outcomes(out)).alias("n_outcomes"), payloads.is_binary(payloads.outcomes(out)).alias("is_binary"), payloads.binary_answer(prices).alias("answer"), resolved.alias("resolved"), payloads.first_text(out).alias("token"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'big-news,markets,e-1,cat,x' WHEN 1 THEN 'c' ELSE '' END AS tags,
    CASE s_suppkey % 3 WHEN 0 THEN '2024-01-01' WHEN 1 THEN '2024-02-02' END AS open, CASE s_suppkey % 3 WHEN 0 THEN '2024-05-05' END AS resolve,
    CASE s_suppkey % 4 WHEN 0 THEN 'told' WHEN 1 THEN 'told by http://a' WHEN 2 THEN 'told' || chr(10) || 'Resolution source: http://a' ELSE 'Resolution source: http://a' END AS criteria FROM supplier""")
def market_texts(spark, sf):
    k = F.col("s_suppkey")
    full = '{"tags":[{"slug":"Big News","label":"markets"}],"events":[{"tags":[{"slug":"e 1","label":""}],"category":"Cat"},{"category":"x"},{"category":"never"}],"category":"CAT","startDate":"2024-01-01","updatedAt":"2024-05-05"}'
    market = F.when(k % 3 == 0, full).when(k % 3 == 1, '{"category":"c","startDate":"","createdAt":"2024-02-02"}').otherwise("{}")
    times = payloads.market_times(market)
    told = F.when(k % 4 == 1, "told by http://a").when(k % 4 != 3, " told ")
    criteria = payloads.resolution_criteria(told, F.when(k % 4 != 0, "http://a"))
    return table(spark, sf, "supplier").select("s_suppkey", F.array_join(payloads.official_tags(market, X.slug), ",").alias("tags"), times["open"].alias("open"), times["resolve"].alias("resolve"), criteria.alias("criteria"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'http://a/' || event_id WHEN 2 THEN 'http://b/' || event_id END AS url, CASE event_id % 5 WHEN 0 THEN '2024-01-02' ELSE '' END AS day FROM events""")
def url_lines(spark, sf):
    i = F.col("event_id").cast("string")
    k = F.col("event_id") % 5
    line = F.when(k == 0, F.concat(F.lit('{"url":"http://a/'), i, F.lit('","published_at":"","gkg_date":"2024-01-02"}'))).when(k == 1, '{"title":"none"}').when(k == 2, F.concat(F.lit(" http://b/"), i)).when(k == 3, "  ").otherwise("[1, 2]")
    return table(spark, sf, "events").select("event_id", payloads.listed_url(line).alias("url"), payloads.listed_day(line).alias("day"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'i' || o_orderkey ELSE 'http://x/' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '.PDF' ELSE '' END END AS doc_id,
    CASE WHEN o_orderkey % 5 = 0 THEN 'blog' WHEN o_orderkey % 3 = 0 THEN 'paper' ELSE 'news' END AS source_type, CASE o_orderkey % 4 WHEN 0 THEN '2024-03-04' WHEN 1 THEN '2023-01-01' ELSE '' END AS timestamp,
    CASE o_orderkey % 3 WHEN 0 THEN 'A title' || chr(10) || 'summed up' WHEN 1 THEN 'a TITLE, told again' ELSE 'A title' || chr(10) || 'one' || chr(10) || 'two' END AS content FROM orders""")
def external_hits(spark, sf):
    k = F.col("o_orderkey")
    url = F.concat(F.lit(" http://x/"), k.cast("string"), F.when(k % 3 == 0, ".PDF").otherwise(""))
    hit = hits.external_hit(
        F.when(k % 2 == 0, F.concat(F.lit("i"), k.cast("string"))), url, F.lit("A title "), F.lit(0.123456), F.when(k % 3 == 0, "summed up"), F.when(k % 3 == 1, F.array(F.lit(" a TITLE,"), F.lit("told again "))),
        F.lit(" one \n\n two"), F.when(k % 4 == 0, "2024-03-04T05:06:07Z"), F.when(k % 4 == 1, '{"publishedAt":"2023-01-01 00:00"}'), F.when(k % 5 == 0, " info/Blog, news"),
    )
    return table(spark, sf, "orders").select(k, hit.alias("h")).select("o_orderkey", "h.doc_id", "h.source_type", "h.timestamp", "h.content")


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 50 - 5 AS INTEGER) END AS e FROM orders),
    l AS (SELECT *, least(coalesce(e, DATE '1996-06-30'), DATE '1996-06-30') AS last FROM d)
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND s <= last THEN s ELSE last - 90 END AS start_date, last AS end_date FROM l""")
def tool_dates(spark, sf):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    end = F.when(k % 4 != 0, F.date_add(F.to_date("o_orderdate"), (k % 50 - 5).cast("int")))
    both = hits.clamped_dates(F.when(k % 3 != 0, hits.tool_day(day)), end, F.lit("1996-06-30").cast("date"))
    return table(spark, sf, "orders").select(k, both.alias("d")).select("o_orderkey", "d.start_date", "d.end_date")


_TITLE_SQL = " ".join(f"WHEN '{level}' THEN CASE WHEN ok THEN '{a}' ELSE '{b}' END" for level, (a, b) in experience.TITLES.items())


@query(f"""WITH r AS (SELECT doc_id, 'd' || CAST(doc_id % 4 AS VARCHAR) AS domain, toxic AS label, ((doc_id * 37 % 101) >= 50) = (toxic > 0) AS ok FROM labels), e AS (SELECT *, unnest(['strategy', 'pattern', 'case']) AS level FROM r), z AS (SELECT *, CASE WHEN ok THEN 'golden' ELSE 'warning' END AS zone FROM e)
    SELECT 'flex-' || zone || '-' || level || '-' || doc_id AS experience_id, level, CASE level {_TITLE_SQL} ELSE 'Will ' || doc_id || ' happen' END AS title, zone || ' ' || level || ' distilled from a resolved ' || domain || ' forecasting example.' AS summary,
    CASE WHEN doc_id % 2 = 0 THEN 'because of it' WHEN ok THEN '{experience.CONTENTS[0]}' ELSE '{experience.CONTENTS[1]}' END AS content, label AS outcome, ok AS correctness FROM z""")
def experiences_built(spark, sf):
    d = F.col("doc_id")
    day = F.lit("2024-01-01")
    rows = table(spark, sf, "labels").select(
        d.alias("market_id"), F.concat(F.lit("d"), (d % 4).cast("string")).alias("domain"), F.concat(F.lit("Will  "), d.cast("string"), F.lit(" happen by March 3, 2026?")).alias("question"), day.alias("open_time"), day.alias("resolve_time"),
        F.col("toxic").alias("label"), ((d * 37 % 101) / 100).alias("predicted_prob"), F.when(d % 2 == 0, " because\nof it ").otherwise(" ").alias("reasoning_summary"),
    )
    return experience.experiences(rows).select("experience_id", "level", "title", "summary", "content", "outcome", "correctness")


@query("""WITH a AS (SELECT DISTINCT user_id + x AS u FROM events, (VALUES (0), (1000000)) t(x)), s AS (SELECT user_id, bool_or(event_id % 11 = 0) AS ok, arg_max(event_type, event_id) FILTER (event_id % 11 <> 0 AND event_id % 2 = 0) AS why FROM events GROUP BY user_id)
    SELECT CAST(u AS VARCHAR) AS url, CASE WHEN coalesce(ok, false) THEN 'success' ELSE 'failed' END AS status, CASE WHEN NOT coalesce(ok, false) THEN coalesce(why, 'unknown_failure') END AS reason FROM a LEFT JOIN s ON s.user_id = a.u""")
def fetch_outcomes(spark, sf):
    e = table(spark, sf, "events")
    return bookkeeping.fetch_outcomes(*_attempts(e))


def _attempts(e):
    i = F.col("event_id")
    asked = e.select(F.col("user_id").alias("url")).unionByName(e.select((F.col("user_id") + 1000000).alias("url")))
    return asked, e.select(F.concat(F.lit(" "), F.col("user_id").cast("string")).alias("url"), i.alias("attempt"), (i % 11 == 0).alias("ok"), F.when(i % 2 == 0, F.concat(F.lit(" "), "event_type")).otherwise(" ").alias("reason"))


@query("""WITH a AS (SELECT DISTINCT user_id + x AS u FROM events, (VALUES (0), (1000000)) t(x)), s AS (SELECT user_id, bool_or(event_id % 11 = 0) AS ok, arg_max(event_type, event_id) FILTER (event_id % 11 <> 0 AND event_id % 2 = 0) AS why FROM events GROUP BY user_id),
    r AS (SELECT coalesce(why, 'unknown_failure') AS reason, count(*) AS n FROM a LEFT JOIN s ON s.user_id = a.u WHERE NOT coalesce(ok, false) GROUP BY 1), t AS (SELECT * FROM r ORDER BY n DESC, reason LIMIT 3)
    SELECT coalesce(string_agg(reason || ' x' || n, '; ' ORDER BY n DESC, reason), 'none') AS summary FROM t""")
def failure_summary(spark, sf):
    return bookkeeping.reasons_text(bookkeeping.fetch_outcomes(*_attempts(table(spark, sf, "events"))))


@query("SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '2023-12-25', DATE '2024-03-05', INTERVAL 1 DAY) t(d) WHERE CAST(d AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM events WHERE event_id % 2 = 0)")
def days_to_fetch(spark, sf):
    files = table(spark, sf, "events").filter("event_id % 2 = 0").select(F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("000000.gkg.csv")).alias("name"))
    return bookkeeping.days_to_fetch(spark, "2023-12-25", "2024-03-05", files)


@query("""WITH c AS (SELECT p_type AS d, count(*) FILTER (p_size >= 30) AS a, count(*) FILTER (p_size >= 7) AS b FROM part WHERE p_partkey % 3 = 0 GROUP BY 1),
    s AS (SELECT p_partkey, p_type, p_size, p_retailprice, CASE WHEN p_size >= 30 THEN greatest(12 - coalesce(a, 0), 0) * 3.0 ELSE 0 END + CASE WHEN p_size >= 7 THEN greatest(12 - coalesce(b, 0), 0) * 1.4 ELSE 0 END AS deficit FROM part LEFT JOIN c ON c.d = p_type)
    SELECT p_partkey, round(CAST(deficit AS DOUBLE), 6) AS deficit FROM s WHERE deficit > 0 OR (SELECT max(deficit) FROM s) <= 0 ORDER BY CAST(deficit AS DOUBLE) DESC, p_size DESC, p_retailprice DESC, p_partkey LIMIT 200""")
def candidate_batch(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("domain"), F.col("p_size").alias("duration_days"), F.col("p_retailprice").alias("volume"))
    third = p.filter("p_partkey % 3 = 0")
    counts = third.select("domain", F.explode(F.array(F.lit(30), F.lit(7))).alias("offset"), "duration_days").filter("duration_days >= offset").groupBy("domain", "offset").agg(F.count("*").alias("n"))
    best = questions.next_batch(questions.deficit_scores(p, counts, [30, 7], 12), 200, "p_partkey")
    return best.select("p_partkey", F.round("deficit", 6).alias("deficit"))


@query("""WITH s AS (SELECT * FROM part WHERE p_size < 20) SELECT 'size' AS dimension, 'selected' AS value, count(*) AS n FROM s UNION ALL SELECT 'size', 'available', count(*) FROM part UNION ALL SELECT 'p_brand', p_brand, count(*) FROM s GROUP BY 2 UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM s GROUP BY 2
    UNION ALL SELECT 'p_name:start', min(p_name), NULL FROM s UNION ALL SELECT 'p_name:end', max(p_name), NULL FROM s""")
def subset_statistics(spark, sf):
    p = table(spark, sf, "part")
    return questions.subset_stats(p.filter("p_size < 20"), p.count(), ["p_brand", "p_size"], ["p_name"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'easy' WHEN c_custkey % 3 = 0 THEN 'hard' WHEN c_custkey % 5 = 0 THEN 'medium' ELSE 'unknown' END AS difficulty,
    CASE WHEN c_custkey % 2 = 0 THEN '30,' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN '7,' ELSE '' END || CASE WHEN c_custkey % 5 = 0 THEN '3,' ELSE '' END AS offsets FROM customer""")
def sampled_horizons(spark, sf):
    k = F.col("c_custkey")
    one = lambda h, d, m: F.when(k % m == 0, F.struct(F.lit(h).alias("key"), F.struct(F.lit(0.5).alias("p_yes"), F.lit(d).alias("difficult"), F.lit("t").alias("t")).alias("value")))
    entries = F.filter(F.array(one("3d", "medium", 5), one("7d", "hard", 3), one("30d", "easy", 2)), lambda e: e.isNotNull())
    sampled = F.map_from_entries(entries)
    offsets = F.array_join(F.transform(questions.offsets_of(F.map_keys(sampled)), lambda d: F.concat(d.cast("string"), F.lit(","))), "")
    return table(spark, sf, "customer").select("c_custkey", questions.dominant_difficulty(sampled).alias("difficulty"), offsets.alias("offsets"))


@query("SELECT coalesce(o_orderpriority, 'total') AS o_orderpriority, sum(o_custkey) AS o_custkey, sum(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey END) AS tokens FROM orders GROUP BY ROLLUP (o_orderpriority)")
def run_totals(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", "o_custkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).alias("tokens"))
    return bookkeeping.totals(o, "o_orderpriority", "o_custkey", "tokens")


@query("SELECT conv_id, coalesce(arg_max(coalesce(text, ''), turn) FILTER (role = 'assistant'), '') AS final FROM conversations GROUP BY conv_id")
def final_messages(spark, sf):
    return bookkeeping.last_message(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@query("""SELECT page_id, sha1(coalesce(html, ''))[1:16] AS page_hash, CASE WHEN page_id % 2 = 0 THEN 'physics-' || page_id ELSE 'a' END AS slug, CASE WHEN page_id % 3 = 0 THEN 'Unknown' ELSE 'S' || page_id % 3 END AS subject, CASE WHEN page_id % 2 = 0 THEN 'p' || page_id || '.xhtml,q.xhtml' ELSE '' END AS refs FROM pages""")
def catalogue_scalars(spark, sf):
    k = F.col("page_id")
    slug = F.when(k % 2 == 0, F.concat(F.lit("/books/physics-"), k.cast("string"), F.lit("/"))).otherwise("a")
    subjects = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("S"), (k % 3).cast("string")), F.lit("T")))
    link = F.concat(F.lit("<a class='x' href='./p"), k.cast("string"), F.lit(".xhtml'>1</a>"))
    toc = F.when(k % 2 == 0, F.concat(link, F.lit('<a href="./q.xhtml">2</a><a href="http://o/r.xhtml">3</a><a href="./s.html">4</a>'), link)).otherwise("<p>none")
    return table(spark, sf, "pages").select("page_id", catalogue.page_hash(F.col("html")).alias("page_hash"), catalogue.book_slug(slug).alias("slug"), catalogue.primary_subject(subjects).alias("subject"), F.array_join(catalogue.toc_refs(toc), ",").alias("refs"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a,b' ELSE '' END AS hits, CASE event_id % 4 WHEN 0 THEN 'u' WHEN 1 THEN 'fallback' ELSE '' END AS href, CASE event_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/plain' ELSE '' END AS mime, CASE event_id % 4 WHEN 0 THEN '403,429' WHEN 1 THEN '' ELSE '500' END AS codes,
    CASE event_id % 4 WHEN 0 THEN 'object' WHEN 1 THEN 'object' WHEN 2 THEN 'raw' ELSE 'results' END AS kind FROM events""")
def tool_payloads(spark, sf):
    k = F.col("event_id") % 4
    p = F.when(k == 0, '{"hits":[{"content":" a "},{"content":" "},{"content":"b","source":"s"}],"_links":{"next":{"href":"u"}},"mimeType":" Application/PDF "}').when(k == 1, '{"_links":{"next":{"href":"fallback"}},"format":{"mimetype":"text/plain"}}').when(k == 2, "plain words").otherwise("[1, 2]")
    shape = payloads.tool_payload(p)
    kind = F.when(F.get_json_object(shape, "$.raw_content").isNotNull(), "raw").when(F.get_json_object(shape, "$.results").isNotNull(), "results").otherwise("object")
    codes = payloads.status_codes(F.when(k == 0, " 429, 403,x,429,99").when(k == 1, "600").otherwise("500"))
    return table(spark, sf, "events").select("event_id", F.array_join(payloads.tool_hits(shape), ",").alias("hits"), F.coalesce(payloads.link_href(shape, "next"), F.lit("")).alias("href"), payloads.mime(shape).alias("mime"), F.array_join(F.transform(codes, lambda c: c.cast("string")), ",").alias("codes"), kind.alias("kind"))


_LUCENE = r"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{Nd}\p{Pc}]{2,}'), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS) + "))"
_SCORES = f"""{_POSTINGS}, st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY ALL),
    s AS (SELECT qid, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * qtf) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL)"""


def _passages(spark, sf):
    d = F.col("doc_id")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (d % 28).cast("int")), "yyyy-MM-dd")
    kind = F.element_at(F.lit(["info/news", "info/blog", "kb/paper", "kb/report"]), (d % 4 + 1).cast("int"))
    return table(spark, sf, "documents").select(d.alias("row_index"), F.col("text").alias("contents"), day.alias("timestamp"), kind.alias("source"))


def _questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.when(F.col("item_id") % 3 != 0, "2024-01-15").alias("cutoff"))


@query(f"""WITH {_SCORES}, h AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0 AND (qid % 3 = 0 OR doc_id % 28 <= 14) AND doc_id % 4 IN (0, 2))
    SELECT qid, doc_id AS "row", round_even(score, 4) AS score, rank FROM h WHERE rank <= 5""")
def search_hits(spark, sf):
    """All questions at once over all passages: scored, cut off by day, filtered by source, ranked."""
    hits_ = retrieval.search(_passages(spark, sf), _questions(spark, sf), 5, "news, kb/paper", None)
    return hits_.select("qid", "row", "score", "rank")


@query(f"""WITH {_SCORES}, o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS n FROM s WHERE score > 0),
    h AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM o WHERE n <= 40 AND (qid % 3 = 0 OR doc_id % 28 <= 14)) SELECT qid, doc_id AS "row", rank FROM h WHERE rank <= 10""")
def search_over_fetched(spark, sf):
    """As an engine does that fetches more candidates than it shows and filters them then."""
    return retrieval.search(_passages(spark, sf), _questions(spark, sf), 10, None, 40).select("qid", "row", "rank")


@query(f"""WITH d AS (SELECT doc_id, {_LUCENE} AS w FROM documents), p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({_LUCENE}) AS term FROM benchmark) GROUP BY ALL),
    s AS (SELECT qid, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * qtf) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
    f AS (SELECT item_id AS qid, x.doc_id, coalesce(s.score, 0) AS score FROM benchmark CROSS JOIN documents x LEFT JOIN s ON s.qid = item_id AND s.doc_id = x.doc_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM f) SELECT qid, doc_id AS "row", round(score, 6) AS score, rank FROM r WHERE rank <= 20""")
def bm25_lucene_topk(spark, sf):
    best = retrieval.bm25(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text", 20, "lucene")
    return best.select("qid", "row", F.round("score", 6).alias("score"), "rank")


@query("""WITH p AS (SELECT p_partkey, p_type, CASE WHEN p_size < 17 THEN 'easy' WHEN p_size < 34 THEN 'medium' ELSE 'hard' END AS difficulty, p_partkey % 4 AS o, p_partkey % 3 AS r FROM part),
    t AS (SELECT 'difficulty' AS dimension, difficulty AS value, count(*) AS n FROM p GROUP BY 2 UNION ALL SELECT 'open_bucket', CAST(o AS VARCHAR), count(*) FROM p GROUP BY 2 UNION ALL SELECT 'resolve_bucket', CAST(r AS VARCHAR), count(*) FROM p GROUP BY 2),
    u AS (SELECT *, CAST(row_number() OVER (PARTITION BY dimension ORDER BY value) AS INTEGER) AS k, count(*) OVER (PARTITION BY dimension) AS m FROM t)
    SELECT dimension, value, CAST(60 // m + CASE WHEN k <= 60 % m THEN 1 ELSE 0 END AS INTEGER) AS target FROM u""")
def even_targets(spark, sf):
    """What a balanced subset should have of each value but the domains."""
    from marlstone.operators import selection

    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(F.col("p_type").alias("domain"), F.when(F.col("p_size") < 17, "easy").when(F.col("p_size") < 34, "medium").otherwise("hard").alias("difficulty"), (k % 4).cast("string").alias("open_bucket"), (k % 3).cast("string").alias("resolve_bucket"))
    counts = {tuple(r[c] for c in selection.COVERED): r["count"] for r in p.groupBy(*selection.COVERED).count().collect()}  # some hundred signatures
    rows = [(c, v, n) for c, each in selection.targets(counts, 60).items() if c != "domain" for v, n in each.items()]
    return spark.createDataFrame(rows, "dimension string, value string, target int")


@query("""WITH RECURSIVE p AS (SELECT CAST(p_type AS VARCHAR) AS domain, count(*) AS n FROM part GROUP BY 1), x AS (SELECT domain, 600 * sqrt(n) / sum(sqrt(n)) OVER () AS exact FROM p), f AS (SELECT *, greatest(1, CAST(floor(exact) AS INTEGER)) AS base, exact - floor(exact) AS rest FROM x),
    r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, domain DESC) AS k, 600 - sum(base) OVER () AS short FROM f) SELECT domain, CAST(base + CASE WHEN k <= short THEN 1 ELSE 0 END AS INTEGER) AS target FROM r""")
def root_targets(spark, sf):
    """What a balanced subset of 600 should have of each domain."""
    from marlstone.operators import selection

    counts = {r.domain: r.n for r in table(spark, sf, "part").groupBy(F.col("p_type").alias("domain")).agg(F.count("*").alias("n")).collect()}
    return spark.createDataFrame(list(selection.sqrt_targets(counts, 600).items()), "domain string, target int")
