"""Benchmark decontamination with DataFrame functions only.

The windows of the benchmark (runs of so many words; an item of fewer is one window) are hashed and broadcast. Documents are scanned
once: their words become arrays of rolling window hashes by pairwise combination (2, 4, 8 words, ...), the hashes are unfolded and probe
the broadcast table inside the same stage, and hits are verified word by word. Only the hits and one marker row per document
reach the only exchange, combined per document before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import col, free_name, kept, without, words_column, written

#: Words in a window.
WINDOW = 10
#: Windows, and bytes of their words and item ids, broadcast at once. A larger benchmark is dealt out over several scans.
MOST_WINDOWS, MOST_BYTES = 1_000_000, 128 << 20
_RESULT = ["n_words", "n_hit", "n_items", "items", "windows", "contaminated"]


def _zip(a: Column, b: Column, shift: int, n: Column) -> Column:
    """Pairs a[i] with b[i + shift] for the first n i, hashed."""
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(shift + 1), n), lambda x, y: F.xxhash64(x, y))


def window_hashes(df: DataFrame, words: str, lengths: list[int], out: str) -> DataFrame:
    """Adds, for each length n, the array {out}{n} of the hashes of all runs of n words. Longer runs are put together from powers of two."""
    size = F.size(words)
    room = lambda n: F.greatest(size - (n - 1), F.lit(0))
    df = df.withColumn("_p1", F.transform(words, lambda x: F.xxhash64(x)))
    df = df.withColumn("_p2", _zip(F.col(words), F.col(words), 1, room(2)))
    power = 2
    while 2 * power <= max(lengths, default=1):
        df = df.withColumn(f"_p{2 * power}", _zip(F.col(f"_p{power}"), F.col(f"_p{power}"), power, room(2 * power)))
        power *= 2
    for n in lengths:
        parts = [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]
        done, have = F.col(f"_p{parts[0]}"), parts[0]
        for p in parts[1:]:
            done = _zip(done, F.col(f"_p{p}"), have, room(have + p))
            have += p
        df = df.withColumn(f"{out}{n}", done)
    return df.drop(*[c for c in df.columns if c.startswith("_p") and c[2:].isdigit()])


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows: h (hash), len, win (words), ids (item ids that hold it; an item whose id is null adds none)."""
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), words_column(F.col(text)).alias("w")).filter(F.size("w") > 0)
    starts = items.select("id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))).alias("s"))
    wins = starts.groupBy(F.slice("w", F.col("s"), F.lit(window)).alias("win")).agg(F.collect_set("id").alias("ids")).withColumn("len", F.size("win"))
    every = window_hashes(wins, "win", list(range(1, window + 1)), "_h")
    pick = F.coalesce(*[F.when(F.col("len") == n, F.get(F.col(f"_h{n}"), F.lit(0))) for n in range(1, window + 1)])
    return every.select(pick.alias("h"), "len", "win", "ids")


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, most: int = MOST_WINDOWS) -> DataFrame:
    """Columns of docs without the text, and what was found: n_words, n_hit (words inside any occurrence of a window), n_items, items
    (their ids, as sorted strings), windows (start and length in words of each occurrence), contaminated (n_hit > 0).

    One row for each row of docs. Null and empty texts have no words and no hits; an empty benchmark hits nothing. Repeated documents
    are found each; repeated items count once. Columns of docs with the names of new ones give way to them.
    """
    wins = benchmark_windows(benchmark, item_id, item_text, window)
    held = F.octet_length(F.array_join("win", " ")) + F.octet_length(F.array_join("ids", " ")) + 8 * F.size("ids")
    count, held, lengths = wins.agg(F.count("*"), F.coalesce(F.sum(held), F.lit(0)), F.collect_set("len")).first()
    lengths = sorted(lengths) or [window]
    keep = [c for c in kept(docs, _RESULT) if c != text]
    scans = max(1, -(-count // most), -(-held // MOST_BYTES))
    base = docs.select(F.monotonically_increasing_id().alias("_uid"), F.struct(*map(col, keep)).alias("_kept") if keep else F.lit(0).alias("_kept"), words_column(col(text)).alias("_words"))
    base = window_hashes(written(base, "numbered") if scans > 1 else base, "_words", lengths, "_h")
    n = F.size("_words")
    rooms = {x: F.greatest(n - (x - 1), F.lit(0)) for x in lengths}
    before = {x: reduce(lambda a, b: a + b, [rooms[y] for y in lengths if y < x], F.lit(0)) for x in lengths}
    start = reduce(lambda a, x: F.when(F.col("len") == x, F.col("_at") - 1 - before[x]).otherwise(a), lengths, F.lit(-1))
    found = None
    for k in range(scans):
        marker = wins.sparkSession.range(1).selectExpr("0L AS h", "0 AS len", "cast(null AS array<string>) AS win", "cast(null AS array<string>) AS ids")
        part = wins.filter(F.pmod("h", F.lit(scans)) == k).unionByName(marker)
        rows = base.select("_uid", "_kept", "_words", F.posexplode(F.concat(F.array(F.lit(0).cast("bigint")), *[F.col(f"_h{x}") for x in lengths])).alias("_at", "h"))
        rows = rows.join(F.broadcast(part), "h").withColumn("_s", start)
        marked = (F.col("_at") == 0) & (F.col("len") == 0)
        hit = (F.col("len") > 0) & (F.col("_at") > 0) & (F.col("_s") >= 0) & (F.slice("_words", F.col("_s") + 1, F.greatest("len", F.lit(1))) == F.col("win"))
        rows = rows.filter(marked | hit).select("_uid", "_kept", n.alias("n_words"), F.when(F.col("len") > 0, F.struct(F.col("_s").alias("start"), "len")).alias("_win"), "ids")
        found = rows if found is None else found.unionByName(rows)
    by = found.groupBy("_uid").agg(F.first("_kept").alias("_kept"), F.max("n_words").alias("n_words"), F.collect_set("_win").alias("windows"), F.collect_set("ids").alias("_ids"))
    by = by.withColumn("items", F.array_sort(F.array_distinct(F.flatten("_ids"))))
    hits = F.size(F.array_distinct(F.flatten(F.transform("windows", lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1)))))
    out = by.select(*[F.col(f"_kept.`{c}`").alias(c) for c in keep], F.col("n_words").cast("bigint").alias("n_words"), hits.cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items", "windows")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def remove_documents(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The rows of docs, as they are, whose texts hold no window of the benchmark.

    A verdict depends on the text alone, so that rows are matched by key (nulls are equal) and fingerprint of the text: docs needs no row numbers, and its columns may
    have any names. The verdicts are a table; it is broadcast while it is small, so that texts stay where they are. Null and empty texts stay, an empty
    benchmark removes nothing, repeated rows go or stay together.
    """
    found = find_hits(docs.select(col(key).alias("id"), F.xxhash64(col(text)).alias("fp"), col(text).alias("text")), benchmark, "text", **more)
    bad_id, bad_fp = free_name(docs.columns, "_bad_id"), free_name(docs.columns, "_bad_fp")
    bad = written(found.filter("contaminated").select(F.col("id").alias(bad_id), F.col("fp").alias(bad_fp)).distinct(), "contaminated")
    return without(docs, bad, col(key).eqNullSafe(F.col(bad_id)) & F.xxhash64(col(text)).eqNullSafe(F.col(bad_fp)))


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **more) -> DataFrame:
    """The rows of docs with the hit words taken out of the texts; what stands between two hit words goes with them.

    A column clean_text is added. Null texts stay null.
    """
    whole, odd, parts = (free_name([*docs.columns, *_RESULT, "clean_text"], x) for x in ("_text", "_odd", "_parts"))
    found = find_hits(docs.withColumn(whole, col(text)), benchmark, text, **more)
    word = r"[A-Za-z0-9\x{80}-\x{10FFFF}]+"
    cut = F.regexp_extract_all(whole, F.lit(f"{word}|[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), F.lit(0))
    covered = lambda i: F.exists("windows", lambda x: (i >= x["start"]) & (i < x["start"] + x["len"]))
    at = lambda i: ((i - F.col(odd)) / 2).cast("int")
    is_word = lambda i: F.pmod(i + F.col(odd), F.lit(2)) == 0
    gone = lambda i: F.when(is_word(i), covered(at(i))).otherwise((i > 0) & F.exists("windows", lambda x: (at(i - 1) >= x["start"]) & (at(i - 1) < x["start"] + x["len"] - 1)))
    clean = F.array_join(F.transform(parts, lambda x, i: F.when(gone(i), "").otherwise(x)), "")
    out = found.withColumn(odd, F.when(F.col(whole).rlike(f"^{word}"), 0).otherwise(1)).withColumn(parts, cut)
    out = out.withColumn("clean_text", F.when(F.col("contaminated"), clean).otherwise(F.col(whole)))
    return out.withColumn(text, F.col(whole)).drop(whole, odd, parts)
