"""Quotation linking: who answers whom, found by what messages quote, and conversations in reply order without the quotes.

A line's quote level is the number of its leading marks ('>'). Runs of lines of one level are passages. Passages and what stands unquoted in messages are
cut into units (the whole, its paragraphs, its sentences), normalised to their words and hashed. A quoted unit belongs to the first message that has it unquoted: in its
own conversation if that is earlier, else (units of LEAST_WORDS or more) in any conversation. A message replies to the one that its longest unit of level one in its own
conversation comes from; threads are the trees of replies, and a message's replies follow it, depth first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import WORD, col, join_by_hot_key, lower_ascii, small_batches, texts, written
from marlstone.llm.graph import components

_MARKS = re.compile(r"^(?:[ \t]*>)+ ?")
#: A line that only tells whose words follow; it goes with the quote.
_ATTRIBUTION = re.compile(r"^.{0,200}\b(?:wrote|writes|said|schrieb|escribió|a écrit)\s*:\s*$", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_WORDS = re.compile(WORD)
#: Units of fewer words are too common to tell conversations apart: they link within their own only.
LEAST_WORDS = 4


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotes, and the quoted passages as (level, text), in order."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for line in text.split("\n"):
        m = _MARKS.match(line)
        level = m.group().count(">") if m else 0
        rest = line[m.end() :] if m else line
        if not level:
            own.append(line)
        elif level == last:
            passages[-1][1].append(rest)
        else:
            if not last and own and _ATTRIBUTION.match(own[-1]):
                own.pop()
            passages.append((level, [rest]))
        last = level
    plain = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip() if passages else text
    return plain, [(level, "\n".join(lines)) for level, lines in passages]


def units(text: str) -> dict[bytes, int]:
    """Hash -> number of words of the whole text, its paragraphs and its sentences; a paragraph broken over several lines is one."""
    parts = [text]
    for block in re.split(r"\n\s*\n", text):
        parts += [block, *block.split("\n"), *_SENTENCE.split(block)]
    out: dict[bytes, int] = {}
    for part in dict.fromkeys(parts):
        words = _WORDS.findall(lower_ascii(part))
        if words:
            out[hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()] = len(words)
    return out


_OWN = pa.list_(pa.binary())
_QUOTED = pa.list_(pa.struct([("h", pa.binary()), ("n", pa.int32()), ("level", pa.int32()), ("passage", pa.int32())]))


def _parsed(messages: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    rows = messages.select(F.monotonically_increasing_id().alias("uid"), col(conv).alias("conv"), col(turn).alias("turn"), col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean, own, quoted, counts = [], [], [], []
            for t in texts(b, "text"):
                plain, passages = parse(t)
                clean.append(plain)
                own.append(list(units(plain)))
                quoted.append([{"h": h, "n": n, "level": level, "passage": i} for i, (level, p) in enumerate(passages) for h, n in units(p).items()])
                counts.append(len(passages))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(3)] + [pa.array(clean, pa.string()), pa.array(own, _OWN), pa.array(quoted, _QUOTED), pa.array(counts, pa.int64())], names=["uid", "conv", "turn", "clean_text", "own", "quoted", "n_quotes"])

    quoted_type = T.ArrayType(T.StructType([T.StructField("h", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("passage", T.IntegerType())]))
    fields = [*rows.schema.fields[:3], T.StructField("clean_text", T.StringType()), T.StructField("own", T.ArrayType(T.BinaryType())), T.StructField("quoted", quoted_type), T.StructField("n_quotes", T.LongType())]
    return written(rows.mapInArrow(run, T.StructType(fields)), "messages")


def find_links(parsed: DataFrame) -> DataFrame:
    """uid, conv, turn, passage, level, n, and where the unit comes from: from_conv, from_turn. One row for each quoted unit that has an origin."""
    known = parsed.filter("conv is not null and turn is not null")
    quoted = written(known.select("uid", "conv", "turn", F.explode("quoted").alias("q")).select("uid", "conv", "turn", F.col("q.h").alias("h"), F.col("q.n").alias("n"), F.col("q.level").alias("level"), F.col("q.passage").alias("passage")), "quoted")
    asked = written(quoted.groupBy("h").agg(F.count("*").alias("asked"), F.max("n").alias("words")), "asked")
    # One row a unit and conversation, before common units meet in the join.
    origins = known.select("conv", "turn", F.explode("own").alias("h")).groupBy("h", "conv").agg(F.min("turn").alias("near_turn"))
    near = written(origins.join(asked.select("h"), "h", "left_semi"), "near")
    # The two smallest conversations of each unit, as the smallest may be the asking one.
    place = F.min(F.struct("conv", F.col("near_turn").alias("turn")))
    first = near.groupBy("h").agg(place.alias("far"), F.count("*").alias("convs"))
    first = written(first.join(asked.filter(F.col("words") >= LEAST_WORDS), "h", "left_semi"), "first")
    rest = join_by_hot_key(near, first.filter("convs > 1"), "h", "convs").filter(F.col("conv") != F.col("far.conv"))
    second = rest.groupBy("h").agg(place.alias("second"))
    far = written(asked.select("h", "asked").join(first.select("h", "far"), "h", "left").join(second, "h", "left"), "far")  # short units too, as they may be hot
    per = quoted.groupBy("h", "conv").agg(F.count("*").alias("asks")).join(near, ["h", "conv"], "left").select(F.struct("h", "conv").alias("hc"), "asks", "near_turn")
    found = join_by_hot_key(quoted.withColumn("hc", F.struct("h", "conv")), written(per, "per"), "hc", "asks").drop("hc", "asks")
    found = join_by_hot_key(found, far, "h", "asked")
    own = F.col("near_turn") < F.col("turn")
    other = F.when(F.col("far.conv") == F.col("conv"), F.col("second")).otherwise(F.col("far"))
    here = F.struct("conv", F.col("near_turn").alias("turn"))
    found = found.withColumn("origin", F.when(own, here).otherwise(other))
    return found.filter(F.col("origin.turn").isNotNull()).select("uid", "conv", "turn", "passage", "level", "n", F.col("origin.conv").alias("from_conv"), F.col("origin.turn").alias("from_turn"))


def in_order(df: DataFrame, *order: str) -> DataFrame:
    """df in this order with idx, the number of each row from 0, from a table. No group is gathered: rows are dealt by ranges and counted by part."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(range(at, at + b.num_rows), pa.int64())], names=[*b.schema.names, "place"])
            at += b.num_rows

    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    placed = written(dealt.mapInArrow(number, T.StructType([*dealt.schema.fields, T.StructField("place", T.LongType())])), "ordered")
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each part
    return placed.join(F.broadcast(before), "part").withColumn("idx", F.col("place") + F.col("before")).drop("part", "place", "before")


def depth_first(children: DataFrame) -> DataFrame:
    """uid, root, after (how many messages of the tree stand from this one to the end, itself included) of all messages in trees of children (uid, parent, turn).

    Each tree is walked around: a message is entered, its replies by turn are walked, it is left. The steps of a walk are a list, whose ranks are found by doubling: in each
    round, a step takes over its successor's successor. Steps that have reached the end of their walk drop out, so that no key is hot; there are as many rounds as the
    longest walk has binary digits.
    """
    ordered = written(in_order(children, "parent", "turn", "uid"), "children")
    later = ordered.select((F.col("idx") - 1).alias("idx"), F.col("uid").alias("next"), F.col("parent").alias("same"))
    beside = ordered.join(later, "idx", "left").select("uid", "parent", F.when(F.col("same") == F.col("parent"), F.col("next")).alias("next"))
    inner = ordered.groupBy(F.col("parent").alias("uid")).agg(F.min_by("uid", "idx").alias("child"))
    nodes = beside.join(inner, "uid", "full")
    enter, leave = lambda c: F.col(c) * 2, lambda c: F.col(c) * 2 + 1
    steps = nodes.select(enter("uid").alias("e"), F.coalesce(enter("child"), leave("uid")).alias("to"), F.lit(1).cast("long").alias("w"))
    steps = steps.unionByName(nodes.select(leave("uid").alias("e"), F.coalesce(enter("next"), leave("parent")).alias("to"), F.lit(0).cast("long").alias("w")))
    steps = written(steps, "steps")
    # done: end and the weight to it; open: where the pointer is and the weight up to there.
    done = steps.filter("to is null").select("e", F.col("e").alias("end"), "w")
    open_ = steps.filter("to is not null")
    while open_.take(1):
        every = open_.select(F.col("e").alias("to"), F.col("to").alias("then"), F.lit(None).cast("long").alias("end"), F.col("w").alias("more"))
        every = every.unionByName(done.select(F.col("e").alias("to"), F.lit(None).cast("long").alias("then"), "end", F.col("w").alias("more")))
        jumped = written(open_.join(every, "to").select("e", F.col("then").alias("to"), "end", (F.col("w") + F.col("more")).alias("w")), "jumped")
        done = written(done.unionByName(jumped.filter("end is not null").select("e", "end", "w")), "done")
        open_ = jumped.filter("end is null").select("e", "to", "w")
    return done.filter("e % 2 = 0").select(F.floor(F.col("e") / 2).alias("uid"), F.floor(F.col("end") / 2).alias("root"), F.col("w").alias("after"))


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """For each message: the conversation and turn, clean_text (without quotes), n_quotes (passages), n_linked (passages with an origin), reply_to (a turn of the
    same conversation, or null), thread (the turn that its chain of replies starts at), position (from 1, in its conversation: threads by their first turn, in
    them a message, then its replies by turn, each with its own before the next).

    Null texts are empty; a message without conversation or turn links to nothing and is its own thread. Repeated (conversation, turn) rows are messages each, in one
    thread; replies go to the first of them. An empty table gives none. Other columns, whatever their names, take no part. Conversations may be of any length: neither links
    nor positions gather one in a task.
    """
    spark = messages.sparkSession
    small_batches(spark)
    parsed = _parsed(messages, conv, turn, text)
    links = written(find_links(parsed), "links")
    per = links.groupBy("uid").agg(F.countDistinct("passage").alias("n_linked"), F.max(F.when((F.col("level") == 1) & (F.col("from_conv") == F.col("conv")), F.struct("n", "from_turn"))).alias("best"))
    per = written(per.select("uid", "n_linked", F.col("best.from_turn").alias("reply_to")), "replies")
    node = lambda c: F.struct(F.col("conv"), F.col(c).alias("turn"))
    replies = links.select("uid", "conv", "turn").distinct().join(per.filter("reply_to is not null"), "uid").select("uid", "turn", node("turn").alias("a"), node("reply_to").alias("b"))
    replies = written(replies, "edges")
    threads = components(replies.select("a", "b")).select(F.col("node.conv").alias("conv"), F.col("node.turn").alias("turn"), F.col("label.turn").alias("thread"))
    heads = parsed.filter("conv is not null and turn is not null").groupBy(node("turn").alias("b")).agg(F.min("uid").alias("parent"))
    heads = written(heads.join(replies.groupBy("b").agg(F.count("*").alias("n")), "b"), "heads")
    trees = written(depth_first(join_by_hot_key(replies, heads, "b", "n").select("uid", "parent", "turn")), "trees")
    rows = parsed.select("uid", "conv", "turn", "clean_text", "n_quotes").join(per, "uid", "left").join(threads, ["conv", "turn"], "left").join(trees, "uid", "left")
    rows = rows.withColumn("thread", F.coalesce("thread", "turn")).withColumn("root", F.coalesce("root", "uid")).withColumn("rank", -F.coalesce("after", F.lit(0).cast("long")))
    ordered = in_order(rows.drop("after"), "conv", "thread", "root", "rank", "uid")
    # A struct is never null, so that messages without a conversation are a group too.
    first = written(ordered.groupBy(F.struct("conv").alias("k")).agg(F.min("idx").alias("first"), F.count("*").alias("n")), "first")
    out = join_by_hot_key(ordered.withColumn("k", F.struct("conv")), first, "k", "n")
    return out.select(F.col("conv").alias(conv), F.col("turn").alias(turn), "clean_text", "n_quotes", F.coalesce("n_linked", F.lit(0).cast("bigint")).alias("n_linked"), "reply_to", "thread", (F.col("idx") - F.col("first") + 1).alias("position"))
