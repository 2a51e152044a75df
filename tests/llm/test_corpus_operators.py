"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from marlstone.llm import byte_bpe, decontaminate, licenses, ngram_join, ngram_lm, quotes, token_counts, topk, toxicity, warc
from marlstone.llm.common import lower_ascii, shared_dir

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, n_tokens string, Score string, extra int"
SPM, RANKS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash", 1) for i, t in enumerate(texts)], DOCS)


def prose(rng, n, vocabulary=200):
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", ",", ".", ".\n"]) for _ in range(n))


TRICKY = ["", None, " ", "a", "  two  spaces  ", "a\n b\t▁c▁▁", "ÉCOLE Straße 日本語 🎉 naïve", "<s>x</s> <|endoftext|>", "x" * 500, "tail   ", "'s 'll don't 123 4.5%", "same text here", "same text here", "\x00 odd \x1f", "one two  three\r\nfour"]


def test_token_counts(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=SPM)
    rng = random.Random(3)
    texts = TRICKY + [prose(rng, 300) for _ in range(5)] + ["word " * 30_000]
    rows = token_counts.count_tokens(docs(spark, texts), SPM, capacity=50, cache=20)
    assert rows.columns == ["doc_id", "text", "Score", "extra", "n_bytes", "n_tokens", "over_limit"]
    for r in rows.collect():
        t = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096), t[:40]
    assert token_counts.count_tokens(docs(spark, texts).limit(0), SPM).count() == 0
    # The longest lengths that the table of frequent pre-tokens may have to hold, and words that are too long for it.
    wide = ["\U00010348" * 64 + " " + "\U0001F9FF" * 64, "\U00010348" * 64, "\U00010348" * 65 + " x", "a" * 300_000, None]
    for r in token_counts.count_tokens(docs(spark, wide * 2), SPM, capacity=50).collect():
        assert r.n_tokens == len(sp.encode(wide[r.doc_id % 5] or ""))
    assert token_counts.additive(SPM)


def test_byte_bpe(spark, monkeypatch):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    rng = random.Random(4)
    texts = TRICKY + [prose(rng, 400) for _ in range(3)]
    rows = byte_bpe.decode(byte_bpe.encode(docs(spark, texts), RANKS, public_tokenizers.PATTERN), RANKS).collect()
    for r in rows:
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert np.frombuffer(r.token_ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()
    monkeypatch.setattr(byte_bpe, "PIECE", 20)
    odd = list("abcXY019 .,;:!?()'\n\t\r\u3000\x1c\x85\u00a0日本語かなカナー・。、「」！é½²٣_-") + ["'s", "'ll", "  ", "\n\n", "n't"]
    texts += ["".join(rng.choice(odd) for _ in range(300)) for _ in range(200)] + ["日本語です。" * 50, "a1" * 100, "line\n" * 100, "x" * 5000]
    for t in [x for x in texts if x]:
        assert "".join(byte_bpe.cut(t, 5)) == t and np.concatenate([enc.encode_ordinary(x) for x in byte_bpe.cut(t, 5)]).tolist() == enc.encode_ordinary(t) and byte_bpe.encode_one(enc, t).tolist() == enc.encode_ordinary(t)


def test_byte_bpe_long_and_odd(spark):
    """Long texts of any script are cut; null ids give null, unknown ids are an error."""
    enc = byte_bpe.encoder(RANKS, public_tokenizers.PATTERN)
    long = ["日本語のとても長い文です。" * 8000, "line of text\n" * 20_000, "a1" * 60_000]
    assert all(max(map(len, byte_bpe.cut(t))) < byte_bpe.PIECE + 100 for t in long)
    rows = byte_bpe.encode(docs(spark, long), RANKS, public_tokenizers.PATTERN).collect()
    assert all(np.frombuffer(r.token_ids, "<u4").tolist() == enc.encode_ordinary(long[r.doc_id]) for r in rows)
    ids = spark.createDataFrame([(1, None), (2, b"")], "k int, token_ids binary")
    assert {r.k: r.decoded for r in byte_bpe.decode(ids, RANKS).collect()} == {1: None, 2: b""}
    with pytest.raises(Exception, match="KeyError"):
        byte_bpe.decode(spark.createDataFrame([(b"\xff\xff\xff\x7f",)], "token_ids binary"), RANKS).collect()


def test_warc(spark, monkeypatch):
    big = "<p>" + "copy " * 60
    pages = [(1, "http://a", "<p>one"), (2, None, None), (7, "http://b", big), (3, "http://c\nx", big), (3, "http://c2", big), (None, "http://d", big), (9, "u", "<p>one"), (10, "u", ""), (11, "é", "ü" * 200)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string")
    path = shared_dir(spark, "warc-test")
    monkeypatch.setattr(warc, "FILE_BYTES", 400)
    index = warc.write(warc.plan_records(df), path)
    assert index.count() == len(pages) and index.select("file", "offset").distinct().count() == len(pages)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(index, path).collect())
    first = 3
    want = Counter()
    for i, _, h in pages:
        body = (h or "").encode()
        revisit = h == big and i != first
        want[(i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None)] += 1
    assert got == want
    some = warc.read(index.filter("url = 'é'"), path).collect()
    assert [bytes(r.payload).decode() for r in some] == ["ü" * 200]
    empty = warc.write(warc.plan_records(df.limit(0)), shared_dir(spark, "warc-test"))
    assert empty.count() == 0
    assert warc.coalesce([(0, 10), (10, 5), (100, 5)], gap=20, most=50) == [(0, 15, [(0, 10), (10, 5)]), (100, 105, [(100, 5)])]


def test_quotes_parse():
    plain, passages = quotes.parse("Hi\nOn Monday X wrote:\n> first\n> > deeper\n> back\nmine")
    assert plain == "Hi\nmine" and passages == [(1, "first"), (2, "deeper"), (1, "back")]
    assert quotes.parse("") == ("", []) and quotes.parse("no quotes\n\n\n\nhere")[0] == "no quotes\n\n\n\nhere"


def test_quote_links(spark):
    rows = [
        (1, 0, "Hello there my dear friend. How are you doing today?"), (1, 1, "Something else entirely to say here."), (1, 2, "X wrote:\n> Hello there my dear\n> friend. How are you doing today?\nI am well and happy today."),
        (1, 3, "> > Hello there my dear friend.\n> I am well and happy today.\nok then good"), (1, 4, "> Something else entirely to say here.\nyes"), (2, 0, None), (None, 1, "> Hello there my dear friend.\nx"), (2, 1, "> Hello there my dear friend.\nother conversation"), (3, 0, "dup turn words here"), (3, 0, "dup turn words here"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, text string, thread string")
    got = quotes.link(df).collect()
    assert len(got) == len(rows)
    one = sorted((r for r in got if r.conv_id == 1), key=lambda r: r.position)
    assert [(r.turn, r.reply_to, r.thread) for r in one] == [(0, None, 0), (2, 0, 0), (3, 2, 0), (1, None, 1), (4, 1, 1)]
    assert [r.clean_text for r in one][1:3] == ["I am well and happy today.", "ok then good"]
    other = next(r for r in got if r.conv_id == 2 and r.turn == 1)
    assert (other.n_quotes, other.n_linked, other.reply_to, other.position) == (1, 1, None, 2)
    assert sorted(r.position for r in got if r.conv_id == 3) == [1, 2]
    assert quotes.link(df.limit(0)).count() == 0


def brute_hits(text, items):
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        b = words(t)
        n = min(10, len(b))
        wins = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
        for k in range(len(w) - n + 1) if n else ():
            if tuple(w[k : k + n]) in wins:
                hit.update(range(k, k + n))
                ids.add(str(i))
    return len(w), len(hit), sorted(ids)


def test_decontamination(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.choice([3, 9, 10, 11, 40]))) for i in range(12)] + [(90, ""), (91, None), (92, "Ünï w1"), (0, "again " * 12)]
    texts = [prose(rng, 60) for _ in range(20)] + [prose(rng, 5) + " " + (t or "") + "! " + prose(rng, 5) for _, t in items] + ["", None, "w1", " ".join(t or "" for _, t in items)]
    texts += [texts[25].upper(), texts[25]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_hits(docs(spark, texts), bench)
    assert "Score" in found.columns and "text" not in found.columns
    for r in found.collect():
        assert (r.n_words, r.n_hit, sorted(r.items)) == brute_hits(texts[r.doc_id], items)
        assert r.contaminated == (r.n_hit > 0) and r.n_items == len(r.items)
    parts = decontaminate.find_hits(docs(spark, texts), bench, most=7)  # several scans
    assert {(r.doc_id, r.n_hit, r.n_items) for r in parts.collect()} == {(r.doc_id, r.n_hit, r.n_items) for r in found.collect()}
    kept = {r.doc_id for r in decontaminate.remove_documents(docs(spark, texts), bench).collect()}
    assert kept == {i for i, t in enumerate(texts) if not brute_hits(t, items)[1]}
    assert decontaminate.find_hits(docs(spark, texts).limit(0), bench).count() == 0
    none = decontaminate.find_hits(docs(spark, texts), bench.limit(0))
    assert none.filter("contaminated").count() == 0 and none.count() == len(texts)


CLASH = ["_id", "_FP", "_Uid", "_DROP", "_kept", "_words", "_bad_id", "_Text", "H", "len", "win", "ids", "c", "v", "label", "a.b"]


def clashing(spark, texts):
    """Documents with further columns whose names the operators use within."""
    rows = [(i, t, *(f"{c}{i}" for c in CLASH)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASH))


def test_filters_keep_columns(spark):
    """What filters keep are rows as they are, whatever their columns are called."""
    rng = random.Random(21)
    texts = [prose(rng, 40, 5000) for _ in range(6)] + ["", None]
    texts += [texts[0], texts[1].upper(), "x " + " ".join(texts[2].split()[1:])]
    df = clashing(spark, texts)
    want = {tuple(r) for r in df.collect()}
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and {tuple(r) for r in kept.collect()} == {r for r in want if r[0] < 8}
    bench = spark.createDataFrame([(1, texts[3])], "item_id long, text string")
    clean = decontaminate.remove_documents(df, bench)
    assert clean.columns == df.columns and {tuple(r) for r in clean.collect()} == {r for r in want if r[0] != 3}
    spans = decontaminate.remove_spans(df, bench).collect()
    assert {tuple(r[c] for c in df.columns) for r in spans} == want
    assert ngram_join.keep_one(df.limit(0)).count() == decontaminate.remove_documents(df.limit(0), bench).count() == 0


def test_shuffled_where_keys_are_many(spark, monkeypatch):
    """Beyond the bound of a broadcast the rows are the same."""
    from marlstone.llm import common

    rng = random.Random(22)
    texts = [prose(rng, 40, 5000) for _ in range(12)]
    texts += texts[:6] + [f"zz {t[3:]}" for t in texts[:4]]
    df = clashing(spark, texts)
    few = [{r.doc_id for r in ngram_join.keep_one(df).collect()}, sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.join(df).collect())]
    monkeypatch.setattr(common, "MOST_KEYS", 1)
    assert few == [{r.doc_id for r in ngram_join.keep_one(df).collect()}, sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.join(df).collect())]
    bench = spark.createDataFrame([(1, texts[3]), (2, texts[5])], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.remove_documents(df, bench).collect()} == {i for i, t in enumerate(texts) if not brute_hits(t, [(1, texts[3]), (2, texts[5])])[1]}


def test_ngram_join_blocks(spark, monkeypatch):
    """A bucket of many blocks gives each link once, and no more than a block's rows of either side to a comparison."""
    rng = random.Random(23)
    base = [f"w{rng.randrange(9000)}" for _ in range(150)]
    texts = []
    for k in range(90):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 4])):
            t[rng.randrange(len(t))] = f"z{k}"
        texts.append(" ".join(t))
    whole = sorted(map(tuple, ngram_join.join(docs(spark, texts)).select("doc_id", "class_id", "n_links", "n_copies").collect()))
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 8)
    monkeypatch.setattr(ngram_join, "BUCKET_ROWS", 12)
    assert sorted(map(tuple, ngram_join.join(docs(spark, texts)).select("doc_id", "class_id", "n_links", "n_copies").collect())) == whole
    sets = [frozenset(zip(*(w[i:] for i in range(5)), strict=False)) for w in map(words, texts)]
    for i, _, n, _ in whole:
        assert n == len({s for s in sets if s != sets[i] and 5 * len(s & sets[i]) >= 4 * len(s | sets[i])})


def test_decontaminated_spans(spark):
    bench = spark.createDataFrame([(1, "alpha beta, gamma")], "item_id long, text string")
    rows = decontaminate.remove_spans(docs(spark, ["Say: Alpha beta Gamma! Done.", "alpha beta", None]), bench).orderBy("doc_id").collect()
    assert [r.clean_text for r in rows] == ["Say: ! Done.", "alpha beta", None]


def test_licenses(spark):
    rng = random.Random(6)
    full = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
    texts = [prose(rng, 30), prose(rng, 20) + "\nReleased under the MIT License.", "Licensed under the Apache License, Version 2.0.\n" + prose(rng, 9) + " mit-license MIT license", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", full, full.replace("documentation", "user documentation"), "mit", "", None, "cc cc cc", "apache license apache license"]
    rows = {r.doc_id: r for r in licenses.scan(docs(spark, texts)).collect()}
    phrases = {tuple(k.split()): v for k, v in licenses.BASE.items()}
    for i, t in enumerate(texts):
        w = words(t)
        places = [(k, v) for k in range(len(w)) for p, v in phrases.items() if tuple(w[k : k + len(p)]) == p]
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({v for _, v in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert [rows[i].labels for i in (0, 4, 5, 6, 10)] == ["", "cc-by-nc", "mit", "mit", ""] and rows[5].score == 1.0
    assert licenses.scan(docs(spark, texts).limit(0)).count() == 0


def brute_labels(text):
    """Labels and best share: every template tried at every place, word by word."""
    w = words(text)
    labels, best = {v for k, v in licenses.BASE.items() if f" {k} " in f" {' '.join(w)} "}, 0.0
    score = 0.5 if labels else 0.0
    for label, t, phrase in licenses.PASSAGES:
        t, n, top = words(t), len(words(t)), 0.0
        if f" {phrase} " not in f" {' '.join(w)} ":
            continue
        for at in range(-licenses.SLACK, len(w)):
            near = w[max(0, at - licenses.SLACK) : max(0, at + n + licenses.SLACK)]
            if f" {phrase} " in f" {' '.join(near)} ":
                row = [0] * (len(near) + 1)  # longest common subsequence
                for x in t:
                    last = row
                    row = [0]
                    for k, y in enumerate(near):
                        row.append(last[k] + 1 if x == y else max(last[k + 1], row[k]))
                top = max(top, row[-1] / n)
        if top >= licenses.LEAST_SHARE:
            labels.add(label)
            best = max(best, top)
    return ",".join(sorted(labels)), best or score


def test_licenses_against_every_place(spark):
    rng = random.Random(31)
    texts = ["", None, "mit license", "no licence at all"]
    for label, t, _ in licenses.PASSAGES:
        w = t.split()
        texts.append(prose(rng, 15) + "\n" + t)
        cut = w[: int(len(w) * 0.8)]
        texts.append(" ".join(cut) + " " + prose(rng, 10) + " deal restriction software copy permission notice license version")
        if len(w) > 12:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["software", "extra", "license"]))
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w) + " " + prose(rng, 5) + " " + t)
    texts.append(" ".join(t for _, t, _ in licenses.PASSAGES))
    texts.append(f"{texts[4]} {texts[4]} {prose(rng, 20_000)}")  # a long one
    for r in licenses.scan(docs(spark, texts)).collect():
        if len(texts[r.doc_id] or "") < 8000:
            labels, best = brute_labels(texts[r.doc_id])
            # The place most agreed on is scored: stray words beyond it, which a place further on may take in, don't count.
            assert r.labels == labels and best - 0.1 <= r.score <= best + 1e-9, texts[r.doc_id]
        else:
            assert r.labels and r.score == 1.0
    grant = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
    rows = licenses.scan(docs(spark, [grant, grant + ". This is a good deal and no restriction holds."])).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == ["mit", "mit"] and rows[1].score >= rows[0].score > 0.6


def test_ngram_join(spark):
    rng = random.Random(7)
    base = prose(rng, 120, 5000).split(" ")
    texts = [" ".join(base), " ".join(base).upper(), "", None, "a b", "A, b!", "solo"]
    for k in range(30):
        t = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 6])):
            t[rng.randrange(len(t))] = f"z{k}{rng.randrange(99)}"
        texts.append(" ".join(t))
    texts += [prose(rng, 80, 5000) for _ in range(20)]
    grams = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []) for w in map(words, texts)]
    kinds = defaultdict(list)
    for i, g in enumerate(grams):
        kinds[g or i].append(i)
    links = defaultdict(set)
    for a in kinds:
        for b in kinds:
            if a != b and not isinstance(a, int) and not isinstance(b, int) and 5 * len(a & b) >= 4 * len(a | b):
                links[a].add(b)
    def group(g):
        seen, todo = {g}, [g]
        while todo:
            todo += [x for x in links[todo.pop()] if x not in seen and not seen.add(x)]
        return min(i for x in seen for i in kinds[x])
    got = ngram_join.join(docs(spark, texts)).collect()
    for r in got:
        g = grams[r.doc_id] or r.doc_id
        assert (r.class_id, r.n_links, r.n_copies) == (group(g), len(links[g]), len(kinds[g])), r.doc_id
    kept = {r.doc_id for r in ngram_join.keep_one(docs(spark, texts)).collect()}
    assert kept == {group(g or i) for i, g in enumerate(grams)}
    twice = docs(spark, ["one two three four five six"]).union(docs(spark, ["one two three four five six"]))
    assert ngram_join.keep_one(twice).count() == 1
    assert ngram_join.join(docs(spark, texts).limit(0)).count() == 0


def test_pruning_keeps_links():
    """Of pairs at the threshold, no more than a few in a hundred thousand may be dropped; far ones are dropped soon."""
    stages = ngram_join.least_matches()
    rng = np.random.default_rng(0)
    same = rng.random((20_000, ngram_join.BANDS * ngram_join.ROWS)) < 0.8
    assert all((same[:, :n].sum(1) >= m).mean() > 0.9999 for n, m in stages)
    far = rng.random((2000, ngram_join.BANDS * ngram_join.ROWS)) < 0.2
    assert (far[:, : stages[1][0]].sum(1) >= stages[1][1]).mean() < 0.05


def counted_model(tokens):
    """The model of lists of tokens, in plain counts: a function from a list to the log10 probabilities of its tokens."""
    c = Counter(w for t in tokens for w in t)
    pairs = Counter(p for t in tokens for p in zip(["<begin>", *t], t, strict=False))
    threes = Counter(x for t in tokens for x in zip(["<begin>", *t], t, t[1:], strict=False))
    after, kinds2, kinds3 = Counter(), Counter(), Counter()
    total2, total3 = Counter(), Counter()
    for (a, b), n in pairs.items():
        total2[a] += n
        kinds2[a] += 1
        after[b] += 1
    for (a, b, _), n in threes.items():
        total3[a, b] += n
        kinds3[a, b] += 1

    def logs(t):
        out = []
        for i, w in enumerate(t):
            v = t[i - 1] if i else "<begin>"
            p = (after[w] + 0.1) / (len(pairs) + 0.1 * (len(c) + 1))
            if total2[v]:
                p = max(pairs[v, w] - 0.75, 0) / total2[v] + 0.75 * kinds2[v] / total2[v] * p
            if i:
                u = t[i - 2] if i > 1 else "<begin>"
                if total3[u, v]:
                    p = max(threes[u, v, w] - 0.75, 0) / total3[u, v] + 0.75 * kinds3[u, v] / total3[u, v] * p
            out.append(math.log10(p))
        return out

    return c, logs


def test_language_model(spark, monkeypatch):
    rng = random.Random(8)
    texts = [prose(rng, 50, 30) for _ in range(40)] + ["", None, "unseen words only", "A b\x0bc  d", "the cat sat", "the cat sat", "w1 w2 unseen w3 w1 w2", "w1 w2 " * 3000]
    df = docs(spark, texts).withColumn("held", F.col("doc_id") % 5 == 0)
    tok = {i: re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(t or "")) + [None] for i, t in enumerate(texts)}
    c, logs = counted_model([tok[i] for i in tok if i % 5])
    n, v = sum(c.values()), len(c)
    first = None
    for fan_in, tokens, bytes_ in ((256, 1 << 20, 4 << 20), (2, 7, 100)):  # counts of many tasks, long texts in pieces
        monkeypatch.setattr(ngram_lm, "FAN_IN", fan_in)
        monkeypatch.setattr(ngram_lm, "MOST_TOKENS", tokens)
        monkeypatch.setattr(ngram_lm, "TEXT_BYTES", bytes_)
        rows = ngram_lm.score(df, ngram_lm.train(df.filter("not held"))).collect()
        for r in rows:
            t = tok[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
            assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
            assert abs(r.score - sum(logs(t))) <= 0.01 * len(t), texts[r.doc_id]
        assert first is None or first == pytest.approx([r.score for r in sorted(rows, key=lambda r: r.doc_id)])
        first = [r.score for r in sorted(rows, key=lambda r: r.doc_id)]
    nothing = ngram_lm.score(df, ngram_lm.train(df.limit(0))).collect()
    assert all(r.base_score == 0 and r.n_known == 0 for r in nothing)
    assert ngram_lm.score(df.limit(0), ngram_lm.train(df)).count() == 0


def test_packed_counts_and_codes():
    """Counts are packed and unpacked as they were; codes keep up to 256 values."""
    rng = np.random.default_rng(3)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 63, 500), rng.integers(0, 1 << 20, 500)]).astype(np.uint64))
    counts = rng.choice([1, 2, 254, 255, 256, 1 << 40], len(keys))
    back = ngram_lm.unpack(*ngram_lm.pack(keys, counts))
    assert (back[0] == keys).all() and (back[1] == counts).all()
    values = rng.choice(np.arange(256) / 7, 5000)
    codes, table = ngram_lm.quantised(values)
    assert np.allclose(table[codes], values)
    many = np.log10(rng.random(100_000))
    codes, table = ngram_lm.quantised(many)
    assert np.abs(table[codes] - many).max() <= (many.max() - many.min()) / 250


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 1), (1, 10**17), (5, 9), (1000, 10**4), (3000, 10**9), (500, 500), (2000, 1 << 60)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.choice(top, n, replace=False) if top < 10**6 else np.unique(rng.integers(0, top, n)))[:n].astype(np.uint64)
    ef = ngram_lm.EliasFano.of(ngram_lm.EliasFano.parts(values))
    assert (ef.access(np.arange(len(values))) == values).all()
    asked = np.unique(np.concatenate([values, rng.integers(0, top + 5, 200).astype(np.uint64)]))
    where = {int(x): i for i, x in enumerate(values)}
    assert ef.find(asked).tolist() == [where.get(int(x), -1) for x in asked]
    pointers = np.array([0, 0, 0, 3, 3, 7], np.uint64)
    assert (ngram_lm.EliasFano.of(ngram_lm.EliasFano.parts(pointers)).access(np.arange(6)) == pointers).all()


def test_topk(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.integers(-20, 20, (300, 6))
    x[50:120] = x[3]  # ties
    rows = [(i, (v / 64).tolist()) for i, v in enumerate(x)] + [(None, [0.0] * 6), (900, None), (901, [float("nan")] * 6), (902, [float("inf")] * 6), (904, [None] * 6), (905, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", topk.quantise(F.col("embedding")).alias("v"))
    monkeypatch.setattr(topk, "BLOCK", 100)
    monkeypatch.setattr(topk, "QUERIES", 5)
    got = topk.top_k(df.filter("vec_id % 20 = 0"), df, 20).collect()
    for q in range(0, 300, 20):
        want = sorted(((-int(x[q] @ x[i]), i) for i in range(300) if i != q))[:20]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    assert topk.top_k(df.filter("vec_id < 3"), df.filter("vec_id < 3"), 20).count() == 6
    assert topk.top_k(df.limit(0), df, 20).count() == 0 and topk.top_k(df.filter("vec_id < 3"), df.limit(0), 20).count() == 0


def test_topk_reads_lists(spark):
    """Where vectors differ in scale, lists are read in part and few scores are resolved; in no case is more than a sixteenth of a block resolved."""
    rng = np.random.default_rng(1)
    for x in ((rng.normal(size=(4000, 8)) * np.exp(rng.normal(size=(4000, 1)) * 1.5) * 20).astype(np.int64), rng.normal(0, 8, (4000, 64)).astype(np.int64)):
        lists = topk.Lists.of(np.arange(4000), x)
        asked = range(0, 4000, 400)
        want = {}
        for i in asked:
            scores = x @ x[i]
            want[i] = [(j, int(scores[j])) for j in np.lexsort((np.arange(4000), -scores)).tolist() if j != i][:20]
        own = [np.array([i]) for i in asked]
        bars = [want[i][9][1] if i else None for i in asked]
        for given, n in (([None] * 10, 20), (bars, 10)):
            for i, (ids, got) in zip(asked, lists.best(x[asked], 20, given, own), strict=True):
                assert list(zip(ids.tolist(), got.tolist(), strict=True))[:n] == want[i][:n]
        assert 0 < lists.read < 20 * 4000 * x.shape[1] and lists.resolved <= 20 * 4000 // topk.FEW_PART
    assert lists.read < 0.95 * 20 * 4000 * 64


def test_topk_odd_values(spark):
    """Values beyond exact floats, nought queries, repeated ids, equal vectors."""
    big = [1 << 40, -(1 << 41), 3]
    rows = [(i, [x * (i % 5) for x in big]) for i in range(60)] + [(7, big), (7, big), (80, [0, 0, 0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.top_k(df.filter("vec_id % 20 = 0"), df, 4).collect()
    for q in (0, 20, 40, 80):
        v = next(v for i, v in rows if i == q)
        want = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)[:4]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    twice = df.filter("vec_id = 7").unionByName(spark.createDataFrame([(7, [0, 0, 1])], df.schema))
    assert topk.top_k(twice, df.filter("vec_id < 3"), 2).count() == 2  # one query: of unequal vectors the smallest


def test_toxicity(spark):
    rng = random.Random(10)
    insults = ["grumblefink", "snotwarble", "dratlump"]
    def text(bad):
        parts = [prose(rng, 30, 400) for _ in range(3)]
        if bad:
            w = rng.choice(insults) + rng.choice(["", "s", "ish"])
            parts.insert(rng.randrange(4), f"{prose(rng, 3, 400)} {w} {prose(rng, 3, 400)}.")
        return " ".join(parts)
    y = [i % 4 == 0 for i in range(240)]
    texts = [text(b) for b in y]
    model = toxicity.fit(texts[:160], [int(b) for b in y[:160]])
    rows = {r.doc_id: r for r in toxicity.score(docs(spark, [*texts[160:], "", None, "You snot-warble!", "what a s n o t w a r b l e", "a snotxwarble there"]), model).collect()}
    assert "Score" not in rows[0].asDict() and "score" in rows[0].asDict()
    assert sum(rows[i].predicted == int(b) for i, b in enumerate(y[160:])) >= 78
    assert rows[80].predicted == rows[81].predicted == 0 and [rows[i].predicted for i in (82, 83, 84)] == [1, 1, 1]
    assert all(0 <= r.score <= 1 for r in rows.values())
    same = toxicity.fit(["a"], [0])
    assert 0 < toxicity.Scorer(same).scores(["x"])[0] < 0.5 and toxicity.fit([], []).logistic == ((0.0, 0.0),) * 2
    labels = spark.createDataFrame([(i, int(b)) for i, b in enumerate(y)] + [(0, 0), (None, 1), (5, None), (99999, 1)], "doc_id long, toxic int")
    got = toxicity.training_rows(docs(spark, texts), labels, most=20)
    assert Counter(b for _, b in got) == {0: 20, 1: 20} or Counter(b for _, b in got)[0] == 20
    assert toxicity.training_rows(docs(spark, texts), labels.limit(0)) == []


def plain_kernel(x, y):
    """The kernel by its definition: subsequences of three letters, the highest weight of each, the lesser of both words'."""
    def weights(w):
        out = {}
        for i in range(len(w)):
            for k in range(i + 2, min(len(w), i + toxicity.SPAN)):
                for j in range(i + 1, k):
                    t = w[i] + w[j] + w[k]
                    out[t] = max(out.get(t, 0), toxicity.DECAY ** (k - i - 2))
        return out

    def size(n):
        return math.sqrt(sum(weights("abcdefgh"[: min(max(n, 3), toxicity.LETTERS)]).values()))

    a, b = weights(x), weights(y)
    return (sum(min(a[t], b[t]) for t in a if t in b) / (size(len(x)) * size(len(y)))) ** toxicity.DEGREE


def test_toxicity_kernel():
    """The landmarks' kernel is the plain one, of whatever script, repeated and long words; it is positive semidefinite."""
    rng = random.Random(19)
    units = ["stupid", "sstupidd", "scum", "scumbag", "дурак", "馬鹿馬鹿", "aaa", "aaaaaa", "réeux", "\2réeux", "s1t2u3p", "x" * 300 + "stupid"] + ["".join(rng.choice("abcdeé1") for _ in range(rng.choice([3, 5, 9, 15]))) for _ in range(30)]
    marks = toxicity.Landmarks(units)
    got = marks.kernel(units)
    for i, x in enumerate(units):
        assert got[i].tolist() == pytest.approx([plain_kernel(x, y) for y in units], rel=1e-4, abs=1e-6)
    assert np.linalg.eigvalsh(got.astype(float)).min() > -1e-4 * np.abs(got).max()
    few = toxicity.Landmarks(units[:9]).kernel(units[9:] + ["", "zz", "😀😀😀😀"])
    assert few[0].tolist() == pytest.approx([plain_kernel(units[9], y) for y in units[:9]], rel=1e-4, abs=1e-6) and not few[-3:].any()


def test_toxicity_by_share_of_words(spark):
    """Words that clean documents have too tell by how many there are; long, repeated and empty texts."""
    rng = random.Random(20)
    def text(n, bad):
        return " ".join(rng.choice(["achlich", "achkeit"]) + rng.choice(["er", "ung", "en", "zu"]) if rng.random() < bad else f"{rng.choice(['der', 'wort', 'blau', 'mond', 'stein'])}{rng.choice(['e', 'en', 'ig', 'el'])}" for _ in range(n))
    y = [i % 5 == 0 for i in range(500)]
    texts = [text(rng.choice([40, 120, 400]), 0.05 if b else 0.002) for b in y]
    model = toxicity.fit(texts[:300], [int(b) for b in y[:300]])
    more = [text(60_000, 0.002), text(60_000, 0.05), "achlicher", "", None, texts[0], texts[0]]
    rows = {r.doc_id: r for r in toxicity.score(docs(spark, [*texts[300:], *more]), model).collect()}
    right = sum(rows[i].predicted == int(b) for i, b in enumerate(y[300:]))
    # Of toxic texts of forty words one in eight has no such word.
    assert right >= 180 and [rows[200 + i].predicted for i in (0, 1, 3, 4)] == [0, 1, 0, 0] and rows[205].score == rows[206].score


def test_toxicity_sample_of_repeated_keys(spark):
    """A key that many rows have gives one text, the shortest."""
    df = spark.range(1000).selectExpr("cast(7 as long) as doc_id", "repeat('x ', 50 + cast(id % 3 as int)) as text").unionByName(spark.createDataFrame([(8, None), (9, "fine")], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 0), (9, 0)], "doc_id long, toxic int")
    assert sorted(toxicity.training_rows(df, labels)) == [("", 0), ("fine", 0), ("x " * 50, 1)]


def test_toxicity_sample(spark):
    """Up to 3000 labelled documents, and 16 MB, of each label are learned from."""
    labels = spark.range(4000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    df = labels.selectExpr("doc_id", "concat('plain text ', doc_id) as text")
    assert Counter(b for _, b in toxicity.training_rows(df, labels)) == {0: 2000, 1: 2000}
    long = labels.filter("doc_id < 40").selectExpr("doc_id", "repeat('seven b ', 50000) as text")
    assert Counter(b for _, b in toxicity.training_rows(long, labels)) == {0: 20, 1: 20}  # 8 MB each


def test_ngram_join_rows_split_otherwise(spark, tmp_path):
    """Which rows are kept doesn't depend on how later scans split the files."""
    rng = random.Random(12)
    texts = [prose(rng, 40, 5000) for _ in range(400)]
    texts += texts[:40]
    docs(spark, texts).select("doc_id", "text").repartition(8).write.parquet(f"{tmp_path}/d")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "4k")
        rows = spark.read.parquet(f"{tmp_path}/d")
        kept = ngram_join.keep_one(rows)
        spark.conf.set(key, "128m")
        assert sorted(r.doc_id for r in kept.select("*").collect()) == list(range(400))
    finally:
        spark.conf.set(key, before)


def test_quote_links_beyond_the_smallest_conversation(spark):
    """A unit that its own conversation repeats later has its origin in another, whichever conversation comes first."""
    said = "A passage that many have quoted."
    rows = [(5, 2, f"> {said}\nyes"), (5, 3, said), (9, 0, said), (3, 1, "> Only here it is said later.\nno"), (3, 2, "Only here it is said later.")]
    got = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    assert {(r.conv_id, r.turn): r.n_linked for r in got if r.n_quotes} == {(5, 2): 1, (3, 1): 0}


def test_quote_links_of_few_words(spark):
    """Units of one to three words link to earlier messages of their own conversation, and to no other conversation."""
    rows = [(1, 0, "Are you sure?"), (1, 1, "Yes, thanks!"), (1, 2, "> Are you sure?\nI am"), (1, 3, "> yes thanks\nfine"), (1, 4, "> Nobody said this\nhm"), (2, 0, "> Are you sure?\nno")]
    got = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    assert {(r.conv_id, r.turn): (r.n_linked, r.reply_to) for r in got if r.n_quotes} == {(1, 2): (1, 0), (1, 3): (1, 1), (1, 4): (0, None), (2, 0): (0, None)}
    assert [r.turn for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.position)] == [0, 2, 1, 3, 4]


def linked(rows):
    """Links and order by plain loops over all messages: (links of passages, reply, thread start, place) of each row."""
    parsed = [quotes.parse(t or "") for _, _, t in rows]
    own = [quotes.units(plain) for plain, _ in parsed]
    n_linked, reply = [], []
    for i, (conv, turn, _) in enumerate(rows):
        found, best = set(), None
        for p, (level, passage) in enumerate(parsed[i][1]):
            for h, n in quotes.units(passage).items():
                near = [rows[j][1] for j in range(len(rows)) if rows[j][0] == conv and rows[j][1] < turn and h in own[j]]
                far = [rows[j][:2] for j in range(len(rows)) if rows[j][0] != conv and h in own[j]] if n >= quotes.LEAST_WORDS else []
                if near or far:
                    found.add(p)
                if near and level == 1:
                    best = max(best or (0, 0), (n, min(near)))
        n_linked.append(len(found))
        reply.append(best[1] if best else None)
    out = {}
    for conv in {r[0] for r in rows}:
        turns = {rows[i][1]: i for i in range(len(rows)) if rows[i][0] == conv}
        place = 0

        def walk(turn, start):
            nonlocal place
            place += 1
            i = turns[turn]
            out[conv, turn] = (n_linked[i], reply[i], start, place)
            for child in sorted(t for t, j in turns.items() if reply[j] == turn):
                walk(child, start)

        for turn in sorted(t for t, i in turns.items() if reply[i] is None):
            walk(turn, turn)
    return out


def test_quote_links_against_loops(spark):
    """Generated mails that quote earlier ones, whole or in part, nested, from their own conversation or another."""
    rng = random.Random(17)
    rows = []
    for conv in range(12):
        said = []
        for turn in range(rng.choice([1, 4, 15, 40])):
            text = ". ".join(prose(rng, rng.choice([2, 6, 12]), 3000).replace("\n", " ").replace(".", "") for _ in range(rng.choice([1, 2, 3]))) + "."
            parts = []
            for _ in range(rng.choice([0, 1, 1, 2])):
                pool = said if said and rng.random() < 0.8 else [t for _, _, t in rows] or [text]
                quoted = rng.choice(pool).split("\n")
                parts.append("\n".join((">" if x.startswith(">") else "> ") + x for x in quoted if x))
                if rng.random() < 0.5:
                    parts.append(rng.choice(["Yes, thanks!", "I see."]))
            if rng.random() < 0.5:
                parts.reverse()
            rows.append((conv, turn, "\n".join([*parts, text])))
            said.append(rows[-1][2])
    want = linked(rows)
    got = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(5)).collect()
    assert {(r.conv_id, r.turn): (r.n_linked, r.reply_to, r.thread, r.position) for r in got} == want
    assert sum(x[1] is not None for x in want.values()) > 50


def test_quote_links_long_chain(spark):
    """A conversation in which each message answers the last but one, and a message that hundreds answer."""
    said = [f"message number {i} says something new w{i}" for i in range(300)]
    rows = [(1, i, (f"> {said[i - 2]}\n" if i > 1 else "") + said[i]) for i in range(300)] + [(2, i, ("> a first word that all answer\n" if i else "a first word that all answer\n") + f"and {i}") for i in range(400)]
    got = {(r.conv_id, r.turn): (r.thread, r.position) for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert [got[1, i] for i in range(300)] == [(i % 2, i // 2 + 1 + 150 * (i % 2)) for i in range(300)]
    assert [got[2, i] for i in range(400)] == [(0, i + 1) for i in range(400)]


def test_toxicity_inserted_letters():
    """Insults with two letters put in, side by side or apart, or one in every gap, are found as the plain ones are; clean words are not."""
    rng = random.Random(13)
    insults = ["stupid", "snotwar", "dratlump"]
    texts = [prose(rng, 30, 400) + (f" {rng.choice(insults)} " if i % 4 == 0 else " ") + prose(rng, 30, 400) for i in range(200)]
    model = toxicity.fit(texts, [int(i % 4 == 0) for i in range(200)])
    filled = ["stupid", "stxuxpid", "stxxupid", "sxtxuxpxixd", "snxoxtwar", "snxxotwar", "sxnxoxtxwxaxr", "drxaxtlump", "dratxxlump", "dxrxaxtxlxuxmxp"]
    assert (toxicity.Scorer(model).scores([f"w1 {w} w2" for w in filled]) >= toxicity.CUT).all()
    assert (toxicity.Scorer(model).scores(["w1 w2", "studio", "stopped", "drastically", "snow war"]) < toxicity.CUT).all()
