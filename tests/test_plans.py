import json

import pytest
from pyspark.sql import functions as F

from marlstone.functions import repair
from marlstone.plans import corpus, experiment, questions


def test_corpus(spark, tmp_path):
    (tmp_path / "in/info").mkdir(parents=True)
    rows = [{"id": f"d{i}", "kind": "info", "source": "news/x", "timestamp": "2024-01-02", "payload": {"title": f"T{i}", "content": " ".join([f"w{i}"] * 1000)}} for i in range(3)]
    (tmp_path / "in/info/records.jsonl").write_text("\n".join(map(json.dumps, rows)))
    out = str(tmp_path / "out")
    stats = corpus.build(spark, str(tmp_path / "in"), out).collect()
    assert [(r.source, r.documents, r.passages) for r in sorted(stats)] == [("info/news", 3, 9), ("total", 3, 9)]
    assert not corpus.is_complete(spark, out)
    corpus.build_index(spark, out)
    assert corpus.is_complete(spark, out)
    with pytest.raises(Exception, match="already exists"):
        corpus.build_index(spark, out)
    hits = corpus.search_index(spark, out, spark.createDataFrame([(1, "w1")], "qid long, question string"))
    docs = spark.read.parquet(f"{out}/passages").withColumnRenamed("row_index", "row")
    assert {r.doc_id for r in hits.join(docs, "row").collect()} == {"d1"} and hits.count() == 3


def test_repair():
    assert repair.first_object('x {"a": "}", "b": {"c": 1}} {') == '{"a": "}", "b": {"c": 1}}' and repair.first_object("{") is None
    assert repair.code_of('{"code":"import math\\nprint(1') == "import math\nprint(1" and repair.code_of("```python\nx = 1\n```") == "x = 1" and repair.code_of("") is None
    assert repair.flex_blocks("# Strategy\n## Title\nT\n## Summary\nS\n## Content\nC\n# Case\n")["strategy"] == {"title": "T", "summary": "S", "content": "C"}
    assert repair.scrub('a ```json {"x": 1}``` market_id: 7, b;') == "a , b" and repair.truncate("a b c", 2) == "a b..." and repair.truncate("a b", 2) == "a b"


def test_repair_column(spark):
    rows = spark.createDataFrame([('a {"k": 1} b',), (None,)], "x string").select(repair.column(repair.first_object, F.col("x")).alias("y")).collect()
    assert [r.y for r in rows] == ['{"k": 1}', None]


def test_admission(spark):
    rows = [(["Yes", "No"], [1.0, 0.0], "resolved", True, "Q", "2024-01-01", "2024-02-01"), (["Yes"], [1.0], "resolved", True, "Q", "2024-01-01", "2024-02-01"), (["Yes", "No"], [0.6, 0.4], "open", True, "Q", "2024-01-01", "2024-02-01"), (["Yes", "No"], [0.97, 0.03], None, True, "Q", "2024-01-01", "2024-01-01T05:00:00Z"), (["Yes", "No"], [0.97, 0.03], None, True, "Q", "bad", "2024-01-02")]
    df = spark.createDataFrame(rows, "outcomes array<string>, prices array<double>, status string, closed boolean, question string, open_time string, resolve_time string")
    assert [r.reject_reason for r in questions.admitted(df).collect()] == [None, "not_binary", "not_resolved", "too_short", "no_time"]


def test_samples_and_selection(spark):
    markets = spark.createDataFrame([(i, "2024-02-10 00:00:00", 1.0, f"d{i % 3}", f"Question {i // 2}?") for i in range(12)], "market_id long, r string, final double, domain string, question string").withColumn("resolve_ts", F.col("r").cast("timestamp"))
    prices = spark.createDataFrame([(i, f"2024-02-0{d} 05:00:00", 0.5, d) for i in range(11) for d in (1, 3, 8)], "market_id long, t string, p double, pos long").withColumn("t", F.col("t").cast("timestamp"))
    s = questions.samples(markets, prices)
    assert {r.horizon for r in s.filter("market_id = 0").collect()} == {"7d", "1d"}  # nothing within a week of thirty days before
    assert {(r.horizon, r.p_yes) for r in s.filter("market_id = 11").collect()} == {("1d", 1.0), ("7d", 1.0)} or s.filter("market_id = 11").count() <= 2
    got = questions.select(markets.select("market_id", "domain", "question"), s, {"7d": 3, "1d": 3}, 6).collect()
    assert len(got) == 6 and {r.domain for r in got} == {"d0", "d1", "d2"} and len({r.question for r in got}) == 6


def test_runs(spark):
    qs = spark.createDataFrame([(f"m-{i}", f"q{i}", "dom", f"2024-01-0{i}T00:00:00Z", f"2024-01-0{j}T00:00:00Z", "easy", 1) for i, j in ((1, 5), (2, 4), (3, 9))], "market_id string, question string, domain string, open_time string, resolve_time string, difficulty string, label int")
    seen = []

    def model(text):
        seen.append(text.split("\n")[0])
        if "q3" in text:
            raise RuntimeError("no")
        return '```json\n{"predicted_prob": 0.8}\n```', 15

    rows = experiment.run_method(spark, qs, experiment.Direct(model)).collect()
    assert seen == ["q2", "q1", "q3"] and [r.predicted_prob for r in rows] == [0.8, 0.8, 0.5] and rows[2].error.startswith("RuntimeError") and rows[0].brier_score == pytest.approx(0.04)
    assert experiment.parse('90% sure ```json {"predicted_prob": 0.02}```')[0] == 0.02 and experiment.parse("?")[0] == 0.5


def test_memory_gates():
    used = []

    def model(text):
        used.append([x for x in ("m-1", "m-2") if x in text])
        return '{"predicted_prob": 0.9}', None

    distil = lambda q, r: [{"experience_id": q["market_id"], "domain": q["domain"], "title": q["market_id"], "summary": q["market_id"], "content": q["market_id"], "embedding": [1.0, 0.0], "source_resolved_time": q["resolved_time"], "support_count": 1, "merged_from": [q["market_id"]], "created_at": None, "source_open_time": None}]
    session = experiment.Remembering(model, lambda t: [1.0, 0.0], distil)
    for m, domain, at, end in (("m-1", "a", "2024-01-01", "2024-01-05"), ("m-2", "b", "2024-01-02", "2024-01-04"), ("m-3", "a", "2024-01-06", "2024-01-09")):
        session.run({"market_id": m, "question": "q", "domain": domain, "sample_time": at, "resolved_time": end})
    assert used == [[], [], ["m-1"]]


def test_registry(spark):
    from marlstone import registry
    from marlstone.operators import evaluate

    assert registry.method("flex") is experiment.Remembering and registry.default_mode({"bm25", "dense"}) == "dense"
    with pytest.raises(KeyError):
        registry.method("nope")
    df = spark.createDataFrame([({"7d": 0.1},), ({},), (None,)], "m map<string, double>")
    assert {(r.horizon, r.covered, r.missing) for r in evaluate.horizon_status(df, "m", ["7d", "1d"]).collect()} == {("7d", 1, 2), ("1d", 0, 3)}
    reasons = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "r string")
    assert [(r.r, r["count"]) for r in evaluate.top_reasons(reasons, "r").collect()] == [("b", 2), ("a", 1)]
