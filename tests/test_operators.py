"""Operators on small tables: edge cases and plain Python counterparts."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.operators import chunking, metrics, planning, retrieval, state, stores, structure


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab c.\n", max_size=400), st.integers(3, 40))
def test_fixed_chunks_hold_all_words(text, limit):
    spans = chunking.fixed(text, limit)
    said = " ".join(t for t, *_ in spans).split()
    assert set(text.split()) <= set(said)
    if "\n" not in text:
        assert said == text.split()
    else:
        assert all(text[a : a + len(t)] == t for t, a, _ in spans)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=9), max_size=120), st.integers(5, 40))
def test_sliding_windows_cover_all_words_in_order(words, limit):
    text = " ".join(words)
    at = 0
    for t, a, b in chunking.sliding(text, limit, limit // 4):
        assert text[a:b] == t and a <= at + 1
        at = max(at, b)
    assert at == len(text)


def test_paragraphs_lose_nothing():
    text = "\n\n".join("p%d " % i * 20 for i in range(9))
    spans = chunking.paragraphs(text, 40)
    assert "\n\n".join(t for t, *_ in spans) == text and all(text[a : a + len(t)] == t for t, a, _ in spans)


def test_semantic_keeps_tables_whole():
    table = "a | b | c\n1 | 2 | 3\n4 | 5 | 6"
    text = "CHAPTER 1\n" + "This is a sentence. " * 200 + "\n" + table + "\nEnd of it."
    spans = chunking.semantic(text, 100)
    assert any(t == table for t, *_ in spans)
    assert all(text[a:b] == t for t, a, b in spans) and max(len(t) for t, *_ in spans) < 900


def test_code_json_notebook_html():
    assert [t.split("(")[0] for t, *_ in chunking.code("import x\ndef a():\n    return 1\n\nclass B:\n    y = 2\n")] == ["def a", "class B:\n    y = 2"]
    assert chunking.code("def broken(:\n", ".py")[0][0].startswith("def broken")
    assert [t for t, *_ in chunking.json_keys('{"a": {"b": [1, null]}, "c": true}')] == ["a.b[0]: 1\na.b[1]: None", "c: True"]
    assert chunking.json_keys("{broken") == [] and chunking.json_keys("3") == []
    cells = {"cells": [{"cell_type": "code", "source": ["def f():\n", "    return 1\n"]}, {"cell_type": "markdown", "source": "# T"}, {"cell_type": "raw", "source": "x"}]}
    assert [t for t, *_ in chunking.notebook(json.dumps(cells))] == ["def f():\n    return 1", "# T"]
    assert chunking.html("<div><h1>T</h1><p>a<b>b</b><script>no</script></div><p>c")[0][0] == "Tab\n\nT\n\nab\n\nc"


@pytest.mark.parametrize("strategy", sorted(chunking.CHUNKERS))
def test_chunkers_take_any_text(spark, strategy):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "word " * 9000, "z"), (3, "tiny", None), (None, "a b\n" * 99, "q")], "id long, text string, chunk_id string")
    out = chunking.chunks(df, "id", "text", strategy)
    assert out.columns[:3] == ["id", "chunk_id", "chunk_index"] and out.where("length(trim(text)) < 50").count() == 0
    assert chunking.chunks(df.limit(0), "id", "text", strategy).count() == 0


def test_nearest_is_exact_with_ties_groups_and_bad_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.random() for _ in range(4)], "ab"[i % 2]) for i in range(60)] + [(100, None, "a"), (101, [1.0], "a"), (102, [float("nan")] * 4, "a"), (103, [0.0] * 4, "b"), (60, [9.0] * 4, "a"), (61, [9.0] * 4, "a")]
    v = spark.createDataFrame(rows, "id long, vec array<double>, grp string")
    q = v.where("id % 20 = 0").select(F.col("id").alias("q"), F.col("vec").alias("qv"), F.col("grp").alias("qg"))
    got = {(r["q"], r["rank"]): r["id"] for r in retrieval.nearest(v, q, "id", "vec", "q", "qv", 3, "l2", F.col("grp"), F.col("qg"), dim=4).collect()}
    good = [r for r in rows if r[1] and len(r[1]) == 4 and r[1][0] == r[1][0]]
    for i, vec, g in good:
        if i % 20 == 0:
            near = sorted((round(sum((a - b) ** 2 for a, b in zip(vec, w)), 9), j) for j, w, h in good if h == g)[:3]
            assert [got[i, k + 1] for k in range(3)] == [j for _, j in near]
    assert retrieval.nearest(v.limit(0), q, "id", "vec", "q", "qv", 3, dim=4).count() == 0


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([("q", "x", 1, 0.1), ("q", "y", 2, 0.2)], "q string, id string, rank int, distance double")
    b = spark.createDataFrame([("q", "y", 1, 5.0), ("q", "z", 2, 4.0)], "q string, id string, rank int, score double")
    got = {r["id"]: (r["rank"], round(r["rrf"], 6)) for r in retrieval.fuse(a, b, "q", "id").collect()}
    assert got["y"] == (1, round(1 / 62 + 1 / 61, 6)) and got["x"][0] == 2 and got["z"][0] == 3


def test_budget_and_context(spark):
    rows = [("q", i, "x" * 10) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "q string, rank int, text string")
    sizes = lambda budget: [len(r["text"]) for r in retrieval.within_budget(df, "q", "text", budget).orderBy("rank").collect()]
    assert sizes(40) == [10] * 4 and sizes(35) == [10, 10, 10, 5] and sizes(20) == [10, 10, 10]
    assert retrieval.context(df.where("rank < 3"), "q", "text").first()["context"] == "[Context 1]\nxxxxxxxxxx\n\n[Context 2]\nxxxxxxxxxx"


def test_bm25_leaves_documents_where_they_are(spark, monkeypatch):
    words = [f"word{i}" for i in range(12)]
    docs = spark.createDataFrame([(f"d{i:03d}", " ".join(words[(i * j) % 12] for j in range(1, 2 + i % 9))) for i in range(200)], "id string, t string").repartition(5)
    q = spark.createDataFrame([(i, f"{words[i]} {words[i + 1]} {words[i]}") for i in range(10)] + [(None, "word3")], "q int, t string")
    df, stats = retrieval.postings(docs, "id", "t").groupBy("term").agg(F.count("*").alias("df")), retrieval.corpus_stats(docs, "t")
    truth = retrieval.scored(retrieval.postings(docs, "id", "t"), df, stats, retrieval.asked_terms(q, "q", "t"), 7)
    truth = {(r["query"], r["id"], r["rank"], round(r["score"], 9)) for r in truth.collect()}
    for most in (200_000, 4):  # at once, and in parts
        monkeypatch.setattr(retrieval, "ASKED_ROWS", most)
        found = retrieval.bm25(docs, q, "id", "t", "q", "t", 7)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        assert {(r["q"], r["id"], r["rank"], round(r["score"], 9)) for r in found.collect()} == truth and len(truth) > 60


@pytest.mark.parametrize("share, weights", [(400, 1 << 22), (1 << 40, 1 << 22), (400, 100), (0, 0)])
def test_bm25_of_many_blocks_equals_joined_postings(spark, monkeypatch, share, weights):
    monkeypatch.setattr(retrieval, "DENSE_SHARE", share)
    monkeypatch.setattr(retrieval, "DENSE_WEIGHTS", weights)
    draw = random.Random(5)
    words = [a + b + "x" for a in "bcdfghjklm" for b in "aeiou"]
    text = lambda n: " ".join(words[int(len(words) * draw.random() ** 2)] for _ in range(n))
    docs = spark.createDataFrame([(i, text(12)) for i in range(3000)] + [(3000 + i, "baxx bexx") for i in range(5)], "id int, text string").repartition(2)
    asked = spark.createDataFrame([(q, text(4)) for q in range(40)], "q int, query string")
    rows = lambda df: sorted((r["q"], r["rank"], r["id"], round(r["score"], 8)) for r in df.collect())
    joined = retrieval.scored(retrieval.postings(docs, "id", "text"), retrieval.postings(docs, "id", "text").groupBy("term").agg(F.count("*").alias("df")), retrieval.corpus_stats(docs, "text"), retrieval.asked_terms(asked, "q", "query"), 4)
    assert rows(retrieval.bm25(docs, asked, "id", "text", "q", "query", 4)) == rows(joined.withColumnRenamed("query", "q"))


@pytest.mark.parametrize("metric, most", [("l2", None), ("cosine", None), ("l2", 1.0)])
def test_nearest_of_many_blocks_is_exact(spark, monkeypatch, metric, most):
    monkeypatch.setattr(retrieval, "HELD_ROWS", 150)
    draw = np.random.default_rng(5)
    v = np.repeat(draw.random((150, 4)), 2, axis=0)  # each vector twice: ties
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, v array<double>").repartition(2)
    asked = spark.createDataFrame([(i, v[i * 7].tolist()) for i in range(30)], "q int, qv array<double>")
    if metric == "l2":
        d = ((v[::7][:30, None] - v[None]) ** 2).sum(2)
    else:
        n = v / np.linalg.norm(v, axis=1, keepdims=True)
        d = 1 - n[::7][:30] @ n.T
    d = np.round(np.maximum(d, 0), 9)
    best = [(q, i) for q in range(30) for i in sorted(range(300), key=lambda i: (d[q, i], i))[:5] if most is None or d[q, i] <= most]
    found = retrieval.nearest(vectors, asked, "id", "v", "q", "qv", 5, metric, dim=4, block=16, most_distance=most).orderBy("q", "rank").collect()
    assert [(r["q"], r["id"]) for r in found] == best


def test_bm25_counts_empty_documents(spark):
    docs = spark.createDataFrame([(1, "apple pie apple"), (2, "banana"), (3, ""), (4, None)], "id long, t string")
    q = spark.createDataFrame([(7, "apple apple"), (8, ""), (9, None)], "q long, t string")
    rows = retrieval.bm25(docs, q, "id", "t", "q", "t").collect()
    assert [(r["q"], r["id"]) for r in rows] == [(7, 1)]
    assert retrieval.bm25(docs.limit(0), q, "id", "t", "q", "t").count() == 0


@pytest.mark.parametrize(
    "query,kind",
    [("good morning!", "trivial"), ("what about taxes", "follow_up"), ("How do I file it", "procedural"), ("help me", "ambiguous"), ("a versus b", "comparative"), ("give an overview", "summarization"), ("explain it", "analytical"), ("capital city", "factual")],
)
def test_query_classes(spark, query, kind):
    df = spark.createDataFrame([(query,)], "q string").withColumn("query_class", planning.query_class("q"))
    assert planning.routed(df).first()["query_class"] == kind


def test_escalation_order_and_null_grounding(spark):
    df = spark.createDataFrame([("my password", True, 0.9), ("ok", False, 0.9), ("ok", None, 0.9), ("ok", True, 0.1)], "q string, g boolean, c double")
    assert [r[0] for r in df.select(planning.escalation("q", F.col("g"), F.col("c"))).collect()] == ["sensitive", "not_grounded", None, "low_confidence"]


def test_rate_limit_ignores_refused_events(spark):
    at = datetime(2025, 1, 1)
    seconds = [0, 1, 2, 3, 11, 12, 13, 14]
    df = spark.createDataFrame([("u", i, at + timedelta(seconds=s)) for i, s in enumerate(seconds)], "u string, id int, ts timestamp")
    got = {r["id"]: r["allowed"] for r in state.rate_limited(df, "u", "ts", "id", 10, 3).collect()}
    assert [got[i] for i in range(8)] == [True, True, True, False, True, True, True, False]


def test_upsert_and_latest(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, state.upserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_percentile_by_index(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)], "v double")
    assert metrics.latency_summary(df.withColumn("k", F.lit("x")), "k", "v").first()["p95"] == 19.0


def test_ranking_quality(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "q string, id string, rank int")
    relevant = spark.createDataFrame([("q", "b"), ("q", "z"), ("p", "a")], "q string, id string")
    got = {r["q"]: (r["hits"], r["recall"], r["reciprocal_rank"]) for r in metrics.ranking_quality(ranked, relevant, "q", "id", 2).collect()}
    assert got == {"q": (1, 0.5, 0.5), "p": (0, 0.0, 0.0)}


def test_a_store_of_tables_keeps_the_last_row_and_forgets_deleted_keys(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    stores.TableStore(spark, path, ["k"]).upsert(rows(("a", 1), ("b", 1), (None, 9)))
    stores.TableStore(spark, path, ["k"]).upsert(rows(("a", 2), ("c", 2)))
    stores.TableStore(spark, path, ["k"]).delete(rows(("a", 0), ("b", 0)))
    stores.TableStore(spark, path, ["k"]).upsert(rows(("b", 3)))
    store = stores.TableStore(spark, path, ["k"])
    assert sorted(map(tuple, store.load().collect())) == [("b", 3), ("c", 2)]
    assert sorted(map(tuple, store.compact(path + "2").load().collect())) == [("b", 3), ("c", 2)]


def test_the_dispatcher_has_every_strategy_and_loses_no_text(spark):
    assert set(chunking.STRATEGIES.values()) | {"semantic"} <= set(chunking.CHUNKERS)
    docs = [
        ("1", "a: 1\nb:\n  - x\n  - y\n", "n.yaml"), ("2", "question,answer,z\nq1?,a1,0\nq2?,a2,0\n", "n.csv"), ("3", "# A\n\n" + "word " * 900 + "\n\n# B\nend", "n.md"),
        ("4", "class A { int f() { return 1; } }\nint x;\nvoid g(int a) { if (a) { } }\n", "n.java"), ("5", None, "n.md"), ("6", "{broken", "n.json"), ("7", "", None),
    ]
    df = spark.createDataFrame(docs, "id string, t string, name string")
    got = {}
    for r in chunking.routed_chunks(df, "id", "t", "name", least_chars=1).orderBy("id", "chunk_index").collect():
        got.setdefault(r["id"], []).append((r["strategy"], r["text"]))
    assert [t for _, t in got["1"]] == ["a: 1", "b[0]: x\nb[1]: y"] and got["2"][0] == ("row_group", "Question: q1?\nAnswer: a1")
    assert got["3"][-1][1] == "# B\nend" and sum(t.count("word") for _, t in got["3"]) == 900
    assert [t for _, t in got["4"]] == ["class A { int f() { return 1; } }", "void g(int a) { if (a) { } }"] and not {"5", "6", "7"} & set(got)


def test_rows_of_a_hot_key_are_numbered_over_ranges(spark):
    df = spark.createDataFrame([(i, "hot" if i % 10 else f"k{i % 3}") for i in range(500)] + [(1000, None)], "o int, k string")
    got = {(r["k"], r["o"]): r["place"] for r in chunking.numbered_within(df, "o", "k", parts=8).collect()}
    for key in {k for k, _ in got}:
        assert [got[key, o] for o in sorted(o for k, o in got if k == key)] == list(range(sum(k == key for k, _ in got)))


def test_nearest_with_dealt_out_vectors_equals_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)], "id int, v array<double>")
    ask = lambda: sorted(map(tuple, retrieval.nearest(v, v.where("id < 20").withColumnsRenamed({"id": "q", "v": "qv"}), "id", "v", "q", "qv", 5, dim=4, block=16).collect()))
    found = ask()
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 0)
    assert ask() == found and len(found) == 100


def test_structure_paths_and_spans(spark):
    t = "intro\n# A\nx\n## B\ny\n# C\n" + "z" * 10
    lines = structure.lines(spark.createDataFrame([("d", t), ("n", None), ("e", "")], "i string, t string"), "i", "t")
    heads = structure.headings(lines, F.lit(True))
    paths = {tuple(r["path"]) for r in structure.heading_paths(heads).collect()}
    assert paths == {("A",), ("A", "B"), ("C",)}
    sizes = spark.createDataFrame([("d", len(t)), ("e", 0)], "id string, size long")
    spans = sorted((r["start"], r["end"], r["title"]) for r in structure.section_spans(heads, sizes).collect())
    assert spans == [(6, 12, "A"), (12, 19, "B"), (19, len(t), "C")]
