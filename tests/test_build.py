import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F
from turnsieve.operators import build, select
from turnsieve.runtime import hot_join, shared_folder
from turnsieve.streaming import resumable


def test_hot_join_equals_a_plain_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else ("k%d" % (i % 7) if i % 5 else None), "same") for i in range(600)] * 2, "i int, k string, clash string")
    right = spark.createDataFrame([("hot", 1.5), ("k1", 2.5), ("k3", 3.5), ("alone", 9.0)], "k string, v double")
    want = sorted(map(str, left.join(right, "k", "left").select("i", "k", "clash", "v").collect()))
    for floor in (1, 10, 50, 10_000):
        assert sorted(map(str, hot_join(left, right, "k", floor).select("i", "k", "clash", "v").collect())) == want
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    assert sorted(map(str, hot_join(left, right, "k", 10, counts).select("i", "k", "clash", "v").collect())) == want
    assert hot_join(left.limit(0), right, "k", 1).count() == 0 and hot_join(left, right.limit(0), "k", 1).count() == left.count()


def test_places_of_updates_by_hand(spark):
    turn = lambda held: ("user", "x", held)
    rows = [
        ("a", "knowledge-update", "q?", "v", ["s0", "s1"], ["s1"], [[turn(False), turn(True)], [turn(None), turn(True), turn(True)]]),
        ("b", "single-session", "q?", "v", ["s0"], ["s0"], [[turn(True)]]), ("c", "knowledge-update", " ", "v", ["s0"], ["s0"], [[turn(True)]]),
        ("d", "knowledge-update", "q?", "v", ["s0"], ["s9"], [[turn(True)]]), ("e", "knowledge-update", "q?", None, None, None, None), ("f", "knowledge-update", "q?", "v", ["s0"], None, [[]]),
    ]
    got = build.knowledge_updates(spark.createDataFrame(rows, build.QUESTION)).collect()
    assert [tuple(r) for r in got] == [("lme_ku_a", 7, [2, 5, 6], [5], 6)]


def test_exchanges_blank_and_missing(spark):
    rows = spark.createDataFrame([("d", 0, "hi", " "), ("d", 1, None, "there"), ("d", 2, "", None)], "dialogue_id string, record_no int, user_utterance string, system_utterance string")
    assert sorted(map(tuple, build.split_exchanges(rows).collect())) == [("d", 0, "user", "hi"), ("d", 1, "system", "there")]


def test_word_label_scores_and_missing_labels(spark):
    turns = spark.createDataFrame([("d", 0, "aa bbbbb"), ("d", 1, " "), ("d", 2, None), ("d", 3, "aa bbbbb ")], "dialogue_id string, turn_id int, text string")
    cache = build.label_cache(turns, F.lit("aa 0\t\t|\t\tbbbbb 1"))
    assert {r["turn_id"]: r["score"] for r in build.label_scores(turns, cache).collect()} == {0: 0.5, 1: 0.0, 2: 0.0, 3: 0.5}
    with pytest.raises(Exception, match="missing"):
        build.label_scores(turns, cache.limit(0)).collect()
    with pytest.raises(Exception, match="neither 0 nor 1"):
        build.label_cache(turns, F.lit("aa 2")).collect()


def test_retention_conventions(spark):
    rows = [("a", "Pho and rice", "pho", "update", None, None, True), ("a", "x", "dep", "dep", None, None, True), ("b", "x", "y", "dep", None, None, True), ("c", "x", "y", "update", None, None, False), ("d", "old then new", "z", "reversal_combined", "old", "NEW", True), ("d", "old", "z", "reversal_combined", "old", "new", True)]
    pairs = spark.createDataFrame(rows, "g string, text string, answer string, qa_type string, old_value string, new_value string, requires_boundary boolean")
    got = {r["g"]: (r["n_pairs"], r["accuracy"]) for r in build.retention_accuracy(pairs, "g", True).collect()}
    assert got["a"] == (2, 1.0) and got["c"] == (0, 1.0) and got["d"] == (2, 0.5) and got["b"][0] == 1 and math.isnan(got["b"][1])


def test_judgments_are_made_once_a_pair(spark):
    rows = spark.createDataFrame([(1, "a", "a b"), (2, "a", "a b"), (3, "a", ""), (4, "c", "b"), (5, None, None)], "i int, g string, c string")
    got = {r["i"]: r["equivalent"] for r in build.expand_judgments(rows, "g", "c", lambda r, c: F.when(c != "", c.contains(r))).collect()}
    assert got == {1: True, 2: True, 3: None, 4: False, 5: None}


def test_global_numbers_and_batches(spark):
    rows = spark.createDataFrame([(i, (i * 37) % 11 + 1) for i in range(200)], "i int, n int")
    got = build.numbered(rows, ["n", "i"]).collect()
    assert [(r["n"], r["i"]) for r in sorted(got, key=lambda r: r["place"])] == sorted((r["n"], r["i"]) for r in got) and sorted(r["place"] for r in got) == list(range(200))
    assert build.numbered(rows.limit(0), ["n", "i"]).count() == 0
    batches = build.budget_batches(rows, "i", "n", 40).groupBy("part", "batch").agg(F.count("*").alias("c"), F.max("n").alias("w")).collect()
    assert sum(b["c"] for b in batches) == 200 and all(b["c"] == 1 or b["w"] * b["c"] <= 40 for b in batches)


def test_word_vectors_against_brute_force(spark):
    texts = {0: "a b b", 1: "B c", 2: None, 3: "  a "}
    turns = spark.createDataFrame([("d", i, t) for i, t in texts.items()], "dialogue_id string, turn_id int, text string")
    got = {r["turn_id"]: np.array(r["vector"]) for r in build.word_vectors(turns).collect()}
    words = {i: (t or "").lower().split() for i, t in texts.items()}
    for i in texts:
        for j in texts:
            dot = sum(words[i].count(w) * words[j].count(w) for w in {*words[i], *words[j]})
            norm = math.sqrt(sum(words[i].count(w) ** 2 for w in {*words[i]})) * math.sqrt(sum(words[j].count(w) ** 2 for w in {*words[j]}))
            assert got[i] @ got[j] == pytest.approx(dot / norm if norm else 0.0, abs=1e-6)
    assert select.mmr(build.word_vectors(turns), "dialogue_id", "turn_id", "vector", 0.5).count() == 2


def test_methods_are_checked_before_planning():
    assert build.check_methods(["recency"]) == ["recency"]
    with pytest.raises(ValueError, match="chunkkv.*nothing_known"):
        build.check_methods(["recency", "chunkkv", "nothing_known"])


def test_stream_batches_that_run_again_add_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(300)] * 2, "k bigint, text string")
    source, sink = str(tmp_path / "in"), str(tmp_path / "sink")
    rows.repartition(3).write.parquet(source)
    for marks in ("m1", "m2"):
        stream = resumable.file_stream(spark, source, rows.schema, 1)
        resumable.run_to_end(stream, lambda b: b.select("k", F.length("text").alias("n")), "k", sink, str(tmp_path / marks))
        assert sorted(r["k"] for r in spark.read.parquet(sink).collect()) == list(range(300))


def test_folders_are_refused_where_executors_cannot_read_them():
    session = lambda master, named: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=SimpleNamespace(master=master))
    assert shared_folder(session("local[4]", None), "x").startswith("file://")
    assert shared_folder(session("spark://host", "/shared/"), "x").startswith("/shared/x-")
    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_folder(session("spark://host", None), "x")
