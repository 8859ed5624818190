import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from turnsieve import runtime
from turnsieve.operators import joins, nested, select, validate

TURNS = "dialogue_id string, turn_id int, speaker string, text string, belief map<string,string>, loaded_at timestamp"


@pytest.fixture(scope="module")
def turns(spark):
    rng = random.Random(1)
    rows = [(f"d{k}", i, rng.choice(["USER", "user", None, "ASSISTANT"]), rng.choice([None, "", "a b c", "x" * 20_000]), None) for k, n in enumerate((1, 2, 7, 40)) for i in range(n)]
    rows += rows[:5]
    return spark.createDataFrame([(*r, None) for r in rows], TURNS)


def test_turns_count_once_and_speakers_are_uniform(turns):
    clean = select.clean_turns(turns)
    assert clean.count() == 50
    assert {r[0] for r in clean.select("speaker").distinct().collect()} <= {"USER", "SYSTEM"}


@pytest.mark.parametrize("ratio", [0.1, 0.3, 0.5, 1.0])
def test_selectors_keep_the_budget(turns, ratio):
    clean = select.clean_turns(turns)
    sizes = {r["dialogue_id"]: r["n"] for r in clean.groupBy("dialogue_id").agg(F.count("*").alias("n")).collect()}
    kept = select.positional(clean, ratio).groupBy("method", "dialogue_id").agg(F.sort_array(F.collect_list("turn_id")).alias("ids")).collect()
    for r in kept:
        n, ids = sizes[r["dialogue_id"]], r["ids"]
        k = n if r["method"] == "full_context" else max(1, round(n * ratio))
        assert len(ids) == len(set(ids)) <= k and all(0 <= i < n for i in ids)
        if r["method"] == "recency":
            assert ids == list(range(n - k, n))
        if r["method"] == "uniform_stride":
            assert ids == (list(range(n)) if k >= n else sorted({min(n - 1, round(i * n / k)) for i in range(k)}))


def test_ranking_hot_keys_equals_a_window(spark, monkeypatch):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.xxhash64("id").alias("o"), "id")
    monkeypatch.setattr(runtime, "HOT_FLOOR", 100)
    plain = {(r["id"], r["rank"]) for r in select.ranked(rows, "k", ["o", "id"]).collect()}
    monkeypatch.setattr(select, "hot_keys", lambda df, key: runtime.hot_keys(df, key, 100))
    spread = {(r["id"], r["rank"]) for r in select.ranked(rows, "k", ["o", "id"]).collect()}
    assert plain == spread
    lag = {(r["id"], r["p"]) for r in select.lagged(rows, "k", ["o", "id"], "id", "p").collect()}
    by_rank = {}
    for i, rank in plain:
        by_rank.setdefault("hot" if i % 3 == 0 else str(i), {})[rank] = i
    want = {(i, (by_rank["hot" if i % 3 == 0 else str(i)].get(rank - 1))) for i, rank in plain}
    assert lag == want


def test_hot_join_loses_nothing(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("1", 2)], "k string, v int")
    plain = sorted(map(str, left.join(right, "k", "left").collect()))
    assert sorted(map(str, runtime.hot_join(left, right, "k", floor=10).collect())) == plain
    assert runtime.hot_keys(left, "k", 10) == ["hot"]


def test_selectors_on_empty_tables(spark):
    empty = spark.createDataFrame([], TURNS)
    clean = select.clean_turns(empty)
    assert select.positional(clean, 0.3).count() == 0
    assert select.hash_random(clean, 0.3, 1).count() == 0
    assert select.transitions(clean).count() == 0


def test_transitions_skip_blanks(spark):
    rows = [("d", i, "USER", "", {"s": v} if v is not None else None, None) for i, v in enumerate(["a", "", "a", None, "b", "b", "a"])]
    got = select.transitions(select.clean_turns(spark.createDataFrame(rows, TURNS))).orderBy("turn_id").collect()
    assert [(r["turn_id"], r["old_value"], r["new_value"]) for r in got] == [(4, "a", "b"), (6, "b", "a")]


PAYLOADS = [
    ('{"probes": [{"method": "m", "probe_type": "P1", "meta": {"s_origin": [0, null, "3", "[T4]", {"turn_id": "5"}, {"speaker": "USER"}, 1.0, true]}}]}', {("m", "P1", "s_origin", 0, 0), ("m", "P1", "s_origin", 2, 3), ("m", "P1", "s_origin", 3, 4), ("m", "P1", "s_origin", 4, 5), ("m", "P1", "s_origin", 6, 1)}),
    ('{"probes": {"m::P3": {"meta": "{\\"control_origin\\": 7}", "s_evidence": {"0": 1, "2": 9}}}}', {("m", "P3", "control_origin", 0, 7), ("m", "P3", "s_evidence", 0, 1), ("m", "P3", "s_evidence", 2, 9)}),
    ('{"groups": [{"probe_type": "P3", "probes": [{"method": "m", "meta": {"support": {"s_evidence": [2, 2]}}}]}]}', {("m", "P3", "s_evidence", 0, 2), ("m", "P3", "s_evidence", 1, 2)}),
    ('{"data": {"count": 1, "probes": [{"method": "m", "probe_type": "P1", "meta": null, "s_origin": {"turn_id": 3}}]}}', {("m", "P1", "s_origin", 0, 3)}),
    ('{"probes": [{"method": "m", "meta": {"s_origin": [1', set()),
    (None, set()),
    ("", set()),
    ("[]", set()),
]


@pytest.mark.parametrize("payload,want", PAYLOADS)
def test_references_in_every_layout(payload, want):
    assert {(p["method"], p["probe_type"], *r) for p in nested.probes_of(payload) for r in p["refs"] if r[2] is not None} == want


def test_nested_tables_keep_links(spark):
    records = spark.createDataFrame([(i, p, "x") for i, (p, _) in enumerate(PAYLOADS)], "record_id bigint, payload string, method string")
    meta = "row_id bigint, method string, probe_type string, list_name string, meta struct<" + ",".join(f"{n}:array<bigint>" for n in nested.TURN_LISTS) + ">"
    probes = spark.createDataFrame([(1, "m", "P1", "clash", ([5, None, 6], None, [], [2], None)), (2, "m", "P1", "clash", None)], meta)
    found = {tuple(r) for r in nested.turn_references(probes, records).collect()}
    own = {r[1:] for r in found if r[0] == "probes"}
    assert own == {(1, "m", "P1", "s_origin", 0, 5), (1, "m", "P1", "s_origin", 2, 6), (1, "m", "P1", "control_origin", 0, 2)}
    assert {r[1:] for r in found if r[0] != "probes"} == {(i, *w) for i, (_, ws) in enumerate(PAYLOADS) for w in ws}
    assert nested.probe_table(records).count() == 4
    assert nested.turn_references(probes.limit(0), records.limit(0)).count() == 0


def test_shared_inlining():
    edges = [("record", "probes", True), ("probes", "meta", False), ("meta", "s_origin", True), ("meta", "ratio", False), ("probes", "ratio", False), ("a", "b", False), ("b", "a", False), ("record", "a", False), ("meta", "span", False), ("s_origin", "span", False), ("span", "end", False)]
    tables = nested.shared_inlining(nested.schema_graph(edges))
    assert tables["meta"] == "probes" and tables["s_origin"] == "s_origin" and tables["a"] == "a" and tables["span"] == "span" and tables["end"] == "span" and tables["ratio"] == "probes"


def test_tables_come_from_the_mapping(spark):
    extra = '{"probes": [{"method": "m", "meta": {"n_turns": 3, "s_origin": [{"turn_id": 1, "odd": {"a": "x"}}], "new": {"deep": 7}}, "marks": [{"k": 1}, "two"]}], "s": {"p": 1}}'
    records = spark.createDataFrame([(i, p) for i, p in enumerate([*(p for p, _ in PAYLOADS), extra])], "record_id bigint, payload string")
    made = {n: [r.asDict() for r in t.collect()] for n, t in nested.nested_tables(records).items()}
    (probe,) = (r for r in made["probes"] if r["record_id"] == len(PAYLOADS))
    assert (probe["meta__new__deep"], probe["meta__n_turns"], probe["probe_no"]) == ("7", "3", 0)
    marks = sorted((r["list_pos"], r["k"], r["value"], r["probe_no"]) for r in made["marks"])
    assert marks == [(0, "1", None, 0), (1, None, '"two"', 0)]
    assert {(r["parent_table"], r["parent_no"]) for r in made["marks"]} == {("probes", probe["row_no"])}
    (entry,) = (r for r in made["s_origin"] if r["record_id"] == len(PAYLOADS))
    assert (entry["turn_id"], entry["odd__a"], entry["probe_no"]) == ("1", '"x"', 0)
    assert [r["s__p"] for r in made["record"] if r["record_id"] == len(PAYLOADS)] == ["1"]


def test_generated_tables_equal_the_walk(spark, data):
    records = spark.read.parquet(f"{data}/raw_probe_records.parquet")
    want = {(r["record_id"], no, p["method"], p["probe_type"], *ref) for r in records.collect() for no, p in enumerate(nested.probes_of(r["payload"])) for ref in p["refs"]}
    assert want and {tuple(r) for r in nested.reference_table(records).collect()} == want


@pytest.mark.parametrize("n,limits", [(5000, {}), (600, {"one_task": 200, "candidates": 40}), (300, {"one_task": 200, "candidates": 1})])
def test_mmr_is_exact_in_groups_of_every_size(spark, n, limits):
    ratio = 0.02
    rng = np.random.default_rng(n)
    v = rng.normal(size=(n, 3)).astype(np.float32)
    v[n // 2 : n // 2 + 40] = v[:40]  # equal vectors
    rows = [("g", i, x.tolist()) for i, x in enumerate(v)] + [("h", i, x.tolist()) for i, x in enumerate(v[:30])]
    df = spark.createDataFrame(rows, "g string, i int, v array<float>").repartition(5)
    got = {(r["g"], r["i"]) for r in select.mmr(df, "g", "i", "v", ratio, **limits).collect()}
    assert got == {("g", i) for i in select.mmr_order(v, int(n * ratio))} | {("h", i) for i in select.mmr_order(v[:30], 1)}


def test_violations_raise(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError, match="keys"):
        validate.demand(validate.not_unique(rows, ["k"]), "keys stand twice")
    validate.demand(validate.not_unique(rows, ["k", "v"]), "never")


def test_conflicting_cache_is_not_reused(spark):
    cache = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("b", "z"), (None, "q"), ("c", None)], "k string, v string")
    assert [tuple(r) for r in joins.reusable(cache, "k", "v").collect()] == [("b", "z", 2)]
