import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from turnsieve.functions import exact, readers, strings
from turnsieve.operators import select, stats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "text,want",
    [("3 pm", "15:00"), ("12 am", "00:00"), ("12 pm", "12:00"), ("at 9:05", "at 09:05"), ("2026", "20:26"), ("1999", "1999"), ("915", "09:15"), ("5 p.m.", "5 p m")],
)
def test_clock_rules(text, want):
    assert exact.normal_value(text) == want


def test_dotted_times_need_the_open_rule():
    assert exact.clock("5 p.m.", dotted=True) == "17:00."  # the pattern ends at a word bound; punctuation goes in a later step
    assert exact.normal_value("5 p.m.", "lme") == "17:00" and exact.normal_value("2026", "lme") == "2026"


def test_normal_value_order_of_rules():
    assert exact.normal_value(None) == ""
    assert exact.normal_value("  Ｇｒａｎｄ   Hôtel! ") == "grand hôtel"
    assert exact.normal_value("City Centre", "multiwoz") == "city center"
    assert exact.normal_value("five people", "multiwoz") == "5"


VALUES = ["", "  ", "３ pm", "12 am", "12:30 pm and 9:05", "915", "1999", "2026", "City Centre!", "Ｇｒａｎｄ ﬁsh ½", "five people", "north american", "é가", "7 p.m. or 8 a.m", "10:30 AM", "13 pm", "x" * 50_000, "2 people, at 7:15pm", "12pm12am", None]


@pytest.mark.parametrize("family", ["", "multiwoz", "lme"])
def test_normal_forms_of_the_jvm_equal_the_exact_ones(spark, family):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, v string")
    got = {r["i"]: r["n"] for r in rows.select("i", strings.normalize_value("v", family).alias("n")).collect()}
    assert got == {i: exact.normal_value(v, family) for i, v in enumerate(VALUES)}


ANSWERS = ['{"value": "a", "support": ["x", null, "y"], "abstain": false}', 'so: {"value": "b"} ok', '```json\n{"value": 0}\n```', '{"a": {"value": "c"}}', "[1]", '"text"', "null", "", None, '{"value": "\\u00e9", "abstain": true}', '{"value": true, "abstain": "no"}', "{", "}{", '{"value": 1.5}', '{"value": ["p", 1]}', '[{"value": "z"}]']


def test_fields_of_answers_by_flavour(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(ANSWERS)], "i int, v string")
    got = {r["i"]: r["f"] for r in rows.select("i", exact.json_fields()("v").alias("f")).collect()}
    for i, v in enumerate(ANSWERS):
        assert tuple(tuple(got[i][f]) for f in exact.FLAVOURS) == tuple(exact.object_fields(exact.recover_json(v, f)) for f in exact.FLAVOURS)
    pick = lambda i, f: tuple(got[i][f])[:4]
    assert pick(0, "dict") == (True, "a", "string", "x y") and pick(9, "tail")[1] == "é" and got[9]["dict"]["abstain"] and pick(13, "dict")[1:3] == ("1.5", "number")
    assert pick(3, "dict")[0] and not pick(3, "tail")[0] and not pick(15, "dict")[0] and pick(15, "tail")[1] == "z" and not got[10]["dict"]["abstain"] and got[10]["dict"]["truthy"]


@pytest.mark.parametrize("needle,hay,want", [("sf", "successfully", False), ("2", "20 rooms", False), ("2", "2 rooms", True), ("a", "aé", False), ("", "x", False), (r"a\Eb", r"x a\Eb", True)])
def test_bounded_occurrence(spark, needle, hay, want):
    assert exact.occurs(needle, hay) == want
    assert one(spark, strings.occurs_bounded(F.lit(needle), F.lit(hay))) == want


def test_null_texts_have_defined_results(spark):
    null = F.lit(None).cast("string")
    assert one(spark, strings.normalize_value(null)) == ""
    assert one(spark, strings.content_tokens(null)) == []
    assert one(spark, strings.occurs_bounded(null, F.lit("x"))) is False
    assert one(spark, strings.split_answer(F.lit("no parts"))) is None


def test_json_flavours():
    text = 'so: {"value": {"a": 1}}'
    assert exact.recover_json(text) is None
    assert exact.recover_json('{"value": {"a": 1}}') == {"value": {"a": 1}}
    assert exact.recover_json("[1, 2]", "any") == [1, 2]
    assert exact.recover_json("[1, 2]") is None
    assert exact.recover_json('x {"a": 1} y {"b": 2} z', "flat") == {"b": 2}
    assert exact.recover_json(None) is None


def test_word_labels_fail_loudly(spark):
    good = F.lit("the 0\t\t|\t\thotel 1")
    assert one(spark, strings.mean_word_label(good)) == 0.5
    with pytest.raises(Exception, match="neither 0 nor 1"):
        one(spark, strings.mean_word_label(F.lit("the 7")))


def test_context_replacement_needs_the_old_context(spark):
    assert one(spark, strings.replace_context(F.lit("abc?"), F.lit("abc"), F.lit("x"))) == "x?"
    with pytest.raises(Exception, match="does not begin"):
        one(spark, strings.replace_context(F.lit("abc?"), F.lit("zzz"), F.lit("x")))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_lcs_against_brute_force(a, b):
    def brute(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + brute(i + 1, j + 1) if a[i] == b[j] else max(brute(i + 1, j), brute(i, j + 1))

    if len(a) * len(b) < 60:
        assert exact.lcs(a, b) == brute(0, 0)
    assert exact.lcs(a, b) == exact.lcs(b, a)


def test_exact_sample_is_seeded_by_dialogue():
    a = select.sample_exact(30, 9, 42, "d1")
    assert a == select.sample_exact(30, 9, 42, "d1") and len(set(a)) == 9 and a == sorted(a)
    assert a != select.sample_exact(30, 9, 42, "d2")


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 10_000))
def test_mmr_against_a_plain_loop(n, k, seed):
    v = np.random.default_rng(seed).normal(size=(n, 3))
    q = v.mean(axis=0)
    cos = lambda a, b: a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-9)
    kept = []
    while len(kept) < min(k, n):
        scores = {i: 0.5 * cos(v[i], q) - 0.5 * (max(cos(v[i], v[j]) for j in kept) if kept else 0) for i in range(n) if i not in kept}
        best = max(scores.values())
        kept.append(next(i for i, s in scores.items() if abs(s - best) < 1e-12))
    assert select.mmr_order(v, k) == sorted(kept)


@pytest.mark.parametrize("b,c", [(64, 0), (23, 0), (76, 1), (5, 5), (0, 3), (400, 380)])
def test_mcnemar(spark, b, c):
    got = one(spark, stats.mcnemar(F.lit(b), F.lit(c)))
    assert math.isclose(got, stats.mcnemar_exact(b, c), rel_tol=1e-6, abs_tol=1e-15)


def test_bootstrap_covers_the_mean(spark):
    rows = spark.range(400).select(F.lit("m").alias("g"), F.col("id").cast("string").alias("c"), (F.col("id") % 2).alias("total"), F.lit(1).alias("n"))
    r = stats.bootstrap_ratio(rows, ["g"], "c", "total", "n", 100).first()
    assert r["lower"] < r["mean"] == 0.5 < r["upper"] and r["upper"] - r["lower"] < 0.15
    exact_draws = stats.bootstrap_exact(np.arange(400) % 2, np.ones(400), 200, 7)
    assert abs(np.quantile(exact_draws, 0.975) - r["upper"]) < 0.03


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=30), st.integers(50, 200))
def test_token_batches(lengths, budget):
    batches = readers.token_batches(lengths, budget)
    assert sorted(i for b in batches for i in b) == list(range(len(lengths)))
    assert all(max(lengths[i] for i in b) * len(b) <= budget for b in batches)


def test_readers_answer_and_fail_by_row(spark):
    rows = spark.createDataFrame([(1, "[T0] USER: at 10:30 please\n\nQuestion?"), (2, None)], "k bigint, p string")
    got = {r["k"]: r for r in readers.answer(rows, "k", "p", "extractive").collect()}
    assert '"10:30"' in got[1]["text"] and got[2]["error"] == "no-prompt"
    with pytest.raises(ValueError, match="unknown reader"):
        readers.answer(rows, "k", "p", "gpt")


def test_many_replicates_against_a_plain_loop(spark):
    rows = [("a" if i % 3 else "b", f"c{i // 2}", float(i % 2) + i / 50, 1 + i % 4) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, c string, total double, n bigint")
    got = {r["g"]: tuple(r)[1:] for r in stats.bootstrap_ratio(df, ["g"], "c", "total", "n", 5000).collect()}
    again = {r["g"]: tuple(r)[1:] for r in stats.bootstrap_ratio(df.repartition(7), ["g"], "c", "total", "n", 5000).collect()}
    assert got == again
    for g in "ab":
        own = [r for r in rows if r[0] == g]
        w = np.stack([stats.cluster_weights(r[1], 5000) for r in own])
        s, n = (w * np.array([r[k] for r in own])[:, None] for k in (2, 3))
        drawn = (s.sum(axis=0) / n.sum(axis=0))[n.sum(axis=0) > 0]
        want = (sum(r[2] for r in own) / sum(r[3] for r in own), len(own), *np.quantile(drawn, [0.025, 0.975]))
        assert got[g] == pytest.approx(want, abs=2e-6)


def test_cluster_weights_are_poisson():
    w = np.concatenate([stats.cluster_weights(f"c{i}", 10_000) for i in range(50)])
    assert len(w) == 500_000 and abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and w.max() >= 8


@pytest.mark.parametrize("name,count", [("bootstrap_methods", 10_000), ("paired_contrast", 5_000), ("seed_balanced_interval", 5_000)])
def test_registered_intervals_take_all_replicates(name, count, spark, data, monkeypatch):
    from turnsieve.plans import queries as core

    asked, plain = [], stats.bootstrap_ratio
    monkeypatch.setattr(stats, "bootstrap_ratio", lambda *a: asked.append(a[-1]) or plain(*a))
    assert all(r["lower"] <= r["mean"] <= r["upper"] for r in core.QUERIES[name](spark, data).collect()) and asked == [count]


def test_seed_balance_by_hand(spark):
    rows = [("g", 1, "a", 1), ("g", 1, "b", 0), ("g", 1, "c", 0), ("g", 1, "d", 0), ("g", 2, "a", 1)]
    got = stats.seed_balanced(spark.createDataFrame(rows, "g string, seed int, c string, strict int"), ["g"], "seed", "c", ["strict"], 200).first()
    assert got["mean"] == 0.625 and got["n_clusters"] == 4 and got["lower"] <= 0.625 <= got["upper"]


def test_judges_by_hand(spark):
    rows = [("q1", True, True), ("q1", False, None), ("q2", False, False), ("q2", True, False), ("q3", None, True)]
    sums = stats.judged_clusters(spark.createDataFrame(rows, "q string, y boolean, j boolean"), [], "q", "y", ["j"])
    got = {r["statistic"]: r["value"] for r in stats.cluster_bootstrap(sums, ["judge"], "q", ["n", "pos", "neg", "right", "tp", "tn"], {"accuracy": F.try_divide("right", "n"), "balanced": (F.try_divide("tp", "pos") + F.try_divide("tn", "neg")) / 2}, 50).collect()}
    assert got == {"accuracy": 0.5, "balanced": 0.5}


def test_consolidation_needs_every_seed(spark):
    rows = [("x", "d1", 1, 1.0), ("x", "d1", 2, 0.0), ("x", "d1", 3, 1.0), ("x", "d2", 1, 0.0), ("x", "d2", 2, 0.0), ("y", "d3", 1, 1.0), ("y", "d4", 2, 0.0), ("z", "d5", 1, 0.5)]
    got = {r["dataset"]: r for r in stats.consolidated_seeds(spark.createDataFrame(rows, "dataset string, dialogue_id string, seed int, acc double")).collect()}
    x, y, z = got["x"], got["y"], got["z"]
    assert (x["n_seeds"], x["n_dialogues"], x["mean"], x["seed_mean"], x["seed_sd"]) == (3, 1, 0.666667, 0.5, 0.5)
    assert (y["n_dialogues"], y["mean"], y["seed_mean"], y["seed_sd"]) == (0, None, 0.5, 0.707107)
    assert (z["n_dialogues"], z["mean"], z["seed_sd"]) == (1, 0.5, 0.0)
