"""Scoring, aggregation, ranking and resampling queries, each with its SQL statement."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exact
from ..functions.strings import STOP_CJK, STOP_GOAL, STOP_VALUE
from ..operators import score, stats
from ..runtime import table
from .selection import DATASET, WS, bounded, nfkc, nv, nv_by


def _answers(spark, d, context=False):
    return score.answers_with_probes(table(spark, d, "reused_raw_answers"), table(spark, d, "probes"), context)


def answers_joined(spark, d):
    """Every joined answer with the fields of its object in both flavours."""
    fields = [F.col(f"{f}.{c}").alias(f"{name}_{c}") for f, name in (("j", "whole"), ("t", "tail")) for c in ("ok", "value", "kind", "support", "abstain", "truthy")]
    return _answers(spark, d).select("answer_no", "dataset", "method", "probe_type", "seed", "gold", *fields)


def score_p1(spark, d):
    return score.score_goal(_answers(spark, d)).select("answer_no", "abstain", "overlap", "strict", "loose", "f1")


def score_p2(spark, d):
    return score.score_value(_answers(spark, d)).select("answer_no", "abstain", "err", "strict", "loose", "overlap_strict", "overlap_loose")


def score_p3_whole(spark, d):
    return score.score_joint_whole(_answers(spark, d)).select("answer_no", "goal_ok", "value_strict", "value_loose", "joint_strict", "joint_loose", "f1")


def score_p3_segment(spark, d):
    return score.score_joint_segment(_answers(spark, d)).select("answer_no", "segment_parse", "goal_ok", "value_strict", "value_loose", "joint_strict", "joint_loose")


def score_lme(spark, d):
    return score.score_variants(_answers(spark, d, context=True)).select("answer_no", "abstain", "err", "strict", "loose", "gold_in_context")


def score_zh(spark, d):
    return score.score_ideographs(_answers(spark, d)).select("answer_no", "overlap", "strict", "loose", "f1")


def score_fmts(spark, d):
    return score.score_either(_answers(spark, d)).select("answer_no", "correct")


def support_in_context(spark, d):
    """Whether the quoted support stands in the context, in the flavour of the answer's scorer."""
    return score.support_in_context(_answers(spark, d, context=True)).select("answer_no", "flavour", "in_context")


def old_state_reversion(spark, d):
    """Answers that fall back to the old value, by dataset and method."""
    from ..functions.strings import normalize_by

    rows = _answers(spark, d).where("probe_type = 'P3' and t.kind = 'string' and old_value is not null")
    rows = rows.select("dataset", "method", normalize_by("old_value", "dataset").alias("o"), normalize_by("t.value", "dataset").alias("v"))
    return rows.select("dataset", "method", ((F.col("o") != "") & F.col("v").contains(F.col("o"))).cast("int").alias("b")).groupBy("dataset", "method").agg(F.count("*").alias("n"), F.sum("b").alias("n_reverted"))


def _value_scores(spark, d):
    return score.score_value(_answers(spark, d))


def agg_method_rates(spark, d):
    """Rates by dataset and method; the optional metric is the mean over rows that have it."""
    return _value_scores(spark, d).groupBy("dataset", "method").agg(F.count("*").alias("n"), F.round(F.avg("strict"), 4).alias("strict_acc"), F.round(F.avg("loose"), 4).alias("loose_acc"), F.round(F.avg(F.col("abstain").cast("int")), 4).alias("abstain_rate"), F.round(F.avg(F.when(F.col("input_tokens") > 0, F.col("input_tokens"))), 4).alias("mean_tokens"))


def _cells(spark, d):
    return _value_scores(spark, d).where("seed is not null").groupBy("dataset", "seed", "method").agg(F.count("*").alias("n"), F.avg("strict").alias("acc"))


def agg_cells(spark, d):
    return _cells(spark, d).select("dataset", "seed", "method", "n", F.round("acc", 6).alias("acc"))


def agg_seed_means(spark, d):
    """Mean of seed means with their deviation: unweighted, null deviation for one seed."""
    return _cells(spark, d).groupBy("dataset", "method").agg(F.count("*").alias("n_seeds"), F.round(F.avg("acc"), 6).alias("mean"), F.round(F.stddev_samp("acc"), 6).alias("sd"))


def agg_variable_seed(spark, d):
    """Rows by seed as an array in seed order, beside the mean of seed means."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("seed", "n"))), lambda x: x["n"])
    return _cells(spark, d).groupBy("dataset", "method").agg(F.array_join(rows.cast("array<string>"), ",").alias("n_by_seed"), F.round(F.avg("acc"), 6).alias("mean"))


def agg_loss_decomposition(spark, d):
    """Joint answers lost between whole-field and segment scoring: unparsed or across segments. Both
    scores come from one pass over the answers."""
    rows = score.score_joint_both(_answers(spark, d))
    lost = (F.col("whole_joint_strict") == 1) & (F.col("joint_strict") == 0)
    return rows.groupBy("dataset", "method").agg(
        F.count("*").alias("n"), F.sum("whole_joint_strict").alias("n_whole"), F.sum("joint_strict").alias("n_segment"), F.count_if(lost & (F.col("segment_parse") == 0)).alias("lost_unparsed"), F.count_if(lost & (F.col("segment_parse") == 1)).alias("lost_across")
    )


def agg_confusion(spark, d):
    """Strict labels against loose judgments, abstentions undecided: counts, accuracy, balanced accuracy."""
    rows = _value_scores(spark, d).select("dataset", (F.col("strict") == 1).alias("y"), F.when(F.col("abstain"), F.lit(None)).otherwise(F.col("loose") == 1).alias("p"))
    tp, fn = F.count_if(F.col("y") & F.col("p")), F.count_if(F.col("y") & ~F.col("p"))
    tn, fp = F.count_if(~F.col("y") & ~F.col("p")), F.count_if(~F.col("y") & F.col("p"))
    agg = rows.groupBy("dataset").agg(tp.alias("tp"), fn.alias("fn"), tn.alias("tn"), fp.alias("fp"), F.count_if(F.col("p").isNull()).alias("undecided"), F.count("*").alias("n"))
    rate = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)))
    return agg.select("*", F.round((F.col("tp") + F.col("tn")) / F.greatest(F.lit(1), F.col("n") - F.col("undecided")), 6).alias("accuracy"), F.round((rate("tp", "fn") + rate("tn", "fp")) / 2, 6).alias("balanced"), F.round(F.col("undecided") / F.col("n"), 6).alias("uncertain"))


def agg_subset_reports(spark, d):
    """Accuracy over overlapping subsets in one pass."""
    rows = _value_scores(spark, d)
    subsets = F.filter(F.array(F.lit("all"), F.when(F.col("strict") == 0, F.lit("not_exact")), F.when(F.col("overlap_loose") == 1, F.lit("shared_token")), F.when(~F.col("abstain"), F.lit("answered"))), lambda x: x.isNotNull())
    return rows.select(F.explode(subsets).alias("subset"), "loose").groupBy("subset").agg(F.count("*").alias("n"), F.sum("loose").alias("n_loose"), F.round(F.avg("loose"), 6).alias("loose_acc"))


def agg_agreement(spark, d):
    """Agreement of the readers of one request with their majority: sum of agreeing over all."""
    votes = _value_scores(spark, d).groupBy("id").agg(F.sum("loose").alias("yes"), F.count("*").alias("n")).where("n > 1")
    return votes.agg(F.count("*").alias("n_requests"), F.sum("n").alias("n_ratings"), F.round(F.sum(F.greatest(F.col("yes"), F.col("n") - F.col("yes"))) / F.sum("n"), 6).alias("agreement"))


def agg_included_excluded(spark, d):
    """Strict rates of probes that a length filter on the gold keeps and drops, and their gap in points."""
    rows = _value_scores(spark, d).where("gold is not null").withColumn("kept", F.length("gold") > 5)
    agg = rows.groupBy("dataset").agg(F.round(F.avg(F.when(F.col("kept"), F.col("strict"))), 6).alias("long_acc"), F.round(F.avg(F.when(~F.col("kept"), F.col("strict"))), 6).alias("short_acc"))
    return agg.select("*", F.round(100 * (F.col("long_acc") - F.col("short_acc")), 3).alias("gap_pp"))


def agg_conditions(spark, d):
    """Paired items under two selectors: flips and kept answers given the full context was right."""
    rows = _value_scores(spark, d).where("method in ('full_context', 'recency', 'first_n')").groupBy("dataset", "dialogue_id", "method").agg(F.max("strict").alias("ok"))
    wide = rows.groupBy("dataset", "dialogue_id").pivot("method", ["full_context", "recency", "first_n"]).agg(F.max("ok"))
    return wide.where("full_context is not null").groupBy("dataset").agg(
        F.count("*").alias("n"), F.count_if((F.col("full_context") == 1) & (F.col("recency") == 0)).alias("flip_recency"), F.count_if((F.col("full_context") == 1) & (F.col("recency") == 1)).alias("keep_recency"),
        F.count_if((F.col("full_context") == 1) & (F.col("first_n") == 0)).alias("flip_first"), F.count_if((F.col("full_context") == 0) & (F.col("first_n") == 1)).alias("gain_first"),
    )


def agg_coverage(spark, d):
    return table(spark, d, "probes").groupBy("method", "probe_type").agg(F.count("*").alias("n"), F.count_distinct("dialogue_id").alias("n_dialogues"), F.count_distinct("request_id").alias("n_requests"))


def agg_medians(spark, d):
    return table(spark, d, "probes").where("meta is not null").groupBy("method").agg(F.median("meta.n_turns").alias("median_turns"), F.median("meta.k_turns").alias("median_kept"), F.round(F.median("compressed_text_chars"), 3).alias("median_chars"))


def agg_last_wins(spark, d):
    """One row a dialogue and method and probe type: the last, at the place of the first."""
    return table(spark, d, "probes").groupBy("dialogue_id", "method", "probe_type").agg(F.max("row_id").alias("row_id"), F.min("row_id").alias("first_place"), F.max_by("gold", "row_id").alias("gold"))


def agg_random_consolidated(spark, d):
    """Random selector by dataset: mean over the dialogues that all seeds share, null where there is
    none, and mean and deviation of the seed means over all dialogues of each seed."""
    rows = _value_scores(spark, d).where("method = 'random_seed' and seed is not null").groupBy("dataset", "dialogue_id", "seed").agg(F.avg("strict").alias("acc"))
    return stats.consolidated_seeds(rows)


def agg_group_seed_counts(spark, d):
    from ..functions.strings import slot_group

    rows = table(spark, d, "probes").where("method = 'full_context' and slot_human is not null").select(slot_group("slot_human").alias("slot_group"), F.col("meta.sample_seed").alias("seed"))
    return rows.groupBy("slot_group").pivot("seed", [42, 43, 44, 45, 46]).count().select("slot_group", *[F.coalesce(str(s), F.lit(0)).alias(f"seed_{s}") for s in (42, 43, 44, 45, 46)])


def agg_metric_tall(spark, d):
    """Means over a tall table of metrics; which metrics there are depends on the probe."""
    rows = _value_scores(spark, d)
    metrics = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in ("strict", "loose", "err")], F.struct(F.lit("unparsed").alias("metric"), (~F.col("parsed")).cast("double").alias("v")))
    return rows.select("method", F.inline(metrics)).groupBy("method", "metric").agg(F.round(F.avg("v"), 6).alias("mean"))


def agg_model_counts(spark, d):
    return table(spark, d, "reused_raw_answers").groupBy("model", "batch_size").agg(F.count("*").alias("n"), F.count("error").alias("n_errors"))


def flatten_cells(spark, d):
    """Aggregate documents dataset -> method -> rates written as JSON and flattened again; the first
    present metric counts, also when it is 0."""
    cells = _value_scores(spark, d).groupBy("dataset", "method").agg(F.count("*").alias("n"), F.round(F.avg("strict"), 6).alias("strict"))
    docs = cells.groupBy("dataset").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("method", F.struct("n", F.col("strict").alias("strict_acc")))))).alias("doc"))
    read = F.from_json("doc", "map<string,struct<n:bigint,strict_acc:double,acc:double>>")
    return docs.select("dataset", F.explode(read).alias("method", "v")).select("dataset", "method", "v.n", F.coalesce("v.acc", "v.strict_acc").alias("strict_acc"))


def composite_key_flatten(spark, d):
    """Counts under `method::probe_type` keys, split again."""
    keys = table(spark, d, "probes").groupBy(F.concat_ws("::", "method", "probe_type").alias("k")).count()
    return keys.select(F.split("k", "::")[0].alias("method"), F.split("k", "::")[1].alias("probe_type"), F.col("count").alias("n"))


def _method_cells(spark, d):
    return _value_scores(spark, d).groupBy("dataset", "method").agg(F.round(F.avg("strict"), 12).alias("s"), F.round(F.avg("loose"), 12).alias("l"))


def rank_midrank(spark, d):
    return _method_cells(spark, d).select("dataset", "method", stats.mid_rank(F.col("s"), ["dataset"]).alias("rank"))


def spearman_methods(spark, d):
    """Rank correlation of strict and loose rates over methods, by dataset; null when degenerate."""
    r = _method_cells(spark, d).select("dataset", stats.mid_rank(F.col("s"), ["dataset"]).alias("a"), stats.mid_rank(F.col("l"), ["dataset"]).alias("b"))
    return r.groupBy("dataset").agg(F.round(F.corr("a", "b"), 5).alias("rho"))


def best_method_sets(spark, d):
    cells = _method_cells(spark, d)
    a = cells.withColumns({"ra": F.rank().over(Window.partitionBy("dataset").orderBy(F.col("s").desc())), "rb": F.rank().over(Window.partitionBy("dataset").orderBy(F.col("l").desc()))})
    best = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.col(c) == 1, F.col("method")))), ",")
    shared = F.max(((F.col("ra") == 1) & (F.col("rb") == 1)).cast("int"))
    return a.groupBy("dataset").agg(best("ra").alias("best_strict"), best("rb").alias("best_loose"), shared.alias("same_best"))


def _cluster_sums(spark, d):
    cluster = F.substring_index("dialogue_id", "__qa_", 1)
    return _value_scores(spark, d).groupBy("method", cluster.alias("cluster")).agg(F.sum("strict").alias("total"), F.count("*").alias("n"))


def bootstrap_methods(spark, d):
    """Cluster bootstrap of strict rates by method, 10,000 replicates."""
    return stats.bootstrap_ratio(_cluster_sums(spark, d), ["method"], "cluster", "total", "n", 10_000)


def paired_contrast(spark, d):
    """Full context less each selector on the same dialogue, with a cluster interval of 5,000 replicates."""
    per = _cluster_sums(spark, d).select("method", "cluster", (F.col("total") / F.col("n")).alias("acc"))
    full = per.where("method = 'full_context'").select("cluster", F.col("acc").alias("full"))
    gains = per.where("method <> 'full_context'").join(full, "cluster").select("method", "cluster", F.round(F.col("full") - F.col("acc"), 9).alias("gain"), F.lit(1).alias("one"))
    return stats.bootstrap_ratio(gains, ["method"], "cluster", "gain", "one", 5_000)


def seed_balanced_interval(spark, d):
    """Strict and loose rates in which every seed weighs the same, clusters redrawn 5,000 times."""
    rows = _value_scores(spark, d).where("seed is not null").withColumn("cluster", F.substring_index("dialogue_id", "__qa_", 1))
    return stats.seed_balanced(rows, ["dataset", "method"], "seed", "cluster", ["strict", "loose"], 5_000)


def question_cluster_bootstrap(spark, d):
    """Judges of strict correctness (loose rule, half of the tokens, any token), undecided where the reader
    abstained: accuracy and balanced accuracy with intervals over 10,000 redraws of the questions."""
    y = (F.col("strict") == 1).alias("y")
    told = lambda c, n: F.when(~F.col("abstain"), c).alias(n)
    rows = _value_scores(spark, d).select("dialogue_id", y, told(F.col("loose") == 1, "loose_rule"), told(F.col("overlap_strict") == 1, "two_tokens"), told(F.col("overlap_loose") == 1, "any_token"))
    sums = stats.judged_clusters(rows, [], "dialogue_id", "y", ["loose_rule", "two_tokens", "any_token"])
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return stats.cluster_bootstrap(sums, ["judge"], "dialogue_id", ["n", "pos", "neg", "right", "tp", "tn"], {"accuracy": rate("right", "n"), "balanced_accuracy": (rate("tp", "pos") + rate("tn", "neg")) / 2}, 10_000)


def paired_judge_gain(spark, d):
    """How much more often the loose rule agrees with strict correctness than each other judge, on the same
    redraws of the questions, 10,000 replicates."""
    ok = lambda c, n: ((F.col(c) == 1) == (F.col("strict") == 1)).cast("int").alias(n)
    rows = _value_scores(spark, d).where("not abstain").select("dialogue_id", ok("loose", "a"), ok("overlap_strict", "b"), ok("overlap_loose", "c"))
    sums = rows.groupBy("dialogue_id").agg(F.count("*").alias("n"), *[F.sum(x).alias(x) for x in "abc"])
    gain = lambda x: F.when(F.col("n") > 0, (F.col("a") - F.col(x)) / F.col("n"))
    return stats.cluster_bootstrap(sums.withColumn("all", F.lit("all")), ["all"], "dialogue_id", ["n", "a", "b", "c"], {"over_two_tokens": gain("b"), "over_any_token": gain("c")}, 10_000).drop("all")


def common_parseable(spark, d):
    """Joint scores of each selector and of the full context over the items where both answers parse."""
    rows = score.score_joint_segment(_answers(spark, d)).where("segment_parse = 1").groupBy("dataset", "dialogue_id", "seed", "method").agg(F.max("joint_strict").alias("s"), F.max("joint_loose").alias("l"))
    full = rows.where("method = 'full_context'").select("dataset", "dialogue_id", F.col("s").alias("fs"), F.col("l").alias("fl")).groupBy("dataset", "dialogue_id").agg(F.max("fs").alias("fs"), F.max("fl").alias("fl"))
    both = rows.where("method <> 'full_context'").join(full, ["dataset", "dialogue_id"])
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return both.groupBy("dataset", "method").agg(F.count("*").alias("n"), mean("fs", "full_strict"), mean("s", "selector_strict"), mean("fl", "full_loose"), mean("l", "selector_loose"))


def percentiles(spark, d):
    p = lambda q: F.round(F.percentile("compressed_text_chars", F.lit(q)), 4)
    return table(spark, d, "probes").groupBy("method").agg(p(0.025).alias("p025"), p(0.5).alias("p50"), p(0.975).alias("p975"))


def wilson_interval(spark, d):
    rows = _value_scores(spark, d).groupBy("dataset", "method").agg(F.sum("strict").alias("k"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return rows.select("dataset", "method", "k", "n", F.round(low, 6).alias("lower"), F.round(high, 6).alias("upper"))


def mcnemar_tests(spark, d):
    """Exact tests of discordant dialogues between strict and loose-only readers, by dataset."""
    rows = _value_scores(spark, d).groupBy("dataset", "dialogue_id").agg(F.max(F.when(F.col("method") == "full_context", F.col("strict"))).alias("f"), F.max(F.when(F.col("method") == "recency", F.col("strict"))).alias("r"))
    counts = rows.where("f is not null and r is not null").groupBy("dataset").agg(F.count_if((F.col("f") == 1) & (F.col("r") == 0)).alias("b"), F.count_if((F.col("f") == 0) & (F.col("r") == 1)).alias("c"))
    return counts.select("dataset", "b", "c", F.round(stats.mcnemar(F.col("b"), F.col("c")), 6).alias("p"))


def parse_mode_rates(spark, d):
    """Exact JSON recovery in its flavours beside each other, each text read once: flavour, n_ok, n_abstain."""
    fields = table(spark, d, "reused_raw_answers").select(exact.json_fields()("reader_output_text").alias("f"))
    each = F.array(*[F.struct(F.lit(f).alias("flavour"), F.col(f"f.{f}.ok").alias("ok"), F.col(f"f.{f}.abstain").alias("abstain")) for f in exact.FLAVOURS])
    return fields.select(F.inline(each)).groupBy("flavour").agg(F.count_if("ok").alias("n_ok"), F.count_if("abstain").alias("n_abstain"))


def normalize_exact(spark, d):
    """Exact normal forms of the distinct values of all three value columns, by field."""
    fields = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in ("old_value", "new_value", "gold")])
    values = table(spark, d, "probes").select(F.inline(fields)).where("value is not null").distinct()
    return values.select("field_name", "value", exact.normal_values("multiwoz")("value").alias("norm"))


_ALL = (
    answers_joined, score_p1, score_p2, score_p3_whole, score_p3_segment, score_lme, score_zh, score_fmts, support_in_context, old_state_reversion, agg_method_rates, agg_cells, agg_seed_means, agg_variable_seed, agg_loss_decomposition,
    agg_confusion, agg_subset_reports, agg_agreement, agg_included_excluded, agg_conditions, agg_coverage, agg_medians, agg_last_wins, agg_random_consolidated, agg_group_seed_counts, agg_metric_tall, agg_model_counts, flatten_cells,
    composite_key_flatten, rank_midrank, spearman_methods, best_method_sets, bootstrap_methods, paired_contrast, seed_balanced_interval, question_cluster_bootstrap, paired_judge_gain, common_parseable, percentiles, wilson_interval, mcnemar_tests, parse_mode_rates, normalize_exact,
)
QUERIES = {f.__name__: f for f in _ALL}


def _in(words) -> str:
    return "(" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def toks(x: str, stop) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({x},'')),'[a-z0-9]+'), lambda w: length(w) >= 2 and w not in {_in(stop)}))"


def nt(x: str) -> str:
    ws = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    return f"trim(regexp_replace(lower({x}),'{ws}',' ','g'))"


def common(a: str, b: str) -> str:
    return f"len(list_intersect({a},{b}))"


def f1(g: str, p: str) -> str:
    return f"case when len({g}) > 0 and len({p}) > 0 then round(2.0::double * {common(g, p)} / (len({g}) + len({p})), 6) else 0 end"


def _object(name: str, source: str) -> str:
    """Fields of a JSON object in a column, as `functions.exact.object_fields` gives them."""
    kind = f"coalesce(json_type({source}, '$.value'), 'NULL')"
    kinds = f"case when {source} is null then null when {kind} = 'NULL' then 'null' when {kind} = 'VARCHAR' then 'string' when {kind} = 'BOOLEAN' then 'bool' when {kind} in ('ARRAY', 'OBJECT') then 'other' else 'number' end"
    said = f"json_extract_string({source}, '$.value')"
    value = f"case when {source} is null then null when {kind} = 'NULL' then '' when {kind} = 'BOOLEAN' then case when {said} = 'true' then 'True' else '' end when {kind} not in ('VARCHAR', 'ARRAY', 'OBJECT') and {said}::double = 0 then '' else {said} end"
    support = f"case when {source} is null then null when json_type({source}, '$.support') = 'VARCHAR' then json_extract_string({source}, '$.support') when json_type({source}, '$.support') = 'ARRAY' then array_to_string(list_filter(json_extract_string({source}, '$.support[*]'), lambda z: z <> ''), ' ') else '' end"
    told = f"json_type({source}, '$.abstain')"
    truthy = f"coalesce(case when {told} = 'BOOLEAN' then json_extract_string({source}, '$.abstain') = 'true' when {told} = 'NULL' then false when {told} = 'VARCHAR' then json_extract_string({source}, '$.abstain') <> '' else json_extract_string({source}, '$.abstain') not in ('0', '0.0', '[]', '{{}}') end, false)"
    return f"{source} is not null {name}_ok, {value} {name}_value, {kinds} {name}_kind, {support} {name}_support, coalesce({told} = 'BOOLEAN' and json_extract_string({source}, '$.abstain') = 'true', false) {name}_abstain, {truthy} {name}_truthy"


_FIRST = lambda *cs: "coalesce(" + ", ".join(f"nullif({c}, '')" for c in cs) + ")"
_FIELDS = f"""p as (select request_id as pid, {DATASET.format('dataset')} dataset, domain, dialogue_id, method, probe_type, meta.sample_seed seed, slot_human, old_value, new_value, gold, gold_story_label, gold_value, {_FIRST('gold_value', 'gold', 'new_value')} value_gold, {_FIRST('compressed_text_used', 'prompt_user')} as context, compressed_text_used compressed from (select *, row_number() over (partition by request_id order by row_id desc) rn from probes where request_id is not null) where rn = 1),
 r as (select answer_no, id, model, source, error, input_tokens, regexp_replace(coalesce(reader_output_text,''), '^\\s+|\\s+$', '', 'g') x from reused_raw_answers where id is not null),
 r1 as (select *, regexp_extract(x, '(?s)(\\{{[^{{]*\\}})[^{{}}]*$', 1) y from r), r2 as (select *, case when json_valid(x) then x end w, case when json_valid(y) then y end y1 from r1),
 r3 as (select *, case when w is not null then case when json_type(w) = 'OBJECT' then w end when json_type(y1) = 'OBJECT' then y1 end j, case when json_type(y1) = 'OBJECT' then y1 end t from r2),
 r4 as (select answer_no, id, model, source, error, input_tokens, {_object('j', 'j')}, {_object('t', 't')} from r3),
 a as materialized (select p.*, r4.* from r4 join p on r4.id = p.pid),
 g as (select *, case when j_ok and not j_abstain then coalesce(j_value, '') else '' end pred, not j_ok or j_abstain or coalesce(j_value, '') = '' abstain, j_ok parsed from a)"""
_V0 = f"v0 as materialized (select *, coalesce(error, '') <> '' er, t_ok parsed, case when t_kind = 'string' then t_value end as value, {nv_by('value_gold')} ng, {toks('value_gold', STOP_VALUE)} gt from a where probe_type = 'P3'), v1 as materialized (select *, not er and (t_truthy or coalesce(lower(trim(value)) in ('', 'unknown', 'n/a', 'none'), false)) abstain, {nv_by('value')} np, {toks('value', STOP_VALUE)} pt from v0)"
_V = f"{_V0}, v as materialized (select *, er::int err, (not er and not abstain and ng <> '' and np <> '' and ng = np)::int strict, (not er and not abstain and {bounded('ng', 'np')})::int loose, (not er and not abstain and {common('gt', 'pt')} >= 2 and len(gt) >= 2)::int overlap_strict, (not er and not abstain and {common('gt', 'pt')} >= 1)::int overlap_loose from v1)"
BASE = f"with {_FIELDS}"
VALUES = f"{BASE}, {_V}"
_C = f"{VALUES}, cells as (select dataset, seed, method, count(*) n, avg(strict) acc from v where seed is not null group by 1, 2, 3)"
_J = f"j0 as (select *, {toks('gold_story_label', STOP_GOAL)} gt, {toks('gold_value', STOP_GOAL)} vt, {toks('pred', STOP_GOAL)} pt, {nt(chr(99) + 'oalesce(gold_value,' + chr(39) * 2 + ')')} gv, {nt('pred')} pn from g where probe_type = 'P1_LATE')"
_JW = f"{_J}, jw as (select *, {common('gt', 'pt')} >= 1 goal, {bounded('gv', 'pn')} st, ({bounded('gv', 'pn')} or (len(vt) > 0 and {common('vt', 'pt')} >= greatest(1, len(vt) // 2))) lo from j0)"
_SEG = r"""s0 as (select *, length(pred) - length(replace(pred, ';', '')) = 1 one, trim(split_part(pred, ';', 1)) sg, case when contains(pred, ';') then substr(pred, instr(pred, ';') + 1) else pred end rest from j0),
 s1 as (select *, trim(substr(rest, 1, instr(rest, ':') - 1)) ss, trim(substr(rest, instr(rest, ':') + 1)) sv from s0), s2 as (select *, (one and instr(rest, ':') > 0 and sg <> '' and ss <> '' and sv <> '') ok from s1)"""
_JS = f"{_J}, {_SEG}, js as (select *, ok and {common('gt', toks('sg', STOP_GOAL))} >= 1 goal, ok and {bounded('gv', nt('sv'))} st, ok and ({bounded('gv', nt('sv'))} or (len(vt) > 0 and {common('vt', toks('sv', STOP_GOAL))} >= greatest(1, len(vt) // 2))) lo from s2)"
_CJK = lambda x: f"list_distinct(regexp_extract_all(lower({nfkc(chr(99) + 'oalesce(' + x + ',' + chr(39) * 2 + ')')}),'[\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{F900}}-\\x{{FAFF}}]') || {toks(nfkc(chr(99) + 'oalesce(' + x + ',' + chr(39) * 2 + ')'), STOP_CJK)})"
_M = f"{VALUES}, m as (select dataset, method, round(avg(strict), 12) s, round(avg(loose), 12) l from v group by 1, 2)"
_MID = "rank() over (partition by dataset order by {0} desc) + (count(*) over (partition by dataset, {0}) - 1) / 2.0::double"
_DRAW = "(" + " + ".join(f"(u >= {p}::double)::int" for p in stats.POISSON) + ")"


def _weights(clusters: str, replicates: int) -> str:
    """Weights of the clusters of a table s in all replicates; a hash gives eight of them."""
    u = "('0x' || substr(h, 1 + 8 * k, 8))::bigint / 4294967296.0::double"
    return f"wh as (select {clusters} c, b, sha256(b || '|' || {clusters}) h from (select distinct {clusters} from s), range(0, {-(-replicates // 8)}) t(b)), w0 as (select c, b * 8 + k rep, {u} u from wh, range(0, 8) t(k)), w as (select c, rep, {_DRAW} w from w0 where rep < {replicates})"


def _boot(replicates: int, by: str = "method", n: str = "n", cluster: str = "cluster") -> str:
    return f"{_weights(cluster, replicates)}, q as (select {by}, rep, sum(w * total) / sum(w * {n})::double stat from s join w on s.{cluster} = w.c where w > 0 group by all), iv as (select {by}, round(quantile_cont(stat, 0.025), 6) + 0.0::double lower, round(quantile_cont(stat, 0.975), 6) + 0.0::double upper from q group by all), mm as (select {by}, round(sum(total) / sum({n})::double, 6) + 0.0::double mean, count(*) n_clusters from s group by all) select {by}, mean, n_clusters, lower, upper from mm join iv using ({by})"


_SUMS = f"{VALUES}, s as (select method, split_part(dialogue_id, '__qa_', 1) as cluster, sum(strict) total, count(*) n from v group by 1, 2)"
_LV = f"""l0 as (select *, coalesce(error, '') <> '' er, case when j_kind in ('string', 'number') then j_value end said, trim(coalesce(value_gold,'')) gd from a where dataset = 'lme_ku' and probe_type = 'P3'),
 l1 as (select *, {nv('said', 'lme')} np, j_truthy or j_kind is null or j_kind = 'null' or (j_kind = 'string' and lower(trim(j_value)) in ('', 'unknown', 'n/a', 'none')) abstain, list_distinct([gd] || list_filter(list_transform(regexp_extract_all(gd, '(?i)\\((?:or\\s+)?([^()]*)\\)', 1), lambda z: trim(z, ' .,;')) || [trim(regexp_replace(gd, '\\([^()]*\\)', ' ', 'g'), ' .,;')], lambda z: z <> '')) vars from l0),
 l2 as (select answer_no, er, abstain, np, gd, context, unnest(vars) vr from l1), l3 as (select *, {nv('vr', 'lme')} nvr, {nv('context', 'lme')} nc, regexp_extract_all(np, '\\d+(?:\\.\\d+)?') pn from l2),
 l4 as (select answer_no, any_value(er) er, any_value(abstain) abstain, any_value(np) np, any_value(gd) gd, bool_or(nvr <> '' and (nvr = np or {bounded('nvr', 'np')} or (not regexp_matches(np, '[a-z]') and len(pn) > 0 and pn = regexp_extract_all(nvr, '\\d+(?:\\.\\d+)?')))) hit, bool_or({bounded('nvr', 'nc')}) inc from l3 group by 1),
 l5 as (select *, not er and not abstain and np <> '' ok, {toks(nv('gd', 'lme'), STOP_VALUE)} gt, {toks('np', STOP_VALUE)} pt from l4)"""
_BLANKS = lambda x: f"trim(regexp_replace(lower({nfkc(x)}), '[{WS}]+', ' ', 'g'))"
_SUPPORT = f"""q as (select *, case when probe_type = 'P3' and dataset = 'lme_ku' then 'bounded' when probe_type = 'P3' then 'value' when probe_type = 'P1' and dataset = 'risawoz' then 'compatible' else 'plain' end flavour, coalesce(t_support, '') ts, coalesce(j_support, '') js, coalesce(context, '') cx, coalesce(compressed, '') cp from a),
 q1 as (select answer_no, flavour, case flavour when 'value' then {nv_by('ts')} when 'bounded' then {nv('js', 'lme')} when 'compatible' then {_BLANKS('js')} else {nt('js')} end s, case flavour when 'value' then {nv_by('cx')} when 'bounded' then {nv('cx', 'lme')} when 'compatible' then {_BLANKS('cp')} else {nt('cx')} end c from q)"""

ORACLE = {
    "answers_joined": f"{BASE} select answer_no, dataset, method, probe_type, seed, gold, " + ", ".join(f"{f}_{c} {n}_{c}" for f, n in (("j", "whole"), ("t", "tail")) for c in ("ok", "value", "kind", "support", "abstain", "truthy")) + " from a",
    "score_p1": f"{BASE}, q as (select answer_no, abstain, {toks('gold', STOP_GOAL)} gt, {toks('pred', STOP_GOAL)} pt from g where probe_type = 'P1') select answer_no, abstain, {common('gt', 'pt')} overlap, ({common('gt', 'pt')} >= 2)::int strict, ({common('gt', 'pt')} >= 1)::int loose, {f1('gt', 'pt')} f1 from q",
    "score_p2": f"{VALUES} select answer_no, abstain, err, strict, loose, overlap_strict, overlap_loose from v",
    "score_p3_whole": f"{BASE}, {_JW} select answer_no, goal::int goal_ok, st::int value_strict, lo::int value_loose, (goal and st)::int joint_strict, (goal and lo)::int joint_loose, {f1('list_distinct(gt || vt)', 'pt')} f1 from jw",
    "score_p3_segment": f"{BASE}, {_JS} select answer_no, ok::int segment_parse, goal::int goal_ok, st::int value_strict, lo::int value_loose, (goal and st)::int joint_strict, (goal and lo)::int joint_loose from js",
    "score_lme": f"{BASE}, {_LV} select answer_no, abstain, er::int err, (ok and hit)::int strict, (ok and (hit or (len(gt) > 0 and len(pt) > 0 and {common('gt', 'pt')} >= ceil(len(gt) / 2.0))))::int loose, inc::int gold_in_context from l5",
    "score_zh": f"{BASE}, q as (select answer_no, abstain, {_CJK('gold')} gt, {_CJK('pred')} pt from g where dataset = 'risawoz' and probe_type = 'P1') select answer_no, {common('gt', 'pt')} overlap, (not abstain and {common('gt', 'pt')} >= 2)::int strict, (not abstain and {common('gt', 'pt')} >= 1)::int loose, {f1('gt', 'pt')} f1 from q",
    "score_fmts": f"{BASE}, q as (select answer_no, lower(coalesce(j_value,'')) p, trim(lower(coalesce(gold,''))) gg, trim(lower(coalesce(old_value,''))) o from a where dataset = 'fmts') select answer_no, (gg <> '' and case when o <> '' and o <> gg and contains(gg, o) then contains(p, o) and len(list_filter(regexp_extract_all(gg, '[\\p{{L}}\\p{{M}}\\p{{Nd}}_]+'), lambda w: length(w) > 3 and contains(p, w))) > 0 else contains(p, gg) or contains(gg, p) end)::int correct from q",
    "support_in_context": f"{BASE}, {_SUPPORT} select answer_no, flavour, (s <> '' and case when flavour = 'bounded' then {bounded('s', 'c')} else contains(c, s) end)::int in_context from q1",
    "old_state_reversion": f"{BASE}, q as (select dataset, method, {nv_by('old_value')} o, {nv_by('t_value')} v from a where probe_type = 'P3' and t_kind = 'string' and old_value is not null) select dataset, method, count(*) n, sum((o <> '' and contains(v, o))::int)::bigint n_reverted from q group by 1, 2",
    "agg_method_rates": f"{VALUES} select dataset, method, count(*) n, round(avg(strict), 4) strict_acc, round(avg(loose), 4) loose_acc, round(avg(abstain::int), 4) abstain_rate, round(avg(case when input_tokens > 0 then input_tokens end), 4) mean_tokens from v group by 1, 2",
    "agg_cells": f"{_C} select dataset, seed, method, n, round(acc, 6) acc from cells",
    "agg_seed_means": f"{_C} select dataset, method, count(*) n_seeds, round(avg(acc), 6) mean, round(stddev_samp(acc), 6) sd from cells group by 1, 2",
    "agg_variable_seed": f"{_C} select dataset, method, string_agg(n::varchar, ',' order by seed) n_by_seed, round(avg(acc), 6) mean from cells group by 1, 2",
    "agg_loss_decomposition": f"{BASE}, {_JW}, {_SEG}, js as (select answer_no, ok, ok and {common('gt', toks('sg', STOP_GOAL))} >= 1 and {bounded('gv', nt('sv'))} seg from s2) select dataset, method, count(*) n, sum((goal and st)::int)::bigint n_whole, sum(seg::int)::bigint n_segment, count(*) filter (where goal and st and not seg and not ok) lost_unparsed, count(*) filter (where goal and st and not seg and ok) lost_across from jw join js using (answer_no) group by 1, 2",
    "agg_confusion": f"{VALUES}, q as (select dataset, strict = 1 y, case when not abstain then loose = 1 end p from v), c as (select dataset, count(*) filter (where y and p) tp, count(*) filter (where y and not p) fn, count(*) filter (where not y and not p) tn, count(*) filter (where not y and p) fp, count(*) filter (where p is null) undecided, count(*) n from q group by 1) select *, round((tp + tn) / greatest(1, n - undecided)::double, 6) accuracy, round((case when tp + fn > 0 then tp / (tp + fn)::double end + case when tn + fp > 0 then tn / (tn + fp)::double end) / 2, 6) balanced, round(undecided / n::double, 6) uncertain from c",
    "agg_subset_reports": f"{VALUES}, q as (select unnest(list_filter(['all', case when strict = 0 then 'not_exact' end, case when overlap_loose = 1 then 'shared_token' end, case when not abstain then 'answered' end], lambda z: z is not null)) subset, loose from v) select subset, count(*) n, sum(loose)::bigint n_loose, round(avg(loose), 6) loose_acc from q group by 1",
    "agg_agreement": f"{VALUES}, q as (select id, sum(loose) yes, count(*) n from v group by 1 having count(*) > 1) select count(*) n_requests, sum(n)::bigint n_ratings, round(sum(greatest(yes, n - yes)) / sum(n)::double, 6) agreement from q",
    "agg_included_excluded": f"{VALUES}, q as (select dataset, round(avg(case when length(gold) > 5 then strict end), 6) long_acc, round(avg(case when length(gold) <= 5 then strict end), 6) short_acc from v where gold is not null group by 1) select *, round(100 * (long_acc - short_acc), 3) gap_pp from q",
    "agg_conditions": f"{VALUES}, q as (select dataset, dialogue_id, max(strict) filter (where method = 'full_context') f, max(strict) filter (where method = 'recency') r, max(strict) filter (where method = 'first_n') s from v where method in ('full_context', 'recency', 'first_n') group by 1, 2) select dataset, count(*) n, count(*) filter (where f = 1 and r = 0) flip_recency, count(*) filter (where f = 1 and r = 1) keep_recency, count(*) filter (where f = 1 and s = 0) flip_first, count(*) filter (where f = 0 and s = 1) gain_first from q where f is not null group by 1",
    "agg_coverage": "select method, probe_type, count(*) n, count(distinct dialogue_id) n_dialogues, count(distinct request_id) n_requests from probes group by 1, 2",
    "agg_medians": "select method, median(meta.n_turns) median_turns, median(meta.k_turns) median_kept, round(median(compressed_text_chars), 3) median_chars from probes where meta is not null group by 1",
    "agg_last_wins": "select dialogue_id, method, probe_type, max(row_id) as row_id, min(row_id) as first_place, (array_agg(gold order by row_id desc))[1] as gold from probes group by 1, 2, 3",
    "agg_random_consolidated": f"{VALUES}, q as (select dataset, dialogue_id, seed, avg(strict) acc from v where method = 'random_seed' and seed is not null group by 1, 2, 3), sm as (select dataset, seed, avg(acc) m from q group by 1, 2), z as (select dataset, count(*) n_seeds, round(avg(m), 6) seed_mean, round(coalesce(stddev_samp(m), 0), 6) seed_sd from sm group by 1), w as (select dataset, dialogue_id, count(*) have, avg(acc) mean from q group by 1, 2) select dataset, n_seeds, seed_mean, seed_sd, count(*) filter (where have = n_seeds) n_dialogues, round(avg(mean) filter (where have = n_seeds), 6) mean from w join z using (dataset) group by 1, 2, 3, 4",
    "agg_metric_tall": f"{VALUES}, q as (select method, unnest([{{'m':'strict','v':strict::double}}, {{'m':'loose','v':loose::double}}, {{'m':'err','v':err::double}}, {{'m':'unparsed','v':(not parsed)::int::double}}]) e from v) select method, e.m as metric, round(avg(e.v), 6) mean from q group by 1, 2",
    "agg_model_counts": "select model, batch_size, count(*) n, count(error) n_errors from reused_raw_answers group by 1, 2",
    "flatten_cells": f"{VALUES} select dataset, method, count(*) n, round(avg(strict), 6) strict_acc from v group by 1, 2",
    "composite_key_flatten": "select method, probe_type, count(*) n from probes group by 1, 2",
    "rank_midrank": f"{_M} select dataset, method, {_MID.format('s')} as rank from m",
    "spearman_methods": f"{_M}, q as (select dataset, {_MID.format('s')} a, {_MID.format('l')} b from m) select dataset, case when stddev_samp(a) > 0 and stddev_samp(b) > 0 then round(corr(a, b), 5) end rho from q group by 1",
    "best_method_sets": f"{_M}, q as (select *, rank() over (partition by dataset order by s desc) ra, rank() over (partition by dataset order by l desc) rb from m) select dataset, string_agg(method, ',' order by method) filter (where ra = 1) best_strict, string_agg(method, ',' order by method) filter (where rb = 1) best_loose, max((ra = 1 and rb = 1)::int) same_best from q group by 1",
    "bootstrap_methods": f"{_SUMS}, {_boot(10_000)}",
    "paired_contrast": f"{VALUES}, per as (select method, split_part(dialogue_id, '__qa_', 1) as cluster, sum(strict) / count(*)::double acc from v group by 1, 2), s as (select x.method, x.cluster, round(y.acc - x.acc, 9) total, 1 n from per x join (select * from per where method = 'full_context') y on x.cluster = y.cluster where x.method <> 'full_context'), {_boot(5_000)}",
    "seed_balanced_interval": f"{VALUES}, tl as (select dataset, method, seed, split_part(dialogue_id, '__qa_', 1) as cluster, unnest([{{'metric': 'strict', 'v': strict}}, {{'metric': 'loose', 'v': loose}}], recursive := true) from v where seed is not null), ce as (select dataset, method, metric, seed, cluster, sum(v) v, count(*) n from tl group by all), z as (select dataset, method, metric, seed, sum(n) o from ce group by all), s as (select dataset, method, metric, cluster, round(sum(v / o::double), 12) total, round(sum(n / o::double), 12) n from ce join z using (dataset, method, metric, seed) group by all), {_boot(5_000, 'dataset, method, metric')}",
    "question_cluster_bootstrap": f"{VALUES}, tl as (select dialogue_id, strict = 1 y, not abstain told, unnest([{{'judge': 'loose_rule', 'p': loose = 1}}, {{'judge': 'two_tokens', 'p': overlap_strict = 1}}, {{'judge': 'any_token', 'p': overlap_loose = 1}}], recursive := true) from v), s as (select judge, dialogue_id, count(*) n, count(*) filter (where y) pos, count(*) filter (where not y) neg, count(*) filter (where told and p = y) rgt, count(*) filter (where told and p and y) tp, count(*) filter (where told and not p and not y) tn from tl group by 1, 2), {_weights('dialogue_id', 10_000)}, q as (select judge, rep, sum(w * n) n, sum(w * pos) pos, sum(w * neg) neg, sum(w * rgt) rgt, sum(w * tp) tp, sum(w * tn) tn from s join w on s.dialogue_id = w.c group by 1, 2 union all select judge, -1, sum(n), sum(pos), sum(neg), sum(rgt), sum(tp), sum(tn) from s group by 1), st as (select judge, rep, unnest([{{'statistic': 'accuracy', 'x': case when n > 0 then rgt / n::double end}}, {{'statistic': 'balanced_accuracy', 'x': case when pos > 0 and neg > 0 then (tp / pos::double + tn / neg::double) / 2 end}}], recursive := true) from q) select judge, statistic, round(max(x) filter (where rep < 0), 6) as value, round(quantile_cont(x, 0.025) filter (where rep >= 0), 6) lower, round(quantile_cont(x, 0.975) filter (where rep >= 0), 6) upper from st group by 1, 2",
    "paired_judge_gain": f"{VALUES}, s as (select dialogue_id, count(*) n, sum(((loose = 1) = (strict = 1))::int) a, sum(((overlap_strict = 1) = (strict = 1))::int) b, sum(((overlap_loose = 1) = (strict = 1))::int) c from v where not abstain group by 1), {_weights('dialogue_id', 10_000).replace(' c, b, ', ' cl, b, ', 1).replace('select c, b * 8', 'select cl, b * 8').replace('select c, rep', 'select cl, rep')}, q as (select rep, sum(w * n) n, sum(w * a) a, sum(w * b) b, sum(w * c) c from s join w on s.dialogue_id = w.cl group by 1 union all select -1, sum(n), sum(a), sum(b), sum(c) from s), st as (select rep, unnest([{{'statistic': 'over_two_tokens', 'x': case when n > 0 then (a - b) / n::double end}}, {{'statistic': 'over_any_token', 'x': case when n > 0 then (a - c) / n::double end}}], recursive := true) from q) select statistic, round(max(x) filter (where rep < 0), 6) as value, round(quantile_cont(x, 0.025) filter (where rep >= 0), 6) lower, round(quantile_cont(x, 0.975) filter (where rep >= 0), 6) upper from st group by 1",
    "common_parseable": f"{BASE}, {_JS}, cp as (select dataset, dialogue_id, seed, method, max((goal and st)::int) s, max((goal and lo)::int) l from js where ok group by all), f as (select dataset, dialogue_id, max(s) fs, max(l) fl from cp where method = 'full_context' group by 1, 2) select dataset, method, count(*) n, round(avg(fs), 6) full_strict, round(avg(s), 6) selector_strict, round(avg(fl), 6) full_loose, round(avg(l), 6) selector_loose from cp join f using (dataset, dialogue_id) where method <> 'full_context' group by 1, 2",
    "percentiles": "select method, round(quantile_cont(compressed_text_chars, 0.025), 4) p025, round(quantile_cont(compressed_text_chars, 0.5), 4) p50, round(quantile_cont(compressed_text_chars, 0.975), 4) p975 from probes group by 1",
    "wilson_interval": f"{VALUES}, q as (select dataset, method, sum(strict)::bigint k, count(*) n from v group by 1, 2), w as (select *, k / n::double p from q) select dataset, method, k, n, round((p + 1.9208 / n - 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) lower, round((p + 1.9208 / n + 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) upper from w",
    "mcnemar_tests": f"{VALUES}, q as (select dataset, dialogue_id, max(strict) filter (where method = 'full_context') f, max(strict) filter (where method = 'recency') r from v group by 1, 2), c as (select dataset, count(*) filter (where f = 1 and r = 0) b, count(*) filter (where f = 0 and r = 1) c from q where f is not null and r is not null group by 1) select dataset, b, c, round(least(1.0::double, 2 * case when b + c <= 46 then list_sum(list_transform(range(0, least(b, c) + 1), lambda i: round(coalesce(list_product(list_transform(range(0, i), lambda j: (b + c - j) / (j + 1)::double)), 1.0::double)))) / pow(2.0::double, b + c) else list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) + (b + c) * ln(0.5::double)))) end), 6) p from c",
    "agg_group_seed_counts": "with x as (select case when contains(lower(slot_human),'time') then 'Time' when contains(lower(slot_human),'date') or contains(lower(slot_human),'day') then 'Date' when regexp_matches(lower(slot_human),'city|location|origin|destination|area|place|name|theater|hotel|restaurant|departure|dest') then 'Place and name' else 'Other' end slot_group, meta.sample_seed seed from probes where method = 'full_context' and slot_human is not null) select slot_group, " + ", ".join(f"count(*) filter (where seed = {s}) seed_{s}" for s in (42, 43, 44, 45, 46)) + " from x group by 1",
}
