"""Reader answers against their probes: joins, recovered fields, and the lexical scorers.

The fields of an answer come from one reading of its JSON (`functions.exact.json_fields`) in the flavour
each scorer follows: goals and joint answers from the whole text or its last object, current values from the
last object only. Everything behind that is a column expression. Nulls: a missing text is unparsed, a
missing gold is never matched. Repeated answers are scored each; a probe that stands twice under one request
counts once, by its last row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exact import json_fields
from ..functions.strings import STOP_GOAL, STOP_VALUE, answer_variants, cjk_tokens, collapse, content_tokens, hangul_tokens, norm_text, normalize_by, normalize_value, numeric_only_equivalent, occurs_bounded, split_answer
from ..functions.text import dataset_name, nfkc
from ..runtime import hot_join

#: Words of a value that stand for no answer (fixed values).
NO_ANSWER = ("", "unknown", "n/a", "none")


def one_probe(probes: DataFrame, context: bool = False) -> DataFrame:
    """The last probe of each request, with the columns that scorers read; the context only on demand."""
    first = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs])
    kept = [
        "row_id", "dialogue_id", dataset_name("dataset").alias("dataset"), "domain", "method", "probe_type", F.col("meta.sample_seed").alias("seed"), "slot_human", "old_value", "new_value", "gold", "gold_story_label", "gold_value", first("gold_value", "gold", "new_value").alias("value_gold"),
        *([first("compressed_text_used", "prompt_user").alias("context"), F.col("compressed_text_used").alias("compressed")] if context else []),
    ]
    return probes.where("request_id is not null").groupBy(F.col("request_id").alias("id")).agg(F.max_by(F.struct(*kept), "row_id").alias("p"))


def answers_with_probes(answers: DataFrame, probes: DataFrame, context: bool = False) -> DataFrame:
    """Inner join of answers and probes by request, safe when one request holds very many answers, with the
    fields of each answer: j (whole text or last object) and t (last object only)."""
    rows = answers.where("id is not null").select("answer_no", "id", "model", "source", "error", "input_tokens", F.col("reader_output_text").alias("text"))
    joined = hot_join(rows, one_probe(probes, context), "id").where("p is not null").withColumn("f", json_fields()("text"))
    return joined.select("answer_no", "id", "model", "source", "error", "input_tokens", "p.*", F.col("f.dict").alias("j"), F.col("f.tail").alias("t"))


def token_f1(gold: Column, pred: Column) -> Column:
    """Set F1 of two token arrays: 0 when either is empty or they are disjoint."""
    both = F.size(F.array_intersect(gold, pred))
    return F.when((F.size(gold) > 0) & (F.size(pred) > 0), 2.0 * both / (F.size(gold) + F.size(pred))).otherwise(0.0)


def _int(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def with_abstain(rows: DataFrame) -> DataFrame:
    """Unparsed, declared and empty answers are abstentions; `pred` is empty for them."""
    pred = F.when(F.col("j.ok") & ~F.col("j.abstain"), F.coalesce("j.value", F.lit(""))).otherwise("")
    return rows.withColumns({"pred": pred, "abstain": pred == "", "parsed": F.col("j.ok")})


def score_goal(rows: DataFrame) -> DataFrame:
    """Initial goals: two shared content tokens are strict, one is loose; set F1 beside them."""
    rows = with_abstain(rows.where("probe_type = 'P1'")).withColumns({"gt": content_tokens("gold", STOP_GOAL), "pt": content_tokens("pred", STOP_GOAL)})
    overlap = F.size(F.array_intersect("gt", "pt"))
    return rows.withColumns({"overlap": overlap, "strict": _int(overlap >= 2), "loose": _int(overlap >= 1), "f1": F.round(token_f1(F.col("gt"), F.col("pt")), 6)}).drop("gt", "pt")


def score_value(rows: DataFrame) -> DataFrame:
    """Current values: equal normal forms are strict, a bounded occurrence is loose. Only a string is a
    prediction; an unparsed answer is wrong but no abstention; rows with an error score 0 with `err` 1."""
    err = F.coalesce(F.col("error"), F.lit("")) != ""
    said = F.when(F.col("t.kind") == "string", F.col("t.value"))
    pick = rows.where("probe_type = 'P3'").withColumns({"err": _int(err), "value": said, "parsed": F.col("t.ok")})
    pick = pick.withColumn("abstain", ~err & (F.col("t.truthy") | F.coalesce(F.lower(F.trim("value")).isin(*NO_ANSWER), F.lit(False))))
    pick = pick.withColumns({"ng": normalize_by("value_gold", "dataset"), "np": normalize_by("value", "dataset"), "gt": content_tokens("value_gold", STOP_VALUE), "pt": content_tokens("value", STOP_VALUE)})
    ok = ~err & ~F.col("abstain")
    overlap = F.size(F.array_intersect("gt", "pt"))
    return pick.withColumns(
        {
            "strict": _int(ok & (F.col("ng") != "") & (F.col("ng") == F.col("np"))),
            "loose": _int(ok & occurs_bounded("ng", "np")),
            "overlap_strict": _int(ok & (overlap >= 2) & (F.size("gt") >= 2)),
            "overlap_loose": _int(ok & (overlap >= 1)),
        }
    ).drop("ng", "np", "gt", "pt")


def half_down(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n / 2).cast("int"))


def score_joint_whole(rows: DataFrame) -> DataFrame:
    """Goal and value anywhere in the whole answer."""
    return _whole_field(with_abstain(rows.where("probe_type = 'P1_LATE'")))


def _whole_field(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({"gt": content_tokens("gold_story_label"), "vt": content_tokens("gold_value"), "pt": content_tokens("pred")})
    goal = F.size(F.array_intersect("gt", "pt")) >= 1
    strict = occurs_bounded(norm_text(F.coalesce("gold_value", F.lit(""))), norm_text("pred"))
    loose = strict | ((F.size("vt") > 0) & (F.size(F.array_intersect("vt", "pt")) >= half_down(F.size("vt"))))
    return rows.withColumns({"goal_ok": _int(goal), "value_strict": _int(strict), "value_loose": _int(loose), "joint_strict": _int(goal & strict), "joint_loose": _int(goal & loose), "f1": F.round(token_f1(F.array_union("gt", "vt"), F.col("pt")), 6)}).drop("gt", "vt", "pt")


def score_joint_segment(rows: DataFrame) -> DataFrame:
    """Goal in the goal segment and value in the value segment of `goal; slot: value`."""
    return _segments(with_abstain(rows.where("probe_type = 'P1_LATE'")))


def score_joint_both(rows: DataFrame) -> DataFrame:
    """Both joint scores of each answer in one pass: whole-field columns with the prefix `whole_`."""
    whole = _whole_field(with_abstain(rows.where("probe_type = 'P1_LATE'")))
    names = ("goal_ok", "value_strict", "value_loose", "joint_strict", "joint_loose", "f1")
    return _segments(whole.withColumnsRenamed({n: f"whole_{n}" for n in names}))


def _segments(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("seg", split_answer("pred"))
    rows = rows.withColumns({"gt": content_tokens("gold_story_label"), "vt": content_tokens("gold_value"), "st": content_tokens("seg.value")})
    parsed = F.col("seg").isNotNull()
    goal = parsed & (F.size(F.array_intersect(F.col("gt"), content_tokens("seg.goal"))) >= 1)
    strict = parsed & occurs_bounded(norm_text(F.coalesce("gold_value", F.lit(""))), norm_text(F.coalesce("seg.value", F.lit(""))))
    loose = strict | (parsed & (F.size("vt") > 0) & (F.size(F.array_intersect("vt", "st")) >= half_down(F.size("vt"))))
    return rows.withColumns({"segment_parse": _int(parsed), "goal_ok": _int(goal), "value_strict": _int(strict), "value_loose": _int(loose), "joint_strict": _int(goal & strict), "joint_loose": _int(goal & loose)}).drop("gt", "vt", "st", "seg")


def score_variants(rows: DataFrame) -> DataFrame:
    """Open values: any displayed variant equal, bounded or numerically equal is strict; half of the
    content tokens, rounded up, is loose. `gold_in_context` needs rows with their context."""
    err = F.coalesce(F.col("error"), F.lit("")) != ""
    said = F.when(F.col("j.kind").isin("string", "number"), F.col("j.value"))
    rows = rows.where("dataset = 'lme_ku' and probe_type = 'P3'").withColumns({"pred": said, "err": _int(err)})
    declared = F.col("j.truthy") | F.col("j.kind").isNull() | (F.col("j.kind") == "null") | ((F.col("j.kind") == "string") & F.lower(F.trim("j.value")).isin(*NO_ANSWER))
    rows = rows.withColumns({"abstain": declared, "np": normalize_value("pred", "lme"), "variants": _normal_variants("value_gold")})
    hit = F.exists("variants", lambda v: (v != "") & ((v == F.col("np")) | occurs_bounded(v, F.col("np")) | numeric_only_equivalent(F.col("np"), v)))
    ok = ~err & ~F.col("abstain") & (F.col("np") != "")
    gt, pt = content_tokens(normalize_value("value_gold", "lme"), STOP_VALUE), content_tokens(F.col("np"), STOP_VALUE)
    enough = (F.size(gt) > 0) & (F.size(pt) > 0) & (F.size(F.array_intersect(gt, pt)) >= F.ceil(F.size(gt) / 2))
    out = {"strict": _int(ok & hit), "loose": _int(ok & (hit | enough))}
    if "context" in rows.columns:
        rows = rows.withColumn("_context", normalize_value("context", "lme"))
        out["gold_in_context"] = _int(F.exists("variants", lambda v: occurs_bounded(v, F.col("_context"))))
    return rows.withColumns(out).drop("np", "variants", "_context")


#: A letter no text uses; it divides texts that are normalized together and is left alone by every step.
_DIVIDER = "\ua66e"


def _normal_variants(gold: str) -> Column:
    """Normal forms of the displayed variants of a text, normalized as one text."""
    joined = F.array_join(answer_variants(F.coalesce(F.col(gold), F.lit(""))), f" {_DIVIDER} ")
    return F.transform(F.split(normalize_value(joined, "lme"), _DIVIDER), lambda v: F.trim(v))


def score_ideographs(rows: DataFrame) -> DataFrame:
    """Goals in Chinese: ideographs and Latin words are tokens; gated by not abstaining."""
    rows = with_abstain(rows.where("dataset = 'risawoz' and probe_type = 'P1'"))
    gt, pt = cjk_tokens("gold"), cjk_tokens("pred")
    overlap = F.size(F.array_intersect(gt, pt))
    return rows.withColumns({"overlap": overlap, "strict": _int(~F.col("abstain") & (overlap >= 2)), "loose": _int(~F.col("abstain") & (overlap >= 1)), "f1": F.round(token_f1(gt, pt), 6)})


def support_in_context(rows: DataFrame) -> DataFrame:
    """Whether the quoted support stands in the context, in the flavour of the answer's scorer: `value` (normal
    forms, of current values), `bounded` (open values, at word bounds), `compatible` (goals in Chinese, over
    the compressed text), `plain` (all others; case and blanks aside). Rows need their context."""
    flavour = F.when((F.col("probe_type") == "P3") & (F.col("dataset") == "lme_ku"), "bounded").when(F.col("probe_type") == "P3", "value").when((F.col("probe_type") == "P1") & (F.col("dataset") == "risawoz"), "compatible").otherwise("plain")
    tail = F.coalesce("t.support", F.lit(""))
    whole = F.coalesce("j.support", F.lit(""))
    inside = lambda s, c: (s != "") & c.contains(s)
    blanks = lambda x: collapse(F.lower(nfkc(x)))
    found = (
        F.when(F.col("flavour") == "value", inside(normalize_by(tail, "dataset"), normalize_by("context", "dataset")))
        .when(F.col("flavour") == "bounded", occurs_bounded(normalize_value(whole, "lme"), normalize_value("context", "lme")))
        .when(F.col("flavour") == "compatible", inside(blanks(whole), blanks(F.coalesce("compressed", F.lit("")))))
        .otherwise(inside(norm_text(whole), norm_text(F.coalesce("context", F.lit("")))))
    )
    return rows.withColumn("flavour", flavour).withColumn("in_context", _int(found))


def either_contains(rows: DataFrame, pred: str, gold: str, old: str) -> Column:
    """Containment in either direction; a gold that holds the old value asks for it and for any of
    the gold's words longer than three letters. An empty prediction is contained in any gold."""
    p, g, o = F.lower(F.coalesce(pred, F.lit(""))), F.trim(F.lower(F.coalesce(gold, F.lit("")))), F.trim(F.lower(F.coalesce(old, F.lit(""))))
    words = F.filter(F.regexp_extract_all(g, F.lit(r"(?U)(\w+)"), 1), lambda w: F.length(w) > 3)
    both = (o != "") & (o != g) & g.contains(o)
    return (g != "") & F.when(both, p.contains(o) & F.exists(words, lambda w: p.contains(w))).otherwise(p.contains(g) | g.contains(p))


def score_either(rows: DataFrame) -> DataFrame:
    """Containment either way, for the dataset that is judged so."""
    rows = rows.where("dataset = 'fmts'").withColumn("value", F.coalesce("j.value", F.lit("")))
    return rows.withColumn("correct", _int(either_contains(rows, "value", "gold", "old_value")))


def retention_question(text: Column | str, expected: Column | str) -> Column:
    """1 if the expected answer stands in the text or more than half of its tokens do."""
    t, e = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(expected, F.lit("")))
    words = hangul_tokens(e)
    share = F.size(F.array_intersect(words, hangul_tokens(t))) / F.greatest(F.size(words), F.lit(1))
    return F.when((e != "") & t.contains(e), 1).when(share > 0.5, 1).otherwise(0)


def share_of(listed: Column, kept: Column, empty: float) -> Column:
    """Share of the listed turns that were kept; `empty` for an empty or missing list."""
    clean = F.array_distinct(F.filter(F.coalesce(listed, F.array().cast("array<bigint>")), lambda x: x.isNotNull()))
    return F.when(F.size(clean) == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(clean, kept)) / F.size(clean))


def kept_turns(context: Column | str) -> Column:
    """Turn numbers of a rendered context."""
    return F.transform(F.regexp_extract_all(F.coalesce(context, F.lit("")), F.lit(r"\[T(\d+)\]"), 1), lambda x: x.cast("bigint"))
