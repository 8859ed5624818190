"""Selection queries over the turn tables, each with its SQL statement."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from ..functions.strings import ALIASES, correction_cue, normalize_value, occurs_bounded, slot_group, storage_stats
from ..functions.text import dataset_name
from ..operators import score, select
from ..operators.build import numbered
from ..runtime import hot_join, table

RATIO = 0.3
SPEAKER = "case when upper(trim(coalesce(speaker,''))) in ('USER','HUMAN','CUSTOMER','用户','사용자') then 'USER' when upper(trim(coalesce(speaker,''))) in ('SYSTEM','ASSISTANT','BOT','AGENT','系统','시스템') then 'SYSTEM' when turn_id % 2 = 0 then 'USER' else 'SYSTEM' end"
TURNS = f"""t as (select dialogue_id, turn_id, {SPEAKER} as speaker, text, belief from (select *, row_number() over (partition by dialogue_id, turn_id order by loaded_at desc, text desc) rn from turns where dialogue_id is not null and turn_id is not null) where rn = 1),
 l as (select *, count(*) over (partition by dialogue_id) n from t), b as (select *, greatest(1, round_even(n * 0.3::double, 0)::int) k from l)"""
DATASET = "case when regexp_replace(lower({0}),'[^a-z]','','g') = 'lmeku' then 'lme_ku' else regexp_replace(lower({0}),'[^a-z]','','g') end"


def turns_of(spark, d):
    return select.clean_turns(table(spark, d, "turns"))


def _method(name):
    def query(spark, d):
        return select.positional(turns_of(spark, d), RATIO).where(F.col("method") == name).select("dialogue_id", "turn_id")

    return query


def sel_positional_all(spark, d):
    return select.positional(turns_of(spark, d), RATIO)


def sel_hash_random(spark, d):
    return select.hash_random(turns_of(spark, d), RATIO, 42)


def sel_first_user_recent(spark, d):
    return select.first_user_recent(turns_of(spark, d), RATIO)


def sel_topk_score(spark, d):
    return select.top_score(turns_of(spark, d), F.length(F.coalesce("text", F.lit(""))), RATIO)


def sel_topk_floor(spark, d):
    return select.top_score(turns_of(spark, d), F.length(F.coalesce("text", F.lit(""))), RATIO, floor=True)


def sel_chunk_retention(spark, d):
    return select.chunk_retention(turns_of(spark, d), F.length(F.coalesce("text", F.lit(""))), 4, 0.5)


def sel_budgets(spark, d):
    n = turns_of(spark, d).groupBy("dialogue_id").agg(F.count("*").alias("n"))
    return n.select("dialogue_id", "n", *[f(r).alias(f"{name}_{int(r * 100)}") for r in (0.1, 0.3, 0.5, 0.7) for name, f in (("round", select.budget), ("floor", select.budget_floor))])


def sel_random_exact(spark, d):
    return select.random_exact(turns_of(spark, d), RATIO, 42)


def sel_mmr_embedding(spark, d):
    return select.mmr(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.1)


def sel_matched_control(spark, d):
    return select.matched_control(turns_of(spark, d), table(spark, d, "update_labels"))


def sel_deletion_conditions(spark, d):
    """Contexts sizes under full, origin deleted, final update deleted."""
    turns = turns_of(spark, d).select("dialogue_id", "turn_id")
    labels = table(spark, d, "update_labels").groupBy("dialogue_id").agg(F.min("origin_turn_id").alias("origin"), F.min("final_slot_update_turn_id").alias("final"))
    rows = hot_join(turns, labels, "dialogue_id").where("origin is not null")
    conditions = F.filter(F.array(F.lit("full"), F.when(F.col("turn_id") != F.col("origin"), F.lit("minus_origin")), F.when(F.col("turn_id") != F.col("final"), F.lit("minus_final"))), lambda c: c.isNotNull())
    return rows.select("dialogue_id", F.explode(conditions).alias("condition")).groupBy("dialogue_id", "condition").agg(F.count("*").alias("n_turns"))


def turns_clean(spark, d):
    return turns_of(spark, d).select("dialogue_id", "turn_id", "speaker", "text")


def turns_render_subset(spark, d):
    turns = turns_of(spark, d)
    kept = select.positional(turns, RATIO).where("method in ('recency', 'first_n', 'uniform_stride')")
    return select.render(turns, kept)


def turns_parse_blocks(spark, d):
    contexts = table(spark, d, "probes").where("compressed_text_used is not null").select("row_id", "compressed_text_used")
    return select.parse_blocks(contexts, "compressed_text_used").select("row_id", "turn_id", "role", "said")


def slot_transitions(spark, d):
    return select.transitions(turns_of(spark, d))


def slot_latest_transition(spark, d):
    return select.latest_transitions(slot_transitions(spark, d))


def event_transitions(spark, d):
    """Changes of event type by user, as slot changes over the event table."""
    rows = select.lagged(table(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"], "event_type", "old_type")
    return rows.where("old_type is not null and old_type <> event_type").select("user_id", "event_id", "old_type", F.col("event_type").alias("new_type"))


def session_flatten(spark, d):
    """User-day sessions flattened with a marker row before each: user_id, flat_id, is_marker, event_id."""
    events = table(spark, d, "events").select("user_id", "event_id", "ts", F.to_date("ts").alias("day"))
    markers = events.groupBy("user_id", "day").agg(F.min("ts").alias("ts")).select("user_id", F.lit(-1).cast("bigint").alias("event_id"), "ts", "day", F.lit(0).alias("kind"))
    rows = markers.unionByName(events.withColumn("kind", F.lit(1)))
    numbered = select.ranked(rows, "user_id", ["day", "kind", "ts", "event_id"])
    return numbered.select("user_id", (F.col("rank") - 1).alias("flat_id"), (F.col("kind") == 0).alias("is_marker"), "event_id")


def evidence_turns(spark, d):
    """Turns that hold the new value at word bounds, with the origin: dialogue_id, turn_id, is_evidence."""
    labels = table(spark, d, "update_labels").groupBy("dialogue_id").agg(F.min_by(F.struct("new_value", "origin_turn_id"), F.struct("slot", "new_value")).alias("l"))
    rows = hot_join(turns_of(spark, d).select("dialogue_id", "turn_id", "text"), labels, "dialogue_id").where("l is not null")
    rows = rows.select("dialogue_id", "turn_id", normalize_value("l.new_value").alias("a"), normalize_value("text").alias("h"), (F.col("turn_id") == F.col("l.origin_turn_id")).alias("is_origin"))
    return rows.select("dialogue_id", "turn_id", occurs_bounded("a", "h").alias("is_evidence"), "is_origin").where("is_evidence or is_origin")


def value_retention(spark, d):
    """Share of probes whose context still holds the new value, by dataset and method."""
    probes = table(spark, d, "probes").where("new_value is not null and compressed_text_used is not null")
    probes = probes.select(dataset_name("dataset").alias("dataset"), "method", normalize_value("new_value").alias("a"), normalize_value("compressed_text_used").alias("h"))
    return probes.select("dataset", "method", occurs_bounded("a", "h").cast("int").alias("kept")).groupBy("dataset", "method").agg(F.count("*").alias("n"), F.sum("kept").alias("n_kept"), F.round(F.avg("kept"), 6).alias("retention"))


def retention_by_group(spark, d):
    probes = table(spark, d, "probes").where("new_value is not null and compressed_text_used is not null and slot_human is not null")
    probes = probes.select(slot_group("slot_human").alias("slot_group"), F.col("meta.sample_seed").alias("seed"), normalize_value("new_value").alias("a"), normalize_value("compressed_text_used").alias("h"))
    return probes.select("slot_group", "seed", occurs_bounded("a", "h").cast("int").alias("kept")).groupBy("slot_group", "seed").agg(F.count("*").alias("n"), F.round(F.avg("kept"), 6).alias("retention"))


def boundary_support_recall(spark, d):
    """Recall of evidence and support turns, and rate of control turns, in each kept context."""
    probes = table(spark, d, "probes").withColumn("kept", score.kept_turns("compressed_text_used"))
    return probes.select(
        "row_id",
        F.round(score.share_of(F.col("meta.s_evidence"), F.col("kept"), 1.0), 6).alias("boundary_recall"),
        F.round(score.share_of(F.col("meta.s_transition_support"), F.col("kept"), 1.0), 6).alias("support_recall"),
        F.round(score.share_of(F.col("meta.control_origin"), F.col("kept"), 0.0), 6).alias("adv_fp_rate"),
    )


def context_storage(spark, d):
    probes = table(spark, d, "probes").select("row_id", storage_stats("compressed_text_used").alias("s"), storage_stats("prompt_user").alias("p"))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    return probes.select("row_id", "s.n_words", "s.n_chars", ratio(F.col("s.n_words"), F.col("p.n_words")).alias("word_ratio"), ratio(F.col("s.n_chars"), F.col("p.n_chars")).alias("char_ratio"))


def retention_question(spark, d):
    probes = table(spark, d, "probes").where("gold is not null")
    return probes.select("row_id", score.retention_question("compressed_text_used", "gold").alias("qa"))


def correction_cue_audit(spark, d):
    """Dialogues whose user turns fire a correction cue, against those with a labelled update."""
    cues = turns_of(spark, d).where("speaker = 'USER'").groupBy("dialogue_id").agg(F.max(correction_cue("text").cast("int")).alias("cue"))
    labels = table(spark, d, "update_labels").groupBy("dialogue_id").agg(F.max(F.col("is_final_slot_update").cast("int")).alias("final"))
    return cues.join(labels, "dialogue_id", "left").groupBy("cue", F.coalesce("final", F.lit(-1)).alias("final")).agg(F.count("*").alias("n_dialogues"))


def eligible_joint(spark, d):
    """Labels fit for joint questions: resolved, final, long enough, revised late."""
    late = F.col("origin_turn_id") / F.greatest(F.lit(1), F.col("n_turns") - 1) >= 0.5
    return table(spark, d, "update_labels").where("origin_status = 'resolved' and is_final_slot_update and n_turns >= 10 and origin_turn_id >= 6").where(late).select("dialogue_id", "slot", "origin_turn_id", "n_turns")


def eligible_value(spark, d):
    """Labels fit for value questions: final, no mere respelling, value present in a turn."""
    from ..functions.strings import alias_equivalent

    labels = table(spark, d, "update_labels").where("is_final_slot_update").where(~alias_equivalent("old_value", "new_value"))
    wanted = labels.select("dialogue_id", "slot", "new_value", normalize_value("new_value").alias("nv")).where("nv <> ''")
    texts = turns_of(spark, d).select("dialogue_id", normalize_value("text").alias("nt"))
    own = wanted.groupBy("dialogue_id").agg(F.collect_set(F.struct("slot", "new_value", "nv")).alias("w"))
    said = hot_join(texts, own, "dialogue_id").where("w is not null").select("dialogue_id", "nt", F.inline("w"))
    return said.where(F.col("nt").contains(F.col("nv"))).select("dialogue_id", "slot", "new_value").distinct()


def transition_window(spark, d):
    """Dialogues of six turns or more with a change in the inner turns."""
    lengths = turns_of(spark, d).groupBy("dialogue_id").agg(F.count("*").alias("n")).where("n >= 6")
    return hot_join(slot_transitions(spark, d), lengths, "dialogue_id").where("turn_id between 3 and n - 2").groupBy("dialogue_id").agg(F.count("*").alias("n_changes"), F.max("turn_id").alias("last_change"))


def sample_by_hash(spark, d):
    """Fifty eligible dialogues in an order that depends on a seed and the id only."""
    ids = table(spark, d, "update_labels").where("is_final_slot_update").select("dialogue_id").distinct()
    order = F.sha2(F.concat(F.lit("7|"), "dialogue_id"), 256)
    return ids.orderBy(order, "dialogue_id").limit(50).select("dialogue_id")


def even_sample(spark, d):
    """Eleven dialogues evenly spaced in the order of their ids."""
    ids = numbered(table(spark, d, "update_labels").select("dialogue_id").distinct(), ["dialogue_id"])
    n = ids.agg(F.count("*").alias("n")).scalar()
    places = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.rint(i * (F.col("n") - 1) / 10).cast("bigint"))
    return ids.withColumn("n", n).where(F.array_contains(places, F.col("place").cast("bigint"))).select("dialogue_id")


_N = {m: _method(m) for m in ("full_context", "recency", "first_n", "uniform_stride", "streamingllm")}
QUERIES = {f"sel_{k}": q for k, q in _N.items()} | {
    f.__name__: f
    for f in (
        sel_positional_all, sel_hash_random, sel_first_user_recent, sel_topk_score, sel_topk_floor, sel_chunk_retention, sel_budgets, sel_random_exact, sel_mmr_embedding, sel_matched_control, sel_deletion_conditions,
        turns_clean, turns_render_subset, turns_parse_blocks, slot_transitions, slot_latest_transition, event_transitions, session_flatten, evidence_turns, value_retention, retention_by_group, boundary_support_recall, context_storage,
        retention_question, correction_cue_audit, eligible_joint, eligible_value, transition_window, sample_by_hash, even_sample,
    )
}

WS = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
W = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}]"
NOT_W = W.replace("[", "[^", 1)


def _compatibility() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters with another compatibility form, by rule from the Unicode tables: those that become one
    character, what they become, and those that become several."""
    single, several = {}, []
    for c in (*range(0xA0, 0x300), *range(0x1E9A, 0x1E9C), *range(0x2000, 0x2500), *range(0x2A00, 0x2A80), *range(0x2E80, 0x2FE0), *range(0x3000, 0x3400), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFFF0)):
        to = unicodedata.normalize("NFKC", chr(c))
        if to != chr(c) and unicodedata.normalize("NFC", chr(c)) == chr(c):
            if len(to) == 1:
                single[chr(c)] = to
            elif c < 0x2190 or 0xFB00 <= c < 0xFB07:
                several.append((chr(c), to))
    return "".join(single), "".join(single.values()), several


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_ONE, _TO, _MANY = _compatibility()
_COMPAT = f"translate(v0, {_quoted(_ONE)}, {_quoted(_TO)})"
for _a, _b in _MANY:
    _COMPAT = f"replace({_COMPAT}, {_quoted(_a)}, {_quoted(_b)})"


def bind(x: str, name: str, then: str) -> str:
    """An expression over a value that is written once."""
    return f"list_transform([{x}], lambda {name}: {then})[1]"


def nfkc(x: str) -> str:
    return bind(x, "v0", f"case when regexp_matches(v0, '[^\\x00-\\x7F]') then nfc_normalize({_COMPAT}) else v0 end")


def _at_bounds(x: str, pattern: str, to: str) -> str:
    """Replace at Unicode word bounds: the neighbours are consumed, so it is done twice."""
    once = lambda y: f"regexp_replace({y}, '(^|{NOT_W}){pattern}($|{NOT_W})', '\\1{to}', 'g')"
    return once(once(x))


def _half_days(x: str, dotted: bool) -> str:
    """Twelve-hour times, one replacement for each hour and half of the day, with and without minutes."""
    halves = ("a\\.?m\\.?", "p\\.?m\\.?") if dotted else ("am", "pm")
    for late, half in enumerate(halves):
        for hour in range(13):
            to = (hour % 12 if hour == 12 else hour) + 12 * late
            x = _at_bounds(_at_bounds(x, f"0?{hour}:(\\d{{2}})\\s*{half}", f"{to:02d}:\\2\\3"), f"0?{hour}\\s*{half}", f"{to:02d}:00\\2")
    return x


def nv(x: str, family: str = "") -> str:
    """SQL of the normal form of a value."""
    out = bind(f"coalesce({x},'')", "n0", f"regexp_replace(lower({nfkc('n0')}), '^[{WS}]+|[{WS}]+$', '', 'g')")
    if family == "multiwoz":
        aliased = "n1"
        for old, new in ALIASES:
            aliased = _at_bounds(aliased, f"{old}", f"{new}\\2")
        out = bind(out, "n1", aliased)
    out = bind(out, "n2", f"case when regexp_matches(n2, '\\d\\s*[ap]\\.?m') then {_half_days('n2', family == 'lme')} else n2 end")
    padded = _at_bounds(out, "(\\d):(\\d{2})", "0\\2:\\3\\4")
    if family != "lme":
        padded = _at_bounds(_at_bounds(padded, "(\\d)([0-5]\\d)", "0\\2:\\3\\4"), "([01]\\d|2[0-3])([0-5]\\d)", "\\2:\\3\\4")
    return f"trim(regexp_replace(regexp_replace({padded}, '[^{W[1:-1]}{WS}:/-]+', ' ', 'g'), '[{WS}]+', ' ', 'g'))"


def nv_by(x: str, dataset: str = "dataset") -> str:
    return f"case when {dataset} = 'multiwoz' then {nv(x, 'multiwoz')} else {nv(x)} end"


def bounded(needle: str, hay: str) -> str:
    return f"coalesce(case when {needle} <> '' and contains({hay},{needle}) then regexp_matches({hay}, '(?:^|{NOT_W})' || regexp_escape({needle}) || '(?:$|{NOT_W})') end, false)"


_PICK = f"with {TURNS} select dialogue_id, turn_id from b where "
_RANK = f"with {TURNS}, r as (select *, row_number() over (partition by dialogue_id order by {{0}}, turn_id) rk from b) select dialogue_id, turn_id from r where rk <= k"
_STRIDE = "(k >= n or list_contains(list_transform(range(0, k::bigint), lambda i: least(n - 1, round_even(i * (n / k::double), 0)::bigint)), turn_id))"
_CONDS = {"full_context": "true", "recency": "turn_id >= n - k", "first_n": "turn_id < k", "uniform_stride": _STRIDE, "streamingllm": "(turn_id < least(k, 2) or turn_id >= n - greatest(k - 2, 0))"}
_BLOCK = "'[T' || turn_id || '] ' || speaker || ': ' || coalesce(text,'')"
_SHARE = "case when len(coalesce({0},[])) = 0 or len(list_filter({0}, lambda x: x is not null)) = 0 then {1}::double else round(len(list_intersect(list_distinct(list_filter({0}, lambda x: x is not null)), kept)) / len(list_distinct(list_filter({0}, lambda x: x is not null)))::double, 6) end"
_CHANGES = f"{TURNS}, v as (select dialogue_id, turn_id, e.key slot, e.value as value from t, unnest(map_entries(belief)) u(e) where belief is not null and trim(coalesce(e.value,'')) <> ''), c as (select *, lag(value) over (partition by dialogue_id, slot order by turn_id) old_value from v), ch as (select dialogue_id, slot, turn_id, old_value, value as new_value from c where old_value is not null and old_value <> value)"
_GROUP = "case when contains(lower(slot_human),'time') then 'Time' when contains(lower(slot_human),'date') or contains(lower(slot_human),'day') then 'Date' when regexp_matches(lower(slot_human),'city|location|origin|destination|area|place|name|theater|hotel|restaurant|departure|dest') then 'Place and name' else 'Other' end"
_CUE = r"(?i)\b(?:actually|instead|rather|on second thought|scrap that|wait,? (?:let me|i)|let me change|let''s change|change (?:it|that|the)|no,? (?:make it|change it|i (?:want|need|meant))|not (?:that|this)|i meant|i''d rather|i would rather|i changed my mind|never mind)\b"

ORACLE = {f"sel_{m}": _PICK + c for m, c in _CONDS.items()} | {
    "sel_positional_all": f"with {TURNS} " + " union all ".join(f"select '{m}' as method, dialogue_id, turn_id from b where {c}" for m, c in _CONDS.items()),
    "sel_hash_random": _RANK.format("sha256('42|' || dialogue_id || '|' || turn_id)"),
    "sel_first_user_recent": f"with {TURNS}, f as (select dialogue_id, min(turn_id) fu from t where speaker = 'USER' group by 1), r as (select b.*, row_number() over (partition by b.dialogue_id order by case when turn_id = fu then 0 else 1 end, turn_id desc) rk from b left join f using (dialogue_id)) select dialogue_id, turn_id from r where rk <= k",
    "sel_topk_score": _RANK.format("length(coalesce(text,'')) desc"),
    "sel_topk_floor": _RANK.format("length(coalesce(text,'')) desc").replace("rk <= k", "rk <= greatest(1, floor(n * 0.3::double))"),
    "sel_chunk_retention": f"with {TURNS}, c as (select dialogue_id, turn_id, (turn_id // 4)::int chunk, length(coalesce(text,'')) s from t), m as (select dialogue_id, chunk, round(avg(s), 9) mean, count(*) over (partition by dialogue_id) chunks from c group by 1, 2), r as (select *, row_number() over (partition by dialogue_id order by mean desc, chunk) rk from m) select dialogue_id, turn_id, chunk from c semi join (select * from r where rk <= greatest(1, floor(chunks * 0.5::double))) using (dialogue_id, chunk)",
    "sel_budgets": f"with {TURNS} select dialogue_id, n, " + ", ".join(f"greatest(1, round_even(n * {r}::double, 0)::int) as round_{int(r * 100)}, greatest(1, floor(n * {r}::double)::int) as floor_{int(r * 100)}" for r in (0.1, 0.3, 0.5, 0.7)) + " from (select dialogue_id, count(*) n from t group by 1)",
    "sel_matched_control": f"with {TURNS}, x as (select dialogue_id, turn_id, speaker, len(regexp_split_to_array(trim(coalesce(text,'')), ' +')) words, {nv('text')} norm from t), w as (select dialogue_id, final_slot_update_turn_id target, {nv('old_value')} o, {nv('new_value')} nn from (select *, row_number() over (partition by dialogue_id order by slot, final_slot_update_turn_id) rn from update_labels) where rn = 1), g as (select w.*, x.speaker sp, x.words tw from w join x on x.dialogue_id = w.dialogue_id and x.turn_id = target), r as (select g.dialogue_id, target, turn_id as control, row_number() over (partition by g.dialogue_id order by abs(words - tw), abs(turn_id - target), turn_id) rk from g join x using (dialogue_id) where turn_id <> target and speaker = sp and not (o <> '' and contains(norm, o)) and not (nn <> '' and contains(norm, nn))) select dialogue_id, target, control from r where rk = 1",
    "sel_deletion_conditions": f"with {TURNS}, q as (select dialogue_id, min(origin_turn_id) o, min(final_slot_update_turn_id) f from update_labels group by 1) select dialogue_id, condition, count(*) n_turns from (select dialogue_id, unnest(list_filter(['full', case when turn_id <> o then 'minus_origin' end, case when turn_id <> f then 'minus_final' end], lambda x: x is not null)) as condition from t join q using (dialogue_id) where o is not null) group by 1, 2",
    "turns_clean": f"with {TURNS} select dialogue_id, turn_id, speaker, text from t",
    "turns_render_subset": f"with {TURNS}, k3 as (" + " union all ".join(f"select '{m}' as method, dialogue_id, turn_id, speaker, text from b where {_CONDS[m]}" for m in ("recency", "first_n", "uniform_stride")) + f") select method, dialogue_id, count(*) n_kept, string_agg({_BLOCK}, chr(10) order by turn_id) as context from k3 group by 1, 2",
    "turns_parse_blocks": r"with m as (select row_id, unnest(regexp_split_to_array(regexp_replace(compressed_text_used, '\n(\[T\d+\] (?:USER|SYSTEM): )', chr(1) || '\1', 'g'), chr(1))) as blk from probes where compressed_text_used is not null) select row_id, regexp_extract(blk, '^\[T(\d+)\]', 1)::int as turn_id, regexp_extract(blk, '^\[T\d+\] (USER|SYSTEM)', 1) as role, regexp_replace(blk, '^\[T\d+\] (?:USER|SYSTEM): ', '') as said from m where regexp_matches(blk, '^\[T\d+\] (?:USER|SYSTEM): ')",
    "slot_transitions": f"with {_CHANGES} select dialogue_id, slot, turn_id, old_value, new_value from ch",
    "slot_latest_transition": f"with {_CHANGES}, r as (select *, row_number() over (partition by dialogue_id order by turn_id desc, slot) rn from ch) select dialogue_id, slot, turn_id, old_value, new_value from r where rn = 1",
    "event_transitions": "with r as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) old_type from events) select user_id, event_id, old_type, event_type as new_type from r where old_type is not null and old_type <> event_type",
    "session_flatten": "with e as (select user_id, event_id, ts, ts::date as d, 1 as kind from events), m as (select user_id, -1::bigint event_id, min(ts) ts, d, 0 as kind from e group by user_id, d) select user_id, (row_number() over (partition by user_id order by d, kind, ts, event_id) - 1)::int flat_id, kind = 0 as is_marker, event_id from (select * from e union all by name select * from m)",
    "evidence_turns": f"with {TURNS}, q as (select dialogue_id, new_value, origin_turn_id from (select *, row_number() over (partition by dialogue_id order by slot, new_value) rn from update_labels) where rn = 1), x as (select dialogue_id, turn_id, origin_turn_id, {nv('new_value')} a, {nv('text')} h from t join q using (dialogue_id)), y as (select dialogue_id, turn_id, {bounded('a', 'h')} as is_evidence, turn_id = origin_turn_id as is_origin from x) select * from y where is_evidence or is_origin",
    "value_retention": f"with x as (select {DATASET.format('dataset')} dataset, method, {nv('new_value')} a, {nv('compressed_text_used')} h from probes where new_value is not null and compressed_text_used is not null), y as (select dataset, method, {bounded('a', 'h')}::int kept from x) select dataset, method, count(*) n, sum(kept)::bigint n_kept, round(avg(kept), 6) retention from y group by 1, 2",
    "retention_by_group": f"with x as (select {_GROUP} slot_group, meta.sample_seed seed, {nv('new_value')} a, {nv('compressed_text_used')} h from probes where new_value is not null and compressed_text_used is not null and slot_human is not null), y as (select slot_group, seed, {bounded('a', 'h')}::int kept from x) select slot_group, seed, count(*) n, round(avg(kept), 6) retention from y group by 1, 2",
    "boundary_support_recall": r"with x as (select row_id, meta.s_evidence ev, meta.s_transition_support su, meta.control_origin co, list_transform(regexp_extract_all(coalesce(compressed_text_used,''), '\[T(\d+)\]', 1), lambda x: x::bigint) kept from probes) select row_id, " + _SHARE.format("ev", 1) + " boundary_recall, " + _SHARE.format("su", 1) + " support_recall, " + _SHARE.format("co", 0) + " adv_fp_rate from x",
    "context_storage": r"with x as (select row_id, len(regexp_extract_all(coalesce(compressed_text_used,''), '\S+'))::bigint n_words, length(coalesce(compressed_text_used,''))::bigint n_chars, len(regexp_extract_all(coalesce(prompt_user,''), '\S+')) pw, length(coalesce(prompt_user,'')) pc from probes) select row_id, n_words, n_chars, case when pw > 0 then round(n_words / pw::double, 6) else 0 end word_ratio, case when pc > 0 then round(n_chars / pc::double, 6) else 0 end char_ratio from x",
    "retention_question": r"with x as (select row_id, lower(coalesce(compressed_text_used,'')) t, lower(gold) e from probes where gold is not null), y as (select *, list_distinct(regexp_extract_all(e,'[a-z0-9]+') || regexp_extract_all(e,'[가-힣]+')) ew, list_distinct(regexp_extract_all(t,'[a-z0-9]+') || regexp_extract_all(t,'[가-힣]+')) tw from x) select row_id, case when e <> '' and contains(t, e) then 1 when len(list_intersect(ew, tw)) / greatest(len(ew), 1)::double > 0.5 then 1 else 0 end qa from y",
    "correction_cue_audit": f"with {TURNS}, c as (select dialogue_id, max(regexp_matches(coalesce(text,''), '{_CUE}')::int) cue from t where speaker = 'USER' group by 1), q as (select dialogue_id, max(is_final_slot_update::int) f from update_labels group by 1) select cue, coalesce(f, -1) as final, count(*) n_dialogues from c left join q using (dialogue_id) group by 1, 2",
    "eligible_joint": "select dialogue_id, slot, origin_turn_id, n_turns from update_labels where origin_status = 'resolved' and is_final_slot_update and n_turns >= 10 and origin_turn_id >= 6 and origin_turn_id / greatest(1, n_turns - 1)::double >= 0.5",
    "eligible_value": f"with {TURNS}, q as (select *, trim(split_part(a, ',', 1)) ha, trim(split_part(b, ',', 1)) hb from (select dialogue_id, slot, new_value, {nv('old_value')} a, {nv('new_value')} b from update_labels where is_final_slot_update)), w as (select * from q where b <> '' and not (a <> '' and b <> '' and (a = b or (ha <> '' and ha = hb) or (least(length(ha), length(hb)) >= 3 and (contains(ha, hb) or contains(hb, ha)))))) select distinct w.dialogue_id, slot, new_value from w join (select dialogue_id, {nv('text')} nt from t) t2 on t2.dialogue_id = w.dialogue_id where contains(nt, b)",
    "transition_window": f"with {_CHANGES}, q as (select dialogue_id, count(*) n from t group by 1 having count(*) >= 6) select dialogue_id, count(*) n_changes, max(turn_id) last_change from ch join q using (dialogue_id) where turn_id between 3 and n - 2 group by 1",
    "sample_by_hash": "select dialogue_id from (select distinct dialogue_id from update_labels where is_final_slot_update) order by sha256('7|' || dialogue_id), dialogue_id limit 50",
    "even_sample": "with r as (select dialogue_id, row_number() over (order by dialogue_id) - 1 r, count(*) over () n from (select distinct dialogue_id from update_labels)) select dialogue_id from r where list_contains(list_transform(range(0, 11), lambda i: round_even(i * (n - 1) / 10::double, 0)::bigint), r)",
}
