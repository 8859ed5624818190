"""Text, join, validation, source and streaming queries, each with its SQL statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import readers, strings
from ..functions.exact import json_fields
from ..functions.text import dataset_name
from ..operators import joins, select, stats, validate
from ..runtime import hot_join, shared_folder, table
from ..sources import files
from ..streaming import resumable
from .selection import DATASET, SPEAKER, nv


def normalize_values(spark, d):
    return table(spark, d, "probes").select("row_id", strings.normalize_value("new_value").alias("norm"), strings.normalize_value("gold").alias("norm_gold"))


def alias_equivalence(spark, d):
    return table(spark, d, "probes").select("row_id", F.coalesce(strings.alias_equivalent("old_value", "new_value"), F.lit(False)).alias("same"))


def alias_spellings(spark, d):
    return table(spark, d, "slot_values").select("value_id", strings.apply_aliases(F.lower("value_text")).alias("spelled"))


def normalize_task(spark, d):
    return table(spark, d, "update_labels").select("dialogue_id", strings.normalize_task("goal_first_sentence").alias("task"), strings.normalize_task("goal_text").alias("goal"))


def humanize_slots(spark, d):
    return table(spark, d, "slot_values").select("value_id", strings.humanize_slot("slot").alias("label"), strings.slot_group("slot").alias("slot_group"))


def content_tokens(spark, d):
    join = lambda t: F.array_join(F.array_sort(t), " ")
    return table(spark, d, "turns").select("dialogue_id", "turn_id", "loaded_at", join(strings.content_tokens("text")).alias("goal_tokens"), join(strings.content_tokens("text", strings.STOP_VALUE)).alias("value_tokens"), join(strings.cjk_tokens("text")).alias("cjk"), join(strings.hangul_tokens("text")).alias("hangul"))


def char_cap(spark, d):
    return table(spark, d, "documents").select("doc_id", strings.char_cap("text", 120).alias("capped"))


def prompt_parts(spark, d):
    return table(spark, d, "probes").select("row_id", strings.prompt_parts("prompt_user").alias("p")).select("row_id", "p.context", "p.question")


def question_labels(spark, d):
    question = F.regexp_extract("prompt_user", r"\n\nQuestion: ([^\n]*)", 1)
    return table(spark, d, "probes").where("prompt_user is not null").select("row_id", strings.question_label(question).alias("label"))


def replace_context(spark, d):
    """Prompts whose context is swapped for its own last turn, the question kept to the byte."""
    rows = table(spark, d, "probes").where("prompt_user is not null and compressed_text_used is not null and startswith(prompt_user, compressed_text_used)")
    return rows.select("row_id", strings.replace_context("prompt_user", "compressed_text_used", F.substring_index("compressed_text_used", "\n", -1)).alias("prompt"))


def left_truncation(spark, d):
    return table(spark, d, "probes").where("prompt_user is not null").select("row_id", strings.keep_last_tokens("prompt_user", 24).alias("kept"))


def hash_ids(spark, d):
    rows = table(spark, d, "probes").where("prompt_user is not null")
    return rows.select("row_id", strings.sha_prefix("prompt_user", 16).alias("template"), F.left(F.sha1(F.concat_ws("|", "dialogue_id", "method", "probe_type")), F.lit(16)).alias("task_uid"), strings.hash_seed(F.concat(F.lit("42|"), "dialogue_id")).alias("seed32"))


def answer_variants(spark, d):
    bracketed = F.concat("value_text", F.lit(" (or "), "slot_human", F.lit(")."))
    return table(spark, d, "slot_values").select("value_id", F.array_join(strings.answer_variants(bracketed), "|").alias("variants"))


def numeric_equivalence(spark, d):
    return table(spark, d, "probes").where("old_value is not null and new_value is not null").select("row_id", strings.numeric_only_equivalent("old_value", "new_value").alias("same"))


def split_answers(spark, d):
    return table(spark, d, "probes").where("gold is not null").select("row_id", strings.split_answer("gold").alias("s")).select("row_id", "s.goal", "s.slot", "s.value")


def speaker_labels(spark, d):
    return table(spark, d, "turns").groupBy(strings.user_speaker("speaker", "turn_id").alias("role"), F.coalesce("speaker", F.lit("(none)")).alias("given")).agg(F.count("*").alias("n"))


def word_label_means(spark, d):
    """Mean of word labels built from each value: words of more than four letters are kept."""
    words = F.transform(F.split("value_text", " "), lambda w: F.concat(w, F.lit(" "), (F.length(w) > 4).cast("int").cast("string")))
    return table(spark, d, "slot_values").select("value_id", F.round(strings.mean_word_label(F.array_join(words, "\t\t|\t\t")), 6).alias("mean"), F.round(strings.digit_mean(F.array_join(words, " ")), 6).alias("legacy"))


def prompt_render(spark, d):
    """Prompts from own templates for the three probe families, over every labelled dialogue."""
    rows = table(spark, d, "update_labels").select("dialogue_id", "slot_human", F.explode(F.array(*[F.lit(x) for x in ("P1", "P3", "P1_LATE")])).alias("probe_type"))
    question = F.when(F.col("probe_type") == "P1", F.lit("What did the user first ask for?")).when(F.col("probe_type") == "P3", F.concat(F.lit("Which "), "slot_human", F.lit(" holds at the end?"))).otherwise(F.concat(F.lit("Name the first request and the final "), "slot_human", F.lit(".")))
    return rows.select("dialogue_id", "slot_human", "probe_type", question.alias("question"))


def resume_anti_join(spark, d):
    answers = table(spark, d, "reused_raw_answers")
    return joins.unseen(table(spark, d, "probes").where("request_id is not null").select("row_id", F.col("request_id").alias("id")), answers.where("error is null and id is not null"), "id")


def request_dedup_expand(spark, d):
    """Each request's one reusable answer, expanded to every probe that asks it."""
    cache = joins.reusable(table(spark, d, "reused_raw_answers").where("reader_output_text is not null"), "id", "reader_output_text")
    rows = table(spark, d, "probes").select("row_id", F.col("request_id").alias("id"))
    return joins.expand(rows, cache, "id").select("row_id", F.col("reader_output_text").alias("answer"), F.coalesce("n_cached", F.lit(0)).alias("n_cached"))


def request_fingerprints(spark, d):
    rows = joins.fingerprints(table(spark, d, "probes").select("prompt_system", "prompt_user"), ["prompt_system", "prompt_user"])
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct("fingerprint").alias("n_requests"))


def merge_replace(spark, d):
    """Probes of one method take the domain of the slot's value, all others keep theirs."""
    base = table(spark, d, "probes").select("row_id", "method", "domain")
    new = base.where("method = 'recency'").select("row_id", F.upper("domain").alias("domain"))
    return joins.merge_replace(base, new, ["row_id"], ["domain"])


def strict_join_violations(spark, d):
    return joins.strict_violations(table(spark, d, "probes").select(F.col("request_id").alias("id")).where("id is not null"), table(spark, d, "reused_raw_answers").select("id").where("id is not null"), "id")


def coverage_split(spark, d):
    return joins.coverage(table(spark, d, "probes").select(F.col("request_id").alias("id")).where("id is not null"), table(spark, d, "reused_raw_answers").where("id is not null and provenance = 'fresh_response'"), "id")


def keep_list(spark, d):
    listed = table(spark, d, "update_labels").where("is_final_slot_update and n_turns >= 12")
    return joins.keep_listed(table(spark, d, "probes"), listed, ["dialogue_id"]).groupBy("method").agg(F.count("*").alias("n"))


def labelled_probes(spark, d):
    """Probes beside their dialogue's label: method fan-out over labels, counted by slot."""
    labels = table(spark, d, "update_labels").select("dialogue_id", F.col("slot").alias("label_slot")).dropDuplicates(["dialogue_id"])
    rows = hot_join(table(spark, d, "probes").select("dialogue_id", "method"), labels, "dialogue_id").where("label_slot is not null")
    return rows.groupBy("label_slot", "method").agg(F.count("*").alias("n"))


def complete_conditions(spark, d):
    rows = table(spark, d, "probes").where("method in ('full_context', 'recency')")
    return joins.complete_items(rows, "dialogue_id", "method", ["full_context", "recency"])


def key_set_equality(spark, d):
    """Ids that only one of two tables holds: side, n."""
    a = table(spark, d, "probes").select("dialogue_id").distinct()
    b = table(spark, d, "update_labels").select("dialogue_id").distinct()
    only = a.exceptAll(b).withColumn("side", F.lit("probes")).unionByName(b.exceptAll(a).withColumn("side", F.lit("labels")))
    return only.groupBy("side").agg(F.count("*").alias("n"))


def speaker_multisets(spark, d):
    """Dialogues whose two halves have the same multiset of speakers."""
    turns = select.clean_turns(table(spark, d, "turns"))
    counts = turns.groupBy("dialogue_id").agg(F.count("*").alias("n"), F.count_if((F.col("turn_id") % 4 < 2) & (F.col("speaker") == "USER")).alias("a"), F.count_if((F.col("turn_id") % 4 >= 2) & (F.col("speaker") == "USER")).alias("b"))
    return counts.where("n % 4 = 0").select("dialogue_id", (F.col("a") == F.col("b")).alias("equal"))


def violations_unique(spark, d):
    return validate.not_unique(table(spark, d, "probes"), ["dialogue_id", "method", "probe_type"])


def violations_range(spark, d):
    return validate.out_of_range(table(spark, d, "probes").where("meta is not null"), "row_id", F.coalesce("meta.s_transition_support", F.array().cast("array<bigint>")), F.col("meta.n_turns"))


def violations_subset(spark, d):
    return validate.not_subset(table(spark, d, "probes").where("meta is not null"), "row_id", F.array_compact("meta.s_origin"), F.array_compact("meta.s_transition_support"))


def violations_rules(spark, d):
    return validate.broken(table(spark, d, "probes"), "row_id", {"chars_match": F.col("compressed_text_chars_used") == F.length("compressed_text_used"), "kept_within": F.col("meta.k_turns") <= F.col("meta.n_turns"), "has_gold": F.col("gold").isNotNull()})


def violations_missing(spark, d):
    return validate.missing_keys(table(spark, d, "probes").select(F.col("request_id").alias("id")).where("id is not null"), table(spark, d, "reused_raw_answers").where("id is not null"), "id")


def embedding_cosine(spark, d):
    """Cosine of every vector with the mean of its label; sums combine before they move."""
    v = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    parts = v.select("vec_id", "label", F.posexplode("v").alias("i", "x"))
    mean = parts.groupBy("label", "i").agg(F.avg("x").alias("m"))
    both = parts.join(F.broadcast(mean), ["label", "i"]) if mean.limit(200_001).count() <= 200_000 else parts.join(mean, ["label", "i"])
    agg = both.groupBy("vec_id").agg(F.sum(F.col("x") * F.col("m")).alias("dot"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("m") * F.col("m")).alias("mm"))
    return agg.select("vec_id", F.round(F.col("dot") / (F.sqrt("xx") * F.sqrt("mm") + 1e-9), 4).alias("cosine"))


def jsonl_roundtrip(spark, d):
    """Labels written as JSON lines and read under their schema again."""
    rows = table(spark, d, "update_labels").select("dialogue_id", "slot", "old_value", "new_value", "n_turns")
    path = shared_folder(spark, "jsonl")
    files.write_jsonl(rows, path)
    return files.read_jsonl(spark, path, "dialogue_id string, slot string, old_value string, new_value string, n_turns int")


def append_resume(spark, d):
    """An interrupted append run again: every key once in the sink."""
    rows = table(spark, d, "update_labels").select("dialogue_id", "slot").dropDuplicates(["dialogue_id"])
    path, schema = shared_folder(spark, "append"), "dialogue_id string, slot string"
    files.append_new(rows.where(F.crc32("dialogue_id") % 2 == 0), path, "dialogue_id", schema)
    files.append_new(rows, path, "dialogue_id", schema)
    return spark.read.schema(schema).parquet(path)


def file_manifest(spark, d):
    """Name, size and SHA-256 of every file of the folder's tables."""
    return files.manifest(spark, d)


def stream_resumable_scores(spark, d):
    """Answers read and scored as a stream of files, each key once, equal to the batch result."""
    source = table(spark, d, "reused_raw_answers")
    stream = resumable.file_stream(spark, f"{d}/reused_raw_answers.parquet", source.schema)
    sink = shared_folder(spark, "stream")

    def score(batch):
        fields = batch.select("answer_no", "error", json_fields()("reader_output_text").alias("f"))
        return fields.select("answer_no", F.length(F.coalesce("f.dict.value", F.lit(""))).alias("n_chars"), F.col("f.dict.ok").cast("int").alias("parsed"), F.col("error").isNotNull().cast("int").alias("err"))

    resumable.run_to_end(stream, score, "answer_no", sink, shared_folder(spark, "marks"))
    return spark.read.parquet(sink).select("answer_no", "n_chars", "parsed", "err")


def stream_latest_values(spark, d):
    """Latest event value by user and day from a stream with a watermark, run to its end."""
    source = table(spark, d, "events").schema
    stream = resumable.file_stream(spark, f"{d}/events.parquet", source)
    out = resumable.latest_values(stream, "user_id", "ts", "value", "1 hour", "1 day")
    sink = shared_folder(spark, "latest")
    resumable.replace_updates(out, ["start", "user_id"], sink, shared_folder(spark, "marks"))
    rows = resumable.latest_updates(spark, sink, ["start", "user_id"], "start timestamp, user_id bigint, value double, n bigint")
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "user_id", F.round("value", 4).alias("value"), "n")


def mock_reader_scores(spark, d):
    """Probes read by the extractive stand-in and scored: method, n, n_abstain, strict rate."""
    probes = table(spark, d, "probes").where("probe_type = 'P3'")
    read = readers.answer(probes, "row_id", "prompt_user", "extractive")
    value = F.get_json_object("text", "$.value")
    rows = read.join(probes.select("row_id", "method", "gold"), "row_id")
    judged = rows.select("method", F.col("text").contains('"abstain": true').alias("declared"), F.coalesce(strings.values_match(value, "gold"), F.lit(False)).cast("int").alias("ok"))
    return judged.groupBy("method").agg(F.count("*").alias("n"), F.count_if("declared").alias("n_abstain"), F.round(F.avg("ok"), 4).alias("strict"))


def star_method_cells(spark, d):
    """Cells over the star schema: revenue rates by nation and year with their share of the year."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    per = li.groupBy("l_orderkey").agg(F.sum("revenue").alias("revenue"))
    rows = o.join(per, o.o_orderkey == per.l_orderkey).join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    return rows.groupBy("n_name", "year").agg(F.count("*").alias("n_orders"), F.round(F.sum("revenue"), 0).alias("revenue"))


def binomial_table(spark, d):
    """Exact test values for a grid of discordant counts."""
    grid = spark.range(0, 12).select(F.col("id").alias("b")).crossJoin(spark.range(0, 12).select(F.col("id").alias("c")))
    return grid.where("b + c > 0").select("b", "c", F.round(stats.mcnemar(F.col("b"), F.col("c")), 6).alias("p"))


def dataset_names(spark, d):
    return table(spark, d, "probes").groupBy(dataset_name("dataset").alias("dataset")).agg(F.count("*").alias("n"))


_ALL = (
    normalize_values, alias_equivalence, alias_spellings, normalize_task, humanize_slots, content_tokens, char_cap, prompt_parts, question_labels, replace_context, left_truncation, hash_ids, answer_variants, numeric_equivalence,
    split_answers, speaker_labels, word_label_means, prompt_render, resume_anti_join, request_dedup_expand, request_fingerprints, merge_replace, strict_join_violations, coverage_split, keep_list, labelled_probes, complete_conditions,
    key_set_equality, speaker_multisets, violations_unique, violations_range, violations_subset, violations_rules, violations_missing, embedding_cosine, jsonl_roundtrip, append_resume, file_manifest, stream_resumable_scores,
    stream_latest_values, mock_reader_scores, star_method_cells, binomial_table, dataset_names,
)
QUERIES = {f.__name__: f for f in _ALL}

_ALIASED = "lower(value_text)"
for _old, _new in strings.ALIASES:
    _ALIASED = f"regexp_replace({_ALIASED}, '\\b{_old}\\b', '{_new}', 'g')"


def _toks(x: str, stop) -> str:
    from .scoring import toks

    return f"array_to_string(list_sort({toks(x, stop)}), ' ')"


_LABELS = "lower(regexp_replace(trim(q), '\\?+$', ''))"
_SHORT = "case " + " ".join(f"when starts_with(t, '{p.replace(chr(39), chr(39) * 2)}') then substr(t, {len(p) + 1})" for p in strings.SLOT_PREFIXES) + " else t end"
_SLOTS = "case when contains(lower(slot),'time') then 'Time' when contains(lower(slot),'date') or contains(lower(slot),'day') then 'Date' when regexp_matches(lower(slot),'city|location|origin|destination|area|place|name|theater|hotel|restaurant|departure|dest') then 'Place and name' else 'Other' end"
_LEAD = "(?i)^(?:can you |could you |please |i''?d like to |i want to |i need to |i''?m looking to )"
_TASK = "lower(trim(regexp_replace(regexp_replace(trim(coalesce({0},'')), '" + _LEAD + "', ''), '[?.!]+\\s*$', '')))"

_STREAMED = """with r as (select answer_no, error, regexp_replace(coalesce(reader_output_text,''), '^\\s+|\\s+$', '', 'g') x from reused_raw_answers), r1 as (select *, regexp_extract(x, '(?s)(\\{[^{]*\\})[^{}]*$', 1) y from r), r2 as (select *, case when json_valid(x) then x end w, case when json_valid(y) then y end y1 from r1),
 r3 as (select *, case when w is not null then case when json_type(w) = 'OBJECT' then w end when json_type(y1) = 'OBJECT' then y1 end j from r2) select answer_no, coalesce(length(json_extract_string(j, '$.value')), 0)::int n_chars, (j is not null)::int parsed, (error is not null)::int err from r3"""
ORACLE = {
    "normalize_values": f"select row_id, {nv('new_value')} norm, {nv('gold')} norm_gold from probes",
    "alias_equivalence": f"with q as (select row_id, a, b, trim(split_part(a, ',', 1)) ha, trim(split_part(b, ',', 1)) hb from (select row_id, {nv('old_value')} a, {nv('new_value')} b from probes)) select row_id, (a <> '' and b <> '' and (a = b or (ha <> '' and ha = hb) or (least(length(ha), length(hb)) >= 3 and (contains(ha, hb) or contains(hb, ha))))) same from q",
    "alias_spellings": f"select value_id, {_ALIASED} spelled from slot_values",
    "normalize_task": f"select dialogue_id, {_TASK.format('goal_first_sentence')} task, {_TASK.format('goal_text')} goal from update_labels",
    "humanize_slots": f"select value_id, lower(trim(regexp_replace(slot, '[_-]+', ' ', 'g'))) as label, {_SLOTS} slot_group from slot_values",
    "content_tokens": "select dialogue_id, turn_id, loaded_at, " + _toks("text", strings.STOP_GOAL) + " goal_tokens, " + _toks("text", strings.STOP_VALUE) + " value_tokens, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(coalesce(text,'')),'[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}]') || list_filter(regexp_extract_all(lower(coalesce(text,'')),'[a-z0-9]+'), lambda w: length(w) >= 2 and w not in (" + ",".join(f"'{w}'" for w in strings.STOP_CJK) + ")))), ' ') cjk, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(coalesce(text,'')),'[a-z0-9]+') || regexp_extract_all(lower(coalesce(text,'')),'[가-힣]+'))), ' ') hangul from turns",
    "char_cap": "select doc_id, case when length(text) > 120 then rtrim(substr(text, 1, 120)) || ' [...]' else text end capped from documents",
    "prompt_parts": "select row_id, case when instr(prompt_user, chr(10) || chr(10) || 'Question:') > 0 then substr(prompt_user, 1, instr(prompt_user, chr(10) || chr(10) || 'Question:') - 1) else prompt_user end as context, case when instr(prompt_user, chr(10) || chr(10) || 'Question:') > 0 then substr(prompt_user, instr(prompt_user, chr(10) || chr(10) || 'Question:')) else '' end as question from probes",
    "question_labels": f"with a as (select row_id, regexp_extract(prompt_user, '\\n\\nQuestion: ([^\\n]*)', 1) q from probes where prompt_user is not null), b as (select row_id, {_LABELS} t from a), c as (select row_id, {_SHORT} s from b) select row_id, array_to_string(regexp_extract_all(s, '[A-Za-z0-9'']+')[1:5], ' ') as label from c",
    "replace_context": "select row_id, split_part(compressed_text_used, chr(10), -1) || substr(prompt_user, length(compressed_text_used) + 1) as prompt from probes where prompt_user is not null and compressed_text_used is not null and starts_with(prompt_user, compressed_text_used)",
    "left_truncation": "select row_id, array_to_string(case when len(t) <= 24 then t else t[-24:] end, ' ') kept from (select row_id, regexp_extract_all(prompt_user, '\\S+') t from probes where prompt_user is not null)",
    "hash_ids": "select row_id, substr(sha256(prompt_user), 1, 16) as template, substr(sha1(concat_ws('|', dialogue_id, method, probe_type)), 1, 16) task_uid, ('0x' || substr(sha256('42|' || dialogue_id), 9, 8))::bigint seed32 from probes where prompt_user is not null",
    "numeric_equivalence": "select row_id, (not regexp_matches(old_value, '\\p{L}') and len(regexp_extract_all(old_value, '\\d+(?:\\.\\d+)?')) > 0 and regexp_extract_all(old_value, '\\d+(?:\\.\\d+)?') = regexp_extract_all(new_value, '\\d+(?:\\.\\d+)?')) same from probes where old_value is not null and new_value is not null",
    "split_answers": "with a as (select row_id, length(gold) - length(replace(gold, ';', '')) = 1 one, trim(split_part(gold, ';', 1)) g, case when contains(gold, ';') then substr(gold, instr(gold, ';') + 1) else gold end r from probes where gold is not null), b as (select *, trim(substr(r, 1, instr(r, ':') - 1)) s, trim(substr(r, instr(r, ':') + 1)) v from a), c as (select *, one and instr(r, ':') > 0 and g <> '' and s <> '' and v <> '' ok from b) select row_id, case when ok then g end goal, case when ok then s end slot, case when ok then v end as value from c",
    "speaker_labels": f"select {SPEAKER} as role, coalesce(speaker, '(none)') as given, count(*) n from turns group by 1, 2",
    "word_label_means": "with w as (select value_id, string_split(value_text, ' ') ws from slot_values) select value_id, round(list_avg(list_transform(ws, lambda x: (length(x) > 4)::int::double)), 6) mean, round(coalesce(list_avg(list_transform(regexp_extract_all(array_to_string(list_transform(ws, lambda x: x || ' ' || (length(x) > 4)::int), ' '), '\\d+(?:\\.\\d+)?'), lambda x: x::double)), 0), 6) as legacy from w",
    "prompt_render": "select dialogue_id, slot_human, t as probe_type, case t when 'P1' then 'What did the user first ask for?' when 'P3' then 'Which ' || slot_human || ' holds at the end?' else 'Name the first request and the final ' || slot_human || '.' end as question from update_labels, unnest(['P1', 'P3', 'P1_LATE']) u(t)",
    "resume_anti_join": "select row_id, request_id as id from probes where request_id is not null and request_id not in (select id from reused_raw_answers where error is null and id is not null)",
    "request_dedup_expand": "with c as (select id, min(reader_output_text) a, count(*) n from reused_raw_answers where reader_output_text is not null and id is not null group by 1 having min(reader_output_text) = max(reader_output_text)) select row_id, a as answer, coalesce(n, 0) n_cached from probes left join c on request_id = id",
    "request_fingerprints": "select count(*) n_rows, count(distinct (coalesce(prompt_system, '∅'), coalesce(prompt_user, '∅'))) n_requests from probes",
    "merge_replace": "select row_id, method, case when method = 'recency' then upper(domain) else domain end as domain, coalesce(method = 'recency', false) replaced from probes",
    "strict_join_violations": "with l as (select request_id id, count(*) n from probes where request_id is not null group by 1), r as (select id, count(*) n from reused_raw_answers where id is not null group by 1), q as (select l.n nl, r.n nr from l full join r using (id)) select kind, count(*) n_keys from (select unnest(list_filter([case when nl > 1 then 'duplicate_left' end, case when nr > 1 then 'duplicate_right' end, case when nl is null then 'unknown' end, case when nr is null then 'missing' end], lambda x: x is not null)) as kind from q) group by 1",
    "coverage_split": "select case when exists (select 1 from reused_raw_answers a where a.id = p.id and provenance = 'fresh_response') then 'cached' else 'missing' end as state, count(*) n_keys from (select distinct request_id id from probes where request_id is not null) p group by 1",
    "keep_list": "select method, count(*) n from probes where dialogue_id in (select dialogue_id from update_labels where is_final_slot_update and n_turns >= 12) group by 1",
    "complete_conditions": "select dialogue_id from probes where method in ('full_context', 'recency') group by 1 having count(distinct method) = 2",
    "key_set_equality": "select side, count(*) n from (select 'probes' side, dialogue_id from probes where dialogue_id not in (select dialogue_id from update_labels where dialogue_id is not null) group by all union all select 'labels', dialogue_id from update_labels where dialogue_id not in (select dialogue_id from probes where dialogue_id is not null) group by all) group by 1",
    "speaker_multisets": f"with t as (select dialogue_id, turn_id, {SPEAKER} as sp from (select *, row_number() over (partition by dialogue_id, turn_id order by loaded_at desc, text desc) rn from turns where dialogue_id is not null and turn_id is not null) where rn = 1) select dialogue_id, count(*) filter (where turn_id % 4 < 2 and sp = 'USER') = count(*) filter (where turn_id % 4 >= 2 and sp = 'USER') as equal from t group by 1 having count(*) % 4 = 0",
    "violations_unique": "select dialogue_id, method, probe_type, count(*) n from probes group by 1, 2, 3 having count(*) > 1",
    "violations_range": "select row_id, entry from (select row_id, unnest(meta.s_transition_support) as entry, meta.n_turns n from probes where meta is not null) where entry is not null and (entry < 0 or entry >= n)",
    "violations_subset": "select row_id, extra::int extra from (select row_id, len(list_filter(list_distinct(list_filter(coalesce(meta.s_origin,[]), lambda x: x is not null)), lambda x: not list_contains(coalesce(meta.s_transition_support,[]), x))) extra from probes where meta is not null) where extra > 0",
    "violations_rules": "select row_id, rule from (select row_id, unnest(list_filter([case when compressed_text_chars_used <> length(compressed_text_used) then 'chars_match' end, case when meta.k_turns > meta.n_turns then 'kept_within' end, case when gold is null then 'has_gold' end], lambda x: x is not null)) as rule from probes)",
    "violations_missing": "select distinct request_id as id from probes where request_id is not null and request_id not in (select id from reused_raw_answers where id is not null)",
    "embedding_cosine": "with p as (select vec_id, label, generate_subscripts(embedding, 1) i, unnest(embedding)::double x from embeddings), m as (select label, i, avg(x) m from p group by 1, 2) select vec_id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m)) + 1e-9), 4) cosine from p join m using (label, i) group by 1",
    "jsonl_roundtrip": "select dialogue_id, slot, old_value, new_value, n_turns from update_labels",
    "append_resume": "select dialogue_id, slot from update_labels",
    "stream_resumable_scores": _STREAMED,
    "stream_latest_values": "select strftime(ts, '%Y-%m-%d') as day, user_id, round(arg_max(value, ts), 4) as value, count(*) n from events group by 1, 2",
    "star_method_cells": "with per as (select l_orderkey, sum(l_extendedprice * (1 - l_discount)) r from lineitem group by 1) select n_name, year(o_orderdate)::int as year, count(*) n_orders, round(sum(r), 0) revenue from orders join per on o_orderkey = l_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2",
    "binomial_table": "select b, c, round(least(1.0::double, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: factorial((b + c)::int)::double / (factorial(i::int) * factorial((b + c - i)::int))::double)) / pow(2.0::double, b + c)), 6) p from range(0, 12) t(b), range(0, 12) u(c) where b + c > 0",
    "labelled_probes": "select slot as label_slot, p.method, count(*) n from probes p join update_labels using (dialogue_id) group by 1, 2".replace("slot as", "update_labels.slot as"),
    "dataset_names": f"select {DATASET.format('dataset')} as dataset, count(*) n from probes group by 1",
}
