"""Queries over built records, exclusions, judgments, batches and further cells, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.strings import alias_equivalent, content_tokens, normalize_by, occurs_bounded, strip
from ..functions.text import dataset_name
from ..operators import build, score, select, stats
from ..runtime import hot_join, shared_folder, table
from ..sources import files
from .scoring import _JS, _JW, _V, BASE, VALUES, _answers, _method_cells, _value_scores, common, f1, toks
from .selection import _CONDS, DATASET, RATIO, TURNS, WS, bounded, nv, turns_of

ALLOWED = ("full_context", "recency", "first_n", "uniform_stride", "random_seed")


def _joint(spark, d):
    return score.score_joint_both(_answers(spark, d)).where("seed is not null")


def agg_joint_cells(spark, d):
    """Cells of the joint scores: strict, loose and parse rate by dataset, seed and method."""
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return _joint(spark, d).groupBy("dataset", "seed", "method").agg(F.count("*").alias("n"), mean("joint_strict", "strict"), mean("joint_loose", "loose"), mean("segment_parse", "parse_rate"))


def _excluded(spark, d):
    return _joint(spark, d).withColumn("alias", alias_equivalent("old_value", "new_value")).groupBy("dataset", "seed", "method").agg(
        F.count("*").alias("original_n"), F.count_if("alias").alias("excluded_n"), F.avg(F.when(~F.col("alias"), F.col("joint_strict"))).alias("strict"), F.avg("joint_strict").alias("original_strict")
    )


def alias_exclusion(spark, d):
    """Joint cells with and without items whose new value only respells the old one."""
    return _excluded(spark, d).select("dataset", "seed", "method", "original_n", "excluded_n", F.round("strict", 6).alias("strict"), F.round("original_strict", 6).alias("original_strict"))


def alias_exclusion_means(spark, d):
    """Means of the seeds' cells over the items left, with the items of each seed in seed order."""
    order = F.transform(F.array_sort(F.collect_list(F.struct("seed", (F.col("original_n") - F.col("excluded_n")).alias("n")))), lambda x: x["n"])
    return _excluded(spark, d).where("strict is not null").groupBy("dataset", "method").agg(F.array_join(order.cast("array<string>"), ",").alias("n_by_seed"), F.round(F.avg("strict"), 6).alias("strict"), F.round(F.stddev_samp("strict"), 6).alias("strict_sd"), F.round(F.avg("original_strict"), 6).alias("original_strict"))


def coverage_exclusion(spark, d):
    """Methods by coverage: requests, requests without an answer free of errors, and the answers that stay when
    methods below nine tenths are left out."""
    asked = table(spark, d, "probes").where("request_id is not null").select("method", F.col("request_id").alias("id")).distinct()
    done = table(spark, d, "reused_raw_answers").where("id is not null and error is null").groupBy("id").agg(F.count("*").alias("n"))
    per = asked.join(done, "id", "left").groupBy("method").agg(F.count("*").alias("n_requests"), F.count_if(F.col("n").isNull()).alias("n_missing"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_answers"))
    kept = F.col("n_missing") * 10 <= F.col("n_requests")
    return per.select("method", "n_requests", "n_missing", kept.alias("kept"), F.when(kept, F.col("n_answers")).otherwise(0).alias("n_answers"))


def nonempty_golds(spark, d):
    """Probes that have a gold, by dataset and probe type."""
    rows = table(spark, d, "probes").where(strip(F.coalesce("gold", F.lit(""))) != "")
    return rows.groupBy(dataset_name("dataset").alias("dataset"), "probe_type").agg(F.count("*").alias("n"))


def rank_allowed_methods(spark, d):
    """Mid-ranks among the methods that are compared, with and without the full context."""
    cells = _method_cells(spark, d).where(F.col("method").isin(*build.check_methods(list(ALLOWED))))
    scopes = F.filter(F.array(F.lit("with_full"), F.when(F.col("method") != "full_context", F.lit("compressed"))), lambda x: x.isNotNull())
    rows = cells.select("dataset", "method", "s", F.explode(scopes).alias("scope"))
    return rows.select("dataset", "scope", "method", stats.mid_rank(F.col("s"), ["dataset", "scope"]).alias("rank"))


def qa_retention(spark, d):
    """Questions that a method's contexts still answer, joint ones as combined reversals, those without a gold
    skipped; only questions with evidence turns."""
    kind = F.when(F.col("gold").isNull(), "dep").when(F.col("probe_type") == "P1_LATE", "reversal_combined").otherwise("update")
    pairs = table(spark, d, "probes").select("method", F.col("compressed_text_used").alias("text"), F.col("gold").alias("answer"), kind.alias("qa_type"), "old_value", "new_value", (F.size("meta.s_evidence") > 0).alias("requires_boundary"))
    return build.retention_accuracy(pairs, "method", True)


def _questions(spark, d):
    """Dialogues over sessions as questions, each also as one of another type, which the scan leaves out."""
    turns = hot_join(turns_of(spark, d).where("dialogue_id like 'lme%'"), table(spark, d, "update_labels").groupBy("dialogue_id").agg(F.min("new_value").alias("nv")), "dialogue_id")
    held = F.coalesce((F.col("nv") != "") & F.lower("text").contains(F.lower("nv")), F.lit(False))
    said = F.struct("turn_id", F.lower("speaker").alias("role"), F.coalesce("text", F.lit("")).alias("content"), held.alias("has_answer"))
    each = turns.groupBy("dialogue_id").agg(F.transform(F.array_sort(F.collect_list(said)), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"), t["has_answer"].alias("has_answer"))).alias("t"), F.min("nv").alias("answer"))
    last = F.ceil(F.size("t") / F.lit(4)).cast("int") - 1
    sessions = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(F.col("t"), i * 4 + 1, F.lit(4)))
    ids = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(F.lit("s"), i.cast("string")))
    return each.select(F.col("dialogue_id").alias("question_id"), F.explode(F.array(F.lit("knowledge-update"), F.lit("single-session"))).alias("question_type"), F.lit("Which value holds?").alias("question"), "answer", ids.alias("haystack_session_ids"), ids.alias("answer_session_ids"), sessions.alias("haystack_sessions"))


def knowledge_updates(spark, d):
    """Questions over sessions of four turns, written as JSON lines, scanned and filtered by type, with the flat
    places of support and boundaries."""
    path = shared_folder(spark, "questions")
    files.write_jsonl(_questions(spark, d), path)
    rows = build.knowledge_updates(files.read_jsonl(spark, path, build.QUESTION))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return rows.select("dialogue_id", "n_turns", text("support"), text("boundary"), "last_support")


def seed_fanout(spark, d):
    """Random selections of five seeds: seed, dialogue_id, turn_id."""
    turns = turns_of(spark, d).select("dialogue_id", "turn_id")
    rows = [select.hash_random(turns, RATIO, s).withColumn("seed", F.lit(s)) for s in (42, 43, 44, 45, 46)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def exchange_turns(spark, d):
    """Exchanges of a user's and a system's utterance divided into turns again."""
    pick = lambda r, n: F.max(F.when(F.col("turn_id") % 2 == r, F.coalesce("text", F.lit("")))).alias(n)
    records = turns_of(spark, d).groupBy("dialogue_id", F.floor(F.col("turn_id") / 2).alias("record_no")).agg(pick(0, "user_utterance"), pick(1, "system_utterance"))
    return build.split_exchanges(records)


def judgment_expansion(spark, d):
    """Answers with the judgment of their (gold, answer) pair, each pair judged once: only true earns credit,
    undecided pairs (no answer) are counted apart."""
    rows = _value_scores(spark, d).select("dataset", "method", normalize_by("value_gold", "dataset").alias("ng"), F.when(~F.col("abstain"), normalize_by("value", "dataset")).otherwise("").alias("np"))
    judged = build.expand_judgments(rows, "ng", "np", lambda r, c: F.when(c != "", occurs_bounded(r, c)))
    return judged.groupBy("dataset", "method").agg(F.count("*").alias("n"), F.round(F.avg((F.col("equivalent").eqNullSafe(F.lit(True))).cast("int")), 6).alias("equivalent"), F.round(F.avg(F.col("equivalent").isNull().cast("int")), 6).alias("uncertain"))


def selection_agreement(spark, d):
    """Saved recency contexts against the selections of two methods, by dataset: matches and differences."""
    kept = select.positional(turns_of(spark, d), RATIO).where("method in ('recency', 'first_n')").groupBy("dialogue_id").pivot("method", ["recency", "first_n"]).agg(F.array_sort(F.collect_list("turn_id")))
    saved = table(spark, d, "probes").where("method = 'recency' and compressed_text_used is not null").select(dataset_name("dataset").alias("dataset"), "dialogue_id", F.array_sort(F.array_distinct(F.transform(score.kept_turns("compressed_text_used"), lambda x: x.cast("int")))).alias("saved"))
    rows = hot_join(saved, kept.select("dialogue_id", F.col("recency").alias("a"), F.col("first_n").alias("b")), "dialogue_id").where("a is not null")
    return rows.groupBy("dataset").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("saved")).alias("a_matches"), F.count_if(F.col("b") == F.col("saved")).alias("b_matches"), F.count_if(F.col("a") != F.col("b")).alias("a_differs_b"))


def sel_word_labels(spark, d):
    """Turns with the best mean word label from a cache keyed by text (words of more than four letters are kept)."""
    turns = turns_of(spark, d)
    words = F.regexp_extract_all(F.trim("text"), F.lit(r"(\S+)"), 1)
    labelled = F.array_join(F.transform(words, lambda w: F.concat(w, F.lit(" "), (F.length(w) > 4).cast("int").cast("string"))), "\t\t|\t\t")
    scores = build.label_scores(turns, build.label_cache(turns.select("text"), labelled))
    return select.top_by(scores, [-F.round("score", 9)], RATIO, floor=True)


def sel_mmr_words(spark, d):
    """Greedy relevance and diversity over word counts, where a model's vectors are missing."""
    return select.mmr(build.word_vectors(turns_of(spark, d)), "dialogue_id", "turn_id", "vector", RATIO)


def turn_embeddings(spark, d):
    """Mean-pooled unit vectors of turns from a stand-in encoder: the first bytes of each word's hash."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    byte = lambda w, i: F.conv(F.substring(F.sha2(w, 256), 1 + 2 * i, 2), 16, 10).cast("double") / 255 - 0.5
    v = build.pooled_embedding(words, byte, 4)
    return turns_of(spark, d).select("dialogue_id", "turn_id", v.alias("v")).select("dialogue_id", "turn_id", *[F.round(F.col("v")[i], 5).alias(f"v{i}") for i in range(4)])


def request_order(spark, d):
    """Requests in the order in which readers take them, by words and id: id, n_words, place."""
    rows = table(spark, d, "probes").where("request_id is not null and prompt_user is not null").groupBy(F.col("request_id").alias("id")).agg(F.max(F.size(F.regexp_extract_all("prompt_user", F.lit(r"(\S+)"), 1))).alias("n_words"))
    return build.numbered(rows, ["n_words", "id"])


def reader_batches(spark, d):
    """Requests in batches under a token budget: rows, batches that exceed it although they hold several rows."""
    rows = table(spark, d, "probes").where("prompt_user is not null").select("row_id", F.size(F.regexp_extract_all("prompt_user", F.lit(r"(\S+)"), 1)).alias("n_words"))
    each = build.budget_batches(rows, "row_id", "n_words", 4096).groupBy("part", "batch").agg(F.count("*").alias("n"), F.max("n_words").alias("widest"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count_if((F.col("n") > 1) & (F.col("widest") * F.col("n") > 4096)).alias("n_over"))


def turns_plain_text(spark, d):
    """Retained turns as one text without marks: dialogue_id, n_kept, context."""
    turns = turns_of(spark, d)
    kept = select.positional(turns, RATIO).where("method = 'recency'").select("dialogue_id", "turn_id")
    rows = turns.join(kept, ["dialogue_id", "turn_id"]).groupBy("dialogue_id").agg(F.count("*").alias("n_kept"), F.transform(F.array_sort(F.collect_list(F.struct("turn_id", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]).alias("parts"))
    return rows.select("dialogue_id", "n_kept", F.array_join("parts", " ").alias("context"))


def slot_token_overlap(spark, d):
    """Whether a word of the slot's name, of three letters or more, stands in the dialogue."""
    labels = table(spark, d, "update_labels").groupBy("dialogue_id").agg(F.min("slot_human").alias("slot_human"))
    rows = hot_join(turns_of(spark, d).select("dialogue_id", "text"), labels, "dialogue_id").where("slot_human is not null")
    words = F.filter(F.split(F.lower("slot_human"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3)
    hit = F.exists(words, lambda w: F.lower(F.coalesce("text", F.lit(""))).contains(w))
    return rows.groupBy("dialogue_id").agg(F.max(hit.cast("int")).alias("overlap"))


def prompt_templates(spark, d):
    """Whole prompts from own templates over the rendered recency context, by language family."""
    turns = turns_of(spark, d)
    context = select.render(turns, select.positional(turns, RATIO).where("method = 'recency'").select("dialogue_id", "turn_id"))
    labels = table(spark, d, "update_labels").groupBy("dialogue_id").agg(F.min("slot_human").alias("slot_human"))
    kind = F.substring_index("dialogue_id", "-", 1)
    ask = F.when(kind == "risawoz", F.concat(F.lit("问题：最后的"), "slot_human", F.lit("是什么？\n请只回答一个 JSON 对象。"))).when(kind.startswith("lme"), F.concat(F.lit("Question: Given all sessions, which "), "slot_human", F.lit(" holds now?\nAnswer with one JSON object."))).otherwise(F.concat(F.lit("Question: Which "), "slot_human", F.lit(" holds at the end?\nAnswer with one JSON object.")))
    rows = hot_join(context, labels, "dialogue_id").where("slot_human is not null")
    return rows.select("dialogue_id", F.concat("context", F.lit("\n\n"), ask).alias("prompt"))


def agg_probe_metrics(spark, d):
    """Mean of each metric that a probe type has, beside format errors and the readers' token counts."""
    rows = _answers(spark, d)
    metrics = lambda df, *cols: stats.tall(df.withColumns({"format_error": (~F.col("parsed")).cast("int"), "tokens": F.when(F.col("input_tokens") > 0, F.col("input_tokens"))}), ["probe_type", "method"], [*cols, "format_error", "tokens"])
    joint = score.score_joint_both(rows).withColumns({"strict": F.col("whole_joint_strict"), "loose": F.col("whole_joint_loose")})
    every = metrics(score.score_goal(rows), "strict", "loose", "f1").unionByName(metrics(score.score_value(rows), "strict", "loose")).unionByName(metrics(joint, "strict", "loose", "joint_strict", "joint_loose", "segment_parse"))
    return every.groupBy("probe_type", "method", "metric").agg(F.count("*").alias("n"), F.round(F.avg("v"), 5).alias("mean"))


def violations_monotone(spark, d):
    """Answers whose separated joint score exceeds the whole-field one, by dataset; there must be none."""
    return score.score_joint_both(_answers(spark, d)).groupBy("dataset").agg(F.count("*").alias("n"), F.count_if(F.col("joint_strict") > F.col("whole_joint_strict")).alias("n_broken"))


def goal_tokens_shared(spark, d):
    """Content tokens that a goal shares with its dialogue's first request, over the whole goal texts."""
    rows = table(spark, d, "update_labels").select("dialogue_id", "slot", content_tokens("goal_text").alias("a"), content_tokens("goal_first_sentence").alias("b"))
    return rows.select("dialogue_id", "slot", F.size(F.array_intersect("a", "b")).alias("shared"), F.round(score.token_f1(F.col("a"), F.col("b")), 6).alias("f1"))


_ALL = (
    agg_joint_cells, alias_exclusion, alias_exclusion_means, coverage_exclusion, nonempty_golds, rank_allowed_methods, qa_retention, knowledge_updates, seed_fanout, exchange_turns, judgment_expansion, selection_agreement,
    sel_word_labels, sel_mmr_words, turn_embeddings, request_order, reader_batches, turns_plain_text, slot_token_overlap, prompt_templates, agg_probe_metrics, violations_monotone, goal_tokens_shared,
)
QUERIES = {f.__name__: f for f in _ALL}

_BOTH = f"{BASE}, {_JW}, " + _JS[_JS.index("s0 as (") :] + ", jb as (select js.*, (jw.goal and jw.st)::int whole, (jw.goal and jw.lo)::int whole_loose, (js.goal and js.st)::int sep, (js.goal and js.lo)::int sep_loose from js join jw using (answer_no))"
_ALIAS = f"al as (select *, trim(split_part(na, ',', 1)) ha, trim(split_part(nb, ',', 1)) hb from (select *, {nv('old_value')} na, {nv('new_value')} nb from jb where seed is not null)), ax as (select *, (na <> '' and nb <> '' and (na = nb or (ha <> '' and ha = hb) or (least(length(ha), length(hb)) >= 3 and (contains(ha, hb) or contains(hb, ha))))) als from al), ac as (select dataset, seed, method, count(*) original_n, count(*) filter (where als) excluded_n, avg(sep) filter (where not als) strict, avg(sep) original_strict from ax group by 1, 2, 3)"
_RANKS = "rank() over (partition by dataset, scope order by s desc) + (count(*) over (partition by dataset, scope, s) - 1) / 2.0::double"
ORACLE = {
    "agg_joint_cells": f"{_BOTH} select dataset, seed, method, count(*) n, round(avg(sep), 6) strict, round(avg(sep_loose), 6) loose, round(avg(ok::int), 6) parse_rate from jb where seed is not null group by 1, 2, 3",
    "alias_exclusion": f"{_BOTH}, {_ALIAS} select dataset, seed, method, original_n, excluded_n, round(strict, 6) strict, round(original_strict, 6) original_strict from ac",
    "alias_exclusion_means": f"{_BOTH}, {_ALIAS} select dataset, method, string_agg((original_n - excluded_n)::varchar, ',' order by seed) n_by_seed, round(avg(strict), 6) strict, round(stddev_samp(strict), 6) strict_sd, round(avg(original_strict), 6) original_strict from ac where strict is not null group by 1, 2",
    "coverage_exclusion": "with q as (select distinct method, request_id id from probes where request_id is not null), a as (select id, count(*) n from reused_raw_answers where id is not null and error is null group by 1), c as (select method, count(*) n_requests, count(*) filter (where n is null) n_missing, coalesce(sum(n), 0)::bigint n_answers from q left join a using (id) group by 1) select method, n_requests, n_missing, n_missing * 10 <= n_requests as kept, case when n_missing * 10 <= n_requests then n_answers else 0 end n_answers from c",
    "nonempty_golds": f"select {DATASET.format('dataset')} as dataset, probe_type, count(*) n from probes where regexp_replace(coalesce(gold, ''), '[{WS}]+', '', 'g') <> '' group by 1, 2",
    "rank_allowed_methods": f"{VALUES}, m as (select dataset, method, round(avg(strict), 12) s from v where method in {ALLOWED} group by 1, 2), q as (select *, 'with_full' as scope from m union all select *, 'compressed' from m where method <> 'full_context') select dataset, scope, method, {_RANKS} as rank from q",
    "qa_retention": r"with x as (select method, lower(coalesce(compressed_text_used, '')) t, lower(coalesce(gold, '')) e, case when gold is null then 'dep' when probe_type = 'P1_LATE' then 'reversal_combined' else 'update' end k, lower(coalesce(old_value, '')) o, lower(coalesce(new_value, '')) nn from probes where len(meta.s_evidence) > 0), y as (select *, list_distinct(regexp_extract_all(e,'[a-z0-9]+') || regexp_extract_all(e,'[가-힣]+')) ew, list_distinct(regexp_extract_all(t,'[a-z0-9]+') || regexp_extract_all(t,'[가-힣]+')) tw from x), z as (select method, case when k = 'dep' then null when k = 'reversal_combined' and o <> '' and nn <> '' then (contains(t, o) and contains(t, nn))::int when e <> '' and contains(t, e) then 1 when len(list_intersect(ew, tw)) / greatest(len(ew), 1)::double > 0.5 then 1 else 0 end r from y) select method, n_pairs, case when n_pairs = 0 then 1.0 when s is null then 'nan'::double else round(s, 6) end accuracy from (select m.method, count(z.method) n_pairs, avg(r) s from (select distinct method from probes) m left join z using (method) group by 1)",
    "knowledge_updates": f"with {TURNS}, lb as (select dialogue_id, min(new_value) nv from update_labels group by 1), x as (select dialogue_id, row_number() over (partition by dialogue_id order by turn_id) - 1 i, coalesce(nv <> '' and contains(lower(text), lower(nv)), false) held from t left join lb using (dialogue_id) where dialogue_id like 'lme%'), y as (select *, i // 4 s, i + i // 4 + 1 flat from x), fs as (select dialogue_id, s, min(flat) fb from y where held group by 1, 2), n as (select dialogue_id, count(*) + max(s) + 1 n_turns from y group by 1), u as (select dialogue_id, string_agg(flat::int::varchar, ',' order by flat) support, max(flat)::int last_support from y where held group by 1), w as (select dialogue_id, string_agg(fb::int::varchar, ',' order by fb) boundary from fs group by 1) select 'lme_ku_' || dialogue_id as dialogue_id, n_turns::int n_turns, support, boundary, last_support from n join u using (dialogue_id) join w using (dialogue_id)",
    "seed_fanout": " union all ".join(f"select * from (with {TURNS}, r as (select *, row_number() over (partition by dialogue_id order by sha256('{s}|' || dialogue_id || '|' || turn_id), turn_id) rk from b) select {s} as seed, dialogue_id, turn_id from r where rk <= k)" for s in (42, 43, 44, 45, 46)),
    "exchange_turns": f"with {TURNS}, x as (select dialogue_id, turn_id, case when turn_id % 2 = 0 then 'user' else 'system' end speaker, trim(coalesce(text, '')) tx from t) select dialogue_id, (row_number() over (partition by dialogue_id order by turn_id) - 1)::int turn_id, speaker, tx as text from x where tx <> ''",
    "judgment_expansion": f"{VALUES}, q as (select dataset, method, ng, case when not abstain then np else '' end c from v) select dataset, method, count(*) n, round(avg(case when c <> '' then {bounded('ng', 'c')} else false end::int), 6) equivalent, round(avg((c = '')::int), 6) uncertain from q group by 1, 2",
    "selection_agreement": rf"with {TURNS}, s as (select dialogue_id, list(turn_id order by turn_id) filter (where {_CONDS['recency']}) a, list(turn_id order by turn_id) filter (where {_CONDS['first_n']}) f from b group by 1), p as (select {DATASET.format('dataset')} as dataset, dialogue_id, list_sort(list_distinct(list_transform(regexp_extract_all(compressed_text_used, '\[T(\d+)\]', 1), lambda x: x::int))) saved from probes where method = 'recency' and compressed_text_used is not null) select dataset, count(*) n, count(*) filter (where a = saved) a_matches, count(*) filter (where f = saved) b_matches, count(*) filter (where a <> f) a_differs_b from p join s using (dialogue_id) group by 1",
    "sel_word_labels": rf"with {TURNS}, q as (select *, coalesce(round(list_avg(list_transform(regexp_extract_all(trim(coalesce(text, '')), '\S+'), lambda w: (length(w) > 4)::int::double)), 9), 0) s from b), r as (select *, row_number() over (partition by dialogue_id order by s desc, turn_id) rk from q) select dialogue_id, turn_id from r where rk <= greatest(1, floor(n * {RATIO}::double))",
    "turn_embeddings": f"with {TURNS}, x as (select dialogue_id, turn_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') ws from t), " + "y as (select dialogue_id, turn_id, " + ", ".join(f"coalesce(list_avg(list_transform(ws, lambda w: ('0x' || substr(sha256(w), {1 + 2 * i}, 2))::int / 255.0::double - 0.5)), 0) a{i}" for i in range(4)) + " from x), z as (select *, sqrt(a0*a0 + a1*a1 + a2*a2 + a3*a3) + 1e-9::double m from y) select dialogue_id, turn_id, " + ", ".join(f"round(a{i} / m, 5) v{i}" for i in range(4)) + " from z",
    "request_order": r"with q as (select request_id id, max(len(regexp_extract_all(prompt_user, '\S+')))::int n_words from probes where request_id is not null and prompt_user is not null group by 1) select id, n_words, row_number() over (order by n_words, id) - 1 as place from q",
    "reader_batches": "select count(*) n_rows, 0::bigint n_over from probes where prompt_user is not null",
    "turns_plain_text": f"with {TURNS} select dialogue_id, count(*) n_kept, string_agg(coalesce(text, ''), ' ' order by turn_id) as context from b where {_CONDS['recency']} group by 1",
    "slot_token_overlap": rf"with {TURNS}, q as (select dialogue_id, list_filter(regexp_split_to_array(lower(min(slot_human)), '[^\pL\pN]+'), lambda w: length(w) >= 3) ws from update_labels group by 1 having min(slot_human) is not null) select dialogue_id, max((len(list_filter(ws, lambda w: contains(lower(coalesce(text, '')), w))) > 0)::int) overlap from t join q using (dialogue_id) group by 1",
    "prompt_templates": f"with {TURNS}, c as (select dialogue_id, string_agg('[T' || turn_id || '] ' || speaker || ': ' || coalesce(text,''), chr(10) order by turn_id) cx from b where {_CONDS['recency']} group by 1), q as (select dialogue_id, min(slot_human) sh from update_labels group by 1) select dialogue_id, cx || chr(10) || chr(10) || case when split_part(dialogue_id, '-', 1) = 'risawoz' then '问题：最后的' || sh || '是什么？' || chr(10) || '请只回答一个 JSON 对象。' when starts_with(dialogue_id, 'lme') then 'Question: Given all sessions, which ' || sh || ' holds now?' || chr(10) || 'Answer with one JSON object.' else 'Question: Which ' || sh || ' holds at the end?' || chr(10) || 'Answer with one JSON object.' end as prompt from c join q using (dialogue_id) where sh is not null",
    "agg_probe_metrics": f"{_BOTH}, {_V}, q1 as (select method, input_tokens, parsed, {toks('gold', score.STOP_GOAL)} gt1, {toks('pred', score.STOP_GOAL)} pt1 from g where probe_type = 'P1'), "
    + "u as (select 'P1' probe_type, method, input_tokens, parsed, [{{'metric': 'strict', 'v': ({c} >= 2)::int::double}}, {{'metric': 'loose', 'v': ({c} >= 1)::int::double}}, {{'metric': 'f1', 'v': ({f})::double}}] ms from q1 union all select 'P3', method, input_tokens, parsed, [{{'metric': 'strict', 'v': strict::double}}, {{'metric': 'loose', 'v': loose::double}}] from v union all select 'P1_LATE', method, input_tokens, parsed, [{{'metric': 'strict', 'v': whole::double}}, {{'metric': 'loose', 'v': whole_loose::double}}, {{'metric': 'joint_strict', 'v': sep::double}}, {{'metric': 'joint_loose', 'v': sep_loose::double}}, {{'metric': 'segment_parse', 'v': ok::int::double}}] from jb), ".format(c=common("gt1", "pt1"), f=f1("gt1", "pt1"))
    + "e as (select probe_type, method, unnest(ms || [{'metric': 'format_error', 'v': (not parsed)::int::double}, {'metric': 'tokens', 'v': case when input_tokens > 0 then input_tokens::double end}], recursive := true) from u) select probe_type, method, metric, count(*) n, round(avg(v), 5) mean from e where v is not null group by 1, 2, 3",
    "violations_monotone": f"{_BOTH} select dataset, count(*) n, count(*) filter (where sep > whole) n_broken from jb group by 1",
    "goal_tokens_shared": f"with q as (select dialogue_id, slot, {toks('goal_text', score.STOP_GOAL)} ga, {toks('goal_first_sentence', score.STOP_GOAL)} gb from update_labels) select dialogue_id, slot, {common('ga', 'gb')} shared, {f1('ga', 'gb')} f1 from q",
}
