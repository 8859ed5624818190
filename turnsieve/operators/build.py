"""Building records: questions over sessions, exchanges as turns, word-label caches, judged pairs, batches.

Defined results: null sessions, texts and labels count as empty; questions without sessions, question, support
or boundary give no record; repeated records are kept; empty tables give no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import mean_word_label
from ..runtime import checkpointed, hot_join
from .select import ranked

#: Schema of a question over sessions.
QUESTION = "question_id string, question_type string, question string, answer string, haystack_session_ids array<string>, answer_session_ids array<string>, haystack_sessions array<array<struct<role:string,content:string,has_answer:boolean>>>"
#: Methods that select turns here, and methods that work inside a model's cache and cannot.
SELECTORS, OUTSIDE = ("full_context", "recency", "first_n", "uniform_stride", "streamingllm", "random_seed", "first_user_recent", "attention_h2o", "embedding_mmr", "llmlingua2"), ("chunkkv", "snapkv", "pyramidkv", "expected_attention")


def check_methods(names: list[str]) -> list[str]:
    """The names, if all can be planned; an error names those that belong to a reader and those unknown."""
    outside, unknown = sorted({*names} & {*OUTSIDE}), sorted({*names} - {*OUTSIDE} - {*SELECTORS})
    if outside or unknown:
        raise ValueError(f"unsupported: {outside}; unknown: {unknown}; known: {sorted(SELECTORS)}")
    return names


def knowledge_updates(questions: DataFrame) -> DataFrame:
    """Questions about updated knowledge with places in the flattened sessions: dialogue_id, n_turns, support
    and boundary places, last_support. Every session has a marker before it, which takes a place. Support is
    every turn that holds the answer, a boundary the first of them in a session named as an answer's."""
    sessions = F.coalesce("haystack_sessions", F.array().cast("array<array<struct<role:string,content:string,has_answer:boolean>>>"))
    sizes = F.transform(sessions, lambda s: F.coalesce(F.size(s), F.lit(0)))
    start = lambda i: F.aggregate(F.slice(F.col("sizes"), F.lit(1), i), F.lit(0), lambda a, n: a + n + 1) + 1
    held = lambda s, i: F.filter(F.transform(s, lambda t, j: F.when(F.coalesce(t["has_answer"], F.lit(False)), start(i) + j)), lambda x: x.isNotNull())
    rows = questions.where("question_type = 'knowledge-update' and trim(coalesce(question, '')) <> ''").withColumn("sizes", sizes).where(F.size("sizes") > 0)
    rows = rows.withColumn("held", F.transform(sessions, held)).withColumn("support", F.array_sort(F.flatten("held")))
    named = F.transform("held", lambda h, i: F.when(F.array_contains(F.coalesce("answer_session_ids", F.array().cast("array<string>")), F.try_element_at("haystack_session_ids", i + 1)) & (F.size(h) > 0), F.array_min(h)))
    rows = rows.withColumn("boundary", F.array_sort(F.filter(named, lambda x: x.isNotNull()))).where("size(support) > 0 and size(boundary) > 0")
    n_turns = F.aggregate("sizes", F.lit(0), lambda a, n: a + n + 1)
    return rows.select(F.concat(F.lit("lme_ku_"), "question_id").alias("dialogue_id"), n_turns.alias("n_turns"), "support", "boundary", F.array_max("support").alias("last_support"))


def split_exchanges(records: DataFrame) -> DataFrame:
    """Records of a user's and a system's utterance as turns: dialogue_id, turn_id, speaker, text. Blank
    utterances give no turn; turns are numbered anew in the order of the records."""
    both = F.array(F.struct(F.lit(0).alias("half"), F.lit("user").alias("speaker"), F.trim("user_utterance").alias("text")), F.struct(F.lit(1).alias("half"), F.lit("system").alias("speaker"), F.trim("system_utterance").alias("text")))
    rows = records.select("dialogue_id", "record_no", F.inline(both)).where("text <> ''")
    return ranked(rows, "dialogue_id", ["record_no", "half"]).select("dialogue_id", (F.col("rank") - 1).alias("turn_id"), "speaker", "text")


def text_key(text: Column | str) -> Column:
    return F.sha2(F.trim(F.coalesce(text, F.lit(""))), 256)


def label_cache(texts: DataFrame, labelled: Column) -> DataFrame:
    """Cache of word-label means, one row for each distinct text: key, score. `labelled` gives a text's labels."""
    return texts.where("trim(coalesce(text, '')) <> ''").select(text_key("text").alias("key"), labelled.alias("labelled")).groupBy("key").agg(F.min("labelled").alias("l")).select("key", mean_word_label("l").alias("score"))


def label_scores(turns: DataFrame, cache: DataFrame) -> DataFrame:
    """Turns with the score of their text: blank texts 0, a text that the cache lacks is an error."""
    joined = hot_join(turns.select("dialogue_id", "turn_id", F.trim(F.coalesce("text", F.lit(""))).alias("said"), text_key("text").alias("key")), cache, "key")
    missing = F.raise_error(F.lit("a turn's word labels are missing")).cast("double")
    return joined.select("dialogue_id", "turn_id", F.when(F.col("said") == "", 0.0).when(F.col("score").isNull(), missing).otherwise(F.col("score")).alias("score"))


def expand_judgments(rows: DataFrame, reference: str, candidate: str, judge) -> DataFrame:
    """Rows with the judgment of their pair: `equivalent` (true, false or null). Each distinct pair is judged
    once, by `judge` from columns reference and candidate, and expanded by its id."""
    keyed = rows.withColumn("semantic_id", F.left(F.sha2(F.to_json(F.struct(F.col(reference).alias("r"), F.col(candidate).alias("c"))), 256), F.lit(20)))
    pairs = keyed.groupBy("semantic_id").agg(F.min(reference).alias("reference"), F.min(candidate).alias("candidate"))
    return hot_join(keyed, pairs.select("semantic_id", judge(F.col("reference"), F.col("candidate")).alias("equivalent")), "semantic_id")


def numbered(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """Rows numbered from 0 in a global order, without gathering them: range partitions are sorted and
    written, counted, and numbered by their offset plus the place inside. Order columns make rows distinct."""
    from pyspark.sql import Window

    spread = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_pid", F.spark_partition_id())
    inside = spread.withColumn(name, F.row_number().over(Window.partitionBy("_pid").orderBy(*order)) - 1)
    counts = spread.groupBy("_pid").agg(F.count("*").alias("_n"))  # one row a partition
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return inside.join(F.broadcast(offsets), "_pid").withColumn(name, F.col(name) + F.col("_before")).drop("_pid", "_before")


def budget_batches(rows: DataFrame, key: str, length: str, budget: int) -> DataFrame:
    """Rows in batches of similar length: key, length, batch. Rows are range-partitioned and sorted by length and
    key; each partition fills batches greedily while widest length x rows stays within the budget."""
    kinds = dict(rows.dtypes)

    def run(parts):
        widest = count = batch = 0
        for part in parts:
            out = []
            for n in part[length]:
                if count and max(widest, n) * (count + 1) <= budget:
                    widest, count = max(widest, n), count + 1
                else:
                    batch, widest, count = batch + 1, n, 1
                out.append(batch)
            yield pd.DataFrame({key: part[key], length: part[length], "batch": out})

    placed = rows.select(key, length).repartitionByRange(length, key).sortWithinPartitions(length, key)
    return placed.mapInPandas(run, f"{key} {kinds[key]}, {length} {kinds[length]}, batch bigint").withColumn("part", F.spark_partition_id())


def word_vectors(turns: DataFrame) -> DataFrame:
    """Turns as unit vectors of word counts over their dialogue's vocabulary: dialogue_id, turn_id, vector."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"(?U)\s+"), lambda w: w != "")
    counts = turns.select("dialogue_id", "turn_id", F.explode(words).alias("w")).groupBy("dialogue_id", "turn_id", "w").agg(F.count("*").alias("c"))
    vocabulary = ranked(counts.select("dialogue_id", "w").distinct(), "dialogue_id", ["w"], "at")
    placed = counts.join(vocabulary, ["dialogue_id", "w"]).groupBy("dialogue_id", "turn_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "c"))).alias("m"), F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    widths = vocabulary.groupBy("dialogue_id").agg(F.max("at").alias("width"))
    rows = hot_join(turns.select("dialogue_id", "turn_id").join(placed, ["dialogue_id", "turn_id"], "left"), widths, "dialogue_id")
    entry = lambda i: F.coalesce(F.try_element_at("m", i) / (F.col("norm") + 1e-9), F.lit(0.0))
    return rows.select("dialogue_id", "turn_id", F.transform(F.sequence(F.lit(1), F.coalesce("width", F.lit(0)) + 1), lambda i: entry(i.cast("int"))).alias("vector"))


def pooled_embedding(words: Column, embed, width: int) -> Column:
    """Mean of the words' vectors scaled to unit length; `embed` gives a word's component. No words: zeros."""
    n = F.greatest(F.size(words), F.lit(1))

    def component(i: int) -> Column:
        return F.aggregate(words, F.lit(0.0), lambda a, w: a + embed(w, i)) / n

    mean = F.array(*[component(i) for i in range(width)])
    return F.transform(F.array(mean), lambda m: F.transform(m, lambda x: x / (F.sqrt(F.aggregate(m, F.lit(0.0), lambda a, y: a + y * y)) + 1e-9)))[0]


def retention_accuracy(pairs: DataFrame, by: str, boundary: bool | None = None) -> DataFrame:
    """Share of questions that a text still answers: by, n_pairs, accuracy.

    `pairs`: by, text, answer, qa_type, old_value, new_value, requires_boundary. With `boundary` only pairs that
    need a boundary turn (or need none) count. Pairs of type `dep` are skipped; no pairs at all give 1.0,
    only skipped ones NaN. A combined reversal needs the old and the new value.
    """
    from .score import retention_question

    fits = F.lit(True) if boundary is None else F.coalesce("requires_boundary", F.lit(False)) == F.lit(boundary)
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    both = (F.col("qa_type") == "reversal_combined") & (low("old_value") != "") & (low("new_value") != "")
    right = F.when(both, (low("text").contains(low("old_value")) & low("text").contains(low("new_value"))).cast("int")).otherwise(retention_question("text", "answer"))
    eligible = fits & (F.coalesce("qa_type", F.lit("")) != "dep")
    rows = pairs.select(by, fits.alias("fits"), F.when(eligible, right).alias("right"))
    agg = rows.groupBy(by).agg(F.count_if("fits").alias("n_pairs"), F.avg("right").alias("share"))
    return agg.select(by, "n_pairs", F.when(F.col("n_pairs") == 0, 1.0).when(F.col("share").isNull(), F.lit(float("nan"))).otherwise(F.round("share", 6)).alias("accuracy"))
