"""Diagnostics, pooled and scaled scores, several controls, and sources of varying shape."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import exact
from ..functions.strings import normalize_value, occurs_bounded
from ..operators import score, select
from ..runtime import shared_folder, table
from ..sources import files
from .selection import DATASET, TURNS, bounded, nv, turns_of


def sel_pooled_scores(spark, d):
    return select.pooled_scores(turns_of(spark, d), F.length(F.coalesce("text", F.lit(""))))


def sel_scaled_scores(spark, d):
    return select.scaled_scores(turns_of(spark, d), F.length(F.coalesce("text", F.lit(""))))


def sel_random_fixed(spark, d):
    return select.random_fixed(turns_of(spark, d), 0.3, 7)


def sel_matched_controls(spark, d):
    """Controls for the origin and the final update of every dialogue, without replacement."""
    labels = table(spark, d, "update_labels").groupBy("dialogue_id").agg(F.min_by(F.struct("origin_turn_id", "final_slot_update_turn_id", "old_value", "new_value"), "slot").alias("l"))
    both = F.array(F.struct(F.lit(0).alias("place"), F.col("l.origin_turn_id").alias("target")), F.struct(F.lit(1).alias("place"), F.col("l.final_slot_update_turn_id").alias("target")))
    return select.matched_controls(turns_of(spark, d), labels.select("dialogue_id", F.inline(both)), labels.select("dialogue_id", "l.old_value", "l.new_value"), 2)


def rouge_of_contexts(spark, d):
    """Longest-common-subsequence overlap of each probe's gold with its whole context."""

    @F.pandas_udf("double")
    def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([round(exact.rouge_l(x, y), 6) for x, y in zip(a, b)])

    rows = table(spark, d, "probes").where("gold is not null and compressed_text_used is not null").select("row_id", "gold", "compressed_text_used")
    return rows.select("row_id", overlap("gold", "compressed_text_used").alias("rouge_l"))


def retention_split(spark, d):
    """Golds held as an exact span, only through shared tokens, or either way, by method."""
    rows = table(spark, d, "probes").where("gold is not null and compressed_text_used is not null")
    span = F.lower("compressed_text_used").contains(F.lower("gold")).cast("int")
    return rows.select("method", span.alias("s"), score.retention_question("compressed_text_used", "gold").alias("q")).groupBy("method").agg(F.count("*").alias("n"), F.sum("s").alias("exact_span"), F.sum(F.col("q") - F.col("s")).alias("overlap_only"), F.sum("q").alias("either"))


def either_bounded(spark, d):
    """Old and new values of which one holds the other at word bounds."""
    rows = table(spark, d, "probes").where("old_value is not null and new_value is not null")
    rows = rows.select("row_id", normalize_value("old_value").alias("a"), normalize_value("new_value").alias("b"))
    return rows.select("row_id", (occurs_bounded("a", "b") | occurs_bounded("b", "a")).alias("holds"))


def gold_leaks(spark, d):
    """Golds that a context still holds although it lost its evidence turns, by dataset."""
    rows = table(spark, d, "probes").where("new_value is not null and compressed_text_used is not null and meta is not null")
    kept = score.kept_turns("compressed_text_used")
    lost = F.size(F.array_intersect(F.coalesce("meta.s_evidence", F.array().cast("array<bigint>")), kept)) == 0
    leak = F.col("compressed_text_used").contains(F.col("new_value")) & lost
    from ..functions.text import dataset_name

    return rows.groupBy(dataset_name("dataset").alias("dataset")).agg(F.count("*").alias("n"), F.count_if(leak).alias("n_leaks"))


def document_shapes(spark, d):
    """Labels as documents of three shapes, one a line, read back by one reader."""
    entry = F.struct("dialogue_id", "slot", "new_value")
    shape = F.pmod(F.crc32("dialogue_id"), F.lit(3))
    text = F.when(shape == 0, F.to_json(F.array(entry))).when(shape == 1, F.to_json(F.struct(F.array(entry).alias("dialogues")))).otherwise(F.to_json(F.map_from_arrays(F.array("dialogue_id"), F.array(entry))))
    path = shared_folder(spark, "shapes")
    table(spark, d, "update_labels").select(text.alias("value")).write.text(path)
    lines = spark.read.text(path).select(F.lit("lines").alias("file_name"), F.col("value").alias("document"))
    found = files.dialogues_of(lines, "struct<dialogue_id:string,slot:string,new_value:string>")
    return found.select("entry.dialogue_id", "entry.slot", "entry.new_value")


def file_name_parts(spark, d):
    """Dataset, ratio, seed and probe from the file names of saved cells."""
    names = table(spark, d, "probes").where("meta is not null").select(F.concat_ws("_", F.lower("dataset"), F.concat(F.lit("r"), (F.col("meta.ratio") * 100).cast("int")), F.concat(F.lit("s"), F.col("meta.sample_seed")), F.lower("probe_type")).alias("file_name")).distinct()
    return files.file_parts(names, r"^(sgd|multiwoz|risawoz|fmts)_r(\d+)_s(\d+)_(.+)$", ["dataset", "ratio", "seed", "probe"])


_ALL = (sel_pooled_scores, sel_scaled_scores, sel_random_fixed, sel_matched_controls, rouge_of_contexts, retention_split, either_bounded, gold_leaks, document_shapes, file_name_parts)
QUERIES = {f.__name__: f for f in _ALL}

_QA = r"x as (select method, lower(compressed_text_used) t, lower(gold) e from probes where gold is not null and compressed_text_used is not null), y as (select *, list_distinct(regexp_extract_all(e,'[a-z0-9]+') || regexp_extract_all(e,'[가-힣]+')) ew, list_distinct(regexp_extract_all(t,'[a-z0-9]+') || regexp_extract_all(t,'[가-힣]+')) tw from x), z as (select method, contains(t, e)::int s, case when e <> '' and contains(t, e) then 1 when len(list_intersect(ew, tw)) / greatest(len(ew), 1)::double > 0.5 then 1 else 0 end q from y)"
ORACLE = {
    "sel_pooled_scores": f"with {TURNS} select dialogue_id, turn_id, round(sum(length(coalesce(text,''))) over (partition by dialogue_id order by turn_id rows between 2 preceding and 2 following) / 5.0::double, 6) pooled from t",
    "sel_scaled_scores": f"with {TURNS}, q as (select dialogue_id, turn_id, length(coalesce(text,''))::double s, min(length(coalesce(text,''))) over w lo, max(length(coalesce(text,''))) over w hi, n from b window w as (partition by dialogue_id)) select dialogue_id, turn_id, round(case when hi = lo then 1.0::double / n else (s - lo) / (hi - lo) end, 6) scaled from q",
    "retention_split": f"with {_QA} select method, count(*) n, sum(s)::bigint exact_span, sum(q - s)::bigint overlap_only, sum(q)::bigint as either from z group by 1",
    "either_bounded": f"with q as (select row_id, {nv('old_value')} a, {nv('new_value')} b from probes where old_value is not null and new_value is not null) select row_id, ({bounded('a', 'b')} or {bounded('b', 'a')}) holds from q",
    "gold_leaks": rf"with q as (select {DATASET.format('dataset')} dataset, contains(compressed_text_used, new_value) and len(list_intersect(coalesce(meta.s_evidence, []), list_transform(regexp_extract_all(compressed_text_used, '\[T(\d+)\]', 1), lambda x: x::bigint))) = 0 leak from probes where new_value is not null and compressed_text_used is not null and meta is not null) select dataset, count(*) n, count(*) filter (where leak) n_leaks from q group by 1",
    "document_shapes": "select dialogue_id, slot, new_value from update_labels",
    "file_name_parts": r"with q as (select distinct concat_ws('_', lower(dataset), 'r' || (meta.ratio * 100)::int, 's' || meta.sample_seed, lower(probe_type)) file_name from probes where meta is not null) select file_name, case when m then regexp_extract(file_name, p, 1) end dataset, case when m then regexp_extract(file_name, p, 2) end ratio, case when m then regexp_extract(file_name, p, 3) end seed, case when m then regexp_extract(file_name, p, 4) end probe from (select *, '^(sgd|multiwoz|risawoz|fmts)_r(\d+)_s(\d+)_(.+)$' p, regexp_matches(file_name, '^(sgd|multiwoz|risawoz|fmts)_r(\d+)_s(\d+)_(.+)$') m from q)",
}
