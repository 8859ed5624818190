"""Problem 4: texts that lost their end, in rendered contexts and in reader answers.

A stack automaton reads the end of a context and says what it leaves open: a turn's tag, quotes,
brackets, markup, an escape, a broken multibyte sequence, a mark of omission, or a missing terminator. An
open tag settles the context. Everything else is only evidence, as speakers leave turns unfinished and
a cut may take no letter: where the turn table knows the turn, an exact check follows, and the
context is cut if at least one letter or digit of the turn is missing. Where the turn is unknown, open
structure counts, and a missing terminator does if it is mostly due to cuts in that dataset: the rate
of missing terminators at the ends of contexts is at least `1 / (1 - EXCESS)` times the rate at the ends of whole turns.
Answers are judged by the response side of `pairs`.

Defined results for hard input: null and empty contexts are no case; a context without any tag is
judged by structure alone; blanks at the end never count; repeated rows are judged alike; an empty table
gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dataset_name
from ..runtime import hot_join, map_rows
from .automata import INVISIBLE, OMISSION, REPLACEMENT, TERMINATORS, open_text
from .pairs import judge_answers

_BLANK_END = re.compile(rf"[\s{INVISIBLE}]+$")
#: Least share of the missing terminators of a dataset's contexts that cuts must explain; turns a
#: dataset needs for a baseline of its own (below, that of all datasets holds).
EXCESS, LEAST_TURNS = 0.5, 30
#: A rendered turn starts with its number and role; the tag is complete with the blank behind it.
TAG = r"\[T(\d+)\] (USER|SYSTEM):"
#: Proper beginnings of a tag, and marks of omission behind them.
_OPEN_TAG = r"\[(?:T(?:\d+(?:\](?: (?:U(?:S(?:E(?:R)?)?)?|S(?:Y(?:S(?:T(?:E(?:M)?)?)?)?)?)?)?)?)?)?"
_MARK = r"\s*(?:\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|\.\.\.|…)\s*$"


def lost_letters(tail: str, whole: str) -> bool:
    """True if `tail` is the turn `whole` without its end and a letter or digit is missing."""
    for shown in _without_marks(tail):
        if len(shown) <= len(whole) and whole.startswith(shown):
            return any(c.isalnum() for c in whole[len(shown) :])
    return tail.rstrip().endswith(REPLACEMENT)


def _without_marks(tail: str):
    """The tail as it is, without blanks, and without the mark of omission or broken character."""
    yield tail
    shown = _BLANK_END.sub("", tail)
    yield shown
    while shown.endswith(REPLACEMENT):
        shown = shown[:-1]
        yield shown
    bare = OMISSION.sub("", shown)
    if bare != shown:
        yield bare
        yield bare.rstrip()


def whole_turns(turns: DataFrame) -> DataFrame:
    """Each turn once, by its latest delivery."""
    return (
        turns.where("dialogue_id is not null and turn_id is not null and text is not null")
        .groupBy("dialogue_id", F.col("turn_id").cast("bigint").alias("turn_no"))
        .agg(F.max_by("text", F.struct("loaded_at", "text")).alias("whole"))
    )


def last_turns(probes: DataFrame) -> DataFrame:
    """The end of every context: key and text of its last tagged turn, and whether an open tag settles
    that it was cut (then nothing but the row's ids moves on)."""
    text = F.col("compressed_text_used")
    number = F.regexp_extract(text, rf"(?s)^(?:.*\n)?{TAG}", 1).try_cast("bigint")
    tail = F.when(number.isNotNull(), F.regexp_replace(text, rf"(?s)^(?:.*\n)?{TAG} ?", "")).otherwise("")
    line = F.regexp_replace(F.substring_index(text, "\n", -1), f"{REPLACEMENT}+$", "")
    settled = F.regexp_like(F.regexp_replace(line, _MARK, ""), F.lit(rf"^{_OPEN_TAG}\s*$"))
    return probes.where(text.isNotNull() & (text != "")).select(
        "row_id", "dataset", _kind("dialogue_id").alias("of"), F.when(~settled, F.struct("dialogue_id", number.alias("turn_no"))).alias("turn_key"), F.when(~settled, tail).alias("tail"), settled.alias("settled")
    )


def _kind(dialogue: str) -> Column:
    return F.substring_index(dialogue, "-", 1)


def judge_contexts(probes: DataFrame, turns: DataFrame) -> DataFrame:
    """Every non-empty context: row_id, dataset, of (dataset of the dialogue), is_cut (null where
    structure and an unknown turn leave it open), evidence.

    The join carries the last turn only, not the whole context. Turns are keyed by dialogue and
    number; a key that holds very many contexts is divided.
    """
    known = whole_turns(turns).select(F.struct("dialogue_id", "turn_no").alias("turn_key"), "whole")
    joined = hot_join(last_turns(probes), known, "turn_key").select("row_id", "dataset", "of", "tail", "settled", "whole")

    def judge(cols: list[list]) -> list[list]:
        ids, datasets, kinds, tails, settled, wholes = cols
        evidence = ["[" if done else open_text(t) for t, done in zip(tails, settled)]
        return [ids, datasets, kinds, [True if done else _cut(t, e, w) for t, done, e, w in zip(tails, settled, evidence, wholes)], evidence]

    return map_rows(joined, judge, "row_id bigint, dataset string, of string, is_cut boolean, evidence string")


def _cut(tail: str, evidence: str, whole: str | None) -> bool | None:
    if whole is not None:
        return lost_letters(tail, whole)
    return None if evidence == "." else bool(evidence)


def missing_ends(probes: DataFrame, turns: DataFrame) -> DataFrame:
    """By dataset of the dialogue, how often a terminator is missing at the ends of contexts (n, bare) and of whole
    turns (turns, open), counted in the JVM."""
    bare = lambda c: ~F.regexp_like(c, F.lit(rf"[{re.escape(TERMINATORS)}][\"'”’」』)）\]】»]?\s*$"))
    ends = last_turns(probes).where("not settled").groupBy("of").agg(F.count("*").alias("n"), F.count_if(bare(F.col("tail"))).alias("bare"))
    said = whole_turns(turns).groupBy(_kind("dialogue_id").alias("of")).agg(F.count("*").alias("turns"), F.count_if(bare(F.col("whole"))).alias("open"))
    return ends.join(said, "of")


def cut_contexts(probes: DataFrame, turns: DataFrame) -> DataFrame:
    """Every non-empty context: row_id, dataset, is_cut; what structure leaves open by its dataset's baseline."""
    rates = missing_ends(probes, turns)
    telling = lambda n, bare, all_turns, unended: F.coalesce(bare * all_turns * (1 - EXCESS) >= unended * n, F.lit(False)) & (bare > 0)
    own = rates.where(F.col("turns") >= LEAST_TURNS).select(F.col("of").alias("_of"), telling(*map(F.col, ("n", "bare", "turns", "open"))).alias("strict"))
    rest = rates.agg(F.coalesce(telling(*map(F.sum, ("n", "bare", "turns", "open"))), F.lit(False)).alias("strict"))
    rows = judge_contexts(probes, turns).join(own, F.col("of") == F.col("_of"), "left")
    return rows.select("row_id", "dataset", F.coalesce("is_cut", "strict", rest.scalar()).alias("is_cut"))


def truncated_records(probes: DataFrame, turns: DataFrame, answers: DataFrame) -> DataFrame:
    """All records that lost their end: source_table, row_key."""
    contexts = cut_contexts(probes, turns).where("is_cut").select(F.lit("probes").alias("source_table"), F.col("row_id").alias("row_key"))
    replies = judge_answers(answers, probes).where("defect = 'truncated'").select(F.lit("reused_raw_answers").alias("source_table"), F.col("answer_no").alias("row_key"))
    return contexts.unionByName(replies)


def truncation_share(probes: DataFrame, turns: DataFrame, answers: DataFrame) -> DataFrame:
    """Share of cut records by dataset of the contexts and by source of the answers."""
    contexts = cut_contexts(probes, turns).select(F.lit("probes").alias("source_table"), dataset_name("dataset").alias("slice"), "is_cut")
    replies = judge_answers(answers, probes).select(F.lit("reused_raw_answers").alias("source_table"), F.col("source").alias("slice"), F.coalesce(F.col("defect") == "truncated", F.lit(False)).alias("is_cut"))
    cut = F.sum(F.col("is_cut").cast("bigint"))
    return contexts.unionByName(replies).groupBy("source_table", "slice").agg(F.count("*").alias("n_records"), cut.alias("n_cut"), F.round(cut / F.count("*"), 6).alias("share"))
