"""Problem 1: broken prompt and response pairs; the response side also serves problem 4.

The closing question of a prompt has a suffix automaton that measures how much of an answer is copied;
a stack over delimiters finds what is left open; refusals and languages are voted on in `votes`.
Each answer gets at most one defect, tested in this order: `empty`, structural truncation,
`copied_question`, `refusal`, `other_language`, `truncated` prose or support.

Defined results for hard input: a null or blank text is `empty`; a missing prompt leaves only the
tests that need no prompt; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import hot_join, map_rows
from .automata import INVISIBLE, OMISSION, REPLACEMENT, TERMINATORS, SuffixAutomaton, fold, open_fence, open_structure, visible
from .votes import DANGLING, FINITE, declines, language, other_language

DEFECTS = ("empty", "truncated", "refusal", "copied_question", "other_language")
#: Mark of a sentence that lacks only its terminator, until the baseline of its source decides.
UNENDED = "unended"

# Openings of answer sentences; an answer that opens so and has no end was cut.
OPENINGS = (
    "according to", "based on", "it should be", "the user", "the answer", "in the end", "in the last", "here is the answer", "they finally", "after all changes", "i'm sorry", "i apologise", "unfortunately", "regretfully", "apologies", "thanks for asking", "as a language assistant",
    "用户想要", "根据对话", "用户最后", "最后用户", "最终确定", "用户在最后", "答案是", "很抱歉", "对不起", "非常遗憾", "作为语言助手",
    "대화에 따르면", "사용자는", "사용자가", "최종적으로", "마지막에", "답은", "죄송합니다", "안타깝지만", "유감스럽게도",
    "der nutzer", "die antwort", "laut gespräch", "am ende", "zuletzt", "gemeint ist", "el usuario", "la respuesta", "según la", "al final", "l'utilisateur", "la réponse", "d'après", "à la fin", "finalement",
)
_SHELL = re.compile(rf"[\s{INVISIBLE}`{{}}\[\]()\"'“”,.:;*_~#<>/\\|-]+")
_QUESTION = re.compile(r"\n\n(?=[^\n]*(?:\n[^\n]*)?\s*$)")
_LABEL = re.compile(r"^\s*(?:question|frage|pregunta|q|问题|질문)\s*[:：]\s*", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
#: Share of an answer that must be covered by the question's text, and share of the question in it.
COPIED, OF_QUESTION, LEAST_MATCH = 0.9, 0.6, 4
#: Words of a sentence; share of a source's sentences that must have a terminator for a missing one to
#: tell anything; sentences a source needs for a baseline of its own (below, that of all sources holds).
LEAST_SENTENCE, BASELINE, LEAST_SENTENCES = 4, 0.8, 30


class Question:
    """The closing part of a prompt: its question, reply instruction, language and automaton."""

    def __init__(self, tail: str) -> None:
        lines = [x for x in tail.split("\n") if x.strip()]
        self.text = _LABEL.sub("", lines[0]) if lines else ""
        self.lines = [self.text, *(lines[1:])]
        self.automaton = SuffixAutomaton(fold(tail))
        self.size = len(fold(self.text))
        self.lang = language(tail)


@lru_cache(4096)
def question_of(tail: str) -> Question:
    return Question(tail)


def split_prompt(prompt: str) -> tuple[str, str]:
    """Context and closing question of a prompt, divided at its last blank line."""
    at = prompt.rfind("\n\n")
    return (prompt[:at], prompt[at + 2 :]) if at >= 0 else ("", prompt)


def is_copied(text: str, q: Question) -> bool:
    """True if the answer consists of the question, with or without the instruction."""
    shown = fold(_LABEL.sub("", text))
    if not shown or not q.size:
        return False
    covered, longest = q.automaton.coverage(shown, LEAST_MATCH)
    return covered >= COPIED * len(shown) and longest >= OF_QUESTION * q.size


def is_refusal(text: str, context: str) -> bool:
    """True if a sentence of the answer declines and is no quotation from the context."""
    said = declines(text)
    return said is not None and said.strip() not in context


def in_other_language(text: str, context: str, q: Question) -> bool:
    """Vote of scripts and function words, without the question's own lines."""
    for line in q.lines:
        if line:
            text = text.replace(line, " ")
    return other_language(text, context, q.lang)


def unfinished(text: str, context: str) -> bool | None:
    """A prose answer that stops before its end; a bare value is complete as it is.

    None for a sentence that lacks only its terminator: it was cut if answers of its source end in one
    where they are sentences.
    """
    shown = visible(text)
    if shown.endswith(REPLACEMENT):
        return True
    bare = OMISSION.sub("", shown)
    if bare != shown:
        return shown not in context or _opens(shown.lower())
    if not shown or shown[-1] in TERMINATORS or shown[-1] in "\"'”’」』)）]】" and shown[-2:-1] and shown[-2] in TERMINATORS:
        return False
    parts = [x for x in _SENTENCE.split(shown) if x]
    if len(parts) > 1 and parts[-2][-1:] in ".。!！":
        return True
    if _opens(parts[-1].lower()):
        return True
    words = parts[-1].lower().split()
    if len(words) < 3 or ";" in shown or shown in context:
        return False
    if words[-1] in DANGLING:
        return True
    return None if len(words) >= LEAST_SENTENCE and not FINITE.isdisjoint(words) else False


def _opens(text: str) -> bool:
    return any(text.startswith(x) or len(text) >= 2 and x.startswith(text) for x in OPENINGS)


def cut_inside_word(support: str, context: str) -> bool:
    """A quoted support whose every place in the prompt goes on with the same word."""
    shown = support.rstrip()
    if shown.endswith(REPLACEMENT):
        return True
    bare = OMISSION.sub("", shown)
    if bare != shown and shown not in context:
        shown = bare
    if not shown or not shown[-1].isalnum():
        return False
    at, inside = context.find(shown), False
    while at >= 0:
        after = context[at + len(shown) : at + len(shown) + 1]
        if not after.isalnum():
            return False
        inside = True
        at = context.find(shown, at + 1)
    return inside


def _shell(text: str) -> bool:
    return _SHELL.sub("", re.sub(r"```\w*", "", text)).lower() in ("", "null", "none", "nil", "undefined", "nan")


def classify(text: str | None, prompt: str | None, strict: bool | None = False) -> str | None:
    """Defect of one answer, or None. `strict` says that a sentence without a terminator was cut; if it is
    None, such a sentence is UNENDED."""
    if text is None or not visible(text):
        return "empty"
    shown = visible(text)
    context, tail = split_prompt(prompt or "")
    q = question_of(tail)
    at = shown.find("{")
    if at >= 0 or shown[0] == "[":
        at = max(at, 0)
        if open_structure(shown[at:]) or open_fence(shown):
            return "truncated"
        return _judge_object(shown, at, context, q)
    if open_fence(shown):
        return "truncated"
    if _shell(shown):
        return "empty"
    return _judge_prose(shown, context, q, strict)


def _judge_object(shown: str, at: int, context: str, q: Question) -> str | None:
    end = shown.rfind("}" if shown[at] == "{" else "]")
    try:
        value = json.loads(shown[at : end + 1])
    except ValueError:
        return None if is_answer(shown) else "empty"
    if not isinstance(value, dict):
        return None if value else "empty"
    if value.get("abstain") is True:
        return None
    answer, support = value.get("value"), value.get("support")
    if answer is None or isinstance(answer, (str, list, dict)) and not (visible(answer) if isinstance(answer, str) else answer):
        return "empty"
    said = answer if isinstance(answer, str) else json.dumps(answer, ensure_ascii=False)
    quoted = support if isinstance(support, str) else ""
    if is_copied(said, q):
        return "copied_question"
    if is_refusal(said, context):
        return "refusal"
    free = said + (" " + quoted if quoted and quoted not in context else "")
    if in_other_language(free, context, q):
        return "other_language"
    if said.endswith(REPLACEMENT) or quoted and cut_inside_word(quoted, context):
        return "truncated"
    return None


def is_answer(shown: str) -> bool:
    return not _shell(shown)


def _judge_prose(shown: str, context: str, q: Question, strict: bool | None) -> str | None:
    if is_copied(shown, q):
        return "copied_question"
    if is_refusal(shown, context):
        return "refusal"
    if in_other_language(shown, context, q):
        return "other_language"
    cut = unfinished(shown, context)
    if cut is None and strict is None:
        return UNENDED
    return "truncated" if cut or cut is None and strict else None


def prompts_by_request(probes: DataFrame) -> DataFrame:
    """One prompt for each request: that of the lowest row id, whatever else is repeated."""
    return (
        probes.where("request_id is not null")
        .select(F.col("request_id").alias("id"), "row_id", "prompt_user")
        .groupBy("id")
        .agg(F.min_by("prompt_user", "row_id").alias("prompt"))
    )


def sentence_ends(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How answers of a source end where they are sentences: (source, strict) of every source with
    enough sentences, and one row over all sources for those with fewer.

    `strict` holds where at least BASELINE of the sentences end in a terminator. Counted in the JVM in
    one pass over the texts.
    """
    text = F.lower(F.coalesce("reader_output_text", F.lit("")))
    words = "|".join(sorted(FINITE))
    sentence = ~text.contains("{") & F.regexp_like(text, F.lit(rf"(?U)(?:^|\s)(?:{words})(?:\s|$)")) & (F.size(F.split(F.trim(text), " ")) >= LEAST_SENTENCE)
    ended = F.regexp_like(text, F.lit(rf"[{re.escape(TERMINATORS)}][\"'”’」』)）\]】]?\s*$"))
    per = answers.groupBy("source").agg(F.count_if(sentence).alias("n"), F.count_if(sentence & ended).alias("ended"))
    own = per.where(F.col("n") >= LEAST_SENTENCES).select("source", (F.col("ended") >= BASELINE * F.col("n")).alias("strict"))
    return own, per.agg(F.coalesce(F.sum("ended") >= BASELINE * F.sum("n"), F.lit(False)).alias("strict"))


def judge_answers(answers: DataFrame, probes: DataFrame) -> DataFrame:
    """Every answer with its defect or null: answer_no bigint, source string, defect string.

    The baselines are joined after the texts are judged, when none moves on, so that there may be any
    number of sources.
    """
    own, rest = sentence_ends(answers)
    rows = answers.select("answer_no", "id", "source", F.col("reader_output_text").alias("text"))
    joined = hot_join(rows, prompts_by_request(probes), "id")

    def judge(cols: list[list]) -> list[list]:
        nos, sources, texts, prompts = cols
        return [nos, sources, [classify(t, p, None) for t, p in zip(texts, prompts)]]

    judged = map_rows(joined.select("answer_no", "source", "text", "prompt"), judge, "answer_no bigint, source string, defect string")
    marked = judged.join(own.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of")), "left")
    defect, strict = F.col("defect"), F.coalesce("strict", rest.scalar())
    return marked.select("answer_no", "source", F.when(defect != UNENDED, defect).when((defect == UNENDED) & strict, "truncated").alias("defect"))


def broken_pairs(answers: DataFrame, probes: DataFrame) -> DataFrame:
    """Defective answers only: answer_no bigint, defect string."""
    return judge_answers(answers, probes).where("defect is not null").select("answer_no", "defect")


def defect_report(answers: DataFrame, probes: DataFrame) -> DataFrame:
    """Answers and defects by answer source: source, defect (`none` for usable), n_answers, share."""
    judged = judge_answers(answers, probes).withColumn("defect", F.coalesce("defect", F.lit("none")))
    counts = judged.groupBy("source", "defect").agg(F.count("*").alias("n_answers"))
    totals = counts.groupBy(F.col("source").alias("of")).agg(F.sum("n_answers").alias("total"))
    return counts.join(F.broadcast(totals), F.col("source").eqNullSafe(F.col("of"))).select("source", "defect", "n_answers", F.round(F.col("n_answers") / F.col("total"), 6).alias("share"))
