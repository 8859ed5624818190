"""Readers behind one interface: prompts in, answer texts out, loaded once for each partition.

Deterministic stand-ins serve for models: one quotes the last value-like span of the context, one
echoes its last turn. A reader may raise; the row then carries an error and no text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..runtime import map_rows

Reader = Callable[[str], str]


def last_turn_reader() -> Reader:
    """Answers with the text of the last turn of the context."""

    def read(prompt: str) -> str:
        turns = re.findall(r"^\[T\d+\] (?:USER|SYSTEM): (.*)$", prompt, re.M)
        return json.dumps({"value": turns[-1] if turns else "", "support": turns[-1] if turns else "", "abstain": not turns}, ensure_ascii=False)

    return read


def extractive_reader() -> Reader:
    """Answers with the last number, time or capitalised name of the context."""

    def read(prompt: str) -> str:
        context = prompt.rsplit("\n\n", 1)[0]
        spans = re.findall(r"\d{1,2}:\d{2}|\b\d+\b|(?<!\] )(?<!^)\b[A-Z][a-z]+(?: [A-Z][a-z]+)*", context)
        return json.dumps({"value": spans[-1] if spans else "", "support": "", "abstain": not spans})

    return read


READERS: dict[str, Callable[[], Reader]] = {"last_turn": last_turn_reader, "extractive": extractive_reader}


def answer(prompts: DataFrame, key: str, prompt: str, reader: str) -> DataFrame:
    """Answers of a registered reader: key bigint, text, error. Null prompts give `no-prompt`."""
    if reader not in READERS:
        raise ValueError(f"unknown reader {reader!r}")

    def run(cols: list[list]) -> list[list]:
        read = READERS[reader]()
        texts, errors = [], []
        for p in cols[1]:
            text = error = None
            if p is None:
                error = "no-prompt"
            else:
                try:
                    text = read(p)
                except Exception as e:  # a reader's failure belongs to its row
                    error = f"exception:{type(e).__name__}"
            texts.append(text)
            errors.append(error)
        return [cols[0], texts, errors]

    return map_rows(prompts.select(key, prompt), run, f"{key} bigint, text string, error string")


def token_batches(lengths: list[int], budget: int) -> list[list[int]]:
    """Greedy batches of indices in order of length: widest row times rows stays within the budget."""
    out: list[list[int]] = []
    widest = 0
    for i in sorted(range(len(lengths)), key=lambda j: (lengths[j], j)):
        wide = max(widest, lengths[i])
        if out and wide * (len(out[-1]) + 1) <= budget:
            out[-1].append(i)
            widest = wide
        else:
            out.append([i])
            widest = lengths[i]
    return out
