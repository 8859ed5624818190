"""Small automata shared by the text operators: suffix automaton, structure stack, phrase sets."""

from __future__ import annotations

import re
import unicodedata

#: Characters that do not show, and blanks of every kind.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e007f"
BLANK = rf"[\s{INVISIBLE}\u2800]"
_BLANKS = re.compile(rf"{BLANK}+")
_ENDS = re.compile(rf"^{BLANK}+|{BLANK}+$")
#: Marks that writers and exporters put where a text was cut.
OMISSION = re.compile(r"\s*(?:\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|\.\.\.|…)\s*$")
REPLACEMENT = "\ufffd"
TERMINATORS = ".?!。？！…．｡"


def visible(text: str) -> str:
    """Text without blanks and invisible characters at its ends."""
    return _ENDS.sub("", text)


def fold(text: str) -> str:
    """Letters and digits of the text, compatibility-normalised and without case."""
    return "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if c.isalnum())


class SuffixAutomaton:
    """Minimal automaton of all substrings of a text (online construction, linear size)."""

    __slots__ = ("edges", "link", "length")

    def __init__(self, text: str) -> None:
        self.edges: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for ch in text:
            last = self._extend(last, ch)

    def _extend(self, last: int, ch: str) -> int:
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and ch not in self.edges[at]:
            self.edges[at][ch] = new
            at = self.link[at]
        if at >= 0:
            target = self.edges[at][ch]
            if self.length[target] == self.length[at] + 1:
                self.link[new] = target
            else:
                twin = self._state(self.length[at] + 1, dict(self.edges[target]), self.link[target])
                self.link[target] = self.link[new] = twin
                while at >= 0 and self.edges[at].get(ch) == target:
                    self.edges[at][ch] = twin
                    at = self.link[at]
        return new

    def _state(self, length: int, edges: dict[str, int], link: int) -> int:
        self.length.append(length)
        self.edges.append(edges)
        self.link.append(link)
        return len(self.length) - 1

    def coverage(self, text: str, least: int) -> tuple[int, int]:
        """Characters of `text` inside matches of at least `least`, and the longest match."""
        state = size = covered = best = reach = 0
        for i, ch in enumerate(text):
            while state and ch not in self.edges[state]:
                state = self.link[state]
                size = self.length[state]
            if ch in self.edges[state]:
                state, size = self.edges[state][ch], size + 1
            else:
                state = size = 0
            best = max(best, size)
            if size >= least:
                covered += i + 1 - max(reach, i + 1 - size)
                reach = i + 1
        return covered, best


def open_structure(text: str) -> str:
    """What a structured text leaves open at its end, from a stack over quotes and brackets.

    Returns `""` for a complete text, else the unclosed delimiters in order; `\\` stands for an
    escape that breaks off. Brackets inside strings are text; a wrong closer is ignored.
    """
    stack: list[str] = []
    inside = escaped = False
    for ch in text:
        if inside:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                inside = False
        elif ch == '"':
            inside = True
        elif ch in "{[":
            stack.append(ch)
        elif ch in "}]" and stack and stack[-1] == ("{" if ch == "}" else "["):
            stack.pop()
    return "".join(stack) + '"' * inside + "\\" * escaped


#: Quotes and brackets of running text with their closers; an apostrophe inside a word is none.
_PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "{": "}"}
_CLOSERS = frozenset("".join(_PAIRS.values()))


def open_text(text: str) -> str:
    """What running text leaves open at its end, from a stack over quotes, brackets, tags and escapes.

    Signs of the result: an unclosed opener; `<` for markup whose tag breaks off; `\\` for an escape
    that breaks off; REPLACEMENT for a broken multibyte sequence; `…` for a mark of omission; `.` for
    a missing terminator. An empty result is a complete text. A closer that fits nothing is ignored.
    """
    stack: list[str] = []
    for at, ch in enumerate(text):
        if stack and ch in _PAIRS.get(stack[-1], stack[-1]):
            stack.pop()
        elif ch in _PAIRS:
            stack.append(ch)
        elif ch == '"':
            stack.append(ch)
        elif ch == "<" and text[at + 1 : at + 2].isalpha() or ch == "<" and text[at + 1 : at + 2] == "/":
            stack.append(ch)
        elif ch == ">" and "<" in stack:
            del stack[stack.index("<") :]
    shown = visible(text)
    left = "".join(stack)
    if re.search(r"\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?$|&#?\w{0,7}$|%[0-9A-Fa-f]?$(?<!\d%)", shown):
        left += "\\"
    if shown.endswith(REPLACEMENT):
        left += REPLACEMENT
    if OMISSION.search(shown):
        left += "…"
    elif shown and shown[-1] not in TERMINATORS and not (shown[-1] in "\"'”’」』)）]】»" and shown[-2:-1] in TERMINATORS):
        left += "."
    return left


def open_fence(text: str) -> bool:
    """True if a code fence is opened and its closing fence is missing or incomplete."""
    shown = visible(text)
    if not shown.startswith("`"):
        return False
    body = shown.lstrip("`")
    if len(shown) - len(body) < 3:
        return not body
    return not re.search(r"```\s*$", body)
