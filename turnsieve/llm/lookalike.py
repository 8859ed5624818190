"""Problem 3: one consistent form for texts that look the same but differ in their characters.

A text first loses what does not show, then wide, narrow, joined and radical forms are replaced by
what they stand for and accents are composed. Each word is then a lattice: at every position stand
the character itself and its look-alikes in other scripts. Viterbi finds the path with the best
character bigram score among scripts that agree; the bigrams are those of the plain values. A word wholly in the script of the text around it stays.

Signs that look different from what they stand for (raised digits, fractions, numero) stay.
Defined results for hard input: nulls give no row; empty texts are plain; repeated rows are cases
of their own; words without look-alikes are never changed, whatever their script.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import map_rows
from .automata import INVISIBLE

FIELDS = ("new_value", "old_value", "gold")
# Letters of other scripts and the Latin letters they look like.
_FROM = {
    "Cyrillic": dict(zip("АВСЕНІЈКМОРЅТХУаԁеһіјӏорԛсѕԝхуүгп", "ABCEHIJKMOPSTXYadehijlopqcswxyyrn")),
    "Greek": dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγικνορυχϲϳ", "ABEZHIKMNOPTYXayikvopuxcj")),
    "Armenian": dict(zip("ՕՍՏԼօսհոցյզ", "OUSLouhngjq")),
    "Cherokee": dict(zip("ᎪᎬᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦᏴᎢᎥ", "AEWMHGZVSLCPKBTi")),
}
# Punctuation that looks like an ASCII sign.
SIGNS = (
    dict.fromkeys("‐‑‒–−﹣⁃˗", "-")
    | dict.fromkeys("∶ː˸꞉׃", ":")
    | dict.fromkeys(";", ";")
    | dict.fromkeys("‚", ",")
    | dict.fromkeys("’‘ʼ′ʹ", "'")
    | dict.fromkeys("⁄∕⧸", "/")
    | dict.fromkeys("․", ".")
)
#: Letters that are drawn as another letter's small capital or modified form, by their Unicode names.
STYLED = {
    chr(c): found[1].lower()
    for c in (*range(0x250, 0x2B0), *range(0x1D00, 0x1D80), *range(0xA720, 0xA800))
    if (found := re.fullmatch(r"LATIN (?:LETTER SMALL CAPITAL|SMALL LETTER SCRIPT|SMALL LETTER DOTLESS) ([A-Z])", unicodedata.name(chr(c), "")))
}
#: Alphabets for formulas: bold, slanted, script and double-struck letters and figures.
FORMULA = range(0x1D400, 0x1D800)
_SPACES = re.compile(r"[   -     　]")
_HIDDEN = re.compile(f"[{INVISIBLE}]")
_KEEP = re.compile(r"^<(?:super|sub|fraction|circle|square|font|initial|medial|final|isolated)>")
_WORD = re.compile(r"[^\W\d_]+")
#: Cost of replacing a character, of a change of script inside a word, and of an unseen bigram.
CHANGE, MIX, UNSEEN = 0.25, 12.0, 7.0


def script(ch: str) -> str:
    """Script of a letter as far as look-alikes matter; `Common` for all else."""
    code = ord(ch)
    if code < 0x370:
        return "Latin" if ch.isalpha() else "Common"
    if code < 0x400 or 0x1F00 <= code < 0x2000:
        return "Greek"
    if 0x530 <= code < 0x590:
        return "Armenian" if ch.isalpha() else "Common"
    if 0x13A0 <= code < 0x1400:
        return "Cherokee"
    if code < 0x530 or 0x1C80 <= code < 0x1C90:
        return "Cyrillic"
    if 0x1E00 <= code < 0x1F00:
        return "Latin"
    return "Other" if ch.isalpha() else "Common"


def _tables() -> dict[str, list[str]]:
    """For each character all that look like it, itself first."""
    groups: dict[str, set[str]] = defaultdict(set)
    for table in _FROM.values():
        for foreign, latin in table.items():
            groups[latin] |= {foreign, latin}
    out: dict[str, set[str]] = defaultdict(set)
    for members in groups.values():
        for ch in members:
            out[ch] |= members
    return {ch: [ch, *sorted(x - {ch})] for ch, x in out.items()}


TWINS = _tables()


def compatible(text: str) -> str:
    """Text without hidden characters, with plain spaces, whole-width forms and composed accents."""
    shown = _HIDDEN.sub("", text)
    spaced = _SPACES.sub(" ", shown)
    if _SPACES.match(shown[:1]):
        spaced = spaced.lstrip(" ")
    if _SPACES.match(shown[-1:]):
        spaced = spaced.rstrip(" ")
    out = []
    for ch in spaced:
        if ch in SIGNS:
            out.append(SIGNS[ch])
            continue
        if ch in STYLED:
            out.append(STYLED[ch])
            continue
        if ord(ch) in FORMULA:
            out.append(unicodedata.normalize("NFKC", ch))
            continue
        how = unicodedata.decomposition(ch)
        if not how or _KEEP.match(how) or not how.startswith("<"):
            out.append(unicodedata.normalize("NFC", ch) if how else ch)
        elif how.startswith("<compat>") and not _reads_the_same(ch):
            out.append(ch)
        else:
            out.append(unicodedata.normalize("NFKC", ch))
    return unicodedata.normalize("NFC", "".join(out))


def _reads_the_same(ch: str) -> bool:
    """Joined letters, radicals, letters of an alphabet block and Roman numerals, not signs."""
    code = ord(ch)
    return 0xFB00 <= code < 0xFB50 or 0x2E80 <= code < 0x2FE0 or 0x3131 <= code < 0x3190 or 0x2160 <= code < 0x2180 or 0x132 <= code < 0x250 or 0x3D0 <= code < 0x400 or 0x1100 <= code < 0x1200


class Bigrams:
    """Character bigrams of plain texts; words begin and end with a blank."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.counts = counts
        self.first: dict[str, int] = defaultdict(int)
        for pair, n in counts.items():
            self.first[pair[0]] += n
        self.cost: dict[str, float] = {p: -math.log(n / self.first[p[0]]) for p, n in counts.items()}

    def of(self, a: str, b: str) -> float:
        return min(self.cost.get(a + b, UNSEEN), UNSEEN)


def best_word(word: str, model: Bigrams, around: str) -> str:
    """Viterbi over the word's look-alike lattice; `around` is the script of the text around it."""
    columns = [TWINS.get(ch, [ch]) for ch in word]
    if all(len(c) == 1 for c in columns) or {script(ch) for ch in word} == {around}:
        return word
    paths = {c: (model.of(" ", c) + (CHANGE if c != word[0] else 0.0) + (0.5 if script(c) not in (around, "Common") else 0.0), c) for c in columns[0]}
    for i in range(1, len(word)):
        step = {}
        for c in columns[i]:
            own = CHANGE if c != word[i] else 0.0
            sc = script(c)
            step[c] = min(
                (cost + own + model.of(p, c) + (MIX if sc != script(p) and "Common" not in (sc, script(p)) else 0.0), path + c) for p, (cost, path) in paths.items()
            )
        paths = step
    return min((cost + model.of(c, " "), path) for c, (cost, path) in paths.items())[1]


def canonical(text: str, model: Bigrams) -> str:
    """The one form of a text."""
    plain = compatible(text)
    scripts: dict[str, int] = defaultdict(int)
    for ch in plain:
        if ch.isalpha() and ch not in TWINS:
            scripts[script(ch)] += 1
    around = max(scripts, key=scripts.get) if scripts else "Latin"
    return _WORD.sub(lambda m: best_word(m[0], model, around), plain)


def plain_bigrams(slot_values: DataFrame, labels: DataFrame) -> dict[str, int]:
    """Bigram counts over the distinct plain values, slot names and goals.

    Counted in the JVM; only pairs of alphabetic script characters and blanks come to the driver,
    at most the square of the few hundred letters with look-alikes and their neighbours.
    """
    texts = slot_values.select(F.col("value_text").alias("t")).unionByName(slot_values.select(F.col("slot_human").alias("t"))).unionByName(labels.select(F.col("goal_text").alias("t"))).where("t is not null").distinct()
    words = texts.select(F.explode(F.split("t", r"(?U)[^\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}\p{IsCherokee}]+")).alias("w")).where("w <> ''").select(F.concat(F.lit(" "), "w", F.lit(" ")).alias("w"))
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, F.lit(2)))).alias("pair"))
    return {r[0]: r[1] for r in pairs.groupBy("pair").count().collect()}


def field_values(probes: DataFrame) -> DataFrame:
    """The fields of every probe as rows: row_id, field_name, value; nulls give none."""
    fields = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in FIELDS])
    return probes.select("row_id", F.inline(fields)).where("value is not null")


def consistent_values(probes: DataFrame, slot_values: DataFrame, labels: DataFrame) -> DataFrame:
    """Every field value in its one form: row_id, field_name, value, canonical.

    Pure ASCII values are plain as they stand and never leave the JVM.
    """
    counts = plain_bigrams(slot_values, labels)
    values = field_values(probes)
    ascii_only = F.col("value").rlike(r"^[\x00-\x7F]*$")

    def run(cols: list[list]) -> list[list]:
        model = Bigrams(counts)
        known: dict[str, str] = {}
        for v in set(cols[2]):
            known[v] = canonical(v, model)
        return [*cols, [known[v] for v in cols[2]]]

    changed = map_rows(values.where(~ascii_only), run, "row_id bigint, field_name string, value string, canonical string")
    return changed.unionByName(values.where(ascii_only).withColumn("canonical", F.col("value")))


def substituted_fields(probes: DataFrame, slot_values: DataFrame, labels: DataFrame) -> DataFrame:
    """Fields that read like their plain form but are not it: row_id, field_name."""
    return consistent_values(probes, slot_values, labels).where("value <> canonical").select("row_id", "field_name")
