"""Scalar text operators as Column expressions, compiled into whole-stage code.

All patterns use Java's Unicode classes where the semantics ask for letters of any script. Nulls
stay null unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, nfkc

# Spellings that mean the same in the hotel and restaurant corpus, in this order.
ALIASES = (
    ("centre", "center"), ("color", "colour"), ("1 person", "1"), ("one person", "1"), ("2 people", "2"), ("two people", "2"), ("3 people", "3"), ("three people", "3"), ("4 people", "4"), ("five people", "5"), ("5 people", "5"),
    ("moderate price", "moderate"), ("moderately priced", "moderate"), ("expensive priced", "expensive"), ("cheap priced", "cheap"), ("guesthouse", "guest house"), ("asian oriental", "asian"), ("north american", "american"), ("panasian", "asian"),
)
# Words without content in goals, in values, and beside ideographs.
STOP_GOAL = tuple(
    "a an the is are was were be to for of in on at by with and or i you we they this that these those my your our user please want need would like find looking search me agent should next do action what it have has had will shall can could may might as from up out if so no not but".split()
)
STOP_VALUE = tuple(
    "the a an of to in on for at by is are was were be been i you he she it we they me my your his her our their this that these those and or but if then so yes no not do does did have has had with without from as than also just about please thanks thank ok okay".split()
)
STOP_CJK = tuple("a an the is are was were be to for of in on at by with and or i you we they this that my your please want need".split())
# Openings of questions, the first that fits is dropped.
SLOT_PREFIXES = ("what is my ", "what's my ", "what was my ", "what is the ", "what's the ", "what was the ", "what ")
# Phrases by which a user takes something back.
CORRECTION_CUES = r"(?i)\b(?:actually|instead|rather|on second thought|scrap that|wait,? (?:let me|i)|let me change|let's change|change (?:it|that|the)|no,? (?:make it|change it|i (?:want|need|meant))|not (?:that|this)|i meant|i'd rather|i would rather|i changed my mind|never mind)\b"
# Words in slot names that stand for places.
PLACE_WORDS = ("city", "location", "origin", "destination", "area", "place", "name", "theater", "hotel", "restaurant", "departure", "dest")


def punctuation_to_space(x: Column | str) -> Column:
    """Every run of characters other than letters, digits, `_`, blanks, `:`, `/` and `-` as one space."""
    return F.regexp_replace(col(x), r"(?U)[^\w\s:/-]+", " ")


def collapse(x: Column | str) -> Column:
    """Blanks of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(col(x), r"(?U)\s+", " "))


def strip(x: Column | str) -> Column:
    """No blanks of any kind at the ends."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def norm_text(x: Column | str) -> Column:
    """Lower case with collapsed blanks."""
    return collapse(F.lower(col(x)))


def apply_aliases(x: Column | str) -> Column:
    """Spelling variants replaced one after another at word bounds."""
    out = col(x)
    for old, new in ALIASES:
        out = F.regexp_replace(out, rf"(?U)\b{old}\b", new)
    return out


#: A time of twelve hours: hour, minutes, half of the day; the second form also has dots in `a.m.`.
HALF_DAY = {False: r"(?U)\b(\d{1,2})(?::(\d{2}))?\s*(am|pm)\b", True: r"(?U)\b(\d{1,2})(?::(\d{2}))?\s*(a\.?m|p\.?m)\b\.?"}


def half_day_times(x: Column | str, dotted: bool = False) -> Column:
    """Twelve-hour times as HH:MM; what lies between them is joined to them again as it was. The text is bound
    once, so that what it is made from is not worked out again for every part."""
    p = F.lit(HALF_DAY[dotted])

    def rewritten(t: Column) -> Column:
        parts = lambda i: F.regexp_extract_all(t, p, i)
        hours = F.transform(parts(1), lambda h: h.cast("int"))
        late = F.transform(parts(3), lambda h: F.startswith(h, F.lit("p")))
        shifted = F.zip_with(hours, late, lambda h, pm: F.when(pm & (h != 12), h + 12).when(~pm & (h == 12), 0).otherwise(h))
        made = F.zip_with(shifted, parts(2), lambda h, m: F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":"), F.when(m == "", "00").otherwise(m)))
        joined = F.array_join(F.flatten(F.zip_with(F.split(t, HALF_DAY[dotted], -1), F.concat(made, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
        return F.when(F.regexp_like(t, F.lit(r"\d\s*[ap]\.?m")), joined).otherwise(t)

    return F.transform(F.array(col(x)), rewritten)[0]


def pad_times(x: Column | str, bare: bool = True) -> Column:
    """`H:MM` as `HH:MM` and, if `bare`, a number of three or four digits as a time where it is one."""
    out = F.regexp_replace(col(x), r"(?U)\b(\d):(\d{2})\b", "0$1:$2")
    if bare:
        out = F.regexp_replace(out, r"(?U)\b(\d)([0-5]\d)\b", "0$1:$2")
        out = F.regexp_replace(out, r"(?U)\b([01]\d|2[0-3])([0-5]\d)\b", "$1:$2")
    return out


def normalize_value(x: Column | str, family: str = "") -> Column:
    """Normal form of a slot value: compatibility form, lower, aliases, times, punctuation, blanks; null
    as ''. `family` is `multiwoz` (with aliases), `lme` (dotted halves of the day, no bare times), or any other."""
    out = strip(F.lower(nfkc(F.coalesce(col(x), F.lit("")))))
    out = apply_aliases(out) if family == "multiwoz" else out
    return collapse(punctuation_to_space(pad_times(half_day_times(out, family == "lme"), family != "lme")))


def normalize_by(x: Column | str, dataset: Column | str) -> Column:
    """Normal form by the row's dataset."""
    return F.when(col(dataset) == "multiwoz", normalize_value(x, "multiwoz")).otherwise(normalize_value(x))


def occurs_bounded(needle: Column | str, hay: Column | str) -> Column:
    """True if the non-empty needle stands in the text with no letter or digit on either side."""
    n, h = col(needle), col(hay)
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(n, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    return F.coalesce((n != "") & h.contains(n) & F.regexp_like(h, quoted), F.lit(False))


def values_match(a: Column | str, b: Column | str, family: str = "") -> Column:
    na, nb = normalize_value(a, family), normalize_value(b, family)
    return (na != "") & (na == nb)


def values_match_loose(prediction: Column | str, reference: Column | str, family: str = "") -> Column:
    """The reference occurs, bounded, in the prediction."""
    return occurs_bounded(normalize_value(reference, family), normalize_value(prediction, family))


def humanize_slot(x: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(col(x), "[_-]+", " ")))


def alias_equivalent(old: Column | str, new: Column | str) -> Column:
    """Equal values, values with one head before the first comma, or one head inside the other when
    the shorter head has three characters or more."""
    a, b = normalize_value(old), normalize_value(new)
    ha, hb = F.trim(F.substring_index(a, ",", 1)), F.trim(F.substring_index(b, ",", 1))
    inside = (F.least(F.length(ha), F.length(hb)) >= 3) & (ha.contains(hb) | hb.contains(ha))
    return (a != "") & (b != "") & ((a == b) | ((ha != "") & (ha == hb)) | inside)


# Phrases that lead a request.
REQUEST_LEAD = r"(?i)^(?:can you |could you |please |i'?d like to |i want to |i need to |i'?m looking to )"


def normalize_task(x: Column | str) -> Column:
    """A request without one leading phrase of asking and without closing marks, in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(col(x), F.lit(""))), REQUEST_LEAD, ""), r"[?.!]+\s*$", "")))


def content_tokens(x: Column | str, stop: tuple[str, ...] = STOP_GOAL) -> Column:
    """Distinct Latin tokens of two characters or more outside the stop list; null as no tokens."""
    words = F.regexp_extract_all(F.lower(F.coalesce(col(x), F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*stop)))


def cjk_tokens(x: Column | str) -> Column:
    """Distinct ideographs of the compatibility form, each a token, and Latin tokens."""
    low = F.lower(nfkc(F.coalesce(col(x), F.lit(""))))
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit(r"([\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}])"), 1), content_tokens(low, STOP_CJK)))


def hangul_tokens(x: Column | str) -> Column:
    """Latin runs and Hangul runs of a text."""
    low = F.lower(F.coalesce(col(x), F.lit("")))
    return F.array_union(F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), 1), F.regexp_extract_all(low, F.lit(r"([\x{AC00}-\x{D7A3}]+)"), 1))


def answer_variants(x: Column | str) -> Column:
    """The text, what stands in each bracket (without a leading `or`), and the text without
    brackets, all without marks at their ends; in order, distinct."""
    t = F.trim(col(x))
    inside = F.transform(F.regexp_extract_all(t, F.lit(r"(?i)\((?:or\s+)?([^()]*)\)"), 1), lambda v: F.btrim(v, F.lit(" .,;")))
    bare = F.btrim(F.regexp_replace(t, r"\([^()]*\)", " "), F.lit(" .,;"))
    return F.array_distinct(F.concat(F.array(t), F.filter(F.concat(inside, F.array(bare)), lambda v: v != "")))


def numbers_of(x: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), 1)


def numeric_only_equivalent(prediction: Column | str, reference: Column | str) -> Column:
    """A prediction without Latin letters holds the same numbers in the same order; for normal forms."""
    p, r = numbers_of(prediction), numbers_of(reference)
    return ~F.regexp_like(F.coalesce(col(prediction), F.lit("")), F.lit("[a-z]")) & (F.size(p) > 0) & (p == r)


def split_answer(x: Column | str) -> Column:
    """Goal, slot and value of `goal; slot: value`: one semicolon, then the first colon; all three
    parts filled, else null."""
    t = col(x)
    one = F.length(t) - F.length(F.replace(t, F.lit(";"), F.lit(""))) == 1
    goal, rest = strip(F.substring_index(t, ";", 1)), F.substring_index(t, ";", -1)
    at = F.instr(rest, ":")
    slot, value = strip(F.substr(rest, F.lit(1), at - 1)), strip(F.substr(rest, at + 1))
    return F.when(one & (at > 0) & (goal != "") & (slot != "") & (value != ""), F.struct(goal.alias("goal"), slot.alias("slot"), value.alias("value")))


def char_cap(x: Column | str, cap: int) -> Column:
    t = col(x)
    return F.when(F.length(t) > cap, F.concat(F.rtrim(F.left(t, F.lit(cap))), F.lit(" [...]"))).otherwise(t)


def question_label(x: Column | str) -> Column:
    """Slot label of a question: without marks and one known opening, its first five words."""
    t = F.lower(F.regexp_replace(F.trim(col(x)), r"\?+$", ""))
    short = t
    for p in reversed(SLOT_PREFIXES):
        short = F.when(F.startswith(t, F.lit(p)), F.substring(t, len(p) + 1, 10_000)).otherwise(short)
    return F.array_join(F.slice(F.regexp_extract_all(short, F.lit(r"([A-Za-z0-9']+)"), 1), 1, 5), " ")


def slot_group(slot: Column | str) -> Column:
    s = F.lower(col(slot))
    places = F.lit(False)
    for w in PLACE_WORDS:
        places = places | s.contains(w)
    return F.when(s.contains("time"), "Time").when(s.contains("date") | s.contains("day"), "Date").when(places, "Place and name").otherwise("Other")


def correction_cue(x: Column | str) -> Column:
    return F.regexp_like(F.coalesce(col(x), F.lit("")), F.lit(CORRECTION_CUES))


def user_speaker(x: Column | str, position: Column | str) -> Column:
    """`USER` or `SYSTEM` from uneven labels; unknown labels alternate by position, user first."""
    s = F.upper(F.trim(F.coalesce(col(x), F.lit(""))))
    return (
        F.when(s.isin("USER", "HUMAN", "CUSTOMER", "用户", "사용자"), "USER")
        .when(s.isin("SYSTEM", "ASSISTANT", "BOT", "AGENT", "系统", "시스템"), "SYSTEM")
        .when(col(position) % 2 == 0, "USER")
        .otherwise("SYSTEM")
    )


def storage_stats(x: Column | str) -> Column:
    """Blank-separated tokens and characters of a text; null as empty."""
    t = F.coalesce(col(x), F.lit(""))
    return F.struct(F.size(F.regexp_extract_all(t, F.lit(r"(\S+)"), 1)).cast("bigint").alias("n_words"), F.length(t).cast("bigint").alias("n_chars"))


def digit_mean(x: Column | str) -> Column:
    """Average of every number in a labelled text, 0 without numbers."""
    numbers = F.transform(numbers_of(x), lambda n: n.cast("double"))
    return F.when(F.size(numbers) == 0, 0.0).otherwise(F.aggregate(numbers, F.lit(0.0), lambda a, b: a + b) / F.size(numbers))


def mean_word_label(x: Column | str) -> Column:
    """Mean of the 0/1 labels behind the last space of each word record; other labels are an error."""
    words = F.filter(F.split(col(x), r"\t\t\|\t\t"), lambda w: F.trim(w) != "")
    labels = F.transform(words, lambda w: F.substring_index(F.rtrim(w), " ", -1))
    right = F.forall(labels, lambda v: v.isin("0", "1"))
    mean = F.aggregate(F.transform(labels, lambda v: v.cast("double")), F.lit(0.0), lambda a, b: a + b) / F.size(labels)
    return F.when(F.size(labels) == 0, 0.0).when(right, mean).otherwise(F.raise_error(F.lit("word label is neither 0 nor 1")).cast("double"))


def keep_last_tokens(x: Column | str, n: int) -> Column:
    """The last `n` blank-separated tokens: over-long prompts lose their oldest text."""
    tokens = F.regexp_extract_all(col(x), F.lit(r"(\S+)"), 1)
    return F.array_join(F.when(F.size(tokens) <= n, tokens).otherwise(F.slice(tokens, -n, n)), " ")


def prompt_parts(x: Column | str) -> Column:
    """Context and question of a prompt, split before its first `Question:` paragraph."""
    t = col(x)
    at = F.instr(t, "\n\nQuestion:")
    return F.struct(F.when(at > 0, F.left(t, at - 1)).otherwise(t).alias("context"), F.when(at > 0, F.substr(t, at)).otherwise("").alias("question"))


def replace_context(prompt: Column | str, old: Column | str, new: Column | str) -> Column:
    """The prompt with another context before the same question; an error if it has another one."""
    p, o = col(prompt), col(old)
    return F.when(F.startswith(p, o), F.concat(col(new), F.substr(p, F.length(o) + 1))).otherwise(F.raise_error(F.lit("prompt does not begin with the given context")))


def sha_prefix(x: Column | str, n: int) -> Column:
    return F.left(F.sha2(col(x), 256), F.lit(n))


def hash_seed(x: Column | str) -> Column:
    """Low 32 bits of the first 64 bits of SHA-256, as a bigint."""
    return F.conv(F.substring(F.sha2(col(x), 256), 9, 8), 16, 10).cast("bigint")
