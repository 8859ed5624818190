"""Problem 8: personal information inside free text, found behind disguises and replaced.

A text is first rewritten by offset-preserving transducers: wide and look-alike characters become
plain ones, hidden characters vanish, `at` and `dot` in words or brackets become their signs, and
numbers said digit by digit become figures, in six languages; every character left remembers where it
came from. Identifiers are then detected in the rewritten text, and their spans are mapped back to the
source, so that positions count code points of the text as it is and everything else stays unchanged.
Names are found by the frames they stand in, and beyond those by candidates that are scored.

Defined results for hard input: null, empty and blank texts have no mentions; texts are read whole;
repeated texts are cases of their own; where mentions overlap the earlier kind in KINDS wins, then
the longer one.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame

from ..runtime import map_rows, spread
from .automata import INVISIBLE

KINDS = ("email", "id_number", "phone", "address", "name")

_HIDDEN = re.compile(f"[{INVISIBLE}]")
_UNEVEN = re.compile(f"[{INVISIBLE}]|[^\\W\\d_][\u0300-\u036f]+|[\u1100-\u115e][\u1161-\u11a7][\u11a8-\u11ff]?")
# Look-alike letters inside addresses and numbers, and signs with a plain twin.
_PLAIN = (
    dict(zip(map(ord, "аеоірсухѕјһԁ"), "aeoipcyxsjhd"))
    | dict.fromkeys(map(ord, "\uff0d\u2010\u2011\u2012\u2013\u2212"), "-")
    | dict.fromkeys(map(ord, "\u00a0\u2005\u2007\u2009\u202f\u3000"), " ")
    | dict(zip(map(ord, "（），．／＃＋＠"), "(),./#+@"))
    | {c: chr(c - 0xFEE0) for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B))}
)


def plain_text(text: str) -> tuple[str, list[int] | None]:
    """Plain form of a text and the source position of each of its characters (None: the same)."""
    if text.isascii():
        return text, None
    if not _HIDDEN.search(text) and unicodedata.is_normalized("NFC", text):
        return text.translate(_PLAIN), None
    out: list[str] = []
    places: list[int] = []
    at, n = 0, len(text)
    for m in _UNEVEN.finditer(text):
        a, b = m.span()
        out.append(text[at:a])
        places.extend(range(at, a))
        ch = text[a]
        if not _HIDDEN.match(ch):
            joined = unicodedata.normalize("NFC", text[a:b])
            if len(joined) == 1:
                out.append(joined)
                places.append(a)
            else:
                out.append(text[a:b])
                places.extend(range(a, b))
        at = b
    out.append(text[at:])
    places.extend(range(at, n))
    places.append(n)
    return "".join(out).translate(_PLAIN), places


# --- disguises: rewriting that keeps offsets ------------------------------------------------------
_AT_WORDS = r"(?:at|ät|arroba|arobase|艾特|골뱅이)"
_DOT_WORDS = r"(?:dot|punkt|punto|point|点|닷|점)"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_TLDS = "example|invalid|test|com|org|net|edu|gov|info|io|co|de|es|fr|kr|cn|uk|it|pt|nl|eu"
#: A sign or word for `@`: bracketed or plain signs anywhere, a bare word only before a host in words or with a known end.
#: Both are matched on text in lower case.
_AT = re.compile(rf"@|\[\s?{_AT_WORDS}\s?\]|\(\s?{_AT_WORDS}\s?\)|\{{\s?{_AT_WORDS}\s?\}}|<{_AT_WORDS}>|\s{_AT_WORDS}\s(?=[a-z0-9](?:[a-z0-9-]*\s{_DOT_WORDS}\s[a-z0-9]|[a-z0-9.-]*\.(?:{_TLDS})(?![a-z0-9-])))")
_DOT = re.compile(rf"\.|\s?\[\s?{_DOT_WORDS}\s?\]\s?|\s?\(\s?{_DOT_WORDS}\s?\)\s?|\s?\{{\s?{_DOT_WORDS}\s?\}}\s?|\s{_DOT_WORDS}\s")
_HOST = re.compile(_LABEL)
_AT_SIGNS = ("@", "at]", "at )", "at)", "at }", "at}", "at ]", "<at>", " at ", "\nat ", " at\n", "ät", "arroba", "arobase", "艾特", "골뱅이")
# Digits in words.
DIGIT_WORDS = {w: str(d) for words in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "cero uno dos tres cuatro cinco seis siete ocho nueve", "zéro un deux trois quatre cinq six sept huit neuf") for d, w in enumerate(words.split())} | {"oh": "0", "nought": "0", "zwo": "2"}
DIGIT_SIGNS = {c: str(d) for signs in ("零一二三四五六七八九", "〇幺两", "공일이삼사오육칠팔구", "영") for d, c in enumerate(signs)} | {"幺": "1", "两": "2", "〇": "0", "영": "0", "륙": "6"}
_TIMES = {"double": 2, "triple": 3}
_WORD_DIGIT = rf"(?:(?:double |triple )?(?:{'|'.join(sorted(DIGIT_WORDS, key=len, reverse=True))}))"
_SAID = re.compile(
    rf"(?<![^\W_])(?:plus[ ,-]+)?{_WORD_DIGIT}(?:[ ,-]+{_WORD_DIGIT}){{6,14}}(?P<ext>,? (?:ext\.?|extension) (?:\d{{1,5}}|{_WORD_DIGIT}(?:[ -]{_WORD_DIGIT})*))?(?![^\W_])"
    rf"|[零〇一二三四五六七八九幺两]{{7,15}}(?![零〇一二三四五六七八九幺两百千万])|(?<![가-힣])[공영일이삼사오육륙칠팔구](?:[ -]?[공영일이삼사오육륙칠팔구]){{6,14}}",
    re.I,
)
_DIGIT_STEMS = tuple(w for w in (*DIGIT_WORDS, *_TIMES) if not any(o != w and o in w for o in (*DIGIT_WORDS, *_TIMES)))
_SAID_SIGNS = re.compile(r"[零〇一二三四五六七八九幺两]{7}|(?:[공영일이삼사오육륙칠팔구][ -]?){7}")


def _says_digits(low: str) -> bool:
    """Whether a text may hold seven digits in words: it then has seven words for digits or repetition."""
    return sum(map(low.count, _DIGIT_STEMS)) >= 7 or not low.isascii() and _SAID_SIGNS.search(low) is not None


def undisguised(plain: str) -> tuple[str, list[tuple[int, int, str]], set[int]]:
    """The text with signs for spoken `at` and `dot` and figures for spoken digits: new text, the edits
    (start, end, what stands there now) in order, and the places of edits that are whole numbers."""
    edits: list[tuple[int, int, str]] = []
    low = plain.lower()
    if len(low) != len(plain):  # a few capitals have longer small forms; offsets must stay
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in plain)
    if any(w in low for w in _AT_SIGNS):
        for at in _AT.finditer(low):
            a, i = at.span()
            a -= a > 0 and low[a - 1].isspace() and not low[a].isspace()
            i += i < len(low) and low[i].isspace() and not low[i - 1].isspace()
            made, ends = [(a, i, "@")], 0
            while label := _HOST.match(low, i):
                dot = _DOT.match(low, label.end())
                if not dot or not _HOST.match(low, dot.end()):
                    break
                made.append((dot.start(), dot.end(), "."))
                i, ends = dot.end(), ends + 1
            if ends and (not edits or edits[-1][1] <= a):
                edits += [x for x in made if plain[x[0] : x[1]] != x[2]]
    said: set[int] = set()
    if _says_digits(low):
        for m in _SAID.finditer(plain):
            if not any(a < m.end() and m.start() < b for a, b, _ in edits):
                edits.append((*m.span(), _figures(m[0][: m.start("ext") - m.start()] if m["ext"] else m[0])))
                said.add(m.start())
    if not edits:
        return plain, edits, said
    edits.sort()
    out, at = [], 0
    for a, b, x in edits:
        out += [plain[at:a], x]
        at = b
    return "".join([*out, plain[at:]]), edits, said


def _figures(words: str) -> str:
    """Figures of a number said digit by digit."""
    out, times = [], 1
    for w in re.findall(r"[^\W\d_]+|\d", words.lower()):
        if w in _TIMES:
            times = _TIMES[w]
        elif w == "plus":
            out.append("+")
        else:
            out.append((DIGIT_WORDS.get(w) or "".join(DIGIT_SIGNS.get(c, c) for c in w)) * times)
            times = 1
    return "".join(out)


def source_spans(found: list[tuple[int, int, str]], edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of the rewritten text as spans of the text before the edits; an edit is covered whole."""
    if not edits:
        return found
    starts, shift = [], 0  # where each edit begins in the rewritten text
    for a, b, x in edits:
        starts.append(a + shift)
        shift += len(x) - (b - a)

    def back(p: int, end: bool) -> int:
        i = bisect_right(starts, p - end) - 1
        if i < 0:
            return p
        a, b, x = edits[i]
        if p - starts[i] < len(x) + end:
            return b if end else a
        return b + p - starts[i] - len(x)

    return [(back(a, False), back(b, True), k) for a, b, k in found]


# --- email -------------------------------------------------------------------------------------
_DOMAIN = rf"{_LABEL}(?:\.{_LABEL})*?\.[A-Za-z]{{2,24}}(?![A-Za-z0-9-])(?!\.[A-Za-z]{{2,24}}(?![A-Za-z0-9-]))"
EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9_%+-]|\.(?=[A-Za-z0-9]))*@{_DOMAIN}", re.I)

# --- identity numbers --------------------------------------------------------------------------
# National shapes of passports, licences, tax and insurance numbers.
_ID_SHAPES = (
    r"\d{3}-\d{2}-\d{4}", r"\d{3} \d{2} \d{4}",
    r"[A-Z]\d{3}-\d{4}-\d{4}", r"[A-Z]\d{8}", r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]",
    r"\d{6}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]",
    r"\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])-\d{7}",
    r"\d{2} \d{3} \d{3} \d{3}", r"\d{8}-?[A-Z]", r"[XYZ]-?\d{7}-?[A-Z]",
    r"\d \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}",
)
_DIGITS, _LETTERS_BEFORE = re.compile(r"\d+"), re.compile(r"(?:[XYZ]-|[A-Z]{2} ?|[A-Z])$")
ID_NUMBER = re.compile(r"(?:" + "|".join(_ID_SHAPES) + r")(?![A-Za-z0-9/_])(?!-\d)(?! \d{2,}\b(?!:))")
# What an official number of a person is called.
_ID_LABEL = re.compile(
    r"(?:\b(?:passport|driv(?:er'?s?|ing) licen[cs]e|licen[cs]e|national id|identity (?:card|number)|id (?:number|card|no)|ssn|social (?:security|insurance)|national insurance|tax (?:id|number|identification)|reisepass|personalausweis|ausweis\w*|führerschein\w*|steuer-?id\w*|steuernummer|sozialversicherung\w*|dni|nie|nif|pasaporte|seguridad social|permiso de conducir|passeport|permis de conduire|carte d'identité|sécurité sociale|numéro fiscal)\b|护照|身份证|驾照|驾驶证|社保|税号|여권|주민등록|운전면허)(?:[ ,:：#.]|是|号|码|번호|는|은|number|card|no|num[eé]ro|nummer|is|it|ist|lautet|es|est|de|du|n[º°]){0,8}$",
    re.I,
)
_ID_TOKEN = re.compile(r"[A-Z]{0,3}\d(?:[A-Z0-9]|[ -](?=[A-Z]?\d)){4,19}(?![A-Za-z0-9])")

# --- phones ------------------------------------------------------------------------------------
_EXT = r"(?:,? ?(?:ext\.?|extension|x|#|Durchwahl|Dw\.?|分机|内线|내선) ?\d{1,5})?"
# National shapes of telephone numbers.
_PHONE_SHAPES = (
    rf"(?:\+1[ .-]?)?(?:\(\d{{3}}\) ?|\d{{3}}[ .-]?)\d{{3}}[ .-]?\d{{4}}{_EXT}",
    rf"\+44 ?(?:\(0\) ?)?\d{{2,5}}(?: ?\d{{3,6}}){{1,2}}{_EXT}", rf"0\d{{4}} ?\d{{3}} ?\d{{3}}{_EXT}",
    rf"(?:\+49|0049)[ -]?(?:\(0\))?\d{{2,5}}[ /-]\d{{3,8}}(?:[ -]\d{{2,5}})?{_EXT}", rf"\(0\d{{2,4}}\) ?\d{{2}} \d{{2}} \d{{2,4}}{_EXT}", rf"0\d{{2,4}}/\d{{5,8}}{_EXT}",
    rf"\+34 ?\d{{3}} ?\d{{2,3}} ?\d{{2,3}}(?: ?\d{{2}})?{_EXT}", rf"\d{{3}} \d{{2}} \d{{2}} \d{{2}}{_EXT}", r"\d{9}", rf"\d{{3}} \d{{3}} \d{{3}}{_EXT}",
    rf"\+33 ?(?:\(0\))?\d(?:[ .]?\d{{2}}){{4}}{_EXT}", rf"\d{{2}}(?:[ .]\d{{2}}){{4}}{_EXT}",
    rf"\+86[ -]?\d{{3}}[ -]?\d{{4}}[ -]?\d{{4}}{_EXT}", r"\d{11}", rf"\d{{3}}-\d{{4}}-\d{{4}}{_EXT}", rf"\(0\d{{2,3}}\) ?\d{{7,8}}{_EXT}", r"0\d{2,3}-\d{7,8}",
    rf"\+82[ -]?\d{{1,2}}[ -]?\d{{3,4}}[ -]?\d{{4}}{_EXT}", rf"\d{{3}} \d{{4}} \d{{4}}{_EXT}",
    rf"\+(?!(?:1|33|34|44|49|82|86)(?!\d))[1-9]\d{{0,2}}(?:[ .-]?\(?\d{{1,4}}\)?){{2,5}}\d{{2}}{_EXT}",
)
PHONE = re.compile(r"(?:" + "|".join(_PHONE_SHAPES) + r")(?![A-Za-z0-9/_])(?!-\d)")
#: What stands before a number that is no telephone or identity number.
_OTHER_NUMBER = re.compile(r"(?:tracking (?:code|number)(?: is)?|reference(?: number)?(?: is)?|order(?: number)?|invoice|run|template|单号|参考号是?|订单|编号|Sendungsnummer(?: lautet)?|Vorgangsnummer lautet|localizador es|seguimiento es|référence est|suivi est|예약 번호는|송장 번호는|운송장 번호는)[ :：#]*$", re.I)

# --- addresses ---------------------------------------------------------------------------------
_UP = r"[A-ZÀ-Þ][\w'’À-ÿ-]*"
#: A contraction such as St has no dot of its own at the end of a sentence, a cut word such as Ave. has.
_ANY = r"[\w'’À-ÿ-]+"
_EN_TYPE = r"(?:Street|Road|Avenue|Lane|Close|Crescent|Terrace|Row|Drive|Court|Place|Square|Gardens|Grove|Way|Walk|Mews|Boulevard|Hill|Park|Rise|View|(?:St|Rd|Ln|Dr|Ct|Blvd)\b(?:\.(?=,|\.| (?-i:[a-z])))?|(?:Ave|Cres|Terr?)\b\.?)"
_UNIT_BEFORE = re.compile(r"(?:Flat|Apt\.?|Apartment|Unit|Suite) \d+[A-Za-z]?, $", re.I)
_ADDRESS_EN = rf"\d{{1,4}}[A-Za-z]? (?:{_ANY} ){{1,3}}?{_EN_TYPE}(?![\w'-])(?:, (?:Flat|Apt\.?|Apartment|Unit|Suite) \d+[A-Za-z]?\b)?"
_ADDRESS = (
    rf"(?i:{_ADDRESS_EN})",
    rf"(?:(?:Am|An der|An den|Auf der|Im|In der|Zum|Zur|Unter den) {_UP}(?: {_UP})?|[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer|damm|steig|pfad)|[A-ZÄÖÜ][\wäöüß-]* (?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Ring|Ufer|Damm)) \d{{1,4}} ?[a-z]?(?![\w:])",
    rf"(?i:(?:Calle|C/|Avda\.|Avenida|Av\.|Plaza|Pza\.|Paseo|Camino|Ronda|Travesía)) ?(?:(?:de|del|la|las|los|el) )*{_UP}(?: (?:(?:de|del|la|las|los|y) )*{_UP})*, ?(?:n\.?º ?)?\d{{1,4}}[A-Za-z]?(?:, \d{{1,2}}\.?[ºª°] ?(?:[A-Z]|izq\.?|dcha\.?)?(?![\w]))?",
    rf"\d{{1,4}}(?: (?:bis|ter|quater))?,? (?:rue|avenue|av\.|impasse|boulevard|bd|place|chemin|allée|quai|cours|route|passage|square)(?: (?:de|du|des|la|le|les|l'|d'|aux?|à la))*(?: ?{_UP})(?: (?:(?:de|du|des|la|le|les) )*{_UP})*(?:, (?:appt?\.?|appartement|bât\.?|étage) ?\w+)?",
    rf"\b(?:Via|Viale|Piazza|Corso|Rua|Praça) (?:(?:di|del|della|dei|da|do|dos|de) )*{_UP}(?: {_UP})*,? (?:n\.? ?)?\d{{1,4}}[A-Za-z]?\b",
    r"[一-鿿]{2}(?:大道|路|街|巷|弄|胡同)(?:[东西南北]段)?\d{1,5}号(?:院)?(?:\d{1,3}(?:栋|幢|号楼))?(?:\d单元)?(?:\d{1,5}室)?",
    r"(?<![가-힣])[가-힣]{2,8}(?:대로|로|길) ?\d{1,4}(?:-\d{1,3})?(?:번길 ?\d{1,4})?(?:, ?(?:\d{1,4}동 ?)?\d{1,5}호)?",
)
#: Words of which one is in every address of a language, in lower case; none: always look.
_ADDRESS_WORDS = (
    (), ("str", "weg", "gasse", "platz", "allee", "ring", "ufer", "damm", "steig", "pfad", "am ", "an de", "auf der", "im ", "in der", "zum ", "zur ", "unter den"),
    ("calle", "c/", "avda", "avenida", "av.", "plaza", "pza", "paseo", "camino", "ronda", "travesía"), ("rue", "avenue", "av.", "impasse", "boulevard", "bd", "place", "chemin", "allée", "quai", "cours", "route", "passage", "square"), ("via ", "viale", "piazza", "corso", "rua ", "praça"), ("号",), ("로", "길"),
)
#: Addresses that begin with the house number are tried at numbers only.
_NUMBER_FIRST = ("(?i:\\d{1,4}", "\\d{1,4}")
ADDRESSES = [(words, re.compile(a)) for words, a in zip(_ADDRESS_WORDS, _ADDRESS)]

# --- names -------------------------------------------------------------------------------------
_T = r"(?:[OoDd]['’])?[^\W\d_](?:[^\W\d_]|['’](?=[^\W\d_]))+(?:-[^\W\d_]+)*"
_I = r"[^\W\d_]\."
#: A full name: given and family name, either of them an initial, or family name first; or one alone.
_FULL = rf"(?:{_T}, (?:{_T}|{_I})(?: {_I})?(?= |$|[.,;:/\n\r])|(?:{_T}|{_I})(?: ?{_I})? {_T}|{_T},? {_I}(?! ?[a-z]))"
_NAME = rf"(?P<name>{_FULL}|{_T}|{_I} {_T})"
_FULLY = rf"(?P<name>{_FULL})"
# What stands before and after a person's name, by language, with words of which one
# is in every such place.
_NAME_FRAMES = (
    (("y name is",), rf"[Mm]y name is {_NAME}(?= and you| and I|[.,;!]| but)"), (("I am ",), rf"\bI am {_NAME}(?=, we spoke)"), (("This is ",), rf"\bThis is {_NAME}(?= again\b| speaking| from )"),
    ((" here, ",), rf"(?<![\w'’.-]){_FULLY}(?= here, )"), (("=",), rf"\b(?:holder|guest|name|owner|passenger)={_NAME}(?=[;,]|$|\s)"),
    (("caller ",), rf"\bthe caller {_NAME}(?= asked\b| called\b| wants\b)"), (("is under ",), rf"\bis under {_NAME}(?=, phone|[.;])"), (("Guest: ", "Name: ", "Contact: "), rf"\b(?:Guest|Name|Contact): {_NAME}(?= /|;|$|\n)"),
    (("driver, ",), rf"\bsecond driver, {_NAME}(?=\.)"), (("It was ",), rf"\bIt was {_NAME}(?= who )"), (("Ask for ",), rf"\bAsk for {_NAME}(?= at )"), (("agreed with ",), rf"\bagreed with {_NAME}(?= yesterday| today| on |[.,;])"),
    (("Regards", "Sincerely", "Yours", "Signed", "Best"), rf"\b(?:Regards|Sincerely|Yours|Signed|Best wishes|Best)(?:,|(?=\s*\n)) ?\s*{_FULLY}"), (("Thanks, ",), rf"\bThanks, (?P<name>{_T})(?! for\b)"),
    (("Dear ",), rf"\bDear (?:(?:Mr|Mrs|Ms|Miss|Dr|Mx)\.? )?{_NAME}(?=[,:!])"), (("Mr", "Ms", "Miss", "Dr", "Mx"), rf"\b(?:Mr|Mrs|Ms|Miss|Dr|Mx)\.? (?P<name>{_T})"),
    (("Name ist ",), rf"\bMein Name ist {_NAME}(?=, Sie|[.,;])"), (("Frau ", "Herr"), rf"\b(?:Frau|Herrn?) (?P<name>{_T})"), (("Grüßen",), rf"\bGrüßen,?\s+{_FULLY}"), (("besprochen",), rf"\b(?i:wie mit) {_NAME}(?= besprochen)"),
    (("Ich bin ", "Hier "), rf"\b(?:Ich bin|Hier ist|Hier spricht) {_NAME}(?=[.,;])"),
    (("llamo ",), rf"\bMe llamo {_NAME}(?= y mi\b|[.,;])"), (("Según ",), rf"\bSegún {_NAME}(?=, la |, el )"), (("saludo",), rf"\bUn saludo,?\s+{_FULLY}"), (("Soy ", "Fue "), rf"\b(?:Soy|Fue) {_NAME}(?= quien|[.,;])"),
    (("nombre de ",), rf"\ba nombre de {_NAME}(?=, m|, t|[.;])"), (("Sr", "Dña"), rf"\b(?:Sra?\.?|Dña\.) (?P<name>{_T})(?=[,.;: ])"),
    (("appelle ",), rf"\bJe m'appelle {_NAME}(?=, joignable|[.,;])"), (("C'est ",), rf"\bC'est {_NAME}(?= qui )"), (("Cordialement",), rf"\bCordialement,?\s+{_FULLY}"), (("Madame", "Monsieur", "Mme", "M. "), rf"\b(?:Madame|Monsieur|Mme|M\.) (?P<name>[A-ZÀ-Þ][\w'’-]+)(?=[,.;: ])"),
    ((), r"(?:我叫|我是|联系人?[：:]?|预订人[：:]|收件人[：:]?|姓名[：:]|上次是|您好[，,])\s?(?P<name>[一-鿿]{2,4}?)(?=[，,。]|即可|帮我|女士|先生|$)"), (("找",), r"找(?P<name>[一-鿿]{2,4})(?=[。，,！]|$|\n)"),
    (("이름은", "예약자", "성함은", "담당자"), r"(?:이름은|예약자|성함은|담당자) ?(?P<name>[가-힣]{2,4}?)(?=이고|이며|입니다|, |,|님| |$)"), ((" 님", " 씨"), r"(?<![가-힣])(?P<name>[가-힣]{2,4})(?= 님| 씨)"),
)
_NAMES = [(words, re.compile(p, re.M)) for words, p in _NAME_FRAMES]
_NOT_NAMES = frozenset("the a an this that it what which who there here everyone again still for and 您的 我的 客服 前台 司机 用户 고객 손님 담당자".split())


# Given names that start a candidate, in lower case.
GIVEN = frozenset(
    "james john robert michael william david richard joseph thomas charles daniel matthew anthony mark paul steven andrew peter george edward brian kevin jason mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa margaret emily emma olivia sophia anna anne laura julia kate alice grace lucy helen rachel hannah "
    "hans klaus jürgen wolfgang stefan thomas andreas michael uwe lukas felix petra sabine monika claudia ursula heike katrin lena "
    "josé juan antonio manuel francisco luis carlos javier miguel pedro pablo diego maría maria carmen ana isabel lucía elena sofía rosa marta "
    "jean pierre michel philippe jacques louis françois antoine marie nathalie isabelle sophie camille chloé claire "
    "marco giuseppe luca giovanni paolo giulia francesca chiara joão tiago ana beatriz ivan sergei dmitri olga natasha tatiana "
    "ahmed mohamed muhammad ali omar hassan fatima aisha layla rahul amit raj sanjay vijay priya anita deepa sunita wei ming li hiroshi kenji yuki sakura minjun jisoo kwame chidi amara zara leila niamh siobhan owen".split()
)
_CAPITAL = r"[A-ZÀ-Þ][a-zß-ÿ]+(?:[-'’][A-ZÀ-Þ]?[a-zß-ÿ]+)*"
_CANDIDATE = re.compile(rf"(?<![\w'’.-])(?P<name>(?P<given>{_CAPITAL})(?: [A-Z]\.)?(?: (?:de|da|van|von|der|del|la|bin|al))*(?: {_CAPITAL}){{1,2}})(?![\w'’-])")
# What stands next to a person and what is no person.
_BEFORE = re.compile(r"(?:\b(?:to|with|from|by|for|and|ask|call|contact|meet|met|tell|cc|attn|attention|signed|yours|regards|sincerely|thanks|colleague|manager|doctor|nurse|guest|driver|director|named|mit|von|an|bei|frag|con|de|para|avec|par|pour|chez)[:,]?\s+)$", re.I)
_AFTER = re.compile(r"\s*(?:,? (?:who|said|says|asked|asks|called|wrote|writes|will|has|had|is|was|confirmed|told|works|from|in|at|on|and|sagte|hat|ist|dijo|ha|es|a dit|est)\b|[.,;!?)]|$|\n)")
_NO_PERSON = frozenset("hotel house inn lodge grill kitchen bistro table café cafe restaurant station street road avenue lane square park museum theatre theater university school college hospital airport bank office bar pub club church bridge tower hall court gardens guest north south east west monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december street place floor room company group gmbh ltd inc corp city river lake mount".split())


def _scored_names(plain: str):
    """Names that stand in no known frame: runs of capitalised words, scored. A common given name counts
    two, a word before or behind that goes with persons one each; three are enough. Runs that hold or
    precede a word for a place or a firm, or follow `the`, are none."""
    for m in _CANDIDATE.finditer(plain):
        if m["given"].lower() not in GIVEN:
            continue
        words = {w.lower() for w in m["name"].split()}
        follows = plain[m.end() + 1 : m.end() + 16].split(" ", 1)[0].lower().strip(".,;:!?")
        if not words & _NO_PERSON and follows not in _NO_PERSON and not plain[: m.start()].lower().endswith("the ") and 2 + bool(_BEFORE.search(plain, max(0, m.start() - 20), m.start())) + bool(_AFTER.match(plain, m.end())) >= 3:
            yield m.span("name")


class _Taken:
    """Spans that do not overlap, in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.spans: list[tuple[int, int, str]] = []

    def add(self, a: int, b: int, kind: str) -> None:
        at = bisect_left(self.starts, b)
        if at == 0 or self.spans[at - 1][1] <= a:
            self.starts.insert(at, a)
            self.spans.insert(at, (a, b, kind))


def _number_begins(text: str, at: int, more: str) -> bool:
    """Whether a number may begin at a place: not inside a word, a number, a path or a list."""
    if at == 0:
        return True
    before = text[at - 1]
    if before in "./_+" or before in more and before != "," or before.isascii() and before.isalnum():
        return False
    return not (before == " " or before in more) or at < 2 or not text[at - 2].isdigit()


def _spans(plain: str) -> list[tuple[int, int, str]]:
    text, edits, said = undisguised(plain)
    taken = _Taken()
    low = text.lower()
    if "@" in text:
        for m in EMAIL.finditer(text):
            taken.add(*m.span(), "email")
    other = lambda at: _OTHER_NUMBER.search(text, max(0, at - 40), at)
    labelled = lambda at: _ID_LABEL.search(text, max(0, at - 40), at)
    starts = [a + sum(len(x) - (d - c) for c, d, x in edits if c < a) for a in sorted(said)]
    ends = {s: s + len(next(x for a, _, x in edits if a == p)) for s, p in zip(starts, sorted(said))}
    for a, b in ends.items():
        taken.add(a, b, "id_number" if labelled(a) else "phone")
    runs = [m.start() for m in _DIGITS.finditer(text)]
    for run in runs:
        at = run
        if at and text[at - 1] in "-ABCDEFGHIJKLMNOPQRSTUVWXYZ " and (lead := _LETTERS_BEFORE.search(text, max(0, at - 3), at)):
            at = lead.start()
        if not _number_begins(text, at, "-"):
            at = run
            if not _number_begins(text, at, "-"):
                continue
        m = ID_NUMBER.match(text, at) or (ID_NUMBER.match(text, run) if at < run and _number_begins(text, run, "-") else None)
        if m and not other(m.start()):
            taken.add(*m.span(), "id_number")
        elif not m and labelled(at) and (m := _ID_TOKEN.match(text, at)) and sum(c.isdigit() for c in m[0]) >= 5:
            taken.add(*m.span(), "id_number")
    for run in runs:
        for at in (run - 1, run) if run and text[run - 1] in "+(" else (run,):
            if _number_begins(text, at, "-#,"):
                m = PHONE.match(text, at)
                if m and not other(at):
                    taken.add(*m.span(), "phone")
                    break
    for words, pattern in ADDRESSES:
        if words and not any(w in low for w in words):
            continue
        if pattern.pattern.startswith(_NUMBER_FIRST):
            for run in runs:
                if (not run or not (text[run - 1].isalnum() or text[run - 1] == "_")) and (m := pattern.match(text, run)):
                    unit = _UNIT_BEFORE.search(text, max(0, run - 20), run)
                    taken.add(unit.start() if unit else run, m.end(), "address")
        else:
            for m in pattern.finditer(text):
                taken.add(*m.span(), "address")
    for words, pattern in _NAMES:
        if words and not any(w in text for w in words):
            continue
        for m in pattern.finditer(text):
            a, b = m.span("name")
            if text[a:b].lower() not in _NOT_NAMES:
                taken.add(a, b, "name")
    for a, b in _scored_names(text):
        taken.add(a, b, "name")
    return source_spans(taken.spans, edits)


def mentions(text: str | None) -> list[tuple[str, int, int]]:
    """Mentions of a text as (kind, start, end) in its own code points."""
    if not text:
        return []
    plain, places = plain_text(text)
    found = _spans(plain)
    if places is None:
        return [(kind, a, b) for a, b, kind in found]
    return [(kind, places[a], places[b - 1] + 1 if places[b] - places[b - 1] == 1 else _end(text, places, b)) for a, b, kind in found]


def _end(text: str, places: list[int], b: int) -> int:
    """End in the source: combining marks belong to their letter, hidden characters do not."""
    end = places[b - 1] + 1
    while end < places[b] and unicodedata.combining(text[end]):
        end += 1
    return end


def redact(text: str | None, found: list[tuple[str, int, int]] | None = None) -> str | None:
    """Text with typed placeholders for its mentions; a null stays null."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in mentions(text) if found is None else found:
        out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join([*out, text[at:]])


def personal_mentions(documents: DataFrame) -> DataFrame:
    """Every mention: doc_id, kind, start_pos, end_pos."""

    def run(cols: list[list]) -> list[list]:
        rows = [(d, *m) for d, t in zip(*cols) for m in mentions(t)]
        return [list(x) for x in zip(*rows)] or [[], [], [], []]

    return map_rows(spread(documents.select("doc_id", "text")), run, "doc_id bigint, kind string, start_pos bigint, end_pos bigint")


def redacted(documents: DataFrame) -> DataFrame:
    """Every document with its mentions as placeholders: doc_id, redacted_text, n_mentions."""

    def run(cols: list[list]) -> list[list]:
        found = [mentions(t) for t in cols[1]]
        return [cols[0], [redact(t, m) for t, m in zip(cols[1], found)], [len(m) for m in found]]

    return map_rows(spread(documents.select("doc_id", "text")), run, "doc_id bigint, redacted_text string, n_mentions int")
