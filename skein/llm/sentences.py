"""Sentence boundaries across languages and scripts (problem 7)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from skein.session import spread

# Character classes used by the rules (fixed values).
UP = "A-ZÀ-ÖØ-ÞА-ЯЁІЇЄҐ"
LO = "a-zß-öø-ÿа-яёіїєґ"
CLOSE = "\"”’»)\\]」』）】"
OPEN = "\"“„«(\\[「『（【¿¡'‘*_—–\\-"

# Abbreviations (fixed values). BEFORE_NAME: a name follows. ALWAYS: something always follows. BEFORE_NUMBER: no end
# before a number. MAY_END: may stand at the end of a sentence, so a capital letter after it starts a new one.
BEFORE_NAME = "інж ст Dr Mr Mrs Ms Prof St Sr Sra Srta Dra D Dña Fr Hr Hrn Rev Gen Col Capt Lt Sgt Sen Gov Mt Eng Exmo инж проф акад доц гр ім им св тов ул вул г-н г-жа д-р डॉ प्रो श्री ดร นพ"
ALWAYS = "cf vs viz esp approx incl excl resp e.g i.e vgl ca bzw z.B d.h u.a Mio Mrd aprox tel ej см див ок напр т.е бл"
BEFORE_NUMBER = "v ver vers no nos vol vols fig figs ch chap sec eq ed eds p pp Abb Nr Bd Kap Tab S Art Abs Stk pág págs núm nº рис стр табл гл мал п с №"
MAY_END = "al etc usw ff p.m a.m Ltd Inc Co Corp Jr Sr Bros EE.UU т.д т.п др пр г гг в вв р рр руб грн тощо тыс млн млрд ін"
MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jahrhundert Jh"
# Words that show that a quotation before them is the speech of this sentence (fixed values).
SPEECH = "asked said wrote replied answered added called cried whispered shouted explained noted fragte sagte schrieb rief antwortete meinte preguntó dijo escribió respondió perguntou disse escreveu respondeu спросил спросила сказал сказала написал ответил запитав запитала сказав написав відповів पूछा कहा लिखा बोला 问 問 说 說 道 答 喊"
# Words that start sentences, to tell "… plan B. The …" from an initial (fixed values).
STARTERS = "The This That It He She They We But And In On At By For When Some Most Nobody Der Die Das Es Wir Ein Eine El La Los Las En Un Una O A Os As Em В На Это Мы Но И"


def _alt(words: str) -> str:
    return "|".join(sorted((re.escape(w).replace(r"\.", r"\.\s?") for w in set(words.split())), key=len, reverse=True))


_B = rf"(?<![{UP}{LO}0-9_ऀ-ॿ฀-๿])"
_NEXT_UP = rf"\s*[{OPEN}]*[{UP}0-9ऀ-ॿ฀-๿぀-ヿ㐀-鿿０-ｚ]"

#: Rule tables: (breaks?, pattern before the position, pattern after it). The tables named for a script are
#: tried one after the other (a language's own rules, then the script's, then the general ones); the first pair
#: that matches decides. A position no rule matches is no boundary.
TABLES: dict[str, list[tuple[bool, str, str]]] = {
    "plain": [(True, rf"[{LO}]{{7}}\.|[{LO}]{{2}}[!?]", rf"\s+[{UP}]")],  # longer than any abbreviation; most positions end here
    "general": [
        (False, r"", r"[,;:，、；：]"),  # the sentence goes on after the mark
        (False, r"", rf"\s*[—–-]\s?[{LO}]"),  # dialogue dash: «…?» — спросил, ? —preguntó
        (False, r"", rf"\s+[{LO}]"),  # a small letter never starts a sentence
    ],
    "en": [(False, _B + r"(?:[ap]\.\s?m)\.", rf"\s+(?:on|in|at|and|or|{_alt('Monday Tuesday Wednesday Thursday Friday Saturday Sunday')})\b")],
    "de": [(False, r"(?<!\d)\d{1,2}\.", rf"\s+(?:{_alt(MONTHS)})\b"), (False, _B + r"[zdu]\. ?[Bha]\.", r"\s")],
    "latin": [
        (False, rf"(?:^|\n)\s*(?:\d{{1,3}}|[{UP}{LO}])\.", r"[ \t]"),  # list number at the start of a line
        (False, _B + rf"[{LO}]\.", rf"\s?[{UP}{LO}]\."),  # the first half of an abbreviation of two letters
        (False, _B + rf"(?:{_alt(BEFORE_NAME)}|(?i:{_alt(ALWAYS)}))\.", r"\s*[^\s]"),
        (False, _B + rf"(?i:{_alt(BEFORE_NUMBER)})\.", r"\s*[(#№]?\d"),
        (False, rf"(?:^|[^{UP}{LO}])[{UP}]\.", rf"\s?(?!(?:{_alt(STARTERS)})\s)[{UP}]"),  # initials
        (True, _B + rf"(?:{_alt(MAY_END)})\.", rf"\s+[{OPEN}]*[{UP}]|\s*$"),
        (False, _B + rf"(?:{_alt(MAY_END)})\.", r"."),
        (True, rf"[{LO}0-9%)»”\"]\.", rf"[{OPEN}]*(?:[{UP}][{LO}{UP}]|[AIOEYÀÉАВИКОСУЯЗІЙ]\s)"),  # the space after the stop is missing
        (False, r"[.!?…]", r"[^\s]"),  # inside a number, version, name or file name
        (True, r"[.!?…]", _NEXT_UP),
        (True, r"[.!?…]", r"\s+[\"“„«(\[「¿¡#*_>|~`\\{<$+=&§-]"),
    ],
    "thai": [(False, _B + r"(?:ดร|นพ|พ\.ศ|ค\.ศ)\.", r""), (False, r"\.", r"[^\s]"), (False, r"[.!?…]", r"\s*[฀-๿]"), (True, r"[.!?…]", _NEXT_UP)],
    # a space behind a Thai letter ends a unit unless it stands at a numeral, Latin letters or a quotation mark
    "thai space": [(False, r"", r"[\dA-Za-z\"“”„«»'(]|\Z"), (True, r"", r"")],
    "danda": [(True, r"[।॥|?!]", r"\s*."), (False, r"\.", r"[^\s]"), (False, _B + rf"(?:{_alt(BEFORE_NAME)})\.", r""), (True, r"\.", _NEXT_UP)],
    "cjk": [
        (False, r"[…‥.]", r"[぀-ヿ㐀-鿿]"),  # an ellipsis inside a sentence
        (False, r"．", r"\d"),
        (False, r"[」』”\"’»]", r"と|って|という|などと"),  # quoted speech goes on: 「…。」と
        (True, r"[。｡．！？!?]", r"\s*."),
    ],
}
#: Which tables a position uses, by the script of the letter before the mark.
CASCADE = {"thai space": ("thai space",), "latin": ("plain", "general", "en", "de", "latin"), "thai": ("thai", "general", "latin"), "danda": ("general", "danda"), "cjk": ("cjk", "general", "latin")}
_RULES = {s: [(v, re.compile(rf"(?:{b})[{CLOSE}“]*\Z") if b else None, re.compile(a)) for t in tables for v, b, a in TABLES[t]] for s, tables in CASCADE.items()}

# Each of the two starts with a look at the first character, which rules out most positions at once.
_SPAN = re.compile(r"(?=[„“«「『\"(（])(?:„[^„“”\n]*[“”]|“[^“”]*”|«[^«»]*»|「[^「」]*」|『[^『』]*』|(?<![\w\"])\"[^\"]*\"|\([^()]*\)|（[^（）]*）)")
_MARK = re.compile(rf"(?=[.!?…。！？．｡।॥|{CLOSE}\s\u200b])(?:[.!?…。！？．｡।॥]+(?:\s?\.\.\.?)?[{CLOSE}]*|(?<=[ऀ-ॿ])\s?\|[{CLOSE}]*|[{CLOSE}]*\n\s*|(?<=[฀-๿])[  ​]+)")
_BLANK = re.compile(r"[ \t\r\f\v ]*\n[ \t\r\f\v ]*\n\s*")
_DONE = re.compile(rf"[.!?…。！？．｡।॥|][{CLOSE}“]*\s*\Z")
_FUNCTION_END = re.compile(r"(?i)\b(?:the|a|an|of|and|or|to|in|on|for|with|by|at|that|und|der|die|das|den|ein|eine|mit|von|zu|de|la|el|los|las|y|en|que|o|e|os|da|do|и|в|на|с|что|і|у|та|що)\Z")
_SPEECH = re.compile("|".join(w if ord(w[0]) >= 0x0900 else rf"\b{w}\b" for w in SPEECH.split()))
_STOP = re.compile(r"[.!?。！？।｡．|\n]")
_HEAD_NEXT = re.compile(rf"[{OPEN}#]*[{UP}0-9ऀ-ॿ฀-๿぀-ヿ㐀-鿿]")
#: A line of at most so many characters and words without a final stop can be a heading.
HEADING_CHARS, HEADING_WORDS = 32, 5
_LOOK = 28  # characters of context that the longest before-pattern can need


def _script(ch: str) -> str:
    o = ord(ch)
    if 0x0E00 <= o <= 0x0E7F:
        return "thai"
    if 0x0900 <= o <= 0x0DFF:
        return "danda"
    if 0x3040 <= o <= 0x30FF or 0x3400 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF or 0xFF66 <= o <= 0xFF9F or 0x20000 <= o <= 0x3FFFF:
        return "cjk"
    return "latin"


def _heading(text: str, start: int, end: int, follows: int, opened: bool) -> bool:
    """Whether text[start:end], which a single line break ends, is a heading; opened: nothing but headings stands before it in its paragraph."""
    line = text[start:end].strip()
    if line.startswith("#"):
        return True
    if not opened or not line or len(line) > HEADING_CHARS or len(line.split()) > HEADING_WORDS:
        return False
    return bool(_HEAD_NEXT.match(text, follows)) and not _FUNCTION_END.search(line)


def boundaries(text: str | None) -> list[int]:
    """End positions (code points, behind the last character) of the sentence units of text; [] for null or blank text."""
    if not text or not text.strip():
        return []
    out: list[int] = []
    begin = 0
    for m in [*(_BLANK.finditer(text) if "\n" in text else ()), None]:
        stop = m.start() if m else len(text)
        if text[begin:stop].strip():
            _paragraph(text, begin, stop, out)
        begin = m.end() if m else stop
    return out


def _paragraph(text: str, begin: int, stop: int, out: list[int]) -> None:
    while begin < stop and text[begin].isspace():
        begin += 1
    while stop > begin and text[stop - 1].isspace():
        stop -= 1
    plain = text.isascii()
    spans = [x.span() for x in _SPAN.finditer(text, begin, stop)]
    at, start, opened = 0, begin, True
    for m in _MARK.finditer(text, begin, stop):
        pos, end = m.start(), m.end()
        ch = text[pos]
        while at < len(spans) and spans[at][1] <= pos:
            at += 1
        inside = spans[at] if at < len(spans) and spans[at][0] < pos < spans[at][1] else None
        if inside and end == inside[1] - 1 and text[end] == "“":  # closes a German quotation, opens elsewhere
            end = inside[1]
        if "\n" in m.group():
            cut = pos + len(m.group().rstrip())
            if inside and inside[1] > cut:
                continue
            if not _DONE.search(text, start, cut):
                if _heading(text, start, cut, end, opened):
                    out.append(cut)
                    start = end
                elif "฀" <= text[cut - 1] <= "๿" and "฀" <= text[end : end + 1] <= "๿":
                    out.append(cut)
                    start, opened = end, False
                continue
            if _decide(text, _script_before(text, start, cut), start, cut, stop, True) and not _continues(text, start, cut, end, stop):
                if cut > (out[-1] if out else 0):
                    out.append(cut)
                start, opened = end, False
            continue
        if ch.isspace():  # behind a Thai letter
            if inside or not _decide(text, "thai space", start, end, stop):
                continue
            out.append(pos)
            start, opened = end, False
            continue
        if inside and inside[1] > end:
            continue  # a mark within a quotation or brackets
        if end >= stop:
            break
        script = "latin" if plain else _script_before(text, start, pos)
        if ch in "。｡．！？" and script == "latin":
            script = "cjk"
        elif ch in "।॥|" or script == "danda":
            script = "danda"
        if not _decide(text, script, start, end, stop):
            continue
        if inside and _continues(text, start, end, end, stop):
            continue
        out.append(end)
        start, opened = end, False
        while start < stop and text[start].isspace():
            start += 1
    if not out or out[-1] < stop:
        out.append(stop)


def _continues(text: str, start: int, end: int, follows: int, stop: int) -> bool:
    """Whether a sentence that opens with a quotation ending at end goes on with who said it."""
    if text[end - 1] not in "\"”“»」’』" or text[start] not in "\"“„«「‘":
        return False
    rest = _STOP.search(text, follows, stop)
    return bool(_SPEECH.search(text, follows, rest.start() if rest else stop))


def _script_before(text: str, start: int, pos: int) -> str:
    for k in range(pos - 1, max(start, pos - 6) - 1, -1):
        if text[k].isalpha():
            return _script(text[k])
    return "latin"


def _decide(text: str, script: str, start: int, pos: int, stop: int, default: bool = False) -> bool:
    """The verdict of the first rule that matches at pos, default if none does."""
    before = text[max(start, pos - _LOOK) : pos]
    for verdict, b, a in _RULES[script]:
        if a.match(text, pos, stop) and (b is None or b.search(before)):
            return verdict
    return default


def sentence_ends(texts: pd.Series) -> pd.Series:
    """boundaries() of each text."""
    return texts.map(boundaries)


_ends = F.pandas_udf(sentence_ends, T.ArrayType(T.IntegerType()))


def sentence_units(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep..., unit_no, start_pos, end_pos): one row per sentence unit, whatever its language and script.

    Method: ordered pairs of break and no-break patterns, one table per language or script, tried in a cascade;
    the first pair that matches decides a position. Marks inside quotations and brackets are no positions.
    A blank line always ends a unit; a single line break only behind a heading or a finished sentence; a Thai
    space unless it stands at a numeral, Latin letters or a quotation mark. Positions count code points.
    Null, empty and blank texts have no unit; repeated rows each have theirs; other columns are ignored.
    """
    ends = spread(df.select(*keep, text)).select(*keep, F.filter(_ends(F.col(text)), lambda e: e.isNotNull()).alias("_ends"))
    rows = ends.select(*keep, "_ends", F.posexplode("_ends").alias("unit_no", "end_pos"))
    start = F.when(F.col("unit_no") == 0, F.lit(0)).otherwise(F.expr("_ends[unit_no - 1]"))
    return rows.select(*keep, F.col("unit_no"), start.alias("start_pos"), F.col("end_pos"))
