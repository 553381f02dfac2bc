"""Personal data by offset-preserving deobfuscation.

Identifiers are e-mail and IP addresses, card and phone numbers.  They are found
twice: in the text as it is (base spans) and in what three transducers make of
it, one after the other:

1. characters: digits of any script, compatibility forms (full width,
   mathematical, circled), letters of other scripts that look Latin, unusual
   spaces, dashes and dots become plain ones, invisible characters go, and O, I
   and l among digits become digits;
2. spelled digits: two or more number words in a row become digits, "double"
   and "triple" repeat, "plus" before a number becomes a sign;
3. disguised marks: "[at]", "(dot)", " at x dot y", " @ " become @ and dots.

A transducer keeps, for each place where it wrote something else, what it read
there.  A span of the last text is carried back through them to the characters
it came from; a character that came from several stands for all of them.  A span
found there only is added if it has something rewritten in it and lies in no
base span of its kind; base spans always stay.

Every rule works in time linear in the text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import text_of

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does: from within the run it would need the same next character.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Texts without these hold no match of the two above; a search for a class of characters is fast.
_SOME_IP, _SOME_CARD = re.compile(r"[0-9]\.[0-9]{1,20}\.[0-9]"), re.compile(r"[0-9](?:[\x20-]?[0-9]){12}")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = domain.end()
                yield start, end
        at = text.find("@", max(at + 1, end))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text) if _SOME_IP.search(text) else ():
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text) if _SOME_CARD.search(text) else ():
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def detect(text: str) -> list[Span]:
    """(kind, start, end) by kind, then start: leftmost matches of each kind that don't overlap."""
    return [(kind, *span) for kind, find in enumerate((emails, addresses, cards, phones)) for span in find(text)]


class Written:
    """A text that came from another one, and where it differs: (start, end) here stands for (start, end) there."""

    def __init__(self, text: str, edits: list[tuple[int, int, int, int]]):
        self.text, self.edits, self.starts = text, edits, [e[0] for e in edits]

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The characters that a span came from."""
        return self._place(start, 2), self._place(end - 1, 3)

    def _place(self, at: int, side: int) -> int:
        k = bisect_right(self.starts, at) - 1
        if k < 0:
            return at + (side == 3)
        _, end, begin_there, end_there = self.edits[k]
        if at < end:
            return (begin_there, end_there)[side - 2]
        return at - end + end_there + (side == 3)

    def touches(self, start: int, end: int) -> bool:
        """True if something in the span was rewritten, or taken out within it."""
        k = bisect_right(self.starts, end - 1) - 1
        return k >= 0 and (self.edits[k][1] > start or self.edits[k][0] > start)


def rewrite(text: str, edits: Iterator[tuple[int, int, str]]) -> Written:
    """``edits``: (start, end, new) in order, without overlap."""
    pieces, marks, at, length = [], [], 0, 0
    for start, end, new in edits:
        pieces += [text[at:start], new]
        length += start - at
        marks.append((length, length + len(new), start, end))
        length, at = length + len(new), end
    return Written("".join([*pieces, text[at:]]), marks) if marks else Written(text, [])


# Letters of other scripts that look like Latin ones, each followed by its double.
LOOKALIKES = (
    "АA ВB СC ЕE НH ІI ЈJ КK МM ОO РP ЅS ТT ХX УY аa сc ԁd еe һh іi јj оo рp ԛq ѕs ԝw хx уy"
    " ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX αa ιi κk νv οo ρp υu χx ɡg ɑa ıi"
)
#: Signs that stand for a dot, besides compatibility forms.
DOTS = "。｡․·‧∙⋅•"


@lru_cache(maxsize=1)
def plain_characters() -> dict[str, str]:
    """What each unusual character stands for, by the character database; Latin-1 letters and marks stay as they are."""
    table = {pair[0]: pair[1] for pair in LOOKALIKES.split()}
    for code in (0xA0, 0xAD, *range(0x300, 0x20000), *range(0xE0000, 0xE0080)):
        c = chr(code)
        if c in table or 0xD800 <= code < 0xE000:
            continue
        kind, digit = unicodedata.category(c), unicodedata.decimal(c, None)
        if digit is not None:
            table[c] = str(digit)
        elif kind == "Cf":
            table[c] = ""
        elif kind == "Zs":
            table[c] = " "
        elif kind == "Pd":
            table[c] = "-"
        else:
            form = unicodedata.normalize("NFKC", c)
            if len(form) == 1 and form.isascii() and (form.isalnum() or form in "@.+-_%()[]{}<>"):
                table[c] = form
    for c in DOTS:
        table[c] = "."
    return table


_UNUSUAL = re.compile(r"[\xA0\xAD\u0131\u0251\u0261\u0300-\U0010FFFF]")
_LETTER_DIGITS = re.compile(r"(?<![A-Za-z0-9])(?=[OoIl]{0,3}[0-9])[0-9OoIl]{2,24}(?![A-Za-z0-9])")
_SOME_LETTER_DIGIT = re.compile(r"[0-9][OoIl]|[OoIl][0-9]")
_AS_DIGITS = str.maketrans("OoIl", "0011")


def characters(text: str) -> Written:
    if text.isascii():
        return Written(text, [])
    table = plain_characters()
    return rewrite(text, ((m.start(), m.end(), new) for m in _UNUSUAL.finditer(text) if (new := table.get(m.group())) is not None))


def letter_digits(text: str) -> Written:
    """O, o, I and l in tokens that have at least two digits and otherwise only these letters."""

    def edits() -> Iterator[tuple[int, int, str]]:
        for m in _LETTER_DIGITS.finditer(text) if _SOME_LETTER_DIGIT.search(text) else ():
            token = m.group()
            if not token.isdigit() and sum(c.isdigit() for c in token) >= max(2, len(token) // 2):
                for k, c in enumerate(token, m.start()):
                    if not c.isdigit():
                        yield k, k + 1, c.translate(_AS_DIGITS)

    return rewrite(text, edits())


# Digits 0 to 9 as words, by language.
DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
    "zéro un deux trois quatre cinq six sept huit neuf",
)
OTHER_WORDS = {"oh": "0", "zwo": "2", "fuenf": "5"}


def lowered(text: str) -> str:
    """Lower case, letter by letter, so that places stay."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


def any_of(words: Iterable[str]) -> str:
    """A pattern for any of the words, which tells them apart letter by letter."""
    rest: dict[str, set[str]] = {}
    for w in words:
        rest.setdefault(w[:1], set()).add(w[1:])
    end = "?" if rest.pop("", None) is not None else ""
    parts = [re.escape(c) + (any_of(r) if r != {""} else "") for c, r in sorted(rest.items())]
    return (f"(?:{'|'.join(parts)})" if len(parts) > 1 or end else "".join(parts)) + end


@lru_cache(maxsize=1)
def spelled() -> tuple[re.Pattern, re.Pattern, re.Pattern, dict[str, str]]:
    """Two number words in a row, whole runs of them, their parts, and what each stands for; all in lower case."""
    value = {w: str(k) for words in DIGIT_WORDS for k, w in enumerate(words.split())} | OTHER_WORDS
    word, between = any_of(value), "(?:, ?|[ -])"
    item = rf"(?:(?:double|triple)[ -])?{word}"
    two = re.compile(rf"\b{word}{between}{item}\b")
    run = re.compile(rf"\b(?:plus[ -])?{item}(?:{between}{item})+\b|\bplus ?(?=[0-9])")
    return two, run, re.compile(rf"(plus)[ -]?|(?:(double|triple)[ -])?({word}){between}?"), value


def digit_words(text: str) -> Written:
    two, run, part, value = spelled()
    lower = lowered(text)
    if not ("plus" in lower or two.search(lower)):
        return Written(text, [])

    def edits() -> Iterator[tuple[int, int, str]]:
        for m in run.finditer(lower):
            for p in part.finditer(lower, *m.span()):
                times = {"double": 2, "triple": 3}.get(p.group(2), 1)
                yield p.start(), p.end(), "+" if p.group(1) else value[p.group(3)] * times

    return rewrite(text, edits())


# Words for the two marks; the bare ones count only with blanks round them.
_AT, _DOT = "at|arroba|arobase|ät", "dot|punkt|punto|point"
_OPEN, _CLOSE = r"[ \t]{0,2}[\[({<][ \t]{0,2}", r"[ \t]{0,2}[\])}>][ \t]{0,2}"
_BARE_DOT = rf"[ \t]{{1,2}}(?:{_DOT})[ \t]{{1,2}}"
_MARKS = re.compile(
    rf"{_OPEN}(?:(?P<at>{_AT}|@|a)|(?P<dot>{_DOT}|\.)|(?P<dash>dash|minus|hyphen)|(?P<line>underscore)){_CLOSE}"
    rf"|(?<=[A-Za-z0-9])[ \t]{{1,2}}(?:(?P<bare_at>{_AT})[ \t]{{1,2}}(?=[A-Za-z0-9-]{{1,63}}(?:{_BARE_DOT}|{_OPEN}(?:{_DOT}|\.){_CLOSE})[A-Za-z0-9])"
    rf"|(?P<bare_dot>{_DOT})[ \t]{{1,2}}(?=[A-Za-z0-9])|(?P<spaced>@)[ \t]{{1,2}}(?=[A-Za-z0-9-]{{1,63}}(?:\.|{_BARE_DOT}|{_OPEN}(?:{_DOT}|\.){_CLOSE})[A-Za-z0-9]))",
    re.IGNORECASE,
)
_MARK = {"at": "@", "dot": ".", "dash": "-", "line": "_", "bare_at": "@", "bare_dot": ".", "spaced": "@"}


_SOME_MARK = re.compile(rf"[\[({{<][ \t]{{0,2}}(?:{_AT}|{_DOT}|@|a|\.|dash|minus|hyphen|underscore)[ \t]{{0,2}}[\])}}>]", re.IGNORECASE)


def marks(text: str) -> Written:
    lower = text.lower()
    # A bare "at" counts only with a disguised dot behind it.
    if not (any(w in lower for w in (*_DOT.split("|"), " @", "\t@")) or _SOME_MARK.search(text)):
        return Written(text, [])
    return rewrite(text, ((m.start(), m.end(), _MARK[m.lastgroup]) for m in _MARKS.finditer(text)))


TRANSDUCERS: tuple[Callable[[str], Written], ...] = (characters, letter_digits, digit_words, marks)


def find(text: str) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, base, value) by kind, start and end; value is the identifier as plain text."""
    base = detect(text)
    out = {(*s, True): text[s[1] : s[2]] for s in base}
    stages, now = [], text
    for transducer in TRANSDUCERS:
        stage = transducer(now)
        if stage.edits:
            stages.append(stage)
            now = stage.text
    if stages:
        for kind, start, end in detect(now):
            value, touched = now[start:end], False
            for stage in reversed(stages):
                touched = touched or stage.touches(start, end)
                start, end = stage.source(start, end)
            if touched and not any(k == kind and s <= start and end <= e for k, s, e in base):
                out[kind, start, end, False] = value
    return [(KINDS[kind], start, end, was, value) for (kind, start, end, was), value in sorted(out.items())]


#: Fields of a span.
SPAN = "struct<kind string, start int, end int, base boolean, value string>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans: array of (kind, start, end, base, value), by kind as listed in KINDS, then start and end.

    Offsets count code points of the text, ends are exclusive.  ``base`` spans
    are those of the text as it is.  Null and empty texts have no spans; every
    row has a result, repeated rows and null ids too.  Texts are handed to
    Python whole, as many at a time as Arrow's byte limit allows.
    """

    @F.pandas_udf(f"array<{SPAN}>")
    def spans(texts: pd.Series) -> pd.Series:
        names = ("kind", "start", "end", "base", "value")
        return texts.map(lambda t: [dict(zip(names, s)) for s in find(t)])

    return docs.select(F.col(id_col), spans(text_of(text_col)).alias("spans"))
