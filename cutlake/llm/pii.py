"""Personal data in take transcripts, also where it is disguised.

Plain identifiers are found by their formats. For disguised ones the text goes through three rewriting transducers
(look-alike characters; spelled digits; spelled or bracketed "at" and "dot"), each of which remembers which stretch of its
input every stretch of its output came from; what the formats find in the rewritten text is mapped back to the source.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from cutlake.llm.common import others, small_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]*\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches; each has one @, so the walk goes from @ to @ and stays linear."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            found.append((start, done))
        at = text.find("@", max(at + 1, done))
    return found


def plain_spans(text: str) -> dict[str, list[Span]]:
    """The base spans of a text by kind, code points, end exclusive. Matches that fail their test go without a retry."""
    out: dict[str, list[Span]] = {"email": emails(text)}
    out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    cards = []
    for m in CARD.finditer(text):
        if m.end() - m.start() > 12:
            digits = NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                cards.append(m.span())
    out["card"] = cards
    out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15] if "+" in text else []
    return out


# Characters that look like an ASCII one, and invisible ones (to nothing).
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "к": "k", "м": "m", "т": "t",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g", "ⅼ": "l", "。": ".", "․": ".", "﹒": ".", "｡": ".", "﹫": "@",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ", "​": "", "‌": "", "‍": "", "⁠": "", "­": "", "﻿": "",
}
# Full-width forms stand at a fixed distance from their ASCII characters; other scripts' digits come in runs of ten.
LOOK_ALIKES |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
LOOK_ALIKES |= {chr(zero + d): str(d) for zero in (0x660, 0x6F0, 0x966) for d in range(10)}
# Digits spelled in the four languages of the transcripts.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: A spelled digit or a group of figures; "oh" is a digit only after another one.
_DIGIT = "(?:(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + r"|[0-9]++)(?![^\W_]))"
_NEXT = rf"(?:{_DIGIT}|oh(?![^\W_]))"
_DOT = r"(?:dot|point|punkt|punto)"

ALIKE = re.compile("[" + "".join(map(re.escape, LOOK_ALIKES)) + "]")
#: Four or more digits or groups, perhaps after a plus and with dots between; linear: every token is consumed once. How many digits it takes, the formats say.
_RUN = rf"(?<![^\W_]){_DIGIT}(?:(?:[\s,-]+(?:{_DOT}[\s,-]+)?|\s*\.\s*){_NEXT}){{3,}}+"
DIGITS = re.compile(rf"(?:(?<![^\W_])plus[\s-]*|\+[\s-]*)?{_RUN}", re.I)
TOKEN = re.compile(rf"{_DOT}|\.|plus|\+|{_NEXT}", re.I)
LETTERS = re.compile(r"[^\W\d_]{2}")
#: Bracketed or encoded "at" and "dot"; the blanks around them belong to the disguise.
AT = re.compile(r"[\x20\t]{0,3}(?:[\[({<][\x20\t]{0,3}(?:at|@|arroba)[\x20\t]{0,3}[\])}>]|&#64;|&#x40;|&commat;|%40)[\x20\t]{0,3}", re.I)
DOT = re.compile(r"[\x20\t]{0,3}(?:[\[({<][\x20\t]{0,3}(?:dot|\.|point|punkt|punto)[\x20\t]{0,3}[\])}>]|&#46;|&#x2e;|&period;)[\x20\t]{0,3}", re.I)
# Endings of addresses that are told apart from words of a sentence.
ENDINGS = "com|org|net|edu|gov|info|biz|io|co|eu|uk|us|de|at|ch|fr|es|it|nl|be|pt|pl|se|dk|fi|ie|ca|au|nz|br|mx|ar|in|jp|cn|tv|me|dev|app"
_WORD_DOT = r"(?:[\x20\t]{1,3}dot[\x20\t]{1,3}|\.)"
#: Plain words, only in the whole shape of an address: name at host dot ending.
WORDS = re.compile(rf"(?<=[A-Za-z0-9])[\x20\t]{{1,3}}at[\x20\t]{{1,3}}(?=[A-Za-z0-9-]{{1,63}}(?:{_WORD_DOT}[A-Za-z0-9-]{{1,63}})*{_WORD_DOT}(?:{ENDINGS})(?![A-Za-z0-9-]))", re.I)
WORD_DOT = re.compile(r"(?<=[A-Za-z0-9])[\x20\t]{1,3}dot[\x20\t]{1,3}(?=[A-Za-z0-9])", re.I)
#: A text without any of these is its own rewriting: a look-alike, a bracketed or encoded sign, "dot" as a word, "at" before a
#: host with an ending, or four digits or groups in a row.
TRIGGER = re.compile(
    rf"[\[({{<][\x20\t]{{0,3}}(?:at|@|arroba|dot|point|punkt|punto|\.)[\x20\t]{{0,3}}[\])}}>]|&#(?:64|46|x40|x2e);|&(?:commat|period);|%40|[\x20\t]dot[\x20\t]|[\x20\t]at[\x20\t]{{1,3}}[a-z0-9-]{{1,63}}\.[a-z0-9]|{_RUN}",
    re.I,
)


class Rewritten:
    """A text made from another one by replacing stretches, and the way back for spans."""

    def __init__(self, text: str, changes: list[tuple[int, int, str]]):
        """``changes``: (start, end, replacement), in order and apart from each other."""
        parts, self.at, self.source, at, made = [], [0], [(0, False, 0)], 0, 0
        for start, end, new in changes:
            parts += [text[at:start], new]
            made += start - at
            self._piece(made, (start, True, end))
            made += len(new)
            self._piece(made, (end, False, end))
            at = end
        parts.append(text[at:])
        self.text = "".join(parts)
        self.changed = [(start, end) for start, end, _ in changes]

    def _piece(self, made: int, source: tuple[int, bool, int]) -> None:
        if self.at[-1] == made:
            self.source[-1] = source
        else:
            self.at.append(made)
            self.source.append(source)

    def back(self, span: Span) -> Span:
        """The source stretch of a stretch of the rewriting; a replaced stretch counts whole."""
        k = bisect_right(self.at, span[0]) - 1
        start, changed, _ = self.source[k]
        first = start if changed else start + span[0] - self.at[k]
        k = bisect_right(self.at, span[1] - 1) - 1
        start, changed, end = self.source[k]
        return first, (end if changed else start + span[1] - self.at[k])


def alike_changes(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), LOOK_ALIKES[m[0]]) for m in ALIKE.finditer(text)]


def digit_changes(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in DIGITS.finditer(text):
        if not LETTERS.search(m[0]):
            continue  # written in figures: nothing is disguised
        at, before = m.start(), ""
        for token in TOKEN.finditer(text, m.start(), m.end()):
            low = token[0].lower()
            new = SPELLED.get(low) or (low if low.isdigit() else "0" if low == "oh" else "+" if low in ("plus", "+") else ".")
            # Groups of figures stay apart from what is not joined to them by a dot.
            apart = " " if before.isdigit() and new.isdigit() and max(len(before), len(new)) > 1 else ""
            out.append((at, token.start(), apart))  # what stands between the tokens
            out.append((token.start(), token.end(), new))
            at, before = token.end(), new
    return out


def sign_changes(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "@") for p in (AT, WORDS) for m in p.finditer(text)]
    if not found:
        if "@" not in text and not DOT.search(text):
            return []
    found += [(m.start(), m.end(), ".") for p in (DOT, WORD_DOT) for m in p.finditer(text)]
    found.sort()
    apart: list[tuple[int, int, str]] = []
    for change in found:
        if not apart or change[0] >= apart[-1][1]:
            apart.append(change)
    return apart


def hidden_spans(text: str, plain: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans of identifiers that only the rewriting shows: they cover something rewritten and no plain span of their kind."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if text.isascii():
        steps, now = [], text
        if not TRIGGER.search(text):
            return out
    else:
        first = Rewritten(text, alike_changes(text))
        if not first.changed and not TRIGGER.search(text):
            return out
        steps, now = [first], first.text
    for changes in (digit_changes, sign_changes):
        steps.append(Rewritten(now, changes(now)))
        now = steps[-1].text
    if now == text:
        return out
    touched: list[Span] = []
    for k, step in enumerate(steps):
        for span in step.changed:
            for earlier in reversed(steps[:k]):
                span = earlier.back(span)
            touched.append(span)
    touched.sort()
    starts = [s for s, _ in touched]
    ends = [0]
    for _, e in touched:
        ends.append(max(ends[-1], e))
    for kind, spans in plain_spans(now).items():
        own = plain[kind]
        own_starts = [s for s, _ in own]
        for span in spans:
            for step in reversed(steps):
                span = step.back(span)
            if ends[bisect_right(starts, span[1] - 1)] <= span[0]:
                continue  # nothing rewritten inside
            k = bisect_right(own_starts, span[1] - 1)
            if k and own[k - 1][1] > span[0]:
                continue
            if not out[kind] or out[kind][-1][1] <= span[0]:
                out[kind].append(span)
    return out


def find_spans(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Plain and hidden spans of one text by kind; none for null."""
    plain = plain_spans(text or "")
    return plain, hidden_spans(text or "", plain)


def mask(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans go together under the first one's kind."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k in KINDS for s, e in spans[k]):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


SPAN = ArrayType(StructType().add("kind", StringType()).add("start", IntegerType()).add("end", IntegerType()).add("hidden", BooleanType()))


@F.pandas_udf(SPAN)
def _spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        rows = []
        for text in texts:
            plain, hidden = find_spans(text)
            rows.append([{"kind": k, "start": s, "end": e, "hidden": h} for k in KINDS for s, e, h in sorted([(*x, False) for x in plain[k]] + [(*x, True) for x in hidden[k]])])
        yield pd.Series(rows, dtype=object)


@F.pandas_udf(StringType())
def _masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        out = []
        for text in texts:
            if not text:
                out.append(text)
                continue
            plain, hidden = find_spans(text)
            out.append(mask(text, {k: plain[k] + hidden[k] for k in KINDS}))
        yield pd.Series(out, dtype=object)


def personal_spans(takes: DataFrame) -> DataFrame:
    """``takes`` with ``spans``: kind, start, end (code points, end exclusive) and whether the identifier was hidden.

    ``takes``: text and any further columns, which pass through (unless named like the result). Spans come by kind
    (email, ip, card, phone), then start. Null and empty texts have none; repeated rows get theirs each.
    """
    return small_batches(takes).select("text", *others(takes, ["text"], ["spans"]), _spans("text").alias("spans"))


def masked_text(text: str | Column = "text") -> Column:
    """The text with all personal data, plain or hidden, replaced by ``<EMAIL>``, ``<IP>``, ``<CARD>`` or ``<PHONE>``; null stays null."""
    return _masked(text)
