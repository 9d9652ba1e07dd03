"""Personal data in texts, also where it is disguised, with offsets into the text as it is.

Plain identifiers are found by fixed patterns. Then transducers rewrite the text and keep, for each
piece, the place it came from: first characters (homoglyphs, full-width and other compatibility
forms, invisible ones), then words (spelled digits, at and dot in brackets or as words). What the
same patterns find in the rewritten text and not in the text itself is mapped back and added.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеѕіјкорсухԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινοτυ",
        "ABESIJKMHOPCTYXaesijkopcyxdhqwABEZHIKMNOPTYXaivotu",
        strict=True,
    )
)
INVISIBLE = "­​‌‍⁠﻿"
UNUSUAL = re.compile(r"[­Ͱ-\U0010ffff]")
DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
DIGIT_OF = {w: str(d) for line in DIGIT_WORDS for d, w in enumerate(line.split())}
SURELY_SPELLED = 4
DIGIT_HINTS = tuple(DIGIT_OF)
_DIGIT = "|".join(sorted(DIGIT_OF, key=lambda w: (-len(w), w)))
_UNIT = rf"(?:(?:{_DIGIT})(?!\w)|[0-9]+)"
SPELLED = re.compile(
    rf"(?<!\w)(?:plus[\s,-]{{1,3}})?{_UNIT}(?:(?:[\s,-]{{1,3}}(?:(?:dot|point|punkt|punto)[\s,-]{{1,3}})?|\.){_UNIT})+",
    re.IGNORECASE,
)
SPELLED_PART = re.compile(rf"(?P<word>(?<!\w)(?:{_DIGIT}|plus|dot|point|punkt|punto)(?!\w))|[0-9]+|[\s,-]+", re.IGNORECASE)
_AT, _DOT = "at|arroba|arobase|ät", "dot|punkt|point|punto"
BRACKETED = re.compile(rf"[\[({{<]\s*(?:(?P<at>{_AT}|@)|(?P<dot>{_DOT}|\.))\s*[\])}}>]\s*", re.IGNORECASE)
SPACED_AT = re.compile(rf"(?<=[A-Za-z0-9._%+-])(?:\s+(?:{_AT})\s+|\s*@\s*)(?=[A-Za-z0-9-])", re.IGNORECASE)
SPACED_DOMAIN = re.compile(
    rf"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?:\s+(?:{_DOT})\s+[A-Za-z0-9-]+)+"
    r"|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:com|org|net|edu|gov|info|io|(?-i:[a-z]{2}|[A-Z]{2}))(?![A-Za-z0-9-])",
    re.IGNORECASE,
)
# After the sign itself any ending will do; after a word it could be a sentence without its blank.
SIGN_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:[a-z]{2,24}|[A-Z]{2,24}|xn--[a-z0-9-]{1,59})(?![A-Za-z0-9-])")
SPACED_DOT = re.compile(rf"\s+(?:{_DOT})\s+", re.IGNORECASE)
NUMBER_DOTS = re.compile(rf"(?<!\w)[0-9]{{1,3}}(?:\s+(?:{_DOT})\s+[0-9]{{1,3}}){{3}}(?!\w)", re.IGNORECASE)
DOT_HINTS = tuple(_DOT.split("|"))


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern in linear time: each has one @, before it the whole run."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        match = DOMAIN.match(text, at + 1) if begin < at else None
        if match:
            yield begin, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def plain_spans(text: str) -> list[Span]:
    """(start, kind, end) of the fixed patterns, by start, then kind."""
    found = [(a, 0, b) for a, b in emails(text)]
    for match in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.group().split(".")):
            found.append((match.start(), 1, match.end()))
    for match in CARD.finditer(text):
        if match.end() - match.start() >= 12:
            digits = _digits(match.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((match.start(), 2, match.end()))
    if "+" in text:
        for match in PHONE.finditer(text):
            if 9 <= len(_digits(match.group())) <= 15:
                found.append((match.start(), 3, match.end()))
    return sorted(found)


class Rewritten:
    """A text after replacements, and where its characters came from."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        self._at, self._from, out, place, size = [], [], [], 0, 0
        for start, end, new in [*edits, (len(text), len(text), "")]:
            for begin, stop, piece, copied in ((place, start, text[place:start], True), (start, end, new, False)):
                if piece:
                    self._at.append(size)
                    self._from.append((begin, stop, copied))
                    out.append(piece)
                    size += len(piece)
            place = end
        self.text = "".join(out)

    def source(self, start: int, end: int) -> tuple[int, int]:
        """Span of the original text behind a span of the rewritten one, which is not empty."""
        first, last = bisect_right(self._at, start) - 1, bisect_right(self._at, end - 1) - 1
        begin, _, copied = self._from[first]
        begin += start - self._at[first] if copied else 0
        low, stop, copied = self._from[last]
        return begin, low + end - self._at[last] if copied else stop


def plain_character(char: str) -> str:
    """ASCII form of a character that imitates one; nothing for invisible ones, else itself."""
    if char in INVISIBLE:
        return ""
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    digit = unicodedata.digit(char, None)
    if digit is not None:
        return str(digit)
    form = unicodedata.normalize("NFKC", char)
    return form if form.isascii() and len(form) == 1 and form.isprintable() else char


def character_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    if text.isascii():
        return edits
    for match in UNUSUAL.finditer(text):
        char = match.group()
        new = plain_character(char)
        if new != char:
            edits.append((match.start(), match.end(), new))
    return edits


def _spelled_edits(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """Replacements that make a run of digits and digit words an identifier; none if it is none.

    A digit word counts once the run as rewritten holds an address, a card or a telephone number.
    Runs with four digit words or more are rewritten in any case, as they may go on outside.
    """
    parts, edits, spelled, place, out = list(SPELLED_PART.finditer(text, start, end)), [], 0, start, []
    for part in parts:
        word = (part["word"] or "").lower()
        if part.group()[0].isdigit():
            continue
        spelled += word in DIGIT_OF
        new = (DIGIT_OF.get(word) or ("+" if word == "plus" else ".")) if word else ""
        edits.append((part.start(), part.end(), new))
        out += [text[place : part.start()], new]
        place = part.end()
    if not spelled:
        return []
    before = "+" if text[start - 1 : start] == "+" else ""
    return edits if spelled >= SURELY_SPELLED or plain_spans(before + "".join([*out, text[place:end]])) else []


def word_edits(text: str) -> list[tuple[int, int, str]]:
    """Replacements of spelled digits and of at and dot in brackets, none overlapping another."""
    edits = []
    for match in BRACKETED.finditer(text):
        start = match.start()
        while start and text[start - 1].isspace():
            start -= 1
        edits.append((start, match.end(), "@" if match["at"] else "."))
    low = text.lower()
    if any(h in low for h in DIGIT_HINTS):
        for match in SPELLED.finditer(text):
            edits += _spelled_edits(text, match.start(), match.end())
    return _apart(edits)


def _apart(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    kept, end = [], 0
    for edit in sorted(edits):
        if edit[0] >= end:
            kept.append(edit)
            end = edit[1]
    return kept


def spaced_edits(text: str) -> list[tuple[int, int, str]]:
    """Replacements of at and dot that stand as words inside an address or between numbers."""
    low, edits = text.lower(), []
    dots = any(h in low for h in DOT_HINTS)
    if dots or "." in low:
        for match in SPACED_AT.finditer(text):
            domain = SPACED_DOMAIN.match(text, match.end())
            if not domain and "@" in match.group():
                domain = SIGN_DOMAIN.match(text, match.end())
            if domain:
                edits.append((*match.span(), "@"))
                edits += [(*m.span(), ".") for m in SPACED_DOT.finditer(text, domain.start(), domain.end())]
    if dots:
        for match in NUMBER_DOTS.finditer(text):
            edits += [(*m.span(), ".") for m in SPACED_DOT.finditer(text, match.start(), match.end())]
    return _apart(edits)


def disguised_spans(text: str, plain: list[Span]) -> list[Span]:
    """What the rewritten text shows and no plain span covers."""
    layers, now = [], text
    for rewrite in (character_edits, word_edits, spaced_edits):
        edits = rewrite(now)
        if edits:
            layers.append(Rewritten(now, edits))
            now = layers[-1].text
    if not layers:
        return []
    found = []
    for start, kind, end in plain_spans(now):
        for layer in reversed(layers):
            start, end = layer.source(start, end)
        if not any(a <= start and end <= b for a, _, b in plain):
            found.append((start, kind, end))
    return found


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added), one per row.

    The counts and the digest are those of the plain patterns; ``spans`` lists plain and disguised
    finds as kind:start:end in code points; ``n_added`` counts the disguised ones. Null and empty
    texts have none. Null ids stay null, repeated rows give a row each, other columns are left
    out, no rows give no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, spans, added = [], [], []
            for text in batch.column(1).to_pylist():
                plain = plain_spans(text or "")
                more = disguised_spans(text or "", plain)
                for kind, column in enumerate(counts):
                    column.append(sum(s[1] == kind for s in plain))
                digests.append(hashlib.sha256(listed(plain).encode()).hexdigest())
                spans.append(listed(sorted(plain + more)))
                added.append(len(more))
            columns = [pa.array(c, pa.int64()) for c in (*counts, added)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns[:4], pa.array(digests, pa.string()), pa.array(spans, pa.string()), columns[4]],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        run,
        "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
        "base_sha256 string, spans string, n_added bigint",
    )


def masked(text: str) -> str:
    """The text with every find replaced by its kind in brackets; overlapping finds as one."""
    plain = plain_spans(text)
    out, place, last = [], 0, -1
    for start, kind, end in sorted(plain + disguised_spans(text, plain)):
        if start >= last:
            out += [text[place:start], f"[{KINDS[kind].upper()}]"]
        place = last = max(last, end)
    return "".join([*out, text[place:]])


def mask(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with finds masked in the text, all other columns as they are.

    ``length_col``, if there is one, gets the new length in characters. Null texts stay null.
    """
    names, at = docs.columns, docs.columns.index(text_col)
    has_length = length_col in names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            new = [t if t is None else masked(t) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(new, pa.string())
            if has_length:
                place = names.index(length_col)
                sizes = [None if t is None else len(t) for t in new]
                columns[place] = pa.array(sizes, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
