"""Personal data: spans of e-mail addresses, IP addresses, card and phone numbers.

Base kinds are found in the source text as it is. Disguised ones are found by transducers that
rewrite the text and remember where every rewritten character came from:

* homoglyphs: full-width, mathematical, Cyrillic and Greek look-alikes and Unicode digits become
  ASCII, one character for one;
* spelled digits: digit words anywhere in the text become digits and join the words and figures
  beside them, "plus" before one becomes ``+`` and "dot" between two ``.``; the detectors' own
  lengths, ranges and sums decide;
* at/dot: ``[at]``, ``(dot)`` and the words "at" and "dot" in the form ``name at host dot tld``
  become ``@`` and ``.``, also in local parts of any length and number of dots.

The same detectors run on the rewritten text, and each find is mapped back to the source
characters it came from. A mapped span is added unless base spans of its kind cover it already.

Offsets are code points, ends exclusive. Defined cases: NULL text is empty; a text without finds
has empty ``spans`` and the hash of the empty string. All scans are linear in the text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwarden.llm.common import blocks, documents, map_arrow

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind number, end

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits does, as it ends where one does.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, anchored at each ``@``: the local part is the whole run before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        if at >= end:
            low = max(end, text.rfind("@", 0, at) + 1)
            start = low + len(text[low:at].rstrip(_LOCAL))
            found = _DOMAIN.match(text, at + 1)
            if found and start < at:
                end = found.end()
                yield start, end
        at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def detect(text: str) -> list[Span]:
    """Base spans of all kinds."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    if "." in text:
        # a part is compared without int(), whose cost grows with the square of a digit run
        small = lambda part: len(part := part.lstrip("0")) < 4 and int(part or 0) <= 255
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


# ---------------------------------------------------------------- transducers

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ɡ": "g", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "υ": "u", "ν": "v", "ѡ": "w",
    "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M",
    "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ο": "o",
    "ρ": "p", "τ": "t", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-",
    "−": "-", "\u00a0": " ", "\u2007": " ", "\u202f": " ",
}
#: Digits in words.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


@cache
def ascii_twin(char: str) -> str:
    """ASCII character that a look-alike stands for, or the character itself."""
    if char < "\x80":
        return char
    if char in LOOK_ALIKES:
        return LOOK_ALIKES[char]
    if char.isdecimal():
        return str(unicodedata.decimal(char))
    plain = unicodedata.normalize("NFKC", char)
    return plain if len(plain) == 1 and plain < "\x80" and plain.isprintable() else char


def fold_look_alikes(text: str) -> str:
    """Text of the same length with look-alikes in ASCII; letters with accents stay."""
    if text.isascii():
        return text
    changed = {ord(c): t for c in set(text) if (t := ascii_twin(c)) != c}
    return text.translate(changed) if changed else text


_AT = re.compile(r"[\x20\t]?[\[({<][\x20\t]?(?:at|@)[\x20\t]?[\])}>][\x20\t]?|[\x20\t]at[\x20\t]|[\x20\t]?@[\x20\t]?", re.I)
_DOT = r"(?:[\x20\t]?[\[({<][\x20\t]?(?:dot|\.)[\x20\t]?[\])}>][\x20\t]?|[\x20\t]dot[\x20\t]|\.)"
_HOST = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I)
_ANY_DOT = re.compile(rf"{_DOT}", re.I)
_LAST_LOCAL = re.compile(r"[\x20\t]?[\[({<][\x20\t]?dot[\x20\t]?[\])}>][\x20\t]?$|[\x20\t]dot[\x20\t]$", re.I)
#: A digit word or a run of figures; the lengths and sums of the detectors decide what it is part of.
_NUMERAL = re.compile(rf"(?<!\w)(?ai:({'|'.join(DIGIT_WORDS)}))(?!\w)|[0-9]+")
_BREAK = re.compile(r"[\x20,.-]{1,3}")
_POINT = re.compile(r"[\x20,.-]{1,3}dot\x20|[\x20\t]?[\[({<][\x20\t]?(?:dot|\.)[\x20\t]?[\])}>][\x20\t]?", re.I)
_PLUS = re.compile(r"(?<!\w)plus[\x20-]$", re.I)

Piece = tuple[str, int, int]  # rewritten text, source start, source end


def _local_start(text: str, end: int) -> int:
    """Where the run of local-part characters before ``end`` begins."""
    width = 64
    while True:
        low = max(end - width, 0)
        start = low + len(text[low:end].rstrip(_LOCAL))
        if start > low or not low:
            return start
        width *= 2


def disguised_emails(text: str) -> Iterator[list[Piece]]:
    """Pieces of each text region of the form local AT host DOT host."""
    for at in _AT.finditer(text):
        host = _HOST.match(text, at.end())
        if not host:
            continue
        dots = list(_ANY_DOT.finditer(text, host.start(), host.end()))
        if at[0].strip().lower() == "at" and all(d[0] == "." for d in dots):
            continue  # plain prose: "look at example.com"
        if at[0] == "@" and all(d[0] == "." for d in dots) and not _LAST_LOCAL.search(text, max((low := _local_start(text, at.start())) - 10, 0), low):
            continue  # not disguised
        pieces: list[Piece] = []
        high = at.start()
        while True:  # local part from right to left, over disguised dots
            start = _local_start(text, high)
            if start == high:
                break
            pieces.append((text[start:high], start, high))
            dot = _LAST_LOCAL.search(text, max(start - 10, 0), start)
            if not dot:
                break
            pieces.append((".", dot.start(), dot.end()))
            high = dot.start()
        if not pieces:
            continue
        if pieces[-1][0] == ".":
            pieces.pop()
        pieces.reverse()
        pieces.append(("@", at.start(), at.end()))
        place = host.start()
        for dot in dots:
            pieces += [(text[place : dot.start()], place, dot.start()), (".", dot.start(), dot.end())]
            place = dot.end()
        pieces.append((text[place : host.end()], place, host.end()))
        yield pieces


def _mapped(pieces: list[Piece]) -> Iterator[Span]:
    """Finds in the rewritten text of a region, in source characters."""
    whole = "".join(p[0] for p in pieces)
    source: list[tuple[int, int]] = []
    for new, start, end in pieces:
        same = len(new) == end - start
        source += [(start + i, start + i + 1) if same else (start, end) for i in range(len(new))]
    for start, kind, end in detect(whole):
        yield source[start][0], kind, source[end - 1][1]


class Rewritten:
    """A text with some spans replaced, none by more than one character, and the way back."""

    def __init__(self, text: str, changes: list[Piece]):
        parts, self.places, self.changes = [], [], changes
        length = place = 0
        for new, start, end in changes:
            parts += [text[place:start], new]
            length += start - place
            self.places.append(length)
            length, place = length + len(new), end
        self.text = "".join([*parts, text[place:]])

    def source(self, place: int) -> tuple[int, int]:
        """(start, end) of the source characters of the character at ``place``."""
        k = bisect_right(self.places, place) - 1
        if k < 0:
            return place, place + 1
        new, start, end = self.changes[k]
        beyond = place - self.places[k] - len(new)
        return (start, end) if beyond < 0 else (end + beyond, end + beyond + 1)

    def spans(self, found: Iterable[Span]) -> Iterator[Span]:
        for start, kind, end in found:
            yield self.source(start)[0], kind, self.source(end - 1)[1]


def spelled_changes(text: str) -> tuple[list[Piece], bool]:
    """(replaced spans that make digit words, and what joins them to others, figures; whether a
    sign of its own joins two of them, which may be a point or a mere break)."""
    changes: list[Piece] = []
    last = points = 0
    spelled = False
    for m in _NUMERAL.finditer(text):
        start, word = m.start(), m[1]
        if last and start - last <= 12:
            if _POINT.fullmatch(text, last, start):
                changes.append((".", last, start))
            elif (word or spelled) and _BREAK.fullmatch(text, last, start):
                changes.append(("", last, start))
                points += text[last:start] == "."
        joined = bool(changes) and changes[-1][2] == start
        if not joined and (plus := _PLUS.search(text, max(start - 6, last), start)):
            changes.append(("+", plus.start(), start))
        if word:
            changes.append((DIGIT_WORDS[word.lower()], start, m.end()))
        last, spelled = m.end(), bool(word)
    return changes, points > 0


def hidden(text: str) -> list[Span]:
    """Spans that only the transducers bring to light."""
    found: list[Span] = []
    plain = fold_look_alikes(text)
    if plain is not text and plain != text:
        found += detect(plain)
    low = plain.lower()
    mails = "@" in low or "dot" in low or "at" in low and any(c in low for c in "[({<")
    if mails:
        for pieces in disguised_emails(plain):
            found += _mapped(pieces)
    changes, points = spelled_changes(plain)
    if changes:
        whole = Rewritten(plain, changes)
        found += whole.spans(s for s in detect(whole.text) if s[1])
        if mails:
            for pieces in disguised_emails(whole.text):
                found += whole.spans(s for s in _mapped(pieces) if not s[1])
        if points:
            whole = Rewritten(plain, [("." if not new and plain[a:b] == "." else new, a, b) for new, a, b in changes])
            found += whole.spans(s for s in detect(whole.text) if s[1])
    return found


def uncovered(base: list[Span], extra: list[Span]) -> list[Span]:
    """Distinct spans of ``extra`` that no base span and no other extra span of their kind covers, in order.

    A sweep by start, the longer first: a span is covered if one before it ends as late.
    """
    reach = [-1] * len(KINDS)
    found = []
    for start, kind, end, new in sorted([(*s, False) for s in base] + [(*s, True) for s in set(extra)], key=lambda s: (s[0], -s[2], s[3])):
        if new and reach[kind] < end:
            found.append((start, kind, end))
        reach[kind] = max(reach[kind], end)
    return sorted(found)


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans), each in order."""
    base = sorted(detect(text))
    extra = hidden(text)
    return base, uncovered(base, extra) if extra else []


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RESULT.split(", ")]
    for block in blocks(batches):
        rows = []
        for text in block.column("text").to_pylist():
            base, added = find(text or "")
            counts = [0, 0, 0, 0]
            for span in base:
                counts[span[1]] += 1
            rows.append((*counts, hashlib.sha256(render(base).encode()).hexdigest(), render(base + added), len(added)))
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)


def find_pii(docs: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their hash, and all spans of every document."""
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), _run, RESULT)


def redact(docs: DataFrame) -> DataFrame:
    """Documents with every span replaced by its kind in angle brackets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = []
            for text in block.column("text").to_pylist():
                out, place = [], 0
                for a, k, b in sorted(sum(find(text), [])) if text else []:
                    if b > place:
                        out += [text[place : max(a, place)], f"<{KINDS[k]}>" if a >= place else ""]
                        place = b
                texts.append(None if text is None else "".join(out) + text[place:])
            at = block.schema.get_field_index("text")
            yield block.set_column(at, block.schema.field(at), pa.array(texts, block.schema.field(at).type))

    return map_arrow(docs, run, docs.schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))


QUERIES = {"op8_pii": (op8_pii, None)}
