"""Benchmark decontamination by templates that outlive changed numbers, names and units.

Every word is stripped of ASCII punctuation at both ends and A-Z is lower-cased. Numbers, units and
names of an item become typed placeholders wherever they stand, so "Tom has 5 kg" and "Ann has
70 lb" are one template. Names are the words with a capital, those that open a sentence too; "a" and
"in" are units only after a number. Windows of ``WINDOW`` words of a document are looked up in hash
tables of the benchmark's windows, one for each set of places with literals, so a document's words
need no reading of their own: a placeholder takes the word of the item itself, or any number, any
known unit or any word with a capital. Copies in capitals or lower case are found by this as well.

A document holds an item if matched windows cover at least ``SHARE`` of the item's windows, or
``RUN`` consecutive ones. Windows are evidence if ``LITERALS`` of their words aren't placeholders by
their place (inside a sentence, after a number) and ``LEAST_FIXED`` aren't placeholders at all, and
only consistent ones: within one document and item, each value of the item's slots
must stand for one value of the document and the other way round, so a re-parameterised question
is caught and chance agreements of placeholders are not.

The benchmark is a stated query set. It is cut by a hash of its text into blocks of about
``BLOCK_CHARS`` characters; each block's windows, whose size that bounds, are broadcast and meet all
documents in one pass without an exchange. No document text is shuffled.

Items without such a window (short ones, tables, sums, lists of names) are looked up as the whole
sequence of their words, which counts as one window without slots.

Defined cases: NULL or empty texts hold nothing. Items of fewer than ``LEAST_EXACT`` words aren't
looked up: documents that hold "one two three" are no copies of it. Repeated item rows count once each by id; rows with a
NULL id are left out on either side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwarden.llm.common import U64, blocks, column_bytes, documents, map_arrow, mix, owners, span_hashes, word_spans
from callwarden.llm.text_stats import DIGITS, UPPERCASE

WINDOW, LITERALS, LEAST_FIXED = 5, 3, 2
LEAST_EXACT = 4
SHARE, RUN = 0.5, 9
BLOCK_CHARS = 4 << 20

#: Units, as words after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz pound pounds ounce ounces gram grams "
    "kilogram kilograms ton tons ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour "
    "hours day days week weeks month months year years km/h mph kph m/s hz khz mhz ghz w kw mw kwh j kj cal kcal v a pa kpa bar psi "
    "c f k °c °f % percent usd eur gbp dollar dollars euro euros cent cents pound kb mb gb tb bit bits byte bytes degree degrees"
).split()
#: Units that are everyday words too.
COMMON = ["a", "in"]
_STEP = 0xD6E8FEB86659FD93
_STEP_BACK = pow(_STEP, -1, 1 << 64)
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "%+-"]] = True
_NUMERIC = DIGITS.copy()
_NUMERIC[[ord(c) for c in ".,:/%+-"]] = True
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?"]] = True
_SMALL = np.zeros(256, bool)
_SMALL[[*range(ord("a"), ord("z") + 1), *range(0xC4, 0x100)]] = True
LITERAL, NUMBER, UNIT, NAME = range(4)
_PLACES = mix(np.arange(1, WINDOW + 1, dtype=np.uint64) * U64(0x5851F42D4C957F2D)) | U64(1)


def _text_hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends)


_UNIT_HASHES = np.sort(_text_hashes(sorted(set(UNITS))))
_COMMON_HASHES = _text_hashes(COMMON)


@dataclass
class Words:
    """Words of a block of texts: value (hash of the stripped lower-case word) and form."""

    value: np.ndarray
    number: np.ndarray
    unit: np.ndarray  # a known unit
    capital: np.ndarray
    lower: np.ndarray  # has lower-case letters
    opening: np.ndarray  # begins a text, a line or a sentence
    first: np.ndarray  # first word of each document and of the end

    def kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """(kind of every word of items, whether it is a placeholder by its place already).

        Words with a capital are names wherever they stand, unless their text has no lower-case
        letters. Known units are units wherever they stand, but ``COMMON`` ones only after a number.
        """
        kind = np.zeros(len(self.value), np.int8)
        cased = np.add.reduceat(np.append(self.lower, False), self.first[:-1])[owners(self.first)] > 0 if len(kind) else self.lower
        behind = np.concatenate([[False], self.number[:-1]])[: len(kind)]
        name = self.capital & cased
        unit = self.unit & (behind | ~np.isin(self.value, _COMMON_HASHES))
        kind[name], kind[unit & ~(name & ~self.opening & ~behind)], kind[self.number] = NAME, UNIT, NUMBER
        return kind, self.number | unit & behind | name & ~self.opening


def words_of(data: np.ndarray, edges: np.ndarray) -> Words:
    starts, ends, first = word_spans(data, edges)
    if not len(starts):
        none = np.empty(0, bool)
        return Words(np.empty(0, np.uint64), none, none, none, none, none, first)
    place = np.arange(len(data), dtype=np.int32)
    solid = ~_PUNCTUATION[data]
    after = np.minimum.accumulate(np.where(solid, place, len(data))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(solid, place, -1))
    low = np.minimum(after[starts], ends)
    high = np.maximum(before[ends - 1] + 1, low)
    empty = low == high  # punctuation alone keeps its characters
    low, high = np.where(empty, starts, low), np.where(empty, ends, high)
    head = data[low]
    following = data[np.minimum(low + 1, len(data) - 1)]
    numeric, digits, small = (np.concatenate([[0], np.cumsum(t[data], dtype=np.int64)]) for t in (_NUMERIC, DIGITS, _SMALL))
    number = (numeric[high] - numeric[low] == high - low) & (digits[high] > digits[low])
    value = span_hashes(data, low, high, fold=True)
    capital = UPPERCASE[head] | ((head == 0xC3) & (following >= 0x80) & (following <= 0x9E))
    opening = np.ones(len(starts), bool)
    opening[1:] = _STOPS[data[ends[:-1] - 1]] | (data[starts[1:] - 1] == 10) | (data[ends[:-1]] == 10)
    opening[first[:-1][first[:-1] < len(starts)]] = True
    unit = ~number & (_UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, value), len(_UNIT_HASHES) - 1)] == value)
    return Words(value, number, unit, capital, small[high] > small[low], opening, first)


def window_codes(value: np.ndarray) -> list[np.ndarray]:
    """For each place in a window, what a literal there adds to the hash of every window."""
    count = max(len(value) - WINDOW + 1, 0)
    return [value[k : k + count] * _PLACES[k] for k in range(WINDOW)]


def mask_hashes(codes: list[np.ndarray], mask: int) -> np.ndarray:
    """Hash of every window whose literals are at the places of ``mask``."""
    chosen = [codes[k] for k in range(WINDOW) if mask >> k & 1]
    total = chosen[0] + chosen[1]
    for code in chosen[2:]:
        total += code
    return total


@dataclass
class Windows:
    """Evidence windows of a block with literals at the same places, sorted by hash."""

    mask: int
    hashes: np.ndarray
    words: np.ndarray  # first word of each window
    item: np.ndarray  # item number of each window
    rank: np.ndarray  # number of the window within its item
    shift: np.uint64
    maybe: np.ndarray  # 1 for the upper bits of any hash

    @classmethod
    def build(cls, mask: int, hashes: np.ndarray, words: np.ndarray, item: np.ndarray, rank: np.ndarray) -> Windows:
        order = np.argsort(hashes, kind="stable")
        bits = min(max(16, len(hashes).bit_length() + 4), 24)
        maybe = np.zeros(1 << bits, bool)
        maybe[(hashes >> U64(64 - bits)).astype(np.int64)] = True
        return cls(mask, hashes[order], words[order], item[order], rank[order], U64(64 - bits), maybe)

    def hits(self, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(window of the documents, number of a window here) of every pair with equal hashes."""
        hashes = mask_hashes(codes, self.mask)
        at = np.flatnonzero(self.maybe[(hashes >> self.shift).astype(np.int64)])
        hashes = hashes[at]
        low, high = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        times = high - low
        return np.repeat(at, times), np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


@dataclass
class Exact:
    """Whole word sequences of items without evidence, found by their first words.

    An anchor is the hash of the first words, ``WINDOW`` or all of a shorter item; each anchor has the
    lengths of its items, and (length, sequence) the items.
    """

    anchors: dict[int, tuple[np.ndarray, np.ndarray]]  # words of the anchor -> hashes, lengths, sorted
    items: dict[tuple[int, int], list[int]]

    @classmethod
    def build(cls, t: Words, numbers: np.ndarray) -> Exact:
        sums = _running(t.value)
        anchors: dict[int, set[tuple[int, int]]] = {}
        items: dict[tuple[int, int], list[int]] = {}
        for number in numbers.tolist():
            start, end = t.first[number], t.first[number + 1]
            if end - start >= LEAST_EXACT:
                at, length = np.array([start]), int(end - start)
                size = min(WINDOW, length)
                anchors.setdefault(size, set()).add((int(_sequences(sums, at, size)[0]), length))
                items.setdefault((length, int(_sequences(sums, at, length)[0])), []).append(number)
        tables = {size: tuple(np.array(x, d) for x, d in zip(zip(*sorted(pairs), strict=True), (np.uint64, np.int64), strict=True)) for size, pairs in anchors.items()}
        return cls(tables, items)

    def matches(self, t: Words) -> set[tuple[int, int]]:
        """(document number, item number) of the items held."""
        found: set[tuple[int, int]] = set()
        if not self.anchors:
            return found
        sums, doc = _running(t.value), owners(t.first)
        for size, (hashes, lengths) in self.anchors.items():
            mine = _sequences(sums, np.arange(max(len(t.value) - size + 1, 0)), size)
            low = np.searchsorted(hashes, mine, "left")
            at = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == mine)
            times = np.searchsorted(hashes, mine[at], "right") - low[at]
            here = np.repeat(at, times)
            size_of = lengths[np.repeat(low[at], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            inside = here + size_of <= t.first[doc[here] + 1]
            here, size_of = here[inside], size_of[inside]
            for d, n, h in zip(doc[here].tolist(), size_of.tolist(), _sequences(sums, here, size_of).tolist(), strict=True):
                found |= {(d, i) for i in self.items.get((n, h), ())}
        return found


def _running(value: np.ndarray) -> np.ndarray:
    """Sums of the word hashes times growing powers, from the start to every word."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * _powers(_STEP, len(value)))])


def _sequences(sums: np.ndarray, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Hash of the ``length`` words from each word ``at``."""
    return mix((sums[at + length] - sums[at]) * _powers(_STEP_BACK, len(sums))[at])


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@dataclass
class Index:
    """Windows of a benchmark block and the words they point to."""

    items: np.ndarray  # item ids
    windows: list[Windows]
    totals: np.ndarray  # windows of each item
    kind: np.ndarray
    value: np.ndarray
    exact: Exact  # items without windows

    @classmethod
    def build(cls, ids: list[int], texts: list[str | None]) -> Index:
        t = words_of(*column_bytes(pa.array(texts, pa.large_string())))
        kind, settled = t.kinds()
        codes, doc = window_codes(t.value), owners(t.first)
        count = len(codes[0])
        plain, literal = (np.concatenate([[0], np.cumsum(x)]) for x in (~settled, kind == LITERAL))
        good = (plain[WINDOW:] - plain[:-WINDOW] >= LITERALS) & (literal[WINDOW:] - literal[:-WINDOW] >= LEAST_FIXED) if count else np.empty(0, bool)
        good &= doc[:count] == doc[len(doc) - count :]
        at = np.flatnonzero(good)
        item = doc[at]
        totals = np.bincount(item, minlength=len(ids))
        rank = np.arange(len(at)) - (np.cumsum(totals) - totals)[item]
        masks = sum(((kind[at + k] == LITERAL).astype(np.int64) << k for k in range(WINDOW)), np.zeros(len(at), np.int64))
        windows = []
        for mask in np.unique(masks).tolist():
            some = masks == mask
            windows.append(Windows.build(mask, mask_hashes(codes, mask)[at[some]], at[some], item[some], rank[some]))
        return cls(np.array(ids), windows, totals, kind, t.value, Exact.build(t, np.flatnonzero(totals == 0)))

    def matches(self, data: np.ndarray, edges: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document number, item number, matched windows, slots) of the items held."""
        t = words_of(data, edges)
        out = [(document, item, 1, 0) for document, item in sorted(self.exact.matches(t))]
        codes = window_codes(t.value)
        found = [self._pairs(w, t, codes) for w in self.windows] if len(codes[0]) else []
        if not sum(len(f[0]) for f in found):
            return out
        here, words, items, ranks = (np.concatenate(x) for x in zip(*found, strict=True))
        doc = np.searchsorted(t.first, here, "right") - 1
        group = doc * len(self.items) + items
        order = np.lexsort((words, here, group))
        group, here, words, ranks = group[order], here[order], words[order], ranks[order]
        cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            document, item = divmod(int(group[a]), len(self.items))
            total = int(self.totals[item])
            if not _enough(np.unique(ranks[a:b]), total):
                continue
            kept, slots = self._consistent(t, here[a:b], words[a:b], ranks[a:b])
            if _enough(kept, total):
                out.append((document, item, len(kept), slots))
        return out

    def _pairs(self, windows: Windows, t: Words, codes: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """(word of the document, word, item, rank of the window) where literals and kinds agree."""
        here, there = windows.hits(codes)
        words = windows.words[there]
        good = np.searchsorted(t.first, here, "right") == np.searchsorted(t.first, here + WINDOW - 1, "right")
        for k in range(WINDOW):
            if not windows.mask >> k & 1:
                mine, kind = here + k, self.kind[words + k]
                form = np.where(kind == NUMBER, t.number[mine], np.where(kind == UNIT, t.unit[mine], t.capital[mine]))
                good &= form | (t.value[mine] == self.value[words + k])
        return here[good], words[good], windows.item[there[good]], windows.rank[there[good]]

    def _consistent(self, t: Words, here: np.ndarray, words: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, int]:
        """(windows of the item whose slots agree with all others, number of slot values).

        Windows are taken along the alignment with the most windows first, so that this alignment
        settles the values.
        """
        shift = here - words
        _, back, count = np.unique(shift, return_inverse=True, return_counts=True)
        order = np.lexsort((here, shift, -count[back]))
        forth: dict[tuple[int, int], int] = {}
        reverse: dict[tuple[int, int], int] = {}
        kept = []
        for i in order:
            mine, its = here[i] + np.arange(WINDOW), words[i] + np.arange(WINDOW)
            slots = [(int(k), int(x), int(y)) for k, x, y in zip(self.kind[its], self.value[its], t.value[mine], strict=True) if k != LITERAL]
            if all(forth.get((k, x), y) == y and reverse.get((k, y), x) == x for k, x, y in slots) and _one_to_one(slots):
                forth.update({(k, x): y for k, x, y in slots})
                reverse.update({(k, y): x for k, x, y in slots})
                kept.append(ranks[i])
        return np.unique(np.array(kept, np.int64)), len(forth)


def _one_to_one(slots: list[tuple[int, int, int]]) -> bool:
    pairs = set(slots)
    return len({(k, x) for k, x, _ in pairs}) == len(pairs) == len({(k, y) for k, _, y in pairs})


def _enough(ranks: np.ndarray, total: int) -> bool:
    """Whether these windows (ascending, distinct) of an item with ``total`` are enough."""
    if not len(ranks):
        return False
    if len(ranks) >= max(SHARE * total, min(total, 4)):
        return True
    breaks = np.flatnonzero(np.concatenate([[True], np.diff(ranks) != 1, [True]]))
    return bool(np.diff(breaks).max() >= RUN)


def benchmark_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[Index]:
    """Indexes of bounded size over all items, one after the other."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-int(chars) // block_chars)
    for number in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == number).orderBy("item_id", "text").collect()
        if rows:
            yield Index.build([r[0] for r in rows], [r[1] for r in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, n_slots) of every document that holds an item."""
    names = ["doc_id", "item_id", "n_windows", "n_matched", "n_slots"]
    schema = ", ".join(f"{n} long" for n in names)
    columns = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    found = docs.sparkSession.createDataFrame([], schema)
    for index in benchmark_blocks(benchmark):
        found = found.unionByName(map_arrow(columns, _finder(docs.sparkSession.sparkContext.broadcast(index), names), schema))
    return found


def _finder(index, names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for block in blocks(batches):
            ids = block.column("doc_id").to_pylist()
            rows = [(ids[d], int(known.items[i]), int(known.totals[i]) or 1, n, s) for d, i, n, s in known.matches(*column_bytes(block.column("text")))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return run


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with all their columns."""
    for index in benchmark_blocks(spark.read.parquet(f"{sf_dir}/benchmark.parquet")):
        docs = map_arrow(docs, _remover(spark.sparkContext.broadcast(index)), docs.schema)
    return docs


def _remover(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            clean = np.ones(block.num_rows, bool)
            clean[[m[0] for m in index.value.matches(*column_bytes(block.column("text")))]] = False
            yield block.filter(pa.array(clean))

    return run


QUERIES = {"op7_decontaminate": (op7_decontaminate, None)}
