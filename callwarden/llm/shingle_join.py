"""N-gram Jaccard join by parity sketches: exact links and components of similar documents.

A document is the set of its distinct word shingles, as 64-bit hashes. Two sets with
``100 * common >= percent * union`` differ in at most
``d = (100 - percent) / (100 + percent) * (size + size)`` shingles.

* Size bands: bounds grow by 100/percent, so similar sets lie in one band or in neighbouring ones.
  Group g compares the sets of band g with those of bands g and g + 1; every set is sketched for
  its own group and for the one below.
* Parity sketch: the shingles are dealt by hash into ``m`` cells and each cell holds the XOR of
  its shingles. A differing shingle changes one cell, so the Hamming distance of two sketches, in
  cells, is a lower bound of the symmetric difference.
* Pigeonhole: with ``m = d + 1 + spare`` cells similar sets agree in ``1 + spare`` cells or more.
  Cells with fewer than ``w`` shingles are too weak to be keys; a set with more weak cells than ``spare``
  is dealt again by another seed as well, until a seed suits it. Two similar sets meet
  at the first seed that suits either of them, in a cell that isn't weak.
* Only the ``d + 1`` rarest cells of a set need to be keys (the others are its most shared cells, such as
  those inside boilerplate); the order by frequency is the same for all sets, so nothing is lost.

Exact copies are merged first, by the hash of the whole set. The centre of a key is the set with the fewest cells
of its own. Comparisons go in rounds, and linked sets become components after each: first every set meets only
the centre that it shares most keys with, so a group of n near copies costs n comparisons; then the sets of a key that lie
in another component than its centre meet that centre. Where a key still holds several components, pairs aren't tried one by
one either. Let E(x) be the shingles in which x and the centre differ. If a isn't similar to the centre
and E(a), E(b) have nothing in common, then ``|a ^ b| = |E(a)| + |E(b)|``, and with
``|E(a)| > f (|a| + |centre|)`` and ``|b| <= |centre| + |E(b)|`` that is more than ``f (|a| + |b|)`` for
f = (100 - percent) / (100 + percent): a and b aren't similar. So similar sets that the centre leaves
apart share a difference from it. These differences are keys in turn, the rarest first. With d the most
differences of similar sets, ``|a ^ b| <= d`` means ``(|E(a)| + |E(b)| - d) / 2`` common ones or more:

* both apart from the centre: ``(|E(a)| - f (|a| - |centre|)) / 2``, so the rarer half are keys;
* a apart, b not: ``|E(a)| - d`` for a, whose d + 1 rarest are keys, and ``(|E(b)| - f (|b| - |centre|)) / 2`` for b.

With ``SHARED`` - 1 more keys each, similar sets share ``SHARED`` keys or all those they must have in
common, so pairs that meet in fewer aren't compared. Pairs whose numbers of differences alone
rule them out are dropped. Every comparison intersects the shingles
of the whole texts, and no pair of one component is formed. What is compared travels as sorted hashes in rows of bounded
length, a centre once for up to ``SPLIT`` of its sets, not as a text for each pair.

Thresholds below 75 percent leave too few shingles to a cell and raise an error.

Defined cases: a text with fewer words than a shingle is one shingle, the whole sequence; NULL text
or no words make an empty set, linked with nothing. Rows with a NULL id are returned without a component.
Rows that share an id are compared as separate texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callwarden.llm.common import LOWER, U64, UPPER, blocks, column_bytes, documents, map_arrow, mix, span_hashes, stage, window_hashes, word_spans
from callwarden.llm.components import components

WORDS, PERCENT = 4, 85
STAGE_WORDS, STAGE_PERCENT = 5, 80
#: Shares of cells beyond d + 1 to choose from: the first under which few sets have too many weak cells.
SPARE = (0.15, 0.2, 0.3, 0.45)
#: Rows of one key that a task holds back to count them; a key with more counts as this many.
HELD_ROWS = 1 << 16
#: Rare differences that two sets apart from their centre must share to be compared (fewer if
#: they need not have as many in common): with so many more keys each, no similar pair has fewer.
SHARED = 1
#: Places in which a task remembers the last set hash of each, so as to sketch most of its own copies once.
REMEMBERED = 1 << 16
#: Seeds for weak cells; with the last one all cells are keys.
SEEDS = 64
#: Bits of a tag that hold the number of surplus cells.
SURPLUS_BITS = 13
#: Bits of the map of wanted documents; the more of them are set, the more others pass it too.
MARKS = 1 << 25
#: Shingles of one row of a set.
CHUNK = 1 << 10
#: Sets that one copy of a centre is compared with.
SPLIT = 1 << 12


def shingle_sets(data: np.ndarray, edges: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; A-Z count as lower case."""
    starts, ends, first = word_spans(data, edges)
    hashes = span_hashes(data, starts, ends, fold=True)
    windows = window_hashes(hashes, words)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words:
            found = np.sort(windows[a : b - words + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif b > a:
            out.append(mix(window_hashes(hashes[a:b], int(b - a)) + U64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_hash(shingles: np.ndarray) -> int:
    """Name of a set: a signed 64-bit hash of all its members."""
    value = mix(np.array([shingles.sum(dtype=np.uint64) ^ mix(np.bitwise_xor.reduce(shingles, keepdims=True))[0]], np.uint64) + U64(len(shingles)))
    return int(value.view(np.int64)[0])


@cache
def bands(percent: int, up_to: int = 1 << 40) -> list[int]:
    """Lower bounds of the size bands."""
    low = [1]
    while low[-1] <= up_to:
        low.append(low[-1] * 100 // percent + 1)
    return low


@cache
def plan_of(group: int, percent: int) -> tuple[int, int, int]:
    """(m, d, w) of a group: cells, most differing shingles, fewest shingles of a key."""
    low = bands(percent)
    small = low[group + 1] - 1
    large = min(low[group + 2] - 1, small * 100 // percent)
    d = (small + large) * (100 - percent) // (100 + percent)
    if not d:
        return 1, 0, 1
    for share in SPARE:
        spare = int(np.ceil(share * (d + 1)))
        m = d + 1 + spare
        each = low[group] / m  # shingles of a cell, at the least
        weak = 2 if each >= 3.5 else 1
        if m * np.exp(-each) * (1 + each * (weak - 1)) <= 0.9 * spare:
            break
    return m, d, weak


def sketch(shingles: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(tag, keys) for each group and seed; tag packs group, seed and surplus cells."""
    own = int(np.searchsorted(bands(percent), len(shingles), "right")) - 1
    most = (1 << SURPLUS_BITS) - 1
    for group in (own, own - 1) if own else (own,):
        m, d, weak = plan_of(group, percent)
        for seed in range(SEEDS):
            last = seed == SEEDS - 1
            dealt = shingles if seed == 0 else np.sort(mix(shingles ^ U64(seed * 0x9E3779B97F4A7C15 % (1 << 64))))
            cell = ((dealt >> U64(32)) * U64(m)) >> U64(32)
            at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            parity, place = np.bitwise_xor.reduceat(dealt, at), cell[at]
            if last:
                parity, place = np.zeros(m, np.uint64), np.arange(m, dtype=np.uint64)
                parity[cell[at]] = np.bitwise_xor.reduceat(dealt, at)
            else:
                full = np.diff(np.append(at, len(dealt))) >= weak
                parity, place = parity[full], place[full]
            keys = mix(parity ^ mix(place + U64((group * SEEDS + seed) << 40)))
            surplus = min(max(len(keys) - (d + 1), 0), most)
            if len(keys):
                yield (group * SEEDS + seed) << SURPLUS_BITS | surplus, keys
            if len(keys) > d:
                break


def _sizes(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            sets = shingle_sets(*column_bytes(block.column("text")), words)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("version"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_hash(s) if len(s) else 0 for s in sets], pa.int64())],
                names=["doc_id", "version", "n_shingles", "c"],
            )

    return run


def set_table(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, version, n_shingles, c: name of the set) of every document."""
    columns = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"), "text")
    return map_arrow(columns, _sizes(words), "doc_id long, version long, n_shingles long, c long")


def _keys(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = [0] * REMEMBERED
        for block in blocks(batches):
            names, tags, keys = [], [], []
            for shingles in shingle_sets(*column_bytes(block.column("text")), words):
                if not len(shingles) or (name := set_hash(shingles)) == done[name % REMEMBERED]:
                    continue
                done[name % REMEMBERED] = name
                for tag, found in sketch(shingles, percent):
                    names.append(np.full(len(found), name))
                    tags.append(np.full(len(found), tag, np.int32))
                    keys.append(found.view(np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, names, tags)], names=["key", "c", "tag"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sorted by key and set) of keys with two sets or more, and how many sets these are."""
    held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
    large = None  # key whose rows go out as they come

    def out(columns: list[np.ndarray], freq: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(freq.astype(np.int32))], names=["key", "c", "tag", "freq"])

    def settle(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        key = columns[0]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, int)
        runs = np.diff(np.append(at, len(key)))
        freq = np.repeat(np.minimum(runs, HELD_ROWS), runs)
        return [x[freq > 1] for x in columns], freq[freq > 1]

    for batch in batches:
        columns = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
        if large is not None:
            more = int(np.searchsorted(columns[0], large, "right"))
            if more:
                yield out([x[:more] for x in columns], np.full(more, HELD_ROWS))
            columns = [x[more:] for x in columns]
            large = large if not len(columns[0]) else None
        if not len(columns[0]):
            held = columns
            continue
        new = np.concatenate([[True], (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])])
        columns = [x[new] for x in columns]
        last = int(np.searchsorted(columns[0], columns[0][-1], "left"))
        found, freq = settle([x[:last] for x in columns])
        if len(freq):
            yield out(found, freq)
        held = [x[last:] for x in columns]
        if len(held[0]) >= HELD_ROWS:
            large = held[0][0]
            yield out(held, np.full(len(held[0]), HELD_ROWS))
            held = [x[:0] for x in held]
    found, freq = settle(held)
    if len(freq):
        yield out(found, freq)


def shared_keys(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, c, most): the rarest keys of each set that other sets have too.

    ``most`` is d + 1 less the cells of the set that no other set shares: the higher, the more
    central the set is among those of its keys.
    """
    rows = map_arrow(docs.select("text"), _keys(words, percent), "key long, c long, tag int")
    dealt = rows.repartition("key").sortWithinPartitions("key", "c")
    shared = map_arrow(dealt, _shared, "key long, c long, tag int, freq int")
    mine = Window.partitionBy("c", "tag")
    ranked = shared.select(
        "key", "c", (F.count("*").over(mine) - F.col("tag").bitwiseAND((1 << SURPLUS_BITS) - 1)).alias("most"),
        F.row_number().over(mine.orderBy("freq", "key")).alias("rank"),
    )
    return ranked.where("rank <= most").select("key", "c", F.col("most").cast("int").alias("most"))


def _members(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            rows = [
                (c, at, found[at : at + CHUNK].tobytes())
                for c, found in zip(block.column("c").to_pylist(), shingle_sets(*column_bytes(block.column("text")), words), strict=True)
                for at in range(0, len(found), CHUNK)
            ]
            kinds = (pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["c", "at", "s"])

    return run


def likely(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose (doc_id, version) may be in ``wanted``: all that are, and few others.

    Texts are large and few are wanted, so they aren't sent to a join: each task looks its rows up in a
    bitmap of hashes, at most ``MARKS`` / 8 bytes whatever the number of documents.
    """
    place = F.pmod(F.xxhash64("doc_id", "version"), F.lit(MARKS))
    marks = wanted.select(place.alias("place")).groupBy(F.expr("place div 32768").alias("bucket"))
    marks = marks.agg(F.bitmap_construct_agg(F.expr("place % 32768")).alias("bits"))
    byte = "conv(hex(substring(bits, cast(place % 32768 div 8 as int) + 1, 1)), 16, 10)"
    marked = F.expr(f"place div 32768 = bucket and getbit(cast({byte} as int), cast(place % 8 as int)) = 1")
    return texts.withColumn("place", place).join(F.broadcast(marks), marked, "left_semi").drop("place")


def member_table(wanted: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(c, at, s): the sorted shingles of each set, ``CHUNK`` in a row, the first of them at place ``at``."""
    wanted = stage(wanted, "shingle-wanted")
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"), "text")
    texts = likely(texts, wanted)
    texts = texts.join(wanted.select("c", "doc_id", "version"), ["doc_id", "version"]).select("c", "text").dropDuplicates(["c"])
    return map_arrow(texts, _members(words), "c long, at long, s binary")


def together(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (a, part, b, at, s) of the sets of pairs (centre a, set b), a's own first, with NULL as b.

    A centre of many sets is dealt to several parts, each with the centre's rows.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPLIT).alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1)))
    dealt = stage(pairs.join(many, "a", "left").select("a", part.alias("part"), "b"), "shingle-pairs")
    centres = dealt.select("a", "part").distinct().join(members.withColumnRenamed("c", "a"), "a")
    others = dealt.join(members.withColumnRenamed("c", "b"), "b").select("a", "part", "b", "at", "s")
    rows = centres.select("a", "part", F.lit(None).cast("long").alias("b"), "at", "s").union(others)
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "b", "at")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(a, b, shingles of a, shingles of b) from the rows of ``together``."""
    now, held, centre = None, [], None
    for batch in batches:
        data, edges = column_bytes(batch.column("s"))
        for row, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b")), strict=True)):
            if key != now:
                if now is not None and now[2] is not None:
                    yield now[0], now[2], centre, np.concatenate(held)
                elif now is not None:
                    centre = np.concatenate(held)
                now, held = key, []
            held.append(data[edges[row] : edges[row + 1]].view(np.uint64))
    if now is not None:
        yield now[0], now[2], centre, np.concatenate(held)


def _in_parts(found: Iterator, size: int) -> Iterator[list]:
    while part := list(islice(found, size)):
        yield part


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(a: int, b: int, x: np.ndarray, y: np.ndarray) -> tuple[int, int, bool]:
            common = len(np.intersect1d(x, y, assume_unique=True))
            return a, b, 100 * common >= percent * (len(x) + len(y) - common)

        for part in _in_parts((linked(*pair) for pair in _met(batches)), 1 << 12):
            yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*part, strict=True))], names=["a", "b", "linked"])

    return run


def _differences(percent: int):
    """For each pair (centre a, set b): a row for each of b's differences.

    ``apart`` says that b isn't similar to a; ``surplus`` and ``surplus_apart`` are the numbers of
    its most frequent differences that need not be keys, against any set and against sets
    that are apart; ``differ`` and ``size`` are the numbers of its differences and shingles.
    """
    low, high = 100 - percent, 100 + percent

    def differences(a: int, b: int, x: np.ndarray, y: np.ndarray) -> tuple:
        gone, new = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
        count = len(gone) + len(new)
        apart = count * high > low * (len(x) + len(y))
        most = low * (len(y) + len(y) * 100 // percent) // high
        common = -(-(count * high - low * (len(y) - len(x))) // (2 * high))  # rounded up
        surplus = max(count - (most + 1), 0) if apart else max(common, 1) - 1
        keys = mix(np.concatenate([new, mix(gone)]) ^ mix(np.array([a]).view(np.uint64))).view(np.int64)
        return keys, (a, b, apart, surplus, max(common, 1) - 1, count, len(y))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _in_parts((differences(*pair) for pair in _met(batches)), 64):
            keys, facts = zip(*part, strict=True)
            columns = [np.repeat(np.array(c), [len(k) for k in keys]) for c in zip(*facts, strict=True)]
            columns = [c.astype(k) for c, k in zip(columns, ("i8", "i8", "?", "i4", "i4", "i4", "i4"), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), *map(pa.array, columns)], names=["key", "a", "b", "apart", "surplus", "surplus_apart", "differ", "size"]
            )

    return run


def compare(pairs: DataFrame, classes: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b) of those pairs of a centre a and a set b that are similar, by all their shingles."""
    size = classes.select("c", "n_shingles")
    sized = pairs.join(size.select(F.col("c").alias("a"), F.col("n_shingles").alias("na")), "a")
    sized = sized.join(size.select(F.col("c").alias("b"), F.col("n_shingles").alias("nb")), "b")
    fitting = sized.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b")
    found = map_arrow(together(fitting, members), _compare(percent), "a long, b long, linked boolean")
    return found.where("linked").select("a", "b")


def apart_pairs(open_keys: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of different components that may be similar though their centre leaves them apart.

    ``open_keys`` has (a: centre, c: set, root: its component).
    """
    pairs = open_keys.where("a != c").select("a", F.col("c").alias("b")).distinct()
    kinds = "key long, a long, b long, apart boolean, surplus int, surplus_apart int, differ int, size int"
    rows = map_arrow(together(pairs, members), _differences(percent), kinds)
    shared = rows.withColumn("freq", F.count("*").over(Window.partitionBy("key"))).where("freq > 1")
    mine = Window.partitionBy("a", "b")
    more = F.lit(SHARED - 1)
    ranked = shared.select(
        "a", "b", "key", "apart", "surplus", "surplus_apart", "differ", "size",
        F.count("*").over(mine).alias("many"), F.row_number().over(mine.orderBy("freq", "key")).alias("rank"),
    )
    ranked = ranked.where(F.col("rank") <= F.col("many") - F.greatest(F.col("surplus") - more, F.lit(0)))
    rare = F.col("rank") <= F.col("many") - F.greatest(F.col("surplus_apart") - more, F.lit(0))
    roots = open_keys.select(F.col("c").alias("b"), "root").distinct()
    kept = ranked.select(F.col("a").alias("centre"), "b", "key", "apart", rare.alias("rare"), "surplus", "surplus_apart", "differ", "size")
    kept = stage(kept.join(roots, "b"), "shingle-differences")
    left = kept.where("apart").select(
        "key", "centre", F.col("b").alias("a"), F.col("root").alias("ra"), F.col("rare").alias("rare_a"), F.col("surplus").alias("sa"),
        F.col("surplus_apart").alias("pa"), F.col("differ").alias("da"), F.col("size").alias("na"),
    )
    right = kept.select("key", "b", F.col("root").alias("rb"), "apart", "rare", F.col("surplus").alias("sb"), F.col("surplus_apart").alias("pb"), F.col("differ").alias("db"), F.col("size").alias("nb"))
    fits = f"abs(da - db) * {100 + percent} <= {100 - percent} * (na + nb) and 100 * least(na, nb) >= {percent} * greatest(na, nb)"
    met = left.join(right, "key").where(f"ra != rb and (not apart or (a < b and rare and rare_a)) and {fits}")
    common = F.when(F.col("apart"), F.greatest("pa", "pb")).otherwise(F.greatest("sa", "sb")) + 1
    met = met.groupBy("centre", "a", "b").agg(F.count("*").alias("meet"), F.max(common).alias("common"))
    met = met.where(F.col("meet") >= F.least(F.col("common"), F.lit(SHARED)))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def mixed_keys(keys: DataFrame, roots: DataFrame) -> DataFrame:
    """(a: centre, ra: its component, c: set, root: its component) of all keys that hold several components."""
    placed = keys.join(roots.withColumnRenamed("node", "c"), "c", "left").select("key", "c", "most", F.coalesce("root", "c").alias("root"))
    first = F.max_by(F.struct(F.col("c").alias("a"), F.col("root").alias("ra")), F.struct("most", "c")).alias("first")
    mixed = placed.groupBy("key").agg(first, F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    return placed.join(mixed.select("key", "first.*"), "key").select("a", "ra", "c", "root").distinct()


def linked_sets(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, root) of the sets that have links, but the roots."""
    keys = stage(shared_keys(docs, words, percent), "shingle-keys")
    members = stage(member_table(keys.select("c").distinct().join(classes, "c"), docs, words), "shingle-members")
    centres = keys.groupBy("key").agg(F.max_by("c", F.struct("most", "c")).alias("a"))
    meet = keys.join(centres, "key").where("a != c").groupBy("a", "c").agg(F.count("*").alias("shared"))
    nearest = meet.groupBy(F.col("c").alias("b")).agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b")
    links = stage(compare(nearest, classes, members, percent), "shingle-links")
    roots = stage(components(links), "shingle-roots")
    left = stage(mixed_keys(keys, roots).where("ra != root").select("a", F.col("c").alias("b")).distinct(), "shingle-left")
    if left.isEmpty():
        return roots
    links = links.union(stage(compare(left, classes, members, percent), "shingle-links"))
    roots = stage(components(links), "shingle-roots")
    open_keys = stage(mixed_keys(keys, roots).select("a", "c", "root"), "shingle-open")
    if open_keys.isEmpty():
        return roots
    more = stage(compare(apart_pairs(open_keys, members, percent), classes, members, percent), "shingle-more")
    return roots if more.isEmpty() else components(links.union(more))


def similar_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, version, n_shingles, component_id) of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = stage(set_table(docs, words), "shingle-sets")
    named = sets.where("doc_id is not null and n_shingles > 0")
    least = F.min(F.struct("doc_id", "version")).alias("least")
    classes = named.groupBy("c").agg(F.max("n_shingles").alias("n_shingles"), least).select("c", "n_shingles", "least.*")
    classes = stage(classes, "shingle-classes")
    roots = linked_sets(docs.where("doc_id is not null"), classes, words, percent)
    placed = classes.join(roots.withColumnRenamed("node", "c"), "c", "left").select("c", "doc_id", F.coalesce("root", "c").alias("root"))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_set = placed.join(least, "root").select("c", "component_id")
    empty = F.col("n_shingles") == 0
    found = sets.join(by_set, "c", "left")
    component = F.when(empty | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "version", "n_shingles", component.alias("component_id"))


def op6_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest id.

    Empty texts and rows without an id are in no group and stay. Of rows that share id and text
    one stays.
    """
    found = similar_documents(docs, STAGE_WORDS, STAGE_PERCENT)
    kept = found.where("n_shingles = 0 or doc_id = component_id").select(F.col("doc_id").alias("_d"), F.col("version").alias("_v")).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    version = F.xxhash64(F.coalesce(F.col("row.text"), F.lit("")))
    held = rows.where("row.doc_id is not null").join(kept, (F.col("row.doc_id") == F.col("_d")) & (version == F.col("_v")), "left")
    held = held.where("_d is not null").dropDuplicates(["_d", "_v"]).select("row.*")
    return held.unionByName(docs.where("doc_id is null"))


SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) END AS s
  FROM words
), members AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))
), reached AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reached WHERE a = doc_id), doc_id)) AS component_id
FROM sets"""

QUERIES: dict = {"op6_shingle_join": (op6_shingle_join, SQL)}
