"""Shared helpers: staging in the shared folder, Arrow text buffers, word spans and hashes.

Texts are handled as UTF-8 bytes. Words are maximal runs without ``[\\x20\\x09-\\x0D]``. Every helper
takes a block of whole documents; a block holds at most ``BLOCK_BYTES`` of text unless one
document alone is longer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwarden.session import ensure_checkpoint_dir, ship_package

BLOCK_BYTES = 1 << 20
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[ord(c) for c in SPACES]] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


# ---------------------------------------------------------------- Spark side


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, so its lineage ends there."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package shipped to the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_crc(doc_id: str = "doc_id"):
    """crc32 of the id written as text; it settles the folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


# ---------------------------------------------------------------- Arrow side


def column_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; NULL counts as empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    kind = values.type
    values = pc.fill_null(values, b"" if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) else "")
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    _, offsets, data = values.buffers()
    count = len(values)
    if offsets is None or count == 0:
        return np.empty(0, np.uint8), np.zeros(count + 1, np.int64)
    edges = np.frombuffer(offsets, np.int64 if wide else np.int32)
    edges = edges[values.offset : values.offset + count + 1].astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), np.zeros(count + 1, np.int64)
    return np.frombuffer(data, np.uint8)[edges[0] : edges[-1]], edges - edges[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most ``limit`` bytes of text each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, edges = column_bytes(batch.column(column))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(edges, edges[row] + limit, "right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield batch.slice(row, end - row)
            row = end


def word_spans(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document and of the end) of all words of a block."""
    size = len(data)
    if size == 0:
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(edges), np.int64)
    inside = NONSPACE[data]
    cuts = edges[(edges > 0) & (edges < size)]
    before = np.empty(size, bool)
    before[0], before[1:] = False, inside[:-1]
    before[cuts] = False
    after = np.empty(size, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, edges)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def _power_tables(count: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < count:
        _tables["up"], _tables["down"] = _powers(_BASE, count), _powers(_INVERSE, count)
    return _tables["up"], _tables["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hash of each byte span; ``fold`` lower-cases A-Z first. Spans are in order."""
    codes = _BYTE_CODES[FOLD] if fold else _BYTE_CODES
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = starts[first]
        last = max(int(np.searchsorted(ends, base + BLOCK_BYTES, "right")), first + 1)
        part = data[base : ends[last - 1]]
        up, down = _power_tables(len(part) + 1)
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(codes[part] * up[: len(part)], out=sums[1:])
        low, high = starts[first:last] - base, ends[first:last] - base
        out[first:last] = mix((sums[high] - sums[low]) * down[low] + (high - low).astype(np.uint64))
        first = last
    return out


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes (over document ends too)."""
    count = max(len(words) - size + 1, 0)
    out = np.zeros(count, np.uint64)
    for k in range(size):
        out = out * U64(0xD6E8FEB86659FD93) + words[k : k + count]
    return mix(out)


def owners(edges: np.ndarray) -> np.ndarray:
    """Group number of every element, given group edges."""
    return np.repeat(np.arange(len(edges) - 1), np.diff(edges))


def group_sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of ``values`` per group of consecutive elements; 0 for empty groups."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def code_points(data: np.ndarray) -> np.ndarray:
    """True where a UTF-8 character begins."""
    return (data & 0xC0) != 0x80
