"""Trigrams of ``^token$`` over Arrow batches of lower-cased texts.

Tokens are runs of ``[a-z0-9_$]``. A token of n characters has n trigrams, one round each of its
characters, so a trigram is a character with its two neighbours (or the marks ``^`` and ``$``) and
has a code of its own below ``CODES``: no dictionary of trigrams is needed anywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The start mark, then the characters of tokens; the place of a character is its class.
ALPHABET = "^abcdefghijklmnopqrstuvwxyz0123456789_$"
CODES = len(ALPHABET) ** 3
END = len(ALPHABET) - 1
#: Characters handled at once, whatever the length of a text.
SLICE = 1 << 19

_CLASS = np.zeros(256, np.uint8)
_CLASS[np.frombuffer(ALPHABET[1:].encode(), np.uint8)] = np.arange(1, len(ALPHABET))


def gram_texts() -> np.ndarray:
    """The trigram of every code."""
    letters = np.array(list(ALPHABET))
    n = len(ALPHABET)
    code = np.arange(CODES)
    first, second, third = letters[code // (n * n)], letters[code // n % n], letters[code % n]
    return np.char.add(np.char.add(first, second), third)


def fold(buckets: int) -> np.ndarray:
    """The bucket of every code: CRC32 of the trigram, modulo ``buckets``."""
    return np.array([zlib.crc32(g.encode()) % buckets for g in gram_texts().tolist()], np.int64)


def positions(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, codes) of all trigrams, slice by slice; a null text has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(ends[0]), int(ends[-1])
    ends = ends - low
    kinds = _CLASS[np.frombuffer(data, np.uint8)[low:high]]
    filled = ends[1:] > ends[:-1]
    opens, closes = np.zeros(high - low, bool), np.zeros(high - low, bool)
    opens[ends[:-1][filled]] = True
    closes[ends[1:][filled] - 1] = True
    for a in range(0, high - low, SLICE):
        at = np.flatnonzero(kinds[a : a + SLICE]) + a
        if not len(at):
            continue
        left = np.where(opens[at], 0, kinds[at - 1])
        right = kinds[np.minimum(at + 1, high - low - 1)]
        right = np.where(closes[at] | (right == 0), END, right)
        codes = (left.astype(np.int64) * len(ALPHABET) + kinds[at]) * len(ALPHABET) + right
        yield np.searchsorted(ends, at, side="right") - 1, codes
