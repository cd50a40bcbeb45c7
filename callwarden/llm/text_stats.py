"""Exact counts of whole documents, computed on blocks of bytes."""

from __future__ import annotations

import numpy as np

from callwarden.llm.common import (
    FOLD, NONSPACE, U64, code_points, group_sums, mix, owners, span_hashes, window_hashes, word_spans,
)

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
UPPERCASE = np.zeros(256, bool)
UPPERCASE[ord("A") : ord("Z") + 1] = True
DIGITS = np.zeros(256, bool)
DIGITS[ord("0") : ord("9") + 1] = True
LETTERS = np.zeros(256, bool)
LETTERS[ord("a") : ord("z") + 1] = True
LETTERS[ord("A") : ord("Z") + 1] = True
LETTERS[0xC0:] = True  # first byte of a character beyond ASCII
MARKS = np.zeros(256, bool)
MARKS[[ord(c) for c in ".,;:!?'\"()-"]] = True
WINDOW = 8


def line_spans(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first line of each document and of the end): lines split at line feeds.

    A document without text has one empty line.
    """
    feeds = np.flatnonzero(data == 10)
    of = np.searchsorted(edges, feeds, "right") - 1
    counts = np.bincount(of, minlength=len(edges) - 1) + 1 if len(edges) > 1 else np.empty(0, np.int64)
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    starts = np.empty(first[-1], np.int64)
    ends = np.empty(first[-1], np.int64)
    place = np.arange(len(feeds)) + of
    ends[place], starts[place + 1] = feeds, feeds + 1
    starts[first[:-1]], ends[first[1:] - 1] = edges[:-1], edges[1:]
    return starts, ends, first


def repeats(keys: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found before in the group, found twice or more in the group) for every element."""
    later, again = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys) < 2:
        return later, again
    salted = mix(keys + mix(groups.astype(np.uint64) + U64(1)))
    order = np.argsort(salted, kind="stable")
    same = salted[order[1:]] == salted[order[:-1]]
    later[order[1:]] = same
    again[order[1:]] |= same
    again[order[:-1]] |= same
    return later, again


def counts(data: np.ndarray, edges: np.ndarray) -> dict[str, np.ndarray]:
    """Counts per document; words are runs without ``[\\x20\\x09-\\x0D]``."""
    docs = len(edges) - 1
    starts, ends, first = word_spans(data, edges)
    hashes = span_hashes(data, starts, ends)
    word_doc = owners(first)
    # repeated windows
    windows = window_hashes(hashes, WINDOW)
    inside = word_doc[: len(windows)] == word_doc[WINDOW - 1 :] if len(windows) else np.empty(0, bool)
    at = np.flatnonzero(inside)
    _, again = repeats(windows[at], word_doc[at])
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + WINDOW, -1)
    repeated = np.cumsum(cover[:-1]) > 0
    # repeated lines
    line_start, line_end, line_first = line_spans(data, edges)
    word_at = np.searchsorted(starts, line_start)
    with_word = (word_at < len(starts)) & (np.append(starts, len(data))[word_at] < line_end)
    held = np.flatnonzero(with_word)
    line_doc = owners(line_first)
    dup, _ = repeats(span_hashes(data, line_start[held], line_end[held]), line_doc[held])
    # distinct words
    folded = span_hashes(data, starts, ends, fold=True)
    seen, _ = repeats(folded, word_doc)
    per = lambda flags: group_sums(flags, edges)
    follow = np.zeros(len(hashes), bool)
    follow[1:] = (folded[1:] == folded[:-1]) & (word_doc[1:] == word_doc[:-1])
    last = data[ends - 1] if len(ends) else np.empty(0, np.uint8)
    return {
        "n_chars": per(code_points(data)),
        "n_words": np.diff(first),
        "word_chars": per(NONSPACE[data] & code_points(data)),
        "n_symbols": per(SYMBOLS[data]),
        "n_lines": np.diff(line_first),
        "n_dup_lines": np.bincount(line_doc[held][dup], minlength=docs),
        "n_repeat_words": group_sums(repeated, first),
        "n_upper": per(UPPERCASE[data]),
        "n_digits": per(DIGITS[data]),
        "n_letters": per(LETTERS[data]),
        "n_marks": per(MARKS[data]),
        "n_exclaims": per(data == ord("!")),
        "n_distinct": np.diff(first) - group_sums(seen, first),
        "n_follow": group_sums(follow, first),
        "n_symbol_ends": group_sums(SYMBOLS[last], first),
        "n_folded": per(FOLD[data] != data),
    }
