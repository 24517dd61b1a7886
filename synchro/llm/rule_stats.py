"""Rule statistics of texts, for whole chunks of UTF-8 texts at once with numpy."""

from __future__ import annotations

import numpy as np

from . import common as C

_U64 = np.uint64
WINDOW = 5


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256, bool)
    m[list(chars)] = True
    return m


SYMBOL = _mask(b"#*$%&|<>")
LINE = ~_mask(b"\n")
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = LETTER[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
BANG, PIPE = _mask(b"!"), _mask(b"|")
POINT = np.ones(256, bool)
POINT[0x80:0xC0] = False


def sums(flags: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """True bytes in each range."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[e] - total[s]


def lines(data: np.ndarray, at: np.ndarray, s: np.ndarray):
    """Non-empty lines: starts, ends, row, first word, word after the last, equal to an earlier one."""
    a, b, _ = C.spans_of(LINE[data], at)
    row = np.searchsorted(at, a, "right") - 1
    w0, w1 = np.searchsorted(s, a), np.searchsorted(s, b)
    key = C.mix(C.span_hashes(data, a, b) ^ (row.astype(_U64) + _U64(1)) * _U64(0x9E3779B97F4A7C15))
    again = np.ones(len(a), bool)
    again[np.unique(key, return_index=True)[1]] = False
    return a, b, row, w0, w1, again


def repeated_words(h: np.ndarray, first: np.ndarray, k: int = WINDOW) -> np.ndarray:
    """By row the words in windows of k words that the row holds twice or more."""
    n = len(first) - 1
    win = C.windows(h, k)
    if not len(win):
        return np.zeros(n, np.int64)
    row = np.searchsorted(first, np.arange(len(win)), "right") - 1
    inside = np.arange(len(win)) + k <= first[row + 1]
    where = np.flatnonzero(inside)
    key = C.mix(win[where] ^ (row[where].astype(_U64) + _U64(1)) * _U64(0x9E3779B97F4A7C15))
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = where[count[back] > 1]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + k, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
    return covered[first[1:]] - covered[first[:-1]]


def statistics(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """By row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and shares for the forest."""
    s, e, first, h = C.words(data, at)
    n, lo, hi = len(at) - 1, at[:-1], at[1:]
    _, _, row, w0, w1, again = lines(data, at, s)
    worded = w1 > w0
    out = {
        "n_words": np.diff(first),
        "word_chars": sums(POINT[data] & ~C.SPACE[data], lo, hi),
        "n_symbols": sums(SYMBOL[data], lo, hi),
        "n_dup_lines": np.bincount(row[worded & again], minlength=n).astype(np.int64),
        "n_repeat_words": repeated_words(h, first),
    }
    words, letters = np.maximum(out["n_words"], 1), np.maximum(sums(LETTER[data] & POINT[data], lo, hi), 1)
    all_lines = np.maximum(np.bincount(row[worded], minlength=n), 1)
    out["shares"] = np.stack(
        [
            np.minimum(out["n_symbols"] / words, 4),
            np.minimum(sums(BANG[data], lo, hi) / words, 4),
            np.minimum(sums(PIPE[data], lo, hi) / words, 4),
            sums(UPPER[data], lo, hi) / letters,
            sums(DIGIT[data], lo, hi) / letters,
            out["n_repeat_words"] / words,
            out["n_dup_lines"] / all_lines,
            np.minimum(out["word_chars"] / words, 40),
        ],
        1,
    )
    return out
