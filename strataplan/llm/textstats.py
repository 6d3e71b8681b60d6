"""Per-text features shared by the classifiers: hashed words and structure statistics."""

from __future__ import annotations

import zlib

import numpy as np

STRUCTURE = [  # names of the structure statistics, in order
    "log_bytes", "log_words", "word_length", "distinct_words", "longest_run", "repeated_words", "symbols", "symbol_words",
    "digits", "upper", "white", "lines_per_word", "repeated_lines", "stops_per_word", "pipes", "high_bytes",
]

_CLASS = np.zeros(256, dtype=np.uint8)  # 1 letter, 2 digit, 3 white, 4 stop, 5 pipe, 6 symbol, 7 upper, 8 high
for _c in range(256):
    _s = chr(_c)
    _CLASS[_c] = 8 if _c > 127 else 7 if _s.isupper() else 1 if _s.isalpha() else 2 if _s.isdigit() else 3 if _s in " \t\n\v\f\r" else 4 if _s in ".,;:!?'\"-()" else 5 if _s == "|" else 6


def bounded_log(x: float) -> float:
    return float(np.log1p(x))


def structure(data: bytes, words: list[bytes]) -> np.ndarray:
    """The statistics of one text; all zero for an empty one."""
    out = np.zeros(len(STRUCTURE), dtype=np.float32)
    n, m = len(data), len(words)
    if not n:
        return out
    kinds = np.bincount(_CLASS[np.frombuffer(data, dtype=np.uint8)], minlength=9)
    lines = [x for x in data.split(b"\n") if x.strip()]
    longest = run = 1
    same = 0
    for a, b in zip(words, words[1:]):
        if a == b:
            run += 1
            same += 1
            longest = max(longest, run)
        else:
            run = 1
    out[:] = (
        bounded_log(n), bounded_log(m), bounded_log(n / max(m, 1)), len(set(words)) / max(m, 1) ** 0.75, bounded_log(longest), same / max(m, 1),
        kinds[6] / n, kinds[6] / max(m, 1), kinds[2] / n, kinds[7] / n, kinds[3] / n, len(lines) / max(m, 1), 1 - len(set(lines)) / max(len(lines), 1),
        kinds[4] / max(m, 1), kinds[5] / max(m, 1), kinds[8] / n,
    )
    return out


def hashed(words: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of the words and the square-rooted, unit-length counts in them."""
    h = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words)) & np.uint32((1 << bits) - 1)
    at, n = np.unique(h, return_counts=True)
    x = np.sqrt(n.astype(np.float32))
    return at.astype(np.int64), x / max(1e-6, float(np.linalg.norm(x)))
