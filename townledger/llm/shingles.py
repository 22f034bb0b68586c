"""Word and shingle hashes of whole texts, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

GOLD = np.uint64(0x9E3779B97F4A7C15)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S30, S27, S31 = np.uint64(30), np.uint64(27), np.uint64(31)
# Hashes of words that a worker remembers, at most; about 20 MB.
CACHED_WORDS = 100_000


def step(n: int) -> np.uint64:
    """The n-th offset of the number sequence."""
    return np.uint64(n * int(GOLD) % (1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> S30)) * M1
    x = (x ^ (x >> S27)) * M2
    return x ^ (x >> S31)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def forget_words() -> None:
    """Give the memory back at the end of a task; the worker lives on for other stages."""
    _words.clear()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
# Words of more bytes are hashed one by one.
LONG_WORD = 64
_TO_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)


def word_bounds(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text with U+0009 to U+000D as spaces, first byte of every word and the byte after its last one."""
    text = text.translate(_TO_SPACE)
    edges = np.flatnonzero(np.diff(np.frombuffer(b" " + text + b" ", np.uint8) == 32))
    return text, edges[::2], edges[1::2]


def span_hashes(text: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words at these bytes, eight bytes of all words at a time: no lookup, however many words differ."""
    eight = np.ndarray((len(text) + 1,), "<u8", text + bytes(8), 0, (1,))
    size = end - begin
    h = mix(size.astype(np.uint64) * GOLD + (eight[begin] & _BYTES[np.minimum(size, 8)]))
    at, rows = 8, np.flatnonzero(size > 8)
    while len(rows) and at < LONG_WORD:
        h[rows] = mix(h[rows] * GOLD + (eight[begin[rows] + at] & _BYTES[np.minimum(size[rows] - at, 8)]))
        at += 8
        rows = rows[size[rows] > at]
    for i in rows.tolist():
        h[i] = xxhash.xxh3_64_intdigest(text[begin[i]:end[i]])
    return h


def run_hashes(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of k consecutive words, in order; empty for shorter texts."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt, np.uint64)
    for i in range(k):
        out = mix(out * GOLD + h[i:i + n])
    return out


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case; bytes split at space and U+0009 to U+000D only."""
    return text.encode().lower().split() if text else []


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter text is one shingle, one without words has none."""
    h = word_hashes(lower_words(text))
    return np.unique(run_hashes(h, min(k, len(h)))) if len(h) else np.zeros(0, np.uint64)


ODD = 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base^0, base^1, … modulo 2^64; kept and lengthened as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def window_hashes(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of k words by differences of prefix sums: the cost does not depend on k."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    back, forth = _power_table(pow(ODD, -1, 1 << 64), n), _power_table(ODD, n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + step(salt + 1)) * back)])
    return mix((total[k:] - total[:n - k + 1]) * forth[k:])
