"""Rolling hashes of word sequences, shared by the operators on word windows."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers, 5 modulo 8, of the polynomial hashes modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: So many words keep their hashes, of at most so many bytes each.
_KEPT, _KEPT_BYTES = 100_000, 64


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= _KEPT_BYTES:
            self[word] = value
        return value


_words = _Words()
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def clear() -> None:
    _words.clear()
    _powers.clear()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    held = _powers.get(base)
    if held is None or len(held[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        held = _powers[base] = tuple(both)
    return held[0][:n], held[1][:n]


def windows(hashes: np.ndarray, size: int, base: int = BASES[0]) -> np.ndarray:
    """Rabin-Karp hash of each window of `size` words, from one running sum; the last steps mix it."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    up, down = _power(base, len(hashes))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up, out=total[1:])
    x = (total[size:] - total[:-size]) * down[:n]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def window_minima(values: np.ndarray, size: int) -> np.ndarray:
    """The smallest of each `size` values in a row."""
    low, step = values, 1
    while step * 2 <= size:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    rest = size - step
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
