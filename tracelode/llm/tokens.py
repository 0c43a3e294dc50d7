"""Words and rolling hashes of byte strings in numpy, shared by the text operators."""

from __future__ import annotations

import numpy as np

#: A-Z lower-cased; the bytes that separate words; ASCII punctuation, which separates words for passages.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BREAK = _SPACE.copy()
_BREAK[[c for c in range(128) if not chr(c).isalnum()]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser: every bit of the result depends on all bits."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Powers:
    """Powers of the base and of its inverse, made longer when a longer text comes."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE)], dtype=np.uint64)
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BACK)], dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = Powers()


class Rolling:
    """Hashes of any slices of one byte string, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _POWERS.get(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def windows(self, n: int) -> np.ndarray:
        """Hashes of all slices of n bytes."""
        return mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n] + np.uint64(n))


def word_hashes(text: str | None, passages: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, in order. Words end at ASCII white space; for passages also at ASCII punctuation."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(LOWER), np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~(_BREAK if passages else _SPACE)[raw]
    change = np.diff(inside)
    start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    if not len(start):
        return np.zeros(0, np.uint64)
    return Rolling(raw).slices(start, end)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words; of fewer words, the whole sequence as one."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(3) + words[k : len(words) - n + 1 + k])
    return np.unique(mix(out + np.uint64(n)))
