"""Word shingles of many texts at once, as 64-bit numbers.

Words are runs of bytes other than space and the controls from tab to carriage return, A-Z lower-cased. A
word's number is a polynomial in its bytes, a shingle's one in its words' numbers, each mixed at the
end. Texts are worked on as one long array of bytes, so there is no loop over words.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
STEP = U(0xD1B54A32D192ED03)
_rng = np.random.default_rng(31)
SYMBOLS = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0xC6A4A7935BD1E995)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, at least, of a base and of its inverse: with them the polynomial hash of any stretch
    comes from a running sum."""
    if len(_tables.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", INVERSE)):
            _tables[name] = np.multiply.accumulate(np.concatenate([[U(1)], np.full(n * 5 // 4, base)]))
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Words:
    """Words of some texts: number of each, place of its bytes in `raw`, and each text's first word."""

    def __init__(self, texts: list[str]):
        coded = [t.encode() for t in texts]
        self.raw = _LOWER[np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)]
        space = _SPACE[self.raw]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edges = np.concatenate([[0], edges])
        self.begin, self.end = edges[::2], edges[1::2]
        self.offsets = np.concatenate([[0], np.cumsum([len(c) + 1 for c in coded])])
        self.first = np.searchsorted(self.begin, self.offsets)
        up, down = powers(len(self.raw) + 1)
        sums = np.zeros(len(self.raw) + 1, U)
        np.cumsum(SYMBOLS[self.raw] * up[: len(self.raw)], out=sums[1:])
        self.numbers = mix((sums[self.end] - sums[self.begin]) * down[self.begin])

    def shingles(self, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all k-word shingles in order, and each text's first one. A text with fewer words, but
        one at least, has its whole sequence as one shingle, whose number also depends on its length."""
        w, counts = self.numbers, np.diff(self.first)
        rolled = np.zeros(len(w), U)
        for i in range(k):
            n = max(0, len(w) - i)
            rolled[:n] = rolled[:n] * STEP + w[i:]
        rolled = mix(rolled)
        left = np.repeat(self.first[1:], counts) - np.arange(len(w))
        keep = left >= k
        short = np.flatnonzero((counts > 0) & (counts < k))
        for i in short.tolist():
            n, x = int(counts[i]), U(0)
            for y in w[self.first[i] : self.first[i + 1]].tolist():
                x = U((int(x) * int(STEP) + y) & 0xFFFFFFFFFFFFFFFF)
            at = self.first[i]
            rolled[at], keep[at] = mix(np.array([x ^ U(n)]))[0], True
        kept = np.concatenate([[0], np.cumsum(keep)])
        return rolled[keep], kept[self.first]

    def sets(self, k: int = 5) -> list[np.ndarray]:
        """The distinct shingles of each text, sorted."""
        numbers, first = self.shingles(k)
        return [np.unique(numbers[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def sliding(x: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """The best of each `width` numbers in a row (the result is width - 1 shorter), by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = best(out[: len(out) - step], out[step:])
        done += step
    return out
