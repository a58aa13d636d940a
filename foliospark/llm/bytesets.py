"""Batches of texts as one byte array, with hashes of byte ranges from prefix sums, all in numpy.

The hash of bytes b[s..e) is sum(b[i] * B**i) * B**-s modulo 2**64 for a fixed odd B, mixed with the length:
one prefix sum serves every range. Equal ranges have equal hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: An odd multiplier and its inverse modulo 2**64.
B = 0x9E3779B97F4A7C15
B_INV = pow(B, -1, 1 << 64)
_WS = np.zeros(256, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True
_pow: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _pow.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _pow[base] = np.multiply.accumulate(steps)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@dataclass
class Batch:
    """Texts laid end to end, each followed by a line feed. doc_of: the text of each word or line."""

    data: np.ndarray
    bounds: np.ndarray  # where each text starts; one more for the end

    @classmethod
    def of(cls, texts: list[bytes]) -> Batch:
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        return cls(np.frombuffer(b"\n".join([*texts, b""]), np.uint8), np.concatenate([[0], np.cumsum(lengths)]))

    def sums(self) -> np.ndarray:
        if not hasattr(self, "_sums"):
            s = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(self.data * powers(B, len(self.data)), out=s[1:])
            self._sums = s
        return self._sums

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        s = self.sums()
        h = (s[end] - s[start]) * powers(B_INV, len(self.data) + 1)[start]
        return mixed(h + (end - start).astype(np.uint64))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all words."""
        blank = _WS[self.data]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if len(self.data) and not blank[0]:
            edge = np.concatenate([[0], edge])
        return edge[0::2], edge[1::2]

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all lines, without the line feed."""
        end = np.flatnonzero(self.data == 10)
        return np.concatenate([[0], end[:-1] + 1]).astype(np.int64) if len(end) else end, end

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, side="right") - 1

    def chars(self) -> np.ndarray:
        """Code points before each byte."""
        if not hasattr(self, "_chars"):
            c = np.zeros(len(self.data) + 1, np.int64)
            np.cumsum((self.data & 0xC0) != 0x80, out=c[1:])
            self._chars = c
        return self._chars


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs more than once, and whether it is not the first of its kind."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    more, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    more[order[1:][same]] = True
    more[order[:-1][same]] = True
    return more, later
