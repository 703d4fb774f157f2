"""Vectorised text primitives over Arrow string buffers.

Words, lines and shingles of many texts are found and hashed at once with numpy, straight on the
UTF-8 bytes. Substring hashes come from a polynomial prefix sum modulo 2**64: any slice's hash is a
subtraction and one multiplication by an inverse power.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tessera.llm.common import strings

#: Any odd multiplier works: it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
U = np.uint64
CHUNK = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

#: ASCII letters and digits, and every byte of a character beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.empty(size, U)
        have[0] = 1
        filled = 1
        with np.errstate(over="ignore"):
            while filled < size:
                have[filled : 2 * filled] = have[:filled] * U(pow(base, filled, 1 << 64))
                filled *= 2
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


@dataclass
class Texts:
    """A run of texts as one byte buffer; ``at`` holds the texts' bounds."""

    first: int
    data: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def prefix(self) -> np.ndarray:
        n = len(self.data)
        out = np.zeros(n + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum((self.data.astype(U) + U(1)) * powers(BASE, n), out=out[1:])
        return out

    def spans(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes where ``word`` holds, cut at text bounds: starts, ends, text index."""
        n = len(self.data)
        edge = np.zeros(n + 1, bool)
        edge[self.at] = True
        starts = word.copy()
        starts[1:] &= ~word[:-1] | edge[1:n]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | edge[1:n]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        return s, e, self.owner(s)

    def owner(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, position, side="right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""The \n-split lines of each text, empty ones included."""
        breaks = np.flatnonzero(self.data == 10)
        s = np.sort(np.concatenate([self.at[:-1], breaks + 1]), kind="stable")
        own = np.sort(np.concatenate([np.arange(len(self)), self.owner(breaks)]), kind="stable")
        nxt = np.append(s[1:] - 1, self.at[-1])
        last = np.append(own[1:] != own[:-1], True)
        return s, np.where(last, self.at[own + 1], nxt), own


def hashes(prefix: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the byte slices [s, e)."""
    with np.errstate(over="ignore"):
        raw = (prefix[e] - prefix[s]) * powers(BASE_INV, len(prefix))[s]
        return mix(raw + (e - s).astype(U) * U(0xD6E8FEB86659FD93))


def windows(h: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one text: index of the first word, hash."""
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, U)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - k + 1, U)
        for j in range(k):
            out = out * U(0xC2B2AE3D27D4EB4F) + h[j : len(h) - k + 1 + j]
    keep = np.flatnonzero(own[k - 1 :] == own[: len(own) - k + 1])
    return keep, mix(out[keep])


def runs(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[Texts]:
    """Whole texts in runs of about ``limit`` bytes; a longer text is a run of its own."""
    column = strings(column)
    if not len(column):
        return
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    body = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield Texts(i, body[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def lowered(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Lower-case texts, nulls empty."""
    return pa.array([x.lower() for x in strings(column).to_pylist()], pa.string())


def lowered_runs(column: pa.Array | pa.ChunkedArray, rows: int = 500) -> Iterator[Texts]:
    """runs() of the lower-case texts, made a few rows at a time to bound the copies."""
    for at in range(0, len(column), rows):
        for t in runs(lowered(column.slice(at, rows))):
            t.first += at
            yield t
