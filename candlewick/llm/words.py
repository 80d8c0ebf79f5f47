"""Words of many texts at once: bounds and hashes as arrays, without a Python step per word.

A word is a longest run of bytes outside space, tab, newline, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: All of ASCII but letters and digits.
MARKS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Bits of the first k bytes of a little-endian word.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
U = np.uint64
STEP = U(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64 bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Words:
    """Texts of one batch. starts, ends: byte bounds of each word in data; first: index of each text's first word, and the total."""

    def __init__(self, texts: pa.Array, lower: bool = False, blank: np.ndarray = BLANK):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        size = int(bounds[-1] - bounds[0])
        self.data = np.zeros(size + 8, np.uint8)
        if size:
            self.data[:size] = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]]
        if lower:
            self.data = LOWER[self.data]
        self.bounds = bounds - bounds[0]
        solid = ~blank[self.data[:size]]
        begins, finishes = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        finishes[:-1] &= ~solid[1:]
        full = self.bounds[:-1][np.diff(self.bounds) > 0]
        begins[full] = solid[full]
        last = self.bounds[1:][np.diff(self.bounds) > 0] - 1
        finishes[last] = solid[last]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(finishes) + 1
        self.first = np.searchsorted(self.starts, self.bounds)

    def hashes(self) -> np.ndarray:
        """64 bits of each word, eight bytes a step."""
        size = self.ends - self.starts
        lanes = np.ndarray((max(1, len(self.data) - 7),), "<u8", self.data, strides=(1,))
        out = mix(lanes[self.starts] & KEEP[np.minimum(size, 8)] ^ (size.astype(U) * STEP)) if len(size) else np.zeros(0, U)
        at, longer = 8, np.flatnonzero(size > 8)
        while len(longer):
            part = lanes[self.starts[longer] + at] & KEEP[np.minimum(size[longer] - at, 8)]
            out[longer] = mix(out[longer] * STEP + part)
            at += 8
            longer = longer[size[longer] > at]
        return out

    def prefixes(self, n: int) -> np.ndarray:
        """The first n bytes of each word, 8 at most, as a number."""
        lanes = np.ndarray((max(1, len(self.data) - 7),), "<u8", self.data, strides=(1,))
        return lanes[self.starts] & KEEP[np.minimum(self.ends - self.starts, n)] if len(self.starts) else np.zeros(0, U)

    def owners(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def runs(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of every n consecutive entries, by doubling; runs over a text's end are for the caller to leave out."""
    if len(h) < n:
        return np.zeros(0, U)
    power, size, out = STEP | U(1), 1, None
    part, done = h, 0
    with np.errstate(over="ignore"):
        while True:
            if n & size:
                out = part if out is None else out[:len(h) - done - size + 1] * power + part[done:done + len(h) - done - size + 1]
                done += size
            if done == n:
                return mix(out + U(seed))
            part = part[:len(part) - size] * power + part[size:]
            power, size = power * power, size * 2
