"""Arrays of the characters of many texts at once, for n-gram operators."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from tidewater.llm.shared import window_hashes

_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """For code points below 0x10000: the lower-case one if it is a single one; a space for white space."""
    if not _FOLD:
        table = np.arange(0x10000, dtype=np.uint32)
        for c in range(0x10000):
            ch = chr(c)
            if ch.isspace():
                table[c] = 32
            elif len(low := ch.lower()) == 1:
                table[c] = ord(low)
        _FOLD.append(table)
    return _FOLD[0]


@dataclass
class Run:
    """Consecutive texts: folded code points, each text followed by one 0. A text's characters keep their places."""

    first: int
    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def grams(self, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """A hash of the n-gram at each place, and whether that lies inside one text."""
        h = window_hashes(self.codes.astype(np.uint64) + np.uint64(seed), n)
        inside = np.ones(len(h) + n, bool)
        for k in range(n):
            inside[np.maximum(self.ends - k, 0)] = False
        return h, inside[: len(h)]


def runs(texts: list[str | None], most: int = 500_000) -> Iterator[Run]:
    """The texts in order, in runs of about `most` characters or of one longer text; null is empty."""
    part: list[str] = []
    first = total = 0
    for k, text in enumerate(texts):
        text = text or ""
        if part and total + len(text) > most:
            yield _run(part, first)
            part, first, total = [], k, 0
        part.append(text)
        total += len(text) + 1
    if part:
        yield _run(part, first)


def _run(part: list[str], first: int) -> Run:
    joined = ("\0".join(part) + "\0").encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(joined, np.uint32)
    fold = _fold()
    codes = np.where(codes < 0x10000, fold[np.minimum(codes, 0xFFFF)], codes)
    sizes = np.fromiter(map(len, part), np.int64, len(part))
    ends = np.cumsum(sizes + 1) - 1
    return Run(first, codes, ends - sizes, ends)
