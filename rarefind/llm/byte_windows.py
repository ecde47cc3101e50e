"""Rolling hashes of byte windows, and the places at which equal windows are sure to meet.

Hashes are polynomials over 64-bit numbers: from prefix sums, any slice's hash takes two look-ups. Long
texts are worked on in chunks, so memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
CHUNK = 1 << 18
_PLACE_BITS = 20
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _powers(base: int, n: int) -> np.ndarray:
    table = np.full(n, base, np.uint64)
    table[0] = 1
    return np.multiply.accumulate(table)


_UP = _powers(_BASE, CHUNK + 4096)
_DOWN = _powers(_INVERSE, CHUNK + 4096)


def scramble(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a hash over the whole number, one to one."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class SliceHashes:
    """Hashes of any slices of at most a chunk of bytes."""

    def __init__(self, data: bytes | np.ndarray):
        x = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
        self._sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _UP[: len(x)], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return scramble((self._sums[end] - self._sums[start]) * _DOWN[start] + (end - start).astype(np.uint64))

    def runs(self, width: int) -> np.ndarray:
        """Hashes of all slices of a width, by start."""
        n = len(self._sums) - width
        return scramble((self._sums[width:] - self._sums[:n]) * _DOWN[:n] + np.uint64(width))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every window: from minima towards both ends of blocks of the window's width."""
    n = len(values) - width + 1
    blocks = np.full(-(-len(values) // width) * width, _NONE, np.uint64)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


@dataclass
class Anchors:
    """Runs of windows that share an anchor: the slice with the least hash in each of them.

    Equal windows have their anchor at the same place inside, whatever stands around them. ``first`` is
    the first window's start, ``count`` the number of windows, ``inside`` the anchor's place after
    ``first``; ``core`` hashes the anchor's slice and ``whole`` all bytes of the run's windows.
    """

    first: np.ndarray
    count: np.ndarray
    inside: np.ndarray
    core: np.ndarray
    whole: np.ndarray


def anchors(data: bytes | np.ndarray, window: int, core: int) -> Iterator[Anchors]:
    """Every window of a text, by anchor, one chunk after another. An array holds a number per place."""
    x = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    n_windows = len(x) - window + 1
    for at in range(0, max(0, n_windows), CHUNK):
        n = min(CHUNK, n_windows - at)
        hashes = SliceHashes(x[at : at + n + window - 1])
        cores = hashes.runs(core)
        places = np.arange(len(cores), dtype=np.uint64)
        least = sliding_minimum((cores & ~_PLACE) | places, window - core + 1)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        count = np.diff(np.concatenate((first, [n])))
        anchor = (least[first] & _PLACE).astype(np.int64)
        whole = hashes.of(first, first + count + window - 1)
        yield Anchors(at + first, count, anchor - first, cores[anchor].view(np.int64), whole.view(np.int64))
