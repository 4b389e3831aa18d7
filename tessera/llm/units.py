"""Encoding by units: texts are cut where no token crosses, each distinct unit is encoded once and its ids are cached.

All texts of a block are cut, hashed and looked up at once by numpy; only units that are new to the worker reach the
tokenizer. Units are known by a 64-bit hash of their code points and their length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import rolling as R

#: Cached units of a worker; beyond them the cache starts anew.
MOST_UNITS = 700_000
_CODE_POINTS = 0x110000
_keys: dict[str, np.ndarray] = {}


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and where each text starts (and the last one ends)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.r_[0, np.cumsum(sizes)]


def unit_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if "cp" not in _keys:
        _keys["cp"] = np.random.default_rng(20240602).integers(1, 1 << 63, _CODE_POINTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    up, down = R._grown(len(points))
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_keys["cp"][points] * up[: len(points)], out=total[1:], dtype=np.uint64)
    return R.mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class UnitEncoder:
    """``cut(points, offsets)`` gives starts and ends of units; ``encode(units)`` their ids, flat, and counts."""

    def __init__(self, cut: Callable, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = MOST_UNITS):
        self.cut, self.encode, self.most = cut, encode, most
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def _learn(self, keys: np.ndarray, units: list[str]) -> None:
        ids, count = self.encode(units)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.int32)])
        self.pool[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(count) - count
        self.used += len(ids)
        keys, at, count = (np.concatenate(x) for x in ((self.keys, keys), (self.at, at), (self.count, count)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.count = keys[order], at[order], count[order]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and where each text's ids start (and the last one's end)."""
        points, offsets = code_points(texts)
        starts, ends = self.cut(points, offsets)
        hashes = unit_hashes(points, starts, ends)
        keys, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self._clear()
        slot = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[slot] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            units = [points[starts[i] : ends[i]].tobytes().decode("utf-32-le", "surrogatepass") for i in first[new]]
            self._learn(keys[new], units)
            slot = np.searchsorted(self.keys, keys)
        count = self.count[slot][place]
        at = self.at[slot][place]
        total = np.cumsum(count)
        flat = np.arange(total[-1] if len(total) else 0) + np.repeat(at - (total - count), count)
        bounds = np.r_[0, total][np.searchsorted(starts, offsets)]
        return self.pool[flat], bounds


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about ``most`` bytes of text, so that only one run is unpacked at a time."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        end = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + most, "right")))
        yield batch.slice(first, end - first)
        first = end


def text_blocks(texts: list[str], most: int = 500_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` characters."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t)
    if texts:
        yield first, len(texts)
