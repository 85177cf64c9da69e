"""A static binary-fuse filter (three segments, 8-bit fingerprints) over 64-bit keys, built with array operations."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

_HEAD = 3  # words before the fingerprints in the packed form


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _tag(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))).astype(np.uint8)


@dataclass(frozen=True)
class FuseFilter:
    """No key it was built from is ever refused; about one other key in 256 passes."""

    seed: int
    segment: int
    segments: int
    tags: np.ndarray

    def _slots(self, h: np.ndarray) -> np.ndarray:
        top = ((h >> np.uint64(32)) * np.uint64(self.segments * self.segment) >> np.uint64(32)).astype(np.int64)
        inside = np.int64(self.segment - 1)
        one = (top + self.segment) ^ ((h >> np.uint64(18)).astype(np.int64) & inside)
        two = (top + 2 * self.segment) ^ (h.astype(np.int64) & inside)
        return np.stack((top, one, two), 1)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(np.asarray(keys, np.uint64))
        n = max(len(keys), 2)
        segment = min(1 << 18, 1 << math.floor(math.log(n) / math.log(3.33) + 2.25))
        size = round(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)))
        segments = max(1, -(-size // segment) - 2)
        for seed in range(1, 200):
            f = cls(seed, segment, segments, np.zeros((segments + 2) * segment, np.uint8))
            if f._fill(_mix(keys, seed)):
                return f
        raise RuntimeError("no seed peels these keys")

    def _fill(self, h: np.ndarray) -> bool:
        slots = self._slots(h)
        degree = np.bincount(slots.ravel(), minlength=len(self.tags))
        left, rounds = np.arange(len(h)), []
        while len(left):
            single = degree[slots[left]] == 1
            peeled = single.any(1)
            if not peeled.any():
                return False
            k = left[peeled]
            rounds.append((k, single[peeled].argmax(1)))
            np.subtract.at(degree, slots[k].ravel(), 1)
            left = left[~peeled]
        tags = _tag(h)
        for k, which in reversed(rounds):
            mine = slots[k, which]
            self.tags[mine] = 0
            self.tags[mine] = tags[k] ^ np.bitwise_xor.reduce(self.tags[slots[k]], axis=1)
        return True

    def __contains__(self, key: int) -> bool:
        return bool(self.screen(np.array([key], np.uint64))[0])

    def screen(self, keys: np.ndarray) -> np.ndarray:
        h = _mix(np.asarray(keys, np.uint64), self.seed)
        return np.bitwise_xor.reduce(self.tags[self._slots(h)], axis=1) == _tag(h)

    def pack(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], "<i8").tobytes() + self.tags.tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> FuseFilter:
        head = np.frombuffer(data, "<i8", _HEAD)
        return cls(*map(int, head), np.frombuffer(data, np.uint8, offset=8 * _HEAD))
