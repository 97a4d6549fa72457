"""A cuckoo filter over 64-bit keys with insertion and deletion, as plain bytes that fit in a table cell."""

from __future__ import annotations

import numpy as np

SLOTS = 4
_KICKS = 500


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; no false negatives for keys that were inserted and not deleted.

    A fingerprint that many kicks cannot place waits in `spare` with its bucket, so none is ever dropped.
    Each key is to be inserted once and deleted at most as often.
    """

    def __init__(self, buckets: int):
        self.cells = np.zeros((buckets, SLOTS), np.uint16)
        self.spare: list[tuple[int, int]] = []

    @classmethod
    def sized(cls, n_keys: int) -> CuckooFilter:
        """An empty filter that `n_keys` keys fill to four fifths at most."""
        buckets = 1
        while buckets * SLOTS * 0.8 < max(1, n_keys):
            buckets *= 2
        return cls(buckets)

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        buckets, spare = (int(x) for x in np.frombuffer(blob, np.int64, 2))
        made = cls(1)
        made.cells = np.frombuffer(blob, np.uint16, buckets * SLOTS, 16).reshape(-1, SLOTS).copy()
        made.spare = [(int(m), int(b)) for m, b in np.frombuffer(blob, np.int64, 2 * spare, 16 + 2 * SLOTS * buckets).reshape(-1, 2)]
        return made

    def dump(self) -> bytes:
        return np.array([len(self.cells), len(self.spare)], np.int64).tobytes() + self.cells.tobytes() + np.array(self.spare, np.int64).tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.asarray(keys, np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        mark = ((h >> np.uint64(40)) & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (h & np.uint64(len(self.cells) - 1)).astype(np.int64)
        return mark, first, first ^ self._step(mark)

    def _step(self, mark: np.ndarray) -> np.ndarray:
        return ((mark.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(len(self.cells) - 1)).astype(np.int64)

    def insert(self, keys: np.ndarray) -> None:
        """Add keys, slot by slot for all of them; what finds both its buckets full is kicked in."""
        mark, first, second = self._places(keys)
        left = np.arange(len(mark))
        for bucket in (first, second):
            for slot in range(SLOTS):
                free = left[self.cells[bucket[left], slot] == 0]
                put = free[np.unique(bucket[free], return_index=True)[1]]
                self.cells[bucket[put], slot] = mark[put]
                left = np.setdiff1d(left, put, assume_unique=True)
        for i in left:
            self._kick(int(first[i]), int(mark[i]))

    def _kick(self, bucket: int, mark: int) -> None:
        for turn in range(_KICKS):
            free = np.flatnonzero(self.cells[bucket] == 0)
            if len(free):
                self.cells[bucket, free[0]] = mark
                return
            slot = (turn * 7 + mark) % SLOTS
            mark, self.cells[bucket, slot] = int(self.cells[bucket, slot]), mark
            bucket = bucket ^ int(self._step(np.array([mark], np.uint16))[0])
        self.spare.append((mark, bucket))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, first, second = self._places(keys)
        found = (self.cells[first] == mark[:, None]).any(1) | (self.cells[second] == mark[:, None]).any(1)
        for held, bucket in self.spare:
            found |= (mark == held) & ((first == bucket) | (second == bucket))
        return found

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that were inserted; one copy of the fingerprint goes for each."""
        for mark, first, second in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for bucket in (first, second):
                slot = np.flatnonzero(self.cells[bucket] == mark)
                if len(slot):
                    self.cells[bucket, slot[0]] = 0
                    break
            else:
                self.spare.remove((mark, first) if (mark, first) in self.spare else (mark, second))
