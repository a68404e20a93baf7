"""An open-addressing table from 64-bit hashes to consecutive numbers, worked on in whole arrays."""

from __future__ import annotations

import numpy as np

from terrane.llm.textops import mix64


class HashTable:
    """Keys get the numbers 0, 1, 2, ... in the order they are added."""

    def __init__(self, capacity: int = 1 << 16) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.count = 0
        self._grow(capacity)

    def _grow(self, capacity: int) -> None:
        capacity = 1 << max(4, int(capacity - 1).bit_length())
        old = self.keys[: self.count]
        self.keys = np.zeros(capacity, np.uint64)
        self.keys[: self.count] = old
        self.slots = np.full(4 * capacity, -1, np.int32)
        self._place(old, np.arange(self.count, dtype=np.int32))

    def _place(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        mask = len(self.slots) - 1
        at = (mix64(keys) & np.uint64(mask)).astype(np.int64)
        while len(at):
            free = np.flatnonzero(self.slots[at] < 0)
            self.slots[at[free]] = numbers[free]  # the last writer of a slot has it
            lost = self.slots[at] != numbers
            at, numbers = (at[lost] + 1) & mask, numbers[lost]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers, -1 for those not there."""
        mask = len(self.slots) - 1
        at = (mix64(keys) & np.uint64(mask)).astype(np.int64)
        out = self.slots[at].astype(np.int64)
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            got = self.slots[at[todo]]
            out[todo] = got
            todo = todo[(got >= 0) & (self.keys[got] != keys[todo])]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Adds keys, all different and none there yet."""
        if self.count + len(keys) > len(self.keys):
            self._grow(self.count + len(keys))
        first = self.count
        self.keys[first : first + len(keys)] = keys
        self.count += len(keys)
        self._place(keys, np.arange(first, self.count, dtype=np.int32))
