"""A cuckoo filter over 128-bit keys, vectorised, with exact overflow.

Buckets of four 16-bit fingerprints; a key's second bucket follows from
its first and the fingerprint, so a key can be deleted again. Keys that
find no place after ``KICKS`` moves go to an exact overflow list, so the
filter never gives a false negative. Fingerprint 0 marks an empty slot.
"""

from __future__ import annotations

import io

import numpy as np

from churnlab.llm.shingles import mix64

SLOTS, KICKS, LOAD = 4, 200, 0.8


class CuckooFilter:
    def __init__(self, capacity: int):
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * LOAD)))))
        self.table = np.zeros((buckets, SLOTS), np.uint16)
        self.overflow = np.zeros((0, 2), np.uint64)

    @property
    def capacity(self) -> int:
        return int(self.table.size * LOAD)

    def _places(self, h1: np.ndarray, h2: np.ndarray):
        mask = np.uint64(len(self.table) - 1)
        mark = (h2.view(np.uint64) >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = mix64(h1.view(np.uint64)) & mask
        return mark, first.astype(np.int64), (first ^ self._step(mark)).astype(np.int64)

    def _step(self, mark) -> np.ndarray:
        return mix64(np.asarray(mark).astype(np.uint64) + np.uint64(1)) & np.uint64(len(self.table) - 1)

    def marked(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Keys whose fingerprint is in the table."""
        mark, i, j = self._places(h1, h2)
        return (self.table[i] == mark[:, None]).any(axis=1) | (self.table[j] == mark[:, None]).any(axis=1)

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Keys of the overflow list, exactly."""
        found = np.isin(h1.view(np.uint64), self.overflow[:, 0])
        over = set(map(tuple, self.overflow.tolist()))
        for x in np.flatnonzero(found).tolist():
            found[x] = (int(h1[x].view(np.uint64)), int(h2[x].view(np.uint64))) in over
        return found

    def list_exactly(self, h1: np.ndarray, h2: np.ndarray) -> None:
        self.overflow = np.concatenate([self.overflow, np.column_stack([h1.view(np.uint64), h2.view(np.uint64)])])

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = self.marked(h1, h2)
        if len(self.overflow):
            found |= np.isin(h1.view(np.uint64), self.overflow[:, 0]) & np.isin(h2.view(np.uint64), self.overflow[:, 1])
        return found

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Add distinct keys that are not in the filter."""
        mark, i, j = self._places(h1, h2)
        left = np.arange(len(h1))
        for where in (i, j):
            left = left[~self._fill(mark[left], where[left])]
        rng = np.random.default_rng(len(h1))
        for x in left.tolist():
            m, at = mark[x], int(j[x])
            moves = []
            for _ in range(KICKS):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = m
                    break
                slot = int(rng.integers(SLOTS))
                moves.append((at, slot))
                m, self.table[at, slot] = self.table[at, slot], m
                at = int(np.uint64(at) ^ self._step(m))
            else:
                for at, slot in reversed(moves):  # undo, then keep the key itself
                    m, self.table[at, slot] = self.table[at, slot], m
                key = np.array([[h1[x], h2[x]]]).view(np.uint64)
                self.overflow = np.concatenate([self.overflow, key])

    def _fill(self, mark: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Put marks into free slots of their buckets; which ones went in."""
        order = np.argsort(where, kind="stable")
        bucket = where[order]
        rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket, side="left")
        free = self.table[bucket] == 0
        fits = rank < free.sum(axis=1)
        slot = (np.cumsum(free, axis=1) == (rank + 1)[:, None]).argmax(axis=1)
        self.table[bucket[fits], slot[fits]] = mark[order][fits]
        done = np.zeros(len(where), bool)
        done[order[fits]] = True
        return done

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Remove keys that were inserted before."""
        mark, i, j = self._places(h1, h2)
        over = {tuple(k) for k in self.overflow.tolist()}
        for x in range(len(h1)):
            key = (int(h1[x].view(np.uint64)), int(h2[x].view(np.uint64)))
            if key in over:
                over.discard(key)
                self.overflow = self.overflow[~((self.overflow[:, 0] == key[0]) & (self.overflow[:, 1] == key[1]))]
                continue
            for at in (i[x], j[x]):
                slot = np.flatnonzero(self.table[at] == mark[x])
                if len(slot):
                    self.table[at, slot[0]] = 0
                    break


class FilterStack:
    """Cuckoo filters of one shard; another, larger one once the last is full.

    Only the last filter takes keys. A key whose fingerprint an earlier one
    holds goes to the last one's exact list instead, so the first filter
    with a key's fingerprint is the one that holds the key.
    """

    def __init__(self, parts: list[CuckooFilter] | None = None, keys: list[int] | None = None):
        self.parts, self.keys = parts or [], keys or []

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h1), bool)
        for part in self.parts:
            found |= part.contains(h1, h2)
        return found

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> None:
        at = 0
        while at < len(h1):
            room = self.parts[-1].capacity - self.keys[-1] if self.parts else 0
            if room <= 0:
                size = max(len(h1) - at, 2 * sum(self.keys), 64)
                self.parts.append(CuckooFilter(size))
                self.keys.append(0)
                continue
            a, b = h1[at : at + room], h2[at : at + room]
            met = np.zeros(len(a), bool)
            for part in self.parts[:-1]:
                met |= part.marked(a, b)
            self.parts[-1].insert(a[~met], b[~met])
            self.parts[-1].list_exactly(a[met], b[met])
            self.keys[-1] += len(a)
            at += room

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Each key from the list or the filter that holds it."""
        left = np.arange(len(h1))
        for held in (CuckooFilter.listed, CuckooFilter.marked):
            for n, part in enumerate(self.parts):
                here = held(part, h1[left], h2[left])
                part.delete(h1[left[here]], h2[left[here]])
                self.keys[n] -= int(here.sum())
                left = left[~here]

    def dump(self) -> bytes:
        out, arrays = io.BytesIO(), {"keys": np.array(self.keys, np.int64)}
        for n, part in enumerate(self.parts):
            arrays |= {f"table{n}": part.table, f"overflow{n}": part.overflow}
        np.savez_compressed(out, **arrays)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> FilterStack:
        with np.load(io.BytesIO(data)) as z:
            keys, parts = z["keys"].tolist(), []
            for n in range(len(keys)):
                part = CuckooFilter.__new__(CuckooFilter)
                part.table, part.overflow = z[f"table{n}"], z[f"overflow{n}"]
                parts.append(part)
        return cls(parts, keys)
