"""Cuckoo filters of digests, as plain bytes: membership with deletion, 16-bit fingerprints, buckets of four.

A digest lies in one of two buckets, each reachable from the other by its fingerprint alone. Absent digests are reported with
probability of about 8 / 65536; present ones always. Every digest may be in a filter once, which the exact tables behind it see to.
"""

from __future__ import annotations

import numpy as np

from .words import mix

SLOTS = 4
KICKS = 500
FULL = 0.9  # beyond this share of taken slots a filter is built anew with twice the buckets


def split(digests: list[bytes] | np.ndarray) -> np.ndarray:
    """The first 8 bytes of each digest as a number."""
    if isinstance(digests, np.ndarray):
        return digests
    return np.frombuffer(b"".join(d[:8] for d in digests), "<u8") if len(digests) else np.zeros(0, np.uint64)


def buckets_for(n: int) -> int:
    """The smallest power of two whose buckets are less than 80 % full with n digests."""
    return 1 << max(2, int(np.ceil(np.log2(max(n, 1) / (SLOTS * 0.8)))))


class Cuckoo:
    def __init__(self, buckets: int, table: bytes | None = None) -> None:
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else np.frombuffer(table, np.uint16).reshape(buckets, SLOTS).copy()

    @classmethod
    def of(cls, digests: list[bytes] | np.ndarray) -> Cuckoo:
        names, buckets = split(digests), buckets_for(len(digests))
        while True:
            made = cls(buckets)
            if made.insert(names):
                return made
            buckets *= 2

    def places(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and the two buckets of each digest."""
        print_of = (names >> np.uint64(48)).astype(np.uint16)
        print_of[print_of == 0] = 1
        first = (mix(names & np.uint64((1 << 48) - 1)) & np.uint64(self.buckets - 1)).astype(np.int64)
        return print_of, first, first ^ self.step(print_of)

    def step(self, print_of: np.ndarray) -> np.ndarray:
        return (mix(print_of.astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def contains(self, digests: list[bytes] | np.ndarray) -> np.ndarray:
        print_of, a, b = self.places(split(digests))
        return (self.table[a] == print_of[:, None]).any(1) | (self.table[b] == print_of[:, None]).any(1)

    def insert(self, digests: list[bytes] | np.ndarray) -> bool:
        """Whether all found a place; if not, the filter must be built anew."""
        print_of, a, b = self.places(split(digests))
        if (self.table > 0).sum() + len(print_of) > FULL * self.table.size:
            return False
        step = self.step(np.arange(1 << 16, dtype=np.uint16))
        free = SLOTS - (self.table > 0).sum(1)
        turn = 0
        for p, x, y in zip(print_of.tolist(), a.tolist(), b.tolist()):
            at = x if free[x] >= free[y] else y
            for _ in range(KICKS):
                if free[at]:
                    self.table[at, np.flatnonzero(self.table[at] == 0)[0]] = p
                    free[at] -= 1
                    break
                turn += 1  # a full bucket: the new one takes a slot in turn, what was there moves to its other bucket
                p, self.table[at, turn % SLOTS] = int(self.table[at, turn % SLOTS]), p
                at ^= int(step[p])
            else:
                return False
        return True

    def delete(self, digests: list[bytes] | np.ndarray) -> None:
        """Take out digests that were put in before."""
        for p, x, y in zip(*(v.tolist() for v in self.places(split(digests)))):
            at = x if (self.table[x] == p).any() else y
            hit = np.flatnonzero(self.table[at] == p)
            if not len(hit):
                raise ValueError("the filter does not hold this digest")
            self.table[at, hit[0]] = 0

    def bytes(self) -> bytes:
        return self.table.tobytes()
