"""Byte-pair merges of many words at once, in vectorised rounds over flat symbol arrays."""

from __future__ import annotations

import numpy as np

NO_PAIR = np.iinfo(np.int64).max
#: Hash values of pairs have so many bits; the multipliers are odd and otherwise free.
BITS = 19
STEPS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _hashed(keys: np.ndarray, step: np.uint64) -> np.ndarray:
    found = keys.view(np.uint64) * step
    found >>= np.uint64(64 - BITS)
    return found.view(np.int64)


class PairMerges:
    """A merge table. Units are merged independently of each other.

    In each round every unit merges its pair of minimum rank, all units at once; units
    without a pair left are taken out and the arrays compacted.
    """

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], stride: int) -> None:
        """pairs: (left, right) -> (rank, merged symbol); symbols lie below `stride`."""
        self.stride = stride
        table = sorted((a * stride + b, r, m) for (a, b), (r, m) in pairs.items())
        self.keys, self.ranks, self.merged = (np.array(x, dtype=np.int64) for x in zip(*table, strict=True))
        # A place per hash value; the pairs whose place is taken have one by the next hash, the few left after two are searched.
        left = np.arange(len(self.keys))
        self.places = []
        for step in STEPS:
            place = np.zeros(1 << BITS, dtype=np.int32)
            place[_hashed(self.keys[left], step)] = left
            self.places.append(place)
            left = left[place[_hashed(self.keys[left], step)] != left]
        self.left = left

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.stride + right
        at = self.places[0][_hashed(key, STEPS[0])]
        found = self.keys[at] == key
        lost = np.flatnonzero(~found)
        if len(lost):
            again = self.places[1][_hashed(key[lost], STEPS[1])]
            if len(self.left):
                spare = self.left[np.minimum(np.searchsorted(self.keys[self.left], key[lost]), len(self.left) - 1)]
                again = np.where(self.keys[spare] == key[lost], spare, again)
            at[lost] = again
            found[lost] = self.keys[again] == key[lost]
        return np.where(found, self.ranks[at], NO_PAIR), self.merged[at]

    def merge(self, sym: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their units after all merges; `unit` ascends and holds for each symbol its unit's number."""
        rank, made = np.full(len(sym), NO_PAIR), np.zeros(len(sym), dtype=np.int64)
        inside = np.flatnonzero(unit[:-1] == unit[1:])
        rank[inside], made[inside] = self._look_up(sym[inside], sym[inside + 1])
        done_unit, done_sym = [], []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            sizes = np.diff(np.r_[starts, len(unit)])
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            over = least == NO_PAIR
            if over.any():
                done_unit.append(unit[over])
                done_sym.append(sym[over])
                sym, unit, rank, made, least = (x[~over] for x in (sym, unit, rank, made, least))
                if not len(sym):
                    break
            merges = self._chosen(sym, unit, rank, made, least)
            sym[merges] = made[merges]
            keep = np.ones(len(sym), dtype=bool)
            keep[merges + 1] = False
            place = np.cumsum(keep) - 1
            changed = place[merges]
            sym, unit, rank, made = (x[keep] for x in (sym, unit, rank, made))
            stale = np.zeros(len(sym) + 1, dtype=bool)  # the place before the first is the last, which is spare
            stale[changed] = stale[changed - 1] = True
            anew = np.flatnonzero(stale[:-1])
            rank[anew] = NO_PAIR
            anew = anew[anew + 1 < len(sym)]
            anew = anew[unit[anew] == unit[anew + 1]]
            rank[anew], made[anew] = self._look_up(sym[anew], sym[anew + 1])
        unit, sym = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (done_unit, done_sym))
        order = np.argsort(unit, kind="stable")
        return sym[order], unit[order]

    def _chosen(self, sym, unit, rank, made, least) -> np.ndarray:
        """Positions to merge: per unit the occurrences of its minimum rank that do not overlap, from the left.

        A unit whose merges would bring up a pair of smaller or equal rank merges only
        its leftmost occurrence, so that the order stays that of one merge at a time.
        """
        at = np.flatnonzero(rank == least)
        run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
        at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
        first = np.r_[True, unit[at[1:]] != unit[at[:-1]]]
        if first.all():
            return at
        new = made[at]
        left = at - 1
        behind = np.r_[False, at[1:] - at[:-1] == 2]  # the pair before was merged as well
        left_sym = np.where(behind, np.r_[0, new[:-1]], sym[left])
        left_in = (left >= 0) & (unit[left] == unit[at])
        right = np.minimum(at + 2, len(sym) - 1)
        right_in = (at + 2 < len(sym)) & (unit[right] == unit[at])
        early = (left_in & (self._look_up(left_sym, new)[0] <= least[at])) | (
            right_in & (self._look_up(new, sym[right])[0] <= least[at]))
        if not early.any():
            return at
        unsafe = np.isin(unit[at], unit[at[early]])
        return at[first | ~unsafe]



def split_ids(sym: np.ndarray, unit: np.ndarray, units: int) -> list[bytes]:
    """The ids of each unit as little-endian unsigned 32-bit integers."""
    ends = np.searchsorted(unit, np.arange(units), side="right") * 4
    raw = sym.astype("<u4").tobytes()
    return [raw[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]
