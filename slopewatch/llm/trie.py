"""Double-array tries over whole-number symbols: built level by level, walked for many texts positions at once."""

from __future__ import annotations

import numpy as np

DEAD, ROOT = 0, 1
_TRIES = 40  # places tried for a node's children before they go to the end


class DoubleArray:
    """Node ``s`` has a child for symbol ``c`` where ``check[base[s] + c] == s``; that slot is the child.

    ``DEAD`` has no children and the last slot is never used, so a step from
    anywhere with any symbol, negative ones too, needs no special case.
    """

    def __init__(self) -> None:
        self.base, self.check = np.zeros(4, np.int32), np.full(4, -1, np.int32)
        self._free = np.array([False, False, True, True])

    def _grow(self, size: int) -> None:
        more = size - len(self.base)
        if more > 0:
            self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])
            self._free = np.concatenate([self._free, np.ones(more, bool)])

    def __getstate__(self) -> dict:
        return {"base": self.base, "check": self.check}  # to be walked only

    def add(self, parent: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Slots of new children, in the order given. A parent gets all of its children in one call, each once.

        Parents with many children are placed first, by trying places of a fixed
        sequence and else behind everything; those with one child take the remaining
        free slots in order. Symbols should be below some thousands: children lie
        as far apart as their symbols.
        """
        slots = np.zeros(len(parent), np.int32)
        if not len(parent):
            return slots
        order = np.lexsort((symbol, parent))
        heads = np.flatnonzero(np.r_[True, parent[order][1:] != parent[order][:-1]])
        many = np.diff(np.r_[heads, len(order)])
        self._grow(int((~self._free).sum() + 5 * len(parent) // 4) + int(symbol.max()) + 4)
        seed, used = 1, int(np.flatnonzero(~self._free)[-1]) + 1
        for g in np.argsort(-many, kind="stable")[: int((many > 1).sum())]:
            at = order[heads[g] : heads[g] + many[g]]
            c = symbol[at].astype(np.int64)
            span = int(c[-1] - c[0]) + 1
            for _ in range(_TRIES):
                seed = (seed * 6364136223846793005 + 1442695040888963407) % (1 << 64)
                places = c - c[0] + 2 + (seed >> 20) % max(len(self.base) - 3 - span, 1)
                if places[-1] < len(self.base) - 1 and self._free[places].all():
                    break
            else:
                if used + span >= len(self.base):
                    self._grow(used + span + len(self.base) // 4 + 1)
                places = c - c[0] + used
            used = max(used, int(places[-1]) + 1)
            self._put(parent[at[0]], at, places, c, slots)
        alone = order[heads[many == 1]]
        if len(alone):
            places = np.flatnonzero(self._free[:-1])
            if len(places) < len(alone):
                self._grow(len(self.base) + len(alone) + 1)
                places = np.flatnonzero(self._free[:-1])
            places = places[: len(alone)]
            self._put(parent[alone], alone, places, symbol[alone].astype(np.int64), slots)
        return slots

    def _put(self, parents: np.ndarray, at: np.ndarray, places: np.ndarray, c: np.ndarray, slots: np.ndarray) -> None:
        self.base[parents] = (places - c)[0] if np.ndim(parents) == 0 else places - c
        self.check[places] = parents
        self._free[places] = False
        slots[at] = places

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Children of ``state`` by ``symbol``, ``DEAD`` where there is none."""
        to = np.clip(self.base[state] + symbol, 0, len(self.base) - 1)
        return np.where(self.check[to] == state, to, DEAD)
