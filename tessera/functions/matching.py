"""Likeness of two texts by their matching blocks, in numpy.

The blocks are those of the classic rule: the longest common run (the first in the one text, then in the other), then the same to the left and to the right of it. In a second text of
FEW code points or more, those that make up over a hundredth of it start no run; they only lengthen one. Ranks of all runs of 1, 2, 4, ... code points are made once for
both texts, by doubling, and only where both have such a run; the longest run within any two stretches is then put together from the largest power down.
"""

from __future__ import annotations

import numpy as np

#: From so many code points of the second text on, frequent ones start no run. Stretches with so many pairs of places are compared place by place.
FEW, SMALL = 200, 2048


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _same(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common beginning."""
    n, at, step = min(len(x), len(y)), 0, 32
    while at < n:
        differ = x[at : min(at + step, n)] != y[at : min(at + step, n)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + len(differ), step * 4
    return n


class Runs:
    """Common runs of two texts a and b."""

    def __init__(self, first: str, second: str):
        self.first, self.second = first, second
        self.a, self.b = a, b = _codes(first), _codes(second)
        both = np.concatenate([a, b])
        kinds, rank = np.unique(both, return_inverse=True)
        here, there = np.zeros(len(kinds), bool), np.bincount(rank[len(a) :], minlength=len(kinds))
        here[rank[: len(a)]] = True
        good = here & (there > 0)
        if len(b) >= FEW:
            good &= there <= len(b) // 100 + 1
        self.starts = good[rank[: len(a)]].tolist()
        rank = np.where(good[rank], rank, -1)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # ranks in a and in b, -1 where the other has no such run
        size = 1
        while (rank >= 0).any():
            self.levels.append((rank[: len(a)], rank[len(a) :]))
            one = np.flatnonzero(rank >= 0)
            end = np.where(one < len(a), len(a), len(both))
            one = one[one + 2 * size <= end]
            one = one[rank[one + size] >= 0]
            if not len(one):
                break
            _, new = np.unique(rank[one] * (int(rank.max()) + 1) + rank[one + size], return_inverse=True)
            mine = one < len(a)
            shared = np.zeros(int(new.max()) + 1, np.int8)
            shared[new[mine]] |= 1
            shared[new[~mine]] |= 2
            rank = np.full(len(both), -1)
            rank[one] = np.where(shared[new] == 3, new, -1)
            size *= 2
        self.seen = np.zeros(max([len(kinds), *(int(max(x.max(initial=-1), y.max(initial=-1))) + 1 for x, y in self.levels)]) + 1, bool)

    def _common(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in x and in y whose ranks are in both; the last mark stands for -1."""
        self.seen[y] = True
        self.seen[-1] = False
        at = np.flatnonzero(self.seen[x])
        self.seen[y] = False
        if not len(at):
            return at, at
        self.seen[x[at]] = True
        of = np.flatnonzero(self.seen[y])
        self.seen[x[at]] = False
        return at, of

    def _small(self, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int]:
        """The longest run, by the lengths of the runs that end at each pair of places."""
        best, before, find = (a0, b0, 0), {}, self.second.find
        for i in range(a0, a1):
            now: dict[int, int] = {}
            if self.starts[i]:
                j = find(self.first[i], b0, b1)
                while j >= 0:
                    now[j] = size = before.get(j - 1, 0) + 1
                    if size > best[2]:
                        best = (i - size + 1, j - size + 1, size)
                    j = find(self.first[i], j + 1, b1)
            before = now
        return best

    def longest(self, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int]:
        """Places in a and b and length of the longest run in a[a0:a1] and b[b0:b1], lengthened by what starts none."""
        i, j, size = a0, b0, 0
        small = (a1 - a0) * (b1 - b0) <= SMALL
        if small:
            i, j, size = self._small(a0, a1, b0, b1)
        for k in range(min(len(self.levels), min(a1 - a0, b1 - b0).bit_length()) - 1, -1, -1) if not small else ():
            size = 1 << k
            in_a, in_b = self.levels[k]
            x, y = in_a[a0 : a1 - size + 1], in_b[b0 : b1 - size + 1]
            p, q = self._common(x, y)
            if not len(p):
                size = 0
                continue
            kind_p, kind_q = x[p], y[q]
            p, q = p + a0, q + b0
            for more in range(k - 1, -1, -1):
                step = 1 << more
                in_a, in_b = self.levels[more]
                fit_p, fit_q = np.flatnonzero(p + size + step <= a1), np.flatnonzero(q + size + step <= b1)
                next_p, next_q = in_a[p[fit_p] + size], in_b[q[fit_q] + size]
                fit_p, next_p, fit_q, next_q = fit_p[next_p >= 0], next_p[next_p >= 0], fit_q[next_q >= 0], next_q[next_q >= 0]
                if not len(fit_p) or not len(fit_q):
                    continue
                wide = len(self.seen)
                key_p, key_q = kind_p[fit_p] * wide + next_p, kind_q[fit_q] * wide + next_q
                in_p = np.isin(key_p, key_q)
                if in_p.any():
                    in_q = np.isin(key_q, key_p)
                    fit_p, fit_q = fit_p[in_p], fit_q[in_q]
                    _, kinds = np.unique(np.concatenate([key_p[in_p], key_q[in_q]]), return_inverse=True)
                    p, q, kind_p, kind_q, size = p[fit_p], q[fit_q], kinds[: len(fit_p)], kinds[len(fit_p) :], size + step
            i, j = int(p[0]), int(q[np.argmax(kind_q == kind_p[0])])
            break
        back = _same(self.a[a0:i][::-1], self.b[b0:j][::-1])
        i, j, size = i - back, j - back, size + back
        return i, j, size + _same(self.a[i + size : a1], self.b[j + size : b1])


def matching(a: str, b: str) -> int:
    """Code points in matching blocks."""
    runs, total, todo = Runs(a, b), 0, [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        i, j, size = runs.longest(a0, a1, b0, b1)
        if size:
            total += size
            todo += [(p, q, r, s) for p, q, r, s in ((a0, i, b0, j), (i + size, a1, j + size, b1)) if p < q and r < s]
    return total


def ratio(a: str, b: str) -> float:
    """2 * matching / all code points; 1 for two empty texts."""
    return 1.0 if a == b else 2.0 * matching(a, b) / (len(a) + len(b))
