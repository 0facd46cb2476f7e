"""Small exact integer problems over the types of tasks, of which there are few however many tasks there are.

A type is a vector of slots in each group, with the number of tasks that have it. Python's whole numbers and fractions decide; floats
only choose what is tried.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np

#: Nodes of the search after which the best assignment so far is returned with a bound that may lie above it.
MOST_NODES = 20_000


def _relaxed(room: list[int], vectors: np.ndarray, counts: list[int]) -> tuple[np.ndarray, int]:
    """Shares of each type that fill the room best, by the simplex method with bounded columns, and the exact bound of its prices.

    The bound is that of any prices p >= 0: what the room is worth and what each task gains beyond its price.
    """
    m, n = len(room), len(counts)
    a = np.concatenate([vectors.T.astype(float), np.eye(m)], 1)
    up = np.concatenate([np.array(counts, float), np.full(m, np.inf)])
    gain = np.concatenate([np.ones(n), np.zeros(m)])
    basis, full = list(range(n, n + m)), np.zeros(n + m, bool)
    b = np.array(room, float)
    for step in range(50 * (m + 1) + 4 * n):
        inverse = np.linalg.inv(a[:, basis])
        x = inverse @ (b - a[:, full] @ up[full]) if full.any() else inverse @ b
        d = gain - (gain[basis] @ inverse) @ a
        d[basis] = 0
        better = np.where(full, -d, d)
        better[basis] = 0
        able = np.flatnonzero(better > 1e-9)
        if not len(able):
            break
        j = int(able[better[able].argmax()]) if step < 25 * (m + 1) + 2 * n else int(able[0])
        w = inverse @ a[:, j] * (-1 if full[j] else 1)
        limit, leave = up[j], -1
        for i in range(m):
            if w[i] > 1e-9:
                t = max(0.0, x[i]) / w[i]
            elif w[i] < -1e-9 and np.isfinite(up[basis[i]]):
                t = max(0.0, up[basis[i]] - x[i]) / -w[i]
            else:
                continue
            if t < limit - 1e-12:
                limit, leave = t, i
        if leave < 0:
            full[j] = not full[j]
            continue
        full[basis[leave]] = w[leave] < 0
        full[j] = False
        basis[leave] = j
    share = np.where(full, up, 0)
    share[basis] = x
    return np.clip(share[:n], 0, up[:n]), _bound(room, vectors, counts, _prices(a, basis, gain))


def _prices(a: np.ndarray, basis: list[int], gain: np.ndarray) -> list[Fraction]:
    """The prices of a basis as fractions, those below zero as zero."""
    m = len(basis)
    rows = [[Fraction(int(a[i, j])) for i in range(m)] + [Fraction(int(gain[j]))] for j in basis]
    for c in range(m):
        at = next((r for r in range(c, m) if rows[r][c]), None)
        if at is None:
            return [Fraction(0)] * m
        rows[c], rows[at] = rows[at], rows[c]
        rows[c] = [v / rows[c][c] for v in rows[c]]
        for r in range(m):
            if r != c and rows[r][c]:
                rows[r] = [v - rows[r][c] * u for v, u in zip(rows[r], rows[c], strict=True)]
    return [max(Fraction(0), rows[c][m]) for c in range(m)]


def _bound(room: list[int], vectors: np.ndarray, counts: list[int], prices: list[Fraction]) -> int:
    scale = 1
    for p in prices:
        scale = scale * p.denominator // np.gcd(scale, p.denominator)
    whole = [int(p * int(scale)) for p in prices]
    value = sum(p * r for p, r in zip(whole, room, strict=True))
    for v, n in zip(vectors.tolist(), counts, strict=True):
        value += n * max(0, int(scale) - sum(p * c for p, c in zip(whole, v, strict=True)))
    return value // int(scale)


def most(room: list[int], vectors: list[list[int]], counts: list[int]) -> tuple[list[int], int]:
    """How many tasks of each type to take so that as many as can be fit into the room of each group, and a proven bound on their number.

    Branch and bound on the numbers of types: the relaxation's exact price bound prunes, its shares rounded down and filled up greedily
    are tried. Of equal bounds, which most nodes have, the newest is opened first, so the search goes down to whole shares. The bound
    equals the number found unless MOST_NODES were not enough. Rooms must not be negative.
    """
    v = np.array(vectors, np.int64).reshape(len(counts), len(room))
    full = list(counts)
    cheap = np.argsort(v.sum(1), kind="stable").tolist()

    def tried(low: list[int], high: list[int], share: np.ndarray) -> list[int]:
        x = [min(h, lo + int(s + 1e-9)) for lo, h, s in zip(low, high, share, strict=True)]
        left = [r - int(u) for r, u in zip(room, np.array(x, object) @ v.astype(object) if len(x) else [0] * len(room), strict=True)]
        while min(left) < 0:  # floats were too generous
            i = max(range(len(x)), key=lambda t: (x[t] > low[t], int((v[t] * (np.array(left) < 0)).sum())))
            if x[i] <= low[i]:
                return low
            x[i] -= 1
            left = [r + int(c) for r, c in zip(left, v[i], strict=True)]
        for i in cheap:
            more = min([full[i] - x[i], *(r // int(c) for r, c in zip(left, v[i], strict=True) if c)])
            if more > 0:
                x[i] += more
                left = [r - more * int(c) for r, c in zip(left, v[i], strict=True)]
        return x

    def node(low: list[int], high: list[int]):
        left = [r - int(u) for r, u in zip(room, np.array(low, object) @ v.astype(object) if low else [0] * len(room), strict=True)]
        if min(left, default=0) < 0:
            return None
        share, bound = _relaxed(left, v, [h - lo for lo, h in zip(low, high, strict=True)])
        return bound + sum(low), share

    best = tried([0] * len(full), full, np.zeros(len(full)))
    if not counts:
        return best, 0
    root = node([0] * len(full), full)
    heap, order, nodes = [(-root[0], 0, [0] * len(full), full, root[1])], 1, 0
    while heap:
        bound, _, low, high, share = heapq.heappop(heap)
        if -bound <= sum(best):
            return best, sum(best)
        if nodes >= MOST_NODES:
            return best, -bound
        nodes += 1
        x = tried(low, high, share)
        if sum(x) > sum(best):
            best = x
        part = np.abs(share - np.round(share))
        i = int(part.argmax()) if part.max() > 1e-7 else next((t for t in range(len(low)) if low[t] < high[t]), None)
        if i is None:
            continue
        cut = low[i] + int(share[i] + 1e-9)
        cut = min(cut, high[i] - 1)
        for lo, hi in (([*low[:i], cut + 1, *low[i + 1 :]], high), (low, [*high[:i], cut, *high[i + 1 :]])):
            found = node(lo, hi)
            if found is not None and found[0] > sum(best):
                heapq.heappush(heap, (-found[0], -order, lo, hi, found[1]))
                order += 1
    return best, sum(best)


def spread(supply: list[int], vectors: list[list[int]], counts: list[int]) -> list[list[int]]:
    """How many tasks of each type are hit from each group, so that the groups' supplies hit as many different tasks as they can.

    A group can hit a task that has a slot in it. Supplies go to types by augmenting paths: a group takes what is spare, or takes over
    what another group can hit elsewhere instead.
    """
    flow = [[0] * len(supply) for _ in counts]
    left, spare = list(supply), list(counts)
    while True:
        queue = [("g", g) for g in range(len(left)) if left[g]]
        came: dict = dict.fromkeys(queue)
        end = None
        while queue and end is None:
            following = []
            for kind, i in queue:
                if kind == "g":
                    step = [("t", t) for t in range(len(counts)) if vectors[t][i]]
                else:
                    step = [("g", h) for h in range(len(supply)) if flow[i][h]]
                for s in step:
                    if s not in came:
                        came[s] = (kind, i)
                        following.append(s)
                        if s[0] == "t" and spare[s[1]]:
                            end = s
                            break
                if end:
                    break
            queue = following
        if end is None:
            return flow
        path = [end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        amount = min(left[path[0][1]], spare[end[1]])
        for a, b in zip(path, path[1:], strict=False):
            if a[0] == "t":
                amount = min(amount, flow[a[1]][b[1]])
        left[path[0][1]] -= amount
        spare[end[1]] -= amount
        for a, b in zip(path, path[1:], strict=False):
            if a[0] == "g":
                flow[b[1]][a[1]] += amount
            else:
                flow[a[1]][b[1]] -= amount
