"""difflib's ratio for long texts: the same blocks, found by hashes of runs in place of lists of every character's places."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

SMALL = 1 << 14  # below so many pairs of places difflib itself is as fast
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Runs:
    """Hashes of the runs of a text: sums of mixed code points times powers of an odd base, modulo 2^64."""

    def __init__(self, points: np.ndarray, power: np.ndarray):
        h = points.astype(np.uint64) + np.uint64(1)
        h = (h ^ (h >> np.uint64(16))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        self.total = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum((h ^ (h >> np.uint64(32))) * power[: len(h)], out=self.total[1:])
        self.power = power

    def keys(self, low: int, high: int, size: int) -> np.ndarray:
        """Of the runs of `size` that begin at low or later and end before high, times the same power."""
        last = high - size + 1
        return (self.total[low + size : last + size] - self.total[low:last]) * self.power[len(self.power) - last : len(self.power) - low][::-1]


def _common(a: np.ndarray, b: np.ndarray) -> bool:
    a, b = (np.sort(a), np.sort(b)) if len(a) >= len(b) else (np.sort(b), np.sort(a))
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return bool((a[at] == b).any())


def _longest_run(equal: np.ndarray) -> int:
    ends = np.flatnonzero(np.append(~equal, True))
    return int(np.diff(ends, prepend=-1).max()) - 1


def _matched(x: str, y: str) -> int:
    return sum(b.size for b in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())


def ratio(x: str, y: str, least: float = 0.0) -> float:
    """SequenceMatcher(None, x, y, autojunk=False).ratio() if it is `least` or more, else 0.

    As there, the longest common run counts (of several the first in x, of its places the first in y), then what is left
    of it and right of it. All longest runs of a range that follow each other are taken at once, and each is compared
    with the text; a range in which equal hashes were of unequal runs goes to difflib."""
    n, m = len(x), len(y)
    if not n + m:
        return 1.0
    p, q = _points(x), _points(y)
    kinds, of = np.unique(np.concatenate([p, q]), return_inverse=True)
    shared = np.minimum(np.bincount(of[:n], minlength=len(kinds)), np.bincount(of[n:], minlength=len(kinds))).sum()
    if 2.0 * int(shared) / (n + m) < least:
        return 0.0
    power = np.full(max(n, m) + 1, _BASE, dtype=np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    a, b = _Runs(p, power), _Runs(q, power)
    found, possible = 0, min(n, m)  # possible: found, and all of the shorter side of what is open
    todo = [(0, n, 0, m, min(n, m))]
    while todo:
        if 2.0 * possible / (n + m) < least:
            return 0.0
        low, high, down, up, most = todo.pop()
        possible -= min(high - low, up - down)
        most = min(most, high - low, up - down)
        taken, rest = _blocks(x, y, p, q, a, b, low, high, down, up, most) if (high - low) * (up - down) > SMALL else (None, [])
        if taken is None:
            taken = _matched(x[low:high], y[down:up])
        found += taken
        possible += taken + sum(min(r[1] - r[0], r[3] - r[2]) for r in rest)
        todo += rest
    r = 2.0 * found / (n + m)
    return r if r >= least else 0.0


def _blocks(x: str, y: str, p: np.ndarray, q: np.ndarray, a: _Runs, b: _Runs, low: int, high: int, down: int, up: int, most: int) -> tuple[int | None, list[tuple[int, int, int, int, int]]]:
    """The characters in the longest common runs of x[low:high] and y[down:up], none of them longer than `most`, and the
    ranges between them with the longest that a run in them can be. None for the characters if hashes misled."""

    def common(size: int) -> bool:
        return _common(a.keys(low, high, size), b.keys(down, up, size))

    wide = min(high - low, up - down)
    size = min(most, max(_longest_run(p[low : low + wide] == q[down : down + wide]), _longest_run(p[high - wide : high] == q[up - wide : up])))
    step = 1
    while size < most and common(min(size + step, most)):
        size = min(size + step, most)
        step *= 2
    above = min(size + step, most + 1)  # no common run is so long
    while above - size > 1:
        middle = (size + above) // 2
        size, above = (middle, above) if common(middle) else (size, middle)
    if not size:
        return 0, []
    keys = b.keys(down, up, size)
    order = np.argsort(keys, kind="stable")
    keys, own = keys[order], a.keys(low, high, size)
    first = np.searchsorted(keys, own)
    starts = np.flatnonzero(keys[np.minimum(first, len(keys) - 1)] == own)
    first, last = first[starts], np.searchsorted(keys, own[starts], side="right")
    final = order[last - 1] + down
    taken, rest, i, j, k = 0, [], low, down, 0
    while True:
        k += int(np.searchsorted(starts[k:], i - low))
        while k < len(starts) and final[k] < j:  # nor will it have a place after any later j
            k += 1
        if k == len(starts):
            break
        places = order[first[k] : last[k]]
        s, t = low + int(starts[k]), down + int(places[np.searchsorted(places, j - down)])
        if x[s : s + size] != y[t : t + size]:
            return None, []
        taken += size
        rest.append((i, s, j, t, size - 1))
        i, j = s + size, t + size
    rest.append((i, high, j, up, size - 1))
    return taken, [r for r in rest if r[1] > r[0] and r[3] > r[2] and r[4] > 0]
