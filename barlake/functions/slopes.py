"""The median of all pairwise slopes without making them: selection by counting inversions.

The slope of two samples is at most theta where values less theta times position are out of order, so a merge sort counts the
slopes up to theta in n log n. An interval about the median is narrowed until few slopes are left in it; only those are made.
"""

from __future__ import annotations

import numpy as np

#: Values of a set up to which all slopes are made at once, and slopes per value that are made in the end.
SMALL, LEFT = 256, 8


def _crossings(ranks: np.ndarray, pairs: bool = False) -> int | tuple[np.ndarray, np.ndarray]:
    """How many pairs of a permutation of 0..n-1 are out of order; or the pairs themselves, as places."""
    n, width, total, found = len(ranks), 1, 0, []
    place = np.empty(n, np.int64)
    place[ranks] = np.arange(n)
    held = ranks.astype(np.int64)
    index = np.arange(n)
    while width < n:
        block = index // (2 * width)
        left = index % (2 * width) < width
        keys = held + block * n  # blocks stand in order, and each half is sorted
        lower, upper = keys[left], keys[~left]
        ends = np.minimum(np.cumsum(np.bincount(block[left], minlength=block[-1] + 1)), len(lower))[block[~left]]
        start = np.searchsorted(lower, upper)
        size = np.maximum(ends - start, 0)
        total += int(size.sum())
        if pairs and size.any():
            hit = size > 0
            first = np.repeat(start[hit] - np.concatenate(([0], np.cumsum(size[hit])[:-1])), size[hit]) + np.arange(int(size[hit].sum()))
            found.append((held[left][first], np.repeat(held[~left][hit], size[hit])))
        held = np.sort(keys) - block * n
        width *= 2
    if not pairs:
        return total
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return place[np.concatenate([a for a, _ in found])], place[np.concatenate([b for _, b in found])]


def _order(v: np.ndarray, theta: float) -> np.ndarray:
    """Samples by value less theta times position; of equal ones the later first, so that a slope of theta counts as passed."""
    n = np.arange(len(v))
    return np.lexsort((-n, v - theta * n))


def _up_to(v: np.ndarray, theta: float) -> int:
    """Slopes of at most theta."""
    order = _order(v, theta)
    ranks = np.empty(len(v), np.int64)
    ranks[order] = np.arange(len(v))
    return _crossings(ranks)


def median_slope(v: np.ndarray) -> float | None:
    """The median of (v[j] - v[i]) / (j - i) over all i < j, the mean of the middle two; None for fewer than two values.

    Where more equal slopes than LEFT a value lie about the median, the interval ends at 1e-13 of the slopes' range and its
    middle is taken.
    """
    v = np.asarray(v, float)
    n = len(v)
    if n < 2:
        return None
    if n <= SMALL:
        i, j = np.triu_indices(n, 1)
        return float(np.median((v[j] - v[i]) / (j - i)))
    steps, total = np.diff(v), n * (n - 1) // 2
    low, high = float(steps.min()), float(steps.max())  # no slope is steeper than all steps
    margin = 1e-6 * max(high - low, abs(low), abs(high), 1e-300)  # so that rounding leaves none outside
    low, high = low - margin, high + margin
    wanted = (total - 1) // 2, total // 2
    below, upto, least = 0, total, 1e-13 * max(high - low, 1e-300)
    sample = np.random.default_rng(n)
    while upto - below > LEFT * n and high - low > least:
        i = sample.integers(0, n - 1, 4096)
        j = i + 1 + (sample.random(4096) * (n - 1 - i)).astype(np.int64)
        slopes = (v[j] - v[i]) / (j - i)
        inside = np.sort(slopes[(slopes > low) & (slopes < high)])
        share = (wanted[0] - below) / (upto - below)
        # two cuts about where the median should lie among the sampled slopes; where too few are left, halves
        if len(inside) > 64:
            around = int(3 * np.sqrt(len(inside)))
            cuts = [float(inside[int(np.clip(share * len(inside) + d, 0, len(inside) - 1))]) for d in (-around, around)]
        else:
            cuts = []
        moved = False
        for cut in cuts:
            if not low < cut < high:
                continue
            count = _up_to(v, cut)
            if count <= wanted[0]:
                low, below, moved = cut, count, True
            elif count > wanted[1]:
                high, upto, moved = cut, count, True
        if not moved:
            middle = (low + high) / 2
            if not low < middle < high:
                return high  # neighbours: all that are left equal it
            count = _up_to(v, middle)
            if count <= wanted[0]:
                low, below = middle, count
            elif count > wanted[1]:
                high, upto = middle, count
            else:
                break  # the two middle slopes lie on either side
    if upto - below > LEFT * n and high - low <= least:
        return (low + high) / 2
    # slopes in (low, high]: samples that change their order between the two
    first, ranks = _order(v, low), np.empty(n, np.int64)
    ranks[_order(v, high)] = np.arange(n)
    a, b = _crossings(ranks[first], True)
    i, j = np.minimum(first[a], first[b]), np.maximum(first[a], first[b])
    slopes = np.sort((v[j] - v[i]) / (j - i))
    if not len(slopes):  # an interval as narrow as rounding
        return (low + high) / 2
    return float(np.mean([slopes[min(max(k - below, 0), len(slopes) - 1)] for k in wanted]))
