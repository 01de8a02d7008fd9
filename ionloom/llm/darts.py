"""DartMinHash signatures: hashed darts thrown into the regions of weighted elements, the earliest kept per coordinate.

Every element owns a plane of (weight, rank) on which darts fall as a Poisson process of rate one that depends on
the element alone; each dart carries one of ``k`` coordinates. A set's element of weight w sees the darts below w,
and coordinate j of its signature is the dart of least rank with coordinate j over all its elements. Two sets
share coordinate j with the probability of their weighted Jaccard similarity, each coordinate by itself.

The plane is cut into cells whose darts are drawn from the cell's hash alone. Ranks are taken in strips from the
lowest on, as far as about ``k ln k + 2k`` darts of a set, so work follows the darts and not elements times k; where a
coordinate is still empty, the next strips follow for that set only.
"""

from __future__ import annotations

import numpy as np

K1, K2, K3 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Rank strips: [0, FIRST), then doubling up to 1, then of width 1. A larger set needs only the first strip.
DOUBLINGS = 4
FIRST = 2.0**-DOUBLINGS


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * K2
    x ^= x >> np.uint64(27)
    x *= K3
    x ^= x >> np.uint64(31)
    return x


def _strips(of: int) -> tuple[float, float]:
    """(start, width) of rank strip number ``of``."""
    if of == 0:
        return 0.0, FIRST
    if of <= DOUBLINGS:
        return FIRST * 2.0 ** (of - 1), FIRST * 2.0 ** (of - 1)
    return float(of - DOUBLINGS), 1.0


def _strip_of(rank: float) -> int:
    """Number of strips that hold all ranks below ``rank``."""
    if rank <= FIRST:
        return 1
    if rank <= 1:
        return 1 + int(np.ceil(np.log2(rank / FIRST)))
    return DOUBLINGS + int(np.ceil(rank))


def _poisson_steps(mean: float) -> np.ndarray:
    """Cumulative Poisson probabilities as 53-bit thresholds."""
    p, total, out = np.exp(-mean), 0.0, []
    for i in range(1, 64):
        total += p
        out.append(total)
        p *= mean / i
        if 1 - total < 1e-15:
            break
    return np.array(out)


def signatures(elements: np.ndarray, sets: np.ndarray, weights: np.ndarray | None, n_sets: int, k: int) -> np.ndarray:
    """(n_sets, k) dart ids of non-empty sets; ``sets`` names each element's set, ``weights`` are positive (None: all 1)."""
    total = np.bincount(sets, weights=weights, minlength=n_sets)
    goal = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300)
    upto = np.array([_strip_of(g) for g in goal])
    begin = np.zeros(n_sets, np.int64)
    rank = np.full(n_sets * k, np.inf)
    ids = np.zeros(n_sets * k, np.uint64)
    todo = np.ones(n_sets, bool)
    with np.errstate(over="ignore"):
        while todo.any():
            _throw(elements, sets, weights, np.where(todo, begin, 0), np.where(todo, upto, 0), k, rank, ids)
            begin = np.where(todo, upto, begin)
            todo &= np.isinf(rank.reshape(n_sets, k)).any(axis=1)
            upto = np.where(todo, np.where(upto <= DOUBLINGS, upto + 1, DOUBLINGS + 2 * (upto - DOUBLINGS)), upto)
    return ids.reshape(n_sets, k)


def _throw(elements, sets, weights, begin, upto, k, rank, ids) -> None:
    """Darts of strips begin to upto - 1 of each set, merged into ``rank`` and ``ids``."""
    first, last = begin[sets], upto[sets]
    for strip in range(int(begin.min(initial=0)), min(int(upto.max(initial=0)), DOUBLINGS + 1)):
        at = np.flatnonzero((first <= strip) & (last > strip))
        if len(at):
            _cells(elements, sets, weights, at, np.full(len(at), strip), k, rank, ids)
    low = np.maximum(first, DOUBLINGS + 1)
    count = np.maximum(last - low, 0)
    if count.any():
        at = np.repeat(np.arange(len(elements)), count)
        strip = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + low[at]
        for i in range(0, len(at), 1 << 18):
            _cells(elements, sets, weights, at[i : i + (1 << 18)], strip[i : i + (1 << 18)], k, rank, ids)


def _cells(elements, sets, weights, at, strip, k, rank, ids) -> None:
    """Darts of one rank strip of each element ``at``, over the weight strips [0, 1), [1, 2), [2, 4) and on."""
    level = 0
    while len(at):
        low, width = (0.0, 1.0) if level == 0 else (2.0 ** (level - 1), 2.0 ** (level - 1))
        _one_level(elements, sets, weights, at, strip, level, low, width, k, rank, ids)
        if weights is None:
            return
        above = weights[at] > low + width
        at, strip, level = at[above], strip[above], level + 1


def _one_level(elements, sets, weights, at, strip, level, low, width, k, rank, ids) -> None:
    seed = mix(elements[at] + (strip.astype(np.uint64) * np.uint64(64) + np.uint64(level)) * K1)
    u = (seed >> np.uint64(11)).astype(np.float64) * 2.0**-53
    same = int(strip.min()) == int(strip.max()) or strip.min() > DOUBLINGS
    start, height = _strips(int(strip[0]))
    # Weight strips of more than area one are cut, so that a cell's mean is one at most.
    cuts = max(1, int(np.ceil(height * width)))
    assert same
    for c in range(cuts):
        if c:
            seed = mix(seed + K1)
            u = (seed >> np.uint64(11)).astype(np.float64) * 2.0**-53
        n = np.searchsorted(_poisson_steps(height * width / cuts), u, side="right")
        hit = np.flatnonzero(n)
        if not len(hit):
            continue
        times = n[hit]
        which = np.repeat(hit, times)
        turn = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        dart = mix(seed[which] + (turn.astype(np.uint64) + np.uint64(1)) * K2)
        more = mix(dart + K1)
        if weights is not None:
            span = width / cuts
            pos = low + span * c + span * ((more & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)
            keep = pos < weights[at[which]]
            which, dart, more = which[keep], dart[keep], more[keep]
        base = start if strip[0] <= DOUBLINGS else strip[which].astype(np.float64) - DOUBLINGS
        r = base + height * ((dart >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        slot = sets[at[which]] * k + (((more >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(rank, slot, r)
        won = r == rank[slot]
        ids[slot[won]] = dart[won]
