"""DartMinHash sketches of weighted sets.

Every element owns a plane of (weight, rank) into which hashed darts fall at unit
density, the same for all sets that hold the element. A set sees the darts below
its element's weight; each dart goes by hash to one coordinate, and a coordinate
keeps the dart of least rank. Two sets agree on a coordinate with a probability
equal to their weighted Jaccard similarity.

Darts of an element come in order of rank, in strips of weight [0, 1), [1, 2),
[2, 4), ... of which only those below the element's weight are looked at. Ranks
up to about k (ln k + 3) / (weight of the set) are thrown first; sets with an
empty coordinate throw on, to twice that, until none is empty. So a sketch costs
about the number of elements plus k ln k, not their product.
"""

from __future__ import annotations

import math

import numpy as np

from .textvec import mix

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Darts that are thrown at once when few strips are left.
THROWN = 1 << 14
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _unit(x: np.ndarray) -> np.ndarray:
    """Values in (0, 1) of 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _strips(elements: np.ndarray, weights: np.ndarray, of: np.ndarray):
    """Strips of weight below each element's: seed, lowest weight, width, weight, owner."""
    seeds, lows, widths, tops, owners = [mix(elements)], [np.zeros(len(elements))], [np.ones(len(elements))], [weights], [of]
    low = 1.0
    while len(more := np.flatnonzero(weights > low)):
        seeds.append(mix(elements[more] + np.uint64(int(GOLDEN) * (int(low) + 1) % (1 << 64))))
        lows.append(np.full(len(more), low))
        widths.append(np.full(len(more), low))
        tops.append(weights[more])
        owners.append(of[more])
        low *= 2
    return tuple(np.concatenate(x) for x in (seeds, lows, widths, tops, owners))


def sketches(elements: np.ndarray, weights: np.ndarray, of: np.ndarray, count: int, k: int) -> np.ndarray:
    """A (count, k) array of dart hashes; rows of empty sets are EMPTY.

    elements: 64-bit hashes, distinct within a set; weights: above 0; of: the set's number.
    """
    out = np.full((count, k), EMPTY, np.uint64)
    total = np.bincount(of, weights, minlength=count)
    reach = np.zeros(count)
    with np.errstate(divide="ignore"):
        goal = k * (math.log(k) + 3) / total
    open_ = np.flatnonzero(total > 0)
    least = np.full(count * k, np.inf)
    flat = out.reshape(-1)
    seed, low, width, top, owner = _strips(elements, weights.astype(np.float64), of)
    rank = np.zeros(len(seed))
    nth = np.zeros(len(seed), np.uint64)
    # The next dart of each strip, fixed before its rank is compared, so a strip can be thrown on.
    rank += -np.log(_unit(mix(seed + nth))) / width
    active = np.ones(count, bool)
    active[total <= 0] = False
    reach[:] = np.where(active, goal, 0)
    at = np.arange(len(seed))
    waiting: list[np.ndarray] = []
    while len(open_):
        at = at[active[owner[at]]]
        while len(at):
            # The fewer strips are left, the more darts of each are thrown at once.
            many = max(1, THROWN // len(at))
            count_of = nth[at, None] + np.arange(many + 1, dtype=np.uint64)
            steps = -np.log(_unit(mix(seed[at, None] + count_of[:, 1:]))) / width[at, None]
            ranks = np.cumsum(np.column_stack([rank[at], steps]), axis=1)
            within = ranks[:, :many] <= reach[owner[at], None]
            thrown = within.sum(axis=1)
            strip, column = np.nonzero(within)
            who = at[strip]
            dart = mix(seed[who] ^ mix(count_of[strip, column] + GOLDEN))
            hit = low[who] + width[who] * _unit(mix(dart + GOLDEN)) < top[who]
            place = owner[who[hit]] * k + (mix(dart[hit]) % np.uint64(k)).astype(np.int64)
            _keep(flat, least, place, ranks[strip[hit], column[hit]], dart[hit])
            nth[at] += thrown.astype(np.uint64)
            rank[at] = ranks[np.arange(len(at)), thrown]
            waiting.append(at[thrown < many])
            at = at[thrown == many]
        open_ = open_[np.isinf(least.reshape(count, k)[open_]).any(axis=1)]
        active[:] = False
        active[open_] = True
        reach[open_] *= 2
        at = np.concatenate(waiting) if waiting else at
        waiting = []
    return out


def _keep(flat: np.ndarray, least: np.ndarray, place: np.ndarray, rank: np.ndarray, dart: np.ndarray) -> None:
    """Keep the dart of least rank at each place."""
    np.minimum.at(least, place, rank)
    won = rank == least[place]
    flat[place[won]] = dart[won]
