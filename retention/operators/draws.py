"""Many seeded permutations at once: what ``np.random.default_rng([seed, tree, path]).permutation(n)[:m]`` gives for each pair.

A generator of its own takes some 20 microseconds, and a deep tree draws for thousands of nodes. Here the generator's seeding
(numpy's SeedSequence), its steps (PCG64, 128 bits as two words) and its shuffle run over arrays. Where the shuffle
rejects very many numbers, the tree or the path is of more than 32 bits, or this version of numpy draws otherwise, the generator
itself is asked.
"""

from __future__ import annotations

import functools

import numpy as np

MASK = np.uint64(0xFFFFFFFF)
HALF = np.uint64(32)
MULT_HIGH, MULT_LOW = np.uint64(0x2360ED051FC65DA4), np.uint64(0x4385DF649FCCF645)
#: pairs at a time: what they look at stays in the processor's cache
AT_ONCE = 4096


def one(seed: int, tree: int, path: int, n: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, path]).permutation(n)


def _seeded(seed: int, tree: np.ndarray, path: np.ndarray) -> list[np.ndarray]:
    """SeedSequence([seed, tree, path]).generate_state(4, uint64)."""
    const = [0x43B0D7E5]

    def hashed(v: np.ndarray, mult: int = 0x931E8875) -> np.ndarray:
        v = v ^ np.uint32(const[0])
        const[0] = const[0] * mult & 0xFFFFFFFF
        v = v * np.uint32(const[0])
        return v ^ (v >> np.uint32(16))

    zero = np.zeros(len(tree), dtype=np.uint32)
    pool = [hashed(v) for v in (zero + np.uint32(seed), tree.astype(np.uint32), path.astype(np.uint32), zero)]
    for src in range(4):
        for to in range(4):
            if src != to:
                v = np.uint32(0xCA01F9DD) * pool[to] - np.uint32(0x4973F715) * hashed(pool[src])
                pool[to] = v ^ (v >> np.uint32(16))
    const[0] = 0x8B51F9DD
    words = [hashed(pool[i % 4], 0x58F38DED).astype(np.uint64) for i in range(8)]
    return [words[2 * i] | words[2 * i + 1] << HALF for i in range(4)]


def _step(high: np.ndarray, low: np.ndarray, inc_high: np.ndarray, inc_low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """state * multiplier + increment, modulo 2^128."""
    a, b = low >> HALF, low & MASK
    c, d = MULT_LOW >> HALF, MULT_LOW & MASK
    cross, other = a * d, b * c
    middle = (b * d >> HALF) + (cross & MASK) + (other & MASK)
    carried = a * c + (cross >> HALF) + (other >> HALF) + (middle >> HALF)
    high = high * MULT_LOW + low * MULT_HIGH + carried
    low = low * MULT_LOW + inc_low
    return high + inc_high + (low < inc_low), low


def _some(seed: int, tree: np.ndarray, path: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(the draws, where they are not sure)."""
    start_high, start_low, seq_high, seq_low = _seeded(seed, tree, path)
    inc_high, inc_low = seq_high << np.uint64(1) | seq_low >> np.uint64(63), seq_low << np.uint64(1) | np.uint64(1)
    low = inc_low + start_low
    high = inc_high + start_high + (low < inc_low)
    high, low = _step(high, low, inc_high, inc_low)
    # the shuffle swaps place i = n - 1, ..., 1 with one up to i: the next 32 bits, masked, until they are at most i
    size, turn = len(tree), np.full(len(tree), n - 1, dtype=np.int32)
    masks = np.array([(1 << i.bit_length()) - 1 for i in range(n)], dtype=np.uint32)
    swaps, rows = np.zeros(n * size, dtype=np.int16), np.arange(size, dtype=np.int32)
    for _ in range(n):
        high, low = _step(high, low, inc_high, inc_low)
        by, mixed = high >> np.uint64(58), high ^ low
        word = mixed >> by | mixed << (-by & np.uint64(63))
        for half in (word & MASK, word >> HALF):
            v = (half.astype(np.uint32) & masks[turn]).astype(np.int32)
            swaps[turn * size + rows] = v  # a rejected one is written over
            turn = np.maximum(turn - (v <= turn), 0)
    unsure, swaps = turn > 0, swaps.reshape(n, size)
    # which element ends at each of the first places: the swaps backwards
    at = np.broadcast_to(np.arange(m, dtype=np.int16)[:, None], (m, len(tree))).copy()
    for i in range(1, n):
        at = np.where(at == i, swaps[i], np.where(at == swaps[i], np.int16(i), at))
    return at.T, unsure


@functools.lru_cache(maxsize=8)
def _as_numpy(n: int) -> bool:
    """Whether this version of numpy draws as the arrays do."""
    tree, path = np.array([0, 3, 70000]), np.array([1, 12345, (1 << 29) + 7])
    found, unsure = _some(42, tree, path, n, n)
    return all(u or f.tolist() == one(42, int(t), int(p), n).tolist() for f, u, t, p in zip(found, unsure, tree, path))


def permutations(seed: int, tree: np.ndarray, path: np.ndarray, n: int, m: int) -> np.ndarray:
    """Pairs x m: the first ``m`` of each pair's permutation of ``n``."""
    tree, path = np.asarray(tree, dtype=np.int64), np.asarray(path, dtype=np.int64)
    out = np.empty((len(tree), m), dtype=np.int64)
    sure = 0 <= seed < 1 << 32 and 1 < n < 1 << 15 and _as_numpy(n)
    for low in range(0, len(tree), AT_ONCE):
        at = slice(low, low + AT_ONCE)
        t, p = tree[at], path[at]
        unsure = np.ones(len(t), dtype=bool)
        if sure:
            out[at], unsure = _some(seed, t, p, n, m)
            unsure |= (t >= 1 << 32) | (p >= 1 << 32)
        for i in np.flatnonzero(unsure):
            out[low + i] = one(seed, int(t[i]), int(p[i]), n)[:m]
    return out
