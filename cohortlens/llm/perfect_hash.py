"""Minimal perfect hash of 64-bit keys by hash and displace, with stored fingerprints.

n keys go to n slots.  A key's bucket names a displacement; with it the key hashes
to its slot.  A bucket of one key stores its slot itself (as -1 - slot).  A 32-bit
fingerprint in the slot turns away keys that were never stored (an unknown key
passes with probability 2 ** -32).
"""

from __future__ import annotations

import numpy as np

KEYS_PER_BUCKET = 4
_TRIES = 64


def mix(keys: np.ndarray, seed) -> np.ndarray:
    """64-bit finaliser (public splitmix constants), vectorised; wraps on purpose."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(seed, np.uint64)
                                                                     + np.uint64(1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys, 0) % np.uint64(buckets)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1) >> np.uint64(32)).astype(np.uint32)


def build(keys: np.ndarray) -> np.ndarray:
    """Displacement per bucket for distinct int64 ``keys``."""
    keys = keys.astype(np.int64).view(np.uint64)
    n = len(keys)
    buckets = max(1, -(-n // KEYS_PER_BUCKET))
    of = _bucket(keys, buckets)
    order = np.argsort(of, kind="stable")
    sizes = np.bincount(of, minlength=buckets)
    begins = np.cumsum(sizes) - sizes
    taken = np.zeros(n, bool)
    displace = np.zeros(buckets, np.int64)
    free: list[int] | None = None
    for b in np.argsort(-sizes, kind="stable"):
        size = int(sizes[b])
        if size == 0:
            break
        if size == 1:
            if free is None:
                free = np.flatnonzero(~taken).tolist()
            displace[b] = -1 - free.pop()
            continue
        mine = keys[order[begins[b]:begins[b] + size]]
        at = 0
        while True:
            d = np.arange(at, at + _TRIES)
            slots = np.sort((mix(mine[None, :], d[:, None] + 2) % np.uint64(n)).astype(np.int64),
                            axis=1)
            fits = ~taken[slots].any(axis=1) & (np.diff(slots, axis=1) > 0).all(axis=1)
            if fits.any():
                k = int(np.argmax(fits))
                taken[slots[k]] = True
                displace[b] = at + k
                break
            at += _TRIES
    return displace


def slots(keys: np.ndarray, displace: np.ndarray, n: int) -> np.ndarray:
    """Slot of each key; keys that were never stored get some slot as well."""
    keys = keys.astype(np.int64).view(np.uint64)
    d = displace[_bucket(keys, len(displace))]
    hashed = (mix(keys, np.maximum(d, 0) + 2) % np.uint64(n)).astype(np.int64)
    return np.where(d < 0, -1 - d, hashed)
