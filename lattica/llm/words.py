"""Words of whole texts as numbers: what the rule, shingle and likelihood operators share.

A word is a run of anything but ASCII white space, which is just what ``bytes.split()`` gives on UTF-8.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .common import mix64, remembers

_HASHES: dict[bytes, int] = {}
#: Word hashes that a worker remembers, and the longest of their words: some 30 MB at most.
REMEMBERED, LONGEST = 150_000, 64

remembers("words", _HASHES.clear)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    got = list(map(_HASHES.get, words))
    if None in got:
        missing = {w for w, h in zip(words, got, strict=True) if h is None}
        found = dict(zip(missing, map(xxhash.xxh64_intdigest, missing), strict=True))
        if len(_HASHES) < REMEMBERED:
            _HASHES.update(found if max(map(len, missing)) <= LONGEST else {w: h for w, h in found.items() if len(w) <= LONGEST})
        got = [found[w] if h is None else h for w, h in zip(words, got, strict=True)]
    return np.fromiter(got, np.uint64, len(got))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each ``n`` neighbouring words; empty with fewer than ``n``."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:count].copy()
    for k in range(1, n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + count])
    return out if n > 1 else mix64(out)
