"""Word shingles of whole texts as 64-bit hashes, in numpy over Arrow buffers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.default_rng(20_240_229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
for _b in range(65, 91):
    _BYTE[_b] = _BYTE[_b + 32]
_BASE = int(_rng.integers(1, 2**62)) * 4 + 3
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_SOLID = np.ones(256, bool)
_SOLID[[32, 9, 10, 11, 12, 13]] = False
#: Bytes hashed at once, and the length from which a word is hashed by blake2b instead.
STRETCH, LONG_WORD = 1 << 20, 256


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_BASE, STRETCH + LONG_WORD), _powers(pow(_BASE, -1, 2**64), STRETCH + LONG_WORD)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each word raw[start:end]; A-Z hash as a-z."""
    out = np.zeros(len(starts), np.uint64)
    size = ends - starts
    for i in np.flatnonzero(size > LONG_WORD):
        word = raw[starts[i] : ends[i]].tobytes()
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in word)
        out[i] = int.from_bytes(hashlib.blake2b(low, digest_size=8).digest(), "little")
    short = np.flatnonzero(size <= LONG_WORD)
    at = 0
    while at < len(short):
        base = starts[short[at]]
        stop = np.searchsorted(starts[short], base + STRETCH, "left")
        some = short[at:stop]
        part = raw[base : ends[some[-1]]]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * _UP[: len(part)])))
        a, b = starts[some] - base, ends[some] - base
        out[some] = mix((sums[b] - sums[a]) * _DOWN[a] + (b - a).astype(np.uint64))
        at = stop
    return out


def shingles(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, end to end, and each text's offsets.

    Words are runs of what is no ASCII white space, A-Z lower-cased. A text of fewer
    than ``size`` words has its whole sequence as its only shingle, and none without words.
    """
    n = len(texts)
    binary = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + n + 1] if n else np.zeros(1, np.int64)
    data = binary.buffers()[2] if n else None
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    solid = _SOLID[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[bounds] = True
    before, after = np.concatenate(([False], solid[:-1])), np.concatenate((solid[1:], [False]))
    starts = np.flatnonzero(solid & (~before[: len(raw)] | first[:-1]))
    ends = np.flatnonzero(solid & (~after[: len(raw)] | first[1:])) + 1
    h = word_hashes(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    at = np.searchsorted(starts, bounds)
    sets, offsets = [], np.zeros(n + 1, np.int64)
    if len(h) >= size:
        rolled = np.zeros(len(h) - size + 1, np.uint64)
        for j in range(size):
            rolled += h[j : j + len(rolled)] * _PLACE[j]
        rolled = mix(rolled)
    for i in range(n):
        a, b = at[i], at[i + 1]
        if b - a >= size:
            own = np.unique(rolled[a : b - size + 1])
        elif b > a:
            own = mix(np.array([(h[a:b] * _PLACE[: b - a]).sum()], np.uint64) + _PLACE[32 + b - a])
        else:
            own = np.zeros(0, np.uint64)
        sets.append(own)
        offsets[i + 1] = offsets[i] + len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), offsets
