"""Hashed word shingles of whole texts, computed for many documents at once with numpy."""

from __future__ import annotations

import numpy as np

WORDS = 5
_CHUNK = 1 << 18
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SLOT = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, _CHUNK + 1024), base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start offset) of every word; words are cut at the six ASCII white-space bytes."""
    b = np.frombuffer(blob.translate(_LOWER), np.uint8)
    if not len(b):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    space = _SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    edge = np.concatenate(([0] * (not space[0]), edge, [len(b)] * (not space[-1]))).astype(np.int64)
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start
    total = np.empty(len(b) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[b] * _powers(_BASE, len(b)), out=total[1:])
    return mix((total[end] - total[start]) * _powers(_INVERSE, len(b))[start]), start


def _of_chunk(blobs: list[bytes]) -> list[np.ndarray]:
    h, at = word_hashes(b"\n".join(blobs))
    ends = np.cumsum([len(b) + 1 for b in blobs])
    cut = np.searchsorted(at, ends)
    full = len(h) - WORDS + 1
    rolled = np.zeros(max(full, 0), np.uint64)
    for j in range(WORDS):
        if full > 0:
            rolled += h[j : j + full] * _SLOT[j]
    rolled = mix(rolled)
    out, lo = [], 0
    for hi in cut.tolist():
        if hi - lo >= WORDS:
            out.append(np.unique(rolled[lo : hi - WORDS + 1]))
        elif hi > lo:
            few = (h[lo:hi] * _SLOT[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
            out.append(mix(np.array([few], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        lo = hi
    return out


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's 5-word shingles.

    A-Z are lowered. Fewer than five words: the whole sequence is the one shingle. Null or
    wordless texts: the empty set.
    """
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0
    for t in texts:
        blob = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(blob) > _CHUNK:
            out += _of_chunk(held)
            held, size = [], 0
        held.append(blob)
        size += len(blob) + 1
    return out + (_of_chunk(held) if held else [])
