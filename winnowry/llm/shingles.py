"""Distinct word shingles of many texts at once, as 64-bit hashes (NumPy; used inside tasks)."""

import numpy as np

WORDS = 5
CHUNK_BYTES = 1 << 18
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    held = _powers.get(int(base))
    if held is None or len(held) < n:
        steps = np.full(max(n, CHUNK_BYTES), base, np.uint64)
        steps[0] = 1
        held = _powers[int(base)] = np.cumprod(steps)
    return held[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words of each text."""
    buf = np.frombuffer((b" ".join(texts) + b" ").translate(_LOWER), np.uint8)
    space = _SPACE[buf]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _power(_BASE, len(buf)), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(buf))[starts])
    bounds = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    return hashes, counts


def _chunks(texts):
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= CHUNK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def distinct_shingles(texts):
    """For each text (UTF-8 bytes) its distinct shingles, sorted. Fewer than WORDS words are one shingle."""
    for part in _chunks(texts):
        h, counts = word_hashes(part)
        n = max(0, len(h) - WORDS + 1)
        joined = h[:n].copy()
        for k in range(1, WORDS):
            joined = mix(joined) + h[k : n + k]
        joined = mix(joined)
        at = 0
        for c in counts.tolist():
            if c >= WORDS:
                yield np.unique(joined[at : at + c - WORDS + 1])
            elif c:
                one = h[at : at + 1].copy()
                for k in range(1, c):
                    one = mix(one) + h[at + k : at + k + 1]
                yield mix(one ^ np.uint64(c))
            else:
                yield h[:0]
            at += c
