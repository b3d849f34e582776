"""128-bit digests of the words of many texts at once, in two lanes of 64 bits, and of runs of words, in numpy.

A lane takes a word's length and then its bytes eight at a time, each step mixed, so that no regular pattern of letters
cancels out; long words go by BLAKE2b. A run's lanes are put together by doubling: each step adds two neighbours under odd
factors of its own lane and mixes the sum.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

#: Bytes 9 to 13 and 32 part words.
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
GROUP = 1 << 18  # bytes of texts hashed at once
LONG_WORD = 64  # bytes
_FACTORS = ((0x9E3779B97F4A7C15, 0xD1342543DE82EF95), (0xC2B2AE3D27D4EB4F, 0xF1357AEA2E62A9C5))
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the words of the texts one after the other (two rows, the lanes), and the number of words of each text."""
    data = b" ".join(texts) + b" " * 8
    raw = np.frombuffer(data, np.uint8)
    white = np.ones(len(raw) + 1, bool)
    white[1:] = _WHITE[raw]
    edge = np.flatnonzero(white[1:] != white[:-1])
    starts, ends = edge[::2], edge[1::2]
    counts = np.diff(np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])), prepend=0)
    size = ends - starts
    eight = np.ndarray((len(raw) - 7,), "<u8", data, strides=(1,))
    lanes = np.stack([mix(size.astype(np.uint64) + np.uint64(seed)) for seed in (1 << 32, 1 << 33)])
    on = np.flatnonzero(size <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        on = on[size[on] > at]
        chunk = eight[starts[on] + at] & _FIRST_BYTES[np.minimum(size[on] - at, 8)]
        for lane in (0, 1):
            lanes[lane, on] = pair(lanes[lane, on], chunk, lane)
    for i in np.flatnonzero(size > LONG_WORD):
        lanes[:, i] = np.frombuffer(blake2b(data[starts[i] : ends[i]], digest_size=16).digest(), np.uint64)
    return lanes, counts


def pair(a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
    """One value for two in order."""
    x, y = _FACTORS[lane]
    return mix(a * np.uint64(x) + b * np.uint64(y))


def runs(lane: np.ndarray, length: int, number: int = 0) -> np.ndarray:
    """For one lane (of that number) a value for every ``length`` consecutive words; those that cross texts are the caller's
    to leave out."""
    if len(lane) < length:
        return np.zeros(0, np.uint64)
    out, done = lane, 1
    while 2 * done <= length:
        out, done = pair(out[:-done], out[done:], number), 2 * done
    more = length - done  # two runs that overlap say as much as one
    return pair(out[: len(out) - more], out[more:], number) if more else out


def whole(lane: np.ndarray, starts: np.ndarray, counts: np.ndarray, number: int = 0) -> np.ndarray:
    """For one lane a value for each short text as a whole; it differs from all values of ``runs``."""
    out = mix(counts.astype(np.uint64))
    for j in range(int(counts.max(initial=0))):
        here = counts > j
        out[here] = pair(out[here], lane[starts[here] + j], number)
    return out


def groups(texts: list[bytes], most: int = GROUP):
    """Slices of texts of some size together."""
    a = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield slice(a, i)
            a, total = i, 0
        total += len(t) + 1
    if texts:
        yield slice(a, len(texts))
