"""Words `[^\\x20\\x09-\\x0D]+` of many texts at once, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Fixed seed of the hash tables; they are built from it by rule.
SEED = 20240229
_rng = np.random.default_rng(SEED)
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_CODES = BYTE_CODES.copy()
LOWER_CODES[65:91] = BYTE_CODES[97:123]
BASE = np.uint64(int(_rng.integers(2**62, 2**63)) * 2 + 1)
#: Bytes of a word that are hashed at once.
LONG_WORD = 1 << 16
#: Bytes of a word that `names` takes by eights, and masks for the first k of eight bytes.
LONG_NAME = 256
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which near numbers part."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: each word's first byte, the byte after it, and the words before each text (one more than texts)."""
    solid = np.zeros(len(data) + 1, bool)
    solid[:-1] = ~IS_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = offsets[:-1][np.diff(offsets) > 0]
    first[begins] = solid[begins]
    last = solid[:-1] & (~solid[1:] | first[1:])
    starts = np.flatnonzero(first[:-1])
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word; with lower, A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths, table = ends - starts, LOWER_CODES if lower else BYTE_CODES
    most = int(lengths.max())
    if most > LONG_WORD:  # by blocks, so that memory doesn't grow with a word
        out, short = np.zeros(len(starts), np.uint64), lengths <= LONG_WORD
        out[short] = hashes(data, starts[short], ends[short], lower)
        step, power = powers(LONG_WORD + 1), np.ones(1, np.uint64)
        for i in np.flatnonzero(~short):
            total, power = np.zeros(1, np.uint64), np.ones(1, np.uint64)
            for at in range(int(starts[i]), int(ends[i]), LONG_WORD):
                codes = table[data[at : min(at + LONG_WORD, int(ends[i]))]]
                total += (codes * step[: len(codes)]).sum(dtype=np.uint64) * power
                power = power * step[LONG_WORD]
            out[i] = mix(total + np.uint64(lengths[i]))[0]
        return out
    begin = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(begin, lengths)
    codes = table[data[place + np.repeat(starts, lengths)]]
    return mix(np.add.reduceat(codes * powers(most)[place], begin) + lengths.astype(np.uint64))


def names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, eight bytes at a time: other values than those of `hashes`, in a fraction of the time."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64) * BASE)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, np.uint64, padded, 0, (1,))  # the eight bytes from each place on
    live = slice(None)
    for at in range(0, min(int(lengths.max()), LONG_NAME), 8):
        if at:
            live = np.flatnonzero(lengths > at)
        out[live] = mix(out[live] * BASE + (eight[starts[live] + at] & MASKS[np.minimum(lengths[live] - at, 8)]))
    long = np.flatnonzero(lengths > LONG_NAME)
    if len(long):
        out[long] = mix(out[long] + hashes(data, starts[long], ends[long]))
    return out


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; the last k - 1 places are of no use."""
    out = np.zeros(len(words), np.uint64)
    for j in range(min(k, len(words))):
        out[: len(words) - j] = out[: len(words) - j] * BASE + words[j:]
    return mix(out)


def pieces(data: np.ndarray, limit: int, overlap: int = 0) -> Iterator[tuple[np.ndarray, int]]:
    """A long text in pieces of about limit bytes that end between words, and the number of words before each.

    Neighbours share overlap words, so that each run of overlap + 1 words lies in exactly one piece; the last piece may hold shared ones only.
    """
    at, first = 0, 0
    while True:
        end = at + limit
        while True:
            if end >= len(data):
                yield data[at:], first
                return
            gap = np.flatnonzero(IS_SPACE[data[end : end + (1 << 16)]])
            if not len(gap):
                end += 1 << 16
                continue
            end += int(gap[0])
            starts = split(data[at:end], np.array([0, end - at]))[0]
            if len(starts) > overlap:
                break
            end += limit
        yield data[at:end], first
        first += len(starts) - overlap
        at = end if not overlap else at + int(starts[-overlap])
