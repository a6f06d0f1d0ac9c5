"""Word shingles as 64-bit hashes, for the operators that compare texts.

A text is lower-cased (A-Z only) and cut into words ``[^\\x20\\x09-\\x0D]+``
on its UTF-8 bytes. A word's hash is a polynomial in random byte values; a
shingle is five consecutive words, hashed from the words' hashes. Texts with
fewer words are one shingle as a whole, texts without words have none.

Everything is vectorised over a block of texts of bounded size, so memory
follows the block (or one text, if that is larger), never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
#: Bytes of text that are hashed at once.
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def _byte_values() -> np.ndarray:
    t = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)
    t[65:91] = t[97:123]  # A-Z count as a-z
    t[_SPACE] = 0  # white space after a word adds nothing to its sum
    return t


_BYTE = _byte_values()
_POWER = np.cumprod(np.full(BLOCK_BYTES, _MUL))
_INVERSE = np.cumprod(np.full(BLOCK_BYTES, np.uint64(pow(int(_MUL), -1, 2**64))))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (spreads every input bit)."""
    h = (h ^ (h >> _S33)) * _MIX1
    h = (h ^ (h >> _S33)) * _MIX2
    return h ^ (h >> _S33)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the multiplier and of its inverse."""
    if n <= BLOCK_BYTES:
        return _POWER[:n], _INVERSE[:n]
    inverse = np.uint64(pow(int(_MUL), -1, 2**64))
    return np.cumprod(np.full(n, _MUL)), np.cumprod(np.full(n, inverse))


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of at most ``BLOCK_BYTES`` bytes."""
    b = np.frombuffer(data, np.uint8)
    space = _SPACE[b]
    begins, ends = ~space, space.copy()
    begins[1:] &= space[:-1]
    ends[1:] &= ~space[:-1]
    ends[:1] = False
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends)
    if not len(starts):
        return starts, starts, np.empty(0, np.uint64)
    if len(stops) < len(starts):
        stops = np.r_[stops, len(b)]
    values = _BYTE[b] * _POWER[: len(b)]
    return starts, stops, mix(np.add.reduceat(values, starts) * _INVERSE[starts])


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of one text of any length.

    A long text is taken piece by piece, cut at white space; of a word longer
    than a block the blocks' hashes are chained.
    """
    if len(data) <= BLOCK_BYTES:
        return _words(data)
    out, at = [], 0
    while at < len(data):
        end = min(at + BLOCK_BYTES, len(data))
        if end < len(data) and not _SPACE[data[end]]:
            gaps = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8, end - at, at)])
            end = at + int(gaps[-1]) + 1 if len(gaps) else at
        if end > at:
            starts, stops, hashes = _words(data[at:end])
            out.append((starts + at, stops + at, hashes))
        else:
            h, end, inside = np.zeros(1, np.uint64), at, True
            while inside and end < len(data):
                piece = np.frombuffer(data, np.uint8, min(BLOCK_BYTES, len(data) - end), end)
                gaps = np.flatnonzero(_SPACE[piece])
                stop = end + (int(gaps[0]) if len(gaps) else len(piece))
                if stop > end:
                    h = mix(h * _MUL + _words(data[end:stop])[2])
                inside, end = not len(gaps), stop
            out.append((np.array([at]), np.array([end]), h))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def located(texts: list[bytes | None]) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, bytes, begins, starts, stops, word hashes, offsets) for runs of texts of at most a block each.

    The texts are joined by line ends; text ``first + i`` begins at the byte
    ``begins[i]`` and has the words ``offsets[i]:offsets[i + 1]``.
    """
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (size + len(texts[last] or b"") + 1 <= BLOCK_BYTES or last == first):
            size += len(texts[last] or b"") + 1
            last += 1
        if size > BLOCK_BYTES:
            found = words(texts[first])
            yield first, last, texts[first], np.zeros(1, np.int64), *found, np.array([0, len(found[0])])
        else:
            lengths = np.fromiter((len(t or b"") + 1 for t in texts[first:last]), np.int64, last - first)
            data, begins = b"\n".join(t or b"" for t in texts[first:last]), np.r_[0, np.cumsum(lengths)]
            found = _words(data)
            yield first, last, data, begins[:-1], *found, np.searchsorted(found[0], begins)
        first = last


def blocks(texts: list[bytes | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, word hashes, offsets) of ``located``."""
    for first, last, *_, hashes, offsets in located(texts):
        yield first, last, hashes, offsets


def runs(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """One hash for each run of ``width`` consecutive words, repeats kept."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h *= _MUL
        h += words[i : i + n]
    return mix(h)


def shingles(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a block's texts, repeats kept, and each text's offsets."""
    n = np.diff(offsets)
    counts = np.where(n >= WIDTH, n - WIDTH + 1, np.minimum(n, 1))
    out_offsets = np.r_[0, np.cumsum(counts)]
    out = np.empty(int(out_offsets[-1]), np.uint64)
    every = runs(words)
    position = np.arange(len(every))
    text = np.searchsorted(offsets, position, side="right") - 1
    out[np.repeat(n >= WIDTH, counts)] = every[position + WIDTH <= offsets[text + 1]]
    for i in np.flatnonzero((n > 0) & (n < WIDTH)):
        out[out_offsets[i]] = runs(words[offsets[i] : offsets[i + 1]], int(n[i]))[0]
    return out, out_offsets


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (faster than ``np.unique`` on short arrays)."""
    s = np.sort(values)
    if len(s) > 1:
        s = s[np.r_[True, s[1:] != s[:-1]]]
    return s


def families(count: int, seed: int) -> np.ndarray:
    """``count`` odd multipliers, one for each minhash function."""
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, size=count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(hashes: np.ndarray, offsets: np.ndarray, family: np.ndarray) -> np.ndarray:
    """Minhashes of the non-empty sets ``hashes[offsets[i]:offsets[i + 1]]``.

    Shape (sets, functions). Function i orders the (already mixed) hashes by
    their product with an odd number; empty sets must be left out before.
    """
    starts = offsets[:-1]
    out = np.empty((len(starts), len(family)), np.uint64)
    for i, a in enumerate(family):
        h = hashes * a
        h ^= h >> np.uint64(29)
        h *= _MIX1
        out[:, i] = np.minimum.reduceat(h, starts)
    return out
