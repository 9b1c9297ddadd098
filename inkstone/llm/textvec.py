"""Words of many texts at once as numpy arrays: where they start and a 64-bit hash of each.

A word's hash takes eight bytes at a time through a mixing that is not linear, so that no family of words collides by its structure; windows of words are hashed the same way from the words' hashes. Hashes only choose candidates: what is decided by words is confirmed on the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np

SEGMENT = 1 << 20
#: Bytes of a word at most that are hashed with all other words' at once; longer words are rare and hashed one by one.
LONG = 128
STEP, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 for white space, 1 for other bytes; or 2 for ASCII marks.
_WORD = (~_SPACE).astype(np.int8)
_MARKED = _WORD.copy()
_MARKED[[*range(0, 9), *range(14, 32), *range(33, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = 2
#: The low bytes of a number that belong to a word with so many bytes left.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the word (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * STEP + b
    return (x ^ (x >> np.uint64(29))) * SPREAD


def _segments(flat: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts at white space, so that memory does not grow with one very long text."""
    at = 0
    while at < len(flat):
        end = min(len(flat), at + SEGMENT)
        if end < len(flat):
            back = np.flatnonzero(_SPACE[flat[at:end]][::-1][:4096])
            if len(back):
                end -= int(back[0])
            else:
                while end < len(flat) and not _SPACE[flat[end : end + SEGMENT]].any():
                    end += SEGMENT
                if end < len(flat):
                    end += int(_SPACE[flat[end : end + SEGMENT]].argmax())
                end = min(end, len(flat))
        yield at, end
        at = end


def hashed(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words at these places."""
    size = ends - starts
    eights = np.ndarray((len(flat) + 1,), "<u8", buffer=np.concatenate((flat, np.zeros(8, np.uint8))), strides=(1,))
    out = mix((eights[starts] & _KEEP[np.minimum(size, 8)]) + size.astype(np.uint64) * SPREAD)
    more, done = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(more):
        out[more] = mix(out[more] * STEP + (eights[starts[more] + done] & _KEEP[np.minimum(size[more] - done, 8)]))
        done += 8
        more = more[size[more] > done]
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(blake2b(flat[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def words(flat: np.ndarray, lower: bool = False, marks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in UTF-8 bytes; ``lower`` folds A-Z in the hashes, ``marks`` makes runs of ASCII marks words of their own."""
    starts, ends, hashes = [], [], []
    for lo, hi in _segments(flat):
        part = flat[lo:hi]
        kind = np.zeros(len(part) + 2, np.int8)
        kind[1:-1] = (_MARKED if marks else _WORD)[part]
        edge = np.flatnonzero(kind[1:] != kind[:-1])
        s, e = edge[kind[edge + 1] > 0], edge[kind[edge] > 0]
        starts.append(s + lo)
        ends.append(e + lo)
        hashes.append(hashed(_LOWER[part] if lower else part, s, e))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` items, by doubling; windows that cross texts are the caller's to leave out."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    out, have = hashes, 1
    while have < width:
        step = min(have, width - have)
        out = joined(out[:-step], out[step:])
        have += step
    return mix(out + np.uint64(width))


@dataclass
class Chunk:
    """Consecutive texts of a batch; word arrays run over all of them, ``first`` has each text's first word (and the end)."""

    at: int
    texts: list[bytes]
    hashes: np.ndarray
    first: np.ndarray
    flat: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts)), np.diff(self.first))


def chunks(texts: list[bytes | None], lower: bool = False, marks: bool = False, limit: int = SEGMENT) -> Iterator[Chunk]:
    """Texts in runs of about ``limit`` bytes; null counts as empty."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or b"") <= limit):
            size += len(texts[end] or b"") + 1
            end += 1
        own = [t or b"" for t in texts[at:end]]
        flat = np.frombuffer(b"\n".join(own), np.uint8)
        starts, ends, hashes = words(flat, lower, marks)
        offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in own])))
        yield Chunk(at, own, hashes, np.searchsorted(starts, offsets), flat, starts, ends)
        at = end
