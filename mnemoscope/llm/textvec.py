"""Texts as arrays: code points, words and rolling hashes for whole batches at once.

All functions take lists of texts and work on their concatenation, a bounded
piece at a time, so the cost of one very long text is its length.
"""

from __future__ import annotations

import hashlib
import sys
import types
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points of texts that are worked on at once; one longer text is a piece of its own.
PIECE = 1 << 19
#: An odd multiplier, for hashes of a few words in sequence.
BASE = 0x9E3779B97F4A7C15
#: Bytes from which on a word is hashed by itself, not eight bytes at a time beside others.
LONG = 256

LETTER, NUMBER, SPACE, MARK, OTHER = 1, 2, 3, 4, 0
#: The code points of the Unicode property White_Space.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def remembered(make: Callable) -> Callable:
    """``make`` with results kept as long as the Python worker lives, over all tasks.

    Functions reach workers by value, so a cache beside them would be new in each task.
    """

    def run(*args):
        held = sys.modules.setdefault("_mnemoscope_held", types.ModuleType("_mnemoscope_held")).__dict__
        key = f"{make.__qualname__}{args!r}"
        if key not in held:
            held[key] = make(*args)
        return held[key]

    return run


@remembered
def classes() -> np.ndarray:
    """The class of each code point."""
    kind = {"L": LETTER, "N": NUMBER, "M": MARK}
    table = np.fromiter((kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pieces(texts: list[str], size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` code points together."""
    return ranges(map(len, texts), size)


def column_pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of pieces of a column; only one piece at a time becomes Python strings, nulls empty."""
    for a, b in ranges(pc.fill_null(pc.utf8_length(column), 0).to_pylist(), size):
        yield a, [t or "" for t in column.slice(a, b - a).to_pylist()]


def ranges(lengths: Iterable[int], size: int) -> Iterator[tuple[int, int]]:
    start = held = end = 0
    for i, length in enumerate(lengths):
        held, end = held + length + 1, i + 1
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < end:
        yield start, end


def byte_places(points: np.ndarray) -> np.ndarray | None:
    """Where each code point, and the end, stands in UTF-8; None if every place is the code point's own."""
    wide = np.flatnonzero(points >= 0x80)
    if not len(wide):
        return None
    sizes = np.ones(len(points) + 1, np.int64)
    sizes[0] = 0
    sizes[wide + 1] += 1 + (points[wide] >= 0x800).astype(np.int64) + (points[wide] >= 0x10000)
    return np.cumsum(sizes)


def range_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end].

    Eight bytes at a time go through a scrambling that isn't linear, so words of a
    special form don't collide more than others. Hashes propose; where two words
    must be the same, their bytes are compared.
    """
    size = ends - starts
    lanes = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))
    masks = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
    out = mix(size.astype(np.uint64) + np.uint64(BASE))
    at, done = np.flatnonzero((size > 0) & (size < LONG)), 0
    while len(at):
        left = size[at] - done
        out[at] = mix(out[at] ^ (lanes[starts[at] + done] & masks[np.minimum(left, 8)]))
        at, done = at[left > 8], done + 8
    for i in np.flatnonzero(size >= LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def same_bytes(one: np.ndarray, first: np.ndarray, other: np.ndarray, second: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether one[first:first + size] equals other[second:second + size], for each of many ranges."""
    stops = np.cumsum(sizes)
    every = np.arange(stops[-1] if len(stops) else 0)
    before = stops - sizes
    differ = np.flatnonzero(one[every + np.repeat(first - before, sizes)] != other[every + np.repeat(second - before, sizes)])
    out = np.ones(len(sizes), bool)
    out[np.searchsorted(stops, differ, side="right")] = False
    return out


@dataclass
class Words:
    """Words of lower-cased texts, runs of letters, numbers and marks: their bytes in all, and for each word where
    it starts and ends in them, its text's number, its letters and its first letter's place among all."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray
    letters: np.ndarray
    first: np.ndarray
    place: np.ndarray | None

    def after(self, which: np.ndarray, n: int) -> np.ndarray:
        """Where the first n letters of some words end."""
        return self.starts[which] + n if self.place is None else self.place[self.first[which] + n]

    def hashes(self) -> np.ndarray:
        return range_hashes(self.data, self.starts, self.ends)


def found_words(texts: list[str]) -> Words:
    lowered = [t.lower() for t in texts]
    joined = "\n".join([*lowered, ""])
    points = code_points(joined)
    kinds = classes()[points]
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = (kinds == LETTER) | (kinds == NUMBER) | (kinds == MARK)
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    sizes = np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered))
    of = np.searchsorted(np.concatenate([[0], np.cumsum(sizes)]), starts, side="right") - 1
    place = byte_places(points)
    at, to = (starts, ends) if place is None else (place[starts], place[ends])
    return Words(joined.encode("utf-8", "surrogatepass"), at, to, of, ends - starts, starts, place)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word."""
    found = found_words(texts)
    return found.hashes(), found.of


def shingles(hashes: np.ndarray, of: np.ndarray, n: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n words in sequence, and the text number of each.

    A text of fewer than n words, but some, has one shingle of all its words.
    """
    up = np.array([pow(BASE, i, 1 << 64) for i in range(n + 1)], np.uint64)
    window = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for i in range(n):
        window += hashes[i : i + len(window)] * up[n - i]
    whole = of[: len(window)] == of[n - 1 : n - 1 + len(window)] if len(window) else np.zeros(0, bool)
    out, owner = mix(window[whole]), of[: len(window)][whole]
    sizes = np.bincount(of, minlength=count)
    few = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(few):
        short = np.flatnonzero(np.isin(of, few))
        lasts = np.cumsum(sizes)
        place = short - (lasts - sizes)[of[short]]
        sums = np.zeros(count, np.uint64)
        np.add.at(sums, of[short], hashes[short] * up[1 + place])
        out = np.concatenate([out, mix(sums[few] + sizes[few].astype(np.uint64))])
        owner = np.concatenate([owner, few])
    return out, owner
