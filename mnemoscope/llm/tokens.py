"""Token ids of whole texts by the tokenizers library, a distinct word at a time.

A byte-level BPE tokenizer first cuts a text into words by a fixed pattern, and a
word's ids don't depend on what stands around it. ``Encoder`` cuts whole batches
with array operations, by the same rules, and lets the library's model encode each
distinct word once. Which words are distinct is decided on their bytes. Texts that
hold an added token's string, and tokenizers of another kind, take the library's
own way from end to end.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pyarrow as pa

from .textvec import LETTER, MARK, OTHER, SPACE, byte_places, classes, code_points, range_hashes, remembered, same_bytes

#: Distinct words that an encoder remembers before it starts anew.
REMEMBERED = 1_000_000


@remembered
def byte_letters() -> dict[int, str]:
    """The letter by which byte-level models spell each byte: itself if it prints, else one from 256 on."""
    prints = [i for i in range(256) if chr(i).isprintable() and not chr(i).isspace()]
    others = [i for i in range(256) if i not in prints]
    return {i: chr(i) for i in prints} | {i: chr(256 + k) for k, i in enumerate(others)}


def word_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where words start in concatenated texts. first: where texts start.

    The rules of the byte-level pattern: an apostrophe with s, t, m, d, re, ve or ll;
    runs of letters, of numbers or of others, each with one space before it; and
    runs of white space, whose last character stands apart if a word follows.
    """
    n = len(points)
    kinds = classes()[points]
    kinds = np.where(kinds == MARK, OTHER, kinds)
    opens = np.zeros(n, bool)
    opens[first[first < n]] = True
    same = np.zeros(n, bool)
    same[1:] = (kinds[1:] == kinds[:-1]) & ~opens[1:]
    starts = ~same
    blank = kinds == SPACE
    # The last of a run of white space before a word of the same text.
    ends = np.zeros(n, bool)
    ends[:-1] = blank[:-1] & ~blank[1:] & ~opens[1:]
    starts |= ends
    joined = np.zeros(n, bool)
    joined[1:] = ends[:-1] & (points[:-1] == 32)
    starts &= ~joined
    for i in np.flatnonzero((points == 39) & starts & ~same):
        tail = "".join(chr(c) for c in points[i + 1 : i + 3])
        length = 2 if tail[:1] in tuple("stmd") else 3 if tail in ("re", "ve", "ll") else 0
        if length and not opens[i + 1 : i + length].any():
            starts[i + 1 : i + length] = False
            if i + length < n and not opens[i + length] and kinds[i + length] == LETTER:
                starts[i + length] = True
    return np.flatnonzero(starts)


def _added(flat: np.ndarray, bounds: np.ndarray, have: int, more: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Growing lists in one array, cut at bounds: ``more`` behind the first ``have`` of them."""
    end = int(bounds[have])
    if end + len(more) > len(flat):
        flat = np.concatenate([flat[:end], np.zeros(end + 2 * len(more), flat.dtype)])
    flat[end : end + len(more)] = more
    if have + len(sizes) + 1 > len(bounds):
        bounds = np.concatenate([bounds, np.zeros(len(bounds) + len(sizes), np.int64)])
    bounds[have + 1 : have + 1 + len(sizes)] = end + np.cumsum(sizes)
    return flat, bounds


class Encoder:
    """Ids of texts; one per Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        pre = kind.get("pre_tokenizer") or {}
        self.by_word = (
            kind["model"]["type"] == "BPE"
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not kind.get("normalizer")
        )
        self.added = [t["content"] for t in kind.get("added_tokens", [])]
        self.forget()

    def forget(self) -> None:
        """Remembered words: their bytes one after another, cut at ``cut``, and their ids, cut at ``bounds``."""
        self.known = 0
        self.spelt, self.cut = np.zeros(1 << 16, np.uint8), np.zeros(1 << 14, np.int64)
        self.flat, self.bounds = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        # Sorted hashes and the words that they propose; words whose hash another word has are in ``twins``.
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.twins: dict[bytes, int] = {}

    def _learn(self, hashes: np.ndarray, found: list[bytes]) -> None:
        model, letters = self.tokenizer.model, byte_letters()
        made = [[t.id for t in model.tokenize(w.decode("latin-1").translate(letters))] for w in found]
        have, self.known = self.known, self.known + len(found)
        ids = np.fromiter(chain.from_iterable(made), np.uint32, sum(map(len, made)))
        self.flat, self.bounds = _added(self.flat, self.bounds, have, ids, list(map(len, made)))
        self.spelt, self.cut = _added(self.spelt, self.cut, have, np.frombuffer(b"".join(found), np.uint8), list(map(len, found)))
        order = np.argsort(hashes)
        hashes = hashes[order]
        spot = np.searchsorted(self.hashes, hashes)
        first = np.append(True, hashes[1:] != hashes[:-1])
        if have:
            first &= self.hashes[np.minimum(spot, len(self.hashes) - 1)] != hashes
        self.twins.update((found[i], have + i) for i in order[~first].tolist())
        self.hashes = np.insert(self.hashes, spot[first], hashes[first])
        self.places = np.insert(self.places, spot[first], have + order[first])

    def _numbers(self, distinct: pa.BinaryArray) -> np.ndarray:
        """The number of each of some distinct words; new ones are learnt. Hashes propose, bytes decide."""
        cut, data = (distinct.buffers()[i] for i in (1, 2))
        cut = np.frombuffer(cut, np.int32)[distinct.offset : distinct.offset + len(distinct) + 1].astype(np.int64)
        hashes = range_hashes(data.to_pybytes(), cut[:-1], cut[1:])
        out = np.full(len(distinct), -1)
        if self.known:
            spot = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            at = np.flatnonzero(self.hashes[spot] == hashes)
            word, sizes = self.places[spot[at]], cut[at + 1] - cut[at]
            good = sizes == self.cut[word + 1] - self.cut[word]
            at, word, sizes = at[good], word[good], sizes[good]
            good = same_bytes(np.frombuffer(data, np.uint8), cut[at], self.spelt, self.cut[word], sizes)
            out[at[good]] = word[good]
        rest = np.flatnonzero(out < 0)
        found = distinct.take(pa.array(rest)).to_pylist()
        if self.twins:
            out[rest] = [self.twins.get(w, -1) for w in found]
            new = np.flatnonzero(out[rest] < 0)
            rest, found = rest[new], [found[i] for i in new.tolist()]
        if found:
            out[rest] = np.arange(self.known, self.known + len(found))
            self._learn(hashes[rest], found)
        return out

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return self._whole(texts)
        odd = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        rest = ["" if any(a in t for a in self.added) else t for t in texts] if odd else texts
        out = self._by_word(rest)
        for i, ids in zip(odd, self._whole([texts[i] for i in odd]), strict=True):
            out[i] = ids
        return out

    def _by_word(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        if not joined:
            return [np.zeros(0, np.uint32) for _ in texts]
        points = code_points(joined)
        starts = word_starts(points, first[:-1])
        place, data = byte_places(points), joined.encode("utf-8", "surrogatepass")
        edges = np.append(starts if place is None else place[starts], len(data)).astype(np.int32)
        listed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        if self.known + len(listed.dictionary) > REMEMBERED:
            self.forget()
        word = self._numbers(listed.dictionary)[listed.indices.to_numpy()]
        sizes = self.bounds[word + 1] - self.bounds[word]
        stops = np.cumsum(sizes)
        ids = self.flat[np.arange(stops[-1]) + np.repeat(self.bounds[word] - (stops - sizes), sizes)]
        upto = np.concatenate([[0], stops])[np.searchsorted(starts, first)]
        return [ids[a:b] for a, b in zip(upto[:-1], upto[1:], strict=True)]


@remembered
def encoder(path: str) -> Encoder:
    return Encoder(path)
