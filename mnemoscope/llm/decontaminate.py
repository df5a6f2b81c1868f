"""Benchmark decontamination by greedy string tiling over words.

A text and a benchmark item that share a run of ``TILE`` words (a seed, found by
Karp-Rabin hashes of running windows) are tiled: the longest common run of words
that are free on both sides is marked, again and again, until none of TILE words
is left (of runs of one length the first in the text, then in the item). The
coverage is the share of the item's words under tiles, so an item counts in
whatever order its passages stand. An item of fewer than TILE words is one seed,
and its tile, of all its words. Hashes propose; a tile is marked only where the
words' bytes are equal. Texts are read once and never move.

A text's seeds meet those of items once for each distinct seed, so a passage that
stands very often in a text, or in all items, costs no product of occurrences until
an item can reach the least coverage.

The benchmark reaches executors in blocks of about ``BLOCK_BYTES`` of text, each a
bounded broadcast; a larger benchmark takes more passes over the corpus.

Defined results: null and empty texts have no tiles; an item without words is
never found; repeated rows and items are each compared; an empty table
or benchmark gives an empty result; other columns of the input stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8_size
from .textvec import BASE, column_pieces, found_words, mix, same_bytes

TILE, COVERAGE = 5, 0.5
BLOCK_BYTES = 16 << 20


def windows(hashes: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n words in sequence of one text, and the word where each starts."""
    up = np.array([pow(BASE, i + 1, 1 << 64) for i in range(n)], np.uint64)
    count = max(0, len(hashes) - n + 1)
    total = np.full(count, n, np.uint64)
    for i in range(n):
        total += hashes[i : i + count] * up[i]
    at = np.flatnonzero(of[:count] == of[n - 1 : n - 1 + count])
    return mix(total[at]), at


class Items:
    """Words of some benchmark items, and the places of every seed."""

    def __init__(self, ids: list[int], texts: list[str]):
        found = found_words(texts)
        hashes = found.hashes()
        self.cut = np.searchsorted(found.of, np.arange(len(texts) + 1))
        self.ids, self.data, self.starts, self.ends = ids, np.frombuffer(found.data, np.uint8), found.starts, found.ends
        sizes = np.diff(self.cut)
        self.sizes = sorted({min(int(n), TILE) for n in sizes if n})
        seeds, places = [], []
        for n in self.sizes:
            seed, at = windows(hashes, found.of, n)
            # Short items are one seed of their size, others have one for each window of TILE words.
            own = np.minimum(sizes[found.of[at]], TILE) == n
            seeds.append(seed[own])
            places.append(at[own])
        seed, at = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((seeds, np.uint64), (places, np.int64)))
        order = np.lexsort((at, seed))
        self.item, self.place = found.of[at[order]], (at - self.cut[found.of[at]])[order]
        self.seeds, first = np.unique(seed[order], return_index=True)
        self.first = np.append(first, len(seed))


#: Whether n words of the text from one place on are those of the item from another.
Same = Callable[[int, int, int], bool]


def tiles(same: Same, length: int, at: np.ndarray, place: np.ndarray, tile: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in text, start in item, words). at, place: where seeds of ``tile`` words agree; length: words of the item."""
    order = np.lexsort((at, at - place))
    at, place = at[order], place[order]
    breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(place) != 1)) + 1
    starts = np.concatenate([[0], breaks])
    lengths = np.diff(np.append(starts, len(at))) + tile - 1
    # Longest first; then the earliest.
    open_ = list(zip((-lengths).tolist(), at[starts].tolist(), place[starts].tolist(), strict=True))
    heapify(open_)
    used_text: set[int] = set()
    used_item = np.zeros(length, bool)
    out = []
    while open_:
        size, a, b = heappop(open_)
        free = np.fromiter((a + i not in used_text and not used_item[b + i] for i in range(-size)), bool, -size)
        if free.all():
            if same(a, b, -size):
                out.append((a, b, -size))
                used_text.update(range(a, a - size))
                used_item[b : b - size] = True
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if y - x >= tile:
                heappush(open_, (x - y, a + x, b + x))
    return out


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for ``sizes[0]`` numbers, then from first[1] on, and so forth."""
    stops = np.cumsum(sizes)
    return np.arange(stops[-1] if len(stops) else 0) + np.repeat(first - (stops - sizes), sizes)


def _reached(items: Items, spots: np.ndarray, least: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Items whose words under the seeds at ``spots`` (distinct) can reach the least coverage: (item, spots, places)."""
    many = items.first[spots + 1] - items.first[spots]
    entry = _ranges(items.first[spots], many)
    item, place, spot = items.item[entry], items.place[entry], np.repeat(spots, many)
    order = np.lexsort((place, item))
    item, place, spot = item[order], place[order], spot[order]
    cut = np.flatnonzero(np.diff(item)) + 1
    out = []
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(item)], strict=True):
        if a == b:
            continue
        length = int(items.cut[item[a] + 1] - items.cut[item[a]])
        # Words under no seed are under no tile.
        covered = int(np.minimum(np.diff(place[a:b]), min(TILE, length)).sum()) + min(TILE, length)
        if covered >= least * length:
            out.append((int(item[a]), spot[a:b], place[a:b]))
    return out


def hits(texts: list[str], items: Items, least: float) -> list[tuple[int, int, float, int, int]]:
    """(text number, item number, coverage, tiles, longest tile) of texts of one piece."""
    found = found_words(texts)
    hashes, of = found.hashes(), found.of
    begin = np.searchsorted(of, np.arange(len(texts) + 1))
    spots, places = [], []
    for n in items.sizes:
        seed, at = windows(hashes, of, n)
        spot = np.minimum(np.searchsorted(items.seeds, seed), len(items.seeds) - 1)
        good = np.flatnonzero(items.seeds[spot] == seed)
        spots.append(spot[good])
        places.append(at[good])
    if not sum(map(len, spots)):
        return []
    spot, at = np.concatenate(spots), np.concatenate(places)
    # Within a text by seed, then by place.
    order = np.lexsort((at, spot, of[at]))
    spot, at = spot[order], at[order]
    text = of[at]
    cut = np.flatnonzero(np.diff(text)) + 1
    raw, out = np.frombuffer(found.data, np.uint8), []
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(text)], strict=True):
        t = int(text[a])
        lead = np.flatnonzero(np.append(True, np.diff(spot[a:b]) != 0))
        distinct, start, end = spot[a:b][lead], a + lead, a + np.append(lead[1:], b - a)
        for i, seeds, into in _reached(items, distinct, least):
            own, length = items.cut[i], int(items.cut[i + 1] - items.cut[i])
            where = np.searchsorted(distinct, seeds)
            times = end[where] - start[where]

            def same(x: int, y: int, n: int, t: int = t, own: int = int(own)) -> bool:
                one, other = slice(begin[t] + x, begin[t] + x + n), slice(own + y, own + y + n)
                sizes = found.ends[one] - found.starts[one]
                if (sizes != items.ends[other] - items.starts[other]).any():
                    return False
                return bool(same_bytes(raw, found.starts[one], items.data, items.starts[other], sizes).all())

            made = tiles(same, length, at[_ranges(start[where], times)] - begin[t], np.repeat(into, times), min(TILE, length))
            coverage = sum(x[2] for x in made) / length
            if made and coverage >= least:
                out.append((t, i, coverage, len(made), max(x[2] for x in made)))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    source = benchmark.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = source.agg(F.sum(utf8_size(F.col("text")))).first()[0] or 0
    count = 1 + total // BLOCK_BYTES
    for i in range(count):
        block = source.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == i).orderBy("id", "text").collect()
        if block:
            yield Items([r.id for r in block], [r.text for r in block])


def _find(block: Broadcast, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = block.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(ids[a + t], items.ids[i], *more) for a, texts in column_pieces(batch.column(1)) for t, i, *more in hits(texts, items, least)]
            yield pa.RecordBatch.from_pylist([dict(zip(("id", "item_id", "coverage", "tiles", "longest"), r, strict=True)) for r in rows], schema=FOUND)

    return run


FOUND = pa.schema([("id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int32()), ("longest", pa.int32())])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", least: float = COVERAGE
) -> DataFrame:
    """One row per text and item whose coverage is at least ``least``: id, item_id, coverage, tiles, longest."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "id long, item_id long, coverage double, tiles int, longest int"
    made = [source.mapInArrow(_find(spark.sparkContext.broadcast(b), least), schema) for b in _blocks(benchmark, item_col, "text")]
    out = reduce(DataFrame.unionByName, made) if made else spark.createDataFrame([], schema)
    return out.withColumnRenamed("id", id_col)


def _keep(block: Broadcast, text_col: str, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = block.value
        for batch in batches:
            bad = {a + t for a, texts in column_pieces(batch.column(text_col)) for t, *_ in hits(texts, items, least)}
            yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

    return run


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", least: float = COVERAGE) -> DataFrame:
    """``docs`` without the rows whose text covers an item."""
    for block in _blocks(benchmark, item_col, "text"):
        docs = docs.mapInArrow(_keep(docs.sparkSession.sparkContext.broadcast(block), text_col, least), docs.schema)
    return docs
