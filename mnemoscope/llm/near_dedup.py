"""Near duplicates: DartMinHash sketches of word shingles, banded buckets, exact check.

1. Each text becomes a weighted set: its shingles of ``WORDS`` words, each with the
   number of its occurrences, and a sketch of ``BANDS * ROWS`` darts. Texts of the same
   words in sequence (by a SHA-256 of their bytes) are one node from here on.
2. Nodes that agree on all darts of a band share a bucket. A bucket is dealt into
   blocks of about ``BLOCK`` nodes. Inside a cell (a block, or two) sketches of one
   byte a dart give estimates, and only few pairs leave it: first a spanning forest
   of the best estimates in FIRST bands, and then, in all bands, every pair between
   nodes that are still in different classes, once: in the first band whose bucket
   both share, by the bands' whole keys. Pairs inside a class can't change it, so a group of
   n near copies costs about n checks, not their square. Nodes that a big class may
   hold are not paired with its members: blocks of such nodes meet blocks of the
   class, texts and all, and only links leave. So do the nodes of a crowded cell, one
   of more than ``CROWDED`` pairs a node: they leave it as nodes, not as pairs.
3. Every pair that leaves is checked on the whole sets, in crowded cells every node
   of one side with every one of the other; pairs whose weighted Jaccard
   similarity (sum of least over sum of largest counts) is at least ``LEAST`` are links,
   and classes are their connected components.

A link at similarity 0.8 is missed with a probability below 0.0001 (no shared
bucket, or an estimate more than four standard deviations too low).

Hot keys: rows of one text, and nodes of one bucket, are dealt over tasks once they
are more than one in 4,096 of all (``with_entries``).

Defined results: rows with equal identifiers are one document (a null identifier
too); equal texts are one class; a text without words is near to no other; a text
of fewer than WORDS words is one shingle; an empty table gives an empty result;
columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, with_entries, written
from .dart import EMPTY, sketches
from .textvec import Words, column_pieces, found_words, mix, pieces, shingles, words

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 26, 5
BLOCK = 256
#: Estimates from which a pair is checked; and those that a forest is made of.
CHECKED, JOINED = 0.66, 0.76
FORESTS = 1
#: Bands whose buckets the forest is made of; they join most of what belongs together.
FIRST = 8
#: Nodes of a class from which on it is met as a whole, not by pairs.
BIG = 32
#: Pairs a node of a cell from which on its nodes leave it instead of its pairs.
CROWDED = 2
#: What leaves a cell: pairs (a, b); a node and a big class (a, b); a node (a, with its class) of the crowded cell (b, cell), on a side.
PAIR, CLASS, CROWD = 0, 1, 2

LEAVES = "a long, b long, kind int, cell long, side int, cls long"
SKETCH = "id long, print binary, bands array<long>, sketch binary"

#: Weights of shingles from their counts.
Weigh = Callable[[np.ndarray], np.ndarray]


def counted(counts: np.ndarray) -> np.ndarray:
    """A shingle weighs as often as it stands in the text."""
    return counts.astype(np.float64)


def once(counts: np.ndarray) -> np.ndarray:
    """Every distinct shingle weighs 1: the weighted similarity is that of sets."""
    return np.ones(len(counts))


def weighted_sets(texts: list[str], n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, their counts, and the number of their text."""
    return _sets(*words(texts), n, len(texts))


def _sets(hashes: np.ndarray, of: np.ndarray, n: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, owner = shingles(hashes, of, n, count)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    lead = np.ones(len(found), bool)
    lead[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(lead)
    return found[at], np.diff(np.append(at, len(found))), owner[at]


def similarity(a: np.ndarray, weight_a: np.ndarray, b: np.ndarray, weight_b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two arrays of distinct values in order."""
    if not len(a) or not len(b):
        return 0.0
    _, at, to = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = np.minimum(weight_a[at], weight_b[to]).sum()
    return float(both / (weight_a.sum() + weight_b.sum() - both))


def _prints(texts: list[str], found: Words) -> list[bytes]:
    """A digest of each text's words in sequence, or of the text itself if it has none."""
    cut = np.searchsorted(found.of, np.arange(len(texts) + 1)).tolist()
    inside = np.zeros(len(found.data), np.int8)
    inside[found.starts] += 1
    inside[found.ends] -= 1
    inside = np.cumsum(inside, dtype=np.int8).view(bool)
    # A word is followed by one byte at least; it becomes a line feed, which no word holds.
    keep = inside.copy()
    keep[found.ends] = True
    plain = np.where(inside, np.frombuffer(found.data, np.uint8), np.uint8(10))[keep]
    upto = np.concatenate([[0], np.cumsum(found.ends - found.starts + 1)])
    out = []
    for i, t in enumerate(texts):
        a, b = cut[i], cut[i + 1]
        out.append(hashlib.sha256(plain[upto[a] : upto[b]].tobytes() if b > a else b"\n" + t.encode("utf-8", "surrogatepass")).digest())
    return out


def _sketch(weigh: Weigh) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        count = len(texts)
        heard = found_words(texts)
        found, counts, owner = _sets(heard.hashes(), heard.of, WORDS, count)
        darts = sketches(found, weigh(counts), owner, count, BANDS * ROWS)
        keys = np.zeros((count, BANDS), np.uint64)
        for r in range(ROWS):
            keys = mix(keys + darts.reshape(count, BANDS, ROWS)[:, :, r])
        keys = mix(keys + np.arange(BANDS, dtype=np.uint64))
        some = darts[:, 0] != EMPTY
        sizes = np.where(some, BANDS, 0)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(keys[some].reshape(-1).view(np.int64)))
        short = (darts >> np.uint64(8)).astype(np.uint8)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(_prints(texts, heard), pa.binary()), lists, pa.array([x.tobytes() for x in short], pa.binary())],
            names=["id", "print", "bands", "sketch"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in column_pieces(batch.column(1)):
                yield rows(batch.column(0).slice(a, len(texts)), texts)

    return run


def _forest(left: np.ndarray, right: np.ndarray, of: np.ndarray) -> list[int]:
    """Which of the pairs, taken in order, join two classes (Kruskal)."""
    top = {int(c): int(c) for c in np.unique(of)}

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    taken = []
    for i, (a, b) in enumerate(zip(of[left].tolist(), of[right].tolist(), strict=True)):
        a, b = root(a), root(b)
        if a != b:
            top[max(a, b)] = min(a, b)
            taken.append(i)
    return taken


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by key and cell, cut anew so that no cell goes on in the next."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None and held.num_rows:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key, at = batch.column("key").to_numpy(), batch.column("cell").to_numpy()
        other = np.flatnonzero((key != key[-1]) | (at != at[-1]))
        whole = int(other[-1]) + 1 if len(other) else 0
        if whole:
            yield batch.slice(0, whole)
        held = batch.slice(whole)
    if held is not None and held.num_rows:
        yield held


def _pairs(least: float, crowded: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What leaves each cell (``LEAVES``): rows (key, cell, side, rep, cls, big, sketch), sorted by key and cell.

    crowded None: nodes of side 0 meet each other, and a forest of their best pairs
    leaves. Otherwise nodes of side 0 meet those of side 1, and those of side 2, which
    are on side 0 of some cell too, if they are of larger number; rows have ``bands``, and a
    pair leaves only the bucket of the first band that both share.
    """

    def forest(rep: np.ndarray, cls: np.ndarray, sketch: np.ndarray) -> list[tuple]:
        order = np.argsort(rep, kind="stable")
        rep, cls, sketch = rep[order], cls[order], sketch[order]
        left, right, score = [], [], []
        for i in range(len(rep)):
            near = (sketch[i + 1 :] == sketch[i]).mean(axis=1)
            good = np.flatnonzero((near >= least) & (cls[i + 1 :] != cls[i]))
            left.append(np.full(len(good), i))
            right.append(good + i + 1)
            score.append(near[good])
        a, b, s = np.concatenate(left), np.concatenate(right), np.concatenate(score)
        best = np.lexsort((rep[b], rep[a], -s))
        a, b = a[best], b[best]
        taken = _forest(a, b, cls)
        return [(x, y, PAIR, None, None, None) for x, y in zip(rep[a[taken]].tolist(), rep[b[taken]].tolist(), strict=True) if x != y]

    def meeting(key: int, cell: int, side: np.ndarray, rep: np.ndarray, cls: np.ndarray, big: np.ndarray, sketch: np.ndarray, bands: np.ndarray) -> list[tuple]:
        others = np.flatnonzero(side != 0)
        drawn, again = sketch[others], side[others] == 2
        left, right = [], []
        for i in np.flatnonzero(side == 0).tolist():
            near = (drawn == sketch[i]).mean(axis=1)
            good = others[(near >= least) & (cls[others] != cls[i]) & ~(again & (rep[others] <= rep[i]))]
            first = (bands[good] == bands[i]).argmax(axis=1)
            good = good[bands[i][first] == key]
            left.append(np.full(len(good), i))
            right.append(good)
        if not left:
            return []
        a, b = np.concatenate(left), np.concatenate(right)
        whole = big[a] | big[b]
        # Of two big classes the one of the lesser number is met as a whole.
        turn = big[a] & (~big[b] | (cls[a] < cls[b]))
        one, other = np.where(turn, b, a)[whole], np.where(turn, a, b)[whole]
        out = [(x, y, CLASS, None, None, None) for x, y in {*zip(rep[one].tolist(), cls[other].tolist(), strict=True)}]
        a, b = a[~whole], b[~whole]
        sides = np.unique(a), np.unique(b)
        if len(a) > crowded * sum(map(len, sides)):
            return out + [(x, key, CROWD, cell, n, y) for n, nodes in enumerate(sides) for x, y in zip(rep[nodes].tolist(), cls[nodes].tolist(), strict=True)]
        low, high = np.minimum(rep[a], rep[b]), np.maximum(rep[a], rep[b])
        return out + [(x, y, PAIR, None, None, None) for x, y in zip(low.tolist(), high.tolist(), strict=True)]

    def results(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, at = batch.column("key").to_numpy(), batch.column("cell").to_numpy()
        side, rep, cls, big = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("side", "rep", "cls", "big"))
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(len(rep), -1)
        bands = None if crowded is None else batch.column("bands").flatten().to_numpy().reshape(len(rep), -1)
        edges = np.flatnonzero((key[1:] != key[:-1]) | (at[1:] != at[:-1])) + 1
        bounds = [0, *edges.tolist(), len(rep)]
        out: set[tuple] = set()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a < 2:
                continue
            if bands is None:
                out.update(forest(rep[a:b], cls[a:b], sketch[a:b]))
            else:
                out.update(meeting(int(key[a]), int(at[a]), side[a:b], rep[a:b], cls[a:b], big[a:b], sketch[a:b], bands[a:b]))
        types = dict(a=pa.int64(), b=pa.int64(), kind=pa.int32(), cell=pa.int64(), side=pa.int32(), cls=pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types.values())], names=list(types))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_cells(batches):
            yield results(batch)

    return run


def _links(weigh: Weigh) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs whose whole texts are similar: rows (a, b, text_a, text_b), sorted by a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            out = []
            texts_a, texts_b = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            for start, end in pieces(texts_b):
                found, counts, owner = weighted_sets(texts_b[start:end])
                weights = weigh(counts)
                cut = np.searchsorted(owner, np.arange(end - start + 1))
                for i in range(start, end):
                    if texts_a[i] != last:
                        last = texts_a[i]
                        own, many, _ = weighted_sets([last])
                        held = own, weigh(many)
                    x, y = cut[i - start], cut[i - start + 1]
                    out.append(similarity(*held, found[x:y], weights[x:y]))
            good = [i for i, s in enumerate(out) if s >= LEAST]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64()), pa.array([out[i] for i in good], pa.float64())], names=["a", "b", "similarity"]
            )

    return run


def _checked(pairs: DataFrame, texts: DataFrame, weigh: Weigh) -> DataFrame:
    """Pairs (a, b) that are links. Pairs of one node are dealt over salts, its text once a salt."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_salts"))
    other = pairs.join(counts, "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    other = other.withColumn("_salt", F.pmod(F.xxhash64("b"), F.col("_salts")).cast("int")).drop("_salts")
    own = counts.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), "text_a"
    )
    both = other.join(own.hint("merge"), ["a", "_salt"]).select("a", "b", "text_a", "text_b")
    return written(both.mapInArrow(_links(weigh), "a long, b long, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "links")


def _met(weigh: Weigh) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links between the sides of each cell that join classes: rows (key, cell, side, id, cls, text), sorted by key and cell."""

    def links(part: pa.RecordBatch) -> Iterator[tuple[int, int, float]]:
        side, ids, cls = (part.column(c).to_numpy() for c in ("side", "id", "cls"))
        texts = part.column("text").to_pylist()
        members = np.flatnonzero(side == 1)
        sets, weights = [], []
        for x, y in pieces(texts):
            found, counts, owner = weighted_sets(texts[x:y])
            cut = np.searchsorted(owner, np.arange(1, y - x))
            sets += np.split(found, cut)
            weights += np.split(weigh(counts), cut)
        total = np.array([w.sum() for w in weights])
        if not len(members):
            return
        every, many = np.concatenate([sets[i] for i in members]), np.concatenate([weights[i] for i in members])
        owner = np.repeat(np.arange(len(members)), [len(sets[i]) for i in members])
        left, right, score = [], [], []
        for i in np.flatnonzero(side == 0).tolist():
            if not len(sets[i]):
                continue
            spot = np.minimum(np.searchsorted(sets[i], every), len(sets[i]) - 1)
            same = sets[i][spot] == every
            both = np.bincount(owner[same], np.minimum(weights[i][spot[same]], many[same]), minlength=len(members))
            share = both / (total[i] + total[members] - both)
            good = np.flatnonzero((share >= LEAST) & (cls[members] != cls[i]))
            # One link joins two classes; more would say nothing new.
            good = good[np.unique(cls[members[good]], return_index=True)[1]]
            left.append(np.full(len(good), i))
            right.append(members[good])
            score.append(share[good])
        if left:
            a, b, s = np.concatenate(left), np.concatenate(right), np.concatenate(score)
            for n in _forest(a, b, cls):
                yield int(ids[a[n]]), int(ids[b[n]]), float(s[n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_cells(batches):
            key, at = batch.column("key").to_numpy(), batch.column("cell").to_numpy()
            edges = np.flatnonzero((key[1:] != key[:-1]) | (at[1:] != at[:-1])) + 1
            bounds = [0, *edges.tolist(), batch.num_rows]
            rows = [x for a, b in zip(bounds[:-1], bounds[1:], strict=True) for x in links(batch.slice(a, b - a))]
            types = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["a", "b", "similarity"])

    return run


def _met_classes(pairs: DataFrame, classes: DataFrame, texts: DataFrame, weigh: Weigh) -> DataFrame:
    """Links of nodes to big classes, pairs (a, cls): blocks of nodes meet blocks of members, with their texts."""
    groups = pairs.groupBy("cls").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_groups"), F.count(F.lit(1)).alias("_rows"))
    counts = classes.groupBy("cls").agg(F.count(F.lit(1)).alias("_n"))
    blocks = groups.join(counts, "cls").withColumn("_blocks", F.ceil(F.col("_n") / BLOCK).cast("int"))
    blocks = written(blocks, "blocks")

    def placed(rows: DataFrame, weight: str, node: str) -> DataFrame:
        found = with_entries(rows, blocks, ["cls"], weight, [node]).where(F.col("_entry").isNotNull())
        found = found.select(F.col("cls").alias("key"), F.col(node).alias("id"), "_entry._groups", "_entry._blocks")
        return found.join(texts, "id")

    # Each of these nodes counts as a class of its own here; it is in none of the classes that it meets.
    own = placed(pairs, "_rows", "a").select(
        "key", F.pmod(F.xxhash64("id"), F.col("_groups")).alias("_g"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_b"), "_blocks", F.lit(0).alias("side"), "id", F.col("id").alias("cls"), "text"
    )
    members = placed(classes, "_n", "node").select(
        "key", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)).alias("_g"), F.pmod(F.xxhash64("id"), F.col("_blocks")).alias("_b"), "_blocks", F.lit(1).alias("side"), "id", F.col("key").alias("cls"), "text"
    )
    cells = own.unionByName(members).select("key", (F.col("_g") * F.col("_blocks") + F.col("_b")).cast("long").alias("cell"), "side", "id", "cls", "text")
    return _met_cells(cells, weigh)


def _met_crowds(rows: DataFrame, texts: DataFrame, weigh: Weigh) -> DataFrame:
    """Links between the nodes of crowded cells, rows (a, b, cell, side, cls)."""
    cells = rows.select(F.col("b").alias("key"), "cell", "side", F.col("a").alias("id"), "cls").join(texts.hint("merge"), "id")
    return _met_cells(cells.select("key", "cell", "side", "id", "cls", "text"), weigh)


def _met_cells(cells: DataFrame, weigh: Weigh) -> DataFrame:
    dealt = cells.repartition("key", "cell").sortWithinPartitions("key", "cell")
    return written(dealt.mapInArrow(_met(weigh), "a long, b long, similarity double"), "met")


def _least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least v of their u; a u of very many edges is no hot task."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n"))
    return with_entries(edges, written(least, "least"), ["u"], "_n", ["v"]).select("u", "v", F.col("_entry.m").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, cls): the least node of each node's component, for nodes that have links (a, b).

    Rounds of hooking to the least neighbour and of pointing stars at their least
    node, until nothing changes; the number of rounds is logarithmic in the diameter.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    # Two sums of hashes and a count stand for a set of edges.
    look = F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40)), F.bit_xor(F.xxhash64("v", "u"))
    while before != (now := tuple(edges.agg(*look).first())):
        before = now
        # Larger neighbours of each node go to the least of its neighbourhood.
        both = _least(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = written(both.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "edges")
        # Smaller neighbours of each node, and the node, go to the least of them.
        small = _least(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.*").where("u <> v").distinct(), "edges")
    tops = edges.groupBy("u").agg(F.min("v").alias("cls")).withColumnRenamed("u", "node")
    return tops.unionByName(tops.select(F.col("cls").alias("node"), "cls").distinct())


def _cells(banded: DataFrame, last: bool) -> DataFrame:
    """Rows of cells (key, cell, side, rep, cls, big, sketch, in the last round bands) of buckets that hold several classes."""
    node = ["rep", "cls", "big", "sketch", *(["bands"] if last else [])]
    sizes = banded.groupBy("key").agg(F.min("cls").alias("_low"), F.max("cls").alias("_high"), F.count(F.lit(1)).alias("_n"))
    mixed = sizes.where(F.col("_low") != F.col("_high")).select("key", "_n")
    if not last:
        dealt = with_entries(banded, written(mixed, "buckets"), ["key"], "_n", ["rep"]).where(F.col("_entry").isNotNull())
        block = F.pmod(F.xxhash64("rep", "key"), F.ceil(F.col("_entry._n") / BLOCK)).cast("int")
        return dealt.select("key", block.alias("cell"), F.lit(0).alias("side"), *node)
    # Nodes outside the largest class of a bucket meet each other and all others.
    shares = banded.groupBy("key", "cls").agg(F.count(F.lit(1)).alias("n"))
    first = shares.groupBy("key").agg(F.max(F.struct("n", "cls")).alias("top"), F.sum("n").alias("_all"))
    first = first.where(F.col("_all") > F.col("top.n"))
    first = written(first.select("key", F.col("top.cls").alias("_main"), "_all", (F.col("_all") - F.col("top.n")).alias("_few")), "buckets")
    dealt = with_entries(banded, first, ["key"], "_all", ["rep"]).where(F.col("_entry").isNotNull())
    dealt = dealt.select("key", *node, F.col("_entry._main").alias("_main"), *(F.ceil(F.col(f"_entry.{c}") / BLOCK).cast("int").alias(w) for c, w in (("_few", "_rows"), ("_all", "_w"))))
    hashed = F.xxhash64("rep", "key")
    few = dealt.where(F.col("cls") != F.col("_main")).select(
        "key", F.explode(F.sequence(F.lit(0), F.col("_w") - 1)).alias("_c"), F.pmod(hashed, F.col("_rows")).cast("int").alias("_r"), "_w", F.lit(0).alias("side"), *node
    )
    all_ = dealt.select(
        "key",
        F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)).alias("_r"),
        F.pmod(hashed, F.col("_w")).cast("int").alias("_c"),
        "_w",
        F.when(F.col("cls") == F.col("_main"), 1).otherwise(2).alias("side"),
        *node,
    )
    return few.unionByName(all_).select("key", (F.col("_r") * F.col("_w") + F.col("_c")).cast("int").alias("cell"), "side", *node)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weigh: Weigh = counted) -> DataFrame:
    """Per row: id, rep (the least identifier with the same words in sequence), class_id (the least of the class)."""
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketched = written(source.mapInArrow(_sketch(weigh), SKETCH), "sketches")
    # A text that stands alone is its own node and needs no entry.
    same = written(sketched.groupBy("print").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1), "same")
    named = with_entries(sketched.select("id", "print", "bands"), same, ["print"], "_n", ["id"], alike=True)
    rep = F.coalesce("_entry.rep", "id")
    # Rows of equal identifiers can be several nodes of one name, so a node is a name and a text.
    node = F.xxhash64("print").alias("node")
    member = written(named.select("id", rep.alias("rep"), node, F.when(F.col("id") == rep, F.col("bands")).alias("bands")), "members")
    spread = member.where(F.col("id") == F.col("rep")).select("rep", "node", F.posexplode("bands").alias("band", "key"))
    full = spread.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    shared = with_entries(spread, written(full, "full"), ["key"], "_n", ["rep"]).where(F.col("_entry").isNotNull())
    shared = written(shared.select("rep", "node", "band", "key"), "shared")
    # Sketches go only to nodes that share a bucket.
    drawn = sketched.select(F.col("id").alias("rep"), node, "sketch", "bands").join(shared.select("rep", "node").distinct().hint("merge"), ["rep", "node"], "left_semi")
    banded = written(shared.join(drawn.dropDuplicates(["rep", "node"]), ["rep", "node"]).drop("node"), "banded")
    near = shared.select(F.col("rep").alias("id")).distinct()
    # Joins that move texts are the same at every size, so their cost grows with the input.
    texts = written(source.join(near.hint("merge"), "id", "left_semi"), "near-texts")
    tested, links, classes = None, None, None
    for turn in range(FORESTS + 1):
        last = turn == FORESTS
        if classes is None:
            current = banded.withColumns({"cls": F.col("rep"), "big": F.lit(False)})
        else:
            sizes = written(classes.groupBy("cls").agg(F.count(F.lit(1)).alias("_n")), "sizes")
            own = with_entries(classes, sizes, ["cls"], "_n", ["node"]).select(F.col("node").alias("rep"), "cls", (F.col("_entry._n") > BIG).alias("big"))
            current = banded.join(own, "rep", "left").withColumns({"cls": F.coalesce("cls", "rep"), "big": F.coalesce("big", F.lit(False))})
        if turn == 0:
            current = current.where(F.col("band") < FIRST)
        cells = _cells(current, last).repartition("key", "cell").sortWithinPartitions("key", "cell")
        pairs = cells.mapInArrow(_pairs(CHECKED, CROWDED) if last else _pairs(JOINED, None), LEAVES).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b", "kind"], "left_anti")
        pairs = written(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = _checked(pairs.where(F.col("kind") == PAIR), texts, weigh)
        if last:
            found = found.unionByName(_met_classes(pairs.where(F.col("kind") == CLASS).select("a", F.col("b").alias("cls")), classes, texts, weigh))
            found = found.unionByName(_met_crowds(pairs.where(F.col("kind") == CROWD), texts, weigh))
        # Classes stand for the links that made them.
        links = found if classes is None else found.select("a", "b").unionByName(classes.toDF("a", "b"))
        classes = written(components(links), "classes")
    copies = same.groupBy("rep").agg(F.sum("_n").alias("_n"))
    entries = classes.withColumnRenamed("node", "rep").join(copies, "rep", "left").select("rep", "cls", F.coalesce("_n", F.lit(1)).alias("_n"))
    out = with_entries(member.select("id", "rep"), written(entries, "entries"), ["rep"], "_n", ["id"])
    real = lambda c: F.when(c != NO_ID, c)
    return out.select(
        real(F.col("id")).alias(id_col), real(F.col("rep")).alias("rep"), real(F.coalesce("_entry.cls", "rep")).alias("class_id")
    )
