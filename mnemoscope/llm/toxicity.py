"""Toxicity by nearest labelled examples under TF-IDF cosine, found exactly.

Examples are at most ``EXAMPLES`` texts of each class, taken in the order of a hash of
their identifiers from at most ``SAMPLE`` labelled rows of each class (the documented
bounds of the fit; there is one copy of the index on each executor). Near copies among
these rows, by minhash marks, are one example: what copies share proves nothing about
other texts. The class that most of them have is its own, their number its weight.

Terms are words and beginnings of words of 4, 5 and 6 letters. Cosines over all terms
find too little (most of a text says nothing about toxicity; figures in the README), so
the vocabulary holds the terms that tell the classes apart. It is chosen from the
``CANDIDATES`` likely terms that mark most toxic examples, by greedy cover: again and
again the term that marks most toxic examples not yet marked, among terms that clean
examples hardly have; then all such terms that are too frequent for chance. A toxic
example that is left unmarked but stands for ``LEAST_NEW`` rows or more (any one, if
there are fewer toxic examples) is known by its runs of five words: the ``RUNS`` of
least hash over the whole text that no clean example has. So copies of it are found,
and other texts are not. Frequencies of the vocabulary are counted over all documents.

The index is inverted: each term's postings lie in blocks of ``BLOCK`` examples, and
each block knows its largest weight. A query looks at blocks in the order of their
upper bounds and stops when no bound can reach its ``NEIGHBOURS`` best, so the result
equals a full search. Neighbours of a cosine of at least ``LEAST_COSINE`` vote with a
weight that falls with their distance and makes up for the sampling of their class; an
isotonic fit of votes that leave the example itself out turns votes into probabilities.

A score depends on the text alone. Defined results: null and empty texts, and others
without a neighbour, get the share of toxic examples without any; without toxic or clean
examples every score is 0; repeated rows are scored each; null labels are not
learnt from; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .textvec import column_pieces, found_words, mix, pieces, range_hashes, shingles, words

EXAMPLES, NEIGHBOURS, BLOCK = 4096, 15, 64
#: Labelled rows of each class among which copies are looked for, and the examples are taken.
SAMPLE = 4 * EXAMPLES
#: Files of the sample, so that as many tasks can read it.
PARTS = 32
#: Least cosine of a neighbour that votes.
LEAST_COSINE = 0.25
#: Runs of words of an example that no term marks.
RUNS, RUN = 256, 5
STEMS = (4, 5, 6)
#: Most terms that go into the greedy choice, and least toxic examples a term must newly mark.
CANDIDATES, LEAST_NEW = 20_000, 3
#: A term is chosen only if at least this share of its examples, with classes weighted alike, is toxic.
PURITY = 0.98
#: Terms beside the cover: so many toxic examples that chance alone is less likely than this.
CHANCE = 1e-8
#: Rows that share ALIKE of MARKS least shingles with an earlier one are its copies.
MARKS, ALIKE = 8, 4
TOXIC = 0.7


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def terms(texts: list[str], runs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes and the number of their text: every word, its beginnings of STEMS letters, and runs of words if wanted."""
    found = found_words(texts)
    hashes = found.hashes()
    out, owner = [hashes], [found.of]
    for n in STEMS:
        long = np.flatnonzero(found.letters >= n)
        out.append(mix(range_hashes(found.data, found.starts[long], found.after(long, n)) + np.uint64(n)))
        owner.append(found.of[long])
    if runs:
        each, of = _runs(hashes, found.of, len(texts))
        out.append(each)
        owner.append(of)
    return np.concatenate(out), np.concatenate(owner)


def _runs(hashes: np.ndarray, of: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    each, owner = shingles(hashes, of, RUN, count)
    return mix(each + np.uint64(RUNS)), owner


def _counted(texts: list[str], runs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text number, term) with counts, in order."""
    found, owner = terms(texts, runs)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    lead = np.ones(len(found), bool)
    lead[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(lead)
    return owner[at], found[at], np.diff(np.append(at, len(found)))


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for ``sizes[0]`` numbers, then from first[1] on, and so forth."""
    stops = np.cumsum(sizes)
    return np.arange(stops[-1] if len(stops) else 0) + np.repeat(first - (stops - sizes), sizes)


@dataclass
class Index:
    """Examples as sparse vectors over a vocabulary: postings by term, in blocks with their largest weights."""

    vocabulary: np.ndarray  # sorted term hashes
    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    weight: np.ndarray  # documents that an example stands for
    postings: tuple[np.ndarray, np.ndarray, np.ndarray]  # places of terms, numbers of examples, normalised weights
    prior: float
    runs: bool = False
    steps: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0), np.zeros(0)))
    alone: float = 0.0

    def __post_init__(self):
        term, example, value = self.postings
        order = np.lexsort((example, term))
        term, self.example, self.value = term[order], example[order], value[order]
        block = self.example // BLOCK
        lead = np.append(True, (np.diff(term) != 0) | (np.diff(block) != 0)) if len(term) else np.zeros(0, bool)
        at = np.flatnonzero(lead)
        self.starts = np.append(at, len(term))
        self.block = block[at]
        self.peak = np.maximum.reduceat(self.value, at) if len(at) else np.zeros(0)
        self.heads = np.searchsorted(term[at], np.arange(len(self.vocabulary) + 1))

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        raw = (1 + np.log(counts)) * self.idf[at]
        size = np.sqrt((raw**2).sum())
        return raw / size if size > 0 else raw

    def nearest(self, at: np.ndarray, values: np.ndarray, k: int = NEIGHBOURS, without: int = -1, least: float = LEAST_COSINE) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine from ``least`` on, ties by number, and their cosines."""
        many = self.heads[at + 1] - self.heads[at]
        entry, says = _ranges(self.heads[at], many), np.repeat(values, many)
        best, cosines = np.zeros(0, np.int64), np.zeros(0)
        if not len(entry):
            return best, cosines
        order = np.argsort(self.block[entry], kind="stable")
        entry, says = entry[order], says[order]
        lead = np.flatnonzero(np.append(True, np.diff(self.block[entry]) != 0))
        stop = np.append(lead[1:], len(entry))
        upper = np.add.reduceat(says * self.peak[entry], lead)
        for r in np.argsort(-upper, kind="stable").tolist():
            if upper[r] < least - 1e-6 or len(best) == k and upper[r] < cosines[-1] - 1e-6:
                break
            own, said = entry[lead[r] : stop[r]], says[lead[r] : stop[r]]
            sizes = self.starts[own + 1] - self.starts[own]
            place = _ranges(self.starts[own], sizes)
            base = int(self.block[own[0]]) * BLOCK
            near = np.bincount(self.example[place] - base, np.repeat(said, sizes) * self.value[place], minlength=BLOCK)
            good = np.flatnonzero(np.round(near, 6) >= least)
            good = good[base + good != without]
            best, cosines = np.concatenate([best, base + good]), np.concatenate([cosines, near[good]])
            keep = np.lexsort((best, -np.round(cosines, 6)))[:k]
            best, cosines = best[keep], cosines[keep]
        return best, cosines

    def vote(self, best: np.ndarray, cosines: np.ndarray) -> float:
        say = self.weight[best] / (1.05 - np.minimum(cosines, 1.0))
        unsure = 0.1 * self.weight.mean()
        return float(((say * self.toxic[best]).sum() + unsure * self.prior) / (say.sum() + unsure))

    def score(self, best: np.ndarray, cosines: np.ndarray) -> float:
        if not len(best):
            return self.alone
        vote = self.vote(best, cosines)
        ends, levels = self.steps
        fitted = float(np.interp(vote, ends, levels)) if len(ends) else vote
        # Votes of one level keep their order.
        return min(1.0, max(0.0, 0.98 * fitted + 0.02 * vote))

    def look(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(text number, terms of the vocabulary, counts) of texts that have some."""
        if not len(self.vocabulary):
            return
        found, owner = terms(texts, self.runs)
        spot = np.minimum(np.searchsorted(self.vocabulary, found), len(self.vocabulary) - 1)
        same = self.vocabulary[spot] == found
        pairs, counts = np.unique(owner[same] * len(self.vocabulary) + spot[same], return_counts=True)
        of, at = np.divmod(pairs, len(self.vocabulary))
        cut = np.flatnonzero(np.diff(of)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(of)], strict=True):
            if b > a:
                yield int(of[a]), at[a:b], counts[a:b]


def isotonic(votes: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A non-decreasing fit of truth to votes (pool adjacent violators): points and levels."""
    blocks: list[list[float]] = []
    for i in np.argsort(votes, kind="stable"):
        blocks.append([truth[i] * weight[i], weight[i], votes[i], votes[i]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2], high]
    points = [x for s, w, low, high in blocks for x in (low, high)]
    levels = [s / w for s, w, _, _ in blocks for _ in range(2)]
    return np.array(points), np.array(levels)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, turn, marks): MARKS least shingles of five words, by as many orders."""
    for batch in batches:
        texts, marks = batch.column("text").to_pylist(), []
        for a, b in pieces(texts):
            hashes, of = words(texts[a:b])
            found, owner = shingles(hashes, of, RUN, b - a)
            least = np.full((b - a, MARKS), np.iinfo(np.uint64).max, np.uint64)
            for i in range(MARKS):
                np.minimum.at(least[:, i], owner, mix(found + np.uint64(i)))
            marks += [x.view(np.int64).tolist() for x in least]
        columns = [batch.column(c) for c in ("doc_id", "toxic", "turn")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(marks, pa.list_(pa.int64()))], names=["doc_id", "toxic", "turn", "marks"])


def grouped(rows: list[tuple[int, int, int, list[int]]]) -> dict[int, tuple[int, int, int]]:
    """Examples (doc_id: class, toxic rows, clean rows) of rows (doc_id, toxic, turn, marks), taken in turn.

    A row joins the example that it shares most marks with, if they are ALIKE or more;
    an example is toxic if most of its rows are.
    """
    holders: dict[tuple[int, int], list[int]] = {}
    members: dict[int, list[int]] = {}
    for doc_id, toxic, _, marks in sorted(rows, key=lambda r: (r[2], r[0])):
        shared = Counter(e for i, m in enumerate(marks) for e in holders.get((i, m), ()))
        # Of equal shares the first example, which stands first in the counter.
        top = max(shared, key=shared.__getitem__, default=None)
        if top is None or shared[top] < ALIKE:
            top = doc_id
            members[top] = [0, 0]
            for i, m in enumerate(marks):
                holders.setdefault((i, m), []).append(top)
        members[top][0 if toxic else 1] += 1
    return {e: (int(t > c), t, c) for e, (t, c) in members.items()}


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic, clean): examples of each class that have the term, of one batch."""
    for batch in batches:
        texts, toxic = batch.column("text").to_pylist(), batch.column("toxic").to_numpy(zero_copy_only=False)
        for a, b in pieces(texts):
            owner, found, _ = _counted(texts[a:b])
            distinct, code = np.unique(found, return_inverse=True)
            bad = np.bincount(code, toxic[a:b][owner], minlength=len(distinct)).astype(np.int64)
            every = np.bincount(code, minlength=len(distinct)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(bad), pa.array(every - bad)], names=["term", "toxic", "clean"])


def _holding(vocabulary: np.ndarray, runs: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, toxic, term, n) of the examples' terms that are in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in pieces(texts):
                owner, found, counts = _counted(texts[a:b], runs)
                good = np.isin(found, vocabulary)
                owner = pa.array(owner[good] + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(owner), batch.column("toxic").take(owner), pa.array(found[good].view(np.int64)), pa.array(counts[good])], names=["doc_id", "toxic", "term", "n"]
                )

    return run


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term): the RUNS runs of words of least hash of each text."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in pieces(texts):
            each, owner = _runs(*words(texts[a:b]), b - a)
            order = np.lexsort((each, owner))
            each, owner = each[order], owner[order]
            nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(each[nth < RUNS]).view(np.int64))], names=["term"])


def _frequencies(vocabulary: np.ndarray, runs: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(place in the vocabulary or -1 for all, documents) of one task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, have = 0, np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            total += batch.num_rows
            for _, texts in column_pieces(batch.column(0)):
                found, owner = terms(texts, runs)
                spot = np.minimum(np.searchsorted(vocabulary, found), len(vocabulary) - 1)
                same = vocabulary[spot] == found
                pairs = np.unique(owner[same] * len(vocabulary) + spot[same])
                have += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(vocabulary))), pa.array(np.concatenate([[total], have]))], names=["place", "n"])

    return run


def chosen_terms(rows: list[tuple[int, bool, int]], classes: tuple[int, int]) -> list[int]:
    """Greedy cover of toxic examples. rows: (example, toxic, term); classes: examples that are toxic, clean."""
    bad: dict[int, set[int]] = {}
    good: Counter[int] = Counter()
    for example, toxic, term in rows:
        if toxic:
            bad.setdefault(term, set()).add(example)
        else:
            good[term] += 1
    share = {t: len(x) / classes[0] / (len(x) / classes[0] + good[t] / classes[1]) for t, x in bad.items()}
    open_ = {t: set(x) for t, x in bad.items() if share[t] >= PURITY}
    odds = math.log(classes[0] / sum(classes))
    sure = {t for t in open_ if len(bad[t]) * odds < math.log(CHANCE)}
    taken = []
    while open_:
        # Most newly marked, then most marked at all, then the least hash.
        term = min(open_, key=lambda t: (-len(open_[t]), -len(bad[t]), t))
        marked = open_.pop(term)
        if len(marked) < LEAST_NEW:
            break
        taken.append(term)
        open_ = {t: rest for t, x in open_.items() if len(rest := x - marked) >= LEAST_NEW}
    return sorted({*taken, *sure})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of examples among ``docs`` with ``labels`` (doc_id, toxic) that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    present = known.join(source.select("doc_id").distinct(), "doc_id", "left_semi")
    present = written(present.withColumn("turn", F.xxhash64("doc_id")), "labels")
    totals = {r.toxic: r["count"] for r in present.groupBy("toxic").count().collect()}
    picked = [_first(present.where(F.col("toxic") == c), totals.get(c, 0)) for c in (0, 1)]
    # At most 2 * SAMPLE rows of three numbers each.
    found = source.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").dropDuplicates(["doc_id"])
    sample = written(found.repartition(PARTS, "doc_id"), "examples")
    rows = [tuple(r) for r in sample.mapInArrow(_marks, "doc_id long, toxic int, turn long, marks array<long>").collect()]
    turns, groups = {r[0]: r[2] for r in rows}, grouped(rows)
    chosen: dict[int, tuple[int, int, int]] = {}
    for c in (0, 1):
        own = sorted((e for e, g in groups.items() if g[0] == c), key=lambda e: (turns[e], e))
        chosen |= {e: groups[e] for e in own[:EXAMPLES]}
    sizes = tuple(sum(g[0] == c for g in chosen.values()) for c in (1, 0))
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    empty = Index(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), nothing, 0.0)
    if not all(sizes):
        return empty
    spark = docs.sparkSession
    taken = spark.createDataFrame([(e, g[0]) for e, g in chosen.items()], "doc_id long, toxic int")
    examples = sample.drop("toxic", "turn").join(F.broadcast(taken), "doc_id")
    counts = examples.mapInArrow(_terms_of, "term long, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    likely = counts.where((F.col("toxic") >= LEAST_NEW) & (F.col("toxic") * sizes[1] * (1 - PURITY) >= F.col("clean") * sizes[0] * PURITY))
    candidates = [r.term for r in likely.orderBy(F.desc("toxic"), "clean", "term").limit(CANDIDATES).collect()]
    rows = _held(examples, np.array(candidates, np.int64).view(np.uint64))
    words_ = set(chosen_terms([(d, bool(t), w) for d, t, w, _ in rows], sizes))
    marked = {d for d, _, w, _ in rows if w in words_}
    left = [e for e, (c, t, _) in chosen.items() if c and e not in marked and (t >= LEAST_NEW or sizes[0] < LEAST_NEW)]
    runs = _known_runs(examples, left)
    vocabulary = np.sort(np.concatenate([np.array(sorted(words_), np.int64).view(np.uint64), runs]))
    if not len(vocabulary):
        return empty
    if len(runs):
        rows = _held(examples, vocabulary, True)
    frequency = source.select("text").mapInArrow(_frequencies(vocabulary, bool(len(runs))), "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    have = {r.place: r.n for r in frequency.collect()}
    idf = np.array([np.log((1 + have[-1]) / (1 + have[i])) + 1 for i in range(len(vocabulary))])
    seen = {c: sum(g[c] for g in groups.values()) for c in (1, 2)}
    scale = {1: totals[1] / max(seen[1], 1), 0: totals[0] / max(seen[2], 1)}
    return _calibrated(vocabulary, idf, rows, chosen, scale, totals[1] / (totals[0] + totals[1]), bool(len(runs)))


def _first(rows: DataFrame, total: int) -> DataFrame:
    """The SAMPLE rows of least turn, a uniform hash. Rows beyond twice their share are left out before they are sorted."""
    if total > 4 * SAMPLE:
        rows = rows.where(F.col("turn") <= -(2**63) + 2 * SAMPLE * 2**64 // total)
    return rows.orderBy("turn", "doc_id").limit(SAMPLE)


def _held(examples: DataFrame, vocabulary: np.ndarray, runs: bool = False) -> list[tuple[int, int, int, int]]:
    return [tuple(r) for r in examples.mapInArrow(_holding(np.sort(vocabulary), runs), "doc_id long, toxic int, term long, n long").collect()]


def _known_runs(examples: DataFrame, left: list[int]) -> np.ndarray:
    """Runs of words by which the examples in ``left`` are known: at most RUNS of each, none that a clean example has."""
    if not left:
        return np.zeros(0, np.uint64)
    wanted = F.broadcast(examples.sparkSession.createDataFrame([(e,) for e in left], "doc_id long"))
    own = examples.join(wanted, "doc_id", "left_semi").mapInArrow(_runs_of, "term long").distinct()
    found = np.sort(np.array([r.term for r in own.collect()], np.int64).view(np.uint64))
    clean = {r[2] for r in _held(examples.where(F.col("toxic") == 0), found, True)}
    return found[~np.isin(found, np.array(sorted(clean), np.int64).view(np.uint64))]


def _calibrated(
    vocabulary: np.ndarray, idf: np.ndarray, rows: list[tuple[int, int, int, int]], chosen: dict[int, tuple[int, int, int]], scale: dict[int, float], prior: float, runs: bool
) -> Index:
    """The index of the examples in rows (doc_id, toxic, term, n), fitted to votes without each example itself.

    An example stands for the rows that it was grouped from, more of them counting less
    and less, and for those of its class that weren't sampled.
    """
    kept = [r for r in rows if (s := int(np.searchsorted(vocabulary, np.int64(r[2]).view(np.uint64)))) < len(vocabulary) and vocabulary[s] == np.int64(r[2]).view(np.uint64)]
    ids = np.array(sorted({r[0] for r in kept}), np.int64)
    term = np.searchsorted(vocabulary, np.array([r[2] for r in kept], np.int64).view(np.uint64))
    example = np.searchsorted(ids, np.array([r[0] for r in kept], np.int64))
    counts = np.array([r[3] for r in kept], np.int64)
    raw = (1 + np.log(np.maximum(counts, 1))) * idf[term]
    value = (raw / np.sqrt(np.bincount(example, raw**2, minlength=len(ids)))[example]).astype(np.float32) if len(kept) else raw
    toxic = np.array([chosen[int(i)][0] for i in ids], np.float64)
    stands = {e: (1 + math.log(t + c)) * scale[g] for e, (g, t, c) in chosen.items()}
    weight = np.array([stands[int(i)] for i in ids])
    index = Index(vocabulary, idf, ids, toxic, weight, (term, example, value), prior, runs)
    known = set(ids.tolist())
    without = [sum(stands[e] for e, g in chosen.items() if g[0] == c and e not in known) for c in (1, 0)]
    order = np.lexsort((term, example))
    cut = np.searchsorted(example[order], np.arange(len(ids) + 1))
    votes, kept_at = [], []
    for i in range(len(ids)):
        own = order[cut[i] : cut[i + 1]]
        best, cosines = index.nearest(term[own], index.vector(term[own], counts[own]), without=i)
        if len(best):
            votes.append(index.vote(best, cosines))
            kept_at.append(i)
        else:
            without[0 if toxic[i] else 1] += weight[i]
    index.steps = isotonic(np.array(votes), toxic[kept_at], weight[kept_at])
    index.alone = float(without[0] / max(sum(without), 1e-9)) if sum(without) else 0.0
    return index


def _scores(index: Index, column: pa.Array) -> tuple[np.ndarray, list[list[int]]]:
    scores, evidence = np.full(len(column), index.alone), [[] for _ in range(len(column))]
    seen: dict[bytes, tuple[float, list[int]]] = {}
    for a, texts in column_pieces(column):
        for i, at, counts in index.look(texts):
            key = at.tobytes() + counts.tobytes()
            if key not in seen:
                best, cosines = index.nearest(at, index.vector(at, counts))
                seen[key] = index.score(best, cosines), index.ids[best[:3]].tolist()
            scores[a + i], evidence[a + i] = seen[key]
    return scores, evidence


def _score(model: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, evidence = _scores(model.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array(evidence, pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted, evidence (identifiers of the nearest examples)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = source.mapInArrow(_score(model), "doc_id long, score double, evidence array<long>")
    return out.select(
        F.col("doc_id").alias(id_col), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "evidence"
    )


def _keep(model: Broadcast, text_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, _ = _scores(model.value, batch.column(text_col))
            yield batch.filter(pa.array(scores < TOXIC))

    return run


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted to be toxic."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    return docs.mapInArrow(_keep(model, text_col), docs.schema)
