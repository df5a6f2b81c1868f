import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from mnemoscope.llm import toxicity as tx


def corpus(count=900, seed=2):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(800)]
    slurs, stem = ["vilezz", "grubzz", "nastzz"], "ployk"
    rows, labels = [], []
    for i in range(count):
        words = rng.choices(plain, k=rng.randint(5, 80))
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(slurs) if rng.random() < 0.6 else stem + rng.choice("abcdef") + rng.choice(plain))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    return (
        spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double").repartition(3),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    got = {r.doc_id: r for r in tx.toxicity(*frames(spark, rows, labels)).collect()}
    assert len(got) == len(rows)
    truth = dict(labels)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    out = [i for i in got if got[i].held_out]
    assert sum(got[i].predicted == truth[i] for i in out) > 0.97 * len(out)
    assert all(not got[e].held_out for r in got.values() for e in r.evidence)


def test_held_out_labels_are_not_learnt(spark):
    rows, labels = corpus(400)
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    a, b = ({r.doc_id: r.score for r in tx.toxicity(*frames(spark, rows, x)).collect()} for x in (labels, turned))
    assert a == b


def test_nearest_equals_full_search():
    rng = np.random.default_rng(3)
    matrix = rng.random((30, 500)) * (rng.random((30, 500)) < 0.1)
    matrix /= np.maximum(np.sqrt((matrix**2).sum(axis=0)), 1e-12)
    n, (at, of) = matrix.shape[1], np.nonzero(matrix)
    index = tx.Index(np.arange(30, dtype=np.uint64), rng.random(30) + 1, np.arange(n), np.zeros(n), np.ones(n), (at, of, matrix[at, of]), 0.1)
    for _ in range(200):
        at = np.sort(rng.choice(30, rng.integers(1, 9), replace=False))
        q = index.vector(at, rng.integers(1, 5, len(at)))
        full = q @ matrix[at]
        without = int(rng.integers(-1, n))
        want = [i for i in np.lexsort((np.arange(n), -np.round(full, 6))) if np.round(full[i], 6) >= tx.LEAST_COSINE and i != without][:15]
        assert index.nearest(at, q, without=without)[0].tolist() == want


def plain_terms(text):
    words = [w for w in re.findall(r"[^\W_]+", text.lower())]
    return Counter([("w", w) for w in words] + [(n, w[:n]) for w in words for n in tx.STEMS if len(w) >= n])


def test_scores_equal_a_full_search_over_whole_texts(spark):
    """Cosines of whole texts under the vocabulary, by plain dictionaries over all examples; votes and levels as the index says."""
    rows, labels = corpus(500, seed=7)
    docs, marks = frames(spark, rows, labels)
    index = tx.fit(docs, marks)
    every = {i: plain_terms(t) for i, t in rows}
    names = {}
    for counts in every.values():
        for kind, w in counts:
            names.setdefault((kind, w), None)
    hashed = dict(zip([int(x) for x in index.vocabulary], range(len(index.vocabulary)), strict=True))
    for key in names:
        h = tx.terms([key[1]])[0]
        names[key] = hashed.get(int(h[0] if key[0] == "w" else h[1 + [n for n in tx.STEMS if len(key[1]) >= n].index(key[0])]))
    total = len(rows)
    have = Counter(k for counts in every.values() for k in counts)

    def vector(i):
        raw = {k: (1 + math.log(n)) * (math.log((1 + total) / (1 + have[k])) + 1) for k, n in every[i].items() if names[k] is not None}
        size = math.sqrt(sum(v * v for v in raw.values()))
        return {k: v / size for k, v in raw.items()} if size else {}

    vectors = {i: vector(i) for i in every}
    got = {r.doc_id: r for r in tx.toxicity(docs, marks).collect()}
    met = 0
    for i in every:
        cosines = [(-round(sum(v * vectors[int(e)].get(k, 0) for k, v in vectors[i].items()), 6), n) for n, e in enumerate(index.ids)]
        near = sorted(c for c in cosines if -c[0] >= tx.LEAST_COSINE)[: tx.NEIGHBOURS]
        want = index.score(np.array([n for _, n in near], int), np.array([-c for c, _ in near]))
        assert abs(got[i].score - want) < 1e-4
        met += bool(near)
    assert met > 50


def test_copied_toxic_text_is_known(spark):
    """A toxic text of words that only it has, labelled toxic on most of its copies: all copies are found, nothing else."""
    rng = random.Random(5)
    rows, labels = corpus(600)
    own = ["zq" + "".join(rng.choices("abcdefgh", k=5)) for _ in range(60)]
    base = len(rows)
    for i in range(30):
        words = list(own)
        words[i % 60] = "other"
        rows.append((base + i, " ".join(own if i % 2 else words)))
        labels.append((base + i, int(i % 7 != 0)))
    got = {r.doc_id: r for r in tx.toxicity(*frames(spark, rows, labels)).collect()}
    assert all(got[base + i].predicted for i in range(30))
    truth = dict(labels)
    assert sum(got[i].predicted and not truth[i] for i in range(base)) <= 3


def test_few_toxic_examples(spark):
    """With one or two toxic examples their copies are found."""
    rows, labels = corpus(300)
    clean = [r for r, (_, t) in zip(rows, labels, strict=True) if not t]
    free = [i for i in range(9000, 9100) if zlib.crc32(str(i).encode()) % 3 != 1]
    held = [i for i in range(9000, 9100) if zlib.crc32(str(i).encode()) % 3 == 1]
    toxic = "some text that nobody else would write about vile things and more of it"
    docs, marks = frames(spark, [*clean, (free[0], toxic), (held[0], toxic + " again")], [*((i, 0) for i, _ in clean), (free[0], 1)])
    got = {r.doc_id: r for r in tx.toxicity(docs, marks).collect()}
    assert got[free[0]].predicted and got[held[0]].predicted and sum(r.predicted for r in got.values()) == 2


def test_isotonic():
    points, levels = tx.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert levels.tolist() == [0, 0, 0.5, 0.5, 1, 1] and points.tolist() == [0.1, 0.1, 0.2, 0.3, 0.4, 0.4]


def test_greedy_terms_skip_what_copies_share():
    rows = [(i, True, 1) for i in range(10)] + [(i, True, 2) for i in range(5)] + [(i, True, 3) for i in range(8, 14)] + [(99, False, 4)]
    assert tx.chosen_terms(rows, (14, 20)) == [1, 3]
    assert tx.chosen_terms(rows, (14, 20_000)) == [1, 2, 3]


def test_copies_are_one_example():
    a, b = list(range(8)), list(range(100, 108))
    rows = [(3, 1, 30, a), (1, 1, 10, a[:4] + b[4:]), (2, 0, 20, b), (4, 0, 40, [*a[:3], 9, 9, 9, 9, 9]), (5, 1, 50, a)]
    # In turn: 1 opens; 2 shares four marks with it; 3 shares four; 4 shares three; 5 shares four.
    assert tx.grouped(rows) == {1: (1, 3, 1), 4: (0, 0, 1)}


def test_first_rows_by_turn(spark, monkeypatch):
    monkeypatch.setattr(tx, "SAMPLE", 200)
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("turn"))
    want = sorted((r.turn, r.doc_id) for r in rows.collect())[:200]
    for total in (3000, 10):
        assert sorted((r.turn, r.doc_id) for r in tx._first(rows, total).collect()) == want


def test_odd_tables(spark):
    rows, labels = corpus(300)
    rows += [(5000, None), (5001, ""), (None, "vilezz"), (3, rows[3][1]), (5002, "x " * 30_000 + "vilezz")]
    docs, marks = frames(spark, rows, [*labels, (5000, None), (None, 1)])
    got = tx.toxicity(docs, marks).collect()
    assert len(got) == len(rows)
    kept = tx.without_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got)
    assert {r.score for r in tx.toxicity(docs, marks.limit(0)).collect()} == {0.0}
    assert tx.toxicity(docs.limit(0), marks).count() == 0


def test_small_table(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    assert tx.toxicity(docs, labels).count() == docs.count()
