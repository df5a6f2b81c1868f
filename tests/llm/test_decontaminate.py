import random

import numpy as np

from mnemoscope.llm import decontaminate as dc

REAL = dc.windows


def plain_words(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def plain_coverage(text, item, least=5):
    """Greedy string tiling by comparing every pair of places; of runs of one length the first in the text, then in the item."""
    a, b = plain_words(text), plain_words(item)
    least = min(least, len(b))
    used_a, used_b = [False] * len(a), [False] * len(b)
    where = {}
    for j, w in enumerate(b):
        where.setdefault(w, []).append(j)
    while b:
        best = (least - 1, 0, 0)
        for i in range(len(a)):
            for j in where.get(a[i], ()):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return sum(used_b) / len(b)
        for k in range(n):
            used_a[i + k] = used_b[j + k] = True
    return 0.0


def frames(spark, docs, items):
    return (
        spark.createDataFrame(docs, "doc_id long, text string").repartition(2),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def cases(rng, count):
    vocabulary = ["w%d" % i for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 40)))) for i in range(16)]
    docs = []
    for i in range(count):
        parts = []
        for _ in range(rng.randint(0, 4)):
            own = rng.choice(items)[1].split()
            a = rng.randrange(len(own))
            parts.append(own[a : a + rng.randint(3, 25)])
            parts.append(rng.choices(vocabulary, k=rng.randint(0, 12)))
        rng.shuffle(parts)
        docs.append((i, ". ".join(" ".join(p) for p in parts).upper() if i % 3 else " ".join(" ".join(p) for p in parts)))
    return docs, items


def test_tiling_brute(spark):
    docs, items = cases(random.Random(6), 120)
    docs += [(1000, None), (1001, ""), (1002, "w1 " * 4_000), (1003, "w1 w2 w3 w1 w2 w3 w1 " * 60)]
    items += [(100, "w1 " * 20), (101, "w1 w2 w3 " * 6), (102, "w7"), (103, "w8 w9"), (104, "w1 w1 w2"), (105, "w1 w2 w3 w1"), (106, "")]
    got = {(r.doc_id, r.item_id): r.coverage for r in dc.contaminated(*frames(spark, docs, items)).collect()}
    want = {(d, i): c for d, t in docs for i, x in items if (c := plain_coverage(t, x)) >= 0.5}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert any(len(plain_words(dict(items)[i])) < 5 for _, i in want)


def test_bytes_decide(spark, monkeypatch):
    """The same tiles when all words have one hash, and no tile of words that only hash alike."""
    docs, items = cases(random.Random(9), 40)
    want = {(d, i) for d, t in docs for i, x in items if plain_coverage(t, x) >= 0.5}
    few = [(t, i) for t, i in want][:3]
    for d, i in few:
        piece = [dict(docs)[d]]
        monkeypatch.setattr(dc, "windows", lambda h, of, n: (w[0] & np.uint64(1), w[1]) if (w := REAL(h, of, n)) else None)
        block = dc.Items([i], [dict(items)[i]])
        made = dc.hits(piece, block, 0.5)
        assert all(coverage <= plain_coverage(piece[0], dict(items)[i]) + 1e-12 for _, _, coverage, _, _ in made)
        monkeypatch.undo()


def test_reordered_passages(spark):
    item = "one two three four five six. seven eight nine ten eleven twelve. red green blue black white pink"
    turned = "x y z. Red green blue black white pink; and SEVEN eight nine ten eleven twelve; one two three four five six!"
    clean = "one two three four x five six seven eight y nine ten eleven z twelve red w green blue"
    docs, items = frames(spark, [(1, turned), (2, clean), (3, f"{'pad ' * 5000}{item}")], [(7, item)])
    got = {r.doc_id: r for r in dc.contaminated(docs, items).collect()}
    assert set(got) == {1, 3} and got[1].coverage == 1.0 and got[1].tiles == 3 and got[3].tiles == 1
    kept = dc.without_contaminated(docs, items)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]


def test_blocks_of_benchmark(spark, monkeypatch):
    docs, items = frames(spark, *cases(random.Random(3), 40))
    whole = sorted(tuple(r) for r in dc.contaminated(docs, items).collect())
    monkeypatch.setattr(dc, "BLOCK_BYTES", 300)
    assert sorted(tuple(r) for r in dc.contaminated(docs, items).collect()) == whole and whole


def test_odd_tables(spark):
    docs, items = frames(spark, [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e")], [(1, "a b c d e"), (1, "a b c d e"), (2, None), (3, "a b")])
    got = dc.contaminated(docs, items).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in got) == sorted([(0, 1), (0, 1), (0, 3), (1, 1), (1, 1), (1, 1), (1, 1), (1, 3), (1, 3)])
    assert dc.contaminated(docs, items.limit(0)).count() == 0
    assert dc.contaminated(docs.limit(0), items).count() == 0
    assert dc.without_contaminated(docs, items.limit(0)).count() == 3
    clashing = docs.selectExpr("doc_id", "text", "'x' AS item_id", "1 AS coverage", "2 AS id", "3 AS tiles")
    assert len(dc.contaminated(clashing, items).collect()) == 9
    assert dc.without_contaminated(clashing, items).columns == clashing.columns
