import itertools
import random

from pyspark.sql import functions as F

from mnemoscope.llm import packing


def plain_padding(histogram, ends):
    total = 0
    for b, r in histogram:
        total += (min(e for e in ends if e >= b) - b) * r
    return total


def least_padding(histogram, buckets):
    """By the plain table over all splits."""
    best = [0] + [float("inf")] * len(histogram)
    for _ in range(buckets):
        now = list(best)
        for j in range(1, len(best)):
            for i in range(j):
                cost = sum((histogram[j - 1][0] - b) * r for b, r in histogram[i:j])
                now[j] = min(now[j], best[i] + cost)
        best = now
    return best[-1]


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(200):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        histogram = [(x, rng.randint(1, 30)) for x in lengths]
        buckets = rng.randint(1, 5)
        got = packing.boundaries(histogram, buckets)
        assert len(got) <= buckets and got[-1] == lengths[-1]
        best = min(
            plain_padding(histogram, [*c, lengths[-1]])
            for k in range(min(buckets, len(lengths)))
            for c in itertools.combinations(lengths[:-1], k)
        )
        assert plain_padding(histogram, got) == best
    assert packing.boundaries([], 4) == []


def test_long_lengths_are_exact(spark):
    """Lengths far above 4,096, close to each other: the padding is least, and no boundary is a rounded one."""
    rng = random.Random(4)
    lengths = sorted({*rng.sample(range(4097, 4400), 14), *rng.sample(range(100_000, 100_200), 8), 1_000_003})
    histogram = [(x, rng.randint(1, 3)) for x in lengths]
    for buckets in (1, 3, 7):
        assert plain_padding(histogram, packing.boundaries(histogram, buckets)) == least_padding(histogram, buckets)
    rows = [(1000 * x + i, x) for x, n in histogram for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, n long").withColumn("text", F.lit(""))
    got = packing.packed(df, buckets=5, length=F.col("n")).collect()
    assert sum(r.padding for r in got) == least_padding(histogram, 5)
    assert {r.bucket_len for r in got} <= set(lengths)
    held(got, packing.BUDGET)


def held(rows, budget):
    batches = {}
    for r in rows:
        assert r.padding == r.bucket_len - r.n_tokens >= 0
        batches.setdefault((r.bucket, r.bucket_len, r.batch), []).append(r.place)
    last = {}
    for (bucket, _, batch) in batches:
        last[bucket] = max(last.get(bucket, 0), batch)
    for (bucket, size, batch), places in batches.items():
        fits = max(1, budget // size)
        assert sorted(places) == list(range(len(places)))
        assert len(places) == fits or batch == last[bucket] and len(places) < fits
    for bucket, top in last.items():
        assert {b for k, _, b in batches if k == bucket} == set(range(top + 1))


def test_packed_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.packed(docs, budget=2000, buckets=6).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.n_tokens == len(texts[r.doc_id].split()) + 1 for r in rows)
    assert len({r.bucket_len for r in rows}) <= 6
    held(rows, 2000)
    one = packing.packed(docs, budget=2000, buckets=1).agg(F.sum("padding")).first()[0]
    assert sum(r.padding for r in rows) < one / 2


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "w " * 50_000)]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, bucket int")
    got = packing.packed(df, budget=100).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 1, 3, 50_001]
    held(got, 100)
    assert packing.packed(df.limit(0)).count() == 0


def test_lengths_by_a_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, None), (2, "some words, and more"), (3, "日本語のテキスト" * 50), (4, "x" * 3000)]
    counted = packing.with_token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path, into="ids")
    want = {i: len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows}
    assert {r.doc_id: r.ids for r in counted.collect()} == want
    got = packing.packed(counted, length=F.col("ids")).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    held(got, packing.BUDGET)
