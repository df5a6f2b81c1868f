import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mnemoscope.llm import token_store as ts
from mnemoscope.llm import tokens
from mnemoscope.llm.textvec import range_hashes
from mnemoscope.llm.tokens import Encoder

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
ODD = [*"ab'stmdrevl  \n\t 1²½é́!.😀日_-ß\x1c\x85　\xa0", "'s", "'re", "'ll", "'ve", "  ", "\n\n", "<|endoftext|>"]


def test_encoder_equals_library():
    rng = random.Random(2)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 40))) for _ in range(6000)]
    encoder, plain = Encoder(PATH), Tokenizer.from_file(PATH)
    assert encoder.by_word
    want = plain.encode_batch(texts, add_special_tokens=False)
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == [e.ids for e in want]
    words = Encoder(str(public_tokenizers.path("word_bpe_49k.json")))
    assert not words.by_word
    assert words.encode(["Some Text"])[0].tolist() == Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))).encode("Some Text", add_special_tokens=False).ids


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate({97: "b", 98: "a"})
    return word


def test_words_are_told_apart_by_their_bytes(monkeypatch):
    """Also words whose hashes a polynomial modulo 2**64 can't tell apart, long ones, and when all hashes collide."""
    word = thue_morse(2048)
    other = word.translate({97: "b", 98: "a"})
    texts = [word, other, f"{word} {other}", "x" * 50_000, "x" * 50_001, "日本語" * 400, "日本語" * 400 + "本", "a aa aaa b bb ab ba"]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in Encoder(PATH).encode(texts)] == want
    rng = random.Random(3)
    some = [" ".join("".join(rng.choices("abcd", k=rng.randint(1, 5))) for _ in range(300)) for _ in range(6)] + texts
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(some, add_special_tokens=False)]
    for bits in (0, 3):
        few = np.uint64((1 << bits) - 1)
        monkeypatch.setattr(tokens, "range_hashes", lambda *x, few=few: range_hashes(*x) & few)
        encoder = Encoder(PATH)
        for t, ids in [*zip(some, want, strict=True), *zip(some, want, strict=True)]:
            assert encoder.encode([t])[0].tolist() == ids
        assert encoder.twins


def test_forgetting_words(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcde", k=rng.randint(1, 9))) for _ in range(40)) for _ in range(30)]
    encoder, plain = Encoder(PATH), Tokenizer.from_file(PATH)
    for t in texts:
        assert encoder.encode([t])[0].tolist() == plain.encode(t, add_special_tokens=False).ids


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 50_000, 20_000).astype(np.uint32)
    b = np.concatenate([a[:500], rng.integers(0, 50_000, 7).astype(np.uint32), a[500:]])
    both = np.concatenate([a, b])
    ends = ts.cuts(both, np.array([0, len(a), len(both)]))
    chunks = [{x.tobytes() for x in np.split(d, np.array(e[:-1]) - o)} for d, e, o in ((a, ends[0], 0), (b, ends[1], len(a)))]
    assert len(chunks[0] & chunks[1]) > 0.8 * len(chunks[0])
    sizes = np.diff([0, *ends[0]])
    assert sizes.max() <= ts.MOST and sizes[:-1].min() >= ts.LEAST
    assert ts.cuts(np.zeros(1, np.uint32), np.array([0, 1])) == [[1]]


def test_shifted_checksums():
    parts = [bytes(random.Random(i).randbytes(n)) for i, n in enumerate((5, 1, 1000, 0, 77))]
    total = 0
    for i, p in enumerate(parts):
        after = sum(map(len, parts[i + 1 :]))
        total ^= int(ts.shifted(np.array([zlib.crc32(p)]), np.array([after]))[0])
    assert total == zlib.crc32(b"".join(parts))


def expected(rows):
    plain, start, out = Tokenizer.from_file(PATH), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_store_round_trip(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = ts.tokens_stored(docs.repartition(3), PATH, path=f"file://{tmp_path}/store")
    assert sorted(tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == expected(rows)
    objects = spark.read.parquet(f"file://{tmp_path}/store/objects").where("kind = 'chunk'")
    assert objects.count() == objects.select("name").distinct().count()


def test_store_odd_rows(spark):
    rows = [(5, None), (3, ""), (None, "x y"), (4, "same text"), (2, "same text"), (1, "word " * 30_000)]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, name string").repartition(2)
    got = ts.tokens_stored(df, PATH).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == expected(rows)
    twice = spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted(r.start for r in ts.tokens_stored(twice, PATH).collect()) == [0, 2]
    assert ts.tokens_stored(df.limit(0), PATH).count() == 0


PARTS = ("objects", "recipes", "manifest")


def copied(spark, at, to, part=None, change=None):
    """The store at ``at`` written again to ``to``, one of its parts changed."""
    for p in PARTS:
        df = spark.read.parquet(f"{at}/{p}")
        df = change(df) if p == part else df
        (df.write if p == "manifest" else df.write.partitionBy("kind")).parquet(f"{to}/{p}")
    return to


def test_store_notices_damage(spark, tmp_path):
    texts = [" ".join(random.Random(i).choices("some few words for a text of many chunks".split(), k=400 * i)) for i in range(1, 9)]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    at = f"file://{tmp_path}/a"
    ts.write_store(df, at, PATH)
    assert ts.read_store(spark, copied(spark, at, f"file://{tmp_path}/same")).count() == 8
    first = F.col("doc_id") == 1
    turned = F.concat(F.expr("substring(chunks, 37, 36)"), F.expr("substring(chunks, 1, 36)"), F.expr("substring(chunks, 73)"))
    damage = (
        ("objects", lambda d: d.withColumn("body", F.when(F.col("kind") == "chunk", F.lit(b"\x01\x00")).otherwise(F.col("body"))), "name says"),
        ("objects", lambda d: d.where((F.col("kind") != "chunk") | (F.col("n") < 100)), "missing"),
        ("recipes", lambda d: d.where(~first | F.col("doc_id").isNull()), "out of place|manifest"),
        ("recipes", lambda d: d.where(F.coalesce(F.col("doc_id"), F.lit(0)) != 8), "manifest"),
        ("recipes", lambda d: d.withColumn("chunks", F.when(F.col("doc_id") == 8, turned).otherwise(F.col("chunks"))), "make its root"),
        ("recipes", lambda d: d.withColumn("root", F.when(F.col("doc_id") == 8, F.lit(bytes(32))).otherwise(F.col("root"))), "root|manifest"),
        ("recipes", lambda d: d.withColumn("root", F.when(F.col("kind") == "manifest", F.lit(bytes(32))).otherwise(F.col("root"))), "root of the store"),
        ("manifest", lambda d: d.withColumn("documents", F.lit(9).cast("long")), "root of the store"),
    )
    for i, (part, change, said) in enumerate(damage):
        with pytest.raises(Exception, match=said):
            ts.read_store(spark, copied(spark, at, f"file://{tmp_path}/b{i}", part, change)).collect()


def test_ids_must_fit(spark):
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    with pytest.raises(Exception, match="doesn't fit"):
        ts.write_store(df, ts.scratch(spark, "narrow"), PATH, width=1)
