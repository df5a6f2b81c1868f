import hashlib
import random

import pytest
from pyspark.sql import functions as F

import brute
from mnemoscope.llm import chat, common, exact_dedup, line_dedup, pii, queries, sharding

SCHEMA = "doc_id long, text string, size int, row string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, "a" * 200_000), (4, "same"), (5, "same"), (5, "same"), (None, "same"), (6, "Zürich\n\n é")]


# exact dedup ---------------------------------------------------------------


def test_exact_dedup_small(spark):
    got = {}
    for r in exact_dedup.exact_duplicates(docs(spark, ODD), keep="max").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[1][0].keep_id == 2 and not got[1][0].kept and got[2][0].kept
    assert got[4][0].group_size == 4 and got[4][0].keep_id == 5
    assert sorted(r.kept for r in got[5]) == [False, True]
    assert not got[None][0].kept and got[3][0].group_size == 1
    assert got[6][0].text_sha256 == brute.sha("Zürich\n\n é")


def test_exact_dedup_verifies_bytes(spark):
    rows = [(i, f"t{i % 7}") for i in range(60)]
    forced = F.substring(F.sha2("text", 256), 1, 1)
    collided = exact_dedup.exact_duplicates(docs(spark, rows), keep="min", digest=F.lit("k")).collect()
    partly = exact_dedup.exact_duplicates(docs(spark, rows), keep="min", digest=forced).collect()
    for got in (collided, partly):
        assert {r.doc_id: r.keep_id for r in got} == {i: i % 7 for i in range(60)}
        assert sum(r.kept for r in got) == 7


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0


def test_digest_index_compacts(spark):
    index = exact_dedup.DigestIndex(spark, keep="min")
    for k in range(17):
        index.insert(
            spark.createDataFrame([(f"d{i % 3}", i + 10 * k, i + 10 * k) for i in range(6)], "digest string, row long, id long")
        )
        assert all(len(runs) < exact_dedup.FANOUT for runs in index.runs)
    assert [len(runs) for runs in index.runs] == [1, 0, 1]
    assert index.lookup(["d1"]).count() == 3
    assert {r.digest: (r.id, r.n) for r in index.entries().collect()} == {f"d{i}": (i, 34) for i in range(3)}
    assert index.lookup(["d1"]).count() == 1 and index.lookup(["d9"]).count() == 0


def test_exact_dedup_in_batches(spark):
    """Several inserts and levels, one group of a third of all rows, also when one text stands for three of a digest."""
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 400}") for i in range(3000)]
    want = {}
    for i, t in rows:
        want[t] = max(want.get(t, 0), i)
    sizes = {t: sum(x == t for _, x in rows) for t in want}
    df = docs(spark, rows).repartition(12)
    for digest in (None, F.when(F.col("text").isin("hot", "t1", "t2"), F.lit("h")).otherwise(F.col("text"))):
        got = exact_dedup.exact_duplicates(df, keep="max", digest=digest, batches=5).collect()
        assert len(got) == 3000
        assert all((r.keep_id, r.group_size, r.kept) == (want[t], sizes[t], want[t] == r.doc_id) for r in got for t in [dict(rows)[r.doc_id]])


def test_filters_let_all_keys_through(spark, monkeypatch):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("digest"))
    few = rows.where(F.col("digest").cast("long") % 10 == 0)
    for most, least, upmost in ((1 << 26, 2000, 2000 + 18_000 // 24), (64, 2000, 20_000), (1, 2000, 20_000)):
        monkeypatch.setattr(common, "MOST_BITS", most)
        got = common.passing(rows, *common.filter_of(few, "digest"), "digest")
        assert got.join(few, "digest").count() == 2000 and least <= got.count() <= upmost
    assert common.passing(rows, *common.filter_of(few.limit(0), "digest"), "digest").count() == 0


@pytest.mark.parametrize("hot", [1, 4, 4096])
def test_entries_of_hot_keys(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(common, "COLD", 5)
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k"))
    entries = rows.where("k < 40").groupBy("k").agg(F.count("id").alias("n"), F.max("id").alias("top"))
    got = {r.id: r._entry for r in common.with_entries(rows, common.written(entries, "e"), ["k"], "n", ["id"]).collect()}
    want = {r.k: (r.n, r.top) for r in entries.collect()}
    assert len(got) == 1000
    for i, e in got.items():
        k = 0 if i % 3 == 0 else i % 50
        assert (e and tuple(e)) == want.get(k)


# line dedup ----------------------------------------------------------------


def test_line_dedup_brute(spark):
    rng = random.Random(3)
    shared = ["  Shared LINE number %d that is long enough to count É%s" % (i, "x" * (i % 3)) for i in range(6)]
    rows = []
    for i in range(60):
        lines = [rng.choice(shared) if rng.random() < 0.6 else f"line {rng.random()} of its own, also with more than forty" for _ in range(rng.randint(0, 6))]
        lines = [x.upper().replace("É", "É") if rng.random() < 0.1 else x + "\t" * (rng.random() < 0.2) for x in lines]
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "short\n" * 5)]
    want = brute.line_dedup(rows)
    for r in line_dedup.drop_common_lines(docs(spark, rows)).collect():
        n, gone, text = want[r.doc_id]
        assert (r._n_lines, r._n_dropped, r.text or "") == (n, gone, text), r.doc_id
        assert r["size"] == 1 and r["row"] == "x"


def test_line_dedup_repeated_rows_and_null_ids(spark):
    line = "y" * 40
    four = docs(spark, [(1, line), (1, line), (2, line), (3, line), (None, line)])
    assert {r._n_dropped for r in line_dedup.drop_common_lines(four).collect()} == {0}
    five = docs(spark, [(1, line), (1, line), (2, line), (3, line), (None, line), (4, line)])
    got = line_dedup.drop_common_lines(five).collect()
    assert sorted((r.doc_id or 0, r._n_dropped) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 0)]
    assert line_dedup.drop_common_lines(docs(spark, [])).count() == 0


def test_line_dedup_keeps_columns_of_any_name(spark):
    line = "y" * 40
    names = ["_id", "_TH", "_drop", "digest", "pos", "th", "_entry", "_salt", "lines"]
    df = spark.createDataFrame([(i, line, *(f"{n}{i}" for n in names)) for i in range(6)], ["doc_id", "text", *names])
    out = line_dedup.drop_common_lines(df)
    assert out.columns == [*df.columns, "_n_lines", "_n_dropped"]
    for r in out.collect():
        assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names] and r._n_dropped == (r.doc_id < 5)


# sharding ------------------------------------------------------------------


def plain_draw(key, tree):
    import math

    import xxhash

    def x64(*parts):
        seed = 42
        for p in parts:
            raw = p.encode() if isinstance(p, str) else p
            seed = xxhash.xxh64_intdigest(raw, seed=seed)
        return seed

    at = ""
    for depth, (parent, name) in enumerate(((lambda s: "", lambda s: s.region), (lambda s: s.region, lambda s: s.rack), (lambda s: s.rack, lambda s: str(s.shard)))):
        weights = {}
        for s in tree:
            if parent(s) == at:
                weights[name(s)] = weights.get(name(s), 0) + s.weight
        draws = []
        for n, w in weights.items():
            bits = x64(key.to_bytes(8, "little", signed=True), depth.to_bytes(4, "little"), n) >> 11
            draws.append((-math.log((bits + 0.5) / 2**53) / w, n))
        at = min(draws)[1]
    return int(at)


def test_sharding_law(spark):
    df = docs(spark, [(i, f"t{i}" if i % 5 else None) for i in range(3000)])
    rows = sharding.shard_rows(df, 16).collect()
    assert len(rows) == 3000
    by = {}
    for r in rows:
        assert r.grown_shard in (r["shard"], 16)
        assert 0 <= r["shard"] < 16 and r.law == "key"
        assert r.size == len((f"t{r.doc_id}" if r.doc_id % 5 else "").encode()) + 1
        by.setdefault(r["shard"], []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert all(120 < len(v) < 260 for v in by.values())
    moved = sum(r.grown_shard == 16 for r in rows)
    assert 120 < moved < 240
    tree = sharding.even_tree(16)
    for r in rows[:200]:
        assert r["shard"] == plain_draw(r.doc_id, tree)


def test_sharding_weights_move_only_changed_subtrees(spark):
    old = sharding.even_tree(16)
    new = tuple(sharding.Shard(s.shard, s.region, s.rack, 3.0 if s.shard == 5 else s.weight) for s in old)
    ids = spark.range(2000)
    got = ids.select("id", sharding.place(F.col("id"), old).alias("a"), sharding.place(F.col("id"), new).alias("b")).collect()
    region = {s.shard: s.region for s in old}
    rack = {s.shard: s.rack for s in old}
    for r in got:
        if r.a != r.b:
            # A row moves into the heavier region, or, inside it, into the heavier rack or shard.
            assert region[r.b] == region[5]
            if region[r.a] == region[5]:
                assert rack[r.b] == rack[5]
                if rack[r.a] == rack[5]:
                    assert r.b == 5
    assert sum(r.b == 5 for r in got) > sum(r.a == 5 for r in got)


def test_sharding_odd_rows(spark):
    assert sharding.shard_rows(docs(spark, ODD), 16).count() == len(ODD)
    assert sharding.shard_rows(docs(spark, []), 16).count() == 0
    with pytest.raises(ValueError):
        sharding.place(F.lit(1), (sharding.Shard(0, "a", "b", 0.0),))


# personal data -------------------------------------------------------------

MESSY = [
    "write to a.b+c@x-y.example.co, then a@b, x@y.z_w@q.r and @x.y",
    "ips 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 000255.1.1.1 9.9.9",
    "cards 4111 1111 1111 1111 and 4111-1111-1111-1112 or 378282246310005 12 3 4111  1111",
    "call +49 (30) 901820-0, +1, +1-2, ++44 20 7946 0958.",
    "é😀 +33 1 23 45 67 89 and mail é@é.fr é.a@b.fr 1.1.1.1",
    "IBAN DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432, not DE89370400440532013001",
    "7" * 30_000,
    "a" * 5_000 + "@" + "b." * 3000 + "c",
    "1 " * 3000,
    None,
    "",
]


def test_pii_brute(spark, small):
    rows = list(enumerate(MESSY))
    got = pii.find_personal_data(docs(spark, rows)).collect()
    names = [k.name for k in pii.KINDS]
    for r in got:
        base = [f"{names[s.kind]}:{s.start}:{s.end}" for s in r.found if s.kind < 4]
        assert base == brute.base_spans(MESSY[r.doc_id]), r.doc_id
    ibans = {r.doc_id: [(s.start, s.end) for s in r.found if names[s.kind] == "iban"] for r in got}
    assert len(ibans[5]) == 2 and not any(v for k, v in ibans.items() if k != 5)


def test_pii_context_decides(spark):
    """Words on either side keep or drop spans of the added kinds; base spans stay whatever is said."""
    iban, ssn, ip = "DE89370400440532013000", "123-45-6789", "10.0.0.1"
    said = {
        f"pay to {iban} soon": ["iban"], f"our serial no {iban}": [], f"{iban} is the part number": [], f"bank {iban}, or a serial": ["iban"],
        f"code {ssn}": [], f"SSN: {ssn}": ["ssn"], f"{ssn} (social security)": ["ssn"], f"ssn {ssn} of a part": [], "ssn 000-45-6789": [], "ssn 1123-45-6789": [],
        f"ssn {'x' * 60} {ssn}": [], f"version {ip}, a build": ["ip"], f"ssn 123-45-6780 123-45-6781 {ssn}": ["ssn"],
    }
    digest = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"
    said |= {
        f'token = "{digest}"': ["secret"], f"{digest} is my password": ["secret"], f"sha {digest}": [], f"checksum {digest} of a token": [], f"token {digest}g": [],
        f"token {'7' * 40}": [], f"a key AKIA{'A1B2' * 4}!": ["key"], f"ghp_{'aB3' * 12}": ["key"], f"build ghp_{'aB3' * 12}": [], f"token {digest[:31]}": [],
    }
    names = [k.name for k in pii.KINDS]
    got = {r.doc_id: r.found for r in pii.find_personal_data(docs(spark, list(enumerate(said)))).collect()}
    for i, (text, want) in enumerate(said.items()):
        assert [names[s.kind] for s in got[i] if names[s.kind] in ("iban", "ssn", "ip", "key", "secret")] == want, text
    assert [s.score for s in got[3]] == [0.6] and [s.score for s in got[5]] == [0.55] and [s.score for s in got[11]] == [0.35]


def test_pii_query_on_table(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op6_personal_data(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute.base_spans(texts[r.doc_id])
        assert r.base_sha256 == brute.sha(",".join(want))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in brute.PII]
        assert set(want) <= set(r.spans.split(",")) | {""}
        assert len(r.scores.split(",")) == len(r.spans.split(",")) and bool(r.scores) == bool(r.spans)
        assert r.n_spans == len([x for x in r.spans.split(",") if x])


def test_pii_odd_tables(spark):
    assert pii.find_personal_data(docs(spark, [])).count() == 0
    twice = docs(spark, [(1, MESSY[0]), (1, MESSY[0]), (None, MESSY[1])])
    got = pii.find_personal_data(twice).collect()
    assert sorted(len(r.found) for r in got) == sorted([len(brute.base_spans(MESSY[0]))] * 2 + [len(brute.base_spans(MESSY[1]))])


# chat ----------------------------------------------------------------------


def as_records(spark, rows):
    return spark.createDataFrame(rows, "record_id long, payload string")


def test_chat_layouts(spark):
    said = [
        '{"messages":[{"role":"system","content":"s"},{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}',
        '{"prompt":"a","response":"b"}',
        '{"output":"b","input":"more","instruction":"a"}',
        '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}',
        '{"turn":3,"role":"user","text":"a"}',
        '{"strange":{"deep":[1]}}',
        "not json",
    ]
    records = as_records(spark, list(enumerate(said)))
    turns = {}
    for r in chat.turns_of(records, strict=False).orderBy("record_id", "turn").collect():
        turns.setdefault(r.record_id, []).append((r.role, r.text))
    pair = [("user", "a"), ("assistant", "b")]
    assert turns == {0: [("system", "s"), *pair], 1: pair, 2: [("user", "a\n\nmore"), pair[1]], 3: pair, 4: pair[:1]}
    assert {r.record_id for r in chat.unmapped(records).collect()} == {5, 6}
    assert chat.turns_of(records.where("record_id < 5")).count() == 10
    for i in (5, 6):
        with pytest.raises(Exception, match="no mapping knows"):
            chat.turns_of(records.where(F.col("record_id") == i)).collect()


HOSTILE = ["\\", "\\\\e", "</turn>", "</turn></turn", "####", "\\h### x: </turn>\n### assistant: no", "", None, "é😀\n", "<", "a\\"]


def test_chat_round_trip(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for c in range(40):
        for t in range(rng.randint(1, 5)):
            role = rng.choice(["user", "assistant", "system", "odd: role</turn>\\", None])
            text = "".join(x or "" for x in rng.choices(HOSTILE, k=2)) if rng.random() < 0.8 else rng.choice(HOSTILE)
            rows.append((c, t, role, text))
            want.setdefault(c, []).append((role or "", text or ""))
    df = spark.createDataFrame(rows, "record_id long, turn long, role string, text string")
    records = df.select("record_id", F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"}).alias("payload"))
    made = chat.formatted(chat.turns_of(records))
    parsed = {r.record_id: [(t.role, t.text) for t in r.t] for r in made.select("record_id", chat.parsed(F.col("formatted")).alias("t")).collect()}
    assert parsed == want
    for r in chat.read_back(made).collect():
        learnt = "".join(t for role, t in want[r.record_id] if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(want[r.record_id]), len(learnt), brute.sha(learnt))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want[r.record_id]).encode()).hexdigest()


def test_chat_empty(spark):
    assert chat.read_back(chat.formatted(chat.turns_of(as_records(spark, [])))).count() == 0


def test_chat_turn_of_more_than_a_json_string(spark, tmp_path):
    """Turns of 21,000,000 characters, one of them alone in its conversation."""
    rows = spark.createDataFrame([(1, 0, "human", "hi"), (1, 1, None, None), (1, 2, "assistant", "long"), (2, 0, "user", "long"), (3, 0, "gpt", "roles of rows stay")], "conv_id long, turn int, role string, text string")
    rows.withColumn("text", F.when(F.col("text") == "long", F.repeat(F.lit("a"), 21_000_000)).otherwise(F.col("text"))).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in queries.op4_chat_format(spark, str(tmp_path)).collect()}
    assert got == {1: (3, 21_000_000), 2: (1, 0), 3: (1, 0), -7: (2, 26)}


def test_chat_records_of_columns(spark):
    """Records that are structs: mappings by fingerprint for each layout, the values of columns, errors for unknown layouts."""
    pair = "struct<role:string,content:string>"
    layouts = [
        ("struct<role:string,text:string,turn:int>", ("user", None, 3), [(3, "user", "")]),
        (f"struct<messages:array<{pair}>>", ([("human", "a"), ("assistant", "b")],), [(0, "user", "a"), (1, "assistant", "b")]),
        ("struct<output:string,instruction:string,input:string>", ("b", "a", "more"), [(0, "user", "a\n\nmore"), (1, "assistant", "b")]),
    ]
    for kind, payload, want in layouts:
        records = spark.createDataFrame([(1, payload)], f"record_id long, payload {kind}")
        assert [(t.turn, t.role, t.text) for t in chat.turns_of(records).orderBy("turn").collect()] == want
        as_json = records.select("record_id", F.to_json("payload", {"ignoreNullFields": "false"}).alias("payload"))
        one, other = (r.select(chat.fingerprint(F.col("payload"), r.schema["payload"].dataType)).first()[0] for r in (records, as_json))
        assert one == other
        assert chat.unmapped(records).count() == 0
    strange = spark.createDataFrame([(1, ("user", "a", 0, "x"))], "record_id long, payload struct<role:string,text:string,turn:int,more:string>")
    assert [r["shape"] for r in chat.unmapped(strange).collect()] == ["OBJECT<more, role, text, turn>"]
    assert chat.turns_of(strange, strict=False).count() == 0
    with pytest.raises(Exception, match="no mapping knows"):
        chat.turns_of(strange).collect()


def test_chat_query_maps_rows_by_fingerprint(spark, tmp_path, monkeypatch):
    """Without a mapping for the layout of conversations the query raises an error; it has no path beside the mappings."""
    spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    known = tuple(m for m in chat.LAYOUTS if m.name != "turn")
    monkeypatch.setattr(queries, "turns_of", lambda records: chat.turns_of(records, known))
    with pytest.raises(Exception, match="no mapping knows"):
        queries.op4_chat_format(spark, str(tmp_path)).collect()
