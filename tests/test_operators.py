from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoscope.functions import governance as G
from mnemoscope.functions import strings as S
from mnemoscope.functions import temporal as T
from mnemoscope.functions import vectors as V
from mnemoscope.operators import graph, lifecycle, logs, records, retrieval, text, vectors
from mnemoscope.sources import ingest, transforms
from mnemoscope.sources.catalog import Catalog
from mnemoscope.streaming import windows

EDGE = "edge_store string, edge_id long, source_kind string, source_id long, rel string, target_kind string, target_id long"


def diamond(spark):
    """A to B and C, both to E, A to D, and E back to A."""
    raw = [("memory", 1, "derived_from", "fact", 2), ("memory", 1, "derived_from", "fact", 3), ("memory", 1, "part_of", "episode", 4), ("fact", 2, "supports", "memory", 5), ("fact", 3, "supports", "memory", 5), ("memory", 5, "derived_from", "memory", 1)]
    return spark.createDataFrame([("t", i, *r) for i, r in enumerate(raw)], EDGE)


def test_walks(spark):
    e = diamond(spark)
    walk = {(r.depth, r.path) for r in graph.walk(e, "memory:1", 4, "out").collect()}
    assert (2, "memory:1>fact:2>memory:5") in walk and (2, "memory:1>fact:3>memory:5") in walk
    assert all(len(set(p.split(">"))) == len(p.split(">")) for _, p in walk) and max(d for d, _ in walk) == 2
    assert [r.depth for r in graph.paths(e, "memory:1", "memory:5").collect()] == [2, 2]
    assert {r.node for r in graph.neighbors(e, "memory:1", "in").collect()} == {"memory:5"}
    assert {r.node for r in graph.neighbors(e, "memory:1", "out", ["part_of"]).collect()} == {"episode:4"}
    assert {r.node: r.depth for r in graph.reachable(e, "memory:1", 3).collect()} == {"memory:1": 0, "fact:2": 1, "fact:3": 1, "episode:4": 1, "memory:5": 1}
    graph_pushed = graph.PUSHED
    try:
        graph.PUSHED = 1
        assert {(r.depth, r.path) for r in graph.walk(e, "memory:1", 4, "out").collect()} == walk
    finally:
        graph.PUSHED = graph_pushed
    tree = spark.createDataFrame([("a", None, 1), ("b", "a", 2), ("c", "a", 1), ("d", "c", 5), ("x", None, 9)], "node string, parent string, ordinal long")
    assert graph.subtree_json(tree, "a", 2).first().subtree == '{"node":"a","children":[{"node":"c","children":[{"node":"d","children":[]}]},{"node":"b","children":[]}]}'
    assert {r.node: (r.root, r.depth) for r in graph.roots(tree, 5).collect()} == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 1), "d": ("a", 2), "x": ("x", 0)}
    down = graph.descend(tree, (F.col("node") == "b").cast("int"), 3)
    assert [r.node for r in down.orderBy("depth").collect()] == ["a", "b"]
    assert [r.path for r in graph.ordered(graph.walk(e, "memory:1", 2, "out"), "dfs").limit(2).collect()] == ["memory:1>episode:4", "memory:1>fact:2"]
    loop = spark.createDataFrame([("t", 1, "fact", 1, "x", "fact", 1)], EDGE)
    assert graph.degree(loop).first().total == 2
    with pytest.raises(ValueError):
        graph.neighbors(e, "memory:1", "sideways")
    with pytest.raises(ValueError):
        graph.walk(e, "memory:1", 33)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = df.select(V.cosine_distance(F.col("a"), F.col("b")).alias("c"), V.l2_squared(F.col("a"), F.col("b")).alias("l"), V.normalized(F.col("b")).alias("n")).collect()
    assert [(r.c, r.l) for r in got] == [(1.0, 5.0), (1.0, 2.0)] and got[0].n == [0.0, 1.0]
    with pytest.raises(ValueError):
        V.distance("other", F.col("a"), F.col("b"))
    with pytest.raises(ValueError):
        vectors.tag_search(df, F.col("a"), 1, [])
    rows = [(1, 1, None), (2, 1, [1.0]), (3, 1, [1.0, 0.0]), (4, 1, [0.0, 1.0])]
    mixed = spark.createDataFrame(rows, "chunk_id long, compartment_id long, embedding array<float>")
    q = vectors.query_vector([1.0, 0.0])
    for metric in ("cosine", "l2", "ip"):
        best = vectors.exact_topk(mixed.where("chunk_id <> 2"), q, 5, metric).collect()
        assert [(r.chunk_id, r.rank_no) for r in best] == [(3, 1), (4, 2)]
        with pytest.raises(Exception, match="vectors of 1 and 2 elements"):
            vectors.exact_topk(mixed, q, 5, metric).collect()
    assert vectors.exact_topk(mixed.where("chunk_id > 2"), q, 1).first().similarity == 1.0
    assert vectors.unit([3.0, 4.0]) == [0.6, 0.8] and vectors.unit([0.0]) == [0.0]
    stones = vectors.forgotten(spark.createDataFrame([(4,)], "chunk_id long"), mixed, spark.createDataFrame([(3,), (3,), (9,)], "chunk_id long"))
    assert {r.chunk_id for r in stones.collect()} == {3, 4}
    with pytest.raises(ValueError):
        vectors.memory_search(mixed, mixed, None, subject="s")
    with pytest.raises(ValueError):
        vectors.tagged(mixed, "default")


@pytest.mark.parametrize("block", [3, 1000])
def test_knn_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(2)
    points = np.round(rng.normal(size=(40, 4)), 1)
    points[7] = points[8]
    rows = [(int(i) * 3, int(i) % 2, [float(x) for x in v]) for i, v in enumerate(points)] + [(999, 0, None)]
    df = spark.createDataFrame(rows, "chunk_id long, compartment_id long, embedding array<double>")
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    sims = np.minimum(1.0, np.round(unit @ unit.T, 6))
    want = set()
    for i in range(40):
        near = sorted((-sims[i, j], j * 3) for j in range(40) if j != i and j % 2 == i % 2 and sims[i, j] >= 0.2)[:4]
        want |= {(i * 3, j, -s, n + 1) for n, (s, j) in enumerate(near)}
    got = {(r.source_id, r.target_id, round(r.similarity, 6), r.rank_no) for r in vectors.knn_edges(df, 4, 0.2).collect()}
    assert got == {(a, b, round(float(s), 6), n) for a, b, s, n in want}


def test_cells_on_disk(spark, small, tmp_path):
    c = Catalog(spark, small)
    index = vectors.CellIndex(c.chunks().where("chunk_id % 2 = 0")).write(f"file://{tmp_path}/cells")
    index.added(c.chunks().where("chunk_id % 2 = 1"))
    again = spark.read.parquet(index.path)
    assert again.count() == c.chunks().count()
    stones = again.select("chunk_id").where("chunk_id < 50")
    query = c.chunks().where("chunk_id = 1").first().embedding
    assert all(r.chunk_id >= 50 for r in index.search(query, 5, tombstones=stones).collect())


def test_approximate_recall(spark, small):
    c = Catalog(spark, small)
    index = vectors.CellIndex(c.chunks())
    found = total = 0
    for r in c.chunks().where("chunk_id % 100 = 0").collect():
        exact = {x.chunk_id for x in vectors.exact_topk(c.chunks(), vectors.query_vector(r.embedding), 10).collect()}
        found += len(exact & {x.chunk_id for x in index.search(r.embedding, 10).collect()})
        total += len(exact)
    assert found >= 0.9 * total


def test_lifecycle(spark):
    facts = spark.createDataFrame(
        [(1, 7, "v", 1.0, datetime(2025, 1, 1), datetime(2025, 6, 30), None, "active"), (2, 7, "v", 2.0, datetime(2025, 5, 1), None, None, "active")],
        "fact_id long, subject_id long, verb string, object_value double, valid_from timestamp, valid_to timestamp, supersedes long, lifecycle_state string",
    )
    at = lifecycle.at_time
    ids = lambda df: sorted(r.fact_id for r in df.collect())
    assert ids(lifecycle.as_of(facts, at("2024-12-31"))) == [] and ids(lifecycle.as_of(facts, at("2025-01-01"))) == [1]
    assert ids(lifecycle.as_of(facts, at("2025-06-30"))) == [2]
    assert ids(lifecycle.overlapping(facts)) == [2]
    fixes = spark.createDataFrame([(1, 10, 5.0)], "fact_id long, new_fact_id long, object_value double")
    fixed = {r.fact_id: r for r in lifecycle.corrected(facts, fixes, at("2025-03-01")).collect()}
    assert fixed[1].lifecycle_state == "superseded" and fixed[1].valid_to == datetime(2025, 3, 1)
    assert fixed[10].supersedes == 1 and fixed[10].object_value == 5.0 and fixed[10].verb == "v"
    gone = lifecycle.retracted(facts, spark.createDataFrame([(1, "wrong")], "fact_id long, reason string"), at("2025-03-01"))
    assert {r.fact_id: r.lifecycle_state for r in gone.collect()} == {1: "retired", 2: "active"}
    for blank in (" ", "", None):
        with pytest.raises(Exception, match="needs a reason"):
            lifecycle.retracted(facts, spark.createDataFrame([(2, blank)], "fact_id long, reason string"), at("2025-03-01")).collect()
    back = {r.fact_id: r for r in lifecycle.reopened(gone, spark.createDataFrame([(1,)], "fact_id long")).collect()}
    assert back[1].valid_to is None and back[1].lifecycle_state == "active" and len(back) == 2
    faults = lifecycle.correction_faults(gone, spark.createDataFrame([(1,), (2,), (7,)], "fact_id long"))
    assert {r.fact_id: r.reason for r in faults.collect()} == {1: "not active", 7: "unknown fact"}
    assert ids(lifecycle.current(facts, at("2025-05-15"))) == [1, 2]
    replay = {m: lifecycle.replayed(facts, m, at("2025-05-15")).first() for m in lifecycle.MODES}
    assert all(r.hidden == 0 and r.steps.count("fact_id") == 2 for r in replay.values())
    before = lifecycle.replayed(facts, "historical", at("2025-02-01")).first()
    assert before.later_changes == 1 and before.hidden == 0 and before.steps.count("fact_id") == 1
    scores = spark.createDataFrame([(1, "supporting_facts", 0.9), (1, "source_diversity", 0.6), (1, "claim_consistency", 0.95), (2, "recency", 0.5)], "target_id long, category string, subscore double")
    weights = spark.createDataFrame([("supporting_facts", 0.2, True), ("source_diversity", 0.15, True), ("claim_consistency", 0.15, True), ("recency", 0.0, True)], "category string, weight double, enabled boolean")
    assert {r.target_id: r.confidence for r in lifecycle.confidence(scores, weights).collect()} == {1: 0.825, 2: None}
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    put = lifecycle.upserted(base, spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), ["k"])
    assert {r.k: r.v for r in put.collect()} == {1: "a", 2: "c", 3: "d"}
    twice = spark.createDataFrame([(2, "c"), (2, "z"), (2, None)], "k long, v string")
    assert {r.k: r.v for r in lifecycle.upserted(base, twice, ["k"], "v").collect()} == {1: "a", 2: "z"} and lifecycle.upserted(base, twice, ["k"]).count() == 2


def test_logs(spark):
    moves = spark.createDataFrame([("s", "ok", "a", 2), ("s", "exception:*", "b", 1), ("s", "default", "c", 0)], "state string, on string, to_state string, ordinal int")
    runs = spark.createDataFrame([(1, "s", "ok"), (2, "s", "exception:io"), (3, "s", "odd")], "run_id int, state string, outcome string")
    assert {r.run_id: r.next_state for r in logs.next_state(moves, runs).collect()} == {1: "a", 2: "b", 3: "c"}
    cursors = spark.createDataFrame([("x", 5), ("y", 5)], "consumer string, cursor long")
    acks = spark.createDataFrame([("x", 3), ("x", 9)], "consumer string, event_id long")
    assert {r.consumer: r.cursor for r in logs.acknowledged(cursors, acks).collect()} == {"x": 9, "y": 5}
    jobs = spark.createDataFrame([(1, 1, "ready", 0, None, None, "p")], "job_id long, queue_id long, status string, attempts int, visible_at timestamp, last_error string, payload string")
    queues = spark.createDataFrame([(1, 2, None)], "queue_id long, max_retries int, dlq_queue_id long")
    with pytest.raises(Exception, match="isn't leased"):
        logs.nacked(jobs, spark.createDataFrame([(1, "e")], "job_id long, error string"), queues, lifecycle.at_time("2024-01-01"))[0].collect()
    odd = spark.createDataFrame([('a"b\\c\nd', 2)], "value string, n long")
    assert logs.prometheus(odd, "m", "k").first().line == 'm{k="a\\"b\\\\c\\nd"} 2'
    events = spark.createDataFrame([(1, "x", None, "p", 1), (2, "x", 5, "q", 1), (3, "x", 6, "p", 2)], "event_id long, event_type string, user_id long, partition string, pool long")
    assert [r.event_id for r in logs.fetch_batch(events, 0, None, 9, account=5).collect()] == [1, 2]
    assert [r.event_id for r in logs.fetch_batch(events, 0, None, 9, partition="p", pool=2).collect()] == [3]


OUTLINE = "# One\ntext\n```\n# not a heading\n```\n## Two\n### Three\n## Four\n# Five\nend"


def test_text(spark):
    docs = spark.createDataFrame([(1, OUTLINE), (2, "no headings\nhere")], "doc_id long, text string")
    got = {(r.doc_id, r.title): (r.level, r.first_line, r.last_line) for r in text.outline(docs).collect()}
    assert got == {(1, "One"): (0, 0, 7), (1, "Two"): (1, 5, 6), (1, "Three"): (2, 6, 6), (1, "Four"): (1, 7, 7), (1, "Five"): (0, 8, 9), (2, ""): (0, 0, 1)}
    fenced = "~~~\n# in\n```\n# in too\n~~~\n# Out\n   ```\n~~~\n# in\n```\n## Last\n"
    got = [(r.title, r.level, r.first_line, r.last_line) for r in text.outline(spark.createDataFrame([(1, fenced), (2, None)], "doc_id long, text string")).collect()]
    assert sorted(got) == [("", 0, 0, 0), ("Last", 1, 10, 11), ("Out", 0, 5, 11)]
    chat = spark.createDataFrame([(1, 0, "a")], "conv_id int, turn int, text string")
    more = spark.createDataFrame([(1, 0, "b"), (1, 1, "c"), (1, 1, "c")], "conv_id int, turn int, text string")
    once = text.appended(chat, more)
    assert {(r.turn, r.text) for r in once.collect()} == {(0, "a"), (1, "c")} and text.appended(once, more).count() == 2
    branched = spark.createDataFrame([(1, 0, "user", "a", None), (1, 1, "user", "b", "new"), (1, 2, "assistant", "c", None)], "conv_id int, turn int, role string, text string, topic_branch string")
    assert [r.topic_no for r in text.chat_topics(branched).orderBy("turn").collect()] == [1, 2, 2]
    named = text.outline(spark.createDataFrame([(1, "a\n# H")], "doc_id int, text string"), first=1).first()
    assert (named.title, named.first_line, named.last_line) == ("H", 2, 2)
    assert text.outline(spark.createDataFrame([(1, "a")], "doc_id int, text string"), 1, "whole").first().title == "whole"
    with pytest.raises(ValueError):
        text.notes_about(docs, docs, docs, docs, [" "])
    skills = spark.createDataFrame([(1, "a", "b", ["K"], "t"), (2, "z", "b", [], "")], "skill_id int, subject string, verb string, keywords array<string>, text string")
    assert {r.skill_id: (r.score, r.reasons) for r in text.skill_scores(skills, "A", "b", "k", None).collect()} == {1: (220, "subject,verb,keyword"), 2: (80, "verb")}
    assert text.skill_scores(skills, None, None, None, None).count() == 2


def plain_web(query, title, body):
    import re

    cut = lambda t: re.findall("[a-z0-9_]+", (t or "").lower())
    fields = cut(title), cut(body)
    count = lambda term, f: sum(f[i : i + len(term)] == list(term) for i in range(len(f)))
    alternatives = text.web_query(query).alternatives
    if not any(all(sum(count(t, f) for f in fields) for t in yes) and not any(sum(count(t, f) for f in fields) for t in no) for yes, no in alternatives):
        return None
    terms = {t for yes, _ in alternatives for t in yes}
    return round(sum(1.0 * count(t, fields[0]) + 0.4 * count(t, fields[1]) for t in terms) / sum(map(len, fields)), 6)


def test_web_search(spark):
    assert text.web_query('a "b c" -d or e -"f g" "').alternatives == (((("a",), ("b", "c")), (("d",),)), ((("e",),), (("f", "g"),)))
    assert text.web_query('-a or ""').alternatives == () and text.web_search(spark.range(1), "-a") is None
    docs = [("Pool", "the pool is exhausted"), (None, "a pooling of pools"), ("cap", None), ("x", "pool cap, exhausted; pool"), ("is exhausted", "not pool"), ("Pool_x", "pool-x"), ("", "")]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "n int, title string, body string")
    for query in ("pool", "pool exhausted", '"is exhausted"', '"pool exhausted" or cap', "pool -cap", "pool_x or pool-x", '"cap exhausted" pool'):
        got = {r.n: r["rank"] for r in text.web_search(df, query).collect()}
        want = {i: w for i, d in enumerate(docs) if (w := plain_web(query, *d)) is not None}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in want), query


def registry(spark):
    rows = [("subject", 1, "postgres_pool", ["pg_pool", "pool"]), ("verb", 2, "exhausted", ["saturated"]), ("predicate", 3, "cap", None)]
    return spark.createDataFrame(rows, "kind string, entry_id long, canonical string, aliases array<string>")


def test_cues(spark):
    said = '"pool exhaustion" pool exhausted cap during outage as of 2026-05-13'
    found = retrieval.cues(spark.createDataFrame([(1, said), (2, None), (3, 'before noon, AFTER 2024-01-01T10:00:00Z "x" PG_Pool!')], "text_id int, text string"), registry(spark)).collect()
    first = [(r.cue_kind, r.cue_text, r.weight) for r in sorted(found, key=lambda r: r.nth) if r.text_id == 1]
    assert first == [("phrase", "pool exhaustion", 2.0), ("time_marker", "as of 2026-05-13", 0.5), ("subject", "pool", 1.5), ("verb", "exhausted", 1.5), ("predicate", "cap", 1.5), ("term", "during", 1.0), ("term", "outage", 1.0)]
    third = [(r.cue_kind, r.cue_text, r.resolved_id) for r in sorted(found, key=lambda r: r.nth) if r.text_id == 3]
    assert third == [("phrase", "x", None), ("time_marker", "AFTER 2024-01-01T10:00:00Z", None), ("term", "before", None), ("term", "noon", None), ("subject", "pg_pool", 1)]
    assert not [r for r in found if r.text_id == 2]


def test_plans(spark):
    E, known = retrieval.Envelope, registry(spark)

    def plan(e, **hints):
        p = retrieval.planned(e, known, hints)
        return p.intent, p.strategies()

    assert plan(E("postgres_pool exhausted cap", ("fact",)))[0] == "narrow" and plan(E("show me anything about widgets"))[0] == "recall"
    assert plan(E("plain free text")) == ("broad", ("fts", "vector", "graph_walk"))
    assert plan(E("x", valid_as_of="2026-01-01"))[1][0] == "temporal_as_of" and plan(E("x", transaction_as_of="2026-01-01"))[0] == "time_as_of"
    assert plan(E("x"), time_constraint_override={"valid_as_of": "2026-01-01"}, suppress_path=["vector"]) == ("broad", ("fts", "graph_walk"))
    boosted = retrieval.planned(E("x", hints={"boost_weight": {"vector": 3}}), known).steps
    assert [(s.strategy, s.boost) for s in boosted] == [("fts", None), ("vector", 3), ("graph_walk", None)]
    floor = retrieval.planned(E("x"), known, {"confidence_floor_override": 0.9})
    assert floor.envelope.confidence_floor == 0.9


def test_execute_retrieval(spark, small):
    m = Catalog(spark, small).governed()
    empty = m.claim.limit(0)
    assert retrieval.execute(m, retrieval.Envelope(None)).count() == 0
    assert retrieval.execute(retrieval.Memory(empty, empty, empty, empty, m.confidences, m.registry), retrieval.Envelope("widget")).count() == 0
    with pytest.raises(ValueError):
        retrieval.execute(m, retrieval.Envelope("widget", ("odd",)))
    only = retrieval.execute(m, retrieval.Envelope("widget", ("fact",)), limit=5)
    assert only.count() == 0
    got = retrieval.retrieve(m, retrieval.Envelope("widget", ("claim",)), limit=5)
    assert got.intent == "broad" and got.final_count == got.hits.count() == 5
    audit = got.decisions.collect()
    assert sorted({r.stage for r in audit}) == ["assembly", "planning"] and {r.object_id for r in audit if r.object_id is not None} == {r.object_id for r in got.hits.collect()}


def test_scalars(spark):
    one = spark.range(1)
    assert one.select(S.substituted(F.lit("{{b}} :a {{a}}"), {"a": F.lit("x"), "b": F.lit("y")})).first()[0] == "y x x"
    assert one.select(S.slug(F.lit("Ab C--d!"))).first()[0] == "ab_c_d"
    assert T.cron_next("*/15 3 * * *", datetime(2024, 1, 1, 3, 50)) == datetime(2024, 1, 2, 3, 0)
    assert T.cron_next("0 0 29 2 *", datetime(2024, 3, 1)) == datetime(2028, 2, 29)
    assert T.cron_field("7/5", 0, 59) == [7] and T.cron_field("50-59/5,3", 0, 59) == [3, 50, 55]
    with pytest.raises(ValueError):
        T.cron_field("9-2", 0, 59)
    rows = [("a", True, '["x"]', "internal"), ("b", False, None, None), ("c", True, "{", "odd"), ("d", True, None, None), ("e", True, '[1]', None)]
    who = spark.createDataFrame(rows, "name string, enabled boolean, scopes string, ceiling string")
    seen = spark.createDataFrame([("x", "internal"), ("x", "restricted"), (None, "public"), ("y", None)], "scope string, level string")
    counts = {n: seen.where(G.principal(who, n).sees(F.col("scope"), F.col("level"))).count() for n in "acde"}
    assert counts == {"a": 1, "c": 0, "d": 4, "e": 0}
    for name in ("b", "nobody"):
        with pytest.raises(PermissionError):
            G.principal(who, name)
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "items": {"type": "integer", "minimum": 2}, "maxItems": 2}, "s": {"pattern": "^x", "minLength": 2}}, "additionalProperties": False}
    assert G.json_errors({"a": [2, 3]}, schema) == []
    assert len(G.json_errors({"a": [1, 2, 3], "b": 1, "s": "y"}, schema)) == 5 and G.json_errors({}, schema) == ["$.a: missing"]
    assert G.advanced("proposed", "canary", G.MODEL_MOVES) == "canary" and G.advanced("canary", "retired", G.MODEL_MOVES) == "retired"
    assert G.advanced("dual_serve", "dual_serve", G.INDEX_MOVES) == "dual_serve"
    with pytest.raises(ValueError):
        G.advanced("done", "proposed", G.INDEX_MOVES)
    levels = spark.createDataFrame([("public",), (None,), ("odd",)], "l string")
    assert [r[0] for r in levels.select(G.sensitivity_rank(F.col("l"))).collect()] == [0, 1, 3]


def test_sources(spark, tmp_path):
    good = '{"subjects":[{"name":"a","type":"t","aliases":["x"]},{"type":"t"}],"verbs":[{"name":"v"}],"edges":[{"subject":"a","verb":"v","object":"b"},{"subject":"a"}]}'
    made = ingest.extraction(spark.createDataFrame([(1, good), (2, "broken")], "doc_id int, payload string"))
    assert {k: v.count() for k, v in made.items()} == {"subjects": 1, "verbs": 1, "edges": 1, "relationships": 0, "skipped": 3}
    linked = ingest.extraction(spark.createDataFrame([(1, '{"relationships":[{"source":"a","relation":"r","target":"b"},{"source":"a"}]}')], "doc_id int, payload string"))
    assert linked["relationships"].count() == 1 and [r.item for r in linked["skipped"].collect()] == [1]
    nodes, links = ingest.graph(spark.createDataFrame([('{"nodes":[{"id":"a"},{"id":"b"}],"links":[{"source":"a","target":"b","confidence":"INFERRED"},{"source":"a","target":"q"}]}',)], "payload string"))
    assert nodes.count() == 2 and [r.confidence for r in links.collect()] == [0.7]
    three = spark.createDataFrame([('{"nodes":[{"id":"a"},{"id":"b"},{"id":"c"}],"links":[]}',)], "payload string")
    assert ingest.graph(three, 3)[0].count() == 3
    with pytest.raises(Exception, match="more than 2 nodes"):
        ingest.graph(three, 2)[0].collect()
    try:
        import pypdf  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            ingest.pdf_pages(three)
    for name in ("a.bin", "b.txt"):
        (tmp_path / name).write_bytes(name.encode() * 3)
    assert [(r.length, bytes(r.content)) for r in ingest.objects(spark, str(tmp_path), "*.bin").collect()] == [(15, b"a.bin" * 3)]
    assert ingest.objects(spark, str(tmp_path), content=False).columns == ["path", "modificationTime", "length"]
    spark.range(1).createOrReplaceTempView("listed")
    assert ("listed.id", "belongs_to", "listed") in ingest.catalog_graph(spark)[1]


def test_streams_equal_batches(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{tmp_path}/events")
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    stream = windows.event_stream(spark, f"{tmp_path}/events", schema)
    query = windows.windowed(stream, "1 hour", late="400 days").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(spark.table("hours").collect()) == sorted(windows.windowed(events, "1 hour").collect())
    for _ in range(2):
        windows.drain(stream.where("event_type = 'error'"), f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination()
    assert spark.read.json(f"{tmp_path}/out").count() == events.where("event_type = 'error'").count()
    seen = []
    windows.forward(stream, lambda batch, n: seen.append(batch.count()), f"{tmp_path}/sent").awaitTermination()
    assert sum(seen) == events.count()
    jobs = spark.createDataFrame([(1, "a", datetime(2024, 1, 1)), (1, "a", datetime(2024, 1, 1)), (2, "a", datetime(2024, 1, 1))], "queue_id int, job_key string, ts timestamp")
    jobs.write.parquet(f"{tmp_path}/jobs")
    source = spark.readStream.schema(jobs.schema).parquet(f"{tmp_path}/jobs")
    windows.drain(windows.enqueued(source), f"{tmp_path}/queue", f"{tmp_path}/qat").awaitTermination()
    assert spark.read.json(f"{tmp_path}/queue").count() == 2


def test_records(spark):
    at = lifecycle.at_time
    objects = spark.createDataFrame([(1,), (2,), (3,)], "object_id long")
    grants = spark.createDataFrame(
        [(1, "read", None, None), (2, "read", datetime(2024, 1, 1), None), (3, "read", None, datetime(2024, 1, 1)), (3, "write", None, None)],
        "object_id long, level string, revoked_at timestamp, expires_at timestamp",
    )
    assert [r.object_id for r in records.granted(objects, grants, "read", at("2024-06-01")).collect()] == [1]
    models = spark.createDataFrame([(1, "a", "active"), (2, "a", "canary"), (3, "b", "active")], "model_id long, kind string, state string")
    assert {r.model_id: r.state for r in records.advanced_model(models, 2, "active").collect()} == {1: "retiring", 2: "active", 3: "active"}
    with pytest.raises(ValueError):
        records.advanced_model(models, 1, "canary")
    with pytest.raises(ValueError):
        records.advanced_model(models, 9, "canary")
    assert records.authorized_types({"a": objects, "b": objects.limit(0)}, ["a", "b"]) == ["a"]
    with pytest.raises(ValueError):
        records.authorized_types({}, ["a"])
    old = spark.createDataFrame([("x", "c1", 1), ("y", "c1", 1)], "namespace string, community string, member long")
    new = spark.createDataFrame([("x", "c2", 2), ("x", "c2", 9)], "namespace string, community string, member long")
    kept, unknown = records.replaced_communities(old, new, spark.createDataFrame([(1,), (2,)], "member long"), "x")
    assert {tuple(r) for r in kept.collect()} == {("y", "c1", 1), ("x", "c2", 2)} and [r.member for r in unknown.collect()] == [9]
    seen = spark.createDataFrame([(1, "s", "v", "o")] * 3 + [(1, "s", "v", "p")], "pool_id long, subject string, verb string, value string")
    claims, rest = records.promoted(seen, 3)
    assert [r.support for r in claims.collect()] == [3] and rest.count() == 1
    made, edges = records.consolidated(
        spark.createDataFrame([(2, "b"), (1, "a")], "memory_id long, title string"), spark.createDataFrame([(0, 1), (0, 2)], "group_id long, memory_id long"), 100
    )
    assert [(r.memory_id, r.title) for r in made.collect()] == [(100, "a\nb")] and edges.count() == 2
    assert records.tenant_view(spark.createDataFrame([("t", 1), ("u", 2)], "owner_schema string, v int"), "t").collect()[0].asDict() == {"v": 1}


def test_transforms(spark):
    who = G.Principal("a", ("x", "y"), 3)
    rows = spark.createDataFrame([(1, None), (2, "y")], "k int, scope string")
    at = lifecycle.at_time("2024-01-01")
    assert {r.k: (r.scope, r.created_by) for r in transforms.stamped(rows, who, at).collect()} == {1: ("x", "a"), 2: ("y", "a")}
    with pytest.raises(Exception, match="may not write to z"):
        transforms.stamped(spark.createDataFrame([(1, "z")], "k int, scope string"), who, at).collect()
    schema = {"type": "object", "required": ["a"]}
    good = spark.createDataFrame([(1, '{"a":1}'), (2, None)], "k int, p string")
    assert transforms.validated(good, {"p": schema}).count() == 2 and transforms.validated(good, {"p": schema}).columns == ["k", "p"]
    with pytest.raises(Exception, match="a: missing"):
        transforms.validated(spark.createDataFrame([(1, "{}")], "k int, p string"), {"p": schema}).collect()
    old = spark.createDataFrame([(1, "t", datetime(2024, 1, 1)), (2, "u", None)], "k int, body string, sealed_at timestamp")
    assert transforms.sealed(old, spark.createDataFrame([(1, "t"), (2, "v"), (3, "w")], "k int, body string"), "k", ["body"]).count() == 3
    with pytest.raises(Exception, match="sealed row 1"):
        transforms.sealed(old, spark.createDataFrame([(1, "other")], "k int, body string"), "k", ["body"]).collect()


def test_states_and_promotions(spark):
    objects = spark.createDataFrame([(1, "active"), (2, "active")], "object_id long, state string")
    holds = spark.createDataFrame([(2,)], "object_id long")
    with pytest.raises(Exception, match="legal hold"):
        lifecycle.with_states(objects, spark.createDataFrame([(2, "retired")], "object_id long, state string"), holds).collect()
    with pytest.raises(Exception, match="needs a reason"):
        lifecycle.pruned(objects, spark.createDataFrame([(1, "")], "object_id long, reason string"), holds).collect()
    members = spark.createDataFrame([(1, 1, "observation", 5, None), (2, 1, "pending_claim", 6, 9)], "member_id long, pool_id long, kind string, object_id long, promoted_to long")
    for i in (1, 2):
        with pytest.raises(Exception, match="no pending claim"):
            records.promoted_to_facts(members, spark.createDataFrame([(i,)], "member_id long"), 100)[0].collect()
    models = spark.createDataFrame([("e", "active", 4)], "kind string, state string, space_id long")
    moves = spark.createDataFrame([(1, 4, 9, "cutover", 0.0, 1)], "migration_id long, source_space long, target_space long, status string, percent double, started_at int")
    assert [tuple(r) for r in records.routed(models, moves, "e").collect()] == [("target_only", 9, 1.0, "target", 1)]
    assert records.routed(models, moves.limit(0), "e").first().strategy == "active"
    with pytest.raises(ValueError):
        records.routed(models, moves, "other")


def test_views_and_envelopes(spark):
    base = spark.createDataFrame([(1, "a"), (2, None)], "k int, ref string")
    view = ingest.reference_view("linked_rows", base, spark.createDataFrame([("a", 7)], "key string, v int"), "ref", "key")
    assert spark.sql("SELECT sum(v) FROM linked_rows").first()[0] == 7 and view.count() == 2
    import json

    bodies = [json.loads(r.body)["records"] for r in windows.envelopes(spark.range(25).repartition(2), 10).collect()]
    assert sorted(r["id"] for b in bodies for r in b) == list(range(25)) and max(map(len, bodies)) <= 10
    typed = spark.createDataFrame([(1, "a", None, "[1,2]", 3.0)], "target_id int, attr_name string, value_timestamp timestamp, value_range string, value_numeric double").withColumn("ref_source", F.lit(None).cast("string"))
    assert records.typed_attributes(typed).first().value_type == "tstzrange"
