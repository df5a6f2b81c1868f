"""Registered queries over the memory model, each next to DuckDB SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoscope.functions import governance as G
from mnemoscope.functions import strings as S
from mnemoscope.functions import temporal as T
from mnemoscope.functions import vectors as VF
from mnemoscope.operators import graph, lifecycle, logs, records, retrieval, text, vectors
from mnemoscope.sources import ingest, transforms
from mnemoscope.sources.catalog import Catalog

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a catalog under its name."""

    def take(f: Callable[[Catalog], DataFrame]) -> Callable[[Catalog], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return take


# Vectors. The query vector is [1, 1/2, 1/3, ...] of 64 elements, known without a look at the data.

DIMS = 64
PROBE = [1.0 / (i + 1) for i in range(DIMS)]
Q = "(SELECT list(1.0 / (i + 1) ORDER BY i) AS q FROM range(64) t(i))"
DOT = "list_sum(list_transform(list_zip(e, q), lambda x: x[1] * x[2]))"
COSINE = f"round(1 - {DOT} / (sqrt(list_sum(list_transform(e, lambda x: x * x))) * sqrt(list_sum(list_transform(q, lambda x: x * x)))), 6)"
L2 = "round(list_sum(list_transform(list_zip(e, q), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6)"
CHUNKS = "(SELECT vec_id AS chunk_id, label AS compartment_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def probe():
    return vectors.query_vector(PROBE)


def _topk_sql(distance: str, where: str = "", limit: int = 10) -> str:
    return f"""
SELECT chunk_id, compartment_id, distance, row_number() OVER (ORDER BY distance, chunk_id) AS rank_no FROM (
  SELECT chunk_id, compartment_id, {distance} AS distance FROM {CHUNKS} c, {Q} p {where}
  ORDER BY distance, chunk_id LIMIT {limit})"""


@query(_topk_sql(COSINE))
def vector_exact_cosine(c):
    return vectors.exact_topk(c.chunks(), probe(), 10, "cosine").drop("similarity")


@query(_topk_sql(L2))
def vector_exact_l2(c):
    return vectors.exact_topk(c.chunks(), probe(), 10, "l2").drop("similarity")


@query(_topk_sql(f"round(-{DOT}, 6)"))
def vector_exact_ip(c):
    return vectors.exact_topk(c.chunks(), probe(), 10, "ip").drop("similarity")


@query(_topk_sql(COSINE, "WHERE compartment_id IN (1, 3, 5)"))
def vector_tag_search(c):
    return vectors.tag_search(c.chunks(), probe(), 10, [1, 3, 5]).drop("similarity")


@query(_topk_sql(COSINE, "WHERE chunk_id % 17 <> 0"))
def vector_tombstone_anti(c):
    return vectors.exact_topk(vectors.without_tombstones(c.chunks(), c.tombstones()), probe(), 10).drop("similarity")


@query(f"""
SELECT chunk_id, compartment_id, distance, rank_no FROM (
  SELECT chunk_id, compartment_id, distance,
         row_number() OVER (PARTITION BY compartment_id ORDER BY distance, chunk_id) AS rank_no
  FROM (SELECT chunk_id, compartment_id, {COSINE} AS distance FROM {CHUNKS} c, {Q} p)) WHERE rank_no <= 3""")
def vector_topk_per_compartment(c):
    return vectors.topk_by_compartment(c.chunks(), probe(), 3)


@query(f"""
SELECT chunk_id, distance, row_number() OVER (ORDER BY distance, chunk_id) AS rank_no FROM (
  SELECT chunk_id, distance FROM (
    SELECT chunk_id, compartment_id, {COSINE} AS distance FROM {CHUNKS} c, {Q} p ORDER BY distance, chunk_id LIMIT 40)
  WHERE compartment_id < 5 ORDER BY distance, chunk_id LIMIT 10)""")
def vector_metadata_filter(c):
    return vectors.filtered_search(c.chunks(), probe(), 10, F.col("compartment_id") < 5)


@query(f"""
SELECT compartment_id, count(*) AS n_chunks, round(avg(sqrt(list_sum(list_transform(e, lambda x: x * x)))), 4) AS avg_norm,
       CASE WHEN count(*) < 10000 THEN 'exact' WHEN count(*) < 250000 THEN 'exact_or_ann' ELSE 'local_ann' END AS search_mode
FROM {CHUNKS} c GROUP BY compartment_id""")
def compartment_stats(c):
    return vectors.compartment_stats(c.chunks())


UNIT = "(SELECT vec_id, label, list_transform(e, lambda x: x / n) AS e FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings))"
KNN = f"""(SELECT source_id, target_id, similarity, rank_no FROM (
  SELECT source_id, target_id, least(1.0, similarity) AS similarity,
         row_number() OVER (PARTITION BY source_id ORDER BY similarity DESC, target_id) AS rank_no
  FROM (SELECT a.vec_id AS source_id, b.vec_id AS target_id,
               round(list_sum(list_transform(list_zip(a.e, b.e), lambda x: x[1] * x[2])), 6) AS similarity
        FROM {UNIT} a JOIN {UNIT} b ON a.label = b.label AND a.vec_id <> b.vec_id)
  WHERE similarity >= 0.1) WHERE rank_no <= 5)"""


@query(f"SELECT * FROM {KNN}")
def semantic_knn_edges(c):
    return vectors.knn_edges(c.chunks(), 5, 0.1)


@query(f"""WITH k AS {KNN}
SELECT a.source_id, a.target_id, a.similarity FROM k a JOIN k b
ON a.source_id = b.target_id AND a.target_id = b.source_id WHERE a.source_id < a.target_id""")
def semantic_mutual_edges(c):
    return vectors.mutual(vectors.knn_edges(c.chunks(), 5, 0.1)).select("source_id", "target_id", "similarity")


@query()
def ann_search(c):
    return vectors.CellIndex(c.chunks()).search(PROBE, 10).drop("similarity")


UNIT_Q = "(SELECT list_transform(q, lambda x: x / sqrt(list_sum(list_transform(q, lambda y: y * y)))) AS q FROM (SELECT list(1.0 / (i + 1) ORDER BY i) AS q FROM range(64) t(i)))"


@query(f"""
SELECT chunk_id, compartment_id, distance, round(-distance, 6) AS similarity, row_number() OVER (ORDER BY distance, chunk_id) AS rank_no FROM (
  SELECT chunk_id, compartment_id, {L2} AS distance FROM {CHUNKS} c, {UNIT_Q} p
  WHERE compartment_id < 5 AND chunk_id % 7 <> 0 ORDER BY distance, chunk_id LIMIT 20)""")
def vector_nulls_and_sizes(c):
    """Chunks without a vector are passed over; those of another size stand in compartments that aren't searched."""
    vector = F.when(F.col("chunk_id") % 7 == 0, F.lit(None)).when(F.col("compartment_id") >= 5, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    own = c.chunks().where("compartment_id < 5").withColumn("embedding", vector)
    return vectors.exact_topk(own, vectors.query_vector(vectors.unit(PROBE)), 20, "l2")


TAGGED = f"""(SELECT chunk_id, chunk_id * 10 AS statement_id, chunk_id AS document_id, {COSINE} AS distance, compartment_id,
  'subject ' || (compartment_id % 3) AS subject_name, 'verb ' || (compartment_id % 2) AS verb_name
  FROM {CHUNKS} c, {Q} p WHERE compartment_id < 8 AND compartment_id % 3 = 1 AND compartment_id % 2 = 0)"""


@query(f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY distance, compartment_id, chunk_id) AS rank_no FROM {TAGGED} t)
SELECT chunk_id, statement_id, r.document_id, distance, round(1 - distance, 6) AS similarity, rank_no, subject_name, verb_name
FROM r LEFT JOIN documents d ON d.doc_id = r.document_id
WHERE rank_no <= 30 AND coalesce(CASE d.lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE CASE WHEN d.doc_id IS NULL THEN 0 ELSE 3 END END, 0) <= 1""")
def memory_search(c):
    chunks = c.chunks().withColumns({"statement_id": F.col("chunk_id") * 10, "document_id": F.col("chunk_id")})
    level = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).when(F.col("lang") == "fr", 2).otherwise(3)
    levels = c.documents.select(F.col("doc_id").alias("document_id"), level.alias("level"))
    return vectors.memory_search(chunks, c.compartments(), probe(), 30, subject="subject 1", verb="verb 0", sensitivities=levels, ceiling=1)


@query("SELECT DISTINCT label AS compartment_id, 'subject ' || (label % 3) AS subject_name, 'verb ' || (label % 2) AS verb_name FROM embeddings WHERE label < 8 AND label % 2 = 1")
def vector_tag_resolution(c):
    return vectors.tagged(c.compartments(), "default", verb="verb 1")


CARD = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 13 <> 0 AND vec_id % 11 <> 0)"


@query(f"""
SELECT CASE WHEN vec_id % 2 = 0 THEN 'subject' ELSE 'svpor_statement' END AS object_kind, vec_id AS object_id, round(1 - {COSINE}, 6) AS score
FROM {CARD} c, {Q} p ORDER BY score DESC, object_kind, object_id LIMIT 25""")
def semantic_search(c):
    return vectors.semantic_search(c.cards(), PROBE, 25)


@query(f"""
SELECT 'subject' AS neighbor_kind, vec_id AS neighbor_id, similarity FROM (
  SELECT c.vec_id, round(1 - {COSINE}, 6) AS similarity FROM {CARD} c, (SELECT e AS q FROM {CARD} x WHERE vec_id = 2) p WHERE vec_id <> 2 AND vec_id % 2 = 0)
WHERE similarity >= 0.05 ORDER BY similarity DESC, neighbor_id LIMIT 12""")
def uedge_semantic_neighbors(c):
    return vectors.semantic_neighbors(c.cards(), "subject", 2, 12, 0.05)


@query(f"""WITH k AS {KNN}, n AS (SELECT least(source_id, target_id) AS source_id, greatest(source_id, target_id) AS target_id, max(similarity) AS similarity FROM k GROUP BY 1, 2)
SELECT n.source_id + CASE WHEN n.source_id % 4 = 0 THEN n.target_id - n.source_id ELSE 0 END AS source_id,
       n.target_id - CASE WHEN n.source_id % 4 = 0 THEN n.target_id - n.source_id ELSE 0 END AS target_id, n.similarity FROM n""")
def semantic_edges_refresh(c):
    """Edges of every fourth source stand already, the other way round and with an old similarity."""
    found = vectors.knn_edges(c.chunks(), 5, 0.1)
    low, high = F.least("source_id", "target_id"), F.greatest("source_id", "target_id")
    old = found.select(high.alias("source_id"), low.alias("target_id"), F.lit(0.0).alias("similarity")).distinct().where("target_id % 4 = 0")
    return vectors.refreshed_edges(old, found)


# Graph.

EDGES = """(
  SELECT 'order:' || o_orderkey AS s, 'placed_by' AS rel, 'customer:' || o_custkey AS t FROM orders UNION ALL
  SELECT 'order:' || l_orderkey, 'contains', 'part:' || l_partkey FROM lineitem UNION ALL
  SELECT 'order:' || l_orderkey, 'supplied_by', 'supplier:' || l_suppkey FROM lineitem UNION ALL
  SELECT 'customer:' || c_custkey, 'located_in', 'nation:' || c_nationkey FROM customer UNION ALL
  SELECT 'supplier:' || s_suppkey, 'located_in', 'nation:' || s_nationkey FROM supplier UNION ALL
  SELECT 'nation:' || n_nationkey, 'located_in', 'region:' || n_regionkey FROM nation)"""
NEAR = {
    "out": f"SELECT DISTINCT rel, t AS node FROM {EDGES} WHERE s = 'customer:7'",
    "in": f"SELECT DISTINCT rel, s AS node FROM {EDGES} WHERE t = 'customer:7'",
}


@query(NEAR["out"])
def graph_neighbors_out(c):
    return graph.neighbors(c.edges(), "customer:7", "out")


@query(NEAR["in"])
def graph_neighbors_in(c):
    return graph.neighbors(c.edges(), "customer:7", "in")


@query(f"{NEAR['out']} UNION {NEAR['in']}")
def graph_neighbors_both(c):
    return graph.neighbors(c.edges(), "customer:7", "both")


WALK = f"""
WITH RECURSIVE arcs AS (SELECT DISTINCT s, rel, t FROM {EDGES} e), w AS (
  SELECT 1 AS depth, t AS node, rel, 'order:1>' || t AS path FROM arcs WHERE s = 'order:1'
  UNION ALL
  SELECT w.depth + 1, a.t, a.rel, w.path || '>' || a.t FROM w JOIN arcs a ON a.s = w.node
  WHERE w.depth < 4 AND NOT contains('>' || w.path || '>', '>' || a.t || '>'))
"""


@query(WALK + "SELECT depth, node, rel, path FROM w")
def graph_walk_bfs(c):
    return graph.walk(c.edges(), "order:1", 4, "out")


@query(WALK + "SELECT depth, path FROM w WHERE node = 'region:1'")
def graph_path(c):
    return graph.paths(c.edges(), "order:1", "region:1", 4, "out")


@query(WALK + "SELECT depth, node, rel, path FROM w ORDER BY path, rel LIMIT 60")
def graph_walk_dfs(c):
    return graph.ordered(graph.walk(c.edges(), "order:1", 4, "out"), "dfs").limit(60)


@query(f"""
WITH n AS ({NEAR['out']} UNION {NEAR['in']}), l AS (
  SELECT 'customer:' || c_custkey AS node, c_name AS label FROM customer UNION ALL SELECT 'nation:' || n_nationkey, n_name FROM nation)
SELECT rel, n.node, coalesce(label, n.node) AS label FROM n LEFT JOIN l ON n.node = l.node WHERE NOT starts_with(n.node, 'order') OR rel = 'placed_by'""")
def uedge_neighbors(c):
    """Labels where a node has one; an edge of the semantic store is held back."""
    guess = c.nation.select(F.lit("semantic").alias("edge_store"), F.col("n_nationkey").cast("long").alias("edge_id"), F.lit("customer").alias("source_kind"), F.lit(7).cast("long").alias("source_id"), F.lit("like").alias("rel"), F.lit("nation").alias("target_kind"), F.col("n_nationkey").cast("long").alias("target_id"))
    return graph.unified_neighbors(c.edges().unionByName(guess), c.labels_of(), "customer:7")


@query(f"""
WITH RECURSIVE arcs AS (SELECT s, t FROM {EDGES} e WHERE rel <> 'contains' UNION SELECT t, s FROM {EDGES} e WHERE rel <> 'contains'), w AS (
  SELECT 'nation:3' AS node, 0 AS depth UNION SELECT a.t, w.depth + 1 FROM w JOIN arcs a ON a.s = w.node WHERE w.depth < 2)
SELECT node, min(depth) AS depth FROM w GROUP BY node""")
def graph_reachable(c):
    return graph.reachable(c.edges().where("rel <> 'contains'"), "nation:3", 2)


@query(f"""
SELECT node, sum(o) AS out_degree, sum(i) AS in_degree, sum(o + i) AS total FROM (
  SELECT s AS node, 1 AS o, 0 AS i FROM {EDGES} e UNION ALL SELECT t, 0, 1 FROM {EDGES} e)
GROUP BY node ORDER BY total DESC, node LIMIT 100""")
def uedge_degree(c):
    return graph.top_degree(c.edges(), 100)


@query("""
WITH x AS (
  SELECT o_orderkey AS source, o_custkey AS target, o_orderpriority AS ca, c_mktsegment AS cb
  FROM orders JOIN customer ON o_custkey = c_custkey),
n AS (SELECT least(ca, cb) AS low, greatest(ca, cb) AS high, count(*) AS pair_count FROM x WHERE ca <> cb GROUP BY 1, 2)
SELECT source, target, low, high, pair_count FROM x JOIN n ON least(ca, cb) = low AND greatest(ca, cb) = high
WHERE ca <> cb ORDER BY pair_count, source, target LIMIT 50""")
def uedge_surprises(c):
    links = c.orders.select(F.col("o_orderkey").alias("source"), F.col("o_custkey").alias("target"))
    sources = c.orders.select(F.col("o_orderkey").alias("member"), F.col("o_orderpriority").alias("community"))
    targets = c.customer.select(F.col("c_custkey").alias("member"), F.col("c_mktsegment").alias("community"))
    return graph.surprises(links, sources, targets, 50)


TREE = """(
  SELECT 'region:' || r_regionkey AS node, NULL AS parent, r_regionkey AS ordinal FROM region UNION ALL
  SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, n_nationkey FROM nation UNION ALL
  SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, c_custkey FROM customer UNION ALL
  SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, o_orderkey FROM orders)"""


@query(f"""
WITH RECURSIVE tree AS (SELECT * FROM {TREE} t), w AS (
  SELECT node, parent, 0 AS depth FROM tree WHERE node = 'order:5'
  UNION ALL SELECT t.node, t.parent, w.depth + 1 FROM w JOIN tree t ON t.node = w.parent)
SELECT node, depth FROM w""")
def tree_ancestors(c):
    return graph.ancestors(c.tree(), "order:5", 4)


@query(f"""
WITH RECURSIVE tree AS (SELECT * FROM {TREE} t), w AS (
  SELECT node, 0 AS depth, CAST(ordinal AS VARCHAR) AS ordinal_path FROM tree WHERE node = 'nation:3'
  UNION ALL SELECT t.node, w.depth + 1, w.ordinal_path || '.' || t.ordinal FROM w JOIN tree t ON t.parent = w.node)
SELECT node, depth, ordinal_path FROM w""")
def tree_descendants(c):
    return graph.descendants(c.tree(), "nation:3", 2)


@query("""
SELECT 'order:' || o_orderkey AS node, 'region:' || n_regionkey AS root, 3 AS depth
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey UNION ALL
SELECT 'customer:' || c_custkey, 'region:' || n_regionkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL
SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 1 FROM nation UNION ALL
SELECT 'region:' || r_regionkey, 'region:' || r_regionkey, 0 FROM region""")
def tree_root(c):
    return graph.roots(c.tree(), 4)


@query(f"""
SELECT parent, '[' || string_agg('{{"ordinal":' || ordinal || ',"node":"' || node || '","kind":"' || split_part(node, ':', 1) || '"}}', ',' ORDER BY ordinal) || ']' AS subtree
FROM {TREE} t WHERE parent IS NOT NULL GROUP BY parent""")
def tree_json(c):
    return graph.children_json(c.tree())


@query(f"SELECT DISTINCT CASE WHEN s = 'supplier:3' THEN t ELSE s END AS node FROM {EDGES} e WHERE s = 'supplier:3' OR t = 'supplier:3'")
def staleness_fanout(c):
    return graph.stale(c.edges(), "supplier:3")


@query("""
WITH c AS (SELECT c_nationkey, string_agg('{"node":"customer:' || c_custkey || '","children":[]}', ',' ORDER BY c_custkey) AS inner_ FROM customer GROUP BY c_nationkey),
n AS (SELECT string_agg('{"node":"nation:' || n_nationkey || '","children":[' || coalesce(inner_, '') || ']}', ',' ORDER BY n_nationkey) AS inner_
      FROM nation LEFT JOIN c ON c_nationkey = n_nationkey WHERE n_regionkey = 2)
SELECT '{"node":"region:2","children":[' || inner_ || ']}' AS subtree FROM n""")
def tree_subtree(c):
    return graph.subtree_json(c.tree(), "region:2", 2)


@query(f"""
WITH RECURSIVE tree AS (SELECT *, {' + '.join(f"contains(node, '{w}')::INT" for w in ('region:2', 'nation', '7', 'customer', '4', 'order', '3'))} AS score FROM {TREE} t),
best AS (SELECT parent, node FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY score DESC, ordinal) AS n FROM tree) WHERE n = 1),
top AS (SELECT node FROM tree WHERE parent IS NULL ORDER BY ordinal LIMIT 1), w AS (SELECT 0 AS depth, node FROM top
      UNION ALL SELECT w.depth + 1, b.node FROM w JOIN best b ON b.parent = w.node WHERE w.depth < 4)
SELECT depth, node FROM w""")
def tree_descent(c):
    return graph.descend(c.tree(), text.overlap_score(F.col("node"), "region:2 nation 7 customer 4 order 3"), 4)


# Time, confidence, retention, cost.

FACTS = """(
  SELECT o_orderkey AS fact_id, o_custkey AS subject_id, o_orderpriority AS verb, o_totalprice AS object_value,
         o_orderdate AS valid_from, lead(o_orderdate) OVER own AS valid_to, lag(o_orderkey) OVER own AS supersedes,
         CASE WHEN o_orderstatus = 'F' THEN 'superseded' ELSE 'active' END AS lifecycle_state
  FROM orders WINDOW own AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""
AT = "TIMESTAMP '1998-06-01'"
VALID = f"valid_from <= {AT} AND (valid_to IS NULL OR valid_to > {AT})"


@query(f"SELECT fact_id, subject_id, object_value FROM {FACTS} f WHERE {VALID} AND lifecycle_state = 'active'")
def fact_as_of(c):
    return lifecycle.as_of(c.facts(), lifecycle.at_time("1998-06-01")).select("fact_id", "subject_id", "object_value")


@query(f"SELECT fact_id, lifecycle_state FROM {FACTS} f WHERE {VALID}")
def fact_history_as_of(c):
    return lifecycle.as_of(c.facts(), lifecycle.at_time("1998-06-01"), active_only=False).select("fact_id", "lifecycle_state")


@query(f"SELECT fact_id, subject_id FROM {FACTS} f WHERE valid_to IS NULL AND lifecycle_state = 'active'")
def current_facts(c):
    return lifecycle.current(c.facts().where("valid_to is null")).select("fact_id", "subject_id")


@query("""
SELECT fact_id, subject_id FROM (
  SELECT o_orderkey AS fact_id, o_custkey AS subject_id, o_orderdate AS a,
         max(o_orderdate + INTERVAL 90 DAY) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM orders) WHERE busy > a""")
def validity_overlap(c):
    held = c.facts().withColumn("valid_to", F.col("valid_from") + F.expr("INTERVAL 90 DAYS"))
    return lifecycle.overlapping(held).select("fact_id", "subject_id")


@query(f"""
SELECT subject_id, fact_id, row_number() OVER (PARTITION BY subject_id ORDER BY valid_from, fact_id) AS version,
       coalesce(lag(fact_id) OVER (PARTITION BY subject_id ORDER BY valid_from, fact_id), -1) AS supersedes FROM {FACTS} f""")
def supersession_chain(c):
    return lifecycle.supersession_chain(c.facts()).withColumn("supersedes", F.coalesce("supersedes", F.lit(-1)))


@query(f"""
SELECT fact_id, object_value, valid_to, lifecycle_state FROM (
  SELECT fact_id, object_value, valid_to, lifecycle_state FROM {FACTS} f WHERE fact_id % 1000 <> 0 UNION ALL
  SELECT fact_id, object_value, CASE WHEN valid_to IS NULL OR valid_to > {AT} THEN {AT} ELSE valid_to END, 'superseded' FROM {FACTS} f WHERE fact_id % 1000 = 0 UNION ALL
  SELECT fact_id + 100000000, object_value * 2, valid_to, 'active' FROM {FACTS} f WHERE fact_id % 1000 = 0)""")
def correct_fact(c):
    fixes = c.facts().where("fact_id % 1000 = 0").select("fact_id", (F.col("fact_id") + 100_000_000).alias("new_fact_id"), (F.col("object_value") * 2).alias("object_value"))
    return lifecycle.corrected(c.facts(), fixes, lifecycle.at_time("1998-06-01")).select("fact_id", "object_value", "valid_to", "lifecycle_state")


@query(f"""
SELECT subject_id, count(*) FILTER (WHERE valid_from > {AT}) AS later_changes,
       count(*) FILTER (WHERE valid_from <= {AT} AND NOT ({VALID} AND lifecycle_state = 'active')) AS hidden
FROM {FACTS} f GROUP BY subject_id""")
def replay_episode(c):
    return lifecycle.replayed(c.facts(), "current_valid", lifecycle.at_time("1998-06-01")).select("subject_id", "later_changes", "hidden")


@query(f"""
SELECT subject_id, '[' || coalesce(string_agg('{{"valid_from":"' || strftime(valid_from, '%Y-%m-%dT%H:%M:%S.000') || '","fact_id":' || fact_id || ',"verb":"' || verb || '","lifecycle_state":"' || lifecycle_state || '"}}',
         ',' ORDER BY valid_from, fact_id) FILTER (WHERE {VALID}), '') || ']' AS steps,
       count(*) FILTER (WHERE valid_from > {AT}) AS later_changes, count(*) FILTER (WHERE valid_from <= {AT} AND NOT ({VALID})) AS hidden
FROM {FACTS} f GROUP BY subject_id""")
def replay_steps(c):
    return lifecycle.replayed(c.facts(), "historical", lifecycle.at_time("1998-06-01"))


SCORES = """(
  SELECT p_partkey AS target_id, 'supporting_facts' AS category, round(least(1.0, p_size / 50.0), 4) AS subscore FROM part UNION ALL
  SELECT p_partkey, 'source_diversity', round(least(1.0, p_retailprice / 2500.0), 4) FROM part UNION ALL
  SELECT p_partkey, 'claim_consistency', round(least(1.0, length(p_name) / 60.0), 4) FROM part)"""


@query(f"""
SELECT target_id, least(1.0, round(sum(subscore * w) / sum(w) + 1e-9, 4)) AS confidence FROM (
  SELECT target_id, subscore, CASE category WHEN 'supporting_facts' THEN 0.2::DOUBLE ELSE 0.15::DOUBLE END AS w FROM {SCORES} s) GROUP BY target_id""")
def maut_confidence(c):
    weights = c.spark.createDataFrame([(k, v, True) for k, v in lifecycle.WEIGHTS.items()], "category string, weight double, enabled boolean")
    return lifecycle.confidence(c.scores(), weights)


@query(f"""
SELECT target_id, count(*) AS n_scores, string_agg(category, ',' ORDER BY category) AS categories, min(subscore) AS low, max(subscore) AS high
FROM {SCORES} s GROUP BY target_id""")
def maut_summary(c):
    return lifecycle.confidence_summary(c.scores())


@query("""
SELECT user_id AS target_id,
       round(1 - exp(-sum(value / 100 * power(0.5, (epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 86400.0 / 90.0)) / 5.0), 4) AS salience
FROM events GROUP BY user_id""")
def salience(c):
    seen = c.events.select(F.col("user_id").alias("target_id"), (F.col("value") / 100).alias("weight"), F.col("ts").alias("at"))
    return lifecycle.salience(seen, lifecycle.at_time("2024-02-01"))


@query("""
SELECT o_orderkey AS object_id FROM orders WHERE o_orderstatus IN ('F', 'O')
AND o_orderdate < TIMESTAMP '2000-01-01' - INTERVAL 365 DAY AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)""")
def retention_candidates(c):
    objects = c.orders.select(F.col("o_orderkey").alias("object_id"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("updated_at"))
    held = c.orders.join(c.customer.where("c_acctbal > 9000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("o_orderkey").alias("object_id"))
    return lifecycle.retention_candidates(objects, held, lifecycle.at_time("2000-01-01"), ["F", "O"]).select("object_id")


@query("""
SELECT user_id AS account, event_type AS kind, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n_calls,
       sum(floor(value)::BIGINT) AS tokens_in, sum(floor(value / 2)::BIGINT) AS tokens_out,
       round(sum(floor(value) * 0.003 + floor(value / 2) * 0.015), 4) AS cost
FROM events WHERE event_type <> 'view' GROUP BY ALL""")
def cost_by_account(c):
    return lifecycle.cost_rollup(_calls(c))


def _calls(c):
    into, out = F.floor("value"), F.floor(F.col("value") / 2)
    hit = F.col("event_type") == "view"
    return c.events.select(
        F.col("user_id").alias("account"),
        F.col("event_type").alias("kind"),
        F.col("ts").alias("at"),
        into.alias("tokens_in"),
        out.alias("tokens_out"),
        lifecycle.cost(into, out, F.lit(0.003), F.lit(0.015), hit).alias("cost"),
        hit.alias("cached"),
    )


@query("""
SELECT user_id AS account, count(*) AS n_calls, sum(floor(value)::BIGINT + floor(value / 2)::BIGINT) AS tokens FROM events
WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16' GROUP BY user_id""")
def usage_today(c):
    return lifecycle.usage(_calls(c), lifecycle.at_time("2024-01-15"), lifecycle.at_time("2024-01-16"))


@query("""
WITH u AS (SELECT user_id AS account, round(sum(value), 2) AS used FROM events GROUP BY user_id),
p AS (SELECT account, 1 AS scope_order, 3000.0 AS budget FROM u WHERE account % 2 = 0 UNION ALL SELECT account, 4, 3400.0 FROM u)
SELECT account, used, scope_order, budget FROM (
  SELECT u.account, used, scope_order, budget::DOUBLE AS budget, row_number() OVER (PARTITION BY u.account ORDER BY scope_order, budget) AS n
  FROM u JOIN p ON u.account = p.account WHERE used >= budget) WHERE n = 1""")
def budget_check(c):
    used = c.events.groupBy(F.col("user_id").alias("account")).agg(F.round(F.sum("value"), 2).alias("used"))
    rules = used.where("account % 2 = 0").select("account", F.lit(1).alias("scope_order"), F.lit(3000.0).alias("budget")).unionByName(
        used.select("account", F.lit(4).alias("scope_order"), F.lit(3400.0).alias("budget"))
    )
    return lifecycle.over_budget(used, rules)


# Logs, queues, presence.

STATUSES = ("ready", "leased", "done", "dead")
STATUS = "CASE event_type WHEN 'view' THEN 'ready' WHEN 'click' THEN 'leased' WHEN 'error' THEN 'dead' ELSE 'done' END"


def _jobs(c):
    kind = F.col("event_type")
    status = F.when(kind == "view", "ready").when(kind == "click", "leased").when(kind == "error", "dead").otherwise("done")
    return c.events.select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("queue_id"), status.alias("status"), (F.col("event_id") % 5).alias("priority"), F.col("ts").alias("visible_at")
    )


@query(f"""
SELECT c_custkey AS queue_id, {', '.join(f"count(*) FILTER (WHERE s = '{x}') AS n_{x}" for x in STATUSES)}
FROM customer LEFT JOIN (SELECT user_id, {STATUS} AS s FROM events) e ON c_custkey = user_id GROUP BY c_custkey""")
def queue_stats(c):
    return logs.queue_stats(c.customer.select(F.col("c_custkey").alias("queue_id")), _jobs(c), STATUSES)


@query("""
SELECT event_id AS job_id, event_id % 5 AS priority, ts AS visible_at FROM events
WHERE event_type = 'view' AND ts <= TIMESTAMP '2024-01-20' ORDER BY event_id % 5 DESC, ts, event_id LIMIT 50""")
def queue_lease_order(c):
    return logs.lease_order(_jobs(c), lifecycle.at_time("2024-01-20"), 50).select("job_id", "priority", "visible_at")


@query("""
SELECT event_id AS job_id, CASE WHEN event_type = 'click' AND ts + INTERVAL 1 HOUR < TIMESTAMP '2024-01-20'
  THEN CASE WHEN event_id % 4 >= 3 THEN 'dead' ELSE 'ready' END ELSE CASE event_type WHEN 'click' THEN 'leased' ELSE 'other' END END AS status FROM events""")
def queue_reap(c):
    jobs = c.events.select(
        F.col("event_id").alias("job_id"), F.when(F.col("event_type") == "click", "leased").otherwise("other").alias("status"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("leased_until"), (F.col("event_id") % 4).alias("attempts")
    )
    return logs.reaped(jobs, lifecycle.at_time("2024-01-20"), 3).select("job_id", "status")


@query("SELECT event_id, event_type, user_id FROM events WHERE event_id > 500 AND event_type IN ('error', 'signup') ORDER BY event_id LIMIT 100")
def event_fetch_batch(c):
    return logs.fetch_batch(c.events, 500, ["error", "signup"], 100).select("event_id", "event_type", "user_id")


@query("""
SELECT c_custkey AS consumer, greatest(200, coalesce(max(event_id), 200)) AS cursor FROM customer LEFT JOIN events ON c_custkey = user_id GROUP BY c_custkey""")
def event_ack_cursor(c):
    cursors = c.customer.select(F.col("c_custkey").alias("consumer"), F.lit(200).cast("long").alias("cursor"))
    return logs.acknowledged(cursors, c.events.select(F.col("user_id").alias("consumer"), "event_id"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 7200000000 THEN 1 ELSE 0 END AS n
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session_no FROM g)
SELECT user_id, session_no, min(ts) AS joined_at, max(ts) AS last_seen, count(*) AS n_beats FROM s GROUP BY user_id, session_no""")
def presence_sessions(c):
    return logs.sessions(c.events.select("user_id", "ts"), 7200)


@query("SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id HAVING max(ts) + INTERVAL 3 HOUR < TIMESTAMP '2024-01-31'")
def presence_expired(c):
    return logs.expired(c.events, lifecycle.at_time("2024-01-31"), 3 * 3600)


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS total
FROM events GROUP BY 1, 2""")
def tumbling_events(c):
    from mnemoscope.streaming import windows

    return windows.windowed(c.events, "1 hour")


@query("""
SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS total
FROM events, range(2) t(k) GROUP BY 1, 2""")
def sliding_events(c):
    from mnemoscope.streaming import windows

    return windows.windowed(c.events, "1 hour", "30 minutes")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS n
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS joined_at, max(ts) + INTERVAL 2 HOUR AS expires_at, count(*) AS n_beats FROM s GROUP BY user_id, k""")
def session_events(c):
    from mnemoscope.streaming import windows

    return windows.presence(c.events, "2 hours")


@query("SELECT 'events_total{kind=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def prometheus_counters(c):
    counts = c.events.groupBy(F.col("event_type").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return logs.prometheus(counts, "events_total", "kind")


# Workflows and skills. A trace is a user's day.

STEPS = """(
  SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, event_type AS action,
         row_number() OVER w AS step_idx, lag(event_type) OVER w AS after
  FROM events WINDOW w AS (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id))"""
SIGNED = f"""(SELECT user_id, day, string_agg(action, '>' ORDER BY step_idx) AS signature, last(action ORDER BY step_idx) = 'error' AS failed
  FROM {STEPS} s GROUP BY user_id, day)"""
TRACE = ("user_id", "day")


def _steps(c):
    return logs.traces(c.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd")), TRACE)


@query(f"SELECT user_id, day, event_id, step_idx, action, after FROM {STEPS} s")
def workflow_traces(c):
    return _steps(c)


@query(f"SELECT signature, count(*) AS n_traces, count(*) FILTER (WHERE NOT failed) AS n_positive, count(*) FILTER (WHERE failed) AS n_negative FROM {SIGNED} s GROUP BY signature")
def workflow_clusters(c):
    return logs.clusters(logs.signatures(_steps(c), TRACE))


@query(f"""
WITH n AS (SELECT step_idx, action, count(*) AS n FROM {STEPS} s GROUP BY step_idx, action),
r AS (SELECT *, row_number() OVER (PARTITION BY step_idx ORDER BY n DESC, action) AS k, sum(n) OVER (PARTITION BY step_idx) AS n_steps FROM n)
SELECT step_idx, action, round(n / n_steps, 4) AS share, n_steps FROM r WHERE k = 1""")
def workflow_step_template(c):
    return logs.step_template(_steps(c))


@query("SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS signature FROM events GROUP BY user_id")
def tool_signature(c):
    return c.events.groupBy("user_id").agg(S.tool_signature(F.collect_set(F.upper("event_type"))).alias("signature"))


@query("""
SELECT event_id AS run_id, 'start' AS state, event_type AS outcome,
       CASE event_type WHEN 'purchase' THEN 'paid' WHEN 'error' THEN 'failed' ELSE 'open' END AS next_state
FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'exception:io' ELSE event_type END AS event_type FROM events) e""".replace("WHEN 'error' THEN 'failed'", "WHEN 'exception:io' THEN 'failed'"))
def skill_state_machine(c):
    moves = c.spark.createDataFrame(
        [("start", "purchase", "paid", 2), ("start", "exception:*", "failed", 1), ("start", "default", "open", 0)], "state string, on string, to_state string, ordinal int"
    )
    outcome = F.when(F.col("event_type") == "error", "exception:io").otherwise(F.col("event_type"))
    return logs.next_state(moves, c.events.select(F.col("event_id").alias("run_id"), F.lit("start").alias("state"), outcome.alias("outcome")))


@query("""
SELECT p_partkey AS skill_id, (p_brand = 'Brand#2')::INT * 100 + (p_type = 'ECONOMY')::INT * 80 + contains(' ' || p_name || ' ', ' ring ')::INT * 40
       + contains(p_name, 'red')::INT * 10 AS score,
       concat_ws(',', CASE WHEN p_brand = 'Brand#2' THEN 'subject' END, CASE WHEN p_type = 'ECONOMY' THEN 'verb' END,
                 CASE WHEN contains(' ' || p_name || ' ', ' ring ') THEN 'keyword' END, CASE WHEN contains(p_name, 'red') THEN 'text' END) AS reasons
FROM part WHERE p_brand = 'Brand#2' OR p_type = 'ECONOMY' OR contains(' ' || p_name || ' ', ' ring ') OR contains(p_name, 'red')""")
def skill_score(c):
    skills = c.part.select(F.col("p_partkey").alias("skill_id"), F.col("p_brand").alias("subject"), F.col("p_type").alias("verb"), F.split("p_name", " ").alias("keywords"), F.col("p_name").alias("text"))
    return text.skill_scores(skills, "Brand#2", "ECONOMY", "ring", "red")


# Text and retrieval.

WORDS = "list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda x: x <> '')"
SEARCH = f"""(
  SELECT doc_id, round((len(list_filter(w, lambda x: x = 'with')) + len(list_filter(w, lambda x: x = 'this'))) / len(w), 6) AS rank, substring(text, 1, 240) AS snippet
  FROM (SELECT doc_id, text, {WORDS} AS w FROM documents) WHERE list_contains(w, 'with') AND list_contains(w, 'this'))"""


@query(f"SELECT doc_id, rank, snippet FROM {SEARCH} s ORDER BY rank DESC, doc_id LIMIT 50")
def text_search_simple(c):
    return text.text_search(c.documents, "this with", 50)


BM25 = [(w, f"t{i}") for i, w in enumerate(("for", "this", "with"))]


@query(f"""
WITH d AS (SELECT doc_id, len(w)::DOUBLE AS n, {', '.join(f"len(list_filter(w, lambda x: x = '{w}'))::DOUBLE AS {t}" for w, t in BM25)} FROM (SELECT doc_id, {WORDS} AS w FROM documents)),
s AS (SELECT count(*) AS docs, avg(n) AS avg_n, {', '.join(f"count(*) FILTER (WHERE {t} > 0) AS d_{t}" for _, t in BM25)} FROM d)
SELECT doc_id, round({' + '.join(f"ln(1 + (docs - d_{t} + 0.5) / (d_{t} + 0.5)) * {t} * 2.2 / ({t} + 1.2 * (0.25 + 0.75 * n / avg_n))" for _, t in BM25)}, 6) AS rank
FROM d, s WHERE {' + '.join(t for _, t in BM25)} > 0 ORDER BY rank DESC, doc_id LIMIT 50""")
def text_search_ranked(c):
    return text.ranked_search(c.documents, "this with for", 50)


@query(f"""
SELECT doc_id, rank FROM (SELECT doc_id, rank FROM {SEARCH} s ORDER BY rank DESC, doc_id LIMIT 250)
WHERE doc_id % 2 = 0 ORDER BY rank DESC, doc_id LIMIT 50""")
def pool_search(c):
    return text.pool_search(c.documents, c.documents.where("doc_id % 2 = 0").select("doc_id"), "this with", 50)


GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^a-z0-9_]+'), lambda x: x <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


@query(f"""
SELECT p_partkey, p_name, similarity FROM (
  SELECT p_partkey, p_name, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity
  FROM (SELECT p_partkey, p_name, {GRAMS.format('p_name')} AS a, {GRAMS.format("'small rings'")} AS b FROM part))
WHERE similarity >= 0.3 ORDER BY similarity DESC, p_partkey LIMIT 40""")
def fuzzy_match(c):
    return text.fuzzy_match(c.part, "small rings", 0.3, 40, "p_partkey", "p_name")


@query("""
WITH t AS (SELECT p_partkey AS text_id, p_brand, list_filter(string_split_regex(lower(p_name || ',  ' || p_type || '  before noon!'), '[\\s,;:!?]+'), lambda x: x <> '') AS w FROM part),
k AS (SELECT text_id, generate_subscripts(w, 1) + 1 AS nth, unnest(w) AS cue_text FROM t)
SELECT text_id, 0 AS nth, 'phrase' AS cue_kind, p_brand AS cue_text, NULL::BIGINT AS resolved_id, 2.0::DOUBLE AS weight FROM t UNION ALL
SELECT text_id, 1, 'time_marker', 'As of 2024-01-01T10:00Z', NULL, 0.5 FROM t UNION ALL
SELECT text_id, nth, CASE WHEN cue_text IN ('red', 'ring') THEN 'subject' WHEN cue_text = 'economy' THEN 'verb' WHEN cue_text = 'noon' THEN 'predicate' ELSE 'term' END, cue_text,
  CASE cue_text WHEN 'red' THEN 1 WHEN 'ring' THEN 3 WHEN 'economy' THEN 5 WHEN 'noon' THEN 6 END,
  CASE WHEN cue_text IN ('red', 'ring', 'economy', 'noon') THEN 1.5 ELSE 1.0 END FROM k""")
def extract_cues(c):
    said = F.concat("p_name", F.lit(", As of  2024-01-01T10:00Z "), "p_type", F.lit(' "'), "p_brand", F.lit('" before noon!'))
    return retrieval.cues(c.part.select(F.col("p_partkey").alias("text_id"), said.alias("text")), c.governed().registry)


@query("""
SELECT doc_id, n_statements, score FROM (
  SELECT l_orderkey AS doc_id, count(*) AS n_statements, count(*) FILTER (WHERE v) * 2 + count(*) FILTER (WHERE s) AS score
  FROM (SELECT l_orderkey, p_type IN ('ECONOMY') AS v, contains(lower(p_name), 'ring') AS s FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE v OR s GROUP BY l_orderkey)
ORDER BY score DESC, doc_id LIMIT 100""")
def note_search(c):
    joined = c.lineitem.join(c.part, F.col("l_partkey") == F.col("p_partkey"))
    made = joined.select(F.monotonically_increasing_id().alias("statement_id"), F.col("l_orderkey").alias("doc_id"), F.col("p_name").alias("subject"), F.col("p_type").alias("verb"))
    return text.note_search(made, "the ring in economy", 100)


OBJECTS = """(
  SELECT 'claim' AS object_type, p_partkey::BIGINT AS object_id, p_name AS title, p_brand AS body FROM part UNION ALL
  SELECT 'fact', o_orderkey, 'customer ' || o_custkey, 'order ' || o_orderkey || ' status ' || o_orderstatus FROM orders UNION ALL
  SELECT 'memory', doc_id, source, text FROM documents UNION ALL
  SELECT 'episode_object', n_nationkey, n_name, 'nation of region ' || n_regionkey FROM nation)"""


def _fts_sql(words: tuple[str, ...]) -> str:
    """All words, title weight 1.0, body 0.4, over the tokens of both."""

    def n(field: str, w: str) -> str:
        return f"len(list_filter({field}, lambda x: x = '{w}'))"

    every = " AND ".join(f"{n('tw', w)} + {n('bw', w)} > 0" for w in words)
    weight = " + ".join(f"1.0 * {n('tw', w)} + 0.4 * {n('bw', w)}" for w in words)
    cut = WORDS.replace("lower(text)", "lower(coalesce({0}, ''))")
    return f"""(SELECT object_type, object_id, title, substring(coalesce(body, ''), 1, 240) AS snippet, round(({weight}) / (len(tw) + len(bw)), 6)::DOUBLE AS rank, 'fts' AS strategy
  FROM (SELECT *, {cut.format('title')} AS tw, {cut.format('body')} AS bw FROM {OBJECTS} o) WHERE {every} ORDER BY rank DESC, object_id, object_type LIMIT 50)"""


def _retrieved_sql(hits: str, floor: float | None = None, limit: int = 40) -> str:
    gate = f"AND (object_type <> 'memory' OR coalesce((SELECT max(quality) FROM labels WHERE doc_id = object_id), 1.0) >= {floor})" if floor is not None else ""
    return f"""
WITH hits AS ({hits}), best AS (SELECT *, row_number() OVER (PARTITION BY object_type, object_id ORDER BY rank DESC, strategy) AS n FROM hits)
SELECT object_type, object_id, title, snippet, rank, strategy FROM best
WHERE n = 1 AND NOT (object_type = 'memory' AND object_id % 10 = 0)
  AND NOT (object_type = 'fact' AND object_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')) {gate}
ORDER BY rank DESC, object_type, object_id LIMIT {limit}"""


@query(_retrieved_sql(f"""
  SELECT * FROM {_fts_sql(('this', 'with'))} UNION ALL
  SELECT 'claim', p_partkey, p_name, p_brand, 1.0, 'source_filter' FROM part WHERE p_size = 7""", 0.5))
def retrieval_execute(c):
    """A source and a text under a floor of confidence; the floor alone would plan by confidence, so the intent is given."""
    asked = retrieval.Envelope("this with", confidence_floor=0.5, hints={"source_package_id": 7, "intent_override": "by_source"})
    return retrieval.execute(c.governed(), asked, limit=40)


@query(_retrieved_sql(f"""
  SELECT * FROM {_fts_sql(('region', 'of'))} UNION ALL
  SELECT 'fact', o_orderkey, 'customer ' || o_custkey, 'order ' || o_orderkey || ' status ' || o_orderstatus, 1.0, 'temporal_as_of' FROM orders
  WHERE o_orderdate + INTERVAL 10 DAY <= {AT} AND o_orderdate + INTERVAL 90 DAY > {AT} UNION ALL
  SELECT 'episode_object', n_nationkey, n_name, 'nation of region ' || n_regionkey, 1.0, 'temporal_as_of' FROM nation"""))
def retrieval_temporal(c):
    return retrieval.execute(c.governed(), retrieval.Envelope("region of", valid_as_of="1998-06-01"), limit=40)


@query(_retrieved_sql(f"""
  SELECT * FROM (SELECT object_type, object_id, subject AS title, NULL AS snippet, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6)::DOUBLE AS rank, 'fuzzy_subject' AS strategy
    FROM (SELECT object_type, object_id, subject, {GRAMS.format('subject')} AS a, {GRAMS.format("'find small widget'")} AS b
          FROM (SELECT object_type, object_id, title AS subject FROM {OBJECTS} o WHERE object_type IN ('claim', 'fact')))
    ORDER BY rank DESC, subject, object_type, object_id LIMIT 50) WHERE rank >= 0.3 UNION ALL
  SELECT * FROM {_fts_sql(('find', 'small', 'widget'))}"""))
def retrieval_fuzzy(c):
    return retrieval.execute(c.governed(), retrieval.Envelope("find small widget"), limit=40)


@query(f"""
SELECT object_type, object_id, rank FROM (
  SELECT object_type, object_id, round((0.4 * (len(list_filter(bw, lambda x: x = 'this')) + len(list_filter(bw, lambda x: x = 'nation'))) + 1.0 * (len(list_filter(tw, lambda x: x = 'this')) + len(list_filter(tw, lambda x: x = 'nation')))
      + 0.4 * len(regexp_extract_all(array_to_string(bw, ' ') || ' ', '\\bregion 2\\b'))) / (len(tw) + len(bw)), 6)::DOUBLE AS rank, tw, bw
  FROM (SELECT *, {WORDS.replace('lower(text)', "lower(coalesce(title, ''))")} AS tw, {WORDS.replace('lower(text)', "lower(coalesce(body, ''))")} AS bw FROM {OBJECTS} o WHERE object_type IN ('memory', 'episode_object')))
WHERE (list_contains(bw, 'this') AND NOT list_contains(bw, 'with') AND NOT list_contains(tw, 'with'))
   OR (regexp_matches(array_to_string(bw, ' '), '\\bregion 2\\b') AND (list_contains(bw, 'nation') OR list_contains(tw, 'nation')))
ORDER BY rank DESC, object_id, object_type LIMIT 60""")
def text_search_web(c):
    """A word without another, or a phrase with a word, over two types."""
    m = c.governed()
    every = m.table("memory").unionByName(m.table("episode_object")).select("object_type", "object_id", "title", "body")
    found = text.web_search(every, 'this -with OR "region 2" nation')
    return found.select("object_type", "object_id", "rank").orderBy(F.desc("rank"), "object_id", "object_type").limit(60)


@query("""
SELECT * FROM (VALUES (0, 'time_as_of', 'temporal_as_of,fts'), (1, 'by_confidence', 'confidence_floor,fts'), (2, 'by_source', 'source_filter,fts'),
  (3, 'structured_doc_qa', 'tree_descent,fts'), (4, 'long_chat_recall', 'tree_descent'), (5, 'narrow', 'svpor_routing,fts,vector'), (6, 'recall', 'fuzzy_subject,fts'),
  (7, 'broad', 'fts,vector,graph_walk'), (8, 'broad', 'vector,fts'), (9, 'recall', 'fts,fuzzy_subject'), (10, 'structured_doc_qa', 'tree_descent,fts')) t(query_id, intent, plan)""")
def retrieval_intent(c):
    known = c.governed().registry
    asked: list[tuple[retrieval.Envelope, dict]] = [
        (retrieval.Envelope("what changed", valid_as_of="1998-06-01", confidence_floor=0.5), {}),
        (retrieval.Envelope("ring", confidence_floor=0.5), {}),
        (retrieval.Envelope("ring", hints={"connector_id": 3}), {}),
        (retrieval.Envelope("ring", hints={"tree_id": 1}), {}),
        (retrieval.Envelope("ring", hints={"chat_index_tree_id": 1}), {}),
        (retrieval.Envelope("Red economy bolts"), {}),
        (retrieval.Envelope("  Show me bolts"), {}),
        (retrieval.Envelope("rings of whatever"), {}),
        (retrieval.Envelope("bolts"), {"force_path": ["vector"], "suppress_path": ["graph_walk"], "boost_weight": {"fts": 2.0}}),
        (retrieval.Envelope("bolts"), {"intent_override": "recall", "force_path": ["fts", "absent"]}),
        (retrieval.Envelope("bolts", object_types=("page_index_node",)), {}),
    ]
    plans = [retrieval.planned(e, known, hints) for e, hints in asked]
    return c.spark.createDataFrame([(i, p.intent, ",".join(p.strategies())) for i, p in enumerate(plans)], "query_id int, intent string, plan string")


@query("""
WITH o AS (SELECT *, CASE WHEN role = 'user' AND (lag(role) OVER w IS NULL OR lag(role) OVER w = 'assistant') THEN 1 ELSE 0 END AS n
           FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, role, sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS topic_no FROM o""")
def chat_topics(c):
    return text.chat_topics(c.conversations)


@query()
def markdown_outline(c):
    said = F.concat(F.lit("# Page "), F.col("page_id"), F.lit("\n"), F.regexp_replace(F.regexp_replace("html", "<h1>", "\n## "), "<[^>]*>", " "))
    return text.outline(c.pages.select(F.col("page_id").alias("doc_id"), said.alias("text")))


@query("SELECT doc_id, 0 AS level, 0 AS first_byte, strlen(coalesce(text, '')) AS end_byte FROM documents")
def plain_text_outline(c):
    return ingest.plain_text(c.documents)


# Attributes, references, governance.


@query("""
SELECT p_partkey AS target_id, p_brand AS brand, p_type AS type, CAST(p_size AS VARCHAR) AS size FROM part""")
def attribute_pivot(c):
    return text.attribute_pivot(_attributes(c), ["brand", "type", "size"])


def _attributes(c):
    pairs = F.array(*(F.struct(F.lit(n).alias("attr_name"), F.col(f"p_{n}").cast("string").alias("value")) for n in ("brand", "type", "size")))
    return c.part.select(F.col("p_partkey").alias("target_id"), F.explode(pairs).alias("a")).select("target_id", "a.*")


@query("SELECT p_partkey AS target_id, 'colour' AS attr_name FROM part UNION ALL SELECT p_partkey, 'size' FROM part WHERE p_size < 10")
def attribute_missing(c):
    targets = c.part.select(F.col("p_partkey").alias("target_id"), F.lit("part").alias("kind"))
    template = c.spark.createDataFrame([("part", "colour"), ("part", "size"), ("part", "brand"), ("tool", "grip")], "kind string, attr_name string")
    have = _attributes(c).where("attr_name <> 'size' OR CAST(value AS INT) >= 10")
    return text.missing_attributes(targets, template, have)


@query("SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey")
def reference_join_left(c):
    return ingest.referenced(c.orders, c.customer.where("c_acctbal > 0"), "o_custkey", "c_custkey", "left").select("o_orderkey", "o_custkey", "c_name")


@query("SELECT o_orderkey, o_custkey, c_name FROM orders JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey")
def reference_join_inner(c):
    return ingest.referenced(c.orders, c.customer.where("c_acctbal > 0"), "o_custkey", "c_custkey", "inner").select("o_orderkey", "o_custkey", "c_name")


LEVEL = "CASE lang WHEN 'en' THEN 'public' WHEN 'de' THEN 'internal' WHEN 'fr' THEN 'restricted' ELSE 'secret' END"


@query(f"""
SELECT doc_id, CASE {LEVEL} WHEN 'public' THEN 0 WHEN 'internal' THEN 1 WHEN 'restricted' THEN 2 ELSE 3 END AS rank FROM documents
WHERE {LEVEL} IN ('public', 'internal')""")
def sensitivity_ceiling(c):
    level = F.when(F.col("lang") == "en", "public").when(F.col("lang") == "de", "internal").when(F.col("lang") == "fr", "restricted").otherwise("secret")
    return c.documents.select("doc_id", G.sensitivity_rank(level).alias("rank")).where("rank <= 1")


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3')")
def scope_filter(c):
    return c.documents.where(G.in_scope(F.col("source"), ["src1", "src2", "src3"], ["src1", "src3", "src9"])).select("doc_id", "source")


@query("""
SELECT o_orderkey, text, coalesce(n_nationkey, -1) AS entry_id, n_name AS canonical FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'n' || (o_orderkey % 30) ELSE 'NATION_' || (o_orderkey % 30) END AS text, o_orderkey % 30 AS k FROM orders)
LEFT JOIN nation ON k = n_nationkey""")
def alias_resolve(c):
    key = F.col("o_orderkey") % 30
    names = c.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("n"), key)).otherwise(F.concat(F.lit("NATION_"), key)).alias("text"))
    registry = c.nation.select(F.col("n_nationkey").alias("entry_id"), F.col("n_name").alias("canonical"), F.array(F.concat(F.lit("n"), F.col("n_nationkey"))).alias("aliases"))
    found = text.resolved(names, registry).join(registry.select("entry_id", "canonical"), "entry_id", "left")
    return found.select("o_orderkey", "text", F.coalesce("entry_id", F.lit(-1)).alias("entry_id"), "canonical")


@query("SELECT sha256(coalesce(text, '')) AS content_hash, min(doc_id) AS first_id, count(*) AS n_copies FROM documents GROUP BY 1")
def content_hash_dedupe(c):
    return c.documents.groupBy(S.content_hash(F.col("text")).alias("content_hash")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"))


@query("SELECT doc_id AS object_id FROM documents WHERE doc_id % 3 <> 0")
def embedding_dirty(c):
    now = c.documents.select(F.col("doc_id").alias("object_id"), S.content_hash(F.col("text")).alias("content_hash"))
    seen = c.documents.where("doc_id % 3 <> 1").select(F.col("doc_id").alias("object_id"), S.content_hash(F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!")))).alias("content_hash"))
    return logs.dirty(now, seen).select("object_id")


@query("""
SELECT o_orderkey AS object_id FROM orders WHERE o_orderstatus = 'P' OR o_orderdate < TIMESTAMP '1996-01-01'
ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END NULLS FIRST, o_orderkey LIMIT 500""")
def reindex_claim(c):
    objects = c.orders.select(F.col("o_orderkey").alias("object_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("last_indexed"))
    return logs.reindex_claims(objects, lifecycle.at_time("1996-01-01"), lifecycle.at_time("1995-06-01"), 5000).select("object_id")


@query("SELECT n_nationkey, round((100 - n_nationkey * 4) / 100.0, 4)::DOUBLE AS old_weight, round(n_nationkey * 4 / 100.0, 4)::DOUBLE AS new_weight FROM nation")
def route_weights(c):
    return c.nation.select("n_nationkey", G.route(F.col("n_nationkey") * 4).alias("r")).select("n_nationkey", "r.*")


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '_', 'g'), '_') AS slug, greatest(1, (length(p_name) + 3) // 4) AS tokens FROM part")
def slugs(c):
    return c.part.select("p_partkey", S.slug(F.concat("p_name", F.lit(" / "), F.col("p_type"))).alias("slug"), S.estimated_tokens(F.col("p_name")).alias("tokens"))


@query("SELECT p_partkey, 'name: ' || p_name || chr(10) || 'type: ' || p_type || chr(10) || 'size: ' || p_size AS card FROM part")
def entity_cards(c):
    return c.part.select("p_partkey", S.card(("name", F.col("p_name")), ("type", F.col("p_type")), ("size", F.col("p_size"))).alias("card"))


@query("SELECT event_id, CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) > 90 THEN 1 ELSE 0 END AS n_errors FROM events")
def payload_validate(c):
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 90}}, "additionalProperties": False}
    return c.events.select("event_id", F.size(G.payload_errors(F.col("props"), schema)).alias("n_errors"))


@query(f"SELECT chunk_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 5) AS norm FROM {CHUNKS} c")
def vector_norms(c):
    return c.chunks().select("chunk_id", F.round(VF.norm(VF.normalized(F.col("embedding"))), 5).alias("norm"))


@query("SELECT o_orderkey, o_orderdate <= TIMESTAMP '1998-01-01' AND o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1998-01-01' AS valid FROM orders")
def validity_window(c):
    end = F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")
    return c.orders.select("o_orderkey", T.valid_at(F.col("o_orderdate"), end, lifecycle.at_time("1998-01-01")).alias("valid"))


# Grants, models, phrases, communities, pools.


@query("""
SELECT doc_id AS object_id FROM documents WHERE doc_id IN (
  SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus <> 'F' AND o_orderdate > TIMESTAMP '1997-01-01')""")
def grant_check(c):
    grants = c.orders.select(
        F.col("o_orderkey").alias("object_id"),
        F.col("o_orderpriority").alias("level"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("revoked_at"),
        F.col("o_orderdate").alias("expires_at"),
    )
    return records.granted(c.documents.select(F.col("doc_id").alias("object_id")), grants, "2-HIGH", lifecycle.at_time("1997-01-01"))


@query("""
SELECT p_partkey AS model_id, p_size AS context FROM part WHERE p_size >= 40
ORDER BY (p_type = 'ECONOMY') DESC, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END DESC NULLS LAST, p_partkey LIMIT 25""")
def model_negotiation(c):
    models = c.part.select(
        F.col("p_partkey").alias("model_id"), (F.col("p_type") == "ECONOMY").alias("gpu"), F.col("p_size").alias("context"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("speed")
    )
    return records.negotiated(models, 40).limit(25).select("model_id", "context")


@query("""
SELECT phrase, n_nationkey AS verb_id, CASE WHEN phrase = lower(n_name) THEN 1 WHEN phrase = 'alias ' || n_nationkey THEN 2 ELSE 3 END AS source
FROM nation, LATERAL (SELECT unnest([lower(n_name), 'alias ' || n_nationkey, 'to do ' || n_nationkey]) AS phrase)""")
def verb_phrase_lookup(c):
    number = F.col("n_nationkey")
    verbs = c.nation.select(
        number.alias("verb_id"), F.col("n_name").alias("canonical"), F.array(F.concat(F.lit("Alias "), number)).alias("aliases"), F.array(F.concat(F.lit("To do "), number), F.concat(F.lit("alias "), number)).alias("phrases")
    )
    asked = c.nation.select(F.explode(F.array(F.lower("n_name"), F.concat(F.lit("alias "), number), F.concat(F.lit("to do "), number))).alias("phrase"))
    return records.phrase_lookup(asked, verbs).select("phrase", "verb_id", "source")


@query("SELECT c_custkey, 'seg' AS owner, c_custkey AS id FROM customer WHERE c_custkey % 2 = 0")
def address_resolve(c):
    address = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("mdo://seg/"), F.col("c_custkey"))).otherwise(F.concat(F.lit("http://seg/"), F.col("c_custkey")))
    return c.customer.select("c_custkey", records.resolved_address(address).alias("r")).where("r is not null").select("c_custkey", "r.*")


@query("""
SELECT 'old' AS namespace, c_mktsegment AS community, c_custkey AS member FROM customer UNION ALL
SELECT 'new', 'n' || c_nationkey, c_custkey FROM customer WHERE c_acctbal > 0""")
def community_replace(c):
    own = c.customer.select(F.lit("old").alias("namespace"), F.col("c_mktsegment").alias("community"), F.col("c_custkey").alias("member"))
    stale = own.withColumn("namespace", F.lit("new"))
    fresh = c.customer.select(F.lit("new").alias("namespace"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("community"), F.col("c_custkey").alias("member"))
    known = c.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("member"))
    return records.replaced_communities(own.unionByName(stale), fresh, known, "new")[0]


@query("SELECT event_id FROM events WHERE event_type = 'click' AND CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) = 7")
def json_containment(c):
    return c.events.where(records.contains_fields(F.col("props"), {"k": 7}) & (F.col("event_type") == "click")).select("event_id")


@query("""
SELECT user_id AS pool_id, event_type AS subject, count(*) AS support FROM events GROUP BY user_id, event_type HAVING count(*) >= 12""")
def pool_promote(c):
    seen = c.events.select(F.col("user_id").alias("pool_id"), F.col("event_type").alias("subject"), F.lit("did").alias("verb"), F.lit("it").alias("value"))
    return records.promoted(seen, 12)[0].select("pool_id", "subject", "support")


@query("""
SELECT 1000000 + c_nationkey AS memory_id, string_agg(c_name, chr(10) ORDER BY c_custkey) AS title, 'active' AS lifecycle_state FROM customer GROUP BY c_nationkey""")
def memory_consolidate(c):
    memories = c.customer.select(F.col("c_custkey").alias("memory_id"), F.col("c_name").alias("title"))
    groups = c.customer.select(F.col("c_nationkey").cast("long").alias("group_id"), F.col("c_custkey").alias("memory_id"))
    return records.consolidated(memories, groups, 1_000_000)[0]


@query("""
SELECT s_suppkey AS target_id, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_nationkey AS VARCHAR) END, s_name) AS value,
       CASE WHEN s_suppkey % 5 = 0 THEN 'reference' WHEN s_suppkey % 3 = 0 THEN 'numeric' ELSE 'text' END AS value_type FROM supplier""")
def attribute_types(c):
    none = F.lit(None).cast("string")
    made = c.supplier.select(
        F.col("s_suppkey").alias("target_id"),
        F.lit("home").alias("attr_name"),
        F.lit(None).cast("timestamp").alias("value_timestamp"),
        F.when(F.col("s_suppkey") % 3 == 0, F.col("s_nationkey")).alias("value_numeric"),
        F.col("s_name").alias("value_text"),
        none.alias("value_json"),
        F.when(F.col("s_suppkey") % 5 == 0, "erp").alias("ref_source"),
    )
    return records.typed_attributes(made).select("target_id", "value", "value_type")


@query("""
SELECT o_orderkey, o_orderstatus IN ('O', 'P') AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderpriority <> '5-LOW' AS fits FROM orders""")
def applicability(c):
    rule = F.struct(
        F.lit("live").alias("environment"), F.array(F.lit("O"), F.lit("P")).alias("stack"), lifecycle.at_time("1996-01-01").alias("from"), F.lit(None).cast("timestamp").alias("until")
    )
    live = F.when(F.col("o_orderpriority") == "5-LOW", "test").otherwise("live")
    return c.orders.select("o_orderkey", records.applicable(live, F.array("o_orderstatus"), F.col("o_orderdate"), rule).alias("fits"))


@query("""
WITH o AS (SELECT *, CASE WHEN role = 'user' AND (lag(role) OVER w IS NULL OR lag(role) OVER w = 'assistant') THEN 1 ELSE 0 END AS n
           FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
t AS (SELECT conv_id, turn, text, sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS topic_no FROM o),
g AS (SELECT conv_id, topic_no, lower(string_agg(text, ' ' ORDER BY turn)) AS title FROM t GROUP BY conv_id, topic_no),
r AS (SELECT *, contains(title, 'with')::INT + contains(title, 'this')::INT + contains(title, 'and')::INT + contains(title, 'for')::INT AS score FROM g WHERE conv_id = (SELECT min(conv_id) FROM g))
SELECT 0 AS depth, 'chat:' || min(conv_id) AS node FROM r UNION ALL
SELECT * FROM (SELECT 1, 'topic:' || conv_id || ':' || topic_no FROM r ORDER BY score DESC, topic_no LIMIT 1)""")
def chat_descent(c):
    """Topics of conversations as a tree; the walk follows the words of a question."""
    turns = text.chat_topics(c.conversations).join(c.conversations.select("conv_id", "turn", "text"), ["conv_id", "turn"])
    topic = turns.groupBy("conv_id", "topic_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("title"))
    leaf = topic.select(F.concat_ws(":", F.lit("topic"), "conv_id", "topic_no").alias("node"), F.concat_ws(":", F.lit("chat"), "conv_id").alias("parent"), F.lit("topic").alias("kind"), F.col("topic_no").alias("ordinal"), "title")
    root = topic.select("conv_id").distinct().select(F.concat_ws(":", F.lit("chat"), "conv_id").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit("chat").alias("kind"), F.col("conv_id").alias("ordinal"), F.lit("").alias("title"))
    return graph.descend(leaf.unionByName(root), text.overlap_score(F.col("title"), "with this and for"), 2)


@query(f"""
SELECT fact_id, valid_to IS NULL OR valid_to > {AT} AS open FROM {FACTS} f
WHERE {VALID} AND valid_from + INTERVAL 10 DAY <= {AT} AND (valid_to IS NULL OR valid_to + INTERVAL 40 DAY > {AT}) AND lifecycle_state = 'active'""")
def fact_as_of_recorded(c):
    """Valid and recorded at the time: facts are recorded ten days late."""
    made = c.facts().withColumns({"recorded_from": F.col("valid_from") + F.expr("INTERVAL 10 DAYS"), "recorded_to": F.col("valid_to") + F.expr("INTERVAL 40 DAYS")})
    return lifecycle.as_of(made, lifecycle.at_time("1998-06-01")).select("fact_id", F.coalesce(F.col("valid_to") > lifecycle.at_time("1998-06-01"), F.lit(True)).alias("open"))


@query(f"""
SELECT fact_id, CASE WHEN fact_id % 500 = 1 AND (valid_to IS NULL OR valid_to > {AT}) THEN {AT} ELSE valid_to END AS valid_to,
       CASE WHEN fact_id % 500 = 1 THEN 'retired' ELSE lifecycle_state END AS lifecycle_state FROM {FACTS} f""")
def retract_fact(c):
    gone = c.facts().where("fact_id % 500 = 1").select("fact_id", F.lit("wrong").alias("reason"))
    return lifecycle.retracted(c.facts(), gone, lifecycle.at_time("1998-06-01")).select("fact_id", "valid_to", "lifecycle_state")


@query("""
SELECT o_orderkey AS fact_id, CASE WHEN o_orderstatus = 'F' THEN 'already superseded' END AS reason FROM orders WHERE o_orderkey % 100 = 0 AND o_orderstatus = 'F'
UNION ALL SELECT -5, 'unknown fact'""")
def correction_faults(c):
    asked = c.facts().where("fact_id % 100 = 0").select("fact_id").unionByName(c.spark.createDataFrame([(-5,)], "fact_id long"))
    return lifecycle.correction_faults(c.facts(), asked)


@query("""
SELECT o_orderkey AS predecessor_id, o_orderkey + 100000000 AS successor_id, 'correction' AS supersession_kind, 'typo' AS reason FROM orders WHERE o_orderkey % 1000 = 0 UNION ALL
SELECT o_orderkey, NULL, 'retraction', 'wrong' FROM orders WHERE o_orderkey % 500 = 1""")
def supersession_edges(c):
    fixes = c.facts().where("fact_id % 1000 = 0").select("fact_id", (F.col("fact_id") + 100_000_000).alias("new_fact_id"), F.lit("typo").alias("reason"))
    gone = c.facts().where("fact_id % 500 = 1").select("fact_id", F.lit("wrong").alias("reason"))
    return lifecycle.supersession_edges(fixes).unionByName(lifecycle.supersession_edges(gone, "retraction"))


@query("""
SELECT event_id, event_id % 4 = 0 AS same_number, event_id % 4 = 1 AS same_text, event_id % 4 = 2 AS same_flag, event_id % 4 = 3 AS in_array FROM events""")
def json_containment_typed(c):
    """A number, its text, a flag and an array of objects, told apart by type."""
    made = [F.lit('{"a":{"k":7,"x":null}}'), F.lit('{"a":{"k":"7"}}'), F.lit('{"a":{"k":true}}'), F.lit('{"a":[{"k":1},{"k":7,"z":[2]}]}')]
    said = F.element_at(F.array(*made), (F.col("event_id") % 4 + 1).cast("int"))
    wanted = ({"a.k": 7}, {"a": {"k": "7"}}, {"a": {"k": True}}, {"a": [{"k": 7}]})
    return c.events.select("event_id", *(records.contains_fields(said, w).alias(n) for n, w in zip(("same_number", "same_text", "same_flag", "in_array"), wanted, strict=True)))


@query("""
SELECT p_partkey AS model_id, p_type AS kind, CASE WHEN p_partkey = 3 THEN 'active' WHEN p_partkey % 5 = 0 AND p_type = (SELECT p_type FROM part WHERE p_partkey = 3) THEN 'retiring'
  WHEN p_partkey % 5 = 0 THEN 'active' ELSE 'canary' END AS state FROM part""")
def model_rollout(c):
    """One model of a kind becomes active; those of its kind that were retire."""
    models = c.part.select(F.col("p_partkey").alias("model_id"), F.col("p_type").alias("kind"), F.when(F.col("p_partkey") % 5 == 0, "active").otherwise("canary").alias("state"))
    return records.advanced_model(models, 3, "active")


@query(f"""
SELECT 'nation:' || n_nationkey AS node, CASE WHEN n_nationkey % 2 = 0 THEN TIMESTAMP '1990-01-01'
  WHEN n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey = 3) THEN {AT} END AS stale_after FROM nation""")
def staleness_marks(c):
    """Neighbours of a changed supplier are marked; older marks stay."""
    objects = c.nation.select(F.concat(F.lit("nation:"), "n_nationkey").alias("node"), F.when(F.col("n_nationkey") % 2 == 0, lifecycle.at_time("1990-01-01")).alias("stale_after"))
    return graph.marked_stale(objects, c.edges(), "supplier:3", lifecycle.at_time("1998-06-01"))


JOBS = f"(SELECT event_id AS job_id, user_id % 3 AS queue_id, {STATUS} AS status, event_id % 4 AS attempts FROM events)"


def _leased(c):
    return _jobs(c).select(
        "job_id", (F.col("queue_id") % 3).alias("queue_id"), "status", (F.col("job_id") % 4).alias("attempts"), "visible_at", F.lit(None).cast("string").alias("last_error"), F.concat(F.lit("p"), "job_id").alias("payload")
    )


def _nacked(c):
    queues = c.spark.createDataFrame([(0, 2, 9), (1, 3, None), (2, 1, 8)], "queue_id long, max_retries int, dlq_queue_id long")
    nacks = _leased(c).where("status = 'leased' AND job_id % 2 = 0").select("job_id", F.lit("boom").alias("error"))
    return logs.nacked(_leased(c), nacks, queues, lifecycle.at_time("2024-03-01"))


@query(f"SELECT job_id, CASE WHEN status = 'leased' AND job_id % 2 = 1 THEN 'done' ELSE status END AS status FROM {JOBS} j")
def queue_ack(c):
    return logs.acked(_leased(c), _leased(c).where("job_id % 2 = 1").select("job_id")).select("job_id", "status")


@query(f"""
SELECT job_id, CASE WHEN status = 'leased' AND job_id % 2 = 0 THEN CASE WHEN attempts >= [2, 3, 1][queue_id + 1] THEN 'dead' ELSE 'ready' END ELSE status END AS status,
       CASE WHEN status = 'leased' AND job_id % 2 = 0 THEN 'boom' END AS last_error FROM {JOBS} j""")
def queue_nack(c):
    return _nacked(c)[0].select("job_id", "status", "last_error")


@query(f"""
SELECT CASE queue_id WHEN 0 THEN 9 ELSE 8 END AS queue_id, queue_id AS source_queue, job_id AS source_job_id, 'boom' AS last_error, 'p' || job_id AS payload FROM {JOBS} j
WHERE status = 'leased' AND job_id % 2 = 0 AND attempts >= [2, 3, 1][queue_id + 1] AND queue_id <> 1""")
def queue_dead_letters(c):
    return _nacked(c)[1]


@query("SELECT DISTINCT user_id % 7 AS pool_id, user_id AS account, 'presence_left' AS event_kind FROM events WHERE user_id % 5 = 0")
def presence_leave(c):
    members = c.events.select((F.col("user_id") % 7).alias("pool_id"), F.col("user_id").alias("account")).distinct()
    leaves = members.where("account % 5 = 0").unionByName(c.spark.createDataFrame([(1, -1)], "pool_id long, account long"))
    return logs.left(members, leaves, lifecycle.at_time("2024-03-01"))[1].drop("at")


@query("SELECT doc_id AS object_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS generation FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0")
def embedding_generations(c):
    """Every third object was embedded as of its first generation; those queued again since stay."""
    queue = c.documents.select(F.col("doc_id").alias("object_id"), F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1).alias("generation"))
    return logs.embedded(queue, c.documents.where("doc_id % 3 = 0").select(F.col("doc_id").alias("object_id"), F.lit(1).alias("generation")))


TOOLED = """(SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS step_idx,
  event_type AS action, 'actor ' || (event_id % 3) AS actor, CASE WHEN event_id % 4 <> 0 THEN ' Tool' || (event_id % 2) END AS tool,
  CASE WHEN event_type = 'error' THEN 'exception:io' || (event_id % 2) WHEN event_id % 6 = 0 THEN 'partial' ELSE 'success' END AS outcome FROM events)"""


def _tooled(c):
    number = F.col("event_id")
    outcome = F.when(F.col("action") == "error", F.concat(F.lit("exception:io"), number % 2)).when(number % 6 == 0, "partial").otherwise("success")
    return _steps(c).withColumns({"actor": F.concat(F.lit("actor "), number % 3), "tool": F.when(number % 4 != 0, F.concat(F.lit(" Tool"), number % 2)), "outcome": outcome})


@query(f"""
WITH t AS (SELECT user_id, day, last(outcome ORDER BY step_idx) AS last_, coalesce(string_agg(DISTINCT lower(trim(tool)), '|' ORDER BY lower(trim(tool))), '') AS tool_stack,
  coalesce(replace(last(outcome ORDER BY step_idx) FILTER (WHERE starts_with(outcome, 'exception:')), 'exception:', ''), '') AS exception_pattern FROM {TOOLED} s GROUP BY user_id, day)
SELECT CASE WHEN starts_with(last_, 'exception:') THEN 'failure' ELSE last_ END AS outcome, user_id % 2 AS environment, tool_stack, exception_pattern, count(*) AS n_traces,
       count(*) FILTER (WHERE NOT starts_with(last_, 'exception:')) AS n_positive, count(*) FILTER (WHERE starts_with(last_, 'exception:')) AS n_negative FROM t GROUP BY ALL""")
def workflow_six_keys(c):
    """Clusters of traces by outcome, environment, tools and last exception; subject and action are one class here."""
    made = logs.trace_summaries(_tooled(c), TRACE).withColumns({"subject_class": F.lit("user"), "action_class": F.lit("visit"), "environment": F.col("user_id") % 2})
    return logs.clusters(made, logs.CLUSTER).drop("subject_class", "action_class")


@query(f"""
WITH s AS (SELECT * FROM {TOOLED} t), g AS (SELECT step_idx, round(count(*) FILTER (WHERE outcome = 'success') / count(*), 4) AS success_rate, count(*) AS sample_count FROM s GROUP BY step_idx),
{', '.join(f"{x} AS (SELECT step_idx, {x} AS common_{x} FROM (SELECT step_idx, {x}, row_number() OVER (PARTITION BY step_idx ORDER BY count(*) DESC, {x}) AS k FROM s WHERE {x} IS NOT NULL GROUP BY step_idx, {x}) WHERE k = 1)" for x in ('action', 'actor', 'tool'))}
SELECT g.*, common_action, common_actor, common_tool FROM g LEFT JOIN action USING (step_idx) LEFT JOIN actor USING (step_idx) LEFT JOIN tool USING (step_idx)""")
def workflow_candidate(c):
    return logs.candidate_template(_tooled(c))


@query("""
SELECT p_partkey AS query_id, CASE WHEN p_type = 'ECONOMY' THEN 'economise' WHEN contains(p_name, 'ring') THEN 'string' ELSE NULL END AS verb,
       CASE WHEN p_type = 'ECONOMY' THEN 1 WHEN contains(p_name, 'ring') THEN 2 END AS verb_id,
       CASE WHEN p_type = 'ECONOMY' THEN 'economy' WHEN contains(p_name, 'ring') THEN 'ring' END AS matched_token,
       array_to_string(list_filter(string_split(lower(p_name || CASE WHEN contains(' ' || p_name || ' ', ' ' || lower(p_type) || ' ') THEN '' ELSE ' ' || p_type END), ' '), lambda w: w <> coalesce(CASE WHEN p_type = 'ECONOMY' THEN 'economy' WHEN contains(p_name, 'ring') THEN 'ring' END, '')), ',') AS subject_tokens
FROM part WHERE p_name NOT LIKE '%string%'""")
def note_query_parse(c):
    verbs = c.spark.createDataFrame([(1, "economise", ["Economy"]), (2, "string", None), (3, "zzz", ["yyy"])], "verb_id int, canonical string, aliases array<string>")
    asked = c.part.where("p_name NOT LIKE '%string%'").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("What about the "), "p_name", F.lit(" in "), "p_type", F.lit("?")).alias("query"))
    return text.note_query(asked, verbs).select("query_id", "verb", "verb_id", "matched_token", F.array_join("subject_tokens", ",").alias("subject_tokens"))


@query("""
WITH hit AS (SELECT l_orderkey AS document_id, l_orderkey * 10 + l_linenumber AS statement_id FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE p_type IN ('ECONOMY', 'PROMO') AND (contains(p_name, 'red') OR l_suppkey = 7))
SELECT o_orderkey AS document_id, o_orderpriority AS title, count(DISTINCT statement_id) AS match_count FROM hit JOIN orders ON document_id = o_orderkey WHERE o_orderstatus = 'O'
GROUP BY o_orderkey, o_orderpriority, o_orderdate ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 40 OFFSET 5""")
def notes_about(c):
    """Statements join a part's type (verb) and name (subject) to a supplier; documents are orders."""
    types = [(1, "ECONOMY", ["cheap"]), (2, "PROMO", ["Cheap offer"]), (3, "LARGE", None), (4, "MEDIUM", None), (5, "STANDARD", None), (6, "SMALL", None)]
    verbs = c.spark.createDataFrame(types, "id long, canonical string, aliases array<string>")
    number = c.part.join(verbs, F.col("p_type") == F.col("canonical")).select("p_partkey", F.col("id").alias("verb_id"))
    made = c.lineitem.join(number, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("statement_id"), F.col("l_orderkey").alias("document_id"), "verb_id", F.col("l_partkey").alias("subject_id"), (-F.col("l_suppkey")).alias("object_id")
    )
    none = F.lit(None).cast("array<string>")
    subjects = c.part.select(F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("canonical"), none.alias("aliases")).unionByName(
        c.supplier.select((-F.col("s_suppkey")).cast("long").alias("id"), F.col("s_name").alias("canonical"), F.when(F.col("s_suppkey") == 7, F.array(F.lit("Red Baron"))).alias("aliases"))
    )
    documents = c.orders.select(F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") == "O", "note").otherwise("mail").alias("source_type"), F.col("o_orderdate").alias("created_at"))
    return text.notes_about(documents, made, verbs, subjects, ["red"], verb_like="cheap", limit=40, offset=5).select("document_id", "title", "match_count")


@query("SELECT doc_id FROM documents WHERE source IN ('src1', 'src3') AND lang IN ('en', 'de')")
def principal_scope(c):
    """A principal reads two scopes up to a level."""
    who = c.spark.createDataFrame([("a", True, '["src1", "src3"]', "internal"), ("b", False, None, None)], "name string, enabled boolean, scopes string, ceiling string")
    level = F.when(F.col("lang") == "en", "public").when(F.col("lang") == "de", "internal").when(F.col("lang") == "fr", "restricted").otherwise("secret")
    return c.documents.where(G.principal(who, "a").sees(F.col("source"), level)).select("doc_id")


@query("SELECT label % 4 AS object_kind, label AS object_id, max(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * vec_id) AS embedded_at FROM embeddings GROUP BY label")
def embedding_newest(c):
    cards = c.embeddings.select((F.col("label") % 4).alias("object_kind"), F.col("label").alias("object_id"), (lifecycle.at_time("2024-01-01") + F.make_dt_interval(hours=F.col("vec_id").cast("int"))).alias("embedded_at"))
    return vectors.newest_embedding(cards)


@query("""
SELECT c_custkey AS connector, coalesce(arg_max('at ' || event_id, event_id) FILTER (WHERE event_type <> 'error'), 'start') AS cursor, 5 + coalesce(sum(event_id % 7), 0)::BIGINT AS items
FROM customer LEFT JOIN events ON c_custkey = user_id GROUP BY c_custkey""")
def connector_checkpoint(c):
    cursors = c.customer.select(F.col("c_custkey").alias("connector"), F.lit("start").alias("cursor"), F.lit(5).cast("long").alias("items"))
    failed = F.when(F.col("event_type") == "error", "broken")
    reports = c.events.select(F.col("user_id").alias("connector"), F.col("event_id").alias("nth"), F.concat(F.lit("at "), "event_id").alias("cursor"), (F.col("event_id") % 7).alias("items"), failed.alias("error"))
    return logs.checkpoints(cursors, reports)


@query("SELECT 'document' AS object_kind, doc_id AS object_id, CASE WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 3 = 1 THEN 4 ELSE 3 END AS generation FROM documents")
def embedding_queue(c):
    """Objects of one remainder are new, of another changed, of the third only queued before."""
    kind = F.lit("document").alias("object_kind")
    queue = c.documents.where("doc_id % 3 <> 0").select(kind, F.col("doc_id").alias("object_id"), F.lit(3).alias("generation"))
    return transforms.queued(queue, c.documents.where("doc_id % 3 <> 2").select(kind, F.col("doc_id").alias("object_id")))


@query("SELECT doc_id, coalesce(CASE WHEN source <> 'src2' THEN source END, 'src1') AS scope, 'loader' AS created_by FROM documents WHERE source IN ('src1', 'src2', 'src3')")
def ingest_stamp(c):
    """Rows without a scope get the principal's first."""
    who = G.Principal("loader", ("src1", "src3"), 3)
    rows = c.documents.where("source IN ('src1', 'src2', 'src3')").select("doc_id", F.when(F.col("source") != "src2", F.col("source")).alias("scope"))
    return transforms.stamped(rows, who, lifecycle.at_time("2024-01-01")).select("doc_id", "scope", "created_by")


@query("""
SELECT o_orderkey AS source_id, o_custkey AS target_id FROM orders
WHERE o_orderdate <= TIMESTAMP '1998-06-01' AND (o_orderstatus = 'O' OR o_orderdate + INTERVAL 60 DAY > TIMESTAMP '1998-06-01')""")
def edges_as_of(c):
    """Edges of open orders have no end."""
    begun = F.col("o_orderdate").cast("timestamp")
    made = c.orders.select(F.col("o_orderkey").alias("source_id"), F.col("o_custkey").alias("target_id"), begun.alias("valid_from"), F.when(F.col("o_orderstatus") != "O", begun + F.expr("INTERVAL 60 DAYS")).alias("valid_to"))
    return lifecycle.edges_as_of(made, lifecycle.at_time("1998-06-01")).select("source_id", "target_id")


@query("""
SELECT o_orderkey AS object_id, CASE WHEN o_orderkey % 7 = 0 AND o_custkey % 10 <> 0 THEN 'archived' WHEN o_orderkey % 7 = 0 THEN 'active' ELSE o_orderstatus END AS state FROM orders""")
def lifecycle_states(c):
    """Some objects are archived; those on hold may only go back to active."""
    objects = c.orders.select(F.col("o_orderkey").alias("object_id"), F.col("o_orderstatus").alias("state"))
    holds = c.orders.where("o_custkey % 10 = 0").select(F.col("o_orderkey").alias("object_id"))
    changes = c.orders.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("object_id"), F.when(F.col("o_custkey") % 10 == 0, "active").otherwise("archived").alias("state"))
    return lifecycle.with_states(objects, changes, holds)


@query("SELECT o_orderkey AS object_id, CASE WHEN o_orderkey % 11 = 0 THEN 'tombstoned' ELSE o_orderstatus END AS state FROM orders")
def prune_objects(c):
    objects = c.orders.select(F.col("o_orderkey").alias("object_id"), F.col("o_orderstatus").alias("state"))
    return lifecycle.pruned(objects, objects.where("object_id % 11 = 0").select("object_id", F.lit("old").alias("reason")), objects.where("object_id % 11 = 1").select("object_id"))


@query("""
WITH m AS (SELECT event_id AS member_id, user_id AS pool_id, CASE WHEN event_type = 'view' THEN 'pending_claim' ELSE 'observation' END AS kind, event_id * 2 AS object_id FROM events),
f AS (SELECT * FROM m WHERE kind = 'pending_claim' AND member_id % 3 = 0)
SELECT member_id, pool_id, kind, object_id, CASE WHEN kind = 'pending_claim' AND member_id % 3 = 0 THEN member_id + 1000000 END AS promoted_to FROM m UNION ALL
SELECT member_id + 1000000, pool_id, 'fact', member_id + 1000000, NULL FROM f""")
def pool_promote_to_fact(c):
    kind = F.when(F.col("event_type") == "view", "pending_claim").otherwise("observation")
    members = c.events.select(F.col("event_id").alias("member_id"), F.col("user_id").alias("pool_id"), kind.alias("kind"), (F.col("event_id") * 2).alias("object_id"), F.lit(None).cast("long").alias("promoted_to"))
    return records.promoted_to_facts(members, members.where("kind = 'pending_claim' AND member_id % 3 = 0").select("member_id"), 1_000_000)[0]


@query("""
SELECT * FROM (VALUES ('dual_serve', 4, 0.7::DOUBLE, 'source', 12), ('dual_serve', 9, 0.3, 'target', 12)) t(strategy, space_id, weight, role, migration_id)""")
def route_query(c):
    models = c.spark.createDataFrame([("embedding", "active", 4), ("embedding", "canary", 9), ("rank", "active", 7)], "kind string, state string, space_id long")
    moves = c.spark.createDataFrame([(11, 4, 8, "aborted", 50.0, 5), (12, 4, 9, "dual_serve", 30.0, 3), (13, 4, 8, "cutover", 0.0, 1)], "migration_id long, source_space long, target_space long, status string, percent double, started_at int")
    return records.routed(models, moves)


@query("""
SELECT doc_id, rank FROM (SELECT doc_id, 0.0::DOUBLE AS rank, row_number() OVER (ORDER BY doc_id % 10, doc_id) AS n FROM documents WHERE doc_id % 2 = 0) WHERE n <= 30""")
def pool_search_fallback(c):
    """Nothing matches, so the members come in the order in which they were added."""
    members = c.documents.where("doc_id % 2 = 0").select("doc_id", (F.col("doc_id") % 10).alias("added_at"))
    return text.pool_search(c.documents, members, "zzzz nowhere", 30, fallback=True)


@query(f"""
SELECT skill_id, round(s + near, 6) AS score, concat_ws(',', CASE WHEN s >= 100 THEN 'subject' END, CASE WHEN near > 0 THEN 'embedding' END) AS reasons FROM (
  SELECT p_partkey AS skill_id, CASE WHEN p_brand = 'Brand#2' THEN 100 ELSE 0 END AS s, coalesce(near, 0) AS near
  FROM part LEFT JOIN (SELECT chunk_id, greatest(round(1 - {COSINE}, 6), 0) AS near FROM {CHUNKS} c, {Q} p) v ON chunk_id = p_partkey) WHERE s + near > 0""")
def skill_score_embedding(c):
    skills = c.part.select(F.col("p_partkey").alias("skill_id"), F.col("p_brand").alias("subject"), F.col("p_type").alias("verb"), F.array().cast("array<string>").alias("keywords"), F.col("p_name").alias("text"))
    own = c.chunks().select(F.col("chunk_id").alias("skill_id"), "embedding")
    return text.skill_scores(skills, "Brand#2", None, None, None, own, probe())


@query(f"SELECT chunk_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))) * 3, 4) AS norm, 1.0::DOUBLE AS unit FROM {CHUNKS} c")
def vector_register(c):
    """Chunks come three times as long; they are kept at length 1, with the length that they had."""
    longer = F.transform("embedding", lambda x: (x.cast("double") * 3).cast("float"))
    made = c.chunks().select("chunk_id", VF.registered(longer).alias("r"))
    return made.select("chunk_id", F.round("r.norm", 4).alias("norm"), F.round(VF.norm(F.col("r.embedding")), 4).alias("unit"))


@query("""
SELECT 'events_total{event_type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type UNION ALL
SELECT 'documents_total{lang="' || lang || '"} ' || count(*) FROM documents GROUP BY lang UNION ALL
SELECT 'chunks_total{compartment_id="' || label || '"} ' || count(*) FROM embeddings GROUP BY label""")
def metrics_exposition(c):
    return logs.exposition({"events_total": (c.events, "event_type"), "documents_total": (c.documents, "lang"), "chunks_total": (c.chunks(), "compartment_id")})


@query("""
SELECT event_id AS schedule_id, CASE WHEN event_id % 2 = 0 AND date_trunc('day', ts) <= TIMESTAMP '2024-01-15 10:07:00' THEN TIMESTAMP '2024-01-15 10:15:00' ELSE date_trunc('day', ts)::TIMESTAMP END AS next_run_at FROM events""")
def schedule_tick(c):
    """Every second schedule is enabled; those due run again at the next quarter of an hour."""
    own = c.events.select(F.col("event_id").alias("schedule_id"), F.lit("*/15 * * * *").alias("cron"), (F.col("event_id") % 2 == 0).alias("enabled"), F.date_trunc("day", "ts").alias("next_run_at"))
    return logs.ticked(own, lifecycle.at_time("2024-01-15 10:07:00"))[0].select("schedule_id", "next_run_at")


@query("""
SELECT p_partkey::VARCHAR AS routine, n AS name FROM part, (VALUES ('widget'), ('blue rod')) t(n) WHERE contains(p_name, n)""")
def catalog_mentions(c):
    routines = c.part.select(F.col("p_partkey").cast("string").alias("routine"), F.concat(F.lit("SELECT "), F.upper("p_name")).alias("body"))
    return ingest.mentions(routines, c.spark.createDataFrame([("widget",), ("rod",), ("blue rod",)], "name string")).select("routine", "name")
