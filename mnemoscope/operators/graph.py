"""Walks over typed edges (source_kind, source_id, rel, target_kind, target_id) and over trees."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoscope.sources.scratch import settled

DIRECTIONS = ("out", "in", "both")


def _name(kind: str, key: str) -> Column:
    return F.concat(F.col(kind), F.lit(":"), F.col(key))


def arcs(edges: DataFrame, direction: str, rels: Sequence[str] | None = None) -> DataFrame:
    """Edges as (node, rel, next): two equi-joinable sides, never a join on either endpoint."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {DIRECTIONS}")
    if rels:
        edges = edges.where(F.col("rel").isin(list(rels)))
    source, target = _name("source_kind", "source_id"), _name("target_kind", "target_id")
    out = edges.select(source.alias("node"), "rel", target.alias("next"))
    back = edges.select(target.alias("node"), "rel", source.alias("next"))
    return out if direction == "out" else back if direction == "in" else out.unionByName(back)


def neighbors(edges: DataFrame, node: str, direction: str = "both", rels: Sequence[str] | None = None) -> DataFrame:
    """Distinct (rel, node) one step away."""
    kind, key = node.split(":")
    here = (F.col("source_kind") == kind) & (F.col("source_id") == int(key))
    there = (F.col("target_kind") == kind) & (F.col("target_id") == int(key))
    parts = []
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {DIRECTIONS}")
    if direction in ("out", "both"):
        parts.append(arcs(edges.where(here), "out", rels))
    if direction in ("in", "both"):
        parts.append(arcs(edges.where(there), "in", rels))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select("rel", F.col("next").alias("node")).distinct()


#: Rows of a frontier up to which its keys go into the scans of the next step.
PUSHED = 1000


def _named(kind: str, key: str) -> Column:
    return F.concat(F.col(kind), F.lit(":"), F.col(key).cast("string"))


def _steps(edges: DataFrame, direction: str, rels: Sequence[str] | None) -> list[DataFrame]:
    """Edges as (kind, id, rel, next_kind, next_id), for each way that a direction allows."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {DIRECTIONS}")
    if rels:
        edges = edges.where(F.col("rel").isin(list(rels)))
    ends = {"out": ("source", "target"), "in": ("target", "source")}
    return [
        edges.select(F.col(f"{a}_kind").alias("kind"), F.col(f"{a}_id").alias("id"), "rel", F.col(f"{b}_kind").alias("next_kind"), F.col(f"{b}_id").alias("next_id"))
        for way, (a, b) in ends.items() if direction in (way, "both")
    ]


def walk(edges: DataFrame, node: str, depth: int = 4, direction: str = "both", rels: Sequence[str] | None = None) -> DataFrame:
    """All simple paths from a node: (depth, node, rel, path); the seed itself isn't a row.

    Stores are scanned only if their kind is in the frontier, and while the frontier is
    small its identifiers go into the scans; a larger one is written and joined.
    """
    if not 0 <= depth <= 32:
        raise ValueError("depth is 0 to 32")
    spark = edges.sparkSession
    ways = _steps(edges, direction, rels)
    kind, key = node.split(":")
    schema = "kind string, id long, path array<string>"
    front: DataFrame = spark.createDataFrame([(kind, int(key), [node])], schema)
    keys: dict[str, list[int]] | None = {kind: [int(key)]}
    kinds = [kind]
    out = None
    for level in range(1, depth + 1):
        if keys is None:
            near = [w.where(F.col("kind").isin(kinds)) for w in ways]
        else:
            here = reduce(lambda a, b: a | b, [(F.col("kind") == k) & F.col("id").isin(ids) for k, ids in keys.items()])
            near = [w.where(here) for w in ways]
        grown = reduce(DataFrame.unionByName, near).join(front, ["kind", "id"])
        name = _named("next_kind", "next_id")
        grown = grown.where(~F.array_contains("path", name)).select(F.col("next_kind").alias("kind"), F.col("next_id").alias("id"), F.concat("path", F.array(name)).alias("path"), "rel").distinct()
        few = grown.limit(PUSHED + 1).collect()
        if len(few) <= PUSHED:
            found = spark.createDataFrame([(r.kind, r.id, r.path, r.rel) for r in few], f"{schema}, rel string")
            keys = {}
            for r in few:
                keys.setdefault(r.kind, []).append(r.id)
            keys = {k: sorted(set(ids)) for k, ids in keys.items()}
        else:
            found = settled(grown, "walk")
            # One row for each kind of node.
            keys, kinds = None, [r.kind for r in found.select("kind").distinct().collect()]
        rows = found.select(F.lit(level).alias("depth"), _named("kind", "id").alias("node"), "rel", F.array_join("path", ">").alias("path"))
        out = rows if out is None else out.unionByName(rows)
        if not few:
            break
        front = found.drop("rel").distinct()
    return out if out is not None else spark.createDataFrame([], "depth int, node string, rel string, path string")


def ordered(found: DataFrame, mode: str = "bfs") -> DataFrame:
    """Rows of a walk in the order of a search: level by level, or each path down to its end."""
    if mode not in ("bfs", "dfs"):
        raise ValueError("mode is bfs or dfs")
    return found.orderBy("depth", "path", "rel") if mode == "bfs" else found.orderBy("path", "rel")


def unified_neighbors(edges: DataFrame, labels: DataFrame, node: str, direction: str = "both", rels: Sequence[str] | None = None, semantic: bool = False) -> DataFrame:
    """Neighbours with their labels (kind, id, label); semantic edges only on request. A node without label is called by its name."""
    kept = edges if semantic else edges.where(F.col("edge_store") != "semantic")
    found = neighbors(kept, node, direction, rels)
    split = found.withColumns({"kind": F.substring_index("node", ":", 1), "id": F.substring_index("node", ":", -1).cast("long")})
    return split.join(labels, ["kind", "id"], "left").select("rel", "node", F.coalesce("label", "node").alias("label"))


def reachable(edges: DataFrame, node: str, depth: int, direction: str = "both") -> DataFrame:
    """Distinct nodes with their least depth: breadth first, so dense graphs don't multiply paths."""
    steps = arcs(edges, direction).select("node", "next")
    seen = edges.sparkSession.range(1).select(F.lit(node).alias("node"), F.lit(0).alias("depth"))
    front = seen
    for level in range(1, depth + 1):
        front = front.select("node").join(steps, "node").select(F.col("next").alias("node")).distinct()
        front = settled(front.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(level)), "reach")
        seen = seen.unionByName(front)
    return seen


def paths(edges: DataFrame, source: str, target: str, depth: int = 6, direction: str = "out") -> DataFrame:
    """Paths between two nodes, shortest first."""
    return walk(edges, source, depth, direction).where(F.col("node") == target).select("depth", "path")


def degree(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, total); a self-loop counts in both."""
    ends = edges.select(F.col("source_kind").alias("kind"), F.col("source_id").alias("id"), F.lit(1).alias("o")).unionByName(
        edges.select(F.col("target_kind").alias("kind"), F.col("target_id").alias("id"), F.lit(0).alias("o"))
    )
    sums = ends.groupBy("kind", "id").agg(F.sum("o").alias("out_degree"), F.sum(1 - F.col("o")).alias("in_degree"), F.count(F.lit(1)).alias("total"))
    return sums.select(_named("kind", "id").alias("node"), "out_degree", "in_degree", "total")


def top_degree(edges: DataFrame, limit: int) -> DataFrame:
    return degree(edges).orderBy(F.desc("total"), "node").limit(min(max(limit, 1), 1000))


def surprises(links: DataFrame, sources: DataFrame, targets: DataFrame, limit: int) -> DataFrame:
    """Links (source, target) between communities, rarest pair of communities first.

    sources, targets: (member, community) of either end. Counts have one row for each
    pair of communities; the limit is a top-k, each task keeps its best.
    """
    a = sources.select(F.col("member").alias("source"), F.col("community").alias("ca"))
    b = targets.select(F.col("member").alias("target"), F.col("community").alias("cb"))
    crossing = links.join(a, "source").join(b, "target").where(F.col("ca") != F.col("cb"))
    crossing = crossing.select("source", "target", F.least("ca", "cb").alias("low"), F.greatest("ca", "cb").alias("high"))
    counts = crossing.groupBy("low", "high").agg(F.count(F.lit(1)).alias("pair_count"))
    return crossing.join(counts, ["low", "high"]).select("source", "target", "low", "high", "pair_count").orderBy("pair_count", "source", "target").limit(limit)


def ancestors(tree: DataFrame, node: str, depth: int = 32) -> DataFrame:
    """(node, depth) upwards from a node, itself at 0; one point look-up a level."""
    level = tree.where(F.col("node") == node).select("node", "parent", F.lit(0).alias("depth"))
    out = level
    for i in range(1, depth + 1):
        level = level.select(F.col("parent").alias("node")).where(F.col("node").isNotNull()).join(tree, "node").select("node", "parent", F.lit(i).alias("depth"))
        out = out.unionByName(level)
    return out.select("node", "depth")


def descendants(tree: DataFrame, node: str, depth: int) -> DataFrame:
    """(node, depth, ordinal_path) downwards, itself at 0; null ordinals are written ``?``."""
    ordinal = F.coalesce(F.col("ordinal").cast("string"), F.lit("?"))
    level = tree.where(F.col("node") == node).select("node", F.lit(0).alias("depth"), ordinal.alias("ordinal_path"))
    out = level
    for i in range(1, depth + 1):
        up = level.select(F.col("node").alias("parent"), "ordinal_path")
        level = tree.join(up, "parent").select("node", F.lit(i).alias("depth"), F.concat("ordinal_path", F.lit("."), ordinal).alias("ordinal_path"))
        out = out.unionByName(level)
    return out


def roots(tree: DataFrame, depth: int) -> DataFrame:
    """(node, root, depth) of every node that a root reaches within a depth, level by level from the top.

    A level is written, so the planner knows its size: the small upper ones are broadcast.
    """
    own = tree.select("node", "parent")
    level = settled(own.where(F.col("parent").isNull()).select("node", F.col("node").alias("root"), F.lit(0).alias("depth")), "roots")
    out = level
    for i in range(1, depth + 1):
        up = level.select(F.col("node").alias("parent"), "root")
        level = settled(own.where(F.col("parent").isNotNull()).join(up, "parent").select("node", "root", F.lit(i).alias("depth")), "roots")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def children_json(tree: DataFrame) -> DataFrame:
    """(parent, subtree): each parent's children as JSON, in order of their ordinals."""
    own = F.array_sort(F.collect_list(F.struct("ordinal", "node", "kind")))
    return tree.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.to_json(own).alias("subtree"))


def subtree_json(tree: DataFrame, node: str, depth: int) -> DataFrame:
    """One row (subtree): a node and all below it down to a depth, as nested JSON with children in order of their ordinals.

    The result is one text by its nature; ``depth`` bounds it.
    """
    own = tree.select("node", "parent", "ordinal")
    levels = [own.where(F.col("node") == node)]
    for _ in range(depth):
        levels.append(own.join(levels[-1].select(F.col("node").alias("parent")), "parent").select("node", "parent", "ordinal"))

    def said(children: Column) -> Column:
        return F.concat(F.lit('{"node":"'), F.col("node"), F.lit('","children":['), children, F.lit("]}"))

    made = levels[-1].withColumn("subtree", said(F.lit("")))
    for level in reversed(levels[:-1]):
        items = F.array_sort(F.collect_list(F.struct("ordinal", "node", "subtree")))
        below = made.groupBy("parent").agg(F.array_join(F.transform(items, lambda x: x["subtree"]), ",").alias("inner")).withColumnRenamed("parent", "node")
        made = level.join(below, "node", "left").withColumn("subtree", said(F.coalesce("inner", F.lit("")))).drop("inner")
    return made.select("subtree")


def stale(edges: DataFrame, node: str) -> DataFrame:
    """Distinct neighbours in both directions that a change of a node makes stale."""
    return neighbors(edges, node, "both").select("node").distinct()


def marked_stale(objects: DataFrame, edges: DataFrame, node: str, at: Column) -> DataFrame:
    """Objects (node, stale_after) with the neighbours of a changed node marked; an older mark stays."""
    hit = stale(edges, node).withColumn("_hit", F.lit(True))
    return objects.join(hit, "node", "left").withColumn("stale_after", F.when(F.col("_hit"), F.coalesce("stale_after", at)).otherwise(F.col("stale_after"))).drop("_hit")


def descend(tree: DataFrame, score: Column, depth: int = 6) -> DataFrame:
    """(depth, node) of the greedy descent from the lowest root: at each node to the child of the highest score, then the lowest ordinal.

    Only the children of the current node are scored; one row a level reaches the driver.
    """
    spark = tree.sparkSession
    here = tree.where(F.col("parent").isNull()).orderBy("ordinal").select("node").first()
    path = []
    while here is not None and len(path) <= depth:
        path.append((len(path), here.node))
        children = tree.where(F.col("parent") == here.node)
        here = children.select("node", "ordinal", score.alias("score")).orderBy(F.desc("score"), "ordinal").first() if len(path) <= depth else None
    return spark.createDataFrame(path, "depth int, node string")
