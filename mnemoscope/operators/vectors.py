"""Vector search over chunks (chunk_id, compartment_id, embedding)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoscope.functions import vectors as V

DIGITS = 6


def query_vector(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def unit(values: Sequence[float]) -> list[float]:
    """A query of length 1; chunks are kept at that length, so all metrics are of one scale."""
    size = float(np.linalg.norm(np.asarray(values, np.float64)))
    return [float(v) / size for v in values] if size else [float(v) for v in values]


def scored(chunks: DataFrame, query: Column, metric: str = "cosine") -> DataFrame:
    """Chunks that have a vector, with their distance, rounded so that ties are ties on every engine.

    A vector of another size than the query's raises an error.
    """
    return chunks.where(F.col("embedding").isNotNull()).withColumn("distance", F.round(V.distance(metric, F.col("embedding"), query), DIGITS))


def exact_topk(chunks: DataFrame, query: Column, k: int, metric: str = "cosine") -> DataFrame:
    """The k nearest by (distance, chunk_id): each task keeps k rows, one merges them."""
    best = scored(chunks, query, metric).orderBy("distance", "chunk_id").limit(max(k, 0))
    rank = F.row_number().over(Window.orderBy("distance", "chunk_id"))
    near = F.round(V.similarity(metric, F.col("distance")), DIGITS)
    return best.select("chunk_id", "compartment_id", "distance", near.alias("similarity"), rank.alias("rank_no"))


def topk_by_compartment(chunks: DataFrame, query: Column, k: int, metric: str = "cosine") -> DataFrame:
    own = Window.partitionBy("compartment_id").orderBy("distance", "chunk_id")
    found = scored(chunks, query, metric).select("chunk_id", "compartment_id", "distance", F.row_number().over(own).alias("rank_no"))
    return found.where(F.col("rank_no") <= k)


def tagged(compartments: DataFrame, namespace: str, subject: str | None = None, verb: str | None = None) -> DataFrame:
    """Compartments (compartment_id, namespace, subject_name, verb_name) of a namespace with a subject, a verb, or both."""
    if subject is None and verb is None:
        raise ValueError("a subject or a verb is required")
    found = compartments.where(F.col("namespace") == namespace)
    for column, name in (("subject_name", subject), ("verb_name", verb)):
        if name is not None:
            found = found.where(F.col(column) == name)
    return found.select("compartment_id", "subject_name", "verb_name")


def tag_search(chunks: DataFrame, query: Column, k: int, compartments: Sequence[int]) -> DataFrame:
    """Top k over some compartments; at least one is required."""
    if not compartments:
        raise ValueError("a subject or a verb is required")
    return exact_topk(chunks.where(F.col("compartment_id").isin(list(compartments))), query, k)


def memory_search(
    chunks: DataFrame, compartments: DataFrame, query: Column | None, k: int = 20, namespace: str = "default",
    subject: str | None = None, verb: str | None = None, metric: str = "cosine", sensitivities: DataFrame | None = None, ceiling: int | None = None,
) -> DataFrame:
    """The k nearest chunks (chunk_id, compartment_id, statement_id, document_id, embedding) of the compartments that tags name.

    sensitivities: (document_id, level 0 to 3). Hits of documents above the ceiling are
    left out after the k are taken, so there may be fewer; a document without a level stays.
    """
    if query is None:
        raise ValueError("a query vector is required")
    own = chunks.join(tagged(compartments, namespace, subject, verb), "compartment_id")
    best = scored(own, query, metric).orderBy("distance", "compartment_id", "chunk_id").limit(max(k, 0))
    near = F.round(V.similarity(metric, F.col("distance")), DIGITS)
    ranked = best.withColumns({"similarity": near, "rank_no": F.row_number().over(Window.orderBy("distance", "compartment_id", "chunk_id"))})
    columns = ["chunk_id", "statement_id", "document_id", "distance", "similarity", "rank_no", "subject_name", "verb_name"]
    if ceiling is None or sensitivities is None:
        return ranked.select(*columns)
    return ranked.join(sensitivities, "document_id", "left").where(F.coalesce("level", F.lit(0)) <= ceiling).select(*columns)


KINDS_SCORED = ("cosine", "l2", "ip")


def semantic_search(cards: DataFrame, query: Sequence[float], k: int = 10, kinds: Sequence[str] | None = None, space: str | None = None, metric: str = "cosine") -> DataFrame:
    """The k best cards (object_kind, object_id, embedding, embedding_space) of any kind, by score; cards of other sizes stand aside."""
    if metric not in KINDS_SCORED:
        raise ValueError(f"metric is one of {KINDS_SCORED}")
    found = cards.where(F.size("embedding") == len(query))
    if kinds:
        found = found.where(F.col("object_kind").isin(list(kinds)))
    if space is not None:
        found = found.where(F.col("embedding_space") == space)
    score = F.round(V.similarity(metric, V.distance(metric, F.col("embedding"), query_vector(query))), DIGITS)
    return found.select("object_kind", "object_id", score.alias("score")).orderBy(F.desc("score"), "object_kind", "object_id").limit(max(k, 1))


def semantic_neighbors(cards: DataFrame, kind: str, key: int, k: int = 5, least: float = 0.70, space: str = "entity-v1") -> DataFrame:
    """The k nearest other cards of an object's kind and space, computed at once; no rows if it has no card."""
    if kind not in ("subject", "svpor_statement"):
        raise ValueError("kind is subject or svpor_statement")
    own = cards.where((F.col("object_kind") == kind) & (F.col("embedding_space") == space) & F.col("embedding").isNotNull())
    here = own.where(F.col("object_id") == key).select("embedding").first()  # one card
    if here is None:
        return own.select(F.col("object_kind").alias("neighbor_kind"), F.col("object_id").alias("neighbor_id"), F.lit(0.0).alias("similarity")).limit(0)
    others = own.where((F.col("object_id") != key) & (F.size("embedding") == len(here.embedding)))
    near = F.round(1 - V.cosine_distance(F.col("embedding"), query_vector(here.embedding)), DIGITS)
    found = others.select(F.col("object_kind").alias("neighbor_kind"), F.col("object_id").alias("neighbor_id"), near.alias("similarity"))
    return found.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "neighbor_id").limit(max(k, 1))


def forgotten(tombstones: DataFrame, chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Tombstones with those of ``ids`` (chunk_id) that are chunks, each once."""
    known = ids.join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id")
    return tombstones.select("chunk_id").unionByName(known).distinct()


def newest_embedding(cards: DataFrame) -> DataFrame:
    """When each object (object_kind, object_id) was last embedded."""
    return cards.groupBy("object_kind", "object_id").agg(F.max("embedded_at").alias("embedded_at"))


def filtered_search(chunks: DataFrame, query: Column, k: int, keep: Column) -> DataFrame:
    """Over-fetch four times k, filter, rank again; may return fewer than k."""
    near = scored(chunks, query).orderBy("distance", "chunk_id").limit(4 * k).where(keep)
    best = near.orderBy("distance", "chunk_id").limit(k)
    return best.select("chunk_id", "distance", F.row_number().over(Window.orderBy("distance", "chunk_id")).alias("rank_no"))


def without_tombstones(chunks: DataFrame, tombstones: DataFrame) -> DataFrame:
    return chunks.join(tombstones, "chunk_id", "left_anti")


def compartment_stats(chunks: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return chunks.groupBy("compartment_id").agg(
        n.alias("n_chunks"), F.round(F.avg(V.norm(F.col("embedding"))), 4).alias("avg_norm"), V.search_mode(n).alias("search_mode")
    )


BLOCK = 1024


def knn_edges(chunks: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """The k most similar chunks of each chunk's compartment with a cosine of at least ``least``.

    Compartments are dealt into blocks, and unordered pairs of blocks are cells of at
    most 2 * BLOCK vectors; a cell keeps k rows of each of its vectors, on both sides,
    and a window keeps k of those. No row is made for a pair that isn't among some
    cell's best. Chunks without a vector have no edges.
    """
    chunks = chunks.where(F.col("embedding").isNotNull()).select("compartment_id", "chunk_id", "embedding")
    sizes = chunks.groupBy("compartment_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = chunks.join(F.broadcast(sizes) if sizes.limit(100_001).count() <= 100_000 else sizes, "compartment_id").withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = dealt.select("compartment_id", "chunk_id", "embedding", "block", every)
    cells = placed.select("compartment_id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "chunk_id", "embedding")

    def best(sims: np.ndarray, own: np.ndarray, targets: np.ndarray) -> list[np.ndarray]:
        """(source, target, similarity) of the k best of each row: by similarity, then the lower target, which stand in order."""
        take = min(k, sims.shape[1])
        edge = np.partition(sims, sims.shape[1] - take, axis=1)[:, sims.shape[1] - take, None] if take < sims.shape[1] else np.full((len(own), 1), -np.inf)
        at, to = np.nonzero((sims >= np.maximum(edge, least)))
        order = np.lexsort((targets[to], -sims[at, to], at))
        at, to = at[order], to[order]
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        at, to = at[nth < k], to[nth < k]
        return [own[at], targets[to], np.minimum(1.0, sims[at, to])]

    def cell(part: pd.DataFrame) -> pd.DataFrame:
        a, b = part[part.side == 0].sort_values("chunk_id"), part[part.side == 1].sort_values("chunk_id")
        same = not len(b) and part.i.iloc[0] == part.j.iloc[0]
        b = a if same else b
        if not len(a) or not len(b):
            return pd.DataFrame({"source_id": [], "target_id": [], "similarity": []})
        x, y = (np.stack(p.embedding.to_numpy()).astype(np.float64) for p in (a, b))
        x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (x, y))
        sims, one, two = np.round(x @ y.T, DIGITS), a.chunk_id.to_numpy(), b.chunk_id.to_numpy()
        sims[one[:, None] == two[None, :]] = -np.inf
        parts = [best(sims, one, two)] if same else [best(sims, one, two), best(sims.T, two, one)]
        return pd.DataFrame(dict(zip(("source_id", "target_id", "similarity"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    found = cells.groupBy("compartment_id", "i", "j").applyInPandas(cell, "source_id long, target_id long, similarity double")
    own = Window.partitionBy("source_id").orderBy(F.desc("similarity"), "target_id")
    return found.withColumn("rank_no", F.row_number().over(own)).where(F.col("rank_no") <= k)


def refreshed_edges(old: DataFrame, found: DataFrame) -> DataFrame:
    """Semantic edges (source_id, target_id, similarity) with new ones put in, in whichever direction they stood."""
    low, high = F.least("source_id", "target_id"), F.greatest("source_id", "target_id")
    new = found.select(low.alias("low"), high.alias("high"), F.col("similarity").alias("_new")).groupBy("low", "high").agg(F.max("_new").alias("_new"))
    kept = old.withColumns({"low": low, "high": high}).join(new, ["low", "high"], "left")
    kept = kept.select("source_id", "target_id", F.coalesce("_new", "similarity").alias("similarity"))
    fresh = new.join(old.select(low.alias("low"), high.alias("high")), ["low", "high"], "left_anti")
    return kept.unionByName(fresh.select(F.col("low").alias("source_id"), F.col("high").alias("target_id"), F.col("_new").alias("similarity")))


def mutual(edges: DataFrame) -> DataFrame:
    """Edges that stand in both directions, once."""
    back = edges.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("source_id"))
    return edges.where("source_id < target_id").join(back, ["source_id", "target_id"], "left_semi")


class CellIndex:
    """Approximate search: centroids of a bounded sample, and every row in its nearest cell."""

    SAMPLE, ROUNDS = 20_000, 10

    def __init__(self, chunks: DataFrame, cells: int = 16):
        chunks = chunks.where(F.col("embedding").isNotNull())
        picked = chunks.orderBy(F.xxhash64("chunk_id")).limit(self.SAMPLE).select("embedding").collect()
        points = np.array([r.embedding for r in picked], np.float64)
        points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300) if len(points) else 1
        self.centroids = points[: min(cells, len(points))].copy()
        for _ in range(self.ROUNDS):
            if not len(points):
                break
            own = (points @ self.centroids.T).argmax(axis=1)
            for c in range(len(self.centroids)):
                if (own == c).any():
                    mean = points[own == c].mean(axis=0)
                    self.centroids[c] = mean / max(np.linalg.norm(mean), 1e-300)
        self.path = None
        self.rows = chunks.withColumn("cell", self._cell(F.col("embedding")))

    def _cell(self, vector: Column) -> Column:
        """The number of the nearest centroid, the lowest of equal ones, by array expressions."""
        near = F.array(*(F.struct(F.round(V.dot(vector, query_vector(c)), 12).alias("s"), F.lit(-i).alias("c")) for i, c in enumerate(self.centroids)))
        return -F.array_max(near)["c"] if len(self.centroids) else F.lit(0)

    def write(self, path: str) -> CellIndex:
        """Write the rows once, a folder for each cell, so that a search reads only the cells that it probes."""
        self.rows.repartition("cell").write.partitionBy("cell").parquet(path)
        self.rows, self.path = self.rows.sparkSession.read.parquet(path), path
        return self

    def added(self, chunks: DataFrame) -> DataFrame:
        """Rows of new chunks with their cells, to be appended below ``path``."""
        out = chunks.where(F.col("embedding").isNotNull()).withColumn("cell", self._cell(F.col("embedding")))
        if self.path:
            out.write.mode("append").partitionBy("cell").parquet(self.path)
        return out

    def search(self, query: Sequence[float], k: int, probes: int = 12, tombstones: DataFrame | None = None) -> DataFrame:
        """The k nearest of the cells whose centroids are nearest; forgotten chunks are left out."""
        order = np.argsort(-(self.centroids @ np.asarray(query, np.float64)), kind="stable")[:probes]
        rows = self.rows.where(F.col("cell").isin([int(c) for c in order]))
        return exact_topk(without_tombstones(rows, tombstones) if tombstones is not None else rows, query_vector(query), k)
