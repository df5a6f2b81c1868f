"""Sources: JSON extractions, node-link graphs, catalog listings, plain texts and external tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a link's label says about its confidence.
CONFIDENCE = {"EXTRACTED": 1.0, "INFERRED": 0.7, "AMBIGUOUS": 0.4}

EXTRACTION = (
    "subjects array<struct<name:string,type:string,aliases:array<string>>>,"
    "verbs array<struct<name:string>>,"
    "edges array<struct<subject:string,verb:string,object:string,confidence:double>>,"
    "relationships array<struct<source:string,relation:string,target:string>>"
)
GRAPH = "nodes array<struct<id:string,label:string>>, links array<struct<source:string,target:string,relation:string,confidence:string>>"


def extraction(docs: DataFrame) -> dict[str, DataFrame]:
    """Sections of JSON extractions (doc_id, payload), and ``skipped``: items and documents that can't be used."""
    read = docs.select("doc_id", F.from_json("payload", EXTRACTION, {"mode": "PERMISSIVE"}).alias("p"), "payload")
    bad = F.col("p").isNull() | (F.col("p.subjects").isNull() & F.col("p.verbs").isNull() & F.col("p.edges").isNull() & F.col("p.relationships").isNull())
    subjects = read.select("doc_id", F.posexplode("p.subjects").alias("item", "s")).select("doc_id", "item", "s.*")
    verbs = read.select("doc_id", F.posexplode("p.verbs").alias("item", "v")).select("doc_id", "item", "v.*")
    edges = read.select("doc_id", F.posexplode("p.edges").alias("item", "e")).select("doc_id", "item", "e.*")
    related = read.select("doc_id", F.posexplode("p.relationships").alias("item", "r")).select("doc_id", "item", "r.*")
    linked = F.col("source").isNotNull() & F.col("relation").isNotNull() & F.col("target").isNotNull()
    whole = F.col("subject").isNotNull() & F.col("verb").isNotNull() & F.col("object").isNotNull()
    skipped = (
        read.where(bad).select("doc_id", F.lit(None).cast("int").alias("item"), F.lit("not an extraction").alias("reason"))
        .unionByName(edges.where(~whole).select("doc_id", "item", F.lit("an edge needs subject, verb and object").alias("reason")))
        .unionByName(related.where(~linked).select("doc_id", "item", F.lit("a relationship needs source, relation and target").alias("reason")))
        .unionByName(subjects.where("name is null").select("doc_id", "item", F.lit("a subject needs a name").alias("reason")))
    )
    return {"subjects": subjects.where("name is not null"), "verbs": verbs.where("name is not null"), "edges": edges.where(whole), "relationships": related.where(linked), "skipped": skipped}


def link_confidence(label: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, value in CONFIDENCE.items():
        out = F.when(F.upper(label) == name, value).otherwise(out)
    return F.coalesce(out, F.lit(CONFIDENCE["AMBIGUOUS"]))


#: Nodes and links that one graph may have.
MOST_NODES, MOST_LINKS = 50_000, 200_000


def graph(docs: DataFrame, most_nodes: int = MOST_NODES, most_links: int = MOST_LINKS) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of node-link JSON (payload); links to unknown nodes are left out, a graph of too many is an error."""
    read = docs.select(F.from_json("payload", GRAPH).alias("g"))
    over = (F.size("g.nodes") > most_nodes) | (F.size("g.links") > most_links)
    read = read.select(F.when(over, F.raise_error(F.lit(f"a graph has more than {most_nodes} nodes or {most_links} links")).cast(read.schema["g"].dataType)).otherwise(F.col("g")).alias("g"))
    nodes = read.select(F.explode("g.nodes").alias("n")).select("n.*").where("id is not null").dropDuplicates(["id"])
    links = read.select(F.explode("g.links").alias("l")).select("l.*")
    links = links.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    return nodes, links.withColumn("confidence", link_confidence(F.col("confidence")))


def catalog_graph(spark: SparkSession) -> tuple[list[tuple[str, str]], list[tuple[str, str, str]]]:
    """Nodes (name, kind) and links (child, belongs_to, parent) of the session's tables and columns."""
    nodes, links = [], []
    for t in spark.catalog.listTables():
        nodes.append((t.name, "view" if t.isTemporary else "table"))
        for c in spark.catalog.listColumns(t.name):
            nodes.append((f"{t.name}.{c.name}", "column"))
            links.append((f"{t.name}.{c.name}", "belongs_to", t.name))
    return nodes, links


def plain_text(docs: DataFrame) -> DataFrame:
    """One root node of each text: the span of its bytes."""
    return docs.select("doc_id", F.lit(0).alias("level"), F.lit(0).cast("long").alias("first_byte"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("end_byte"))


def referenced(base: DataFrame, external: DataFrame, ref: str, key: str, how: str = "left") -> DataFrame:
    """External rows beside their references, compared as text."""
    if how not in ("left", "inner"):
        raise ValueError("how is 'left' or 'inner'")
    return base.join(external, F.col(ref).cast("string") == F.col(key).cast("string"), how)


def reference_view(name: str, base: DataFrame, external: DataFrame, ref: str, key: str, how: str = "left") -> DataFrame:
    """``referenced`` as a view of the session under a name."""
    joined = referenced(base, external, ref, key, how)
    joined.createOrReplaceTempView(name)
    return joined.sparkSession.table(name)


def mentions(routines: DataFrame, names: DataFrame, least: int = 6) -> DataFrame:
    """(routine, name) of routines (routine, body) whose text holds a name of ``least`` letters or more: an inferred link each."""
    known = names.select("name").where(F.length("name") >= least).distinct()
    small = known.limit(100_001).count() <= 100_000
    found = routines.join(F.broadcast(known) if small else known, F.contains(F.lower("body"), F.lower("name")) & (F.lower("routine") != F.lower("name")))
    return found.select("routine", "name", F.lit("mentions").alias("relation"), F.lit(CONFIDENCE["INFERRED"]).alias("confidence"))


def pdf_pages(files: DataFrame) -> DataFrame:
    """(path, page, text) of PDF files (path, content), a file a row, by the pypdf library; an error without it."""
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the pypdf library") from e

    def read(batches):
        import io

        import pandas as pd
        import pypdf

        for batch in batches:
            rows = [(p, i, page.extract_text()) for p, raw in zip(batch.path, batch.content, strict=True) for i, page in enumerate(pypdf.PdfReader(io.BytesIO(raw)).pages)]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return files.select("path", "content").mapInPandas(read, "path string, page int, text string")


def objects(spark: SparkSession, path: str, pattern: str = "*", content: bool = True) -> DataFrame:
    """Objects of a store that Spark reads: path, length, modification time, and content if wanted (its bytes aren't read otherwise)."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return found if content else found.drop("content")
