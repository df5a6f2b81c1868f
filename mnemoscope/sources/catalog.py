"""Tables of a data folder, and the memory model's views over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemoscope.operators.retrieval import Memory

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


class Catalog:
    """Lazily read tables; every view is a projection that prunes to what a query uses."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def chunks(self) -> DataFrame:
        """Vector chunks; a compartment is a label."""
        return self.embeddings.select(
            F.col("vec_id").alias("chunk_id"), F.col("label").alias("compartment_id"), F.col("embedding")
        )

    def tombstones(self) -> DataFrame:
        return self.embeddings.where(F.col("vec_id") % 17 == 0).select(F.col("vec_id").alias("chunk_id"))

    def edges(self) -> DataFrame:
        """Typed edges of all stores, with endpoints (kind, id)."""

        def edge(df, store, key, source, source_id, rel, target, target_id):
            return df.select(
                F.lit(store).alias("edge_store"),
                F.col(key).cast("long").alias("edge_id"),
                F.lit(source).alias("source_kind"),
                F.col(source_id).cast("long").alias("source_id"),
                F.lit(rel).alias("rel"),
                F.lit(target).alias("target_kind"),
                F.col(target_id).cast("long").alias("target_id"),
            )

        parts = [
            edge(self.orders, "order", "o_orderkey", "order", "o_orderkey", "placed_by", "customer", "o_custkey"),
            edge(self.lineitem, "item", "l_linenumber", "order", "l_orderkey", "contains", "part", "l_partkey"),
            edge(self.lineitem, "supply", "l_linenumber", "order", "l_orderkey", "supplied_by", "supplier", "l_suppkey"),
            edge(self.customer, "home", "c_custkey", "customer", "c_custkey", "located_in", "nation", "c_nationkey"),
            edge(self.supplier, "seat", "s_suppkey", "supplier", "s_suppkey", "located_in", "nation", "s_nationkey"),
            edge(self.nation, "place", "n_nationkey", "nation", "n_nationkey", "located_in", "region", "n_regionkey"),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def tree(self) -> DataFrame:
        """region > nation > customer > order, as (node, parent, kind, ordinal)."""

        def level(df, kind, key, parent_kind, parent):
            up = F.concat(F.lit(f"{parent_kind}:"), F.col(parent)) if parent else F.lit(None).cast("string")
            return df.select(
                F.concat(F.lit(f"{kind}:"), F.col(key)).alias("node"), up.alias("parent"), F.lit(kind).alias("kind"), F.col(key).cast("long").alias("ordinal")
            )

        return (
            level(self.region, "region", "r_regionkey", None, None)
            .unionByName(level(self.nation, "nation", "n_nationkey", "region", "n_regionkey"))
            .unionByName(level(self.customer, "customer", "c_custkey", "nation", "c_nationkey"))
            .unionByName(level(self.orders, "order", "o_orderkey", "customer", "o_custkey"))
        )

    def facts(self) -> DataFrame:
        """A customer's order is valid until the next one; fully delivered ones are superseded."""
        own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        return self.orders.select(
            F.col("o_orderkey").alias("fact_id"),
            F.col("o_custkey").alias("subject_id"),
            F.col("o_orderpriority").alias("verb"),
            F.col("o_totalprice").alias("object_value"),
            F.col("o_orderdate").alias("valid_from"),
            F.lead("o_orderdate").over(own).alias("valid_to"),
            F.lag("o_orderkey").over(own).alias("supersedes"),
            F.when(F.col("o_orderstatus") == "F", "superseded").otherwise("active").alias("lifecycle_state"),
        )

    def scores(self) -> DataFrame:
        """Evidence scores of parts, in [0, 1], by category."""
        size = F.col("p_size") / 50.0
        price = F.least(F.lit(1.0), F.col("p_retailprice") / 2500.0)
        text = F.length("p_name") / 60.0
        made = F.array(
            *(
                F.struct(F.lit(n).alias("category"), F.round(F.least(F.lit(1.0), c), 4).alias("subscore"))
                for n, c in (("supporting_facts", size), ("source_diversity", price), ("claim_consistency", text))
            )
        )
        return self.part.select(F.col("p_partkey").alias("target_id"), F.explode(made).alias("s")).select("target_id", "s.*")

    def labels_of(self) -> DataFrame:
        """(kind, id, label) of nodes that have a name."""
        parts = [("customer", "c"), ("supplier", "s"), ("part", "p"), ("nation", "n"), ("region", "r")]
        made = [
            getattr(self, kind).select(F.lit(kind).alias("kind"), F.col(f"{x}_{'part' if x == 'p' else 'cust' if x == 'c' else 'supp' if x == 's' else kind}key").cast("long").alias("id"), F.col(f"{x}_name").alias("label"))
            for kind, x in parts
        ]
        return reduce(DataFrame.unionByName, made)

    def compartments(self) -> DataFrame:
        """Compartments by label: the last ones are of another namespace."""
        own = self.embeddings.select(F.col("label").alias("compartment_id")).distinct()
        return own.select(
            "compartment_id",
            F.when(F.col("compartment_id") < 8, "default").otherwise("other").alias("namespace"),
            F.concat(F.lit("subject "), F.col("compartment_id") % 3).alias("subject_name"),
            F.concat(F.lit("verb "), F.col("compartment_id") % 2).alias("verb_name"),
        )

    def cards(self) -> DataFrame:
        """Embedded cards of two kinds; some have no vector, some one of another size."""
        vector = F.when(F.col("vec_id") % 13 == 0, F.lit(None)).when(F.col("vec_id") % 11 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
        kind = F.when(F.col("vec_id") % 2 == 0, "subject").otherwise("svpor_statement")
        return self.embeddings.select(kind.alias("object_kind"), F.col("vec_id").alias("object_id"), vector.alias("embedding"), F.lit("entity-v1").alias("embedding_space"))

    def governed(self) -> Memory:
        """The four governed types: parts as claims, orders as facts, documents as memories, nations as episodes."""
        always, never = F.lit(None).cast("timestamp"), F.lit(None).cast("string")

        def table(df, key, title, body, state=F.lit("active"), since=always, until=always, recorded=F.lit("1995-01-01").cast("timestamp"), subject=never, verb=never, package=F.lit(None).cast("long")):
            return df.select(
                F.col(key).cast("long").alias("object_id"), subject.alias("subject"), verb.alias("verb"), title.alias("title"), body.alias("body"), state.alias("lifecycle_state"),
                package.alias("source_package_id"), since.alias("valid_from"), until.alias("valid_to"), recorded.alias("recorded_from"), always.alias("recorded_to"),
            )

        customer = F.concat(F.lit("customer "), F.col("o_custkey"))
        ordered = F.col("o_orderdate").cast("timestamp")
        registry = [("subject", 1, "red", ["crimson"]), ("subject", 3, "ring", None), ("verb", 4, "ring", None), ("verb", 5, "buy cheaply", ["Economy"]), ("predicate", 6, "Noon", None)]
        return Memory(
            claim=table(self.part, "p_partkey", F.col("p_name"), F.col("p_brand"), subject=F.col("p_name"), verb=F.col("p_type"), package=F.col("p_size").cast("long")),
            fact=table(
                self.orders, "o_orderkey", customer, F.concat(F.lit("order "), F.col("o_orderkey"), F.lit(" status "), F.col("o_orderstatus")),
                F.when(F.col("o_orderstatus") == "P", "tombstoned").otherwise("active"), ordered, ordered + F.expr("INTERVAL 90 DAYS"), ordered + F.expr("INTERVAL 10 DAYS"), customer, F.col("o_orderpriority"),
            ),
            memory=table(
                self.documents, "doc_id", F.col("source"), F.col("text"), F.when(F.col("doc_id") % 10 == 0, "retired").otherwise("active"), F.lit("2000-01-01").cast("timestamp") + F.make_dt_interval(days=F.col("doc_id").cast("int")),
            ),
            episode_object=table(self.nation, "n_nationkey", F.col("n_name"), F.concat(F.lit("nation of region "), F.col("n_regionkey")), since=F.lit("1990-01-01").cast("timestamp")),
            confidences=self.labels.select(F.lit("memory").alias("object_type"), F.col("doc_id").alias("object_id"), F.col("quality").cast("double").alias("confidence")),
            registry=self.spark.createDataFrame(registry, "kind string, entry_id long, canonical string, aliases array<string>"),
        )
