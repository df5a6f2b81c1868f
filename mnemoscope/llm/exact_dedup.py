"""Exact deduplication with a log-structured merge index of text digests.

* A memtable is what one task holds: an insert flushes one sorted run per task, with
  no shuffle. Inserts come in batches; when a level holds ``FANOUT`` runs, they are
  merged by digest into one run of the next level, which keeps the smallest (or
  largest) identifier and the number of rows.
* A run's filters are its row-group ranges and Parquet Bloom filters, read by
  ``lookup``, and a bitmap of its digests (``filter_of``) that goes to every task, so
  that rows which can't hit leave before any join. A bitmap has at most 2**26 bits;
  one that is too full lets more rows through, never fewer.
* Every hit is verified on bytes against the text of the row that stays. Only texts
  that pass the filter move; members of large groups are dealt over salts, with the
  keeper's text once per salt, and no digest sends more than one in 4,096 of all
  rows to one task.

Defined results: a null text equals the empty text; of rows that repeat the kept
identifier one stays; null identifiers count as smaller than all others; an empty
table gives an empty result; columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_of, passing, scratch, with_entries, written

#: Rows of one group that are compared with one copy of the keeper's text.
ROWS_A_SALT = 512
#: Runs that a level holds before they are merged into one of the next.
FANOUT = 4
#: Inserts that a table is divided into.
BATCHES = 8


class DigestIndex:
    """Runs of (digest, row, id, n) by level; level 0 is flushed, the others are merged."""

    def __init__(self, spark: SparkSession, keep: str = "min", path: str | None = None):
        if keep not in ("min", "max"):
            raise ValueError("keep is 'min' or 'max'")
        self.spark, self.keep = spark, keep
        self.path = path or scratch(spark, "lsm")
        self.runs: list[list[str]] = [[], []]
        self.made = 0

    def _flush(self, df: DataFrame, level: int) -> DataFrame:
        self.made += 1
        at = f"{self.path}/level{level}/run{self.made}"
        filters = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "100000"}
        out = written(df.sortWithinPartitions("digest"), "run", at, **filters)
        if level == len(self.runs):
            self.runs.append([])
        self.runs[level].append(at)
        return out

    def insert(self, rows: DataFrame) -> None:
        """Flush rows (digest, row, id) as a run of level 0, and merge levels that are full."""
        self._flush(rows.select("digest", "row", "id", F.lit(1).cast("long").alias("n")), 0)
        level = 0
        while level < len(self.runs) and len(self.runs[level]) >= FANOUT:
            paths, self.runs[level] = self.runs[level], []
            self._flush(self._merged(paths), level + 1)
            level += 1

    def _read(self, paths: Sequence[str]) -> DataFrame:
        return self.spark.read.schema("digest string, row long, id long, n long").parquet(*paths)

    def _merged(self, paths: Sequence[str]) -> DataFrame:
        """One entry a digest. Partial sums go first, so a hot digest is no hot task."""
        pick = F.min if self.keep == "min" else F.max
        # Of rows that repeat the identifier, the first row number stays.
        row = F.col("row") if self.keep == "min" else -F.col("row")
        return (
            self._read(paths)
            .groupBy("digest")
            .agg(pick(F.struct("id", row.alias("row"))).alias("top"), F.sum("n").alias("n"))
            .select("digest", F.abs("top.row").alias("row"), "top.id", "n")
        )

    def _all(self) -> list[str]:
        return [p for level in self.runs for p in level]

    def compact(self) -> DataFrame:
        """Merge every run into one of the highest level."""
        paths, top = self._all(), max(1, len(self.runs) - 1)
        merged = self._merged(paths)
        self.runs = [[] for _ in range(top + 1)]
        return self._flush(merged, top)

    def entries(self) -> DataFrame:
        """One entry a digest."""
        runs = self._all()
        return self._read(runs) if len(runs) == 1 and not self.runs[0] else self.compact()

    def lookup(self, digests: Sequence[str]) -> DataFrame:
        """Entries of a few digests: ranges and Bloom filters skip runs that can't hold them."""
        return self._read(self._all()).where(F.col("digest").isin(list(digests)))


def _false_hits(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """Digests under which a text differs from the keeper's. texts: digest, id, text; hits: digest, keeper_row, keep_id, n."""
    found = with_entries(texts, hits, ["digest"], "n", ["id"], alike=True).where(F.col("_entry").isNotNull())
    found = found.select("digest", "id", "text", F.col("_entry.keep_id").alias("keep_id"), F.ceil(F.col("_entry.n") / ROWS_A_SALT).cast("int").alias("_salts"))
    keepers = (
        found.where(F.col("id").eqNullSafe(F.col("keep_id")))
        .groupBy("digest", "_salts")
        .agg(F.min("text").alias("kept_text"))
        .select("digest", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), "kept_text")
    )
    # Rows of equal identifiers may have different texts; the salt goes by both.
    members = found.select("digest", F.pmod(F.xxhash64("id", "text"), F.col("_salts")).cast("int").alias("_salt"), "text")
    return (
        members.join(keepers.hint("merge"), ["digest", "_salt"]).where(F.col("text") != F.col("kept_text")).select("digest").distinct()
    )


def _regrouped(rows: DataFrame, keep: str) -> DataFrame:
    """Rows (row, id, sha, digest, text) of false hits, grouped by the text itself."""
    row = F.col("row") if keep == "min" else -F.col("row")
    pick = F.min if keep == "min" else F.max
    groups = rows.groupBy("digest", "text").agg(
        pick(F.struct("id", row.alias("row"))).alias("top"), F.count(F.lit(1)).alias("n")
    )
    return rows.join(groups, ["digest", "text"]).select(
        "id",
        F.col("top.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.abs("top.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest: Column | None = None, batches: int = BATCHES
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``digest`` replaces the index key (a string expression over column ``text``),
    so that tests can force collisions; equality is always decided on bytes.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sha = F.sha2("text", 256)
    key = (sha if digest is None else digest).alias("digest")
    # A row's number is fixed by writing it; a task's rows are one batch.
    batch = F.pmod(F.spark_partition_id(), F.lit(batches)).alias("batch")
    made = source.select(F.monotonically_increasing_id().alias("row"), "id", sha.alias("sha"), key, batch)
    path = scratch(docs.sparkSession, "digests")
    (made if digest is not None else made.drop("sha")).write.partitionBy("batch").parquet(path)
    columns = "row long, id long, digest string" if digest is None else "row long, id long, sha string, digest string"
    listed = docs.sparkSession.read.schema(f"{columns}, batch int").parquet(path)
    index = DigestIndex(docs.sparkSession, keep)
    for i in range(batches):
        index.insert(listed.where(F.col("batch") == i))
    if digest is None:
        listed = listed.withColumn("sha", F.col("digest"))
    groups = index.entries().where(F.col("n") > 1)
    hits = written(groups.select("digest", F.col("row").alias("keeper_row"), F.col("id").alias("keep_id"), "n"), "hits")
    # Texts are read again; those that can't be in a group stay where they are.
    texts = passing(source.select(key, "id", "text"), *filter_of(hits, "digest"), "digest")
    false_hits = written(_false_hits(texts, hits), "false-hits")
    joined = with_entries(listed, hits, ["digest"], "n", ["row"])
    collided = not false_hits.isEmpty()
    if collided:
        joined = joined.join(false_hits, "digest", "left_anti")
    hit = F.col("_entry").isNotNull()
    out = joined.select(
        "id",
        F.when(hit, F.col("_entry.keep_id")).otherwise(F.col("id")).alias("keep_id"),
        F.when(hit, F.col("_entry.n")).otherwise(F.lit(1)).cast("long").alias("group_size"),
        (~hit | (F.col("row") == F.col("_entry.keeper_row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    if collided:
        again = source.select(F.monotonically_increasing_id().alias("row"), "id", sha.alias("sha"), key, "text")
        out = out.unionByName(_regrouped(written(again.join(false_hits, "digest", "left_semi"), "collided"), keep))
    return out.withColumnRenamed("id", id_col)
