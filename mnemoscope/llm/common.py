"""What several operators share: written intermediate tables and gapless numbering.

Intermediate results are Parquet tables below the folder that the session names
in ``spark.checkpoint.dir``. Every executor can read them, so a lost executor
costs only its own tasks, and row identities drawn while writing stay fixed.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_A_CHUNK = 100_000
LEAST_CHUNKS = 64
#: A key is hot that holds more than one in HOT of all rows, and more than COLD.
HOT, COLD = 4096, 1024
#: Bits of a filter for each key, and of the largest filter.
BITS, MOST_BITS = 32, 1 << 26
#: What stands for a null identifier.
NO_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where none is set and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="mnemoscope-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, path: str | None = None, **options: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back."""
    path = path or scratch(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(*values_and_body) -> Column:
    """Evaluate named columns once for an expression that uses them inside lambdas."""
    *values, body = values_and_body
    return F.element_at(F.transform(F.array(F.struct(*values)), body), 1)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, whatever the case, one for each of ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def utf8_size(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def with_entries(rows: DataFrame, entries: DataFrame, keys: Sequence[str], weight: str, spread: Sequence[str], alike: bool = False) -> DataFrame:
    """``rows`` with a struct ``_entry`` of what ``entries`` has under their keys, null where there is nothing.

    entries: a written table of one row a key, with the number of rows that hold the key
    in column ``weight``. Entries of hot keys, fewer than HOT by definition, are broadcast,
    and their rows are dealt by ``spread``; all others meet in a join, where no key has
    more than one in HOT of all rows, or COLD. alike: that join moves both sides at every
    size, so that its cost grows with the input and doesn't jump where a broadcast ends.
    """

    def side(df: DataFrame) -> DataFrame:
        return df.hint("merge") if alike else df

    total, most = entries.agg(F.sum(weight), F.max(weight)).first()
    value = F.struct(*(c for c in entries.columns if c not in keys)).alias("_entry")
    if not most or most <= COLD or most * HOT <= total:
        return rows.join(side(entries.select(*keys, value)), list(keys), "left")
    hot = (F.col(weight) > COLD) & (F.col(weight) * HOT > total)
    found = rows.join(F.broadcast(entries.where(hot).select(*keys, value.alias("_hot"))), list(keys), "left")
    salt = F.when(F.col("_hot").isNotNull(), 1 + F.pmod(F.xxhash64(*spread), F.lit(1 << 20))).otherwise(F.lit(0).cast("long"))
    rest = entries.where(~hot).select(*keys, F.lit(0).cast("long").alias("_salt"), value.alias("_cold"))
    both = found.withColumn("_salt", salt).join(side(rest), [*keys, "_salt"], "left")
    return both.withColumn("_entry", F.coalesce("_hot", "_cold")).drop("_hot", "_cold", "_salt")


def filter_of(entries: DataFrame, key: str) -> tuple[DataFrame, int]:
    """A bitmap of the keys of a written table, as rows (slot, word) of 64 bits, and its number of slots."""
    slots, wanted = 1, min(BITS * entries.count(), MOST_BITS)
    while slots * 64 < wanted:
        slots *= 2
    slot, bit = _place(key, slots)
    return entries.select(slot.alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("word")), slots


def _place(key: str, slots: int) -> tuple[Column, Column]:
    spot = F.pmod(F.xxhash64(key), F.lit(64 * slots))
    return F.shiftright(spot, 6), (spot % 64).cast("int")


def passing(rows: DataFrame, words: DataFrame, slots: int, key: str) -> DataFrame:
    """Rows whose key may be among those of a filter; a filter that is too full lets more rows through, never fewer.

    A filter has at most MOST_BITS, however many keys it has, so it is broadcast.
    """
    slot, bit = _place(key, slots)
    marked = rows.withColumns({"_slot": slot, "_bit": bit})
    have = F.broadcast(words.select(F.col("slot").alias("_slot"), F.col("word").alias("_word")))
    return marked.join(have, "_slot").where(F.call_function("bit_get", F.col("_word"), F.col("_bit")) == 1).drop("_slot", "_bit", "_word")


def with_slots(df: DataFrame, groups: Sequence[str], order: Sequence[str], into: str = "slot") -> DataFrame:
    """Number the rows of each group from 0 without gaps, however large a group is.

    Rows are dealt by a hash of ``order`` into chunks of about ROWS_A_CHUNK, at
    least LEAST_CHUNKS in all; counts by (group, chunk) give each chunk its first
    number, and one window per (group, chunk) gives the rest. The numbering is
    fixed by (chunk, order). ``df`` is read twice and must be a written table;
    ``order`` must tell rows apart, or equal rows share the order at random.
    """
    rows = df.count()
    chunks = max(LEAST_CHUNKS, -(-rows // ROWS_A_CHUNK))
    dealt = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    by = [*groups, "_chunk"]
    counts = dealt.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(*by).orderBy(*order)
    return (
        dealt.join(first, by)
        .withColumn(into, F.col("_first") + F.row_number().over(inside) - 1)
        .drop("_chunk", "_first")
    )
