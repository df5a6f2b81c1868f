"""Packing into optimal length buckets and batches of a token budget.

The histogram of all lengths decides the buckets: dynamic programming chooses the
bucket boundaries whose total padding is least. Inside a bucket every row is
padded to the boundary, so a batch of a budget holds ``budget // boundary`` rows
(one, if the boundary exceeds the budget), and batches are runs of the bucket's
gapless numbering.

The histogram has one row for each length that occurs, at every size of input: all
lengths are exact, and so is the least padding. Different lengths that sum to the
tokens of the table are at most the root of twice that number, so the driver's part
(two numbers a length) is 4.5 million rows at 10**13 tokens, if no two texts were of
one length, and far less else.

Defined results: a null text is empty and has length 1 (its end token); no text is
cut or left out; repeated rows are packed each; an empty table gives an empty
result; other columns of the input are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import with_slots, written
from .textvec import column_pieces
from .tokens import encoder

BUCKETS, BUDGET = 16, 32_768


def word_count(text: Column) -> Column:
    """Words between white space, and an end token."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")) + 1


def with_token_counts(docs: DataFrame, tokenizer_path: str, text_col: str = "text", into: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of a tokenizer's ids of each text, and an end token, for ``packed(length=...)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(ids) + 1 for _, texts in column_pieces(batch.column(text_col)) for ids in encoder(tokenizer_path).encode(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(into, LongType())]))


def _hidden(first: tuple, second: tuple, slope: int, offset: int) -> bool:
    """Whether the second of three lines of falling slope is nowhere the lowest."""
    return (offset - first[1]) * (first[0] - second[0]) <= (second[1] - first[1]) * (first[0] - slope)


def boundaries(histogram: Sequence[tuple[int, int]], buckets: int) -> list[int]:
    """Boundaries of least total padding. histogram: (length, rows), ascending.

    Putting lengths i..j-1 into one bucket costs ``length[j-1] * rows - tokens``. With
    prefix sums the cost of a split is a line in the boundary, and lines are met in
    order of slope, so each layer of the table takes one pass over a lower hull.
    """
    n = len(histogram)
    rows, tokens = [0], [0]
    for length, r in histogram:
        rows.append(rows[-1] + r)
        tokens.append(tokens[-1] + length * r)
    best: list[int | None] = [0] + [None] * n
    back: list[array] = []
    for _ in range(min(buckets, n)):
        hull: list[tuple[int, int, int]] = []  # slope, offset, split
        at, now, chosen = 0, [None] * (n + 1), array("i", bytes(4 * (n + 1)))
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                slope, offset = -rows[j - 1], best[j - 1] + tokens[j - 1]
                while len(hull) > 1 and _hidden(hull[-2], hull[-1], slope, offset):
                    hull.pop()
                hull.append((slope, offset, j - 1))
                at = min(at, len(hull) - 1)
            if not hull:
                continue
            x = histogram[j - 1][0]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            now[j] = x * rows[j] - tokens[j] + hull[at][0] * x + hull[at][1]
            chosen[j] = hull[at][2]
        back.append(chosen)
        best = now
    out, j = [], n
    for chosen in reversed(back):
        if j == 0:
            break
        out.append(histogram[j - 1][0])
        j = chosen[j]
    return out[::-1]


def packed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    length: Column | None = None,
) -> DataFrame:
    """Per row: id, n_tokens, bucket, bucket_len, batch (from 0 in a bucket), place (in the batch), padding."""
    tokens = word_count(F.col(text_col)) if length is None else length
    rows = docs.select(F.col(id_col).alias("id"), tokens.cast("long").alias("n_tokens"), F.xxhash64(text_col).alias("hash"))
    small = written(rows, "lengths")
    histogram = small.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("rows")).toArrow().sort_by("n_tokens")
    ends = boundaries(list(zip(*(c.to_pylist() for c in histogram.columns), strict=True)), buckets)
    at: Column = F.lit(0)
    for end in ends[:-1]:
        at = at + (F.col("n_tokens") > end).cast("int")
    to = F.element_at(F.array(*(F.lit(e).cast("long") for e in ends or [1])), F.col("bucket") + 1)
    numbered = with_slots(small.withColumn("bucket", at), ["bucket"], ["id", "hash", "n_tokens"])
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len"))).cast("long")
    return numbered.withColumn("bucket_len", to).select(
        F.col("id").alias(id_col),
        "n_tokens",
        "bucket",
        "bucket_len",
        F.floor(F.col("slot") / fits).cast("long").alias("batch"),
        (F.col("slot") % fits).cast("long").alias("place"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
