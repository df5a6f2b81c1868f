"""Drop lines that many documents share, keeping one holder of each.

A line's key is the line without ASCII white space at both ends and with A-Z
lower-cased; it is identified by the SHA-256 of its bytes. Keys of at least
``least_chars`` code points found in at least ``least_docs`` documents lose all
their lines except in the largest identifier that holds them.

Lines are hashed once and written as (digest, identifier, position). Counting sums
first, so one very common line is spread over all tasks. A bitmap of the common
keys lets only lines that may be common move; the few keys that hold more than one
in 4,096 of them are broadcast to their rows, the others meet theirs in a join. Dropped positions are then joined back to the documents, and
lines are reassembled by position.

Defined results: a null or empty text is one empty line; a null identifier is
one document smaller than all others; repeated rows count as one document and
lose the same lines; an empty table gives an empty result; other columns of the
input stay as they are, whatever their names (columns _n_lines and _n_dropped of
the input are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, filter_of, fresh, let, passing, with_entries, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """ASCII lines take the quick way; others must keep their non-ASCII capitals."""
    cut = F.trim(line, F.lit(BLANKS))
    return F.when(F.octet_length(cut) == F.char_length(cut), F.lower(cut)).otherwise(F.translate(cut, UPPER, LOWER))


def _marked(identity: Column, whole: Column, docs: DataFrame, least_chars: int) -> DataFrame:
    """A written table (digest, id, hash of the text, pos) of lines whose key can count."""
    # Only lines that can reach the least length are trimmed, hashed and moved.
    lines = (
        docs.select(identity.alias("id"), F.xxhash64(whole).alias("th"), F.split(whole, "\n", -1).alias("lines"))
        .select("id", "th", F.posexplode("lines").alias("pos", "line"))
        .where(F.char_length("line") >= least_chars)
        .select("id", "th", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= least_chars)
    )
    return written(lines.select(F.unhex(F.sha2("key", 256)).alias("digest"), "id", "th", "pos"), "lines")


def drop_common_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5
) -> DataFrame:
    """``docs`` with the text after dropping, and columns _n_lines and _n_dropped."""
    whole = F.coalesce(F.col(text_col), F.lit(""))
    identity = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    marked = _marked(identity, whole, docs, least_chars)
    common = (
        marked.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("digest").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("holder"), F.sum("n").alias("rows"))
        .where(F.col("docs") >= least_docs)
        .select("digest", "holder", "rows")
    )
    common = written(common, "common-lines")
    likely = passing(marked, *filter_of(common, "digest"), "digest")
    held = with_entries(likely, common, ["digest"], "rows", ["id", "pos"])
    doc, th, drop = fresh(docs, "_id", "_th", "_drop")
    gone = held.where(F.col("_entry.holder") != F.col("id")).groupBy(F.col("id").alias(doc), F.col("th").alias(th)).agg(F.collect_set("pos").alias(drop))
    # Written, so that the join may split a document that is repeated very often; the same join at every size.
    joined = docs.withColumns({doc: identity, th: F.xxhash64(whole)}).join(written(gone, "dropped-lines").hint("merge"), [doc, th], "left")
    rest = let(
        F.split(whole, "\n", -1).alias("lines"),
        F.col(drop).alias("drop"),
        lambda x: F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(x.lines) - 1), x["drop"]), lambda p: F.element_at(x.lines, p + 1)
        ),
    )
    return joined.withColumns(
        {
            "_n_lines": F.size(F.split(whole, "\n", -1)).cast("long"),
            "_n_dropped": F.when(F.col(drop).isNull(), F.lit(0)).otherwise(F.size(drop)).cast("long"),
            text_col: F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(F.array_join(rest, "\n")),
        }
    ).drop(doc, th, drop)
