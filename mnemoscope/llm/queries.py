"""The registered queries: each applies its operator to whole tables with production parameters."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import formatted, read_back, turns_of
from .decontaminate import contaminated
from .exact_dedup import exact_duplicates
from .line_dedup import drop_common_lines
from .near_dedup import near_duplicates
from .packing import packed
from .pii import KINDS, find_personal_data
from .sharding import shard_rows
from .token_store import tokens_stored
from .toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op3_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), 16)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of conversations is a record of one turn, a struct; conversation -7 is one record of messages, in JSON.
    The fingerprints of both choose their mappings."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("record_id"), F.struct("turn", "role", "text").alias("payload"))
    said = "\\### Assistant: </turn> ok"
    messages = {"messages": [{"role": r, "content": said} for r in ("user", "assistant")]}
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("record_id"), F.lit(json.dumps(messages)).alias("payload"))
    out = read_back(formatted(turns_of(rows).unionByName(turns_of(extra))))
    return out.select(F.col("record_id").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans' counts and digest, all spans, their scores in the same order, and their number."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    names = F.array(*(F.lit(k.name) for k in KINDS))
    base = [i for i, k in enumerate(KINDS) if k.base]

    def listed(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def count(kind: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    counts = {f"n_{KINDS[i].name}": count(i) for i in base}
    return found.select(
        "doc_id",
        *(c.alias(n) for n, c in counts.items()),
        F.sha2(listed(F.filter("found", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
        F.size("found").cast("long").alias("n_spans"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op8_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens_stored(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="max")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_dart_minhash, op2_length_buckets, op3_hash_tree_shards, op4_chat_format, op5_toxicity, op6_personal_data, op7_line_dedup, op8_string_tiling, op9_token_store, op10_exact_dedup)}
