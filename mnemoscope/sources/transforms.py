"""What happens to rows when they come in: stamps, checks, seals and work that they cause."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoscope.functions.governance import Principal, payload_errors


def stamped(rows: DataFrame, who: Principal, at: Column) -> DataFrame:
    """Rows with who brought them in and when, and a scope: their own, which the principal must have, or the principal's first."""
    own = who.scopes[0] if who.scopes else "default"
    scope = F.coalesce("scope", F.lit(own)) if "scope" in rows.columns else F.lit(own)
    if who.scopes is not None:
        scope = F.when(scope.isin(list(who.scopes)), scope).otherwise(F.raise_error(F.concat(F.lit(f"{who.name} may not write to "), scope)).cast("string"))
    return rows.withColumns({"scope": scope, "created_by": F.lit(who.name), "created_at": at})


def validated(rows: DataFrame, schemas: Mapping[str, dict]) -> DataFrame:
    """Rows whose JSON columns keep to their schemas; a row that doesn't raises an error with what it breaks. Null payloads pass."""
    for column, schema in schemas.items():
        errors = payload_errors(F.coalesce(column, F.lit("null")), schema)
        checked = F.when(F.col(column).isNull() | (F.size("_errors") == 0), F.col(column)).otherwise(F.raise_error(F.array_join("_errors", "; ")).cast("string"))
        rows = rows.withColumn("_errors", errors).withColumn(column, checked).drop("_errors")
    return rows


def sealed(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """New versions of rows; one that changes a column of a sealed row (sealed_at) raises an error."""
    held = old.where(F.col("sealed_at").isNotNull()).select(key, F.struct(*columns).alias("_held"))
    same = F.col("_held").isNull() | F.struct(*columns).eqNullSafe(F.col("_held"))
    first = columns[0]
    kept = F.when(same, F.col(first)).otherwise(F.raise_error(F.concat(F.lit("sealed row "), F.col(key).cast("string"))).cast(new.schema[first].dataType))
    return new.join(held, key, "left").withColumn(first, kept).drop("_held")


def queued(queue: DataFrame, changed: DataFrame) -> DataFrame:
    """The embedding queue (object_kind, object_id, generation) with changed objects in a new generation."""
    keys = ["object_kind", "object_id"]
    new = changed.select(*keys).distinct().withColumn("_new", F.lit(True))
    return queue.join(new, keys, "full").select(*keys, F.when(F.col("_new"), F.coalesce("generation", F.lit(0)) + 1).otherwise(F.col("generation")).alias("generation"))
