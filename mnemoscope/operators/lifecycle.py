"""Facts over time, confidence, salience, retention, budgets and costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoscope.functions import temporal as T

#: Default weights of evidence categories.
WEIGHTS = {
    "supporting_facts": 0.20,
    "claim_consistency": 0.15,
    "source_diversity": 0.15,
    "inference": 0.10,
    "temporal_coherence": 0.15,
    "contradiction_status": 0.15,
    "staleness_status": 0.10,
}


def at_time(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def as_of(facts: DataFrame, at: Column, active_only: bool = True) -> DataFrame:
    """Facts, memories or episodes valid at a time, and recorded then (recorded_from, recorded_to, if there are such columns).

    As the model has it, superseded ones stay hidden unless asked for.
    """
    found = facts.where(T.valid_at(F.col("valid_from"), F.col("valid_to"), at))
    if "recorded_from" in facts.columns:
        found = found.where((F.col("recorded_from") <= at) & (F.col("recorded_to").isNull() | (F.col("recorded_to") > at)))
    return found.where(F.col("lifecycle_state") == "active") if active_only else found


def current(objects: DataFrame, at: Column | None = None) -> DataFrame:
    """Active objects whose window holds the time (now): begun, and not ended."""
    at = F.current_timestamp() if at is None else at
    return objects.where(T.valid_at(F.col("valid_from"), F.col("valid_to"), at) & (F.col("lifecycle_state") == "active"))


def edges_as_of(edges: DataFrame, at: Column) -> DataFrame:
    """Relationship edges whose window (valid_from, valid_to) holds a time."""
    return edges.where(T.valid_at(F.col("valid_from"), F.col("valid_to"), at))


def overlapping(facts: DataFrame, by: Sequence[str] = ("subject_id",)) -> DataFrame:
    """Facts that begin before an earlier one of the same ``by`` ends: one look back per fact instead of a self-join."""
    own = Window.partitionBy(*by).orderBy("valid_from", "fact_id")
    open_end = at_time("9999-12-31")
    before = F.max(F.coalesce("valid_to", open_end)).over(own.rowsBetween(Window.unboundedPreceding, -1))
    return facts.withColumn("busy_until", before).where(F.col("busy_until") > F.col("valid_from"))


def supersession_chain(facts: DataFrame) -> DataFrame:
    """Each fact's place in its subject's chain, and its predecessor."""
    own = Window.partitionBy("subject_id").orderBy("valid_from", "fact_id")
    return facts.select("subject_id", "fact_id", F.row_number().over(own).alias("version"), F.lag("fact_id").over(own).alias("supersedes"))


def corrected(facts: DataFrame, corrections: DataFrame, at: Column) -> DataFrame:
    """A new snapshot: corrected facts are closed and superseded, successors inherit what isn't given.

    corrections: (fact_id, new_fact_id, object_value).
    """
    hit = facts.join(corrections.select("fact_id", "new_fact_id", F.col("object_value").alias("new_value")), "fact_id")
    closed = hit.withColumns({"valid_to": T.closed(F.col("valid_to"), at), "lifecycle_state": F.lit("superseded")})
    successor = hit.withColumns(
        {
            "supersedes": F.col("fact_id"),
            "fact_id": F.col("new_fact_id"),
            "object_value": F.coalesce("new_value", "object_value"),
            "valid_from": at,
            "lifecycle_state": F.lit("active"),
        }
    )
    rest = facts.join(corrections, "fact_id", "left_anti")
    return rest.unionByName(closed.select(*facts.columns)).unionByName(successor.select(*facts.columns))


def correction_faults(facts: DataFrame, corrections: DataFrame) -> DataFrame:
    """(fact_id, reason) of corrections that the rules refuse: unknown facts, and facts that aren't active."""
    state = facts.select("fact_id", F.col("lifecycle_state").alias("_state"))
    found = corrections.select("fact_id").join(state, "fact_id", "left")
    reason = F.when(F.col("_state").isNull(), "unknown fact").when(F.col("_state") == "superseded", "already superseded").when(F.col("_state") != "active", "not active")
    return found.select("fact_id", reason.alias("reason")).where("reason is not null")


def supersession_edges(corrections: DataFrame, kind: str = "correction") -> DataFrame:
    """(predecessor_id, successor_id, supersession_kind, reason) of corrections or retractions; the latter have no successor."""
    successor = F.col("new_fact_id") if "new_fact_id" in corrections.columns else F.lit(None).cast("long")
    reason = F.col("reason") if "reason" in corrections.columns else F.lit(None).cast("string")
    return corrections.select(F.col("fact_id").alias("predecessor_id"), successor.alias("successor_id"), F.lit(kind).alias("supersession_kind"), reason.alias("reason"))


def retracted(facts: DataFrame, retractions: DataFrame, at: Column) -> DataFrame:
    """A new snapshot in which facts of (fact_id, reason) are retired; a retraction without a reason raises an error."""
    given = F.length(F.trim(F.coalesce("reason", F.lit("")))) > 0
    checked = retractions.select(F.when(given, F.col("fact_id")).otherwise(F.raise_error(F.lit("a retraction needs a reason")).cast("long")).alias("fact_id")).distinct()
    hit = facts.join(checked.withColumn("_hit", F.lit(True)), "fact_id", "left")
    closed = {"valid_to": T.closed(F.col("valid_to"), at), "lifecycle_state": F.lit("retired")}
    if "superseded_at" in facts.columns:
        closed["superseded_at"] = at
    return hit.select(*(F.when(F.col("_hit"), closed[c]).otherwise(F.col(c)).alias(c) if c in closed else F.col(c) for c in facts.columns))


def reopened(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """A new snapshot in which the windows of ``ids`` (fact_id) are open again and their facts active."""
    hit = facts.join(ids.select("fact_id").distinct().withColumn("_hit", F.lit(True)), "fact_id", "left")
    opened = {"valid_to": F.lit(None).cast("timestamp"), "lifecycle_state": F.lit("active")}
    return hit.select(*(F.when(F.col("_hit"), opened[c]).otherwise(F.col(c)).alias(c) if c in opened else F.col(c) for c in facts.columns))


MODES = ("current_valid", "historical", "as_of_transaction_time", "full_bitemporal")


def replayed(facts: DataFrame, mode: str, at: Column, by: str = "subject_id") -> DataFrame:
    """Each subject's facts as JSON steps under a mode, those after the anchor, and how many the mode hides.

    current_valid: valid at the anchor and active; historical: valid at the anchor
    in any state; as_of_transaction_time: known at the anchor (recorded_from,
    recorded_to; without these columns the valid window stands for them);
    full_bitemporal: both, in any state.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    known = ("recorded_from", "recorded_to") if "recorded_from" in facts.columns else ("valid_from", "valid_to")
    valid = T.valid_at(F.col("valid_from"), F.col("valid_to"), at)
    recorded = T.valid_at(F.col(known[0]), F.col(known[1]), at)
    shown = {
        "current_valid": valid & (F.col("lifecycle_state") == "active"),
        "historical": valid,
        "as_of_transaction_time": recorded,
        "full_bitemporal": valid & recorded,
    }[mode]
    later = F.col("valid_from") > at
    step = F.struct("valid_from", "fact_id", "verb", "lifecycle_state")
    steps = F.array_sort(F.collect_list(F.when(shown, step)))
    return facts.groupBy(by).agg(
        F.to_json(steps).alias("steps"), F.count_if(later).alias("later_changes"), F.count_if(~shown & ~later).alias("hidden")
    )


def upserted(base: DataFrame, delta: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``base`` with the rows of ``delta`` put in or replaced by key; of rows of one key the last by ``order`` counts, without it any."""
    if order is None:
        once = delta.dropDuplicates(keys)
    else:
        own = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order))
        once = delta.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")
    return base.join(once, keys, "left_anti").unionByName(once)


def confidence(scores: DataFrame, weights: DataFrame, by: str = "target_id") -> DataFrame:
    """Weighted mean of subscores over enabled weights, to four digits, at most 1; null without weight."""
    exact = {c: F.col(c).cast("decimal(5,4)") for c in ("subscore", "weight")}
    joined = scores.join(weights.where("enabled"), "category").withColumns(exact)
    total = F.sum("weight")
    value = F.round(F.sum(F.col("subscore") * F.col("weight")) / F.when(total != 0, total), 4)
    return joined.groupBy(by).agg(F.when(value > 1, 1.0).otherwise(value.cast("double")).alias("confidence"))


def confidence_summary(scores: DataFrame, by: str = "target_id") -> DataFrame:
    """Categories and bounds of subscores, and of the times of evaluation if there are (evaluated_at)."""
    times = (F.min("evaluated_at").alias("first_evaluated"), F.max("evaluated_at").alias("last_evaluated")) if "evaluated_at" in scores.columns else ()
    return scores.groupBy(by).agg(
        *times,
        F.count(F.lit(1)).alias("n_scores"),
        F.array_join(F.array_sort(F.collect_list("category")), ",").alias("categories"),
        F.min("subscore").alias("low"),
        F.max("subscore").alias("high"),
    )


def salience(events: DataFrame, now: Column, half_life_days: float = 90.0, scale: float = 5.0) -> DataFrame:
    """1 - exp(-v / scale) of decayed weights v, to four digits. events: (target_id, weight, at)."""
    v = F.sum(T.decayed(F.col("weight"), F.col("at"), now, half_life_days))
    return events.groupBy("target_id").agg(F.round(1 - F.exp(-v / scale), 4).alias("salience"))


def retention_candidates(objects: DataFrame, holds: DataFrame, cutoff: Column, states: list[str], days: int = 365) -> DataFrame:
    """Objects (object_id, state, updated_at) in a state, older than the days before the cutoff, without a legal hold."""
    old = F.col("updated_at") < cutoff - F.make_dt_interval(days=F.lit(days))
    return objects.where(F.col("state").isin(states) & old).join(holds, "object_id", "left_anti")


#: States that a legal hold forbids.
HELD = ("tombstoned", "retired", "archived")


def with_states(objects: DataFrame, changes: DataFrame, holds: DataFrame) -> DataFrame:
    """Objects (object_id, state, ...) with the new states of ``changes`` (object_id, state); one that a legal hold forbids raises an error."""
    new = changes.groupBy("object_id").agg(F.max("state").alias("_new"))
    held = holds.select("object_id").distinct().withColumn("_held", F.lit(True))
    found = objects.join(new, "object_id", "left").join(held, "object_id", "left")
    refused = F.raise_error(F.concat(F.lit("a legal hold is on object "), F.col("object_id").cast("string"))).cast("string")
    state = F.when(F.col("_new").isNull(), F.col("state")).when(F.col("_held") & F.col("_new").isin(*HELD), refused).otherwise(F.col("_new"))
    return found.withColumn("state", state).select(*objects.columns)


def pruned(objects: DataFrame, prunes: DataFrame, holds: DataFrame) -> DataFrame:
    """Objects with those of ``prunes`` (object_id, reason) tombstoned; rows stay, as they show where others came from."""
    given = F.length(F.coalesce("reason", F.lit(""))) > 0
    wanted = prunes.select(F.when(given, F.col("object_id")).otherwise(F.raise_error(F.lit("pruning needs a reason")).cast("long")).alias("object_id"), F.lit("tombstoned").alias("state"))
    return with_states(objects, wanted, holds)


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column, cached: Column) -> Column:
    """Nothing for a cache hit; null where a price is unknown."""
    return F.when(cached, F.lit(0.0)).otherwise(tokens_in * price_in + tokens_out * price_out)


def cost_rollup(calls: DataFrame) -> DataFrame:
    """Per account, kind and day over calls (account, kind, at, tokens_in, tokens_out, cost, cached); hits don't count."""
    return (
        calls.where(~F.col("cached"))
        .groupBy("account", "kind", F.date_trunc("day", "at").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("n_calls"),
            F.sum("tokens_in").alias("tokens_in"),
            F.sum("tokens_out").alias("tokens_out"),
            F.round(F.sum("cost"), 4).alias("cost"),
        )
    )


def usage(calls: DataFrame, start: Column, end: Column, by: Sequence[str] = ("account",)) -> DataFrame:
    """Calls and tokens of each scope (account, kind, ...) in a time span [start, end)."""
    span = calls.where((F.col("at") >= start) & (F.col("at") < end))
    return span.groupBy(*by).agg(F.count(F.lit(1)).alias("n_calls"), F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"))


def over_budget(usage: DataFrame, policies: DataFrame) -> DataFrame:
    """The first policy (scope_order, account, budget) that each account's usage (account, used) reaches."""
    own = Window.partitionBy("account").orderBy("scope_order", "budget")
    hit = usage.join(policies, "account").where(F.col("used") >= F.col("budget"))
    return hit.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")
