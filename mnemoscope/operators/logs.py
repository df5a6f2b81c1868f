"""Event logs, queues, presence and workflow mining, over batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoscope.functions import temporal as T


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def fetch_batch(events: DataFrame, cursor: int, kinds: Sequence[str] | None, limit: int, account: int | None = None, partition: str | None = None, pool: int | None = None) -> DataFrame:
    """Events behind a cursor, in order of identifiers; no kinds means all, events without account are for everyone.

    partition, pool: only events of that partition or pool (columns of these names).
    """
    found = events.where(F.col("event_id") > cursor)
    if kinds:
        found = found.where(F.col("event_type").isin(list(kinds)))
    if account is not None:
        found = found.where(F.col("user_id").isNull() | (F.col("user_id") == account))
    for column, wanted in (("partition", partition), ("pool", pool)):
        if wanted is not None:
            found = found.where(F.col(column) == wanted)
    return found.orderBy("event_id").limit(limit)


def acknowledged(cursors: DataFrame, acks: DataFrame) -> DataFrame:
    """Cursors (consumer, cursor) moved by acks (consumer, event_id): never backwards."""
    top = acks.groupBy("consumer").agg(F.max("event_id").alias("seen"))
    return cursors.join(top, "consumer", "left").select("consumer", F.greatest("cursor", F.coalesce("seen", "cursor")).alias("cursor"))


def checkpoints(cursors: DataFrame, reports: DataFrame) -> DataFrame:
    """Connectors' cursors (connector, cursor, items) after reports (connector, nth, cursor, items, error): items add up
    always, a cursor moves to that of the last report without an error."""
    told = reports.groupBy("connector").agg(
        F.max_by("cursor", F.when(F.col("error").isNull(), F.col("nth"))).alias("_last"), F.sum("items").alias("_more"), F.count_if(F.col("error").isNull()).alias("_good")
    )
    moved = F.when(F.col("_good") > 0, F.col("_last")).otherwise(F.col("cursor"))
    return cursors.join(told, "connector", "left").select("connector", moved.alias("cursor"), (F.col("items") + F.coalesce("_more", F.lit(0))).alias("items"))


def queue_stats(queues: DataFrame, jobs: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Counts by status; queues without jobs stay."""
    counts = jobs.groupBy("queue_id").agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses))
    joined = queues.join(counts, "queue_id", "left")
    return joined.select("queue_id", *(F.coalesce(f"n_{s}", F.lit(0)).alias(f"n_{s}") for s in statuses))


def lease_order(jobs: DataFrame, now: Column, limit: int) -> DataFrame:
    """Visible ready jobs by priority, time and identifier."""
    ready = jobs.where((F.col("status") == "ready") & (F.col("visible_at") <= now))
    return ready.orderBy(F.desc("priority"), "visible_at", "job_id").limit(limit)


def reaped(jobs: DataFrame, now: Column, attempts: int) -> DataFrame:
    """Jobs whose lease is over: ready again, or dead after so many attempts."""
    over = (F.col("status") == "leased") & (F.col("leased_until") < now)
    return jobs.withColumn("status", F.when(over, F.when(F.col("attempts") >= attempts, "dead").otherwise("ready")).otherwise(F.col("status")))


def acked(jobs: DataFrame, acks: DataFrame) -> DataFrame:
    """Jobs with those of ``acks`` (job_id) done that were leased; others stay as they are."""
    hit = jobs.join(acks.select("job_id").distinct().withColumn("_hit", F.lit(True)), "job_id", "left")
    return hit.withColumn("status", F.when(F.col("_hit") & (F.col("status") == "leased"), "done").otherwise(F.col("status"))).drop("_hit")


def nacked(jobs: DataFrame, nacks: DataFrame, queues: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Jobs with those of ``nacks`` (job_id, error) ready again or dead, and letters for the queues of dead ones.

    A nack of a job that isn't leased raises an error. queues: (queue_id, max_retries,
    dlq_queue_id); letters: (queue_id, source_queue, source_job_id, last_error, payload),
    none where a queue has no queue for dead letters.
    """
    told = nacks.groupBy("job_id").agg(F.max("error").alias("_error"))
    joined = jobs.join(told.withColumn("_hit", F.lit(True)), "job_id", "left").join(queues, "queue_id", "left")
    wrong = F.raise_error(F.concat(F.lit("job "), F.col("job_id").cast("string"), F.lit(" isn't leased"))).cast("string")
    over = F.col("attempts") >= F.col("max_retries")
    status = F.when(F.col("_hit").isNull(), F.col("status")).when(F.col("status") != "leased", wrong).when(over, "dead").otherwise("ready")
    marked = joined.withColumns({"_was": F.col("status"), "status": status})
    back = F.col("_hit") & (F.col("status") == "ready")
    out = marked.withColumns({"visible_at": F.when(back, now).otherwise(F.col("visible_at")), "last_error": F.when(F.col("_hit"), F.col("_error")).otherwise(F.col("last_error"))})
    dead = marked.where(F.col("_hit") & (F.col("status") == "dead") & F.col("dlq_queue_id").isNotNull())
    letters = dead.select(F.col("dlq_queue_id").alias("queue_id"), F.col("queue_id").alias("source_queue"), F.col("job_id").alias("source_job_id"), F.col("_error").alias("last_error"), "payload")
    return out.select(*jobs.columns), letters


def left(members: DataFrame, leaves: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Present members (pool_id, account, ...) without those that leave (pool_id, account), and an event for each that was there."""
    keys = ["pool_id", "account"]
    gone = members.join(leaves.select(*keys).distinct(), keys, "left_semi")
    return members.join(leaves, keys, "left_anti"), gone.select(*keys, F.lit("presence_left").alias("event_kind"), now.alias("at"))


def sessions(beats: DataFrame, ttl_seconds: int, key: str = "user_id", at: str = "ts") -> DataFrame:
    """Presence: heartbeats closer than the time to live are one session."""
    own = Window.partitionBy(key).orderBy(at)
    gap = _micros(F.col(at)) - _micros(F.lag(at).over(own))
    marked = beats.withColumn("_new", F.when(gap.isNull() | (gap >= ttl_seconds * 1_000_000), 1).otherwise(0))
    numbered = marked.withColumn("session_no", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session_no").agg(F.min(at).alias("joined_at"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("n_beats"))


def expired(beats: DataFrame, now: Column, ttl_seconds: int, key: str = "user_id", at: str = "ts") -> DataFrame:
    """Members whose last heartbeat is older than the time to live."""
    last = beats.groupBy(key).agg(F.max(at).alias("last_seen"))
    return last.where(_micros(F.col("last_seen")) + ttl_seconds * 1_000_000 < _micros(now))


def dirty(objects: DataFrame, embedded: DataFrame) -> DataFrame:
    """Objects (object_id, content_hash) that have no embedding of the same content."""
    return objects.join(embedded, ["object_id", "content_hash"], "left_anti")


def embedded(queue: DataFrame, done: DataFrame) -> DataFrame:
    """The queue (object_id, generation) without what was embedded (object_id, generation): one that was queued again meanwhile stays."""
    return queue.join(done.select("object_id", "generation"), ["object_id", "generation"], "left_anti")


def reindex_claims(objects: DataFrame, oldest: Column, newest_entry: Column, limit: int) -> DataFrame:
    """Never indexed, indexed too long ago, or before the newest registry entry; never indexed first."""
    last = F.col("last_indexed")
    due = objects.where(last.isNull() | (last < oldest) | (last < newest_entry))
    return due.orderBy(F.asc_nulls_first("last_indexed"), "object_id").limit(min(max(limit, 1), 500))


def prometheus(counts: DataFrame, metric: str, label: str) -> DataFrame:
    """Lines ``metric{label="x"} n`` of (value, n); backslashes, quotes and line feeds in values are escaped."""
    value = F.replace(F.replace(F.replace(F.col("value"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return counts.select(F.format_string(metric + "{" + label + '="%s"} %d', value, "n").alias("line"))


def exposition(metrics: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Lines of several metrics: name to (rows, column); a metric counts its rows by the column's values."""
    made = [prometheus(rows.groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).where("value is not null"), name, c) for name, (rows, c) in metrics.items()]
    return reduce(DataFrame.unionByName, made)


def ticked(schedules: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Schedules (schedule_id, cron, enabled, next_run_at) after a tick, and those that fire: enabled ones whose time has come."""
    due = F.col("enabled") & (F.col("next_run_at") <= now)
    after = schedules.withColumn("next_run_at", F.when(due, T.next_fire(F.col("cron"), now)).otherwise(F.col("next_run_at")))
    return after, schedules.where(due)


def traces(events: DataFrame, key: Sequence[str]) -> DataFrame:
    """Steps of each trace in order, with the step before."""
    own = Window.partitionBy(*key).orderBy("ts", "event_id")
    return events.select(
        *key, "event_id", F.row_number().over(own).alias("step_idx"), F.col("event_type").alias("action"), F.lag("event_type").over(own).alias("after")
    )


def signatures(steps: DataFrame, key: Sequence[str]) -> DataFrame:
    """Each trace's actions in order, and whether it ended in an error."""
    ordered = F.array_sort(F.collect_list(F.struct("step_idx", "action")))
    made = steps.groupBy(*key).agg(ordered.alias("s"))
    names = F.transform("s", lambda x: x["action"])
    return made.select(*key, F.array_join(names, ">").alias("signature"), (F.element_at(names, -1) == "error").alias("failed"))


def trace_summaries(steps: DataFrame, key: Sequence[str]) -> DataFrame:
    """Each trace's outcome, tools, last exception and evidence; steps: (step_idx, action, tool, outcome).

    The last step's outcome is the trace's; an exception is an outcome ``exception:...``.
    """
    made = steps.groupBy(*key).agg(
        F.max_by("outcome", "step_idx").alias("last"),
        F.array_join(F.array_sort(F.collect_set(F.lower(F.trim("tool")))), "|").alias("tool_stack"),
        F.max_by("outcome", F.when(F.startswith("outcome", F.lit("exception:")), F.col("step_idx"))).alias("_thrown"),
        F.count_if(F.startswith("outcome", F.lit("exception:"))).alias("_n"),
    )
    outcome = F.when(F.startswith("last", F.lit("exception:")), "failure").otherwise(F.col("last"))
    exception = F.when(F.col("_n") > 0, F.substring_index("_thrown", ":", -1)).otherwise(F.lit(""))
    return made.select(*key, outcome.alias("outcome"), "tool_stack", exception.alias("exception_pattern"), outcome.isin("failure", "aborted").alias("failed"))


#: The keys by which traces are alike.
CLUSTER = ("subject_class", "action_class", "outcome", "environment", "tool_stack", "exception_pattern")


def clusters(signed: DataFrame, by: Sequence[str] = ("signature",)) -> DataFrame:
    """Traces alike in all of ``by`` (a null is one value), with counts of their evidence."""
    return signed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_traces"), F.count_if(~F.col("failed")).alias("n_positive"), F.count_if("failed").alias("n_negative")
    )


def step_template(steps: DataFrame) -> DataFrame:
    """Per step the most frequent action (ties: the first by name), its share and the count."""
    counts = steps.groupBy("step_idx", "action").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("step_idx")
    ranked = counts.withColumns({"_n": F.row_number().over(own.orderBy(F.desc("n"), "action")), "n_steps": F.sum("n").over(own)})
    return ranked.where("_n = 1").select("step_idx", "action", F.round(F.col("n") / F.col("n_steps"), 4).alias("share"), "n_steps")


def candidate_template(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per step (of each of ``by``) the most frequent action, actor and tool, the share of successes and the count; ties go to the first by name."""
    keys = [*by, "step_idx"]
    out = steps.groupBy(*keys).agg(F.round(F.count_if(F.col("outcome") == "success") / F.count(F.lit(1)), 4).alias("success_rate"), F.count(F.lit(1)).alias("sample_count"))
    for column in ("action", "actor", "tool"):
        counts = steps.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
        own = Window.partitionBy(*keys).orderBy(F.desc("_n"), column)
        top = counts.withColumn("_k", F.row_number().over(own)).where("_k = 1").select(*keys, F.col(column).alias(f"common_{column}"))
        out = out.join(top, keys, "left")
    return out


def next_state(transitions: DataFrame, runs: DataFrame) -> DataFrame:
    """A skill's next state: the exact outcome, then ``exception:*``, then ``default``; the lowest ordinal."""
    joined = runs.join(transitions, "state")
    rank = (
        F.when(F.col("on") == F.col("outcome"), 1)
        .when((F.col("on") == "exception:*") & F.startswith("outcome", F.lit("exception:")), 2)
        .when(F.col("on") == "default", 3)
    )
    own = Window.partitionBy("run_id").orderBy("_rank", "ordinal")
    ranked = joined.withColumn("_rank", rank).where(F.col("_rank").isNotNull()).withColumn("_n", F.row_number().over(own))
    return ranked.where("_n = 1").select("run_id", "state", "outcome", F.col("to_state").alias("next_state"))
