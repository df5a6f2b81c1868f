"""Retrieval from an envelope to rows: cues, intent, plan, hints, executors, assembly.

The four governed types live in tables of one shape each (see ``Memory``). A plan is
a small value on the driver; what it runs are DataFrames. Planned strategies that
have no executor (vector, graph walk, routing, floor, tree) stay in the plan and run
nothing; the floor is applied when hits are assembled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoscope.functions import strings as S
from mnemoscope.operators import lifecycle, records, text

#: Governed types in the order of their search.
TYPES = ("claim", "fact", "memory", "episode_object")
#: Weights of cues by kind.
CUE_WEIGHTS = {"phrase": 2.0, "time_marker": 0.5, "subject": 1.5, "verb": 1.5, "predicate": 1.5, "term": 1.0}
#: Registries in the order in which they are asked; patterns of a recall and of a time marker.
REGISTRIES = ("subject", "verb", "predicate")
RECALL = r"^\s*(what|show me|list|find|where|when|who)\b"
MARKER = r"(?i)\b(as of|before|after)\s+(\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2})?Z?)?)"
#: States that a hit may not be in; rows of one strategy; characters of a snippet.
GONE = ("tombstoned", "retired")
STRATEGY_LIMIT, SNIPPET, THRESHOLD = 50, 240, 0.3
HIT = ("object_type", "object_id", "title", "snippet", "rank", "strategy")


@dataclass(frozen=True)
class Envelope:
    """What is asked: a text, types, times, a floor of confidence, and inline hints."""

    cue_text: str | None = None
    object_types: tuple[str, ...] | None = TYPES
    valid_as_of: str | None = None
    transaction_as_of: str | None = None
    confidence_floor: float | None = None
    hints: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Step:
    strategy: str
    params: Mapping[str, Any] = field(default_factory=dict)
    boost: float | None = None


@dataclass(frozen=True)
class Plan:
    intent: str
    cues: tuple[tuple[str, str], ...]
    steps: tuple[Step, ...]
    envelope: Envelope

    def strategies(self) -> tuple[str, ...]:
        return tuple(s.strategy for s in self.steps)


@dataclass(frozen=True)
class Memory:
    """Tables of the governed types.

    claims and facts: (object_id, subject, verb, title, body, lifecycle_state, source_package_id,
    valid_from, valid_to, recorded_from, recorded_to); memories and episodes the same without
    subject, verb and source. confidences: (object_type, object_id, confidence).
    registry: (kind, entry_id, canonical, aliases).
    """

    claim: DataFrame
    fact: DataFrame
    memory: DataFrame
    episode_object: DataFrame
    confidences: DataFrame
    registry: DataFrame

    def table(self, kind: str) -> DataFrame:
        return getattr(self, kind).withColumn("object_type", F.lit(kind))


def cues(texts: DataFrame, registry: DataFrame) -> DataFrame:
    """Cues (text_id, nth, cue_kind, cue_text, resolved_id, weight) of (text_id, text), in order.

    Quoted phrases come first, then time markers (as of, before or after a date), then
    the other words, each looked up among the names of subjects, verbs and predicates
    (canonical, kind by kind, before aliases of that kind); what no registry knows is a term.
    """
    whole = F.coalesce("text", F.lit(""))
    bare = F.regexp_replace(whole, '"[^"]+"', "")
    marked = F.zip_with(F.regexp_extract_all(bare, F.lit(MARKER), F.lit(1)), F.regexp_extract_all(bare, F.lit(MARKER), F.lit(2)), lambda a, b: F.concat(a, F.lit(" "), b))
    words = F.filter(F.split(F.lower(F.regexp_replace(bare, MARKER, "")), r"[\s,;:!?]+", -1), lambda w: w != "")

    def kind(name: str) -> Callable[[Column], Column]:
        return lambda x: F.struct(F.lit(name).alias("cue_kind"), x.alias("cue_text"))

    made = F.concat(
        F.transform(F.regexp_extract_all(whole, F.lit('"([^"]+)"'), F.lit(1)), kind("phrase")), F.transform(marked, kind("time_marker")), F.transform(words, kind("term"))
    )
    found = texts.select("text_id", F.posexplode(made).alias("nth", "c")).select("text_id", "nth", "c.*")
    order = reduce(lambda out, x: out.when(F.col("kind") == x[1], x[0]), enumerate(REGISTRIES), F.when(F.lit(False), 0))
    names = registry.select(order.alias("_o"), "kind", "entry_id", F.posexplode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_a", "name"))
    own = Window.partitionBy("name").orderBy("_o", F.col("_a") > 0, "entry_id")
    first = names.withColumn("name", F.lower("name")).withColumn("_n", F.row_number().over(own)).where("_n = 1")
    first = first.select(F.col("name").alias("cue_text"), F.lit("term").alias("cue_kind"), F.col("kind").alias("_kind"), "entry_id")
    known = found.join(first, ["cue_kind", "cue_text"], "left").withColumn("cue_kind", F.coalesce("_kind", "cue_kind"))
    weights = F.create_map(*(F.lit(x) for pair in CUE_WEIGHTS.items() for x in pair))
    return known.select("text_id", "nth", "cue_kind", "cue_text", F.col("entry_id").alias("resolved_id"), F.element_at(weights, F.col("cue_kind")).alias("weight"))


def intent_of(e: Envelope, found: Sequence[tuple[str, str]]) -> str:
    """What an envelope with these cues (kind, text) is after; the first rule that holds decides."""
    import re

    kinds = set(e.object_types or ())
    rules = (
        ("time_as_of", e.valid_as_of is not None or e.transaction_as_of is not None),
        ("by_confidence", e.confidence_floor is not None),
        ("by_source", not {"source_package_id", "connector_id"}.isdisjoint(e.hints)),
        ("structured_doc_qa", not {"tree_id", "page_index_tree_id"}.isdisjoint(e.hints)),
        ("long_chat_recall", not {"chat_tree_id", "chat_index_tree_id"}.isdisjoint(e.hints)),
        ("structured_doc_qa", "page_index_node" in kinds),
        ("long_chat_recall", not {"chat_index_topic", "chat_index_message"}.isdisjoint(kinds)),
        ("narrow", sum(k in REGISTRIES for k, _ in found) >= 2),
        ("recall", re.match(RECALL, (e.cue_text or "").lower()) is not None),
    )
    return next((name for name, holds in rules if holds), "broad")


def steps_for(intent: str, e: Envelope, found: Sequence[tuple[str, str]]) -> tuple[Step, ...]:
    """Strategies of an intent, in order, with their parameters."""
    asked = {"query": e.cue_text}
    typed = Step("fts", {**asked, "object_types": e.object_types})
    fts, vector = Step("fts", asked), Step("vector", asked)

    def tree(*names: str) -> Step:
        return Step("tree_descent", {"tree_id": next((e.hints[n] for n in names if n in e.hints), None), **asked})

    #: Which strategies an intent runs.
    return {
        "narrow": (Step("svpor_routing", {"cues": tuple(found)}), typed, vector),
        "broad": (typed, vector, Step("graph_walk", {"max_depth": 3})),
        "recall": (Step("fuzzy_subject", {"needle": e.cue_text, "threshold": THRESHOLD}), fts),
        "time_as_of": (Step("temporal_as_of", {"valid_as_of": e.valid_as_of, "transaction_as_of": e.transaction_as_of}), fts),
        "by_source": (Step("source_filter", {k: e.hints.get(k) for k in ("source_package_id", "connector_id")}), fts),
        "by_confidence": (Step("confidence_floor", {"floor": e.confidence_floor}), fts),
        "structured_doc_qa": (tree("tree_id", "page_index_tree_id"), fts),
        "long_chat_recall": (tree("chat_tree_id", "chat_index_tree_id"),),
    }.get(intent, (fts,))


def hinted(plan: Plan, hints: Mapping[str, Any] | None) -> Plan:
    """A plan under hints: overrides plan anew, then paths are suppressed, forced to the front and boosted.

    A boost only annotates its step.
    """
    if not hints:
        return plan
    e, intent, steps = plan.envelope, hints.get("intent_override", plan.intent), plan.steps
    if "confidence_floor_override" in hints:
        e = replace(e, confidence_floor=hints["confidence_floor_override"])
    if "time_constraint_override" in hints:
        e = replace(e, **{k: v for k, v in hints["time_constraint_override"].items() if k in ("valid_as_of", "transaction_as_of")})
    if not {"confidence_floor_override", "time_constraint_override", "intent_override"}.isdisjoint(hints):
        steps = steps_for(intent, e, plan.cues)
    steps = tuple(s for s in steps if s.strategy not in hints.get("suppress_path", ()))
    forced = tuple(hints.get("force_path", ()))
    steps = (*(s for name in forced for s in steps if s.strategy == name), *(s for s in steps if s.strategy not in forced))
    boosts = hints.get("boost_weight", {})
    return Plan(intent, plan.cues, tuple(replace(s, boost=boosts.get(s.strategy, s.boost)) for s in steps), e)


def planned(e: Envelope, registry: DataFrame, hints: Mapping[str, Any] | None = None) -> Plan:
    """The plan of an envelope: its cues (one text, so a few rows), intent and steps; inline hints first, then ``hints``."""
    asked = registry.sparkSession.createDataFrame([(0, e.cue_text)], "text_id int, text string")
    found = tuple((r.cue_kind, r.cue_text) for r in sorted(cues(asked, registry).collect(), key=lambda r: r.nth))
    intent = intent_of(e, found)
    return hinted(hinted(Plan(intent, found, steps_for(intent, e, found), e), e.hints), hints)


def _hits(rows: DataFrame, rank: Column, strategy: str, title: Column | None = None) -> DataFrame:
    shown = F.coalesce("title", F.lit("?")) if title is None else title
    return rows.select("object_type", "object_id", shown.alias("title"), F.substring(F.coalesce("body", F.lit("")), 1, SNIPPET).alias("snippet"), rank.cast("double").alias("rank"), F.lit(strategy).alias("strategy"), "lifecycle_state")


def _every(m: Memory, kinds: Sequence[str]) -> DataFrame | None:
    columns = ("object_type", "object_id", "title", "body", "lifecycle_state")
    parts = [m.table(k).select(*columns) for k in TYPES if k in kinds]
    return reduce(DataFrame.unionByName, parts) if parts else None


def fts(m: Memory, params: Mapping[str, Any]) -> DataFrame | None:
    """Hits of a web-style query over titles (weight A) and bodies (weight B) of the wanted types."""
    query, kinds = params.get("query"), params.get("object_types") or TYPES
    every = _every(m, kinds)
    if not query or every is None:
        return None
    matched = text.web_search(every, query)
    if matched is None:
        return None
    best = matched.orderBy(F.desc_nulls_last("rank"), "object_id", "object_type").limit(params.get("limit") or STRATEGY_LIMIT)
    return _hits(best, F.col("rank"), "fts")


def fuzzy_subject(m: Memory, params: Mapping[str, Any]) -> DataFrame | None:
    """Claims and facts whose subject is like the needle, by trigrams."""
    needle = params.get("needle")
    if not needle:
        return None
    parts = [m.table(k).select("object_type", "object_id", "subject", "lifecycle_state") for k in ("claim", "fact")]
    near = F.round(S.similarity(S.trigrams(F.col("subject")), S.trigrams(F.lit(needle))), 6)
    found = parts[0].unionByName(parts[1]).where("subject is not null").withColumn("near", near).where(F.col("near") >= params.get("threshold", THRESHOLD))
    best = found.orderBy(F.desc("near"), "subject", "object_type", "object_id").limit(params.get("limit") or STRATEGY_LIMIT)
    return _hits(best.withColumn("body", F.lit(None).cast("string")), F.col("near"), "fuzzy_subject", F.col("subject")).withColumn("snippet", F.lit(None).cast("string"))


def temporal_as_of(m: Memory, params: Mapping[str, Any]) -> DataFrame:
    """Facts, memories and episodes that were valid and recorded at a time (now without one)."""
    at = params.get("valid_as_of") or params.get("transaction_as_of")
    moment = lifecycle.at_time(at) if at else F.current_timestamp()
    parts = [_hits(lifecycle.as_of(m.table(k), moment), F.lit(1.0), "temporal_as_of") for k in TYPES[1:]]
    return reduce(DataFrame.unionByName, parts)


def source_filter(m: Memory, params: Mapping[str, Any]) -> DataFrame | None:
    """Claims of a source package."""
    package = params.get("source_package_id")
    if package is None:
        return None
    return _hits(m.table("claim").where(F.col("source_package_id") == package), F.lit(1.0), "source_filter")


EXECUTORS: dict[str, Callable[[Memory, Mapping[str, Any]], DataFrame | None]] = {
    "fts": fts, "fuzzy_subject": fuzzy_subject, "temporal_as_of": temporal_as_of, "source_filter": source_filter,
}


def execute(m: Memory, e: Envelope, hints: Mapping[str, Any] | None = None, limit: int = 20) -> DataFrame:
    """Hits of an envelope, best first: the best of each object over all strategies, none that is gone or below the floor.

    No types asked for means the four types; a type without visible rows is left out,
    and without any there are no hits.
    """
    spark = m.registry.sparkSession
    kinds = records.authorized_types({k: m.table(k) for k in TYPES}, e.object_types or TYPES)
    made: list[DataFrame] = []
    if kinds:
        plan = planned(replace(e, object_types=tuple(kinds)), m.registry, hints)
        made = [h for s in plan.steps if s.strategy in EXECUTORS for h in [EXECUTORS[s.strategy](m, s.params)] if h is not None]
    if not made:
        return spark.createDataFrame([], "object_type string, object_id long, title string, snippet string, rank double, strategy string")
    every = reduce(DataFrame.unionByName, made)
    own = Window.partitionBy("object_type", "object_id").orderBy(F.desc_nulls_last("rank"), "strategy")
    best = every.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")
    # Hits carry their state, so no table is read again to leave out what is gone; claims have no such states.
    live = best.where((F.col("object_type") == "claim") | ~F.coalesce(F.col("lifecycle_state").isin(*GONE), F.lit(False)))
    if e.confidence_floor is not None:
        sure = F.coalesce("confidence", F.lit(1.0))
        live = live.join(m.confidences, ["object_type", "object_id"], "left").where(sure >= e.confidence_floor).drop("confidence")
    return live.orderBy(F.desc_nulls_last("rank"), "object_type", "object_id").limit(limit).select(*HIT)


@dataclass(frozen=True)
class Retrieved:
    """Hits of an envelope (written once, so that the audit speaks of the same rows) and the decisions behind them."""

    hits: DataFrame
    decisions: DataFrame
    intent: str
    final_count: int


def retrieve(m: Memory, e: Envelope, hints: Mapping[str, Any] | None = None, hint_name: str | None = None, limit: int = 20) -> Retrieved:
    """``execute`` with an audit: (stage, allowed, reason, object_type, object_id) of planning and of every object included."""
    from mnemoscope.sources.scratch import settled

    found = settled(execute(m, e, hints, limit), "hits")
    first = m.registry.sparkSession.createDataFrame(
        [("planning", True, f"hint:{hint_name}" if hint_name else "no_hint", None, None)], "stage string, allowed boolean, reason string, object_type string, object_id long"
    )
    kept = found.select(F.lit("assembly").alias("stage"), F.lit(True).alias("allowed"), F.lit("object included").alias("reason"), "object_type", "object_id")
    return Retrieved(found, first.unionByName(kept), planned(e, m.registry, hints).intent, found.count())
