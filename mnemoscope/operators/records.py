"""Grants, models, phrases, addresses, communities, pools and attributes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def granted(objects: DataFrame, grants: DataFrame, level: str, now: Column) -> DataFrame:
    """Objects (object_id) with a grant of a level that is neither revoked nor expired."""
    live = grants.where((F.col("level") == level) & F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    return objects.join(live, "object_id", "left_semi")


def authorized_types(tables: Mapping[str, DataFrame], wanted: Sequence[str]) -> list[str]:
    """Of the wanted types those with at least one visible row; an unknown type is an error."""
    unknown = [t for t in wanted if t not in tables]
    if unknown:
        raise ValueError(f"unknown types {unknown}")
    return [t for t in wanted if not tables[t].isEmpty()]


def negotiated(models: DataFrame, least_context: int, gpu: bool | None = None) -> DataFrame:
    """Models (model_id, gpu, context, speed) that are able, graphics cards first, then the fastest; unknown speed last."""
    able = models.where(F.col("context") >= least_context)
    if gpu is not None:
        able = able.where(F.col("gpu") == gpu)
    return able.orderBy(F.desc("gpu"), F.desc_nulls_last("speed"), "model_id")


def advanced_model(models: DataFrame, model_id: int, to: str) -> DataFrame:
    """Models (model_id, kind, state) with one in a new state; one that becomes active sends the active one of its kind into retirement."""
    from mnemoscope.functions.governance import MODEL_MOVES, advanced

    found = models.where(F.col("model_id") == model_id).select("kind", "state").first()
    if found is None:
        raise ValueError(f"unknown model {model_id}")
    state = F.when(F.col("model_id") == model_id, advanced(found.state, to, MODEL_MOVES))
    if to == "active":
        state = state.when((F.col("kind") == found.kind) & (F.col("state") == "active"), "retiring")
    return models.withColumn("state", state.otherwise(F.col("state")))


def phrase_lookup(phrases: DataFrame, verbs: DataFrame) -> DataFrame:
    """Each phrase's verb (verb_id, canonical, aliases, phrases): canonical name, then alias, then search phrase."""
    names = (
        verbs.select("verb_id", F.lower("canonical").alias("_p"), F.lit(1).alias("source"))
        .unionByName(verbs.select("verb_id", F.explode("aliases").alias("_p"), F.lit(2).alias("source")).withColumn("_p", F.lower("_p")))
        .unionByName(verbs.select("verb_id", F.explode("phrases").alias("_p"), F.lit(3).alias("source")).withColumn("_p", F.lower("_p")))
    )
    own = Window.partitionBy("_p").orderBy("source", "verb_id")
    first = names.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")
    return phrases.withColumn("_p", F.lower("phrase")).join(first, "_p").drop("_p")


def resolved_address(address: Column) -> Column:
    """(owner, id) of addresses ``mdo://owner/id``; null for others."""
    pattern = r"^mdo://([^/]+)/([0-9]+)$"
    made = F.struct(F.regexp_extract(address, pattern, 1).alias("owner"), F.regexp_extract(address, pattern, 2).cast("long").alias("id"))
    return F.when(F.rlike(address, F.lit(pattern)), made)


def replaced_communities(old: DataFrame, new: DataFrame, known: DataFrame, namespace: str) -> tuple[DataFrame, DataFrame]:
    """Memberships (namespace, community, member) with one namespace replaced, and the members nobody knows."""
    fresh = new.where(F.col("namespace") == namespace)
    unknown = fresh.join(known, "member", "left_anti").select("member").distinct()
    kept = old.where(F.col("namespace") != namespace).unionByName(fresh.join(known, "member", "left_semi").select(*old.columns))
    return kept, unknown


def applicable(environment: Column, stack: Column, at: Column, rule: Column) -> Column:
    """Whether a rule (environment, stack, from, until; null is any) fits."""
    return (
        (rule["environment"].isNull() | (rule["environment"] == environment))
        & (rule["stack"].isNull() | F.arrays_overlap(stack, rule["stack"]))
        & (rule["from"].isNull() | (rule["from"] <= at))
        & (rule["until"].isNull() | (rule["until"] > at))
    )


def _holds(value: Column, wanted: object) -> Column:
    """Whether a variant contains a JSON value: objects field by field, arrays some element for each, scalars by type and value."""
    kind = F.schema_of_variant(value)
    if isinstance(wanted, Mapping):
        out = F.startswith(kind, F.lit("OBJECT"))
        for name, inner in wanted.items():
            out = out & _holds(F.try_variant_get(value, f"$['{name}']", "variant"), inner)
    elif isinstance(wanted, (list, tuple)):
        items = F.try_variant_get(value, "$", "array<variant>")
        out = F.startswith(kind, F.lit("ARRAY"))
        for inner in wanted:
            out = out & F.exists(items, _holder(inner))
    elif isinstance(wanted, bool):
        out = (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == F.lit(wanted))
    elif isinstance(wanted, (int, float)):
        out = F.rlike(kind, F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)")) & (F.try_variant_get(value, "$", "double") == F.lit(float(wanted)))
    elif wanted is None:
        out = kind == "VOID"
    else:
        out = (kind == "STRING") & (F.try_variant_get(value, "$", "string") == F.lit(str(wanted)))
    return F.coalesce(out, F.lit(False))


def _holder(wanted: object) -> Callable[[Column], Column]:
    return lambda x: _holds(x, wanted)


def contains_fields(payload: Column, wanted: Mapping[str, object]) -> Column:
    """Whether JSON texts contain a JSON object, types included ("7" isn't 7); a dotted name is a path."""
    nested: dict = {}
    for path, value in wanted.items():
        *above, last = path.split(".")
        at = nested
        for name in above:
            at = at.setdefault(name, {})
        at[last] = value
    return _holds(F.try_parse_json(payload), nested)


def typed_attributes(attributes: DataFrame) -> DataFrame:
    """Attributes with the first value that is there (time, range of times, number, text, JSON) and its type; references keep theirs."""
    kinds = (("timestamp", "value_timestamp"), ("tstzrange", "value_range"), ("numeric", "value_numeric"), ("text", "value_text"), ("jsonb", "value_json"))
    kinds = tuple(k for k in kinds if k[1] in attributes.columns)
    value = F.coalesce(*(F.col(c).cast("string") for _, c in kinds))
    kind = F.when(F.col("ref_source").isNotNull(), "reference")
    for name, c in kinds:
        kind = kind.when(F.col(c).isNotNull(), name)
    return attributes.select("target_id", "attr_name", value.alias("value"), kind.alias("value_type"))


def promoted(observations: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Claims of a pool's observations (pool_id, subject, verb, value) seen at least so often, and what stays."""
    keys = ["pool_id", "subject", "verb", "value"]
    claims = observations.groupBy(*keys).agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= least)
    return claims, observations.join(claims, keys, "left_anti")


def promoted_to_facts(members: DataFrame, chosen: DataFrame, first_id: int) -> tuple[DataFrame, DataFrame]:
    """Pool members (member_id, pool_id, kind, object_id, promoted_to) after ``chosen`` (member_id) became facts, and the facts (fact_id, claim_id, pool_id).

    Only pending claims that weren't promoted may be; others raise an error. The claim
    stays as a member that names its fact, and the fact becomes a member of the pool.
    """
    hit = members.join(chosen.select("member_id").distinct().withColumn("_hit", F.lit(True)), "member_id", "left")
    wrong = F.raise_error(F.concat(F.lit("member "), F.col("member_id").cast("string"), F.lit(" is no pending claim"))).cast("long")
    fits = (F.col("kind") == "pending_claim") & F.col("promoted_to").isNull()
    fact = F.when(fits, F.col("member_id") + first_id).otherwise(wrong)
    old = hit.withColumn("promoted_to", F.when(F.col("_hit"), fact).otherwise(F.col("promoted_to"))).select(*members.columns)
    made = hit.where("_hit").select("member_id", "pool_id", fact.alias("fact_id"), F.col("object_id").alias("claim_id"))
    new = made.select(F.col("fact_id").alias("member_id"), "pool_id", F.lit("fact").alias("kind"), F.col("fact_id").alias("object_id"), F.lit(None).cast("long").alias("promoted_to"))
    return old.unionByName(new), made.select("fact_id", "claim_id", "pool_id")


def routed(models: DataFrame, migrations: DataFrame, kind: str = "embedding") -> DataFrame:
    """Spaces (strategy, space_id, weight, role, migration_id) that a query of a kind of model goes to.

    models: (kind, state, space_id); migrations: (migration_id, source_space, target_space,
    status, percent, started_at). Without an active model there is an error; a migration in
    dual_serve splits, one in cutover or cleanup sends all to its target.
    """
    active = models.where((F.col("kind") == kind) & (F.col("state") == "active")).orderBy("space_id").select("space_id").first()
    if active is None:
        raise ValueError(f"no active model of kind {kind}")
    going = migrations.where((F.col("source_space") == active.space_id) & F.col("status").isin("dual_serve", "cutover", "cleanup"))
    last = going.orderBy(F.desc("started_at"), F.desc("migration_id")).first()
    if last is None:
        rows = [("active", active.space_id, 1.0, "active", None)]
    elif last.status == "dual_serve":
        share = round(last.percent / 100.0, 4)
        rows = [("dual_serve", last.source_space, round(1 - share, 4), "source", last.migration_id), ("dual_serve", last.target_space, share, "target", last.migration_id)]
    else:
        rows = [("target_only", last.target_space, 1.0, "target", last.migration_id)]
    return models.sparkSession.createDataFrame(rows, "strategy string, space_id long, weight double, role string, migration_id long")


def consolidated(memories: DataFrame, groups: DataFrame, first_id: int) -> tuple[DataFrame, DataFrame]:
    """Successors of groups (group_id, memory_id) and the edges (source, rel, target) to what they take the place of."""
    joined = memories.join(groups, "memory_id")
    own = joined.groupBy("group_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("memory_id", "title"))), lambda x: x["title"])).alias("title"))
    made = own.select((F.col("group_id") + first_id).alias("memory_id"), "title", F.lit("active").alias("lifecycle_state"))
    edges = groups.select((F.col("group_id") + first_id).alias("source"), F.lit("consolidates").alias("rel"), F.col("memory_id").alias("target"))
    return made, edges


def tenant_view(df: DataFrame, owner: str, column: str = "owner_schema") -> DataFrame:
    """One tenant's rows without the tenant column."""
    return df.where(F.col(column) == owner).drop(column)
