"""Scalars over texts: slugs, tokens, trigrams, templates, hashes."""

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def estimated_tokens(text: Column) -> Column:
    """About four characters a token, at least one."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4).cast("int"))


def substituted(template: Column, values: Mapping[str, Column]) -> Column:
    """``{{name}}`` and ``:name`` replaced, in order of names."""
    for name in sorted(values):
        template = F.replace(F.replace(template, F.lit("{{" + name + "}}"), values[name]), F.lit(":" + name), values[name])
    return template


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9_]+", -1), lambda x: x != "")


def token_count(lowered: Column) -> Column:
    """How many tokens a lower-cased text has."""
    return F.regexp_count(lowered, F.lit("[a-z0-9_]+"))


def word_count(lowered: Column, words: Sequence[str]) -> Column:
    """How often words stand in sequence among the tokens of a lower-cased text; nothing else than tokens is found."""
    if not all(re.fullmatch("[a-z0-9_]+", w) for w in words):
        return F.lit(0)
    return F.regexp_count(lowered, F.lit(f"(?<![a-z0-9_]){'[^a-z0-9_]+'.join(words)}(?![a-z0-9_])"))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of every word, padded by two blanks before and one behind."""
    padded = F.transform(tokens(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    each = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def similarity(a: Column, b: Column) -> Column:
    """Shared over all trigrams."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / every)


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def tool_signature(tools: Column) -> Column:
    """Lower-cased names in order, joined by a bar; blanks are dropped."""
    named = F.filter(F.transform(tools, lambda t: F.lower(F.trim(t))), lambda t: t.isNotNull() & (t != ""))
    return F.array_join(F.array_sort(named), "|")


def card(*parts: tuple[str, Column]) -> Column:
    """One ``name: value`` line for each value that is there."""
    return F.concat_ws("\n", *(F.when(v.isNotNull() & (v.cast("string") != ""), F.concat(F.lit(f"{n}: "), v.cast("string"))) for n, v in parts))
