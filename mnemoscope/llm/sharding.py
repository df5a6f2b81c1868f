"""Shards by a hierarchical weighted hash tree: region, then rack, then shard.

At each level a row draws ``-ln(u) / weight`` for every child of the node it has
reached, with u from a hash of the row's key and the child's name, and goes down
to the least draw. A child's share is its weight's share; a draw depends on
nothing but key, name and weight, so a change moves rows only between the
subtrees whose weights change. A node's weight is the sum of its shards'.

Growing by one shard adds a region of its own: the draws of all old regions stay
as they were, so a row either keeps its shard or goes to the new one.

Defined results: the key decides alone, so repeated rows meet in one shard; a null
key is hashed like any other value; null and empty texts have size 1; an empty
table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import utf8_size, with_slots, written


@dataclass(frozen=True)
class Shard:
    shard: int
    region: str
    rack: str
    weight: float = 1.0


Tree = tuple[Shard, ...]


def even_tree(shards: int, founding: int = 16, racks_a_region: int = 2, shards_a_rack: int = 2) -> Tree:
    """``founding`` shards in equal racks and regions; each shard after them is a region of its own.

    The tree of n + 1 shards is that of n and one more region, for n of at least ``founding``.
    """
    a_region = racks_a_region * shards_a_rack
    first = tuple(
        Shard(s, f"r{s // a_region}", f"r{s // a_region}/k{s % a_region // shards_a_rack}")
        for s in range(min(shards, founding))
    )
    return first + tuple(Shard(s, f"g{s}", f"g{s}/k0") for s in range(founding, shards))


def _level(children: dict[str, dict[str, float]]) -> tuple[dict[str, int], Column]:
    """Numbers of the parents, and an array by number of their children (name, weight)."""
    number = {parent: i for i, parent in enumerate(children)}
    return number, F.array(
        *(
            F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("w")) for n, w in own.items()))
            for own in children.values()
        )
    )


def _draw(key: Column, depth: int) -> Callable[[Column], Column]:
    def draw(child: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(depth), child["name"]), 11)
        unit = (bits.cast("double") + 0.5) / F.lit(float(2**53))
        return F.struct((-F.ln(unit) / child["w"]).alias("cost"), child["name"].alias("name"))

    return draw


def place(key: Column, tree: Tree) -> Column:
    """The shard of a key: an int column, made of hashes and array functions only."""
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for s in tree:
        if s.weight <= 0:
            raise ValueError("weights are above 0")
        for own, (parent, name) in zip(levels, (("", s.region), (s.region, s.rack), (s.rack, str(s.shard))), strict=True):
            named = own.setdefault(parent, {})
            named[name] = named.get(name, 0.0) + s.weight
    at: Column = F.lit("")
    for depth, own in enumerate(levels):
        number, children = _level(own)
        ids = F.create_map(*(x for parent, i in number.items() for x in (F.lit(parent), F.lit(i + 1))))

        at = F.array_min(F.transform(F.element_at(children, F.element_at(ids, at)), _draw(key, depth)))["name"]
    return at.cast("int")


def shard_rows(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc id, size, text_crc32, law 'key', shard, slot (gapless in a shard), grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (utf8_size(F.col(text_col)) + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    placed = rows.withColumns(
        {
            "law": F.lit("key"),
            "shard": place(F.col("id"), even_tree(shards)),
            "grown_shard": place(F.col("id"), even_tree(shards + 1)),
        }
    )
    # Texts are read once; what is numbered is a few dozen bytes a row.
    small = written(placed, "placed")
    out = with_slots(small, ["shard"], ["id", "text_crc32", "size"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
