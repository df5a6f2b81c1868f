"""Chat formatting: records of many layouts become one template, reversibly.

A record is JSON, or a struct of columns. Its schema fingerprint is a hash of its
nested field paths (leaf types do not count); a declarative mapping, found by
fingerprint, says how its fields become turns. Values of a struct are taken from
its columns, so no text of it goes through JSON, whose parser reads no string of
more than 20,000,000 characters. Records whose fingerprint no mapping knows are returned
by ``unmapped``; ``turns_of`` raises an error where it meets one, unless it is told
to leave them out. Layouts with other names of roles (``human``, ``gpt``) give them
the template's; the flat layout's roles stay as they are.

The template of a turn is ``### role: text</turn>`` and a line feed. Inside roles
and texts ``\\``, ``###``, ``</turn>`` and (in roles) ``:`` are escaped, so markers
in texts are never taken for turns. The loss mask of a conversation is a list of
spans of its formatted text, one for each assistant text.

Defined results: a null role or text is empty; turns of a record are ordered by
their number, then place, role and text (a null number comes first); repeated rows
are repeated turns; records with a null id form one conversation; a record with no
turns gives none; a record that JSON can't be read from (also one with a string of
more than 20,000,000 characters) is unmapped; columns other than record_id and
payload are not read. One
conversation is one output row, so its turns meet in one task by definition.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

END = "</turn>"
HEAD = "### "
#: Fixed values of the template: control strings and what stands for them.
ESCAPES = ((END, "\\e"), ("###", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
#: Names of roles in the layouts that are met.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

TURN_TYPE = "array<struct<turn:bigint,role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns. paths: its field paths, without order.

    items: JSON path of an array whose items have ``role`` and ``text`` fields, and
    roles: what its names of roles are in the template; or
    turns: (role, JSON paths whose non-empty values are joined by a blank line).
    """

    name: str
    paths: frozenset[str]
    items: tuple[str, str, str] | None = None
    roles: tuple[tuple[str, str], ...] = ()
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    one_turn: tuple[str, str, str] | None = None


def _layouts() -> tuple[Mapping, ...]:
    out = [Mapping("turn", frozenset({"turn", "role", "text"}), one_turn=("$.turn", "$.role", "$.text"))]
    for top, role, text in (("messages", "role", "content"), ("conversations", "from", "value"), ("conversation", "role", "content")):
        out.append(Mapping(top, frozenset({top, f"{top}[].{role}", f"{top}[].{text}"}), items=(top, role, text), roles=tuple(ROLES.items())))
    for asked, answer in (("prompt", "response"), ("prompt", "completion"), ("question", "answer"), ("instruction", "output"), ("instruction", "response")):
        pair = (("user", (f"$.{asked}",)), ("assistant", (f"$.{answer}",)))
        out.append(Mapping(f"{asked}-{answer}", frozenset({asked, answer}), turns=pair))
        out.append(Mapping(f"system-{asked}-{answer}", frozenset({"system", asked, answer}), turns=(("system", ("$.system",)), *pair)))
    given = (("user", ("$.instruction", "$.input")), ("assistant", ("$.output",)))
    out.append(Mapping("instruction-input", frozenset({"instruction", "input", "output"}), turns=given))
    return tuple(out)


LAYOUTS = _layouts()


def _shape(paths: frozenset[str]) -> str:
    """The canonical text of a set of field paths, as a record's schema yields it."""
    tree: dict = {}
    for path in paths:
        at = tree
        for name in path.replace("[]", ".[]").split("."):
            at = at.setdefault(name, {})

    def say(node: dict) -> str:
        if "[]" in node:
            return f"ARRAY<{say(node['[]'])}>"
        return "OBJECT<" + ", ".join(f"{k}: {say(v)}".removesuffix(": ") for k, v in sorted(node.items())) + ">" if node else ""

    return say(tree)


def _outline(value: Column, kind: DataType) -> Column:
    """A value of columns with its strings cut to their first character: only names, nesting and arrays count."""
    if isinstance(kind, StructType):
        fields = F.struct(*(_outline(value.getField(f.name), f.dataType).alias(f.name) for f in kind))
        return F.when(value.isNotNull(), fields)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _outline(x, kind.elementType))
    return F.left(value, F.lit(1)) if isinstance(kind, StringType) else value


def shape(payload: Column, kind: DataType = StringType()) -> Column:  # noqa: B008
    """Nested field paths of a record as text: names, nesting and arrays; leaf types are left out. kind: the payload's type."""
    record = F.to_variant_object(_outline(payload, kind)) if isinstance(kind, StructType) else F.try_parse_json(payload)
    return F.regexp_replace(F.schema_of_variant(record), r": (?!ARRAY<|OBJECT<)[A-Z]+(?:\([0-9, ]+\))?(?=[,>])", "")


def fingerprint(payload: Column, kind: DataType = StringType()) -> Column:  # noqa: B008
    return F.xxhash64(shape(payload, kind))


@dataclass(frozen=True)
class _Json:
    """Values of a record that is a variant."""

    def value(self, record: Column, path: str, kind: str) -> Column:
        return F.try_variant_get(record, path, kind)

    def items(self, record: Column, top: str) -> Column:
        return F.try_variant_get(record, f"$.{top}", "array<variant>")

    def has(self, paths: frozenset[str]) -> bool:
        return True


@dataclass(frozen=True)
class _Columns:
    """Values of a record that is a struct."""

    fields: StructType

    def value(self, record: Column, path: str, kind: str) -> Column:
        return record.getField(path.removeprefix("$.")).try_cast(kind)

    def items(self, record: Column, top: str) -> Column:
        return record.getField(top)

    def has(self, paths: frozenset[str]) -> bool:
        """Whether a record can have these paths at all."""
        return all(self._found(self.fields, path.split(".")) for path in paths)

    def _found(self, kind: DataType, names: list[str]) -> bool:
        if not names:
            return True
        name, array = names[0].removesuffix("[]"), names[0].endswith("[]")
        if not isinstance(kind, StructType) or name not in kind.names:
            return False
        inner = kind[name].dataType
        return self._found(inner.elementType if array and isinstance(inner, ArrayType) else inner, names[1:])


def _reader(records: DataFrame) -> _Json | _Columns:
    kind = records.schema["payload"].dataType
    return _Columns(kind) if isinstance(kind, StructType) else _Json()


def _text(read: _Json | _Columns, record: Column, path: str) -> Column:
    return F.coalesce(read.value(record, path, "string"), F.lit(""))


def _turns(read: _Json | _Columns, record: Column, m: Mapping) -> Column:
    def turn(i: Column, role: Column, text: Column) -> Column:
        return F.struct(i.cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))

    if m.one_turn:
        at, role, text = m.one_turn
        made = F.array(turn(read.value(record, at, "bigint"), _text(read, record, role), _text(read, record, text)))
    elif m.items:
        top, role, text = m.items
        made = F.transform(
            read.items(record, top), lambda x, i: turn(i, _role(_text(read, x, f"$.{role}"), m.roles), _text(read, x, f"$.{text}"))
        )
    else:
        parts = []
        for i, (role, paths) in enumerate(m.turns):
            filled = F.filter(F.array(*(_text(read, record, p) for p in paths)), lambda x: x != "")
            parts.append(turn(F.lit(i), F.lit(role), F.array_join(filled, "\n\n")))
        made = F.array(*parts)
    return made.cast(TURN_TYPE)


def _recorded(records: DataFrame) -> DataFrame:
    kind = records.schema["payload"].dataType
    record = F.col("payload") if isinstance(kind, StructType) else F.try_parse_json("payload")
    return records.select("record_id", "payload", record.alias("record"), fingerprint(F.col("payload"), kind).alias("print"))


def _print_of(m: Mapping) -> Column:
    return F.xxhash64(F.lit(_shape(m.paths)))


def turns_of(records: DataFrame, layouts: tuple[Mapping, ...] = LAYOUTS, strict: bool = True) -> DataFrame:
    """Canonical turns (record_id, turn, place, role, text) of records (record_id, payload: JSON text or a struct).

    strict: a record that no mapping knows raises an error; otherwise it has no turns.
    """
    chosen = F.raise_error(F.lit("no mapping knows a record's layout; unmapped() lists such records")).cast(TURN_TYPE) if strict else F.lit(None).cast(TURN_TYPE)
    read = _reader(records)
    for m in (m for m in reversed(layouts) if read.has(m.paths)):
        chosen = F.when(F.col("print") == _print_of(m), _turns(read, F.col("record"), m)).otherwise(chosen)
    return _recorded(records).select("record_id", F.posexplode(chosen).alias("place", "t")).select("record_id", "place", "t.*")


def _role(role: Column, names: tuple[tuple[str, str], ...]) -> Column:
    for old, new in names:
        role = F.when(role == old, F.lit(new)).otherwise(role)
    return role


def unmapped(records: DataFrame, layouts: tuple[Mapping, ...] = LAYOUTS) -> DataFrame:
    """Records that no mapping knows, with their shape."""
    known = F.col("print").isin(*(_print_of(m) for m in layouts)) if layouts else F.lit(False)
    return _recorded(records).where(~F.coalesce(known, F.lit(False))).select("record_id", "payload", shape(F.col("payload"), records.schema["payload"].dataType).alias("shape"))


def escaped(text: Column, pairs: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def unescaped(text: Column, pairs: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    """Doubled backslashes are cut out first: between them every backslash begins one escape."""

    def part(x: Column) -> Column:
        for old, new in reversed(pairs):
            x = F.replace(x, F.lit(new), F.lit(old))
        return x

    return F.array_join(F.transform(F.split(text, re.escape("\\\\"), -1), part), "\\")


def formatted(turns: DataFrame) -> DataFrame:
    """Per conversation: record_id, formatted, loss: array of (start, end) in code points of ``formatted``."""
    order = ["turn", "place", "role", "text"]
    up_to = Window.partitionBy("record_id").orderBy(*order)
    head = F.concat(F.lit(HEAD), escaped(F.col("role"), ROLE_ESCAPES), F.lit(": "))
    one = turns.select(
        "record_id", F.row_number().over(up_to).alias("nth"), head.alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("learn")
    )
    length = F.length("head") + F.length("body") + len(END) + 1
    before = Window.partitionBy("record_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = one.withColumn("start", F.coalesce(F.sum(length).over(before), F.lit(0)) + F.length("head"))
    whole = placed.groupBy("record_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "nth",
                    F.concat("head", "body", F.lit(END + "\n")).alias("said"),
                    "learn",
                    "start",
                    (F.col("start") + F.length("body")).alias("end"),
                )
            )
        ).alias("all")
    )
    return whole.select(
        "record_id",
        F.array_join(F.transform("all", lambda x: x["said"]), "").alias("formatted"),
        F.transform(F.filter("all", lambda x: x["learn"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("loss"),
    )


def parsed(text: Column) -> Column:
    """Turns (role, text) read from a formatted conversation."""
    parts = F.filter(F.split(text, re.escape(END + "\n"), -1), lambda x, i: x != "")

    def turn(x: Column) -> Column:
        # An escaped role has no colon, so the first one ends it.
        cut = F.instr(x, ":")
        role = F.substr(x, F.lit(len(HEAD) + 1), cut - len(HEAD) - 1)
        return F.struct(
            unescaped(role, ROLE_ESCAPES).alias("role"), unescaped(F.substr(x, cut + 2, F.lit(2**31 - 1))).alias("text")
        )

    return F.transform(parts, turn)


def read_back(conversations: DataFrame) -> DataFrame:
    """Digests of what the formatted texts and their loss masks hold when they are read again."""
    learnt = F.transform("loss", lambda s: unescaped(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    read = conversations.select(
        "record_id", F.length("formatted").cast("long").alias("formatted_chars"), parsed(F.col("formatted")).alias("turns"), F.array_join(learnt, "").alias("learnt")
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "record_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        "formatted_chars",
    )
