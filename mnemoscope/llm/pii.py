"""Personal data in texts: patterns propose spans, checksums confirm, context scores.

Each kind's pattern proposes leftmost, non-overlapping spans; a proposal that
fails its check (Luhn, mod-97, number ranges, digit counts) is dropped and not
tried again in another length. Words within CONTEXT_CHARS on either side of a span,
as far as the next match of its kind, adjust its score: the kind's own words raise
it, words of part and serial numbers lower it. The base kinds stay whatever their
score is; kinds that this module adds must reach LEAST_SCORE, so an account number
(mod-97 confirms it) goes if it is called a serial number, and a social security
number or a run of hexadecimal digits (no checksum confirms it) stays only if it is
called one, or a token, key or password. Keys of known prefixes stay by their form.

A text is cut by the pattern, so that the lengths of matches and of the gaps
between them sum to positions in code points. The sums are window sums over the
(short) rows of proposals, never over texts.

Defined results: a null text equals the empty text and has no spans; repeated
rows each have their own; an empty table gives an empty result; other columns of
the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, written

CONTEXT_CHARS = 48
LEAST_SCORE = 0.5
#: What the words around a span add to its score or take from it.
RAISED, LOWERED = 0.25, 0.25
#: Words that speak of numbers of other kinds.
OTHER_NUMBERS = r"serial|\bparts?\b|\bsku\b|model|version|\bbuild\b|\bisbn\b|tracking|checksum|article no"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where a digit string passes the Luhn checksum."""
    places = F.split(F.reverse(digits), "")

    def part(x: Column, i: Column) -> Column:
        twice = x.cast("int") * 2
        return F.when(i % 2 == 0, x.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(places, part), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """True where an international account number leaves 1 modulo 97."""
    turned = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))

    def step(rest: Column, x: Column) -> Column:
        code = F.ascii(x)
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _card(match: Column) -> Column:
    n = F.length(_digits(match))
    return F.when((n >= 14) & (n <= 19), luhn(_digits(match))).otherwise(F.lit(False))


def _iban(match: Column) -> Column:
    plain = F.replace(match, F.lit(" "), F.lit(""))
    return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(F.lit(False))


def _mixed(match: Column) -> Column:
    """Digits and letters both."""
    return F.rlike(match, F.lit("[0-9]")) & F.rlike(match, F.lit("[A-Za-z]"))


def _ssn(match: Column) -> Column:
    """Area, group and serial of numbers that are given out."""
    return ~F.rlike(match, F.lit("^(?:000|666|9)|-00-|-0000$"))


_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    name: str
    #: Possessive where the base pattern's greedy run can't be followed by its own characters: the same spans, without deep recursion.
    pattern: str
    check: Callable[[Column], Column]
    #: What a text must hold before the pattern is tried.
    hint: Callable[[Column], Column]
    words: str
    score: float
    base: bool = True


LOCAL = "[A-Za-z0-9._%+-]"
SECRETS = r"token|secret|passw(?:or)?d|api[_ -]?key|private key|credential|authorization|bearer"
KINDS = (
    Kind(
        "email",
        rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda m: F.lit(True),
        lambda t: F.contains(t, F.lit("@")),
        r"e-?mail|mail|contact|correo|courriel|kontakt",
        0.8,
    ),
    Kind(
        "ip",
        r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda m: F.rlike(m, F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")),
        lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]")),
        r"\bip\b|address|host|server|serveur|adresse",
        0.6,
    ),
    Kind(
        "card",
        r"[0-9]++(?:[ -][0-9]++)++|[0-9]{2,}+",
        _card,
        lambda t: F.rlike(t, F.lit("[0-9][ -]?[0-9]")),
        r"card|visa|master|amex|carte|karte|tarjeta|pay",
        0.7,
    ),
    Kind(
        "phone",
        r"\+[0-9][ ().0-9-]+[0-9]",
        lambda m: F.length(_digits(m)).between(10, 15),
        lambda t: F.contains(t, F.lit("+")),
        r"phone|tel|call|mobile|fax|telefon|tel[eé]fono",
        0.6,
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
        _iban,
        lambda t: F.rlike(t, F.lit("[A-Z]{2}[0-9]{2}")),
        r"iban|account|bank|konto|compte|cuenta",
        0.6,
        base=False,
    ),
    Kind(
        "ssn",
        r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
        _ssn,
        lambda t: F.rlike(t, F.lit("[0-9]{3}-[0-9]{2}-[0-9]{4}")),
        r"\bssn\b|social security|sozialversicherung|sécurité sociale|seguridad social",
        0.3,
        base=False,
    ),
    Kind(
        "key",
        r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_live_[A-Za-z0-9]{16,}+)(?![A-Za-z0-9])",
        lambda m: F.lit(True),
        lambda t: F.contains(t, F.lit("AKIA")) | F.rlike(t, F.lit("gh[pousr]_|xox[abprs]-|sk_live_")),
        SECRETS,
        0.6,
        base=False,
    ),
    Kind(
        "secret",
        r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,128}+(?![0-9A-Za-z])",
        _mixed,
        lambda t: F.rlike(t, F.lit("[0-9A-Fa-f]{32}")),
        SECRETS,
        0.3,
        base=False,
    ),
)


def _proposals(text: Column, number: int, kind: Kind) -> Column:
    """Array of (kind, place, gap before, length, confirmed, score)."""
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    reach = F.lit(CONTEXT_CHARS)

    def row(hit: Column, i: Column, before: Column, behind: Column) -> Column:
        near = F.lower(F.concat_ws("\n", F.right(before, reach), F.left(behind, reach)))
        score = (
            F.lit(kind.score)
            + F.when(F.rlike(near, F.lit(kind.words)), F.lit(RAISED)).otherwise(F.lit(0.0))
            - F.when(F.rlike(near, F.lit(OTHER_NUMBERS)), F.lit(LOWERED)).otherwise(F.lit(0.0))
        )
        return F.struct(
            F.lit(number).alias("kind"),
            i.alias("place"),
            F.length(before).alias("gap"),
            F.length(hit).alias("len"),
            kind.check(hit).alias("ok"),
            F.round(score, 2).alias("score"),
        )

    found = let(
        hits.alias("hits"), gaps.alias("gaps"),
        lambda x: F.transform(x.hits, lambda hit, i: row(hit, i, F.element_at(x.gaps, i + 1), F.element_at(x.gaps, i + 2))),
    )
    return F.when(kind.hint(text), found).otherwise(F.array().cast("array<struct<kind:int,place:int,gap:int,len:int,ok:boolean,score:double>>"))


def proposals(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A written table (row, id, found): every row's proposals of every kind, and its row number."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.concat(*(_proposals(F.col("_text"), i, k) for i, k in enumerate(KINDS)))
    return written(
        docs.select(F.col(id_col).alias("id"), text.alias("_text")).select(
            F.monotonically_increasing_id().alias("row"), "id", found.alias("found")
        ),
        "pii",
    )


def spans(listed: DataFrame) -> DataFrame:
    """Confirmed spans (row, id, kind number, start, end, score) of a table of proposals."""
    each = listed.select("row", "id", F.explode("found").alias("f")).select("row", "id", "f.*")
    up_to = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    ends = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(up_to))
    added = [i for i, k in enumerate(KINDS) if not k.base]
    return ends.where(F.col("ok") & (~F.col("kind").isin(added) | (F.col("score") >= LEAST_SCORE))).select(
        "row", "id", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "score"
    )


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, found: array of (start, kind, end, score) in order of start, then kind."""
    listed = proposals(docs, id_col, text_col)
    by_row = spans(listed).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "score"))).alias("found")
    )
    out = listed.select("row", "id").join(by_row, "row", "left")
    nothing = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,score:double>>")
    return out.select(F.col("id").alias(id_col), F.coalesce("found", nothing).alias("found"))
