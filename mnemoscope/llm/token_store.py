"""Token ids in a content-addressed store of chunks, recipes and Merkle manifests.

Writing: each document's ids (with an end id) are cut where a rolling hash of the
last ids allows it, so equal passages give equal chunks. A chunk is named by the
SHA-256 of its bytes and stored once; a task sends each chunk it meets at most
once, so even a chunk of a third of all documents is one row per task. A recipe
lists a document's chunks; recipes are files in ascending order of identifiers,
and each file's manifest holds the Merkle root of its documents' roots.

Reading: every chunk is hashed again, and each chunk's checksum is shifted by the
length of what follows it in the document. The sum (exclusive or) of the shifted
checksums is the checksum of the document, so chunks need not move to be checked.
Recipes must hash to their roots, roots to the roots of their files' manifests, and
these to the root of the store; a recipe that is missing, out of place or altered
raises an error, and so does a chunk.

Layout below a store's path: ``objects/kind=chunk`` (name, n, body: little-endian
ids of ``width`` bytes), ``recipes/kind=recipe`` (file, nth, doc_id, start in the
file, n, chunks: 32 bytes of name and 4 of length each, root),
``recipes/kind=manifest`` (file, documents, ids, root) and ``manifest``, one row
(documents, ids, root) for the whole store.

Defined results: an id that ``width`` bytes can't hold raises an error; null and empty texts have the end id alone; repeated rows and
null identifiers (first in order) are documents like any other; an empty table
gives an empty store; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch
from .textvec import mix, pieces
from .tokens import encoder

#: Least, usual and most ids of a chunk, and ids that the rolling hash sees.
LEAST, USUAL, MOST, SEEN = 64, 256, 1024, 16
#: Code points that are encoded at once: the more there are, the fewer look-ups of the same words.
TEXT = 1 << 20
#: Names that a task remembers having sent.
SENT = 500_000
NAME = 32

OBJECTS = "kind string, name binary, doc_id long, n int, body binary"
RECIPES = "kind string, file int, nth long, doc_id long, start long, n long, chunks binary, root binary"


def cuts(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each document ids[bounds[i]:bounds[i + 1]]."""
    rolling = np.zeros(len(ids), np.uint64)
    each = mix(ids.astype(np.uint64) + np.uint64(1))
    for i in range(min(SEEN, len(ids))):
        rolling[i:] += each[: len(ids) - i] << np.uint64(i)
    wanted = np.flatnonzero((mix(rolling) & np.uint64(USUAL - 1)) == 0) + 1
    out, k = [], 0
    wanted = [*wanted.tolist(), len(ids) + MOST]
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = []
        while end - start > LEAST:
            while wanted[k] < start + LEAST:
                k += 1
            cut = min(wanted[k], start + MOST)
            if cut >= end:
                break
            own.append(cut)
            start = cut
        own.append(end)
        out.append(own)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of SHA-256; an odd last node goes up as it is."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(level[i] + level[i + 1]).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


def _encode(path: str, end_id: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(ids_of: list, texts: list[str], sent: set[bytes]) -> pa.RecordBatch:
        docs = [np.append(x, np.uint32(end_id)) for x in encoder(path).encode(texts)]
        ids = np.concatenate(docs)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in docs])])
        if int(ids.max()) >> 8 * width:
            raise ValueError(f"id {ids.max()} doesn't fit into {width} bytes")
        packed = ids.astype(f"<u{width}")
        out: dict[str, list] = {"kind": [], "name": [], "doc_id": [], "n": [], "body": []}

        def add(*values) -> None:
            for column, value in zip(out.values(), values, strict=True):
                column.append(value)

        for doc_id, start, ends in zip(ids_of, bounds[:-1].tolist(), cuts(ids, bounds), strict=True):
            first, recipe, names = start, [], []
            for end in ends:
                body = packed[start:end].tobytes()
                name = hashlib.sha256(body).digest()
                if name not in sent:
                    if len(sent) >= SENT:
                        sent.clear()
                    sent.add(name)
                    add("chunk", name, None, end - start, body)
                names.append(name)
                recipe.append(name + (end - start).to_bytes(4, "little"))
                start = end
            add("document", merkle(names), doc_id, start - first, b"".join(recipe))
        return pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(out.values(), (pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=list(out)
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in pieces(texts, TEXT):
                yield rows(ids_of[a:b], texts[a:b], sent)

    return run


class Tree:
    """Merkle root of documents' roots that come one by one: full subtrees by height, closed at the end."""

    def __init__(self):
        self.documents, self.ids, self.peaks = 0, 0, []

    def add(self, roots: list[bytes], sizes: np.ndarray) -> None:
        self.documents, self.ids = self.documents + len(roots), self.ids + int(sizes.sum())
        for root in roots:
            node = (0, root)
            while self.peaks and self.peaks[-1][0] == node[0]:
                node = (node[0] + 1, hashlib.sha256(self.peaks.pop()[1] + node[1]).digest())
            self.peaks.append(node)

    def root(self) -> bytes:
        root, *rest = (x for _, x in reversed(self.peaks))
        for left in rest:
            root = hashlib.sha256(left + root).digest()
        return root


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes of one sorted file, with starts in it, then its manifest."""
    file, tree = TaskContext.get().partitionId(), Tree()
    names = ["kind", "file", "nth", "doc_id", "start", "n", "chunks", "root"]
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    for batch in batches:
        sizes = np.array(batch.column("n").to_numpy(zero_copy_only=False), np.int64)
        starts = tree.ids + np.cumsum(sizes) - sizes
        count = len(sizes)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(["recipe"] * count, types[0]),
                pa.array(np.full(count, file), types[1]),
                pa.array(tree.documents + np.arange(count), types[2]),
                batch.column("doc_id"),
                pa.array(starts, types[4]),
                pa.array(sizes, types[5]),
                batch.column("body"),
                batch.column("name"),
            ],
            names=names,
        )
        tree.add(batch.column("name").to_pylist(), sizes)
    if tree.documents:
        last = ("manifest", file, tree.documents, None, 0, tree.ids, None, tree.root())
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(last, types, strict=True)], names=names)


def _manifests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, documents, ids, root) of recipes (file, nth, start, n, root), sorted by file and nth."""
    trees: dict[int, Tree] = {}

    def closed() -> pa.RecordBatch:
        (file, tree), = trees.items()
        trees.clear()
        row = zip((file, tree.documents, tree.ids, tree.root()), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in row], names=["file", "documents", "ids", "root"])

    for batch in batches:
        files, nth, start, n = (batch.column(c).to_numpy() for c in ("file", "nth", "start", "n"))
        cut = np.flatnonzero(np.diff(files)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(files)], strict=True):
            if a == b:
                continue
            file = int(files[a])
            if trees and file not in trees:
                yield closed()
            tree = trees.setdefault(file, Tree())
            sizes = n[a:b].astype(np.int64)
            if (nth[a:b] != tree.documents + np.arange(b - a)).any() or (start[a:b] != tree.ids + np.cumsum(sizes) - sizes).any():
                raise ValueError(f"recipes of file {file} are missing or out of place")
            tree.add(batch.column("root").slice(a, b - a).to_pylist(), sizes)
    if trees:
        yield closed()


def _store_root(manifests: DataFrame) -> DataFrame:
    """One row (documents, ids, root) over the files' manifests, one row a file."""
    roots = F.array_sort(F.collect_list(F.struct("file", F.hex("root").alias("root"))))
    return manifests.agg(
        F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"),
        F.coalesce(F.sum("ids"), F.lit(0)).alias("ids"),
        F.sha2(F.array_join(F.transform(roots, lambda x: x["root"]), ""), 256).alias("root"),
    )


def _stored_manifests(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.schema(RECIPES).parquet(f"{path}/recipes").where(F.col("kind") == "manifest")
    return read.select("file", F.col("nth").alias("documents"), F.col("n").alias("ids"), "root")


def write_store(
    docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, width: int = 2
) -> None:
    """Write the ids of all texts as a store. width: bytes of an id (2 for up to 65,536 ids)."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = source.mapInArrow(_encode(tokenizer_path, end_id, width), OBJECTS)
    # Chunks meet by name; documents are spread by identifier.
    dealt = made.withColumn("_to", F.when(F.col("kind") == "chunk", F.xxhash64("name")).otherwise(F.xxhash64("doc_id", "name")))
    same = Window.partitionBy("_to", "kind", "name").orderBy("n")
    once = dealt.withColumn("_nth", F.row_number().over(same)).where((F.col("kind") == "document") | (F.col("_nth") == 1))
    once.drop("_to", "_nth").write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/objects")
    listed = docs.sparkSession.read.schema(OBJECTS).parquet(f"{path}/objects").where(F.col("kind") == "document")
    ordered = listed.select("doc_id", "name", "n", "body").repartitionByRange("doc_id", "name").sortWithinPartitions("doc_id", "name")
    ordered.mapInArrow(_recipes, RECIPES).write.partitionBy("kind").parquet(f"{path}/recipes")
    _store_root(_stored_manifests(docs.sparkSession, path)).write.parquet(f"{path}/manifest")


# The checksum's polynomial, reflected.
POLYNOMIAL = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the checksum's."""
    out, b = np.zeros(len(a), np.uint32), b.copy()
    one = np.uint32(1)
    for i in range(32):
        out ^= b * ((a >> np.uint32(31 - i)) & one)
        b = (b >> one) ^ (POLYNOMIAL * (b & one))
    return out


def shifted(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Checksums as they count when ``after`` bytes follow."""
    out = crc.astype(np.uint32)
    # x**8 modulo the polynomial, whose coefficients run from the highest bit.
    power, after = np.array([1 << 23], np.uint32), after.astype(np.int64)
    while after.any():
        odd = np.flatnonzero(after & 1)
        out[odd] = _times(out[odd], np.repeat(power, len(odd)))
        power, after = _times(power, power), after >> 1
    return out


def _checked(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, crcs, sizes = batch.column("name").to_pylist(), [], []
            for name, body in zip(names, batch.column("body").to_pylist(), strict=True):
                if hashlib.sha256(body).digest() != name:
                    raise ValueError(f"chunk {name.hex()} doesn't hold what its name says")
                ids = np.frombuffer(body, f"<u{width}").astype("<u4")
                crcs.append(zlib.crc32(ids.tobytes()))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int32())], names=["name", "crc", "n"])

    return run


def _shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = shifted(batch.column("crc").to_numpy(), 4 * batch.column("after").to_numpy())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "nth", "n")), pa.array(crc.astype(np.int64))], names=["file", "nth", "n", "crc"])


def recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with each document's start among all ids; raises where recipes, manifests and the store's root differ."""
    stored = _stored_manifests(spark, path)
    if [tuple(r) for r in _store_root(stored).collect()] != [tuple(r) for r in spark.read.parquet(f"{path}/manifest").collect()]:
        raise ValueError("the files' manifests don't make the root of the store")
    own = spark.read.schema(RECIPES).parquet(f"{path}/recipes").where(F.col("kind") == "recipe")
    ordered = own.select("file", "nth", "start", "n", "root").repartition("file").sortWithinPartitions("file", "nth")
    made = ordered.mapInArrow(_manifests, "file int, documents long, ids long, root binary")
    both = made.join(stored.select("file", *(F.col(c).alias(f"_{c}") for c in ("documents", "ids", "root"))), "file", "full")
    same = F.lit(True)
    for c in ("documents", "ids", "root"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    checked = F.when(same, F.col("ids")).otherwise(F.raise_error(F.lit("a file's recipes don't make its manifest")).cast("long"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    # One row a file, so this window is as small as the list of files; the file's own size is checked with it.
    files = both.select("file", checked.alias("ids")).select("file", (F.coalesce(F.sum("ids").over(before), F.lit(0)) + F.col("ids")).alias("upto"), "ids")
    own = own.join(files, "file")
    return own.withColumn("start", F.col("start") + F.col("upto") - F.col("ids")).drop("upto", "ids", "kind")


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk of a recipe that hashes to its root: file, nth, name, n and after, the ids behind it in the document."""
    kind = np.dtype([("name", f"V{NAME}"), ("n", "<u4")])
    for batch in batches:
        parts = [np.frombuffer(x, kind) for x in batch.column("chunks").to_pylist()]
        counts = [len(x) for x in parts]
        for x, root in zip(batch.column("chunks").to_pylist(), batch.column("root").to_pylist(), strict=True):
            if merkle([x[i : i + NAME] for i in range(0, len(x), NAME + 4)]) != root:
                raise ValueError("a recipe's chunks don't make its root")
        every = np.concatenate(parts) if parts else np.zeros(0, kind)
        n = every["n"].astype(np.int64)
        ends = np.concatenate([np.cumsum(x["n"].astype(np.int64)) for x in parts]) if parts else n
        total = np.array([int(x["n"].sum()) for x in parts], np.int64)
        names = pa.FixedSizeBinaryArray.from_buffers(pa.binary(NAME), len(every), [None, pa.py_buffer(np.ascontiguousarray(every["name"]).tobytes())])
        place = np.repeat(np.arange(len(parts)), counts)
        yield pa.RecordBatch.from_arrays(
            [batch.column("file").take(pa.array(place)), batch.column("nth").take(pa.array(place)), names.cast(pa.binary()), pa.array(n), pa.array(np.repeat(total, counts) - ends)],
            names=["file", "nth", "name", "n", "after"],
        )


def read_store(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, from the files; raises where they don't agree."""
    chunks = spark.read.schema(OBJECTS).parquet(f"{path}/objects").where(F.col("kind") == "chunk")
    held = chunks.select("name", "body").mapInArrow(_checked(width), "name binary, crc long, held int")
    made = recipes(spark, path)
    used = made.select("file", "nth", "chunks", "root").mapInArrow(_references, "file int, nth long, name binary, n long, after long")
    parts = used.join(held, "name").where(F.col("n") == F.col("held")).select("file", "nth", "n", "crc", "after")
    sums = (
        parts.mapInArrow(_shift, "file int, nth long, n long, crc long")
        .groupBy("file", "nth")
        .agg(F.bit_xor("crc").alias("crc"), F.sum("n").alias("found"))
    )
    whole = F.when(F.col("found") == F.col("n"), F.col("crc")).otherwise(F.raise_error(F.lit("a document's chunks are missing")).cast("long"))
    return made.join(sums, ["file", "nth"], "left").select("doc_id", "start", F.col("n").alias("n_tokens"), whole.alias("ids_crc32"))


def tokens_stored(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Write a store of ``docs`` and read it back."""
    path = path or scratch(docs.sparkSession, "store")
    write_store(docs, path, tokenizer_path)
    return read_store(docs.sparkSession, path)
