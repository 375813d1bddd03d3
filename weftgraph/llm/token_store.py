"""Token ids in a content-addressed store.

Rolling hashes over a document's ids cut it into chunks at places that depend on the content
alone; a chunk is named by the hash of its ids and stored once. A document is a recipe: the
names of its chunks, in ascending order of document id, with its start in the whole stream. A
manifest holds a Merkle root for each run of recipes and one for all of them.

    <store>/objects   kind 0, chunks: name, n_ids, payload (16-bit ids, or 32-bit ids if any needs them; the files are compressed)
                      kind 1, recipes as they were cut
    <store>/recipes   part, pos, doc_id, start, n_tokens, name (the hash of the next column and the id), names
    <store>/manifest  part, docs, tokens, root; part -1 is the whole store

Defined results: null and empty texts have the end id alone; equal rows are documents of their
own, in an order set by id, then content; null ids come first; an empty table gives an empty
store; other columns are ignored; a chunk or recipe that doesn't match its name raises an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.bpe import WordEncoder, encoder, rolling
from weftgraph.llm.common import drop_table, new_path, record, slices, small_batches, texts_of, write_table

#: Ids in a chunk: least, mean beyond that, most; bytes of a name.
LEAST, MASK, MOST, NAME = 64, 0x1FF, 4096, 16
_ROW = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())])
_ROW_SQL = "kind int, key binary, doc_id long, n long, payload binary"


def name_of(ids: bytes) -> bytes:
    return blake2b(ids, digest_size=NAME).digest()


def packed(ids: np.ndarray) -> bytes:
    narrow = not len(ids) or ids.max() < 1 << 16
    return (b"\x02" if narrow else b"\x04") + ids.astype("<u2" if narrow else "<u4").tobytes()


def unpacked(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload[1:], "<u2" if payload[:1] == b"\x02" else "<u4").astype("<u4")


def bounds(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of documents that lie end to end in ``ids``."""
    mixed = (ids * np.uint32(0x9E3779B1)) ^ (ids * np.uint32(0x85EBCA6B) >> np.uint32(13))
    marks = (np.flatnonzero((rolling(mixed, 4) >> np.uint32(7) & np.uint32(MASK)) == 0) + 1).tolist()
    out, k, at = [], 0, 0
    for end in ends.tolist():
        own = []
        while at < end:
            while k < len(marks) and marks[k] < at + LEAST:
                k += 1
            at = min(marks[k] if k < len(marks) else end, at + MOST, end)
            own.append(at)
        out.append(own)
    return out


def _encode(words: WordEncoder, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids, end to end, and where each text's ids end, the end id included."""
    ids, ends = words.encode(texts)
    return np.insert(ids, ends, end_id).astype("<u4"), ends + np.arange(1, len(ends) + 1)


def _cut_task(path: str, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = encoder(path, shown=False), set()
        for part in slices(batches, "text", 4 << 20):
            ids, ends = _encode(words, texts_of(part), end_id)
            rows: list[tuple] = []
            start = 0
            for doc_id, end, cuts in zip(part.column(0).to_pylist(), ends.tolist(), bounds(ids, ends), strict=True):
                names = []
                for a, b in zip([start, *cuts], cuts, strict=False):
                    name = name_of(ids[a:b].tobytes())
                    names.append(name)
                    if name not in seen:  # a task sends a chunk once; the store keeps it once
                        seen.add(name)
                        rows.append((0, name, None, b - a, packed(ids[a:b])))
                recipe = b"".join(names)
                rows.append((1, _recipe_name(recipe, doc_id), doc_id, end - start, recipe))
                start = end
            if len(seen) > 1 << 18:
                seen.clear()
            yield record(_ROW, *zip(*rows, strict=True))

    return run


class _Merkle:
    """Root over leaves that come in order, with a node for each level only."""

    def __init__(self):
        self.levels: list[bytes | None] = []

    def add(self, node: bytes) -> None:
        for i, other in enumerate(self.levels):
            if other is None:
                self.levels[i] = node
                return
            self.levels[i], node = None, name_of(b"\x01" + other + node)
        self.levels.append(node)

    def root(self) -> bytes:
        node = b""
        for other in self.levels:
            node = other if other and not node else name_of(b"\x01" + other + node) if other else node
        return node or name_of(b"")


def _recipe_name(names: bytes, doc_id: int | None) -> bytes:
    return name_of(names + str(doc_id).encode())


def _leaf(doc_id: int | None, n: int, names: bytes) -> bytes:
    return name_of(b"\x00" + f"{doc_id}:{n}:".encode() + names)


def _roots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run's Merkle root, from rows (part, doc_id, n_tokens, name, names) in order; each recipe is held against its name."""
    trees: dict[int, list] = {}
    for batch in batches:
        for part, doc_id, n, name, names in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if _recipe_name(names, doc_id) != name:
                raise ValueError(f"the recipe of document {doc_id} doesn't match its name")
            t = trees.setdefault(part, [_Merkle(), 0, 0])
            t[0].add(_leaf(doc_id, n, names))
            t[1], t[2] = t[1] + 1, t[2] + n
    schema = pa.schema([("part", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()), ("root", pa.binary())])
    yield record(schema, [*trees], [t[1] for t in trees.values()], [t[2] for t in trees.values()], [t[0].root() for t in trees.values()])


def _run_roots(recipes: DataFrame) -> DataFrame:
    ordered = recipes.select("part", "doc_id", "n_tokens", "name", "names", "pos").repartition("part").sortWithinPartitions("part", "pos")
    return ordered.drop("pos").mapInArrow(_roots, "part int, docs long, tokens long, root binary")


def _top(runs: list) -> tuple[int, int, bytes]:
    tree = _Merkle()
    for r in sorted(runs, key=lambda r: r["part"]):
        tree.add(bytes(r["root"]))
    return sum(r["docs"] for r in runs), sum(r["tokens"] for r in runs), tree.root()


def write(docs: DataFrame, path: str, end_id: int, store: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode whole texts with the vocabulary file ``path`` and store them; the store's path."""
    spark = docs.sparkSession
    store = store or new_path(spark, "token-store")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    # all rows with a chunk's name meet in one partition, a row for each task that met it, and the first is kept
    cut = rows.mapInArrow(_cut_task(path, end_id), _ROW_SQL).repartition("key")
    once = cut.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("kind"))).where("kind = 1 or _n = 1").drop("_n")
    with small_batches(spark):
        once.write.option("compression", "zstd").partitionBy("kind").parquet(f"{store}/objects")
    staged = _objects(spark, store, 1)
    ordered = staged.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key")
    ordered = write_table(ordered.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos"), "doc_id", F.col("n").alias("n_tokens"), F.col("key").alias("name"), F.col("payload").alias("names")), "recipes")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = ordered.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    offsets = totals.select(F.col("part").alias("_part"), F.coalesce(F.sum("total").over(before(Window.orderBy("part"))), F.lit(0)).alias("offset"))
    start = F.col("offset") + F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("part").orderBy("pos"))), F.lit(0))
    recipes = ordered.join(F.broadcast(offsets), F.col("part") == F.col("_part")).withColumn("start", start)  # a row for each partition
    recipes.select("part", "pos", "doc_id", "start", "n_tokens", "name", "names").write.option("compression", "zstd").parquet(f"{store}/recipes")
    drop_table(ordered)
    runs = _run_roots(spark.read.parquet(f"{store}/recipes")).collect()  # a row for each partition
    docs_n, tokens, root = _top(runs)
    spark.createDataFrame([*[tuple(r) for r in runs], (-1, docs_n, tokens, root)], "part int, docs long, tokens long, root binary").coalesce(1).write.parquet(f"{store}/manifest")
    return store


def verify(spark: SparkSession, store: str) -> None:
    """Recompute the Merkle roots from the recipes; raise if they differ from the manifest's."""
    held = {r["part"]: r for r in spark.read.parquet(f"{store}/manifest").collect()}
    runs = _run_roots(spark.read.parquet(f"{store}/recipes")).collect()
    found = {r["part"]: bytes(r["root"]) for r in runs} | {-1: _top(runs)[2]}
    if found != {k: bytes(r["root"]) for k, r in held.items()}:
        raise ValueError(f"the recipes of {store} don't match its manifest")


def _objects(spark: SparkSession, store: str, kind: int) -> DataFrame:
    return spark.read.schema("key binary, doc_id long, n long, payload binary, kind int").parquet(f"{store}/objects").where(F.col("kind") == kind)


def chunks(spark: SparkSession, store: str) -> DataFrame:
    return _objects(spark, store, 0).select("key", "n", "payload")


def recipes(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema("part int, pos long, doc_id long, start long, n_tokens long, name binary, names binary").parquet(f"{store}/recipes")


def _checked(key: bytes, payload: bytes) -> np.ndarray:
    ids = unpacked(payload)
    if name_of(ids.tobytes()) != key:
        raise ValueError(f"chunk {key.hex()} doesn't match its name")
    return ids


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.binary()), ("n_ids", pa.int64()), ("crc", pa.int64())])
    for batch in batches:
        keys = batch.column(0).to_pylist()
        ids = [_checked(k, p) for k, p in zip(keys, batch.column(1).to_pylist(), strict=True)]
        yield record(schema, keys, [len(x) for x in ids], [zlib.crc32(x.tobytes()) for x in ids])


_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the CRC's, bits reflected."""
    p, b = np.zeros(np.broadcast(a, b).shape, np.uint32), np.broadcast_to(b, np.broadcast(a, b).shape).copy()
    for i in range(31, -1, -1):
        p ^= np.where(a >> np.uint32(i) & np.uint32(1), b, np.uint32(0))
        b = b >> np.uint32(1) ^ np.where(b & np.uint32(1), _POLY, np.uint32(0))
    return p


def joined_crc(crcs: np.ndarray, after: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """CRC-32 of documents from their pieces' CRCs and the bytes that follow each piece in its document."""
    power, base, n = np.full(len(crcs), 1 << 31, np.uint32), np.array([1 << 23], np.uint32), after.astype(np.uint64)  # x^0, x^8
    while n.any():
        power = np.where(n & np.uint64(1), _times(power, base), power)
        base, n = _times(base, base), n >> np.uint64(1)
    return np.bitwise_xor.reduceat(_times(power, crcs.astype(np.uint32)), starts)


def _combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(3)
        ord_, n_ids, crc = (x.to_numpy() for x in lists.flatten().flatten())
        sizes = np.diff(lists.offsets.to_numpy())
        starts = np.cumsum(sizes) - sizes
        order = np.lexsort((ord_, np.repeat(np.arange(len(sizes)), sizes)))
        n_ids, crc = n_ids[order], crc[order]
        if not np.array_equal(np.add.reduceat(n_ids, starts), batch.column(2).to_numpy()):
            raise ValueError("a recipe doesn't add up to its number of ids")
        total = np.cumsum(n_ids * 4)
        after = np.repeat(total[starts + sizes - 1], sizes) - total
        yield record(schema, batch.column(0), batch.column(1), batch.column(2), joined_crc(crc.astype(np.uint32), after, starts).astype(np.int64))


def digests(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids, from the store's files: each chunk is unpacked and held against its name once."""
    sums = chunks(spark, store).select("key", "payload").mapInArrow(_sums, "key binary, n_ids long, crc long")
    ord_ = F.posexplode(F.expr(f"transform(sequence(0, cast(length(names) / {NAME} as int) - 1), i -> substring(names, i * {NAME} + 1, {NAME}))")).alias("ord", "key")
    used = recipes(spark, store).select("doc_id", "start", "n_tokens", ord_)
    by_doc = used.join(sums, "key").groupBy("doc_id", "start", "n_tokens").agg(F.collect_list(F.struct("ord", "n_ids", "crc")).alias("pieces"))
    return by_doc.mapInArrow(_combine, "doc_id long, start long, n_tokens long, ids_crc32 long")


def documents(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, start, ids): every document rebuilt from its recipe."""
    ord_ = F.posexplode(F.expr(f"transform(sequence(0, cast(length(names) / {NAME} as int) - 1), i -> substring(names, i * {NAME} + 1, {NAME}))")).alias("ord", "key")
    used = recipes(spark, store).select("doc_id", "start", ord_)
    by_doc = used.join(chunks(spark, store).select("key", "payload"), "key").groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("ord", "key", "payload"))).alias("pieces"))

    def rebuild(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for batch in batches:
            ids = [np.concatenate([_checked(p["key"], p["payload"]) for p in ps]).astype(np.int32) for ps in batch.column(2).to_pylist()]
            yield record(schema, batch.column(0), batch.column(1), ids)

    return by_doc.mapInArrow(rebuild, "doc_id long, start long, ids array<int>")
