"""Shared helpers: tables in the cluster's shared folder, token rules and Arrow batching."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.session import drop_path, drop_table, new_path

__all__ = ["ascii_lower", "bound", "bounded", "drop_path", "drop_table", "fold_of", "likely", "new_path", "record", "runs", "slices", "small_batches", "table", "texts_of", "words_of", "write_table"]

#: White space that separates words: space and U+0009 to U+000D. Python's ``bytes.split()`` cuts at the same bytes.
SPACE = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Bytes of an Arrow batch while an operator writes a table: each task holds a batch on either side.
BATCH = 4 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with BATCH as its limit of an Arrow batch unless it has been given one. The queries and the pipeline's stages do this, whose results are read after they return; operators leave the session as it is."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH))
    return spark


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH bytes for what is run within; afterwards the session's own limit holds again."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key)
    if 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(own) <= BATCH:
        yield
        return
    spark.conf.set(key, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def write_table(df: DataFrame, name: str, path: str | None = None, small: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and survives lost executors. small: in no more files than the cluster has cores."""
    path = path or new_path(df.sparkSession, name)
    if small:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, 1))
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of a filter.
FILTER = 1 << 20


def likely(rows: DataFrame, own: list[Column], keys: DataFrame, names: list[str]) -> DataFrame:
    """The rows whose key (``own``) may be among ``keys`` (``names``), and few others: a table of FILTER bits, whatever the number of keys, keeps texts that a join would drop out of its shuffle."""
    at = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(FILTER))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), (h % 64).cast("int"))
    h = at([F.col(n) for n in names])
    words = {r["w"]: r["b"] for r in keys.select(h.alias("h")).groupBy((F.col("h") / 64).cast("int").alias("w")).agg(F.bit_or(bit(F.col("h"))).alias("b")).collect()}
    table = F.split(F.lit(",".join(str(words.get(i, 0)) for i in range(FILTER // 64))), ",").cast("array<bigint>")
    mine = at(own)
    return rows.where(F.get(table, (mine / 64).cast("int")).bitwiseAND(bit(mine)) != 0)


def words_of(text: Column) -> Column:
    """Words of a text as an array; null text: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, whatever the optimizer inlines."""
    return F.transform(F.array(value), body)[0]


def release() -> None:
    """Give freed memory back: workers are kept for later tasks, and with them what their allocators hold."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes in each part (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and (total + size > limit or i - start >= rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start, n - start)
    release()


def runs(rows: Iterable[tuple], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rests) of rows that follow each other and agree in their first ``width`` columns: only one such run is held."""
    now, held = None, []
    for row in rows:
        if row[:width] != now:
            if held:
                yield now, held
            now, held = row[:width], []
        held.append(row[width:])
    if held:
        yield now, held


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """Texts as UTF-8 bytes; null: empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the queries."""
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")
