"""Exact top-k search with vector-approximation files.

Vectors are turned into integers, floor(1024 x) for each component, and stored twice: whole, and
as approximations, in which each component of a vector is the number of its cell, one of 2**BITS
intervals of the component's range within the vector's block. A search has two phases. The first
scans approximations only: a cell's middle and half width give a lower and an upper bound of every
inner product, and a vector whose upper bound is below the kth best lower bound is dropped, within
a task and then over all. The second reads the whole vectors of the rest by row, in order of their
bounds, until the kth best score is certain to be at least every bound that is left.

Approximations and queries meet in a grid: each cell of it has some blocks of approximations and
some queries, both of bounded size, so that no key holds all of either side. A task returns for
each of its queries the vectors that can still be among the k best of what it has seen.

Defined results: vectors that are null, or hold a null or a non-finite component, take no part;
vectors meet those of equal length only (empty ones, too: their score is 0); ties go to the
smaller id, and rows that repeat an id are all ranked; query rows that repeat an id are one query,
a row's score being listed once for each different vector of the query; null ids take no part;
fewer candidates than k give as many rows; an empty table gives an empty one; other columns are
ignored. Scores beyond 64 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import drop_table, record, runs, write_table

#: Factor of components; bits of a cell's side; vectors of a block; blocks, and queries, of a cell of the grid; bytes of whole vectors that wait for their block to fill; a query's candidates that one part of it reads.
SCALE, BITS, BLOCK, BLOCKS, QUERIES, WAIT, PART = 1024, 8, 4096, 16, 1024, 32 << 20, 128


def integers(vector: Column) -> Column:
    """floor(1024 x) of each component; null where the vector takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(v * SCALE).cast("long")))


def cells(v: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Approximation of a block: the cell of each component, and each component's least value and width of a cell."""
    low = v.min(0)
    step = np.maximum((v.max(0) - low + (1 << bits)) // (1 << bits), 1)
    return ((v - low) // step).astype(np.uint8), low, step


_BLOCK = pa.schema([("dim", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("low", pa.binary()), ("step", pa.binary()), ("cells", pa.binary())])
_BLOCK_SQL = "dim int, rows binary, ids binary, low binary, step binary, cells binary"


def _approximate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of up to BLOCK vectors of one length as approximations, from rows (row, id, v)."""
    held: dict[int, list[tuple]] = {}
    size = 0

    def out(dim: int) -> pa.RecordBatch:
        nonlocal size
        members = held.pop(dim)
        size -= 8 * (dim + 2) * len(members)
        v = np.array([m[2] for m in members], np.int64).reshape(len(members), dim)
        cell, low, step = cells(v)
        rows, ids = (np.array([m[i] for m in members], np.int64).tobytes() for i in (0, 1))
        return record(_BLOCK, [dim], [rows], [ids], [low.tobytes()], [step.tobytes()], [cell.tobytes()])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            dim = len(row[2])
            held.setdefault(dim, []).append(row)
            size += 8 * (dim + 2)
            if len(held[dim]) >= BLOCK:
                yield out(dim)
            while size > WAIT:  # vectors of many lengths: the largest block goes as it is
                yield out(max(held, key=lambda d: (d + 2) * len(held[d])))
    for dim in [*held]:
        yield out(dim)


def bounds(q: np.ndarray, cell: np.ndarray, low: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of queries with a block's vectors: (queries, vectors)."""
    largest = np.maximum(np.abs(low.astype(np.float64)), np.abs(low.astype(np.float64) + step * float(1 << BITS)))
    if float(np.abs(q.astype(np.float64)).max(initial=0)) * float(largest.max(initial=0)) * max(q.shape[1], 1) >= 2**63:
        raise OverflowError("inner products don't fit 64 bits")
    f, half = q.astype(np.float64), (step - 1) / 2
    middle = (f * step) @ cell.T.astype(np.float64) + (f @ (low + half))[:, None]
    slack = (np.abs(f) @ half + 1e-9 * (1 + np.abs(f) @ largest))[:, None]  # half a cell, and rounding
    return middle - slack, middle + slack


_KEPT = pa.schema([("query_id", pa.int64()), ("q_row", pa.int64()), ("row", pa.int64()), ("lower", pa.float64()), ("upper", pa.float64())])
_KEPT_SQL = "query_id long, q_row long, row long, lower double, upper double"


def kth(lower: np.ndarray, k: int) -> float:
    """The kth largest; minus infinity if there are fewer."""
    return float(np.partition(lower, len(lower) - k)[len(lower) - k]) if len(lower) >= k else -np.inf


def _scan(k: int):
    """For each query the vectors that can be among the k best of a cell of the grid, from its rows in order: queries, then blocks of approximations."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        now, ids, q, kept = None, [], None, []
        for (*cell, side), members in runs(rows, 4):
            if cell != now:
                yield from _found(ids, kept)
                now, ids, q, kept = cell, [], None, []
            if side < 0:
                ids = [m[:2] for m in members]
                q = np.array([m[2] for m in members], np.int64).reshape(len(ids), cell[0])
                kept = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0)) for _ in ids]
            elif q is not None:
                for block in members:
                    _keep(ids, q, kept, block[3:], k)
        yield from _found(ids, kept)

    return run


def _keep(ids: list[tuple], q: np.ndarray, kept: list[tuple], block: tuple, k: int) -> None:
    """Add to what is kept for each query the vectors of a block that can be among its k best, and drop what no longer can."""
    rows, own, low, step = (np.frombuffer(x, np.int64) for x in block[:4])
    least, most = bounds(q, np.frombuffer(block[4], np.uint8).reshape(len(rows), q.shape[1]), low, step)
    for i, (query_id, _) in enumerate(ids):
        r, lo, up = kept[i]
        some = np.flatnonzero((most[i] >= kth(lo, k)) & (own != query_id))
        if len(some):
            r, lo, up = np.append(r, rows[some]), np.append(lo, least[i, some]), np.append(up, most[i, some])
            stay = up >= kth(lo, k)
            kept[i] = r[stay], lo[stay], up[stay]


def _found(ids: list, kept: list) -> Iterator[pa.RecordBatch]:
    for (own, q_row), (r, lo, up) in zip(ids, kept, strict=True):
        if len(r):
            yield record(_KEPT, [own] * len(r), [q_row] * len(r), r, lo, up)


def _exact(k: int):
    """(query_id, vec_id, score) of each query's best, from rows (query_id, part, upper, q, id, v) by falling upper bounds: whole vectors are used until the kth result of the part is certain."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, top, done, out = (None, None), [], False, []
        for batch in batches:
            for query_id, part, upper, q, id_, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (query_id, part) != now:
                    out += [(now[0], i, -s) for s, i in top]
                    now, top, done = (query_id, part), [], False
                if not done:
                    done = len(top) >= k and upper < -top[k - 1][0]
                if not done:
                    top = sorted([*top, (-sum(a * b for a, b in zip(q, v, strict=True)), id_)])[:k]
            if len(out) >= 4096:
                yield record(schema, *zip(*out, strict=True))
                out = []
        out += [(now[0], i, -s) for s, i in top]
        if out:
            yield record(schema, *zip(*out, strict=True))

    return run


def candidates(vectors: DataFrame, approximations: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, q_row, row, upper): the pairs whose upper bound is at least the query's kth best lower bound, from approximations and queries (row, id, v)."""
    n, m = vectors.count(), asked.count()
    down, across = (max(1, -(-rows // size)) for rows, size in ((n, BLOCK * BLOCKS), (m, QUERIES // 2)))
    every = lambda most, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))).alias(name)
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    q = asked.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(across)).alias("across"), every(down, "down"), F.lit(-1).cast("long").alias("side"), "id", "row", "v", *none("binary", "rows", "ids", "low", "step", "cells"))
    at = F.pmod(F.xxhash64("rows"), F.lit(down)).alias("down")
    b = approximations.select("dim", at, F.xxhash64("rows").bitwiseAND((1 << 62) - 1).alias("side"), every(across, "across"), "rows", "ids", "low", "step", "cells")
    b = b.select("dim", "across", "down", "side", *none("long", "id", "row"), *none("array<long>", "v"), "rows", "ids", "low", "step", "cells")
    grid = q.unionByName(b).repartition("dim", "across", "down").sortWithinPartitions("dim", "across", "down", "side")
    kept = write_table(grid.mapInArrow(_scan(k), _KEPT_SQL), "bounds")
    best = Window.partitionBy("query_id").orderBy(F.desc("lower"))
    floor = kept.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).groupBy(F.col("query_id").alias("_q")).agg(F.min("lower").alias("floor"), F.count("*").alias("_n"))
    out = write_table(kept.join(floor, F.col("query_id") == F.col("_q")).where((F.col("upper") >= F.col("floor")) | (F.col("_n") < k)).select("query_id", "q_row", "row", "upper"), "candidates")
    drop_table(kept)
    return out


def top_k(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``queries`` marks, the k best of all rows with another id."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col)).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where("id is not null and v is not null")
    whole = write_table(v.withColumn("row", F.monotonically_increasing_id()), "vectors")
    # of equal vectors no more than k and the query itself can be among the best: the smallest ids
    same = Window.partitionBy("h", "v").orderBy("id", "row")
    ranked = whole.withColumn("h", F.xxhash64("v")).withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k + 1)
    approximations = write_table(ranked.select("row", "id", "v").mapInArrow(_approximate, _BLOCK_SQL), "approximations")
    asked = write_table(whole.where("asks").groupBy("id", "v").agg(F.min("row").alias("row")).select("row", "id", "v"), "queries")
    few = candidates(whole, approximations, asked, k)
    sizes = few.groupBy(F.col("query_id").alias("_q")).agg(F.ceil(F.count("*") / PART).alias("parts"))  # a query with many near ties is read in parts
    rest = few.join(sizes, F.col("query_id") == F.col("_q")).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    met = rest.join(whole.select("row", "id", "v"), "row").join(asked.select(F.col("row").alias("q_row"), F.col("v").alias("q")), "q_row")
    met = met.repartition("query_id", "part").sortWithinPartitions("query_id", "part", F.desc("upper"), "id")
    found = write_table(met.select("query_id", "part", "upper", "q", "id", "v").mapInArrow(_exact(k), "query_id long, vec_id long, score long"), "found")
    for used in (whole, approximations, asked, few):
        drop_table(used)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
