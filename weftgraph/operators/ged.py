"""Approximate graph edit distance: costs of a given mapping as joins, and annealing in an Arrow kernel.

A mapping pairs vertices of two graphs; the smaller graph is padded with nulls. Its cost is
vertex / |map| + edge / (|E1| + |E2|) + relabel / |map|, a part being 0 where its divisor is.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weftgraph.operators.graph import EXTERNAL, INTERNAL, remove_vertices
from weftgraph.operators.pairs import greedy_classes

#: Inverse temperature, divisor of the inverse temperature after a round, rounds, and proposals of a round.
BETA, COOLING, ROUNDS, PROPOSALS = 4.0, 0.2, 50, 50


def mapping_cost(mapping: DataFrame, e1: DataFrame, e2: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, vertex_cost, edge_cost, relabel_cost, cost) from mapping(keys, v1, v2, relabel) and edges(keys, src, dst) of both sides."""
    m = mapping.groupBy(*keys).agg(F.count("*").alias("size"), F.sum((F.col("v1").isNull() | F.col("v2").isNull()).cast("long")).alias("vertex_cost"), F.sum(F.coalesce("relabel", F.lit(0.0))).alias("relabel_cost"))
    full = mapping.where("v1 is not null and v2 is not null").select(*keys, "v1", "v2")
    s, d = full.select(*keys, F.col("v1").alias("src"), F.col("v2").alias("s2")), full.select(*keys, F.col("v1").alias("dst"), F.col("v2").alias("d2"))
    image = e1.join(s, [*keys, "src"]).join(d, [*keys, "dst"]).select(*keys, F.col("s2").alias("src"), F.col("d2").alias("dst"))
    kept = image.join(e2, [*keys, "src", "dst"], "left_semi").groupBy(*keys).agg(F.count("*").alias("kept"))
    n1, n2 = (e.groupBy(*keys).agg(F.count("*").alias(n)) for e, n in ((e1, "n1"), (e2, "n2")))
    x = m.join(n1, keys, "left").join(n2, keys, "left").join(kept, keys, "left").na.fill(0, ["n1", "n2", "kept"])
    x = x.withColumn("edge_cost", F.col("n1") + F.col("n2") - 2 * F.col("kept"))
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b.cast("double")), F.lit(0.0))
    return x.select(*keys, "vertex_cost", "edge_cost", "relabel_cost", (part("vertex_cost", F.col("size")) + part("edge_cost", F.col("n1") + F.col("n2")) + part("relabel_cost", F.col("size"))).alias("cost"))


def relabel_cost(type1, name1, type2, name2, similarity):
    """Cost of a pair: External pairs by name, mixed ones 1, Internal ones 1 - similarity, with a null side 0."""
    return (
        F.when(type1.isNull() | type2.isNull(), 0.0)
        .when((type1 == EXTERNAL) & (type2 == EXTERNAL), F.when(name1.eqNullSafe(name2), 0.0).otherwise(1.0))
        .when(type1 != type2, 1.0)
        .otherwise(1 - similarity)
    )


def _places(at: dict, edges: np.ndarray) -> np.ndarray:
    """Places of the ends of those edges (sources and targets, as rows) whose ends both have one."""
    known = np.array(sorted(at), np.int64)
    place = np.array([at[x] for x in sorted(at)], int)
    lo, span = int(known[0]), int(known[-1]) - int(known[0]) + 1
    if span <= 4 * len(known) + edges.size:  # a table by id costs less than searches
        table = np.full(span, -1)
        table[known - lo] = place
        inside = ((edges >= lo) & (edges < lo + span)).all(0)
        found = table[(edges if inside.all() else edges[:, inside]) - lo]
        return found if (found >= 0).all() else found[:, (found >= 0).all(0)]
    found = np.searchsorted(known, edges).clip(max=len(known) - 1)
    return place[found[:, (known[found] == edges).all(0)]]


class State:
    """A mapping under search: a permutation of padded targets, with exact costs of a swap."""

    def __init__(self, v1: list, v2: list, e1: set, e2: set, relabel: Callable, rng: np.random.Generator):
        n = max(len(v1), len(v2))
        self.v1, self.v2 = [*v1, *[None] * (n - len(v1))], [*v2, *[None] * (n - len(v2))]
        self.to = rng.permutation(n)
        self.n, self.relabel = n, relabel
        at1, at2 = {x: i for i, x in enumerate(v1)}, {x: i for i, x in enumerate(v2)}
        self.a, self.b = np.zeros((n, n), bool), np.zeros((n, n), bool)
        for m, at, edges in ((self.a, at1, e1), (self.b, at2, e2)):
            if edges is None or isinstance(edges, bytes):
                edges = unpacked(edges)
            if isinstance(edges, np.ndarray):  # sources and targets, as rows
                for lo in range(0, edges.shape[1] if at else 0, 1 << 20):
                    s, d = _places(at, edges[:, lo : lo + (1 << 20)])
                    m[s, d] = True
                continue
            for s, d in edges:
                if s in at and d in at:
                    m[at[s], at[d]] = True
        self.edges = int(self.a.sum() + self.b.sum())
        self.at, self.bt = (np.ascontiguousarray(m.T) for m in (self.a, self.b))  # columns as rows
        self._known: dict[tuple, float] = {}

    def pair(self, i: int, j: int) -> float:
        if (i, j) not in self._known:
            x, y = self.v1[i], self.v2[j]
            self._known[i, j] = 0.0 if x is None or y is None else self.relabel(x, y)
        return self._known[i, j]

    def edge_cost(self) -> int:
        image = self.b[np.ix_(self.to, self.to)]
        return np.count_nonzero(self.a ^ image)

    def cost(self) -> float:
        padded = sum(x is None for x in self.v1) + sum(x is None for x in self.v2)
        relabel = sum(self.pair(i, int(j)) for i, j in enumerate(self.to))
        return (padded / self.n if self.n else 0.0) + (self.edge_cost() / self.edges if self.edges else 0.0) + (relabel / self.n if self.n else 0.0)

    def _local(self, i: int, j: int) -> tuple[int, float]:
        """Edges not kept in the rows and columns of two places, each once, and their relabelling."""
        rows = [i, j]
        diff = self.a[rows] ^ self.b[self.to[rows]][:, self.to]
        cols = self.at[rows] ^ self.bt[self.to[rows]][:, self.to]
        return np.count_nonzero(diff) + np.count_nonzero(cols) - np.count_nonzero(cols[:, rows]), self.pair(i, int(self.to[i])) + self.pair(j, int(self.to[j]))

    def swap(self, i: int, j: int) -> float:
        """Swap two targets; the change of the cost."""
        e0, r0 = self._local(i, j)
        self.to[i], self.to[j] = self.to[j], self.to[i]
        e1, r1 = self._local(i, j)
        return ((e1 - e0) / self.edges if self.edges else 0.0) + (r1 - r0) / self.n


def anneal(state: State, rng: np.random.Generator, beta: float = BETA, cooling: float = COOLING, rounds: int = ROUNDS, proposals: int = PROPOSALS) -> float:
    """The cost of the last state: worse swaps pass with probability exp(-beta delta), and beta grows after each round."""
    if state.n < 2:
        return state.cost()
    for _ in range(rounds):
        for _ in range(proposals):
            i, j = (int(x) for x in rng.choice(state.n, 2, replace=False))
            delta = state.swap(i, j)
            if delta >= 0 and rng.random() >= math.exp(-min(beta * delta, 700)):
                state.swap(i, j)
        beta /= cooling
    return state.cost()


def vertex_list() -> Column:
    """A group's vertices in order of their ids, as a pair's side holds them."""
    return F.array_sort(F.collect_list(F.struct("id", "type", "name", "features")))


def packed(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, vs, es): one row for each graph; es holds its edges as compressed differences of numbers, null without edges, as a dense graph's edges are many and its pairs carry them."""
    v = vertices.groupBy("graph").agg(vertex_list().alias("vs"))
    name = edges.schema["graph"].dataType.simpleString()

    def some(batches, most=1 << 20):
        """Edges of a task by graph, packed where they are made, so that no single edge is shuffled."""
        held: dict = {}
        for batch in batches:
            of = batch.column(0).dictionary_encode()
            at, ends = of.indices.to_numpy(), np.array([batch.column(1).to_numpy(), batch.column(2).to_numpy()], np.int64)
            for i, g in enumerate(of.dictionary.to_pylist()):
                held.setdefault(g, []).append(ends if len(of.dictionary) == 1 else ends[:, at == i])
            for g in [g for g, x in held.items() if sum(y.shape[1] for y in x) >= most]:
                yield pa.RecordBatch.from_pylist([{"graph": g, "some": _compressed(np.concatenate(held.pop(g), axis=1))}], schema)
        for g, x in held.items():
            yield pa.RecordBatch.from_pylist([{"graph": g, "some": _compressed(np.concatenate(x, axis=1))}], schema)

    def run(batches):
        for pdf in batches:
            ends = [np.concatenate([unpacked(x) for x in parts], axis=1) for parts in pdf.pop("parts")]
            pdf["es"] = [_compressed(x[:, np.lexsort(x[::-1])]) for x in ends]
            yield pdf

    schema = pa.schema([("graph", to_arrow_type(edges.schema["graph"].dataType)), ("some", pa.binary())])
    known = edges.select("graph", "src", "dst").where("graph is not null and src is not null and dst is not null")
    parts = known.mapInArrow(some, f"graph {name}, some binary").groupBy("graph").agg(F.collect_list("some").alias("parts"))
    e = parts.mapInPandas(run, f"graph {name}, es binary")
    return v.join(e, "graph", "left")


def _compressed(edges: np.ndarray) -> bytes:
    """Edges as compressed numbers, each less the one before it, behind a byte that gives a number's width. Sums and differences wrap around alike."""
    width = 4 if np.abs(edges).max(initial=0) < 1 << 31 else 8
    return bytes([width]) + zlib.compress(np.diff(edges.astype(f"<i{width}"), axis=1, prepend=0).astype(f"<i{width}").tobytes(), 1)


def unpacked(es: bytes | None) -> np.ndarray:
    """Sources and targets of edges, as two rows."""
    if es is None:
        return np.zeros((2, 0), np.int64)
    kind = f"<i{es[0]}"
    return np.cumsum(np.frombuffer(zlib.decompress(memoryview(es)[1:]), kind).reshape(2, -1), axis=1, dtype=kind)


def distances(pairs: DataFrame, similarity: Callable, seed: int = 0, **search) -> DataFrame:
    """(graph1, graph2, d) from pairs of :func:`packed` graphs (graph1, vs1, es1, graph2, vs2, es2); ``similarity`` compares two features in Python.

    A pair's random numbers come from its names and the seed, so results don't depend on the partitioning.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for g1, vs1, es1, g2, vs2, es2 in pdf[["graph1", "vs1", "es1", "graph2", "vs2", "es2"]].itertuples(index=False):
                if not len(vs1) and not len(vs2):
                    out.append((g1, g2, 0.0))
                    continue
                info1, info2 = {v["id"]: v for v in vs1}, {v["id"]: v for v in vs2}

                def relabel(x, y, a=info1, b=info2):
                    p, q = a[x], b[y]
                    if p["type"] == EXTERNAL and q["type"] == EXTERNAL:
                        return float(p["name"] != q["name"])
                    return 1.0 if p["type"] != q["type"] else 1 - similarity(p["features"], q["features"])

                rng = np.random.default_rng(int.from_bytes(hashlib.md5(f"{seed}:{g1}:{g2}".encode()).digest()[:8], "little"))
                state = State([*info1], [*info2], es1, es2, relabel, rng)  # one graph's edges are unpacked at a time
                out.append((g1, g2, anneal(state, rng, **search)))
            yield pd.DataFrame(out, columns=["graph1", "graph2", "d"])

    kind = pairs.schema["graph1"].dataType.simpleString()
    return pairs.mapInPandas(run, f"graph1 {kind}, graph2 {kind}, d double")


def all_pairs(graphs: DataFrame, similarity: Callable, seed: int = 0, tasks: int | None = None, **search) -> DataFrame:
    """Distances of all pairs graph1 < graph2, dealt out evenly: the input is small and the work is large."""
    a, b = (graphs.select(F.col("graph").alias(f"graph{i}"), F.col("vs").alias(f"vs{i}"), F.col("es").alias(f"es{i}")) for i in (1, 2))
    pairs = a.join(b, F.col("graph1") < F.col("graph2"))
    n = tasks or 4 * graphs.sparkSession.sparkContext.defaultParallelism
    return distances(pairs.repartition(n, "graph1", "graph2"), similarity, seed, **search)


def one_pair(graphs: DataFrame, g1, g2, similarity: Callable, seed: int = 0, **search) -> DataFrame:
    a, b = (graphs.where(F.col("graph") == g).select(F.col("graph").alias(f"graph{i}"), F.col("vs").alias(f"vs{i}"), F.col("es").alias(f"es{i}")) for i, g in ((1, g1), (2, g2)))
    return distances(a.crossJoin(b), similarity, seed, **search)  # one row each


def reduced(vertices: DataFrame, edges: DataFrame, pairs: DataFrame, similarity, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Greedy matches (graph1, graph2, v1, v2, sim) of Internal vertices at or above the threshold, and what is left of both graphs' vertices: (graph1, graph2, side, id)."""
    # vertices of a graph that have the same features are compared and matched as one class
    inner = vertices.where(F.col("type") == INTERNAL).groupBy("graph", "features").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    a, b = (inner.select(F.col("graph").alias(f"graph{i}"), F.col("ids").alias(f"v{i}"), F.col("features").alias(f"f{i}")) for i in (1, 2))
    cand = pairs.join(a, "graph1").join(b, "graph2").withColumn("sim", similarity(F.col("f1"), F.col("f2"))).where(F.col("sim") >= threshold)
    match = greedy_classes(cand.select("graph1", "graph2", "v1", "v2", "sim"), ["graph1", "graph2"], "v1", "v2", "sim")
    left = []
    for i in (1, 2):
        v = pairs.join(vertices.select(F.col("graph").alias(f"graph{i}"), "id"), f"graph{i}")
        left.append(v.join(match.select("graph1", "graph2", F.col(f"v{i}").alias("id")), ["graph1", "graph2", "id"], "left_anti").select("graph1", "graph2", F.lit(i).alias("side"), "id"))
    return match, left[0].unionByName(left[1])


def without_matched(vertices: DataFrame, edges: DataFrame, matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph's tables without matched vertices (graph, id)."""
    return remove_vertices(vertices, edges, matched)
