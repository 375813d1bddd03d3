"""Graphs as two tables: vertices(graph, id, name, type, features, ...) and edges(graph, src, dst).

A reverse index isn't kept: in-edges are the edges by ``dst``. Edges are a set for each graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.hashing import name_bucket

INTERNAL, EXTERNAL = "Internal", "External"


def add_vertices(labels: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Ids from 0 by order of appearance in each graph."""
    return labels.withColumn("id", (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("int"))


def upsert(vertices: DataFrame, new: DataFrame) -> DataFrame:
    """Vertices with explicit ids: an id that is there already is overwritten."""
    return vertices.join(new, ["graph", "id"], "left_anti").unionByName(new)


def edge_set(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["graph", "src", "dst"])


def remove_vertices(vertices: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the vertices ``gone`` (graph, id) and the edges at them: the induced subgraph of the rest."""
    e = edges
    for end in ("src", "dst"):
        e = e.join(gone.withColumnRenamed("id", end), ["graph", end], "left_anti")
    return vertices.join(gone, ["graph", "id"], "left_anti"), e.select(*edges.columns)


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone, ["graph", "src", "dst"], "left_anti")


def lookup_vertices(vertices: DataFrame, keys: DataFrame) -> DataFrame:
    """For each key (graph, id) its vertex, or nulls."""
    return keys.join(vertices, ["graph", "id"], "left")


def lookup_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(edges.withColumn("found", F.lit(True)), ["graph", "src", "dst"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, id, out_degree, in_degree): one pass over the edges, each seen from both ends."""
    ends = edges.select("graph", F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    counts = ends.groupBy("graph", F.col("x.id").alias("id")).agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))
    return vertices.select("graph", "id").join(counts, ["graph", "id"], "left").na.fill(0)


def sizes(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, v_size, e_size, empty)."""
    v = vertices.groupBy("graph").agg(F.count("*").alias("v_size"))
    e = edges.groupBy("graph").agg(F.count("*").alias("e_size"))
    return v.join(e, "graph", "left").na.fill(0).withColumn("empty", F.col("v_size") == 0)


def neighbours(edges: DataFrame, incoming: bool = False) -> DataFrame:
    """(graph, id, neighbours): adjacent vertices, or those that point here."""
    own, other = ("dst", "src") if incoming else ("src", "dst")
    return edges.groupBy("graph", F.col(own).alias("id")).agg(F.array_sort(F.collect_set(other)).alias("neighbours"))


def edges_of(edges: DataFrame, ids: DataFrame, incoming: bool = False) -> DataFrame:
    end = "dst" if incoming else "src"
    return edges.join(ids.withColumnRenamed("id", end), ["graph", end], "left_semi")


def call_graph(functions: DataFrame, extractor: Column | None = None, keep_instructions: bool = False) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges from functions(binary, fn_id, name, aliases, called[, instructions]).

    A called name resolves to the function that has it as name or alias (the later one wins);
    names that none has become External vertices behind the Internal ones, by first call.
    """
    f = functions.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    # a function's name comes before its aliases, and later functions overwrite earlier ones
    names = f.select("binary", F.col("fn_id"), F.posexplode(F.concat(F.array("name"), "aliases")).alias("at", "called"))
    names = names.groupBy("binary", "called").agg(F.max(F.struct("fn_id", "at"))["fn_id"].alias("callee"))
    calls = f.select("binary", "fn_id", F.posexplode("called").alias("at", "called"))
    resolved = calls.join(names, ["binary", "called"], "left")
    internal_n = f.groupBy("binary").agg(F.count("*").alias("n"))
    first = resolved.where("callee is null").groupBy("binary", "called").agg(F.min(F.struct("fn_id", "at")).alias("first"))
    external = first.join(internal_n, "binary").select("binary", "called", (F.col("n") + F.row_number().over(Window.partitionBy("binary").orderBy("first")) - 1).cast("int").alias("ext"))
    code = F.col("instructions") if keep_instructions else F.lit(None)
    feature = extractor if extractor is not None else F.lit(None).cast("array<bigint>")
    inner = f.select(F.col("binary").alias("graph"), F.col("fn_id").cast("int").alias("id"), "name", F.lit(INTERNAL).alias("type"), feature.alias("features"), *([code.alias("instructions")] if keep_instructions else []))
    outer = external.select(F.col("binary").alias("graph"), F.col("ext").alias("id"), F.col("called").alias("name"), F.lit(EXTERNAL).alias("type"))
    vertices = inner.unionByName(outer, allowMissingColumns=True)
    e = resolved.join(external, ["binary", "called"], "left").select(F.col("binary").alias("graph"), F.col("fn_id").cast("int").alias("src"), F.coalesce("callee", "ext").cast("int").alias("dst"))
    return vertices, e.distinct()


def refeatured(vertices: DataFrame, extractor: Column) -> DataFrame:
    """New features on Internal vertices; External ones stay without."""
    return vertices.withColumn("features", F.when(F.col("type") == INTERNAL, extractor))


def oversize(vertices: DataFrame, most: int = 450) -> DataFrame:
    """Graphs with 1 to ``most`` Internal vertices."""
    n = F.count(F.when(F.col("type") == INTERNAL, 1))
    return vertices.groupBy("graph").agg(n.alias("n")).where(F.col("n").between(1, most)).select("graph")


def bucketed(vertices: DataFrame, bucketiser: Column, bits: int) -> DataFrame:
    """Vertices with a bucket: Internal ones by their features, External ones by name; both share one id space."""
    return vertices.withColumn("bucket", F.when(F.col("type") == EXTERNAL, name_bucket(F.col("name"), bits)).otherwise(bucketiser))


def renamed(vertices: DataFrame) -> DataFrame:
    return vertices.withColumn("name", F.col("bucket").cast("string"))


def graph_vectors(vertices: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("vertex", "edge")) -> DataFrame:
    """(graph, kind, bucket, freq) in long form, from bucketed vertices: counts of vertex buckets and of edge bucket pairs."""
    b = vertices.select("graph", "id", "bucket")
    out = []
    if "vertex" in kinds:
        out.append(b.select("graph", F.lit("vertex").alias("kind"), F.col("bucket").cast("string").alias("bucket")))
    if "edge" in kinds:
        both = edges.join(b.select("graph", F.col("id").alias("src"), F.col("bucket").alias("a")), ["graph", "src"]).join(b.select("graph", F.col("id").alias("dst"), F.col("bucket").alias("b")), ["graph", "dst"])
        out.append(both.select("graph", F.lit("edge").alias("kind"), F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")).alias("bucket")))
    rows = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    return rows.groupBy("graph", "kind", "bucket").agg(F.count("*").alias("freq"))


def tf_idf(vectors: DataFrame, idf: str = "reference") -> DataFrame:
    """Vectors with df and weight. idf 'reference': ln(1 + df) for vertices and ln(N + 1) - ln(1 + df) for edges; 'standard': the latter for both."""
    df = vectors.groupBy("kind", "bucket").agg(F.count_distinct("graph").alias("df"))
    n = vectors.agg(F.count_distinct("graph").alias("n"))
    x = vectors.join(df, ["kind", "bucket"]).crossJoin(F.broadcast(n))  # one row
    usual = F.ln(F.col("n") + 1) - F.ln(1 + F.col("df"))
    weight = usual if idf == "standard" else F.when(F.col("kind") == "vertex", F.ln(1 + F.col("df"))).otherwise(usual)
    tf = F.when(F.col("freq") > 0, 1 + F.ln(F.when(F.col("freq") > 0, F.col("freq")))).otherwise(0.0)
    return x.withColumn("weight", tf * weight).drop("n")
