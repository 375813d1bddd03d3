"""The ten programs, as functions from tables or paths to tables. A command line is in ``__main__``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import ngrams, sketches
from weftgraph.functions.hashing import seeded, signature_bucket
from weftgraph.functions.similarity import SIMILARITIES, text_edit_similarity, token_edit_similarity
from weftgraph.operators import clustering, evaluation, ged, graph, mining, pairs
from weftgraph.operators.numbering import numbered
from weftgraph.session import cut
from weftgraph.sources import gml, listing, sinks

FEATURES = ("minhash", "cosine", "jaccard", "inst", "lshcosine", "new_jaccard")


def feature(kind: str, mode: str = "opcode", n: int = 2, bits: int = 8, functions: int = 3, planes: int = 1024, seed: int = 0) -> Column:
    """Features of a function's ``instructions`` by kind: what to extract for each vertex."""
    tokens = F.transform("instructions", lambda i: i[mode])
    grams = ngrams.token_ngrams(tokens, n, ngrams.SKETCH if kind == "minhash" else ngrams.HASHED)
    hash_ = seeded(seed)
    if kind == "minhash":
        return sketches.minhash_tokens(grams, sketches.minhash_parameters(functions, seed), hash_=hash_)
    if kind == "cosine":
        return ngrams.hashed_frequency(grams, bits, hash_=hash_)
    if kind == "jaccard":
        return gml.words_of(ngrams.hashed_set(grams, bits, hash_), max(1, (1 << bits) // 64))
    if kind == "inst":
        return F.col("instructions")
    if kind == "lshcosine":
        return sketches.hyperplane_words(sketches.planes(1 << bits, planes, seed))(ngrams.hashed_frequency(grams, bits, hash_=hash_))
    raise ValueError(f"no such feature: {kind}")


CODEC = {"minhash": "long", "cosine": "double", "jaccard": "bits", "inst": "instructions", "lshcosine": "long", "new_jaccard": "double"}


def extract_call_graphs(lines: DataFrame, kind: str = "minhash", mode: str = "opcode", n: int = 2, include_db: bool = False, keep_instructions: bool = False, vocabulary: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """E1: vertices and edges of call graphs from listing lines."""
    fns = cut(listing.functions(lines, include_db), "functions")  # vertices and edges read it several times
    if kind != "new_jaccard":
        return graph.call_graph(fns, feature(kind, mode, n, **options), keep_instructions)
    grams = fns.select("binary", "fn_id", F.explode(ngrams.token_ngrams(F.transform("instructions", lambda i: i[mode]), n, ngrams.VOCABULARY)).alias("ngram"))
    vocab = vocabulary if vocabulary is not None else ngram_vocabulary(lines, n, mode, include_db)
    size = vocab.count()
    counts = ngrams.vocabulary_counts(grams, ["binary", "fn_id"], vocab).groupBy("binary", "fn_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", F.col("n").cast("double")))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(max(size - 1, 0))), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    full = fns.join(counts, ["binary", "fn_id"], "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<int,double>")))
    return graph.call_graph(full, dense, keep_instructions)


def graph_vectors(vertices: DataFrame, edges: DataFrame, bits: int = 8, algorithm: str = "minhash", prefix: int | None = None, total: int = 1024, width: int = 16, weights: bool = False, kinds: tuple[str, ...] = ("vertex", "edge")) -> DataFrame:
    """E2: bucket frequencies (and TF-IDF weights) of graphs whose features are signatures."""
    features = F.col("features") if algorithm == "minhash" else sketches.bands(F.col("features"), total, width)
    b = graph.bucketed(vertices, signature_bucket(features, bits, prefix), bits)
    out = graph.graph_vectors(b, edges, kinds)
    return graph.tf_idf(out) if weights else out


def vectors_arff(vectors: DataFrame, labels: DataFrame | None, value: str = "freq") -> tuple[list[str], DataFrame]:
    """E2's sink: header and data lines."""
    named = vectors.withColumn("entry", F.concat_ws(":", "kind", "bucket")).select("graph", "entry", value)
    return sinks.arff(named, "graph", "entry", value, numbered(named.select("entry").distinct(), "entry"), labels)


#: The nominal classes of byte n-gram files.
BYTE_CLASSES = [str(i) for i in range(1, 10)]


def bytes_arff(counts: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """E8's sink: header and data lines, with the classes 1 to 9."""
    return sinks.arff(counts, "binary", "ngram", "n", numbered(counts.select("ngram").distinct(), "ngram"), labels, BYTE_CLASSES)


def sequences_arff(indicators: DataFrame, labels: DataFrame | None, with_id: bool = True) -> tuple[DataFrame, DataFrame]:
    """E7's sink: header and data lines, ids in quotes."""
    return sinks.arff(indicators, "binary", "entry", "value", numbered(indicators.select("entry").distinct(), "entry"), labels, with_id=with_id, quoted=True)


def _python_similarity(kind: str):
    def run(a, b) -> float:
        if kind == "minhash":
            return sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b), 1)
        x, y = np.asarray(a, float), np.asarray(b, float)
        if kind == "cosine":
            scale = np.linalg.norm(x) * np.linalg.norm(y)
            return float(x @ y / scale) if scale else 0.0
        top = np.maximum(x, y).sum()
        return float(np.minimum(x, y).sum() / top) if top else 0.0

    return run


def all_pair_similarity(vertices: DataFrame, edges: DataFrame, kind: str = "minhash", threshold: float | None = None, seed: int = 0, **search) -> DataFrame:
    """E3: (graph1, graph2, d) of all pairs; with a threshold, similar Internal vertices are matched and taken out first."""
    similarity = _python_similarity(kind)
    if threshold is None:
        return ged.all_pairs(ged.packed(vertices, edges), similarity, seed, **search)
    names = vertices.select("graph").distinct()
    all_ = names.select(F.col("graph").alias("graph1")).join(names.select(F.col("graph").alias("graph2")), F.col("graph1") < F.col("graph2"))
    _, left = ged.reduced(vertices, edges, all_, SIMILARITIES[kind], threshold)
    x = all_
    # a pair carries its graphs' packed edges, of which those at vertices that are left count: edges aren't joined for each pair
    packed = cut(ged.packed(vertices, edges).select("graph", "es"), "edges")
    for i in (1, 2):
        own = left.where(F.col("side") == i).select(F.col(f"graph{i}").alias("graph"), "graph1", "graph2", "id")
        v = vertices.join(own, ["graph", "id"]).groupBy("graph1", "graph2").agg(ged.vertex_list().alias(f"vs{i}"))
        x = x.join(v, ["graph1", "graph2"], "left").join(packed.select(F.col("graph").alias(f"graph{i}"), F.col("es").alias(f"es{i}")), f"graph{i}")
        x = x.withColumns({f"vs{i}": F.coalesce(f"vs{i}", F.array().cast(v.schema[f"vs{i}"].dataType)), f"es{i}": F.when(F.col(f"vs{i}").isNotNull(), F.col(f"es{i}"))})
    return ged.distances(x.repartition(4 * x.sparkSession.sparkContext.defaultParallelism, "graph1", "graph2"), similarity, seed, **search)


def pair_similarity(vertices: DataFrame, edges: DataFrame, g1: str, g2: str, kind: str = "minhash", seed: int = 0, **search) -> DataFrame:
    """E4: the same for one pair."""
    two = vertices.where(F.col("graph").isin(g1, g2)), edges.where(F.col("graph").isin(g1, g2))
    return ged.one_pair(ged.packed(*two), g1, g2, _python_similarity(kind), seed, **search)


def cluster_by_distance(distances: DataFrame, labels: DataFrame, k: int, algorithm: str = "kmedoids", seed: int = 0, most: int = 5000, medoids: dict[int, str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """E5: predictions (id, actual, predicted), their accuracy and contingency, from a distance table (id1, id2, d) and labels (id, class). Where the clusters' ``medoids`` are known, the table needs no pairs without one."""
    both = pairs.symmetric(distances, "id1", "id2", "d").dropDuplicates(["id", "other"])
    ids = both.select("id").distinct()
    if medoids is not None:
        own = distances.sparkSession.createDataFrame([(m, m, 0.0) for m in medoids.values()], "id string, other string, d double")
        a = clustering.placed(both.unionByName(own), medoids)
    elif algorithm == "kmedoids":
        a, _ = clustering.kmedoids(both, ids, k, seed=seed, most=most)
    else:
        a, _ = clustering.agglomerative(ids, k, "complete", distances.select(F.col("id1").alias("a"), F.col("id2").alias("b"), "d"))
    named = a.select("id", "cluster").join(labels.select("id", F.col("class").alias("label")), "id", "left")
    p = evaluation.by_cluster(named)
    return p, evaluation.accuracy(p), evaluation.contingency(p)


def naive_knn(distances: DataFrame, labels: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """E6: the same by the k nearest neighbours."""
    both = pairs.symmetric(distances, "id1", "id2", "d").dropDuplicates(["id", "other"])
    p = evaluation.knn(both, labels.select("id", F.col("class").alias("label")), k)
    return p, evaluation.accuracy(p), evaluation.contingency(p)


def frequent_sequences(lines: DataFrame, mode: str = "asm", support: float = 0.07, least: int = 0, most: int = 3, gap: int | None = None, include_db: bool = False) -> DataFrame:
    """E7: (binary, sequence, support) mined in each listing; listings without instructions are skipped."""
    i = listing.instructions(lines, include_db).select("binary", "line_no", F.col(mode).alias("item"))
    return mining.spam(mining.positions(i, "binary", "line_no", "item"), "binary", "item", support, least, most, gap)


def sequence_indicators(found: DataFrame) -> DataFrame:
    """E7's features in long form: (binary, entry, value 1); the corpus vocabulary is the distinct entries."""
    return found.select("binary", mining.sequence_name(F.col("sequence")).alias("entry"), F.lit(1).alias("value")).distinct()


def byte_ngrams(files: DataFrame, n: int = 2) -> DataFrame:
    """E8: (binary, ngram, n) from (binary, content)."""
    return files.select("binary", F.explode(ngrams.byte_ngrams(F.col("content"), n)).alias("ngram")).groupBy("binary", "ngram").agg(F.count("*").alias("n"))


def ngram_vocabulary(lines: DataFrame, n: int = 2, mode: str = "asm", include_db: bool = False) -> DataFrame:
    """E9: (ngram, idx) over whole listings, so n-grams go across functions."""
    i = listing.instructions(lines, include_db).select("binary", "line_no", F.col(mode).alias("token"))
    return ngrams.vocabulary(ngrams.ngram_rows(i, ["binary"], "line_no", "token", n, ngrams.VOCABULARY), ["binary", "line_no"])


def edit_versus_sketch(vertices: DataFrame, labels: DataFrame, kind: str = "jaccard", most: int | None = 450, mode: str = "asm", **how) -> DataFrame:
    """E10: (class1, class2, edit, other): exact edit similarity and a sketch's, for Internal functions of different graphs, without graphs of more than ``most`` functions unless that is None. ``how``: options of :func:`pairs.edit_and_set_pairs`, for sets."""
    inner = vertices.where(F.col("type") == graph.INTERNAL)
    if most is not None:
        inner = inner.join(graph.oversize(vertices, most), "graph")
    inner = inner.join(labels.select(F.col("id").alias("graph"), "class"), "graph")
    inner = inner.select("graph", "class", "features", F.transform("instructions", lambda i: i[mode]).alias("tokens"))
    if kind == "jaccard":
        return pairs.edit_and_set_pairs(inner, **how)
    texts = pairs.token_texts(inner, "tokens")
    x = pairs.ordered_pairs(inner if texts is None else texts, "graph", ["class", "features", "tokens", *([] if texts is None else ["text"])])
    tokens = F.col("tokens_a"), F.col("tokens_b")
    edit = token_edit_similarity(*tokens) if texts is None else text_edit_similarity(F.col("text_a"), F.col("text_b"), *tokens)
    return x.select(F.col("class_a").alias("class1"), F.col("class_b").alias("class2"), edit.alias("edit"), SIMILARITIES[kind](F.col("features_a"), F.col("features_b")).alias("other"))


def scan(spark: SparkSession, path: str, **options) -> DataFrame:
    return listing.lines(spark, path, **options)
