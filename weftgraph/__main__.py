"""Command line: ``python -m weftgraph PROGRAM --option value ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from weftgraph.plans import programs
from weftgraph.session import get_session
from weftgraph.sources import delimited, gml, sinks


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser("weftgraph")
    p.add_argument("program", choices=["graphs", "vectors", "distances", "pair", "cluster", "knn", "sequences", "bytes", "vocabulary"])
    for name, kind, default in (("in", str, None), ("out", str, None), ("labels", str, None), ("feat", str, "minhash"), ("mode", str, "opcode"), ("n", int, 2), ("bits", int, 8), ("k", int, 5), ("seed", int, 0), ("max-files", int, None), ("support", float, 0.07), ("threshold", float, None), ("first", str, None), ("second", str, None), ("algorithm", str, "kmedoids")):
        p.add_argument(f"--{name}", type=kind, default=default, dest=name.replace("-", "_") if name != "in" else "source")
    p.add_argument("--recursive", action="store_true")
    p.add_argument("--tfidf", action="store_true")
    o, _ = p.parse_known_args(argv)  # unknown options are ignored
    spark = spark or get_session()

    def graphs():
        rows = gml.read(spark, o.source, programs.CODEC[o.feat])
        v = rows.where("kind = 'vertex'").select("graph", "id", rows.label.alias("name"), "type", gml.decoded(rows.features, programs.CODEC[o.feat]).alias("features"))
        return v, rows.where("kind = 'edge'").select("graph", "src", "dst")

    if o.program in ("graphs", "sequences", "vocabulary"):
        lines = programs.scan(spark, o.source, recursive=o.recursive, limit=o.max_files)
    if o.program == "graphs":
        v, e = programs.extract_call_graphs(lines, o.feat, o.mode, o.n, bits=o.bits, seed=o.seed) if o.feat != "new_jaccard" else programs.extract_call_graphs(lines, o.feat, o.mode, o.n)
        gml.write(gml.documents(v, e, programs.CODEC[o.feat]), o.out)
    elif o.program == "vectors":
        vectors = programs.graph_vectors(*graphs(), o.bits, weights=o.tfidf)
        head, lines = programs.vectors_arff(vectors, delimited.labels(spark, o.labels) if o.labels else None, "weight" if o.tfidf else "freq")
        sinks.write_arff(head, lines, "graph", o.out)
    elif o.program == "distances":
        sinks.write_csv(sinks.distance_csv(programs.all_pair_similarity(*graphs(), o.feat, o.threshold, o.seed)), o.out)
    elif o.program == "pair":
        programs.pair_similarity(*graphs(), o.first, o.second, o.feat, o.seed).show(truncate=False)
    elif o.program in ("cluster", "knn"):
        d, labels = delimited.distances(spark, o.source), delimited.labels(spark, o.labels)
        result = programs.cluster_by_distance(d, labels, o.k, o.algorithm, o.seed) if o.program == "cluster" else programs.naive_knn(d, labels, o.k)
        lines = sinks.report(*result[1:])
        if o.out:
            lines.orderBy("part", "by").select("line").coalesce(1).write.text(o.out)
        else:
            lines.orderBy("part", "by").select("line").show(1000, truncate=False)
    elif o.program == "sequences":
        found = programs.sequence_indicators(programs.frequent_sequences(lines, o.mode, o.support))
        sinks.write_arff(*programs.sequences_arff(found, delimited.labels(spark, o.labels) if o.labels else None), "binary", o.out)
    elif o.program == "bytes":
        counts = programs.byte_ngrams(delimited.raw_bytes(spark, o.source), o.n)
        sinks.write_arff(*programs.bytes_arff(counts, delimited.labels(spark, o.labels) if o.labels else None), "binary", o.out)
    else:
        sinks.write_csv(sinks.vocabulary_csv(programs.ngram_vocabulary(lines, o.n, o.mode)), o.out, header=False)


if __name__ == "__main__":
    main()
