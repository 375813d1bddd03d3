"""Graph, mining, clustering, anomaly, evaluation and graph-distance operators."""
