"""Toxicity by a counterfactually regularised classifier.

A logistic model over words and word beginnings that tell labelled classes apart. What is labelled
is a document, as the set of its words; its identity terms are swapped for others of their group,
and the fit penalises the squared change of the score, so that a neutral mention of a group has no
weight of its own. Features and weights come from at most SAMPLE labelled documents, the first by a
hash of the id; every document is scored whole.

Defined results: null and empty texts get the score of no evidence; runs of more than 64 characters
between white space are no words, and have no features; a null id belongs to the labelled part; a
document that is labelled twice is toxic if any label says so, null labels count for nothing; of
features that tell as much, those first by name are taken; rows that repeat a labelled id are
samples of their own; equal rows are scored alike; an empty table gives an empty one, and without
labels of both classes every score is 1 if all labels are toxic, else 0; other columns are ignored
by :func:`scored` and kept by :func:`accepted`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import drop_table, fold_of, record, slices, texts_of, write_table

#: Most labelled documents that the model is fitted to; most features; labelled documents that a feature must be in.
SAMPLE, FEATURES, SUPPORT = 20_000, 4096, 4
#: Penalties of squared weights and of squared score changes under a swap; steps of the fit.
RIDGE, COUNTERFACTUAL, STEPS = 1e-4, 4.0, 300

# Groups of identity terms; a term is swapped for the others of its group.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "arab", "mexican", "chinese"),
    ("immigrants", "refugees", "foreigners", "locals"), ("old", "young"), ("disabled", "blind", "deaf"),
)
_GROUP = {t: [o for o in g if o != t] for g in IDENTITY for t in g}
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
PREFIXES = (4, 5, 6)


def features_of(word: str) -> list[str]:
    """Features of a word: itself, without marks at its ends, and its beginnings."""
    w = _EDGES.sub("", word.lower())
    return [w, *(f"{w[:k]}*" for k in PREFIXES if len(w) > k)] if w and len(w) <= 64 else []


def swaps(words: set[str]) -> list[set[str]]:
    """Texts as sets of words with every identity term swapped: one text for each place in the groups."""
    own = [w for w in words if w in _GROUP]
    if not own:
        return []
    n = max(len(_GROUP[w]) for w in own)
    return [(words - set(own)) | {_GROUP[w][i % len(_GROUP[w])] for w in own} for i in range(n)]


def _plain(text: bytes) -> set[str]:
    return {w for x in set(text.split()) if (w := _EDGES.sub("", x.decode("utf-8", "replace").lower()))}


def _candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, documents) summed over runs of labelled documents."""
    schema = pa.schema([("feature", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())])
    for part in slices(batches, "text", 4 << 20):
        sums: dict[tuple, int] = {}
        for text, toxic in zip(texts_of(part), part.column(1).to_pylist(), strict=True):
            for f in {f for w in _plain(text) for f in features_of(w)}:
                sums[f, toxic] = sums.get((f, toxic), 0) + 1
        if sums:
            yield record(schema, [k[0] for k in sums], [k[1] for k in sums], [*sums.values()])


def _present(index: dict[str, int]):
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("found", pa.list_(pa.int32())), ("gained", pa.list_(pa.list_(pa.int32()))), ("lost", pa.list_(pa.list_(pa.int32())))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = lambda words: {index[f] for w in words for f in features_of(w) if f in index}
        for part in slices(batches, "text", 4 << 20):
            rows = []
            for doc_id, toxic, text in zip(part.column(2).to_pylist(), part.column(1).to_pylist(), texts_of(part), strict=True):
                words = _plain(text)
                own, others = at(words), [at(x) for x in swaps(words)]
                rows.append((doc_id, toxic, sorted(own), [sorted(x - own) for x in others], [sorted(own - x) for x in others]))
            if rows:
                yield record(schema, *zip(*rows, strict=True))

    return run


def fit(found: list[list[int]], labels: list[int], gained: list[list[list[int]]], lost: list[list[list[int]]], n: int, counterfactual: float = COUNTERFACTUAL) -> np.ndarray:
    """Weights, the last one the intercept: mean log-loss plus penalties, by gradient steps with moments. gained, lost: for each document and swap, the features that come and go."""
    y = np.array(labels, np.float64)
    rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
    cols = np.array([c for x in found for c in x], np.int64)
    changes = [(up, down) for ups, downs in zip(gained, lost, strict=True) for up, down in zip(ups, downs, strict=True)]
    d_rows = np.repeat(np.arange(len(changes)), [len(up) + len(down) for up, down in changes]).astype(np.int64)
    d_cols = np.array([c for up, down in changes for c in (*up, *down)], np.int64)
    d_sign = np.array([x for up, down in changes for x in (*[1.0] * len(up), *[-1.0] * len(down))])
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    w[n] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for t in range(1, STEPS + 1):
        z = np.bincount(rows, w[cols], len(y)) + w[n]
        g = balance * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        grad = np.append(np.bincount(cols, g[rows], n), g.sum()) + RIDGE * np.append(w[:n], 0)
        if changes:
            change = np.bincount(d_rows, d_sign * w[d_cols], len(changes))
            grad[:n] += 2 * counterfactual / len(changes) * np.bincount(d_cols, d_sign * change[d_rows], n)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_fold: int | None = 0, counterfactual: float = COUNTERFACTUAL) -> tuple[dict[str, float], float]:
    """Weights by feature, and the intercept. Rows of the held fold are not read."""
    told = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if held_fold is not None:
        told, rows = told.where(fold_of(F.col("_id")) != held_fold), rows.where(fold_of(F.col("doc_id")) != held_fold)
    told = told.where("_id is not null").orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)  # of fixed size, so it can be broadcast and no text is shuffled
    known = write_table(rows.join(F.broadcast(told), F.col("doc_id") == F.col("_id")).select("text", "toxic", "doc_id"), "labelled")
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return {}, 40.0 if bad else -40.0
    sums = known.mapInArrow(_candidates, "feature string, toxic int, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("g"))
    ratio = F.ln((F.col("b") + 0.5) / (bad + 1)) - F.ln((F.col("g") + 0.5) / (good + 1))
    gain = F.abs(ratio) * F.sqrt(F.col("b") + F.col("g"))
    best = sums.where(F.col("b") + F.col("g") >= SUPPORT).orderBy(F.desc(gain), "feature").limit(FEATURES).select("feature").collect()
    names = list(dict.fromkeys([*(r["feature"] for r in best), *_GROUP]))  # identity terms are always there, so that their weights are held down
    index = {f: i for i, f in enumerate(names)}
    sample = known.mapInArrow(_present(index), "doc_id long, toxic int, found array<int>, gained array<array<int>>, lost array<array<int>>").orderBy("doc_id").collect()  # at most SAMPLE documents' places among the features
    drop_table(known)
    w = fit([r["found"] for r in sample], [r["toxic"] for r in sample], [r["gained"] for r in sample], [r["lost"] for r in sample], len(names), counterfactual)
    return {f: float(x) for f, x in zip(names, w[:-1], strict=True) if abs(x) > 1e-6}, float(w[-1])


def _scorer(weights: dict[str, float], intercept: float):
    """Scores of texts; a task remembers the features of the words that it meets, up to a number."""
    seen: dict[bytes, tuple] = {}

    def score(texts: list[bytes]) -> list[float]:
        scores = []
        for text in texts:
            words = set(text.split())
            for w in words.difference(seen):
                seen[w] = tuple(f for f in features_of(w.decode("utf-8", "replace")) if f in weights)
            z = sum(map(weights.__getitem__, set().union(*map(seen.__getitem__, words))), intercept)
            scores.append(float(1 / (1 + np.exp(-max(-40.0, min(40.0, z))))))
            if len(seen) > 100_000:
                seen.clear()
        return scores

    return score


def _score_task(weights: dict[str, float], intercept: float):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(weights, intercept)
        for part in slices(batches, "text", 1 << 20):
            yield record(schema, part.column(0), score(texts_of(part)))

    return run


def scored(docs: DataFrame, model: tuple[dict[str, float], float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if the score is at least 0.5)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_score_task(*model), "doc_id long, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, model: tuple[dict[str, float], float], text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic; the same columns."""
    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(*model)
        for part in slices(batches, text_col, 1 << 20):
            yield part.filter(pa.array([s < 0.5 for s in score(texts_of(part, text_col))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
