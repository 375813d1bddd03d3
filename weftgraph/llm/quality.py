"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Words and word pairs are hashed to a fixed number of bins. Bins are counted over the whole corpus
and over all trusted documents; a document's score is the mean over its n-grams of
``ln p(bin | trusted) - ln p(bin | raw)``. Documents whose score is below a threshold that is
set from the trusted documents' own scores are rejected. DataFrame functions only; the bins
are a table of fixed size, and ids of trusted documents meet the corpus in a join.

Defined results: a null text has no words and fails the base rule; texts of any length are scored
whole; ties need no order; equal rows give equal results, and each counts; a null id is none of
the trusted; empty tables: no rows, and without trusted documents every score is 0 and the verdict
is the base rule's; other columns are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import bound, drop_table, likely, words_of, write_table

#: Bins of the hashed n-grams; added to each bin's count; weights are held in units of 1/UNIT.
BINS, SMOOTH, UNIT = 1 << 15, 0.5, 10_000
#: A document is kept if its score is at least the mean less so many standard deviations of trusted documents that pass the base rule.
SPREAD = 7.0
_SYMBOLS = "[#*$%&|<>]"


def base_features(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""

    def repeated(ws: Column) -> Column:
        # windows by hash and place, sorted: a window is repeated if it equals a neighbour; then the words that such windows cover
        same = lambda a, b: (a["h"] == b["h"]) & (F.slice(ws, a["i"] + 1, 3) == F.slice(ws, b["i"] + 1, 3))
        windows = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
        tagged = lambda hs: F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        hits = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: F.coalesce(same(x, F.get(s, j - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, j + 1)), F.lit(False))), lambda x: x["i"]))
        covered = lambda p: F.aggregate(F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0), lambda a, x: a + x)
        dense = lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(bound(bound(tagged(hs), hits), covered))
        return F.when(F.size(ws) > 3, bound(windows, dense)).otherwise(0)

    def of(t: Column, ws: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
        return F.struct(
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
            bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        )

    return bound(F.coalesce(text, F.lit("")), lambda t: bound(words_of(t), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), of(t, ws).alias("t"), repeated(ws).cast("long").alias("n_repeat_words"))))


def _failed(at: str = "") -> Column:
    return (F.col(f"{at}n_words") < 50) | (100 * F.col(f"{at}n_repeat_words") > 50 * F.col(f"{at}n_words"))


def bins(text: Column, n: int = BINS) -> Column:
    """The bins of a text's words and word pairs, lower-cased, in order."""
    one = lambda ws: F.transform(ws, lambda w: F.pmod(F.hash(w), F.lit(n)))
    two = lambda ws: F.transform(F.slice(ws, 2, F.greatest(F.size(ws), F.lit(1))), lambda w, i: F.pmod(F.hash(F.get(ws, i), w), F.lit(n)))
    return bound(words_of(F.lower(text)), lambda ws: F.concat(one(ws), two(ws)))


def _counts(texts: DataFrame, text_col: str, n: int) -> dict[int, int]:
    """How often each bin occurs: a table of fixed size."""
    return {r["bin"]: r["count"] for r in texts.select(F.explode(bins(F.col(text_col), n)).alias("bin")).groupBy("bin").count().collect()}


def weights(docs: DataFrame, target: DataFrame, text_col: str, n: int = BINS) -> list[int]:
    """The log ratio of each bin in units of 1/UNIT: a table of fixed size."""
    raw, good = _counts(docs, text_col, n), _counts(target, text_col, n)
    raw_n, good_n = sum(raw.values()), sum(good.values())
    share = lambda c, total: math.log((c + SMOOTH) / (total + SMOOTH * n))
    return [round(UNIT * (share(good.get(b, 0), good_n) - share(raw.get(b, 0), raw_n))) if good_n else 0 for b in range(n)]


def scored(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = BINS, spread: float = SPREAD) -> DataFrame:
    """Every document with its base features, ``llr`` (0 without n-grams), ``threshold``, ``base_failed`` and ``kept``; keeps all other columns, and replaces those of these names.

    ``trusted``: ids of the target's documents in a column named as ``id_col``.
    """
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "threshold", "base_failed", "kept")
    ids = trusted.select(F.col(id_col).alias("_trusted")).where("_trusted is not null").distinct()
    # one plan at every size: texts are dealt by id, of documents that may be trusted
    own = likely(docs.select(id_col, text_col), [F.col(id_col).cast("string")], ids.select(F.col("_trusted").cast("string").alias("_t")), ["_t"])
    target = write_table(own.hint("merge").join(ids, F.col(id_col) == F.col("_trusted")).select(text_col), "trusted")
    w = F.split(F.lit(",".join(map(str, weights(docs, target, text_col, n)))), ",").cast("array<int>")
    mean = lambda bs: F.aggregate(bs, F.lit(0).cast("long"), lambda a, b: a + F.get(w, b)) / (UNIT * F.greatest(F.size(bs), F.lit(1)))
    llr = bound(bins(F.col(text_col), n), mean)
    own = target.withColumn("_b", base_features(F.col(text_col))).where(~_failed("_b.")).select(llr.alias("llr"))
    level = own.agg(F.coalesce(F.avg("llr") - spread * F.stddev_pop("llr"), F.lit(-1e9))).first()[0]
    drop_table(target)
    out = docs.withColumn("_b", base_features(F.col(text_col))).withColumn("llr", llr).withColumn("threshold", F.lit(round(level, 6)))
    out = out.select(*docs.columns, "_b.n_words", "_b.t.word_chars", "_b.t.n_symbols", "_b.t.n_dup_lines", "_b.n_repeat_words", "llr", "threshold")
    out = out.withColumn("base_failed", _failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.col("threshold")))
