"""N-grams of tokens and bytes, and feature vectors made of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import bound
from weftgraph.functions.hashing import portable_hash
from weftgraph.operators.numbering import numbered

#: Key formats: separator, whether it also ends the key, and whether a single token stays bare.
HASHED, VOCABULARY, SKETCH = (",", True, False), ("-", True, True), ("", False, False)


def token_ngrams(tokens: Column, n: int, style: tuple = HASHED) -> Column:
    """Sliding n-grams of an array of tokens as keys; none if there are fewer tokens than n."""
    sep, ends, bare = style

    def grams(tokens: Column) -> Column:
        one = lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), sep)
        key = (lambda i: F.concat(one(i), F.lit(sep))) if ends and not (bare and n == 1) else one
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), key)
        return F.when(F.size(tokens) >= n, each).otherwise(F.array().cast("array<string>"))

    return bound(tokens, grams)


def ngram_rows(tokens: DataFrame, keys: list[str], order: str, value: str, n: int, style: tuple = HASHED) -> DataFrame:
    """The same from long rows: a window over the next n rows of each key."""
    sep, ends, bare = style
    w = Window.partitionBy(*keys).orderBy(order)
    cols = [F.col(value), *[F.lead(value, i).over(w) for i in range(1, n)]]
    gram = F.concat_ws(sep, *cols) if sep else F.concat(*cols)
    if ends and not (bare and n == 1):
        gram = F.concat(gram, F.lit(sep))
    return tokens.select(*keys, order, gram.alias("ngram"), cols[-1].isNotNull().alias("_full")).where("_full").drop("_full")


def hashed_bins(grams: Column, bits: int, hash_: Callable[[Column], Column] = portable_hash) -> Column:
    """Bin of each n-gram, in order."""
    return F.transform(grams, lambda g: F.abs(hash_(g) % (1 << bits)).cast("int"))


def hashed_set(grams: Column, bits: int, hash_: Callable[[Column], Column] = portable_hash) -> Column:
    """Boolean feature vector as the sorted positions of its set bits."""
    return F.array_sort(F.array_distinct(hashed_bins(grams, bits, hash_)))


def hashed_frequency(grams: Column, bits: int, normalise: bool = False, hash_: Callable[[Column], Column] = portable_hash) -> Column:
    """Dense vector of relative frequencies by bin; unit length if ``normalise``; all zeros without n-grams."""
    counts = lambda bins: F.transform(F.sequence(F.lit(0), F.lit((1 << bits) - 1)), lambda b: F.size(F.filter(bins, lambda x: x == b)).cast("double"))
    power = 2 if normalise else 1
    total = lambda cs: F.aggregate(cs, F.lit(0.0), lambda a, x: a + x**power) ** (1 / power)
    scaled = lambda cs: bound(total(cs), lambda s: F.transform(cs, lambda c: F.when(s > 0, c / F.when(s > 0, s)).otherwise(0.0)))
    return bound(hashed_bins(grams, bits, hash_), lambda bins: bound(counts(bins), scaled))


def frequency_rows(grams: DataFrame, keys: list[str], bits: int, hash_: Callable[[Column], Column] = portable_hash) -> DataFrame:
    """Sparse long form of the same: (keys, bin, n, freq, unit), one hash aggregation and one window."""
    counts = grams.withColumn("bin", F.abs(hash_(F.col("ngram")) % (1 << bits)).cast("int")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    return counts.withColumn("freq", F.col("n") / F.sum("n").over(w)).withColumn("unit", F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(w)))


def vocabulary(grams: DataFrame, order: list[str]) -> DataFrame:
    """(ngram, idx): distinct n-grams numbered from 0 by first appearance in ``order``."""
    first = grams.groupBy("ngram").agg(F.min(F.struct(*order)).alias("first"))
    return numbered(first, "first", "ngram").select("ngram", "idx")


def vocabulary_counts(grams: DataFrame, keys: list[str], vocab: DataFrame, normalise: bool = False) -> DataFrame:
    """(keys, idx, n[, freq]): counts of known n-grams; unknown ones are dropped."""
    counts = grams.groupBy(*keys, "ngram").agg(F.count("*").alias("n")).join(vocab, "ngram").drop("ngram")
    return counts.withColumn("freq", F.col("n") / F.sum("n").over(Window.partitionBy(*keys))) if normalise else counts


def byte_ngrams(content: Column, n: int) -> Column:
    """Byte n-grams of a binary column as lower-case hex, two digits a byte."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(content) - n + 1, F.lit(1))), lambda i: F.lower(F.hex(F.substring(content, i, F.lit(n)))))
    return F.when(F.octet_length(content) >= n, grams).otherwise(F.array().cast("array<string>"))


def printed_bytes(gram: Column) -> Column:
    """A byte n-gram as reports print it: each byte in hex without a leading zero, each followed by a hyphen."""
    parts = F.transform(F.sequence(F.lit(1), F.length(gram), F.lit(2)), lambda i: F.regexp_replace(F.substring(gram, i, F.lit(2)), "^0(.)", "$1"))
    return F.concat(F.array_join(parts, "-"), F.lit("-"))
