import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.functions import hashing, ngrams, similarity, sketches

ASM = list("abcdabdab")


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def arr(xs, kind):
    return F.array(*map(F.lit, xs)).cast(f"array<{kind}>")


def test_hashes(spark):
    assert one(spark, hashing.string_hash(F.lit("hello"))) == 99162322
    assert one(spark, hashing.array_hash(arr([1, 2, 3], "bigint"))) == 30817
    assert one(spark, hashing.array_hash(arr([-1, 1 << 40], "bigint"))) == ((31 + 0) * 31 + 256)
    # published test vectors of Murmur3
    assert hashing.murmur3_32(b"", 0) == 0 and hashing.murmur3_32(b"", 1) & 0xFFFFFFFF == 0x514E28B7
    assert hashing.murmur3_32(b"test", 0) & 0xFFFFFFFF == 0xBA6BD213
    assert hashing.murmur3_32(b"Hello, world!", 0x9747B28C) & 0xFFFFFFFF == 0x24884CBA
    assert hashing.murmur3_128(b"", 0) == (0, 0)
    assert one(spark, F.hash(F.lit("abcd"))) == hashing.murmur3_32(b"abcd", 42) == one(spark, hashing.murmur(42)(F.lit("abcd")))
    assert one(spark, hashing.lookup_hash({"a": 7})(F.lit("a"))) == 7


@given(st.text(alphabet=st.characters(max_codepoint=0xD7FF), max_size=12))
@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_string_hash_wraps(spark, s):
    h = 0
    for c in s:
        h = (31 * h + ord(c) + (1 << 31)) % (1 << 32) - (1 << 31)
    assert one(spark, hashing.string_hash(F.lit(s))) == h


def test_ngrams(spark):
    tokens = arr(ASM, "string")
    assert one(spark, ngrams.token_ngrams(tokens, 2))[:2] == ["a,b,", "b,c,"]
    assert one(spark, ngrams.token_ngrams(tokens, 1, ngrams.VOCABULARY))[:2] == ["a", "b"]
    assert one(spark, ngrams.token_ngrams(tokens, 2, ngrams.SKETCH))[0] == "ab"
    assert one(spark, ngrams.token_ngrams(arr(["a"], "string"), 2)) == []
    lookup = hashing.lookup_hash({"a,b,": 0, "b,c,": 1, "c,d,": 2, "d,a,": 3, "b,d,": 4, "b,a,": 5})
    got = one(spark, ngrams.hashed_frequency(ngrams.token_ngrams(tokens, 2), 3, hash_=lookup))
    assert got == pytest.approx([3 / 8, 1 / 8, 1 / 8, 2 / 8, 1 / 8, 0, 0, 0])
    unit = one(spark, ngrams.hashed_frequency(ngrams.token_ngrams(tokens, 2), 3, True, lookup))
    assert unit == pytest.approx([x / 4 for x in (3, 1, 1, 2, 1, 0, 0, 0)])
    assert one(spark, ngrams.hashed_frequency(arr([], "string"), 2)) == [0, 0, 0, 0]
    assert one(spark, ngrams.byte_ngrams(F.lit(bytearray(b"\x00\xffA")), 2)) == ["00ff", "ff41"]
    assert one(spark, ngrams.printed_bytes(F.lit("00ff"))) == "0-ff-"


def test_similarities(spark):
    k = lambda s: arr(list(s), "string")
    assert one(spark, similarity.token_edit_similarity(k("kitten"), k("sitting"))) == pytest.approx(1 - 3 / 7)
    assert one(spark, similarity.token_edit_similarity(k("kitten"), k("k"))) == pytest.approx(1 - 5 / 6)
    assert one(spark, similarity.token_edit_similarity(k(""), k(""))) == 1 and one(spark, similarity.token_edit_similarity(k("ab"), k(""))) == 0
    d = lambda *x: arr(x, "double")
    assert one(spark, similarity.weighted_jaccard(d(1, 3, 1, 2), d(3, 3, 1, 2))) == pytest.approx(7 / 9)
    assert one(spark, similarity.weighted_jaccard(d(3, 3, 4), d(1, 3, 4))) == pytest.approx(0.8)
    assert one(spark, similarity.weighted_jaccard(d(0), d(0))) == 0 and one(spark, similarity.cosine(d(0, 0), d(1, 0))) == 0
    with pytest.raises(Exception, match="length"):
        one(spark, similarity.weighted_jaccard(d(1), d(1, 2)))
    s = lambda *x: arr(x, "int")
    assert [one(spark, similarity.set_jaccard(a, b)) for a, b in ((s(), s()), (s(1), s()), (s(1, 2), s(2, 3)))] == [1, 0, pytest.approx(1 / 3)]
    assert one(spark, similarity.matching("edit", 0.6)(k("kitten"), k("sitting"))) and not one(spark, similarity.matching("edit", 0.6, True)(k("kitten"), k("sitting")))
    assert not one(spark, similarity.matching("jaccard", 0.0)(s(1), s(1))) and one(spark, similarity.matching("weighted", 0.75)(d(3, 3, 4), d(1, 3, 4)))


def test_sketches(spark):
    p = sketches.minhash_parameters(128, 3)
    a, b = set(range(100)), set(range(50, 150))
    sig = lambda x: sketches.minhash(arr(sorted(x), "bigint"), p)
    assert abs(one(spark, sketches.minhash_similarity(sig(a), sig(b))) - 1 / 3) < 0.15
    assert set(one(spark, sketches.minhash(arr([], "bigint"), p))) == {sketches.EMPTY}
    m = sketches.planes(4, 256, 1, 0.0)
    words = sketches.hyperplane_words(m)
    x, y = [0.4, 0.2, 0.1, 56.4], [98.0, 3.2, 0.1, 56.4]
    df = spark.createDataFrame([(x, y)], "x array<double>, y array<double>").select(words("x").alias("a"), words("y").alias("b"))
    exact = 1 - math.acos(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)) / math.pi
    assert abs(df.select(sketches.angle_similarity(F.col("a"), F.col("b"), 256).alias("x")).first()["x"] - exact) < 0.0999
    bands = df.select(sketches.bands(F.col("a"), 256, 16).alias("x")).first()["x"]
    assert bands == [int(w) >> s & 0xFFFF for w in df.first()["a"] for s in (0, 16, 32, 48)]
    with pytest.raises(Exception, match="components"):
        spark.createDataFrame([([1.0],)], "x array<double>").select(words("x")).collect()
    u, v = [0.3, 0.0, 0.0, 0.4, 0.5], [0.3, 0.4, 0.3, 0.5, 0.5]
    r = spark.createDataFrame([(u,), (u,), (v,)], "v array<double>").select(sketches.simhash(16)("v").alias("h")).collect()
    assert r[0].h == r[1].h and (r[0].h ^ r[2].h).bit_count() / 16 <= 0.4
    assert -(1 << 63) <= spark.createDataFrame([(v,)], "v array<double>").select(sketches.simhash(64)("v").alias("h")).first().h < 1 << 63


def test_murmur_of_columns(spark):
    rng = random.Random(2)
    values = ["".join(rng.choices("aé한\U0001f600 z", k=rng.randrange(0, 40))) for _ in range(3000)] + [None, "", "x" * 5000]
    df = spark.createDataFrame([(x,) for x in values], "t string").repartition(3)
    for seed in (0, 77, -5):
        for r in df.select("t", hashing.murmur(seed)(F.col("t")).alias("h")).collect():
            assert r.h == (None if r.t is None else hashing.murmur3_32(r.t.encode(), seed))
