"""Hash functions and bucketisers as column expressions.

ANSI arithmetic raises on overflow, so 32-bit wrapping is done on masked bigints.
A hash strategy is a ``Column -> Column`` callable, and so is a bucketiser.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

_W = 1 << 32
_H = 1 << 31


def _wrap(x: Column) -> Column:
    """The low 32 bits, signed. The bigint mask also takes negative values."""
    return (x + F.lit(_H)).bitwiseAND(F.lit(_W - 1)) - F.lit(_H)


def portable_hash(text: Column) -> Column:
    """Unsigned 32-bit hash that any engine with md5 reproduces: the first 8 hex digits of the MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def seeded(seed: int, base: Callable[[Column], Column] = portable_hash) -> Callable[[Column], Column]:
    """A hash strategy with an explicit seed."""
    return lambda text: base(F.concat(F.lit(f"{seed}:"), text))


def lookup_hash(table: dict[str, int]) -> Callable[[Column], Column]:
    """A hash strategy that looks values up; unknown values are null. For tests."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return lambda text: F.try_element_at(pairs, text).cast("long")


def string_hash(text: Column) -> Column:
    """The 31-polynomial 32-bit hash of a string (characters of the basic plane)."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda a, c: _wrap(a * 31 + F.ascii(c)))


def array_hash(values: Column) -> Column:
    """The 31-polynomial 32-bit hash of an array of bigints, each folded to 32 bits; starts at 1."""
    # an unsigned shift by 32 is the high word; both words are folded by xor
    fold = lambda v: _wrap(v.bitwiseXOR(F.shiftrightunsigned(v, 32)).bitwiseAND(F.lit(_W - 1)))
    return F.aggregate(values, F.lit(1).cast("long"), lambda a, v: _wrap(a * 31 + fold(v)))


def name_bucket(name: Column, bits: int) -> Column:
    """Signed bucket of an external name: remainder keeps the dividend's sign."""
    return (string_hash(name) % (1 << bits)).cast("int")


def signature_bucket(signature: Column, bits: int, prefix: int | None = None) -> Column:
    """LSH bucket of a signature (or of its first ``prefix`` values): signed remainder of the array hash."""
    return (array_hash(F.slice(signature, 1, prefix) if prefix else signature) % (1 << bits)).cast("int")


def band_buckets(signature: Column, width: int, bits: int) -> Column:
    """True banding: one bucket for each band of ``width`` values (OR-amplified), tagged by band."""
    n = F.ceil(F.size(signature) / width).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.concat_ws(":", b.cast("string"), (array_hash(F.slice(signature, b * width + 1, F.lit(width))) % (1 << bits)).cast("string")))


def pair_key(a: Column, b: Column) -> Column:
    """Order-insensitive key of a pair."""
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def _rotl(x: int, r: int, w: int) -> int:
    return (x << r | x >> (w - r)) & ((1 << w) - 1)


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """Murmur3 for x86, 32 bits, signed. The algorithm's constants."""
    c1, c2, m = 0xCC9E2D51, 0x1B873593, _W - 1
    h, n = seed & m, len(data)
    spread = lambda k: _rotl(k * c1 & m, 15, 32) * c2 & m
    for i in range(0, n - n % 4, 4):
        h = (_rotl(h ^ spread(int.from_bytes(data[i : i + 4], "little")), 13, 32) * 5 + 0xE6546B64) & m
    if n % 4:
        h ^= spread(int.from_bytes(data[n - n % 4 :], "little"))
    h ^= n
    for shift, k in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * k & m
    h ^= h >> 16
    return h - _W if h >= _H else h


def murmur3_128(data: bytes, seed: int = 0) -> tuple[int, int]:
    """Murmur3 for x64, 128 bits, as two unsigned halves. The algorithm's constants."""
    c1, c2, m = 0x87C37B91114253D5, 0x4CF5AD432745937F, (1 << 64) - 1
    a = b = seed & m
    n = len(data)
    first = lambda k: _rotl(k * c1 & m, 31, 64) * c2 & m
    second = lambda k: _rotl(k * c2 & m, 33, 64) * c1 & m
    whole = n - n % 16
    for i in range(0, whole, 16):
        a ^= first(int.from_bytes(data[i : i + 8], "little"))
        a = ((_rotl(a, 27, 64) + b) * 5 + 0x52DCE729) & m
        b ^= second(int.from_bytes(data[i + 8 : i + 16], "little"))
        b = ((_rotl(b, 31, 64) + a) * 5 + 0x38495AB5) & m
    b ^= second(int.from_bytes(data[whole + 8 :], "little"))
    a ^= first(int.from_bytes(data[whole : whole + 8], "little"))
    a, b = a ^ n, b ^ n
    a = (a + b) & m
    b = (b + a) & m

    def final(x: int) -> int:
        x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & m
        x = (x ^ x >> 33) * 0xC4CEB9FE1A85EC53 & m
        return x ^ x >> 33

    a, b = final(a), final(b)
    a = (a + b) & m
    return a, (b + a) & m


def _murmur3_column(data: list[bytes], seed: int) -> np.ndarray:
    """murmur3_32 of many values at once: a step takes the next four bytes of all that have them."""
    size = np.fromiter(map(len, data), np.int64, len(data))
    wide = int(size.max(initial=0)) // 4 + 1
    words = np.frombuffer(b"".join(x.ljust(4 * wide, b"\0") for x in data), "<u4").reshape(len(data), wide)
    u = np.uint32
    rotl = lambda x, r: x << u(r) | x >> u(32 - r)
    spread = lambda k: rotl(k * u(0xCC9E2D51), 15) * u(0x1B873593)
    h = np.full(len(data), seed & 0xFFFFFFFF, u)
    for i in range(wide):
        mixed = spread(words[:, i])
        h = np.where(i < size // 4, rotl(h ^ mixed, 13) * u(5) + u(0xE6546B64), np.where((i == size // 4) & (size % 4 > 0), h ^ mixed, h))
    h ^= size.astype(u)
    for shift, k in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> u(shift)) * u(k)
    return (h ^ h >> u(16)).view(np.int32)


#: Values that are hashed at once, as all are padded to the longest.
_AT_ONCE = 1024


def murmur(seed: int = 0) -> Callable[[Column], Column]:
    """Murmur3 (32 bits) of a string's UTF-8 bytes as a hash strategy. Spark's own ``hash`` treats the last bytes differently."""

    @pandas_udf("int")
    def run(text: pd.Series) -> pd.Series:
        out = pd.Series(pd.NA, index=text.index, dtype="Int32")
        known = text[text.notna()].sort_values(key=lambda x: x.str.len())  # values of like lengths together
        for i in range(0, len(known), _AT_ONCE):
            part = known.iloc[i : i + _AT_ONCE]
            out.loc[part.index] = _murmur3_column([x.encode() for x in part], seed)
        return out

    return run
