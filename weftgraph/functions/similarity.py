"""Similarities and distances between columns.

A similarity is a binary column function. ``matching`` follows the documented quirks of the
analytics this engine serves: cosine and edit matching are true *below* the threshold and set
matching is always false, unless ``strict`` asks for the plain meaning.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.functions import bound
from weftgraph.functions.sketches import minhash_similarity

Similarity = Callable[[Column, Column], Column]


def _sum(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def magnitude(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), magnitude(a) * magnitude(b)), F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 / (cosine + 1.1)."""
    return 1 / (cosine(a, b) + 1.1)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of arrays without repeats; 1 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(1.0))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of the smaller components by the sum of the larger ones; 0 if that is 0; lengths must agree."""
    value = F.coalesce(F.try_divide(_sum(a, b, lambda x, y: F.least(x.cast("double"), y.cast("double"))), _sum(a, b, lambda x, y: F.greatest(x.cast("double"), y.cast("double")))), F.lit(0.0))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).otherwise(value)


def token_edit_similarity(a: Column, b: Column) -> Column:
    """1 minus the edit distance of two arrays of tokens by the longer one; 1 if both are empty.

    Tokens become single characters by their place among the two arrays' distinct tokens, so
    the built-in string distance counts tokens.
    """
    # places start at U+0100 and leave out the surrogates
    code = lambda p: F.lpad(F.hex(p + 0x100 + F.when(p > 0xD000, 0x2000).otherwise(0)), 4, "0")
    text = lambda known, xs: F.array_join(F.transform(xs, lambda t: F.decode(F.unhex(code(F.array_position(known, t))), "UTF-16BE")), "")
    apart = bound(F.array_distinct(F.concat(a, b)), lambda known: F.levenshtein(text(known, a), text(known, b)))
    return F.coalesce(1 - F.try_divide(apart, F.greatest(F.size(a), F.size(b))), F.lit(1.0))


def text_edit_similarity(a: Column, b: Column, tokens_a: Column, tokens_b: Column) -> Column:
    """The same of two arrays that are texts already, one character a token."""
    return F.coalesce(1 - F.try_divide(F.levenshtein(a, b), F.greatest(F.size(tokens_a), F.size(tokens_b))), F.lit(1.0))


def matching(kind: str, threshold: float, strict: bool = False) -> Similarity:
    """Predicate whether two features match."""
    quirk = not strict
    return {
        "cosine": lambda a, b: F.abs(cosine(a, b)) < threshold if quirk else cosine(a, b) >= threshold,
        "edit": lambda a, b: token_edit_similarity(a, b) < threshold if quirk else token_edit_similarity(a, b) >= threshold,
        "jaccard": lambda a, b: F.lit(False) if quirk else set_jaccard(a, b) >= threshold,
        "weighted": lambda a, b: weighted_jaccard(a, b) >= threshold,
        "minhash": lambda a, b: minhash_similarity(a, b) >= threshold,
    }[kind]


SIMILARITIES: dict[str, Similarity] = {"cosine": cosine, "jaccard": set_jaccard, "weighted": weighted_jaccard, "minhash": minhash_similarity, "edit": token_edit_similarity}
DISTANCES: dict[str, Similarity] = {"euclidean": euclidean, "cosine": cosine_distance}


# ---- the same of each row of a matrix and each row of another, components added in order -----


def each_sum(x: np.ndarray, y: np.ndarray, *terms: Callable[[np.ndarray, np.ndarray, np.ndarray], object]) -> list[np.ndarray]:
    """Sums over the components; a term puts its value of a column and a row of components into its last argument."""
    out, t = [np.zeros((len(x), len(y))) for _ in terms], np.empty((len(x), len(y)))
    for u, w in zip(x.T[:, :, None], y.T[:, None], strict=True):
        for total, term in zip(out, terms, strict=True):
            term(u, w, t)
            total += t
    return out


def each_magnitude(x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for u in x.T:
        total += u * u
    return np.sqrt(total)


def each_ratio(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x / y; 0 where y is 0."""
    return np.divide(x, y, out=np.zeros(np.broadcast_shapes(x.shape, y.shape)), where=y != 0)


def each_cosine(x: np.ndarray, y: np.ndarray, dots: np.ndarray | None = None) -> np.ndarray:
    dots = each_sum(x, y, np.multiply)[0] if dots is None else dots
    return each_ratio(dots, each_magnitude(x)[:, None] * each_magnitude(y)[None])


def squared_gap(u: np.ndarray, w: np.ndarray, t: np.ndarray) -> None:
    np.subtract(u, w, out=t)
    np.multiply(t, t, out=t)


def each_matching(kind: str, threshold: float, strict: bool = False) -> Callable[[np.ndarray], np.ndarray]:
    """As :func:`matching`, of similarities that are known."""
    if strict or kind in ("weighted", "minhash"):
        return lambda s: s >= threshold
    return {"cosine": lambda s: np.abs(s) < threshold, "edit": lambda s: s < threshold, "jaccard": lambda s: np.zeros(s.shape, bool)}[kind]


def each_edit_distance(xs: list[np.ndarray], ys: list[np.ndarray], lanes: int = 1 << 14, room: int = 1 << 23) -> np.ndarray:
    """Edit distances of each text (an array of codes from 0) and each other.

    A column of the table of distances goes on in words of 64 bits, which hold where it grows and
    falls by one, with a carry from word to word (Myers, Hyyro). ``lanes``: pairs at a time. ``room``:
    words of the table of a text's codes; a text that needs more gets plain rows of distances.
    """
    out = np.zeros((len(xs), len(ys)), np.int32)
    if not len(xs) or not len(ys):
        return out
    sizes = np.array([len(y) for y in ys])
    of_y = np.argsort(-sizes, kind="stable")
    sizes = sizes[of_y]
    flat = np.concatenate([np.zeros(0, np.int64), *[ys[j] for j in of_y]]).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    active = np.searchsorted(-sizes, -np.arange(sizes[0]))  # texts that are longer than each place
    codes = 1 + max((int(z.max()) for z in (*xs, flat) if len(z)), default=0)
    of_x = sorted(range(len(xs)), key=lambda i: -len(xs[i]))
    at = 0
    while at < len(of_x):
        words = max(1, -(-len(xs[of_x[at]]) // 64))
        if codes * words > room:
            out[of_x[at]] = [_edit_distance(xs[of_x[at]], y) for y in ys]
            at += 1
            continue
        n = max(1, min(lanes // len(ys), room // (codes * words), (1 << 21) // (len(ys) * words)))
        some = of_x[at : at + n]
        out[np.ix_(some, of_y)] = _edit_words([xs[i] for i in some], flat, starts, sizes, active, words, codes).T
        at += n
    return out


def _edit_words(xs: list[np.ndarray], flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, active: np.ndarray, words: int, codes: int) -> np.ndarray:
    one, top = np.uint64(1), np.uint64(63)
    equal = np.zeros((words, codes, len(xs)), np.uint64)
    mask = np.zeros((words, len(xs)), np.uint64)
    for i, x in enumerate(xs):
        place = np.arange(len(x))
        bit = one << (place % 64).astype(np.uint64)
        np.bitwise_or.at(equal, (place // 64, x, i), bit)
        np.bitwise_or.at(mask, (place // 64, i), bit)
    up = np.full((words, len(sizes), len(xs)), ~np.uint64(0))
    down = np.zeros_like(up)
    buffers = [np.empty((len(sizes), len(xs)), np.uint64) for _ in range(7)]
    for t, k in enumerate(active):
        code = flat[starts[:k] + t]
        eq, xv, hp, hn, *turns = (b[:k] for b in buffers)
        for w in range(words):
            p, m = up[w, :k], down[w, :k]
            np.take(equal[w], code, axis=0, out=eq, mode="clip")
            np.bitwise_or(eq, m, out=xv)
            if w:
                np.bitwise_or(eq, fell, out=eq)  # noqa: F821
            np.bitwise_and(eq, p, out=hn)
            np.add(hn, p, out=hn)
            np.bitwise_xor(hn, p, out=hn)
            np.bitwise_or(hn, eq, out=hn)
            np.bitwise_or(hn, p, out=hp)
            np.invert(hp, out=hp)
            np.bitwise_or(hp, m, out=hp)
            np.bitwise_and(hn, p, out=hn)
            if w + 1 < words:  # eq isn't read any more, so that it can hold a carry
                np.right_shift(hp, top, out=turns[0])
                np.right_shift(hn, top, out=eq)
            np.left_shift(hp, one, out=hp)
            np.bitwise_or(hp, rose if w else one, out=hp)  # noqa: F821
            np.left_shift(hn, one, out=hn)
            if w:
                np.bitwise_or(hn, fell, out=hn)
            np.bitwise_and(hp, xv, out=m)
            np.bitwise_or(hp, xv, out=hp)
            np.invert(hp, out=hp)
            np.bitwise_or(hp, hn, out=p)
            if w + 1 < words:
                rose, fell = turns[1], turns[2]
                np.copyto(rose, turns[0])
                np.copyto(fell, eq)
    total = np.repeat(sizes[:, None], len(xs), 1).astype(np.int32)
    for w in range(words):
        total += np.bitwise_count(up[w] & mask[w])
        total -= np.bitwise_count(down[w] & mask[w])
    return total


def _edit_distance(x: np.ndarray, y: np.ndarray) -> int:
    """The same of two texts, a row of distances at a time."""
    at = np.arange(len(y) + 1)
    row = at
    for i, c in enumerate(x, 1):
        row = np.minimum.accumulate(np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (y != c))]) - at) + at
    return int(row[-1])


def each_edit_similarity(xs: list[np.ndarray | None], nx: np.ndarray, ys: list[np.ndarray | None], ny: np.ndarray) -> np.ndarray:
    """As :func:`text_edit_similarity`, of texts and the numbers of their tokens; None: no text."""
    empty = np.zeros(0, np.int64)
    apart = each_edit_distance([empty if x is None else x for x in xs], [empty if y is None else y for y in ys])
    known = np.array([x is not None for x in xs], bool)[:, None] & np.array([y is not None for y in ys], bool)[None]
    return np.where(known, 1 - each_ratio(apart.astype(float), np.maximum(nx[:, None], ny[None]).astype(float)), 1.0)


def each_set_jaccard(xs: list[np.ndarray | None], ys: list[np.ndarray | None], step: int = 4096) -> np.ndarray:
    """As :func:`set_jaccard`, of sets as arrays of codes from 0; 1 where one is None."""
    sides = [(np.repeat(np.arange(len(s)), [0 if z is None else len(z) for z in s]), np.concatenate([np.zeros(0, np.int64), *[z for z in s if z is not None]]).astype(np.int64)) for s in (xs, ys)]
    shared = np.zeros((len(xs), len(ys)))
    for low in range(0, 1 + max((int(c.max()) for _, c in sides if len(c)), default=0), step):
        parts = []
        for (row, code), s in zip(sides, (xs, ys), strict=True):
            keep = (code >= low) & (code < low + step)
            part = np.zeros((len(s), step if len(code) and code.max() >= step else 1 + int(code.max(initial=0))), np.float32)
            part[row[keep], code[keep] - low] = 1
            parts.append(part)
        width = min(p.shape[1] for p in parts)
        shared += parts[0][:, :width] @ parts[1][:, :width].T
    n, m = (np.array([0 if z is None else len(np.unique(z)) for z in s]) for s in (xs, ys))
    either = n[:, None] + m[None] - shared
    known = np.array([x is not None for x in xs], bool)[:, None] & np.array([y is not None for y in ys], bool)[None]
    return np.where(known & (either > 0), each_ratio(shared, either), 1.0)
