"""Near-duplicate detection with SetSketch registers.

A document's set of word shingles is reduced to M registers: minima of exponential variables
over the set, on an exponential scale of base B, truncated to 16 bits. Registers of a union are
the larger ones of its parts, and two sets' registers agree with about the probability of their
Jaccard similarity. Bands of registers find candidates, a likelihood over how many registers are
larger, smaller and equal drops hopeless ones, and the rest is verified on the full sets.

Documents with equal sets are one class and meet the rest as one. Within a bucket of a band,
pairs with a pivot come first, not all pairs; links found merge classes into components. What
this leaves is compared in blocks of bounded size, the largest component of a bucket against the
rest but never with itself: registers tell which members of a block could still link across
components, their full sets are read, and pairs are verified, most similar first, until no pair
across components is left; a block returns a tree of links at most. A pair that shares several
bands is looked at in the first. Rows reach the kernels sorted by group, so that a task holds one
pivot or one block. So no group is collected, no partner is capped, and no link between
components is lost but with the probability that all bands miss a pair (below 1e-8 at a
similarity of 0.85, 3.1e-6 at 0.8: ``(1 - j ** ROWS) ** BANDS``) or the likelihood errs (some
1e-5). The similarity that links is an argument, in hundredths.

Defined results: null and empty texts, and texts without words, have no shingles and are linked
with nothing; texts of fewer words than a shingle have one; texts of any length are hashed in
pieces of some MB; equal rows are linked; a null id is smaller than none: it never names a
component that has an id; an empty table gives an empty one; other columns are ignored by
:func:`deduplicated` and kept by :func:`unique`. Rows may repeat an id: :func:`unique` keeps one
row of each component, the first by id, then by a hash of the text, and every row without
shingles.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import drop_table, likely, record, runs, slices, texts_of, write_table

#: Words of a shingle; hundredths of similarity that link where a caller names none.
WIDTH, LINK = 5, 85
#: Registers as bands of rows; base of the scale and rate of the exponentials; largest register.
BANDS, ROWS, BASE, RATE, LARGEST = 32, 5, 1.001, 64.0, 65535
M = BANDS * ROWS
#: A candidate is dropped if its likelihood at the linking similarity is below the best by more than this logarithm.
DROP = 10.0
#: Members of a block, and shingles of its members, about; members of a pivot that one task verifies; bytes of text that are hashed at once.
BLOCK, BLOCK_SHINGLES, STAR, PIECE = 256, 1 << 18, 128, 4 << 20

_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))
_PLACE = _RNG.integers(1, 1 << 63, WIDTH + 1, np.uint64) | np.uint64(1)
_LOW, _HIGH = (_RNG.integers(1, 1 << 32, M, np.uint32) | np.uint32(1) for _ in range(2))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_GAP = re.compile(rb"[ \t-\r]")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of ``data``."""
    codes = np.frombuffer(data, np.uint8)
    space = _SPACE[codes]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))  # starts and ends of words in turn
    begin, end = edge[::2], edge[1::2]
    # a word's hash: polynomial over its bytes, from differences of a running sum
    power = np.full(len(codes) + 1, _STEP)
    power[0] = 1
    np.cumprod(power, out=power)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_BYTE[codes] * power[:-1], out=total[1:])
    back = np.full(len(codes) + 1, _STEP_INVERSE)
    back[0] = 1
    np.cumprod(back, out=back)
    return begin, _mix((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64) * _PLACE[0])


def _all_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The same, by pieces that end at white space, so that the working memory is that of a piece."""
    if len(data) <= PIECE:
        return _words(data)
    at, begins, hashes = 0, [], []
    while at < len(data):
        gap = _GAP.search(data, min(at + PIECE, len(data)))
        end = gap.end() if gap else len(data)
        begin, words = _words(data[at:end])
        begins.append(begin + at)
        hashes.append(words)
        at = end
    return np.concatenate(begins), np.concatenate(hashes)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    data = b"\n".join([t.lower() for t in texts])
    begin, words = _all_words(data)
    del data
    limits = np.searchsorted(begin, np.cumsum([0, *[len(t) + 1 for t in texts]]))
    n = max(len(words) - width + 1, 0)
    grams = np.zeros(n, np.uint64)
    for k in range(width):
        grams += words[k : k + n] * _PLACE[k + 1]
    grams = _mix(grams)
    out = []
    for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            out.append(_mix((words[a:b] * _PLACE[1 : b - a + 1]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers of sets, none of them empty: (sets, M) of 16 bits."""
    if not sets:
        return np.zeros((0, M), np.uint16)
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
    least = np.empty((M, len(sets)), np.uint32)
    for i in range(M):
        least[i] = np.minimum.reduceat(low * _LOW[i] + high * _HIGH[i], starts)
    x = -np.log1p(-(least + 0.5) / 2**32) / RATE  # minimum of exponential variables
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LARGEST).astype(np.uint16).T.copy()


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def log_likelihood(j: np.ndarray, more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Of similarity ``j``, given how many registers of a are larger and smaller than those of b, and both sizes."""
    u = n_a / (n_a + n_b)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = np.maximum(p(u - (1 - u) * j), 1e-12), np.maximum(p((1 - u) - u * j), 1e-12)
    return more * np.log(up) + less * np.log(down) + (M - more - less) * np.log(np.maximum(1 - up - down, 1e-12))


_GRID = np.linspace(0, 1, 51)


def estimate(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, link: int = LINK) -> tuple[np.ndarray, np.ndarray]:
    """Most likely similarity on a grid, and whether a similarity of ``link`` hundredths is plausible (sizes allow it; likelihood not far below the best)."""
    shape = lambda x: np.asarray(x, np.float64)[:, None]
    n_a, n_b = shape(n_a), shape(n_b)
    top = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    at = _GRID[None] * top
    ll = log_likelihood(at, shape(more), shape(less), n_a, n_b)
    best = ll.argmax(1)
    j, rows = at[np.arange(len(at)), best], top[:, 0] >= link / 100
    at_link = log_likelihood(np.minimum(link / 100, top), shape(more), shape(less), n_a, n_b)[:, 0]
    return j, rows & ((j >= link / 100) | (ll.max(1) - at_link <= DROP))


_SKETCH = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("regs", pa.binary()), ("text_key", pa.int64())])
_SKETCH_SQL = "doc_id long, key binary, n long, regs binary, text_key long"


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", 1 << 20):
        sets = shingle_sets(texts_of(part))
        full = [s for s in sets if len(s)]
        regs = iter(registers(full))
        keys = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        yield record(_SKETCH, part.column(0), keys, [len(s) for s in sets], [next(regs).tobytes() if len(s) else None for s in sets], part.column(2))


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, M)


_ODD = _RNG.integers(1, 1 << 63, (BANDS, ROWS + 1), np.uint64) | np.uint64(1)


def _bands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("bucket", pa.int64()), ("band", pa.int32()), ("key", pa.binary()), ("n", pa.int64())])
    for batch in batches:
        for k in range(0, batch.num_rows, 2048):
            part = batch.slice(k, 2048)
            if part.num_rows:
                regs = _regs(part.column(1)).reshape(-1, BANDS, ROWS).astype(np.uint64)
                buckets = _mix((regs * _ODD[None, :, :ROWS]).sum(2) + _ODD[None, :, ROWS]).astype(np.int64)
                each = pa.array(np.repeat(np.arange(part.num_rows), BANDS))
                yield record(schema, pa.array(buckets.reshape(-1)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), part.num_rows)), part.column(0).take(each), part.column(2).take(each))


def _plausible(batches: Iterable[pa.RecordBatch], link: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that could link, from rows (a, b, n_a, n_b, regs_a, regs_b)."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    for batch in batches:
        if batch.num_rows:
            x, y = _regs(batch.column(4)), _regs(batch.column(5))
            _, ok = estimate((x > y).sum(1), (x < y).sum(1), batch.column(2).to_numpy(), batch.column(3).to_numpy(), link)
            keep = pa.array(ok, pa.bool_())
            yield record(schema, batch.column(0).filter(keep), batch.column(1).filter(keep))


def _links(x: np.ndarray, y: np.ndarray, link: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= link * (len(x) + len(y) - both)


def _with_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows with their last column, a text, as the text's set."""
    for part in slices(batches, "text", 1 << 20):
        sets = shingle_sets(texts_of(part))
        yield from zip(*(c.to_pylist() for c in part.columns[:-1]), sets, strict=True)


def _verified(batches: Iterable[pa.RecordBatch], link: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that link, from rows (pivot, part, side, key, text) in order: the pivot's own row, then those that are held against it."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    pivot, own, out = None, None, []
    for a, _, side, b, s in _with_sets(batches):
        if side == 0:
            pivot, own = a, s
        elif a == pivot and _links(own, s, link):
            out.append((a, b))
            if len(out) >= 4096:
                yield record(schema, *zip(*out, strict=True))
                out = []
    if out:
        yield record(schema, *zip(*out, strict=True))


def _open_pairs(regs: np.ndarray, n: np.ndarray, label: np.ndarray, own: np.ndarray, band: int, link: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For members i of a block, in order of ``own``, the partners that could link, in another component and in no earlier band: (i, partners, likely similarities). Members of two parts meet across these only."""
    bands = regs.reshape(-1, BANDS, ROWS)
    side = int((own == own[0]).sum())
    few, many = sorted((np.arange(side), np.arange(side, len(own))), key=len)
    for i in few.tolist() if len(few) else range(len(own) - 1):
        o = many if len(few) else np.arange(i + 1, len(own))
        o = o[(label[o] != label[i]) & (np.minimum(n[o], n[i]) * 100 >= link * np.maximum(n[o], n[i]))]
        if len(o) and band:
            o = o[~(bands[o, :band] == bands[i, :band]).all(2).any(1)]
        if len(o):
            more, less = (regs[i] > regs[o]).sum(1), (regs[i] < regs[o]).sum(1)
            j, ok = estimate(more, less, np.full(len(o), n[i]), n[o], link)
            if ok.any():
                yield i, o[ok], j[ok]


def _arrays(members: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Registers, sizes, labels as numbers and parts of members (own, key, label, n, regs, ...)."""
    number = {x: i for i, x in enumerate(dict.fromkeys(m[2] for m in members))}
    regs = np.frombuffer(b"".join(m[4] for m in members), np.uint16).reshape(-1, M)
    return regs, np.array([m[3] for m in members]), np.array([number[m[2]] for m in members]), np.array([m[0] for m in members])


_MEMBER = pa.schema([("bucket", pa.int64()), ("band", pa.int32()), ("i", pa.int64()), ("j", pa.int64()), ("own", pa.int64()), ("key", pa.binary()), ("label", pa.binary()), ("n", pa.int64()), ("regs", pa.binary())])
_MEMBER_SQL = "bucket long, band int, i long, j long, own long, key binary, label binary, n long, regs binary"


def _wanted(batches: Iterable[pa.RecordBatch], link: int) -> Iterator[pa.RecordBatch]:
    """Members of blocks whose sets have to be read, from members in order of blocks."""
    for block, members in runs((row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)), 4):
        need: set[int] = set()
        for x, others, _ in _open_pairs(*_arrays(members), block[1], link):
            need.add(x)
            need.update(others.tolist())
        if need:
            yield record(_MEMBER, *zip(*[(*block, *members[k]) for k in sorted(need)], strict=True))


def _joined(batches: Iterable[pa.RecordBatch], link: int) -> Iterator[pa.RecordBatch]:
    """Links that join components within a block, most similar pairs first: a tree of links at most, from members with texts in order of blocks."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    for block, members in runs(_with_sets(batches), 4):
        arrays = _arrays(members)
        root = arrays[2].tolist()
        top = list(range(max(root) + 1))

        def find(x: int, top=top) -> int:
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        pairs = [(-float(s), x, int(o)) for x, os, js in _open_pairs(*arrays, block[1], link) for o, s in zip(os, js, strict=True)]
        out = []
        for _, x, o in sorted(pairs):
            p, q = find(root[x]), find(root[o])
            if p != q and _links(members[x][5], members[o][5], link):
                top[p] = q
                out.append((members[x][1], members[o][1]))
        if out:
            yield record(schema, *zip(*out, strict=True))


def components(edges: DataFrame) -> DataFrame:
    """(key, label): the smallest key that each end of the edges (a, b) reaches. Smallest neighbours, then labels of labels, until nothing changes."""
    both = write_table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", small=True)
    labels = write_table(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels", small=True)
    while True:
        near = both.join(labels, both.a == labels.key).groupBy(F.col("b").alias("_key")).agg(F.min("label").alias("near"))
        step = labels.join(near, labels.key == near._key).select("key", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        up = labels.select(F.col("key").alias("_to"), F.col("label").alias("up"))
        new = write_table(step.join(up, F.col("to") == F.col("_to"), "left").select("key", F.coalesce(F.least("to", "up"), "to").alias("label"), "was"), "labels", small=True)
        drop_table(labels)
        labels = new.select("key", "label")
        if new.where(F.col("label") != F.col("was")).isEmpty():
            drop_table(both)
            return labels


def _same_or(labels: DataFrame | None, rows: DataFrame) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("key"))
    return rows.join(labels.withColumnRenamed("label", "_label"), "key", "left").withColumn("label", F.coalesce("_label", "key")).drop("_label")


def _texts(keys: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, text) of one document for each of the classes ``keys``."""
    one = write_table(nodes.join(keys.distinct(), "key", "left_semi").select("key", F.col("at.doc_id").alias("_id"), F.col("at.text_key").alias("_text")), "standing")
    met = likely(docs, [F.col("text_key")], one, ["_text"]).hint("merge").join(one, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_text")))
    return met.select("key", "text").dropDuplicates(["key"])


def _star_links(members: DataFrame, nodes: DataFrame, docs: DataFrame, link: int) -> DataFrame:
    """Links between each bucket's pivot and its members."""
    pairs = members.where((F.col("key") != F.col("pivot")) & (F.least("n", "pivot_n") * 100 >= link * F.greatest("n", "pivot_n"))).select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct()
    regs = lambda x: nodes.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    pairs = pairs.join(regs("a"), "a").join(regs("b"), "b").select("a", "b", "n_a", "n_b", "regs_a", "regs_b")
    pairs = write_table(pairs.mapInArrow(lambda x: _plausible(x, link), "a binary, b binary"), "pairs")
    # a pivot's members are dealt to parts of about STAR, each led by the pivot
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    dealt = pairs.join(sizes, "a").select(F.col("a").alias("pivot"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"), F.col("b").alias("key"))
    rows = write_table(dealt.union(dealt.select("pivot", "part", F.lit(0).alias("side"), F.col("pivot").alias("key")).distinct()), "stars")
    whole = rows.join(_texts(rows.select("key"), nodes, docs), "key").select("pivot", "part", "side", "key", "text")
    whole = whole.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "side")
    links = write_table(whole.mapInArrow(lambda x: _verified(x, link), "a binary, b binary"), "links")
    for used in (pairs, rows):
        drop_table(used)
    return links


def _block_links(members: DataFrame, labels: DataFrame | None, nodes: DataFrame, docs: DataFrame, link: int) -> DataFrame:
    """Links across components within buckets, block by block: the largest component of a bucket meets the others, and they meet each other."""
    met = _same_or(labels, members.select("bucket", "band", "key", "n"))
    size = met.groupBy("bucket", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    mixed = size.groupBy("bucket").agg(F.max(F.struct("c", "label", "s")).alias("main"), F.sum("c").alias("all_c"), F.sum("s").alias("all_s"), F.count("*").alias("kinds")).where("kinds > 1")
    parts = lambda c, s: F.ceil(F.greatest(c / BLOCK, s / BLOCK_SHINGLES))
    mixed = mixed.select("bucket", F.col("main.label").alias("main"), parts(F.col("main.c"), F.col("main.s")).alias("mains"), parts(F.col("all_c") - F.col("main.c"), F.col("all_s") - F.col("main.s")).alias("others"))
    rows = met.join(mixed, "bucket")
    is_main, at = F.col("label") == F.col("main"), F.xxhash64("key")
    own = F.when(is_main, F.col("others") + F.pmod(at, F.col("mains"))).otherwise(F.pmod(at, F.col("others")))
    last = F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    rows = rows.select("bucket", "band", "key", "label", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other")).join(nodes.select("key", "n", "regs"), "key")
    rows = rows.select("bucket", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "label", "n", "regs")
    block = ("bucket", "band", "i", "j")
    order = lambda x: x.repartition(*block).sortWithinPartitions(*block, "own", "key")
    wanted = write_table(order(rows).mapInArrow(lambda x: _wanted(x, link), _MEMBER_SQL), "wanted")
    full = order(wanted.join(_texts(wanted.select("key"), nodes, docs), "key").select(*wanted.columns, "text"))
    links = write_table(full.mapInArrow(lambda x: _joined(x, link), "a binary, b binary").distinct(), "links")
    drop_table(wanted)
    return links


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", link: int = LINK) -> DataFrame:
    """One row a document: doc_id, text_key, n_shingles, component_id (smallest id reached) and first (it is its component's first by id, then text_key)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    sketches = write_table(rows.mapInArrow(_sketch, _SKETCH_SQL), "sketches")
    classes = sketches.where("key is not null").groupBy("key")
    nodes = write_table(classes.agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("at"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("regs").alias("regs")), "nodes")
    bands = nodes.select("key", "regs", "n").mapInArrow(_bands, "bucket long, band int, key binary, n long")
    shared = bands.groupBy("bucket").agg(F.count("*").alias("c"), F.min(F.struct("key", "n")).alias("pivot")).where("c > 1")
    members = write_table(bands.join(shared, "bucket").select("bucket", "band", "key", "n", F.col("pivot.key").alias("pivot"), F.col("pivot.n").alias("pivot_n")), "members")
    links = _star_links(members, nodes, rows, link)
    labels = None if links.isEmpty() else components(links)
    more = _block_links(members, labels, nodes, rows, link)
    if not more.isEmpty():
        labels = components(links.union(more))
    known = _same_or(labels, nodes.select("key", "least", "at"))
    named = known.groupBy("label").agg(F.min("least").alias("component_id"), F.min("at").alias("first"))
    named = known.join(named, "label").select("key", "component_id", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_text"))
    none = F.col("key").isNull()
    out = sketches.select("doc_id", "text_key", "n", "key").join(named, "key", "left").select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(none, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (none | F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_text"))).alias("first"),
    )
    out = write_table(out, "verdicts")
    for used in (sketches, nodes, members, links, more, labels):
        if used is not None:
            drop_table(used)
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", link: int = LINK) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest id reached) and kept (it is this document's)."""
    out = verdicts(docs, id_col, text_col, link)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", link: int = LINK) -> DataFrame:
    """The documents without near-duplicates: one row of each component, the first by id, then text; the same columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column's name meets one of the join
    own = docs.toDF(*names)
    found = verdicts(docs, id_col, text_col, link)
    text = F.coalesce(F.col(names[docs.columns.index(text_col)]).cast("string"), F.lit(""))
    own = own.withColumn("_key", F.xxhash64(text))
    id_ = F.col(names[docs.columns.index(id_col)]).cast("long")
    among = lambda rows, how: own.join(rows.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t")).distinct(), id_.eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_t")), how)
    again = found.where("first and n_shingles > 0").groupBy("doc_id", "text_key").agg(F.count("*").alias("c")).where("c > 1")
    dropped = found.where("not first").select("doc_id", "text_key")
    if again.isEmpty():
        return among(dropped, "left_anti").select(*names).toDF(*docs.columns)
    # rows that repeat an id and a text: one of them stays
    alone = among(dropped.union(again.select("doc_id", "text_key")), "left_anti")
    return alone.union(among(again, "left_semi").dropDuplicates([names[docs.columns.index(id_col)], "_key"])).select(*names).toDF(*docs.columns)
