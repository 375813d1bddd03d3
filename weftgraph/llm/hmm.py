"""Language-model scoring with a hidden Markov model over words.

States emit word classes and a class emits its words: P(word | state) = P(class | state) P(word | class).
The CLASSES most frequent training words are classes of their own; all other words, unseen ones
included, share TAILS classes by a hash of their last bytes, each with a smoothed distribution
over its words and one place for unseen words. Baum-Welch counts are summed across partitions
over all training texts; the scaled forward recursion then gives each whole text's exact
likelihood, end token included.

Training reads texts in windows that share one token with the next: each move and each token is
counted once, and a window within a text begins with the states' shares in the corpus, not as a
text does. Corpus counts are exact and grow with the corpus: texts are encoded once against small
dictionaries, one for a run of texts, and only the dictionaries meet the corpus counts, frequent
words dealt to many tasks. Only the model, whose size is fixed, reaches the driver.

Defined results: a null text is empty (its only token is the end); a null id belongs to the
training texts; a text of any length is one text, scored whole; words of equal counts are ranked
by their bytes; equal rows are scored alike, and each counts; an empty table gives an empty one;
without training texts all counts are 0; other columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import drop_table, fold_of, record, slices, texts_of, write_table

#: Hidden states; words that are classes of their own (of at most LONGEST bytes); classes of the others; passes of Baum-Welch.
STATES, CLASSES, LONGEST, TAILS, ROUNDS = 8, 4096, 64, 512, 5
#: Tokens of a training window; added to counts; bytes of text that share a dictionary; tasks that a frequent word's dictionary entries are dealt to.
SPAN, SMOOTH, RUN, SALTS = 64, 0.5, 12 << 20, 64
#: Bytes of compressed texts that are unpacked at once, to be counted and to be scored: scoring steps through all texts of a part at the pace of the longest.
COUNTED, SCORED = 1 << 18, 2 << 20
#: The end of a text as a dictionary entry: no word has a space.
END = b" "

_CHUNK = "chunk long, words array<binary>, counts array<int>, doc_ids array<long>, held array<boolean>, lengths array<int>, ids binary"


def _pack(ids: np.ndarray) -> bytes:
    """Local ids as compressed byte planes, as many as the largest id needs."""
    planes = max(1, (int(ids.max(initial=0)).bit_length() + 7) // 8)
    return zlib.compress(b"".join((ids >> (8 * i) & 255).astype(np.uint8).tobytes() for i in range(planes)), 1)


def _unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(-1, n).astype(np.int32)
    return sum(p << (8 * i) for i, p in enumerate(planes))


def _encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a run of texts: its distinct words with training counts, and its texts as local ids, frequent words first."""
    from pyspark import TaskContext

    schema = pa.schema([("chunk", pa.int64()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("ids", pa.binary())])
    number = TaskContext.get().partitionId() << 32
    numbers = lambda: defaultdict(itertools.count().__next__)  # noqa: E731  (a word gets the next number when it is first looked up)
    place = numbers()
    doc_ids, outs, lengths, ids = [], [], [], []
    size = 0

    def flush():
        nonlocal number
        flat = np.concatenate(ids)
        order = np.argsort(-np.bincount(flat, minlength=len(place)), kind="stable")
        rank = np.empty(len(place), np.int32)
        rank[order] = np.arange(len(place), dtype=np.int32)
        flat = rank[flat]
        trained = np.bincount(flat[np.repeat(~np.array(outs), lengths)], minlength=len(place))
        words = pa.array([*place], pa.binary()).take(pa.array(order))
        number += 1
        return record(schema, [number], pa.ListArray.from_arrays([0, len(place)], words), pa.ListArray.from_arrays([0, len(place)], pa.array(trained, pa.int32())), [doc_ids], [outs], [lengths], [_pack(flat)])

    for part in slices(batches, "text", 2 << 20):
        tokens: list[bytes] = []
        for text in texts_of(part):
            ws = text.lower().split()
            tokens += ws
            tokens.append(END)
            lengths.append(len(ws) + 1)
            size += len(text) + 16
        doc_ids += part.column(0).to_pylist()
        outs += part.column(1).to_pylist()
        ids.append(np.fromiter(map(place.__getitem__, tokens), np.int32, len(tokens)))
        del tokens, ws
        if size > RUN:
            yield flush()
            place, doc_ids, outs, lengths, ids, size = numbers(), [], [], [], [], 0
    if ids:
        yield flush()


def _tail(word: Column) -> Column:
    """Class of a word that is none of its own: by its last three bytes."""
    return F.lit(CLASSES) + (F.crc32(F.substring(word, -3, 3)) % TAILS).cast("int")


def _start(prior: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Initial model (first states, moves, emissions, shares of states): the class distribution, disturbed for each state."""
    rng = np.random.default_rng(seed)
    emit = prior * np.exp(rng.normal(0, 1.0, (STATES, len(prior))))
    move = np.full((STATES, STATES), 0.2 / max(STATES - 1, 1))
    np.fill_diagonal(move, 0.8)
    return np.full(STATES, 1 / STATES), move, emit / emit.sum(1, keepdims=True), np.full(STATES, 1 / STATES)


def expected(model: tuple, windows: np.ndarray, lengths: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts (first states, moves, emissions) and log-likelihood of windows of class ids, padded on the right. begins, ends: whether a window begins or ends its text; the last token of one that doesn't end it belongs to the next."""
    first, move, emit, shares = (x.astype(np.float64) for x in model)
    n, span = windows.shape
    alpha, scale = np.zeros((span, n, STATES)), np.ones((span, n))
    by_class = np.ascontiguousarray(emit.T)
    seen = [by_class[windows[:, t]] for t in range(span)]
    now = np.where(begins[:, None], first, shares) * seen[0]
    for t in range(span):
        if t:
            now = (alpha[t - 1] @ move) * seen[t]
        total = now.sum(1)
        alive = t < lengths
        scale[t] = np.where(alive, total, 1.0)
        alpha[t] = np.where(alive[:, None], now / np.maximum(total, 1e-300)[:, None], 0)
    ahead = np.zeros((n, STATES))  # scaled backward variables of the place behind
    moves, gammas = np.zeros((STATES, STATES)), np.zeros((span, n, STATES))
    for t in range(span - 1, -1, -1):
        last = t == lengths - 1
        inner = t < lengths - 1
        if t < span - 1:
            onward = seen[t + 1] * ahead / scale[t + 1][:, None]
            onward[~inner] = 0
            moves += alpha[t].T @ onward * move
            beta = onward @ move.T
        else:
            beta = np.zeros((n, STATES))
        beta[last] = 1.0
        gammas[t] = alpha[t] * beta
        ahead = beta
    own = np.arange(span)[:, None] < np.where(ends, lengths, lengths - 1)
    weight = (gammas * own[:, :, None]).reshape(-1, STATES)
    flat = windows.T.reshape(-1)
    emissions = np.stack([np.bincount(flat, weight[:, s], emit.shape[1]) for s in range(STATES)])
    return gammas[0][begins].sum(0), moves, emissions, float(np.log(scale[own]).sum())


def forward(model: tuple, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of whole texts of class ids, all in step, longest first."""
    first, move, emit, _ = model
    by_class = np.ascontiguousarray(emit.T)
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order])
    out = np.zeros(len(texts))
    if not len(sizes):
        return out
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.concatenate([texts[i] for i in order])
    alive = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # how many texts go beyond t
    now = np.tile(first, (len(texts), 1))
    for t in range(sizes[0]):
        n = alive[t]
        now = (now[:n] @ move if t else now[:n]) * by_class[flat[starts[:n] + t]]
        total = now.sum(1)
        out[:n] += np.log(total)
        now /= total[:, None]
    back = np.empty(len(texts))
    back[order] = out
    return back


def _windows(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts cut to windows of SPAN tokens and the next one, some thousands at a time: windows, lengths, and which begin and end a text."""
    parts = [(x[i : i + SPAN + 1], i == 0, i + SPAN >= len(x)) for x in texts for i in range(0, len(x), SPAN)]
    for k in range(0, len(parts), 4096):
        own, begins, ends = zip(*parts[k : k + 4096], strict=True)
        lengths = np.array([len(x) for x in own])
        out = np.zeros((len(own), SPAN + 1), np.int32)
        out[np.arange(SPAN + 1) < lengths[:, None]] = np.concatenate(own)
        yield out, lengths, np.array(begins), np.array(ends)


def _classes(part: pa.RecordBatch, i: int) -> list[np.ndarray]:
    lengths = part.column(i).to_pylist()
    ids = part.column(i + 1).to_pylist()
    return [np.frombuffer(zlib.decompress(x), np.uint16).astype(np.int32) if n else np.zeros(0, np.int32) for n, x in zip(lengths, ids, strict=True)]


def _count_task(model: tuple):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in slices(batches, "classes", COUNTED):
            texts = _classes(batch, 0)
            for part in _windows(texts):
                got = expected(model, *part)
                sums = got if sums is None else tuple(a + b for a, b in zip(sums, got, strict=True))
        schema = pa.schema([("slot", pa.int32()), ("value", pa.float64())])
        if sums is not None:
            flat = np.concatenate([np.ravel(x) for x in sums])
            yield record(schema, pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat))

    return run


def train(texts: DataFrame, prior: np.ndarray, rounds: int = ROUNDS) -> tuple[tuple, list[float]]:
    """The model after Baum-Welch over ``texts`` (n, classes), and each round's log-likelihood."""
    spark = texts.sparkSession
    model, track = _start(prior), []
    k = len(prior)
    for _ in range(rounds):
        tasks = max(2 * spark.sparkContext.defaultParallelism, 8)  # counts are summed within a task first: as many vectors as the cluster has cores, not as the corpus has parts
        sums = texts.coalesce(tasks).mapInArrow(_count_task(model), "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value"))
        flat = np.zeros(STATES + STATES * STATES + STATES * k + 1)
        for slot, value in sums.collect():
            flat[slot] = value
        first, move, emit, ll = np.split(flat, np.cumsum([STATES, STATES * STATES, STATES * k]))
        first, move, emit = first + SMOOTH, move.reshape(STATES, STATES) + SMOOTH, emit.reshape(STATES, k) + SMOOTH * prior * STATES + 1e-6
        model = (first / first.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True), emit.sum(1) / emit.sum())
        track.append(float(ll[0]))
    return model, track


_TEXT = "n int, classes binary, doc_id long, held boolean, n_tokens long, n_known long, base double, within double"


def _resolve_task(n_all: int, n_words: int, stats: dict[int, tuple[int, int]]):
    """Texts of a run as class ids, with the parts of their scores that need no states, from the run's row and its dictionary's counts."""
    schema = pa.schema([("n", pa.int32()), ("classes", pa.binary()), ("doc_id", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("within", pa.float64())])

    size = np.array([stats.get(i, (0, 0))[0] + SMOOTH * (stats.get(i, (0, 0))[1] + 1) for i in range(CLASSES + TAILS)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name: batch.column(batch.schema.get_field_index(name))[i]  # noqa: B023, E731
                order = get("places").values.to_numpy(zero_copy_only=False)
                back = np.empty(len(order), np.int64)
                back[order] = np.arange(len(order))
                count = get("totals").values.to_numpy(zero_copy_only=False)[back]
                own = get("classes").values.to_numpy(zero_copy_only=False)[back].astype(np.uint16)
                within = np.where(own < CLASSES, 0.0, np.log10((count + SMOOTH) / size[own]))
                base = np.log10((count + 0.5) / (n_all + 0.5 * (n_words + 1)))
                lengths = np.array(get("lengths").as_py())
                ids = _unpack(get("ids").as_py(), int(lengths.sum()))
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                classes = own[ids]
                sums = [np.add.reduceat(x[ids], starts) for x in ((count > 0).astype(np.int64), base, within)]
                packed = [zlib.compress(classes[a : a + n].tobytes(), 1) for a, n in zip(starts, lengths, strict=True)]
                yield record(schema, lengths.tolist(), packed, get("doc_ids").as_py(), get("held").as_py(), lengths, *sums)

    return run


def _score_task(model: tuple, train_tokens: int):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "classes", SCORED):
            col = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            score = forward(model, _classes(batch, 0)) / np.log(10) + col("within").to_numpy()
            yield record(schema, col("doc_id"), col("held"), col("n_tokens"), col("n_known"), [train_tokens] * batch.num_rows, col("base"), score)

    return run


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_fold: int = 1, rounds: int = ROUNDS, report: list | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. ``report`` gets each round's log-likelihood."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold_of(F.col(id_col)) == held_fold).alias("held"), F.col(text_col).cast("string").alias("text"))
    runs = write_table(rows.mapInArrow(_encode, _CHUNK), "hmm-runs")
    places = runs.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select("chunk", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("count"))
    vocabulary = places.groupBy("word").agg(F.sum("count").alias("total"))
    # classes of their own: the most frequent words; a list of fixed size
    top = vocabulary.where((F.col("total") > 0) & (F.octet_length("word") <= LONGEST) & (F.col("word") != F.lit(END))).orderBy(F.desc("total"), "word").limit(CLASSES - 1).select("word").collect()
    own = {bytes(r["word"]): i + 1 for i, r in enumerate(top)} | {END: 0}
    listed = spark.createDataFrame([*own.items()], "word binary, own int")
    counted = vocabulary.join(F.broadcast(listed), "word", "left").withColumn("class", F.coalesce("own", _tail(F.col("word")))).drop("own")
    counted = write_table(counted, "hmm-vocabulary")
    stats = {r["class"]: (r["c"], r["v"]) for r in counted.groupBy("class").agg(F.sum("total").alias("c"), F.sum((F.col("total") > 0).cast("long")).alias("v")).collect()}
    n_all, n_words = (sum(x[i] for x in stats.values()) for i in (0, 1))
    k = CLASSES + TAILS
    prior = np.array([stats.get(i, (0, 0))[0] + SMOOTH for i in range(k)], np.float64)
    prior[len(own) : CLASSES] = 0  # classes that have no word
    prior /= prior.sum()
    # the listed words are in every dictionary: their rows are dealt to SALTS tasks each
    salted = counted.withColumn("salt", F.explode(F.when(F.col("class") < CLASSES, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    marked = places.select("chunk", "place", "word").join(F.broadcast(listed), "word", "left").withColumn("salt", F.when(F.col("own").isNull(), 0).otherwise(F.pmod(F.xxhash64("chunk"), F.lit(SALTS)).cast("int"))).drop("own")
    met = marked.join(salted, ["word", "salt"])
    each = met.groupBy("chunk").agg(F.collect_list(F.struct("place", "total", "class")).alias("m"))
    each = each.select("chunk", F.col("m.place").alias("places"), F.col("m.total").alias("totals"), F.col("m.class").alias("classes"))
    texts = each.join(runs.select("chunk", "doc_ids", "held", "lengths", "ids"), "chunk").mapInArrow(_resolve_task(n_all, n_words, stats), _TEXT)
    texts = write_table(texts, "hmm-texts")
    for used in (runs, counted):
        drop_table(used)
    model, track = train(texts.where("not held").select("n", "classes"), prior, rounds)
    if report is not None:
        report += track
    out = write_table(texts.mapInArrow(_score_task(model, n_all), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "hmm-scores")
    drop_table(texts)
    return out
