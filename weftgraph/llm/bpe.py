"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the text's bytes cuts it into chunks at places that depend on the content
alone, so that passages shared by documents give the same chunks. A task encodes each distinct
chunk once. A cut can fall inside a word, where a chunk's own encoding is wrong; such a seam is
repaired by encoding anew from the last white space before it to the first one behind it, over
as many chunks as that takes. The seam is then encoded once more between the words next to it,
as text, and has to give the ids that the chunks on both sides have for these words; where it
doesn't, the whole text is encoded in their place, which always agrees.

Chunks are remembered by a task, in a memory of bounded size; they aren't exchanged between
tasks, as moving texts costs more than encoding them. The vocabulary file has to have the normaliser
and the pre-tokenizer that the fast ways here rely on; any other raises an error.

Defined results: null and empty texts have no ids and decode to an empty text; texts of any
length are cut into bounded chunks; equal rows give equal results; an empty table gives an empty
one; other columns are ignored by :func:`digests` and kept by :func:`encoded`.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from weftgraph.llm.common import record, slices, texts_of

_SPACES = frozenset(b" \t\n\x0b\x0c\r")


# The normaliser and pre-tokenizer of the vocabulary files that this module encodes with.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,;:!?)")] = True
_LETTER[97:123] = True


def prepared(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Texts, end to end, and their bounds: with the same ids but fewer distinct words, by ASCII lower case, as the normaliser makes it, and a blank between a letter and a mark, where the pre-tokenizer cuts anyway."""
    data = b"".join([t if b"<|" in t else t.lower() for t in texts])  # special tokens are found before normalisation
    codes = np.frombuffer(data, np.uint8)
    cuts = np.flatnonzero(_MARK[codes[1:]] & _LETTER[codes[:-1]]) + 1
    ends = np.cumsum([0, *map(len, texts)])
    ends += np.searchsorted(cuts, ends, side="left")  # a blank at a text's very start belongs to the one before
    return np.insert(codes, cuts, 32).tobytes(), ends


class WordEncoder:
    """Encodes words that hold no ASCII white space, remembering frequent ones. Ids are little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, most: int = 500_000, shown: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # the same model without normaliser and patterns, for words of plain letters
        spec = json.loads(self.tokenizer.to_str())
        if (spec["normalizer"], spec["pre_tokenizer"], spec["post_processor"], spec["decoder"]) != (_NORMALIZER, _PRE_TOKENIZER, None, None) or spec["model"].get("end_of_word_suffix") != "</w>" or any(x["normalized"] or not x["content"].startswith("<|") for x in spec["added_tokens"]):
            raise ValueError(f"{path} isn't a vocabulary of the kind that this encoder handles")
        spec |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, spec["pre_tokenizer"]["pretokenizers"][-1]]}}
        self.plain = Tokenizer.from_str(json.dumps(spec))
        self.most, self.known, self.shown, self.shows = most, {}, {}, shown
        self.strings = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(self.tokenizer.get_vocab_size())]
        self.ends = np.array([x.endswith(b"</w>") for x in self.strings])

    def _keep(self, words: list[bytes], ids: list[bytes]) -> None:
        self.known.update(zip(words, ids, strict=True))
        if self.shows:
            strings = self.strings.__getitem__
            self.shown.update(zip(words, [b" ".join(map(strings, memoryview(x).cast("I"))) for x in ids], strict=True))

    def learn(self, words: set[bytes]) -> None:
        """Make sure that ``known`` and ``shown`` (the decoded pieces) have these words."""
        new = words.difference(self.known)
        plain = [w for w in new if w.isalpha()]  # ASCII letters
        other = []
        for w in new.difference(plain):
            s = w.decode("utf-8", "replace")
            # normalisation leaves lower-case Latin letters alone
            if s.isalpha() and s.islower() and max(s) < "\u0250":
                plain.append(w)
            else:
                other.append(w)
        if plain:
            # each is one piece, so they can be encoded as one text: a piece ends with its first token that ends a word
            ids = np.array(self.plain.encode_batch_fast([b" ".join(plain).lower().decode()], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(cuts) == len(plain) and cuts[-1] == 4 * len(ids):
                raw = ids.tobytes()
                self._keep(plain, [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)])
            else:
                other += plain
        if other:
            self._keep(other, self.whole(other))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, end to end, and where each text's ids end: words are split and numbered by Arrow, and each distinct word is looked up once."""
        data, bounds = prepared(texts)
        words = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        self.learn(set(distinct))
        each = list(map(self.known.__getitem__, distinct))
        self.trim()
        pool = np.frombuffer(b"".join(each), "<u4")
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        first = np.cumsum(size) - size
        place = coded.indices.to_numpy()
        n = size[place]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(first[place] - total[:-1], n) + np.arange(total[-1])]
        return ids, total[words.offsets.to_numpy()[1:]]

    def whole(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts as the library gives them."""
        done = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in done]

    def trim(self) -> None:
        """Bound the memory: forget long words when there are too many."""
        if len(self.known) > self.most:
            kept = [w for w in self.known if len(w) <= 7][: self.most // 2]
            self.known, self.shown = {w: self.known[w] for w in kept}, {w: self.shown[w] for w in kept} if self.shows else {}


_ENCODERS: dict[tuple, WordEncoder] = {}


def encoder(path: str, shown: bool = True) -> WordEncoder:
    """This worker's encoder for a vocabulary file."""
    if (path, shown) not in _ENCODERS:
        _ENCODERS[path, shown] = WordEncoder(path, 150_000 if shown else 1_000_000, shown)
    return _ENCODERS[path, shown]


def _gear(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, np.uint32)


def rolling(values: np.ndarray, steps: int) -> np.ndarray:
    """Hash of the 2**steps values up to each place: sum of value[i - k] << k, by doubling the window."""
    h = values.astype(np.uint32)
    for s in range(steps):
        w = 1 << s
        h[w:] += h[:-w] << np.uint32(w)
    return h


def cut(data: bytes, ends: list[int], mask: int, least: int, most: int) -> list[list[bytes]]:
    """Chunks of each of several texts that lie end to end in ``data``."""
    h = rolling(_gear()[np.frombuffer(data, np.uint8)], 5) if data else np.zeros(0, np.uint32)
    marks = (np.flatnonzero((h & np.uint32(mask)) == 0) + 1).tolist()
    out, k, at = [], 0, 0
    for end in ends:
        chunks = []
        while at < end:
            while k < len(marks) and marks[k] < at + least:
                k += 1
            nxt = min(marks[k] if k < len(marks) else end, at + most, end)
            chunks.append(data[at:nxt])
            at = nxt
        out.append(chunks)
    return out


class ChunkEncoder:
    """Encodes texts by chunks; each distinct chunk's inner words are encoded once while it is remembered."""

    def __init__(self, words: WordEncoder, mask: int = 0x1FF, least: int = 64, most: int = 4096, budget: int = 16 << 20, agreed: int = 50_000):
        self.words, self.mask, self.least, self.most, self.budget, self.most_agreed = words, mask, least, most, budget, agreed
        self.chunks: dict[bytes, tuple | None] = {}
        self.agreed: dict[tuple[bytes, ...], bool] = {}
        self.held = self.encoded = self.reused = self.repaired = 0

    def _enter(self, new: set[bytes]) -> None:
        split = {c: c.split() for c in new}
        inner: dict[bytes, tuple] = {}
        for c, parts in split.items():
            first, last = c[0] in _SPACES, c[-1] in _SPACES
            if len(parts) == 1 and not first and not last:
                self.chunks[c] = None  # within one word: only part of a seam
            else:
                head, tail = (b"" if first or not parts else parts[0]), (b"" if last or not parts else parts[-1])
                inner[c] = (head, parts[bool(head) : len(parts) - bool(tail)], tail)
        self.words.learn(set().union(*[body for _, body, _ in inner.values()]))
        known, shown = self.words.known, self.words.shown
        for c, (head, body, tail) in inner.items():
            self.chunks[c] = (head, b"".join(map(known.__getitem__, body)), b" ".join(filter(None, map(shown.__getitem__, body))), tail, body[0] if body else b"", body[-1] if body else b"")
            self.held += len(c) * 4
        self.encoded += len(new)

    def _agree(self, joints: set[tuple[bytes, ...]]) -> None:
        """Encode seams (word before, seam, word behind; words may be missing) as text and hold the ids against those of the words."""
        if len(self.agreed) > self.most_agreed:
            self.agreed = {}
        known, new = self.words.known, [j for j in joints if j not in self.agreed]
        for j, ids in zip(new, self.words.whole([b" ".join(filter(None, j)) for j in new]), strict=True):
            self.agreed[j] = ids == b"".join([known[w] for w in j if w])
        self.repaired += len(new)

    def encode(self, texts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(ids, decoded text) of each text."""
        data, bounds = prepared(texts)
        docs = cut(data, bounds[1:].tolist(), self.mask, self.least, self.most)
        if self.held > self.budget:
            self.chunks, self.held = {}, 0
            self.words.trim()
        distinct = {c for chunks in docs for c in chunks}
        new = distinct.difference(self.chunks)
        self.reused += sum(map(len, docs)) - len(new)
        self._enter(new)
        plans, seams, joints = [], set(), []
        for chunks in docs:
            plan, open_word, before, own = [], b"", b"", []
            for c in chunks:
                entry = self.chunks[c]
                if entry is None:
                    open_word += c
                    continue
                if seam := open_word + entry[0]:
                    plan.append(seam)
                    seams.add(seam)
                    if plan[:-1]:
                        own.append((before, seam, entry[4]))
                plan.append(entry)
                open_word, before = entry[3], entry[5]
            if open_word:
                plan.append(open_word)
                seams.add(open_word)
            plans.append(plan)
            joints.append(own)
        self.words.learn(seams)
        self._agree({j for own in joints for j in own})
        known, shown = self.words.known, self.words.shown
        for text, plan, own in zip(texts, plans, joints, strict=True):
            if all(map(self.agreed.__getitem__, own)):
                ids = b"".join([known[x] if isinstance(x, bytes) else x[1] for x in plan])
                yield ids, b" ".join([y for x in plan if (y := shown[x] if isinstance(x, bytes) else x[2])])
            else:
                ids = self.words.whole([text])[0]
                yield ids, b" ".join(filter(None, map(self.words.strings.__getitem__, memoryview(ids).cast("I"))))


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digest_task(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ChunkEncoder(encoder(path))
        for part in slices(batches, "text", 2 << 20):
            done = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(shown).hexdigest()) for ids, shown in chunks.encode(texts_of(part))]
            n, a, b = zip(*done, strict=True)
            yield record(DIGESTS, part.column(0), n, a, b)

    return run


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (little-endian unsigned 32-bit) and of the decoded text."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(_digest_task(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encode_task(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ChunkEncoder(encoder(path))
        for part in slices(batches, "_text", 4 << 20):
            done = list(chunks.encode(texts_of(part, "_text")))
            ids = [np.frombuffer(i, "<u4").astype(np.int32) for i, _ in done]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.list_(pa.int32())), pa.array([s.decode() for _, s in done], pa.string())], names=[*part.schema.names[:-1], "ids", "decoded"])

    return run


def encoded(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """The documents with two more columns, ``ids`` and ``decoded``, which replace any of these names."""
    docs = docs.drop("ids", "decoded", "_text")
    rows = docs.withColumn("_text", docs[text_col])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return rows.mapInArrow(_encode_task(path), f"{kept}, ids array<int>, decoded string")
