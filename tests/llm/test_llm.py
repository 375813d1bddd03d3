"""The operators against brute force: on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, and on empty tables."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.llm import bpe, chat, hmm, mixing, pii, quality, queries, setsketch, token_store, toxicity, vafile

PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, key string, n long, score double, spans string, kept int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def texts():
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choices(WORDS, k=n))
    base = say(80)
    near = base.split()
    near[40] = "changed"
    out = [say(rng.randrange(1, 90)) for _ in range(24)]
    out += [base, base, " ".join(near), base.upper(), "", " \t\n", None, "a", "a b c d", "A  B\tc d", "x" * 5000, say(4000)]
    out += ["mail me at a.b@c.de or @x, a@b; 1.2.3.4 256.1.1.1 1.2.3.4.5 001.2.3.4", "card 4111 1111 1111 1111, 4111-1111-1111-1112 +1 (386) 555-3733 +12", "one two three one two three one two three\none\none\n\n \nfour", "é́ İstanbul ΑΣ 한 ﬁ <|endoftext|> don't I'LL 12.5 “q”…\u2028x\u00a0y"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 4}", None, 1, "k", 2, 0.5, "s", 1) for i, t in enumerate(texts())]
    rows += [rows[3], rows[3], (None, "a b c d", None, "s1", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def fold(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5


def test_hmm(docs, empty):
    track = []
    got = hmm.scored(docs, report=track).collect()
    rows = rows_of(docs)
    toks = [(i, t.encode().lower().split() + [b"\0end"]) for i, t in rows]
    c = collections.Counter(w for i, ws in toks if fold(i) != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), fold(i) == 1, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in toks)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got) and track[-1] > track[0]
    assert hmm.scored(empty).count() == 0


def test_forward_and_counts_equal_enumeration():
    rng = np.random.default_rng(0)
    s, k = 3, 5
    norm = lambda x: x / x.sum(-1, keepdims=True)
    first, move, emit, shares = norm(rng.random(s)), norm(rng.random((s, s))), norm(rng.random((s, k))), norm(rng.random(s))
    seqs = [rng.integers(0, k, n).astype(np.int32) for n in (1, 4, 2, 5)]

    def paths(x):
        import itertools

        for p in itertools.product(range(s), repeat=len(x)):
            q = first[p[0]] * emit[p[0], x[0]]
            for a, b, o in zip(p, p[1:], x[1:], strict=False):
                q *= move[a, b] * emit[b, o]
            yield p, q

    exact = [math.log(sum(q for _, q in paths(x))) for x in seqs]
    assert hmm.forward((first, move, emit, shares), seqs) == pytest.approx(exact)
    old = hmm.STATES
    hmm.STATES = s
    try:
        (part,) = hmm._windows(seqs)
        f, m, e, ll = hmm.expected((first, move, emit, shares), *part)
    finally:
        hmm.STATES = old
    f2, m2, e2 = np.zeros(s), np.zeros((s, s)), np.zeros((s, k))
    for x, lx in zip(seqs, exact, strict=True):
        for p, q in paths(x):
            g = q / math.exp(lx)
            f2[p[0]] += g
            for a, b in zip(p, p[1:], strict=False):
                m2[a, b] += g
            for a, o in zip(p, x, strict=True):
                e2[a, o] += g
    assert f == pytest.approx(f2) and m == pytest.approx(m2) and e == pytest.approx(e2) and ll == pytest.approx(sum(exact))


def brute_windows(model, x):
    """Counts of one text, token by token, in windows that share a token."""
    first, move, emit, shares = model
    f, m, e, ll = np.zeros(len(first)), np.zeros_like(move), np.zeros_like(emit), 0.0
    for i in range(0, len(x), hmm.SPAN):
        w, last = x[i : i + hmm.SPAN + 1], i + hmm.SPAN >= len(x)
        alpha, scale = [], []
        for t, o in enumerate(w):
            a = (alpha[-1] @ move if t else first if i == 0 else shares) * emit[:, o]
            scale.append(a.sum())
            alpha.append(a / a.sum())
        beta = np.ones(len(first))
        for t in range(len(w) - 1, -1, -1):
            if t < len(w) - 1:
                onward = emit[:, w[t + 1]] * beta / scale[t + 1]
                m += np.outer(alpha[t], onward) * move
                beta = move @ onward
            if last or t < len(w) - 1:
                e[:, w[t]] += alpha[t] * beta
                ll += math.log(scale[t])
        f += alpha[0] * beta if i == 0 else 0
    return f, m, e, ll


def brute_scores(rows, rounds):
    """Scores of all texts by a model of the same shape, trained in one place."""
    toks = [(i, t.encode().lower().split() + [hmm.END]) for i, t in rows]
    c = collections.Counter(w for i, ws in toks if fold(i) != 1 for w in ws)
    top = sorted((w for w in c if w != hmm.END and len(w) <= hmm.LONGEST), key=lambda w: (-c[w], w))[: hmm.CLASSES - 1]
    own = {hmm.END: 0} | {w: n + 1 for n, w in enumerate(top)}
    class_of = lambda w: own.get(w, hmm.CLASSES + zlib.crc32(w[-3:]) % hmm.TAILS)
    total, kinds = collections.Counter(), collections.Counter()
    for w, n in c.items():
        total[class_of(w)] += n
        kinds[class_of(w)] += 1
    k = hmm.CLASSES + hmm.TAILS
    prior = np.array([total[i] + hmm.SMOOTH if i < len(own) or i >= hmm.CLASSES else 0 for i in range(k)])
    prior /= prior.sum()
    model = hmm._start(prior)
    texts = [np.array([class_of(w) for w in ws]) for _, ws in toks]
    for _ in range(rounds):
        f, m, e, _ = (sum(x) for x in zip(*(brute_windows(model, x) for (i, _), x in zip(toks, texts, strict=True) if fold(i) != 1), strict=True))
        f, m, e = f + hmm.SMOOTH, m + hmm.SMOOTH, e + hmm.SMOOTH * prior * hmm.STATES + 1e-6
        model = f / f.sum(), m / m.sum(1, keepdims=True), e / e.sum(1, keepdims=True), e.sum(1) / e.sum()
    out = []
    for (i, ws), x in zip(toks, texts, strict=True):
        a, score = model[0] * model[2][:, x[0]], 0.0
        for t, o in enumerate(x):
            a = a if t == 0 else (a @ model[1]) * model[2][:, o]
            score += math.log10(a.sum())
            a = a / a.sum()
        score += sum(math.log10((c[w] + hmm.SMOOTH) / (total[class_of(w)] + hmm.SMOOTH * (kinds[class_of(w)] + 1))) for w in ws if w not in own)
        out.append((str(i), len(ws), score))
    return sorted(out)


def test_scores_equal_a_model_trained_in_one_place(spark, docs, monkeypatch):
    for name, size in (("CLASSES", 12), ("SALTS", 3)):  # so that many words are tails
        monkeypatch.setattr(hmm, name, size)
    rows = docs.select("doc_id", "text").where("doc_id is null or doc_id <> 35")
    got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in hmm.scored(rows, rounds=2).collect())
    want = brute_scores(rows_of(rows), 2)
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want], rel=1e-6)


def test_windows_count_every_token_and_move_once():
    rng = np.random.default_rng(3)
    k = 7
    model = hmm._start(np.full(k, 1 / k))
    texts = [rng.integers(0, k, n).astype(np.int32) for n in (1, 63, 64, 65, 128, 129, 500)]
    got = [sum(x) for x in zip(*(hmm.expected(model, *part) for part in hmm._windows(texts)), strict=True)]
    want = [sum(x) for x in zip(*(brute_windows(model, x) for x in texts), strict=True)]
    assert all(a == pytest.approx(b) for a, b in zip(got, want, strict=True))
    assert got[0].sum() == pytest.approx(len(texts)) and got[1].sum() == pytest.approx(sum(len(x) - 1 for x in texts)) and got[2].sum() == pytest.approx(sum(map(len, texts)))


def test_ids_of_large_dictionaries():
    for top in (1, 255, 256, 1 << 16, 1 << 24, (1 << 24) + 5):
        ids = np.array([0, top, top // 2], np.int32)
        assert np.array_equal(hmm._unpack(hmm._pack(ids), 3), ids)


def repeated(ws):
    at = collections.defaultdict(list)
    for i in range(len(ws) - 2):
        at[tuple(ws[i : i + 3])].append(i)
    return len({j for x in at.values() if len(x) > 1 for i in x for j in (i, i + 1, i + 2)})


def test_quality(spark, docs, empty):
    trusted = spark.createDataFrame([(i,) for i in range(12)] + [(None,), (1,)], "doc_id long")
    got = quality.scored(docs, trusted).collect()
    rows = rows_of(docs)

    def base(t):
        ws, ls = words(t), [x for x in t.split("\n") if words(x)]
        return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(ls) - len(set(ls)), repeated(ws)

    want = sorted((str(i), *base(t)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    bins = {(r.doc_id, r.text or ""): list(r.b) for r in docs.select("doc_id", "text", quality.bins(F.col("text")).alias("b")).collect()}
    raw = collections.Counter(b for i, t in rows for b in bins[i, t])
    good = collections.Counter(b for i, t in rows if i is not None and i < 12 for b in bins[i, t])
    share = lambda c, b: math.log((c[b] + quality.SMOOTH) / (sum(c.values()) + quality.SMOOTH * quality.BINS))
    llr = lambda bs: sum(share(good, b) - share(raw, b) for b in bs) / max(len(bs), 1)
    by = {(i, t): llr(bins[i, t]) for i, t in rows}
    own = [by[i, t] for i, t in rows if i is not None and i < 12 and len(words(t)) >= 50 and 2 * repeated(words(t)) <= len(words(t))]
    level = np.mean(own) - quality.SPREAD * np.std(own)
    for r in got:
        x = by[r.doc_id, r.text or ""]
        assert r.llr == pytest.approx(x, abs=2e-4) and r.threshold == pytest.approx(level, abs=2e-3)
        assert r.kept == (not r.base_failed and r.llr >= r.threshold) and r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert quality.scored(empty, trusted).count() == 0
    assert quality.scored(docs, trusted.where("false")).where("llr <> 0").count() == 0


def ids_of(t):
    from tokenizers import Tokenizer

    tk = ids_of.__dict__.setdefault("tk", Tokenizer.from_file(PATH))
    e = tk.encode(t, add_special_tokens=False).ids
    return e, tk.decode(e, skip_special_tokens=False)


def test_token_store(spark, docs, empty):
    store = token_store.write(docs, PATH, 2)
    token_store.verify(spark, store)
    got = token_store.digests(spark, store).collect()
    each = sorted(((i, np.array(ids_of(t)[0] + [2], "<u4")) for i, t in rows_of(docs)), key=lambda x: (x[0] is not None, x[0] or 0))
    start, want = 0, []
    for i, e in each:
        want.append((str(i), start, len(e), zlib.crc32(e.tobytes())))
        start += len(e)
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    full = {(r.doc_id, r.start): list(r.ids) for r in token_store.documents(spark, store).collect()}
    assert all(full[i, s] == e.tolist() for (i, e), (_, s, _, _) in zip(each, want, strict=True))
    c = token_store.chunks(spark, store)
    assert c.count() == c.select("key").distinct().count()
    bad = c.limit(1).withColumn("payload", F.concat(F.lit(b"\x02").cast("binary"), F.lit(b"\x00\x01").cast("binary")))
    with pytest.raises(Exception, match="match its name"):
        bad.select("key", "payload").mapInArrow(token_store._sums, "key binary, n_ids long, crc long").collect()
    # a recipe or a manifest that was changed doesn't verify
    r = token_store.recipes(spark, store)
    for what, names in (("name", F.concat("names", "names")), ("manifest", F.col("names"))):
        other = f"{store}-{what}"
        r.withColumn("names", names).where("n_tokens > 1").write.parquet(f"{other}/recipes")
        spark.read.parquet(f"{store}/manifest").write.parquet(f"{other}/manifest")
        with pytest.raises(Exception, match=f"match its {what}"):
            token_store.verify(spark, other)
    nothing = token_store.write(empty, PATH, 2)
    token_store.verify(spark, nothing)
    assert token_store.digests(spark, nothing).count() == 0


@given(st.lists(st.binary(max_size=40), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_joined_crc(parts):
    after = np.array([sum(map(len, parts[i + 1 :])) for i in range(len(parts))])
    got = token_store.joined_crc(np.array([zlib.crc32(p) for p in parts], np.uint32), after, np.array([0]))
    assert int(got[0]) == zlib.crc32(b"".join(parts))


def test_toxicity(spark, docs, empty):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        bad = i % 3 == 0
        group = rng.choice(["women", "men"])
        # toxic sentences name one group much more often
        if bad and rng.random() < 0.9:
            group = "women"
        rows.append((i, " ".join([*rng.choices(WORDS, k=12), group, *(["idiot"] if bad and rng.random() < 0.85 else []), *(["scumbag"] if bad else [])]), int(bad)))
    t = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = t.select("doc_id", "toxic").union(spark.createDataFrame([(5, None), (None, 1)], "doc_id long, toxic int"))
    fair, plain = (toxicity.train(t, labels, counterfactual=c) for c in (50.0, 0.0))
    gap = lambda m: abs(m[0].get("women", 0) - m[0].get("men", 0))
    assert gap(fair) < 0.3 * gap(plain)
    held = toxicity.scored(t, fair).join(t, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    assert held.where("predicted <> toxic").count() == 0 and held.count() > 30
    scores = toxicity.scored(docs, fair)
    assert scores.count() == docs.count() and scores.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.accepted(docs, fair).columns == docs.columns
    assert toxicity.scored(empty, fair).count() == 0
    none = toxicity.train(empty, labels)
    assert toxicity.scored(docs, none).where("predicted = 1").count() == 0


def brute_toxicity(rows, counterfactual):
    """Weights by the same rules, with dense matrices and a list of all features."""
    bad, good = sum(y for _, _, y in rows), sum(1 - y for _, _, y in rows)
    plain = lambda t: {w for x in t.lower().split() if (w := x.strip(".,!?"))}
    feats = lambda ws: {f for w in ws if len(w) <= 64 for f in [w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) > k)]}
    count = {1: collections.Counter(), 0: collections.Counter()}
    for _, t, y in rows:
        count[y].update(feats(plain(t)))
    gain = {f: abs(math.log((count[1][f] + 0.5) / (bad + 1)) - math.log((count[0][f] + 0.5) / (good + 1))) * math.sqrt(count[1][f] + count[0][f]) for f in {*count[0], *count[1]} if count[1][f] + count[0][f] >= toxicity.SUPPORT}
    names = list(dict.fromkeys([*sorted(gain, key=lambda f: (-round(gain[f], 9), f))[: toxicity.FEATURES], *(t for g in toxicity.IDENTITY for t in g)]))
    dense = lambda ws: np.array([f in x for x in [feats(ws)] for f in names], float)
    group = {t: [o for o in g if o != t] for g in toxicity.IDENTITY for t in g}
    x, d = [], []
    for _, t, _ in rows:
        ws = plain(t)
        x.append(dense(ws))
        own = [w for w in ws if w in group]
        for i in range(max((len(group[w]) for w in own), default=0)):
            d.append(dense(ws.difference(own) | {group[w][i % len(group[w])] for w in own}) - x[-1])
    x, d, y = np.array(x), np.array(d), np.array([y for _, _, y in rows], float)
    w, m, v = np.zeros(len(names) + 1), 0, 0
    w[-1] = math.log((bad + 0.5) / (good + 0.5))
    each = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    for t in range(1, toxicity.STEPS + 1):
        g = each * (1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y)
        grad = np.append(x.T @ g + toxicity.RIDGE * w[:-1] + 2 * counterfactual / len(d) * d.T @ (d @ w[:-1]), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return dict(zip(names, w[:-1], strict=True)), w[-1]


def test_toxicity_equals_a_dense_fit(spark):
    rng = random.Random(17)
    rows = []
    for i in range(200):
        bad = int(i % 3 == 0)
        ws = [*rng.choices(WORDS, k=10), *rng.choices(["women", "men,", "Gay", "muslim", "old!"], k=2), *(["idiots", "scum."] if bad else ["thanks"]), "x" * 70]
        rows.append((i, " ".join(rng.sample(ws, len(ws))), bad))
    used = [r for r in rows if fold(r[0]) != 0]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    for c in (0.5, 4.0):
        got, bias = toxicity.train(df, df.select("doc_id", "toxic"), counterfactual=c)
        want, level = brute_toxicity(used, c)
        assert bias == pytest.approx(level, abs=1e-5) and all(got.get(f, 0.0) == pytest.approx(w, abs=1e-5) for f, w in want.items()) and set(got) <= set(want)
        scores = {r.doc_id: r.score for r in toxicity.scored(df, (got, bias)).collect()}
        words_ = lambda t: {f for x in t.lower().split() if (w := x.strip(".,!?")) and len(w) <= 64 for f in [w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) > k)]}
        for i, t, _ in rows:
            assert scores[i] == pytest.approx(1 / (1 + math.exp(-sum(want.get(f, 0) for f in words_(t)) - level)), abs=1e-4)


_EMAIL, _IP, _CARD, _PHONE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def spans_of(t):
    luhn = lambda d: sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    out = []
    for k, p in enumerate((_EMAIL, _IP, _CARD, _PHONE)):
        for m in p.finditer(t):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (14 <= len(d) <= 19 and luhn(d)) or k == 3 and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_pii_patterns(spark, docs, empty):
    rng = random.Random(9)
    alphabet = ["1", "23", "4", ".", "@", "a", "b-", "+", " ", "-", "(", ")", "_", "é", "255", "1.1", "a@b.c", "4111111111111111", "+1 386 555 3733", "\n"]
    odd = [(1000 + i, "".join(rng.choices(alphabet, k=rng.randrange(1, 25)))) for i in range(400)] + [(5000, "1" * 20000), (5001, "a." * 9000), (5002, "1 " * 9000), (5003, "+" + "(" * 9000)]
    all_ = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    got = all_.select("text", pii.rendered(pii.base_spans(F.col("text"))).alias("s")).collect()
    assert [(r.text, r.s) for r in got if r.s != spans_of(r.text or "")] == []
    assert pii.analysed(empty).count() == 0


def test_pii_disclosure(spark, docs):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        filler = [" ".join(rng.choices(WORDS, k=4)) for _ in range(4)]
        if i % 6 == 0:  # a nickname that stands beside one address only, in different surroundings
            rows.append((i, f"{filler[0]} {rng.choice(WORDS)}{i} Zorblax write to zed@example.org {filler[1]}"))
        else:
            rows.append((i, " ".join(filler) + (f" write to u{i}@example.org" if i % 6 == 1 else "")))
    t = spark.createDataFrame([*rows, rows[0], (None, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.analysed(t).select("doc_id", "text", pii.rendered(F.col("spans")).alias("s"), pii.cleaned(F.col("text"), F.col("spans")).alias("c")).collect()}
    for i, text in rows:
        base = spans_of(text)
        assert set(base.split(",")) <= set(got[i].s.split(",")) or not base
        if i % 6 == 0:
            at = text.index("Zorblax")
            assert f"remove:{at}:{at + 7}" in got[i].s and "Zorblax" not in got[i].c and "<EMAIL>" in got[i].c
        elif i % 6 == 1:
            assert got[i].s == base and "<EMAIL>" in got[i].c
        else:
            assert got[i].s == "" and got[i].c == text
    out = pii.sanitised(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_pii_discloses_rare_values_everywhere(spark):
    """A term that stands with a value that occurs once is removed wherever it stands in that document, far from the value too."""
    rng = random.Random(5)
    far = " ".join(rng.choices(WORDS, k=60))
    rows = [(i, " ".join(rng.choices(WORDS, k=30))) for i in range(80)] + [(100, f"Quibblex {far} mail q@example.org {far} quibblex"), (101, "mail q2@example.org " + far)]
    got = {r.doc_id: r for r in pii.analysed(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.rendered(F.col("spans")).alias("s"), pii.cleaned(F.col("text"), F.col("spans")).alias("c")).collect()}
    at = rows[80][1].index("quibblex")
    assert "remove:0:8," in got[100].s and f"email:{rows[80][1].index('q@')}" in got[100].s and f"remove:{at}:{at + 8}" in got[100].s
    assert "uibblex" not in got[100].c and far in got[100].c and far in got[101].c
    assert all(got[i].c == t for i, t in rows[:80])


def test_pii_copies_do_not_hide_a_term(spark):
    """Exact copies of one text count as one text: a term beside an entity is removed from all of them."""
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choices(WORDS, k=n))
    held = [f"{say(20)} Zorblax zed@example.org {say(20)}" for _ in range(4)]
    rows = list(enumerate([*held, *[held[0]] * 200, *[say(40) for _ in range(100)]]))
    got = pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and sum("<EMAIL>" in r.text for r in got) == 204
    assert not [r.doc_id for r in got if "Zorblax" in r.text]


def brute_disclosure(rows):
    """All spans of each text, by counts over all pairs of an entity and a term."""
    term = re.compile(r"[^\W_]+")
    texts = sorted({t for _, t in rows})
    terms = {t: {w.lower() for w in term.findall(t) if 3 <= len(w) <= 40} for t in texts}
    base = {t: [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans_of(t).split(",") if x)] for t in texts}
    held = {t: {(k, t[a:b].lower()) for k, a, b in base[t]} for t in texts}
    n, n_t, n_e = len(texts), collections.Counter(w for x in terms.values() for w in x), collections.Counter(e for x in held.values() for e in x)
    n_et = collections.Counter((e, w) for t in texts for e in held[t] for w in terms[t])
    out = {}
    for t in texts:
        share = {}
        for w in terms[t]:
            for e in held[t]:
                chance = n_t[w] / n
                p = (n_et[e, w] + pii.PRIOR * chance) / (n_e[e] + pii.PRIOR)
                share[w] = max(share.get(w, 0), math.log(p / chance) / math.log(n / n_e[e]) if n > n_e[e] else 0)
        every = [(a, pii.KINDS.index(k), b) for k, a, b in base[t]]
        for m in term.finditer(t):
            x = share.get(m[0].lower(), 0)
            if x >= pii.GENERALISE and not any(a < m.end() and m.start() < b for a, _, b in every[: len(base[t])]):
                every.append((m.start(), 5 if x >= pii.REMOVE else 4, m.end()))
        out[t] = ",".join(f"{(*pii.KINDS, 'general', 'remove')[k]}:{a}:{b}" for a, k, b in sorted(every))
    return out


def test_pii_spans_equal_brute_force(spark):
    rng = random.Random(21)
    names = [f"name{i}" for i in range(30)]
    entity = ["a.b@c.de", "zed@example.org", "1.2.3.4", "+1 386 555 3733", "4111111111111111", "q1@w.net", "mix4111111111111111x@a.b", "9.9.9.9 +44 20 7946 0958"]
    rows = []
    for i in range(150):
        parts = [*rng.choices(WORDS, k=rng.randrange(1, 25)), *rng.choices(names, k=rng.randrange(3))]
        parts += rng.choices(entity, k=rng.randrange(3)) if i % 3 else []
        rng.shuffle(parts)
        rows.append((i, rng.choice([" ", ", ", "é ", "\n"]).join(parts)))
    rows += [(200 + i, rows[4][1]) for i in range(9)]
    want = brute_disclosure(rows)
    got = pii.analysed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "text", pii.rendered(F.col("spans")).alias("s")).collect()
    assert len(got) == len(rows) and [(r.doc_id, r.s) for r in got if r.s != want[r.text]] == []
    assert sum("general" in x for x in want.values()) > 5 and sum("remove" in x for x in want.values()) > 5


def test_pii_of_a_text_with_many_matches(spark):
    """Thousands of spans in one text, some within others, are placed and cut in the order of the text."""
    t = " ".join(f"ü{i} a{i}@b.c 1.2.3.{i % 256} +1 386 555 {i:04d}" for i in range(2000))
    r = pii.sanitised(spark.createDataFrame([(1, t), (2, "ü1 plain")], "doc_id long, text string")).where("doc_id = 1").first()
    assert r.text.count("<EMAIL>") == 2000 and r.text.count("<IP>") == 2000 and r.text.count("<PHONE>") == 2000 and not re.search(r"@|[0-9]\.[0-9]|\+", r.text)


def test_bpe(docs, empty):
    got = bpe.digests(docs, PATH).collect()
    want = []
    for i, t in rows_of(docs):
        e, d = ids_of(t)
        want.append((str(i), len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(d.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert bpe.digests(empty, PATH).count() == 0
    one = bpe.encoded(docs.where("doc_id = 3"), PATH).first()
    assert (list(one.ids), one.decoded) == ids_of(one.text)


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abAB'’.,;!? \t\n\x0b\x0c\r\x1c\x85\u00a0\u2028\u3000<|>é\u0301İΣ한ﬁ1²½_…«"), st.characters(codec="utf-8")), max_size=60), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_encoding_is_exact(some):
    chunks = bpe.ChunkEncoder(bpe.encoder(PATH), mask=3, least=2, most=9)
    raw = [x.encode() for x in some]
    for t, (ids, shown) in zip(some, chunks.encode(raw), strict=True):
        e, d = ids_of(t)
        assert np.frombuffer(ids, "<u4").tolist() == e and shown.decode() == d
    ids, ends = bpe.encoder(PATH, shown=False).encode(raw)
    assert ids.tolist() == [x for t in some for x in ids_of(t)[0]] and ends.tolist() == np.cumsum([len(ids_of(t)[0]) for t in some]).tolist()


def test_seams_that_disagree_are_encoded_with_the_whole_text(monkeypatch):
    """Where a seam's ids differ from those of its words, as text, the whole text is encoded in their place."""
    chunks = bpe.ChunkEncoder(bpe.encoder(PATH), mask=3, least=2, most=9)
    text = " ".join(random.Random(4).choices(WORDS, k=60)) + " <|endoftext|> don't"
    want = ids_of(text)
    assert [(np.frombuffer(a, "<u4").tolist(), b.decode()) for a, b in chunks.encode([text.encode()])] == [want] and chunks.repaired > 20 and all(chunks.agreed.values())
    wrong = bpe.ChunkEncoder(bpe.encoder(PATH), mask=3, least=2, most=9)
    monkeypatch.setattr(wrong, "_agree", lambda joints: wrong.agreed.update(dict.fromkeys(joints, False)))
    assert [(np.frombuffer(a, "<u4").tolist(), b.decode()) for a, b in wrong.encode([text.encode(), b""])] == [want, ([], "")]


def test_other_vocabularies_are_refused(tmp_path):
    import json

    import public_tokenizers

    with pytest.raises(ValueError, match="kind"):
        bpe.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    spec = json.load(open(PATH))
    spec["normalizer"] = None
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="kind"):
        bpe.WordEncoder(str(tmp_path / "v.json"))


def test_texts_beyond_the_limits_of_slices_and_runs(spark):
    """Texts of some MB, which cross every limit of a slice, a run of texts and a memory of words."""
    rng = random.Random(31)
    pool = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(60_000)]
    long = [" ".join(rng.choices(pool, k=n)) for n in (700_000, 650_000, 3)] + ["z" * 1_500_000 + " idiot " + " ".join(rng.choices(pool, k=400_000))]
    rows = list(enumerate(long)) + [(10, long[1][:3_000_000]), (11, long[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    ids = {i: np.array(ids_of(t)[0], "<u4") for i, t in rows}
    got = {r.doc_id: r for r in bpe.digests(df, PATH).collect()}
    assert all(got[i].n_tokens == len(x) and got[i].ids_sha256 == hashlib.sha256(x.tobytes()).hexdigest() for i, x in ids.items())
    found = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_store.digests(spark, token_store.write(df, PATH, 2)).collect()}
    assert found == {i: (len(x) + 1, zlib.crc32(np.append(x, np.uint32(2)).astype("<u4").tobytes())) for i, x in ids.items()}
    near = {r.doc_id: r for r in setsketch.deduplicated(df).collect()}
    assert [near[i].n_shingles for i, _ in rows] == [len(s) for s in sets_of(rows)] and near[11].component_id == 0 and near[10].component_id == 10
    c = collections.Counter(w for i, t in rows if fold(i) != 1 for w in [*t.encode().split(), b" "])
    n, v = sum(c.values()), len(c)
    for r in hmm.scored(df, rounds=1).collect():
        ws = [*dict(rows)[r.doc_id].encode().split(), b" "]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n) and r.score < 0
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
    scores = {r.doc_id: r.score for r in toxicity.scored(df, ({"idiot": 3.0, "z": 9.0}, -1.0)).collect()}
    assert scores == pytest.approx({i: 1 / (1 + math.exp(-2 if "idiot" in t.split() else 1)) for i, t in rows})


def test_chunks_are_reused():
    text = " ".join(random.Random(2).choices(WORDS, k=3000)).encode()
    c = bpe.ChunkEncoder(bpe.encoder(PATH))
    list(c.encode([text]))
    first = c.encoded
    list(c.encode([b"another start " + text, b"zz " + text]))
    assert c.encoded - first < 0.3 * first


def test_mixing(spark, docs, empty):
    got = mixing.assign(docs).collect()
    sizes = [(r.doc_id, r.source, len(words(r.text or ""))) for r in docs.collect()]
    per = collections.Counter()
    for _, s, n in sizes:
        per[s] += n
    order = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    w = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, left, open_ = {}, sum(per.values()), set(order)
    while True:  # reshare the excess until none is above its cap
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > 3 * per[s]}
        if not full:
            break
        for s in full:
            target[s] = 3.0 * per[s]
            left -= target[s]
        open_ -= full
    target |= {s: level * w[s] for s in open_}
    assert sorted((str(r.doc_id), str(r.source), r.size, r.source_size, round(r.target, 6)) for r in got) == sorted((str(i), str(s), n, per[s], round(target[s], 6)) for i, s, n in sizes)
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.copies == 0) and (r.position is None or 0 <= r.position <= 1)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 for s in order)
    again = mixing.assign(docs.repartition(1)).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in again) == sorted((str(r.doc_id), r.size, r.taken) for r in got)
    mix = [r.position for r in mixing.mixed(mixing.assign(docs)).collect()]
    assert mix == sorted(mix) and len(mix) == sum(r.copies for r in got)
    assert mixing.assign(empty).count() == 0
    # all of a small source's cap, and none with text at all
    small = spark.createDataFrame([(1, "a", "x"), (2, " ".join("b" * 100), "y"), (3, None, "z")], "doc_id long, text string, source string")
    assert {r.doc_id: r.taken for r in mixing.assign(small).collect()} == {1: 3, 2: 100, 3: 0}


def test_mix_is_dealt_in_training_order(spark, docs, tmp_path):
    """The query and the pipeline's stage give rows in the order of training positions, each copy at its own."""
    import corpus_pipeline as p

    rng = random.Random(12)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(1, 30))), "en", f"s{i % 3 if i % 4 else 0}", 0) for i in range(120)]
    small = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = [r.doc_id for r in mixing.mixed(mixing.assign(small)).collect()]
    assert len(set(want)) < len(want) and [r.doc_id for r in p.mix(spark, small, "").collect()] == want
    small.write.parquet(str(tmp_path / "documents.parquet"))
    got = [r.doc_id for r in queries.op7_mixing(spark, str(tmp_path)).collect()]
    assert got[: len(set(want))] == list(dict.fromkeys(want)) and sorted(got) == list(range(120))
    key = lambda x: sorted((str(r.doc_id), str(r.source), r.size, r.taken, str(r.position)) for r in x.collect())
    assert key(mixing.dealt(docs)) == key(mixing.assign(docs))


def test_mix_of_rows_that_share_an_id(spark):
    """The stage takes each row as often as the operator says, whatever rows share its id, source, size or all of it."""
    import corpus_pipeline as p

    rows = [(1, "a b", "en", "s", 3), (1, "c d", "en", "s", 3), (1, "a b", "en", "s", 3), (1, "a b", "de", "s", 3), (None, "e f g", None, None, None), (2, "h", "en", "t", 1), (2, "h", "en", "s", 1), (3, None, "en", "t", 0)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, source string, n_chars long").withColumn("copies", F.lit(9)).repartition(3)
    key = lambda r: str((r.doc_id, r.text, r.lang, r.source, r.n_chars))
    got = collections.Counter(map(key, p.mix(spark, docs, "").collect()))
    keyed = docs.withColumns(mixing.row_key(*p.COLUMNS))
    copies = collections.Counter()
    names = {(r["_h1"], r["_h2"]): key(r) for r in keyed.collect()}
    assert len(names) == 7
    for r in mixing.assign(keyed, keep=mixing.KEY).collect():
        copies[names[r["_h1"], r["_h2"]]] += r.copies
    assert got == +copies
    assert p.mix(spark, docs.where("false"), "").count() == 0


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, key string, spans int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0


def test_demand_inverse(spark):
    x = spark.range(11).select((F.col("id") / 10).alias("s"))
    for a, b in ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0)):
        for r in x.select("s", mixing.demand_inverse(F.col("s"), a, b).alias("t")).collect():
            assert a * r.t + (b - a) * r.t**2 / 2 == pytest.approx(r.s * (a + b) / 2)


def sets_of(rows):
    out = []
    for _, t in rows:
        ws = t.encode().lower().split()
        out.append(frozenset(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) > 4 else frozenset([tuple(ws)] if ws else []))
    return out


def components(rows):
    sets, up = sets_of(rows), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                up[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return sorted((str(d), len(sets[i]), str(least[find(i)]) if sets[i] else str(d)) for i, (d, _) in enumerate(rows))


def test_near_duplicates(spark, docs, empty):
    got = setsketch.deduplicated(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == components(rows_of(docs))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert setsketch.deduplicated(empty).count() == 0
    kept = setsketch.unique(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}


def test_near_duplicate_families(spark):
    """Families with all degrees of similarity, where links have to be found through others, and more members than a block."""
    rng = random.Random(8)
    rows = []
    for f in range(3):
        base = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(60)]
        now = list(base)
        for _ in range(setsketch.BLOCK + 40 if f == 0 else 40):
            src = list(now if rng.random() < 0.5 else base)
            for _ in range(rng.randrange(0, 4)):
                src[rng.randrange(60)] = "w" + str(rng.randrange(10**6))
            now = src
            rows.append((len(rows), " ".join(src)))
    got = setsketch.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == components(rows)


def test_unique_keeps_one_row_of_a_component(spark):
    """By row, not by id: equal rows leave one, and a row whose text is another's copy goes, whatever other rows have its id."""
    one, two = "a b c d e f g", "h i j k l m n"
    rows = [(7, one, "x"), (7, one, "x"), (7, one, "y"), (9, one, "x"), (9, two, "z"), (None, two, "w"), (11, "", "e"), (11, "", "e"), (12, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string").repartition(3)
    got = sorted(map(str, setsketch.unique(df).select("doc_id", "text").collect()))
    assert got == sorted(["Row(doc_id=7, text='a b c d e f g')", "Row(doc_id=9, text='h i j k l m n')", "Row(doc_id=11, text='')", "Row(doc_id=11, text='')", "Row(doc_id=12, text=None)"])
    assert setsketch.unique(df).columns == df.columns and setsketch.unique(df.where("false")).count() == 0


def test_links_between_085_and_090(spark):
    """Pairs just above the threshold, and just below it, beside many others: every link is found."""
    rng, rows = random.Random(11), []
    for _ in range(400):
        base = [f"{rng.choice(WORDS)}{rng.randrange(300)}" for _ in range(rng.randrange(60, 160))]
        other = list(base)
        for _ in range(rng.randrange(1, 4)):
            other[rng.randrange(len(other))] = f"w{rng.randrange(10**6)}"
        rows += [(2 * len(rows), " ".join(base)), (2 * len(rows) + 1, " ".join(other))]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    sets = sets_of(rows)
    near = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, len(rows), 2)]
    assert sum(0.85 <= x < 0.9 for x in near) > 40 and sum(0.8 <= x < 0.85 for x in near) > 40
    for link in (85, 80):
        got = {r.doc_id: r.component_id for r in setsketch.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), link=link).collect()}
        assert [got[2 * i] == got[2 * i + 1] for i in range(400)] == [100 * x >= link for x in near]


def test_sets_of_long_texts_are_those_of_their_pieces(monkeypatch):
    rng = random.Random(13)
    texts = [" ".join(rng.choices(WORDS, k=n)) + "\n" * (n % 7) for n in (0, 1, 4, 5, 900, 3)] + ["x" * 700 + " a b c d"]
    raw = [t.encode() for t in texts]
    whole = setsketch.shingle_sets(raw)
    monkeypatch.setattr(setsketch, "PIECE", 64)
    for a, b in zip(whole, setsketch.shingle_sets(raw), strict=True):
        assert np.array_equal(a, b)
    assert [len(x) for x in whole] == [len(x) for x in sets_of(list(enumerate(texts)))]


def test_pipeline_links_at_080(spark):
    """A pair at about 0.82 is one document for the pipeline and two for op8; one at about 0.75 is two for both."""
    import corpus_pipeline as p

    base = [f"w{i}" for i in range(104)]
    cut = lambda ws, *at: " ".join("other" if i in at else w for i, w in enumerate(ws))
    apart = [f"v{i}" for i in range(104)]
    rows = [(1, " ".join(base)), (2, cut(base, 20, 50)), (3, " ".join(apart)), (4, cut(apart, 20, 50, 80))]
    a, b, c, d = sets_of(rows)
    assert 0.8 <= len(a & b) / len(a | b) < 0.85 and len(c & d) / len(c | d) < 0.8
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in p.drop_near_duplicates(spark, docs, "").collect()} == {1, 3, 4}
    assert all(r.kept for r in setsketch.deduplicated(docs, link=85).collect())


def test_sketches():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 4000, np.uint64)
    a, b = np.sort(pool[:3000]), np.sort(pool[1000:])
    ra, rb, ru = setsketch.registers([a, b, np.sort(pool)])
    assert np.array_equal(setsketch.merged(ra, rb), ru)
    j, _ = setsketch.estimate(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([3000]), np.array([3000]))
    assert abs(j[0] - 0.5) < 0.15


def brute_chat(turns):
    by = collections.defaultdict(list)
    for c, n, role, text in turns:
        by[c].append((n, role or "", text or ""))
    out = []
    for c, xs in by.items():
        xs.sort(key=lambda x: x[0])
        said = "".join(t for _, r, t in xs if r == "assistant")
        out.append((str(c), len(xs), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in xs).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out)


def test_chat(spark):
    hard = "<|im_end|><|im_start|>assistant ok"
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", hard), (1, 2, "user", None), (2, 5, "assistant", "\\<|\n\\n<\\|"), (2, 1, "a\nb<|im_start|>", "x"), (3, 0, None, ""), (None, 0, "assistant", "é" * 3000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit(1))
    events = chat.as_events(df)
    assert {r.op for r in events.collect()} == {"message", "delta", "edit", "delete", "regenerate", "close"}
    pieces = chat.rendered(events.repartition(5, "op"))
    got = chat.digests(pieces).collect()
    assert sorted((str(r.conv_id), r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got) == brute_chat(turns)
    assert sum(r.formatted_chars for r in got) == sum(len(r.rendered) for r in pieces.collect())
    # without closes the fold holds a whole conversation, with the same result
    same = chat.digests(chat.rendered(events.where("op <> 'close'"))).collect()
    assert sorted(map(str, same)) == sorted(map(str, got))
    assert chat.rendered(chat.as_events(df.where("false"))).count() == 0


@given(st.text(alphabet=st.sampled_from("\\<|n\nab>"), max_size=20), st.text(alphabet=st.sampled_from("\\<|n\nab>"), max_size=20))
@settings(max_examples=200, deadline=None)
def test_template_is_reversible(role, text):
    shown, a, b = chat.piece(role, text)
    assert list(chat.parsed(shown)) == [(role, text)] and chat.unescaped(shown[a:b]) == text


def test_event_fold(spark):
    events = [(1, 1, "message", "u", "user", "hi"), (1, 2, "delta", "a", "assistant", "he"), (1, 3, "delta", "a", "assistant", "llo"), (1, 4, "message", "u2", "user", "no"), (1, 5, "regenerate", "a", "assistant", ""), (1, 6, "delta", "a", "assistant", "bye"), (1, 7, "edit", "u", "user", "hey"), (1, 8, "message", "x", "user", "gone"), (1, 9, "delete", "x", None, None)]
    events += [(1, 10, "close", None, None, None), (1, 11, "delta", "a", "assistant", "more"), (1, 12, "close", None, None, None), (1, 13, "regenerate", "u", "user", "new")]
    df = spark.createDataFrame(events, "conv_id long, seq long, op string, message string, role string, text string").repartition(3)
    got = [t for r in chat.rendered(df).orderBy("part").collect() for t in chat.parsed(r.rendered)]
    assert got == [("user", "hey"), ("assistant", "bye"), ("assistant", "more"), ("user", "new")]
    with pytest.raises(Exception, match="unknown event"):
        chat.rendered(df.withColumn("op", F.lit("other"))).collect()


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 6)], i) for i in range(260)]
    rows += [(100, rows[100][1], 0), (260, rows[7][1], 1), (261, None, 1), (262, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (263, [float("nan")] * 6, 1), (264, [float("inf")] * 6, 1), (None, rows[0][1], 1), (265, [0.5, 0.5], 1), (300, [0.1, 0.2], 1), (400, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in dict((i, v) for i, v in ok if i % 100 == 0).items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    got = vafile.top_k(df, F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert vafile.top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_approximation_bounds():
    rng = np.random.default_rng(1)
    for top in (3, 900, 1 << 24):
        v, q = rng.integers(-top, top, (500, 16)), rng.integers(-top, top, (3, 16))
        cell, low, step = vafile.cells(v)
        assert (low + step * cell <= v).all() and (v < low + step * (cell.astype(np.int64) + 1)).all()
        least, most = vafile.bounds(q, cell, low, step)
        exact = q @ v.T
        assert (least <= exact).all() and (exact <= most).all()
        # what is kept of a grid's cell holds the k best and little more
        ids, kept = [(-1, 0), (-2, 1), (7, 2)], [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))] * 3
        for k in range(0, 500, 100):
            some = np.arange(k, k + 100)
            own = vafile.cells(v[some])
            vafile._keep(ids, q, kept, (some.tobytes(), some.tobytes(), own[1].tobytes(), own[2].tobytes(), own[0].tobytes()), 10)
        for i, (own, _) in enumerate(ids):
            best = [int(j) for j in np.lexsort((np.arange(500), -exact[i])) if j != own][:10]
            assert set(best) <= set(kept[i][0].tolist()) and len(kept[i][0]) < 60
    with pytest.raises(OverflowError):
        vafile.bounds(np.full((1, 2), 1 << 40), np.zeros((1, 2), np.uint8), np.full(2, 1 << 40), np.ones(2, np.int64))


def test_top_k_of_many_equal_vectors_and_blocks(spark, monkeypatch):
    """Ties of a vector that most rows hold go to the smallest ids; small blocks and grids give the same result."""
    for name, size in (("BLOCK", 7), ("BLOCKS", 2), ("QUERIES", 4), ("WAIT", 600)):
        monkeypatch.setattr(vafile, name, size)
    rng = np.random.default_rng(6)
    rows = [(i, [0.5, 0.25] if i % 3 else [float(x) for x in rng.normal(0, 0.1, 2)]) for i in range(400)] + [(500 + i, [0.1] * i) for i in range(6)]
    got = vafile.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 100 == 0)
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    want = []
    for q, v in ints:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ints if i != q and len(w) == len(v))[:10]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(6)
    say = lambda n: " ".join(rng.choices(WORDS, k=n))
    rows = [(i, say(30) + (" idiot" if i % 5 == 0 else ""), "en", f"s{i % 3}", 0) for i in range(100)]
    rows += [(100 + i, rows[i][1], "en", f"s{i % 3}", 0) for i in range(20)] + [(200, say(20) + " a.b@c.de " + say(20), "en", "s0", 0), (201, None, None, None, None), (202, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("key", F.lit(1))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(100)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in p.STAGES] == ["toxicity", "near-duplicates", "personal data", "mixing", "encoding"]
    now, seen = docs, []
    for name, stage in p.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == p.COLUMNS
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id: r.text for r in now.collect()})
    clean = [r for r in rows if "idiot" not in (r[1] or "")]
    assert set(seen[0]) == {r[0] for r in clean}
    least = {i for i, _, c in ((int(a), b, int(c)) for a, b, c in components([(r[0], r[1] or "") for r in clean])) if i == c}
    assert set(seen[1]) == least and "<EMAIL>" in seen[2][200] and set(seen[2]) == least
    want = sorted((r.doc_id, r.copies) for r in mixing.assign(spark.read.parquet(str(tmp_path / "personal data"))).where("copies > 0").collect())
    assert sorted(collections.Counter(r.doc_id for r in now.collect()).items()) == want
    final = p.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in final) == sorted((r.doc_id, len(ids_of(r.text or "")[0])) for r in now.collect())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_against_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for n in os.listdir(d):
        c.execute(f"CREATE VIEW {n.split('.')[0]} AS SELECT * FROM '{d}/{n}'")
    r = c.execute(queries.ORACLE[name])
    names = [x[0] for x in r.description]
    df = queries.QUERIES[name](spark, d)
    key = lambda row: tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in row)
    assert sorted(key(x[n] for n in names) for x in df.collect()) == sorted(map(key, r.fetchall()))
