"""Information-theoretic sanitisation of personal data. DataFrame functions only.

Patterns find protected entities (e-mail and IP addresses, card and phone numbers). Corpus
co-occurrence then tells how strongly a term of the same document reveals an entity: with
counts n(e), n(t) and n(e, t) of distinct texts among N, so that copies prove nothing, a term
discloses the share ``PMI(t; e) / IC(e) = ln(p(t | e) N / n(t)) / ln(N / n(e))`` of what naming
the entity would tell. ``p(t | e)`` is ``(n(e,t) + PRIOR n(t) / N) / (n(e) + PRIOR)``: as if
the entity stood in PRIOR more texts that hold the term as often as any text. A term whose
share exceeds a threshold is removed wherever it stands in a text that holds the entity, or
generalised if it exceeds a lower one.

A term is a run of letters, marks and digits, 3 to 40 of them, in lower case; shorter and longer
runs are no terms. Each of a text's terms is weighed against each of its entities.

Defined results: null text: as empty, no spans; very long texts are scanned whole, each
pattern in linear time, and matches are placed by running totals; equal rows give equal results;
a null id is an id; spans that overlap are cut out together; an empty table gives an empty one;
columns of other names are kept, whatever they are, and :func:`analysed` replaces ``base`` and
``spans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import bound, drop_table, write_table

# The kinds in order, with patterns that find the same matches as
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+     ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card [0-9]([\x20-]?[0-9])+ (14 digits or more)              phone \+[0-9][\x20().0-9-]+[0-9]
# but, by possessive repeats and a look behind, without trying every start in a run.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = r"[\p{L}\p{M}\p{N}]+"

#: Lengths of terms that count.
SHORTEST, LONGEST = 3, 40
#: Texts that a pair's estimate is smoothed by; shares at which a term is removed or generalised.
PRIOR, REMOVE, GENERALISE = 1.0, 0.8, 0.5


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda acc, i: acc + F.element_at(F.when(i % 2 == 1, F.array(*map(F.lit, range(10)))).otherwise(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))), F.substring(F.reverse(digits), i, F.lit(1)).cast("int") + 1),
    )
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.regexp_extract(p, "^0*([0-9]{0,3})$", 1).try_cast("int"), F.lit(0)) <= 255)
    if kind == "card":
        return F.length(_digits(m)).between(14, 19) & F.when(F.length(_digits(m)) <= 19, _luhn(_digits(m))).otherwise(False)
    return F.length(_digits(m)).between(10, 15) if kind == "phone" else F.lit(True)


_SPANS = "array<struct<start:int,k:int,end:int,value:string,at:int,to:int>>"
#: Beyond any place in a text.
_FAR = (1 << 31) - 1


def _none() -> Column:
    return F.expr(f"cast(array() as {_SPANS})")


#: Values that a fold appends to one array: appending copies the array.
_RUN = 64


def running(xs: Column, join) -> Column:
    """Running totals of an array of ints by ``join``, which leaves out nulls: folds of short runs, then of the runs' totals."""
    last = lambda acc: F.get(acc, F.size(acc) - 1)
    fold = lambda ys: F.aggregate(ys, F.expr("cast(array() as array<int>)"), lambda acc, x: F.array_append(acc, F.coalesce(join(x, last(acc)), x)))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _RUN).cast("int")), lambda i: fold(F.slice(xs, i * _RUN + 1, F.lit(_RUN))))
    moved = lambda rs: lambda before: F.transform(rs, lambda r, i: F.when(i == 0, r).otherwise(F.transform(r, lambda x: join(x, F.get(before, i - 1)))))
    whole = lambda rs: F.flatten(bound(fold(F.transform(rs, last)), moved(rs)))
    return F.when(F.size(xs) <= _RUN, fold(xs)).otherwise(bound(runs, whole))


def _matched(text: Column, pattern: str, of) -> Column:
    """Spans of all matches of a pattern: ``of(match, (start, end, first byte, end in bytes))``. Gaps between matches come from a split by the same pattern."""
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap"), F.octet_length(gap).alias("bytes")))
    total = lambda ps, gap, size: running(F.transform(ps, lambda x: x[gap] + size(x["m"])), lambda x, y: x + y)
    placed = lambda ps, ends, tos: F.transform(ps, lambda x, i: of(x["m"], (F.get(ends, i) - F.length(x["m"]), F.get(ends, i), F.get(tos, i) - F.octet_length(x["m"]), F.get(tos, i))))
    return bound(F.filter(pairs, lambda x: x["m"].isNotNull()), lambda ps: bound(total(ps, "gap", F.length), lambda ends: bound(total(ps, "bytes", F.octet_length), lambda tos: placed(ps, ends, tos))))


def _span(k: Column, value: Column, where: tuple) -> Column:
    return F.struct(where[0].alias("start"), k.alias("k"), where[1].alias("end"), value.alias("value"), where[2].alias("at"), where[3].alias("to"))


def _found(text: Column, kind: str) -> Column:
    """Spans of one kind."""
    pattern = F.lit(PATTERNS[kind])
    spans = F.filter(_matched(text, PATTERNS[kind], lambda m, where: _span(F.lit(KINDS.index(kind)), m, where)), lambda s: _valid(kind, s["value"]))
    may = F.rlike(text, pattern) if HINTS[kind] is None else F.contains(text, F.lit(HINTS[kind])) & F.rlike(text, pattern)
    return F.when(may, spans).otherwise(_none())


def base_spans(text: Column) -> Column:
    """Spans of all kinds by start, then kind; positions in code points, end exclusive."""
    return bound(F.coalesce(text, F.lit("")), lambda t: F.sort_array(F.concat(*[_found(t, k) for k in KINDS])))


def rendered(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    kinds = F.array(*[F.lit(k) for k in (*KINDS, "general", "remove")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _terms(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda w: F.length(w).between(SHORTEST, LONGEST))


def _occurrences(marked: DataFrame, known: DataFrame) -> DataFrame:
    """(text_key, terms): the spans in each text of its revealing terms, from (text_key, text) and (text_key, term, share). A text's words are rows that a running sum places and a join looks up."""
    parts = F.zip_with(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.split("text", TERM, -1), lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap"), F.octet_length(gap).alias("bytes")))
    words = marked.select("text_key", F.posexplode(F.filter(parts, lambda x: x["m"].isNotNull())).alias("i", "w"))
    upto = Window.partitionBy("text_key").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end, to = (F.sum(F.col(f"w.{gap}") + size("w.m")).over(upto).cast("int") for gap, size in (("gap", F.length), ("bytes", F.octet_length)))
    words = words.select("text_key", F.lower("w.m").alias("term"), F.length("w.m").alias("n"), F.octet_length("w.m").alias("b"), end.alias("end"), to.alias("to"))
    hits = words.join(known, ["text_key", "term"])
    kind = F.when(F.col("share") >= REMOVE, len(KINDS) + 1).otherwise(len(KINDS))
    span = _span(kind, F.lit(None).cast("string"), (F.col("end") - F.col("n"), F.col("end"), F.col("to") - F.col("b"), F.col("to")))
    return hits.groupBy("text_key").agg(F.collect_list(span).alias("terms"))


def _free(spans: Column, terms: Column) -> Column:
    """The spans of terms that stand outside ``spans``, in order of starts."""
    base = lambda s: s["k"] < len(KINDS)
    behind = lambda xs: running(F.transform(xs, lambda s: F.when(base(s), s["end"]).otherwise(0)), F.greatest)
    ahead = lambda xs: F.reverse(running(F.transform(F.reverse(xs), lambda s: F.when(base(s), s["start"]).otherwise(_FAR)), F.least))
    # in order of starts, a term is free if no span before it reaches into it and none begins within it
    free = lambda xs, ends, starts: F.transform(xs, lambda s, i: F.when(~base(s) & (F.coalesce(F.get(ends, i - 1), F.lit(0)) <= s["start"]) & (F.coalesce(F.get(starts, i + 1), F.lit(_FAR)) >= s["end"]), s))
    kept = lambda xs: bound(behind(xs), lambda ends: bound(ahead(xs), lambda starts: free(xs, ends, starts)))
    return F.filter(bound(F.sort_array(F.concat(spans, terms)), kept), lambda s: s.isNotNull())


def revealing(texts: DataFrame, marked: DataFrame) -> DataFrame:
    """(text_key, term, share): the terms of each text that disclose one of its entities by GENERALISE or more, with the largest share.

    ``texts``: (text_key, text), whose rows may repeat a text; ``marked``: (text_key, text, spans), the distinct texts that hold entities.
    """
    terms = lambda x: x.select("text_key", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    held = marked.select("text_key", F.explode(F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s["k"].cast("string"), F.lower(s["value"]))))).alias("entity"))
    # entities that stand in the same texts reveal and are revealed alike: they are counted as one, named by 128 bits of their texts
    sign = [F.bit_xor(F.xxhash64(F.lit(i), "text_key")).alias(f"e{i}") for i in (1, 2)]
    held = write_table(held, "entities")
    alike = held.groupBy("entity").agg(F.count("*").alias("n_e"), *sign)
    classes = held.join(alike, "entity").select("text_key", "e1", "e2", "n_e").distinct()
    counts = terms(texts.dropDuplicates(["text_key"])).groupBy("term").agg(F.count("*").alias("n_t"))
    n = F.lit(float(texts.select("text_key").distinct().count()))
    # as p(t | e) <= 1, no share reaches GENERALISE unless ln(N / n_t) >= GENERALISE ln(N / n_e): only such pairs are counted
    may = F.ln(n / F.col("n_t")) >= GENERALISE * F.ln(n / F.col("n_e")) - 1e-9
    pairs = terms(marked).join(counts, "term").join(classes, "text_key").where(may)
    pairs = write_table(pairs.select("text_key", "e1", "e2", "term", "n_e", "n_t"), "disclosures")
    chance = F.col("n_t") / n
    given = (F.col("n_et") + PRIOR * chance) / (F.col("n_e") + PRIOR)
    share = F.ln(given / chance) / F.ln(F.greatest(n / F.col("n_e"), F.lit(1.0 + 1e-9)))
    known = pairs.groupBy("e1", "e2", "term", "n_e", "n_t").agg(F.count("*").alias("n_et")).withColumn("share", share).where(F.col("share") >= GENERALISE)
    out = pairs.select("text_key", "e1", "e2", "term").join(known.select("e1", "e2", "term", "share"), ["e1", "e2", "term"])
    found = write_table(out.groupBy("text_key", "term").agg(F.max("share").alias("share")), "revealing")
    for used in (held, pairs):
        drop_table(used)
    return found


def analysed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with ``base`` (spans by pattern) and ``spans`` (all spans); keeps all other columns, and replaces those of these names and _base, _spans, _id, _key, _k."""
    docs = docs.drop("base", "spans", "_base", "_spans", "_id", "_key", "_k")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(text, F.length(text))
    # patterns are matched once, here; what follows reads the documents that hold entities, and each text counts once however many rows hold it
    rows = write_table(docs.select(F.col(id_col).alias("_id"), key.alias("text_key"), base_spans(F.col(text_col)).alias("spans"), text.alias("text")).where(F.size("spans") > 0), "marked")
    marked = rows.dropDuplicates(["text_key"]).select("text_key", "text", "spans")
    known = revealing(docs.select(key.alias("text_key"), text.alias("text")), marked)
    terms = _occurrences(marked.select("text_key", "text"), known)
    added = marked.select("text_key", "spans").join(terms, "text_key").select("text_key", _free(F.col("spans"), F.col("terms")).alias("added"))
    every = F.when(F.col("added").isNull(), F.col("spans")).otherwise(F.sort_array(F.concat("spans", "added")))
    found = rows.groupBy("_id", "text_key").agg(F.first("spans").alias("spans")).join(added, "text_key", "left").select("_id", F.col("text_key").alias("_key"), F.col("spans").alias("_base"), every.alias("_spans"))
    found = write_table(found, "spans")
    for used in (rows, known):
        drop_table(used)
    out = docs.withColumn("_k", key).join(found, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key")), "left")
    return out.withColumn("base", F.coalesce("_base", _none())).withColumn("spans", F.coalesce("_spans", _none())).drop("_id", "_key", "_k", "_base", "_spans")


def cleaned(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind's mark; revealing terms are removed or become a mark. ``spans`` are in order of starts; bytes are cut, which needs no walk from the text's start."""
    marks = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS], F.lit("<TERM>"), F.lit(""))
    ends = running(F.transform(spans, lambda s: s["to"]), F.greatest)
    cut = lambda raw, a, b: F.substring(raw, a + 1, F.greatest(b - a, F.lit(0))).cast("string")
    before = lambda tos, i: F.coalesce(F.get(tos, i - 1), F.lit(0))
    piece = lambda raw, tos: lambda s, i: F.concat(cut(raw, before(tos, i), s["at"]), F.when(s["to"] > before(tos, i), F.element_at(marks, s["k"] + 1)).otherwise(""))
    whole = lambda raw: bound(ends, lambda tos: F.concat(F.array_join(F.transform(spans, piece(raw, tos)), ""), cut(raw, F.element_at(tos, -1), F.octet_length(raw))))
    return F.when(F.size(spans) > 0, bound(text.cast("binary"), whole)).otherwise(text)


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with cleaned texts, and the same columns. A null text stays null."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column's name meets one of the analysis
    ids, texts = (names[docs.columns.index(c)] for c in (id_col, text_col))
    out = analysed(docs.toDF(*names), ids, texts).withColumn(texts, cleaned(F.col(texts), F.col("spans")))
    return out.select(*names).toDF(*docs.columns)
