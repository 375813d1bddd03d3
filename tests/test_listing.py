"""Listings against a brute force over the pieces between markers, and the fixtures of FIXTURES.md."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weftgraph.plans import programs
from weftgraph.sources import listing

HEAD = ".text:00401000 "


def cut_at_markers(lines, include_db=False):
    """Functions of a listing: (name, aliases, instructions). The list is cut at its markers, and each piece is judged by itself.

    A piece goes to a new function if its marker begins one, or if the piece before held an
    instruction: that closed a function, whatever its marker. Else it goes on with the open one.
    """
    pattern = re.compile(listing.LINE if include_db else listing.LINE_NO_DB)
    at = [i for i, x in enumerate(lines) if re.match(listing.BEGIN, x) or re.match(listing.END, x)]
    pieces = [lines[a:b] for a, b in zip([0, *at], [*at, len(lines)], strict=True)]
    pieces = pieces[1:] if not pieces[0] else pieces
    code = [[bool(pattern.match(x)) for x in p] for p in pieces]
    heads = [re.match(listing.BEGIN, p[0]) for p in pieces]
    marked = [bool(at) and (i > 0 or at[0] == 0) for i in range(len(pieces))]
    new = [i == 0 or bool(heads[i]) or any(code[i - 1]) for i in range(len(pieces))]
    groups = [[j for j in range(i, len(pieces)) if sum(new[: j + 1]) == sum(new[: i + 1])] for i in range(len(pieces)) if new[i]]
    out, number = [], 1
    for g in groups:
        body = [(x, c) for j in g for x, c in zip(pieces[j][marked[j] :], code[j][marked[j] :], strict=True)]
        number += not heads[g[0]] and g[0] > 0 and bool(body)
        labels = [m[1] for x, c in body if not c and (m := re.match(listing.LABEL, x))]
        if any(c for _, c in body):
            out.append((heads[g[0]][1] if heads[g[0]] else f"unamed_function_{number}", ",".join(dict.fromkeys(labels)), str(sum(c for _, c in body))))
    return out


def test_functions_equal_pieces_between_markers(spark):
    rng = random.Random(5)
    kinds = ["sub_{:X} proc near", "sub_{:X} endp", "loc_{:X}: ; CODE XREF", "8B 44 \t mov eax, [esp]", "; nothing", "12 \t db 12h"]
    files = {f"f{k}": [HEAD + rng.choices(kinds, [2, 2, 1, 3, 2, 1])[0].format(rng.randrange(16)) for _ in range(rng.randrange(1, 60))] for k in range(40)}
    rows = spark.createDataFrame([(k, i, v) for k, ls in files.items() for i, v in enumerate(ls)], "binary string, line_no int, value string")
    got = {}
    for r in listing.functions(rows).orderBy("binary", "fn_id").collect():
        got.setdefault(r.binary, []).append((r.name, ",".join(r.aliases), str(len(r.instructions))))
    assert got == {k: m for k, ls in files.items() if (m := cut_at_markers(ls))}
    again = listing.functions(rows.repartition(1)).count()
    assert again == sum(map(len, got.values()))


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("    near ptr  VersionOfUpdateOrPlatform+1", "VersionOfUpdateOrPlatform"), ("    dword ptr [ebp+8]", None), ("    sub_4587A3DE", "sub_4587A3DE"), ("    ds:GetCurrentThreadId", "GetCurrentThreadId"),
        ("    eax", None), ("    [eax+1]", None), ("    ??0exception@std@@QAE@ABQBD@Z ; std::exception::exception(char const * const &)", "std::exception::exception"),
        ("    esi ; GetProcAddress", "GetProcAddress"), ("    _memcpy_s", "_memcpy_s"), ("    ??2@YAPAXI@Z ; operator new(uint)", "new"),
    ],
)
def test_called_names(spark, text, name):
    assert spark.range(1).select(listing.called_name(F.lit(text))).first()[0] == name


@pytest.mark.parametrize(
    ("body", "db", "asm", "opcode"),
    [
        ("8B 44 24 10 \t mov     eax, [esp+10h]", True, "mov", "8B"), ("50 \t push    eax", False, "push", "50"), ("sub_401 proc near", True, None, None), ("E8 74 1A 00 00 \t call    sub_1", False, "call", "E8"),
        ("0F 95 C1 \t setnz   cl", False, "setnz", "0F 95"), ("90 \t nop", False, "nop", "90"), ("12 \t db 12h", True, "db", "12"), ("12 \t db 12h", False, None, None), ("8B FF \t word_1 db 2 dup(0)", False, None, None),
    ],
)
def test_instruction_lines(spark, body, db, asm, opcode):
    got = spark.range(1).select(listing.parsed(F.lit(HEAD + body), db).alias("i")).first()["i"]
    assert (got and (got.asm, got.opcode)) == (asm and (asm, opcode))


def test_files_to_call_graphs(spark, tmp_path):
    (tmp_path / "a.asm").write_text("\r\n".join([HEAD + "sub_1 proc near", HEAD + "E8 00 \t call    sub_2", HEAD + "sub_1 endp", HEAD + "sub_2 proc near", HEAD + "90 \t nop", HEAD + "E8 01 \t call    ds:Api", HEAD + "sub_2 endp"]))
    (tmp_path / "b.txt").write_text("no listing")
    v, e = programs.extract_call_graphs(programs.scan(spark, str(tmp_path)), "minhash")
    assert [(r.id, r.name, r.type) for r in v.orderBy("id").collect()] == [(0, "sub_1", "Internal"), (1, "sub_2", "Internal"), (2, "Api", "External")]
    assert sorted((r.src, r.dst) for r in e.collect()) == [(0, 1), (1, 2)]
    for kind in ("cosine", "jaccard", "lshcosine", "new_jaccard", "inst"):
        assert programs.extract_call_graphs(programs.scan(spark, str(tmp_path), limit=1, share=1.0), kind)[0].count() == 3


def test_stream_of_listings(spark, tmp_path):
    from weftgraph.streaming import listing_stream, stream_call_graphs

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"f{k}.asm").write_text("\n".join([HEAD + "sub_1 proc near", HEAD + "90 \t nop", HEAD + "sub_1 endp"]))
    q = stream_call_graphs(listing_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/vertices")).select("graph").distinct().count() == 3
