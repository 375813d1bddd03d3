"""Disassembly listings: lines -> instructions -> functions, as window expressions over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions import bound
from weftgraph.sources.delimited import first_by_name, sampled

# The line formats of listings.
LINE = r"^.text:[0-9A-Fa-f]+\s+((?:[0-9A-Fa-f]{2}\s)+)\s+(\S+)(.*)$"
LINE_NO_DB = r"^.text:[0-9A-Fa-f]+\s+((?:[0-9A-Fa-f]{2}\s)+)(?!\s+[dD][bwdqtBWDTQ]\s+)\s+([a-zA-Z][a-zA-Z0-9]{1,12}(?!\s+[dD][bwdqtBWDTQ]\s+))(?:\s+(.*)|)$"
TWO_BYTE = r"^(0[Ff]\s+[0-9A-Fa-f]{2}).*$"
BEGIN = r"^.text:[0-9A-Fa-f]+\s+(sub_[0-9A-Fa-f]+)\s+proc\s+near.*$"
END = r"^.text:[0-9A-Fa-f]+\s+(sub_[0-9A-Fa-f]+)\s+endp.*$"
LABEL = r"^.text:[0-9A-Fa-f]+\s+(loc_[0-9A-Fa-f]+):\s+;\s+.*$"
LOCAL = r"^sub_[0-9A-Fa-f]+$"
POINTER = r"^\S+\s+ptr\s+\[?([^+\s]+).*$"
SEGMENT = r"^[CDEFGScdefgs]s:(\S+)$"
REGISTER = r"^\[?([EeRr][ABCDSabcds][IPXipx])(?:\+[0-9A-Fa-f]+h?)?\]?\s*$"
PROTOTYPE = r"^\s*(?:\w+\s+)*([^\s\(]+)\([^)]*\)$"
NEWLINE = r"\r\n|[\n\r\u2028\u2029\u0085]"
UNNAMED = "unamed_function_"


def lines(spark: SparkSession, path: str, suffix: str | None = ".asm", recursive: bool = False, limit: int | None = None, share: float = 1.0, seed: int = 0) -> DataFrame:
    """(binary, line_no, value): the files below ``path`` by suffix, in the first ``limit`` by name, or a share of them by a hash of the name."""
    files = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if suffix:
        files = files.option("pathGlobFilter", f"*{suffix}")
    whole = files.text(path, wholetext=True).select(binary_name(F.element_at(F.split(F.input_file_name(), "/"), -1)).alias("binary"), "value")
    if share < 1:
        whole = sampled(whole, "binary", share, seed)
    return split_lines(whole if limit is None else first_by_name(whole, "binary", limit))


def split_lines(whole: DataFrame) -> DataFrame:
    return whole.select("binary", F.posexplode(F.split("value", NEWLINE)).alias("line_no", "value"))


def binary_name(file: Column) -> Column:
    """A file's name without its last extension."""
    return F.regexp_replace(file, r"[.][^.]+$", "")


def parsed(value: Column, include_db: bool = True) -> Column:
    """struct(asm, opcode, operand) of a line, or null. The operand is the called name of a call."""
    pattern = LINE if include_db else LINE_NO_DB
    # one match gives all three groups
    groups = F.split(F.regexp_replace(value, pattern, "$1\x01$2\x01$3"), "\x01", 3)

    def of(g: Column) -> Column:
        raw, asm = g[0], g[1]
        two = F.regexp_extract(raw, TWO_BYTE, 1)
        opcode = F.when(two != "", two).otherwise(F.substring(raw, 1, 2))
        return F.struct(asm.alias("asm"), opcode.alias("opcode"), F.when(F.lower(asm) == "call", called_name(g[2])).alias("operand"))

    return F.when(F.rlike(value, F.lit(pattern)), bound(groups, of))


def called_name(text: Column) -> Column:
    """Name of the callee from operand and comment, or null for a register."""
    pick = lambda x, p, g=1: F.nullif(F.regexp_extract(x, p, g), F.lit(""))
    clean = lambda x: F.trim(F.translate(x, "\t", " "))
    register = lambda x: F.rlike(x, F.lit(REGISTER))

    def of(parts: Column) -> Column:
        operand, shown = parts["operand"], parts["shown"]
        pointed = F.transform(F.array(pick(operand, POINTER)), lambda p: F.when(p.isNotNull(), F.struct(F.when(~register(p), p).alias("name"))))[0]
        segment = pick(operand, SEGMENT)
        plain = F.when(pointed.isNotNull(), pointed["name"]).otherwise(F.coalesce(segment, F.when(~register(operand), operand)))
        told = F.coalesce(pick(shown, PROTOTYPE), pick(shown, r"^(\S+)$"))
        return F.when(operand == "", None).when(F.rlike(operand, F.lit(LOCAL)), operand).when(shown.isNotNull(), told).otherwise(plain)

    parts = F.struct(clean(F.regexp_extract(text, r"^([^;]*)", 1)).alias("operand"), F.when(F.rlike(text, F.lit(r"^[^;]*;\s+")), clean(F.regexp_extract(text, r"^[^;]*;\s+(.*)$", 1))).alias("shown"))
    return bound(parts, of)


def instructions(rows: DataFrame, include_db: bool = True) -> DataFrame:
    """(binary, line_no, asm, opcode, operand): one row for each line that holds an instruction."""
    return rows.withColumn("i", parsed(F.col("value"), include_db)).where("i is not null").select("binary", "line_no", "i.*")


def transactions(rows: DataFrame, mode: str = "asm", include_db: bool = True) -> DataFrame:
    """(binary, line_no, items): each instruction as a one-item set of its mnemonic or opcode."""
    return instructions(rows, include_db).select("binary", "line_no", F.array(F.col(mode)).alias("items"))


def marked(rows: DataFrame, include_db: bool = False) -> DataFrame:
    """Lines with the number of their function in the file.

    A start marker opens a function, and replaces an empty one; an end marker closes one that
    holds instructions and leaves an empty one open. Markers cut a file into islands, and a
    function that is open at a marker holds something exactly if the last island does.
    """
    pick = lambda p: F.nullif(F.regexp_extract("value", p, 1), F.lit(""))
    by = Window.partitionBy("binary").orderBy("line_no")
    x = rows.select("binary", "line_no", pick(BEGIN).alias("begin"), F.rlike("value", F.lit(END)).alias("end"), "value")
    x = x.withColumn("mark", F.col("begin").isNotNull() | F.col("end")).withColumn("island", F.sum(F.col("mark").cast("int")).over(by))
    x = x.withColumn("i", F.when(~F.col("mark"), parsed(F.col("value"), include_db))).withColumn("label", F.when(~F.col("mark") & F.col("i").isNull(), pick(LABEL)))
    x = x.drop("value").withColumn("has", F.max(F.col("i").isNotNull()).over(Window.partitionBy("binary", "island")))
    x = x.withColumn("first", F.row_number().over(by) == 1).withColumn("closes", F.col("mark") & F.coalesce(F.lag("has").over(by), F.lit(False)))
    return x.withColumn("fn", F.sum((F.col("first") | F.col("begin").isNotNull() | F.col("closes")).cast("int")).over(by))


def functions(rows: DataFrame, include_db: bool = False) -> DataFrame:
    """(binary, fn_id, name, aliases, called, instructions): functions in order; functions without instructions are none.

    A function without a start marker is numbered: 1 for the one that is open at first, and the
    next number whenever a line behind a closing marker opens one, even if it stays empty.
    """
    seq = lambda value: F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("line_no", value.alias("v"))))), lambda s: s["v"])
    f = marked(rows, include_db).groupBy("binary", "fn").agg(
        F.max("begin").alias("begin"), F.max("first").alias("first"), F.max(~F.col("mark")).alias("lines"),
        F.array_distinct(seq(F.col("label"))).alias("aliases"),
        seq(F.when(F.lower("i.asm") == "call", F.col("i.operand"))).alias("called"),
        seq(F.col("i")).alias("instructions"),
    )
    by = Window.partitionBy("binary").orderBy("fn")
    number = 1 + F.sum((F.col("begin").isNull() & ~F.col("first") & F.col("lines")).cast("int")).over(by)
    f = f.withColumn("name", F.coalesce("begin", F.concat(F.lit(UNNAMED), number.cast("string")))).where(F.size("instructions") > 0)
    return f.select("binary", (F.row_number().over(by) - 1).cast("int").alias("fn_id"), "name", "aliases", "called", "instructions")


def known_by(name: str) -> Column:
    """Predicate on functions: called ``name`` or has it as an alias."""
    return (F.col("name") == name) | F.array_contains("aliases", name)


def projected(fns: DataFrame, extraction: str = "both", mode: str = "asm") -> DataFrame:
    """Function columns by extraction mode: instruction, transaction or both."""
    items = F.transform("instructions", lambda i: F.array(i[mode])).alias("transactions")
    base = ["binary", "fn_id", "name", "aliases", "called"]
    return {"instruction": fns.select(*base, "instructions"), "transaction": fns.select(*base, items), "both": fns.select(*base, "instructions", items)}[extraction]


def record_sizes(fns: DataFrame) -> DataFrame:
    """(binary, fn_id, aliases, called, instructions, empty): sizes of a function's lists, 0 where one is unset."""
    n = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)) if c in fns.columns else F.lit(0)
    return fns.select("binary", "fn_id", n("aliases").alias("aliases"), n("called").alias("called"), n("instructions").alias("instructions"), (n("instructions") + n("transactions") == 0).alias("empty"))
