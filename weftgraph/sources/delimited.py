"""Attribute schemas, delimited instances, transactions, labels, vocabularies, distance tables and raw bytes."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITER = r"[\s|,]+"


@dataclass(frozen=True)
class Attribute:
    """name, kind (discrete, continuous or ID) and, if discrete, its values."""

    name: str
    kind: str
    values: tuple[str, ...] = ()

    @property
    def sql(self) -> str:
        return "double" if self.kind == "continuous" else "string"


def attributes(lines: list[str]) -> list[Attribute]:
    """Attributes from lines ``name: continuous``, ``name: ID`` or ``name: v1 v2 ...``; blank lines are skipped."""
    out = []
    for line in lines:
        name, colon, rest = line.partition(":")
        if not colon or not (words := rest.split()):
            continue
        kind = words[0].rstrip(".") if len(words) == 1 else ""
        out.append(Attribute(name.strip(), kind) if kind in ("continuous", "ID") else Attribute(name.strip(), "discrete", tuple(w.rstrip(".") for w in words)))
    return out


def read_attributes(spark: SparkSession, path: str) -> list[Attribute]:
    """A schema file: a few lines, read on the driver."""
    return attributes(spark.read.text(path, wholetext=True).first()["value"].splitlines())


def instances(rows: DataFrame, attrs: list[Attribute], labelled: bool = True, header: bool = False, delimiter: str = DELIMITER) -> DataFrame:
    """Typed columns, and ``label`` from the last column, from text rows ``value``; rows that are too short are dropped."""
    parts = F.split(F.trim("value"), delimiter)
    need = len(attrs) + labelled
    x = rows.select(parts.alias("p")).where(F.size("p") >= need)
    if header:
        x = x.where(~F.forall(F.zip_with(F.slice("p", 1, len(attrs)), F.array(*[F.lit(a.name) for a in attrs]), lambda a, b: a.eqNullSafe(b)), lambda e: e))
    cols = [F.get("p", i).try_cast(a.sql).alias(a.name, metadata={"kind": a.kind, "values": list(a.values)}) for i, a in enumerate(attrs)]
    return x.select(*cols, *([F.element_at("p", -1).alias("label")] if labelled else []))


def transaction_rows(rows: DataFrame, attrs: list[Attribute], delimiter: str = DELIMITER) -> DataFrame:
    return instances(rows, attrs, labelled=False, delimiter=delimiter)


def itemset(attrs: list[Attribute], one: str = "1"):
    """Names of the attributes whose value is ``one``, as a sorted array."""
    return F.array_sort(F.filter(F.array(*[F.when(F.col(a.name).cast("string") == one, F.lit(a.name)) for a in attrs]), lambda x: x.isNotNull()))


def masked_equal(left: str, right: str, names: list[str], mask: set[int]):
    """Equality of two aliased rows on the attributes that the mask doesn't hide."""
    out = F.lit(True)
    for i, n in enumerate(names):
        if i not in mask:
            out = out & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return out


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, class) from CSV files with a header and quoted ids; of an id's rows the last one counts, files in order of their names."""
    raw = spark.read.option("header", True).option("sep", "\x01").option("quote", "").schema("value string").csv(path)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = raw.select(at.alias("at"), F.split("value", ",").alias("p")).where(F.size("p") == 2)
    rows = rows.select("at", F.expr("substring(p[0], 2, length(p[0]) - 2)").alias("id"), F.trim(F.col("p")[1]).alias("class"))
    return rows.groupBy("id").agg(F.max_by("class", "at").alias("class"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(ngram, idx) without a header; quoted n-grams can hold blanks and commas."""
    return spark.read.csv(path, schema="ngram string, idx int", ignoreLeadingWhiteSpace=True)


def distances(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(id1, id2, d); rows whose third value is no number, such as a header, are dropped."""
    raw = spark.read.csv(path, sep=delimiter, schema="id1 string, id2 string, d string", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return raw.withColumn("d", F.col("d").try_cast("double")).where("d is not null")


def distance_piece(path: str, delimiter: str = ",") -> pa.Table:
    """As :func:`distances`, of a task's own file with a header."""
    names = ["id1", "id2", "d"]
    read = pyarrow.csv.ReadOptions(column_names=names, skip_rows=1, use_threads=False)
    kinds = pyarrow.csv.ConvertOptions(column_types={"id1": pa.string(), "id2": pa.string(), "d": pa.float64()}, null_values=[""])
    return pyarrow.csv.read_csv(path, read, pyarrow.csv.ParseOptions(delimiter=delimiter), kinds)


def comparison_piece(path: str) -> pa.Table:
    """The rows of a task's own comparison file with a header, as texts."""
    names = ["class1", "class2", "edit", "other"]
    read = pyarrow.csv.ReadOptions(column_names=names, skip_rows=1, use_threads=False)
    kinds = pyarrow.csv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), null_values=[""], strings_can_be_null=True)
    return pyarrow.csv.read_csv(path, read, pyarrow.csv.ParseOptions(newlines_in_values=True), kinds)


def files(spark: SparkSession, path: str, suffix: str | None = None, recursive: bool = False) -> DataFrame:
    """(name, bytes): the files in a folder by suffix, all without one, and those below it if ``recursive``; contents aren't read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if suffix:
        r = r.option("pathGlobFilter", f"*{suffix}")
    return r.load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))


def entries(spark: SparkSession, path: str, suffix: str | None = None) -> DataFrame:
    """(name, bytes): what lies in a folder, each file by itself and the files below each sub-folder together under the sub-folder's name, with the fewest bytes that one of them has; only files with the suffix, all without one."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if suffix:
        r = r.option("pathGlobFilter", f"*{suffix}")
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    above = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/")
    name = F.get(F.split(F.substring("path", len(above) + 2, 2**31 - 1), "/"), 0)
    return r.load(path).groupBy(name.alias("name")).agg(F.min("length").alias("bytes"))


def raw_bytes(spark: SparkSession, path: str, suffix: str | None = None, recursive: bool = False) -> DataFrame:
    """(binary, content): one row a file."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if suffix:
        r = r.option("pathGlobFilter", f"*{suffix}")
    return r.load(path).select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"[.][^.]+$", "").alias("binary"), "content")


def sampled(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """Rows whose key's hash falls into a share of the range: the same for any partitioning."""
    return df.where(F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(1_000_000)) < int(round(share * 1_000_000)))


def first_by_name(df: DataFrame, name: str, n: int) -> DataFrame:
    """The first n distinct names' rows, exactly n; all if n is below 0."""
    return df if n < 0 else df.join(F.broadcast(df.select(name).distinct().orderBy(name).limit(n)), name)
