"""Corpus pipeline: drop toxic documents, keep one of each group of near-duplicates, sanitise personal data, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns
of ``documents``. ``run`` writes each stage as Parquet to the shared folder and reads it again.

Defined results: a document with a null or an empty text isn't toxic without evidence, has no
near-duplicates and no personal data, and a size of 0: the mix takes it as often as demand passes
its place; null ids, sources and languages are values like others; of rows that are near-duplicates
of each other one stays, the first by id, then by a hash of the text, so that of equal rows with a
shingle one stays; rows that share an id but no text are documents of their own in every stage;
very long texts are read whole; an empty table gives an empty one; columns beyond those of
``documents`` are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, mixing, pii, setsketch, toxicity
from weftgraph.llm.common import bounded, table, write_table
from weftgraph.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Hundredths of similarity from which documents are near-duplicates.
LINK = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), held_fold=0)
    return toxicity.accepted(docs.select(*COLUMNS), model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return setsketch.unique(docs.select(*COLUMNS), link=LINK)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitised(docs.select(*COLUMNS)).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy that the mix takes of a document, range-sorted by the copy's own training position. Rows with an id in common have places of their own; equal rows are one text with as many places."""
    rows = docs.select(*COLUMNS).withColumns(mixing.row_key(*COLUMNS))
    taken = mixing.assign(rows, keep=mixing.KEY).where("copies > 0").select(*mixing.KEY, "copies", "offset", "source_size", "rank", "last_rank", "target")
    # texts are dealt by key once: for equal rows, and for the join
    return mixing.mixed(rows.dropDuplicates(list(mixing.KEY)).join(taken, list(mixing.KEY))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return bpe.digests(docs, vocabulary())


STAGES = [("toxicity", drop_toxic), ("near-duplicates", drop_near_duplicates), ("personal data", sanitise), ("mixing", mix), ("encoding", encode)]

#: The stages train a classifier, sketch and tokenize, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
