"""Streaming ingestion: a listing file is self-contained, so a stream of files is a stream of call graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.plans import programs
from weftgraph.sources import listing


def listing_stream(spark: SparkSession, path: str, suffix: str = ".asm", files_per_batch: int = 1000) -> DataFrame:
    """(binary, value): whole files as they arrive in a folder."""
    s = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", f"*{suffix}").option("maxFilesPerTrigger", files_per_batch).load(path)
    return s.select(listing.binary_name(F.element_at(F.split(F.input_file_name(), "/"), -1)).alias("binary"), "value")


def stream_call_graphs(source: DataFrame, out: str, checkpoint: str, kind: str = "minhash", **options) -> StreamingQuery:
    """Write each micro-batch's vertices and edges below ``out``, in a folder for each batch, so that a batch that runs again overwrites itself."""

    def each(batch: DataFrame, epoch: int) -> None:
        v, e = programs.extract_call_graphs(listing.split_lines(batch), kind, **options)
        v.write.mode("overwrite").parquet(f"{out}/vertices/epoch={epoch}")
        e.write.mode("overwrite").parquet(f"{out}/edges/epoch={epoch}")

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
