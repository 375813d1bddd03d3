"""Dense numbers in an order, without passing all rows through one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.session import cut


def numbered(rows: DataFrame, *order: str | Column, name: str = "idx") -> DataFrame:
    """The rows with an int column from 0 in a total order: rows are dealt by ranges of the order, and only the ranges' sizes, a row for each partition, reach the driver."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumns({"_part": F.spark_partition_id(), "_pos": F.monotonically_increasing_id()}), "numbered")
    sizes = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())
    starts = rows.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, accumulate((n for _, n in sizes), initial=0), strict=False)], "_part int, _start long")
    place = F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy("_pos")) - 1
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, place.cast("int")).drop("_part", "_pos", "_start")
