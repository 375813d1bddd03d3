"""Session factory and the shared folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession


T = TypeVar("T")


def get_session(app: str = "weftgraph", cores: int | str = "*", memory: str | None = None, shuffle: int | None = None) -> SparkSession:
    """A local session for tests and benches. On a cluster, settings given to spark-submit hold."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.adaptive.enabled", "true")
    if "SPARK_MASTER" not in os.environ:
        b = b.master(f"local[{cores}]")
    if memory:
        b = b.config("spark.driver.memory", memory)
    if shuffle:
        b = b.config("spark.sql.shuffle.partitions", shuffle)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``, or a private one where it is unset and the session is local."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("weftgraph.local.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + (own := tempfile.mkdtemp(prefix="weftgraph-"))
        spark.conf.set("weftgraph.local.dir", path)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/weftgraph/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: ends a loop's lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def concurrently(jobs: dict[str, Callable[[], T]], most: int = 4) -> dict[str, T]:
    """Results of jobs by name, at most so many submitted at a time, after all have ended; Spark's scheduler shares the cluster among them."""
    with ThreadPoolExecutor(most) as pool:
        running = {name: pool.submit(job) for name, job in jobs.items()}
    return {name: x.result() for name, x in running.items()}


def drop_path(spark: SparkSession, folder: str) -> None:
    """Delete a folder made by :func:`new_path`; any other is refused."""
    if not re.search(r"/weftgraph/[^/]+-[0-9a-f]{32}$", folder):
        raise ValueError(f"{folder} holds no table of a step")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files under a table from :func:`cut` that nothing reads any more; no other file is touched."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, folder)
