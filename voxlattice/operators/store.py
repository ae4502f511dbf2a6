"""Tables written between the steps of a job: they cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a folder of its own; on a cluster that is an error.
    """
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='voxlattice-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def write(df: DataFrame) -> DataFrame:
    path = f"{folder(df.sparkSession)}/grid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of `write` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for place in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if not re.search(r"/grid-[0-9a-f]{32}$", place):
                raise ValueError(f"{place} was not written here")
            path = jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
