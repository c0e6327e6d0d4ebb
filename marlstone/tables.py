"""Tables by name under one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def state(spark: SparkSession, directory: str, *names: str) -> tuple:
    """Size and time of change of tables' files: equal as long as what was made from them holds."""
    out = []
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{directory}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        out.append((name, fs.getContentSummary(path).getLength(), fs.getFileStatus(path).getModificationTime()))
    return tuple(out)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")
