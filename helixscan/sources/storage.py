"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder.

    The cluster names the folder in ``spark.checkpoint.dir``.  Where that is unset, a local session
    (as in tests) gets a temporary folder and a cluster the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        root = tempfile.mkdtemp(prefix="helixscan-") if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/helixscan/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and safe from lost executors."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` with its rows' places (from 0) in ``order``, as a written table.

    A distributed sort puts rows into ranges; the number of rows before a range, one number for each
    partition, goes to all tasks."""
    at = F.monotonically_increasing_id()
    table = written(df.orderBy(*order).withColumn("_at", at), "sorted").withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = table.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return table.join(F.broadcast(before), "_range").select(*df.columns, (F.col("_before") + F.col("_at")).cast("long").alias(name))
