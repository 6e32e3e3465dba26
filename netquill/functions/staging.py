"""Tables written to the shared folder, and rows numbered in order by way of one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts the lineage: when an executor is lost, later stages reread the table.
    """
    return df.sparkSession.read.schema(df.schema).parquet(staged_path(df, name))


def staged_path(df: DataFrame, name: str) -> str:
    """Write df to the shared folder; returns the path of the table."""
    path = f"{shared_folder(df.sparkSession)}/netquill/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def placed(rows: DataFrame, order: list[str], name: str, ranges: int | None = None) -> DataFrame:
    """rows with name: the place from 0 in this order, which should have no ties.

    No task sorts all rows: they are dealt by ranges of the order, whose counts are summed up
    to offsets, and a window ranks rows inside one range. Ranges come from a sample, so the
    rows are written with theirs once and counts and ranks cannot disagree.
    """
    dealt = rows.repartitionByRange(*([ranges] if ranges else []), *order)
    dealt = staged(dealt.withColumn("nq_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("nq_range").agg(F.count("*").alias("n_here"))
    up_to = Window.orderBy("nq_range").rowsBetween(Window.unboundedPreceding, 0)
    below = counts.select("nq_range", (F.sum("n_here").over(up_to) - F.col("n_here")).alias("nq_below"))
    ranked = dealt.withColumn("nq_rank", F.row_number().over(Window.partitionBy("nq_range").orderBy(*order)))
    return ranked.join(F.broadcast(below), "nq_range").withColumn(name, F.col("nq_rank") + F.col("nq_below") - 1).drop("nq_range", "nq_rank", "nq_below")
