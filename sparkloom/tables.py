"""Tables that are written to the cluster's shared folder and read back."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it names none: on one machine a temporary folder, on a cluster one
    in the warehouse, which all of its machines share."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        own = tempfile.mkdtemp(prefix="sparkloom-") if sc.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        sc.setCheckpointDir(named or own)
    return named or sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: losing an executor loses nothing, lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with the place of each row, from 0: those of a part follow those of the parts before it, by exact counts."""
    rows = durable(df).withColumns({"__m": F.monotonically_increasing_id(), "__p": F.spark_partition_id()})
    starts = rows.groupBy("__p").agg(F.min("__m").alias("__f"), F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    starts = starts.select("__p", "__f", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    return rows.join(F.broadcast(starts), "__p").withColumn(name, F.col("__s") + F.col("__m") - F.col("__f")).drop("__m", "__p", "__f", "__s")
