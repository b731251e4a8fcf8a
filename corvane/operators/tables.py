"""Tables in the folder all executors share, global numbering, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ways that a join splits the rows of one label.
SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where it names none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """df written in the shared folder and read back: this cuts the lineage and outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*settled: DataFrame) -> None:
    """Delete tables that settle wrote and nothing reads any more."""
    for df in settled:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with name, the place of each row in the order of key, from 1; parts are ranked side by side.

    Only one number for each part is gathered, whatever the number of rows.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism
    part = settle(df.repartitionByRange(parts, key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return part.withColumn("_own", own).join(F.broadcast(before), F.col("_part") == F.col("_of")).withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_own", "_of", "_before")


def salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes of edges (a, b), of any ordered type: the least id that is reachable.

    Each round takes the least label of a node and its neighbours, then that label's
    own label, so rounds grow with the logarithm of the longest path.  A common label
    is no hot key: labels are looked up once each and handed back by salted rows.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = settle(both, "edges")
    labels = settle(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("least"))
        moved = settle(labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "least").alias("now")), "moved")
        jump = moved.select("now").distinct().join(labels.select(F.col("id").alias("now"), F.col("label").alias("further")), "now")
        jump = jump.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        label = F.least("now", "further")
        new = settle(moved.withColumn("_salt", salt("id")).join(jump, ["now", "_salt"]).select("id", label.alias("label"), (label != F.col("was")).alias("changed")), "labels")
        discard(labels, moved)
        labels = new
        if labels.where("changed").isEmpty():
            discard(both)
            return labels.select("id", F.col("label").alias("component"))
