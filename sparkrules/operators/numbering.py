"""Consecutive numbers in a given order without bringing the rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ensure_checkpoint_dir(spark) -> None:
    """Use the cluster's shared folder; set one of our own only in local mode, where none is set."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            where = tempfile.mkdtemp(prefix="sparkrules-")
        spark.sparkContext.setCheckpointDir(where)


def numbered(df: DataFrame, order: list, name: str, start: int = 0) -> tuple[DataFrame, int]:
    """``df`` with 0-based numbers from ``start``, by range partitions; also the count.  Materialised, so numbers are stable."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    part, inner = f"{name}__p", f"{name}__i"
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    spread = spread.withColumn(part, F.spark_partition_id()).withColumn(inner, F.monotonically_increasing_id() % F.lit(1 << 33))
    spread = spread.checkpoint()
    # one row for each partition
    sizes = sorted((r[part], r["count"]) for r in spread.groupBy(part).count().collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, start + total))
        total += n
    if not offsets:
        return spread.withColumn(name, F.lit(0).cast("bigint")).drop(part, inner), 0
    schema = T.StructType([T.StructField("p", T.IntegerType()), T.StructField("o", T.LongType())])
    table = F.broadcast(spark.createDataFrame(offsets, schema))
    out = spread.join(table, F.col(part) == F.col("p")).withColumn(name, F.col("o") + F.col(inner))
    return out.drop(part, inner, "p", "o"), total
