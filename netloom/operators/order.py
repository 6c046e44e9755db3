"""Row numbers in a total order, without a task that holds a whole group.

Rows are dealt out by ranges of the order and numbered there; a group's numbers before a range are a sum over its
ranges, a row each. So a group, or the whole table, may be of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.session import scratch


def numbered(rows: DataFrame, keys: list[str], order: list[str], out: str = "number", total: str | None = None) -> DataFrame:
    """Adds out: the place (from 1) of a row within its keys, by the columns of order (which should tell rows apart); total: how many rows its keys have."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "ranges")
    # Ranges are fixed once written, so that both uses see the same ones.
    rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    inner = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))
    sizes = ranged.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))  # a row a range
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", F.sum("_n").over(w)).drop("_n")
    same = F.col("r._part") == F.col("b._part")
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = ranged.withColumn("_inner", inner).alias("r").join(before.alias("b"), same)
    named = [F.col(f"r.{c}") for c in rows.columns] + [(F.col("_inner") + F.col("_before")).alias(out)] + ([F.col("_total").alias(total)] if total else [])
    return joined.select(*named)
