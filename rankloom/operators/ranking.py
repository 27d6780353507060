"""Sequential ranks over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut


def ranked(rows: DataFrame, order: list[Column], group: str | None = None, name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Adds each row's position 1..n in its group by ``order`` (a total order), without one task per group.

    Rows are range-sorted by (group, order); a row's rank is its place within
    its partition plus the rows of its group in earlier partitions. The counts
    are one row a partition and group.
    """
    keys = [F.col(group).asc(), *order] if group else order
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    g = [group] if group else []
    counts = placed.groupBy("_part", *g).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*g).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("_part").alias("_p"), "_first", before.alias("_before"), *[F.col(c).alias("_g") for c in g])
    on = (placed["_part"] == offsets["_p"]) & (placed[group].eqNullSafe(offsets["_g"]) if group else F.lit(True))
    out = placed.join(offsets, on).withColumn(name, (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("int"))
    return out.drop("_at", "_part", "_p", "_g", "_first", "_before")
