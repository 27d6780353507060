"""Rankings that arrive in files are folded into the latest row of each job and resume, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

KEYS, VERSION = ("job_id", "resume_id"), ("scored_at", "loaded_at", "ranking_id")


def fold(known: DataFrame | None, arrived: DataFrame) -> DataFrame:
    """The row of the highest version for each key, of what is known and what arrived."""
    rows = arrived if known is None else known.unionByName(arrived)
    rest = [c for c in arrived.columns if c not in (*KEYS, *VERSION)]
    top = rows.groupBy(*KEYS).agg(F.max(F.struct(*VERSION, F.struct(*rest).alias("rest"))).alias("t"))
    return top.select(*KEYS, *[F.col(f"t.{c}").alias(c) for c in VERSION], *[F.col(f"t.rest.{c}").alias(c) for c in rest])


def _folders(spark: SparkSession, target: str) -> dict[str, list[int]]:
    """The numbers of the finished ``delta-n`` and ``base-n`` folders of a target."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"delta": [], "base": []}
    for status in fs.listStatus(path) if fs.exists(path) else []:
        kind, _, n = status.getPath().getName().partition("-")
        if kind in found and n.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found[kind].append(int(n))
    return {k: sorted(v) for k, v in found.items()}


def current(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The folded table: the newest base and the batches after it (of the batches before ``before``, if given); None if nothing has arrived."""
    known = _folders(spark, target)
    base = max((n for n in known["base"] if before is None or n < before), default=None)
    paths = [f"{target}/base-{base}"] if base is not None else []
    paths += [f"{target}/delta-{n}" for n in known["delta"] if (base is None or n > base) and (before is None or n < before)]
    return fold(None, spark.read.parquet(*paths)) if paths else None


def run(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, compact: int = 16):
    """A query that adds each batch, folded, to ``target``; ``current`` reads the whole. ``target`` and ``checkpoint`` are shared folders.

    A batch writes its own rows alone. Every ``compact`` batches all of it is
    folded into a new base, after which what came before the last base goes.
    Folders are numbered by batch, so a batch that is run again after a failure
    writes the same folders again.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, n: int) -> None:
        fold(None, batch).write.mode("overwrite").parquet(f"{target}/delta-{n}")
        if n % compact == compact - 1:
            older = _folders(spark, target)
            current(spark, target, n + 1).write.mode("overwrite").parquet(f"{target}/base-{n}")
            last = max((b for b in older["base"] if b < n), default=-1)
            for kind, numbers in older.items():
                for old in (x for x in numbers if x < last or (kind == "delta" and x <= last)):
                    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{kind}-{old}")
                    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by kind and hour, with late rows allowed for; for a stream or a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
