"""Session helpers: reading tables, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a scale directory."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, shared by all executors.

    It is the cluster's ``spark.checkpoint.dir``.  Only where the session has
    none, as in local tests, a folder of our own is set.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder shared by all executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


SMALL_BYTES = 4 << 20


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    spread: list[str],
    how: str = "inner",
    hot_rows: int = 200_000,
    small_bytes: int = SMALL_BYTES,
) -> DataFrame:
    """Join many ``left`` rows to few ``right`` rows per key (best one), hot keys split.

    Keys with more than ``hot_rows`` left rows are counted first (partial
    aggregation), spread over ``ceil(rows / hot_rows)`` salts by a hash of the
    ``spread`` columns, and their right rows are repeated per salt.  The
    broadcast list of hot keys has at most ``rows / hot_rows`` entries.
    Null keys match nothing; ``how`` is inner, left,
    left_semi or left_anti.  A left side
    that Catalyst estimates below ``SMALL_BYTES`` has no key worth splitting
    and is joined as it is.
    """
    if estimated_bytes(left) < small_bytes:
        return left.join(right, on, how)
    hot = (
        left.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("__lookup_rows"))
        .where(F.col("__lookup_rows") > hot_rows)
        .select(*on, F.ceil(F.col("__lookup_rows") / hot_rows).cast("int").alias("__lookup_salts"))
    )
    hot = F.broadcast(hot)
    one = F.coalesce(F.col("__lookup_salts"), F.lit(1))
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on])
    salts = F.when(null_key, F.lit(1 << 16)).otherwise(one)  # null keys meet nothing, wherever they go
    many = (
        left.join(hot, on, "left")
        .withColumn("__lookup_salt", F.pmod(F.xxhash64(*spread), salts).cast("int"))
        .drop("__lookup_salts")
    )
    few = (
        right.join(hot, on, "left")
        .withColumn("__lookup_salt", F.explode(F.sequence(F.lit(0), one - 1)))
        .drop("__lookup_salts")
    )
    return many.join(few, [*on, "__lookup_salt"], how).drop("__lookup_salt")


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's upper estimate of the size of a plan's result."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit_bytes: int = 8 << 20) -> DataFrame:
    """Hint a broadcast only if the plan's estimate is under the limit.

    Beyond it no hint is given, and Spark joins by shuffle.
    """
    return F.broadcast(df) if estimated_bytes(df) <= limit_bytes else df
