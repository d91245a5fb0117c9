"""Helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut_lineage


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing column(s) {missing}; found {df.columns}")
    return df


def arg_min(value: Column, *order: Column) -> Column:
    """Value of the row with the smallest order tuple; partial aggregation keeps one row per map task and group."""
    return F.min_by(value, F.struct(*order))


def arg_max(value: Column, *order: Column) -> Column:
    return F.max_by(value, F.struct(*order))


def prefer(cond: Column) -> Column:
    """Sort key that puts rows meeting the condition first."""
    return F.when(cond, F.lit(0)).otherwise(F.lit(1))


PER_TASK = 250_000  # rows of a large input that one task takes


def dealt(df: DataFrame, *keys: str, by: DataFrame | None = None) -> DataFrame:
    """Rows read from files, dealt by key to a number of tasks that grows with them (or with those of `by`), so what a task holds does not.

    Steps by the same key follow that number. Input that every core gets only a part of a task of is left as it is. Counting takes no
    more than the footers of the files.
    """
    spark = df.sparkSession
    n = -(-(df if by is None else by).count() // PER_TASK)
    if n <= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def global_number(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """1-based row number over a total order without a single-task window.

    The sorted frame is written once; each partition then needs only the count of the partitions before it, a table with
    one row per partition.
    """
    tagged = cut_lineage(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    tagged = tagged.withColumn("_pid", F.shiftright("_mid", 33))
    sizes = tagged.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid"), 33)
    return (
        tagged.join(F.broadcast(offsets), "_pid")
        .withColumn(name, (local + F.col("_off") + 1).cast("bigint"))
        .drop("_mid", "_pid", "_off")
    )


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Row number restarting at 1 for each key, again without gathering a key in one task."""
    out = global_number(df, [F.col(k).asc() for k in keys] + list(order), "_g")
    first = out.groupBy(*keys).agg(F.min("_g").alias("_nw_first"))
    return out.join(first, list(keys)).withColumn(name, F.col("_g") - F.col("_nw_first") + 1).drop("_g", "_nw_first")
