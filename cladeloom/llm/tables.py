"""Shared helpers: reading a table, cutting lineage through a written table, and sizes that follow the data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeloom.session import scratch_path

FILTER_BITS = 1 << 26  # of the bitmap (8 MB) that spares rows without a partner a shuffle
_PAGE = 32_768  # bits of one bitmap row


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the frame below the shared folder and read it back: lineage ends there and a lost executor repeats nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket(value: Column, n: int) -> Column:
    """Bucket 0..n-1 by hash; apart from the hash that Spark's exchanges use."""
    return F.pmod(F.xxhash64(value, F.lit("bucket")), F.lit(n))


def bitmap(keys: DataFrame, name: str) -> np.ndarray:
    """FILTER_BITS bits, set at the hash in column `name` of each row: the same size, whatever the input."""
    bit = F.pmod(F.col(name), F.lit(FILTER_BITS))
    own = keys.select(F.floor(bit / _PAGE).cast("int").alias("page"), (bit % _PAGE).cast("long").alias("bit"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in own.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():  # FILTER_BITS / _PAGE rows of 4 KB at most
        bits[r["page"] * _PAGE // 8 : (r["page"] + 1) * _PAGE // 8] = np.frombuffer(r["bits"], np.uint8)
    return bits


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bits of these (signed) hashes are set."""
    at = hashes % FILTER_BITS
    return (bits[at // 8] >> (at % 8).astype(np.uint8)) & 1 > 0


def likely(keys: DataFrame, name: str, th: Column) -> Column:
    """True for every hash in column `name` of keys, and for few others: a test against a bitmap of FILTER_BITS bits, whatever the input."""
    shared = keys.sparkSession.sparkContext.broadcast(bitmap(keys, name).tobytes())

    @F.pandas_udf("boolean")
    def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = np.frombuffer(shared.value, np.uint8)
        for s in batches:
            yield pd.Series(in_bitmap(table, s.to_numpy()))

    return test(th)


def hashed_sample(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """At most n rows, those whose columns `by` hash lowest. Tasks send the driver about n rows in all, not n each."""
    total, h = df.count(), F.xxhash64(*by)
    if total > 2 * n:
        df = df.where(h.cast("double") < -(2.0**63) + 2.0**64 * 1.5 * n / total)
    return df.orderBy(h, *by).limit(n)
