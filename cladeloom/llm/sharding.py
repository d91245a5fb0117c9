"""Longest-processing-time sharding of groups that must stay together."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import bucket, written

GROUPS_PER_BUCKET = 100_000  # a heap run in one task sees about so many groups
MAX_BUCKETS = 2_000  # so the last heap sees a bounded number of bundles
BUNDLES_PER_SHARD = 200  # at least so many bundles a shard: the last heap can level them
FILLER_SHARE = 0.02  # of a bucket's bytes, in its smallest groups, packed into small bundles that fill the gaps


def longest_first(sizes: list[int], loads: list[int]) -> list[int]:
    """Place sizes, largest first, each on the least loaded bin (ties: the lower bin). Returns the bin of each size."""
    heap = [(load, i) for i, load in enumerate(loads)]
    heapq.heapify(heap)
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        load, i = heap[0]
        heapq.heapreplace(heap, (load + sizes[k], i))
        out[k] = i
    return out


def _bundles(bins: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "grp"], ascending=[False, True]).reset_index(drop=True)
        main = (pdf["bytes"].cumsum() - pdf["bytes"] <= (1 - FILLER_SHARE) * pdf["bytes"].sum()).to_numpy()
        n = int(main.sum())
        sizes = pdf["bytes"].tolist()
        pdf["bin"] = longest_first(sizes[:n], [0] * bins) + [bins + b for b in longest_first(sizes[n:], [0] * bins)]
        return pdf[["grp", "bucket", "bin", "bytes"]]

    return pack


def lpt_shards(rows: DataFrame, order: Column, n_shards: int) -> DataFrame:
    """Give every row of (id, grp, size, ...) a shard 0..n_shards-1 and a gapless slot; rows of one grp share a shard.

    Longest-processing-time scheduling in two levels. Groups that weigh or number over one part in n_shards * 200 of all
    (so at most twice that many) go to the last heap as they are. The others are dealt by hash to buckets; in each, one
    heap packs them, largest first, into bundles, and the smallest 2% of bytes into small bundles. The last heap places large
    groups and bundles, largest first, on the least loaded shard; it sees at most 2 * n_shards * 200 large groups and
    2 * max(n_shards * 200, 2000 * n_shards) + bundles, whatever the input. Slots number the rows of a shard: rows are dealt
    to sub-buckets by `order`, each is sorted by itself, and a prefix sum of their counts gives the offsets.
    Null groups form one group; repeated rows are rows; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    rows = written(rows.withColumns({"grp": F.coalesce(F.col("grp").cast("string"), F.lit("")), "part": F.xxhash64(order)}), "shard-rows")
    groups = written(rows.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    n_groups, n_rows, total = groups.agg(F.count("*"), F.sum("n"), F.sum("bytes")).first()
    n_rows, total = n_rows or 0, total or 0
    n_buckets = min(MAX_BUCKETS, max(16, -(-n_groups // GROUPS_PER_BUCKET)))
    bins = n_shards * -(-BUNDLES_PER_SHARD // n_buckets)
    large = (F.col("bytes") * n_shards * BUNDLES_PER_SHARD > total) | (F.col("n") * n_shards * BUNDLES_PER_SHARD > n_rows)
    groups = groups.withColumns({"large": large, "bucket": bucket(F.col("grp"), n_buckets)})
    packed = written(
        groups.where("not large").groupBy("bucket").applyInPandas(_bundles(bins), "grp string, bucket long, bin long, bytes long"), "shard-bundles"
    )
    pieces = [(g, None, None, b) for g, b in groups.where("large").select("grp", "bytes").orderBy("grp").collect()]
    pieces += [(None, *r) for r in packed.groupBy("bucket", "bin").agg(F.sum("bytes")).orderBy("bucket", "bin").collect()]
    shard = longest_first([p[3] for p in pieces], [0] * n_shards)
    placed = spark.createDataFrame([(*p[:3], s) for p, s in zip(pieces, shard, strict=True)] or [], "grp string, bucket long, bin long, shard int")
    # both lists are bounded as stated above
    whole = F.broadcast(placed.where("grp is not null").select("grp", F.col("shard").alias("shard_w")))
    bundled = packed.join(F.broadcast(placed.where("grp is null").select("bucket", "bin", "shard")), ["bucket", "bin"]).select("grp", "shard")
    marked = rows.join(whole, "grp", "left")
    out = marked.where("shard_w is not null").withColumnRenamed("shard_w", "shard").select(*rows.columns, "shard")
    out = written(out.union(marked.where("shard_w is null").join(bundled, "grp").select(*rows.columns, "shard")), "shard-placed")
    n_parts = min(MAX_BUCKETS, max(8, -(-n_rows // (n_shards * GROUPS_PER_BUCKET // 4))))
    out = out.withColumn("part", F.pmod("part", F.lit(n_parts)))
    counts = out.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    local = F.row_number().over(Window.partitionBy("shard", "part").orderBy(order))
    out = out.withColumn("slot", local - 1).join(F.broadcast(offsets), ["shard", "part"])  # n_shards * 2000 rows at most
    return out.withColumn("slot", (F.col("slot") + F.col("off")).cast("long")).drop("part", "off")


def shard_documents(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """Documents to shards of near equal bytes, equal texts together; see `lpt_shards`. A null text counts as an empty one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.md5(text.cast("binary")).alias("grp"),
    )
    out = lpt_shards(rows, F.struct("doc_id", "text_crc32"), n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
