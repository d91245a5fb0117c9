"""The given tables read as genomic tables. Every view has a Spark form and the same text in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

EPOCH = "1992-01-01"


def days(c: str):
    return F.datediff(F.col(c).cast("date"), F.lit(EPOCH).cast("date")).cast("bigint")


# lineitem as intervals on a day axis
IV = """iv AS (
  SELECT l_partkey AS k, l_suppkey AS supp, l_returnflag AS flag, l_linestatus AS ls, l_orderkey AS okey,
         date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS s,
         date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) - 1 AS e
  FROM lineitem)"""


def iv(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("k"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("ls"),
        F.col("l_orderkey").alias("okey"),
        days("l_shipdate").alias("s"),
        (days("l_shipdate") + F.col("l_quantity").cast("bigint") - 1).alias("e"),
    )


# supplier nation as species `REGION_NATION_n`
SPECIES = """species AS (
  SELECT s_suppkey, n_nationkey, n_name, r_name || '_' || n_name AS species
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def species(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    s = table(spark, sf, "supplier")
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select("s_suppkey", "n_nationkey", "n_name", F.concat_ws("_", "r_name", "n_name").alias("species"))
    )


# lineitem as alignment lines of parts (genes) against nations (targets)
HITS = (
    SPECIES
    + """, hits AS (
  SELECT 'g' || l_partkey AS gene_id, n_name AS target, species AS target_species,
         l_discount AS evalue, l_extendedprice AS bitscore, round(100 - 100 * l_tax, 1) AS pident,
         (d % 150) + 1 AS qstart, (d % 150) + q AS qend, ((d // 7) % 100) + 1 AS sstart, ((d // 7) % 100) + q AS send,
         CAST(220 AS BIGINT) AS qlen, CAST(160 AS BIGINT) AS slen, l_orderkey * 8 + l_linenumber AS line
  FROM (SELECT *, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS d, CAST(l_quantity AS BIGINT) AS q
        FROM lineitem) JOIN species ON l_suppkey = s_suppkey)"""
)


def hits(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").withColumn("d", days("l_shipdate")).withColumn("q", F.col("l_quantity").cast("bigint"))
    week = F.floor(F.col("d") / 7) % 100
    return li.join(species(spark, sf), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.concat(F.lit("g"), F.col("l_partkey").cast("string")).alias("gene_id"),
        F.col("n_name").alias("target"),
        F.col("species").alias("target_species"),
        F.col("l_discount").alias("evalue"),
        F.col("l_extendedprice").alias("bitscore"),
        F.round(100 - 100 * F.col("l_tax"), 1).alias("pident"),
        (F.col("d") % 150 + 1).alias("qstart"),
        (F.col("d") % 150 + F.col("q")).alias("qend"),
        (week + 1).alias("sstart"),
        (week + F.col("q")).alias("send"),
        F.lit(220).cast("bigint").alias("qlen"),
        F.lit(160).cast("bigint").alias("slen"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("line"),
    )
