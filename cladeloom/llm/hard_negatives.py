"""Hard negatives: exact integer scores of anchors against all rows by residue matrix products, then selection in a score window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import bucket, written

ROWS = 8192  # rows of a block
ANCHORS = 1024  # anchors of a block
WIDTH = 1024  # components multiplied at once
LIMIT = 1 << 56  # scores stay below this, so that 100 scores still fit 64 bits


def primes(width: int, bound: int) -> list[int]:
    """Primes whose product is over 2 * bound, each so small that `width` products of centred residues sum up exactly in float32."""
    most = int(2 * (2**24 / width) ** 0.5)  # width * (p / 2)^2 < 2^24
    found: list[int] = []
    product, p = 1, most - (most % 2 == 0)
    while product <= 2 * bound:
        if p < 3:
            raise ValueError("scores are too large for the primes below 4096")
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            found.append(p)
            product *= p
        p -= 2
    return found


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Residues of whole numbers (float64) modulo p, centred on zero, as float32."""
    r = np.fmod(x, p)
    half = p // 2
    return np.where(r > half, r - p, np.where(r < -half, r + p, r)).astype(np.float32)


def combine(parts: list[np.ndarray], modules: list[int]) -> np.ndarray:
    """Chinese remaindering, digit by digit: the number of least magnitude with these residues. Exact while the product of the modules fits 64 bits.

    In mixed radix each digit is found modulo one small prime, so no step passes the size of the result.
    """
    whole = np.zeros(parts[0].shape, np.int64)
    weight = 1
    for r, p in zip(parts, modules, strict=True):
        digit = ((r - whole % p) * pow(weight, -1, p)) % p
        digit = np.where(digit > p // 2, digit - p, digit)  # centred digits give the centred number
        whole += digit * weight
        weight *= p
    return whole


def exact_products(a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """The integer matrix a @ b.T of whole numbers held in float64, if no entry passes `bound`, by float32 products modulo small primes."""
    width = min(WIDTH, max(1, a.shape[1]))
    modules = primes(width, bound)
    parts = []
    for p in modules:
        x, y = residues(a, p), residues(b, p)
        total = np.zeros((len(a), len(b)), np.int64)
        for at in range(0, a.shape[1], width):
            total += (x[:, at : at + width] @ y[:, at : at + width].T).astype(np.int64)
        parts.append(total % p)
    return combine(parts, modules)


def first_in_rows(score: np.ndarray, use: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the k highest used entries of every row, higher first, equal ones by column; fewer where there are fewer."""
    least = np.iinfo(np.int64).min
    masked = np.where(use, score, least)
    if masked.shape[1] > k:
        kth = np.partition(masked, masked.shape[1] - k, axis=1)[:, masked.shape[1] - k]
        use = use & (masked >= kth[:, None])
    row, col = np.nonzero(use)
    order = np.lexsort((col, -score[row, col], row))
    row, col = row[order], col[order]
    start = np.searchsorted(row, np.arange(len(score)))
    keep = np.arange(len(row)) - start[row] < k
    return row[keep], col[keep]


def _matrix(column: pa.ListArray, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _block(ids: str, more: list[str]) -> Column:
    return F.array_sort(F.collect_list(F.struct(ids, "label", *more, "x"))).alias("rows")


def _pairs(batches: Iterator[pa.RecordBatch], bound: int) -> Iterator[tuple[pa.StructArray, pa.StructArray, np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            a, b = batch.column(0)[k].values, batch.column(1)[k].values
            yield a, b, exact_products(_matrix(a.field("x"), len(a)), _matrix(b.field("x"), len(b)), bound)


_FOUND = "anchor_id long, anchor_label long, found_id long, found_score long"


def _positives(bound: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, score in _pairs(batches, bound):
            ids, own = (x.field("vec_id").to_numpy() for x in (a, b))
            labels, theirs = (x.field("label").to_numpy() for x in (a, b))
            row, col = first_in_rows(score, (labels[:, None] == theirs) & (ids[:, None] != own), k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row]), pa.array(labels[row]), pa.array(own[col]), pa.array(score[row, col])],
                ["anchor_id", "anchor_label", "found_id", "found_score"],
            )

    return run


_NEGATIVE = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def _negatives(bound: int, k: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, score in _pairs(batches, bound):
            ids, own = (x.field("vec_id").to_numpy() for x in (a, b))
            labels, theirs = (x.field("label").to_numpy() for x in (a, b))
            lists = a.field("positives")
            sizes = lists.value_lengths().to_numpy()
            start = np.cumsum(sizes) - sizes
            pairs = lists.flatten()
            positive, goal = pairs.field("positive_id").to_numpy(), pairs.field("positive_score").to_numpy()
            other = labels[:, None] != theirs
            for turn in range(int(sizes.max(initial=0))):
                at = np.flatnonzero(sizes > turn)
                p = start[at] + turn
                mine = 100 * score[at]
                row, col = first_in_rows(score[at], other[at] & (mine >= low * goal[p][:, None]) & (mine <= high * goal[p][:, None]), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at[row]]), pa.array(positive[p[row]]), pa.array(goal[p[row]]), pa.array(own[col]), pa.array(score[at[row], col])],
                    ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"],
                )

    return run


def _first(df: DataFrame, keys: list[str], score: str, ids: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(ids))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def whole_rows(vectors: DataFrame, relabel: bool = True) -> DataFrame:
    """(vec_id, label, x) of the rows that take part: x holds floor(256 * component) as doubles."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("e"))
    fine = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & fine)
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label")) if relabel else F.col("label")
    # floor as a double: a bigint would cut large components
    x = F.transform("e", lambda c: _floor(c * 256))
    return v.select("vec_id", label.alias("label"), x.alias("x")).distinct()


def _floor(c: Column) -> Column:
    """Floor of a double as a double: beyond 2^53 a double is whole already."""
    return F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c)


def hard_negatives(
    vectors: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor, positive and hard negative.

    Anchors are rows whose vec_id is divisible by `every`; scores are integer inner products of floor(256 * component), equal ones go
    by vec_id. Positives: the first `n_positives` other rows of the label. Negatives: the first `n_negatives` rows of another
    label with low * positive <= 100 * negative <= high * positive.

    Anchors meet all rows block against block, the stated query set against the table: blocks of ANCHORS anchors travel to every block of
    ROWS rows, and a task sends only its first few of each anchor. The number of primes follows from the longest vector.

    Rows with a null id, label, vector or component, or one that is not finite, take no part; nor do vectors of another length than
    most have. A row repeated with the same label and vector counts once; "other" rows have another vec_id. Empty vectors score
    zero. Extra columns are not read. Scores of 2^56 or more raise an error, as 100 of them pass 64 bits.
    """
    rows = written(whole_rows(vectors), "whole-rows")
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    size = length["d"] if length else 0
    rows = rows.where(F.size("x") == size)
    square = rows.agg(F.max(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c)).alias("s"), F.count("*").alias("n")).first()
    bound = int((square["s"] or 0.0) * (1 + 1e-9)) + 1  # no inner product passes the largest squared length
    if bound >= LIMIT:
        raise ValueError(f"scores up to {bound} do not fit: 100 of them pass 64 bits")
    n_blocks = max(1, -(-square["n"] // ROWS))
    anchors = rows.where(F.col("vec_id") % every == 0)
    n_anchor_blocks = max(1, -(-anchors.count() // ANCHORS))
    blocks = rows.groupBy(bucket(F.col("vec_id"), n_blocks).alias("block")).agg(_block("vec_id", []))
    blocks = written(blocks, "row-blocks")

    # as many tasks as blocks; Spark takes the exploded anchors for few and would send them to the driver to broadcast them
    n_tasks = max(n_blocks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = blocks.withColumn("block", F.col("block").cast("int")).repartition(n_tasks, "block")

    def met(own: DataFrame, more: list[str]) -> DataFrame:
        own = own.groupBy(bucket(F.col("vec_id"), n_anchor_blocks).alias("part")).agg(_block("vec_id", more))
        own = own.select(F.col("rows").alias("anchors"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
        return own.repartition(n_tasks, "block").hint("merge").join(dealt, "block").select("anchors", "rows")

    found = met(anchors, []).mapInArrow(_positives(bound, n_positives), _FOUND)
    first = _first(found, ["anchor_id", "anchor_label"], "found_score", "found_id", n_positives)
    pair = F.struct(F.col("found_id").alias("positive_id"), F.col("found_score").alias("positive_score"))
    lists = first.groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor_label").alias("label")).agg(F.collect_list(pair).alias("positives"))
    own = written(anchors.hint("merge").join(lists, ["vec_id", "label"]), "positives")
    met_again = met(own, ["positives"])
    got = met_again.mapInArrow(_negatives(bound, n_negatives, low, high), _NEGATIVE)
    out = _first(got, ["anchor_id", "positive_id", "positive_score"], "negative_score", "negative_id", n_negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def sql(every: int = 100, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90) -> str:
    return f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
a AS (SELECT * FROM v WHERE vec_id % {every} = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS al, v.vec_id AS id, v.label AS vl, list_sum(list_transform(list_zip(a.x, v.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM a, v WHERE a.vec_id <> v.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE al = vl
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {n_positives}),
g AS (
  SELECT p.anchor_id, p.positive_id, s.id AS negative_id, p.positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.al <> s.vl
    AND {low} * p.positive_score <= 100 * s.score AND 100 * s.score <= {high} * p.positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM g WHERE rank <= {n_negatives}"""
