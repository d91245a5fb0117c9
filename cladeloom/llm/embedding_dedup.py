"""Near-duplicate vectors by a subspace pigeonhole join."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .simhash import join_labels
from .tables import written

COSINE = 0.93
BLOCK = 32  # dimensions of a block
GROUP = 32_768  # rows of a piece
PIECE = 1 << 24  # bytes of a piece
ROWS_AT_ONCE = 256
PAIRS_AT_ONCE = 50_000
SLACK = 1e-5  # of squared distances in float32


def blocks(d: int) -> list[slice]:
    return [slice(a, min(a + BLOCK, d)) for a in range(0, d, BLOCK)]


def budgets(d: int, cosine: float) -> np.ndarray:
    """Squared distance that each block may have: unit vectors at the cosine are 2 - 2 cosine apart, in proportion to the dimensions."""
    widths = np.array([b.stop - b.start for b in blocks(d)])
    return (2 - 2 * cosine) * widths / d * (1 + 1e-6) + 1e-12


@lru_cache(8)
def rotation(d: int) -> np.ndarray:
    """A fixed random rotation, so that no block holds more of the difference than its dimensions make likely."""
    q, r = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def _rotated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for value in batch.column(3):
            v = np.array(value.as_py(), np.float64)
            v /= np.abs(v).max()  # neither tiny nor huge components leave the range of doubles
            out.append((v / math.sqrt(float(v @ v)) @ rotation(len(v))).tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["node", "label", "n", "vec"])


def _near(x: np.ndarray, cosine: float) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Per block float32 rows for both sides of a product and the least value of it at which a pair is within the block's budget.

    The right side carries a column, so that one product gives u v - h(v); the budget holds where that is at least h(u).
    """
    left, right, least = [], [], []
    for part, budget in zip(blocks(x.shape[1]), budgets(x.shape[1], cosine), strict=True):
        sub = x[:, part]
        half = ((sub**2).sum(axis=1) - (budget + SLACK) / 2) / 2
        left.append(np.hstack([sub, np.ones((len(x), 1))]).astype(np.float32))
        right.append(np.hstack([sub, -half[:, None]]).astype(np.float32))
        least.append(half.astype(np.float32))
    return left, right, least


def _links(cosine: float):
    def solve(rows: pa.Table) -> pa.RecordBatch:
        dim, alone = rows.column("dim")[0].as_py(), rows.column("alone")[0].as_py()
        own = rows.column("own").to_numpy(zero_copy_only=False)
        n = rows.column("n").to_numpy()
        x = np.frombuffer(b"".join(rows.column("vec").to_pylist())).reshape(-1, dim)
        order = np.argsort(~own, kind="stable")  # own rows first
        x, n, owners = x[order], n[order], int(own.sum())
        node = rows.column("node").to_numpy()[order]
        left, right, least = _near(x, cosine)
        degree, label = np.zeros(len(x), np.int64), np.arange(len(x))
        for a in range(0, owners, ROWS_AT_ONCE):
            b = min(a + ROWS_AT_ONCE, owners)
            first = a if alone else owners  # own rows meet the later ones of their piece, or the visitors
            near = np.zeros((b - a, len(x) - first), bool)
            for u, v, h in zip(left, right, least, strict=True):
                near |= u[a:b] @ v[first:].T >= h[a:b, None]
            i, j = np.divmod(np.flatnonzero(near), max(1, near.shape[1]))
            i, j = i + a, j + first
            later = i < j
            i, j = i[later], j[later]
            for s in range(0, len(i), PAIRS_AT_ONCE):
                p, q = i[s : s + PAIRS_AT_ONCE], j[s : s + PAIRS_AT_ONCE]
                keep = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
                p, q = p[keep], q[keep]
                np.add.at(degree, p, n[q])
                np.add.at(degree, q, n[p])
                join_labels(label, p, q)
        found = degree > 0
        return pa.RecordBatch.from_arrays([pa.array(node[found]), pa.array(node[label[found]]), pa.array(degree[found])], ["node", "root", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group is taken whole."""
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            grp = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(grp[1:] != grp[:-1]) + 1).tolist(), len(grp)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and grp[a] != last:
                    yield solve(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = grp[a]
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(node, root, links) found per task for vectors (node, label, n, vec): links sums, over all rows of a node, to the vectors that
    are linked to it (each with its multiplicity n), and the pairs (node, root) connect what the links connect.

    If two unit vectors are within the squared distance of the cosine, some block of their rotated coordinates is within its
    share of it. What any block finds is verified in full, in doubles. The rows of a label are cut into pieces of at most GROUP rows or
    PIECE bytes on average; every two pieces meet in one task, and each piece meets itself, so a pair meets once, no task holds more than two
    pieces, whatever a label or a dense cluster holds, and no pair leaves its task. Work is the square of a label's rows.
    """
    rows = vectors.select("label", (F.octet_length("vec") / 8).cast("int").alias("dim"), "node", "n", "vec")
    most = F.least(F.lit(GROUP), F.greatest(F.lit(1), F.floor(F.lit(PIECE) / (F.col("dim") * 8)).cast("int")))
    sizes = rows.groupBy("label", "dim").count().withColumn("pieces", F.ceil(F.col("count") / most).cast("int"))
    sizes = written(sizes, "label-sizes")
    # labels of one piece share tasks, all others have one for every two pieces
    pairs = F.when(F.col("pieces") > 1, F.col("pieces") * (F.col("pieces") + 1)).otherwise(F.col("count") / GROUP)
    n_tasks = sizes.agg(F.ceil(F.sum(pairs.cast("double"))).alias("n")).first()["n"] or 0
    n_tasks = max(int(n_tasks), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    piece = F.pmod(F.xxhash64("node", F.lit("piece")), F.col("pieces"))
    dealt = rows.join(sizes.drop("count"), ["label", "dim"]).withColumn("piece", piece.cast("int"))
    dealt = dealt.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    grp = F.xxhash64("label", "dim", F.least("piece", "to"), F.greatest("piece", "to")).alias("grp")
    dealt = dealt.select(grp, "dim", (F.col("piece") == F.col("to")).alias("alone"), (F.col("piece") <= F.col("to")).alias("own"), "node", "n", "vec")
    return dealt.repartition(n_tasks, "grp").sortWithinPartitions("grp").mapInArrow(_links(cosine), "node long, root long, links long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label).

    Rows link if their labels are equal and their vectors, of one length, have at least the cosine. A null label or vec_id, and a
    vector that is null, empty, zero, or holds a null or a component that is not finite, links with nothing. Equal vectors of
    a label are one node with a multiplicity; repeated rows count as other vectors.
    """
    v = F.col("embedding").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    sound = sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    node = F.when(F.coalesce(sound, F.lit(False)), F.xxhash64("label", v))
    rows = vectors.select(F.col("vec_id").cast("long"), "label", v.alias("v"), node.alias("node"))
    valid = rows.where("node is not null")
    nodes = valid.groupBy("node").agg(F.first("label").cast("string").alias("label"), F.count("*").alias("n"), F.first("v").alias("v"), F.min("vec_id").alias("low"))
    nodes = written(nodes, "nodes")
    turned = written(nodes.select("node", "label", "n", "v").mapInArrow(_rotated, "node long, label string, n long, vec binary"), "rotated")
    found = written(links(turned, cosine), "found")
    roots = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    all_nodes = nodes.select("node", "n", "low").join(degree, "node", "left").join(roots, "node", "left")
    all_nodes = all_nodes.select("node", "low", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    lows = all_nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = written(all_nodes.join(lows, "root").select("node", "n_links", "component_id"), "named")
    out = rows.select("vec_id", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
