"""Runs, gaps and chains along alignments and lineages."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import dealt
from ..functions.aligned import flags_at, gap_run_rows, recheck_spans
from ..functions.seq import STOPS
from ..session import cut_lineage
from .intervals import asof_join, first_overlap_join, merge_intervals
from .tree import Tree, branching


def indel_runs(aln: DataFrame, keys: list[str], ref: str = "ref_text", row: str = "row_text", reported_only: bool = True) -> DataFrame:
    """Deletion and insertion runs per aligned row; reported are those that shift the frame or insert a stop codon."""
    schema = T.StructType([*(aln.schema[k] for k in keys), T.StructField("ref_len", T.IntegerType()), T.StructField("kind", T.StringType()), *(
        T.StructField(c, T.IntegerType()) for c in ("start", "end", "length")), T.StructField("seq", T.StringType())])
    x = aln.select(*keys, ref, row).mapInArrow(gap_run_rows(keys, ref, row), schema)
    if not reported_only:
        return x
    stop = (F.col("kind") == "insertion") & (F.col("length") == 3) & F.col("seq").isin(STOPS)
    return x.filter((F.col("length") % 3 != 0) | stop)


def drop_untrusted_runs(runs: DataFrame, mask: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split runs into trusted ones and the audit table: deletions that reach an end of the reference or the mask.

    runs(keys, kind, start, end, length, ref_len), mask(keys, m_start, m_end).
    """
    dele = runs.filter("kind = 'deletion'")
    end = F.col("start").eqNullSafe(1) | (F.col("end") == F.col("ref_len"))
    hit = first_overlap_join(dele, mask.withColumn("_id", F.lit(1)), keys, ("start", "end"), ("m_start", "m_end"), "_id")
    reason = F.when(end, "unaligned_end").when(F.col("_id").isNotNull(), "masked_out")
    hit = hit.withColumn("reason", reason)
    audit = hit.filter("reason is not null").select(*runs.columns, "reason")
    kept = hit.filter("reason is null").select(*runs.columns).unionByName(runs.filter("kind = 'insertion'"))
    return kept, audit


def per_row(events: DataFrame, aln: DataFrame, keys: list[str], what) -> DataFrame:
    """Events with fields worked out from the aligned row they lie on.

    The events of a row come to it as one array, at most one per position, so the row's text is moved once and not once
    per event. `what` maps the array column to an array of structs in the same order.
    """
    cols = [c for c in events.columns if c not in keys]
    # Spark judges exploded runs and collected arrays by the size of the file they come from: never broadcast them
    g = events.groupBy(*keys).agg(F.collect_list(F.struct(*cols)).alias("_e")).hint("merge")
    j = g.join(aln, keys).select(*keys, "_e", what(F.col("_e")).alias("_w"))
    z = j.select(*keys, F.explode(F.arrays_zip("_e", "_w")).alias("z"))
    return z.select(*keys, "z._e.*", "z._w.*")


def recheck_runs(runs: DataFrame, aln: DataFrame, keys: list[str], ref: str = "ref_text", row: str = "row_text") -> DataFrame:
    """Reported deletions with what they are in the alignment as it now stands."""
    spans = lambda e: F.transform(e, lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end")))
    return per_row(runs, aln.select(*keys, ref, row), keys, lambda e: recheck_spans(ref, row, spans(e)))


def event_flags(events: DataFrame, aln: DataFrame, keys: list[str], ref: str = "ref_text", row: str = "row_text") -> DataFrame:
    """Events (start in reference positions, length) with their flags: a homopolymer or an edge of the focal sequence, an N of the row within
    five columns, another length at the same position."""
    # dealt by row once, for the window over positions and for the arrays of per_row
    spot = Window.partitionBy(*keys, "start")
    events = events.repartition(*keys).withColumn("multi_length", F.min("length").over(spot) < F.max("length").over(spot))
    return per_row(events, aln.select(*keys, ref, row), keys, lambda e: flags_at()(ref, row, F.transform(e, lambda x: x["start"].cast("long"))))


def block_gap_audit(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per (exon, taxon): bases missing between consecutive blocks (also where the contig changes), blocks it is absent from, contig switches.

    rows(exon, taxon, block_ix, contig, start, size), blocks(exon, block_ix).
    """
    key = ["exon", "taxon"]
    prev = rows.select(*key, F.col("block_ix").alias("_pix"), F.col("contig").alias("_pc"), (F.col("start") + F.col("size")).alias("_pe"))
    j = asof_join(rows, prev, key, "block_ix", "_pix", ["_pix", "_pc", "_pe"], True, False)
    miss = F.when(F.col("start") > F.col("_pe"), F.col("start") - F.col("_pe")).otherwise(0)
    g = j.groupBy(*key).agg(
        F.sum(miss).cast("bigint").alias("missing_bp"), F.count_if(miss > 0).alias("n_missing"),
        F.count_if(F.col("_pc") != F.col("contig")).alias("n_switches"), F.countDistinct("block_ix").alias("_n"))
    n = blocks.groupBy("exon").agg(F.countDistinct("block_ix").alias("n_blocks"))
    g = g.join(n, "exon").withColumn("n_absent", F.col("n_blocks") - F.col("_n"))
    return g.withColumn("in_all_blocks", F.col("n_absent") == 0).drop("_n")


def jump_filter(rows: DataFrame, max_jump: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """Strict mode: drop a taxon from a whole exon when consecutive blocks change contig or jump too far."""
    key = ["exon", "taxon"]
    prev = rows.select(*key, F.col("block_ix").alias("_pix"), F.col("contig").alias("_pc"), (F.col("start") + F.col("size")).alias("_pe"))
    j = asof_join(rows, prev, key, "block_ix", "_pix", ["_pix", "_pc", "_pe"], True, False)
    bad = j.filter((F.col("_pc") != F.col("contig")) | (F.abs(F.col("start") - F.col("_pe")) > max_jump)).select(*key).distinct()
    return rows.join(bad, key, "left_anti"), bad


def shared_events(events: DataFrame, tree: Tree, excluded: list | None = None, requires: dict | None = None,
                  contiguous: bool = True, living: DataFrame | None = None, by: DataFrame | None = None) -> DataFrame:
    """Events inherited along a lineage: carried by at least two lineage ancestors, oldest first.

    events(gene, focal, event, node). Excluded nodes never count; a node in `requires` counts only when all the nodes it
    requires carry the event. contiguous: each unbroken run of carriers is an event of its own. living(gene, event,
    species): a single missing ancestor between two carriers is filled when a living species on its side branch carries
    the event. A lineage has a bounded number of nodes, so an event is one short array. `by` is the table the inputs come from: rows that
    gaps are filled in are dealt by gene to a number of tasks that grows with it.
    """
    # the tree's own tables are as large as the tree, whatever the number of events
    e = events.select("gene", "focal", "event", "node").distinct().join(F.broadcast(tree.lineage), ["focal", "node"])
    key = ["gene", "focal", "event"]
    for node, needed in (requires or {}).items():
        ok = e.filter(F.col("node").isin(list(needed))).groupBy(*key).agg(F.countDistinct("node").alias("_c")).filter(F.col("_c") == len(needed))
        e = e.filter(F.col("node") != node).unionByName(e.filter(F.col("node") == node).join(ok.select(*key), key, "left_semi"))
    if excluded:
        e = e.filter(~F.col("node").isin(list(excluded)))
    e = e.withColumn("inferred", F.lit(False))
    w = Window.partitionBy(*key).orderBy("ix")
    if living is not None:
        # gaps and species meet by aggregation: all steps stay in the tasks of their gene, and an event has few of both
        deal = lambda df: df if by is None else dealt(df, "gene", by=by)
        gaps = e.withColumn("_nx", F.lead("ix").over(w)).filter("_nx = ix + 2").select(*key, (F.col("ix") + 1).alias("ix"))
        gaps = gaps.select("gene", "event", F.struct("focal", "ix").alias("_gap")).unionByName(living.select("gene", "event", "species"), allowMissingColumns=True)
        gaps = deal(gaps.filter("gene is not null and event is not null")).groupBy("gene", "event").agg(F.collect_set("_gap").alias("_gaps"), F.collect_set("species").alias("_all"))
        gaps = gaps.select("gene", "event", "_all", F.explode("_gaps").alias("_gap")).select("gene", "event", "_gap.*", F.explode("_all").alias("species"))
        gaps = branching(gaps, tree).filter("ix = _ix")
        e = deal(e.unionByName(gaps.select(*key, "node", "ix", F.lit(True).alias("inferred")).distinct()))
    run = F.col("ix") - F.row_number().over(w) if contiguous else F.lit(0)
    g = e.withColumn("_run", run).groupBy(*key, "_run").agg(
        F.sort_array(F.collect_list(F.struct("ix", "node", "inferred")), asc=False).alias("_a"), F.count("*").alias("n_nodes"))
    return g.filter("n_nodes >= 2").select(
        *key, F.transform("_a", lambda x: x["node"]).alias("nodes"), F.transform("_a", lambda x: x["ix"]).alias("ixs"), "n_nodes",
        F.filter(F.transform("_a", lambda x: F.when(x["inferred"], x["node"])), lambda v: v.isNotNull()).alias("inferred"))


def collinear_chains(exons: DataFrame, max_span: int, cut_from: int = 1_000_000) -> DataFrame:
    """Greedy chains of exon pieces per (locus, taxon, contig, strand): every piece with its chain.

    exons(locus, taxon, ix, contig, strand, start, end, bases) with ix in reference order, one piece each. A chain breaks where the
    coordinates stop moving in the direction of the strand, or where it would span more than max_span.

    Whether a piece opens a chain depends on the piece before and on the head of the chain so far, so a group is read once in order
    and nothing but the two is kept. Only groups of over `cut_from` pieces are dealt to several tasks, at the price of many joins.
    """
    g = ["locus", "taxon", "contig", "strand"]
    minus = F.col("strand") == "-"
    x = exons.withColumn("_u", F.when(minus, -F.col("end")).otherwise(F.col("start")).cast("bigint")).withColumn(
        "_v", F.when(minus, -F.col("start")).otherwise(F.col("end")).cast("bigint"))
    large = cut_lineage(exons.groupBy(*g).agg(F.count("*").alias("_n")).filter(F.col("_n") > cut_from).select(*g))
    if large.isEmpty():
        return _chains_in_order(x, g, max_span)
    few = x.join(F.broadcast(large), g, "left_anti")
    return _chains_in_order(few, g, max_span).unionByName(_chains_by_jumps(x.join(F.broadcast(large), g, "left_semi"), g, max_span))


def _chains_in_order(x: DataFrame, g: list[str], max_span: int) -> DataFrame:
    """Chains of groups that one task reads from end to end. An unknown coordinate breaks no chain."""
    kept = [c for c in x.columns if c not in ("_u", "_v")]
    far = 1 << 62
    first = F.row_number().over(Window.partitionBy(*g).orderBy("ix", "_u", "_v")) == 1
    x = x.select(*kept, F.coalesce("_u", F.lit(far)).alias("_u"), F.coalesce("_v", F.lit(-far)).alias("_v"), first.alias("_first"))
    schema = T.StructType([*(x.schema[c] for c in kept), T.StructField("chain", x.schema["ix"].dataType)])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_u, last_v = None, far, -far
        for b in batches:
            chain = []
            for first, ix, u, v in zip(*(b.column(c).to_pylist() for c in ("_first", "ix", "_u", "_v")), strict=True):
                if first or u < last_v or v > head_u + max_span:
                    head, head_u = ix, u
                last_v = v
                chain.append(head)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(chain, b.column("ix").type)], names=[*kept, "chain"])

    return x.mapInArrow(solve, schema)


def _chains_by_jumps(x: DataFrame, g: list[str], max_span: int) -> DataFrame:
    """Chains of groups too large for a task.

    Direction breaks look at one neighbour. Between them coordinates are monotone, so the first piece at which a chain
    starting at i gets too long is one as-of lookup, next(i). The chain heads are what next() reaches from the first
    piece of a stretch; doubling the jumps marks them in log2(chains) rounds however long a stretch is.
    """
    prev = x.select(*g, F.col("ix").alias("_pix"), F.col("_v").alias("_pv"))
    x = asof_join(x, prev, g, "ix", "_pix", ["_pix", "_pv"], True, False)
    heads = x.filter(F.col("_pix").isNull() | (F.col("_u") < F.col("_pv"))).select(*g, F.col("ix").alias("_seg"))
    x = asof_join(x.drop("_pix", "_pv"), heads.withColumn("_hs", F.col("_seg")), g, "ix", "_hs", ["_seg"], True, True)
    x = cut_lineage(x)
    gs = [*g, "_seg"]
    q = x.withColumn("_lim", F.col("_u") + max_span)
    far = asof_join(q, x.select(*gs, F.col("_v").alias("_fv"), F.col("ix").alias("_fix")), gs, "_lim", "_fv", ["_fix"], False, False)
    far = asof_join(far, x.select(*gs, F.col("ix").alias("_nix"), F.col("ix").alias("_nix2")), gs, "ix", "_nix2", ["_nix"], False, False)
    nxt = F.when(F.col("_fix") > F.col("ix"), F.col("_fix")).when(F.col("_fix").isNotNull(), F.col("_nix"))
    jump = cut_lineage(far.select(*gs, "ix", nxt.alias("to")).filter("to is not null"))
    mark = x.filter("ix = _seg").select(*gs, "ix")
    while not jump.isEmpty():
        mark = cut_lineage(mark.unionByName(mark.join(jump, [*gs, "ix"]).select(*gs, F.col("to").alias("ix"))).distinct())
        jump = cut_lineage(jump.withColumnsRenamed({"ix": "_a", "to": "ix"}).join(jump, [*gs, "ix"]).select(*gs, F.col("_a").alias("ix"), "to"))
    out = asof_join(x, mark.withColumnRenamed("ix", "chain").withColumn("_ci", F.col("chain")), gs, "ix", "_ci", ["chain"], True, True)
    return out.drop("_u", "_v", "_seg")


def dominant_chain(chains: DataFrame) -> DataFrame:
    """Per (locus, taxon) the chain with most bases, then more pieces, shorter span, contig, strand."""
    c = chains.groupBy("locus", "taxon", "contig", "strand", "chain").agg(
        F.sum("bases").cast("bigint").alias("bases"), F.count("*").alias("n"), (F.max("end") - F.min("start")).alias("span"),
        F.min("start").alias("lo"), F.max("end").alias("hi"))
    order = F.struct((-F.col("bases")).alias("b"), (-F.col("n")).alias("m"), "span", "contig", "strand", "chain", "lo", "hi")
    d = c.groupBy("locus", "taxon").agg(F.min(order).alias("d"))
    return d.select("locus", "taxon", "d.contig", "d.strand", "d.chain", (-F.col("d.b")).alias("bases"), (-F.col("d.m")).alias("n_exons"), "d.span", "d.lo", "d.hi")


class _Highest:
    """Highest key left of a place, over places 0..n-1: a tournament tree."""

    def __init__(self, n: int):
        self.n = n
        self.tree = [-1] * (2 * n)

    def put(self, at: int, key: int) -> None:
        tree, at = self.tree, at + self.n
        tree[at] = key
        while at > 1:
            at >>= 1
            top = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == top:
                break
            tree[at] = top

    def before(self, end: int) -> int:
        tree, lo, hi, best = self.tree, self.n, end + self.n, -1
        while lo < hi:
            if lo & 1:
                best = max(best, tree[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                best = max(best, tree[hi])
            lo >>= 1
            hi >>= 1
        return best


SWEEP = 100_000  # rows of one part scored together; what a later row can still reach is carried over


def _sweep(carried: list[tuple], rows: list[tuple], jump: int) -> tuple[list[tuple], list[tuple]]:
    """Scores along the axis. carried: (start, end, ix, score) of earlier rows in reach; rows: (start, end, ix, bases) sorted by start and ix.

    Returns (score, previous ix or None) of each row and what to carry on. The score of a row is its bases plus the highest score among the
    rows before it in block order that end at most `jump` before it starts, the first of equals in block order.
    """
    known = carried + rows
    order = sorted(range(len(known)), key=lambda k: (known[k][2], known[k][0], known[k][1]))
    place = [0] * len(known)
    for at, k in enumerate(order):
        place[k] = at
    n = len(known)
    tree = _Highest(n)
    waiting = [(known[k][1], k) for k in range(len(carried))]
    heapq.heapify(waiting)
    inside: deque = deque()  # rows in the tree, by end
    score = [r[3] for r in known]
    out = []
    for k in range(len(carried), n):
        start, end, _, bases = known[k]
        while waiting and waiting[0][0] <= start:
            stop, j = heapq.heappop(waiting)
            tree.put(place[j], score[j] * n + n - 1 - place[j])
            inside.append((stop, j))
        while inside and inside[0][0] < start - jump:
            tree.put(place[inside.popleft()[1]], -1)
        best = tree.before(place[k])
        previous = None
        if best >= n:  # a score of zero adds nothing
            j = order[n - 1 - best % n]
            score[k], previous = bases + best // n, known[j][2]
        out.append((score[k], previous))
        heapq.heappush(waiting, (end, k))
    last = rows[-1][0]
    near = {j for _, j in waiting} | {j for _, j in inside}
    return out, [(*known[j][:3], score[j]) for j in sorted(near) if known[j][1] >= last - jump]


def best_chain(blocks: DataFrame, jump: int, cut_from: int = 10 * SWEEP) -> DataFrame:
    """Blocks of the best collinear chain per (exon, taxon): `0 <= start - previous end <= jump`, most bases.

    blocks(exon, taxon, block_ix, contig, strand, start, end, bases). No chain can cross a stretch of more than `jump`
    uncovered positions, so a group of over `cut_from` rows is first cut there into parts for tasks of their own. Each part is swept along the axis in pieces of
    SWEEP rows: only scores that a later row can still reach are carried from piece to piece, and a range-maximum tree makes a
    piece n log n. A second sweep, from the other end, follows the links of the winning part, so neither holds a part.
    """
    g = ["exon", "taxon", "contig", "strand"]
    columns, key = blocks.columns, [*g, "_part"]
    sizes = cut_lineage(blocks.groupBy(*g).agg(F.count("*").alias("_n"), F.min("start").alias("_part")))
    large = sizes.filter(F.col("_n") > cut_from).select(*g)
    x = blocks.join(sizes.filter(F.col("_n") <= cut_from).drop("_n"), g)
    if not large.isEmpty():
        own = blocks.join(large, g, "left_semi")
        parts = merge_intervals(own, g, "start", "end", gap=jump).select(*g, F.col("start").alias("_part"))
        x = x.unionByName(asof_join(own, parts.withColumn("_ps", F.col("_part")), g, "start", "_ps", ["_part"], True, True))
    x = x.select(*columns, "_part")
    x = x.repartition(*key).sortWithinPartitions(*key, "start", "block_ix", "end")
    schema = T.StructType(x.schema.fields + [T.StructField("score", T.LongType()), T.StructField("prev", x.schema["block_ix"].dataType)])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, carried = None, []
        for pdf in batches:
            keys = list(zip(*(pdf[c].tolist() for c in key), strict=True))
            rows = list(zip(*(pdf[c].tolist() for c in ("start", "end", "block_ix", "bases")), strict=True))
            score, prev = [r[3] for r in rows], [None] * len(rows)
            at = 0
            while at < len(rows):
                if keys[at] != last:
                    last, carried = keys[at], []
                to = at + 1
                while to < len(rows) and to < at + SWEEP and keys[to] == last:
                    to += 1
                alone = to == at + 1 < len(rows) and not carried and keys[to] != last
                if not alone:
                    got, carried = _sweep(carried, rows[at:to], jump)
                    score[at:to], prev[at:to] = zip(*got, strict=True)
                at = to
            yield pdf.assign(score=score, prev=pd.array(prev, "Int64"))

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, want = None, None
        for pdf in batches:
            keys = list(zip(*(pdf[c].tolist() for c in key), strict=True))
            last, ix, prev = pdf["last"].tolist(), pdf["block_ix"].tolist(), pdf["prev"].tolist()
            pick = np.zeros(len(pdf), bool)
            for k in range(len(pdf)):
                if keys[k] != part:
                    part, want = keys[k], last[k]
                if want is not None and ix[k] == want:
                    pick[k] = True
                    want = None if prev[k] is pd.NA or prev[k] != prev[k] else int(prev[k])
            yield pdf.loc[pick, columns]

    solved = cut_lineage(x.mapInPandas(solve, schema))
    top = solved.groupBy(*g).agg(F.min("block_ix").alias("_first"), F.min(F.struct((-F.col("score")).alias("s"), F.col("block_ix").alias("last"), "_part")).alias("b"))
    best = top.groupBy("exon", "taxon").agg(F.min(F.struct("b.s", "_first", "contig", "strand", "b.last", "b._part")).alias("b"))
    best = best.select("exon", "taxon", "b.contig", "b.strand", "b._part", "b.last")
    own = solved.join(best, key).repartition(*key).sortWithinPartitions(*key, F.desc("start"), F.desc("block_ix"), F.desc("end"))
    return own.mapInPandas(follow, blocks.schema)
