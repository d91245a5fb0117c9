"""Interval operators: merge, cover, subtract, overlap joins, nearest neighbours, coordinate lift.

One key (a chromosome, a hot gene) may hold a large part of all rows, so no step sorts a whole key in one task. The axis
is cut into fixed bins; a window runs inside (key, bin), where at most a few rows per position remain after
pre-aggregation, and one summary row per (key, bin) carries the state from bin to bin.

Interval ends are inclusive unless a function says otherwise. Keys must not be NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 8192


def _bin(pos: Column | str, width: int) -> Column:
    p = F.col(pos) if isinstance(pos, str) else pos
    return F.coalesce(F.floor(p / F.lit(width)).cast("bigint"), F.lit(0).cast("bigint"))


def _known(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without NULL in the columns. Stated once here, the filter is the same on both sides of the joins with the
    bin summaries, so Spark computes the shuffle below them once and reuses it."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isNotNull()
    return df.filter(cond)


def _carry(df: DataFrame, keys: Sequence[str], per_bin: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
    """Add columns computed over the bin summaries of a key; the rows keep their (key, bin) partitioning."""
    s = df.groupBy(*keys, "_bin").agg(*[c.alias(n) for n, c in per_bin.items()])
    s = s.select(*keys, "_bin", *[c.alias(n) for n, c in carried.items()])
    return df.join(s, [*keys, "_bin"])


def _bins_before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)


def _bins_after(keys: Sequence[str]):
    """The bins after this one, nearest last: a frame that grows costs a step a row, one that shrinks is read again for every row."""
    return Window.partitionBy(*keys).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)


def sweep(events: DataFrame, keys: Sequence[str], layers: Sequence[str], width: int = WIDTH) -> DataFrame:
    """Depth of every layer after each event position.

    events holds `pos` and one delta column per layer (+1 where an interval opens, -1 where it closes). The result has
    one row per (key, pos) with the deltas and `n_<layer>`, the depth from this position on.
    """
    ev = (
        _known(events, *keys, "pos").groupBy(*keys, "pos")
        .agg(*[F.sum(x).alias(x) for x in layers])
        .withColumn("_bin", _bin("pos", width))
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.withColumns({f"_l_{x}": F.sum(x).over(inside) for x in layers})
    before = _bins_before(keys)
    ev = _carry(
        ev,
        keys,
        {f"_s_{x}": F.sum(x) for x in layers},
        {f"_c_{x}": F.coalesce(F.sum(f"_s_{x}").over(before), F.lit(0)) for x in layers},
    )
    return ev.withColumns({f"n_{x}": F.col(f"_l_{x}") + F.col(f"_c_{x}") for x in layers}).drop(
        *[f"_l_{x}" for x in layers], *[f"_c_{x}" for x in layers]
    )


def _next(df: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """First non-null value at a later position of the key, across bins."""
    later = Window.partitionBy(*keys, "_bin").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_v", value).withColumn("_n", F.last("_v", ignorenulls=True).over(later))
    df = _carry(
        df, keys, {"_f": F.min("_v")}, {"_nb": F.last("_f", ignorenulls=True).over(_bins_after(keys))}
    )
    return df.withColumn(name, F.coalesce("_n", "_nb")).drop("_v", "_n", "_nb")


def merge_intervals(
    df: DataFrame, keys: Sequence[str], start: str, end: str, gap: int = 1, width: int = WIDTH
) -> DataFrame:
    """Maximal intervals per key; an interval joins the one before when its start is at most `gap` past that end.

    gap=1 joins adjacent inclusive intervals, gap=0 joins only those that share a position. Direction is ignored.

    Copies are combined first, then each (key, bin) is merged on its own. One summary row per bin tells how far the
    earlier bins reach and which interval was the last to start there; a piece inside that reach belongs to it.
    """
    lo, hi = F.least(start, end).cast("bigint"), F.greatest(start, end).cast("bigint")
    x = _known(df.select(*keys, lo.alias("_s"), hi.alias("_e")), *keys, "_s", "_e")
    x = x.groupBy(*keys, "_s").agg(F.max("_e").alias("_e")).withColumn("_bin", _bin("_s", width))
    order = Window.partitionBy(*keys, "_bin").orderBy("_s")
    reach = F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_new", F.when(reach.isNull() | (F.col("_s") > reach + gap), 1).otherwise(0))
    x = x.withColumn("_piece", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    p = x.groupBy(*keys, "_bin", "_piece").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))

    b = p.groupBy(*keys, "_bin").agg(F.max("_s").alias("_last"), F.max("_e").alias("_top"))
    b = b.withColumn("_in", F.max("_top").over(_bins_before(keys)))
    alive = F.col("_in").isNull() | (F.col("_last") > F.col("_in") + gap)
    b = b.withColumn("_open", F.last(F.when(alive, F.col("_last")), ignorenulls=True).over(_bins_before(keys)))
    j = p.join(b.select(*keys, "_bin", "_in", "_open"), [*keys, "_bin"])
    own = F.col("_in").isNull() | (F.col("_s") > F.col("_in") + gap)
    head = F.when(own, F.col("_s")).otherwise(F.col("_open"))
    return j.groupBy(*keys, head.alias(start)).agg(F.max("_e").alias(end))


def _events(df: DataFrame, keys: Sequence[str], start: str, end: str, layer: str, layers: Sequence[str]) -> DataFrame:
    lo, hi = F.least(start, end).cast("bigint"), F.greatest(start, end).cast("bigint")
    both = F.array(
        F.struct(lo.alias("pos"), F.lit(1).alias("d")), F.struct((hi + 1).alias("pos"), F.lit(-1).alias("d"))
    )
    out = df.select(*keys, F.explode(both).alias("e"))
    return out.select(
        *keys, "e.pos", *[(F.col("e.d") if x == layer else F.lit(0)).alias(x) for x in layers]
    )


def union_length(
    df: DataFrame, keys: Sequence[str], start: str, end: str, name: str = "covered", width: int = WIDTH
) -> DataFrame:
    """Number of distinct positions covered per key.

    Intervals are cut at bin borders, so every (key, bin) is counted on its own and no state passes between bins. Take a
    width above the usual interval length: an interval costs one row per bin it touches.
    """
    lo, hi = F.least(start, end).cast("bigint"), F.greatest(start, end).cast("bigint")
    x = _known(df.select(*keys, lo.alias("_s"), hi.alias("_e")), *keys, "_s", "_e")
    x = x.select(*keys, "_s", "_e", F.explode(F.sequence(_bin("_s", width), _bin("_e", width))).alias("_bin"))
    s = F.greatest(F.col("_s"), F.col("_bin") * width)
    e = F.least(F.col("_e"), F.col("_bin") * width + (width - 1))
    x = x.groupBy(*keys, "_bin", s.alias("_s")).agg(F.max(e).alias("_e"))
    prior = Window.partitionBy(*keys, "_bin").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("_e") - F.greatest(F.col("_s") - 1, F.coalesce(F.max("_e").over(prior), F.col("_s") - 1))
    x = x.select(*keys, F.greatest(fresh, F.lit(0)).alias("_n"))
    return x.groupBy(*keys).agg(F.sum("_n").cast("bigint").alias(name))


def overlap_length(
    a: DataFrame, b: DataFrame, keys: Sequence[str], start: str, end: str, name: str = "overlap", width: int = WIDTH
) -> DataFrame:
    """Positions covered by both interval sets, per key that occurs in either: |A| + |B| - |A or B|, in one merge."""
    x = a.select(*keys, start, end, F.lit(1).alias("_sign")).unionByName(
        b.select(*keys, start, end, F.lit(2).alias("_sign"))
    )
    x = x.withColumn("_sign", F.explode(F.array(F.col("_sign"), F.lit(-1))))
    n = union_length(x, [*keys, "_sign"], start, end, "_n", width)
    total = F.sum(F.when(F.col("_sign") > 0, F.col("_n")).otherwise(-F.col("_n")))
    return n.groupBy(*keys).agg(total.cast("bigint").alias(name))


def subtract_intervals(
    a: DataFrame, mask: DataFrame, keys: Sequence[str], start: str, end: str, width: int = WIDTH
) -> DataFrame:
    """Maximal stretches of the first set that the mask does not cover."""
    layers = ["a", "b"]
    sw = sweep(
        _events(a, keys, start, end, "a", layers).unionByName(_events(mask, keys, start, end, "b", layers)),
        keys,
        layers,
        width,
    )
    now = (F.col("n_a") > 0) & (F.col("n_b") == 0)
    was = (F.col("n_a") - F.col("a") > 0) & (F.col("n_b") - F.col("b") == 0)
    sw = _next(sw, keys, F.when(was & ~now, F.col("pos")), "_close").filter(now & ~was)
    return sw.select(*keys, F.col("pos").alias(start), (F.col("_close") - 1).alias(end))


def meetings(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    a_span: tuple[str, str],
    b_span: tuple[str, str],
    width: int,
    levels: int,
    factor: int,
) -> DataFrame:
    """Pairs of intervals that share a cell of the ladder, before their spans are compared; see `overlap_join`."""

    def filed(df: DataFrame, span: tuple[str, str], own: str) -> DataFrame:
        s, e = (F.col(x).cast("bigint") for x in span)
        level = F.lit(levels - 1)
        for i in reversed(range(levels - 1)):
            level = F.when(e - s <= width * factor**i, F.lit(i)).otherwise(level)
        df = df.withColumn(own, level).withColumn(
            "_level", F.explode(F.sequence(F.col(own), F.lit(levels - 1)))
        )
        w = F.lit(width) * F.pow(F.lit(factor), F.col("_level"))
        lo, hi = F.floor(s / w).cast("bigint"), F.floor(e / w).cast("bigint")
        df = df.withColumn(own + "_lo", lo).withColumn("_cell", F.explode(F.sequence(lo, hi)))
        return df.withColumn(own, F.col("_level") == F.col(own))

    fa = filed(a.filter(F.col(a_span[0]) <= F.col(a_span[1])), a_span, "_la")
    fb = filed(b.filter(F.col(b_span[0]) <= F.col(b_span[1])), b_span, "_lb")
    on = [*keys, "_level", "_cell"]
    # rows of their own level meet all of the other side; coarser copies meet only rows whose own level that is, so two short
    # intervals never meet on a coarse level
    return fa.filter("_la").join(fb, on).unionByName(fa.filter("not _la").join(fb.filter("_lb"), on))


def overlap_join(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    a_span: tuple[str, str],
    b_span: tuple[str, str],
    width: int = WIDTH,
    levels: int = 4,
    factor: int = 16,
) -> DataFrame:
    """All pairs of overlapping intervals with equal keys; touching inclusive ends overlap.

    Intervals are filed on a ladder of bin widths. Each takes the level where it spans at most two bins (the top level
    takes whatever is longer) and is also filed on the coarser levels; a pair meets on the coarser of its two levels, in
    the first bin they share. A long interval therefore costs a few rows, not one per bin. All other column names of the
    two frames must differ.
    """
    j = meetings(a, b, keys, a_span, b_span, width, levels, factor).filter(
        (F.col("_cell") == F.greatest("_la_lo", "_lb_lo"))
        & (F.col(a_span[0]) <= F.col(b_span[1]))
        & (F.col(b_span[0]) <= F.col(a_span[1]))
    )
    return j.drop("_level", "_cell", "_la", "_lb", "_la_lo", "_lb_lo")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_pos: str,
    right_pos: str,
    values: Sequence[str],
    backward: bool = True,
    inclusive: bool = True,
    width: int = WIDTH,
) -> DataFrame:
    """For each left row the values of the nearest right row at or before (after) its position, else NULL.

    Of several right rows at one position the smallest value tuple is taken. Only distinct positions are sorted; the
    answers are joined back to the left rows.
    """
    side = 1 if backward == inclusive else -1
    lp = F.col(left_pos).cast("bigint") * 2 + side
    rp = F.col(right_pos).cast("bigint") * 2
    marks = right.groupBy(*keys, rp.alias("pos")).agg(F.min(F.struct(*values)).alias("_r"))
    asks = left.select(*keys, lp.alias("pos")).distinct()
    u = _known(marks.unionByName(asks, allowMissingColumns=True), *keys, "pos").withColumn("_bin", _bin("pos", width * 2))
    # the rows up to this one, coming from the side the answer lies on
    order = Window.partitionBy(*keys, "_bin").orderBy("pos" if backward else F.desc("pos"))
    near = F.last("_r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    if backward:
        far, edge = F.last("_e", ignorenulls=True).over(_bins_before(keys)), F.max_by("_r", "_k")
    else:
        far, edge = F.last("_e", ignorenulls=True).over(_bins_after(keys)), F.min_by("_r", "_k")
    u = u.withColumn("_near", near).withColumn("_k", F.when(F.col("_r").isNotNull(), F.col("pos")))
    u = _carry(u, keys, {"_e": edge}, {"_far": far})
    hit = F.coalesce("_near", "_far")
    answers = u.filter(F.col("pos") % 2 != 0).select(
        *keys, F.col("pos").alias("_pos"), *[hit[v].alias(v) for v in values]
    )
    # as many answers as left rows have positions: where those come from an explode Spark takes them for few and would broadcast them
    return left.withColumn("_pos", lp).join(answers.hint("merge"), [*keys, "_pos"], "left").drop("_pos")


def first_overlap_join(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    a_span: tuple[str, str],
    b_span: tuple[str, str],
    b_id: str,
    width: int = WIDTH,
) -> DataFrame:
    """For each interval of `a` the overlapping interval of `b` with the smallest (start, end, id), else NULL.

    Sorted by (start, end), the answer is the first interval whose end reaches the query start, and such an interval
    always raises the running maximum of ends. So only those record holders are kept, and one forward as-of join on the
    end finds the answer: no list of overlapping pairs is made.
    """
    bs, be = b_span
    x = _known(b, *keys, bs, be).groupBy(*keys, bs, be).agg(F.min(b_id).alias(b_id)).withColumn("_bin", _bin(bs, width))
    prior = Window.partitionBy(*keys, "_bin").orderBy(bs, be).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_m", F.max(be).over(prior))
    x = _carry(x, keys, {"_top": F.max(be)}, {"_mb": F.max("_top").over(_bins_before(keys))})
    seen = F.greatest("_m", "_mb")
    records = x.filter(seen.isNull() | (F.col(be) > seen)).select(*keys, bs, be, b_id)
    got = asof_join(
        a, records.withColumn("_end", F.col(be)), keys, a_span[0], "_end", [bs, be, b_id], backward=False, width=width
    )
    ok = F.col(bs) <= F.col(a_span[1])
    return got.withColumns({c: F.when(ok, F.col(c)) for c in (b_id, be)}).withColumn(
        bs, F.when(F.col(b_id).isNotNull(), F.col(bs))
    )


def nearest_join(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    a_span: tuple[str, str],
    b_span: tuple[str, str],
    b_values: Sequence[str],
    max_gap: int = 1000,
    width: int = WIDTH,
) -> DataFrame:
    """Nearest interval of `b` that ends before or starts after each interval of `a`, at most max_gap away.

    The left neighbour wins a tie of distance. Adds side ('left'/'right'), gap and the values, NULL when none is near.
    """
    bs, be = b_span
    vals = [bs, be, *b_values]
    lcols, rcols = {v: f"_l_{v}" for v in vals}, {v: f"_r_{v}" for v in vals}
    lb = b.withColumns({n: F.col(v) for v, n in lcols.items()}).select(*keys, *lcols.values())
    rb = b.withColumns({n: F.col(v) for v, n in rcols.items()}).select(*keys, *rcols.values())
    j = asof_join(a, lb, keys, a_span[0], lcols[be], list(lcols.values()), True, False, width)
    j = asof_join(j, rb, keys, a_span[1], rcols[bs], list(rcols.values()), False, False, width)
    lgap = F.col(a_span[0]) - F.col(lcols[be])
    rgap = F.col(rcols[bs]) - F.col(a_span[1])
    lgap, rgap = F.when(lgap <= max_gap, lgap), F.when(rgap <= max_gap, rgap)
    left = lgap.isNotNull() & (rgap.isNull() | (lgap <= rgap))
    side = F.when(left, F.lit("left")).when(rgap.isNotNull(), F.lit("right"))
    j = j.withColumn("side", side).withColumn("gap", F.when(left, lgap).otherwise(rgap).cast("bigint"))
    pick = {
        v: F.when(F.col("side") == "left", F.col(lcols[v])).when(F.col("side") == "right", F.col(rcols[v]))
        for v in vals
    }
    return j.withColumns(pick).drop(*lcols.values(), *rcols.values())


def cds_offsets(exons: DataFrame, key: str, start: str, end: str, strand: str) -> DataFrame:
    """Exons with `cds_start`: the number of coding bases before them in transcript order (descending on minus)."""
    order = F.when(F.col(strand) == "-", -F.col(start)).otherwise(F.col(start))
    e = exons.withColumn("pos", order.cast("bigint")).withColumn("_len", F.col(end) - F.col(start) + 1)
    sw = sweep(e.select(key, "pos", "_len"), [key], ["_len"])
    off = sw.select(key, "pos", (F.col("n__len") - F.col("_len")).cast("bigint").alias("cds_start"))
    return e.join(off, [key, "pos"]).drop("pos", "_len")


def lift_to_cds(
    ranges: DataFrame, exons: DataFrame, key: str, r_span: tuple[str, str], e_span: tuple[str, str], strand: str
) -> DataFrame:
    """Genomic ranges as coding positions (0-based start, inclusive end), clipped to each exon they touch."""
    e = cds_offsets(exons, key, e_span[0], e_span[1], strand)
    j = overlap_join(ranges, e, [key], r_span, e_span)
    lo, hi = F.greatest(r_span[0], e_span[0]), F.least(r_span[1], e_span[1])
    minus = F.col(strand) == "-"
    first = F.when(minus, F.col(e_span[1]) - hi).otherwise(lo - F.col(e_span[0]))
    return j.withColumn("cds_lo", (F.col("cds_start") + first).cast("bigint")).withColumn(
        "cds_hi", (F.col("cds_lo") + hi - lo).cast("bigint")
    )


def lift_to_genome(
    ranges: DataFrame, exons: DataFrame, key: str, r_span: tuple[str, str], e_span: tuple[str, str], strand: str
) -> DataFrame:
    """Coding ranges (0-based inclusive) back to genomic ranges, one row per exon they touch."""
    e = cds_offsets(exons, key, e_span[0], e_span[1], strand).withColumn(
        "_cend", F.col("cds_start") + F.col(e_span[1]) - F.col(e_span[0])
    )
    j = overlap_join(ranges, e, [key], r_span, ("cds_start", "_cend"))
    lo = F.greatest(F.col(r_span[0]), F.col("cds_start")) - F.col("cds_start")
    hi = F.least(F.col(r_span[1]), F.col("_cend")) - F.col("cds_start")
    minus = F.col(strand) == "-"
    s, t = F.col(e_span[0]), F.col(e_span[1])
    return (
        j.withColumn("genome_lo", F.when(minus, t - hi).otherwise(s + lo).cast("bigint"))
        .withColumn("genome_hi", F.when(minus, t - lo).otherwise(s + hi).cast("bigint"))
        .drop("_cend")
    )


def detect_bed_convention(bed: DataFrame, seqs: DataFrame, key: str, start: str, end: str, length: str) -> DataFrame:
    """Vote on whether starts are 0- or 1-based: transcripts whose exon lengths sum to the sequence length."""
    sums = bed.groupBy(key).agg(
        F.sum(F.col(end) - F.col(start)).alias("_z"), F.sum(F.col(end) - F.col(start) + 1).alias("_o")
    )
    j = sums.join(seqs.select(key, length), key)
    v = j.agg(
        F.count_if(F.col("_z") == F.col(length)).alias("zero_based"),
        F.count_if(F.col("_o") == F.col(length)).alias("one_based"),
    )
    return v.withColumn("convention", F.when(F.col("one_based") > F.col("zero_based"), 1).otherwise(0))
