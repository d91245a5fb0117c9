"""Scans of one aligned row against its reference row.

These need running positions over alignment columns, which array lambdas can only give at quadratic cost. Each is an
Arrow-batched pandas function with a few numpy operations per row, applied where the row lives: no shuffle.
Positions are 1-based reference positions unless a name says column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf, pandas_udf

from .seq import IUPAC, STOPS

GAP, N = 45, 78
BASES = np.frombuffer(b"ACGT", np.uint8)
INT = T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def _structs(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(_struct(**fields))


_STOP = {s.encode() for s in STOPS}


def _arr(s: str) -> np.ndarray:
    return np.frombuffer(s.upper().encode("latin-1", "replace"), np.uint8)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of every run of True."""
    d = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1) - 1


def _triples(bases: np.ndarray, wanted: set[bytes]) -> np.ndarray:
    """Indices of the frame-0 codons that are in the set."""
    n = len(bases) // 3
    hit = np.zeros(n, bool)
    c = bases[: 3 * n].reshape(n, 3)
    for w in wanted:
        hit |= (c == np.frombuffer(w, np.uint8)).all(axis=1)
    return np.flatnonzero(hit)


def _first_codon(bases: np.ndarray) -> set[bytes]:
    """The first codon as a one-member set; nothing if there are under three bases."""
    return {bases[:3].tobytes()} if len(bases) >= 3 else set()


def _pair(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """Reference and row as arrays of one length: an unequal pair is no alignment."""
    r, q = _arr(a), _arr(b)
    if len(r) != len(q):
        raise ValueError(f"reference and row of an alignment differ in length: {len(r)} and {len(q)}")
    return r, q


def _breaks(r: np.ndarray, q: np.ndarray, first: int) -> np.ndarray:
    """Positions where the reference frame breaks: stops before the last codon, gap runs that shift the frame."""
    base = r != GAP
    pos = np.cumsum(base)
    n = int(pos[-1]) if len(pos) else 0
    stop = _triples(q[base], _STOP) * 3
    cuts = [stop[stop < n - 3 - n % 3] + 1]
    for mask, low in ((base & (q == GAP), 1), (~base & (q != GAP), first)):
        s, e = _runs(mask)
        shift = (e - s + 1) % 3 != 0
        cuts.append(np.maximum(pos[s[shift]], low))
    return np.unique(np.concatenate(cuts))


def _gap_runs(ref: pa.Array, row: pa.Array) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """Runs and reference bases of each row, and of all runs the kind, start, end, length and inserted bases, as columns."""
    kinds, starts, ends, lengths, seqs, sizes, bases = [], [], [], [], [], [0], []
    for a, b in zip(ref.to_pylist(), row.to_pylist(), strict=True):
        r, q = _pair(a or "", b or "")
        pos = np.cumsum(r != GAP)
        bases.append(int(pos[-1]) if len(pos) else 0)
        for kind, mask in ((0, (r != GAP) & (q == GAP)), (1, (r == GAP) & (q != GAP))):
            s, e = _runs(mask)
            kinds.append(np.full(len(s), kind, np.int32))
            starts.append(pos[s])
            ends.append(pos[e])
            lengths.append(e - s + 1)
            upper = b.upper() if kind and b else ""
            seqs += [upper[i:j] for i, j in zip(s.tolist(), (e + 1).tolist(), strict=True)]
        sizes.append(len(seqs))
    whole = lambda x: pa.array(np.concatenate(x).astype(np.int32) if x else np.empty(0, np.int32))
    kind = pa.array(["deletion", "insertion"]).take(whole(kinds))
    return np.diff(sizes), np.array(bases, np.int32), [kind, whole(starts), whole(ends), whole(lengths), pa.array(seqs, pa.string())]


RUN_CHARS = 1_000_000  # characters of rows whose runs are held at once


def gap_run_rows(keys: list[str], ref: str, row: str):
    """For mapInArrow: one row per maximal deletion or insertion run, with the keys and the reference length of its row.

    A batch of rows may hold millions of runs, so they leave in parts; an array per row would gather them all first.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars = pc.fill_null(pc.binary_length(batch.column(ref)), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(chars, dtype=np.int64) // RUN_CHARS
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                x = batch.slice(lo, hi - lo)
                sizes, bases, fields = _gap_runs(x.column(ref), x.column(row))
                at = pa.array(np.repeat(np.arange(x.num_rows), sizes))
                own = [x.column(k).take(at) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(bases).take(at), *fields], names=[*keys, "ref_len", "kind", "start", "end", "length", "seq"])

    return scan


@pandas_udf(_structs(start=INT, end=INT, codon=T.StringType()))
def frame_stops(ref: pd.Series, row: pd.Series) -> pd.Series:
    """Stops read in the reference frame, at their reference positions."""
    def one(a: str, b: str):
        r, q = _pair(a, b)
        bases = q[r != GAP]
        return [(3 * int(i) + 1, 3 * int(i) + 3, bases[3 * i : 3 * i + 3].tobytes().decode()) for i in _triples(bases, _STOP)]

    return pd.Series([one(a, b) for a, b in zip(ref, row)])


@pandas_udf(T.ArrayType(INT))
def frame_breaks(ref: pd.Series, row: pd.Series) -> pd.Series:
    return pd.Series([_breaks(_arr(a), _arr(b), 1).astype(np.int32) for a, b in zip(ref, row)])


@pandas_udf(T.DoubleType())
def in_frame_pct(ref: pd.Series, row: pd.Series) -> pd.Series:
    """Longest stretch without a frame break, as a percentage of the reference bases."""
    def one(a: str, b: str):
        r, q = _pair(a, b)
        n = int((r != GAP).sum())
        c = np.concatenate(([0], _breaks(r, q, 0)))
        inner = np.diff(c) - 1
        best = max(int(inner.max()) if len(inner) else 0, n - int(c[-1]), 0)
        return 100.0 * best / n if n else 0.0

    return pd.Series([one(a, b) for a, b in zip(ref, row)])


@pandas_udf(_struct(ref_first=T.StringType(), first_codon=T.StringType(), aligned=INT, n=INT))
def reference_view(ref: pd.Series, row: pd.Series) -> pd.DataFrame:
    """The first three reference bases, what the row holds at them, and the row's known bases among all n reference bases."""
    def one(a: str, b: str):
        r, q = _pair(a, b)
        base = r != GAP
        at = q[base]
        return r[base][:3].tobytes().decode("latin-1"), at[:3].tobytes().decode("latin-1"), int(((at != GAP) & (at != N)).sum()), len(at)

    return pd.DataFrame([one(*v) for v in zip(ref, row)], columns=["ref_first", "first_codon", "aligned", "n"])


@pandas_udf(_structs(start=INT, end=INT))
def start_codons(ref: pd.Series, row: pd.Series) -> pd.Series:
    """ATG codons of the gap-free row in its own frame 0, at the reference positions of their first and last base."""
    def one(a: str, b: str):
        r, q = _pair(a, b)
        pos, cols = np.cumsum(r != GAP), np.flatnonzero(q != GAP)
        return [(int(pos[cols[3 * i]]), int(pos[cols[3 * i + 2]])) for i in _triples(q[cols], {b"ATG"})]

    return pd.Series([one(a, b) for a, b in zip(ref, row)])


def orfs(starts: tuple[str, ...] = ("ATG",), count_stop: bool = False, focal_start: bool = False):
    """All ORFs of the three forward frames of the gap-free row.

    An ORF opens at the first start codon after a stop of its frame and runs to the next stop or the end. The result
    gives its length, first and last column (1-based), and how many of its codons begin on a reference codon.
    focal_start adds the first reference codon to the start codons.
    """

    @pandas_udf(_structs(frame=INT, length=INT, first_col=INT, last_col=INT, in_frame=INT))
    def scan(ref: pd.Series, row: pd.Series) -> pd.Series:
        def one(a: str, b: str):
            r, q = _pair(a, b)
            cols = np.flatnonzero(q != GAP)
            s, base = q[cols], r != GAP
            codon_start = base & ((np.cumsum(base) - 1) % 3 == 0)
            want = {x.encode() for x in starts}
            if focal_start:
                want |= _first_codon(r[base])
            out = []
            for f in range(3):
                n = (len(s) - f) // 3
                begin = _triples(s[f:], want)
                stop = np.append(_triples(s[f:], _STOP), n)
                block = np.searchsorted(stop, begin, side="left")
                _, lead = np.unique(block, return_index=True)
                for i in lead:
                    first, end = int(begin[i]), int(stop[block[i]])
                    last = end + 1 if count_stop and end < n else end
                    if last <= first:
                        continue
                    c = cols[f + 3 * np.arange(first, last)]
                    out.append((f, 3 * (last - first), int(c[0]) + 1, int(cols[f + 3 * last - 1]) + 1, int(codon_start[c].sum())))
            return out

        return pd.Series([one(a, b) for a, b in zip(ref, row)])

    return scan


def focal_frame_orf(min_span: float, min_bases: float, starts: tuple[str, ...] = ("ATG",), focal_start: bool = True):
    """Best unbroken stretch that opens with a start codon in the reference frame: (has, span %, bases %).

    The stretch runs to the next frame break; bases are the row's own bases in it. A stretch passing both cuts beats
    any other; among equals the longer span, then the earlier, wins.
    """

    @pandas_udf(_struct(has=T.BooleanType(), span=T.DoubleType(), bases=T.DoubleType()))
    def scan(ref: pd.Series, row: pd.Series) -> pd.DataFrame:
        def one(a: str, b: str):
            r, q = _pair(a, b)
            base = r != GAP
            at = q[base]
            n = len(at)
            want = {x.encode() for x in starts}
            if focal_start:
                want |= _first_codon(r[base])
            k = _triples(at, want) * 3
            if not len(k):
                return False, 0.0, 0.0
            cuts = np.append(_breaks(r, q, 1), n + 1)
            end = cuts[np.searchsorted(cuts, k + 1, side="right").clip(max=len(cuts) - 1)] - 1
            own = np.concatenate(([0], np.cumsum((at != GAP) & (at != N))))
            span, bases = 100.0 * (end - k) / n, 100.0 * (own[end] - own[k]) / n
            ok = (span >= min_span) & (bases >= min_bases)
            pool = ok if ok.any() else np.ones(len(k), bool)
            # the first passing stretch is taken even when a later one is longer only by a tie
            i = np.flatnonzero(pool)[np.argmax(span[pool])]
            return bool(ok.any()), float(span[i]), float(bases[i])

        return pd.DataFrame([one(a, b) for a, b in zip(ref, row)], columns=["has", "span", "bases"])

    return scan


def orf_call(df, ref: str, row: str, min_len: float, min_cov: float, min_frame: float = 0.0, count_stop: bool = False, measure: str = "contiguous"):
    """Add `has_orf` and the percentages that decided it, by one of three measures.

    contiguous: focal_frame_orf with the frame cut as span and the length cut as bases (the coverage cut is unused).
    orf: one ORF must pass length, coverage and in-frame share. row: the longest ORF passes length and coverage, and
    the row's longest unbroken frame passes the frame cut.
    """
    n = F.length(F.replace(F.col(ref), F.lit("-"), F.lit("")))
    df = df.withColumn("row_in_frame", in_frame_pct(ref, row))
    if measure == "contiguous":
        df = df.withColumn("_b", focal_frame_orf(min_frame, min_len)(ref, row))
        return df.withColumn("has_orf", F.col("_b.has")).withColumn("len_pct", F.col("_b.bases")).withColumn(
            "cov_pct", F.col("_b.span")).withColumn("frame_pct", F.col("_b.span")).drop("_b")
    if measure not in ("orf", "row"):
        raise ValueError("measure must be orf, row or contiguous")
    df = df.withColumn("_o", orfs(count_stop=count_stop, focal_start=True)(ref, row))
    pct = lambda x: F.lit(100.0) * x / n
    cover = lambda o: F.length(F.replace(F.substring(F.col(ref), o["first_col"], o["last_col"] - o["first_col"] + 1), F.lit("-"), F.lit("")))
    scored = F.transform("_o", lambda o: F.struct(
        pct(o["length"]).alias("len_pct"), pct(cover(o)).alias("cov_pct"), pct(o["in_frame"] * 3).alias("frame_pct"),
        (-o["frame"]).alias("f"), (-o["first_col"]).alias("c")))
    df = df.withColumn("_s", F.reverse(F.array_sort(F.transform(scored, lambda s: F.struct(s["len_pct"], s["f"], s["c"], s["cov_pct"], s["frame_pct"])))))
    fits = lambda s: (s["len_pct"] >= min_len) & (s["cov_pct"] >= min_cov)
    top = F.try_element_at(F.col("_s"), F.lit(1))
    if measure == "row":
        has, best = F.coalesce(fits(top), F.lit(False)) & (F.col("row_in_frame") >= min_frame), top
    else:
        good = F.filter("_s", lambda s: fits(s) & (s["frame_pct"] >= min_frame))
        has, best = F.size(good) > 0, F.coalesce(F.try_element_at(good, F.lit(1)), top)
    df = df.withColumn("_h", has).withColumn("_b", best)
    zero = lambda c: F.coalesce(F.col("_b")[c], F.lit(0.0))
    return df.withColumn("has_orf", F.col("_h")).withColumn("len_pct", zero("len_pct")).withColumn("cov_pct", zero("cov_pct")).withColumn(
        "frame_pct", zero("frame_pct")).drop("_o", "_s", "_h", "_b")


@arrow_udf(_structs(finding=T.StringType()))
def recheck_spans(ref: pa.Array, row: pa.Array, spans: pa.Array) -> pa.Array:
    """What each reported span is in the alignment: unaligned_end, mask_remainder, exact, or not_a_gap.

    Spans are read and findings built as columns: as one object per span a batch of long rows would not fit a worker.
    """
    flat = spans.flatten()
    first, last = (flat.field(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
    ends = np.concatenate(([0], np.cumsum(spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    kinds = np.zeros(len(first), np.int32)
    for k, (a, b) in enumerate(zip(ref, row, strict=True)):
        r, q = _pair(a.as_py(), b.as_py())
        gap = q[r != GAP] == GAP
        n = len(gap)
        lo, hi = _runs(gap)
        part = slice(ends[k], ends[k + 1])
        s, e = first[part], last[part]
        if not len(lo):
            continue
        i = np.searchsorted(lo, s - 1, side="right") - 1
        inside = (s >= 1) & (s <= e) & (e <= n) & (i >= 0) & (hi[i] >= e - 1)
        edge = (lo[i] == 0) | (hi[i] == n - 1)
        exact = (lo[i] == s - 1) & (hi[i] == e - 1)
        kinds[part] = np.where(~inside, 0, np.where(edge, 1, np.where(exact, 2, 3)))
    finding = pa.array(["not_a_gap", "unaligned_end", "exact", "mask_remainder"]).take(pa.array(kinds))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([finding], ["finding"]))


def flags_at(reach: int = 5, margin: int = 9):
    """For each reference position of a row: four equal bases within four positions, a place within `margin` of an end, and an N of the row
    within `reach` columns. All are differences of two ranks, so an event costs the same in a long row as in a short one."""

    @arrow_udf(_structs(homopolymer=T.BooleanType(), at_edge=T.BooleanType(), n_nearby=T.BooleanType()))
    def scan(ref: pa.Array, row: pa.Array, positions: pa.Array) -> pa.Array:
        sizes, fields = [], ([], [], [])
        for a, b, at in zip(ref, row, positions):
            text = a.as_py()
            r, q = _pair(text, b.as_py())
            cols = np.flatnonzero(r != GAP)
            p = at.values.to_numpy(zero_copy_only=False).astype(np.int64)
            n = len(cols)
            d = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)[cols]
            same = (d[1:] == d[:-1]) & np.isin(d[1:], BASES)
            four = np.zeros(n, bool)  # a run of four bases starts here
            four[: max(n - 3, 0)] = same[: max(n - 3, 0)] & same[1 : max(n - 2, 1)] & same[2:]
            before = np.concatenate(([0], np.cumsum(four)))
            lo, hi = np.clip(p - 5, 0, n), np.clip(p + 1, 0, n)  # a run may start from four before to one after
            fields[0].append(before[np.maximum(lo, hi)] > before[lo])
            fields[1].append((p <= margin) | (p >= n - margin))
            if n:
                col = cols[np.clip(p - 1, 0, n - 1)]
                rank = np.concatenate(([0], np.cumsum(q == N)))
                fields[2].append(rank[np.minimum(col + reach + 1, len(q))] > rank[np.maximum(col - reach, 0)])
            else:
                fields[2].append(np.zeros(len(p), bool))
            sizes.append(len(p))
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate([np.empty(0, bool), *f])) for f in fields], ["homopolymer", "at_edge", "n_nearby"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), flat)

    return scan


@pandas_udf(T.ArrayType(T.BooleanType()))
def sites_known(ref: pd.Series, row: pd.Series, sites: pd.Series) -> pd.Series:
    """Whether the row has a base other than N at every reference base of each site(pos, span); a site beyond the end is unknown."""
    def one(a: str, b: str, xs):
        r, q = _pair(a, b)
        letters = q[r != GAP]
        bad = np.concatenate(([0], np.cumsum((letters == GAP) | (letters == N))))
        lo = np.array([x["pos"] - 1 for x in xs], np.int64)
        hi = np.minimum(lo + [x["span"] for x in xs], len(letters))
        return [bool(0 <= i < j and bad[i] == bad[j]) for i, j in zip(lo, hi)]

    return pd.Series([one(*v) for v in zip(ref, row, sites)], dtype=object)


@arrow_udf(T.ArrayType(INT))
def columns_from(ref: pa.Array, first: pa.Array, positions: pa.Array) -> pa.Array:
    """For each coordinate the number of columns before it. An insertion counts to the letter before it, at the front of
    the row to the first letter, whose coordinate is `first`. Rows are looked at one by one where Arrow holds them, so a batch of long
    ones takes no more than itself and its answers."""
    out = []
    for a, s, at in zip(ref, first, positions):
        row = _arr(a.as_py())
        cols = np.append(np.flatnonzero(row != GAP), len(row))
        k = at.values.to_numpy(zero_copy_only=False).astype(np.int64) - s.as_py()
        out.append(np.where(k <= 0, 0, cols[np.clip(k, 0, len(cols) - 1)]).astype(np.int32))
    ends = np.cumsum([0, *map(len, out)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *out])))


_BITS = np.zeros(256, np.uint8)
_BITS[[ord(c) for c in IUPAC]] = list(IUPAC.values())
_PLAIN = np.isin(np.arange(256), [ord(c) for c in "ACGT"])


@pandas_udf(_struct(mode=T.StringType(), extra=T.ArrayType(INT), status=T.StringType(), accepted=T.StringType()))
def trim_reference(ref: pd.Series, cds: pd.Series, lens: pd.Series, rightmost: pd.Series, strand: pd.Series) -> pd.DataFrame:
    """How a reference row was extracted, its extra columns (1-based) and whether it is the coding sequence without them.

    lens are the exon lengths in transcript order, rightmost the 0-based index of the exon that ends furthest along the
    genome. Rows with a null argument give nulls.
    """
    def one(a, b, sizes, right, minus):
        if a is None or b is None or sizes is None:
            return None, None, None, None
        r, want, n = _arr(a), _arr(b), np.asarray(sizes, np.int64)
        cols = np.flatnonzero(r != GAP)
        over = len(cols) - len(want)
        has = np.zeros(len(n), bool)
        if over == len(n):
            mode, has[:] = "one_extra_per_exon", True
        elif len(n) > 1 and over == len(n) - 1:
            mode, has = "one_extra_per_exon_except_rightmost", np.arange(len(n)) != right
        elif over == 0:
            mode = "cds_length"
        else:
            return None, None, "UNEXPECTED_REFERENCE_LENGTH", None
        after = np.cumsum(n + has)
        extra = cols[(after - n - 1 if minus else after - 1)[has]]
        got = np.delete(r, extra)
        got = got[got != GAP]
        same = got == want
        if same.all():
            return mode, extra + 1, "OK", ""
        # every exon must be held in its place by a plain base that agrees
        anchors = np.concatenate(([0], np.cumsum(same & _PLAIN[want])))
        ends = np.cumsum(n)
        if (same | ((_BITS[got] & _BITS[want]) > 0)).all() and (anchors[ends] > anchors[ends - n]).all():
            at = np.flatnonzero(~same)
            return mode, extra + 1, "OK", ",".join(f"{i + 1}:{chr(got[i])}/{chr(want[i])}" for i in at.tolist())
        off = got[1:] != want[:-1] if minus else got[:-1] != want[1:]
        off[ends[(ends > 0) & (ends < len(want))] - 1] = False  # the base at an exon's end has no partner
        shifted = not len(extra) and not off.any()
        return mode, None, "EXTRACTION_SHIFTED" if shifted else "REFERENCE_MISMATCH_AFTER_TRIM", None

    rows = [one(a, b, n, k, d == "-") for a, b, n, k, d in zip(ref, cds, lens, rightmost, strand)]
    return pd.DataFrame(rows, columns=["mode", "extra", "status", "accepted"])


@pandas_udf(_struct(text=T.StringType(), in_gaps=INT, in_extra=INT))
def project_row(ref: pd.Series, row: pd.Series, extra: pd.Series) -> pd.DataFrame:
    """The row at the reference bases without the extra columns, and its bases in the columns removed as gaps and as extra."""
    def one(a, b, cols):
        r, q = (np.frombuffer(x.encode("latin-1", "replace"), np.uint8) for x in (a, b))
        base = r != GAP
        drop = np.asarray(cols, np.int64) - 1
        keep = base.copy()
        keep[drop] = False
        full = q != GAP
        return q[keep].tobytes().decode("latin-1"), int((full & ~base).sum()), int(full[drop].sum())

    return pd.DataFrame([one(*v) for v in zip(ref, row, extra)], columns=["text", "in_gaps", "in_extra"])
