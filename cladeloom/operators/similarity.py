"""Similarity of sequences by shared k-mers: a table join in place of a search program. Its scores are not E-values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import number_within
from ..session import cut_lineage
from .intervals import union_length


def distinct_sequences(df: DataFrame, id_col: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """One representative per distinct sequence and the (id, rep) map: copies take no further part in a join."""
    reps = df.groupBy(F.col(seq).alias("seq")).agg(F.min(id_col).alias("rep"), F.count("*").alias("n_copies"))
    return reps, df.select(F.col(id_col).alias("id"), F.col(seq).alias("seq")).join(reps, "seq").select("id", "rep")


# letters of a piece, which travels by itself, and of the chunks it is read in: positions in a string are found by
# counting from its start, so both stay short
PIECE, CHUNK = 1 << 16, 1 << 8
SALTS = 16


def _cut(df: DataFrame, text: str, size: int, k: int, at: str) -> DataFrame:
    """Rows of at most size + k - 1 letters that overlap by k - 1, with the 0-based place of each."""
    starts = F.sequence(F.lit(0), F.length(text) - k, F.lit(size))
    keep = [c for c in df.columns if c != text]
    x = df.filter(F.length(text) >= k).select(*keep, text, F.explode(starts).alias(at))
    return x.withColumn(text, F.substring(F.col(text), F.col(at) + 1, F.lit(size + k - 1)))


def _pieces(df: DataFrame, id_col: str, k: int) -> DataFrame:
    """(rep, seq) in pieces with their places. A long sequence is spread over tasks."""
    return _cut(df.select(F.col("rep").alias(id_col), "seq"), "seq", PIECE, k, "_piece").repartition(id_col, "_piece")


def _placed_kmers(df: DataFrame, id_col: str, k: int) -> DataFrame:
    """Every k-mer of (rep, seq) with its 1-based place."""
    x = _cut(_pieces(df, id_col, k), "seq", CHUNK, k, "_chunk")
    cut = F.transform(F.sequence(F.lit(1), F.length("seq") - k + 1), lambda p: F.substring(F.col("seq"), p, F.lit(k)))
    x = x.select(id_col, (F.col("_piece") + F.col("_chunk")).alias("_at"), F.posexplode(cut).alias("_pos", "kmer"))
    return x.select(id_col, "kmer", (F.col("_at") + F.col("_pos") + 1).alias("pos"))


BITS, PAGE = 26, 15  # log2 of the bits of the map of wanted k-mers (8 MB, whatever the input) and of one of its rows


def kmer_bits(text: str, k: int) -> np.ndarray:
    """The bit of each k-mer of the text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(max(0, len(c) - k + 1), np.uint64)
    for j in range(k):
        h = h * np.uint64(1_000_003) + c[j : j + len(h)]
    return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)


def _bitmap(kmers: DataFrame, k: int) -> np.ndarray:
    """BITS bits, set for the k-mers of a table: a fixed number of rows reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate([np.empty(0, np.int64), *(kmer_bits(x.as_py(), k) for x in b.column(0))])
            yield pa.RecordBatch.from_arrays([pa.array(at >> PAGE), pa.array(at & (1 << PAGE) - 1)], names=["page", "bit"])

    bits = np.zeros(1 << BITS - 3, np.uint8)
    for r in kmers.select("kmer").mapInArrow(run, "page long, bit long").groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        bits[r["page"] << PAGE - 3 : r["page"] + 1 << PAGE - 3] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _likely_kmers(df: DataFrame, id_col: str, k: int, wanted: DataFrame) -> DataFrame:
    """Distinct (id, kmer) of (rep, seq) that may be among the k-mers of `wanted`: all that are, and few others.

    They are told from the rest where a piece lies, so the k-mers that no one asks for never become rows.
    """
    x = _pieces(df, id_col, k).drop("_piece")
    bits = df.sparkSession.sparkContext.broadcast(_bitmap(wanted, k).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.uint8)
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                own = []
                for v in part.column(1):
                    text = v.as_py()
                    at = kmer_bits(text, k)
                    at = np.flatnonzero(table[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                    own.append(list({text[i : i + k] for i in at.tolist()}))
                of = np.repeat(np.arange(part.num_rows), [len(o) for o in own])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array([m for o in own for m in o], pa.string())], names=[id_col, "kmer"])

    schema = x.select(id_col).schema.add("kmer", "string")
    return x.select(id_col, "seq").mapInArrow(run, schema).distinct()


def kmer_join(q: DataFrame, t: DataFrame, k: int, min_share: float) -> DataFrame:
    """Pairs in which at least min_share of the distinct k-mers of the query occur in the target.

    q and t are (rep, seq) tables of distinct sequences. Exact prefix filter: with the k-mers of a query ordered from
    rare to common, a target that shares need = ceil(min_share n) of n of them must hold m of the first n - need + m, whatever m; m is an
    eighth of need. Only those rare ones look for candidates, so a k-mer that occurs everywhere never multiplies out; what holds m of them
    is then counted in full. A k-mer in many targets is met in SALTS parts by target. Null and shorter sequences have no k-mers
    and are in no pair. Returns (query, target, n_shared, n_query, share).
    """
    kq = cut_lineage(_placed_kmers(q, "query", k).select("query", "kmer").distinct())
    # k-mers of targets that no query holds go before anything is shuffled or written; the few that pass the map go here
    kt = _likely_kmers(t, "target", k, kq).join(kq.select("kmer").distinct(), "kmer", "left_semi")
    kt = cut_lineage(kt.select("target", "kmer"))
    freq = kt.groupBy("kmer").agg(F.count("*").alias("f"))
    size = kq.groupBy("query").agg(F.count("*").alias("n_query"))
    present = kq.join(freq, "kmer", "left").select("query", "kmer", F.coalesce("f", F.lit(0)).alias("f"))
    ranked = number_within(present, ["query"], [F.col("f"), F.col("kmer")], "_r").join(size, "query")
    need = F.ceil(F.lit(min_share) * F.col("n_query"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    ranked = ranked.withColumn("_m", F.greatest(F.lit(1), F.ceil(need / 8)))
    probe = ranked.filter((F.col("_r") <= F.col("n_query") - need + F.col("_m")) & (F.col("f") > 0)).select("query", "kmer", "_m", salts)
    salted = kt.withColumn("_salt", F.pmod(F.hash("target"), F.lit(SALTS)))
    cand = probe.join(salted, ["kmer", "_salt"]).groupBy("query", "target").agg(F.count("*").alias("_n"), F.min("_m").alias("_m"))
    cand = cand.filter("_n >= _m").select("query", "target")
    shared = cand.join(kq, "query").join(kt, ["target", "kmer"]).groupBy("query", "target").agg(F.count("*").alias("n_shared")).join(size, "query")
    return shared.filter(F.col("n_shared") >= need).select("query", "target", "n_shared", "n_query", (F.col("n_shared") / F.col("n_query")).alias("share"))


def shared_spans(pairs: DataFrame, q: DataFrame, t: DataFrame, k: int) -> DataFrame:
    """Query and target positions covered by shared k-mers, as percentages, for the given pairs."""
    p = cut_lineage(pairs.select("query", "target").distinct())
    of = lambda df, name: _placed_kmers(df.join(p.select(F.col(name).alias("rep")).distinct(), "rep", "left_semi"), name, k)
    out = pairs
    for mine, other, a, b in (("query", "target", q, t), ("target", "query", t, q)):
        x = p.join(of(a, mine), mine).join(of(b, other).select(other, "kmer"), [other, "kmer"], "left_semi")
        x = x.select("query", "target", F.col("pos").alias("s"), (F.col("pos") + k - 1).alias("e"))
        c = union_length(x, ["query", "target"], "s", "e", "_c").join(a.select(F.col("rep").alias(mine), F.length("seq").alias("_len")), mine)
        out = out.join(c.select("query", "target", F.round(F.lit(100.0) * F.col("_c") / F.col("_len"), 2).alias(mine + "_pct")), ["query", "target"])
    return out
