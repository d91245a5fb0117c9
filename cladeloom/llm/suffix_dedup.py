"""Exact repeated strings across documents, by longest-previous-factor arrays over the places where a repeat can be."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import likely, written

MIN_BYTES = 400
GRAM = 64  # bytes of an anchor
PIECE = 1 << 19  # window starts handled at once in a long text
HOT_ANCHOR = 200  # anchors in more different segments are refined by counting instead
WINDOWS_AT_ONCE = 30_000  # suffixes sorted at once, if one anchor doesn't need more

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_LOW = np.uint64((1 << 20) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and its inverse, as many as were needed so far."""

    up = down = np.empty(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up = np.multiply.accumulate(np.full(n, _ODD))
            cls.down = np.multiply.accumulate(np.full(n, _INVERSE))
        return cls.up[:n], cls.down[:n]


def anchors(data: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchor of each `size`-byte window: its gram of least hash, the first of equals. Runs of windows with one anchor:
    start, number of windows, place of the anchor, its hash. Equal windows have equal anchors at equal distance."""
    n_windows, width = len(data) - size + 1, size - gram + 1
    up, down = Powers.of(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)))
    h = _mix((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])
    key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    table = np.concatenate((key, np.full(-len(key) % width, np.uint64(2**64 - 1)))).reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(back[:n_windows], ahead[width - 1 : width - 1 + n_windows]) & _LOW).astype(np.int64)
    start = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return start, np.diff(np.append(start, n_windows)), place[start], h[place[start]]


_RUN = "doc_id long, th long, anchor long, seg long, start long, n int, off int"


def _runs(size: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            rows = 0
            for k, value in enumerate(batch.column(2)):
                raw = value.as_py().encode()
                data = np.frombuffer(raw, np.uint8)
                for at in range(0, len(raw) - size + 1, PIECE):
                    start, n, place, h = anchors(data[at : at + PIECE + size - 1], size, gram)
                    digest = xxhash.xxh3_64_intdigest
                    segs = [digest(raw[s:e]) for s, e in zip((at + start).tolist(), (at + start + n + size - 1).tolist(), strict=True)]
                    new = np.full(len(start), k), h.view(np.int64), np.array(segs, np.uint64).view(np.int64), at + start, n, place - start
                    for c, x in zip(cols, new, strict=True):
                        c.append(x)
                    rows += len(start)
                if rows and (rows > 20_000 or k == batch.num_rows - 1):
                    yield _batch(batch, cols)
                    cols, rows = [[] for _ in range(6)], 0
            if rows:
                yield _batch(batch, cols)

    return run


def _batch(batch: pa.RecordBatch, cols: list[list[np.ndarray]]) -> pa.RecordBatch:
    at, h, seg, start, n, off = (np.concatenate(c) for c in cols)
    own = [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))]
    return pa.RecordBatch.from_arrays(
        [*own, *map(pa.array, (h, seg, start)), pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32))],
        ["doc_id", "th", "anchor", "seg", "start", "n", "off"],
    )


_PIECE = "doc_id long, th long, anchor long, start long, n int, off int, sole boolean, hot boolean, body binary"


def _bodies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            held = 0
            for row in range(batch.num_rows):
                raw = batch.column(2)[row].as_py().encode()
                key = {"doc_id": batch.column(0)[row].as_py(), "th": batch.column(1)[row].as_py()}
                for p in batch.column(3)[row].as_py():
                    body = raw[p["start"] : p["start"] + p["n"] + size - 1]
                    out.append({**key, **p, "body": body})
                    held += len(body)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_pylist(out, _PIECE_SCHEMA)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, _PIECE_SCHEMA)

    return run


_PIECE_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("th", pa.int64()), ("anchor", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("off", pa.int32()), ("sole", pa.bool_()), ("hot", pa.bool_()), ("body", pa.binary())]
)


def suffix_order(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes whose first bytes are the rows, ties by place, and whether each shares all of them with the one before it in
    that order: its longest common prefix, capped at the row length, is full."""
    order = np.argsort(windows.view(f"S{windows.shape[1]}").ravel(), kind="stable")
    # trailing zero bytes are compared as well: rows have one length, so padding never stands for them
    same = np.concatenate(([False], (windows[order[1:]] == windows[order[:-1]]).all(axis=1)))
    return order, same


def factors(order: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the longest previous factor, and the longest next one, of each place reach the full length.

    The longest previous factor comes from the previous or the next smaller place in suffix order. Where the common prefix
    is capped, suffixes that share it stand in order of their places, so the previous smaller place is the suffix just before
    and a next smaller one shares less; mirrored for the next factor.
    """
    earlier, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    earlier[order] = same
    later[order] = np.append(same[1:], False)
    return earlier, later


_FOUND = "doc_id long, th long, start long, stop long"


def _cold(size: int):
    def solve(rows: pa.Table) -> pa.RecordBatch:
        bodies = rows.column("body").to_pylist()
        n = rows.column("n").to_numpy()
        windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(np.frombuffer(b, np.uint8), size) for b in bodies])
        earlier, later = factors(*suffix_order(np.ascontiguousarray(windows)))
        repeated = earlier | later
        owner = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        use = repeated & rows.column("sole").to_numpy(zero_copy_only=False)[owner]
        owner, place = owner[use], place[use]
        first = np.concatenate(([True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1))) if len(owner) else np.empty(0, bool)
        begin, end = np.flatnonzero(first), np.flatnonzero(np.append(first[1:], True)) if len(owner) else np.empty(0, np.int64)
        base = rows.column("start").to_numpy()[owner[begin]]
        at = pa.array(owner[begin])
        ids = [rows.column(c).combine_chunks().take(at) for c in ("doc_id", "th")]
        return pa.RecordBatch.from_arrays([*ids, pa.array(base + place[begin]), pa.array(base + place[end] + size)], ["doc_id", "th", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; anchors are taken whole, several at once."""
        held: list[pa.RecordBatch] = []
        total, last = 0, None
        for batch in batches:
            anchor, n = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            at = 0
            for k in range(len(anchor)):
                if total > WINDOWS_AT_ONCE and anchor[k] != last:
                    held.append(batch.slice(at, k - at))
                    yield solve(pa.Table.from_batches(held))
                    held, total, at = [], 0, k
                total, last = total + int(n[k]), anchor[k]
            held.append(batch.slice(at))
        if total:
            yield solve(pa.Table.from_batches(held))

    return run


def _refined(pieces: DataFrame, size: int, spread: int) -> DataFrame:
    """Repeated windows among the segments of hot anchors, by counting: no anchor's segments meet in one task.

    Windows at distances d .. d + w - 1 before the anchor all hold the same size - w + 1 bytes, the core. If a core is found
    once, none of those windows repeats; if all finds of a core agree in all their bytes, all do; else the range of
    distances is cut in parts. At w = 1 core and window are one. Counts combine before they are shuffled.
    """
    rest = pieces.select("doc_id", "th", "anchor", "start", "n", "off", "sole", "body")
    found = None
    while True:
        step = max(1, -(-spread // 7))
        # distances of a segment's windows: off, off - 1, .., off - n + 1; parts are aligned to multiples of the step
        part = F.explode(F.sequence(F.floor((F.col("off") - F.col("n") + 1) / step), F.floor(F.col("off") / step))).alias("part")
        cut = rest.select("*", part)
        high = F.least("off", F.col("part") * step + step - 1)
        low = F.greatest(F.col("off") - F.col("n") + 1, F.col("part") * step)
        skip = F.col("off") - high
        cut = cut.select(
            "doc_id", "th", "anchor", "part", "sole",
            (F.col("start") + skip).alias("start"), (high - low + 1).cast("int").alias("n"), high.cast("int").alias("off"),
            F.substring("body", (skip + 1).cast("int"), (high - low + F.lit(size)).cast("int")).alias("body"),
        )
        # from where the nearest window of the part starts to where the farthest one ends: every window of the part holds it
        core_at = F.col("off") - F.col("part") * step
        core = F.substring("body", (core_at + 1).cast("int"), F.lit(size - step + 1))
        cut = cut.withColumns({"core": F.xxhash64("anchor", "part", core), "full": F.xxhash64("body")})
        cut = written(cut, "refine")
        stats = cut.groupBy("core").agg(F.count("*").alias("finds"), F.min("full").alias("lo"), F.max("full").alias("hi")).where("finds > 1")
        seen = written(cut.join(stats, "core"), "refine-seen")
        done = seen.where("lo = hi and sole").select("doc_id", "th", "start", (F.col("start") + F.col("n") + size - 1).alias("stop"))
        found = done if found is None else found.union(done)
        rest = seen.where("lo <> hi").select(*rest.columns)
        if step == 1 or rest.isEmpty():
            return found
        spread = step


def repeated_spans(docs: DataFrame, size: int = MIN_BYTES, gram: int = GRAM) -> DataFrame:
    """(doc_id, th, spans) of the texts with a repeat, th the xxhash64 of the text: byte ranges [start, stop) whose union is every byte
    that a repeated string of `size` bytes covers.

    Equal windows of `size` bytes choose equal anchors, so windows are compared only under one anchor. Segments (all windows
    of one anchor in one place) that are found twice as a whole are repeats, whatever their number; they are counted, not
    gathered. Anchors with several different segments send those, one of each, to one task, where suffix order and
    previous-factor arrays over their windows tell which windows are repeated; anchors with over HOT_ANCHOR different segments
    are refined by counting instead. Segments are told apart by a 64-bit hash.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("th"), text.alias("text"))
    long = texts.where(F.octet_length("text") >= size)
    runs = written(long.mapInArrow(_runs(size, gram), _RUN), "runs")
    place = F.struct("doc_id", "th", "start", "n", "off")
    segs = written(runs.groupBy("anchor", "seg").agg(F.count("*").alias("finds"), F.min(place).alias("p")), "segments")
    per = segs.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    mixed = segs.join(per, "anchor").select("anchor", "p.*", (F.col("finds") == 1).alias("sole"), (F.col("kinds") > HOT_ANCHOR).alias("hot"))
    mixed = written(mixed, "mixed")
    lists = mixed.groupBy("doc_id", "th").agg(F.collect_list(F.struct("anchor", "start", "n", "off", "sole", "hot")).alias("own"))
    once = long.where(likely(mixed, "th", F.col("th"))).alias("t")
    lists = lists.alias("l")
    joined = once.join(lists, F.col("t.th").eqNullSafe(F.col("l.th")) & F.col("t.doc_id").eqNullSafe(F.col("l.doc_id")))
    joined = joined.select("t.doc_id", "t.th", "t.text", "l.own")
    pieces = written(joined.mapInArrow(_bodies(size), _PIECE), "pieces")
    cold = pieces.where("not hot").repartition("anchor").sortWithinPartitions("anchor")
    found = cold.mapInArrow(_cold(size), _FOUND)
    hot = pieces.where("hot")
    if not hot.isEmpty():
        found = found.union(_refined(hot, size, size - gram + 1))
    many = segs.where("finds > 1").select("anchor", "seg")
    whole = runs.join(many, ["anchor", "seg"]).select("doc_id", "th", "start", (F.col("start") + F.col("n") + size - 1).alias("stop"))
    all_found = found.union(whole)
    return all_found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping and touching ranges as one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    return np.stack((spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]), axis=1)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            out = []
            for row in batch.slice(a, 500).to_pylist():
                raw = row["text"].encode()
                spans = merged(np.array([(s["start"], s["stop"]) for s in row["spans"]])) if row["spans"] else np.empty((0, 2), np.int64)
                edge = [0, *spans.ravel().tolist(), len(raw)]
                kept = b"".join(raw[s:e] for s, e in zip(edge[::2], edge[1::2], strict=True))
                out.append((row["doc_id"], len(raw), len(raw) - len(kept), len(spans), kept, kept.decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=_KEPT_SCHEMA)


_KEPT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("text", pa.string())])


def remove_repeats(docs: DataFrame, size: int = MIN_BYTES, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, text) of every document row, `kept` being the remaining bytes and `text` the same as a
    string, in which a character that was cut apart is U+FFFD.

    Every byte that a string of `size` bytes covers goes, if the string also starts anywhere else: in another row, or elsewhere in
    its own; all copies lose it. A null text is an empty one; null doc_ids and repeated rows stay rows, and repeated rows are
    copies of each other. Texts shorter than `size` lose nothing.
    """
    spans = written(repeated_spans(docs, size, gram), "spans")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("th"), text.alias("text"))
    marked = texts.withColumn("likely", likely(spans, "th", F.col("th")))
    n = F.octet_length("text").cast("long")
    none = F.lit(0).cast("long")
    clean = marked.where("not likely").select("doc_id", n.alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("text").cast("binary").alias("kept"), "text")
    a, b = marked.where("likely").alias("a"), spans.alias("b")
    both = a.join(b, F.col("a.th").eqNullSafe(F.col("b.th")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), "left").select("a.doc_id", "a.text", "b.spans")
    cut = both.mapInArrow(_cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, text string")
    return clean.union(cut)


def digests(docs: DataFrame, size: int = MIN_BYTES) -> DataFrame:
    """remove_repeats with a digest of the remaining bytes instead of the bytes."""
    return remove_repeats(docs, size).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "text")
