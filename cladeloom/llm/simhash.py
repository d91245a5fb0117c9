"""SimHash fingerprints and their links, found with hierarchical indexes in Gray order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import likely, written

SEED = 42
FAN_OUT = 8  # children of an index node
HOT_GROUP = 20_000  # larger groups are divided again by the next bits
PAIRS_AT_ONCE = 1 << 19
CHUNK = 1 << 16  # shingles whose bits are counted at once
CLASSES = 24  # shingle classes that a text is fingerprinted in, at most
CLASS_SHINGLES = 4  # shingles a class has at least, on average
MEMBERS = 500  # texts that one task compares with a leader
PREFIX_BELOW = 200  # shingles: a pair with a smaller text is looked for by single shingles
SAMPLE = 20_000  # texts whose shingles are counted, about
COMMON = 10  # times that a shingle is in the sample, from which it is put behind rarer ones
ROUNDS = 3  # of comparisons with leaders, before what is left of the buckets is compared in full
PART = 256  # texts of a bucket that are held while others pass


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of each shingle of k words, repeats included. Words: A-Z lower-cased, parted by ASCII white space.

    Fewer than k words give one shingle of all of them; no words (also a null text) give none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - k + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(k, len(words)) - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; 0 for no hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), k)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long; null and empty texts get 0."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Hierarchy over codes sorted by (group, Gray rank).

    Neighbours in Gray order share most bits, so each node of FAN_OUT children keeps the bits that all codes below it share as
    a masked pattern. Two nodes differ at least in the shared bits in which their patterns differ: if those are more than the
    radius, no code below one lies within the radius of a code below the other, and the whole pair is pruned. Nodes never
    span groups, and the roots are one node a group.
    """

    def __init__(self, group: np.ndarray, codes: np.ndarray) -> None:
        self.order = np.lexsort((gray_rank(codes), group))
        group, codes = group[self.order], codes[self.order]
        self.both, self.some, self.first = [codes], [codes], []
        while len(group) > 1 and (group[1:] == group[:-1]).any():
            new = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            at = np.arange(len(group)) - np.repeat(new, np.diff(np.append(new, len(group))))
            first = np.flatnonzero(at % FAN_OUT == 0)
            self.both.append(np.bitwise_and.reduceat(self.both[-1], first))
            self.some.append(np.bitwise_or.reduceat(self.some[-1], first))
            self.first.append(np.append(first, len(group)))
            group = group[first]

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of sorted positions within the radius and in one group, in pieces of bounded size."""
        top = len(self.first)
        roots = np.arange(len(self.both[top]))
        stack = [(top, roots[a : a + 4096], roots[a : a + 4096]) for a in range(0, len(roots), 4096)]
        while stack:
            level, i, j = stack.pop()
            if level == 0:
                keep = i < j
                yield i[keep], j[keep]
                continue
            first, below = self.first[level - 1], level - 1
            ni, nj = first[i + 1] - first[i], first[j + 1] - first[j]
            per = ni * nj
            pair = np.repeat(np.arange(len(i)), per)
            at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
            a, b = first[i[pair]] + at // nj[pair], first[j[pair]] + at % nj[pair]
            keep = a <= b
            a, b = a[keep], b[keep]
            both, some = self.both[below], self.some[below]
            shared = ~(both[a] ^ some[a]) & ~(both[b] ^ some[b])
            keep = np.bitwise_count((both[a] ^ both[b]) & shared) <= radius
            a, b = a[keep], b[keep]
            step = PAIRS_AT_ONCE // FAN_OUT**2
            stack += [(below, a[s : s + step], b[s : s + step]) for s in range(0, len(a), step)]


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union in place: give linked positions one label, the smallest position of their set."""
    while len(i):
        a, b = label[i], label[j]
        keep = a != b
        i, j, a, b = i[keep], j[keep], a[keep], b[keep]
        if not len(i):
            return
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _links(radius: int):
    def solve(block: np.ndarray, value: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        new = (block[1:] != block[:-1]) | (value[1:] != value[:-1])
        index = GrayIndex(np.concatenate(([0], np.cumsum(new))), codes)
        label = np.arange(len(codes))
        for i, j in index.pairs(radius):
            join_labels(label, i, j)
        own = index.both[0].view(np.int64)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(own[linked]), pa.array(own[label[linked]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (block, value): the last group of a batch may go on in the next."""
        held = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols = [np.concatenate((h, c)) for h, c in zip(held, cols, strict=True)] if held else cols
            new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
            cut = int(new[-1]) + 1 if len(new) else 0
            if cut:
                yield solve(cols[0][:cut], cols[1][:cut], cols[2][:cut].view(np.uint64))
            held = [c[cut:] for c in cols]
        if held and len(held[0]):
            yield solve(held[0], held[1], held[2].view(np.uint64))

    return run


def _cut(bits: list[int], parts: int) -> list[list[int]]:
    step = -(-len(bits) // parts)
    return [bits[a : a + step] for a in range(0, len(bits), step)]


def gray_links(codes: DataFrame, radius: int = 2) -> DataFrame:
    """Links (u, v) that connect all codes of column fp within the radius: the same components as all close pairs have.

    The bits are cut into radius + 1 blocks; two codes within the radius agree on a whole block, which is an upper node
    common to both. A block value that over HOT_GROUP codes share is divided again in the same way by the bits left, so no
    group grows with the data: after three cuts at most 2^19 codes fit a group at radius 2. Inside a group the Gray index
    finds the pairs, and only a spanning forest of them leaves the task. Nulls and repeated codes drop out.
    """
    codes = codes.where("fp is not null").select("fp").distinct()
    todo = codes.select("fp", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("value"))
    left: dict[int, list[int]] = {0: list(range(64))}
    found, serial = None, 0
    while True:
        cuts, deeper = [], {}
        for block, bits in left.items():
            for part in _cut(bits, radius + 1):
                serial += 1
                mask = sum(1 << b for b in part)
                mask -= (mask >> 63) << 64
                deeper[serial] = [b for b in bits if b not in part]
                value = F.xxhash64("value", F.col("fp").bitwiseAND(F.lit(mask)))
                cuts.append(F.when(F.col("block") == block, F.struct(F.lit(serial).cast("long").alias("block"), value.alias("value"))))
        keyed = todo.select("fp", F.explode(F.array_compact(F.array(*cuts))).alias("k")).select("fp", "k.block", "k.value")
        last = min(map(len, deeper.values())) <= 19
        hot = None
        if not last:
            hot = keyed.groupBy("block", "value").count().where(F.col("count") > HOT_GROUP).select("block", "value")
            hot = written(hot, "hot-blocks")
            if hot.isEmpty():
                hot = None
        plain = keyed if hot is None else keyed.join(hot, ["block", "value"], "left_anti")
        plain = plain.select("block", "value", "fp").repartition("block", "value").sortWithinPartitions("block", "value")
        links = plain.mapInArrow(_links(radius), "u long, v long")
        found = links if found is None else found.union(links)
        if hot is None:
            return found
        todo, left = keyed.join(hot, ["block", "value"]).select("fp", "block", "value"), deeper


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: fingerprints within the radius link, a component carries its smallest
    doc_id.

    Equal fingerprints are one code, so a group of copies of any size costs one code. Null and empty texts have fingerprint
    zero and link like any other; rows with a null doc_id take part, but never name a component, unless all of it is null.
    """
    rows = written(fingerprints(docs, shingle), "fingerprints")
    codes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "codes")
    roots = components(gray_links(codes, radius))
    codes = codes.join(roots, codes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = codes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = written(codes.join(lows, "root").select("fp", "component_id"), "named")
    out = rows.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def class_levels(n: int, similarity: float) -> list[int]:
    """Powers of two of classes for a text of n shingles. Two texts whose numbers of shingles are as near as the similarity asks share one."""
    of = lambda m: max(0, int(m / CLASS_SHINGLES).bit_length() - 1)
    return sorted({of(n), of(n / similarity)})


def class_fingerprints(hashes: np.ndarray, similarity: float) -> np.ndarray:
    """A SimHash of each of the first CLASSES classes of the distinct shingles, mixed with its level and number.

    A shingle's class is given by the top bits of its hash, so that texts with common shingles have them in common classes.
    """
    out = []
    for level in class_levels(len(hashes), similarity):
        top = (hashes >> np.uint64(63 - level) >> np.uint64(1)).astype(np.int64) if level else np.zeros(len(hashes), np.int64)
        own = top < CLASSES
        h, top = hashes[own], top[own]
        order = np.argsort(top, kind="stable")
        h, top = h[order], top[order]
        first = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1]))) if len(h) else np.empty(0, np.int64)
        if not len(first):
            continue
        size = np.diff(np.append(first, len(h)))
        bits = np.add.reduceat(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32), first, axis=0)
        codes = np.packbits(2 * bits > size[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
        out.append((codes ^ (top[first].astype(np.uint64) << np.uint64(6) | np.uint64(level))) * np.uint64(0x9E3779B97F4A7C15) ^ size.astype(np.uint64))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def prefix_codes(hashes: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first n - ceil(similarity n) + 1 of n distinct shingles in one order of all shingles: two texts at the similarity share one of them.

    The order is by the count in `common` (hashes in ascending order, counts), then by hash.
    """
    n = len(hashes)
    keys, counts = common
    if n and len(keys):
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        hashes = hashes[np.lexsort((hashes, np.where(keys[at] == hashes, counts[at], 0)))]
    return hashes[: n - math.ceil(similarity * n - 1e-9) + 1]


def bucket_codes(hashes: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The buckets of a text by its distinct shingles in ascending order: of classes from PREFIX_BELOW shingles, and single ones where the
    smaller text of a pair may have fewer."""
    n = len(hashes)
    few = prefix_codes(hashes, similarity, common) if n * similarity < PREFIX_BELOW else np.empty(0, np.uint64)
    return np.concatenate((few, class_fingerprints(hashes, similarity))) if n >= PREFIX_BELOW else few


def _short_shingles(k: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(shingle_hashes(t.as_py(), k)) for t in batch.column(0)]
            own = [h for h in own if len(h) * similarity < PREFIX_BELOW]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *own]).view(np.int64))], ["h"])

    return run


def common_shingles(texts: DataFrame, k: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are in COMMON or more of a sample of about SAMPLE short texts, with their counts: a bounded number.

    They only order the shingles, so what the sample lacks costs comparisons, not links.
    """
    every = max(1, texts.count() // SAMPLE)
    some = texts.where(F.pmod(F.xxhash64("th", F.lit("sample")), F.lit(every)) == 0).select("th", "text").dropDuplicates(["th"]).select("text")
    counts = some.mapInArrow(_short_shingles(k, similarity), "h long").groupBy("h").count().where(F.col("count") >= COMMON).collect()
    hashes, n = np.array([r["h"] for r in counts], np.int64).view(np.uint64), np.array([r["count"] for r in counts], np.int64)
    order = np.argsort(hashes)
    return hashes[order], n[order]


def _described(k: int, similarity: float, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                fps, classes = [], []
                for t in part.column(2):
                    h = shingle_hashes(t.as_py(), k)
                    fps.append(fingerprint(h))
                    classes.append(bucket_codes(np.unique(h), similarity, common.value).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(c) for c in classes]), pa.int32()), pa.array(np.concatenate(classes)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), lists], ["doc_id", "th", "fp", "classes"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                own = [np.unique(shingle_hashes(t.as_py(), k).astype(np.uint32)).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.binary())], ["th", "own"])

    return run


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (leader, salt), the leader's own row first: it is held, the others are compared with it one by one."""
        leader, held = None, np.empty(0, np.uint32)
        for batch in batches:
            out = []
            for lead, first, th, raw in zip(*(batch.column(i) for i in (0, 2, 3, 4)), strict=True):
                lead, own = lead.as_py(), np.frombuffer(raw.as_buffer(), np.uint32)
                if first.as_py() == 0:
                    leader, held = lead, own
                elif lead == leader:
                    both = np.intersect1d(held, own, assume_unique=True).size
                    if both >= similarity * (len(held) + len(own) - both) - 1e-9 and both:
                        out.append((th.as_py(), lead))
            cols = [list(c) for c in zip(*out, strict=True)] or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["u", "v"])

    return run


def _compare(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (th, leader) whose texts are similar enough, each leader's members dealt to tasks of about MEMBERS."""
    many = edges.groupBy("leader").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts"))
    salted = edges.join(many, "leader").select("leader", F.pmod(F.xxhash64("th", F.lit("salt")), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("turn"), "th")
    own = many.select("leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("turn"), F.col("leader").alias("th"))
    rows = salted.union(own).join(sets, "th").select("leader", "salt", "turn", "th", "own")
    return rows.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "turn").mapInArrow(_verified(similarity), "u long, v long")


def _crossed(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (bucket, a, b, side): the texts of part a (side 0) are held under their shingles, those of part b pass.

        Only links between texts that no links join yet go out.
        """
        key = None
        for batch in batches:
            out = []
            for bucket, a, b, side, th, root, raw in zip(*(batch.column(i) for i in range(7)), strict=True):
                if key != (own_key := (bucket.as_py(), a.as_py(), b.as_py())):
                    key, held, index, up = own_key, [], None, {}
                th, root, own = th.as_py(), root.as_py(), np.frombuffer(raw.as_py(), np.uint32)
                if side.as_py() == 0:
                    held.append((th, root, own))
                    continue
                if index is None:
                    size = np.array([len(x[2]) for x in held], np.int64)
                    value = np.concatenate([x[2] for x in held])
                    order = np.argsort(value, kind="stable")
                    index, owner = value[order], np.repeat(np.arange(len(held)), size)[order]
                low = np.searchsorted(index, own, "left")
                n = np.searchsorted(index, own, "right") - low
                at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(held))
                for i in np.flatnonzero((both > 0) & (both >= similarity * (size + len(own) - both) - 1e-9)):
                    x, y = held[i][1], root
                    while x in up:
                        x = up[x]
                    while y in up:
                        y = up[y]
                    if x != y:
                        up[max(x, y)] = min(x, y)
                        out.append((th, held[i][0]))
            cols = [list(c) for c in zip(*out, strict=True)] or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["u", "v"])

    return run


def _rest(members: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between texts that share a bucket but no component: all such pairs are compared, so none is missed.

    Buckets of one component, of two texts (compared with each other in the first round) or of the same texts as another drop
    out. The others are cut in parts of about PART texts and each pair of parts is a task's work. A component of more texts has parts
    of its own, which are not compared with each other.
    """
    own = members.join(roots, F.col("th") == F.col("node"), "left").select("bucket", "th", F.coalesce("root", "th").alias("root"))
    per = own.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.min("th").alias("first"), F.max("th").alias("last"), F.bit_xor(F.xxhash64("th")).alias("all"))
    mixed = per.where("low <> high and n > 2").groupBy("n", "first", "last", "all").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    own = written(own.join(mixed, "bucket"), "mixed")
    sizes = own.groupBy("bucket", "root").agg(F.count("*").alias("own"))
    salt = lambda c, n: F.pmod(F.xxhash64(c, F.lit("part")), F.ceil(F.col(n) / PART))
    large = F.col("own") > PART
    part = F.when(large, F.xxhash64("root", salt("th", "own"))).otherwise(salt("root", "n"))
    own = written(own.join(sizes, ["bucket", "root"]).select("bucket", "th", "root", part.alias("part"), F.when(large, F.col("root")).alias("pure")), "parts")
    parts = own.select("bucket", "part", "pure").distinct()
    a, b = (parts.select("bucket", F.col("part").alias(c), F.col("pure").alias(f"pure_{c}")) for c in "ab")
    pairs = a.join(b, "bucket").where("a <= b and not coalesce(pure_a = pure_b, false)").select("bucket", "a", "b").distinct()
    sides = pairs.select("bucket", "a", "b", F.lit(0).alias("side"), F.col("a").alias("part")).union(pairs.select("bucket", "a", "b", F.lit(1).alias("side"), F.col("b").alias("part")))
    rows = own.select("bucket", "th", "root", "part").join(sides, ["bucket", "part"]).join(sets, "th").select("bucket", "a", "b", "side", "th", "root", "own")
    return rows.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "side").mapInArrow(_crossed(similarity), "u long, v long")


def near_duplicate_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 2) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, finds) of the rows and (th, root) of the texts in a group of several: texts whose shingle sets have at least the Jaccard
    similarity link, equal texts (one th, the xxhash64 of the text) always do.

    At similarity 0.8 fingerprints of whole texts differ in up to 16 of 64 bits, beyond what an index can prune. So, besides whole
    fingerprints within the radius, the candidates are texts that share the SimHash of one of their shingle classes: a class
    of 4 to 8 shingles is equal with probability 0.8^6 or so at similarity 0.8, and one of 24 with over 0.99. Shorter texts have
    too few classes for that; they, and texts up to 1 / similarity times longer, are candidates if they share one of
    the rarest shingles of an exact prefix filter. In each such
    bucket every text is compared with one leader, the text with the most company in its buckets; texts that are not linked
    are compared again, with new leaders, ROUNDS times. Then all pairs of texts of one bucket that are not of one component
    yet are compared: no two candidates stay untested unless other links join them. Texts with near fingerprints are a bucket as well.
    Shingles are compared as 32-bit hashes.
    """
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), F.coalesce(text, F.lit("")).alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(texts, shingle, similarity))
    seen = written(texts.mapInArrow(_described(shingle, similarity, common), "doc_id long, th long, fp long, classes array<long>"), "described")
    rows = written(seen.groupBy("doc_id", "th").agg(F.count("*").alias("finds"), F.first("fp").alias("fp")), "rows")
    kinds = written(rows.groupBy("th").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("low")), "kinds")
    # whole fingerprints within the radius share a bucket
    near = components(gray_links(kinds, radius))
    close = kinds.select("fp", "th").join(near, F.col("fp") == F.col("node"), "left").select("th", F.xxhash64(F.coalesce("root", "fp"), F.lit("near")).alias("bucket"))
    members = written(seen.select("th", F.explode("classes").alias("bucket")).union(close).distinct(), "members")
    shared = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = written(members.join(shared, "bucket"), "shared")
    weight = members.groupBy("th").agg(F.sum(F.log("size")).alias("weight"))
    members = every = written(members.join(weight, "th").select("bucket", "th", "weight"), "weighted")
    pick = written(kinds.join(members.select("th").distinct(), "th").select("th", F.col("low").alias("doc_id")), "ends")
    # a shuffle between the two Python steps, also where pick is small: in one stage each task would hold two Python workers
    full = texts.where(likely(pick, "th", F.col("th"))).alias("t").join(pick.alias("p").hint("merge"), F.col("t.th").eqNullSafe(F.col("p.th")) & F.col("t.doc_id").eqNullSafe(F.col("p.doc_id")))
    sets = written(full.select("t.th", "t.text").mapInArrow(_sets(shingle), "th long, own binary"), "sets")
    links = None
    for _ in range(ROUNDS):
        lead = members.groupBy("bucket").agg(F.max_by("th", F.struct("weight", "th")).alias("leader"), F.count("*").alias("n")).where("n > 1")
        edges = members.join(lead, "bucket").where("th <> leader").select("th", "leader")
        edges = written(edges.distinct(), "edges")
        if edges.isEmpty():
            break
        good = written(_compare(edges, sets, similarity), "verified")
        links = good if links is None else links.union(good)
        done = good.select(F.col("u").alias("th")).union(edges.select(F.col("leader").alias("th"))).distinct()
        members = written(members.join(done, "th", "left_anti"), "left")
    if links is None:
        roots = kinds.select(F.col("th").alias("node"), F.col("th").alias("root")).limit(0)
    else:
        roots = components(links)
        rest = written(_rest(every, roots, sets, similarity), "rest")
        if not rest.isEmpty():
            roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(rest))
    groups = kinds.select("th").join(roots, F.col("th") == F.col("node"), "left").select("th", F.coalesce("root", "th").alias("root"))
    return rows, groups


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """The documents with one of each near-duplicate group left, the one with the smallest doc_id, with their columns.

    Equal texts are one group, so of all empty and null texts one stays; a null doc_id comes last; of repeated rows one stays.
    """
    rows, groups = near_duplicate_groups(docs, shingle, similarity, radius)
    marked = written(rows.join(groups, "th").select("doc_id", "th", "finds", "root"), "marked")
    best = marked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("best"), F.sum("finds").alias("total"))
    crowd = written(marked.join(best.where("total > 1"), "root"), "crowd")
    stays = (F.col("doc_id").eqNullSafe(F.col("best.doc_id"))) & (F.col("th") == F.col("best.th"))
    keep = written(crowd.where(stays).select("doc_id", "th", "finds"), "keep")
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    own = docs.withColumn("_crowd", likely(crowd, "th", th))
    alone = own.where("not _crowd").select(*docs.columns)
    # rows that the bitmap takes for members of a group without their being one have no entry in crowd and stay
    same = lambda b: (th == F.col(f"{b}.th")) & F.col("d.doc_id").cast("long").eqNullSafe(F.col(f"{b}.doc_id"))
    drop = crowd.where(~stays).select("doc_id", "th").distinct().alias("x")
    doubtful = own.where("_crowd").alias("d").join(drop, same("x"), "left_anti").select("d.*").drop("_crowd")
    repeated = keep.where("finds > 1")
    if repeated.isEmpty():
        return alone.union(doubtful)
    once = doubtful.alias("d").join(repeated.alias("r"), same("r"), "left_anti")
    again = doubtful.alias("d").join(repeated.alias("r"), same("r"), "left_semi").withColumn("_th", th).dropDuplicates(["doc_id", "_th"]).drop("_th")
    return alone.union(once).union(again)
