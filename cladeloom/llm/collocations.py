"""Phrase collocations: phrase counts from depth-truncated suffix subtrees, built group by group of word prefixes, and their scores."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .suffix_dedup import Powers, _mix
from .tables import bitmap, in_bitmap, written

DEPTH = 4  # words of the longest phrase
CHUNK = 2_000_000  # bytes of text whose suffixes are counted together before anything is sent
BUDGET = 2_000_000  # suffix entries of one group of prefixes, about 50 MB
SHARE = 32  # a prefix with more than BUDGET / SHARE entries is extended by a word

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: pa.Array, lang: str) -> np.ndarray:
    """A 64-bit hash of each word (not null) within its language, for filters and for dealing: no result depends on it."""
    words = words.cast(pa.large_binary())
    n = len(words)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
    if not n or offsets[-1] == offsets[0]:
        return np.zeros(n, np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    up, down = Powers.of(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])))
    seed = np.uint64(sum((b + 1) * pow(131, i, 1 << 61) for i, b in enumerate(lang.encode())) & ((1 << 64) - 1))
    return _mix(_mix((sums[offsets[1:]] - sums[offsets[:-1]]) * down[offsets[:-1]]) + seed).view(np.int64)


def tokens(raw: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of a text in order and the number of the piece each stands in."""
    data = np.frombuffer(raw.translate(_LOWER), np.uint8)
    cut = data == 10
    gap = cut | (data == 32)
    edge = np.diff(np.concatenate(([1], gap, [1])).astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(stop - start)))
    words = pa.Array.from_buffers(pa.large_utf8(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[~gap].tobytes())])
    return words, np.cumsum(cut)[start] if len(start) else np.empty(0, np.int64)


def _slices(raw: bytes) -> Iterator[bytes]:
    """A long text in slices that end at a border between pieces, so that no phrase crosses one."""
    at = 0
    raw = raw.translate(_LOWER) if len(raw) > CHUNK else raw
    while len(raw) - at > CHUNK:
        end = raw.find(b"\n", at + CHUNK)
        if end < 0:
            break
        yield raw[at:end]
        at = end + 1
    yield raw[at:]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Texts of one language put together to about CHUNK bytes, a line break between them."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang = lang.as_py()
            for part in _slices(text.as_py().encode()):
                held.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + len(part) + 1
                if size[lang] >= CHUNK:
                    yield lang, b"\n".join(held.pop(lang))
                    del size[lang]
            if len(size) > 1 and sum(size.values()) > 4 * CHUNK:
                for k in list(held):
                    yield k, b"\n".join(held.pop(k))
                size.clear()
    for k in list(held):
        yield k, b"\n".join(held.pop(k))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, raw in _chunks(batches):
        words, _ = tokens(raw)
        counts = pc.value_counts(words)
        if len(counts):
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]).take(pa.array(np.zeros(n, np.int32))), counts.field(0).cast(pa.string()), counts.field(1).cast(pa.int64())],
                ["lang", "word", "f"],
            )


def _order(m: np.ndarray, top: int) -> np.ndarray:
    """Order of the suffixes (rows of word numbers, -1 for none)."""
    m, wide = m.astype(np.int64), np.int64(top + 2)
    if int(wide) ** DEPTH < 2**63:
        return np.argsort(((((m[:, 0] + 1) * wide + m[:, 1] + 1) * wide) + m[:, 2] + 1) * wide + m[:, 3] + 1, kind="stable")
    return np.lexsort(((m[:, 2] + 1) * wide + m[:, 3] + 1, (m[:, 0] + 1) * wide + m[:, 1] + 1))


def _fresh(m: np.ndarray) -> np.ndarray:
    """For sorted suffixes and each depth, whether a new node starts: the common prefix with the row before is shorter."""
    differs = np.ones(m.shape, bool)
    differs[1:] = m[1:] != m[:-1]
    return np.logical_or.accumulate(differs, axis=1)


def _suffixes(bits: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """Language, frequent words, and the suffixes of a chunk: rows of word numbers, cut at DEPTH words, at the end of a piece and before a
    rare word, as no phrase that holds one is frequent enough."""
    for lang, raw in _chunks(batches):
        words, piece = tokens(raw)
        if not len(words):
            continue
        coded = words.dictionary_encode()
        common = in_bitmap(bits, word_hashes(coded.dictionary, lang))
        number = np.where(common, np.cumsum(common) - 1, -1).astype(np.int32)
        m = np.full((len(words), DEPTH), -1, np.int32)
        m[:, 0] = number[coded.indices.to_numpy()]
        goes_on = (piece[1:] == piece[:-1]) & (m[:-1, 0] >= 0)
        for d in range(1, DEPTH):
            m[:-1, d] = np.where(goes_on, m[1:, d - 1], -1)
        m = m[m[:, 0] >= 0]
        if len(m):
            yield lang, coded.dictionary.filter(pa.array(common)).cast(pa.string()), m


def _prefix_hashes(words: pa.Array, lang: str, m: np.ndarray) -> np.ndarray:
    """Hash of the first 1, 2, .. DEPTH words of each suffix; the end of a suffix counts as a word."""
    h = np.append(word_hashes(words, lang), 0).view(np.uint64)  # number -1 is the end
    out = np.empty(m.shape, np.uint64)
    so_far = np.zeros(len(m), np.uint64)
    for d in range(DEPTH):
        so_far = out[:, d] = _mix(so_far * _STEP + h[m[:, d]] + np.uint64(d + 1))
    return out.view(np.int64)


def _depths(h: np.ndarray, bits: np.ndarray | None) -> np.ndarray:
    """How many words the partitioning prefix of each suffix has: the first prefix that is not over-full; DEPTH + 1 if all are."""
    depth = np.ones(len(h), np.int64)
    if bits is not None:
        full = np.ones(len(h), bool)
        for d in range(DEPTH):
            full &= in_bitmap(bits, h[:, d])
            depth += full
    return depth


def _prefix_sizes(common, full, level: int):
    """(h, n): occurrences of each prefix of `level` words whose shorter prefixes are all over-full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(full.value, np.uint8)
        for lang, words, m in _suffixes(np.frombuffer(common.value, np.uint8), batches):
            h = _prefix_hashes(words, lang, m)
            key, n = np.unique(h[_depths(h, bits) >= level, level - 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["h", "n"])

    return run


_PART = "lang string, grp long, part binary"


def _packed(words: pa.Array, *arrays: np.ndarray) -> bytes:
    """Words and arrays of small whole numbers as one compressed value, each array in the narrowest type that holds it."""
    narrow = [x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in arrays]
    own = "\n".join(words.to_pylist()).encode()
    head = struct.pack("<q", len(own)) + b"".join(struct.pack("<cq", x.dtype.char.encode(), x.nbytes) for x in narrow)
    return zstandard.compress(head + own + b"".join(x.tobytes() for x in narrow), 1)


def _unpacked(value: bytes, n: int) -> tuple[list[bytes], list[np.ndarray]]:
    raw = zstandard.decompress(value)
    (size,) = struct.unpack_from("<q", raw)
    at = 8 + 9 * n
    words, out = raw[at : at + size].split(b"\n"), []
    at += size
    for i in range(n):
        kind, size = struct.unpack_from("<cq", raw, 8 + 9 * i)
        out.append(np.frombuffer(raw[at : at + size], kind.decode()))
        at += size
    return words, out


def _parts(common, full, groups: int):
    """The suffixes of a chunk that go to one group, equal ones counted, with the words they use and the length of their prefix.

    A whole suffix that is over-full by itself is dealt by chunk: its counts add up in the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(full.value, np.uint8) if full else None
        for lang, words, m in _suffixes(np.frombuffer(common.value, np.uint8), batches):
            m = m[_order(m, len(words))]
            first = np.flatnonzero(_fresh(m)[:, -1])
            counts = np.diff(np.append(first, len(m)))
            m = m[first]
            h = _prefix_hashes(words, lang, m)
            depth = _depths(h, bits)
            key = h[np.arange(len(h)), np.minimum(depth, DEPTH) - 1].view(np.uint64)
            salt = np.uint64(xxhash.xxh64_intdigest(m.tobytes()))
            key = np.where(depth > DEPTH, _mix(key + salt), key)
            group = (_mix(key + np.uint64(7)) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            edge = np.append(np.flatnonzero(np.diff(group[order], prepend=-1)), len(order))
            made = []
            for at in np.split(order, edge[1:-1]):
                used, number = np.unique(m[at], return_inverse=True)
                used = used[int(used[0] == -1) :]
                number = number.reshape(-1, DEPTH).T + int(len(used) == number.max(initial=0) + 1)  # 0 is the end, then the words used
                made.append(_packed(words.take(pa.array(used)), number.ravel(), counts[at], depth[at]))
            lang_column = pa.array([lang]).take(pa.array(np.zeros(len(made), np.int32)))
            yield pa.RecordBatch.from_arrays([lang_column, pa.array(group[order[edge[:-1]]]), pa.array(made, pa.binary())], ["lang", "grp", "part"])

    return run


_NODE = "lang string, phrase string, k int, f long"


def _subtrees(least: int):
    """The suffix subtrees of one group as sorted suffixes and the depths at which they part; a node's count is the total of its leaves."""

    def solve(rows: pa.Table) -> pa.Table:
        words: list[bytes] = []
        found, counts, depth = [], [], []
        for value in rows.column("part"):
            own, (number, n, d) = _unpacked(value.as_py(), 3)
            # the end of a suffix becomes 0 again; words of different parts are made one below
            found.append(np.where(number == 0, 0, number.astype(np.int64) + len(words)).reshape(DEPTH, -1).T)
            words += own
            counts.append(n.astype(np.int64))
            depth.append(d.astype(np.int64))
        coded = pa.array(words, pa.binary()).cast(pa.string()).dictionary_encode()
        same = np.concatenate(([-1], coded.indices.to_numpy()))
        m, counts, depth = same[np.concatenate(found)].astype(np.int32), np.concatenate(counts), np.concatenate(depth)
        order = _order(m, len(coded.dictionary))
        m, counts, depth = m[order], counts[order], depth[order]
        fresh = _fresh(m)
        out = []
        for d in range(1, DEPTH + 1):
            at = np.flatnonzero(fresh[:, d - 1])
            f = np.add.reduceat(counts, at)
            # below its partitioning prefix a node is whole here; above it other groups hold the rest
            use = (m[at, d - 1] >= 0) & ((f >= least) | (depth[at] > d))
            at, f = at[use], f[use]
            parts = [coded.dictionary.take(pa.array(m[at, j])) for j in range(d)]
            phrase = pc.binary_join_element_wise(*parts, " ") if d > 1 else parts[0]
            out.append(pa.table({"phrase": phrase.cast(pa.string()), "k": pa.array(np.full(len(at), d, np.int32)), "f": pa.array(f)}))
        nodes = pa.concat_tables(out)
        lang = pa.array([rows.column("lang")[0].as_py()], pa.string()).take(pa.array(np.zeros(len(nodes), np.int32)))
        return nodes.add_column(0, "lang", lang)

    return solve


def phrase_counts(docs: DataFrame, least: int, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of every phrase of 1 to DEPTH words that occurs at least `least` times, and (lang, n), all word occurrences.

    Vertical partitioning: a word prefix that holds more suffixes than a share of the budget is extended by a word, and again;
    prefixes are then dealt to groups of half the budget on average, each prefix being small against it, and each group's subtrees, cut
    at DEPTH words, are built in a task of their own. Over-full prefixes are known by a bitmap of fixed size; one that is taken for
    over-full by chance is only dealt more finely, its counts still add up. Suffixes end before a word that occurs less than
    `least` times (a bitmap again), and equal ones are counted before they are sent, CHUNK bytes of text at a time.
    """
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    texts = docs.select(lang, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("text <> ''")
    words = written(texts.mapInArrow(_word_counts, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f")), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= least)
    common = spark.sparkContext.broadcast(bitmap(frequent.mapInArrow(_hashes(False), "h long"), "h").tobytes())
    total = frequent.agg(F.sum("f")).first()[0] or 0
    limit = budget // SHARE
    own = bitmap(frequent.where(F.col("f") > limit).mapInArrow(_hashes(True), "h long"), "h")
    bits, full = own, None
    for level in range(2, DEPTH + 2):
        if not own.any():
            break
        bits = bits | own
        full = spark.sparkContext.broadcast(bits.tobytes())
        if level <= DEPTH:
            sizes = texts.mapInArrow(_prefix_sizes(common, full, level), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
            own = bitmap(sizes.where(F.col("n") > limit), "h")
    groups = max(1, -(-2 * total // budget))
    nodes = texts.mapInArrow(_parts(common, full, groups), _PART).groupBy("lang", "grp").applyInArrow(_subtrees(least), _NODE)
    phrases = nodes.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return written(phrases, "phrases"), totals


def _hashes(as_prefix: bool):
    """The hash of each (lang, word), or that of the prefix which is this word alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in pc.unique(batch.column(0)).to_pylist():
                words = batch.column(1).filter(pc.equal(batch.column(0), one))
                m = np.full((len(words), DEPTH), -1, np.int32)
                m[:, 0] = np.arange(len(words))
                yield pa.RecordBatch.from_arrays([pa.array(_prefix_hashes(words, one, m)[:, 0] if as_prefix else word_hashes(words, one))], ["h"])

    return run


def _wide(c: Column) -> Column:
    return c.cast("decimal(28,0)")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of 2 to 4 words of each language that stand out most against their parts.

    a is the number of occurrences, at least `least`; the phrase is cut where floor(2000000 a / (l + r)) is lowest, the
    earliest of equal cuts. A phrase whose words lie within a longer candidate with at least 80 % of its count goes. Each
    language's first `top` by score, count, then phrase in byte order. A null language is `und`; null and empty texts hold no words;
    repeated rows count again; only lang and text are read, whatever other columns there are; an empty table gives no rows.
    """
    phrases, totals = phrase_counts(docs, least, budget)
    words = F.split("phrase", " ", -1)
    cand = phrases.where("k > 1").withColumn("w", words)
    cut = cand.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("j"))
    text = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cut = cut.select("lang", "phrase", "a", "j", text(F.lit(1), F.col("j")).alias("head"), text(F.col("j") + 1, F.size("w") - F.col("j")).alias("tail"))
    part = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("pf"))
    cut = cut.join(part.withColumnsRenamed({"part": "head", "pf": "l"}), ["lang", "head"]).join(part.withColumnsRenamed({"part": "tail", "pf": "r"}), ["lang", "tail"])
    # integral division of decimals is exact; the quotient is at most 1000000
    score = F.call_function("div", _wide(F.col("a")) * F.lit(2000000).cast("decimal(7,0)"), _wide(F.col("l") + F.col("r")))
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "j", "l", "r")).alias("c"))
    inner = cand.where("k > 2").select("lang", "f", F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left")
    kept = kept.where(F.col("longer").isNull() | (_wide(F.col("longer")) * 100 < _wide(F.col("a")) * 80))
    order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    out = ranked.join(totals, "lang")
    return out.select("lang", "rank", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").cast("long").alias("score"))


def sql(least: int = 30, top: int = 2000) -> str:
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
spans AS (SELECT lang, w, i, unnest(range(1, least(4, len(w) - i + 1) + 1)) AS k FROM starts),
grams AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*)::HUGEINT AS f FROM spans GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM grams WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND f >= {least}),
cuts AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS j FROM cand),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.j, x.f AS l, y.f AS r, (2000000 * c.a) // (x.f + y.f) AS score
  FROM cuts c
  JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.j], ' ')
  JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.j + 1:c.k], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, a, w, k, unnest(range(2, k)) AS m FROM cand WHERE k > 2),
places AS (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM inside),
longer AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS a FROM places GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.a IS NULL OR 100 * g.a < 80 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= {top}"""
