"""Column functions on sequences: plain strings stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard genetic code, codons in the base order T, C, A, G.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STOPS = ["TAA", "TAG", "TGA"]
# IUPAC codes as bit sets of A=1, C=2, G=4, T=8.
IUPAC = {"A": 1, "C": 2, "G": 4, "T": 8, "R": 5, "Y": 10, "S": 6, "W": 9, "K": 12, "M": 3, "B": 14, "D": 13, "H": 11, "V": 7, "N": 15}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ungap(x: Column | str) -> Column:
    return F.replace(_c(x), F.lit("-"), F.lit(""))


def revcomp(x: Column | str) -> Column:
    """Reverse complement of A, C, G, T; other characters only change place."""
    return F.translate(F.reverse(_c(x)), "ATCG", "TAGC")


def codons(x: Column | str) -> Column:
    """Whole codons in frame 0, in one pass."""
    return F.regexp_extract_all(_c(x), F.lit("(?s)..."), 0)


def _code_map() -> Column:
    triples = [a + b + c for a in BASES for b in BASES for c in BASES]
    return F.create_map(*[F.lit(v) for pair in zip(triples, AMINO_ACIDS) for v in pair])


def translate_cds(x: Column | str) -> Column:
    """Amino acids of the whole codons; an unknown codon gives X."""
    table = _code_map()
    return F.array_join(F.transform(codons(F.upper(_c(x))), lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))), "")


def edge_codons(x: Column | str) -> dict[str, Column]:
    """First and last three bases of the gap-free sequence and whether they are the usual start and stop."""
    s = F.upper(ungap(x))
    first, last = F.left(s, F.lit(3)), F.right(s, F.lit(3))
    return {"first3": first, "last3": last, "starts_atg": first == "ATG", "ends_stop": last.isin(STOPS)}


def segment_orf(sseq: Column | str, qlen: Column | str) -> dict[str, Column]:
    """ORF fields of a translated search segment; stops are `*` or X."""
    s = F.replace(ungap(sseq), F.lit("*"), F.lit("X"))
    m = F.locate("M", s)
    from_m = F.when(m > 0, F.length(F.element_at(F.split(F.substring(s, m, F.length(s)), "X"), 1))).otherwise(0)
    longest = F.array_max(F.transform(F.split(s, "X"), lambda p: F.length(p)))
    denom = _c(qlen) - 1
    pct = lambda n: F.when(denom > 0, F.lit(100.0) * n / denom).otherwise(0.0)
    return {
        "orf_len": from_m, "first_stop": F.locate("X", s), "longest_open": longest,
        "frac_orf": F.round(pct(from_m), 6), "frac_cds": F.round(pct(longest), 6),
    }


def has_homopolymer(seq: Column | str, pos: Column | str) -> Column:
    """Four equal bases within four positions of a 1-based place."""
    p = _c(pos)
    lo = F.greatest(p - 4, F.lit(1))
    return F.substring(_c(seq), lo, p + 4 - lo + 1).rlike("A{4}|C{4}|G{4}|T{4}")


def near_edge(seq: Column | str, pos: Column | str, margin: int = 9) -> Column:
    return (_c(pos) <= margin) | (_c(pos) >= F.length(seq) - margin)


def iupac_match(a: Column | str, b: Column | str) -> Column:
    """True where two equally long sequences could be the same: equal letters, or codes that share a base."""
    mask = F.create_map(*[F.lit(v) for kv in IUPAC.items() for v in kv])
    ok = F.zip_with(
        F.split(_c(a), ""), F.split(_c(b), ""),
        lambda x, y: (x == y) | F.coalesce(F.try_element_at(mask, x).bitwiseAND(F.try_element_at(mask, y)) > 0, F.lit(False)))
    return (F.length(_c(a)) == F.length(_c(b))) & F.forall(ok, lambda v: v)


def exact_base(a: Column | str, b: Column | str) -> Column:
    """True when some place holds the same plain base in both."""
    return F.exists(F.zip_with(F.split(_c(a), ""), F.split(_c(b), ""), lambda x, y: (x == y) & x.isin("A", "C", "G", "T")), lambda v: v)


def is_shifted(a: Column | str, b: Column | str, minus: Column) -> Column:
    """One exon moved by one base towards higher coordinates: it lacks its first base and ends with an outside base."""
    n = F.length(_c(b))
    plus = F.left(_c(a), n - 1) == F.right(_c(b), n - 1)
    return F.when(minus, F.right(_c(a), n - 1) == F.left(_c(b), n - 1)).otherwise(plus)


def orientation_audit(ref: Column | str, raw: Column | str) -> Column:
    """Whether the written reference row equals the raw bases, their reverse complement, both or neither."""
    w, r = F.upper(ungap(ref)), F.upper(ungap(raw))
    same, flip = w == r, w == revcomp(r)
    return F.when(same & flip, "ambiguous").when(same, "forward").when(flip, "reverse").otherwise("mismatch")


def aligned_pct(row: Column | str, focal: Column | str) -> Column:
    """Row bases as a percentage of the focal bases."""
    n = F.length(ungap(focal))
    return F.when(n > 0, F.lit(100.0) * F.length(ungap(row)) / n).otherwise(0.0)
