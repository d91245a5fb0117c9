"""Column functions on identifiers, taxon names and delimited cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: text after '__' that looks like a species name.
SPECIES_TAG = r"^[A-Z][a-z\-.]*(_[A-Za-z0-9.\-]+)*$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def canonical_id(x: Column | str) -> Column:
    """Gene id without a `__Species` suffix, split at the last `__`; kept whole when either part would be empty."""
    return F.regexp_replace(_c(x), r"(?s)^(.+)__(?!_*$)((?!.*__).+)$", "$1")


def species_suffix(x: Column | str) -> Column:
    tail = F.substring_index(_c(x), "__", -1)
    return F.when(_c(x).contains("__") & (tail != "") & (F.length(x) > F.length(tail) + 2), tail)


def looks_like_species(x: Column | str) -> Column:
    return F.coalesce(_c(x).rlike(SPECIES_TAG), F.lit(False))


def strip_isoform(x: Column | str) -> Column:
    """Drop a trailing `.p` or `.p<n>`, then one trailing `.<n>` (fixed values: the suffixes of the file formats)."""
    return F.regexp_replace(F.regexp_replace(_c(x), r"\.p\d*$", ""), r"\.\d+$", "")


def strip_coordinates(x: Column | str) -> Column:
    """Drop a trailing `_start_end_length`."""
    return F.regexp_replace(_c(x), r"_\d+_\d+_\d+$", "")


def loose_id(x: Column | str, species: Column | str | None = None) -> Column:
    """Id without case, `db|` prefixes, a leading species tag, and protein or version suffixes; `_` counts as `.`.

    Only for finding mismatches, never for joining. A suffix needs a separator, so AT1G01010 and AT1G01011 stay apart.
    """
    parts = F.split(F.trim(_c(x)), r"\|")
    bare = F.lower(F.element_at(parts, F.when(F.size(parts) > 2, -2).otherwise(-1)))
    if species is not None:
        sp = F.lower(_c(species))
        for tag in (F.concat(sp, F.lit("_")), F.concat(F.substring_index(sp, "_", 1), F.lit("_"))):
            bare = F.when(F.startswith(bare, tag), F.substr(bare, F.length(tag) + 1)).otherwise(bare)
    return F.replace(F.regexp_replace(F.regexp_replace(bare, r"[._]p\d*$", ""), r"[._]t?\d+$", ""), F.lit("_"), F.lit("."))


def taxon_key(x: Column | str, level: str = "species") -> Column:
    """Comparable species name: `species` = first two words, `genus` = first word, `exact` = all words."""
    words = F.filter(F.split(F.lower(F.regexp_replace(F.trim(_c(x)), r"[\s\-]+", "_")), "_"), lambda w: w != "")
    if level == "exact":
        return F.array_join(words, "_")
    return F.array_join(F.slice(words, 1, {"species": 2, "genus": 1}[level]), "_")


def genus_of(x: Column | str) -> Column:
    g = F.element_at(F.split(F.trim(_c(x)), r"[\s_]+"), 1)
    return F.when(g != "", F.lower(g))


def natural_key(x: Column | str) -> Column:
    """Sort key that orders digit runs of any length by value.

    A run loses its leading zeros and gets its length in front, and in front of that the length of that number.
    """

    def part(p: Column) -> Column:
        bare = F.regexp_replace(p, r"^0+(?=\d)", "")
        size = F.length(bare).cast("string")
        return F.when(p.rlike(r"^\d"), F.concat(F.hex(F.length(size)), size, bare)).otherwise(p)

    return F.array_join(F.transform(F.regexp_extract_all(_c(x), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0)), part), "")


def taxon_of(header: Column | str) -> Column:
    """The part of `taxon.contig` before the first dot."""
    return F.substring_index(_c(header), ".", 1)


def contig_of(header: Column | str) -> Column:
    """The part after the first dot; the whole header without one."""
    return F.regexp_replace(_c(header), r"^[^.]*\.", "")


def join_distinct(x: Column | str, sep: str = "|") -> Column:
    """Values of an array as one text, each once, in order of first mention; `NA` if there are none."""
    values = F.array_distinct(F.filter(_c(x), lambda v: v.isNotNull() & (v != "") & (v != "NA")))
    return F.when(F.size(values) > 0, F.array_join(values, sep)).otherwise("NA")


def split_cell(x: Column | str, sep: str = ",") -> Column:
    """Members of a delimited cell, trimmed, without empty and `-` entries."""
    parts = F.transform(F.split(_c(x), sep), lambda p: F.trim(p))
    return F.filter(parts, lambda p: (p != "") & (p != "-"))


def attributes(x: Column | str) -> Column:
    """`k=v;k2=v2` to a map; a repeated key keeps its last value; %2C %3B %3D are decoded."""
    pairs = F.filter(F.split(_c(x), ";"), lambda p: p.contains("="))
    last = F.aggregate(
        pairs,
        F.expr("map_from_arrays(array(), array())").cast("map<string,string>"),
        lambda m, p: F.map_concat(
            F.map_filter(m, lambda k, _: k != F.trim(F.substring_index(p, "=", 1))),
            F.create_map(F.trim(F.substring_index(p, "=", 1)), _decode(F.regexp_replace(p, r"^[^=]*=", ""))),
        ),
    )
    return last


def _decode(x: Column) -> Column:
    for code, ch in (("%2C", ","), ("%3B", ";"), ("%3D", "="), ("%2c", ","), ("%3b", ";"), ("%3d", "=")):
        x = F.replace(x, F.lit(code), F.lit(ch))
    return x


def format_intervals(x: Column | str) -> Column:
    """array<struct<a,b>> to `a-b;c-d`."""
    return F.array_join(F.transform(_c(x), lambda i: F.concat_ws("-", i["a"].cast("string"), i["b"].cast("string"))), ";")


def parse_intervals(x: Column | str) -> Column:
    good = F.filter(F.split(_c(x), ";"), lambda p: p.rlike(r"^\s*\d+-\d+\s*$"))
    return F.transform(
        good,
        lambda p: F.struct(
            F.trim(F.substring_index(p, "-", 1)).cast("int").alias("a"),
            F.trim(F.substring_index(p, "-", -1)).cast("int").alias("b"),
        ),
    )
