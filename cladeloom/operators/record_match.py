"""Sequence records to proteins by nine prioritised rules, and the reports on what matched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .match import exon_fingerprint, header_fingerprint, unambiguous

# The rules in order of priority, and the feature types of transcripts.
RULES = ["ExplicitID", "Fingerprint", "TransMap", "LocusMap", "GeneMap", "GeneIDMap", "SimpleID", "SimpleID_p", "LCLFallback"]
TRANSCRIPTS = ["mRNA", "transcript", "mrna"]


def _attr(name: str) -> Column:
    return F.col("attrs")[name]


def _geneid(text: Column) -> Column:
    n = F.regexp_extract(text, r"GeneID:(\d+)", 1)
    return F.when(n != "", F.concat(F.lit("GeneID:"), n))


def feature_keys(features: DataFrame) -> DataFrame:
    """(kind, key, protein): what leads to one protein. Kind `map` holds identifiers, `loc` exon fingerprints.

    features(row, type, start, end, attrs map) in file order. A transcript belongs to the protein of its last coding row. Transcript ids,
    also without a leading `rna-`, lead to it; so do locus tags of the transcript and names, tags and numbers of its gene, unless they
    lead to several proteins. Such a key beats an id of the same text; of equal ids the transcript that comes later wins.
    """
    parents = F.explode(F.split(_attr("Parent"), ",")).alias("mrna")
    cds = features.filter((F.col("type") == "CDS") & _attr("protein_id").isNotNull() & _attr("Parent").isNotNull())
    cds = cds.select("row", _attr("protein_id").alias("protein"), parents).groupBy("mrna").agg(F.max_by("protein", "row").alias("protein"), F.min("row").alias("at"))
    exons = features.filter((F.col("type") == "exon") & _attr("Parent").isNotNull()).select("start", "end", parents)
    prints = exon_fingerprint(exons, "mrna", "start", "end").join(cds, "mrna")
    loc = unambiguous(prints.select("fingerprint", "protein"), "fingerprint", "protein").select(F.lit("loc").alias("kind"), F.col("fingerprint").alias("key"), "protein")
    tr = features.filter(F.col("type").isin(TRANSCRIPTS) & _attr("ID").isNotNull()).select("row", _attr("ID").alias("mrna"), _attr("Parent").alias("gene"), _attr("locus_tag").alias("key"))
    gene_of = tr.filter("gene is not null").groupBy("mrna").agg(F.max_by("gene", "row").alias("gene"))
    genes = features.filter((F.col("type") == "gene") & _attr("ID").isNotNull())
    names = F.array_compact(F.array(_attr("Name"), _attr("locus_tag"), _attr("gene"), _geneid(F.array_join(F.map_values("attrs"), ";"))))
    genes = genes.select(_attr("ID").alias("gene"), F.explode(names).alias("key"))
    known = cds.join(tr.filter("key is not null").select("mrna", "key"), "mrna").select("key", "protein").unionByName(
        cds.join(gene_of, "mrna").join(genes, "gene").select("key", "protein"))
    clear = unambiguous(known, "key", "protein").select("key", "protein", F.lit(1).alias("level"), F.lit(0).cast("bigint").alias("at"))
    ids = cds.select(F.explode(F.array(F.col("mrna"), F.when(F.startswith("mrna", F.lit("rna-")), F.replace("mrna", F.lit("rna-"), F.lit(""))))).alias("key"), "protein", F.lit(0).alias("level"), F.col("at").cast("bigint"))
    one = clear.unionByName(ids.filter("key is not null")).groupBy("key").agg(F.max_by("protein", F.struct("level", "at")).alias("protein"))
    return loc.unionByName(one.select(F.lit("map").alias("kind"), "key", "protein"))


def authenticity(header: Column) -> Column:
    """2 for coding messengers, 0 for other RNA, else 1."""
    up = F.upper(header)
    messenger = F.contains(up, F.lit("GBKEY=MRNA")) | F.contains(up, F.lit("GBKEY=CDS")) | F.contains(header, F.lit("XM_")) | F.contains(header, F.lit("NM_"))
    return F.when(messenger, 2).when(F.contains(up, F.lit("GBKEY=MISC_RNA")) | F.contains(header, F.lit("XR_")), 0).otherwise(1)


def match_records(records: DataFrame, features: DataFrame, proteins: DataFrame) -> DataFrame:
    """records(row, header, length) with `protein` and `rule` of the first rule that leads to a listed protein; NULL without one.

    Every record lists its keys with their rules in one table; one join looks all of them up, one more keeps listed proteins, and the
    smallest rule of a record is taken by partial aggregation.
    """
    h = F.col("header")
    found = lambda p: F.nullif(F.regexp_extract(h, p, 1), F.lit(""))
    first = F.split(F.trim(h), r"\s+")[0]
    keys = [
        (0, "id", found(r"\[protein_id=([^\]]+)\]")), (1, "id", found(r"polypeptide=([^ ]+)")), (2, "loc", header_fingerprint(h)),
        (3, "map", found(r"\[transcript_id=([^\]]+)\]")), (4, "map", found(r"\[locus_tag=([^\]]+)\]")), (5, "map", found(r"\[gene=([^\]]+)\]")),
        (6, "map", _geneid(h)), (7, "id", first), (8, "id", F.concat(first, F.lit(".p"))), (9, "id", found(r"_cds_([A-Za-z0-9]+\.\d+)_")),
    ]
    listed = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(RULES[max(i - 1, 0)]).alias("rule"), F.lit(k).alias("kind"), c.alias("key")) for i, k, c in keys]), lambda x: x["key"].isNotNull())
    cand = records.select("row", F.explode(listed).alias("c")).select("row", "c.*")
    ids = proteins.select(F.lit("id").alias("kind"), F.col("protein").alias("key"), "protein")
    table = feature_keys(features).join(proteins.select("protein"), "protein", "left_semi").unionByName(ids)
    best = cand.join(table, ["kind", "key"]).groupBy("row").agg(F.min(F.struct("i", "rule", "protein")).alias("b"))
    return records.join(best, "row", "left").select(*records.columns, F.col("b.protein").alias("protein"), F.col("b.rule").alias("rule"))


def _best_first() -> Column:
    return F.struct((-authenticity(F.col("header"))).alias("a"), (-F.col("length")).alias("b"), "row", "header", "length", "rule")


def best_records(matches: DataFrame) -> DataFrame:
    """(protein, row, header, length, rule, n_records): the most authentic record of each protein, then the longest, then the first."""
    g = matches.filter("protein is not null").groupBy("protein").agg(F.min(_best_first()).alias("b"), F.count("*").alias("n_records"))
    return g.select("protein", "b.row", "b.header", "b.length", "b.rule", "n_records")


def sequence_report(proteins: DataFrame, **kinds: DataFrame) -> DataFrame:
    """Per protein its length and, for each kind of sequence, the length and rule of its best record (NULL and `Missing` without one)."""
    def add(left: DataFrame, item: tuple[str, DataFrame]) -> DataFrame:
        kind, matches = item
        b = best_records(matches).select("protein", F.col("length").alias(f"{kind}_length"), F.col("rule").alias("_r"))
        return left.join(b, "protein", "left").withColumn(f"{kind}_rule", F.coalesce("_r", F.lit("Missing"))).drop("_r")

    return reduce(add, kinds.items(), proteins.select("protein", "length"))


def missing_proteins(proteins: DataFrame, matches: DataFrame) -> DataFrame:
    """Proteins that no record matched, with the gene of their header (`NA` without one)."""
    gene = F.regexp_extract("header", r"\[gene=([^\]]+)\]", 1)
    out = proteins.join(matches.select("protein"), "protein", "left_anti")
    return out.select("protein", F.when(gene != "", gene).otherwise("NA").alias("gene"), "header")


def headers_not_kept(matches: DataFrame) -> DataFrame:
    """(protein, kept, header): the records of a protein besides the best one, a row each."""
    best = best_records(matches).filter("n_records > 1").select("protein", F.col("row").alias("_kept"), F.col("header").alias("kept"))
    other = matches.filter("protein is not null").join(best, "protein").filter("row <> _kept and header <> kept")
    return other.select("protein", "kept", "header")
