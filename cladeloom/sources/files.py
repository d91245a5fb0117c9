"""Readers and writers of the text formats. A folder is read in one scan; long files are split, not loaded whole.

Two readers need the order of lines inside a file (the completeness proofs of search outputs). They order lines by file,
block start and row within the block; what crosses a block border is settled on one summary row a block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import number_within
from ..functions.ids import attributes, contig_of, split_cell, taxon_of
from ..session import cut_lineage, kept_table

# Column names of the text formats, in file order.
HIT_FIELDS = "qseqid sseqid pident length mismatch gapopen qstart qend sstart send evalue bitscore qlen slen".split()
GFF_SCHEMA = "seqid string, source string, type string, start string, end string, score string, strand string, phase string, attributes string"
BED_SCHEMA = "chrom string, start string, end string, name string, score string, strand string, id string"
MATCH_SCHEMA = (
    "query string, md5 string, length int, analysis string, signature string, description string, start int, stop int, "
    "score double, status string, date string, ipr string, ipr_description string, go string, pathway string"
)
TYPES = {"pident": "double", "evalue": "double", "bitscore": "double", "qseqid": "string", "sseqid": "string", "stitle": "string"}


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[A-Za-z]+)?(\.gz)?$", 1)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, record_id, header, seq); records are split at `>` in the scan itself, so big files are read in parallel."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(_stem(F.col("_metadata.file_path")).alias("file"), "value")
    rec = F.regexp_replace(F.regexp_replace("value", "\r", ""), r"^\s*>", "")
    head = F.trim(F.substring_index(rec, "\n", 1))
    seq = F.regexp_replace(F.regexp_replace(rec, r"^[^\n]*", ""), r"\s", "")
    out = raw.select("file", F.element_at(F.split(head, r"\s+"), 1).alias("record_id"), head.alias("header"), seq.alias("seq"))
    return out.filter("record_id <> ''")


def fasta_problems(records: DataFrame) -> DataFrame:
    """Ids that occur twice and records without a sequence."""
    dup = records.groupBy("file", "record_id").agg(F.count("*").alias("n")).filter("n > 1").select("file", "record_id", F.lit("duplicate_id").alias("problem"))
    return dup.unionByName(records.filter(F.length("seq") == 0).select("file", "record_id", F.lit("empty_sequence").alias("problem")))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    g = spark.read.schema(GFF_SCHEMA).option("sep", "\t").option("comment", "#").option("quote", "").csv(path)
    g = g.filter(F.col("attributes").isNotNull() & F.col("start").rlike(r"^\d+$") & F.col("end").rlike(r"^\d+$"))
    return g.select("seqid", "type", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "strand", attributes("attributes").alias("attrs"))


def folder_name(path: Column) -> Column:
    """The folder of a file, without `column=`: names files that were written by partition."""
    return F.regexp_extract(path, r"/(?:[^/=]*=)?([^/]+)/[^/]+$", 1)


def _lines(spark: SparkSession, path: str, name: Callable[[Column], Column]) -> DataFrame:
    """(path, file, block, row, line): within a file, lines follow each other by block and row."""
    raw = spark.read.option("recursiveFileLookup", True).text(path)
    where = F.col("_metadata.file_path")
    return raw.select(where.alias("path"), name(where).alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("row"), F.regexp_replace("value", "\r$", "").alias("line"))


def _confirmed(marks: DataFrame) -> DataFrame:
    """(query, confirmed) from the query lines and footers of files: marks(path, block, row, query, said).

    A footer vouches for the queries since the footer before it if it counts as many. Within a block that is a window over the block;
    between blocks, one row a block tells how many queries are open at its end and whether its first footer fits what was open before.
    """
    in_block = Window.partitionBy("path", "block").orderBy("row")
    footers_before = F.count("said").over(in_block.rowsBetween(Window.unboundedPreceding, -1))
    m = marks.withColumn("seg", footers_before)
    segs = m.groupBy("path", "block", "seg").agg(F.count("query").alias("n"), F.max("said").alias("said"))
    blocks = segs.groupBy("path", "block").agg(F.count("said").alias("footers"), F.max(F.when(F.col("seg") == 0, F.col("n"))).alias("n_first"),
                                               F.max(F.when(F.col("seg") == 0, F.col("said"))).alias("said_first"), F.sum(F.when(F.col("said").isNull(), F.col("n")).otherwise(0)).alias("open"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("path").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # nearest last, a step a block
    total = F.sum("open").over(Window.partitionBy("path").orderBy("block"))
    b = blocks.withColumn("total", total).withColumn("base", F.when(F.col("footers") > 0, F.col("total") - F.col("open")))
    zero = F.lit(0).cast("bigint")
    carried = F.coalesce(F.last("total").over(before), zero) - F.coalesce(F.last("base", ignorenulls=True).over(before), zero)
    b = b.withColumn("first_ok", F.when(F.col("footers") > 0, carried + F.col("n_first") == F.col("said_first")))
    b = b.withColumn("next_ok", F.last("first_ok", ignorenulls=True).over(after)).select("path", "block", "first_ok", "next_ok")
    ok = F.when(F.col("said").isNull(), F.col("next_ok")).when(F.col("seg") == 0, F.col("first_ok")).otherwise(F.col("n") == F.col("said"))
    known = segs.join(b, ["path", "block"]).select("path", "block", "seg", ok.alias("ok"))
    own = m.filter("query is not null").join(known, ["path", "block", "seg"])
    return own.groupBy("query").agg(F.max(F.coalesce("ok", F.lit(False))).alias("confirmed"))


def read_hits_tabular(spark: SparkSession, path: str, fields: list[str] | None = None, name: Callable[[Column], Column] = _stem) -> tuple[DataFrame, DataFrame]:
    """(hits, queries): a query is confirmed if a footer counts as many queries as were seen since the last one; one such group is enough.

    Other queries are unconfirmed and must become NOT_RUN, never "no hit". A row with a wrong number of columns is an error, and so are
    hits in a file that names no search program. `pos` orders the hits of a file.
    """
    fields = fields or HIT_FIELDS
    x = _lines(spark, path, name)
    foot, asked = F.regexp_extract("line", r"^# BLAST processed (\d+) quer", 1), F.regexp_extract("line", r"^# Query:\s*(\S+)", 1)
    marks = x.filter("startswith(line, '#')").select("path", "block", "row", F.nullif(asked, F.lit("")).alias("query"), F.nullif(foot, F.lit("")).cast("bigint").alias("said"))
    q = _confirmed(marks.filter("query is not null or said is not null"))
    c = F.split("line", "\t")
    # fixed value: the line with which a search program starts its part of a file
    named = x.filter(F.col("line").rlike(r"^# \S*BLAST\S* \d")).select("path").distinct().withColumn("_named", F.lit(True))
    data = x.filter("trim(line) <> '' and not startswith(line, '#')").withColumn("_c", c).join(named, "path", "left")
    wrong = F.when(F.col("_named").isNull(), F.concat(F.lit("no program header in "), F.col("file"))).when(F.size("_c") != len(fields), F.concat(F.lit("wrong column count: "), F.col("line")))
    ok = F.when(wrong.isNull(), F.lit(True)).otherwise(F.raise_error(wrong).cast("boolean"))
    hits = data.filter(ok).select("file", F.struct("block", "row").alias("pos"), *[F.col("_c")[i].cast(TYPES.get(f, "int")).alias(f) for i, f in enumerate(fields)])
    return hits, q


def read_domtbl(spark: SparkSession, path: str, searched: DataFrame | None = None, name: Callable[[Column], Column] = _stem) -> tuple[DataFrame, DataFrame]:
    """(domains, queries). A file is complete only if its last line is `# [ok]`; searched(file, query) lists its queries."""
    x = _lines(spark, path, name).filter(F.trim("line") != "")
    last = F.max_by("line", F.struct("block", "row"))  # each task sends one line a file
    done = x.groupBy("path", "file").agg((F.trim(last) == "# [ok]").alias("complete")).groupBy("file").agg(F.min("complete").alias("complete"))
    c = F.split(F.trim("line"), r"\s+", 23)
    at = {"target": (0, "string"), "tlen": (2, "int"), "query": (3, "string"), "qlen": (5, "int"), "evalue": (6, "double"), "bitscore": (7, "double"),
          "bias": (8, "double"), "ievalue": (12, "double"), "qstart": (15, "int"), "qend": (16, "int"), "sstart": (17, "int"), "send": (18, "int")}
    d = x.filter("not startswith(line, '#')").withColumn("_c", c).select("file", *[F.col("_c")[i].cast(t).alias(n) for n, (i, t) in at.items()])
    listed = d.select("file", "query") if searched is None else d.select("file", "query").unionByName(searched.select("file", "query"))
    q = listed.distinct().join(done, "file").groupBy("query").agg(F.max("complete").alias("confirmed"))
    return d, q


def read_domain_matches(spark: SparkSession, path: str, evidence: str, name: Callable[[Column], Column] = _stem) -> DataFrame:
    """Domain matches with `finished`: the log or status file of the same name says the run ended."""
    nested = spark.read.option("recursiveFileLookup", True)
    m = nested.schema(MATCH_SCHEMA).option("sep", "\t").option("quote", "").csv(path).withColumn("file", name(F.col("_metadata.file_path")))
    e = spark.read.option("recursiveFileLookup", True).text(evidence).select(name(F.col("_metadata.file_path")).alias("file"), "value")
    done = e.groupBy("file").agg(F.max(F.col("value").rlike("100% done|hep_status=complete")).alias("finished"))
    return m.join(done, "file", "left").withColumn("finished", F.coalesce("finished", F.lit(False)))


def read_groups(spark: SparkSession, path: str, n_meta: int = 3) -> DataFrame:
    """Orthogroup matrix to (group, species, member); the species are the columns after the first n_meta."""
    w = spark.read.option("header", True).option("sep", "\t").option("inferSchema", False).csv(path)
    g = w.columns[0]
    long = w.select(F.col(f"`{g}`").alias("group"), *[F.col(f"`{c}`") for c in w.columns[n_meta:]]).unpivot("group", w.columns[n_meta:], "species", "cell")
    return long.select("group", "species", F.explode(split_cell("cell")).alias("member"))


def read_pairs(spark: SparkSession, path: str, name_of: Callable[[Column], Column] = _stem) -> DataFrame:
    """Pairwise ortholog files `<A>__v__<B>.tsv` to (species, gene, other_species, other_gene)."""
    p = spark.read.option("recursiveFileLookup", True).schema("grp string, a string, b string").option("header", True).option("enforceSchema", True).option("sep", "\t").csv(path)
    name = name_of(F.col("_metadata.file_path"))
    p = p.select(F.substring_index(name, "__v__", 1).alias("species"), F.substring_index(name, "__v__", -1).alias("other_species"), "a", "b")
    return p.select("species", F.explode(split_cell("a")).alias("gene"), "other_species", "b").select("species", "gene", "other_species", F.explode(split_cell("b")).alias("other_gene"))


def transpose_metrics(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rows = metrics, columns = species, to one row per species with the renamed metrics."""
    name, species = df.columns[0], df.columns[1:]
    long = df.select(*[F.col(f"`{c}`").cast("string") for c in df.columns]).unpivot(name, species, "species", "value")
    return long.groupBy("species").agg(*[F.max(F.when(F.col(name) == m, F.col("value"))).alias(n) for m, n in mapping.items()])


def read_maf(spark: SparkSession, path: str, index: bool = False, name: Callable[[Column], Column] = _stem) -> tuple[DataFrame, DataFrame]:
    """(blocks, block_rows). One block per record of the scan; plus_start turns minus-strand starts round.

    index: blocks are numbered from 1 in the order of their file (block_ix), which takes a sort of all blocks.
    """
    at = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")]
    raw = spark.read.option("lineSep", "\na").option("recursiveFileLookup", True).text(path).select(name(F.col("_metadata.file_path")).alias("exon"), "value", *(at if index else []))
    s = F.filter(F.split(F.regexp_replace("value", "\r", ""), "\n"), lambda l: l.rlike(r"^s\s"))
    x = raw.withColumn("s", s).filter(F.size("s") > 0).drop("value")
    n = ["block_ix"] if index else []
    if index:
        # the sort reads its input twice; files are opened once
        x = kept_table(x, "scanned")
        x = cut_lineage(number_within(x, ["exon"], [F.col("path"), F.col("block"), F.col("row")], "block_ix").drop("path", "block", "row"))
    x = x.withColumn("_ref", F.split(F.col("s")[0], r"\s+"))
    x = x.select("exon", *n, F.col("_ref")[2].cast("bigint").alias("ref_start"), F.col("_ref")[3].cast("bigint").alias("ref_len"), "s")
    r = x.select("exon", *n, "ref_start", "ref_len", F.posexplode("s").alias("row_ix", "l")).withColumn("_c", F.split("l", r"\s+"))
    src = F.col("_c")[1]
    r = r.select("exon", *n, "ref_start", "ref_len", "row_ix", taxon_of(src).alias("taxon"), contig_of(src).alias("contig"),
                 F.col("_c")[2].cast("bigint").alias("start"), F.col("_c")[3].cast("bigint").alias("size"), F.col("_c")[4].alias("strand"),
                 F.col("_c")[5].cast("bigint").alias("src_size"), F.col("_c")[6].alias("text"))
    plus = F.when(F.col("strand") == "-", F.col("src_size") - F.col("start") - F.col("size")).otherwise(F.col("start"))
    return x.select("exon", *n, "ref_start", "ref_len"), r.withColumn("plus_start", plus)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    b = spark.read.schema(BED_SCHEMA).option("sep", "\t").option("comment", "#").csv(path).filter(F.col("start").rlike(r"^\d+$"))
    return b.withColumns({c: F.col(c).cast("bigint") for c in ("start", "end")})


def read_taxonomy(spark: SparkSession, nodes: str, names: str) -> tuple[DataFrame, DataFrame]:
    """(taxid, parent, rank) and (taxid, name, name_class) of a taxonomy dump; three name classes are kept."""
    part = lambda df: df.withColumn("_c", F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t"))
    n = part(spark.read.text(nodes)).select(F.col("_c")[0].cast("bigint").alias("taxid"), F.col("_c")[1].cast("bigint").alias("parent"), F.col("_c")[2].alias("rank"))
    m = part(spark.read.text(names)).select(F.col("_c")[0].cast("bigint").alias("taxid"), F.col("_c")[1].alias("name"), F.col("_c")[3].alias("name_class"))
    return n, m.filter(F.col("name_class").isin("scientific name", "synonym", "equivalent name"))


def write_tsv(df: DataFrame, path: str, sort: list[str], by: str | None = None) -> None:
    """Sorted tab-separated text with NA for missing values; `by` writes one folder per value."""
    out = df.select(*[F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c).cast("string")), F.lit("NA")).alias(c) for c in df.columns])
    w = out.orderBy(*([by] if by else []), *sort).write.mode("overwrite").option("header", True).option("sep", "\t")
    (w.partitionBy(by) if by else w).csv(path)


def write_fasta(df: DataFrame, path: str, header: str, seq: str, by: str | None = None) -> None:
    """FASTA wrapped at 60 letters; `by` writes one folder per species."""
    text = F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.regexp_replace(F.regexp_replace(seq, "(.{60})", "$1\n"), "\n$", ""))
    out = df.select(*([by] if by else []), text.alias("value"))
    w = out.write.mode("overwrite")
    (w.partitionBy(by) if by else w).text(path)
