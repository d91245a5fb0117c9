"""Quality control, best-record selection and summaries of sequence and annotation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import arg_max, arg_min
from ..functions.ids import looks_like_species, natural_key, species_suffix, taxon_key

# The seven label combinations of the quality report, in report order.
QC_LABELS = ["S", "noM", "<30", "S/noM", "S/<30", "S/noM/<30", "noM/<30"]


def qc_label(seq: Column | str, min_len: int = 30) -> Column:
    """S = `*` or `X` before the last residue, noM = no leading M, <30 = too short (the label text never changes)."""
    s = F.col(seq) if isinstance(seq, str) else seq
    n = F.length(s)
    body = F.substring(s, F.lit(1), n - 1)
    return F.concat_ws(
        "/",
        F.when(body.rlike(r"[*X]"), "S"),
        F.when(~s.startswith("M"), "noM"),
        F.when(n < min_len, "<30"),
    )


def qc_sequences(df: DataFrame, seq: str, min_len: int = 30, keep_nom_only: bool = False) -> DataFrame:
    """Non-empty sequences with `qc_label` and `qc_keep`."""
    label = qc_label(seq, min_len)
    keep = (F.col("qc_label") == "") | (F.lit(keep_nom_only) & (F.col("qc_label") == "noM"))
    return df.filter(F.length(seq) > 0).withColumn("qc_label", label).withColumn("qc_keep", keep)


def qc_summary(qc: DataFrame, by: str) -> DataFrame:
    """Counts of the label combinations per species, with totals and the share kept and lost."""
    g = qc.groupBy(by).agg(
        F.count("*").alias("n_input"),
        F.count_if("qc_keep").alias("n_clean"),
        *[F.count_if((F.col("qc_label") == x) & ~F.col("qc_keep")).alias(x) for x in QC_LABELS],
    )
    pct = lambda n: F.round(F.lit(100.0) * n / F.col("n_input"), 2)
    return g.withColumn("filtered_total", F.col("n_input") - F.col("n_clean")).withColumn(
        "retained_pct", pct(F.col("n_clean"))
    ).withColumn("reduction_pct", pct(F.col("n_input") - F.col("n_clean")))


def tag_ids(df: DataFrame, header: str, file: str, species_map: DataFrame | None = None, species: str | None = None, remove: bool = False) -> DataFrame:
    """First header token plus `__Species`, from a constant or a (file, species) map; an unmapped file gives its own name.

    `remove` first takes what stands after the last `__` away; otherwise the token stays whole.
    """
    token = F.element_at(F.split(F.trim(header), r"\s+"), 1)
    bare = F.regexp_replace(token, r"__(?!.*__).*$", "") if remove else token
    if species_map is not None:
        df = df.join(species_map.select(F.col("file").alias(file), F.col("species").alias("_sp")), file, "left")
        sp = F.coalesce("_sp", F.col(file))
    else:
        sp = F.lit(species)
    return df.withColumn("tagged_id", F.concat(bare, F.lit("__"), F.replace(sp, F.lit(" "), F.lit("_")))).drop("_sp")


def is_protein_coding(transcript_biotype: Column, has_cds: Column, gene_biotype: Column) -> Column:
    coding = lambda c: F.coalesce(F.lower(c) == "protein_coding", F.lit(False))
    return coding(transcript_biotype) | F.coalesce(has_cds, F.lit(False)) | coding(gene_biotype)


def longest_per_group(df: DataFrame, group: str, length: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Longest record of each group (first listed on ties) with the number of records in the group."""
    best = F.struct(*columns, F.col(length), F.col(order))
    g = df.groupBy(group).agg(F.count("*").alias("n_isoforms"), arg_min(best, -F.col(length), F.col(order)).alias("b"))
    return g.filter(F.col("b")[length] > 0).select(group, "b.*", "n_isoforms")


def coding_surplus(cds_length: Column, protein_length: Column) -> Column:
    """Bases of the coding sequence beyond three per amino acid (3 = a stop codon); null without a protein."""
    return F.when(protein_length > 0, cds_length - 3 * protein_length)


def other_members(df: DataFrame, best: DataFrame, group: str, record: str) -> DataFrame:
    """Every record that is not the chosen one of its group, one row each beside the chosen id.

    Kept as rows: a group may hold any number of records, so they are not folded into one cell.
    """
    b = best.select(group, F.col(record).alias("chosen"))
    return df.join(b, group).filter(F.col(record) != F.col("chosen"))


def transcript_metrics(gff: DataFrame) -> DataFrame:
    """Per transcript: gene, summed exon length (else span), coding length, exon count, stop flag and strand.

    gff(type, start, end, strand, id, parents array, flags array). The strand of a gene line wins.
    """
    tx = gff.filter(F.col("type").isin("mRNA", "transcript")).groupBy(F.col("id").alias("transcript")).agg(
        F.min(F.element_at("parents", 1)).alias("gene"), F.min("strand").alias("_ts"), (F.max("end") - F.min("start") + 1).alias("_span"))
    genes = gff.filter("type = 'gene'").groupBy(F.col("id").alias("gene")).agg(F.min("strand").alias("_gs"))
    size = F.greatest(F.col("end") - F.col("start") + 1, F.lit(0))
    kind = lambda t: F.col("type") == t
    parts = (
        gff.filter(F.col("type").isin("exon", "CDS", "stop_codon"))
        .select("type", "start", "end", "flags", F.explode("parents").alias("transcript"))
        .groupBy("transcript").agg(
            F.sum(F.when(kind("exon"), size)).alias("_exon"), F.sum(F.when(kind("CDS"), size)).alias("_cds"),
            F.count_if(kind("exon")).alias("_n"), F.max(kind("stop_codon")).alias("_stop"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("flags")))).alias("_flags"),
        )
    )
    # a transcript that only its parts name is one all the same
    j = tx.join(parts, "transcript", "full").join(genes, "gene", "left")
    mrna = F.when(F.col("_exon") > 0, F.col("_exon")).otherwise(F.coalesce("_span", F.lit(0)))
    return j.select(
        "transcript", "gene", F.coalesce("_gs", "_ts").alias("strand"), mrna.cast("bigint").alias("mrna_length"),
        F.coalesce("_cds", F.lit(0)).cast("bigint").alias("cds_length"), F.coalesce("_n", F.lit(0)).cast("bigint").alias("exon_count"),
        F.coalesce("_stop", F.lit(False)).alias("has_stop"), F.array_join(F.coalesce("_flags", F.array().cast("array<string>")), ",").alias("flags"),
    )


def rebuild_genes(gff: DataFrame) -> DataFrame:
    """Add one gene row per `gene_id` attribute of transcripts when the annotation has no gene rows of its own."""
    none = gff.filter("type = 'gene'").limit(1).isEmpty()
    if not none:
        return gff
    g = gff.filter(F.col("type").isin("mRNA", "transcript") & F.col("gene_id").isNotNull()).groupBy("gene_id").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("strand", "start").alias("strand"))
    return gff.unionByName(g.select(F.lit("gene").alias("type"), "start", "end", "strand", F.col("gene_id").alias("id"), "gene_id"), allowMissingColumns=True)


def authenticity(header: Column | str) -> Column:
    """2 for a real mRNA or CDS record, 0 for miscellaneous RNA, else 1."""
    h = F.col(header) if isinstance(header, str) else header
    u = F.upper(h)
    good = u.contains("GBKEY=MRNA") | u.contains("GBKEY=CDS") | h.contains("XM_") | h.contains("NM_")
    return F.when(good, 2).when(u.contains("GBKEY=MISC_RNA") | h.contains("XR_"), 0).otherwise(1)


def best_by_score(df: DataFrame, key: str, score: str, length: str, order: str) -> DataFrame:
    """Every record with `is_best`: the highest (score, length) of its key, the first listed on ties."""
    best = df.groupBy(key).agg(F.min(F.struct((-F.col(score)).alias("s"), (-F.col(length)).alias("l"), order)).alias("_b"))
    return df.join(best, key).withColumn("is_best", F.col(order) == F.col("_b")[order]).drop("_b")


def fasta_summary(files: DataFrame, records: DataFrame) -> DataFrame:
    """(file, size in MB, number of sequences); files(file, bytes), records(file)."""
    n = records.groupBy("file").agg(F.count("*").alias("n_sequences"))
    return files.join(n, "file", "left").select(
        "file", F.round(F.col("bytes") / F.lit(1048576.0), 2).alias("size_mb"), F.coalesce("n_sequences", F.lit(0)).cast("bigint").alias("n_sequences"))


def build_reference_set(seqs: DataFrame, exclude: Sequence[str], level: str = "species") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sequences to search against, the species table, and the problems (duplicate ids, empty sequences; must be empty).

    seqs(file_species, id, seq): an id that carries a species-like tag keeps it, any other is tagged with file_species.
    """
    tag = species_suffix("id")
    sp = F.when(looks_like_species(tag), tag).otherwise(F.col("file_species"))
    new_id = F.when(looks_like_species(tag), F.col("id")).otherwise(F.concat_ws("__", "id", "file_species"))
    keys = [taxon_key(F.lit(e), level) for e in exclude]
    # whole files are left out, by the species of the file and before ids are tagged
    out = taxon_key("file_species", level).isin(keys) if keys else F.lit(False)
    clean = F.replace("seq", F.lit("*"), F.lit(""))
    s = seqs.select(new_id.alias("id"), sp.alias("species"), clean.alias("seq"), "file_species", out.alias("excluded"), tag.alias("_tag"))
    fine = looks_like_species("_tag")
    table = s.groupBy("file_species").agg(
        F.count("*").alias("n_sequences"), F.count_if(fine).alias("n_tagged"), F.count_if(F.col("_tag").isNotNull() & ~fine).alias("n_odd"),
        F.when(F.max("excluded"), "EXCLUDED").otherwise("INCLUDED").alias("status"))
    kept = s.filter("not excluded").select("id", "species", "seq")
    dup = kept.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("duplicate_id").alias("problem"))
    empty = kept.filter(F.length("seq") == 0).select("id", F.lit("empty_sequence").alias("problem"))
    return kept, table, dup.unionByName(empty)


def species_inventory(ids: DataFrame, id_col: str) -> DataFrame:
    """Sequences per species tag with their share, and how many ids carry no or an odd tag."""
    tag = species_suffix(id_col)
    kind = F.when(tag.isNull(), "untagged").when(looks_like_species(tag), "tagged").otherwise("odd")
    g = ids.select(kind.alias("kind"), F.when(kind == "tagged", tag).alias("species"))
    g = g.groupBy("kind", "species").agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n")).scalar()
    return g.withColumn("share_pct", F.round(F.lit(100.0) * F.col("n") / total, 2))


def tier_report(species: DataFrame, tiers: DataFrame, thin: int, max_share: float, few: int) -> DataFrame:
    """Species and sequences per tier with EMPTY / THIN status and the number of DOMINANT and FEW_SEQUENCES species.

    species(species, tier, n); tiers(tier) lists every tier that must appear.
    """
    total = species.agg(F.sum("n")).scalar()
    s = species.withColumn("_t", total).withColumn("_share", F.col("n") / F.col("_t"))
    g = s.groupBy("tier").agg(
        F.count("*").alias("n_species"), F.sum("n").cast("bigint").alias("n_sequences"),
        F.count_if(F.col("_share") > max_share).alias("n_dominant"), F.count_if((F.col("n") > 0) & (F.col("n") < few)).alias("n_few"),
        F.round(100 * F.sum("n") / F.max("_t"), 1).alias("pct"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    n = F.coalesce("n_species", F.lit(0))
    return tiers.join(g, "tier", "left").select(
        "tier", z("n_species"), z("n_sequences"), z("n_dominant"), z("n_few"), F.coalesce("pct", F.lit(0.0)).alias("pct"),
        F.when(n == 0, "EMPTY").when(n < thin, "THIN").otherwise("ok").alias("status"))


def family_species(df: DataFrame, family: str, species: str) -> DataFrame:
    return df.groupBy(family, species).agg(F.count("*").alias("n"))


def event_matrix(events: DataFrame, by: Sequence[str], column: str, values: Sequence) -> DataFrame:
    """Counts of each event (rows) per species or ancestor (columns); absent ones are 0."""
    return events.groupBy(*by).agg(*[F.count_if(F.col(column) == v).alias(str(v)) for v in values])


def species_totals(df: DataFrame, species: str, gene_type: str, specific: Column) -> DataFrame:
    """Genes, DNG and PDNG per species with percentages and the species-specific DNG share."""
    dng = F.col(gene_type) == "DNG"
    g = df.groupBy(species).agg(
        F.count("*").alias("total_genes"), F.count_if(dng).alias("DNGs"), F.count_if(F.col(gene_type) == "PDNG").alias("PDNGs"),
        F.count_if(dng & specific).alias("specific_DNGs"))
    pct = lambda a, b: F.when(b > 0, F.round(F.lit(100.0) * a / b, 2)).otherwise(0.0)
    return g.withColumn("pct_DNGs", pct(F.col("DNGs"), F.col("total_genes"))).withColumn(
        "pct_specific_DNGs", pct(F.col("specific_DNGs"), F.col("DNGs")))


def long_list(df: DataFrame, gene: str, gene_type: str, node: str, excluded: Sequence = ()) -> DataFrame:
    """The rows that the final tables count: a named gene of type DNG or PDNG (any case, spaces around it) whose node isn't excluded."""
    kind = F.upper(F.trim(gene_type))
    d = df.filter((F.trim(F.col(gene).cast("string")) != "") & kind.isin("DNG", "PDNG"))
    left_out = F.coalesce(F.col(node).isin(list(excluded)), F.lit(False)) if excluded else F.lit(False)
    return d.filter(~left_out).withColumn(gene_type, kind)


def by_age(df: DataFrame, species: str, node: str, gene_type: str, excluded: Sequence = ()) -> DataFrame:
    """Gene counts per species, node and type, without the excluded nodes."""
    d = df.filter(~F.col(node).isin(list(excluded))) if excluded else df
    return d.groupBy(species, node).agg(*[F.count_if(F.col(gene_type) == t).alias(t) for t in ("DNG", "PDNG")])


def relatedness_order(tree, reference: Column) -> DataFrame:
    """Leaves ranked by the depth of their common ancestor with a reference leaf (closest first)."""
    ref = tree.closure.filter(F.col("node") == reference).select("ancestor", F.col("dist").alias("_d"))
    c = tree.closure.join(tree.leaves, "node", "left_semi").join(ref, "ancestor")
    return c.groupBy(F.col("node").alias("species")).agg(F.min("_d").alias("distance"))


def top1(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """First row of each key in a multi-part order."""
    return df.groupBy(*keys).agg(arg_min(F.struct(*columns), *order).alias("b")).select(*keys, "b.*")


def duplicate_keys(df: DataFrame, keys: Sequence[str], distinct_of: str | None = None) -> DataFrame:
    """Keys that occur more than once (or with more than one value of another column); must usually be empty."""
    n = F.countDistinct(distinct_of) if distinct_of else F.count("*")
    return df.groupBy(*keys).agg(n.alias("n")).filter("n > 1")


def coverage_check(ids: DataFrame, known: DataFrame, key: str, by: str, minimum: float) -> DataFrame:
    """Share of ids found per species and whether it reaches the minimum."""
    k = known.select(key).distinct().withColumn("_k", F.lit(True))
    g = ids.join(k, key, "left").groupBy(by).agg(F.count("*").alias("n_ids"), F.count("_k").alias("n_found"))
    return g.withColumn("ok", F.col("n_found") >= F.lit(minimum) * F.col("n_ids"))


def id_form_mismatch(ids: DataFrame, known: DataFrame, by: str, key: str, strict: Column, loose: Column) -> DataFrame:
    """Per species how many ids match as written and how many only after loosening their form."""
    ks = known.select(by, strict.alias("_s")).distinct().withColumn("_ms", F.lit(True))
    kl = known.select(by, loose.alias("_l")).distinct().withColumn("_ml", F.lit(True))
    j = ids.select(by, strict.alias("_s"), loose.alias("_l")).join(ks, [by, "_s"], "left").join(kl, [by, "_l"], "left")
    g = j.groupBy(by).agg(
        F.count("*").alias("n_ids"), F.count("_ms").alias("n_strict"), F.count_if(F.col("_ms").isNull() & F.col("_ml")).alias("n_loose_only"))
    issue = F.when(F.col("n_loose_only") > 0, "id_form_differs").when(F.col("n_strict") == 0, "no_match")
    return g.withColumn("issue", issue)


def id_collisions(ids: DataFrame, by: str, raw: str, form: Column) -> DataFrame:
    """Normalised keys shared by different ids of one species (must be empty before joining on them)."""
    return ids.groupBy(by, form.alias("key")).agg(F.countDistinct(raw).alias("n_ids"), F.min(raw).alias("example")).filter("n_ids > 1")


def candidate_stats(strata: DataFrame, totals: DataFrame, kept: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Share of genes per species that are candidates: clustered only, all, and all after the cross-check.

    strata(species, gene, node) with the candidate classes among the nodes (the clustered class first); totals(species,
    n_genes); kept(species, gene) are the survivors of the cross-check.
    """
    k = kept.select("species", "gene").withColumn("_kept", F.lit(True))
    cand = F.col("node").isin(list(candidates))
    g = strata.join(k, ["species", "gene"], "left").groupBy("species").agg(
        F.count_if(F.col("node") == candidates[0]).alias("n_clustered"), F.count_if(cand).alias("n_candidates"),
        F.count_if(cand & F.col("_kept")).alias("n_checked"))
    j = totals.join(g, "species", "left").na.fill(0, ["n_clustered", "n_candidates", "n_checked"])
    pct = lambda c: F.round(F.lit(100.0) * F.col(c) / F.col("n_genes"), 2)
    return j.withColumns({"pct_" + c[2:]: pct(c) for c in ("n_clustered", "n_candidates", "n_checked")})


def node_counts(strata: DataFrame, nodes: Sequence[str]) -> DataFrame:
    """Genes per species in one column per node."""
    return event_matrix(strata, ["species"], "node", nodes)
