"""From search-hit tables to a verdict per gene."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import require_columns
from ..functions.ids import genus_of, taxon_key
from .intervals import merge_intervals, overlap_join, union_length

# Statuses of a gene in one run, and verdicts over all runs.
NOT_RUN, HIT, SPURIOUS = "NOT_RUN", "HIT", "SPURIOUS"
EXCLUDED_ONLY, IN_PHYLOGENY_ONLY, NO_HIT = "EXCLUDED_ONLY", "IN_PHYLOGENY_ONLY", "NO_HIT"
NOT_SEARCHED = "NOT_SEARCHED"
PASS, REMOVED, INCOMPLETE = "PASS", "REMOVED", "INCOMPLETE"
REMOVED_HOG, REGION_UNKNOWN, REMOVED_PARALOG = "REMOVED_HOG", "REGION_UNKNOWN", "REMOVED_PARALOG"


@dataclass(frozen=True)
class HitRules:
    evalue: float = 1e-3
    min_qcov: float = 0.0
    min_tcov: float = 0.0
    min_pident: float | None = None
    single_line: bool = False
    use_tcov: bool = True
    max_bias_frac: float | None = None
    min_genera: int = 1
    ignore_sources: tuple[str, ...] = ()
    ignore_targets: tuple[str, ...] = ()
    not_counted_taxa: tuple[str, ...] = ()
    taxon_level: str = "species"
    source: str = "search"
    intervals: bool = False


def matches_taxa(species: Column, taxa: Sequence[str], level: str = "species") -> Column:
    """True when the species is one of the names at the level; a one-word name matches its whole genus."""
    return matched_taxon(species, taxa, level).isNotNull()


def matched_taxon(species: Column, taxa: Sequence[str], level: str = "species") -> Column:
    """The first listed name that matches the species, else NULL."""
    out = F.lit(None).cast("string")
    for t in reversed(taxa):
        one_word = len([w for w in t.replace("-", "_").replace(" ", "_").split("_") if w]) == 1
        at = "genus" if one_word else level
        out = F.when((taxon_key(species, at) == taxon_key(F.lit(t), at)) & (F.trim(species) != ""), F.lit(t)).otherwise(out)
    return out


def _pct(x: Column, total: Column) -> Column:
    return F.lit(100.0) * x / F.greatest(F.lit(1), total)


def _note(text: str, x: Column, limit: float) -> Column:
    return F.concat(F.lit(text + " "), F.round(x, 1).cast("string"), F.lit(f"% below {limit:g}%"))


def _coverage(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct query and target positions covered by the lines of each key, in one sweep over both axes."""
    axes = lines.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.lit("q").alias("axis"), F.col("qstart").alias("s"), F.col("qend").alias("e")),
                F.struct(F.lit("t").alias("axis"), F.col("sstart").alias("s"), F.col("send").alias("e")),
            )
        ).alias("x"),
    ).select(*keys, "x.*")
    cov = union_length(axes, [*keys, "axis"], "s", "e", "n")
    return cov.groupBy(*keys).agg(
        F.sum(F.when(F.col("axis") == "q", F.col("n"))).alias("_q"),
        F.sum(F.when(F.col("axis") == "t", F.col("n"))).alias("_t"),
    )


def _with_intervals(rows: DataFrame, lines: DataFrame, keys: Sequence[str], name: str = "q_intervals") -> DataFrame:
    """Covered query intervals as one array per hit. Merged intervals of one hit are disjoint on one protein, so the
    array is bounded by the protein length."""
    m = merge_intervals(lines, keys, "qstart", "qend")
    arr = F.array_sort(F.collect_list(F.struct(F.col("qstart").cast("int").alias("a"), F.col("qend").cast("int").alias("b"))))
    return rows.join(m.groupBy(*keys).agg(arr.alias(name)), list(keys), "left")


def evaluate_hits(hits: DataFrame, rules: HitRules) -> DataFrame:
    """One row per (gene_id, target): best line, coverage of the lines within the E-value, and whether the hit counts.

    `line` is the place of a line in its table.

    Coverage is the union of the aligned positions (or the longest line); the note names the first rule that failed.
    """
    require_columns(
        hits, "gene_id target target_species evalue bitscore pident qstart qend sstart send qlen slen line".split(), "hits"
    )
    keys = ["gene_id", "target"]
    ok = F.col("evalue") <= rules.evalue
    # of equally good lines the first listed one counts
    line = F.struct("evalue", (-F.col("bitscore")).alias("nb"), "line", "pident", "qlen", "slen", "target_species")
    g = hits.groupBy(*keys).agg(
        F.min(line).alias("_any"),
        F.min(F.when(ok, line)).alias("_best"),
        F.max(F.when(ok, F.abs(F.col("qend") - F.col("qstart")) + 1)).alias("_long"),
    )
    good = hits.filter(ok)
    g = g.join(_coverage(good, keys), keys, "left")
    b = F.coalesce("_best", "_any")
    passing = F.col("_best").isNotNull()
    q = F.when(passing, _pct(F.col("_long") if rules.single_line else F.col("_q"), F.col("_best.qlen")))
    t = F.when(passing, _pct(F.col("_t"), F.col("_best.slen"))) if rules.use_tcov else F.lit(None).cast("double")
    g = g.select(
        *keys,
        b["target_species"].alias("target_species"),
        F.lit(rules.source).alias("source"),
        b["evalue"].alias("evalue"),
        (-b["nb"]).alias("bitscore"),
        b["pident"].alias("pident"),
        passing.alias("_pass"),
        q.alias("_qc"),
        t.alias("_tc"),
    )
    why = F.when(~F.col("_pass"), F.lit(f"E-value above {rules.evalue:g}"))
    why = why.when(F.col("_qc") < rules.min_qcov, _note("query coverage", F.col("_qc"), rules.min_qcov))
    if rules.use_tcov:
        why = why.when(F.col("_tc") < rules.min_tcov, _note("target coverage", F.col("_tc"), rules.min_tcov))
    if rules.min_pident is not None:
        why = why.when(F.col("pident") < rules.min_pident, _note("identity", F.col("pident"), rules.min_pident))
    out = _finish(g, why, rules)
    return _with_intervals(out, good, keys) if rules.intervals else out


def _finish(g: DataFrame, why: Column, rules: HitRules) -> DataFrame:
    """Apply the taxon rule and the genus minimum to hits whose own rules are decided."""
    own = matched_taxon(F.col("target_species"), rules.not_counted_taxa, rules.taxon_level)
    unknown = F.coalesce(F.trim("target_species"), F.lit("")) == ""
    why = why.when(own.isNotNull(), F.concat(F.lit("own_clade:"), own))
    g = g.withColumn("_why", why)
    out = g.select(
        "gene_id",
        "target",
        "target_species",
        "source",
        "evalue",
        "bitscore",
        F.round("_qc", 1).alias("qcov"),
        F.round("_tc", 1).alias("tcov"),
        "pident",
        F.col("_why").isNull().alias("counts_as_hit"),
        F.coalesce("_why", F.when(unknown, F.lit("species_unknown"))).alias("note"),
        F.coalesce(F.col("_why").startswith("own_clade:"), F.lit(False)).alias("in_phylogeny"),
    )
    return apply_min_genera(out, rules.min_genera)


def evaluate_domains(rows: DataFrame, rules: HitRules) -> DataFrame:
    """As evaluate_hits for profile searches: the sequence E-value decides the hit, domain E-values (`ievalue`) decide
    which domains cover, and a hit whose composition bias is too large a part of its score fails first."""
    require_columns(rows, "gene_id target evalue bitscore bias ievalue qstart qend sstart send qlen slen".split(), "domains")
    keys = ["gene_id", "target"]
    good = rows.filter(F.col("ievalue") <= rules.evalue)
    g = rows.groupBy(*keys).agg(F.min(F.struct("evalue", "bitscore", "bias", "qlen", "slen", "target_species")).alias("b"))
    g = g.join(_coverage(good.filter(F.col("evalue") <= rules.evalue), keys), keys, "left")
    passing = F.col("b.evalue") <= rules.evalue
    g = g.select(
        *keys,
        F.col("b.target_species").alias("target_species"),
        F.lit(rules.source).alias("source"),
        "b.evalue",
        "b.bitscore",
        F.lit(None).cast("double").alias("pident"),
        passing.alias("_pass"),
        F.when(passing, _pct(F.coalesce("_q", F.lit(0)), F.col("b.qlen"))).alias("_qc"),
        F.when(passing, _pct(F.coalesce("_t", F.lit(0)), F.col("b.slen"))).alias("_tc"),
        F.col("b.bias").alias("_bias"),
    )
    why = F.when(~F.col("_pass"), F.lit(f"E-value above {rules.evalue:g}"))
    if rules.max_bias_frac is not None:
        biased = F.col("_bias") >= rules.max_bias_frac * F.col("bitscore")
        why = why.when(biased, F.concat(F.lit("biased:"), F.round("_bias", 1).cast("string")))
    why = why.when(F.col("_qc") < rules.min_qcov, _note("query coverage", F.col("_qc"), rules.min_qcov))
    why = why.when(F.col("_tc") < rules.min_tcov, _note("target coverage", F.col("_tc"), rules.min_tcov))
    out = _finish(g, why, rules)
    if rules.intervals:
        # a hit made of domains that are all weak keeps all of them as its region
        strong = good.select(*keys).distinct().withColumn("_s", F.lit(True))
        region = rows.join(strong, keys, "left").filter(F.col("_s").isNull() | (F.col("ievalue") <= rules.evalue))
        out = _with_intervals(out, region.drop("_s"), keys)
    return out


def source_of(accession: Column | str) -> Column:
    """Database letters of a domain accession (pfam00069 -> PFAM)."""
    letters = F.upper(F.regexp_extract(accession, r"^([A-Za-z]+)\d", 1))
    return F.when(letters != "", letters).otherwise(F.lit("NA"))


def evaluate_models(hits: DataFrame, rules: HitRules) -> DataFrame:
    """As evaluate_hits against domain models; qualifying hits to ignored sources or domains are `excluded`."""
    keys = ["gene_id", "target"]
    g = evaluate_hits(hits, HitRules(evalue=rules.evalue, source="NA"))
    src = source_of("target")
    dropped_dom = F.lower("target").isin([d.lower() for d in rules.ignore_targets]) if rules.ignore_targets else F.lit(False)
    dropped_src = src.isin([s.upper() for s in rules.ignore_sources]) if rules.ignore_sources else F.lit(False)
    ok = F.col("counts_as_hit")
    why = F.when(~ok, F.col("note"))
    why = why.when(F.col("tcov") < rules.min_tcov, _note("domain coverage", F.col("tcov"), rules.min_tcov))
    why = why.when(F.col("qcov") < rules.min_qcov, _note("query coverage", F.col("qcov"), rules.min_qcov))
    why = why.when(dropped_dom, F.concat(F.lit("ignored:"), F.col("target")))
    why = why.when(dropped_src, F.concat(F.lit("ignored:"), src))
    return g.withColumn("_why", why).select(
        *keys, src.alias("source"), "evalue", "bitscore", "qcov", "tcov", "pident",
        F.col("_why").isNull().alias("counts_as_hit"),
        F.col("_why").alias("note"),
        F.coalesce(F.col("_why").startswith("ignored"), F.lit(False)).alias("excluded"),
    )


@dataclass(frozen=True)
class MatchRules:
    exclude_analyses: tuple[str, ...] = ()
    spurious_analyses: tuple[str, ...] = ()
    evalue_analyses: tuple[str, ...] = ()
    ignore_domains: tuple[str, ...] = ()
    max_evalue: float | None = None
    max_evalue_exempt: tuple[str, ...] = ()
    require_evalue: bool = False
    family_analysis: str = "panther"
    family_exclude_species: tuple[str, ...] = field(default=())


def evaluate_matches(matches: DataFrame, rules: MatchRules, families: DataFrame | None = None) -> DataFrame:
    """Sort every domain match into counts / excluded / spurious / ignored, decided by its analysis.

    families(family, species): a match of the family analysis counts only if the family is unknown or has a species
    outside family_exclude_species.
    """
    def norm(c: Column) -> Column:
        return F.lower(F.regexp_replace(c, r"[^A-Za-z0-9]", ""))

    def among(names: Sequence[str], c: Column) -> Column:
        return c.isin([n.lower() for n in names]) if names else F.lit(False)

    m = matches.withColumn("_a", norm(F.col("analysis")))
    fam_key = F.substring_index("signature", ":", 1)
    if families is not None:
        outside = ~F.upper("species").isin(list(rules.family_exclude_species) or [""])
        known = families.groupBy(F.col("family").alias("_fam")).agg(F.max(outside).alias("_outside"))
        m = m.withColumn("_fam", F.when(F.col("_a") == rules.family_analysis, fam_key)).join(known, "_fam", "left")
    is_e = among(rules.evalue_analyses, F.col("_a")) & ~among(rules.max_evalue_exempt, F.col("_a"))
    names = [norm(F.coalesce(c, F.lit(""))) for c in ("signature", "ipr", "description")]
    dom = F.lit(False)
    for n in names:
        dom = dom | among([d.replace("_", "").replace("-", "") for d in rules.ignore_domains], n)
    kind = F.when(among(rules.spurious_analyses, F.col("_a")), "spurious")
    kind = kind.when(among(rules.exclude_analyses, F.col("_a")), "excluded")
    kind = kind.when(F.coalesce(F.col("status"), F.lit("")) != "T", "ignored").when(dom, "excluded")
    if rules.max_evalue is not None:
        kind = kind.when(is_e & (F.col("score") > rules.max_evalue), "ignored")
    if rules.require_evalue:
        kind = kind.when(is_e & F.col("score").isNull(), "ignored")
    if families is not None:
        kind = kind.when((F.col("_a") == rules.family_analysis) & (F.col("_outside") == F.lit(False)), "excluded")
    return m.withColumn("class", kind.otherwise("counts")).drop("_a", "_fam", "_outside")


def apply_min_genera(hits: DataFrame, min_genera: int) -> DataFrame:
    """Un-count the hits of genes whose counted hits come from fewer than min_genera genera; all unknown genera count
    once together."""
    if min_genera <= 1:
        return hits
    n = (
        hits.filter("counts_as_hit")
        .groupBy("gene_id")
        .agg(F.countDistinct(F.coalesce(genus_of("target_species"), F.lit("NA"))).alias("_n"))
    )
    low = F.col("counts_as_hit") & (F.coalesce("_n", F.lit(0)) < min_genera)
    text = F.concat(F.lit("few_genera:"), F.col("_n").cast("string"))
    return (
        hits.join(n, "gene_id", "left")
        .withColumn("note", F.when(low, text).otherwise(F.col("note")))
        .withColumn("counts_as_hit", F.col("counts_as_hit") & ~low)
        .drop("_n")
    )


def gene_flags(hits: DataFrame) -> DataFrame:
    """Per gene which kinds of hit it has, and how many counted hits."""
    has = {c: c in hits.columns for c in ("excluded", "spurious", "in_phylogeny")}
    return hits.groupBy("gene_id").agg(
        F.count_if("counts_as_hit").alias("n_counted_hits"),
        *[(F.max(c) if has[c] else F.lit(False)).alias(c) for c in has],
    )


def classify_status(genes: DataFrame, flags: DataFrame, searched: DataFrame) -> DataFrame:
    """Status of every gene; a gene without proof of a finished search is NOT_RUN, whatever else is known."""
    s = searched.select("gene_id").distinct().withColumn("_ran", F.lit(True))
    j = genes.join(flags, "gene_id", "left").join(s, "gene_id", "left")
    n = F.coalesce("n_counted_hits", F.lit(0))
    status = (
        F.when(F.col("_ran").isNull(), NOT_RUN).when(n > 0, HIT).when(F.col("spurious"), SPURIOUS)
        .when(F.col("excluded"), EXCLUDED_ONLY).when(F.col("in_phylogeny"), IN_PHYLOGENY_ONLY).otherwise(NO_HIT)
    )
    return j.select(*genes.columns, status.alias("status"), n.cast("bigint").alias("n_counted_hits"))


def passes(status: Column | str, drop_spurious: bool = False) -> Column:
    ok = [NO_HIT, EXCLUDED_ONLY, IN_PHYLOGENY_ONLY] + ([] if drop_spurious else [SPURIOUS])
    return (F.col(status) if isinstance(status, str) else status).isin(ok)


def pool_runs(runs: Sequence[tuple[DataFrame, DataFrame]], genes: DataFrame, min_genera: int) -> DataFrame:
    """One status per gene from several (hits, statuses) runs searched side by side.

    The genus minimum is taken over all runs together. A counted hit stands even if some run did not search the gene;
    without one, a single NOT_RUN or missing status keeps the gene NOT_RUN.
    """
    cols = ["gene_id", "target", "target_species", "counts_as_hit", "note"]
    hits, stat = None, None
    for i, (h, s) in enumerate(runs):
        h, s = h.select(*cols), s.select("gene_id", "status", F.lit(i).alias("_run"))
        hits, stat = (h, s) if hits is None else (hits.unionByName(h), stat.unionByName(s))
    counted = apply_min_genera(hits, min_genera).filter("counts_as_hit").groupBy("gene_id").agg(F.count("*").alias("_n"))
    ran = stat.groupBy("gene_id").agg(
        F.countDistinct(F.when(F.col("status") != NOT_RUN, F.col("_run"))).alias("_ran"),
        F.max(F.col("status") == IN_PHYLOGENY_ONLY).alias("_own"),
    )
    j = genes.select("gene_id").join(counted, "gene_id", "left").join(ran, "gene_id", "left")
    n = F.coalesce("_n", F.lit(0))
    status = (
        F.when(n > 0, HIT).when(F.coalesce("_ran", F.lit(0)) < len(runs), NOT_RUN)
        .when(F.col("_own"), IN_PHYLOGENY_ONLY).otherwise(NO_HIT)
    )
    return j.select("gene_id", status.alias("status"), n.cast("bigint").alias("n_counted_hits"))


def combine_runs(statuses: DataFrame, runs: Sequence[str], drop_spurious: bool = False) -> DataFrame:
    """Verdict per gene over runs in the given order, with one status column per run.

    statuses(gene_id, run, status). The run names are configuration, so the state of a gene is a fixed set of columns.
    """
    w = statuses.groupBy("gene_id").agg(*[F.max(F.when(F.col("run") == r, F.col("status"))).alias(r) for r in runs])
    stopped = {r: ~passes(r, drop_spurious) for r in runs}
    gone = {r: F.coalesce(stopped[r] & (F.col(r) != NOT_RUN), F.lit(False)) for r in runs}
    halt = {r: F.coalesce(stopped[r], F.lit(False)) for r in runs}
    stopper = F.coalesce(*[F.when(halt[r], F.lit(r)) for r in runs])
    unfinished = F.lit(False)
    for i, r in enumerate(runs):
        earlier = F.lit(False)
        for p in runs[:i]:
            earlier = earlier | halt[p]
        unfinished = unfinished | (F.col(r) == NOT_RUN) | (F.col(r).isNull() & ~earlier)
    removed = F.array_compact(F.array(*[F.when(gone[r], F.lit(r)) for r in runs]))
    searched = sum((F.when(F.col(r).isNotNull() & (F.col(r) != NOT_RUN), 1).otherwise(0) for r in runs), F.lit(0))
    verdict = F.when(F.size(removed) > 0, REMOVED).when(F.coalesce(unfinished, F.lit(False)), INCOMPLETE).otherwise(PASS)
    return w.select(
        "gene_id",
        verdict.alias("verdict"),
        F.when(F.size(removed) > 0, F.array_join(removed, ";")).alias("removed_by"),
        stopper.alias("dropped_by"),
        F.size(removed).cast("bigint").alias("n_runs_removed"),
        searched.cast("bigint").alias("n_runs_searched"),
        *[F.coalesce(r, F.lit(NOT_SEARCHED)).alias(r) for r in runs],
    )


def unexplained_gaps(statuses: DataFrame, runs: Sequence[str]) -> DataFrame:
    """(gene_id, run) where a run never received a gene and no earlier run had stopped it."""
    m = combine_runs(statuses, runs)
    names = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r).alias("run"), F.col(r).alias("s")) for i, r in enumerate(runs)])
    x = m.select("gene_id", "dropped_by", F.explode(names).alias("x"))
    rank = F.coalesce(*[F.when(F.col("dropped_by") == r, F.lit(i)) for i, r in enumerate(runs)], F.lit(len(runs)))
    return x.filter((F.col("x.s") == NOT_SEARCHED) & (F.col("x.i") < rank)).select("gene_id", "x.run")


def hit_breadth(genes: DataFrame, hits: DataFrame, searched: DataFrame) -> DataFrame:
    """Distinct species and genera among the counted hits of each gene; NULL where no run searched(gene_id) the gene."""
    n = hits.filter("counts_as_hit").groupBy("gene_id").agg(
        F.countDistinct(taxon_key("target_species", "species")).alias("n_hit_species"),
        F.countDistinct(taxon_key("target_species", "genus")).alias("n_hit_genera"),
    )
    zero = lambda c: F.when(F.col("_run"), F.coalesce(c, F.lit(0)).cast("bigint")).alias(c)
    run = searched.select("gene_id").distinct().withColumn("_run", F.lit(True))
    return genes.join(n, "gene_id", "left").join(run, "gene_id", "left").select(*genes.columns, zero("n_hit_species"), zero("n_hit_genera"))


def run_summary(matrix: DataFrame, runs: Sequence[str], drop_spurious: bool = False) -> DataFrame:
    """Per run: genes received, removed, passed, not run, not searched, and genes it was the first to remove."""
    first = F.element_at(F.split("removed_by", ";"), 1)
    x = matrix.select(
        first.alias("_first"),
        F.explode(F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(r).alias("run"), F.col(r).alias("s"))
                            for i, r in enumerate(runs)])).alias("x"),
    ).select("_first", "x.*")
    ok = passes("s", drop_spurious)
    return x.groupBy("run", "position").agg(
        F.count_if(F.col("s") != NOT_SEARCHED).alias("genes_received"),
        F.count_if(~ok & ~F.col("s").isin(NOT_RUN, NOT_SEARCHED)).alias("removed"),
        F.count_if(ok).alias("passed"),
        F.count_if(F.col("s") == NOT_RUN).alias("not_run"),
        F.count_if(F.col("s") == NOT_SEARCHED).alias("not_searched"),
        F.count_if(F.col("_first") == F.col("run")).alias("removed_first"),
    )


def overlap_patterns(matrix: DataFrame) -> DataFrame:
    p = F.replace("removed_by", F.lit(";"), F.lit("+"))
    return matrix.filter("removed_by is not null").groupBy(p.alias("pattern")).agg(F.count("*").alias("n_genes"))


def verdict_summary(matrix: DataFrame, by: str) -> DataFrame:
    """Verdict counts per value of `by`, plus an ALL row."""
    r = matrix.rollup(by).agg(
        F.count("*").alias("n_genes"), *[F.count_if(F.col("verdict") == v).alias(v) for v in (PASS, REMOVED, INCOMPLETE)]
    )
    return r.withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit("ALL")))


def binary_matrix(matrix: DataFrame, runs: Sequence[str], drop_spurious: bool = False) -> DataFrame:
    """1 = removed by the run, 0 = passed it, NULL = no answer."""
    def bit(r: str) -> Column:
        return F.when(F.col(r).isin(NOT_RUN, NOT_SEARCHED), None).when(passes(r, drop_spurious), 0).otherwise(1)
    return matrix.select("gene_id", *[bit(r).cast("bigint").alias(r) for r in runs])


def group_pairs(alignments: DataFrame, verdicts: DataFrame, groups: DataFrame, evidence: DataFrame) -> DataFrame:
    """Alignments between a PASS gene and a removed member of its own group that has evidence.

    The pairs come from the alignment table, so nothing multiplies out inside a group.
    """
    g1 = groups.select(F.col("gene_id").alias("candidate"), F.col("group_id").alias("_g1"))
    g2 = groups.select(F.col("gene_id").alias("member"), F.col("group_id").alias("_g2"))
    ok = verdicts.filter(F.col("verdict") == PASS).select(F.col("gene_id").alias("candidate"))
    bad = verdicts.filter(F.col("verdict") == REMOVED).select(F.col("gene_id").alias("member"))
    ev = evidence.select(F.col("gene_id").alias("member")).distinct()
    return (
        alignments.join(ok, "candidate", "left_semi").join(bad, "member", "left_semi").join(ev, "member", "left_semi")
        .join(g1, "candidate").join(g2, "member").filter(F.col("_g1") == F.col("_g2"))
        .withColumnRenamed("_g1", "group_id").drop("_g2")
    )


def group_pair_counts(verdicts: DataFrame, groups: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per group how many candidates face how many evidence members, and the number of pairs that makes."""
    ev = evidence.select("gene_id").distinct().withColumn("_ev", F.lit(True))
    j = groups.join(verdicts.select("gene_id", "verdict"), "gene_id").join(ev, "gene_id", "left")
    g = j.groupBy("group_id").agg(
        F.count_if(F.col("verdict") == PASS).alias("n_candidates"),
        F.count_if((F.col("verdict") == REMOVED) & F.col("_ev")).alias("n_members"),
    )
    return g.filter("n_candidates > 0 and n_members > 0").withColumn(
        "n_pairs", F.col("n_candidates") * F.col("n_members")
    )


def group_rule(
    alignments: DataFrame, regions: DataFrame, no_region: DataFrame, min_overlap: int = 20, unknown_fails: bool = True
) -> DataFrame:
    """Remove a candidate whose alignment to a group member covers enough of the region that condemned the member.

    alignments(candidate, member, start, end) in member coordinates; regions(member, r_start, r_end).
    """
    a = merge_intervals(alignments, ["candidate", "member"], "start", "end")
    r = merge_intervals(regions, ["member"], "r_start", "r_end")
    part = F.least("end", "r_end") - F.greatest("start", "r_start") + 1
    ov = overlap_join(a, r, ["member"], ("start", "end"), ("r_start", "r_end")).groupBy("candidate", "member").agg(
        F.sum(part).cast("bigint").alias("n")
    )
    best = ov.groupBy("candidate").agg(F.min(F.struct((-F.col("n")).alias("n"), "member")).alias("b"))
    lost = no_region.select("member").distinct().join(r.select("member").distinct(), "member", "left_anti")
    unknown = alignments.join(lost, "member", "left_semi").select("candidate").distinct().withColumn("_u", F.lit(True))
    out = alignments.select("candidate").distinct().join(best, "candidate", "left").join(unknown, "candidate", "left")
    n = F.coalesce(-F.col("b.n"), F.lit(0)).cast("bigint")
    verdict = F.when(n >= min_overlap, REMOVED_HOG)
    if unknown_fails:
        verdict = verdict.when(F.col("_u"), REGION_UNKNOWN)
    return out.select("candidate", verdict.otherwise(PASS).alias("verdict"), F.col("b.member").alias("best_member"),
                      n.alias("best_overlap"))


def paralog_rule(
    alignments: DataFrame, candidates: DataFrame, max_evalue: float, min_pident: float = 50.0, min_qcov: float = 50.0
) -> DataFrame:
    """Remove a candidate with one alignment to a non-candidate that passes both cuts; report the best alignment.

    alignments(query, subject, pident, evalue, qstart, qend, qlen).
    """
    qcov = F.lit(100.0) * (F.col("qend") - F.col("qstart") + 1) / F.col("qlen")
    a = (
        alignments.filter((F.col("query") != F.col("subject")) & (F.col("evalue") <= max_evalue))
        .join(candidates.select(F.col("gene_id").alias("subject")).distinct(), "subject", "left_anti")
        .withColumn("qcov", qcov)
    )
    row = F.struct("pident", "qcov", (-F.col("evalue")).alias("ne"), "subject")
    ok = (F.col("pident") >= min_pident) & (F.col("qcov") >= min_qcov)
    g = a.groupBy("query").agg(F.max(row).alias("any"), F.max(F.when(ok, row)).alias("ok"))
    b = F.coalesce("ok", "any")
    return g.select(
        "query", F.when(F.col("ok").isNotNull(), REMOVED_PARALOG).otherwise(PASS).alias("verdict"),
        b["subject"].alias("subject"), b["pident"].alias("pident"), F.round(b["qcov"], 2).alias("qcov"),
        (-b["ne"]).alias("evalue"),
    )


def two_sided_match(hits: DataFrame, min_ident: float, min_cov: float) -> DataFrame:
    """Best target per query by pooled identity times the larger of query and target cover, among those that reach both limits.

    hits(gene_id, target, n_ident, length, qstart, qend, sstart, send, qlen, slen).
    """
    keys = ["gene_id", "target"]
    g = hits.groupBy(*keys).agg(
        (F.lit(100.0) * F.sum("n_ident") / F.sum("length")).alias("ident"), F.max("qlen").alias("qlen"),
        F.max("slen").alias("slen"),
    ).join(_coverage(hits, keys), keys)
    cov = F.greatest(_pct(F.col("_q"), F.col("qlen")), _pct(F.col("_t"), F.col("slen")))
    g = g.withColumn("cover", cov).filter((F.col("ident") >= min_ident) & (F.col("cover") >= min_cov))
    b = g.groupBy("gene_id").agg(F.min(F.struct((-F.col("ident") * F.col("cover")).alias("ns"), "target", "ident", "cover")).alias("b"))
    return b.select("gene_id", "b.target", F.round("b.ident", 2).alias("ident"), F.round("b.cover", 2).alias("cover"))


def chain_screens(genes: DataFrame, screens: Sequence[DataFrame]) -> DataFrame:
    """Each screen (gene_id, status) sees only survivors of the one before. Adds `stopped_by`, NULL for survivors."""
    out = genes.withColumn("stopped_by", F.lit(None).cast("int"))
    for i, s in enumerate(screens):
        ok = s.filter(passes("status")).select("gene_id", F.lit(True).alias("_ok"))
        out = out.join(ok, "gene_id", "left").withColumn(
            "stopped_by", F.coalesce("stopped_by", F.when(F.col("_ok").isNull(), F.lit(i + 1)))
        ).drop("_ok")
    return out


def passing_sequences(matrix: DataFrame, seqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences of the PASS genes, and the PASS genes that have none (must be empty)."""
    ok = matrix.filter(F.col("verdict") == PASS).select("gene_id")
    return seqs.join(ok, "gene_id", "left_semi"), ok.join(seqs.select("gene_id"), "gene_id", "left_anti")


def run_conflicts(statuses: DataFrame, passed: DataFrame) -> DataFrame:
    """Genes on which the passed list and the status table of a run disagree (must be empty)."""
    ok = statuses.filter(passes("status")).select("gene_id")
    a = passed.select("gene_id").join(ok, "gene_id", "left_anti").withColumn("issue", F.lit("passed_but_status_fails"))
    b = ok.join(passed.select("gene_id"), "gene_id", "left_anti").withColumn("issue", F.lit("status_passes_but_not_listed"))
    return a.unionByName(b)
