"""Rule cascade from event nodes to gene types.

A lineage position is an index: 0 is the focal species itself, 1 its parent, larger is older. Lineages are short and come
from the tree, so the nodes of an event are a short array of indexes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import dealt
from ..functions.aligned import focal_frame_orf, orf_call, reference_view, sites_known
from .tree import Tree, branch_points, parsimony_states


def nearest_event(events: DataFrame, orf: DataFrame, excluded: Sequence[int] = (), skip_younger: bool = False) -> DataFrame:
    """The event nearest to the ORF node of each gene: nearest older node, then most nodes, then first listed.

    events(gene, kind, event, seq, ixs array), orf(gene, orf_ix) with one or several ORF nodes per gene. Events that
    touch the ORF node (with skip_younger: or any ancestor younger than it) are passed over.
    """
    j = events.join(orf, "gene")
    o = F.col("orf_ix")
    touch = F.array_contains("ixs", o)
    if skip_younger:
        touch = touch | F.exists("ixs", lambda i: (i > 0) & (i < o))
    older = F.filter("ixs", lambda i: (i > o) & ~i.isin(list(excluded) or [-1]))
    j = j.withColumn("near", F.array_min(older)).filter(~touch & F.col("near").isNotNull())
    pick = F.min(F.struct("near", (-F.size("ixs")).alias("n"), "seq", "event", "ixs"))
    return j.groupBy("gene", "kind", "orf_ix").agg(pick.alias("b")).select("gene", "kind", "orf_ix", "b.event", "b.ixs", "b.near")


def limit_to_synteny(ixs: Column, synteny_ix: Column, excluded: Sequence[int] = ()) -> Column:
    """Event nodes no older than the synteny node, without the excluded ones."""
    return F.filter(ixs, lambda i: (i <= synteny_ix) & ~i.isin(list(excluded) or [-1]))


def enablers(indel_ixs: Column, stop_ixs: Column, orf_ix: Column) -> Column:
    """The two nearest nodes older than the ORF node over both kinds of event, older one first; NULL with fewer than two."""
    none = F.array().cast("array<bigint>")
    nodes = F.array_distinct(F.concat(F.coalesce(indel_ixs, none), F.coalesce(stop_ixs, none)))
    older = F.slice(F.array_sort(F.filter(nodes, lambda i: i > orf_ix)), 1, 2)
    return F.when(F.size(older) == 2, F.reverse(older))


def gene_types(chosen: DataFrame, max_dist: int = 1) -> DataFrame:
    """Enabler nodes, their distance to the ORF node, and the type of each gene.

    chosen(gene, orf_ix, indel_ixs, stop_ixs): a DNG has two older enabler nodes, the nearer at most max_dist away.
    """
    c = chosen.withColumn("enabler_ixs", enablers(F.col("indel_ixs"), F.col("stop_ixs"), F.col("orf_ix")))
    dist = F.array_min("enabler_ixs") - F.col("orf_ix")
    return c.withColumn("dist", dist).withColumn("gene_type", F.when(dist <= max_dist, "DNG").otherwise("PDNG"))


def orf_clade_consistency(events: DataFrame, orf: DataFrame, inside: DataFrame) -> DataFrame:
    """Oldest ORF node, not older than the given one, whose chosen events are absent from its own clade.

    orf(gene, orf_ix); inside(gene, kind, event, ix) lists the lineage nodes whose clade holds a carrier of the event. The
    rule of moving one node younger and choosing again stops at the first node that passes, so every candidate node is
    judged at once and the oldest passing one is taken; node 0 always passes.
    """
    cand = orf.select("gene", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("orf_ix").cast("bigint"))).alias("orf_ix"))
    pick = nearest_event(events, cand)
    bad = pick.join(inside.withColumnRenamed("ix", "orf_ix"), ["gene", "kind", "event", "orf_ix"], "left_semi").filter("orf_ix > 0")
    ok = cand.join(bad.select("gene", "orf_ix").distinct(), ["gene", "orf_ix"], "left_anti")
    best = ok.groupBy("gene").agg(F.max("orf_ix").alias("new_orf_ix"))
    return orf.join(best, "gene").withColumn("moved", F.col("new_orf_ix") != F.col("orf_ix"))


def inferred_nodes(chosen: DataFrame, at_node: DataFrame, side: DataFrame, orf_bearing: DataFrame) -> DataFrame:
    """Nodes between a moved ORF node and the nearest node of its chosen event at which the event is inferred.

    chosen(gene, kind, event, orf_ix, ixs), of genes whose ORF node moved; at_node(gene, kind, event, ix, length): carriers on
    the lineage; side(gene, kind, event, ix, length): living carriers by the lineage node at which they branch off. The lengths
    that count are those of the nearest older lineage carrier; a node between is added if its side branch carries one of
    them, and rejected if it bears the ORF, orf_bearing(gene, ix). All genes are settled at once.
    """
    key = ["gene", "kind", "event"]
    older = F.filter("ixs", lambda i: i > F.col("orf_ix"))
    c = chosen.select(*key, "orf_ix", older.alias("_older")).withColumn("_near", F.array_min("_older"))
    own = c.select(*key, F.explode("_older").alias("ix")).join(at_node, [*key, "ix"])
    first = own.groupBy(*key).agg(F.min("ix").alias("ix"))
    lengths = own.join(first, [*key, "ix"], "left_semi").select(*key, "length").distinct()
    between = side.join(c.select(*key, "orf_ix", "_near"), key).filter("ix > orf_ix and ix < _near")
    found = between.join(lengths, [*key, "length"], "left_semi").select(*key, "ix").distinct()
    bears = orf_bearing.select("gene", "ix").distinct().withColumn("_b", F.lit(True))
    return found.join(bears, ["gene", "ix"], "left").select(*key, "ix", F.when(F.col("_b"), "rejected").otherwise("added").alias("status"))


def with_inferred(chosen: DataFrame, inferred: DataFrame) -> DataFrame:
    """Chosen events with the added nodes in their node lists."""
    key = ["gene", "kind", "event"]
    # at most one entry a lineage node, so the list is bounded by the depth of the tree
    more = inferred.filter("status = 'added'").groupBy(*key).agg(F.sort_array(F.collect_set("ix")).alias("_more"))
    none = F.array().cast("array<bigint>")
    return chosen.join(more, key, "left").withColumn("ixs", F.concat("ixs", F.coalesce("_more", none))).drop("_more")


def start_gain_events(rows: DataFrame) -> DataFrame:
    """Rows whose first reference codon is a full codon other than ATG, unless an ATG ORF already covers the frame.

    rows(gene, taxon, first_codon, ref_first, covered).
    """
    full = (F.length("first_codon") == 3) & ~F.col("first_codon").rlike("[-N]") & (F.col("first_codon") != "ATG")
    return rows.filter((F.col("ref_first") == "ATG") & full & ~F.col("covered")).select(
        "gene", "taxon", F.lit(1).alias("start"), F.lit(3).alias("end"), F.concat(F.lit("noATG_"), F.col("first_codon")).alias("codon"))


def start_gains_from_rows(aln: DataFrame, known: DataFrame, min_span: float, min_bases: float) -> DataFrame:
    """start_gain_events read from aligned rows(gene, taxon, ref_text, row_text), the focal row left out.

    known(gene, taxon) lists events at the first codon that the table holds already. A row is covered when an ATG in the
    focal frame opens an unbroken stretch that passes both cuts. Null texts give no event; repeated rows give one each.
    """
    x = aln.filter("ref_text is not null and row_text is not null").join(known.select("gene", "taxon").distinct(), ["gene", "taxon"], "left_anti")
    x = x.select("gene", "taxon", "ref_text", "row_text", reference_view("ref_text", "row_text").alias("v"))
    # the longer scan is only for rows that could be events
    x = x.filter("v.ref_first = 'ATG' and length(v.first_codon) = 3 and v.first_codon <> 'ATG'").filter(~F.col("v.first_codon").rlike("[-N]"))
    x = x.withColumn("covered", focal_frame_orf(min_span, min_bases, focal_start=False)("ref_text", "row_text")["has"])
    return start_gain_events(x.select("gene", "taxon", "v.first_codon", "v.ref_first", "covered"))


def filter_indel_events(events: DataFrame, details: DataFrame, support: DataFrame) -> DataFrame:
    """Events with the reason they are no events: a terminal gap, or a homopolymer without a living carrier beside it.

    events(gene, event, homopolymer), details(gene, event, start, end, ref_len) of the carriers among its nodes,
    support(gene, event) events with a carrier on a side branch.
    """
    d = details.groupBy("gene", "event").agg(F.max((F.col("start") == 1) | (F.col("end") == F.col("ref_len"))).alias("_t"))
    s = support.select("gene", "event").distinct().withColumn("_s", F.lit(True))
    j = events.join(d, ["gene", "event"], "left").join(s, ["gene", "event"], "left")
    why = F.concat_ws(",", F.when(F.col("_t"), "terminal_gap"), F.when(F.col("homopolymer") & F.col("_s").isNull(), "homopolymer_no_extant_support"))
    return j.select(*events.columns, F.when(why != "", why).alias("reason"))


def filter_stop_events(events: DataFrame) -> DataFrame:
    """Stops in the reference frame, without the focal terminal stop. events(..., start, ref_len)."""
    return events.filter((F.col("start") % 3 == 1) & (F.col("start") + 2 < F.col("ref_len")))


def drop_orf_bearing(events: DataFrame, has_orf: DataFrame, whole: bool = False) -> DataFrame:
    """Events without the nodes that bear the ORF; whole=True drops the event once it touches one.

    events(gene, ..., ixs), has_orf(gene, ix).
    """
    h = has_orf.groupBy("gene").agg(F.collect_set("ix").alias("_h"))
    j = events.join(h, "gene", "left")
    none = F.array().cast("array<bigint>")
    hit = F.arrays_overlap("ixs", F.coalesce("_h", none))
    left = F.array_except("ixs", F.coalesce("_h", none))
    kept = F.when(hit & F.lit(whole), none).otherwise(left)
    return j.withColumn("ixs", kept).filter(F.size("ixs") > 0).drop("_h")


def remove_conserved(genes: DataFrame, has_orf: DataFrame, nodes: Sequence) -> tuple[DataFrame, DataFrame]:
    """Genes without an ORF in any listed node, and the log of those removed (one row per gene and node)."""
    log = has_orf.filter(F.col("node").isin(list(nodes))).select("gene", "node").distinct().join(genes.select("gene"), "gene", "left_semi")
    return genes.join(log, "gene", "left_anti"), log


def evidence(enabler_nodes: DataFrame, carriers: DataFrame, aligned: DataFrame, tree: Tree, outer: bool = False, by: DataFrame | None = None) -> DataFrame:
    """Living support for every enabler node: carriers and contradicting species on its side branch.

    enabler_nodes(gene, focal, ix, event), carriers(gene, event, species) living carriers of the same change,
    aligned(gene, event, species) species with data at the place. With outer, a node whose side branch has no data may
    be stood in for by an older side branch with a carrier, the oldest first; two nodes never share one. `by` is the table the inputs
    come from: rows are dealt to a number of tasks that grows with it.
    """
    key = ["gene", "focal", "event"]
    deal = lambda df, *keys: df if by is None else dealt(df, *keys, by=by)
    fe = deal(enabler_nodes.select(*key).distinct(), "gene", "event")
    species = lambda df, c, d: df.select("gene", "event", "species", F.lit(c).alias("_c"), F.lit(d).alias("_d"))
    marks = deal(species(carriers, 1, 0).unionByName(species(aligned, 0, 1)), "gene", "event")
    j = fe.join(marks.groupBy("gene", "event", "species").agg(F.max("_c").alias("_c"), F.max("_d").alias("_d")), ["gene", "event"])
    j = j.join(branch_points(j.select("focal", "species"), tree).select("focal", "species", "ix"), ["focal", "species"])
    # nodes and the species on their side branches meet by aggregation: dealt by gene once, all steps stay there
    n = ["n_support", "n_against", "_n_data"]
    found = j.select(*key, "ix", F.lit(0).alias("_node"), F.col("_c").alias(n[0]), F.when(F.col("_c") == 0, F.col("_d")).otherwise(0).alias(n[1]), F.col("_d").alias(n[2]))
    nodes = enabler_nodes.select(*key, "ix", F.lit(1).alias("_node"), *[F.lit(0).alias(c) for c in n])
    per = deal(found.unionByName(nodes), "gene").groupBy(*key, "ix").agg(F.sum("_node").alias("_node"), *[F.sum(c).alias(c) for c in n])
    n_car = per.filter("n_support > 0").select(*key, "ix", "n_support")
    out = per.filter("_node > 0").groupBy("gene", "focal", "ix").agg(*[F.sum(F.col("_node") * F.col(c)).alias(c) for c in n])
    if not outer:
        return out.drop("_n_data")
    # side branches that may stand in, per node; each gene has two nodes, so the choice is a pair of distinct branches
    bare = out.filter("n_support = 0 and _n_data = 0").select("gene", "focal", "ix")
    cand = enabler_nodes.join(bare, ["gene", "focal", "ix"], "left_semi").join(n_car.withColumnRenamed("ix", "via"), key).filter("via > ix")
    own = out.filter("n_support > 0").select("gene", "focal", "ix", F.col("ix").alias("via"))
    choice = cand.select("gene", "focal", "ix", "via").unionByName(own).distinct()
    pair = choice.alias("a").join(choice.alias("b"), ["gene", "focal"]).filter("a.ix < b.ix and a.via <> b.via")
    pair = pair.groupBy("gene", "focal").agg(F.min(F.struct(
        (-F.col("b.via")).alias("bv"), (-F.col("a.via")).alias("av"), F.col("b.ix").alias("bi"), F.col("a.ix").alias("ai"))).alias("p"))
    via = pair.select("gene", "focal", F.explode(F.array(
        F.struct(F.col("p.ai").alias("ix"), (-F.col("p.av")).alias("via")), F.struct(F.col("p.bi").alias("ix"), (-F.col("p.bv")).alias("via")))).alias("v")).select("gene", "focal", "v.*")
    return out.drop("_n_data").join(via, ["gene", "focal", "ix"], "left")


def require_extant(types: DataFrame, support: DataFrame) -> DataFrame:
    """A DNG with an enabler node that no living species supports becomes a PDNG. support(gene, ix, n_support)."""
    lost = support.groupBy("gene").agg(F.min(F.col("n_support") > 0).alias("_ok"))
    j = types.join(lost, "gene", "left")
    keep = (F.col("gene_type") == "DNG") & F.coalesce("_ok", F.lit(False))
    return j.withColumn("gene_type", F.when(keep, "DNG").otherwise("PDNG")).drop("_ok")


def require_consecutive(types: DataFrame) -> DataFrame:
    """A DNG whose enabler nodes are not the parent and grandparent of its ORF node becomes a PDNG."""
    ok = (F.element_at("enabler_ixs", 2) == F.col("orf_ix") + 1) & (F.element_at("enabler_ixs", 1) == F.col("orf_ix") + 2)
    keep = (F.col("gene_type") == "DNG") & F.coalesce(ok, F.lit(False))
    return types.withColumn("gene_type", F.when(keep, "DNG").otherwise("PDNG"))


def older_orf(types: DataFrame, has_orf: DataFrame) -> DataFrame:
    """A DNG becomes a PDNG when a lineage ancestor older than its ORF node has the ORF. has_orf(gene, ix)."""
    h = has_orf.groupBy("gene").agg(F.max("ix").alias("_o"))
    j = types.join(h, "gene", "left")
    old = F.coalesce(F.col("_o") > F.col("orf_ix"), F.lit(False))
    return j.withColumn("gene_type", F.when((F.col("gene_type") == "DNG") & ~old, "DNG").otherwise("PDNG")).drop("_o")


def parsimony_filter(types: DataFrame, chosen: DataFrame, tips: DataFrame, tree: Tree, by: DataFrame | None = None) -> DataFrame:
    """A DNG is kept only if every chosen event is surely absent (state 0) at its ORF node.

    chosen(unit, gene, node) one row per chosen event with the ORF node, tips(unit, species, state). `by` is the table the inputs come
    from: rows are dealt to a number of tasks that grows with it.
    """
    deal = lambda df, *keys: df if by is None else dealt(df, *keys, by=by)
    st = parsimony_states(tips, tree, chosen, by)
    at = deal(chosen, "unit", "node").join(deal(st, "unit", "node"), ["unit", "node"], "left")
    ok = deal(at, "gene").groupBy("gene").agg(F.min(F.coalesce(F.col("can0") & ~F.col("can1"), F.lit(True))).alias("_ok"))
    j = deal(types, "gene").join(ok, "gene", "left")
    keep = (F.col("gene_type") == "DNG") & F.coalesce("_ok", F.lit(True))
    return j.withColumn("gene_type", F.when(keep, "DNG").otherwise("PDNG")).drop("_ok")


def tip_states_from_rows(chosen: DataFrame, carriers: DataFrame, aln: DataFrame, species: DataFrame, tree: Tree, rows: Column | None = None) -> DataFrame:
    """tips(unit, species, state) of chosen events, for parsimony_filter.

    chosen(unit, gene, focal, kind, pos, orf_ix); carriers(gene, kind, pos, taxon, length), living species and ancestors, stops with length 3;
    aln(gene, taxon, ref_text, row_text) against the focal row; species(species) the living ones. The event has the lengths that its
    youngest carrier on the lineage above the ORF node has; without one it is an error. Species: the focal one is 0, a
    carrier of such a length 1, one with known bases at the whole site 0; others are not listed, so they may be either.
    rows: where several taxa's rows follow from one of aln(gene, ref_text, ...), the array of (taxon, row_text); they are told apart only
    after the sites of the gene have met it, so no copy of a text travels.
    """
    c = chosen.join(carriers, ["gene", "kind", "pos"]).select("unit", "focal", "orf_ix", "taxon", "length")
    above = c.join(tree.lineage.withColumnRenamed("node", "taxon"), ["focal", "taxon"]).filter("ix > orf_ix")
    above = above.groupBy("unit", "ix").agg(F.collect_set("length").alias("lengths")).groupBy("unit").agg(F.min_by("lengths", "ix").alias("lengths"))
    none = F.raise_error(F.concat(F.lit("no carrier older than the ORF node for event "), F.col("unit").cast("string"))).cast("array<bigint>")
    u = chosen.join(above, "unit", "left").withColumn("lengths", F.coalesce(F.col("lengths").cast("array<bigint>"), none))
    has = c.join(u.select("unit", "lengths"), "unit").filter(F.array_contains("lengths", F.col("length").cast("bigint"))).select("unit", F.col("taxon").alias("species"))
    span = F.when(F.col("kind") == "stop", F.lit(3).cast("bigint")).otherwise(F.array_max("lengths"))
    sites = u.groupBy("gene").agg(F.collect_list(F.struct("unit", F.col("pos").cast("bigint").alias("pos"), span.alias("span"))).alias("sites"))
    x = aln.filter("ref_text is not null").join(sites, "gene")
    if rows is not None:
        x = x.select("ref_text", "sites", F.explode(rows).alias("_t")).select("ref_text", "sites", "_t.taxon", "_t.row_text")
    x = x.filter("row_text is not null").withColumnRenamed("taxon", "species")
    x = x.withColumn("known", sites_known("ref_text", "row_text", "sites")).select("species", F.explode(F.arrays_zip("sites", "known")).alias("s"))
    known = x.filter("s.known").select(F.col("s.sites.unit").alias("unit"), "species")
    state = lambda df, value, rank: df.join(species, "species", "left_semi").select("unit", "species", F.lit(value).alias("state"), F.lit(rank).alias("_r"))
    own = state(u.select("unit", F.col("focal").alias("species")), 0, 0)
    return own.unionByName(state(has, 1, 1)).unionByName(state(known, 0, 2)).groupBy("unit", "species").agg(F.min_by("state", "_r").alias("state"))


def orf_presence(calls: DataFrame, min_aligned: float = 50.0) -> DataFrame:
    """Presence by the ORF rule: 1, 0, or unknown where too little is aligned. calls(gene, taxon, has_orf, aligned_pct)."""
    call = F.when(F.col("has_orf"), "1").when(F.coalesce("aligned_pct", F.lit(0.0)) < min_aligned, "unknown").otherwise("0")
    return calls.withColumn("presence", call)


def orf_presence_from_rows(cells: DataFrame, aln: DataFrame, min_len: float, min_cov: float, min_frame: float = 0.0, min_aligned: float = 50.0,
                           count_stop: bool = False, measure: str = "contiguous") -> DataFrame:
    """Presence of every cell(gene, taxon, is_focal) read from the aligned rows(gene, taxon, ref_text, row_text).

    The focal cell is 1; without a row, or with too little aligned, a cell is unknown. Several rows of a cell: the ORF if any row has it.
    """
    x = aln.filter("ref_text is not null and row_text is not null").join(cells.filter("not is_focal").select("gene", "taxon").distinct(), ["gene", "taxon"], "left_semi")
    x = orf_call(x, "ref_text", "row_text", min_len, min_cov, min_frame, count_stop, measure).withColumn("v", reference_view("ref_text", "row_text"))
    pct = F.when(F.col("v.n") > 0, F.lit(100.0) * F.col("v.aligned") / F.col("v.n")).otherwise(0.0)
    calls = x.groupBy("gene", "taxon").agg(F.bool_or("has_orf").alias("has_orf"), F.max(pct).alias("aligned_pct"))
    j = cells.join(calls, ["gene", "taxon"], "left")
    return orf_presence(j.withColumn("has_orf", F.col("is_focal") | F.coalesce("has_orf", F.lit(False))), min_aligned).select("gene", "taxon", "presence")


def presence_comparison(calls: DataFrame, other: DataFrame) -> DataFrame:
    """Cells per pair of old and new call. other(gene, taxon, old)."""
    return calls.join(other, ["gene", "taxon"]).groupBy("old", "presence").agg(F.count("*").alias("cells"))


def gene_status(genes: DataFrame, reasons: Sequence[tuple[str, DataFrame]], counted: str = "counted") -> DataFrame:
    """One status per gene: the first reason table that lists it, else counted. Totals reconcile by construction."""
    out = genes.withColumn("status", F.lit(None).cast("string"))
    for label, df in reasons:
        r = df.select("gene").distinct().withColumn("_r", F.lit(label))
        out = out.join(r, "gene", "left").withColumn("status", F.coalesce("status", "_r")).drop("_r")
    return out.withColumn("status", F.coalesce("status", F.lit(counted)))
