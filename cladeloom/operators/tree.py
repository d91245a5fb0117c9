"""Questions over a rooted tree given as an edge table (node, parent).

The youngest lineage node of a species is its parent (ix 1); ix grows towards the root. Most placement rules reduce to the
common ancestor of a species set, which is what these operators compute.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import dealt, global_number
from ..session import cut_lineage


@dataclass(frozen=True)
class Tree:
    edges: DataFrame  # node, parent
    closure: DataFrame  # node, ancestor, dist (a node is its own ancestor at 0)
    depth: DataFrame  # node, depth (root 0)
    leaves: DataFrame  # node
    paths: DataFrame  # node, path (from the root down to the node), pre (place in preorder)

    @property
    def clade(self) -> DataFrame:
        """(node, species): the leaves below every node."""
        c = self.closure.join(self.leaves, "node", "left_semi")
        return c.select(F.col("ancestor").alias("node"), F.col("node").alias("species"))

    @property
    def lineage(self) -> DataFrame:
        """(focal, node, ix) for every leaf."""
        c = self.closure.join(self.leaves, "node", "left_semi").filter("dist > 0")
        return c.select(F.col("node").alias("focal"), F.col("ancestor").alias("node"), F.col("dist").alias("ix"))


def closure(edges: DataFrame) -> DataFrame:
    """Every (node, ancestor, dist). Paths double in each round, so a tree of depth d takes about log2(d) rounds.

    On a cycle of m nodes the jumps go on for ever; once they are longer than there are nodes, one exists.
    """
    e = edges.filter("parent is not null").select("node", "parent")
    nodes = e.select("node").union(e.select(F.col("parent").alias("node"))).distinct()
    known = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("bigint").alias("dist"))
    jump = cut_lineage(e.select("node", F.col("parent").alias("ancestor")))
    k, n_nodes = 0, nodes.count()
    while not jump.isEmpty():
        if 2**k > n_nodes:
            raise ValueError("the edge table holds a cycle")
        far = jump.select("node", F.col("ancestor").alias("mid")).join(
            known.select(F.col("node").alias("mid"), "ancestor", (F.col("dist") + 2**k).alias("dist")), "mid"
        )
        known = known.unionByName(far.drop("mid"))
        jump = cut_lineage(
            jump.select("node", F.col("ancestor").alias("mid"))
            .join(jump.select(F.col("node").alias("mid"), "ancestor"), "mid").drop("mid")
        )
        k += 1
    return cut_lineage(known)


def tree_tables(edges: DataFrame) -> Tree:
    """Closure, depth and leaves, after checking for one root and one parent per node."""
    e = edges.filter("parent is not null").select("node", "parent").distinct()
    many = e.groupBy("node").count().filter("count > 1")
    if not many.isEmpty():
        raise ValueError("a node has two parents")
    roots = e.select(F.col("parent").alias("node")).distinct().join(e.select("node"), "node", "left_anti")
    if roots.limit(2).count() != 1:
        raise ValueError("the tree must have exactly one root")
    c = closure(e)
    depth = cut_lineage(c.groupBy("node").agg(F.max("dist").alias("depth")))
    inner = c.filter("dist = 1").select(F.col("ancestor").alias("node"))
    leaves = cut_lineage(depth.select("node").join(inner, "node", "left_anti"))
    parents = c.filter("dist = 1").select("node", F.col("ancestor").alias("parent"))
    steps = c.join(depth.select(F.col("node").alias("ancestor"), "depth"), "ancestor")
    path = F.transform(F.array_sort(F.collect_list(F.struct("depth", "ancestor"))), lambda s: s["ancestor"])
    paths = cut_lineage(global_number(steps.groupBy("node").agg(path.alias("path")), [F.col("path")], "pre"))
    return Tree(parents, c, depth, leaves, paths)


def node_types(tree: Tree) -> DataFrame:
    """Every node with its parent, depth and kind (living / ancestor)."""
    leaf = tree.leaves.withColumn("_leaf", F.lit(True))
    kind = F.when(F.col("_leaf"), "living").otherwise("ancestor")
    return tree.depth.join(tree.edges, "node", "left").join(leaf, "node", "left").select("node", "parent", "depth", kind.alias("kind"))


def _shared_path(a: Column | str, b: Column | str) -> Column:
    """Number of nodes that two paths from the root have in common."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda same: same))


def lca(sets: DataFrame, tree: Tree, key: str, node: str = "node") -> DataFrame:
    """Deepest common ancestor of each node set.

    In preorder everything below a node is one stretch, so the ancestor of a set is that of its first and last member, which
    combine before the shuffle.
    """
    pre = tree.paths.select(F.col("node").alias("_n"), "pre")
    s = sets.select(key, F.col(node).alias("_n")).join(pre, "_n")
    ends = s.groupBy(key).agg(F.min("pre").alias("_lo"), F.max("pre").alias("_hi"))
    pairs = ends.select("_lo", "_hi").distinct()
    at = lambda e: tree.paths.select(F.col("pre").alias(e), F.col("path").alias("_p" + e))
    top = pairs.join(at("_lo"), "_lo").join(at("_hi"), "_hi")
    top = top.select("_lo", "_hi", F.element_at("_p_lo", _shared_path("_p_lo", "_p_hi")).alias("lca"))
    return ends.join(top, ["_lo", "_hi"]).select(key, "lca")


def branch_points(pairs: DataFrame, tree: Tree) -> DataFrame:
    """(focal, species, node, ix) for the given pairs of leaves only: the lineage node of the focal species at which the other one
    branches off. Pairs of a leaf with itself, or with an unknown one, drop out."""
    at = lambda c: tree.paths.select(F.col("node").alias(c), F.col("path").alias("_" + c))
    p = pairs.select("focal", "species").distinct().filter("focal <> species").join(at("focal"), "focal").join(at("species"), "species")
    k = _shared_path("_focal", "_species")
    return p.select("focal", "species", F.element_at("_focal", k).alias("node"), (F.size("_focal") - k).cast("bigint").alias("ix"))


def branching(rows: DataFrame, tree: Tree) -> DataFrame:
    """rows(focal, species, ..) of two different leaves with the lineage node and its ix (node, _ix) at which the species branches off.

    Worked out on each row from the two paths, one of every node of the tree, so rows stay where they are: dealt by pairs of leaves,
    of which there are few, they would not spread.
    """
    at = lambda c: F.broadcast(tree.paths.select(F.col("node").alias(c), F.col("path").alias("_" + c)))
    p = rows.filter("focal <> species").join(at("focal"), "focal").join(at("species"), "species")
    k = _shared_path("_focal", "_species")
    return p.select(*rows.columns, F.element_at("_focal", k).alias("node"), (F.size("_focal") - k).cast("bigint").alias("_ix"))


def side_branches(tree: Tree) -> DataFrame:
    """The side branch at every branch of the tree: the leaves below node that are not below its child.

    With the leaves numbered in preorder a clade is one range, so a side branch is a range less an inner one:
    (node, child, lo, hi, skip_lo, skip_hi, n_species), one row a branch. A focal species below child has this side branch at
    node on its lineage, whichever species it is, so nothing is listed per pair of leaves.
    """
    rank = global_number(tree.leaves.join(tree.paths.select("node", "pre"), "node"), [F.col("pre")], "rank").select("node", "rank")
    span = cut_lineage(tree.closure.join(rank, "node").groupBy("ancestor").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi")))
    whole = span.withColumnRenamed("ancestor", "parent")
    inner = span.select(F.col("ancestor").alias("node"), F.col("lo").alias("skip_lo"), F.col("hi").alias("skip_hi"))
    n = (F.col("hi") - F.col("lo")) - (F.col("skip_hi") - F.col("skip_lo"))
    return tree.edges.join(whole, "parent").join(inner, "node").select(F.col("parent").alias("node"), F.col("node").alias("child"), "lo", "hi", "skip_lo", "skip_hi", n.alias("n_species"))


def side_branch_counts(lines: DataFrame, tree: Tree) -> DataFrame:
    """Lines of the species on every side branch: those of the clade less those of the child. lines(species), one row a line."""
    per = lines.groupBy(F.col("species").alias("node")).agg(F.count("*").alias("n"))
    clade = cut_lineage(tree.closure.join(per, "node").groupBy("ancestor").agg(F.sum("n").alias("n")))
    at = lambda c, n: clade.select(F.col("ancestor").alias(c), F.col("n").alias(n))
    x = side_branches(tree).select("node", "child", "n_species").join(at("node", "_all"), "node", "left").join(at("child", "_in"), "child", "left")
    return x.select("node", "child", "n_species", (F.coalesce("_all", F.lit(0)) - F.coalesce("_in", F.lit(0))).alias("n_lines"))


def place_on_lineage(presence: DataFrame, tree: Tree, need_focal: bool = False) -> DataFrame:
    """Youngest lineage node of the focal species that holds all positive species.

    presence(gene, focal, species) lists positives. NULL focal presence matters only with need_focal. A gene positive
    in its focal species alone gets the node NULL and ix 0 (specific). Genes without a positive are not listed.
    """
    bins = branch_points(presence, tree)
    j = presence.join(bins, ["focal", "species"], "left")
    g = j.groupBy("gene", "focal").agg(
        F.max_by("node", F.coalesce("ix", F.lit(0))).alias("node"),
        F.max(F.coalesce("ix", F.lit(0))).alias("ix"),
        F.max(F.col("species") == F.col("focal")).alias("_own"),
    )
    return (g.filter("_own") if need_focal else g).drop("_own")


def oldest_node(has: DataFrame, tree: Tree, contiguous: bool = False) -> DataFrame:
    """Oldest lineage ancestor with a property; contiguous = oldest of the unbroken run above the focal species.

    has(gene, focal, node) lists ancestors with the property. Genes with none (or, if contiguous, whose youngest
    ancestor lacks it) are not listed: they are specific to the focal species.
    """
    h = has.distinct().join(tree.lineage, ["focal", "node"])
    if contiguous:
        # one row per lineage node at most, so the window is bounded by the tree depth
        w = Window.partitionBy("gene", "focal").orderBy("ix")
        h = h.withColumn("_rn", F.row_number().over(w)).filter("ix = _rn").drop("_rn")
    return h.groupBy("gene", "focal").agg(F.max_by("node", "ix").alias("node"), F.max("ix").alias("ix"))


def bin_counts(presence: DataFrame, tree: Tree) -> DataFrame:
    """Positive species newly added at each lineage node, per gene and node."""
    bins = branch_points(presence, tree)
    j = presence.select("gene", "focal", "species").distinct().join(bins, ["focal", "species"])
    return j.groupBy("gene", "focal", "node", "ix").agg(F.count("*").alias("n_species"))


def oldest_shared_bin(presence: DataFrame, tree: Tree) -> DataFrame:
    """Oldest lineage node with newly added positives, when at least two nodes have some; else NULL."""
    g = bin_counts(presence, tree).groupBy("gene", "focal").agg(
        F.count("*").alias("n_bins"), F.max_by("node", "ix").alias("_o")
    )
    return g.withColumn("node", F.when(F.col("n_bins") >= 2, F.col("_o"))).drop("_o")


def phylostratum(groups: DataFrame, tree: Tree) -> DataFrame:
    """Oldest node at which a group is shared with a sister clade, per (group, species).

    Walking up from any species of a group, that node is the common ancestor of all its species; a group of one species
    is `species_specific_clustered` (node NULL). groups(group, species).
    """
    gs = groups.select("group", "species").distinct()
    n = gs.groupBy("group").agg(F.count("*").alias("n_species"))
    node = lca(gs.withColumnRenamed("species", "node"), tree, "group")
    shared = F.when(F.col("n_species") > 1, F.col("lca"))
    return gs.join(n, "group").join(node, "group").select("group", "species", "n_species", shared.alias("node"))


def gene_strata(members: DataFrame, proteins: DataFrame, tree: Tree) -> DataFrame:
    """Stratum of every gene, one row per (species, gene, group).

    members(group, species, gene), proteins(species, gene). The stratum is the oldest node at which the group is shared,
    `species_specific_clustered` for a group of one species, and `species_specific_unclustered` (no group) for a protein that no
    such group holds. Species outside the tree are left out; a group shared only with those has no stratum in the tree.
    """
    m = members.select("group", "species", "gene").distinct()
    at = phylostratum(m, tree).filter("node is null or node <> species")
    known = m.join(at.select("group", "species", "node"), ["group", "species"])
    # a group of one species outside the tree also has no node
    known = known.join(tree.leaves.select(F.col("node").alias("species")), "species", "left_semi")
    placed = known.select("species", "gene", F.coalesce(F.col("node").cast("string"), F.lit("species_specific_clustered")).alias("stratum"), "group")
    rest = proteins.select("species", "gene").distinct().join(tree.leaves.select(F.col("node").alias("species")), "species", "left_semi")
    rest = rest.join(placed.select("species", "gene"), ["species", "gene"], "left_anti")
    none = rest.select("species", "gene", F.lit("species_specific_unclustered").alias("stratum"), F.lit(None).cast(m.schema["group"].dataType).alias("group"))
    return placed.unionByName(none)


def stratum_counts(strata: DataFrame) -> DataFrame:
    """Groups and genes per species and stratum; unclustered genes have no number of groups."""
    g = strata.groupBy("species", "stratum").agg(F.countDistinct("group").alias("n"), F.countDistinct("gene").alias("n_genes"))
    return g.select("species", "stratum", F.when(F.col("stratum") != "species_specific_unclustered", F.col("n")).alias("n_groups"), "n_genes")


def assign_tiers(species: DataFrame, tree: Tree, clade: Column, ladder: DataFrame) -> DataFrame:
    """INSIDE_CLADE, or the nearest ladder ancestor holding the species, or outside.

    species(name, node); ladder(node, rung) lists ancestors of the clade, nearest first.
    """
    up = species.join(tree.closure, "node")
    inside = up.groupBy("name").agg(F.max(F.col("ancestor") == clade).alias("inside"))
    near = up.join(ladder.select(F.col("node").alias("ancestor"), "rung"), "ancestor").groupBy("name").agg(
        F.min_by("ancestor", "rung").alias("_t"), F.min("rung").alias("rung")
    )
    tier = F.when(F.col("inside"), "INSIDE_CLADE").otherwise(F.coalesce(F.col("_t").cast("string"), F.lit("outside")))
    out = species.join(inside, "name", "left").join(near, "name", "left")
    return out.select("name", tier.alias("tier"), F.when(~F.col("inside"), F.col("rung")).alias("rung"))


def resolve_names(names: DataFrame, taxonomy: DataFrame, levels: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """Taxon of each name at the first level with any candidate; several candidates at that level stay unresolved.

    levels: (label, key of a name, key of a taxonomy name), in order; taxonomy(taxid, tax_name, rank), names(name). At level
    `genus` only taxa of that rank are candidates; at level `species` those of that rank come before others.
    """
    out = None
    for i, (label, nk, tk) in enumerate(levels):
        own = F.col("rank") == label
        rows = taxonomy.filter(own) if label == "genus" else taxonomy
        first = F.when(own, F.col("taxid")) if label == "species" else F.lit(None).cast(taxonomy.schema["taxid"].dataType)
        keys = rows.select(tk.alias("_k"), "taxid", first.alias("_first")).filter("_k <> ''").groupBy("_k").agg(
            F.when(F.count("_first") > 0, F.countDistinct("_first")).otherwise(F.countDistinct("taxid")).alias("n"),
            F.coalesce(F.min("_first"), F.min("taxid")).alias("taxid"),
        )
        m = names.select("name", nk.alias("_k")).join(keys, "_k").select(
            "name", F.struct(F.lit(i).alias("i"), F.lit(label).alias("level"), "n", "taxid").alias("m")
        )
        out = m if out is None else out.unionByName(m)
    best = out.groupBy("name").agg(F.min("m").alias("m"))
    j = names.join(best, "name", "left")
    return j.select(
        "name", F.when(F.col("m.n") == 1, F.col("m.taxid")).alias("taxid"),
        F.when(F.col("m").isNull(), "UNMATCHED").when(F.col("m.n") > 1, "AMBIGUOUS").otherwise(F.col("m.level")).alias("level"),
    )


def root_distance(lengths: DataFrame, tree: Tree) -> DataFrame:
    """Summed branch length from the root; lengths(node, length) is the branch above each node."""
    l = lengths.select(F.col("node").alias("ancestor"), "length")
    d = tree.closure.join(l, "ancestor", "left")
    return d.groupBy("node").agg(F.sum(F.coalesce("length", F.lit(0.0))).alias("height"))


def farthest(present: DataFrame, lengths: DataFrame, tree: Tree) -> DataFrame:
    """Per locus the present species farthest from its reference by branch length (ties: smallest species).

    present(locus, ref, species).
    """
    h = root_distance(lengths, tree)
    bins = branch_points(present.select(F.col("ref").alias("focal"), "species"), tree)
    hs = lambda c: h.select(F.col("node").alias(c), F.col("height").alias("_h_" + c))
    b = bins.select(F.col("focal").alias("ref"), "species", F.col("node").alias("_mrca"))
    j = present.join(b, ["ref", "species"]).join(hs("ref"), "ref").join(hs("species"), "species").join(hs("_mrca"), "_mrca")
    dist = F.round(F.col("_h_ref") + F.col("_h_species") - 2 * F.col("_h__mrca"), 6)
    j = j.withColumn("distance", dist)
    best = F.min(F.struct((-F.col("distance")).alias("d"), "species"))
    return j.groupBy("locus", "ref").agg(best.alias("b")).select("locus", "ref", "b.species", (-F.col("b.d")).alias("distance"))


def dollo_losses(units: DataFrame, presence: DataFrame, tree: Tree, unknown: DataFrame | None = None) -> DataFrame:
    """Branches on which a unit was lost, given one origin and presence at the leaves.

    units(unit, origin); presence(unit, species); unknown(unit, species) lists leaves of unknown state. A node carries
    the unit when a descendant leaf does; a loss lies on a branch whose upper node carries and whose lower node does
    not. An unknown leaf takes the state that costs least, so a branch with nothing but unknown leaves below it is no
    loss, and every other loss stays where it was.
    """
    below = tree.closure.select(F.col("node").alias("_x"), F.col("ancestor").alias("origin"))
    up = tree.closure.select(F.col("node").alias("species"), F.col("ancestor").alias("node"))
    origin = units.select("unit", "origin", F.col("origin").alias("node"))
    c = presence.select("unit", "species").distinct().join(up, "species").select("unit", "node").distinct()
    inside = below.select(F.col("_x").alias("node"), "origin")
    carriers = c.join(units, "unit").join(inside, ["origin", "node"]).select("unit", "origin", "node")
    carriers = carriers.unionByName(origin.select("unit", "origin", "node")).distinct()
    kids = tree.edges.select(F.col("parent").alias("node"), F.col("node").alias("branch"))
    down = carriers.join(kids, "node").select("unit", "origin", "branch")
    lost = down.join(carriers.select("unit", "origin", F.col("node").alias("branch")), ["unit", "origin", "branch"], "left_anti")
    if unknown is None:
        return lost
    size = tree.clade.groupBy(F.col("node").alias("branch")).agg(F.count("*").alias("_leaves"))
    u = unknown.select("unit", "species").distinct().join(presence.select("unit", "species"), ["unit", "species"], "left_anti")
    u = u.join(up, "species").groupBy("unit", F.col("node").alias("branch")).agg(F.count("*").alias("_unknown"))
    j = lost.join(u, ["unit", "branch"], "left").join(size, "branch")
    return j.filter(F.coalesce("_unknown", F.lit(0)) < F.col("_leaves")).select("unit", "origin", "branch")


def parsimony_states(tips: DataFrame, tree: Tree, asked: DataFrame | None = None, by: DataFrame | None = None) -> DataFrame:
    """States (0, 1) over all most parsimonious assignments with unit cost: (unit, node, can0, can1).

    tips(unit, species, state) with state 0 or 1; a leaf that is not listed may be either. asked(unit, node) are the nodes wanted;
    by default those at or above a listed leaf. Costs are summed level by level from the deepest nodes to the root, then the
    cost of all else is passed down to the nodes asked for and those above them. A node without a listed leaf below costs
    nothing, so it has no row on the way up. `by` is the table the inputs come from: every step is dealt by unit to a number of tasks
    that grows with it, once for each table that meets there. The tree's own tables are as large as the tree, whatever the number of units.
    """
    # a join stays where its rows are only if both sides are dealt by all its keys
    deal = lambda df, *keys: df if by is None else dealt(df, *(keys or ("unit", "node")), by=by)
    far = F.lit(1 << 40).cast("bigint")
    place = F.broadcast(tree.depth.join(tree.edges, "node", "left").select("node", "parent", "depth"))
    height = place.agg(F.max("depth")).first()[0]
    cost = lambda s: F.when(F.max("state") == s, F.lit(0)).otherwise(far).cast("bigint").alias(f"c{s}")
    leaf = deal(tips, "unit").groupBy("unit", F.col("species").alias("node")).agg(cost(0), cost(1)).join(place, "node")
    best = lambda x, y: F.least(F.col(x), F.col(y) + 1)
    down: list[DataFrame] = []
    for level in range(height, -1, -1):
        own = leaf.filter(F.col("depth") == level).select("unit", "node", "c0", "c1")
        if down:
            kids = down[-1].join(F.broadcast(place.select("node", "parent")), "node").select("unit", F.col("parent").alias("node"), best("c0", "c1").alias("c0"), best("c1", "c0").alias("c1"))
            own = own.unionByName(kids)
        down.append(cut_lineage(deal(own).groupBy("unit", "node").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))))
    down.reverse()
    if asked is None:
        asked = tips.select("unit", F.col("species").alias("node"))
    above = F.broadcast(tree.closure.select("node", "ancestor"))
    want = cut_lineage(deal(asked.select("unit", "node"), "unit").distinct().join(above, "node").select("unit", F.col("ancestor").alias("node")).distinct().join(place, "node"))
    root = down[0].select("unit", F.least("c0", "c1").alias("least"))
    up = down[0].withColumns({"u0": F.lit(0).cast("bigint"), "u1": F.lit(0).cast("bigint")})
    rows = [up]
    for level in range(1, height + 1):
        x = deal(want.filter(F.col("depth") == level).select("unit", "node", "parent")).join(deal(down[level]), ["unit", "node"], "left").na.fill(0, ["c0", "c1"])
        p = up.select("unit", F.col("node").alias("parent"), (F.col("u0") + F.col("c0")).alias("p0"), (F.col("u1") + F.col("c1")).alias("p1"))
        x = deal(x, "unit", "parent").join(deal(p, "unit", "parent"), ["unit", "parent"]).withColumns({"r0": F.col("p0") - best("c0", "c1"), "r1": F.col("p1") - best("c1", "c0")})
        up = cut_lineage(x.select("unit", "node", "c0", "c1", best("r0", "r1").alias("u0"), best("r1", "r0").alias("u1")))
        rows.append(up)
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    wanted = want.select("unit", "node")
    is_least = lambda i: (F.col(f"u{i}") + F.col(f"c{i}") == F.col("least")).alias(f"can{i}")
    out = deal(out).join(deal(wanted), ["unit", "node"], "left_semi")
    return deal(out, "unit").join(deal(root, "unit"), "unit").select("unit", "node", is_least(0), is_least(1))
