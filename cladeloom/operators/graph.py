"""Connected components and the loci, families and origins built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import global_number, number_within
from ..session import cut_lineage
from .tree import Tree


# fixed bound: in how many tasks the edges of one vertex may meet its minimum
SLOTS = 256


def with_minimum(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The smallest neighbour m of every u of edges(u, v), and the edges with it.

    The edges of a vertex are dealt to slots by their other end; minima are taken per slot, then over the slots of a vertex, and go
    back to the edges by slot. So no task meets all edges of a hub, whether or not the joins adapt to skew.
    """
    e = edges.withColumn("_s", F.pmod(F.hash("v"), F.lit(SLOTS)))
    part = e.groupBy("u", "_s").agg(F.min("v").alias("m"))
    low = part.groupBy("u").agg(F.min("m").alias("m"))
    return low, e.join(part.select("u", "_s").join(low, "u"), ["u", "_s"]).drop("_s")


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): component is the smallest id reachable over edges(src, dst).

    Alternates the large-star and small-star steps of Kiveris et al. (2014): each point links its larger, then its
    smaller neighbours to the smallest neighbour. Minima are taken and joined back in two steps (with_minimum), so the
    edges of a hub are never gathered in one task. Each round is written to the shared folder; the last is the one that
    changes no edge.
    """
    e = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).filter("u <> v")
    e = cut_lineage(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_minimum(both)[1].filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.filter("u <> v").distinct()
        low, j = with_minimum(large)
        small = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        old, e = e, cut_lineage(small.filter("u <> v").distinct())
        both = old.select("u", "v", F.lit(1).alias("was"), F.lit(0).alias("is")).unionByName(e.select("u", "v", F.lit(0).alias("was"), F.lit(1).alias("is")))
        if both.groupBy("u", "v").agg(F.sum("was").alias("was"), F.sum("is").alias("is")).filter(F.col("was") != F.col("is")).isEmpty():
            break
    label = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return vertices.select("id").distinct().join(label, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def build_loci(members: DataFrame, components: DataFrame, rank: DataFrame) -> DataFrame:
    """One record per component: oldest node of its members, DNG if any member is, numbered by (node rank, first gene).

    members(id, node, gene_type, gene); rank(node, rank) with the oldest node first.
    """
    m = members.join(components, "id").join(rank, "node", "left")
    r = F.struct(F.col("rank").isNull().alias("unknown"), "rank")
    g = m.groupBy("component").agg(
        F.min_by("node", F.struct(r, "gene")).alias("node"), F.min(r).alias("_r"),
        F.when(F.max(F.col("gene_type") == "DNG"), "DNG").otherwise("PDNG").alias("gene_type"),
        F.min("gene").alias("first_gene"), F.count("*").alias("n_members"),
    )
    return global_number(g, [F.col("_r"), F.col("first_gene"), F.col("component")], "locus").drop("_r")


def families(seqs: DataFrame, hits: DataFrame) -> DataFrame:
    """Families of similar sequences per species: (species, id, length) plus family, size and representative.

    The representative is the longest member, then the smallest id; families are numbered per species by size.
    """
    known = seqs.select(F.col("id"), F.col("species"))
    e = hits.filter("query <> subject")
    e = e.join(known.select(F.col("id").alias("query"), "species"), "query").join(
        known.select(F.col("id").alias("subject"), F.col("species").alias("_s2")), "subject"
    ).filter("species = _s2")
    comp = connected_components(seqs.select("id"), e.select(F.col("query").alias("src"), F.col("subject").alias("dst")))
    m = seqs.join(comp, "id")
    size = m.groupBy("species", "component").agg(
        F.count("*").alias("family_size"), F.min(F.struct((-F.col("length")).alias("l"), "id")).alias("_rep"), F.min("id").alias("_first")
    )
    fam = number_within(size, ["species"], [F.col("family_size").desc(), F.col("_first").asc()], "family_no")
    j = m.join(fam, ["species", "component"])
    return j.select("species", "id", "family_no", "family_size", (F.col("id") == F.col("_rep.id")).alias("is_representative"), "length")


def family_summary(fam: DataFrame) -> DataFrame:
    one = fam.groupBy("species", "family_no").agg(F.max("family_size").alias("n"))
    g = one.groupBy("species").agg(
        F.sum("n").cast("bigint").alias("total"), F.count("*").alias("families"), F.count_if(F.col("n") == 1).alias("singletons"),
        F.count_if(F.col("n") > 1).alias("multi_families"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).cast("bigint").alias("in_multi"),
    )
    g = g.withColumn("redundant", F.col("in_multi") - F.col("multi_families"))
    return g.withColumn("pct_redundant", F.round(F.lit(100.0) * F.col("redundant") / F.col("total"), 1))


def mode_first(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Most frequent value per key; on ties the one seen first in `order`."""
    c = df.groupBy(key, value).agg(F.count("*").alias("_n"), F.min(order).alias("_o"))
    return c.groupBy(key).agg(F.min_by(value, F.struct((-F.col("_n")).alias("n"), "_o", value)).alias(value))


def origin_units(loci: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """Loci with the unit they belong to, and whether they are kept.

    loci(locus, gene_type, node); members(locus, species, gene, seq) with a listing order seq; groups(species, gene,
    group). The unit is the most frequent group of the members, else SINGLETON_<locus>. A PDNG locus is dropped when
    every species of it also has a DNG of the unit.
    """
    g = members.join(groups, ["species", "gene"])
    hog = mode_first(g, "locus", "group", "seq")
    unit = F.coalesce(F.col("group").cast("string"), F.concat(F.lit("SINGLETON_"), F.col("locus").cast("string")))
    l = loci.join(hog, "locus", "left").withColumn("unit", unit).drop("group")
    sp = members.select("locus", "species").distinct().join(l.select("locus", "unit", "gene_type"), "locus")
    dng = sp.filter("gene_type = 'DNG'").select("unit", "species").distinct().withColumn("_d", F.lit(True))
    pd_ = sp.filter("gene_type = 'PDNG'").join(dng, ["unit", "species"], "left")
    alone = pd_.groupBy("locus").agg(F.max(F.col("_d").isNull()).alias("_alone"))
    return l.join(alone, "locus", "left").withColumn("kept", F.coalesce("_alone", F.lit(True))).drop("_alone")


def split_lineages(units: DataFrame, tree: Tree, merge: bool = False) -> DataFrame:
    """Origins of each (unit, gene_type): the birth branch each locus belongs to, numbered from 1 within its unit.

    units(unit, gene_type, locus, branch). Going from the oldest branch, a locus joins the first origin whose clade
    holds its branch, else it starts a new one; that origin is the shallowest listed branch above or at its own.
    merge=True keeps one origin per unit.
    """
    key = ["unit", "gene_type"]
    d = tree.depth.select(F.col("node").alias("branch"), "depth")
    u = units.join(d, "branch")
    listed = u.groupBy(*key, "branch", "depth").agg(F.min("locus").alias("_first"))
    first = listed.groupBy(*key).agg(F.min_by("branch", F.struct("depth", "_first")).alias("origin"))
    if merge:
        o = listed.select(*key, "branch").join(first, key)
    else:
        up = tree.closure.select(F.col("node").alias("branch"), F.col("ancestor").alias("origin"))
        cand = listed.select(*key, F.col("branch").alias("origin"), "depth")
        j = listed.select(*key, "branch").join(up, "branch").join(cand, [*key, "origin"])
        o = j.groupBy(*key, "branch").agg(F.min_by("origin", "depth").alias("origin"))
    out = u.join(o, [*key, "branch"])
    starts = out.filter("branch = origin").groupBy(*key, "origin", "depth").agg(F.min("locus").alias("_f"))
    no = number_within(starts, key, [F.col("depth").asc(), F.col("_f").asc(), F.col("origin").asc()], "origin_no")
    out = out.join(no.select(*key, "origin", "origin_no"), [*key, "origin"])
    n = F.col("origin_no")
    label = F.concat(F.col("unit"), F.when(n > 1, F.concat(F.lit("#"), n.cast("string"))).otherwise(F.lit("")))
    return out.select(*key, "locus", "branch", "origin", "origin_no", label.alias("label"))


def branch_rates(branches: DataFrame, births: DataFrame, deaths: DataFrame) -> DataFrame:
    """Births and deaths per branch and gene type, and per unit of branch length; NULL where the length is missing or 0.

    branches(branch, length); births and deaths are (branch, gene_type), one row per event.
    """
    def per(df: DataFrame, what: str) -> DataFrame:
        return df.groupBy("branch").agg(*[F.count_if(F.col("gene_type") == t).alias(f"{t}_{what}") for t in ("DNG", "PDNG")])

    j = branches.join(per(births, "births"), "branch", "left").join(per(deaths, "deaths"), "branch", "left")
    names = [f"{t}_{w}" for w in ("births", "deaths") for t in ("DNG", "PDNG")]
    j = j.withColumns({n: F.coalesce(n, F.lit(0)).cast("bigint") for n in names})
    j = j.withColumns({f"TDNG_{w}": F.col(f"DNG_{w}") + F.col(f"PDNG_{w}") for w in ("births", "deaths")})
    rate = lambda n: F.when(F.col("length") != 0, F.round(F.col(n) / F.col("length"), 3))
    every = [*names, "TDNG_births", "TDNG_deaths"]
    return j.withColumns({n[:-1] + "_rate": rate(n) for n in every})


def lengths_from_ages(ages: DataFrame, tree: Tree) -> DataFrame:
    """Branch length = parent age - node age; a negative length is an error row with a NULL length."""
    a = ages.select("node", "age")
    p = ages.select(F.col("node").alias("parent"), F.col("age").alias("_p"))
    x = F.col("_p") - F.coalesce("age", F.lit(0.0))
    j = tree.edges.join(a, "node", "left").join(p, "parent")
    return j.select(F.col("node").alias("branch"), F.when(x >= 0, x).alias("length"), (x < 0).alias("is_error"))


