"""Tree questions: nations are the leaves of a binary tree (leaf 32 + key, parent of i is i div 2, root 1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import taxon_key
from ..operators import graph as G
from ..operators import tree as H
from .registry import query, table

TREE = """node_t AS (SELECT DISTINCT (32 + n_nationkey) >> k AS node FROM nation, range(0, 6) r(k)),
 clo AS (SELECT node, node >> d AS ancestor, d AS dist FROM node_t, range(0, 6) r(d) WHERE (node >> d) >= 1),
 leaf AS (SELECT 32 + n_nationkey AS node FROM nation)"""

GRP = """grp AS (SELECT DISTINCT l_orderkey AS "group", 32 + s_nationkey AS species FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""

LCA = f"""{TREE}, {GRP}, gn AS (SELECT "group", count(*) AS n FROM grp GROUP BY 1),
 up AS (SELECT "group", ancestor, count(*) AS c FROM grp JOIN clo ON species = node GROUP BY ALL),
 lca AS (SELECT up."group", max(ancestor) AS lca, any_value(n) AS n FROM up JOIN gn ON up."group" = gn."group" AND c = n GROUP BY 1)"""

PRES = """pres AS (SELECT DISTINCT o_orderkey AS gene, 32 + c_nationkey AS focal, 32 + s_nationkey AS species FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN orders ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey)"""
# lineage index at which a species leaves the focal lineage: the number of shifts until both agree
IX = "(SELECT min(k) FROM range(0, 6) r(k) WHERE (focal >> k) = (species >> k))"


def nation_tree(spark, sf):
    n = table(spark, sf, "nation").select((F.col("n_nationkey") + 32).cast("bigint").alias("leaf"))
    up = n.select("leaf", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    node = F.floor(F.col("leaf") / F.pow(F.lit(2), F.col("k"))).cast("bigint")
    e = up.select(node.alias("node")).distinct()
    return H.tree_tables(e.select("node", F.when(F.col("node") > 1, F.floor(F.col("node") / 2).cast("bigint")).alias("parent")))


def leaf(c: str):
    return (F.col(c) + 32).cast("bigint")


def lines(spark, sf):
    return table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))


def groups(spark, sf):
    return lines(spark, sf).select(F.col("l_orderkey").alias("group"), leaf("s_nationkey").alias("species"))


def presence(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return lines(spark, sf).join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("gene"), leaf("c_nationkey").alias("focal"), leaf("s_nationkey").alias("species"))


@query(
    "tree_usage",
    f"""WITH {TREE}, {GRP} SELECT c.ancestor AS node, CASE WHEN c.ancestor > 1 THEN c.ancestor >> 1 END AS parent,
    CAST(floor(log2(c.ancestor)) AS BIGINT) AS depth, CASE WHEN c.ancestor IN (SELECT node FROM leaf) THEN 'living' ELSE 'ancestor' END AS kind,
    count("group") AS n_groups FROM clo c LEFT JOIN grp ON species = c.node GROUP BY ALL""",
)
def tree_usage(spark, sf):
    t = nation_tree(spark, sf)
    g = groups(spark, sf).distinct().join(t.closure.withColumnRenamed("node", "species"), "species")
    n = g.groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("n_groups"))
    return H.node_types(t).join(n, "node", "left").withColumn("n_groups", F.coalesce("n_groups", F.lit(0)))


@query("common_ancestor", f'WITH {LCA} SELECT "group", lca FROM lca')
def common_ancestor(spark, sf):
    return H.lca(groups(spark, sf).withColumnRenamed("species", "node"), nation_tree(spark, sf), "group")


@query(
    "phylostratum",
    f'WITH {LCA} SELECT grp."group", species, n AS n_species, CASE WHEN n > 1 THEN lca END AS node FROM grp JOIN lca ON grp."group" = lca."group"',
)
def phylostratum(spark, sf):
    return H.phylostratum(groups(spark, sf), nation_tree(spark, sf))


@query(
    "side_branch_lines",
    f"""WITH {PRES}, b AS (SELECT *, {IX} AS ix FROM pres WHERE focal <> species)
    SELECT focal, focal >> ix AS node, ix, count(*) AS n_lines FROM b GROUP BY ALL""",
)
def side_branch_lines(spark, sf):
    p = presence(spark, sf).distinct()
    # the branching point of the pairs that occur, never of all pairs of leaves
    return p.join(H.branch_points(p, nation_tree(spark, sf)), ["focal", "species"]).groupBy("focal", "node", "ix").agg(F.count("*").alias("n_lines"))


@query(
    "side_branch_counts",
    f"""WITH {TREE}, br AS (SELECT node >> 1 AS node, node AS child FROM node_t WHERE node > 1),
    sb AS (SELECT br.node, br.child, c.node AS species FROM br JOIN clo c ON c.ancestor = br.node SEMI JOIN leaf ON leaf.node = c.node WHERE NOT EXISTS (SELECT 1 FROM clo x WHERE x.node = c.node AND x.ancestor = br.child)),
    n AS (SELECT 32 + s_nationkey AS species, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
    SELECT br.node, br.child, count(sb.species) AS n_species, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_lines FROM br LEFT JOIN sb ON sb.node = br.node AND sb.child = br.child LEFT JOIN n ON n.species = sb.species GROUP BY ALL""",
)
def side_branch_counts(spark, sf):
    return H.side_branch_counts(groups(spark, sf), nation_tree(spark, sf))


# clustered genes: parts in returned or accepted lines; the proteins of a species are all its parts; nation 7 is not in the tree
STRATA = f"""{TREE}, lv AS (SELECT node FROM leaf WHERE node <> 39), mb AS (SELECT DISTINCT l_orderkey AS "group", 32 + s_nationkey AS species, l_partkey AS gene FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag <> 'N'),
 pt AS (SELECT DISTINCT 32 + s_nationkey AS species, l_partkey AS gene FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> 7), ms AS (SELECT DISTINCT "group", species FROM mb),
 na AS (SELECT "group", count(*) AS n FROM ms GROUP BY 1), mt AS (SELECT * FROM ms SEMI JOIN lv ON lv.node = species), nt AS (SELECT "group", count(*) AS nt FROM mt GROUP BY 1),
 ml AS (SELECT u."group", max(u.ancestor) AS lca FROM (SELECT "group", ancestor, count(*) AS c FROM mt JOIN clo ON species = node GROUP BY ALL) u JOIN nt ON nt."group" = u."group" AND c = nt.nt GROUP BY 1),
 pl AS (SELECT mb.species, mb.gene, CASE WHEN n = 1 THEN 'species_specific_clustered' ELSE CAST(lca AS VARCHAR) END AS stratum, mb."group" FROM mb SEMI JOIN lv ON lv.node = mb.species JOIN na ON na."group" = mb."group" JOIN ml ON ml."group" = mb."group" WHERE n = 1 OR lca <> mb.species),
 sr AS (SELECT * FROM pl UNION ALL SELECT pt.species, pt.gene, 'species_specific_unclustered', NULL FROM pt ANTI JOIN pl ON pl.species = pt.species AND pl.gene = pt.gene)"""


def strata(spark, sf):
    t = nation_tree(spark, sf)
    without = H.tree_tables(t.edges.filter("node <> 39"))
    x = lines(spark, sf).select(F.col("l_orderkey").alias("group"), leaf("s_nationkey").alias("species"), F.col("l_partkey").alias("gene"), "l_returnflag")
    return H.gene_strata(x.filter("l_returnflag <> 'N'"), x, without)


@query("gene_strata", f"WITH {STRATA} SELECT * FROM sr")
def gene_strata(spark, sf):
    return strata(spark, sf)


@query(
    "stratum_counts",
    f"""WITH {STRATA} SELECT species, stratum, CASE WHEN stratum <> 'species_specific_unclustered' THEN count(DISTINCT "group") END AS n_groups, count(DISTINCT gene) AS n_genes FROM sr GROUP BY species, stratum""",
)
def stratum_counts(spark, sf):
    return H.stratum_counts(strata(spark, sf))


PLACED = f"{PRES}, b AS (SELECT *, {IX} AS ix FROM pres), pl AS (SELECT gene, focal, max(ix) AS ix, bool_or(focal = species) AS own FROM b GROUP BY ALL)"


@query("place_on_lineage", f"WITH {PLACED} SELECT gene, focal, CASE WHEN ix > 0 THEN focal >> ix END AS node, ix FROM pl")
def place(spark, sf):
    return H.place_on_lineage(presence(spark, sf), nation_tree(spark, sf))


@query("place_on_lineage_synteny", f"WITH {PLACED} SELECT gene, focal, CASE WHEN ix > 0 THEN focal >> ix END AS node, ix FROM pl WHERE own")
def place_synteny(spark, sf):
    return H.place_on_lineage(presence(spark, sf), nation_tree(spark, sf), need_focal=True)


HAS = f"""{PRES}, h0 AS (SELECT DISTINCT o_orderkey AS gene, 32 + c_nationkey AS focal, (32 + s_nationkey) >> (1 + l_linenumber % 4) AS node
   FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey),
 h AS (SELECT gene, focal, node, k AS ix FROM h0, range(1, 6) r(k) WHERE (focal >> k) = node)"""


def has(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    node = F.floor(leaf("s_nationkey") / F.pow(F.lit(2), 1 + F.col("l_linenumber") % 4)).cast("bigint")
    return lines(spark, sf).join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("gene"), leaf("c_nationkey").alias("focal"), node.alias("node"))


@query("oldest_node", f"WITH {HAS} SELECT gene, focal, focal >> max(ix) AS node, max(ix) AS ix FROM h GROUP BY gene, focal")
def oldest(spark, sf):
    return H.oldest_node(has(spark, sf), nation_tree(spark, sf))


@query(
    "oldest_node_contiguous",
    f"""WITH {HAS}, r AS (SELECT *, row_number() OVER (PARTITION BY gene, focal ORDER BY ix) AS rn FROM h)
    SELECT gene, focal, focal >> max(ix) AS node, max(ix) AS ix FROM r WHERE ix = rn GROUP BY gene, focal""",
)
def oldest_contiguous(spark, sf):
    return H.oldest_node(has(spark, sf), nation_tree(spark, sf), contiguous=True)


@query(
    "lineage_bins",
    f"WITH {PRES}, b AS (SELECT *, {IX} AS ix FROM pres WHERE focal <> species) SELECT gene, focal, focal >> ix AS node, ix, count(*) AS n_species FROM b GROUP BY ALL",
)
def bins(spark, sf):
    return H.bin_counts(presence(spark, sf), nation_tree(spark, sf))


@query(
    "oldest_shared_bin",
    f"""WITH {PRES}, b AS (SELECT DISTINCT gene, focal, {IX} AS ix FROM pres WHERE focal <> species)
    SELECT gene, focal, count(*) AS n_bins, CASE WHEN count(*) >= 2 THEN focal >> max(ix) END AS node FROM b GROUP BY gene, focal""",
)
def shared_bin(spark, sf):
    return H.oldest_shared_bin(presence(spark, sf), nation_tree(spark, sf))


@query(
    "tier_assignment",
    """SELECT c_name AS name, CASE WHEN (32 + c_nationkey) >> 3 = 4 THEN 'INSIDE_CLADE' WHEN (32 + c_nationkey) >> 4 = 2 THEN '2' ELSE 'outside' END AS tier,
    CASE WHEN (32 + c_nationkey) >> 3 <> 4 AND (32 + c_nationkey) >> 4 = 2 THEN 1 END AS rung FROM customer""",
)
def tiers(spark, sf):
    t = nation_tree(spark, sf)
    s = table(spark, sf, "customer").select(F.col("c_name").alias("name"), leaf("c_nationkey").alias("node"))
    ladder = t.edges.filter("node = 2").select("node", F.lit(1).alias("rung"))
    return H.assign_tiers(s, t, F.lit(4), ladder)


@query(
    "resolve_names",
    """WITH tx AS (SELECT p_brand AS taxid, p_name AS tax_name FROM part), nm AS (SELECT DISTINCT p_name || ' ' || p_type AS name FROM part),
    two AS (SELECT tax_name AS k, count(DISTINCT taxid) AS n, min(taxid) AS taxid FROM tx GROUP BY 1),
    one AS (SELECT DISTINCT split_part(tax_name, ' ', 1) AS k, 1 AS n, 'G-' || split_part(tax_name, ' ', 1) AS taxid FROM tx WHERE substr(tax_name, 1, 1) > 'd')
    SELECT name, CASE WHEN two.n = 1 THEN two.taxid WHEN two.n IS NULL AND one.n = 1 THEN one.taxid END AS taxid,
      CASE WHEN coalesce(two.n, one.n) IS NULL THEN 'UNMATCHED' WHEN coalesce(two.n, one.n) > 1 THEN 'AMBIGUOUS' WHEN two.n IS NOT NULL THEN 'species' ELSE 'genus' END AS level
    FROM nm LEFT JOIN two ON two.k = split_part(name, ' ', 1) || ' ' || split_part(name, ' ', 2) LEFT JOIN one ON one.k = split_part(name, ' ', 1)""",
)
def resolve(spark, sf):
    p = table(spark, sf, "part")
    # parts are species; first words after the letter d are genera
    tx = p.select(F.col("p_brand").alias("taxid"), F.col("p_name").alias("tax_name"), F.lit("species").alias("rank"))
    word = F.substring_index("p_name", " ", 1)
    tx = tx.unionByName(p.filter("substr(p_name, 1, 1) > 'd'").select(F.concat(F.lit("G-"), word).alias("taxid"), word.alias("tax_name"), F.lit("genus").alias("rank")).distinct())
    nm = p.select(F.concat_ws(" ", "p_name", "p_type").alias("name")).distinct()
    levels = [(lv, taxon_key("name", lv), taxon_key("tax_name", lv)) for lv in ("exact", "species", "genus")]
    return H.resolve_names(nm, tx, levels)


LEN = "CASE WHEN {0} > 1 THEN {0} % 7 + 0.5 ELSE 0.0 END"


@query(
    "farthest_species",
    f"""WITH {PRES}, hgt AS (SELECT n, sum({LEN.format("(n >> k)")}) AS h FROM range(1, 64) t(n), range(0, 6) r(k) WHERE (n >> k) > 0 GROUP BY n),
    d AS (SELECT p.*, CAST(round(a.h + b.h - 2 * c.h, 6) AS DOUBLE) AS distance FROM (SELECT *, focal >> {IX} AS m FROM pres WHERE focal <> species) p
      JOIN hgt a ON a.n = focal JOIN hgt b ON b.n = species JOIN hgt c ON c.n = m),
    r AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY distance DESC, species) AS rn FROM d)
    SELECT gene AS locus, focal AS ref, species, distance FROM r WHERE rn = 1""",
)
def farthest(spark, sf):
    t = nation_tree(spark, sf)
    lengths = t.edges.select("node", (F.col("node") % 7 + 0.5).cast("double").alias("length"))
    p = presence(spark, sf).select(F.col("gene").alias("locus"), F.col("focal").alias("ref"), "species").distinct()
    return H.farthest(p, lengths, t)


CARRY = f"""{LCA}, car AS (SELECT DISTINCT up."group" AS unit, lca AS origin, ancestor AS node FROM up JOIN lca ON up."group" = lca."group" WHERE ancestor >= lca),
 lost AS (SELECT unit, origin, b.node AS branch FROM (SELECT unit, origin, unnest([2 * node, 2 * node + 1]) AS node FROM car) b SEMI JOIN (SELECT node FROM node_t WHERE node > 1) t ON t.node = b.node
   LEFT JOIN (SELECT unit AS u, node AS v FROM car) x ON x.u = b.unit AND x.v = b.node WHERE x.v IS NULL)"""


@query("dollo_losses", f"WITH {CARRY} SELECT unit, origin, branch FROM lost")
def dollo(spark, sf):
    t = nation_tree(spark, sf)
    g = groups(spark, sf)
    u = H.lca(g.withColumnRenamed("species", "node"), t, "group").select(F.col("group").alias("unit"), F.col("lca").alias("origin"))
    return H.dollo_losses(u, g.withColumnRenamed("group", "unit"), t)


@query(
    "dollo_losses_unknown",
    f"""WITH {TREE}, pr AS (SELECT DISTINCT l_orderkey AS unit, 32 + s_nationkey AS species FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag <> 'N'),
    un AS (SELECT DISTINCT l_orderkey AS unit, 32 + s_nationkey AS species FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'N' EXCEPT SELECT * FROM pr),
    car AS (SELECT DISTINCT unit, ancestor AS node FROM pr JOIN clo ON species = node UNION SELECT DISTINCT unit, 1 FROM pr),
    size AS (SELECT ancestor AS node, count(*) AS n FROM clo WHERE node >= 32 GROUP BY 1), uc AS (SELECT unit, ancestor AS node, count(*) AS n FROM un JOIN clo ON species = node GROUP BY ALL),
    lost AS (SELECT unit, b.node FROM car JOIN node_t b ON b.node >> 1 = car.node AND b.node > 1 ANTI JOIN car x ON x.unit = car.unit AND x.node = b.node)
    SELECT l.unit, CAST(1 AS BIGINT) AS origin, l.node AS branch FROM lost l JOIN size s ON s.node = l.node LEFT JOIN uc ON uc.unit = l.unit AND uc.node = l.node WHERE coalesce(uc.n, 0) < s.n"""
    .replace("ANTI JOIN car x ON x.unit = car.unit AND x.node = b.node", "WHERE NOT EXISTS (SELECT 1 FROM car x WHERE x.unit = car.unit AND x.node = b.node)"),
)
def dollo_unknown(spark, sf):
    t = nation_tree(spark, sf)
    x = lines(spark, sf).select(F.col("l_orderkey").alias("unit"), leaf("s_nationkey").alias("species"), "l_returnflag")
    p = x.filter("l_returnflag <> 'N'").select("unit", "species").distinct()
    u = x.filter("l_returnflag = 'N'").select("unit", "species").distinct()
    return H.dollo_losses(p.select("unit", F.lit(1).cast("bigint").alias("origin")).distinct(), p, t, u)


LINE_TIPS = "SELECT l_orderkey AS unit, 32 + s_nationkey AS node, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS state FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"


def parsimony_sql(tips: str = LINE_TIPS) -> str:
    """Leaves are at depth 5 and the parent of i is i >> 1: costs up to the root, then down again. A tip of state NULL may be either."""
    best = lambda d, a, b: f"least({d}.c{a}, {d}.c{b} + 1)"
    down = "".join(f""",
 d{k} AS (SELECT unit, node >> 1 AS node, sum({best('x', 0, 1)}) AS c0, sum({best('x', 1, 0)}) AS c1 FROM d{k + 1} x GROUP BY ALL)""" for k in range(4, -1, -1))
    up = "".join(f""",
 r{k} AS (SELECT x.*, p.u0 + p.c0 - {best('x', 0, 1)} AS r0, p.u1 + p.c1 - {best('x', 1, 0)} AS r1 FROM d{k} x JOIN u{k - 1} p ON p.unit = x.unit AND p.node = x.node >> 1),
 u{k} AS (SELECT unit, node, c0, c1, least(r0, r1 + 1) AS u0, least(r1, r0 + 1) AS u1 FROM r{k})""" for k in range(1, 6))
    every = " UNION ALL ".join(f"SELECT * FROM u{k}" for k in range(6))
    return f"""WITH t AS ({tips}),
 d5 AS (SELECT unit, node, CASE WHEN state = 1 THEN 1000000 ELSE 0 END AS c0, CASE WHEN state = 0 THEN 1000000 ELSE 0 END AS c1 FROM t){down},
 u0 AS (SELECT *, 0 AS u0, 0 AS u1 FROM d0){up}, m AS (SELECT unit, least(c0, c1) AS b FROM d0)
 SELECT a.unit, a.node, a.u0 + a.c0 = b AS can0, a.u1 + a.c1 = b AS can1 FROM ({every}) a JOIN m ON m.unit = a.unit"""


@query("parsimony_states", parsimony_sql())
def parsimony(spark, sf):
    x = lines(spark, sf).groupBy(F.col("l_orderkey").alias("unit"), leaf("s_nationkey").alias("species"))
    tips = x.agg(F.max(F.when(F.col("l_returnflag") == "A", 1).otherwise(0)).alias("state"))
    return H.parsimony_states(tips, nation_tree(spark, sf))


# customers and their orders
EDGE = """edge AS (SELECT 'c' || o_custkey AS a, 'o' || o_orderkey AS b FROM orders)"""
COMP = f"""RECURSIVE {EDGE}, e2 AS (SELECT a AS u, b AS v FROM edge UNION SELECT b, a FROM edge),
 reach AS (SELECT u, u AS w FROM e2 UNION SELECT e2.u, reach.w FROM reach JOIN e2 ON e2.v = reach.u),
 comp AS (SELECT u AS id, min(w) AS component FROM reach GROUP BY 1),
 allc AS (SELECT 'o' || o_orderkey AS id, coalesce(component, 'o' || o_orderkey) AS component, o_orderkey % 50 AS sz FROM orders LEFT JOIN comp ON id = 'o' || o_orderkey
          UNION ALL SELECT 'c' || c_custkey, coalesce(component, 'c' || c_custkey), c_nationkey FROM customer LEFT JOIN comp ON id = 'c' || c_custkey)"""



def _id(prefix: str, c: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def vertices(spark, sf):
    o = table(spark, sf, "orders").select(_id("o", "o_orderkey").alias("id"), (F.col("o_orderkey") % 50).alias("sz"))
    return o.unionByName(table(spark, sf, "customer").select(_id("c", "c_custkey").alias("id"), F.col("c_nationkey").alias("sz")))


def edges(spark, sf):
    return table(spark, sf, "orders").select(_id("c", "o_custkey").alias("src"), _id("o", "o_orderkey").alias("dst"))


@query("connected_components", f"WITH {COMP} SELECT id, component FROM allc")
def components(spark, sf):
    return G.connected_components(vertices(spark, sf), edges(spark, sf))


@query(
    "locus_records",
    f"""WITH {COMP}, m AS (SELECT *, id AS gene, CASE WHEN sz % 9 = 0 THEN 'DNG' ELSE 'PDNG' END AS gt, sz % 5 AS rank FROM allc),
    g AS (SELECT component, min(rank) AS r, arg_min('N' || rank, (rank, gene)) AS node, CASE WHEN bool_or(gt = 'DNG') THEN 'DNG' ELSE 'PDNG' END AS gene_type, min(gene) AS first_gene, count(*) AS n_members FROM m GROUP BY 1)
    SELECT component, node, gene_type, first_gene, n_members, row_number() OVER (ORDER BY r, first_gene, component) AS locus FROM g""",
)
def loci(spark, sf):
    v = vertices(spark, sf)
    m = v.select("id", F.concat(F.lit("N"), (F.col("sz") % 5).cast("string")).alias("node"),
                 F.when(F.col("sz") % 9 == 0, "DNG").otherwise("PDNG").alias("gene_type"), F.col("id").alias("gene"))
    rank = v.select((F.col("sz") % 5).alias("rank")).distinct().select("rank", F.concat(F.lit("N"), F.col("rank").cast("string")).alias("node"))
    return G.build_loci(m, components(spark, sf), rank)


HIT = """RECURSIVE hit AS (SELECT DISTINCT 'p' || p_partkey AS u, 'p' || (p_partkey * 7 // 10 + 1) AS v FROM part),
 pt AS (SELECT 'p' || p_partkey AS id, p_brand AS species, length(p_name) AS length FROM part),
 fe AS (SELECT u, v FROM hit JOIN pt a ON a.id = u JOIN pt b ON b.id = v WHERE a.species = b.species AND u <> v),
 f2 AS (SELECT u, v FROM fe UNION SELECT v, u FROM fe), reach AS (SELECT u, u AS w FROM f2 UNION SELECT f2.u, reach.w FROM reach JOIN f2 ON f2.v = reach.u),
 c AS (SELECT u AS id, min(w) AS comp FROM reach GROUP BY 1), mem AS (SELECT pt.*, coalesce(comp, pt.id) AS comp FROM pt LEFT JOIN c ON c.id = pt.id),
 sz AS (SELECT species, comp, count(*) AS n, min(id) AS f FROM mem GROUP BY ALL), num AS (SELECT *, row_number() OVER (PARTITION BY species ORDER BY n DESC, f) AS no FROM sz),
 fam AS (SELECT m.species, m.id, no AS family_no, n AS family_size, row_number() OVER (PARTITION BY m.species, m.comp ORDER BY length DESC, m.id) = 1 AS is_representative, CAST(length AS INTEGER) AS length
   FROM mem m JOIN num ON num.species = m.species AND num.comp = m.comp)"""


@query("sequence_families", f"WITH {HIT} SELECT * FROM fam")
def families(spark, sf):
    p = table(spark, sf, "part")
    s = p.select(_id("p", "p_partkey").alias("id"), F.col("p_brand").alias("species"), F.length("p_name").alias("length"))
    near = F.floor(F.col("p_partkey") * 7 / 10) + 1
    h = p.select(_id("p", "p_partkey").alias("query"), F.concat(F.lit("p"), near.cast("string")).alias("subject"))
    return G.families(s, h)


@query(
    "family_summary",
    f"""WITH {HIT}, o AS (SELECT species, family_no, max(family_size) AS n FROM fam GROUP BY ALL),
    s AS (SELECT species, CAST(sum(n) AS BIGINT) AS total, count(*) AS families, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (n > 1) AS multi_families, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS in_multi FROM o GROUP BY 1)
    SELECT *, in_multi - multi_families AS redundant, round(100.0 * (in_multi - multi_families) / total, 1) AS pct_redundant FROM s""",
)
def family_summary(spark, sf):
    return G.family_summary(families(spark, sf))


@query(
    "most_frequent_brand",
    """WITH c AS (SELECT l_orderkey, p_brand, count(*) AS n, min(l_linenumber) AS o FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, o, p_brand) AS rn FROM c) SELECT l_orderkey, p_brand FROM r WHERE rn = 1""",
)
def mode_brand(spark, sf):
    x = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return G.mode_first(x, "l_orderkey", "p_brand", "l_linenumber")


# orders are loci, shipped parts their genes, brands the groups
UNITS = """lo AS (SELECT o_orderkey AS locus, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'DNG' ELSE 'PDNG' END AS gene_type, o_custkey % 63 + 1 AS node FROM orders),
 me AS (SELECT l_orderkey AS locus, 32 + s_nationkey AS species, l_partkey AS gene, l_linenumber AS seq, p_brand || '-' || p_size AS "group" FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey),
 ct AS (SELECT locus, "group", count(*) AS n, min(seq) AS o FROM me GROUP BY ALL), hg AS (SELECT locus, arg_min("group", (-n, o, "group")) AS g FROM ct GROUP BY 1),
 un AS (SELECT lo.*, coalesce(g, 'SINGLETON_' || lo.locus) AS unit FROM lo LEFT JOIN hg ON hg.locus = lo.locus),
 sp AS (SELECT DISTINCT unit, un.locus, gene_type, species FROM un JOIN me ON me.locus = un.locus), dn AS (SELECT DISTINCT unit, species FROM sp WHERE gene_type = 'DNG'),
 al AS (SELECT sp.locus, bool_or(dn.unit IS NULL) AS alone FROM sp LEFT JOIN dn ON dn.unit = sp.unit AND dn.species = sp.species WHERE gene_type = 'PDNG' GROUP BY 1),
 kept AS (SELECT un.*, coalesce(alone, true) AS kept FROM un LEFT JOIN al ON al.locus = un.locus)"""


def unit_inputs(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("locus"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "DNG").otherwise("PDNG").alias("gene_type"),
        (F.col("o_custkey") % 63 + 1).alias("node"))
    x = lines(spark, sf).select(
        F.col("l_orderkey").alias("locus"), leaf("s_nationkey").alias("species"), F.col("l_partkey").alias("gene"), F.col("l_linenumber").alias("seq"))
    g = lines(spark, sf).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        leaf("s_nationkey").alias("species"), F.col("l_partkey").alias("gene"), F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("group")).distinct()
    return o, x, g


@query("origin_units", f"WITH {UNITS} SELECT locus, gene_type, node, unit, kept FROM kept")
def origin_units(spark, sf):
    return G.origin_units(*unit_inputs(spark, sf))


SPLIT = UNITS + """, b AS (SELECT unit, gene_type, locus, node AS branch, CAST(floor(log2(node)) AS BIGINT) AS depth FROM kept WHERE kept AND node IN (SELECT DISTINCT (32 + n_nationkey) >> k FROM nation, range(0, 6) r(k))),
 ls AS (SELECT DISTINCT unit, gene_type, branch, depth FROM b),
 og AS (SELECT l.unit, l.gene_type, l.branch, arg_min(c.branch, c.depth) AS origin FROM ls l JOIN ls c ON c.unit = l.unit AND c.gene_type = l.gene_type AND c.depth <= l.depth AND l.branch >> (l.depth - c.depth) = c.branch GROUP BY ALL),
 x AS (SELECT b.*, origin FROM b JOIN og ON og.unit = b.unit AND og.gene_type = b.gene_type AND og.branch = b.branch),
 st AS (SELECT unit, gene_type, origin, min(depth) AS d, min(locus) AS f FROM x WHERE branch = origin GROUP BY ALL),
 no AS (SELECT *, row_number() OVER (PARTITION BY unit, gene_type ORDER BY d, f, origin) AS origin_no FROM st),
 sl AS (SELECT x.unit, x.gene_type, locus, branch, x.origin, origin_no, x.unit || CASE WHEN origin_no > 1 THEN '#' || origin_no ELSE '' END AS label FROM x JOIN no ON no.unit = x.unit AND no.gene_type = x.gene_type AND no.origin = x.origin)"""


@query("split_lineages", f"WITH {SPLIT} SELECT * FROM sl")
def split(spark, sf):
    k = origin_units(spark, sf).filter("kept").select("unit", "gene_type", "locus", F.col("node").alias("branch"))
    return G.split_lineages(k, nation_tree(spark, sf))


@query(
    "branch_rates",
    f"""WITH {SPLIT}, bl AS (SELECT DISTINCT (32 + n_nationkey) >> k AS branch FROM nation, range(0, 6) r(k)), le AS (SELECT branch, CASE WHEN branch % 10 = 0 THEN NULL ELSE branch % 7 * 1.5 END AS length FROM bl),
    bi AS (SELECT DISTINCT unit, gene_type, origin, origin_no FROM sl),
    c AS (SELECT le.branch, CAST(length AS DOUBLE) AS length, count(*) FILTER (bi.gene_type = 'DNG') AS db, count(*) FILTER (bi.gene_type = 'PDNG') AS pb FROM le LEFT JOIN bi ON bi.origin = le.branch GROUP BY ALL),
    de AS (SELECT (32 + s_nationkey) >> 1 AS branch, count(*) FILTER (l_returnflag = 'A') AS dd, count(*) FILTER (l_returnflag <> 'A') AS pd FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
    j AS (SELECT c.*, coalesce(dd, 0) AS dd, coalesce(pd, 0) AS pd FROM c LEFT JOIN de ON de.branch = c.branch)
    SELECT branch, length, db AS "DNG_births", pb AS "PDNG_births", dd AS "DNG_deaths", pd AS "PDNG_deaths", db + pb AS "TDNG_births", dd + pd AS "TDNG_deaths",
      CASE WHEN length <> 0 THEN round(db / length, 3) END AS "DNG_birth_rate", CASE WHEN length <> 0 THEN round(pb / length, 3) END AS "PDNG_birth_rate",
      CASE WHEN length <> 0 THEN round(dd / length, 3) END AS "DNG_death_rate", CASE WHEN length <> 0 THEN round(pd / length, 3) END AS "PDNG_death_rate",
      CASE WHEN length <> 0 THEN round((db + pb) / length, 3) END AS "TDNG_birth_rate", CASE WHEN length <> 0 THEN round((dd + pd) / length, 3) END AS "TDNG_death_rate" FROM j""",
)
def rates(spark, sf):
    s = split(spark, sf)
    births = s.select("unit", "gene_type", "origin", "origin_no").distinct().select(F.col("origin").alias("branch"), "gene_type")
    d = lines(spark, sf).select(
        F.floor(leaf("s_nationkey") / 2).alias("branch"), F.when(F.col("l_returnflag") == "A", "DNG").otherwise("PDNG").alias("gene_type"))
    b = nation_tree(spark, sf).depth.select(F.col("node").alias("branch"))
    b = b.withColumn("length", F.when(F.col("branch") % 10 != 0, (F.col("branch") % 7 * 1.5).cast("double")))
    return G.branch_rates(b, births, d)
