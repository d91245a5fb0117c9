"""Queries against their SQL on a few odd rows: short, empty and unknown texts, keys without a partner, ids shared by rows."""

import math
from collections import Counter

import duckdb

import __spark_entry__ as entry


def same_as_sql(spark, folder, name, **tables):
    """Writes the tables as parquet, runs the query on them and compares with its SQL; returns the rows."""
    con = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = entry.queries()[name](spark, str(folder))
    cols = ", ".join(f'"{c}"' for c in df.columns)
    plain = lambda r: tuple("NaN" if isinstance(v, float) and math.isnan(v) else v for v in r)
    got = [plain(r) for r in df.collect()]
    want = [plain(r) for r in con.execute(f"SELECT {cols} FROM ({entry.oracle_sql()[name]})").fetchall()]
    assert Counter(got) == Counter(want)
    return got


TEXTS = ("doc_id long, text string", [(1, "atg tax"), (2, ""), (3, "c"), (4, "ab"), (5, None), (6, "m"), (7, "12 34"), (8, "x"), (9, "qrs"), (10, None)])


def test_texts_without_a_codon_have_no_protein(spark, tmp_path):
    assert {r[0] for r in same_as_sql(spark, tmp_path, "translation", documents=TEXTS)} == {1, 9}


def test_segments_of_one_residue_none_and_unknown(spark, tmp_path):
    assert len(same_as_sql(spark, tmp_path, "segment_orf", documents=TEXTS)) == 10


def test_transcripts_with_empty_and_unknown_exons(spark, tmp_path):
    rows = same_as_sql(spark, tmp_path, "build_cds", documents=TEXTS)
    assert len(rows) == 10 and {r[2] for r in rows} == {2}


LINES = ("l_partkey long, l_suppkey long", [(1, 1002), (2, 2), (3, 7), (9, 5), (None, 2), (4, None), (4, 3)])
PARTS = ("p_partkey long, p_name string, p_brand string, p_size int", [(1, "a", "B1", 50), (2, "b", "B2", 1), (3, "c", "B3", 1), (4, "c", "B4", 1), (5, "d", None, 50)])
SUPPLIERS = ("s_suppkey long, s_name string, s_acctbal double", [(1002, "S1", 9000.0), (2, "S2", 9000.0), (3, "S3", 1.0), (5, "S5", 9000.0), (6, None, 9000.0)])


def test_rows_with_the_same_id_keep_their_own_targets(spark, tmp_path):
    # 1 * 1000 + 1002 and 2 * 1000 + 2 are the same id; part 9 is unknown
    rows = same_as_sql(spark, tmp_path, "priority_match", lineitem=LINES, part=PARTS, supplier=SUPPLIERS)
    assert (2002, "B1", "part") in rows and (2002, "S2", "supplier") in rows and (9005, "S5", "supplier") in rows


def test_report_counts_rows_with_the_same_id_apart(spark, tmp_path):
    rows = same_as_sql(spark, tmp_path, "match_report", lineitem=LINES, part=PARTS, supplier=SUPPLIERS)
    assert ("S2", 2, "supplier") in rows and ("S5", 1, "supplier") in rows


def test_report_holds_every_name_that_a_rule_leads_to(spark, tmp_path):
    # part 1 leads to its brand by its size, part 2 by its name; brand B9 is led to by no line, a part without a brand to none
    lines = ("l_partkey long, l_suppkey long", [(1, 3), (2, 3), (2, 7), (6, 3), (9, 2)])
    parts = (PARTS[0], [*PARTS[1], (6, "e", "B1", 1), (7, "f", "B9", 1)])
    rows = same_as_sql(spark, tmp_path, "match_report", lineitem=lines, part=parts, supplier=SUPPLIERS)
    want = {("B1", 2, "name;part"), ("B2", 2, "name"), ("B3", 0, "Missing"), ("B4", 0, "Missing"), ("B9", 0, "Missing"), ("S2", 1, "supplier")}
    assert want <= set(rows) and len(rows) == 5 + len(SUPPLIERS[1])


def test_every_row_of_a_repeated_customer_is_not_found(spark, tmp_path):
    orders = ("o_orderkey long, o_custkey long", [(1, 4), (2, 5)])
    lines = ("l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string, l_linenumber int, l_quantity double", [(1, 7, 3, "R", 1, 5.0), (2, 7, 10, "R", 1, 5.0)])
    rows = same_as_sql(spark, tmp_path, "features_not_found", orders=orders, lineitem=lines, customer=("c_custkey long", [(4,), (5,), (5,), (None,)]))
    assert len(rows) == 4


def test_asked_ids_without_a_line_are_not_among_the_not_found(spark, tmp_path):
    # customer 8 has no order with a line, supplier 20 only a line of no order and supplier 30 only one of customer 4
    orders = ("o_orderkey long, o_custkey long", [(1, 4), (2, 5), (3, 8), (4, None)])
    lines = ("l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string, l_linenumber int, l_quantity double",
             [(1, 7, 30, "R", 1, 5.0), (2, 7, 10, "R", 1, 5.0), (9, 7, 20, "R", 1, 5.0), (4, 7, 40, "R", 1, 5.0)])
    rows = same_as_sql(spark, tmp_path, "features_not_found", orders=orders, lineitem=lines, customer=("c_custkey long", [(4,), (5,), (8,)]))
    assert sorted(r[0] for r in rows) == ["zz4", "zz5", "zz8"]
