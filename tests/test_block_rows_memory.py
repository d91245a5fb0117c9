"""From blocks to collinear rows: the answers of a batch stay numbers."""

import tracemalloc

import pyarrow as pa

from cladeloom.functions import aligned as A


def test_columns_of_a_batch_are_not_objects():
    n, rows = 20_000, 100
    batch = pa.array(["A-" * (n // 2)] * rows), pa.array([1] * rows, pa.int64()), pa.array([list(range(n))] * rows, pa.list_(pa.int64()))
    tracemalloc.start()
    got = A.columns_from.func(*batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == rows and got[99].as_py()[:5] == [0, 0, 2, 4, 6] and got[0].as_py()[-1] == n
    assert peak < 30 * rows * n / 2  # 8 bytes a position with the parts of the answer; as lists of numbers some 40


def test_columns_of_odd_rows(spark):
    x = spark.createDataFrame([("--AC-G", 5, [4, 5, 6, 7, 8, 90]), ("", 1, [0, 1, 7]), ("A", 1, [])], "r string, s long, p array<long>")
    assert [r[0] for r in x.select(A.columns_from("r", "s", "p")).collect()] == [[0, 0, 3, 5, 6, 6], [0, 0, 0], []]
