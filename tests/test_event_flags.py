"""Flags of events: right at the ends of a row, and no dearer in a long row than in a short one."""

import time

import numpy as np
import pyarrow as pa

from cladeloom.functions import aligned as A


def test_flags_of_an_event_do_not_read_the_row_again():
    # 100 thousand events on one row of a million letters: by substrings of the text each would walk to its place
    row = "ACGGT" * 200_000
    at = np.arange(1, 1_000_001, 10)
    began = time.process_time()
    got = A.flags_at().func(pa.array([row]), pa.array([row.replace("T", "-")]), pa.array([at])).to_pylist()[0]
    assert time.process_time() - began < 20
    assert len(got) == 100_000 and [i for i, g in enumerate(got) if g["at_edge"]] == [0, 99_999] and not any(g["homopolymer"] or g["n_nearby"] for g in got)


def test_flags_at_the_ends_of_a_row():
    got = A.flags_at().func(pa.array(["CAAAA-C" + "GT" * 12, "--"]), pa.array(["CAAAANC" + "GT" * 12, "NN"]), pa.array([[0, 5, 9, 10, 12, 30], [1]])).to_pylist()
    assert [tuple(x.values()) for x in got[0]] == [(False, True, True), (True, True, True), (False, True, True), (False, False, True), (False, False, False), (False, True, False)]
    assert [tuple(x.values()) for x in got[1]] == [(False, True, False)]
