"""Tables in the shared folder."""

import types

import pytest

from codelattice import tables


def test_sweep_deletes_what_is_not_kept(spark):
    mark = tables.written()
    one, two = tables.stored(spark.range(5), "one"), tables.stored(spark.range(7), "two")
    tables.sweep(spark, mark, keep=(two,))
    assert two.count() == 7 and tables.written() == mark + 1
    with pytest.raises(Exception):
        one.count()
    tables.drop_stored(two)
    assert tables.written() == mark


def test_no_local_folder_off_a_local_master():
    def session(master):
        return types.SimpleNamespace(conf={}, sparkContext=types.SimpleNamespace(master=master))

    for master in ("local", "local[8]", "local[*, 4]"):
        assert tables.shared_folder(session(master)).startswith("file:")
    for master in ("local-cluster[3,2,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(RuntimeError):
            tables.shared_folder(session(master))


def test_ordered_index_of_ties_and_nulls(spark):
    frame = spark.createDataFrame([("b", 1), (None, 2), ("a", 3), ("a", 4)], "k string, v int")
    rows = tables.ordered_index(frame, [frame["k"].asc_nulls_last(), frame["v"].asc()], "n").collect()
    assert {(r.n, r.v) for r in rows} == {(0, 3), (1, 4), (2, 1), (3, 2)}
