import __spark_entry__ as entry


def test_names():
    known, sql = entry.queries(), entry.oracle_sql()
    assert len(known) > 90 and set(sql) <= set(known)


def test_flagship(spark, tmp_path):
    import os

    import pytest

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    rows = entry.entry(spark)
    assert rows.columns == ["code", "t0", "t1", "ret", "bin"]
    got = rows.collect()
    assert got and {r.bin for r in got} <= {-1, 0, 1}
