import __spark_entry__ as entry


def test_names_and_flagship(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and "p1_found" in q
    df = entry.entry(spark)
    assert df.columns == ["chamber", "subcommittee", "old_fy", "new_fy", "path", "occ", "change_kind"] and df.count() > 0
