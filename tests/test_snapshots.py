import datetime as dt

from editrail.operators.snapshots import section_changes, snapshot_changes, snapshot_steps

T0 = dt.datetime(2024, 1, 1)


def changes(df):
    """snapshot_changes of records (s, v, k, c), named by their series and versions."""
    df = df.selectExpr("*", "to_json(struct(s, v)) AS snap")
    steps = snapshot_steps(df.select("s", "v", "snap").distinct(), ["s"], "v", "snap")
    out = snapshot_changes(df, steps, "snap", ["k"], "c")
    named = steps.selectExpr("old_step AS step", "s", "version AS a", "next_version AS b").where("step IS NOT NULL")
    return sorted(map(tuple, out.join(named, "step").select("s", "a", "b", "k", "change_kind").collect()), key=str)


def test_labels_over_gaps_and_several_versions(spark):
    rows = [
        ("a", 2001, "x", "1"), ("a", 2001, "y", "1"), ("a", 2001, "n", None),
        ("a", 2003, "x", "2"), ("a", 2003, "z", "1"), ("a", 2003, "n", None),
        ("a", None, "x", "9"), (None, 1, "k", "1"), (None, 2, "k", "1"), ("b", 5, "q", "1"),
    ]
    df = spark.createDataFrame(rows, "s string, v int, k string, c string").selectExpr("*", "1 AS in_old", "2 AS content", "3 AS k_null")
    assert changes(df) == [("a", 2001, 2003, "x", "changed"), ("a", 2001, 2003, "y", "removed"), ("a", 2001, 2003, "z", "added")]
    assert changes(df.where("false")) == []


def test_null_keys_are_values(spark):
    rows = [("a", 1, None, "1"), ("a", 1, "", "1"), ("a", 2, None, "2"), (None, 1, None, "1"), (None, 2, "q", None)]
    df = spark.createDataFrame(rows, "s string, v int, k string, c string")
    assert changes(df) == sorted([("a", 1, 2, None, "changed"), ("a", 1, 2, "", "removed"), (None, 1, 2, None, "removed"), (None, 1, 2, "q", "added")], key=str)


def test_a_report_without_sections_is_a_snapshot(spark):
    s = spark.createDataFrame([(1, "p1", 0, ["T"], None, T0), (2, "p3", 0, ["T"], None, T0)], "section_id long, package_id string, seq int, path array<string>, paragraphs array<struct<text:string,kind:string,topic:string>>, loaded_at timestamp_ntz")
    r = spark.createDataFrame([(f"p{k}", "house", "A", 2000 + k) for k in (1, 2, 3)], "package_id string, chamber string, subcommittee string, fiscal_year int")
    got = sorted(map(tuple, section_changes(s, r).collect()))
    assert got == [("house", "A", 2001, 2002, "T", 1, "removed"), ("house", "A", 2002, 2003, "T", 1, "added")]


def test_sections(spark):
    p = lambda *ts: [(t, "narrative", None) for t in ts]
    reports = [("p1", "house", "A", 2001), ("p10", "house", "A", 2002), ("p9", "house", "A", 2002), ("p2", "house", "A", None), ("p1", "house", "A", 2001)]
    rows = [
        (1, "p1", 0, ["T"], p("a  b\n"), T0), (2, "p1", 1, ["T", "x"], None, T0), (3, "p1", 2, ["T", "d"], p("one"), T0), (4, "p1", 3, ["T", "d"], p("two"), T0),
        (5, "p9", 0, ["T"], p("a b"), T0), (6, "p9", 1, ["T", "x"], [], T0), (7, "p9", 2, ["T", "d"], p("two"), T0), (8, "p9", 3, ["T", "new"], p(None), T0),
        (5, "p9", 0, ["T"], p("old text"), T0 - dt.timedelta(1)), (5, "p9", 0, ["T"], p("a b"), T0),
        (9, "p10", 0, ["T"], p("never compared"), T0),
    ]
    s = spark.createDataFrame(rows, "section_id long, package_id string, seq int, path array<string>, paragraphs array<struct<text:string,kind:string,topic:string>>, loaded_at timestamp_ntz")
    r = spark.createDataFrame(reports, "package_id string, chamber string, subcommittee string, fiscal_year int").selectExpr("*", "'x' AS path", "1 AS occ")
    got = sorted(map(tuple, section_changes(s.selectExpr("*", "1 AS content"), r).collect()))
    # the greatest package_id in string order is p9
    assert got == [("house", "A", 2001, 2002, "T > d", 1, "changed"), ("house", "A", 2001, 2002, "T > d", 2, "removed"), ("house", "A", 2001, 2002, "T > new", 1, "added")]
    assert section_changes(s.where("false"), r).count() == 0 and section_changes(s, r.where("false")).count() == 0


def test_long_texts_and_equal_snapshots(spark):
    long = "word " * 100_000
    rows = [("s", 1, "k", long), ("s", 2, "k", long), ("s", 3, "k", long + "!")]
    df = spark.createDataFrame(rows, "s string, v int, k string, c string")
    assert changes(df) == [("s", 2, 3, "k", "changed")]
