import pytest

from editrail.plans import compare as cp
from editrail.plans import history as hs

PARA = "array<struct<text:string,kind:string,topic:string>>"
LAMPS = "The account keeps the harbor lamps burning and the locks greased through the winter, and it pays the two keepers and their boy."
FERRY = "Ferries leave twice a day from the eastern pier with mail, grain and passengers for the islands beyond the strait."


def editions(spark, years):
    """years: fy -> [(path, [texts])]; package p<fy>, section id fy * 100 + position."""
    rows = []
    for fy, secs in years.items():
        for seq, (path, texts) in enumerate(secs):
            rows.append((fy * 100 + seq, f"p{fy}", seq, seq, path[-1], len(path) - 1, path, [(t, "directive" if ".--" in t else "narrative", t.split(".--")[0] if ".--" in t else None) for t in texts]))
    s = spark.createDataFrame(rows, f"section_id long, package_id string, seq int, sort_order int, heading string, level int, path array<string>, paragraphs {PARA}")
    fys = sorted(years)
    p = spark.createDataFrame([(f"{a}-{b}", "house", "harbors", f"p{a}", f"p{b}", a, b, b - a) for a, b in zip(fys, fys[1:])], "pair string, chamber string, slug string, old_package string, new_package string, old_fy int, new_fy int, year_delta int")
    return p, s


@pytest.fixture(scope="module")
def compared(spark):
    p, s = editrail_years = editions(
        spark,
        {
            1: [(["T", "A"], [LAMPS, FERRY]), (["T", "B"], ["One line stays."]), (["T", "C"], ["Gone next year for good and all."])],
            2: [(["T", "A"], [LAMPS.replace("winter", "autumn")]), (["T", "B"], ["One line stays.", FERRY]), (["T", "D"], ["Oil.--The office shall buy oil."])],
            3: [(["T", "A"], [LAMPS.replace("winter", "autumn")]), (["T", "B"], ["One line stays.", FERRY]), (["T", "D"], ["Oil.--The office may buy oil."])],
        },
    )
    return (*editrail_years, cp.compare(p, s))


def test_sections_are_classed_ranked_and_named(compared):
    _, _, c = compared
    rows = {(r["pair"], tuple(r["path"])): r for r in c.sections.collect()}
    assert {k: v["change"] for k, v in rows.items()} == {
        ("1-2", ("T", "A")): "substantive", ("1-2", ("T", "B")): "substantive", ("1-2", ("T", "C")): "dropped", ("1-2", ("T", "D")): "new",
        ("2-3", ("T", "A")): "unchanged", ("2-3", ("T", "B")): "unchanged", ("2-3", ("T", "D")): "substantive",
    }
    # the moved ferry counts for neither section: one changed word is left of A, none of B
    assert rows["1-2", ("T", "A")]["changed_words"] == 1 and rows["1-2", ("T", "B")]["changed_words"] == 0
    assert rows["1-2", ("T", "D")]["score"] == 5 * 2.0 * 3.0
    for pair in ("1-2", "2-3"):
        anchors = [r["anchor"] for (p, _), r in rows.items() if p == pair]
        assert len(anchors) == len(set(anchors))


def test_moves(compared):
    assert [(r["pair"], r["old_key"], r["new_key"], r["how"]) for r in compared[2].moves.collect()] == [("1-2", "100:1", "201:1", "verbatim")]


def test_origins_go_through_moves_and_edits(compared):
    p, _, c = compared
    got = {r["key"]: (r["first_fy"], r["edited_fy"], r["edit"], r["moved_fy"]) for r in hs.paragraph_origins(c.paragraphs, c.moves, p.select("pair", "old_fy", "new_fy")).collect()}
    assert got["301:1"] == (1, None, None, 2)
    assert got["300:0"] == (1, 2, "minor", None)
    assert got["301:0"] == (1, None, None, None)
    assert got["302:0"][1:3] == (3, "substantive")


def test_compared_with_itself_nothing_changes(spark):
    p, s = editions(spark, {1: [(["T", "A"], [LAMPS]), (["T", "A"], [FERRY])], 2: [(["T", "A"], [LAMPS]), (["T", "A"], [FERRY])]})
    c = cp.compare(p, s)
    assert {r["change"] for r in c.sections.collect()} == {"unchanged"} and c.moves.count() == 0 and c.related.count() == 0


def test_stitching_over_a_gap_and_not_over_strangers(spark):
    rows = [
        ("h", 1, 1, 101, ["T", "A"], LAMPS), ("h", 3, 3, 103, ["T", "A"], LAMPS + " Also buoys."),  # returns after a year
        ("h", 5, 1, 105, ["T", "X"], "Rail tunnels get new lamps and drains along all their length this year."), ("h", 7, 2, 107, ["T", "Y"], FERRY),
        ("h", 9, 1, 109, ["T", "K"], "stays"), ("h", 9, 2, 110, ["T", "K"], "stays"), ("h", 9, 3, 111, ["T", "K"], "stays"),
    ]
    cells = spark.createDataFrame([(*r[:5], [(r[5], "narrative", None)]) for r in rows], f"slug string, thread long, fy int, section_id long, path array<string>, paragraphs {PARA}")
    e = spark.createDataFrame([("h", y) for y in (1, 2, 3)], "slug string, fy int")
    members, links = hs.stitch(cells, e, ["slug"])
    assert {r["section_id"]: r["thread"] for r in members.collect()} == {101: 1, 103: 1, 105: 5, 107: 7, 109: 9, 110: 9, 111: 9}
    assert [tuple(r) for r in links.collect()] == [(1, 3, "returned", 3)]


def test_stitching_goes_on_until_nothing_joins(spark):
    """A section that comes and goes every other year: each round joins what the one before made whole."""
    years = range(1, 29)
    rows = [("h", y, y, 100 + y, ["T", "A"], [(LAMPS, "narrative", None)]) for y in years if y % 2]
    rows += [("h", 1000, y, 1000 + y, ["T", "K"], [("stays", "narrative", None)]) for y in years]
    cells = spark.createDataFrame(rows, f"slug string, thread long, fy int, section_id long, path array<string>, paragraphs {PARA}")
    members, links = hs.stitch(cells, spark.createDataFrame([("h", y) for y in years], "slug string, fy int"), ["slug"])
    assert {r["thread"] for r in members.collect()} == {1, 1000} and links.count() == 13


@pytest.fixture(scope="module")
def chained(spark):
    """Four years: A loses its text to a new name in year 2 under another title, B skips year 3, a provision's number is given anew, an account has a sub-head."""
    years = {
        1: [(["T", "A"], [LAMPS]), (["T", "B"], [FERRY]), (["T", "SEC 1"], ["Sec. 1. None of the funds may be used to paint bridges in any colour but grey."]), (["T", "D"], ["Stays as it is."])],
        2: [(["U", "Z"], [LAMPS]), (["T", "B"], [FERRY]), (["T", "SEC 1"], ["Sec. 1. Fees that the keepers collect stay with the lighthouse until spent."]), (["T", "D"], ["Stays as it is."])],
        3: [(["U", "Z"], [LAMPS]), (["T", "SEC 1"], ["Sec. 1. Fees that the keepers collect stay with the lighthouse until spent."]), (["T", "D"], ["Stays as it is."])],
        4: [(["U", "Z"], [LAMPS]), (["T", "B"], [FERRY]), (["T", "SEC 1"], ["Sec. 1. Fees that the keepers collect stay with the lighthouse until spent."]), (["T", "D"], ["Stays, and shall grow."])],
    }
    p, s = editions(spark, years)
    e = spark.createDataFrame([("house", "harbors", y, f"p{y}") for y in years], "chamber string, slug string, fy int, package_id string")
    c = cp.compare(p, s)
    t = hs.follow(c, s, e, p)
    return s, c, t, hs.account_rows(t.members, s, hs.thread_scores(c, t.members))


def test_cells_of_stitched_threads(chained):
    _, _, t, _ = chained
    assert {(r["dead"], r["born"], r["kind"], r["fy"]) for r in t.links.collect()} == {(100, 200, "reorganized", 2), (101, 401, "returned", 4)}
    got = {}
    for r in t.cells.collect():
        got.setdefault(r["thread"], {})[r["fy"]] = r["label"]
    assert got[100] == {2: "reorganized", 3: "unchanged", 4: "unchanged"}
    assert got[101] == {2: "unchanged", 3: "dropped", 4: "returned"}
    assert got[102] == {2: "dropped"} and got[202] == {2: "new", 3: "unchanged", 4: "unchanged"}
    assert got[103] == {2: "unchanged", 3: "unchanged", 4: "substantive"}


def test_rows_keys_cells_and_heat(chained):
    s, _, t, rows = chained
    by = {r["row_key"]: r for r in rows.collect()}
    assert set(by) == {"U > Z", "T > B", "T > SEC 1 > B1", "T > SEC 1 > B2", "T > D"}
    assert by["U > Z"]["formerly"] == "A (FY1)" and by["T > B"]["formerly"] is None
    cells = {(r["row_key"], r["fy"]): r["label"] for r in hs.row_cells(rows, t.cells).collect()}
    assert cells["U > Z", 2] == "reorganized" and cells["T > B", 4] == "returned" and cells["T > D", 4] == "substantive"
    heat = {r["fy"]: (r["words"], r["heat"]) for r in hs.transition_heat(t.cells).collect()}
    assert max(h for _, h in heat.values()) == 100 and min(h for _, h in heat.values()) >= 4
    of = dict(map(tuple, hs.section_rows(rows, t.members).collect()))
    assert of[102] == "T > SEC 1 > B1" and of[202] == of[301] == "T > SEC 1 > B2" and of[100] == of[400] == "U > Z" and len(of) == s.count()


def test_sub_heads_belong_to_their_account_and_equal_numbers_get_ordinals(spark):
    m = spark.createDataFrame([("h", "x", 2, k, k) for k in (1, 2, 3, 4)], "chamber string, slug string, fy int, section_id long, thread long")
    s = spark.createDataFrame([(1, ["T", "A"], "A", 3), (2, ["T", "A", "Mission"], "Mission", 4), (3, ["T", "SEC 9"], "s", 4), (4, ["T", "SEC 9"], "s", 4)], "section_id long, path array<string>, heading string, level int")
    scores = spark.createDataFrame([(1, 5.0), (2, 1.0), (3, 1.0), (4, 2.0)], "thread long, score double")
    got = {r["row_key"]: (r["members"], r["score"]) for r in hs.account_rows(m, s, scores).collect()}
    assert got == {"T > A": (2, 6.0), "T > SEC 9 > B2": (1, 2.0), "T > SEC 9 > B2.1": (1, 1.0)}


def test_labels_of_origins(spark):
    rows = [(1, 1, None, None, None, None), (2, 1, None, None, None, None), (2, 1, 2, "minor", None, None), (2, 1, 3, "numbers only", 4, "Old"), (1, 1, 5, "substantive", None, None)]
    df = spark.createDataFrame(rows, "f int, s int, e int, c string, m int, h string")
    got = [r[0] for r in df.select(hs.origin_label(*[df[c] for c in "fsecmh"])).collect()]
    assert got == ["unchanged since FY1", "added FY2", "added FY2", "added FY2; figures updated FY3; moved from Old (FY4)", "revised FY5"]


@pytest.fixture(scope="module")
def renamed_folder(spark, tmp_path_factory):
    """One series of three years whose second year calls the lamps' section otherwise and puts another text under SEC 1."""
    from datetime import datetime

    d = str(tmp_path_factory.mktemp("renamed"))
    sec = lambda n, text: (["T", "GENERAL", f"SEC {n}"], [f"Sec. {n}. {text}"])
    old, other = "None of the funds may be used to paint bridges in any colour but grey.", "Fees that keepers collect stay with the lighthouse until they are spent."
    years = {
        2007: [(["T", "HARBOR LAMPS"], [LAMPS]), sec(1, old)],
        2008: [(["T", "LIGHTS OF HARBORS"], [LAMPS.replace("winter", "autumn")]), sec(1, other)],
        2009: [(["T", "LIGHTS OF HARBORS"], [LAMPS.replace("winter", "autumn")]), sec(1, other)],
    }
    _, s = editions(spark, years)
    at = datetime(2024, 1, 1)
    from pyspark.sql import functions as F

    s.withColumn("table_spans", F.lit(0)).withColumn("loaded_at", F.lit(at)).write.parquet(f"{d}/sections.parquet")
    spark.createDataFrame([(f"p{y}", "House", "Harbors", y, "Harbors") for y in years], "package_id string, chamber string, subcommittee string, fiscal_year int, title string").write.parquet(f"{d}/reports.parquet")
    return d


def test_threads_follow_renames_and_leave_reused_numbers(spark, renamed_folder):
    from editrail.plans import catalogue as cat

    heads = {r["section_id"]: r["thread"] for r in cat.thread_ids(spark, renamed_folder).collect()}
    assert heads[200800] == heads[200900] == 200700
    assert heads[200901] == heads[200801] == 200801 and heads.get(200701, 200701) == 200701
    runs = {(r["thread"], r["heading"]): (r["first_fy"], r["last_fy"]) for r in cat.name_runs(spark, renamed_folder).collect()}
    assert runs[200700, "HARBOR LAMPS"] == (2007, 2007) and runs[200700, "LIGHTS OF HARBORS"] == (2008, 2009)
    origins = {r["thread"]: (r["added_fy"], r["edited_fy"]) for r in cat.provenance(spark, renamed_folder).collect()}
    assert origins == {200700: (2007, 2008), 200701: (2007, None), 200801: (2008, None)}


def test_every_table_of_a_comparison_covers_all_passes(spark, renamed_folder):
    from editrail.plans import catalogue as cat

    pair = "House-harbors-fy2007-fy2008"
    here = lambda q: q(spark, renamed_folder).where(f"pair = '{pair}'")
    # the renamed lamps are one edited section; the number that went to another text is one dropped and one new
    assert {(r["old_id"], r["new_id"], r["change"]) for r in here(cat.section_class).collect()} == {(200700, 200800, "minor")}
    assert {r["change"]: r["n"] for r in here(cat.change_counts).collect()} == {"minor": 1, "dropped": 1, "new": 1}
    assert tuple(here(cat.index_page).first()) == (pair, 1, 1, 1)
    assert {(r["old_id"], r["new_id"]) for r in here(cat.document_order).collect()} == {(200700, 200800), (200701, None), (None, 200801)}
    assert {(r["old_id"], r["new_id"], r["change"]) for r in here(cat.significance).collect()} == {(200700, 200800, "minor"), (200701, None, "dropped"), (None, 200801, "new")}
    assert {(r["section_id"], r["change"]) for r in here(cat.new_section_scores).collect()} == {(200701, "dropped"), (200801, "new")}


def test_moves_start_and_end_inside_matched_sections(spark, tmp_path):
    from datetime import datetime

    from pyspark.sql import functions as F

    from editrail.plans import catalogue as cat

    d = str(tmp_path)
    years = {2007: [(["T", "A"], [LAMPS, FERRY]), (["T", "B"], ["One line stays."])], 2008: [(["T", "A"], [LAMPS]), (["T", "B"], ["One line stays.", FERRY])]}
    _, s = editions(spark, years)
    s.withColumn("table_spans", F.lit(0)).withColumn("loaded_at", F.lit(datetime(2024, 1, 1))).write.parquet(f"{d}/sections.parquet")
    spark.createDataFrame([(f"p{y}", "House", "Harbors", y, "Harbors") for y in years], "package_id string, chamber string, subcommittee string, fiscal_year int, title string").write.parquet(f"{d}/reports.parquet")
    assert [tuple(r)[1:] for r in cat.moves_verbatim(spark, d).collect()] == [("200700:1", "200801:1")]
