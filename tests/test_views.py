from pyspark.sql import functions as F

from editrail.plans import evaluate as ev
from editrail.plans import views as vw


def test_redline_escapes_and_marks(spark):
    from editrail.functions import similarity as sim

    df = spark.createDataFrame([("a < b stays", "a < c & stays on")], "o string, n string")
    assert df.select(vw.redline(sim.edits("o", "n"))).first()[0] == "a &lt; <del>b</del> <ins>c &amp;</ins> stays <ins>on</ins>"


def test_outline_reuses_only_the_latest_sibling(spark):
    rows = [("p", k, k, path) for k, path in enumerate([["T"], ["T", "A"], ["T", "A", "x"], ["T", "A", "y"], ["T", "B"], ["T", "A"]])]
    s = spark.createDataFrame(rows, "package_id string, section_id long, seq int, path array<string>")
    got = sorted((r["depth"], r["first_seq"], tuple(r["prefix"]), r["sections"]) for r in vw.outline(s).collect())
    assert got == [(1, 0, ("T",), 6), (2, 1, ("T", "A"), 3), (2, 4, ("T", "B"), 1), (2, 5, ("T", "A"), 1), (3, 2, ("T", "A", "x"), 1), (3, 3, ("T", "A", "y"), 1)]


def test_unchanged_paragraphs_collapse(spark):
    rows = [("p", 1, 2, k, c) for k, c in enumerate(["unchanged", "unchanged", "minor", "unchanged", "new", "new"])]
    d = spark.createDataFrame(rows, "pair string, old_id long, new_id long, idx int, change string")
    assert sorted((r["first"], r["last"], r["change"]) for r in vw.collapsed(d).collect()) == [(0, 1, "unchanged"), (2, 2, "minor"), (3, 3, "unchanged"), (4, 4, "new"), (5, 5, "new")]


def test_page_escapes():
    assert "<td>&lt;b&gt;</td><td></td>" in vw.page("t", [{"a": "<b>", "c": None}], ["a", "c"])


def test_labels_find_their_candidate_by_text(spark):
    t = "The account keeps the harbor lamps burning through the winter."
    cols = "id long, slug string, old_heading string, new_heading string, old_text string, new_text string"
    labels = spark.createDataFrame([(1, "s", "Lamps", "LAMPS 2024", t, t), (2, "s", "Lamps", "Other", t, t)], cols)
    cands = spark.createDataFrame([(7, "s", "LAMPS", "Lamps 2025", t + " ", t), (8, "s", "LAMPS", "Lamps 2025", "something else", t)], cols)
    assert dict(map(tuple, ev.label_matches(labels, cands).collect())) == {1: 7, 2: None}


def test_years_of_a_timeline_are_those_present(spark):
    c = spark.createDataFrame([("h", "x", "A", y, "new") for y in (1999, 2010, 2030)] + [("h", "x", "A", 2010, "unchanged")], "chamber string, slug string, heading string, fy int, change string")
    assert vw.timeline(c).first().asDict() == {"chamber": "h", "slug": "x", "heading": "A", "fy1999": 1, "fy2010": 1, "fy2030": 1}


def test_display_headings(spark):
    rows = ["OFFICE OF THE R&D AND II--GENERAL", "Mixed stays", "THE ISLES (OIS) XI", None, "", "ÉTÉ OF X"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "h string").select(vw.display_heading(F.col("h"))).collect()]
    assert got[:2] == ["Office of the R&D and II--General", "Mixed stays"] and got[2] == "The Isles (Ois) Xi" and got[3] is None and got[4] == ""


def test_links_between_pages(spark):
    page = '<a href="index.html#s-1">a</a><a href="document.html">b</a><a href="https://x/index.html">c</a>'
    got = spark.createDataFrame([(page,)], "p string").select(vw.rewrite_links(F.col("p"), {"index.html": "ranked", "document.html": "whole"})).first()[0]
    assert got == '<a href="#s-1" data-view="ranked">a</a><a href="" data-view="whole">b</a><a href="https://x/index.html">c</a>'


def test_filters_of_a_page(spark):
    s = spark.createDataFrame([("p", 1, 2, "unchanged", True), ("p", 3, 4, "numbers only", False), ("p", 5, 6, "substantive", False), ("p", 7, 8, "minor", True)], "pair string, old_id long, new_id long, change string, directive boolean")
    d = spark.createDataFrame([("p", 5, 6, "narrative", [(2,)]), ("p", 7, 8, "narrative", [(1,)]), ("p", 3, 4, "directive", [])], "pair string, old_id long, new_id long, kind string, flags array<struct<tier:int>>")
    shown = lambda **k: sorted(r["new_id"] for r in vw.shown_sections(s, d, **k).collect())
    assert shown() == [4, 6, 8] and shown(hide_unchanged=False) == [2, 4, 6, 8] and shown(hide_numbers=True) == [6, 8]
    assert shown(directives_only=True) == [4, 8] and shown(flagged_only=True) == [6]


def test_manifest_counts_review_flags(spark):
    import json

    pairs = spark.createDataFrame([("p", "a", "b"), ("q", "b", "c")], "pair string, old_package string, new_package string")
    index = spark.createDataFrame([("p", 3, 1, 2)], "pair string, changed long, new long, dropped long")
    flags = spark.createDataFrame([("p", 1), ("p", 2), ("p", 2)], "pair string, tier int")
    reports = spark.createDataFrame([("a", "https://x", "pdf", "00")], "package_id string, url string, read_from string, sha256 string")
    got = {r["pair"]: json.loads(r["json"]) for r in vw.manifest(index, pairs, flags, reports).collect()}
    assert got["p"] == {"pair": "p", "sections": {"changed": 3, "new": 1, "dropped": 2}, "review_flags": 2, "old": {"package_id": "a", "url": "https://x", "read_from": "pdf", "sha256": "00"}}
    assert got["q"]["sections"] == {"changed": 0, "new": 0, "dropped": 0} and got["q"]["review_flags"] == 0


def test_navigation_and_folders(spark):
    p = spark.createDataFrame([("house", "b"), ("house", "a"), ("house", "a"), ("senate", "a")], "chamber string, slug string")
    assert {r["chamber"]: r["subcommittees"] for r in vw.navigation(p).collect()} == {"house": ["a", "b"], "senate": ["a"]}
    assert p.select(vw.thread_folder(F.col("chamber"), F.col("slug"), F.lit(2019), F.lit(2024))).first()[0] == "house-b-threads-fy2019-fy2024"


def test_audits_of_the_tree(spark):
    s = spark.createDataFrame([("p", 1, ["T", "RIVERS", "ROADS", "X"], 3), ("p", 2, ["T", "INCLUDING TRANSFER"], 4), ("p", 3, ["T", "SEC 1"], 4), ("p", 4, ["T", "ROADS", "WEIRS"], 3), ("p", 5, ["T", "WEIRS"], 3)], "package_id string, section_id long, path array<string>, level int")
    names = spark.createDataFrame([("RIVERS",), ("ROADS",)], "name string")
    assert {(r["path"], r["finding"]) for r in ev.nested_findings(s, names).collect()} == {("T > RIVERS > ROADS > X", "nested_agency"), ("T > INCLUDING TRANSFER", "annotation")}
    accounts = spark.createDataFrame([("Weirs, Rivers", "Rivers"), ("Lamps", "Rivers"), ("Lamps", "Roads"), (None, "Roads")], "title string, agency string")
    truth = ev.account_truth(accounts)
    assert {tuple(r) for r in truth.collect()} == {("WEIRS RIVERS", "RIVERS"), ("WEIRS", "RIVERS")}
    assert {r["section_id"]: r["finding"] for r in ev.misparented(s, truth, names).collect()} == {4: "misparented", 5: "orphaned"}


def test_leads_inside_tables(spark):
    table = "-" * 60 + "\n    Oil.--The office buys oil.   1,200   1,300\n" + "-" * 60
    docs = spark.createDataFrame([(1, "    Lamps.--The office lights them.\n\n" + table + "\n\n    Section 12 stays."), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in ev.swallowed_leads(docs, "doc_id", "text").collect()] == [(1, 3, 1, True)]
