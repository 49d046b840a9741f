import pytest

from editrail.operators import diff as d


@pytest.mark.parametrize(
    "old,new,change",
    [
        ("It provides $5,000 in 2024.", "It provides $5,000 in 2024.", "unchanged"),
        ("It provides $5,000 by May 3, 2024.", "It provides $7,500 by May 12, 2025.", "numbers only"),
        ("The office keeps a small harbor.", "The office keeps a tiny harbor.", "minor"),
        ("The office keeps a small harbor in the north of the island.", "Rail tunnels receive new lamps and drains along all their length.", "substantive"),
        ("The agency may open a depot.", "The agency shall open a depot.", "substantive"),
        ("Funds may be used for tolls.", "Funds may not be used for tolls.", "substantive"),
        ("A plan is due within 90 days of the act.", "A plan is due 90 days after the act.", "substantive"),
        ("Spend up to $20 on oars.", "Spend $20 on oars.", "substantive"),
    ],
)
def test_classes(old, new, change):
    assert d.diff_texts(old, new)["change"] == change


def test_figures_of_a_limit_are_more_than_numbers():
    out = d.diff_texts("Not less than $4,000 for sails.", "Not less than $6,000 for sails.")
    assert out["literal"] == "numbers only" and out["change"] == "substantive" and [f["category"] for f in out["flags"]] == ["limit"]


def test_masks_in_their_order():
    assert d.masked("On September 30, 2027 and in September 2027, $1,900,000.") == "On #D and in #DY, #."


def para(text, kind="narrative", topic=None):
    return {"text": text, "kind": kind, "topic": topic}


def test_pairing_by_topic_then_likeness():
    olds = [para("Dredging.--The old text of it.", "directive", "Dredging"), para("alpha beta gamma delta"), para("nothing like it at all")]
    news = [para("epsilon zeta"), para("alpha beta gamma epsilon"), para("Dredging.--Quite new wording.", "directive", "Dredging")]
    # the topic is the only common key; what stands before and after it has no counterpart there
    assert d.pair_paragraphs(olds, news) == [(None, 0), (None, 1), (0, 2), (1, None), (2, None)]
    assert d.pair_paragraphs(olds[1:], news[:2]) == [(0, 1), (1, None), (None, 0)]
    assert d.pair_paragraphs(olds, olds) == [(0, 0), (1, 1), (2, 2)]
    assert d.pair_paragraphs([para("Levees.--a b", "directive", "Levees")], [para("Kilns.--c d", "directive", "Kilns")]) == [(0, None), (None, 0)]


def test_paragraph_and_section_diffs(spark):
    t = "array<struct<text:string,kind:string,topic:string>>"
    rows = [
        ("p", 1, 2, [("same", "narrative", None)], [("same", "narrative", None)]),
        ("p", 3, 4, [("Boats may go out", "narrative", None)], [("Boats shall go out", "narrative", None), ("Not later than 5 days, submit a report.", "narrative", None)]),
        ("p", 5, 6, None, [(None, "narrative", None)]),
    ]
    df = spark.createDataFrame(rows, f"pair string, old_id long, new_id long, old_paragraphs {t}, new_paragraphs {t}").selectExpr("*", "1 AS change", "1 AS year_delta")
    diffs = d.paragraph_diffs(df)
    got = {r["new_id"]: (r["change"], r["changed_words"]) for r in d.section_diffs(diffs).collect()}
    assert got == {2: ("unchanged", 0), 4: ("substantive", 9), 6: ("substantive", 0)}
    tags = {(r["new_id"], r["idx"]): r["tags"] for r in diffs.collect()}
    assert tags == {(2, 0): [], (4, 0): [], (4, 1): ["reporting requirement", "deadline"], (6, 0): []}
    flags = [(r["new_id"], r["category"], r["tier"], r["before"]["mid"], r["after"]["mid"]) for r in d.policy_flags(diffs).collect()]
    assert flags == [(4, "discretion", 2, "may", "shall")]
    assert d.paragraph_diffs(df.where("false")).count() == 0
