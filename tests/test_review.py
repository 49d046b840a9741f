import pytest

from editrail.plans import review as rv

RAW = """<pre>
                              WEIRS

    The office keeps four weirs on
the upper river in good order.
    Too short.
Appropriations, 2024...............  1,200
    Gate Repairs.--The Committee directs the office to
mend all gates of the northern weir.
                 ROADS
    The office keeps four roads on the lower river.
</pre>"""


def test_reference_paragraphs(spark):
    docs = spark.createDataFrame([(1, RAW), (2, None), (3, "")], "doc_id long, text string")
    got = [(r["doc_id"], r["idx"], r["heading"], r["text"]) for r in rv.reference_paragraphs(docs, "doc_id", "text").orderBy("idx").collect()]
    assert got == [
        (1, 0, "WEIRS", "The office keeps four weirs on the upper river in good order."),
        (1, 1, "WEIRS", "Gate Repairs.--The Committee directs the office to mend all gates of the northern weir."),
        (1, 2, "ROADS", "The office keeps four roads on the lower river."),
    ]


def test_close_pairs_equal_all_pairs(spark):
    import random

    from editrail.functions.similarity import indel_ratio

    rng = random.Random(1)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    a, b = [(f"{k % 2}", t) for k, t in enumerate(texts)], [(f"{k % 2}", t) for k, t in enumerate(texts[20:] + texts[:5])]
    for least in (60.0, 90.0):
        got = {(r["s"], r["a"], r["b"]) for r in rv.close_pairs(spark.createDataFrame(a, "s string, a string"), spark.createDataFrame(b, "s string, b string"), ["s"], least).collect()}
        assert got == {(s, x, y) for s, x in a for z, y in b if s == z and indel_ratio(x, y) >= least}


OLD = [(0, "A", "The lamps are lit at dusk by two keepers."), (1, "A", "Boats leave twice a day from the pier."), (2, "B", "Tolls are paid at the gate in coin."), (3, "B", "Nothing of this stays.")]
NEW = [(0, "A", "The lamps are lit at dawn by two keepers."), (1, "C", "boats leave twice a day, from the pier"), (2, "B", "Tolls are paid at the gate in coin."), (3, "B", "A quite new matter altogether here.")]
COLS = "pair string, idx long, heading string, text string"


@pytest.fixture(scope="module")
def units(spark):
    side = lambda rows: spark.createDataFrame([("p", *r) for r in rows], COLS)
    return rv.extract_units(side(OLD), side(NEW), ["pair"])


def test_units(units):
    got = {(r["type"], r["old_idx"], r["new_idx"]): r["changed_words"] for r in units.collect()}
    assert got == {("edited", 0, 0): 1, ("relocated", 1, 1): 3, ("removed", 3, None): None, ("added", None, 3): None}


def test_samples_and_batches(spark):
    rows = [("p", k, "edited" if k % 3 else "added", 2 if k % 2 else 50) for k in range(300)]
    u = spark.createDataFrame(rows, "pair string, unit long, type string, changed_words int")
    got = rv.sample_units(u, ["pair"], "unit", 20).collect()
    small = [r for r in rows if r[2] == "edited" and r[3] <= 12]
    assert len(got) == len(small) + 20 and {r["batch"] for r in got} == set(range(-(-len(got) // 70)))


def view(spark, edits=(), moves=(), added=(), removed=(), old=(), new=()):
    flag = "array<struct<tier:int>>"
    pairs = lambda rows: spark.createDataFrame([("p", *r) for r in rows], f"pair string, ok string, nk string, change string, literal string, flags {flag}")
    keys = lambda ks: spark.createDataFrame([("p", k, "s-1") for k in ks], "pair string, k string, anchor string")
    return {"edits": pairs(edits), "moves": pairs(moves), "added": keys(added), "removed": keys(removed), "old": keys(old), "new": keys(new)}


def test_what_became_of_units(spark):
    a, b, c, d = "the lamps are lit at dusk", "boats leave twice a day", "tolls are paid in coin here", "a wholly new matter of state"
    v = view(spark, edits=[(a, b, "minor", "minor", [(1,)])], moves=[(c, c, "unchanged", "unchanged", [])], added=[d, b + " x"], removed=[d, "gone for good and all"], old=[a, c, d], new=[b, c, d])
    rows = [
        ("u1", "edited", a, b), ("u2", "relocated", c, c), ("u3", "edited", a, d), ("u4", "edited", d, d), ("u5", "added", None, d), ("u6", "removed", "gone for good and all!", None),
        ("u7", "added", None, b.upper()), ("u8", "removed", "never printed anywhere at all", None), ("u9", "edited", "never printed anywhere at all", "nor was this one ever printed"),
    ]
    u = spark.createDataFrame([("p", *r) for r in rows], "pair string, unit string, type string, old_text string, new_text string")
    got = {r["unit"]: (r["status"], r["change"]) for r in rv.locate(u, v).collect()}
    assert got == {
        "u1": ("edited", "minor"), "u2": ("moved", "unchanged"), "u3": ("mispaired", None), "u4": ("split", None), "u5": ("added", None), "u6": ("removed", None),
        "u7": ("added", None), "u8": ("missing", None), "u9": ("missing", None),
    }


LOCATED = "pair string, unit string, new_text string, old_text string, type string, changed_words int, status string, change string, literal string, flags array<struct<tier:int>>, label string, reviewer string, same_passage boolean"


def test_scores_and_packet(spark):
    row = lambda unit, type_, words, status, change, literal, tiers, label, reviewer="draft", same=None: ("p", unit, unit, None, type_, words, status, change, literal, [(t,) for t in tiers], label, reviewer, same)
    rows = [
        row("a", "edited", 3, "edited", "substantive", "minor", [2], "substantive", "kim"), row("b", "edited", 3, "edited", "minor", "minor", [1], "substantive"), row("c", "edited", 40, "edited", "substantive", "substantive", [2], "editorial"),
        row("d", "edited", 2, "edited", "minor", "minor", [], "editorial"), row("e", "relocated", None, "unchanged", None, None, [], "moved"), row("f", "edited", 9, "split", None, None, [], "substantive"),
        row("g", "edited", 9, "mispaired", None, None, [], "substantive", same=False), row("h", "added", None, "added", None, None, [], "out_of_scope"), row("i", "edited", 1, "edited", "substantive", "numbers only", [2], "funding_amount"),
    ]
    d = spark.createDataFrame(rows, LOCATED)
    s = rv.score_units(d).first().asDict()
    assert (s["labelled"], s["adjudicated"], s["substantive"], s["missed"], s["missed_by_size"], s["missed_small"]) == (9, 1, 4, 2, 3, 2)
    assert (s["quiet"], s["false_alarms"], s["false_alarms_by_size"], s["promoted"], s["promoted_right"]) == (2, 1, 1, 3, 1) and s["precision"] == pytest.approx(1 / 3)
    assert (s["disagreements"], s["split"], s["mispaired"], s["moves_not_shown"], s["reference_mispairs"], s["funding"], s["funding_promoted"]) == (1, 1, 0, 1, 1, 1, 1)
    assert rv.score_units(d, {"funding_amount": "substantive"}).first()["substantive"] == 5
    anchors = spark.createDataFrame([("p", "a", "s-9")], "pair string, k string, anchor string")
    got = {r["unit"]: (r["group"][0], r["anchor"]) for r in rv.review_packet(d, anchors).collect()}
    assert got == {"a": ("3", "s-9"), "b": ("1", None), "c": ("2", None), "d": ("4", None), "g": ("1", None)}


def test_labels_migrate_or_are_lost_and_must_be_of_known_units(spark):
    labels = spark.createDataFrame([(1, None, None), (2, "x", None), (3, None, None)], "id long, old_text string, new_text string")
    kept, lost = rv.migrate_labels(labels, spark.createDataFrame([(1, "o", "n"), (2, "other", None)], "id long, old_text string, new_text string"))
    assert {tuple(r) for r in kept.collect()} == {(1, "o", "n"), (2, "x", None)} and [r["id"] for r in lost.collect()] == [3]
    units = spark.createDataFrame([("p", 1)], "pair string, unit long")
    rv.check_units_known(units, units, ["pair"], "unit")
    with pytest.raises(ValueError):
        rv.check_units_known(spark.createDataFrame([("p", 9)], "pair string, unit long"), units, ["pair"], "unit")


def test_two_renderings_agree_in_words(spark):
    a = spark.createDataFrame([(1, "The up-\nstream gates -- all of $1,200.50 -- stay.")], "k long, text string")
    b = spark.createDataFrame([(1, "the up-stream gates all of $1,200.50 leave")], "k long, text string")
    r = rv.render_agreement(a, b, "k").first()
    assert r["words"] == 7 and r["agreement"] == pytest.approx(6 / 7)


def test_close_pairs_over_several_blocks(spark, monkeypatch):
    import random

    from editrail.functions.similarity import indel_ratio

    monkeypatch.setattr(rv, "BLOCK", 7)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    a, b = [("s", t) for t in texts], [("s", t[: len(t) - rng.randint(0, 3)]) for t in texts]
    got = {(r["a"], r["b"]) for r in rv.close_pairs(spark.createDataFrame(a, "s string, a string"), spark.createDataFrame(b, "s string, b string"), ["s"], 90.0).collect()}
    assert got == {(x, y) for _, x in a for _, y in b if indel_ratio(x, y) >= 90}


def test_each_side_of_the_view_meets_the_units_once(spark, monkeypatch):
    """It was ten times: once for every table of the view and side of a unit."""
    calls, plain = [], rv.close_pairs
    monkeypatch.setattr(rv, "close_pairs", lambda *args: calls.append(1) or plain(*args))
    u = spark.createDataFrame([("p", "u", "edited", "the lamps are lit", "the lamps were lit")], "pair string, unit string, type string, old_text string, new_text string")
    got = rv.locate(u, view(spark, edits=[("the lamps are lit", "the lamps were lit", "minor", "minor", [(1,)])], old=["the lamps are lit"], new=["the lamps were lit"]))
    assert [(r["status"], r["change"]) for r in got.collect()] == [("edited", "minor")] and len(calls) == 2
