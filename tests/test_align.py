from editrail.operators import align as al
from editrail.operators import chain as ch


def sections(spark, specs):
    rows = [("p", i, path, seq, seq, [(t, "narrative", None) for t in text.split("\n")]) for seq, (i, path, text) in enumerate(specs)]
    return spark.createDataFrame(rows, "pair string, section_id long, path array<string>, seq int, sort_order int, paragraphs array<struct<text:string,kind:string,topic:string>>")


def test_cascade(spark):
    body = "The account keeps the harbor lamps burning and the locks greased through the winter, and pays the two keepers."
    other = "Ferries leave twice a day from the eastern pier with mail, grain and passengers for the islands of the strait."
    old = sections(spark, [(1, ["T", "A"], body), (2, ["T", "A", "X"], "one"), (3, ["T", "A", "X"], "two"), (4, ["T", "LAMP FUND"], body), (5, ["T", "B", "OLD NAME"], other), (6, ["T", "GONE"], "nothing of it stays")])
    new = sections(spark, [(11, ["T", "A"], body), (12, ["T", "A", "X"], "one"), (13, ["T", "A", "X"], "two"), (14, ["U", "LAMP FUND"], body), (15, ["T", "B", "NEW TITLE"], other + " Also on feast days."), (16, ["T", "FRESH"], "quite another matter")])
    matched, traced, _ = al.align(old, new)
    got = {(r["old_id"], r["new_id"]): r["match_pass"] for r in matched.collect()}
    assert got[1, 11] == got[2, 12] == got[3, 13] == "exact" and got[4, 14] == "unique_heading" and got[5, 15] == "content_parent"
    assert len(got) == 5 and {"score", "accepted"} <= set(traced.columns)
    left = al.left_over(old, matched, "old_id").collect()
    assert [r["section_id"] for r in left] == [6]


def test_compared_with_itself_all_is_exact(spark):
    a = sections(spark, [(1, ["T"], "a"), (2, ["T", "SEC 101"], "Section 101. The Committee continues a provision on boats."), (3, ["T"], "a")])
    matched, _, _ = al.align(a, a)
    assert {(r["old_id"], r["new_id"], r["match_pass"]) for r in matched.collect()} == {(1, 1, "exact"), (2, 2, "exact"), (3, 3, "exact")}


def test_renumbered_provisions_follow_their_text(spark):
    x = "Section {}. The Committee continues a provision on the sale of surplus ferry tickets to visiting crews at the pier."
    y = "Section {}. The Committee continues a provision on the burial of veterans in the northern grounds at no cost to kin."
    old = sections(spark, [(1, ["T", "SEC 101"], x.format(101)), (2, ["T", "SEC 102"], y.format(102))])
    new = sections(spark, [(11, ["T", "SEC 101"], y.format(101)), (12, ["T", "SEC 102"], x.format(102))])
    matched, _, _ = al.align(old, new)
    assert {(r["old_id"], r["new_id"]) for r in matched.collect()} == {(1, 12), (2, 11)}


def test_greedy_equals_a_plain_loop(spark):
    import random

    rng = random.Random(6)
    rows = [("p", b, o, n, float(rng.randint(60, 100)), n, o) for b in "xy" for o in range(12) for n in range(12) if rng.random() < 0.5]
    df = spark.createDataFrame(rows, "pair string, block string, old_id long, new_id long, score double, new_rank long, old_rank long")
    got = {(r["block"], r["old_id"], r["new_id"]) for r in al.take_greedily(df, ["pair", "block"], 70).collect()}
    want = set()
    for b in "xy":
        gone_o, gone_n = set(), set()
        for _, _, o, n, s, _, _ in sorted((r for r in rows if r[1] == b and r[4] >= 70), key=lambda r: (-r[4], r[5], r[6])):
            if o not in gone_o and n not in gone_n:
                want.add((b, o, n))
                gone_o.add(o)
                gone_n.add(n)
    assert got == want


def test_rename_of_mutual_best(spark):
    body = "Ferries leave twice a day from the eastern pier with mail, grain and passengers for the islands of the strait. " * 3
    old, new = sections(spark, [(1, ["T", "B", "OLD NAME"], body)]), sections(spark, [(11, ["T", "B", "OTHER"], body + " Also on feast days."), (12, ["T", "B", "Z"], "short")])
    nothing = spark.createDataFrame([], "pair string, old_id long, new_id long")
    best = al.best_counterparts(al.scored_pairs(old, new), nothing)
    paths = spark.createDataFrame([], "pair string, old_path array<string>, new_path array<string>")
    assert [(r["old_id"], r["new_id"]) for r in al.promote_renames(best, paths).collect()] == [(1, 11)]
    assert {(r["section_id"], r["other_id"]) for r in al.related(best).collect()} >= {(1, 11), (11, 1)}


def test_threads_runs_spans_and_order(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (10, 11)], "old_id long, new_id long")
    assert dict(map(tuple, ch.thread_heads(links).collect())) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10}
    assert ch.thread_heads(links.where("false")).count() == 0
    r = spark.createDataFrame([("t", y, h) for y, h in enumerate(["a", "a", None, None, "a"])], "t string, y int, h string")
    assert sorted((x["first"], x["last"], x["h"]) for x in ch.runs(r, ["t"], "y", "h").collect()) == [(0, 1, "a"), (2, 3, None), (4, 4, "a")]
    s = spark.createDataFrame([("d", 1, 4), ("d", 2, 3), ("d", 4, 6), ("d", 8, 9), ("e", 1, 1)], "d string, a int, b int")
    assert sorted(map(tuple, ch.merge_spans(s, ["d"], "a", "b").collect())) == [("d", 1, 6), ("d", 8, 9), ("e", 1, 1)]
    o = spark.createDataFrame([("p", 0, 0), ("p", 1, None), ("p", 2, 1), ("p", None, 2)], "p string, old_seq int, new_seq int")
    placed = {(r["old_seq"], r["new_seq"]): (r["place_new"], r["place_old"]) for r in ch.document_order(o, ["p"]).collect()}
    assert placed == {(0, 0): (0, -1), (1, None): (0, 1), (2, 1): (1, -1), (None, 2): (2, -1)}
    lab = spark.createDataFrame([(["dropped", "reorganized"],), (["new", "returned"],), (["minor", "new"],), (["unchanged", "minor"],)], "l array<string>")
    assert [r[0] for r in lab.select(ch.row_label(lab["l"])).collect()] == ["reorganized", "returned", "new", "minor"]


LOOSE = "pair string, section long, key string, ord long, text string, topic string, kind string"


def test_moves(spark):
    t = "a plan for the northern harbor with lamps and two keepers through the long winter months"
    gone = spark.createDataFrame([("p", 1, "1:0", 1000, "same text", None, "narrative"), ("p", 2, "2:0", 2000, t, None, "narrative")], LOOSE)
    come = spark.createDataFrame([("p", 9, "9:0", 9000, "same text", None, "narrative"), ("p", 8, "8:0", 8000, t + " ahead", None, "narrative")], LOOSE)
    assert [(r["old_key"], r["new_key"]) for r in ch.moved_verbatim(gone, come, ["pair"]).collect()] == [("1:0", "9:0")]
    assert [(r["old_key"], r["new_key"]) for r in ch.moved_nearly(gone, come, ["pair"]).collect()] == [("2:0", "8:0")]


def test_moves_of_one_topic_are_consumed_in_new_order(spark):
    import difflib
    import random

    rng = random.Random(3)
    base = "The office shall keep the lamps of the northern harbor lit through the winter and pay its keepers in full".split()
    text = lambda: " ".join(w for w in base if rng.random() < 0.8) + "".join(f" w{rng.randint(0, 9)}" for _ in range(6))
    olds = [("p", k, f"o{k}", k, text(), rng.choice(["Lamps", "lamps", "Oil"]), "directive") for k in range(8)]
    news = [("p", 50 + k, f"n{k}", k, text(), rng.choice(["LAMPS", "oil", None]), "directive") for k in range(9)]
    got = {(r["old_key"], r["new_key"]) for r in ch.moved_same_topic(spark.createDataFrame(olds, LOOSE), spark.createDataFrame(news, LOOSE), ["pair"]).collect()}
    left, want = list(olds), set()
    for n in news:
        best, bar = None, 0.5
        for o in left:
            if n[5] and o[5].lower() == n[5].lower():
                r = difflib.SequenceMatcher(None, o[4], n[4], autojunk=False).ratio()
                if r > bar:
                    best, bar = o, r
        if best:
            left.remove(best)
            want.add((best[2], n[2]))
    assert got == want and len(got) > 4


def test_near_moves_equal_all_pairs(spark):
    """No pair over the bar is lost, though none of its words need be rare, or even the same."""
    import random

    from editrail.functions.similarity import indel_ratio

    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "klmn" for b in "aeio" for c in "rst"]

    def variant(t):
        chars = list(t)
        for _ in range(rng.randint(0, 25)):
            k = rng.randrange(len(chars))
            chars[k] = rng.choice("0123456789 ")
        return "".join(chars)

    olds = [("p", k, f"o{k}", k, " ".join(rng.choice(words) for _ in range(rng.randint(14, 40))), None, "n") for k in range(40)]
    news = [("p", 100 + k, f"n{k}", k, variant(rng.choice(olds)[4]), None, "n") for k in range(40)] + [("q", 7, "other", 1, olds[0][4], None, "n"), ("p", 3, "same", 99, olds[3][4], None, "n")]
    got = {(r["old_key"], r["new_key"]) for r in ch.moved_nearly(spark.createDataFrame(olds, LOOSE), spark.createDataFrame(news, LOOSE), ["pair"]).collect()}
    score = {}
    for o in olds:
        for n in news:
            a, b = o[4], n[4]
            if o[0] == n[0] and min(len(a.split()), len(b.split())) >= 12 and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and indel_ratio(a, b) >= 85:
                score[o[2], n[2]] = indel_ratio(a, b)
    first = lambda key, own: min((k for k in score if k[own] == key[own]), key=lambda k: (-score[k], int(k[1 - own].strip("onsame") or 99)))
    home = {x[2]: x[1] for x in olds + news}
    want = {k for k in score if first(k, 0) == k and first(k, 1) == k and home[k[0]] != home[k[1]]}
    assert got == want and len(got) > 10


def test_whole_texts_are_compared_beyond_their_first_characters(spark):
    lead, far = "The office keeps the lamps and locks in order. " * 50, "Ferries leave twice a day with mail and grain. " * 50
    other = "Quarries yield slate, lime, jasper, zinc, quartz, onyx. " * 50
    old, new = sections(spark, [(1, ["T", "B", "OLD NAME"], lead + far)]), sections(spark, [(11, ["T", "B", "ZZZ"], lead + other)])
    score = lambda whole, o=old, n=new: [r["similar"] for r in al.scored_pairs(o, n, whole).collect()]
    assert score(False) == [100.0] and all(s < 80 for s in score(True))
    one, two = ([(k, ["T", f"SEC {k}"], f"Section {k}. The Committee continues a provision on boats.\n" + t)] for k, t in ((5, far), (6, other)))
    old, new = sections(spark, one), sections(spark, two)
    assert score(False, old, new) == [100.0] and all(s < 80 for s in score(True, old, new))
