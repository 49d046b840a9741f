import random

from hypothesis import given
from hypothesis import strategies as st

from editrail.functions import similarity as sim

words = st.lists(st.sampled_from(["the", "may", "shall", "not", "fund", "$5", "90", "days"]), max_size=25).map(" ".join)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(st.text("abcdé", max_size=80), st.text("abcdé", max_size=80))
def test_lcs_equals_the_quadratic_table(a, b):
    assert sim.lcs_length(a, b) == lcs(a, b)
    assert sim.indel_ratio(a, b) == sim.indel_ratio(b, a)


@given(words, words)
def test_edits_rebuild_both_texts(a, b):
    e = sim.word_edits(a, b)
    assert " ".join(w for _, o, _ in e for w in o) == " ".join(a.split()) and " ".join(w for _, _, n in e for w in n) == " ".join(b.split())
    assert (sim.changed_words(e) == 0) == (a.split() == b.split())
    assert sim.blocks_ratio(a.split(), b.split()) <= sim.bag_ratio(a.split(), b.split()) + 1e-12


@given(words, words)
def test_token_ratios(a, b):
    s = sim.token_set_ratio(a, b)
    assert 0 <= s <= 100 + 1e-9 and abs(s - sim.token_set_ratio(b, a)) < 1e-9
    shuffled = a.split()
    random.Random(1).shuffle(shuffled)
    assert sim.token_sort_ratio(a, " ".join(shuffled)) == 100
    if a.split() and set(a.split()) <= set(b.split()):
        assert s == 100


def test_hand_worked():
    assert sim.indel_ratio("abcd", "abxd") == 75
    assert sim.token_set_ratio("", "a") == 0
    assert sim.word_edits("may not exceed", "may exceed") == [("equal", ["may"], ["may"]), ("delete", ["not"], []), ("equal", ["exceed"], ["exceed"])]


def test_udfs(spark):
    df = spark.createDataFrame([("abcd", "abxd"), (None, "x"), ("", "")], "a string, b string")
    rows = df.select(sim.indel("a", "b").alias("i"), sim.edited_words(sim.edits("a", "b")).alias("w")).collect()
    assert [r["i"] for r in rows] == [75.0, None, 100.0] and rows[0]["w"] == 1


def test_lanes_and_alike_equal_one_by_one():
    import random

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé😀 x") for _ in range(rng.randint(0, 6))) for _ in range(30)]
    a = list({" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(70)})
    b = list({" ".join(w if rng.random() < 0.95 else "q" for w in rng.choice(a).split(" ")) for _ in range(60)} | {""})
    for y in b:
        assert sim.Lanes(a).lcs_lengths(y) == [sim.lcs_length(x, y) for x in a]
    for least in (60.0, 90.0):
        want = sorted((x, y, sim.indel_ratio(x, y)) for x in a for y in b if sim.indel_ratio(x, y) >= least)
        assert want and sorted(sim.alike(a, b, least)) == sorted((x, y, r) for y, x, r in sim.alike(b, a, least)) == want
    assert sim.alike([], b, 60.0) == sim.alike(a, [], 60.0) == []
