import datetime as dt
import random
import re
from fractions import Fraction

import numpy as np

from editrail.llm import neardup

T0 = dt.datetime(2024, 1, 1)


def brute(rows, threshold, width):
    last = {}
    for i, at, h, t in rows:
        if i not in last or at > last[i][0]:
            last[i] = (at, h, t)
    sets = {}
    for i, (_, h, t) in last.items():
        w = re.findall("[a-z0-9]+", (h or "").lower()) + re.findall("[a-z0-9]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    limit = Fraction(str(threshold))
    out = set()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= limit * len(sets[a] | sets[b]):
                out.add((a, b))
    return out


def corpus(seed, n, lengths):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, 3)):
                if w:
                    k = rng.randrange(len(w))
                    w[k : k + rng.randint(0, 1)] = [rng.choice(vocab)] * rng.randint(0, 1)
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rng.choice(vocab) for _ in range(rng.choice(lengths))))
    return [(i, T0, "Head" if i % 3 else None, t) for i, t in enumerate(texts)]


def run(spark, rows, threshold=0.6, width=3):
    df = spark.createDataFrame(rows, "id long, at timestamp_ntz, heading string, text string").selectExpr("*", "1 AS k", "2 AS words")
    out = [tuple(r) for r in neardup.similar_pairs(df, threshold, width).collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_equals_brute_force_over_sizes(spark):
    rows = corpus(1, 300, [2, 3, 4, 5, 8, 20, 60])
    rows += [(900, T0, None, None), (901, T0, "", ""), (902, T0, None, " \n"), (903, T0, "Ünï", "ÇA — é"), (904, T0, None, "long " * 30000)]
    assert run(spark, rows) == brute(rows, 0.6, 3)


def test_other_threshold_and_width(spark):
    rows = corpus(2, 200, [6, 9, 30])
    assert run(spark, rows, 0.8, 5) == brute(rows, 0.8, 5)


def test_small_and_large_sets_meet_at_any_boundary(spark, monkeypatch):
    rows = corpus(3, 200, [2, 3, 5, 8, 13, 21])
    want = brute(rows, 0.6, 3)
    for x in (1, 4, 9, 1000):
        monkeypatch.setattr(neardup, "_boundary", lambda sets, plan_of, x=x: (x, 1000))
        assert run(spark, rows) == want


def test_copies_later_deliveries_and_empty_table(spark):
    t = "one two three four five six"
    rows = [(1, T0, None, t), (2, T0, None, t), (2, T0, None, t), (3, T0, None, t), (3, T0 + dt.timedelta(1), None, "quite other words than those before"), (4, T0, "one", "two three four five six")]
    assert run(spark, rows) == {(1, 2), (1, 4), (2, 4)}
    assert run(spark, rows[:0]) == set()


def test_cost_decides_between_subsets_and_lists():
    counts = np.full(neardup.COUNTERS, 1)
    plan = neardup.Plan(counts, Fraction(3, 5), 3, small=10)
    words = [np.arange(n, dtype=np.uint32).tobytes() for n in (6, 40)]
    record, key, short, blocks = plan.keys(plan.sets(words))
    n = plan.sets(words).n
    p = plan.prefix(n)
    assert (record == 0).sum() == (p[0] + 1) * p[0] // 2 and (record == 1).sum() == p[1]


def test_one_repeated_word_and_low_thresholds(spark):
    """Sets of one sequence, stored as different texts, and thresholds at which sets may share one sequence only."""
    rows = [(1, T0, None, "x x x"), (2, T0, None, "x x x x"), (3, T0, None, "x " * 50), (4, T0, None, "x x x y"), (5, T0, None, "y x x x")]
    assert run(spark, rows) == brute(rows, 0.6, 3) == {(1, 2), (1, 3), (2, 3)}
    for threshold in (0.5, 0.34, 0.25):
        assert run(spark, rows, threshold) == brute(rows, threshold, 3)
    rows = corpus(5, 120, [3, 4, 5, 6, 9])
    for threshold in (0.5, 0.3):
        assert run(spark, rows, threshold, 2) == brute(rows, threshold, 2)


def test_a_long_list_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LIST_BLOCK", 16)
    rows = corpus(6, 250, [5, 8, 20]) + [(500 + k, T0, None, f"same few words in every one of them {k}") for k in range(60)]
    assert run(spark, rows) == brute(rows, 0.6, 3)


def test_blocks_of_a_list_meet_pairwise():
    names = np.arange(1, 101, dtype=np.int64)
    record, key = np.arange(100), np.full(100, 7, dtype=np.uint64)
    rec, cut_key, _ = neardup._cut_lists(record, key, np.ones(100, dtype=bool), np.full(100, 4), names)
    together = set()
    for k in np.unique(cut_key):
        of = rec[cut_key == k]
        together |= {(a, b) for a in of for b in of if a < b}
    assert len(together) == 100 * 99 // 2 and len(rec) == 400


def test_classes_say_what_pairs_say(spark):
    rows = corpus(7, 150, [4, 8, 12]) + [(1000 + k, T0, None, "a text that has very many copies here") for k in range(50)]
    df = spark.createDataFrame(rows, "id long, at timestamp_ntz, heading string, text string")
    members, links = neardup.similar_classes(df, 0.6, 3)
    of = {}
    for r in members.collect():
        of.setdefault(r["class_id"], []).append(r["id"])
    assert all(c == min(ids) for c, ids in of.items())
    got = {(min(a, b), max(a, b)) for r in links.collect() for a in of[r["class_a"]] for b in of[r["class_b"]]}
    got |= {(a, b) for ids in of.values() for a in ids for b in ids if a < b}
    assert got == brute(rows, 0.6, 3)
