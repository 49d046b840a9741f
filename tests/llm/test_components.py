import random

from editrail.llm.components import accepted_links, connected_components, threads


def brute(pairs):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def groups(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len({r[0] for r in rows})
    return dict(rows)


def test_chains_hubs_and_random_graphs(spark):
    rng = random.Random(7)
    chain = list(range(1000, 1064))
    rng.shuffle(chain)
    pairs = list(zip(chain, chain[1:])) + [(5, x) for x in range(100, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)]
    pairs = [p for p in pairs if p[0] != p[1]]
    df = spark.createDataFrame(pairs + [(b, a) for a, b in pairs[:50]] + pairs[:20], "x long, y long")
    assert groups(connected_components(df, "x", "y")) == brute(pairs)


def test_null_ends_loops_and_empty_tables_link_nothing(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (3, 3)], "x long, y long")
    assert groups(connected_components(df, "x", "y")) == {}
    assert groups(connected_components(df.where("false"), "x", "y")) == {}


def test_latest_decision_counts_whichever_end_is_old(spark):
    rows = [
        (1, 2, True, "2024-01-01"), (2, 1, False, "2024-02-01"),  # revised
        (3, 4, False, "2024-01-01"), (4, 3, True, "2024-02-01"), (4, 3, True, "2024-02-01"),
        (5, 6, True, "2024-01-01"), (5, 6, None, "2024-02-01"),  # undecided again
        (7, None, True, "2024-01-01"), (8, 8, True, "2024-01-01"), (4, 9, True, None),
    ]
    df = spark.createDataFrame(rows, "old_section_id long, new_section_id long, accepted boolean, decided_at string").selectExpr("*", "1 AS verdict", "'x' AS a")
    assert sorted(map(tuple, accepted_links(df).collect())) == [(3, 4), (4, 9)]
    assert groups(threads(df)) == {3: 3, 4: 3, 9: 3}
