"""A third of all rows with one key, text, value or hub: results stay right and whole."""

import datetime as dt

from editrail.llm import canon, components, neardup, textform, tokenize

T0 = dt.datetime(2024, 1, 1)
N = 3000


def test_hub_of_a_graph(spark):
    hub = [(0, k) for k in range(1, N // 3)]
    rest = [(10_000 + 2 * k, 10_001 + 2 * k) for k in range(N // 3)]
    df = spark.createDataFrame(hub + rest, "a long, b long")
    got = dict(map(tuple, components.connected_components(df, "a", "b").collect()))
    assert {got[k] for k in range(N // 3)} == {0} and all(got[b] == a for a, b in rest) and len(got) == N


def test_one_text_in_a_third_of_the_rows(spark):
    t = "one text that a great many of the records have word for word and that no other record has"
    rows = [(k, "s", t) for k in range(N // 3)] + [(N + k, "s", f"own text number {k}") for k in range(2 * N // 3)] + [(9 * N, "s", t.replace("one", "οne"))]
    df = spark.createDataFrame(rows, "id long, scope string, text string")
    pairs = textform.look_alike_pairs(textform.text_hashes(df, ["id"]), []).collect()
    assert sorted(map(tuple, pairs)) == [(k, 9 * N) for k in range(N // 3)]
    ids = tokenize.encode_documents(df.withColumnRenamed("id", "doc_id")).collect()
    assert len(ids) == len(rows) and len({tuple(r["ids"]) for r in ids if r["doc_id"] < N // 3}) == 1


def test_copies_among_near_copies(spark):
    base = [f"word{k}" for k in range(40)]
    copies = [(k, T0, None, " ".join(base)) for k in range(40)]
    near = [(100 + k, T0, None, " ".join(base[:k] + ["other"] + base[k + 1 :])) for k in range(5)]
    alone = [(1000 + k, T0, None, " ".join(f"x{k}y{j}" for j in range(20))) for k in range(60)]
    df = spark.createDataFrame(copies + near + alone, "id long, at timestamp_ntz, heading string, text string")
    got = [tuple(r) for r in neardup.similar_pairs(df, 0.6, 3).collect()]
    assert len(got) == len(set(got)) == 40 * 39 // 2 + 40 * 5 + 5 * 4 // 2


def test_one_value_in_a_third_of_the_rows(spark):
    entries = spark.createDataFrame([(1, "k", "Harbors and Canals", []), (2, "k", "Mines and Quarries", [])], "ref_id long, kind string, name string, aliases array<string>")
    values = spark.createDataFrame([("k", "harbors & canals")] * (N // 3) + [("k", f"junk {k}") for k in range(50)], "kind string, value string")
    got = {r["value"]: r["ref_id"] for r in canon.map_values(values, entries).collect()}
    assert got.pop("harbors & canals") == 1 and set(got.values()) == {0} and len(got) == 50
