import random

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from editrail.llm.packing import best_fit, pack, split_long


@given(st.lists(st.integers(0, 50), max_size=200))
def test_best_fit_keeps_capacity_and_places_all(sizes):
    sizes = np.array(sizes, dtype=np.int64)
    place, fills = best_fit(sizes, 50)
    assert ((place >= 0) == (sizes > 0)).all()
    assert (np.bincount(place[place >= 0], weights=sizes[place >= 0], minlength=len(fills)) == fills).all()
    assert (fills <= 50).all()
    # of two bins, one is over half full
    assert (fills <= 25).sum() <= 1


def test_split_long_covers_each_item_once():
    item, first, n = split_long(np.array([0, 10, 25, 20]), 10)
    assert list(zip(item, first, n)) == [(0, 0, 0), (1, 0, 10), (2, 0, 10), (2, 10, 10), (2, 20, 5), (3, 0, 10), (3, 10, 10)]


def packed(spark, sizes, parts):
    df = spark.createDataFrame([(i, int(n), "b") for i, n in enumerate(sizes)], "key long, n long, bin string").repartition(parts)
    return pack(df, lambda: lambda b: b.column(1).to_numpy(), ["key", "n"], "key", capacity=100).collect()


def test_containers_over_partitions(spark):
    rng = random.Random(2)
    sizes = [0, 0, 250, 100] + [rng.randint(1, 70) for _ in range(400)]
    rows = packed(spark, sizes, 7)
    by_key, by_bin = {}, {}
    for r in rows:
        by_key.setdefault(r["key"], []).append((r["token_from"], r["token_count"]))
        if r["container_id"] is not None:
            by_bin[r["container_id"]] = by_bin.get(r["container_id"], 0) + r["token_count"]
        else:
            assert r["token_count"] == 0
    for key, parts in by_key.items():
        at = 0
        for first, n in sorted(parts):
            assert first == at
            at += n
        assert at == sizes[key] and (len(parts) == 1 or sizes[key] > 100)
    assert len(by_key) == len(sizes) and max(by_bin.values()) <= 100
    assert len(by_bin) <= -(-sum(sizes) // 100) + 7 + 1  # of each partition, one may stay underfull


def test_empty_and_all_empty(spark):
    assert packed(spark, [], 1) == []
    assert [r["container_id"] for r in packed(spark, [0, 0], 2)] == [None, None]
