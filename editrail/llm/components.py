"""Consolidating pairwise matches into groups (connected components).

Rounds of minimum-label propagation over the edges, sped up by pointer jumping; each round ends in a
checkpoint, and edges are then rewritten to the labels of their ends, so they shrink until none is
left, which is when no label changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editrail.runtime import cut, read_table, release

#: Jumps of each label to its own label in a round. Any number gives the same groups.
JUMPS = 2


def _nearest_label(edges: DataFrame) -> DataFrame:
    """(v, l): the least of v and its neighbours. min() combines before the shuffle, so hubs are cheap."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("n")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("n")))
    return both.groupBy("v").agg(F.min("n").alias("n")).select("v", F.least("v", "n").alias("l"))


def _renamed(labels: DataFrame, later: DataFrame) -> DataFrame:
    """labels with each label replaced by the label that later has for it, if any.

    A giant group makes its label a hot key of this join. later has one row to a label, so AQE splits the hot label's
    rows over tasks and copies that one row; a fixed salt would copy every row of later, at every round.
    """
    up = later.where("v <> l").select(F.col("v").alias("l"), F.col("l").alias("l2"))
    return labels.join(up, "l", "left").select("v", F.coalesce("l2", "l").alias("l"))


def _jump(labels: DataFrame) -> DataFrame:
    """Replace each label by its own label. Every label is a vertex of the table."""
    return _renamed(labels, labels)


def _relabel(edges: DataFrame, labels: DataFrame) -> DataFrame:
    moved = labels.where("v <> l")
    e = edges.join(moved.select(F.col("v").alias("a"), F.col("l").alias("la")), "a", "left")
    e = e.join(moved.select(F.col("v").alias("b"), F.col("l").alias("lb")), "b", "left")
    e = e.select(F.coalesce("la", "a").alias("x"), F.coalesce("lb", "b").alias("y")).where("x <> y")
    return e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def connected_components(pairs: DataFrame, a: str, b: str, jumps: int = JUMPS) -> DataFrame:
    """(node, group_id): each end of a pair with the least node it is linked with, itself included.

    Pairs may repeat, in either order. Pairs with a null end or two equal ends link nothing and give
    no row; an empty table gives none. Other columns are ignored. Node ids are integers.
    """
    p = pairs.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    edges = cut(p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps = []
    while not edges.isEmpty():
        labels = _nearest_label(edges)
        for _ in range(jumps):
            labels = _jump(labels)
        labels = cut(labels)
        steps.append(labels)
        done, edges = edges, cut(_relabel(edges, labels))
        release(done)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("group_id"))
    # from the last round back: the table of a round holds all nodes that are still named after it
    groups = steps.pop()
    while steps:
        groups = _renamed(steps.pop(), groups)
    return groups.select(F.col("v").alias("node"), F.col("l").alias("group_id"))


def accepted_links(candidates: DataFrame) -> DataFrame:
    """(a, b) of the pairs of sections that are linked by their latest decision.

    Rows with a null end or two equal ends decide nothing. An undecided (null) latest row doesn't
    link. Of decisions at the same time, accepted wins over refused over undecided; null times lose.
    """
    d = candidates.select(
        F.least("old_section_id", "new_section_id").alias("a"),
        F.greatest("old_section_id", "new_section_id").alias("b"),
        "decided_at",
        F.coalesce(F.col("accepted").cast("int"), F.lit(-1)).alias("verdict"),
        F.col("old_section_id").isNotNull().alias("has_old"),
        F.col("new_section_id").isNotNull().alias("has_new"),
    ).where("has_old AND has_new AND a <> b")
    last = d.groupBy("a", "b").agg(F.max(F.struct("decided_at", "verdict"))["verdict"].alias("verdict"))
    return last.where("verdict = 1").select("a", "b")


def threads(candidates: DataFrame) -> DataFrame:
    return connected_components(accepted_links(candidates), "a", "b").select(F.col("node").alias("section_id"), "group_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads(read_table(spark, sf_dir, "linkage_candidates"))


P3_SQL = """
WITH RECURSIVE d AS (
  SELECT least(old_section_id, new_section_id) AS a, greatest(old_section_id, new_section_id) AS b, decided_at, accepted
  FROM linkage_candidates
  WHERE old_section_id IS NOT NULL AND new_section_id IS NOT NULL AND old_section_id <> new_section_id
), k AS (
  SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY decided_at DESC, coalesce(CAST(accepted AS INTEGER), -1) DESC) AS rn FROM d)
  WHERE rn = 1 AND accepted
), e AS (SELECT a AS u, b AS v FROM k UNION SELECT b, a FROM k),
r AS (SELECT u AS node, u AS seen FROM e UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.seen)
SELECT node AS section_id, min(seen) AS group_id FROM r GROUP BY node
"""
