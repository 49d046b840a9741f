"""Moves of paragraphs, ranking, anchors, order on the page, threads over the years and provenance."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from editrail.functions import policy
from editrail.functions import similarity as sim
from editrail.functions.text import anchor, word_count
from editrail.operators.diff import class_name, class_rank
from editrail.runtime import cut

# Weights of the ranking and bars of the moves.
CLASS_WEIGHT = {"unchanged": 0.0, "numbers only": 0.2, "minor": 0.5, "substantive": 1.0, "new": 2.0, "dropped": 2.0}
EDITED_DIRECTIVE, LONE_DIRECTIVE = 1.5, 3.0
TOPIC_RATIO, NEAR_RATIO, LENGTH_RATIO, LEAST_WORDS = 0.5, 85.0, 0.8, 12


# ---- moves: paragraphs without a counterpart in their own section


def moved_verbatim(gone: DataFrame, come: DataFrame, scope: list[str]) -> DataFrame:
    """scope, text, old_key, new_key: the k-th dropped paragraph of a text with the k-th new one.

    gone, come: scope, key, ord, text. Null texts move nowhere.
    """
    w = Window.partitionBy(*scope, "text").orderBy("ord", "key")
    a = gone.where("text IS NOT NULL").select(*scope, "text", F.col("key").alias("old_key"), F.row_number().over(w).alias("occ"))
    b = come.where("text IS NOT NULL").select(*scope, "text", F.col("key").alias("new_key"), F.row_number().over(w).alias("occ"))
    return a.join(b, [*scope, "text", "occ"]).drop("occ")


def moved_same_topic(gone: DataFrame, come: DataFrame, scope: list[str]) -> DataFrame:
    """scope, old_key, new_key, score: new paragraphs, in their order, each with the most alike dropped one of its topic that is left.

    Over half alike, by difflib's measure on characters; ties go to the earlier dropped one. Lengths alone rule out most pairs
    before any text is compared.
    """
    named = lambda df, s: df.where("topic <> ''").select(*scope, F.lower("topic").alias("topic"), F.col("key").alias(f"{s}_key"), F.col("ord").alias(f"{s}_ord"), F.col("text").alias(f"{s}_text"))
    both = named(gone, "old").join(named(come, "new"), [*scope, "topic"])
    a, b = F.length("old_text"), F.length("new_text")
    both = both.where(2 * F.least(a, b) > TOPIC_RATIO * (a + b)).withColumn("score", sim.blocks("old_text", "new_text")).where(F.col("score") > TOPIC_RATIO)
    both = both.drop("old_text", "new_text")

    def consume(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["new_ord", "new_key", "score", "old_ord", "old_key"], ascending=[True, True, False, True, True])
        taken: set = set()
        keep = []
        for _, of in rows.groupby(["new_ord", "new_key"], sort=False):
            for row, old in zip(of.index, of["old_key"]):
                if old not in taken:
                    taken.add(old)
                    keep.append(row)
                    break
        return rows.loc[keep, [*scope, "old_key", "new_key", "score"]]

    types = ", ".join(f"`{c}` {both.schema[c].dataType.simpleString()}" for c in [*scope, "old_key", "new_key", "score"])
    return both.groupBy(*scope, "topic").applyInPandas(consume, types)


#: Characters whose counts bound how alike two texts can be; all others count together.
_COUNTED = "abcdefghijklmnopqrstuvwxyz0123456789 .,"


def _bag(text) -> Column:
    low = F.lower(text)
    each = [F.length(low) - F.length(F.replace(low, F.lit(c), F.lit(""))) for c in _COUNTED]
    rest = F.length(low) - reduce(lambda x, y: x + y, each)
    return F.array(*each, rest)


def moved_nearly(gone: DataFrame, come: DataFrame, scope: list[str]) -> DataFrame:
    """scope, old_key, new_key, score: paragraphs of at least a dozen words and like length, mutually the most alike.

    Every pair of a scope that can reach the bar is scored: texts meet in bands of length, neighbours included, which
    holds all pairs of like length, and a bound from their counted characters drops those that can't be alike enough.
    """
    step = -math.log(LENGTH_RATIO)

    def banded(df: DataFrame, s: str, reach: int) -> DataFrame:
        long = df.where(word_count(F.col("text")) >= LEAST_WORDS)
        band = F.floor(F.log(F.length("text").cast("double")) / step).cast("int")
        bands = F.explode(F.sequence(band - reach, band + reach)) if reach else band
        return long.select(*scope, F.col("key").alias(f"{s}_key"), F.col("ord").alias(f"{s}_ord"), F.col("section").alias(f"{s}_section"), F.col("text").alias(f"{s}_text"), _bag(F.col("text")).alias(f"{s}_bag"), bands.alias("band"))

    both = banded(gone, "old", 1).join(banded(come, "new", 0), [*scope, "band"])
    a, b = F.length("old_text"), F.length("new_text")
    both = both.where(F.least(a, b) >= LENGTH_RATIO * F.greatest(a, b))
    shared = F.aggregate(F.zip_with("old_bag", "new_bag", lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x)
    both = both.where(200 * shared >= NEAR_RATIO * (a + b)).drop("old_bag", "new_bag", "band")
    both = both.withColumn("score", sim.indel("old_text", "new_text")).where(F.col("score") >= NEAR_RATIO)
    best = mutual_best(both, scope, ["old_section", "new_section"])
    return best.where("NOT old_section <=> new_section").drop("old_section", "new_section")


def mutual_best(both: DataFrame, scope: list[str], more: list[str] = ()) -> DataFrame:
    o = Window.partitionBy(*scope, "old_key").orderBy(F.desc("score"), "new_ord", "new_key")
    n = Window.partitionBy(*scope, "new_key").orderBy(F.desc("score"), "old_ord", "old_key")
    both = both.withColumn("ro", F.row_number().over(o)).withColumn("rn", F.row_number().over(n))
    return both.where("ro = 1 AND rn = 1").select(*scope, "old_key", "new_key", "score", *more)


# ---- ranking


def significance(section_diffs: DataFrame, flags: DataFrame | None, boosts: DataFrame) -> DataFrame:
    """section_diffs with a score: changed words by class weight, plus a weight per family and paragraph, times the boost.

    flags: section key, paragraph key, category. boosts: section key, boost. Sections without either have 0 and 1.
    """
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in CLASS_WEIGHT.items() for x in kv]), F.col("change"))
    out = section_diffs
    if flags is not None:
        of = F.element_at(F.create_map(*[F.lit(x) for kv in policy.WEIGHTS.items() for x in kv]), F.col("category"))
        added = flags.select("section", "paragraph", "category").distinct().groupBy("section").agg(F.sum(of).alias("flagged"))
        out = out.join(added, "section", "left")
    else:
        out = out.withColumn("flagged", F.lit(0.0))
    out = out.join(boosts, "section", "left")
    score = (F.col("changed_words") * weight + F.coalesce("flagged", F.lit(0.0))) * F.coalesce("boost", F.lit(1.0))
    return out.withColumn("score", score).drop("flagged", "boost")


def boost(kind: Column, change: Column) -> Column:
    """Of one paragraph: directives that changed lift their section."""
    lone = change.isin("new", "dropped")
    return F.when(kind == "directive", F.when(lone, LONE_DIRECTIVE).when(change != "unchanged", EDITED_DIRECTIVE).otherwise(1.0)).otherwise(1.0)


def with_anchors(ranked: DataFrame, page: list[str], order: list) -> DataFrame:
    """A name on its page for each row's path; the second of a path and those after it get a number."""
    w = Window.partitionBy(*page, "base").orderBy(*order)
    out = ranked.withColumn("base", anchor(F.col("path"))).withColumn("nth", F.row_number().over(w))
    return out.withColumn("anchor", F.when(F.col("nth") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "nth"))).drop("base", "nth")


def document_order(rows: DataFrame, page: list[str]) -> DataFrame:
    """Where each row stands: new rows at their place, dropped ones after what preceded them in the old edition.

    rows: page columns, old_seq, new_seq (null where a side lacks the section). Adds place_new, place_old.
    """
    w = Window.partitionBy(*page).orderBy(F.col("old_seq").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.when(F.col("old_seq").isNotNull(), F.last("new_seq", True).over(w))
    return rows.withColumn("place_new", F.coalesce("new_seq", carried, F.lit(-1))).withColumn("place_old", F.when(F.col("new_seq").isNotNull(), F.lit(-1)).otherwise(F.col("old_seq")))


# ---- threads


def thread_heads(links: DataFrame) -> DataFrame:
    """(node, head): the first section of the thread each section is in, for links old_id -> new_id of in- and out-degree one.

    Pointer jumping: every round doubles the distance a section looks back, so a thread of n editions takes log n rounds.
    """
    nodes = links.select(F.col("old_id").alias("node")).union(links.select("new_id")).distinct()
    back = nodes.join(links.select(F.col("new_id").alias("node"), F.col("old_id").alias("prev")), "node", "left")
    state = cut(back.select("node", F.coalesce("prev", "node").alias("head")))
    while True:
        up = state.select(F.col("node").alias("head"), F.col("head").alias("further"))
        state_next = cut(state.join(up, "head").select("node", F.col("further").alias("head"), (F.col("further") != F.col("head")).alias("moved")))
        state = state_next.select("node", "head")
        if state_next.where("moved").isEmpty():
            return state


def stitched(dead: DataFrame, born: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, dead_id, born_id, kind): threads that ended and threads that began later under the same name and title.

    dead, born: scope, id, key, fy (transition of the end or birth). At the same transition the thread was
    reorganized, later it returned. One-to-one: of a name, the k-th to end with the k-th to begin.
    """
    wd = Window.partitionBy(*scope, "key").orderBy("fy", "id")
    d = dead.select(*scope, "key", F.col("id").alias("dead_id"), F.col("fy").alias("death"), F.row_number().over(wd).alias("nth"))
    b = born.select(*scope, "key", F.col("id").alias("born_id"), F.col("fy").alias("birth"), F.row_number().over(wd).alias("nth"))
    kind = F.when(F.col("birth") == F.col("death"), "reorganized").otherwise("returned")
    return d.join(b, [*scope, "key", "nth"]).where("birth >= death").select(*scope, "dead_id", "born_id", kind.alias("kind"))


def row_label(labels: Column) -> Column:
    """One label of the cells of a row: of dropped and reorganized cells alone, or new and returned ones, their own; else the greatest class."""
    only = lambda *ok: F.forall(labels, lambda x: x.isin(*ok))
    greatest = class_name(F.array_max(F.transform(labels, lambda x: F.coalesce(F.when(class_rank(x) >= 0, class_rank(x)), F.lit(3)))))
    return (
        F.when(only("dropped", "reorganized"), F.when(F.array_contains(labels, "reorganized"), "reorganized").otherwise("dropped"))
        .when(only("new", "returned"), F.when(F.array_contains(labels, "returned"), "returned").otherwise("new"))
        .otherwise(greatest)
    )


def runs(rows: DataFrame, key: list[str], order: str, label: str) -> DataFrame:
    """(key, label, first, last, n): consecutive rows of equal label as one. Null labels are equal."""
    w = Window.partitionBy(*key).orderBy(order)
    step = rows.withColumn("starts", F.when(F.lag(order).over(w).isNull(), 0).otherwise((~F.lag(label).over(w).eqNullSafe(F.col(label))).cast("int")))
    step = step.withColumn("run", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return step.groupBy(*key, "run").agg(F.first(label).alias(label), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("run")


def merge_spans(rows: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """(key, start, end): spans that overlap or touch as one."""
    w = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    step = rows.withColumn("fresh", F.when(F.col(start) > F.coalesce(reach, F.lit(-(1 << 62))), 1).otherwise(0))
    step = step.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return step.groupBy(*key, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def provenance(cells: DataFrame) -> DataFrame:
    """Of each thread: the year it was added, and the last year and class of an edit.

    cells: thread, fy, change. The label says 'unchanged since' where nothing happened after the first year.
    """
    edited = F.when(~F.col("change").isin("unchanged", "new"), F.struct("fy", "change"))
    out = cells.groupBy("thread").agg(F.min("fy").alias("added_fy"), F.max(edited).alias("e"), F.max("fy").alias("last_fy"))
    verb = F.when(F.col("e.change") == "numbers only", "figures updated").when(F.col("e.change") == "minor", "tweaked").otherwise("revised")
    text = F.when(F.col("e").isNull(), F.concat(F.lit("unchanged since FY"), "added_fy")).otherwise(F.concat(F.lit("added FY"), "added_fy", F.lit("; "), verb, F.lit(" FY"), "e.fy"))
    return out.select("thread", "added_fy", F.col("e.fy").alias("edited_fy"), F.col("e.change").alias("edit"), text.alias("label"), (F.coalesce(F.col("e.fy") == F.col("last_fy"), F.lit(False))).alias("hot"))
