"""What became of sections and paragraphs over all years of a series, from the comparisons of neighbouring editions.

A thread is a section followed through the years. Its members are sections, at most one to an edition; its cells say
what happened to it at each transition, the last one that it was dropped if it ends before the series.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from editrail.functions import similarity as sim
from editrail.operators import align as al
from editrail.operators import chain as ch
from editrail.runtime import cut, release

# Bars of joining a thread that ended to one that began.
SAME_NAME, OTHER_NAME, NAME_BONUS = 45.0, 80.0, 10.0
LEAST_BODY, BODY_RATIO, SHORT_BODY, STRICT = 40, 0.4, 300, 85.0
SERIES = ["chamber", "slug"]


@dataclass
class Threads:
    """members: series, fy, section_id, thread. links: dead, born, kind, fy of the joins over gaps. cells: series, thread, fy, pair, old_id, new_id, label, changed_words, score, renamed."""

    members: DataFrame
    links: DataFrame
    cells: DataFrame


def threads(matched: DataFrame, sections: DataFrame) -> DataFrame:
    """sections with their thread: the section_id of the first of the sections linked year by year."""
    heads = ch.thread_heads(matched.select("old_id", "new_id")).select(F.col("node").alias("section_id"), F.col("head").alias("thread"))
    return sections.join(heads, "section_id", "left").withColumn("thread", F.coalesce("thread", "section_id"))


def comparable(a, b, strict) -> F.col:
    """Enough text on both sides, of like length, and near-verbatim if short."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return (short >= LEAST_BODY) & (short >= BODY_RATIO * long) & ((short >= SHORT_BODY) | (strict >= STRICT))


def stitch_candidates(dead: DataFrame, born: DataFrame, scope: list[str]) -> DataFrame:
    """Threads that ended and threads that began no earlier, with scores.

    dead, born: scope, path, id, fy, paragraphs (of the last or first section). Under one name and title a low score
    is enough; else it must be high and the bodies comparable. Provisions have no name, only a text. What is compared is
    blocked by series; a pair whose lengths alone forbid both ways is dropped before any text is scored.
    """
    side = lambda df, s, year: df.select(*scope, F.col("path").alias(f"{s}_path"), F.col("id").alias(f"{s}_id"), F.col("fy").alias(year), F.col("paragraphs").alias(f"{s}_text"))
    both = side(dead, "dead", "death").join(side(born, "born", "birth"), scope).where("birth >= death AND dead_id <> born_id")
    dp, bp = F.col("dead_path"), F.col("born_path")
    both = both.withColumn("same", (al.leaf(dp) == al.leaf(bp)) & (F.get(dp, F.lit(0)) == F.get(bp, F.lit(0))) & ~al.is_provision(dp))
    dt, bt = al.provision_texts(F.col("dead_text"), F.col("born_text"), dp, bp)
    db, bb = al.body(F.col("dead_text"), al.COMPARED), al.body(F.col("born_text"), al.COMPARED)
    both = both.withColumn("dt", dt).withColumn("bt", bt).withColumn("db", db).withColumn("bb", bb)
    both = both.where(F.col("same") | comparable(F.col("db"), F.col("bb"), F.lit(100.0)))
    both = both.withColumn("score", sim.token_set("dt", "bt")).where((F.col("same") & (F.col("score") >= SAME_NAME)) | (F.col("score") >= OTHER_NAME))
    bare = lambda c: F.regexp_replace(c, al.PROVISION_LEAD, "")
    both = both.withColumn("strict", sim.indel(bare(F.col("dt")), bare(F.col("bt"))))
    both = both.where((F.col("same") & (F.col("score") >= SAME_NAME)) | comparable(F.col("db"), F.col("bb"), F.col("strict")))
    return both.withColumn("rank", F.col("score") + F.when(F.col("same"), NAME_BONUS).otherwise(0.0))


def stitch(members: DataFrame, editions: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """(members, links): threads joined over gaps, best rank first and one to one, until no more join.

    members: scope, thread, fy, section_id, path, paragraphs. links: dead, born, kind, fy: the thread that ended took in the
    one that began, at the same transition (reorganized) or later (returned), fy being the year that the latter began in.
    """
    w = Window.partitionBy(*scope).orderBy("fy")
    years = editions.select(*scope, "fy", F.lead("fy").over(w).alias("next_fy"), F.min("fy").over(Window.partitionBy(*scope)).alias("first_fy"))
    links = None
    while True:
        cell = F.struct("fy", "section_id", "path", "paragraphs")
        t = members.groupBy(*scope, "thread").agg(F.min(cell).alias("a"), F.max(cell).alias("z"))
        dead = t.select(*scope, F.col("thread").alias("id"), F.col("z.fy").alias("fy"), "z.paragraphs", "z.path")
        dead = dead.join(years, [*scope, "fy"]).where("next_fy IS NOT NULL").withColumn("fy", F.col("next_fy"))
        born = t.select(*scope, F.col("thread").alias("id"), F.col("a.fy").alias("fy"), "a.paragraphs", "a.path")
        born = born.join(years, [*scope, "fy"]).where("fy > first_fy")
        c = stitch_candidates(dead, born, scope)
        c = c.select(*scope, F.col("dead_id").alias("old_id"), F.col("born_id").alias("new_id"), F.col("rank").alias("score"), F.col("born_id").alias("new_rank"), F.col("dead_id").alias("old_rank"), "death", "birth")
        taken = cut(al.take_greedily(c, scope, 0.0, same_ids=True))
        kind = F.when(F.col("birth") == F.col("death"), "reorganized").otherwise("returned")
        new = taken.select(F.col("old_id").alias("dead"), F.col("new_id").alias("born"), kind.alias("kind"), F.col("birth").alias("fy"))
        links = new if links is None else links.unionByName(new)
        if taken.isEmpty():
            return members, links
        names = ch.thread_heads(taken.select("old_id", "new_id")).select(F.col("node").alias("thread"), "head")
        before, members = members, cut(members.join(names, "thread", "left").withColumn("thread", F.coalesce("head", "thread")).drop("head"))
        release(before)


def follow(comparison, sections: DataFrame, editions: DataFrame, pairs: DataFrame) -> Threads:
    """The threads of every series, joined over gaps, and their cells."""
    own = sections.select("section_id", "package_id", "path", "paragraphs").join(editions, "package_id").where(F.size("path") > 0)
    linked = cut(threads(comparison.matched, own).select(*SERIES, "thread", "fy", "section_id", "path", "paragraphs"))
    first = linked.select("section_id", "thread")
    members, links = stitch(cut(linked), editions, SERIES)
    final = cut(members.select(*SERIES, "fy", "section_id", "thread"))
    links = cut(links)
    rows = comparison.sections.select("pair", "old_id", "new_id", "change", "changed_words", "score", F.col("renamed_from").isNotNull().alias("renamed"))
    rows = rows.join(pairs.select("pair", *SERIES, F.col("new_fy").alias("fy")), "pair").withColumn("section_id", F.coalesce("new_id", "old_id"))
    rows = rows.join(first.withColumnRenamed("thread", "before"), "section_id").join(final.select("section_id", "thread"), "section_id")
    # the birth of a thread that was taken in is no birth, and a section that was dropped and taken in at once isn't dropped
    births = links.select(F.col("born").alias("before"), "fy", F.lit("new").alias("change"), "kind")
    # a thread taken in earlier goes by its own first name here, so later links find its end by the section that ends it
    ends = links.where("kind = 'reorganized'").select(F.col("dead").alias("thread"), "fy", F.lit("dropped").alias("change"), F.lit(True).alias("gone"))
    rows = rows.join(births, ["before", "fy", "change"], "left").join(_named(ends, links), ["thread", "fy", "change"], "left").where("gone IS NULL")
    cells = rows.select(*SERIES, "thread", "fy", "pair", "old_id", "new_id", F.coalesce("kind", "change").alias("label"), "changed_words", "score", "renamed")
    return Threads(final, links, cells)


def _named(ends: DataFrame, links: DataFrame) -> DataFrame:
    """ends under the name that their thread has in the end."""
    heads = ch.thread_heads(links.select(F.col("dead").alias("old_id"), F.col("born").alias("new_id"))).select(F.col("node").alias("thread"), "head")
    return ends.join(heads, "thread", "left").select(F.coalesce("head", "thread").alias("thread"), "fy", "change", "gone").distinct()


def thread_scores(comparison, members: DataFrame) -> DataFrame:
    """(thread, score): what all comparisons of its sections add up to."""
    rows = comparison.sections.select(F.coalesce("new_id", "old_id").alias("section_id"), "score")
    return rows.join(members.select("section_id", "thread"), "section_id").groupBy("thread").agg(F.sum("score").alias("score"))


def account_rows(members: DataFrame, sections: DataFrame, scores: DataFrame) -> DataFrame:
    """A row per account: series, row_key, display, heading, formerly, members (threads), score; and (thread, row_key) as `threads`.

    A thread belongs to the account of its latest section: a provision is a row of its own, under its number and the year that
    it began in, as numbers are given anew; a heading of the fourth level or deeper belongs to what it stands under.
    """
    s = sections.select("section_id", "path", "heading", "level")
    m = members.join(s, "section_id")
    at = F.struct("fy", "section_id", "path", "heading", "level")
    t = m.groupBy(*SERIES, "thread").agg(F.max(at).alias("z"), F.min(at).alias("a"), F.min("fy").alias("birth")).join(scores, "thread", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    path = F.col("z.path")
    key = F.when(~al.is_provision(path) & (F.col("z.level") >= 4) & (F.size(path) > 1), al.parent(path)).otherwise(path)
    t = t.withColumn("display", key).withColumn("sec", al.is_provision(F.col("display")))
    nth = F.row_number().over(Window.partitionBy(*SERIES, "display", "birth").orderBy(F.desc("score"), "thread")) - 1
    t = t.withColumn("nth", nth)
    suffix = F.concat(F.lit("B"), F.col("birth").cast("string"), F.when(F.col("nth") > 0, F.concat(F.lit("."), F.col("nth").cast("string"))).otherwise(F.lit("")))
    t = t.withColumn("row_key", F.array_join(F.when(F.col("sec"), F.concat("display", F.array(suffix))).otherwise(F.col("display")), " > "))
    # the account's own thread names the row, of several the best scored
    own = F.when(path == F.col("display"), F.struct("score", -F.col("thread"), "z", "a", "birth"))
    rows = t.groupBy(*SERIES, "row_key").agg(F.first("display").alias("display"), F.max(own).alias("own"), F.count("*").alias("members"), F.sum("score").alias("score"), F.collect_set("thread").alias("threads"))
    named = F.initcap(F.lower(al.leaf(F.col("display"))))
    formerly = F.when(al.leaf(F.col("own.a.path")) != al.leaf(F.col("own.z.path")), F.format_string("%s (FY%d)", F.col("own.a.heading"), F.col("own.birth")))
    return rows.select(*SERIES, "row_key", "display", F.coalesce("own.z.heading", named).alias("heading"), formerly.alias("formerly"), "members", "score", "threads")


def row_cells(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """(series, row_key, fy, label, words, renamed): the cells of a row's threads at a transition as one."""
    keyed = rows.select(*SERIES, "row_key", F.explode("threads").alias("thread")).join(cells.drop(*SERIES), "thread")
    out = keyed.groupBy(*SERIES, "row_key", "fy").agg(F.collect_set("label").alias("labels"), F.sum("changed_words").cast("long").alias("words"), F.bool_or("renamed").alias("renamed"))
    return out.select(*SERIES, "row_key", "fy", ch.row_label(F.col("labels")).alias("label"), "words", "renamed")


def section_rows(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(section_id, row_key): which row each section of a series is on."""
    return rows.select("row_key", F.explode("threads").alias("thread")).join(members.select("thread", "section_id"), "thread").select("section_id", "row_key")


def transition_heat(cells: DataFrame) -> DataFrame:
    """(series, fy, words, heat): words that changed at each transition, as a share of the series' greatest, 4 per cent at least."""
    w = Window.partitionBy(*SERIES)
    n = cells.groupBy(*SERIES, "fy").agg(F.sum("changed_words").cast("long").alias("words"))
    peak = F.greatest(F.max("words").over(w), F.lit(1))
    return n.select(*SERIES, "fy", "words", F.greatest(F.lit(4), F.round(100 * F.col("words") / peak)).cast("int").alias("heat"))


def paragraph_origins(diffs: DataFrame, moves: DataFrame, order: DataFrame) -> DataFrame:
    """(key, first_fy, edited_fy, edit, moved_fy, moved_from) of the paragraphs of every edition that a later comparison reads.

    diffs: pair, new_id, new_idx, old_id, old_idx, change. moves: pair, old_key, new_key, change, old_heading. order: pair,
    old_fy, new_fy. A move counts over the diff of the same paragraph. Steps back are doubled each round until none is left.
    """
    key = lambda a, b: F.concat_ws(":", a, b)
    none = F.lit(None)
    stay = diffs.where("old_idx IS NOT NULL AND new_idx IS NOT NULL").select("pair", key("new_id", "new_idx").alias("node"), key("old_id", "old_idx").alias("prev"), "change", none.cast("string").alias("moved"))
    went = moves.select("pair", F.col("new_key").alias("node"), F.col("old_key").alias("prev"), "change", F.coalesce("old_heading", F.lit("")).alias("moved"))
    both = stay.join(went.select("pair", "node"), ["pair", "node"], "left_anti").unionByName(went).join(order, "pair")
    fresh = diffs.where("old_idx IS NULL").join(order, "pair").select(key("new_id", "new_idx").alias("node"), F.col("new_fy").alias("fy"))
    last = F.when(F.col("change") != "unchanged", F.struct(F.col("new_fy").alias("fy"), "change"))
    move = F.when(F.col("moved").isNotNull(), F.struct(F.col("new_fy").alias("fy"), "moved"))
    state = cut(both.select("node", F.col("prev").alias("at"), last.alias("e"), move.alias("m"), F.col("old_fy").alias("fy")))
    while True:
        up = state.select(F.col("node").alias("at"), F.col("at").alias("at2"), F.col("e").alias("e2"), F.col("m").alias("m2"), F.col("fy").alias("fy2"))
        step = state.join(up, "at", "left").select("node", F.coalesce("at2", "at").alias("at"), F.coalesce("e", "e2").alias("e"), F.coalesce("m", "m2").alias("m"), F.coalesce("fy2", "fy").alias("fy"), F.col("at2").isNotNull().alias("further"))
        before, step = state, cut(step)
        release(before)
        state = step
        if step.where("further").isEmpty():
            break
    old = state.select(F.col("node").alias("key"), F.col("fy").alias("first_fy"), F.col("e.fy").alias("edited_fy"), F.col("e.change").alias("edit"), F.col("m.fy").alias("moved_fy"), F.col("m.moved").alias("moved_from"))
    new = fresh.join(state.select("node"), "node", "left_anti").select(F.col("node").alias("key"), F.col("fy").alias("first_fy"), none.cast("int").alias("edited_fy"), none.cast("string").alias("edit"), none.cast("int").alias("moved_fy"), none.cast("string").alias("moved_from"))
    return old.unionByName(new)


def origin_label(first_fy, start_fy, edited_fy, edit, moved_fy, moved_from) -> F.col:
    """What a reader is told of a paragraph: when it was added, last edited and moved; 'unchanged since' the series' start if none of these.

    start_fy: the first year of the series. An edit in the year of the addition is part of it.
    """
    verb = F.when(edit == "numbers only", "figures updated").when(edit == "minor", "tweaked").otherwise("revised")
    added = F.when(first_fy > start_fy, F.concat(F.lit("added FY"), first_fy))
    edited = F.when(edited_fy.isNotNull() & (added.isNull() | (edited_fy != first_fy)), F.concat(verb, F.lit(" FY"), edited_fy))
    moved = F.when(moved_fy.isNotNull(), F.concat(F.lit("moved from "), moved_from, F.lit(" (FY"), moved_fy, F.lit(")")))
    said = F.concat_ws("; ", added, edited, moved)
    return F.when(said == "", F.concat(F.lit("unchanged since FY"), start_fy)).otherwise(said)
