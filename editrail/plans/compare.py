"""The comparison of editions as one composition: align, promote renames, diff, find moves, rank, name.

All pairs of editions at once. Each stage that several others read is cut to the checkpoint folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from editrail.functions.text import word_count
from editrail.operators import align as al
from editrail.operators import chain as ch
from editrail.operators import diff as df_
from editrail.runtime import cut, small


@dataclass
class Matching:
    """The sections of both sides, those matched by any pass, and those of one side only; all keyed by pair."""

    pairs: DataFrame
    old: DataFrame
    new: DataFrame
    matched: DataFrame
    candidates: DataFrame
    scored: DataFrame
    renamed: DataFrame
    removed: DataFrame
    added: DataFrame


@dataclass
class Comparison:
    """Tables keyed by pair; sections by old_id and new_id, null where an edition lacks the section."""

    matching: Matching
    matched: DataFrame
    related: DataFrame
    paragraphs: DataFrame
    moves: DataFrame
    sections: DataFrame


def _words(paragraphs) -> F.col:
    return F.aggregate(paragraphs, F.lit(0), lambda n, p: n + word_count(F.coalesce(p["text"], F.lit("")))).cast("long")


def loose_paragraphs(side: DataFrame, alone: DataFrame, diffs: DataFrame, old_side: bool) -> DataFrame:
    """(pair, section, key, ord, text, topic, kind) of paragraphs without a counterpart: of sections of one side, and inside matched sections."""
    id_, idx, text, label = ("old_id", "old_idx", "old_text", "dropped") if old_side else ("new_id", "new_idx", "new_text", "new")
    whole = alone.select("pair", F.col("section_id").alias("section"), F.posexplode("paragraphs").alias("idx", "p")).select("pair", "section", "idx", "p.text", "p.topic", "p.kind")
    inside = diffs.where(F.col("change") == label).select("pair", F.col(id_).alias("section"), F.col(idx).alias("idx"), F.col(text).alias("text"), "topic", "kind")
    rows = whole.unionByName(inside).where("text IS NOT NULL AND text <> ''")
    rows = rows.join(side.select("pair", F.col("section_id").alias("section"), "seq", "heading"), ["pair", "section"])
    return rows.select("pair", "section", F.concat_ws(":", "section", "idx").alias("key"), (F.shiftleft(F.col("seq").cast("long"), 32) + F.col("idx")).alias("ord"), "text", "topic", "kind", "heading")


def find_moves(gone: DataFrame, come: DataFrame) -> DataFrame:
    """(pair, old_key, new_key, how, score): verbatim, then of one topic, then nearly verbatim; each paragraph once."""
    scope = ["pair"]
    rest = lambda side, moves, key: side.join(moves.select("pair", F.col(key).alias("key")), ["pair", "key"], "left_anti")
    first = cut(ch.moved_verbatim(gone, come, scope).select("pair", "old_key", "new_key", F.lit("verbatim").alias("how"), F.lit(None).cast("double").alias("score")))
    gone, come = rest(gone, first, "old_key"), rest(come, first, "new_key")
    second = cut(ch.moved_same_topic(gone, come, scope).select("pair", "old_key", "new_key", F.lit("topic").alias("how"), F.col("score").cast("double").alias("score")))
    gone, come = cut(rest(gone, second, "old_key")), cut(rest(come, second, "new_key"))
    third = ch.moved_nearly(gone, come, scope).select("pair", "old_key", "new_key", F.lit("near").alias("how"), F.col("score").cast("double").alias("score"))
    return first.unionByName(second).unionByName(third)


def match(pairs: DataFrame, sections: DataFrame, whole: bool = False) -> Matching:
    """Sections through all passes: guarded exact path, unique heading, fuzzy heading, content, promoted renames."""
    pairs = cut(pairs)
    sections = cut(sections.select("section_id", "package_id", "seq", "sort_order", "heading", "level", "path", "paragraphs"))
    old, new = al.sides(pairs, sections)
    matched, candidates, scored = al.align(old, new, whole)
    path_of = lambda side, id_, name: side.select("pair", F.col("section_id").alias(id_), F.col("path").alias(name))
    paths = matched.join(path_of(old, "old_id", "old_path"), ["pair", "old_id"]).join(path_of(new, "new_id", "new_path"), ["pair", "new_id"])
    renamed = al.promote_renames(al.best_counterparts(scored, matched), paths).select("pair", "old_id", "new_id", F.lit("renamed").alias("match_pass"), "score")
    matched = cut(matched.unionByName(renamed))
    removed, added = cut(al.left_over(old, matched, "old_id")), cut(al.left_over(new, matched, "new_id"))
    return Matching(pairs, old, new, matched, candidates, scored, matched.where("match_pass = 'renamed'"), removed, added)


def with_paragraphs(m: Matching) -> DataFrame:
    """The matched sections with the paragraphs of both sides, and the years between them."""
    texts = lambda side, id_, name: side.select("pair", F.col("section_id").alias(id_), F.col("paragraphs").alias(name))
    rows = m.matched.join(texts(m.old, "old_id", "old_paragraphs"), ["pair", "old_id"]).join(texts(m.new, "new_id", "new_paragraphs"), ["pair", "new_id"])
    return rows.join(small(m.pairs.select("pair", "year_delta")), "pair")


def section_classes(matched: DataFrame, diffs: DataFrame) -> DataFrame:
    """(pair, old_id, new_id, change, changed_words) of every matched section; without paragraphs it is unchanged."""
    per_section = matched.select("pair", "old_id", "new_id").join(df_.section_diffs(diffs), ["pair", "old_id", "new_id"], "left")
    return per_section.select("pair", "old_id", "new_id", F.coalesce("change", F.lit("unchanged")).alias("change"), F.coalesce("changed_words", F.lit(0)).alias("changed_words"))


def compare(pairs: DataFrame, sections: DataFrame, whole: bool = False) -> Comparison:
    m = match(pairs, sections, whole)
    old, new, matched, renamed, removed, added = m.old, m.new, m.matched, m.renamed, m.removed, m.added
    hints = al.related(al.best_counterparts(m.scored, matched))
    diffs = cut(df_.paragraph_diffs(with_paragraphs(m)))

    gone, come = cut(loose_paragraphs(old, removed, diffs, True)), cut(loose_paragraphs(new, added, diffs, False))
    moves = find_moves(gone, come)
    side = lambda df, s: df.select("pair", F.col("key").alias(f"{s}_key"), F.col("section").alias(f"{s}_section"), F.col("text").alias(f"{s}_text"), F.col("heading").alias(f"{s}_heading"))
    moves = moves.join(side(gone, "old"), ["pair", "old_key"]).join(side(come, "new"), ["pair", "new_key"]).join(small(m.pairs.select("pair", "year_delta")), "pair")
    moves = cut(df_.text_diffs(moves))

    # words that merely moved count for neither section
    still = moves.where("old_text = new_text").withColumn("words", word_count(F.col("old_text")).cast("long"))
    off_old = still.groupBy("pair", F.col("old_section").alias("old_id")).agg(F.sum("words").alias("off_old"))
    off_new = still.groupBy("pair", F.col("new_section").alias("new_id")).agg(F.sum("words").alias("off_new"))
    per_section = section_classes(matched, diffs)
    lone = lambda df, o, n, label: df.select("pair", o.alias("old_id"), n.alias("new_id"), F.lit(label).alias("change"), _words("paragraphs").alias("changed_words"))
    none = F.lit(None).cast("long")
    rows = per_section.unionByName(lone(removed, F.col("section_id"), none, "dropped")).unionByName(lone(added, none, F.col("section_id"), "new"))
    rows = rows.join(off_old, ["pair", "old_id"], "left").join(off_new, ["pair", "new_id"], "left")
    rows = rows.withColumn("changed_words", F.greatest(F.lit(0).cast("long"), F.col("changed_words") - F.coalesce("off_old", F.lit(0)) - F.coalesce("off_new", F.lit(0))))

    name = F.concat_ws(":", "pair", F.coalesce(F.col("old_id").cast("string"), F.lit("-")), F.coalesce(F.col("new_id").cast("string"), F.lit("-")))
    rows, keyed = rows.withColumn("section", name), diffs.withColumn("section", name)
    flags = keyed.select("section", F.col("idx").alias("paragraph"), F.explode("flags.category").alias("category"))
    lift = keyed.select("section", ch.boost(F.col("kind"), F.col("change")).alias("boost"))
    directive = F.exists("paragraphs", lambda p: p["kind"] == "directive")
    alone = removed.select("pair", F.col("section_id").alias("old_id"), none.alias("new_id"), directive.alias("d")).unionByName(added.select("pair", none.alias("old_id"), F.col("section_id").alias("new_id"), directive.alias("d")))
    lift = lift.unionByName(alone.where("d").select(name.alias("section"), F.lit(ch.LONE_DIRECTIVE).alias("boost"))).groupBy("section").agg(F.max("boost").alias("boost"))
    ranked = ch.significance(rows.drop("off_old", "off_new"), flags, lift)

    about = lambda side, id_, s: side.select("pair", F.col("section_id").alias(id_), F.col("path").alias(f"{s}_path"), F.col("heading").alias(f"{s}_heading"), F.col("seq").alias(f"{s}_seq"))
    ranked = ranked.join(about(old, "old_id", "old"), ["pair", "old_id"], "left").join(about(new, "new_id", "new"), ["pair", "new_id"], "left")
    ranked = ranked.join(renamed.select("pair", "old_id", "new_id", F.lit(True).alias("renamed")), ["pair", "old_id", "new_id"], "left")
    leaf = lambda c: F.element_at(c, -1)
    ranked = ranked.withColumn("renamed_from", F.when(F.col("renamed") & (leaf("old_path") != leaf("new_path")), F.col("old_heading")))
    ranked = ranked.withColumn("path", F.coalesce("new_path", "old_path")).withColumn("heading", F.coalesce("new_heading", "old_heading"))
    order = [F.desc("score"), "path", F.coalesce("new_seq", "old_seq"), "new_id", "old_id"]
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("pair").orderBy(*order)))
    ranked = ch.with_anchors(ranked, ["pair"], ["place"])
    out = ranked.select("pair", "old_id", "new_id", "change", "changed_words", "score", "path", "heading", "renamed_from", "old_seq", "new_seq", "place", "anchor")
    return Comparison(m, matched, hints, diffs, moves, cut(out))
