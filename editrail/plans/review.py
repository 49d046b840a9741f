"""Holding a comparison against reviewers: reference units taken from the texts alone, what the comparison made of each, and scores.

The units share no code with the segmenter but the bounds of the body: paragraphs by indent and blank lines only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from editrail.functions import policy
from editrail.functions import similarity as sim
from editrail.functions.text import WRAP_HYPHEN, comparison_key
from editrail.operators import diff as df_
from editrail.operators.segment import LEADER, body_bounds, indent, report_text
from editrail.runtime import cut, spread

# Bars of pairing and locating units, sizes of samples, and labels that a reader need not act on.
PAIR_RATIO, LOCATE_RATIO = 60.0, 90.0
SMALL_EDIT, LEAST_WORDS, DEEP_INDENT, LONGEST_HEADING = 12, 4, 9, 90
BATCH = 70
BLOCK = 512
QUIET_KINDS = ("editorial", "routine_numbers", "renumbering")
PACKET = {"3 flag, looks right": 6, "4 quiet, looks right": 4}


def split_paragraphs(raw: str) -> list[tuple[str, str]]:
    """(heading, text) of the paragraphs of a report, by indent, blank lines and leaders; very short ones are left out."""
    lines = report_text(raw).split("\n")
    start, end = body_bounds(lines)
    out: list[tuple[str, str]] = []
    held: list[str] = []
    heading = ""

    def close() -> None:
        text = re.sub(WRAP_HYPHEN, "", re.sub(r"\s+", " ", " ".join(held)).strip())
        if len(text.split()) >= LEAST_WORDS:
            out.append((heading, text))
        held.clear()

    for line in lines[start:end]:
        t, deep = line.strip(), indent(line)
        if not t or re.search(LEADER, line) or 2 <= deep:
            close()
        if t and not re.search(LEADER, line):
            if deep >= DEEP_INDENT:
                heading = t if re.search("[A-Za-z]", t) and len(t) < LONGEST_HEADING else heading
            elif deep >= 2 or held:
                held.append(t)
    close()
    return out


def reference_paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, heading, text) of the reference paragraphs of every document; null texts have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, h, t) for k, raw in zip(f["key"], f["text"]) for i, (h, t) in enumerate(split_paragraphs(raw))]
            yield pd.DataFrame(rows, columns=["key", "idx", "heading", "text"])

    slim = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = spread(slim).mapInPandas(run, f"key {slim.schema['key'].dataType.simpleString()}, idx int, heading string, text string")
    return out.withColumnRenamed("key", key)


def close_pairs(a: DataFrame, b: DataFrame, scope: list[str], least: float) -> DataFrame:
    """(scope, a, b, score) of the texts a of the one table and b of the other that are at least so alike; equal ones too.

    The texts of a scope, by length, are cut into blocks; two blocks are one row's work, unless their lengths alone rule all pairs
    out. Within it a bound from lengths and counted characters drops pairs before any is scored.
    """
    w = lambda c: Window.partitionBy(*scope).orderBy(F.length(c), c)

    def blocks(df: DataFrame, c: str) -> DataFrame:
        t = df.where(F.col(c).isNotNull()).select(*scope, c).distinct().withColumn("block", F.floor((F.row_number().over(w(c)) - 1) / BLOCK))
        return t.groupBy(*scope, "block").agg(F.min(F.length(c)).alias(f"{c}_least"), F.max(F.length(c)).alias(f"{c}_most"), F.collect_list(c).alias(c)).drop("block")

    both = blocks(a, "a").join(blocks(b, "b"), scope)
    meet = lambda short, long: 200 * F.col(short) >= least * (F.col(short) + F.col(long))
    both = both.where((meet("a_most", "b_least") | (F.col("a_most") >= F.col("b_least"))) & (meet("b_most", "a_least") | (F.col("b_most") >= F.col("a_least"))))
    both = both.select(*scope, "a", "b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(*of, x, y, r) for *of, xs, ys in f.itertuples(index=False) for x, y, r in sim.alike(list(xs), list(ys), least)]
            yield pd.DataFrame(rows, columns=[*scope, "a", "b", "score"])

    types = ", ".join(f"`{c}` {both.schema[c].dataType.simpleString()}" for c in scope)
    return both.mapInPandas(run, f"{types}, a string, b string, score double")


def extract_units(olds: DataFrame, news: DataFrame, scope: list[str]) -> DataFrame:
    """scope, type, old_idx, new_idx, old_heading, new_heading, old_text, new_text, changed_words of what differs between two texts.

    olds, news: scope, idx, heading, text. Paragraphs of one comparison key pair in order, the k-th with the k-th, and are
    relocated if their headings differ. Of the rest, those that are each other's most alike are edited if alike enough, all
    others removed or added. idx is unique within a scope and gives the order.
    """
    side = lambda df, s: df.select(*scope, comparison_key(F.col("text")).alias("key"), F.lit(s).alias("side"), F.struct("idx", "heading", "text").alias("p"))
    # both sides are shuffled once; what stands on both under one heading is no unit and goes no further
    lines = side(olds, "old").unionByName(side(news, "new")).repartition(*scope, "key")
    lines = lines.withColumn("nth", F.row_number().over(Window.partitionBy(*scope, "key", "side").orderBy("p.idx")))
    of = lambda s: F.max(F.when((F.col("side") == s) & F.col("key").isNotNull(), F.col("p"))).alias(s)
    both = lines.groupBy(*scope, "key", "nth").agg(of("old"), of("new"))
    both = both.where("old IS NULL OR new IS NULL OR NOT old.heading <=> new.heading")
    both = cut(both.select(*scope, "key", "nth", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("old", "new") for c in ("idx", "heading", "text")]))
    relocated = both.where("old_idx IS NOT NULL AND new_idx IS NOT NULL").withColumn("type", F.lit("relocated"))
    rest = lambda s, other: both.where(F.col(f"{other}_idx").isNull()).select(*scope, "key", f"{s}_idx", f"{s}_heading", f"{s}_text", "nth")
    o, n = rest("old", "new"), rest("new", "old")
    scored = close_pairs(o.withColumnRenamed("key", "a"), n.withColumnRenamed("key", "b"), scope, PAIR_RATIO)
    cand = scored.join(o.withColumnRenamed("key", "a").drop("nth"), [*scope, "a"]).join(n.withColumnRenamed("key", "b").drop("nth"), [*scope, "b"])
    best = lambda s, t: F.row_number().over(Window.partitionBy(*scope, f"{s}_idx").orderBy(F.desc("score"), f"{t}_idx")) == 1
    edited = cand.withColumn("ob", best("old", "new")).withColumn("nb", best("new", "old")).where("ob AND nb").withColumn("type", F.lit("edited"))
    edited = cut(edited.drop("a", "b", "ob", "nb"))
    left = lambda df, s: df.join(edited.select(*scope, f"{s}_idx"), [*scope, f"{s}_idx"], "left_anti")
    none = F.lit(None)
    removed = left(o, "old").select(*scope, F.lit("removed").alias("type"), "old_idx", none.cast("long").alias("new_idx"), "old_heading", none.cast("string").alias("new_heading"), "old_text", none.cast("string").alias("new_text"))
    added = left(n, "new").select(*scope, F.lit("added").alias("type"), none.cast("long").alias("old_idx"), "new_idx", none.cast("string").alias("old_heading"), "new_heading", none.cast("string").alias("old_text"), "new_text")
    cols = [*scope, "type", "old_idx", "new_idx", "old_heading", "new_heading", "old_text", "new_text"]
    rows = relocated.select(*cols).unionByName(edited.select(*cols)).unionByName(removed.select(*cols)).unionByName(added.select(*cols))
    return rows.withColumn("changed_words", F.when(F.col("old_text").isNotNull() & F.col("new_text").isNotNull(), sim.edited_words(sim.edits("old_text", "new_text"))))


def sample_units(units: DataFrame, scope: list[str], unit_id: str, n: int) -> DataFrame:
    """All small edits, and so many of the other units of each scope by a hash of their id; with the batch each goes to a reviewer in."""
    small = (F.col("type") == "edited") & (F.coalesce("changed_words", F.lit(0)) <= SMALL_EDIT)
    turn = F.row_number().over(Window.partitionBy(*scope, small).orderBy(F.md5(F.col(unit_id).cast("string")), unit_id))
    kept = units.withColumn("small", small).withColumn("turn", turn).where(F.col("small") | (F.col("turn") <= n))
    place = F.row_number().over(Window.partitionBy(*scope).orderBy(unit_id)) - 1
    return kept.withColumn("batch", F.floor(place / BATCH).cast("int")).drop("small", "turn")


def tool_view(comparison) -> dict[str, DataFrame]:
    """What a comparison shows, by comparison key of the texts: edits, moves, added, removed, and all paragraphs of both sides with their section's anchor."""
    key = lambda c: comparison_key(F.coalesce(F.col(c), F.lit("")))
    d, m = comparison.paragraphs, comparison.matching
    edits = d.where("old_idx IS NOT NULL AND new_idx IS NOT NULL AND change <> 'unchanged'").select("pair", key("old_text").alias("ok"), key("new_text").alias("nk"), "change", "literal", "flags")
    moves = comparison.moves.select("pair", key("old_text").alias("ok"), key("new_text").alias("nk"), "change", F.col("change").alias("literal"), "flags")
    texts = lambda side: side.select("pair", "section_id", F.explode("paragraphs").alias("p")).select("pair", "section_id", comparison_key(F.coalesce("p.text", F.lit(""))).alias("k"))
    lone = lambda side, label, text: texts(side).select("pair", "k").unionByName(d.where(F.col("change") == label).select("pair", key(text).alias("k"))).distinct()
    at = comparison.sections.select("pair", "old_id", "new_id", "anchor")
    anchored = lambda side, id_: texts(side).join(at.select("pair", F.col(id_).alias("section_id"), "anchor"), ["pair", "section_id"], "left").select("pair", "k", "anchor")
    return {"edits": edits, "moves": moves, "added": lone(m.added, "new", "new_text"), "removed": lone(m.removed, "dropped", "old_text"), "old": anchored(m.old, "old_id"), "new": anchored(m.new, "new_id")}


def locate(units: DataFrame, view: dict[str, DataFrame]) -> DataFrame:
    """units with what the comparison did with each: status, change, literal, flags.

    units: pair, unit, type, old_text, new_text. The first that applies: moved, edited; of units with both sides mispaired (its
    old side went with another), split (dropped and new), missing (a side is nowhere), unchanged; of units with one side added
    or removed, absorbed (paired after all), missing, unchanged.
    """
    u = units.withColumn("ok", comparison_key(F.col("old_text"))).withColumn("nk", comparison_key(F.col("new_text")))

    def near(side: str, whole: str, lone: str, seen: str, alone: str) -> DataFrame:
        """(pair, unit, side, had, alone) of the view's texts of a side that are a unit's, or nearly: whether an edition has them, and whether they are without counterpart."""
        mark = lambda df, k, had, by: df.select("pair", F.col(k).alias("k")).distinct().select("pair", "k", F.lit(had).alias(seen), F.lit(by).alias(alone))
        texts = mark(view[whole], "k", True, False).unionByName(mark(view[lone], "k", False, True))
        texts = texts.unionByName(mark(e, side, False, False)).unionByName(mark(m, side, False, False)).where("k IS NOT NULL")
        texts = cut(texts.groupBy("pair", "k").agg(F.bool_or(seen).alias(seen), F.bool_or(alone).alias(alone)))
        own = u.where(F.col(side).isNotNull()).select("pair", "unit", F.col(side).alias("a"))
        close = close_pairs(own, texts.select("pair", F.col("k").alias("b")), ["pair"], LOCATE_RATIO).drop("score")
        return cut(own.join(close, ["pair", "a"]).withColumnRenamed("b", "k").join(texts, ["pair", "k"]).select("pair", "unit", F.col("k").alias(side), seen, alone))

    e, m = cut(view["edits"]), cut(view["moves"])
    old_near, new_near = near("ok", "old", "removed", "had_old", "gone"), near("nk", "new", "added", "had_new", "come")
    by_old, by_new = old_near.select("pair", "unit", "ok"), new_near.select("pair", "unit", "nk")
    names = ("had_old", "gone", "had_new", "come")
    none = F.lit(None).cast(e.select(F.struct("change", "literal", "flags", "ok", "nk").alias("s")).schema["s"].dataType)
    seen = lambda df: df.select("pair", "unit", none.alias("row"), F.lit(None).cast("string").alias("name"), *[F.col(c) if c in df.columns else F.lit(False).alias(c) for c in names])
    rows = seen(old_near).unionByName(seen(new_near))
    # a shown row counts for a unit by either side, or by both
    for shown, s in ((m, "m"), (e, "e")):
        for hit, name in ((shown.join(by_old, ["pair", "ok"]), "old"), (shown.join(by_new, ["pair", "nk"]), "new"), (shown.join(by_old, ["pair", "ok"]).join(by_new, ["pair", "unit", "nk"]), "both")):
            rows = rows.unionByName(hit.select("pair", "unit", F.struct("change", "literal", "flags", "ok", "nk").alias("row"), F.lit(f"{s}_{name}").alias("name"), *[F.lit(False).alias(c) for c in names]))
    first = lambda name: F.min_by(F.struct("row.change", "row.literal", "row.flags"), F.when(F.col("name") == name, F.struct("row.ok", "row.nk"))).alias(name)
    found = rows.groupBy("pair", "unit").agg(*[first(f"{s}_{name}") for s in "me" for name in ("old", "new", "both")], *[F.bool_or(c).alias(c) for c in names])
    u = u.join(found, ["pair", "unit"], "left")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    old, new = F.col("old_text").isNotNull(), F.col("new_text").isNotNull()
    moved = F.when(old & new, F.col("m_both")).when(old, F.col("m_old")).otherwise(F.col("m_new"))
    one = F.when(new, F.col("e_new")).otherwise(F.col("e_old"))
    status = (
        F.when(moved.isNotNull(), "moved")
        .when(old & new & F.col("e_both").isNotNull(), "edited")
        .when(old & new & F.col("e_old").isNotNull(), "mispaired")
        .when(old & new & is_("gone") & is_("come"), "split")
        .when(old & new & (F.col("type") == "relocated"), "unchanged")
        .when(old & new & ~(is_("had_old") & is_("had_new")), "missing")
        .when(old & new, "unchanged")
        .when(new & is_("come"), "added")
        .when(~new & is_("gone"), "removed")
        .when(one.isNotNull(), "absorbed")
        .when(F.when(new, is_("had_new")).otherwise(is_("had_old")), "unchanged")
        .otherwise("missing")
    )
    said = F.when(F.col("status") == "moved", moved).when(F.col("status") == "edited", F.col("e_both")).when(F.col("status") == "absorbed", one)
    return u.withColumn("status", status).withColumn("said", said).select(*units.columns, "status", "said.change", "said.literal", "said.flags")


def surfaced(status: Column, change: Column) -> Column:
    """Whether a reader of the ranked page is pointed at a unit; by the literal class in place of change, whether size alone would do."""
    return status.isin("added", "removed", "split") | (status.isin("edited", "moved", "absorbed") & (F.coalesce(df_.class_rank(change), F.lit(-1)) >= 3))


def promoted(status: Column, flags: Column) -> Column:
    return status.isin("edited", "moved") & (df_.max_tier(flags) >= policy.REVIEW)


def score_units(located: DataFrame, remap: dict[str, str] | None = None) -> DataFrame:
    """One row per comparison of what reviewers' labels say of it.

    located: pair, type, changed_words, status, change, literal, flags, label, reviewer, same_passage. remap: labels to read as
    others. Units out of scope count as labelled only; where the reference paired what are two passages, no disagreement counts.
    """
    label = F.col("label")
    if remap:
        label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in remap.items() for x in kv]), label), label)
    d = located.withColumn("label", label).withColumn("in", F.col("label") != "out_of_scope")
    status, small = F.col("status"), (F.col("type") == "edited") & (F.coalesce("changed_words", F.lit(0)) <= SMALL_EDIT)
    apart, wanted = ~F.coalesce("same_passage", F.lit(True)), F.col("label") == "substantive"
    quiet = F.col("label").isin(*QUIET_KINDS) & status.isin("edited", "moved")
    flagged = promoted(status, F.col("flags"))
    odd = status.isin("mispaired", "split", "absorbed") & ~apart
    n = lambda c, name: F.count_if(F.col("in") & c).alias(name)
    out = d.groupBy("pair").agg(
        F.count("*").alias("labelled"), F.count_if(F.coalesce("reviewer", F.lit("draft")) != "draft").alias("adjudicated"), n(wanted, "substantive"), n(wanted & small, "substantive_small"),
        n(wanted & ~surfaced(status, F.col("change")), "missed"), n(wanted & ~surfaced(status, F.col("literal")), "missed_by_size"), n(wanted & small & ~surfaced(status, F.col("change")), "missed_small"),
        n(wanted & (status == "missing"), "lost_in_segmentation"), n(quiet, "quiet"), n(quiet & flagged, "false_alarms"), n(quiet & (F.coalesce(df_.class_rank(F.col("literal")), F.lit(-1)) >= 3), "false_alarms_by_size"),
        n(flagged, "promoted"), n(flagged & wanted, "promoted_right"), n(F.col("label") == "funding_amount", "funding"), n((F.col("label") == "funding_amount") & flagged, "funding_promoted"),
        n(odd, "disagreements"), n(odd & (status == "mispaired"), "mispaired"), n(odd & (status == "split"), "split"), n(odd & (status == "absorbed"), "absorbed"),
        n((F.col("type") == "relocated") & (F.col("label") == "moved") & (status == "unchanged"), "moves_not_shown"), n(apart, "reference_mispairs"),
    )
    return out.withColumn("precision", F.col("promoted_right") / F.nullif(F.col("promoted"), F.lit(0)))


def review_packet(located: DataFrame, anchors: DataFrame) -> DataFrame:
    """Units for a person to look at: all misses and false alarms, some right flags and right silences by a hash, with the place on the page.

    located: as score_units takes it, with unit and new_text. anchors: pair, k, anchor of the newer side.
    """
    status, flagged = F.col("status"), promoted(F.col("status"), F.col("flags"))
    wanted, quiet = F.col("label") == "substantive", F.col("label").isin(*QUIET_KINDS)
    below = F.coalesce(df_.class_rank(F.col("change")), F.lit(-1)) < 3
    group = (
        F.when(wanted & ~surfaced(status, F.col("change")), "1 missed substantive")
        .when(quiet & flagged, "2 false alarm")
        .when(wanted & flagged, "3 flag, looks right")
        .when(quiet & (status == "edited") & ~flagged & below, "4 quiet, looks right")
    )
    turn = F.row_number().over(Window.partitionBy("pair", "group").orderBy(F.md5(F.col("unit").cast("string")), "unit"))
    most = F.element_at(F.create_map(*[F.lit(x) for kv in PACKET.items() for x in kv]), F.col("group"))
    rows = located.withColumn("group", group).where("group IS NOT NULL").withColumn("turn", turn).where(F.col("turn") <= F.coalesce(most, F.lit(1 << 30))).drop("turn")
    place = anchors.groupBy("pair", "k").agg(F.min("anchor").alias("anchor"))
    return rows.withColumn("k", comparison_key(F.coalesce("new_text", "old_text"))).join(place, ["pair", "k"], "left").drop("k")


def migrate_labels(labels: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, lost): labels with the texts they were given on, and those whose texts no candidate file has any more.

    labels: id, old_text, new_text (null where a label has none yet) and others. evidence: id, old_text, new_text.
    """
    found = evidence.groupBy("id").agg(F.min(F.struct("old_text", "new_text")).alias("e"))
    both = labels.join(found, "id", "left")
    has = F.col("old_text").isNotNull() | F.col("new_text").isNotNull()
    said = {c: F.when(has, F.col(c)).otherwise(F.col(f"e.{c}")).alias(c) for c in ("old_text", "new_text")}
    kept = both.where(has | F.col("e").isNotNull()).select(*[said.get(c, F.col(c)) for c in labels.columns])
    return kept, both.where(~has & F.col("e").isNull()).select(*labels.columns)


def check_units_known(labels: DataFrame, units: DataFrame, scope: list[str], unit_id: str) -> None:
    """Fail if a label names a unit that isn't there."""
    strange = labels.join(units.select(*scope, unit_id), [*scope, unit_id], "left_anti").limit(5).collect()
    if strange:
        raise ValueError(f"labels of unknown units: {[tuple(r[c] for c in [*scope, unit_id]) for r in strange]}")


def render_agreement(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """(key, words, agreement): how much of one rendering of a document the other has in the same order. ours, theirs: key, text."""
    plain = lambda c: F.array_join(F.transform(F.regexp_extract_all(F.replace(F.lower(F.regexp_replace(c, r"-\s*\n\s*", "-")), F.lit("--"), F.lit(" ")), F.lit(r"[a-z0-9$][\w$,.'%-]*"), F.lit(0)), lambda w: F.regexp_replace(w, r"\.+$", "")), " ")
    both = ours.select(key, plain(F.col("text")).alias("a")).join(theirs.select(key, plain(F.col("text")).alias("b")), key)
    return both.select(key, F.size(F.split("a", " ")).alias("words"), sim.agreement("a", "b").alias("agreement"))
