"""Result tables that a reader works with: counts, summaries, timelines, redlines and a plain page."""

from __future__ import annotations

import html
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from editrail.functions import policy
from editrail.operators.chain import stitched
from editrail.operators.diff import max_tier
from editrail.runtime import cut

#: An edition with fewer sections than this is a stub and no part of a chain.
LEAST_SECTIONS = 15


def transitions(editions: DataFrame) -> DataFrame:
    """(chamber, slug, from_fy, to_fy) of the neighbouring editions of every series of two or more."""
    w = Window.partitionBy("chamber", "slug").orderBy("fy")
    return editions.select("chamber", "slug", F.col("fy").alias("from_fy"), F.lead("fy").over(w).alias("to_fy")).where("to_fy IS NOT NULL")


def without_stubs(editions: DataFrame, sections: DataFrame, least: int = LEAST_SECTIONS) -> DataFrame:
    """Editions of at least so many sections, of series that keep at least two."""
    n = sections.groupBy("package_id").agg(F.count("*").alias("sections")).where(F.col("sections") >= least)
    kept = editions.join(n, "package_id")
    return kept.withColumn("years", F.count("*").over(Window.partitionBy("chamber", "slug"))).where("years >= 2").select("package_id", "chamber", "slug", "fy", "sections")


def redline(edits: Column) -> Column:
    """Word edits as text: <del>old</del> <ins>new</ins>, all else as it stands, HTML escaped."""
    safe = lambda ws: F.replace(F.replace(F.replace(F.array_join(ws, " "), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    gone = lambda e: F.when(F.size(e["old"]) > 0, F.concat(F.lit("<del>"), safe(e["old"]), F.lit("</del>")))
    come = lambda e: F.when(F.size(e["new"]) > 0, F.concat(F.lit("<ins>"), safe(e["new"]), F.lit("</ins>")))
    return F.array_join(F.transform(edits, lambda e: F.when(e["tag"] == "equal", safe(e["new"])).otherwise(F.concat_ws(" ", gone(e), come(e)))), " ")


def counts(section_diffs: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """(pair, change, n): how many sections of each class a comparison has."""
    rows = section_diffs.select("pair", "change")
    rows = rows.unionByName(removed.select("pair", F.lit("dropped").alias("change"))).unionByName(added.select("pair", F.lit("new").alias("change")))
    return rows.groupBy("pair", "change").agg(F.count("*").alias("n"))


def flag_summary(diffs: DataFrame) -> DataFrame:
    """(pair, category, size, n): flags by whether their paragraph changed little otherwise."""
    f = diffs.select("pair", "literal", F.explode("flags.category").alias("category"))
    size = F.when(F.col("literal").isin("minor", "numbers only"), "small").otherwise("large")
    return f.groupBy("pair", "category", size.alias("size")).agg(F.count("*").alias("n"))


def timeline(cells: DataFrame, years: list[int] | None = None) -> DataFrame:
    """(chamber, slug, heading, fy2010, fy2011, ...): how many sections of a heading changed in each year.

    Without years, there is a column for every fiscal year present: a bounded set, read by a query of its own.
    """
    if years is None:
        cells = cut(cells)
        years = sorted(r["fy"] for r in cells.select("fy").where("fy IS NOT NULL").distinct().collect())
    rows = cells.where("change NOT IN ('unchanged', 'numbers only')")
    return rows.groupBy("chamber", "slug", "heading").agg(*[F.count_if(F.col("fy") == y).alias(f"fy{y}") for y in years])


def stitch(cells: DataFrame, editions: DataFrame) -> DataFrame:
    """Threads that ended before their series and threads that began after its start, joined by name and title."""
    w = Window.partitionBy("chamber", "slug").orderBy("fy")
    years = editions.select("chamber", "slug", "fy", F.lead("fy").over(w).alias("next_fy"), F.min("fy").over(Window.partitionBy("chamber", "slug")).alias("first_fy"))
    t = cells.groupBy("thread").agg(F.min("fy").alias("from_fy"), F.max("fy").alias("to_fy"), F.first("chamber").alias("chamber"), F.first("slug").alias("slug"), F.min_by("path", "fy").alias("p0"), F.max_by("path", "fy").alias("p1"))
    key = lambda p: F.concat_ws(" > ", F.get(p, F.lit(0)), F.element_at(p, -1))
    dead = t.join(years.select("chamber", "slug", F.col("fy").alias("to_fy"), "next_fy"), ["chamber", "slug", "to_fy"]).where("next_fy IS NOT NULL")
    dead = dead.select("chamber", "slug", key("p1").alias("key"), F.col("thread").alias("id"), F.col("next_fy").alias("fy"))
    born = t.join(years.select("chamber", "slug", F.col("fy").alias("from_fy"), "first_fy"), ["chamber", "slug", "from_fy"]).where("from_fy > first_fy")
    born = born.select("chamber", "slug", key("p0").alias("key"), F.col("thread").alias("id"), F.col("from_fy").alias("fy"))
    same = lambda df: df.where(~F.col("key").rlike("> SEC "))
    return stitched(same(dead), same(born), ["chamber", "slug"])


def outline(sections: DataFrame) -> DataFrame:
    """(package_id, depth, node, prefix, first_seq, sections): nodes of each report's outline in reading order.

    A node goes on while the next section shares its path down to that depth; a name that comes back later is a new node.
    """
    by_report = Window.partitionBy("package_id").orderBy("seq", "section_id")
    s = sections.where(F.size("path") > 0).withColumn("before", F.lag("path").over(by_report))
    s = s.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size("path"))))
    cut_at = lambda c: F.slice(c, F.lit(1), F.col("depth"))
    s = s.withColumn("prefix", cut_at("path")).withColumn("starts", (~cut_at("before").eqNullSafe(F.col("prefix"))).cast("int"))
    w = Window.partitionBy("package_id", "depth").orderBy("seq", "section_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("node", F.sum("starts").over(w))
    return s.groupBy("package_id", "depth", "node").agg(F.first("prefix").alias("prefix"), F.min("seq").alias("first_seq"), F.count("*").alias("sections"))


def index_page(kinds: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """(pair, changed, new, dropped) of every comparison. kinds: pair, kind, n of the matched sections."""
    changed = kinds.where("kind <> 'unchanged'").select("pair", F.col("n").alias("changed"), F.lit(0).alias("new"), F.lit(0).alias("dropped"))
    new = added.select("pair", F.lit(0).alias("changed"), F.lit(1).alias("new"), F.lit(0).alias("dropped"))
    gone = removed.select("pair", F.lit(0).alias("changed"), F.lit(0).alias("new"), F.lit(1).alias("dropped"))
    return changed.unionByName(new).unionByName(gone).groupBy("pair").agg(*[F.sum(c).cast("long").alias(c) for c in ("changed", "new", "dropped")])


def manifest(index: DataFrame, pairs: DataFrame, flags: DataFrame, reports: DataFrame) -> DataFrame:
    """(pair, json): what a comparison holds, for machines: sections by class, flags for review, and what each side was read from.

    flags: pair, tier. reports: package_id, url, read_from, sha256 of both editions.
    """
    n = flags.where(F.col("tier") >= policy.REVIEW).groupBy("pair").agg(F.count("*").alias("review_flags"))
    about = lambda s: reports.select(F.col("package_id").alias(f"{s}_package"), F.struct("package_id", "url", "read_from", "sha256").alias(f"{s}_report"))
    rows = pairs.select("pair", "old_package", "new_package").join(index, "pair", "left").join(n, "pair", "left").join(about("old"), "old_package", "left").join(about("new"), "new_package", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return rows.select("pair", F.to_json(F.struct("pair", F.struct(zero("changed"), zero("new"), zero("dropped")).alias("sections"), zero("review_flags"), F.col("old_report").alias("old"), F.col("new_report").alias("new"))).alias("json"))


def shown_sections(sections: DataFrame, diffs: DataFrame, hide_unchanged: bool = True, hide_numbers: bool = False, directives_only: bool = False, flagged_only: bool = False) -> DataFrame:
    """The sections of a comparison that a reader's filters leave.

    sections: pair, old_id, new_id, change, directive (whether a directive stands in it). A section is flagged if a paragraph
    of it has a flag for review, and a directive one too if a side of one of its paragraphs is a directive.
    """
    marks = diffs.groupBy("pair", "old_id", "new_id").agg(F.max(max_tier(F.col("flags"))).alias("tier"), F.bool_or(F.col("kind") == "directive").alias("edited"))
    rows = sections.join(marks, ["pair", "old_id", "new_id"], "left").withColumn("tier", F.coalesce("tier", F.lit(0)))
    rows = rows.withColumn("directive", F.coalesce("directive", F.lit(False)) | F.coalesce("edited", F.lit(False)))
    hidden = F.lit(False)
    if hide_unchanged:
        hidden = hidden | (F.col("change") == "unchanged")
    if hide_numbers:
        hidden = hidden | (F.col("change") == "numbers only")
    if directives_only:
        hidden = hidden | ~F.col("directive")
    if flagged_only:
        hidden = hidden | (F.col("tier") < policy.REVIEW)
    return rows.where(~hidden).drop("edited")


def rewrite_links(page: Column, known: dict[str, str]) -> Column:
    """Links of a page to other pages of the set as marks of the view they open; other links stay."""
    for file, view in known.items():
        page = F.regexp_replace(page, 'href="' + re.escape(file) + '(#[^"]*)?"', f'href="$1" data-view="{view}"')
    return page


# Words that stay small inside a heading, and numerals that stay large.
SMALL_WORDS = ("a", "an", "and", "as", "at", "by", "for", "in", "of", "on", "or", "the", "to", "under", "with")
NUMERALS = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")


def display_heading(heading: Column) -> Column:
    """A heading without small letters as a reader wants it: each run of letters with a capital initial, small words small, numerals large."""
    words = F.filter(F.split(F.lower(heading), r"\s+"), lambda w: w != "")
    run = lambda r: F.when(r.isin(*NUMERALS), F.upper(r)).otherwise(F.concat(F.upper(F.left(r, F.lit(1))), F.substring(r, 2, 1 << 30)))
    cased = lambda w: F.array_join(F.transform(F.regexp_extract_all(w, F.lit("[a-z]+|[^a-z]+"), F.lit(0)), run), "")
    shown = F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*SMALL_WORDS), w).otherwise(cased(w)))
    return F.when(heading.rlike(r"\p{Ll}"), heading).otherwise(F.array_join(shown, " "))


def document_page(sections: DataFrame, diffs: DataFrame, moves: DataFrame) -> DataFrame:
    """The whole newer document in its order, dropped sections where they stood, a row to a paragraph: its redline and the notes beside it.

    sections: pair, old_id, new_id, place_new, place_old, heading, change. Notes are flags for review alone; a paragraph that
    moved says where from or to instead of counting as new or dropped.
    """
    key = lambda s: F.concat_ws(":", f"{s}_id", f"{s}_idx")
    said = F.when(F.col("change") == "new", F.concat(F.lit("<ins>"), F.col("new_text"), F.lit("</ins>"))).when(F.col("change") == "dropped", F.concat(F.lit("<del>"), F.col("old_text"), F.lit("</del>")))
    body = F.coalesce(said, F.when(F.size("edits") > 0, redline(F.col("edits"))), F.col("new_text"))
    notes = F.transform(F.filter("flags", lambda f: f["tier"] >= policy.REVIEW), lambda f: F.concat(f["category"], F.lit(": "), f["reason"]))
    rows = diffs.select("pair", "old_id", "new_id", "idx", "change", body.alias("body"), notes.alias("notes"), key("old").alias("old_key"), key("new").alias("new_key"))
    came = moves.select("pair", "new_key", F.concat(F.lit("moved from "), "old_heading").alias("came"))
    went = moves.select("pair", "old_key", F.concat(F.lit("moved to "), "new_heading").alias("went"))
    rows = rows.join(came, ["pair", "new_key"], "left").join(went, ["pair", "old_key"], "left")
    rows = rows.withColumn("change", F.when(F.col("came").isNotNull() | F.col("went").isNotNull(), "moved").otherwise(F.col("change")))
    rows = rows.withColumn("notes", F.concat("notes", F.array_compact(F.array("came", "went")))).drop("came", "went", "old_key", "new_key")
    whole = sections.select("pair", "old_id", "new_id", "place_new", "place_old", "heading", F.col("change").alias("section_change"))
    same = [whole["pair"] == rows["pair"], whole["old_id"].eqNullSafe(rows["old_id"]), whole["new_id"].eqNullSafe(rows["new_id"])]
    return whole.join(rows.select("pair", "old_id", "new_id", "idx", "change", "body", "notes"), same, "left").select(whole["*"], "idx", "change", "body", "notes")


def navigation(pairs: DataFrame) -> DataFrame:
    """(chamber, subcommittees): what the pages of a site lead to."""
    return pairs.groupBy("chamber").agg(F.array_sort(F.collect_set("slug")).alias("subcommittees"))


def thread_folder(chamber: Column, slug: Column, first: Column, last: Column) -> Column:
    """Where a series' thread pages lie, named by the years they cover."""
    return F.format_string("%s-%s-threads-fy%d-fy%d", chamber, slug, first, last)


def collapsed(diffs: DataFrame) -> DataFrame:
    """(pair, new_id, change, first, last, n): paragraphs of a section in reading order, unchanged ones in a row as one."""
    w = Window.partitionBy("pair", "old_id", "new_id").orderBy("idx")
    same = (F.col("change") == "unchanged") & (F.lag("change").over(w) == "unchanged")
    d = diffs.withColumn("starts", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    d = d.withColumn("run", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return d.groupBy("pair", "old_id", "new_id", "run").agg(F.first("change").alias("change"), F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("n")).drop("run")


def page(title: str, rows: list[dict], columns: list[str]) -> str:
    """A plain HTML table of collected rows, every value escaped. For reports of bounded size."""
    esc = lambda v: html.escape("" if v is None else str(v))
    head = "".join(f"<th>{esc(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{esc(r.get(c))}</td>" for c in columns) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset=utf-8><title>{esc(title)}</title><h1>{esc(title)}</h1><table><tr>{head}</tr>{body}</table>"


def dump_sections(sections: DataFrame) -> DataFrame:
    """(package_id, json): the sections of each report in reading order."""
    row = F.struct("seq", "heading", "level", "path", "paragraphs", "table_spans")
    return sections.groupBy("package_id").agg(F.sort_array(F.collect_list(row)).alias("s")).select("package_id", F.to_json("s", {"ignoreNullFields": "false"}).alias("json"))
