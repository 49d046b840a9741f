"""Named queries of the core, each over whole tables, and their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from editrail.functions import policy
from editrail.functions import similarity as sim
from editrail.functions import text as tx
from editrail.operators import align as al
from editrail.operators import chain as ch
from editrail.operators import diff as df_
from editrail.operators import segment as sg
from editrail.operators import snapshots
from editrail.plans import compare as cp
from editrail.plans import evaluate as ev
from editrail.plans import history as hs
from editrail.plans import oracles as o
from editrail.plans import oracles_chain as on
from editrail.plans import oracles_compare as oc
from editrail.plans import oracles_text as ot
from editrail.plans import review as rv
from editrail.plans import views as vw
from editrail.runtime import cut
from editrail.runtime import read_table
from editrail.sources import reports as src


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return src.pairs(src.editions(spark, d))


def _matching(spark: SparkSession, d: str) -> cp.Matching:
    return cp.match(_pairs(spark, d), src.sections(spark, d))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return al.sides(_pairs(spark, d), src.sections(spark, d))


# ---- sources and catalog


def catalog_latest(spark, d):
    return src.catalog(spark, d).select("package_id", "chamber", "subcommittee", "fiscal_year", "stage", "title")


def catalog_union(spark, d):
    """The published catalog, and what the prerelease one has besides."""
    c = src.catalog(spark, d).select("package_id", "chamber", "stage", "source")
    return src.union_new(c.where("source <> 'prerelease'"), c).select("package_id", "chamber", "stage", "source")


def catalog_upsert(spark, d):
    c = src.catalog(spark, d).select("package_id", "stage", "fiscal_year")
    changes = c.where("stage = 'reported'").withColumn("stage", F.lit("committee"))
    return src.upsert(c, changes)


def usable_reports(spark, d):
    return src.usable(src.catalog(spark, d)).select("package_id", "chamber", "subcommittee", "fiscal_year")


def like_for_like(spark, d):
    c = src.catalog(spark, d).select("package_id", "chamber", "fiscal_year", "local_path", "pdf_url", F.coalesce("from_pdf", F.lit(False)).alias("from_pdf"))
    return src.like_for_like(c, ["chamber", "fiscal_year"]).select("package_id", "from_pdf")


def catalog_paths(spark, d):
    c = src.catalog(spark, d)
    return c.select("package_id", src.raw_path().alias("path"), src.pdf_path(src.raw_path()).alias("pdf"), tx.safe_url(F.col("html_url")).alias("url"))


def lexicon_unambiguous(spark, d):
    s = src.sections(spark, d).where(F.size("path") >= 3)
    return src.unambiguous(s.select(F.get("path", F.lit(2)).alias("child"), F.get("path", F.lit(1)).alias("parent")), "child", "parent")


# ---- pairing


def pair_adjacent_years(spark, d):
    return _pairs(spark, d).select("pair", "old_fy", "new_fy", "old_package", "new_package", F.col("year_delta").cast("int").alias("year_delta"))


def chain_transitions(spark, d):
    return vw.transitions(src.editions(spark, d))


def stub_editions(spark, d):
    return vw.without_stubs(src.editions(spark, d), src.sections(spark, d))


# ---- alignment


def align_exact_path(spark, d):
    return al.exact_path(*_sides(spark, d))


def removed_sections(spark, d):
    """Sections of an older edition that no pass finds in the newer one."""
    return _matching(spark, d).removed.select("pair", "section_id")


def added_sections(spark, d):
    return _matching(spark, d).added.select("pair", "section_id")


def align_unique_heading(spark, d):
    old, new = _sides(spark, d)
    first = al.exact_path(old, new)
    return al.unique_heading(al.left_over(old, first, "old_id"), al.left_over(new, first, "new_id"))


def align_cascade(spark, d):
    return _matching(spark, d).matched.select("pair", "old_id", "new_id", "match_pass", F.round("score", 6).alias("score"))


def align_candidates(spark, d):
    """What the scored passes decided on, taken or not."""
    return _matching(spark, d).candidates.select("pair", "old_id", "new_id", "match_pass", F.round("score", 6).alias("score"), "accepted")


def rename_promotion(spark, d):
    return _matching(spark, d).renamed.select("pair", "old_id", "new_id", F.round("score", 6).alias("score"))


def related_hints(spark, d):
    m = _matching(spark, d)
    return al.related(al.best_counterparts(m.scored, m.matched)).select("pair", "section_id", "other_id", F.round("overlap", 6).alias("overlap"))


# ---- texts


def mask_text(spark, d):
    return src.paragraphs(spark, d).where("text IS NOT NULL").select("para_id", F.md5(tx.mask(F.col("text"))).alias("masked"))


def heading_normalise(spark, d):
    h = read_table(spark, d, "headings").where("text IS NOT NULL").select("heading_id", "text").distinct()
    return h.select("heading_id", tx.normal_heading(F.col("text")).alias("heading"), tx.normal_name(F.col("text")).alias("name"), tx.comparison_key(F.col("text")).alias("key"))


def paragraph_kinds(spark, d):
    p = src.paragraphs(spark, d).where("text IS NOT NULL")
    return p.select("para_id", tx.paragraph_kind(F.col("text")).alias("kind"), tx.paragraph_topic(F.col("text")).alias("topic"))


def family_counts(spark, d):
    p = src.paragraphs(spark, d).where("text IS NOT NULL")
    return p.select("para_id", *tx.family_counts(F.col("text")))


def describe_tags(spark, d):
    p = src.paragraphs(spark, d).where("text IS NOT NULL")
    return p.select("para_id", F.array_join(tx.describe(F.col("text")), ",").alias("tags"))


def line_kinds(spark, d):
    """Lines of each document by kind, as the segmenter sees them, and rows of tables by shape."""
    lines = sg.lines_of(read_table(spark, d, "documents"), "doc_id", "text")
    shapes = [F.count_if(F.col("shape") == s).alias(s) for s in ("numeric", "wide", "columnar")]
    return lines.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum("line_no").alias("line_sum"), *shapes)


def word_totals(spark, d):
    return src.paragraphs(spark, d).where("text IS NOT NULL").groupBy("package_id", "kind").agg(F.sum(tx.word_count(F.col("text"))).cast("long").alias("words"), F.count("*").alias("n"))


def anchors(spark, d):
    s = src.sections(spark, d).where(F.size("path") > 0)
    return ch.with_anchors(s, ["package_id"], ["seq", "section_id"]).select("section_id", "anchor")


# ---- differences


def _exact_paragraphs(spark, d):
    old, new = _sides(spark, d)
    m = al.exact_path(old, new)
    m = m.join(old.select("pair", F.col("section_id").alias("old_id"), F.col("paragraphs").alias("old_paragraphs"), F.col("seq").alias("old_seq")), ["pair", "old_id"])
    return m.join(new.select("pair", F.col("section_id").alias("new_id"), F.col("paragraphs").alias("new_paragraphs"), F.col("seq").alias("new_seq"), "path"), ["pair", "new_id"])


def _masked_kinds(m):
    join = lambda c: F.array_join(F.transform(c, lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    a, b = join("old_paragraphs"), join("new_paragraphs")
    kind = F.when(a == b, "unchanged").when(tx.mask(a) == tx.mask(b), "numbers only").otherwise("language")
    return m.withColumn("kind", kind).groupBy("pair", "kind").agg(F.count("*").alias("n"))


def masked_section_changes(spark, d):
    return _masked_kinds(_exact_paragraphs(spark, d))


def _matched_paragraphs(spark, d):
    return cp.with_paragraphs(_matching(spark, d))


def paragraph_diffs(spark, d):
    out = df_.paragraph_diffs(_matched_paragraphs(spark, d))
    return out.select("pair", "old_id", "new_id", "idx", "old_idx", "new_idx", "change", "literal", "changed_words", F.size("flags").alias("n_flags"))


def word_diff(spark, d):
    out = df_.paragraph_diffs(_matched_paragraphs(spark, d)).where(F.size("edits") > 0)
    return out.select("pair", "old_id", "new_id", "idx", vw.redline(F.col("edits")).alias("redline"), sim.edited_words(F.col("edits")).alias("words"))


def _classes(m):
    return cp.section_classes(m.matched, df_.paragraph_diffs(cp.with_paragraphs(m)))


def section_class(spark, d):
    return _classes(_matching(spark, d))


def change_counts(spark, d):
    m = _matching(spark, d)
    return vw.counts(_classes(m), m.removed, m.added)


def policy_summary(spark, d):
    return vw.flag_summary(df_.paragraph_diffs(_matched_paragraphs(spark, d)))


def policy_flags(spark, d):
    """Every flag of every edited paragraph."""
    f = df_.policy_flags(df_.paragraph_diffs(_matched_paragraphs(spark, d)))
    return f.select("pair", "old_id", "new_id", "idx", F.col("at").alias("first_word"), "category", "label", "tier")


def flags_for_review(spark, d):
    """How many flags for review the paragraphs of a comparison have, and the highest tier."""
    diffs = df_.paragraph_diffs(_matched_paragraphs(spark, d))
    n = F.size(F.filter("flags", lambda f: f["tier"] >= policy.REVIEW))
    return diffs.groupBy("pair").agg(F.sum(n).cast("long").alias("n"), F.max(df_.max_tier(F.col("flags"))).alias("highest"))


def significance(spark, d):
    return _comparison(spark, d).sections.select("pair", "old_id", "new_id", "change", "changed_words", F.round("score", 4).alias("score"))


def rank_top_k(spark, d):
    return _comparison(spark, d).sections.where("place <= 10").select("pair", "old_id", "new_id", "change", "changed_words", F.round("score", 4).alias("score"), "place")


def new_section_scores(spark, d):
    """Sections of one side only: their words, but for those that moved, by the weight of their class, directives lifting them."""
    rows = _comparison(spark, d).sections.where("change IN ('dropped', 'new')")
    return rows.select("pair", F.coalesce("new_id", "old_id").alias("section_id"), "change", F.col("changed_words").cast("int").alias("words"), "score")


def _placed(m):
    side = lambda df, id_, seq: df.select("pair", F.col("section_id").alias(id_), F.col("seq").alias(seq))
    rows = m.matched.select("pair", "old_id", "new_id").join(side(m.old, "old_id", "old_seq"), ["pair", "old_id"], "right").join(side(m.new, "new_id", "new_seq"), ["pair", "new_id"], "full")
    return ch.document_order(rows, ["pair"])


def document_order(spark, d):
    placed = _placed(_matching(spark, d))
    return placed.select("pair", "old_id", "new_id", F.col("place_new").cast("int").alias("place_new"), F.col("place_old").cast("int").alias("place_old"))


def document_page(spark, d):
    """A row per paragraph of every comparison in reading order, with its redline and notes."""
    c = _comparison(spark, d)
    placed = _placed(c.matching).select("pair", "old_id", "new_id", "place_new", "place_old")
    same = [placed["pair"] == c.sections["pair"], placed["old_id"].eqNullSafe(c.sections["old_id"]), placed["new_id"].eqNullSafe(c.sections["new_id"])]
    sections = placed.join(c.sections.select("pair", "old_id", "new_id", "heading", "change"), same).select(placed["*"], "heading", "change")
    page = vw.document_page(sections, c.paragraphs, c.moves)
    return page.select("pair", "old_id", "new_id", "place_new", "place_old", "section_change", "idx", "change", F.md5("body").alias("body"), F.size("notes").alias("n_notes"))


def shown_sections(spark, d):
    """What a reader sees who hides unchanged sections and sections of new figures, and wants directives alone."""
    c = _comparison(spark, d)
    directive = lambda side, id_: side.select("pair", F.col("section_id").alias(id_), F.exists("paragraphs", lambda p: F.coalesce(p["kind"] == "directive", F.lit(False))).alias(f"d_{id_}"))
    s = c.sections.join(directive(c.matching.old, "old_id"), ["pair", "old_id"], "left").join(directive(c.matching.new, "new_id"), ["pair", "new_id"], "left")
    s = s.withColumn("directive", F.coalesce("d_new_id", "d_old_id", F.lit(False)))
    out = vw.shown_sections(s.select("pair", "old_id", "new_id", "change", "directive"), c.paragraphs, hide_numbers=True, directives_only=True)
    return out.select("pair", "old_id", "new_id", "change", "tier")


def collapsed_paragraphs(spark, d):
    return vw.collapsed(df_.paragraph_diffs(_matched_paragraphs(spark, d)))


def outline_nodes(spark, d):
    n = vw.outline(src.sections(spark, d))
    return n.select("package_id", "depth", "node", F.array_join("prefix", " > ").alias("prefix"), "first_seq", "sections")


def index_page(spark, d):
    m = _matching(spark, d)
    return vw.index_page(_masked_kinds(cp.with_paragraphs(m)), m.removed, m.added)


def manifest(spark, d):
    m = _matching(spark, d)
    index = vw.index_page(_masked_kinds(cp.with_paragraphs(m)), m.removed, m.added)
    flags = df_.policy_flags(df_.paragraph_diffs(cp.with_paragraphs(m))).select("pair", "tier")
    read_from = F.when(F.coalesce("from_pdf", F.lit(False)), "pdf").otherwise("htm")
    cat = src.catalog(spark, d).select("package_id", tx.safe_url(F.col("html_url")).alias("url"), read_from.alias("read_from"))
    whole = vw.dump_sections(src.sections(spark, d)).select("package_id", F.sha2("json", 256).alias("sha256"))
    return vw.manifest(index, _pairs(spark, d), flags, whole.join(cat, "package_id", "left"))


def section_dump(spark, d):
    return vw.dump_sections(src.sections(spark, d))


# ---- moves


def moves_verbatim(spark, d):
    return _comparison(spark, d).moves.where("how = 'verbatim'").select("pair", "old_key", "new_key")


def _scored_moves(spark, d, how):
    return _comparison(spark, d).moves.where(F.col("how") == how).select("pair", "old_key", "new_key", F.round("score", 6).alias("score"))


def moves_same_topic(spark, d):
    return _scored_moves(spark, d, "topic")


def moves_near(spark, d):
    return _scored_moves(spark, d, "near")


# ---- the whole comparison


def _comparison(spark, d):
    return cp.compare(_pairs(spark, d), src.sections(spark, d))


def compare_sections(spark, d):
    out = _comparison(spark, d).sections
    return out.select("pair", "place", "old_id", "new_id", "change", "changed_words", F.round("score", 4).alias("score"), "renamed_from", "anchor")


def compare_moves(spark, d):
    return _comparison(spark, d).moves.select("pair", "old_key", "new_key", "how")


# ---- threads over the years


def _chain_editions(spark, d):
    """The editions that chains are made of: no stubs, and two of a series at least."""
    return vw.without_stubs(src.editions(spark, d), src.sections(spark, d)).select("chamber", "slug", "fy", "package_id")


def _chain(spark, d):
    """(comparison, threads, rows, sections, pairs) over the editions that are no stubs."""
    editions, sections = cut(_chain_editions(spark, d)), src.sections(spark, d)
    pairs = src.pairs(editions)
    c = cp.compare(pairs, sections)
    t = hs.follow(c, sections, editions, pairs)
    rows = cut(hs.account_rows(t.members, sections, hs.thread_scores(c, t.members)))
    return c, t, rows, sections, pairs


def _links(spark, d):
    return _matching(spark, d).matched.select("old_id", "new_id")


def thread_ids(spark, d):
    return ch.thread_heads(_links(spark, d)).select(F.col("node").alias("section_id"), F.col("head").alias("thread"))


def _cells(spark, d):
    m = _matching(spark, d)
    heads = cut(ch.thread_heads(m.matched.select("old_id", "new_id")))
    s = src.sections(spark, d).where(F.size("path") > 0).join(src.editions(spark, d), "package_id")
    s = s.join(heads.withColumnRenamed("node", "section_id"), "section_id", "left").withColumn("thread", F.coalesce("head", "section_id"))
    s = s.join(_classes(m).select(F.col("new_id").alias("section_id"), "change"), "section_id", "left")
    return s.select("thread", "chamber", "slug", "fy", "section_id", "heading", "path", F.coalesce("change", F.lit("new")).alias("change"))


def provenance(spark, d):
    return ch.provenance(_cells(spark, d).select("thread", "fy", "change"))


def name_runs(spark, d):
    s = src.sections(spark, d).select("section_id", "package_id", "heading").join(src.editions(spark, d), "package_id")
    linked = hs.threads(_links(spark, d), s.where(F.col("section_id").isNotNull()))
    r = ch.runs(linked.select("thread", "fy", "heading"), ["thread"], "fy", "heading")
    return r.select("thread", "heading", F.col("first").alias("first_fy"), F.col("last").alias("last_fy"), "n")


def stitched_threads(spark, d):
    return _chain(spark, d)[1].members.select("section_id", "thread")


def stitch_links(spark, d):
    """Which threads were joined over a gap, and how."""
    return _chain(spark, d)[1].links


def paragraph_origins(spark, d):
    """Where each paragraph of an edition that has a predecessor comes from, and what a reader is told of it."""
    pairs = _pairs(spark, d)
    c = cp.compare(pairs, src.sections(spark, d))
    out = hs.paragraph_origins(c.paragraphs, c.moves, pairs.select("pair", "old_fy", "new_fy"))
    series = src.editions(spark, d).withColumn("start_fy", F.min("fy").over(Window.partitionBy("chamber", "slug")))
    at = src.sections(spark, d).select("section_id", "package_id").join(series, "package_id").select("section_id", "start_fy")
    out = out.withColumn("section_id", F.split("key", ":")[0].cast("long")).join(at, "section_id")
    label = hs.origin_label(*[F.col(c) for c in ("first_fy", "start_fy", "edited_fy", "edit", "moved_fy", "moved_from")])
    return out.select("key", "first_fy", "edited_fy", "edit", "moved_fy", label.alias("label"))


def thread_rows(spark, d):
    """The accounts of every series: name, former name, threads and score."""
    return _chain(spark, d)[2].select("chamber", "slug", "row_key", "heading", "formerly", "members", F.round("score", 4).alias("score"))


def row_cells(spark, d):
    """What happened to each account at each transition."""
    _, t, rows, _, _ = _chain(spark, d)
    return hs.row_cells(rows, t.cells)


def active_rows(spark, d):
    """Accounts with a transition that is more than unchanged or new figures."""
    _, t, rows, _, _ = _chain(spark, d)
    loud = ~F.col("label").isin("unchanged", "numbers only")
    return hs.row_cells(rows, t.cells).groupBy("chamber", "slug", "row_key").agg(F.bool_or(loud).alias("active"), F.count("*").alias("n")).where("active").drop("active")


def transition_heat(spark, d):
    return hs.transition_heat(_chain(spark, d)[1].cells)


def section_rows(spark, d):
    """Which account each section is on."""
    _, t, rows, _, _ = _chain(spark, d)
    return hs.section_rows(rows, t.members)


def thread_words(spark, d):
    """Words that changed in each thread, by year."""
    cells = _chain(spark, d)[1].cells
    return cells.groupBy("thread", "fy").agg(F.sum("changed_words").cast("long").alias("words"))


def active_headings(spark, d):
    """Headings of a series with a year that is more than unchanged or new figures."""
    c = _cells(spark, d).groupBy("chamber", "slug", "heading").agg(F.bool_or(~F.col("change").isin("unchanged", "numbers only")).alias("active"), F.count("*").alias("n"))
    return c.where("active").drop("active")


def thread_names(spark, d):
    return src.sections(spark, d).where(F.size("path") > 0).select("section_id", tx.thread_name(F.col("path")).alias("name"))


def directive_sections(spark, d):
    return src.sections(spark, d).where(F.exists("paragraphs", lambda p: p["kind"] == "directive")).select("section_id", "package_id")


def automatic_labels(spark, d):
    m = _exact_paragraphs(spark, d)
    a, b = al.body(F.col("old_paragraphs"), 4000), al.body(F.col("new_paragraphs"), 4000)
    rows = m.select("pair", "old_id", "new_id", a.alias("a"), b.alias("b")).withColumn("score", sim.token_set("a", "b")).withColumn("agreement", sim.agreement("a", "b"))
    return rows.select("pair", "old_id", "new_id", ev.auto_label(F.col("a"), F.col("b"), F.lit(True), F.col("score")).alias("label"), F.round("agreement", 6).alias("agreement"))


def chain_pivot(spark, d):
    return vw.timeline(_cells(spark, d))


def chain_timeline(spark, d):
    """chain_pivot in long form: how many sections of a heading changed, by year."""
    return _cells(spark, d).where("change NOT IN ('unchanged', 'numbers only')").groupBy("chamber", "slug", "heading", "fy").agg(F.count("*").alias("n"))


def display_headings(spark, d):
    h = read_table(spark, d, "headings").where("text IS NOT NULL").select("heading_id", "text").distinct()
    return h.select("heading_id", vw.display_heading(F.col("text")).alias("shown"))


def navigation(spark, d):
    nav = vw.navigation(_pairs(spark, d))
    return nav.select("chamber", F.array_join("subcommittees", ",").alias("subcommittees"))


def wanted_pairs(spark, d):
    """The pairs of one chamber whose newer edition is of 2015 to 2020."""
    return src.wanted_pairs(_pairs(spark, d), chamber="house", years=(2015, 2020)).select("pair", "old_fy", "new_fy")


def stitch_returned(spark, d):
    return vw.stitch(_cells(spark, d), src.editions(spark, d))


# ---- segmentation


def segment_documents(spark, d):
    out = sg.segment_documents(read_table(spark, d, "documents"), "doc_id", "text")
    return out.select("doc", "seq", "heading", "level", "path", F.size("paragraphs").alias("n_paragraphs"), "table_spans")


def leader_spans(spark, d):
    """Runs of table lines that touch, as one span each."""
    lines = sg.lines_of(read_table(spark, d, "documents"), "doc_id", "text").where("kind IN ('leader', 'table_rule', 'table_marker')")
    return ch.merge_spans(lines.select("doc_id", F.col("line_no").alias("start"), (F.col("line_no") + 1).alias("end")), ["doc_id"], "start", "end")


def reference_paragraphs(spark, d):
    """Paragraphs of the documents by indent and blank lines alone."""
    p = rv.reference_paragraphs(read_table(spark, d, "documents"), "doc_id", "text")
    return p.select("doc_id", "idx", F.md5("heading").alias("heading"), F.md5("text").alias("text"))


def _units(p, sections):
    s = sections.select("package_id", "seq", "section_id", "heading", F.posexplode("paragraphs").alias("i", "p")).where("p.text IS NOT NULL")
    s = s.select("package_id", (F.shiftleft(F.col("seq").cast("long"), 32) + F.col("i")).alias("idx"), "heading", "p.text")
    side = lambda c: s.join(p.select("pair", F.col(c).alias("package_id")), "package_id").drop("package_id")
    return rv.extract_units(side("old_package"), side("new_package"), ["pair"])


def evaluation_units(spark, d):
    """What differs between the editions of every pair, by their texts alone."""
    return _units(_pairs(spark, d), src.sections(spark, d)).groupBy("pair", "type").agg(F.count("*").alias("n"), F.sum("changed_words").cast("long").alias("words"))


def located_units(spark, d):
    """What the comparison made of each unit."""
    pairs, sections = cut(_pairs(spark, d)), cut(src.sections(spark, d))
    u = cut(_units(pairs, sections).withColumn("unit", F.concat_ws(":", "type", "old_idx", "new_idx")).select("pair", "unit", "type", "old_text", "new_text"))
    return rv.locate(u, rv.tool_view(cp.compare(pairs, sections, whole=True))).groupBy("pair", "type", "status").agg(F.count("*").alias("n"))


# ---- similarity kernels


def token_sets(spark, d):
    m = _exact_paragraphs(spark, d)
    text = lambda c: F.lower(F.array_join(F.transform(c, lambda p: F.coalesce(p["text"], F.lit(""))), " "))
    words = lambda c: F.array_distinct(F.filter(F.split(text(c), "[ \\t\\r\\n]+"), lambda w: w != ""))
    a, b = words("old_paragraphs"), words("new_paragraphs")
    return m.select("pair", "old_id", "new_id", F.size(F.array_intersect(a, b)).alias("shared"), F.size(F.array_except(a, b)).alias("only_old"), F.size(F.array_except(b, a)).alias("only_new"))


def indel_scores(spark, d):
    m = _exact_paragraphs(spark, d)
    a, b = al.body(F.col("old_paragraphs"), 1500), al.body(F.col("new_paragraphs"), 1500)
    return m.select("pair", "old_id", "new_id", F.round(sim.indel(a, b), 6).alias("indel"), F.round(sim.token_set(a, b), 6).alias("token_set"), F.round(sim.word_blocks(a, b), 6).alias("blocks"), F.round(sim.word_bag(a, b), 6).alias("bag"))


_QUERIES = [
    catalog_latest, catalog_union, catalog_upsert, usable_reports, like_for_like, catalog_paths, lexicon_unambiguous,
    pair_adjacent_years, chain_transitions, stub_editions,
    align_exact_path, removed_sections, added_sections, align_unique_heading, align_cascade, align_candidates, rename_promotion, related_hints,
    mask_text, heading_normalise, paragraph_kinds, family_counts, describe_tags, line_kinds, word_totals, anchors,
    masked_section_changes, paragraph_diffs, word_diff, section_class, change_counts, policy_summary, policy_flags, flags_for_review, significance, rank_top_k, new_section_scores, document_order, document_page, shown_sections,
    collapsed_paragraphs, outline_nodes, index_page, manifest, section_dump,
    moves_verbatim, moves_same_topic, moves_near, compare_sections, compare_moves,
    thread_ids, provenance, name_runs, stitched_threads, stitch_links, paragraph_origins, thread_rows, row_cells, active_rows, transition_heat, section_rows, thread_words, chain_pivot, chain_timeline, stitch_returned, active_headings, display_headings, navigation, wanted_pairs, thread_names, directive_sections, automatic_labels,
    segment_documents, leader_spans, reference_paragraphs, evaluation_units, located_units, token_sets, indel_scores,
]


def queries() -> dict:
    return {"p1_found": snapshots.p1_found} | {f.__name__: f for f in _QUERIES} | ev.QUERIES


def oracle_sql() -> dict[str, str]:
    return {"p1_found": snapshots.P1_SQL} | o.ORACLES | oc.ORACLES | ot.ORACLES | on.ORACLES
