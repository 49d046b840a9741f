"""Audits of structure and scores of linkage decisions against reviews."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from editrail.functions import similarity as sim
from editrail.functions import text as tx
from editrail.operators import segment as sg
from editrail.runtime import latest, read_table, spread
from editrail.sources import reports as src

OFFSETS = list(range(-15, 20, 5))


def _decisions(spark, d) -> DataFrame:
    c = read_table(spark, d, "linkage_candidates").where("score IS NOT NULL")
    return latest(c, ["cand_id"], ["decided_at", F.xxhash64(*c.columns).desc()])


def linkage_by_pass(spark, d) -> DataFrame:
    """Precision of each pass against decided candidates."""
    c = _decisions(spark, d).where("accepted IS NOT NULL")
    return c.groupBy("match_pass").agg(F.count("*").alias("n"), F.count_if("accepted").alias("right"), F.count_if(~F.col("auto")).alias("reviewed"))


def linkage_sweep(spark, d, bar: float = 70.0) -> DataFrame:
    """Right, wrong and missed links at bars around the working one."""
    c = _decisions(spark, d).where("accepted IS NOT NULL")
    bars = F.explode(F.array(*[F.lit(bar + x) for x in OFFSETS]))
    c = c.withColumn("bar", bars)
    over = F.col("score") >= F.col("bar")
    return c.groupBy("bar").agg(F.count_if(over & F.col("accepted")).alias("right"), F.count_if(over & ~F.col("accepted")).alias("wrong"), F.count_if(~over & F.col("accepted")).alias("missed"))


def duplicate_paths(spark, d) -> DataFrame:
    """(package_id, path, n): paths that a report has more than once."""
    s = src.sections(spark, d)
    return s.groupBy("package_id", F.array_join("path", " > ").alias("path")).agg(F.count("*").alias("n")).where("n > 1")


def resumed_parents(spark, d) -> DataFrame:
    """(package_id, n): how often a report comes back to a parent that it had left."""
    s = src.sections(spark, d).where(F.size("path") > 1)
    s = s.withColumn("parent", F.array_join(F.slice("path", 1, 2), " > "))
    w = Window.partitionBy("package_id").orderBy("seq", "section_id")
    starts = s.withColumn("starts", ~F.lag("parent").over(w).eqNullSafe(F.col("parent"))).where("starts")
    n = starts.groupBy("package_id", "parent").agg((F.count("*") - 1).alias("again"))
    return n.groupBy("package_id").agg(F.sum("again").alias("n")).where("n > 0")


def parent_drift(spark, d) -> DataFrame:
    """Headings that two neighbouring editions have once each, under different parents."""
    s = src.sections(spark, d).where(F.size("path") > 1).join(src.editions(spark, d), "package_id")
    once = s.groupBy("chamber", "slug", "fy", F.element_at("path", -1).alias("heading")).agg(F.count("*").alias("n"), F.min(F.element_at("path", -2)).alias("parent")).where("n = 1")
    years = src.editions(spark, d).withColumn("next_fy", F.lead("fy").over(Window.partitionBy("chamber", "slug").orderBy("fy"))).select("chamber", "slug", "fy", "next_fy")
    a = once.join(years, ["chamber", "slug", "fy"])
    b = once.select("chamber", "slug", "heading", F.col("fy").alias("next_fy"), F.col("parent").alias("new_parent"))
    return a.join(b, ["chamber", "slug", "heading", "next_fy"]).where("parent <> new_parent").select("chamber", "slug", "heading", F.col("fy").alias("old_fy"), F.col("next_fy").alias("new_fy"), F.col("parent").alias("old_parent"), "new_parent")


#: What a paragraph has that is a row of a table.
LEAK = r"\.{6,}|-{6,}"


def structure_sweep(spark, d) -> DataFrame:
    """Reports with too few sections or paragraphs, or with rows of tables among their paragraphs, and their share of directives."""
    s = src.sections(spark, d)
    kept = lambda p: F.size(F.filter("paragraphs", p))
    n = s.groupBy("package_id").agg(
        F.count("*").alias("sections"), F.sum(F.size("paragraphs")).alias("paragraphs"), F.sum("table_spans").alias("tables"),
        F.sum(kept(lambda p: p["kind"] == "directive")).alias("directives"), F.sum(kept(lambda p: F.coalesce(p["text"].rlike(LEAK), F.lit(False)))).alias("leaks"),
    )
    thin = (F.col("sections") < 15) | (F.col("paragraphs") < 30) | (F.col("leaks") > 0)
    return n.select("package_id", "sections", "paragraphs", "tables", "directives", "leaks", thin.alias("thin"))


def swallowed_leads(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, leads, swallowed, much): directives and provisions that open a line of the body, how many of them lie inside tables, and whether that is over 2 in 100."""
    lead, provision = re.compile(r"^\s{1,8}([A-Z][^.\n]{2,80}?)\.--"), re.compile(r"^\s{1,8}Section\s+\d+")

    def run(frames):
        for f in frames:
            rows = []
            for k, raw in zip(f["key"], f["text"]):
                lines = sg.report_text(raw).split("\n")
                start, end = sg.body_bounds(lines)
                inside = {i for a, b in sg.table_spans(sg.Lines(lines[:end])) for i in range(a, b)}
                found = [i for i in range(start, end) if lead.match(lines[i]) or provision.match(lines[i])]
                rows.append((k, len(found), sum(i in inside for i in found)))
            yield pd.DataFrame(rows, columns=["key", "leads", "swallowed"])

    slim = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = spread(slim).mapInPandas(run, f"key {slim.schema['key'].dataType.simpleString()}, leads long, swallowed long")
    return out.select(F.col("key").alias(key), "leads", "swallowed", (F.col("swallowed") > 0.02 * F.col("leads")).alias("much"))


def leads_in_tables(spark, d) -> DataFrame:
    return swallowed_leads(read_table(spark, d, "documents"), "doc_id", "text")


def nested_findings(sections: DataFrame, agencies: DataFrame) -> DataFrame:
    """(package_id, path, finding): nested_agency where a path has two agencies, annotation where a subtitle opens a section.

    agencies: name, normal. Provisions, which lie outside the tree by their place, are left out.
    """
    apart = (F.size("path") == 2) & F.element_at("path", -1).rlike(r"^SEC \d")
    s = sections.where((F.size("path") > 0) & ~F.coalesce(apart, F.lit(False))).select("package_id", "section_id", "path")
    held = s.select("*", F.explode("path").alias("name")).join(agencies.select("name").distinct(), "name").groupBy("package_id", "section_id", "path").agg(F.count("*").alias("n"))
    nested = held.where("n > 1").select("package_id", F.array_join("path", " > ").alias("path"), F.lit("nested_agency").alias("finding"))
    notes = s.where(F.element_at("path", -1).rlike(r"^(INCLUDING|EXCLUDING)\b")).select("package_id", F.array_join("path", " > ").alias("path"), F.lit("annotation").alias("finding"))
    return nested.unionByName(notes)


def structure_findings(spark, d) -> DataFrame:
    """Agencies under agencies, by the names that stand over accounts, and subtitles that open sections."""
    over = src.sections(spark, d).where("level = 1 AND size(path) > 0").select(F.element_at("path", -1).alias("name")).distinct()
    return nested_findings(src.sections(spark, d), over)


def heading_occurrences(spark, d) -> DataFrame:
    """How often each report prints a heading, by its normal name."""
    h = read_table(spark, d, "headings").where("text IS NOT NULL").select("heading_id", "package_id", "text").distinct()
    return h.groupBy("package_id", tx.normal_heading(F.col("text")).alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def account_truth(accounts: DataFrame) -> DataFrame:
    """(name, agency): normal names of accounts, by their title, their title without the agency's name, and its first part, that have one agency only."""
    title, agency = F.col("title"), F.col("agency")
    bare = F.when(F.endswith(F.lower(title), F.lower(F.concat(F.lit(", "), agency))), F.left(title, F.length(title) - F.length(agency) - 2)).otherwise(title)
    names = F.array(title, bare, F.split(title, ",")[0])
    a = accounts.where("title <> '' AND agency <> ''").select(F.explode(F.transform(names, tx.normal_name)).alias("name"), tx.normal_name(agency).alias("agency")).where("name <> ''")
    one = a.groupBy("name").agg(F.count_distinct("agency").alias("n"), F.min("agency").alias("agency"))
    return one.where("n = 1").select("name", "agency")


def misparented(sections: DataFrame, truth: DataFrame, agencies: DataFrame) -> DataFrame:
    """(section_id, package_id, finding) of accounts whose agency is known: right, misparented under another agency, or orphaned under none."""
    s = sections.where("level <= 3 AND size(path) > 0").select("section_id", "package_id", F.element_at("path", -1).alias("name"), F.slice("path", F.lit(1), F.size("path") - 1).alias("above"))
    s = s.join(truth, "name")
    right = F.exists("above", lambda p: F.contains(p, F.col("agency")))
    others = s.select("section_id", F.explode("above").alias("name")).join(agencies.select("name").distinct(), "name").select("section_id").distinct().withColumn("other", F.lit(True))
    return s.join(others, "section_id", "left").select("section_id", "package_id", F.when(right, "right").when(F.col("other"), "misparented").otherwise("orphaned").alias("finding"))


def stratified_sample(spark, d, per_stratum: int = 5) -> DataFrame:
    """So many paragraphs of each kind and report year, chosen by a hash of their id, one of each stratum in turn."""
    p = src.paragraphs(spark, d).join(src.editions(spark, d), "package_id")
    w = Window.partitionBy("kind", "fy").orderBy(F.md5(F.col("para_id").cast("string")), "para_id")
    return p.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= per_stratum).select("para_id", "kind", "fy", "turn")


def merged_labels(spark, d) -> DataFrame:
    """(a, b, accepted, drafted): the verdict on each pair of sections; people's over drafts, then the latest."""
    c = read_table(spark, d, "linkage_candidates").where("old_section_id IS NOT NULL AND new_section_id IS NOT NULL AND accepted IS NOT NULL")
    c = c.select(F.least("old_section_id", "new_section_id").alias("a"), F.greatest("old_section_id", "new_section_id").alias("b"), "accepted", "auto", "decided_at")
    m = c.groupBy("a", "b").agg(F.max(F.struct((~F.col("auto")).alias("human"), "decided_at", "accepted")).alias("m"))
    return m.select("a", "b", "m.accepted", (~F.col("m.human")).alias("drafted"))


def figures(spark, d) -> DataFrame:
    """Figures of each paragraph by kind, and its dollars."""
    p = src.paragraphs(spark, d).where("text IS NOT NULL")
    n = lambda pattern: tx.by_class(F.col("text"), pattern, lambda t, q: F.regexp_count(t, F.lit(q)))
    dollars = F.regexp_extract_all("text", F.lit(r"\$([0-9][0-9,]*)"), F.lit(1))
    total = F.aggregate(dollars, F.lit(0).cast("long"), lambda t, x: t + F.replace(x, F.lit(","), F.lit("")).cast("long"))
    return p.select("para_id", n(r"\$[0-9]").alias("amounts"), n(r"\b[0-9]+ percent\b").alias("shares"), n(r"\b[0-9]+ (?:days|weeks|months)\b").alias("spans"), n(r"\b(?:19|20)[0-9]{2}\b").alias("years"), total.alias("dollars"))


def label_matches(labels: DataFrame, candidates: DataFrame, least: float = 90.0) -> DataFrame:
    """labels with the candidate they still describe: the same comparison and headings, and both excerpts nearly verbatim.

    labels, candidates: slug, old_heading, new_heading, old_text, new_text, id. A label without such a candidate has a null candidate_id.
    """
    keys = ["slug", "ho", "hn"]
    named = lambda df: df.withColumn("ho", tx.normal_heading(F.col("old_heading"))).withColumn("hn", tx.normal_heading(F.col("new_heading")))
    a = named(labels).select(*keys, F.col("id").alias("label_id"), F.col("old_text").alias("lo"), F.col("new_text").alias("ln"))
    b = named(candidates).select(*keys, F.col("id").alias("candidate_id"), F.col("old_text").alias("co"), F.col("new_text").alias("cn"))
    near = a.join(b, keys).withColumn("so", sim.indel("lo", "co")).withColumn("sn", sim.indel("ln", "cn")).where((F.col("so") >= least) & (F.col("sn") >= least))
    best = near.groupBy("label_id").agg(F.max_by("candidate_id", F.struct(F.col("so") + F.col("sn"), -F.col("candidate_id"))).alias("candidate_id"))
    return labels.select(F.col("id").alias("label_id")).join(best, "label_id", "left")


def auto_label(old_text, new_text, same_path, score):
    """A verdict where the texts leave no doubt: same, different, or null."""
    long = (F.length(old_text) > 120) & (F.length(new_text) > 120)
    empty = (old_text == "") & (new_text == "")
    return F.when(empty & same_path, "same").when(~empty & (score >= 97), "same").when(long & ~same_path & (score <= 25), "different")


def write_worksheet(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_worksheet(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


QUERIES = {
    f.__name__: f
    for f in (linkage_by_pass, linkage_sweep, duplicate_paths, resumed_parents, parent_drift, structure_sweep, leads_in_tables, structure_findings, heading_occurrences, stratified_sample, merged_labels, figures)
}
