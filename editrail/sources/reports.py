"""Catalogs, editions and sections as tables."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from editrail.functions.text import normal_name
from editrail.runtime import latest, read_table

CATALOG = StructType(
    [StructField(c, StringType()) for c in ("package_id", "chamber", "subcommittee", "stage", "title", "html_url", "pdf_url", "local_path", "source")]
    + [StructField("congress", IntegerType()), StructField("fiscal_year", IntegerType()), StructField("from_pdf", BooleanType())]
)
# What a catalog's missing fields mean.
DEFAULTS = {"stage": "committee", "title": "", "html_url": "", "pdf_url": "", "local_path": "", "source": ""}


def read_catalog(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """A JSON array of entries, or an entry to a line; missing fields take their defaults."""
    df = spark.read.schema(CATALOG).option("multiLine", not by_line).json(path)
    return df.fillna(DEFAULTS).fillna({"from_pdf": False})


def locate_corpus(spark: SparkSession, path: str | None = None) -> str:
    """The corpus' folder: given, or named by the setting editrail.corpus or the variable EDITRAIL_CORPUS. It must hold a catalog."""
    at = path or spark.conf.get("editrail.corpus", None) or os.environ.get("EDITRAIL_CORPUS")
    if not at:
        raise ValueError("name the corpus' folder: an argument, the setting editrail.corpus or the variable EDITRAIL_CORPUS")
    if not exists(spark, f"{at}/catalog.json"):
        raise FileNotFoundError(f"no catalog.json in {at}")
    return at


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_catalog_if_any(spark: SparkSession, path: str) -> DataFrame:
    """read_catalog of a file that may be missing: then without rows."""
    return read_catalog(spark, path) if exists(spark, path) else spark.createDataFrame([], CATALOG)


def load_catalog(spark: SparkSession, corpus: str) -> DataFrame:
    """The main catalog of a corpus, and the entries of its prerelease catalog, if there is one, that the main one lacks."""
    return union_new(read_catalog(spark, f"{corpus}/catalog.json"), read_catalog_if_any(spark, f"{corpus}/prerelease/catalog.json"))


def report_files(spark: SparkSession, corpus: str) -> DataFrame:
    """(path): the report files of a corpus, relative to it. File names only are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.htm").option("recursiveFileLookup", True).load(corpus)
    return files.select(F.regexp_replace("path", "^.*?" + re.escape(corpus.rstrip("/").split("://")[-1]) + "/", "").alias("path"))


def with_files(entries: DataFrame, files: DataFrame) -> DataFrame:
    """The entries whose report is on disk."""
    return entries.withColumn("path", raw_path()).join(files.distinct(), "path", "left_semi").drop("path")


def read_reports(entries: DataFrame, corpus: str) -> DataFrame:
    """entries with the text of their report, null where it is missing. Bytes that are no UTF-8 become replacement characters."""
    spark = entries.sparkSession
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.htm").text(corpus, wholetext=True)
    name = F.regexp_replace(F.col("_metadata.file_path"), "^.*?" + re.escape(corpus.rstrip("/").split("://")[-1]) + "/", "")
    texts = texts.select(name.alias("path"), F.col("value").alias("text"))
    return entries.withColumn("path", raw_path()).join(texts, "path", "left")


def wanted_pairs(pairs_df: DataFrame, chamber: str | None = None, slug: str | None = None, years: tuple[int, int] | None = None) -> DataFrame:
    """The pairs of a chamber, a subcommittee (its case doesn't count) and a range of years of the newer edition.

    The years are applied to pairs, not to editions: the predecessor of the first wanted year may lie before it.
    """
    out = pairs_df.where(F.col("chamber") == chamber) if chamber else pairs_df
    out = out.where(F.col("slug") == slug.lower()) if slug else out
    return out.where(F.col("new_fy").between(*years)) if years else out


def parse_request(words: list[str]) -> dict:
    """What a command line asks for: {'command', 'chamber', 'slug', 'years'}.

    all | CHAMBER [SUBCOMMITTEE [FY | FY-FY]] | demo | dump PACKAGE | ingest FILE | compare OLD NEW
    """
    none = {"command": "build", "chamber": None, "slug": None, "years": None, "rest": []}
    if not words or words == ["all"]:
        return none
    if words[0] in ("demo", "dump", "ingest", "compare"):
        return none | {"command": words[0], "rest": list(words[1:])}
    if words[0] not in ("house", "senate") or len(words) > 3:
        raise ValueError(f"not understood: {' '.join(words)}")
    years = None
    if len(words) == 3:
        found = re.fullmatch(r"(?:FY)?(\d{4})(?:-(?:FY)?(\d{4}))?", words[2], re.I)
        if not found or (found[2] and int(found[2]) < int(found[1])):
            raise ValueError(f"no fiscal year or range of them: {words[2]}")
        years = (int(found[1]), int(found[2] or found[1]))
    return none | {"chamber": words[0], "slug": words[1].lower() if len(words) > 1 else None, "years": years}


def write_catalog(df: DataFrame, path: str) -> None:
    """An entry to a line, in the order of the package."""
    df.orderBy("package_id").write.mode("overwrite").json(path)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's catalog table, each package once: the latest row counts."""
    rows = read_table(spark, sf_dir, "catalog_entries")
    tie = F.xxhash64(*[c for c in rows.columns if c != "loaded_at"]).desc()
    return latest(rows, ["package_id"], ["loaded_at", tie]).fillna(DEFAULTS)


def union_new(main: DataFrame, extra: DataFrame, key: str = "package_id") -> DataFrame:
    """main, and the rows of extra whose key it lacks."""
    return main.unionByName(extra.join(main.select(key).distinct(), key, "left_anti"))


def upsert(main: DataFrame, changes: DataFrame, key: str = "package_id") -> DataFrame:
    """changes, and the rows of main whose key they don't have."""
    return main.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes)


def usable(entries: DataFrame) -> DataFrame:
    """Committee-stage reports of a known subcommittee and year that are no bill action."""
    return entries.where(
        (F.col("stage") == "committee")
        & (F.trim(F.coalesce("subcommittee", F.lit(""))) != "")
        & F.col("fiscal_year").isNotNull()
        & ~F.upper("title").startswith("MAKING")
    )


def like_for_like(entries: DataFrame, chain: list[str]) -> DataFrame:
    """If a chain has a prerelease, its other members are read from their PDF too, and those without one are left out."""
    w = Window.partitionBy(*chain)
    pre = F.coalesce(F.col("local_path"), F.lit("")) != ""
    with_mark = entries.withColumn("any_pre", F.max(pre.cast("int")).over(w) == 1)
    kept = with_mark.where(~F.col("any_pre") | pre | (F.coalesce(F.col("pdf_url"), F.lit("")) != ""))
    return kept.withColumn("from_pdf", F.when(F.col("any_pre") & ~pre, True).otherwise(F.coalesce("from_pdf", F.lit(False)))).drop("any_pre")


def raw_path():
    """Where a report's text lies: its own path if it has one, else by congress and chamber."""
    own = F.coalesce(F.col("local_path"), F.lit(""))
    return F.when(own != "", own).otherwise(F.format_string("raw/%d/%s/%s.htm", "congress", "chamber", "package_id"))


def pdf_path(path):
    return F.regexp_replace(path, r"\.htm$", ".pdf")


def unambiguous(pairs: DataFrame, child: str, parent: str) -> DataFrame:
    """Children (normalised names) that have exactly one parent and are no parent themselves."""
    named = pairs.select(normal_name(F.col(child)).alias("name"), normal_name(F.col(parent)).alias("parent")).where("name <> '' AND parent <> ''")
    one = named.groupBy("name").agg(F.count_distinct("parent").alias("n"), F.min("parent").alias("parent")).where("n = 1")
    return one.select("name", "parent").join(named.select(F.col("parent").alias("name")).distinct(), "name", "left_anti")


def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chamber, slug, fy, package_id): of a year's reports the greatest package_id in string order."""
    r = read_table(spark, sf_dir, "reports").where("fiscal_year IS NOT NULL")
    return r.groupBy("chamber", F.lower("subcommittee").alias("slug"), F.col("fiscal_year").alias("fy")).agg(F.max("package_id").alias("package_id"))


def pairs(editions_df: DataFrame) -> DataFrame:
    """Each edition with the latest earlier one of its series."""
    w = Window.partitionBy("chamber", "slug").orderBy("fy")
    p = editions_df.select(
        "chamber", "slug", F.lag("fy").over(w).alias("old_fy"), F.col("fy").alias("new_fy"), F.lag("package_id").over(w).alias("old_package"), F.col("package_id").alias("new_package")
    ).where("old_fy IS NOT NULL")
    name = F.concat_ws("-", "chamber", "slug", F.concat(F.lit("fy"), "old_fy"), F.concat(F.lit("fy"), "new_fy"))
    return p.withColumn("pair", name).withColumn("year_delta", F.greatest(F.lit(1), F.col("new_fy") - F.col("old_fy")))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section once, the latest delivery; null paragraphs as an empty list."""
    s = read_table(spark, sf_dir, "sections")
    tie = F.xxhash64(*[c for c in s.columns if c != "loaded_at"]).desc()
    return latest(s, ["section_id"], ["loaded_at", tie]).withColumn("paragraphs", F.coalesce("paragraphs", F.array()))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "paragraphs")
    tie = F.xxhash64(*[c for c in p.columns if c != "loaded_at"]).desc()
    return latest(p, ["para_id"], ["loaded_at", tie])
