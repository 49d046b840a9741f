"""What changed between consecutive full snapshots.

`snapshot_changes` compares every snapshot of a series with the next one present: EXCEPT ALL both
ways drops the identical rows, the residues are full-joined by record key and labelled. All pairs of
snapshots of all series go through one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from editrail.runtime import cut, latest, read_table, small

#: Any run of white space, Unicode's included.
SPACE_RUN = r"(?U)\s+"


def one_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE_RUN, " "))


def key_hash(name: str, *columns) -> list[Column]:
    """128 bits of the columns, as name1 and name2. A null is a value of its own; nulls within arrays need a column that marks them."""
    parts = [x for c in columns for c in [F.col(c) if isinstance(c, str) else c] for x in (c, c.isNull())]
    return [F.xxhash64(*parts).alias(f"{name}1"), F.xxhash64(F.lit(1), *parts).alias(f"{name}2")]


def snapshot_steps(snapshots: DataFrame, series: list[str], version: str, snapshot: str) -> DataFrame:
    """(snapshot, old_step, new_step, series, old_version, new_version) of every snapshot and its neighbours.

    A step is the change from a version to the next one present; old_step is the step that the snapshot is the old side of,
    new_step the one it is the new side of, null where it has no neighbour. A snapshot without records is a snapshot.
    """
    s = snapshots.where(F.col(version).isNotNull()).select(*series, F.col(version).alias("at"), snapshot)
    w = Window.partitionBy(*series).orderBy("at")
    s = s.withColumn("next_at", F.lead("at").over(w)).withColumn("last_at", F.lag("at").over(w))
    step = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.xxhash64(*[F.to_json(F.struct(c)) for c in series], a, b))
    return s.select(snapshot, *series, F.col("at").alias("version"), F.col("next_at").alias("next_version"), step(F.col("at"), F.col("next_at")).alias("old_step"), step(F.col("last_at"), F.col("at")).alias("new_step"))


def snapshot_changes(records: DataFrame, steps: DataFrame, snapshot: str, key: list[str], content: str) -> DataFrame:
    """(step, key columns, change_kind) of each record that differs between the two snapshots of a step.

    records: snapshot, key columns, content; (snapshot, key) is unique. steps: as snapshot_steps gives them. `content` is
    compared as it stands. Nulls: null keys are values of their own; records of an unknown snapshot are in none; null content
    equals null content. Without records, or with one snapshot to a series, there are no rows. Other columns are ignored.

    The snapshots' table is broadcast if a count proves it small, so no record is shuffled by its snapshot and a
    large snapshot is no hot key. EXCEPT ALL and the join go over (step, key, content), which is nearly unique.
    """
    rows = records.select(snapshot, *key, F.col(content).alias("content")).join(small(steps.select(snapshot, "old_step", "new_step")), snapshot)
    ids = ["step", *key]
    side = lambda step: rows.where(F.col(step).isNotNull()).select(F.col(step).alias("step"), *key, "content")
    old, new = side("old_step"), side("new_step")
    # null-safe joining: every key column goes beside its null mark
    safe = lambda df, mark: df.select("step", *[F.coalesce(F.col(c), F.lit(_zero(df, c))).alias(c) for c in key], *[F.col(c).isNull().alias(f"{c}_null") for c in key], F.lit(1).alias(mark))
    gone, come = safe(old.exceptAll(new), "in_old"), safe(new.exceptAll(old), "in_new")
    found = gone.join(come, ids + [f"{c}_null" for c in key], "full_outer")
    kind = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").otherwise("changed")
    return found.select("step", *[F.when(~F.col(f"{c}_null"), F.col(c)).alias(c) for c in key], kind.alias("change_kind"))


def _zero(df: DataFrame, column: str):
    """A value of the column's type that stands beside a null mark."""
    return "" if df.schema[column].dataType.typeName() == "string" else 0


def report_series(reports: DataFrame) -> DataFrame:
    """(chamber, subcommittee, fiscal_year, package_id): of a year's reports the greatest package_id counts."""
    return (
        reports.where("fiscal_year IS NOT NULL AND package_id IS NOT NULL")
        .groupBy("chamber", "subcommittee", "fiscal_year")
        .agg(F.max("package_id").alias("package_id"))
    )


def section_changes(sections: DataFrame, reports: DataFrame) -> DataFrame:
    """Sections added, removed or changed between one report of a panel and the next.

    Sections of equal path within a report are numbered by seq. Content is the list of paragraph
    texts, white space made single; null paragraphs equal an empty list, a null text is a text of its
    own. Null paths are one path, printed as null. Repeated rows count once, later loaded_at wins. A report
    without sections is a snapshot, of none.

    Paths and contents travel as hashes, 128 bits of a path and 64 of a content (contents are compared for one key at
    a time); the paths of what differs are looked up among the distinct ones at the end.
    """
    texts = F.transform(F.coalesce("paragraphs", F.array()), lambda p: F.coalesce(one_spaced(p["text"]), F.lit("\u0000")))
    joined = F.concat(F.size(texts).cast("string"), F.lit("\u0001"), F.array_join(texts, "\u0001"))
    hashed_path = key_hash("p", "path", F.transform("path", lambda x: x.isNull()))
    slim = sections.select("section_id", "package_id", "seq", *hashed_path, "loaded_at", F.xxhash64(joined).alias("content"))
    rows = latest(slim, ["section_id"], ["loaded_at", F.col("seq").desc_nulls_last(), F.xxhash64("package_id", "p1", "content").desc()])
    w = Window.partitionBy("package_id", "p1", "p2").orderBy("seq", "section_id")
    rows = rows.select("package_id", "p1", "p2", F.row_number().over(w).alias("occ"), "content")
    series = report_series(reports)
    steps = cut(snapshot_steps(series, ["chamber", "subcommittee"], "fiscal_year", "package_id"))
    out = snapshot_changes(rows, steps, "package_id", ["p1", "p2", "occ"], "content")
    names = sections.select(*hashed_path, F.array_join("path", " > ").alias("path")).groupBy("p1", "p2").agg(F.first("path").alias("path"))
    about = steps.where("old_step IS NOT NULL").select(F.col("old_step").alias("step"), "chamber", "subcommittee", F.col("version").alias("old_fy"), F.col("next_version").alias("new_fy"))
    out = out.join(names, ["p1", "p2"]).join(small(about), "step")
    return out.select("chamber", "subcommittee", "old_fy", "new_fy", "path", "occ", "change_kind")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_changes(read_table(spark, sf_dir, "sections"), read_table(spark, sf_dir, "reports"))


#: DuckDB text of p1_found, written on its own lines of thought: a plain full join, no EXCEPT.
P1_SQL = r"""
WITH s AS (
  SELECT section_id, package_id, seq, path, paragraphs FROM sections
  QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY loaded_at DESC) = 1
), t AS (
  SELECT package_id, path, seq, section_id,
    list_transform(coalesce(paragraphs, []), lambda x: coalesce(trim(regexp_replace(x.text, '\s+', ' ', 'g')), chr(1))) AS texts,
    CAST(row_number() OVER (PARTITION BY package_id, path ORDER BY seq, section_id) AS INTEGER) AS occ
  FROM s
), r AS (
  SELECT chamber, subcommittee, fiscal_year AS fy, max(package_id) AS package_id
  FROM reports WHERE fiscal_year IS NOT NULL GROUP BY ALL
), y AS (
  SELECT *, lead(fy) OVER (PARTITION BY chamber, subcommittee ORDER BY fy) AS next_fy,
    lead(package_id) OVER (PARTITION BY chamber, subcommittee ORDER BY fy) AS next_package FROM r
), a AS (SELECT y.*, t.path, t.occ, t.texts FROM y JOIN t ON t.package_id = y.package_id WHERE next_fy IS NOT NULL),
b AS (SELECT y.*, t.path, t.occ, t.texts FROM y JOIN t ON t.package_id = y.next_package WHERE next_fy IS NOT NULL)
SELECT coalesce(a.chamber, b.chamber) AS chamber, coalesce(a.subcommittee, b.subcommittee) AS subcommittee,
  coalesce(a.fy, b.fy) AS old_fy, coalesce(a.next_fy, b.next_fy) AS new_fy,
  array_to_string(coalesce(a.path, b.path), ' > ') AS path, coalesce(a.occ, b.occ) AS occ,
  CASE WHEN a.occ IS NULL THEN 'added' WHEN b.occ IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM a FULL JOIN b ON a.package_id = b.package_id AND a.path = b.path AND a.occ = b.occ
WHERE a.occ IS NULL OR b.occ IS NULL OR a.texts <> b.texts
"""
