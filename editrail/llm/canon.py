"""Mapping freely typed values to the entries of a reference list, in SQL alone.

Partition-based pigeonhole join: a reference string of a given length is cut into k+1 segments, so a
string within k edits of it holds one of them unchanged, at most a few places away; strings meet by
equality of such positional substrings and built-in levenshtein verifies. The join runs twice: between
whole values, squeezed to their letters, and whole names in every rotation (typing errors, lost or
stray spaces), and between words and the words of names (shortened, reordered, incomplete values),
whose matches are weighed into a score per entry. A shortened word meets the word it shortens by its
consonants: equality with a beginning of the other's, or the positional join over them; levenshtein then
says whether letters were left out and nothing else. What no entry claims comes out through an anti-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from editrail.runtime import cut, read_table

#: Words that p4_found's values are decorated with. They count for an entry that has them and against none.
NEUTRAL = ("and", "the", "of", "for", "on", "a", "nd", "subcommittee", "comm", "committee", "cmte", "account", "acct", "cont", "contd", "d", "continued", "draft", "fy", "no")
#: Edits allowed to a word and to a whole value, by the length of the reference string.
WORD_EDITS = "CASE WHEN {n} < 4 THEN 0 WHEN {n} = 4 THEN 1 WHEN {n} < 7 THEN 2 ELSE 3 END"
VALUE_EDITS = "least(7, CAST({n} / 4 AS INT))"
#: Consonants that a shortened word may lack between others; any number may lack at its end.
CONSONANT_EDITS = "CASE WHEN {n} < 4 THEN 0 WHEN {n} < 6 THEN 1 ELSE 2 END"
#: Words that join others and stand for nothing.
GLUE = ("and", "the", "of", "for", "on", "a")
#: Least share of a value's letters and of an entry's weight that word matches must cover.
VALUE_COVER, ENTRY_COVER = 0.7, 0.45

# first letter and later consonants
_BONES = "concat(left({x}, 1), translate(substr({x}, 2), 'aeiou', ''))"


def _listed(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words) or "NULL"


# lower case, plain spaces, no fiscal years, and digits beside letters read as the letters they are misread from
_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(lower({x}), '\\bfy ?[0-9]+\\b', ' '),
  '(?<=[a-z])0|0(?=[a-z])', 'o'), '(?<=[a-z])1|1(?=[a-z])', 'i'), '(?<=[a-z])5|5(?=[a-z])', 's'), '[^a-z0-9]+', ' ')"""


def _segments(table: str, column: str, edits: str) -> str:
    """Rows (s, n, seg, i) of each string of the reference side cut into k+1 segments."""
    k = edits.format(n="n")
    return f"""
      SELECT s, n, i, substr(s, lo + 1, hi - lo) AS seg FROM (
        SELECT s, n, i, CAST(floor(i * n / (k + 1)) AS INT) AS lo, CAST(floor((i + 1) * n / (k + 1)) AS INT) AS hi
        FROM (SELECT s, n, {k} AS k, explode(sequence(0, {k})) AS i FROM (SELECT DISTINCT {column} AS s, length({column}) AS n FROM {table})))"""


def _probes(table: str, column: str, edits: str, most: int) -> str:
    """Rows (t, n, seg, i): the substrings of each probing string that may equal segment i of a string of length n.

    Segment i can have moved by no more than i edits before it, nor by more than the k - i after it allow.
    """
    k = edits.format(n="n")
    return f"""
      SELECT t, n, i, substr(t, p + 1, hi - lo) AS seg FROM (
        SELECT t, n, k, i, lo, hi, explode(sequence(greatest(0, lo - i, lo + length(t) - n - (k - i)), least(length(t) - (hi - lo), lo + i, lo + length(t) - n + (k - i)))) AS p
        FROM (
          SELECT t, n, k, i, CAST(floor(i * n / (k + 1)) AS INT) AS lo, CAST(floor((i + 1) * n / (k + 1)) AS INT) AS hi
          FROM (
            SELECT t, n, {k} AS k, explode(sequence(0, {k})) AS i
            FROM (SELECT t, explode(sequence(greatest(1, length(t) - {most}), length(t) + {most})) AS n FROM (SELECT DISTINCT {column} AS t FROM {table} WHERE {column} <> ''))
          ) WHERE abs(length(t) - n) <= k
        ) WHERE greatest(0, lo - i, lo + length(t) - n - (k - i)) <= least(length(t) - (hi - lo), lo + i, lo + length(t) - n + (k - i))
      )"""


def _near(probe: str, p_col: str, ref: str, r_col: str, edits: str, most: int) -> str:
    """(t, s, d): probing strings and reference strings within the allowed edits of each other."""
    k = edits.format(n="length(s)")
    return f"""
      SELECT t, s, levenshtein(t, s) AS d FROM (
        SELECT DISTINCT p.t, r.s FROM ({_probes(probe, p_col, edits, most)}) p JOIN ({_segments(ref, r_col, edits)}) r ON p.n = r.n AND p.i = r.i AND p.seg = r.seg
      ) WHERE levenshtein(t, s) <= {k}"""


def _shortened(words: str, refs: str) -> str:
    """(t, s, q): words and the reference words that they are left when letters, but not the first, are left out.

    A word of one letter shortens nothing. Whether only letters were left out: the edits are as many as the lengths differ by.
    """
    bones_t = f"SELECT t, {_BONES.format(x='t')} AS b FROM (SELECT DISTINCT t FROM {words} WHERE length(t) >= 2)"
    bones_s = f"SELECT s, {_BONES.format(x='s')} AS b FROM (SELECT DISTINCT w AS s FROM {refs})"
    begun = f"SELECT t, s FROM ({bones_t}) JOIN (SELECT s, explode(transform(sequence(1, length(b)), n -> left(b, n))) AS b FROM ({bones_s})) USING (b)"
    gapped = f"""SELECT x.t, y.s FROM ({_near(f"({bones_t})", "b", f"({bones_s})", "b", CONSONANT_EDITS, 2)}) n
        JOIN ({bones_t}) x ON x.b = n.t JOIN ({bones_s}) y ON y.b = n.s"""
    return f"""
      SELECT DISTINCT t, s, IF(startswith(s, t), 0.95, 0.9) AS q FROM ({begun} UNION ALL {gapped})
      WHERE length(t) < length(s) AND left(t, 1) = left(s, 1) AND levenshtein(t, s) = length(s) - length(t)"""


def map_values(values: DataFrame, entries: DataFrame, neutral: tuple[str, ...] = GLUE, glue: tuple[str, ...] = GLUE) -> DataFrame:
    """(kind, value, ref_id, how) of each distinct value; ref_id 0 and how 'none' if it stands for no entry.

    values: kind, value. entries: ref_id, kind, name, aliases. neutral: lower-case words that decorate values; they count
    for an entry that has them and against none. glue: words that are no words of a name. A value claims an entry as a
    whole within a quarter of the entry's letters in edits, seven at most; beyond that, by its words alone. Null and blank values are left out,
    values without letters stand for nothing. Repeated values count once, so a hot value costs no
    more than a rare one. A value that two entries claim equally stands for neither. Null names and
    aliases are ignored; an empty list of entries leaves all values unmatched. Other columns are ignored.
    """
    spark = values.sparkSession
    sql = spark.sql
    neutral_sql = _listed(neutral)
    vals = cut(
        sql(
            f"SELECT kind, value, trim({_CLEAN.format(x='value')}) AS clean FROM (SELECT DISTINCT kind, value FROM {{v}} WHERE trim(regexp_replace(value, '(?U)\\\\s', ' ')) <> '')",
            v=values,
        )
    )
    names = sql(f"SELECT ref_id, kind, trim({_CLEAN.format(x='name')}) AS name, aliases FROM {{e}}", e=entries)
    # a name's words in every rotation, with and without its neutral words, whole or one short, squeezed; and its aliases
    forms = cut(
        sql(
            f"""
            WITH w AS (
              SELECT ref_id, kind, split(name, ' ') AS w FROM {{n}} WHERE name <> ''
              UNION ALL SELECT ref_id, kind, filter(split(name, ' '), x -> NOT array_contains(array({neutral_sql}), x)) FROM {{n}} WHERE name <> ''
            ), o AS (
              SELECT ref_id, kind, w, 0.0 AS off FROM w WHERE size(w) > 0
              UNION ALL SELECT ref_id, kind, filter(w, (x, i) -> i <> gap), 0.01 FROM (SELECT *, explode(sequence(0, size(w) - 1)) AS gap FROM w WHERE size(w) > 2)
            )
            SELECT ref_id, kind, form, min(off) AS off FROM (
              SELECT ref_id, kind, array_join(concat(slice(w, r + 1, size(w)), slice(w, 1, r)), '') AS form, off + IF(r = 0, 0.0, 0.001) AS off
              FROM (SELECT *, explode(sequence(0, size(w) - 1)) AS r FROM o)
              UNION ALL SELECT ref_id, kind, regexp_replace(lower(a), '[^a-z0-9]', ''), 0.0 FROM (SELECT ref_id, kind, explode(aliases) AS a FROM {{n}}) WHERE a IS NOT NULL
            ) GROUP BY ref_id, kind, form
            """,
            n=names,
        ).where("form <> ''")
    )
    whole = sql(
        f"""
        SELECT kind, value, t, min(less) AS less FROM (
          SELECT kind, value, replace(clean, ' ', '') AS t, 0.0 AS less FROM {{v}}
          UNION ALL SELECT kind, value, array_join(filter(split(clean, ' '), x -> NOT array_contains(array({neutral_sql}), x)), ''), 0.002 FROM {{v}}
        ) GROUP BY kind, value, t
        """,
        v=vals,
    ).where("t <> ''")
    near = sql(_near("{w}", "t", "{f}", "form", VALUE_EDITS, 7), w=whole, f=forms)
    by_string = sql(
        """
        SELECT kind, value, ref_id, min(d / length(form) + off + less) AS off
        FROM {w} JOIN {m} USING (t) JOIN (SELECT kind AS k, ref_id, form, off FROM {f}) ON s = form AND kind = k
        GROUP BY kind, value, ref_id
        """,
        w=whole,
        m=near,
        f=forms,
    )
    words = sql("SELECT DISTINCT kind, ref_id, explode(split(name, ' ')) AS w FROM {n} WHERE name <> ''", n=names)
    words = sql(f"SELECT * FROM {{w}} WHERE coalesce(w NOT IN ({_listed(glue)}), true)", w=words)
    weights = cut(
        sql(
            """
            SELECT w.kind, w.ref_id, w.w, ln(1 + c.n / f.n) AS weight, sum(ln(1 + c.n / f.n)) OVER (PARTITION BY w.kind, w.ref_id) AS total
            FROM {w} w JOIN (SELECT kind, w, count(*) AS n FROM {w} GROUP BY kind, w) f ON w.kind = f.kind AND w.w = f.w
            JOIN (SELECT kind, count(DISTINCT ref_id) AS n FROM {w} GROUP BY kind) c ON w.kind = c.kind
            """,
            w=words,
        )
    )
    # each word, and the ways to read it: a 1 was read as i, but may stand for l
    tokens = cut(
        sql(
            """
            SELECT DISTINCT kind, value, word, t FROM (
              SELECT kind, value, word, explode(IF(value RLIKE '1', array(word, replace(word, 'i', 'l')), array(word))) AS t
              FROM (SELECT kind, value, explode(split(clean, ' ')) AS word FROM {v})
            ) WHERE t <> ''
            """,
            v=vals,
        )
    )
    typed = f"SELECT t, s, 1 - d / length(s) AS q FROM ({_near('{t}', 't', '{w}', 'w', WORD_EDITS, 3)})"
    alike = cut(sql(f"SELECT t, s, max(q) AS q FROM ({_shortened('{t}', '{w}')} UNION ALL {typed}) GROUP BY t, s", t=tokens, w=weights))
    by_words = sql(
        f"""
        WITH hit AS (
          SELECT tk.kind, tk.value, tk.word, w.ref_id, w.w, w.weight, w.total, a.q
          FROM {{t}} tk JOIN {{a}} a ON tk.t = a.t JOIN {{w}} w ON w.w = a.s AND w.kind = tk.kind
        ), v AS (SELECT kind, value, ref_id, sum(IF(word IN ({neutral_sql}), 0, length(word)) * q) AS said FROM (SELECT kind, value, ref_id, word, max(q) AS q FROM hit GROUP BY ALL) GROUP BY ALL),
        e AS (SELECT kind, value, ref_id, sum(weight * q) / max(total) AS cover FROM (SELECT kind, value, ref_id, w, weight, total, max(q) AS q FROM hit GROUP BY ALL) GROUP BY ALL),
        -- neutral words count for an entry's cover, not for or against the value's
        n AS (SELECT kind, value, sum(IF(word IN ({neutral_sql}), 0, length(word))) AS letters FROM (SELECT DISTINCT kind, value, word FROM {{t}}) GROUP BY ALL)
        SELECT v.kind, v.value, v.ref_id, least(1, said / greatest(letters, 1)) AS said, cover
        FROM v JOIN e ON v.kind = e.kind AND v.value = e.value AND v.ref_id = e.ref_id JOIN n ON n.kind = v.kind AND n.value = v.value
        """,
        t=tokens,
        a=alike,
        w=weights,
    )
    claims = sql(
        f"""
        SELECT kind, value, ref_id, max(score) AS score, max_by(how, score) AS how FROM (
          SELECT kind, value, ref_id, 2 - off AS score, 'string' AS how FROM {{s}}
          UNION ALL SELECT kind, value, ref_id, said * cover, 'words' FROM {{b}} WHERE said >= {VALUE_COVER} AND cover >= {ENTRY_COVER}
        ) GROUP BY kind, value, ref_id
        """,
        s=by_string,
        b=by_words,
    )
    best = sql(
        """
        SELECT kind, value, ref_id, how FROM (
          SELECT *, rank() OVER (PARTITION BY kind, value ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY kind, value, score) AS ties FROM {c}
        ) WHERE r = 1 AND ties = 1
        """,
        c=claims,
    )
    best = cut(best)
    return sql(
        """
        SELECT kind, value, ref_id, how FROM {b}
        UNION ALL SELECT kind, value, 0L, 'none' FROM {v} v LEFT ANTI JOIN {b} b ON v.kind = b.kind AND v.value = b.value
        """,
        b=best,
        v=vals,
    )


def typed_values(catalog: DataFrame, sections: DataFrame) -> DataFrame:
    """(record_kind, record_key, kind, value): the latest row of each package and of each level-3 section."""
    return catalog.sparkSession.sql(
        """
        SELECT 'catalog' AS record_kind, package_id AS record_key, 'subcommittee' AS kind, m.value FROM (
          SELECT package_id, max(struct(loaded_at, subcommittee AS value)) AS m FROM {c} GROUP BY package_id)
        UNION ALL
        SELECT 'section', CAST(section_id AS STRING), 'heading', m.value FROM (
          SELECT section_id, max(struct(loaded_at, level, heading AS value)) AS m FROM {s} GROUP BY section_id) WHERE m.level = 3
        """,
        c=catalog,
        s=sections,
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank subcommittees have no row; a blank heading stands for none (0)."""
    rows = typed_values(read_table(spark, sf_dir, "catalog_entries"), read_table(spark, sf_dir, "sections"))
    rows = rows.where("record_kind = 'section' OR trim(regexp_replace(value, '(?U)\\\\s', ' ')) <> ''")
    mapped = map_values(rows, read_table(spark, sf_dir, "canon_entries"), NEUTRAL)
    return spark.sql(
        "SELECT r.record_kind, r.record_key, coalesce(m.ref_id, 0L) AS ref_id FROM {r} r LEFT JOIN {m} m ON r.kind = m.kind AND r.value = m.value",
        r=rows,
        m=mapped,
    )
