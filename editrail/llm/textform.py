"""One consistent form for text that looks the same but is stored in different characters.

`canonical` composes compatibility normalisation (limited to what is drawn alike), look-alike letters,
mapped white space and removal of invisible characters; `case_fold=True` adds full case folding for
comparisons that ignore case. `with_canonical` runs it over a DataFrame: plain ASCII stays in the JVM,
the rest goes to Arrow batches where each distinct value is worked on once.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from editrail.runtime import cut, read_table

# Cyrillic and Greek letters drawn like Latin letters, and those Latin letters.
CYRILLIC = "АВЕКМНОРСТУХЅІЈԌԚԜҮӀаеорсухѕіјһԁԛԝӏ"
CYRILLIC_AS = "ABEKMHOPCTYXSIJGQWYIaeopcyxsijhdqwl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϳͿ"
GREEK_AS = "ABEZHIKMNOPTYXojJ"
# Hyphens as short as the one of ASCII: Armenian, the plain and the non-breaking one, bullet, small, full-width.
HYPHENS = "֊‐‑⁃﹣－"

_INVISIBLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}\p{Cc}--\s\x1c-\x1f]+", regex.V1)
_SPACES = regex.compile(r"[\s\x1c-\x1f]+")
#: Parts that the rows of one look are spread over. Any number gives the same classes.
SALTS = 8
_JOINED = ("<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>")


@lru_cache(maxsize=1)
def drawn_alike() -> dict[int, str]:
    """Single characters and the ordinary letters they are drawn as, derived from Unicode's own data.

    Full-width, half-width and joined forms, characters drawn as a row of letters (Roman numerals,
    units, TEL) and look-alike letters. Raised and lowered characters, fractions, letters in circles
    and letters of another face are no such characters.
    """
    table: dict[int, str] = {}
    for code in range(0x80, sys.maxunicode + 1):
        tag, _, _ = unicodedata.decomposition(chr(code)).partition(" ")
        if not tag.startswith("<"):
            continue
        plain = unicodedata.normalize("NFKC", chr(code))
        letters = all(c.isalpha() or c == "." for c in plain) and plain[0] != "."
        row = tag in ("<compat>", "<square>") and letters and "<super>" not in unicodedata.decomposition(chr(code))
        if tag in _JOINED or (row and (len(plain) > 1 or 0x2160 <= code < 0x2180)):
            table[code] = plain
    table.update(zip(map(ord, CYRILLIC + GREEK), CYRILLIC_AS + GREEK_AS))
    table.update(dict.fromkeys(map(ord, HYPHENS), "-"))
    return table


def canonical(text: str | None, case_fold: bool = False) -> str | None:
    """The form in which texts that look the same are equal. Null stays null, blank becomes empty."""
    if text is None:
        return None
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        if not text.isascii():
            table = drawn_alike()
            text = unicodedata.normalize("NFD", text).translate(table)
            text = unicodedata.normalize("NFC", text)
    elif not text.isprintable():
        text = _INVISIBLE.sub("", text)
    text = _SPACES.sub(" ", text).strip(" ")
    if case_fold:
        text = unicodedata.normalize("NFC", text.casefold())
    return text


def _canonical_udf(case_fold: bool):
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        codes, values = pd.factorize(texts, use_na_sentinel=True)
        done = [canonical(v, case_fold) for v in values] + [None]
        return pd.Series([done[c] for c in codes], dtype=object)

    return run


def canonical_column(text: Column, case_fold: bool = False) -> Column:
    """canonical() of a column: ASCII with no control character but white space by JVM functions alone."""
    # \z, not $: Java's $ also matches before a last line end, of which U+0085, U+2028 and U+2029 are some
    plain = text.rlike(r"\A[\x20-\x7e\t-\r]*\z")
    in_jvm = F.trim(F.regexp_replace(text, r"\s+", " "))
    if case_fold:
        in_jvm = F.lower(in_jvm)
    return F.coalesce(F.when(plain, in_jvm), _canonical_udf(case_fold)(F.when(~plain, text)))


def with_canonical(df: DataFrame, text: str, out: str = "canonical", case_fold: bool = False) -> DataFrame:
    """df and one more column: null for null, empty for blank text. Texts of any length are done whole."""
    return df.withColumn(out, canonical_column(F.col(text), case_fold))


def text_hashes(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep and 128-bit hashes of the text as stored (s1, s2) and of its one form (c1, c2).

    All four are null for null and blank texts.
    """
    form = with_canonical(rows.select(*keep, "text"), "text")
    some = F.col("canonical") != ""
    pair = lambda c, n: [F.when(some, F.xxhash64(c)).alias(f"{n}1"), F.when(some, F.xxhash64(F.lit(1), c)).alias(f"{n}2")]
    return form.select(*keep, *pair("text", "s"), *pair("canonical", "c"))


#: Rows of one look that a task joins with as many others; a look with more is spread over blocks.
BLOCK_ROWS = 5_000


def look_alike_classes(hashes: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, id, class_id, form_id) of the rows whose look is stored in more than one form in their scope.

    class_id is the least id of the look, form_id the least id of the stored form: rows of a class look the same, and
    rows of a form are equal as stored. One row to a row, so a text repeated in a third of all rows costs its rows, not
    their square. hashes: id, the columns of scope, and those of text_hashes; repeated rows count once. Null and
    blank texts are in no class, nor are null scopes. An empty table gives no rows; other columns are ignored.
    """
    look = [*scope, "c1", "c2"]
    # kept, since it is read twice and its making runs Python
    known = cut(hashes.select("id", *look, "s1", "s2").where(" AND ".join(f"`{c}` IS NOT NULL" for c in look)))
    # looks of several forms, by an aggregate that combines before the shuffle: a hot text sends one row from a task
    forms = F.struct("s1", "s2")
    looks = known.groupBy(*look).agg(F.min(forms).alias("lo"), F.max(forms).alias("hi"), F.min("id").alias("class_id")).where("lo <> hi").select(*look, "class_id")
    # they are few; the rows meet them by a salt, so a hot look is no hot key
    looks = looks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = known.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(looks, [*look, "salt"])
    rows = cut(rows.select(*scope, "id", "class_id", "s1", "s2").distinct())
    of_form = rows.groupBy(*scope, "class_id", "s1", "s2").agg(F.min("id").alias("form_id"))
    return rows.join(of_form, [*scope, "class_id", "s1", "s2"]).select(*scope, "id", "class_id", "form_id")


def look_alike_pairs(hashes: DataFrame, scope: list[str]) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the classes of look_alike_classes as pairs of rows of different forms.

    As many rows as there are such pairs. A class of many rows is spread over blocks, each joined by tasks of its own.
    """
    classes = cut(look_alike_classes(hashes, scope))
    size = classes.groupBy(*scope, "class_id").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    rows = classes.join(size, [*scope, "class_id"])
    a = rows.select(*scope, "class_id", F.col("id").alias("id_a"), F.col("form_id").alias("form_a"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    b = rows.select(*scope, "class_id", F.col("id").alias("id_b"), F.col("form_id").alias("form_b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return a.join(b, [*scope, "class_id", "block"]).where("id_a < id_b AND form_a <> form_b").select("id_a", "id_b").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later loaded_at replaces a paragraph; its hashes stand for the text, which is never shuffled."""
    p = read_table(spark, sf_dir, "paragraphs").withColumnRenamed("para_id", "id")
    p = text_hashes(p, ["id", "loaded_at"]).groupBy("id").agg(F.max(F.struct("loaded_at", "s1", "s2", "c1", "c2")).alias("m"))
    h = read_table(spark, sf_dir, "headings").withColumnRenamed("heading_id", "id")
    para = look_alike_pairs(p.select("id", "m.*"), [])
    head = look_alike_pairs(text_hashes(h, ["id", "package_id"]), ["package_id"])
    kind = lambda df, k: df.select(F.lit(k).alias("record_kind"), "id_a", "id_b")
    return kind(para, "paragraph").unionByName(kind(head, "heading"))


def _p5_sql() -> str:
    """p5_found over the characters that these tables hold, by the other engine's translate and NFC."""
    wide = "".join(chr(0xFF01 + k) for k in range(94))
    plain = "".join(chr(0x21 + k) for k in range(94))
    source, target = wide + CYRILLIC + GREEK + "\u2010\u2011", plain + CYRILLIC_AS + GREEK_AS + "--"
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    form = f"translate(regexp_replace(text, '[\\x{{00AD}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}]', '', 'g'), {quoted(source)}, {quoted(target)})"
    rows = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\u2160": "I", "\u2161": "II", "\u2162": "III", "\u2163": "IV", "\u2164": "V"}
    for one, row in rows.items():
        form = f"replace({form}, '{one}', '{row}')"
    form = f"trim(regexp_replace(nfc_normalize({form}), '[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))"
    return f"""
    WITH p AS (SELECT para_id AS id, text FROM paragraphs QUALIFY row_number() OVER (PARTITION BY para_id ORDER BY loaded_at DESC) = 1),
    a AS (SELECT 'paragraph' AS record_kind, id, '' AS scope, text, {form} AS form FROM p WHERE text IS NOT NULL
      UNION ALL SELECT DISTINCT 'heading', heading_id, package_id, text, {form} FROM headings WHERE text IS NOT NULL)
    SELECT DISTINCT x.record_kind, x.id AS id_a, y.id AS id_b FROM a x JOIN a y ON x.record_kind = y.record_kind AND x.scope = y.scope AND x.form = y.form
    WHERE x.id < y.id AND x.text <> y.text AND x.form <> ''"""


P5_SQL = _p5_sql()
