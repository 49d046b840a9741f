"""Paragraph pairing, word edits and change classes of matched sections."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editrail.functions import policy
from editrail.functions.similarity import blocks_ratio, changed_words, word_edits
from editrail.functions.text import MASKS, describe

# Classes in their order, when a change is minor or two paragraphs may be paired, and how much of a text is its key.
CLASSES = ["unchanged", "numbers only", "minor", "substantive", "new", "dropped"]
MINOR_WORDS, MINOR_RATIO, PAIR_RATIO, KEY_CHARS = 5, 0.97, 0.5, 120

_masks = [(re.compile(p), r) for p, r in MASKS]


def masked(text: str) -> str:
    for pattern, placeholder in _masks:
        text = pattern.sub(placeholder, text)
    return text


def literal_class(old: str, new: str, changed: int) -> str:
    if old == new:
        return "unchanged"
    a, b = masked(old), masked(new)
    if a == b:
        return "numbers only"
    # the cheap half of the rule first: characters are compared only where it doesn't decide
    return "minor" if changed <= MINOR_WORDS or blocks_ratio(a, b) >= MINOR_RATIO else "substantive"


def diff_texts(old: str, new: str, year_delta: int = 1, lexicon: policy.Lexicon = policy.LEXICON) -> dict:
    if old == new:
        return {"change": "unchanged", "literal": "unchanged", "changed_words": 0, "edits": [], "flags": []}
    edits = word_edits(old, new)
    n = changed_words(edits)
    literal = literal_class(old, new, n)
    found = policy.flag_edit(old, new, edits, year_delta, lexicon)
    change = "substantive" if policy.highest_tier(found) >= policy.REVIEW else literal
    return {"change": change, "literal": literal, "changed_words": n, "edits": edits, "flags": found}


def paragraph_key(p: dict) -> str:
    return f"{p['kind']}:{p['topic'].lower()}" if p["topic"] else masked((p["text"] or "").lower())[:KEY_CHARS]


def pair_paragraphs(olds: list[dict], news: list[dict]) -> list[tuple[int | None, int | None]]:
    """Index pairs in reading order; None where a paragraph has no counterpart.

    Equal runs of keys pair by position; within a replaced run the pairs of most alike words are taken first.
    """
    if olds == news:
        return [(i, i) for i in range(len(olds))]
    matcher = difflib.SequenceMatcher(None, [paragraph_key(p) for p in olds], [paragraph_key(p) for p in news], autojunk=False)
    out: list[tuple[int | None, int | None]] = []
    for tag, i1, i2, j1, j2 in matcher.get_opcodes():
        if tag == "equal":
            out += [(i1 + k, j1 + k) for k in range(i2 - i1)]
            continue
        chosen: dict[int, int] = {}
        if tag == "replace":
            words_old = [(olds[i]["text"] or "").split() for i in range(i1, i2)]
            words_new = [(news[j]["text"] or "").split() for j in range(j1, j2)]
            graded = []
            for i, a in enumerate(words_old):
                for j, b in enumerate(words_new):
                    m = difflib.SequenceMatcher(None, a, b, autojunk=False)
                    if m.quick_ratio() >= PAIR_RATIO and (r := m.ratio()) >= PAIR_RATIO:
                        graded.append((r, i1 + i, j1 + j))
            for _, i, j in sorted(graded, key=lambda g: -g[0]):
                if i not in chosen and j not in chosen.values():
                    chosen[i] = j
        out += [(i, chosen.get(i)) for i in range(i1, i2)]
        out += [(None, j) for j in range(j1, j2) if j not in chosen.values()]
    return out


FLAG = "struct<category:string,reason:string,tier:int,before:struct<lead:string,mid:string,trail:string>,after:struct<lead:string,mid:string,trail:string>,at:int>"
DIFFS = (
    "pair string, old_id long, new_id long, idx int, old_idx int, new_idx int, kind string, topic string, old_text string, new_text string, "
    f"change string, literal string, changed_words int, edits array<struct<tag:string,old:array<string>,new:array<string>>>, flags array<{FLAG}>"
)
_COLUMNS = "pair old_id new_id idx old_idx new_idx kind topic old_text new_text change literal changed_words edits flags".split()


def paragraph_diffs(matched: DataFrame, lexicon: policy.Lexicon = policy.LEXICON) -> DataFrame:
    """One row per paragraph of every matched section, in reading order; lone ones with tags of what they say.

    matched: pair, old_id, new_id, old_paragraphs, new_paragraphs, year_delta. A row is a whole unit of work, so
    nothing is shuffled; null lists and null texts count as empty.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                olds, news = ([dict(p) for p in x] if x is not None else [] for x in (r.old_paragraphs, r.new_paragraphs))
                for idx, (i, j) in enumerate(pair_paragraphs(olds, news)):
                    a, b = (olds[i] if i is not None else None), (news[j] if j is not None else None)
                    ta, tb = ((p["text"] or "") if p else None for p in (a, b))
                    if a and b:
                        d = diff_texts(ta, tb, int(r.year_delta), lexicon)
                    else:
                        lone = "dropped" if a else "new"
                        d = {"change": lone, "literal": None, "changed_words": len((ta if a else tb).split()), "edits": [], "flags": []}
                    edits = [{"tag": t, "old": o, "new": n} for t, o, n in d["edits"]]
                    p = b or a
                    out.append((r.pair, r.old_id, r.new_id, idx, i, j, p["kind"], p["topic"], ta, tb, d["change"], d["literal"], d["changed_words"], edits, d["flags"]))
            frame = pd.DataFrame(out, columns=_COLUMNS)
            frame[["old_idx", "new_idx"]] = frame[["old_idx", "new_idx"]].astype("Int32")
            yield frame

    slim = matched.select("pair", "old_id", "new_id", "old_paragraphs", "new_paragraphs", "year_delta")
    lone = F.col("change").isin("new", "dropped")
    return slim.mapInPandas(run, DIFFS).withColumn("tags", F.when(lone, describe(F.coalesce("new_text", "old_text"))).otherwise(F.array().cast("array<string>")))


def text_diffs(pairs: DataFrame, lexicon: policy.Lexicon = policy.LEXICON) -> DataFrame:
    """pairs (old_text, new_text, year_delta and other columns) with the change, the changed words and the flags of each."""
    kind = f"struct<change:string,changed_words:int,flags:array<{FLAG}>>"

    @F.pandas_udf(kind)
    def run(old: pd.Series, new: pd.Series, gap: pd.Series) -> pd.DataFrame:
        rows = [diff_texts(a, b, int(g), lexicon) for a, b, g in zip(old, new, gap)]
        return pd.DataFrame({c: [r[c] for r in rows] for c in ("change", "changed_words", "flags")})

    said = run(F.coalesce("old_text", F.lit("")), F.coalesce("new_text", F.lit("")), "year_delta")
    return pairs.withColumn("__d", said).select(*pairs.columns, "__d.*")


def policy_flags(diffs: DataFrame, least_tier: int = policy.NOTE) -> DataFrame:
    """A row per flag of at least that tier: where, category and its name on a page, tier, reason, and the words before and after."""
    f = diffs.select("pair", "old_id", "new_id", "idx", F.explode("flags").alias("f")).where(F.col("f.tier") >= least_tier)
    label = F.element_at(F.create_map(*[F.lit(x) for kv in policy.LABELS.items() for x in kv]), F.col("f.category"))
    return f.select("pair", "old_id", "new_id", "idx", "f.at", "f.category", F.coalesce(label, F.col("f.category")).alias("label"), "f.tier", "f.reason", "f.before", "f.after")


def max_tier(flags: Column) -> Column:
    """The highest tier among flags, 0 without any."""
    return F.coalesce(F.array_max(F.transform(flags, lambda f: f["tier"])), F.lit(0))


def class_rank(change: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, CLASSES)), change) - 1).cast("int")


def class_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CLASSES)), rank + 1)


def section_diffs(diffs: DataFrame) -> DataFrame:
    """(pair, old_id, new_id, change, changed_words): the greatest class of a section's paragraphs; a lone paragraph counts as substantive."""
    rank = F.least(class_rank(F.col("change")), F.lit(3))
    return diffs.groupBy("pair", "old_id", "new_id").agg(F.max(rank).alias("rank"), F.sum("changed_words").cast("long").alias("changed_words")).select("pair", "old_id", "new_id", class_name(F.col("rank")).alias("change"), "changed_words")
