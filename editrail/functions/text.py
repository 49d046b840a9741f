"""Column functions on headings, lines and paragraphs. All of them run in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from editrail.functions import policy

# The placeholders of figures, applied in this order.
MASKS = [
    (r"\b(?:19|20)\d{2}\b", "#Y"),
    (r"\$?\b\d[\d,]*(?:\.\d+)?\b", "#"),
    (r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+#(?:,\s*#Y)?", "#D"),
]

# Character classes written out, since \s, \d and \b of Java, Python and SQL engines differ beyond ASCII: these are Python's.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = r"[\p{L}\p{N}_]"
_EDGE = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"

# How provisions and directives open, and which hyphens at a wrap go.
PROVISION = r"^(?:Section|Sec\.)\s+(\d+[A-Za-z]?)\b"
LEAD_IN = r"^([A-Z][^.]{2,80}?)\.--"
WRAP_HYPHEN = r"(?<=[a-z])- (?!(?:and|or)\b)(?=[a-z])"
# Fixed value: the acronym that ends a heading.
ACRONYM_AT_END = r"\s*\([A-Z][A-Za-z0-9&-]{1,5}\)\s*\z"

def bounded(pattern: str) -> str:
    """A Python pattern for Java: blanks, digits and word boundaries (outside brackets) written out."""
    return pattern.replace(r"\b", _EDGE).replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]").replace(r"\w", _WORD).replace(r"\d", r"\p{Nd}")


def by_class(text: Column, pattern: str, f) -> Column:
    """f(text, pattern) with Python's classes; texts where Java's own are the same take the pattern as it is, which is faster."""
    odd = text.rlike(r"[^\x00-\x1b\x20-\x7f]")
    return F.when(odd, f(text, bounded(pattern))).otherwise(f(text, pattern))


def _count(text: Column, pattern: str) -> Column:
    return by_class(text, pattern, lambda t, p: F.regexp_count(t, F.lit(p)))


def mask(text: Column) -> Column:
    """Years, numbers, then dates become placeholders, so that text differing in figures alone is equal."""
    return reduce(lambda t, m: F.regexp_replace(t, m[0], m[1]), MASKS, text)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("int")


def normal_name(name: Column) -> Column:
    """Upper case, other than letters, digits and blanks to blanks, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(name), "[^A-Z0-9 ]+", " "), " +", " "))


def normal_heading(heading: Column) -> Column:
    """normal_name without a trailing acronym in brackets, and with years as FY."""
    bare = F.regexp_replace(heading, bounded(ACRONYM_AT_END), "")
    return normal_name(F.regexp_replace(F.upper(bare), bounded(r"\b(?:19|20)[0-9]{2}\b"), "FY"))


def comparison_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9$%]+", " "))


def unwrap(lines: Column) -> Column:
    """Wrapped text as one line; a word cut at the wrap is joined, unless 'and' or 'or' follows the hyphen."""
    return F.regexp_replace(squeeze(lines), WRAP_HYPHEN, "")


def paragraph_topic(text: Column) -> Column:
    """What a paragraph is about: the number of a provision, or the words before '.--'."""
    number = F.regexp_extract(text, bounded(PROVISION), 1)
    lead = F.regexp_extract(text, LEAD_IN, 1)
    return F.when(number != "", F.concat(F.lit("Section "), number)).when(lead != "", lead)


def paragraph_kind(text: Column) -> Column:
    topic = paragraph_topic(text)
    return F.when(topic.rlike(r"^Section \p{Nd}"), "gp_section").when(topic.isNotNull(), "directive").otherwise("narrative")


def phrase_count(text: Column, pattern: str) -> Column:
    return _count(F.lower(text), pattern)


def scoped_count(text: Column, pattern: str, scope: str) -> Column:
    """Count outside the phrases of the scope."""
    return _count(by_class(F.lower(text), scope, lambda t, p: F.regexp_replace(t, p, " ")), pattern)


def family_counts(text: Column, lexicon: policy.Lexicon = policy.LEXICON) -> list[Column]:
    """A count column for each tier of force, family, limits and deadlines."""
    out = [phrase_count(text, p).alias(n) for n, p in lexicon.force.items()]
    for name, p in lexicon.families.items():
        out.append((scoped_count(text, p, lexicon.scope) if name in lexicon.scoped else phrase_count(text, p)).alias(name))
    return [*out, phrase_count(text, lexicon.limit).alias("limit"), phrase_count(text, lexicon.deadline).alias("deadline")]


def words_of(text: Column) -> Column:
    """The words of a text, by Python's white space."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def _bare(word: Column) -> Column:
    edge = "[" + re.escape(policy.PUNCTUATION).replace("“", "\\u201c").replace("”", "\\u201d").replace("‘", "\\u2018").replace("’", "\\u2019") + "]+"
    return F.regexp_replace(F.lower(word), rf"\A{edge}|{edge}\z", "")


def has_deadline(text: Column) -> Column:
    """Whether a number of the text counts days, weeks, months or years, and is no year, citation or date."""
    numeral = "(?i)\\A[+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:e[+-]?\\d+)?\\z"
    spelt = F.array(*map(F.lit, policy.NUMBER_WORDS))
    cite, no_cite = bounded(policy.CITATION.replace("$", "\\z")), "(?:" + "|".join(policy.NO_CITATION) + ")\\z"

    def holds(words: Column, bare: Column, b: Column, k: Column) -> Column:
        value = F.regexp_replace(F.regexp_replace(b, "[$,]", ""), "%+\\z", "")
        before = F.array_join(F.slice(bare, F.greatest(k - policy.NUMBER_CONTEXT + 1, F.lit(1)), F.least(k, F.lit(policy.NUMBER_CONTEXT))), " ")
        cited = before.rlike(cite) & ~before.rlike(no_cite)
        year = b.rlike("\\A(19|20)\\d{2}\\z") & ~F.contains(F.get(words, k), F.lit("$"))
        month = F.coalesce(F.get(bare, k - 1).rlike(policy.MONTH), F.lit(False))
        timed = F.coalesce(F.get(bare, k + 1).rlike(policy.TIME_UNIT), F.lit(False))
        # the cheap test first: most words aren't followed by a unit of time
        return timed & (value.rlike(numeral) | F.array_contains(spelt, value)) & ~year & ~cited & ~month

    # the words are bound to a name, as an element of an array, so that they are made once and not for every word
    made = F.transform(F.array(words_of(text)), lambda w: F.struct(w.alias("words"), F.transform(w, _bare).alias("bare")))
    return F.exists(made, lambda m: F.size(F.filter(m["bare"], lambda b, k: holds(m["words"], m["bare"], b, k))) > 0)


def describe(text: Column, lexicon: policy.Lexicon = policy.LEXICON) -> Column:
    """What a whole paragraph does, in a fixed order: tags for one that is new or dropped."""
    says = lambda p: by_class(F.lower(text), p, lambda t, q: t.rlike(q))
    named = {
        "prohibition": says(lexicon.families["prohibition"]),
        "mandatory direction": says(next(iter(lexicon.force.values()))),
        "reporting requirement": says(lexicon.families["reporting"]),
        "deadline": F.lower(text).rlike(r"day|week|month|year|calendar|business") & has_deadline(text),
        "floor / ceiling": says(lexicon.limit) & F.contains(text, F.lit("$")),
        "eligibility / scope": says(lexicon.families["eligibility"]) & says(r"\beligib|\bonly\b|limited to"),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]))


def safe_url(url: Column) -> Column:
    return F.when(url.rlike("(?i)^https?://"), url).otherwise(F.lit(""))


def anchor(path: Column) -> Column:
    """A page-unique name of a path: 60 characters to read and 6 of a digest."""
    slug = F.array_join(F.transform(path, lambda p: F.replace(F.lower(p), F.lit(" "), F.lit("_"))), "-")
    return F.concat(F.lit("s-"), F.left(slug, F.lit(60)), F.lit("-"), F.left(F.md5(F.array_join(path, " > ")), F.lit(6)))


def thread_name(path: Column) -> Column:
    """A file name for a thread: 90 characters to read and 6 of a digest."""
    slug = F.trim(F.regexp_replace(F.lower(F.array_join(path, " ")), "[^a-z0-9]+", " "))
    return F.concat(F.left(F.replace(slug, F.lit(" "), F.lit("-")), F.lit(90)), F.lit("-"), F.left(F.md5(F.array_join(path, " > ")), F.lit(6)))
