import re
from datetime import datetime

import pytest

from editrail.functions import policy
from editrail.plans import catalogue as cat
from editrail.plans import evaluate as ev

TEXTS = [
    "The office shall report within 30 days.",
    "The café shall not open; it may close.",
    "Sec. 12. None of the funds may be used.",
    "Section ١٢ stays.",
    "Oil.--The office​ must buy oil for $1,200 and\t5 percent more.",
    "The оffice shall\nsubmit it\tby 2024　not later than 60 days, nó more.",
    "Up to $5 only if eligible, section 12 months, \"thirty\" (days) or ninety. calendar days; in May 5 weeks.",
    "limited to 2024 years and 3 months",
    "François\x1cmust\x85wait until 2023é or 2024.",
    "  ",
    "",
]
HEADINGS = ["Café Fund (CF) ", "Lamps 2024 (LMP)\n", "Naïve\tPlan 2023", "Ŕoads ２024"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("texts"))
    at = datetime(2024, 1, 1)
    rows = [(k, "r", "h", k, t, "narrative", None, at) for k, t in enumerate([*TEXTS, None])]
    spark.createDataFrame(rows, "para_id long, package_id string, heading string, para_idx int, text string, kind string, topic string, loaded_at timestamp").write.parquet(f"{d}/paragraphs.parquet")
    spark.createDataFrame(list(enumerate([*HEADINGS, None])), "heading_id long, text string").write.parquet(f"{d}/headings.parquet")
    return d


def test_phrases_of_every_text_are_counted(spark, folder):
    def want(t):
        low = t.lower()
        named = policy.FORCE | policy.FAMILIES | {"limit": policy.LIMIT, "deadline": policy.DEADLINE}
        return {n: len(re.findall(p, re.sub(policy.NO_NEGATION, " ", low) if n == "negation" else low)) for n, p in named.items()}

    got = {r["para_id"]: {k: v for k, v in r.asDict().items() if k != "para_id"} for r in cat.family_counts(spark, folder).collect()}
    assert got == {k: want(t) for k, t in enumerate(TEXTS)}


def test_tags_of_every_text(spark, folder):
    def timed(t):
        p = policy.Passage(t)
        return any(p.kind(k) == "deadline" for k in p.numbers(0, len(p.words)))

    def want(t):
        low = t.lower()
        says = {
            "prohibition": re.search(policy.FAMILIES["prohibition"], low), "mandatory direction": re.search(policy.FORCE["mandatory"], low),
            "reporting requirement": re.search(policy.FAMILIES["reporting"], low), "deadline": timed(t), "floor / ceiling": re.search(policy.LIMIT, low) and "$" in t,
            "eligibility / scope": re.search(policy.FAMILIES["eligibility"], low) and re.search(r"\beligib|\bonly\b|limited to", low),
        }
        return ",".join(n for n, x in says.items() if x)

    tags = {r["para_id"]: r["tags"] for r in cat.describe_tags(spark, folder).collect()}
    assert tags == {k: want(t) for k, t in enumerate(TEXTS)}


def test_words_of_every_text_are_totalled(spark, folder):
    assert [(r["words"], r["n"]) for r in cat.word_totals(spark, folder).collect()] == [(sum(len(t.split()) for t in TEXTS), len(TEXTS))]


def test_kinds_of_every_text(spark, folder):
    def want(t):
        if m := re.search(r"^(?:Section|Sec\.)\s+(\d+[A-Za-z]?)\b", t):
            return "gp_section", f"Section {m[1]}"
        m = re.search(r"^([A-Z][^.]{2,80}?)\.--", t)
        return ("directive", m[1]) if m else ("narrative", None)

    assert {r["para_id"]: (r["kind"], r["topic"]) for r in cat.paragraph_kinds(spark, folder).collect()} == {k: want(t) for k, t in enumerate(TEXTS)}


def test_figures_of_every_text(spark, folder):
    patterns = {"amounts": r"\$[0-9]", "shares": r"\b[0-9]+ percent\b", "spans": r"\b[0-9]+ (?:days|weeks|months)\b", "years": r"\b(?:19|20)[0-9]{2}\b"}
    got = {r["para_id"]: {n: r[n] for n in [*patterns, "dollars"]} for r in ev.figures(spark, folder).collect()}
    assert got == {k: {n: len(re.findall(p, t)) for n, p in patterns.items()} | {"dollars": sum(int(x.replace(",", "")) for x in re.findall(r"\$([0-9][0-9,]*)", t))} for k, t in enumerate(TEXTS)}


def test_every_heading_is_normalised(spark, folder):
    name = lambda h: re.sub(" +", " ", re.sub("[^A-Z0-9 ]+", " ", h.upper())).strip(" ")

    def want(h):
        bare = re.sub(r"\s*\([A-Z][A-Za-z0-9&-]{1,5}\)\s*\Z", "", h).upper()
        return name(re.sub(r"\b(?:19|20)[0-9]{2}\b", "FY", bare)), name(h), re.sub("[^a-z0-9$%]+", " ", h.lower()).strip(" ")

    assert {r["heading_id"]: (r["heading"], r["name"], r["key"]) for r in cat.heading_normalise(spark, folder).collect()} == {k: want(h) for k, h in enumerate(HEADINGS)}
