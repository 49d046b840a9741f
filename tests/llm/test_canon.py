import random

import pytest

from editrail.llm import canon

ENTRIES = [
    (1, "subcommittee", "Harbors, Canals, and Inland Shipping", ["HCIS"], "x"),
    (2, "subcommittee", "Naval Yards and Coast Watch", ["NYCW"], "x"),
    (3, "subcommittee", "Schools, Apprentices, and Museums", [], "x"),
    (4, "subcommittee", "Mines, Quarries, and Mineral Leasing", None, "x"),
    (10, "heading", "BEACON DREDGING TRUST FUND", ["BDTF"], "x"),
    (11, "heading", "LEVEE DREDGING OPERATIONS", [], "x"),
    (12, "heading", "BEACON MAPPING CONTRIBUTIONS", ["BMC"], "x"),
    *[(20 + k, "heading", f"{w} TRUST FUND", [], "x") for k, w in enumerate(("KILN STORAGE", "MILL LEASING", "FERRY OUTREACH", "ORCHARD TRAINING", "BINDERY REPLACEMENT"))],
]
CASES = {
    "subcommittee": {
        "Harbors, Canals, and Inland Shipping": 1, "harbors canals inland shipping": 1, "HCIS": 1, "H.C.I.S.": 1, "Subcommittee on Harbors, Canals, and Inland Shipping": 1,
        "Harb. Cnls. & Inl. Shppng": 1, "and Inland Shipping Harbors, Canals,": 1, "Harbors, Canals, and InlandoShipping": 1, "navalyardsandcoastwatch": 2, "Naval Yrads and Coats Watch": 2,
        "Nava1 Yards and C0ast Watch FY2021": 2, "Schools, and Museums": 3, "5chools, Apprentices, and Museums *": 3, "Toffee Exhibit Unit": 0, "Naval Falconry Lottery": 0, "misc.": 0, "???": 0,
    },
    "heading": {"BEACON DREDGING TRUST FUND (cont'd)": 10, "BDTF account": 10, "B.M.C.": 12, "TRUST FUND DREDGING": 10, "LEVEE OPERATIONS": 11, "TRUST FUND": 0, "KITE TRUST FUND GAZETTE": 0},
}


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(ENTRIES, "ref_id long, kind string, name string, aliases array<string>, value string")


def test_cases(spark, entries):
    rows = [(k, v, 1) for k, vs in CASES.items() for v in vs] + [("heading", None, 1), ("heading", "  ", 2), ("subcommittee", "HCIS", 3)]
    values = spark.createDataFrame(rows, "kind string, value string, ref_id int")
    got = {(r["kind"], r["value"]): r["ref_id"] for r in canon.map_values(values, entries, canon.NEUTRAL).collect()}
    assert got == {(k, v): n for k, vs in CASES.items() for v, n in vs.items()}


def test_empty_values_and_entries(spark, entries):
    values = spark.createDataFrame([("heading", "LEVEE")], "kind string, value string")
    assert canon.map_values(values.where("false"), entries).count() == 0
    assert [tuple(r) for r in canon.map_values(values, entries.where("false")).collect()] == [("heading", "LEVEE", 0, "none")]


def test_pigeonhole_join_finds_all_within_the_edits(spark):
    """Against all pairs and the definition of the edit distance."""
    rng = random.Random(4)
    ref = ["".join(rng.choice("abcd") for _ in range(rng.randint(3, 24))) for _ in range(25)]
    probe = []
    for _ in range(150):
        s = list(rng.choice(ref))
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(s) + 1)
            s[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "bc"])
        probe.append("".join(s))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    a, b = spark.createDataFrame([(x,) for x in probe], "t string"), spark.createDataFrame([(x,) for x in ref], "form string")
    got = {tuple(r) for r in spark.sql(canon._near("{p}", "t", "{r}", "form", canon.VALUE_EDITS, 7), p=a, r=b).collect()}
    want = {(x, y, d) for x in set(probe) if x for y in set(ref) if (d := distance(x, y)) <= min(7, len(y) // 4)}
    assert got == want


def test_shortened_words(spark):
    """Letters left out after the first: at the end, vowels, and few consonants between others; nothing else."""
    refs = ["management", "causeway", "surveillance", "greenhouse", "account", "operations", "aa", "b"]
    words = ["mgmt", "mngmt", "man", "caswy", "csway", "srvllnc", "surv", "grnhse", "acct", "oprtns", "ops", "nagement", "maneg", "m", "account", "a", "aa", "operationsx"]
    t, w = spark.createDataFrame([(x,) for x in words], "t string"), spark.createDataFrame([(x,) for x in refs], "w string")
    got = {(r["t"], r["s"]) for r in spark.sql(canon._shortened("{t}", "{w}"), t=t, w=w).collect()}
    assert got == {
        ("mgmt", "management"), ("mngmt", "management"), ("man", "management"), ("caswy", "causeway"), ("csway", "causeway"), ("srvllnc", "surveillance"),
        ("surv", "surveillance"), ("grnhse", "greenhouse"), ("acct", "account"), ("oprtns", "operations"),
    }


def test_decorations_are_a_parameter(spark, entries):
    values = spark.createDataFrame([("subcommittee", "ledger bureau HCIS"), ("subcommittee", "HCIS")], "kind string, value string")
    said = lambda **kw: {r["value"]: r["ref_id"] for r in canon.map_values(values, entries, **kw).collect()}
    assert said() == {"ledger bureau HCIS": 0, "HCIS": 1} and said(neutral=("ledger", "bureau")) == {"ledger bureau HCIS": 1, "HCIS": 1}
    assert said(neutral=(), glue=()) == {"ledger bureau HCIS": 0, "HCIS": 1}
