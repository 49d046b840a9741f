import json

from editrail.sources import reports as src


def test_catalog_round_trip_union_and_upsert(spark, tmp_path):
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps([{"package_id": "a", "congress": 118, "chamber": "house", "subcommittee": "X", "fiscal_year": 2024}, {"package_id": "b", "congress": 118, "chamber": "senate", "title": "MAKING law", "subcommittee": "X", "fiscal_year": 2024}]))
    c = src.read_catalog(spark, str(path))
    assert {r["package_id"]: (r["stage"], r["title"], r["from_pdf"]) for r in c.collect()} == {"a": ("committee", "", False), "b": ("committee", "MAKING law", False)}
    assert [r["package_id"] for r in src.usable(c).collect()] == ["a"]
    more = c.where("package_id = 'a'").selectExpr("* EXCEPT (package_id, stage)", "explode(array('a', 'n')) AS package_id", "'reported' AS stage")
    assert {r["package_id"]: r["stage"] for r in src.union_new(c, more).collect()} == {"a": "committee", "b": "committee", "n": "reported"}
    assert {r["package_id"]: r["stage"] for r in src.upsert(c, more).collect()} == {"a": "reported", "b": "committee", "n": "reported"}
    src.write_catalog(c, str(tmp_path / "out"))
    assert src.read_catalog(spark, str(tmp_path / "out"), by_line=True).count() == 2


def test_like_for_like(spark):
    rows = [("a", "h", "pre.pdf", "", False), ("b", "h", "", "u", False), ("c", "h", "", "", False), ("d", "s", "", "", False)]
    df = spark.createDataFrame(rows, "package_id string, chamber string, local_path string, pdf_url string, from_pdf boolean")
    assert sorted((r["package_id"], r["from_pdf"]) for r in src.like_for_like(df, ["chamber"]).collect()) == [("a", False), ("b", True), ("d", False)]


def test_pairs_take_the_latest_earlier_year(spark):
    e = spark.createDataFrame([("h", "x", 2010, "p1"), ("h", "x", 2013, "p2"), ("h", "x", 2014, "p3"), ("s", "x", 2012, "q")], "chamber string, slug string, fy int, package_id string")
    got = {(r["old_package"], r["new_package"], r["year_delta"]) for r in src.pairs(e).collect()}
    assert got == {("p1", "p2", 3), ("p2", "p3", 1)}


def test_stream_keeps_the_latest(spark, tmp_path):
    from editrail.streaming.ingest import changes_per_window, keep_latest, read_entries

    rows = lambda *r: spark.createDataFrame(list(r), "k string, at timestamp, v int")
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    folder = str(tmp_path / "in")
    rows(("a", t, 1), ("b", t, 1)).write.parquet(folder)
    schema = rows().schema
    for n in range(2):
        q = keep_latest(read_entries(spark, folder, schema), "k", "at", str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
        got = {r["k"]: r["v"] for r in spark.read.parquet(str(tmp_path / f"out/gen={n}")).collect()}
        assert got == ({"a": 1, "b": 1} if n == 0 else {"a": 2, "b": 1, "c": 3})
        rows(("a", t + dt.timedelta(1), 2), ("c", t, 3)).write.mode("append").parquet(folder)
    counted = changes_per_window(read_entries(spark, folder, schema, "at"), "at", "1 hour", "k")
    q = counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r["n"] for r in spark.table("counted").collect()) == 6


def test_converted_text():
    from editrail.functions import converted as cv

    known = {"harbor", "co-op", "keeper", "light", "house", "day", "night", "lighthouse"}
    assert cv.join_wrapped(["the har-", "bor and the co-", "op"], known) == "the harbor and the co-op"
    assert cv.join_wrapped(["North-", "South line"], known) == "North-South line"
    assert cv.join_wrapped(["a light-", "house"], known) == "a lighthouse" and cv.join_wrapped(["a gate-", "keeper"], set()) == "a gatekeeper"
    assert cv.join_wrapped(["from day-to-", "night"], known) == "from day-to-night" and cv.join_wrapped(["a non-con-", "fidential"], known) == "a non-con-fidential"
    assert cv.join_wrapped(["a day-", "night run"], known) == "a day-night run"
    assert cv.join_wrapped(["Public Law 95-", "94 holds"], known) == "Public Law 95-94 holds" and cv.join_wrapped(["Lamps.—", "The"], known) == "Lamps.—The"
    assert cv.wrap_heading("SCHOOLS and READING ROOMS of THE OUTER ISLANDS", 25) == ["SCHOOLS and READING", "ROOMS of THE OUTER", "ISLANDS"]
    assert cv.wrap_heading("X" * 80, 25) == ["X" * 80] and cv.wrap_heading("", 25) == []
    assert cv.lower_small_caps([("H", False), ("ARBOR", True)]) == "Harbor" and cv.lower_small_caps([("ALL", True)]) == "ALL" and cv.lower_small_caps([("12 ", False), ("ALL", True)]) == "12 ALL"
    assert cv.to_ascii("“5—6” ∂3 ¥4") == "``5--6'' +3 -4".replace("''", cv.to_ascii("”")) and "&lt;b&gt;" in cv.to_print("<b>")


def part(text, x0, y1, font="Roman", size=10.0, x1=None, page=1, width=600.0, height=800.0):
    x1 = x1 if x1 is not None else x0 + 6.0 * len(text)
    return {"package_id": "p", "page": page, "width": width, "height": height, "x0": float(x0), "y0": y1 - 10.0, "x1": float(x1), "y1": float(y1), "spans": [{"text": text, "font": font, "size": size, "x1": float(x1)}]}


def test_rows_of_a_page():
    from editrail.functions import converted as cv

    parts = [part("1,200", 400, 200.5), part("Weirs........", 100, 200), part("running head", 100, 30), part("17", 50, 220, font="Sans"), part("Next", 100, 220)]
    rows = cv.rows_of_page(parts, 800.0, "Roman")
    assert ["".join(s["text"] for s in r["spans"]) for r in rows] == ["Weirs........ 1,200", "Next"] and rows[0]["x0"] == 100 and rows[0]["size"] == 10.0
    assert cv.layout_row([("Weirs........", 100), ("1,200", 400)], 100, 400) == "Weirs" + "." * 51 + "1,200".rjust(16)
    assert cv.layout_row([("a", 100), ("b", 200)], 100, 400) == "a" + " " * 17 + "b" and cv.layout_row([], 0, 1) == ""


def test_tiers_of_type(spark):
    from editrail.functions import converted as cv

    mid = lambda text, y, **k: part(text, 300 - 3 * len(text), y, **k)
    parts = [mid("body of the text " * 3, 700), mid("WEIRS", 100), mid("AND LOCKS", 111), mid("OFFICE", 200, size=7.8), mid("Rivers", 300, font="Bold"), mid("Mixed Case", 400), mid("12", 500), part("LEFT", 20, 600), mid("FAR BELOW", 160)]
    parts = sorted(parts, key=lambda p: p["y1"])
    assert cv.heading_tiers(parts, "Roman", "Bold") == [("caps", "WEIRS AND LOCKS"), ("caps", "FAR BELOW"), ("sc", "OFFICE"), ("bold", "Rivers")]
    assert cv.heading_tiers([], "Roman", "Bold") == []
    df = spark.createDataFrame(parts, "package_id string, page int, width double, height double, x0 double, y0 double, x1 double, y1 double, spans array<struct<text:string,font:string,size:double,x1:double>>")
    assert [(t["tier"], t["text"]) for t in cv.print_tiers(df, "Roman", "Bold").first()["tiers"]] == cv.heading_tiers(parts, "Roman", "Bold")
    assert tuple(cv.body_face(df).first()) == ("p", "Roman", 10.0)
    assert cv.page_rows(df, "Roman").count() == len(cv.rows_of_page(parts, 800.0, "Roman"))


def test_input_checks(spark):
    from editrail.functions import converted as cv

    rows = [
        ("a", "Gpo-Body", 10.0, "REPORT (  SENATE  ... Rivers  Appropriations Bill, 2026"), ("b", "Gpo-Body", 14.0, "IN THE HOUSE OF REPRESENTATIVES ... September 30, 2025"), ("c", None, None, None),
        ("d", "Arial", 10.0, "x"), ("e", "Gpo-Body", 10.0, "HOUSE REPORT"), ("f", "Gpo-Body", 10.0, "Roads Appropriations Act, 2024"), ("g", "Gpo-Body", 10.0, "Explanatory Statement for the Legislative Branch Appropriations, 2027"),
    ]
    got = {r["id"]: (r["chamber"], r["fy"], r["bill"], r["problem"]) for r in cv.input_problems(spark.createDataFrame(rows, "id string, font string, size double, head string"), ["Gpo"]).collect()}
    assert got["a"] == ("senate", 2026, False, None) and got["b"] == ("house", 2025, True, None) and got["g"] == ("senate", 2027, False, None)
    assert [got[k][3] for k in "cdef"] == ["no text layer", "not the publisher's print", "no fiscal year", "no chamber"]


def test_cached_conversion(spark):
    import pyarrow as pa

    from editrail.functions import converted as cv

    def upper(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.decode().upper() for x in b.column(1).to_pylist()])], names=["key", "text"])

    s = spark.createDataFrame([("a", b"one"), ("b", b"two"), ("c", b"one")], "package_id string, content binary")
    key = s.select(cv.cache_key(s["content"], 3)).first()[0]
    cache = spark.createDataFrame([(key, "from the cache")], "key string, text string")
    texts, fresh = cv.converted(s, cache, upper, 3)
    assert dict(map(tuple, texts.collect())) == {"a": "from the cache", "b": "TWO", "c": "from the cache"} and [r["text"] for r in fresh.collect()] == ["TWO"]


def test_corpus_on_disk(spark, tmp_path):
    import pytest

    root = tmp_path / "corpus"
    (root / "raw/118/house").mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        src.locate_corpus(spark, str(root))
    (root / "catalog.json").write_text(json.dumps([{"package_id": k, "congress": 118, "chamber": "house", "subcommittee": "X", "fiscal_year": 2024} for k in ("a", "b")]))
    (root / "raw/118/house/a.htm").write_bytes(b"<pre>text \xff here</pre>")
    assert src.locate_corpus(spark, str(root)) == str(root)
    c = src.load_catalog(spark, str(root))
    assert c.count() == 2 and src.read_catalog_if_any(spark, str(root / "none.json")).count() == 0
    (root / "prerelease").mkdir()
    (root / "prerelease/catalog.json").write_text(json.dumps([{"package_id": "a", "title": "again"}, {"package_id": "n", "local_path": "prerelease/n.htm"}]))
    (root / "prerelease/n.htm").write_text("new")
    c = src.load_catalog(spark, str(root))
    assert {r["package_id"] for r in c.collect()} == {"a", "b", "n"}
    assert {r["path"] for r in src.report_files(spark, str(root)).collect()} == {"raw/118/house/a.htm", "prerelease/n.htm"}
    assert {r["package_id"] for r in src.with_files(c, src.report_files(spark, str(root))).collect()} == {"a", "n"}
    texts = {r["package_id"]: r["text"] for r in src.read_reports(c, str(root)).collect()}
    assert texts == {"a": "<pre>text \ufffd here</pre>", "b": None, "n": "new"}


def test_requests_and_wanted_pairs(spark):
    import pytest

    assert src.parse_request([])["command"] == "build" and src.parse_request(["all"])["chamber"] is None
    assert src.parse_request(["house", "Rivers", "FY2020-2023"]) == {"command": "build", "chamber": "house", "slug": "rivers", "years": (2020, 2023), "rest": []}
    assert src.parse_request(["senate", "x", "2021"])["years"] == (2021, 2021) and src.parse_request(["dump", "p"])["rest"] == ["p"]
    for bad in (["lords"], ["house", "x", "soon"], ["house", "x", "2023-2020"], ["house", "x", "2020", "y"]):
        with pytest.raises(ValueError):
            src.parse_request(bad)
    e = spark.createDataFrame([("house", "x", y, f"p{y}") for y in (2010, 2013, 2014)] + [("senate", "x", 2013, "q"), ("senate", "x", 2014, "r")], "chamber string, slug string, fy int, package_id string")
    got = {(r["old_fy"], r["new_fy"]) for r in src.wanted_pairs(src.pairs(e), "house", "X", (2013, 2013)).collect()}
    assert got == {(2010, 2013)} and src.wanted_pairs(src.pairs(e)).count() == 3
