import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from meetlake.operators import documents as DC
from meetlake.operators import pages as PG
from meetlake.operators import service as S


def test_bridge_matches_missing_dates_and_refuses_doubt(results):
    canonical = results(dict(resolved_athlete_id="R1"), dict(resolved_athlete_id="R2", date_of_birth="01-01-1990"))
    rows = results(dict(resolved_athlete_id="stale"), dict(date_of_birth="01-01-1990"))
    assert [r["resolved_athlete_id"] for r in S.attach_identity(rows, canonical).orderBy("seq").collect()] == ["R1", "R2"]
    with pytest.raises(PySparkException):
        S.attach_identity(results(dict(year=1999)), canonical).collect()
    doubtful = results(dict(resolved_athlete_id="R1"), dict(resolved_athlete_id="R2"))
    assert S.ambiguous_keys(doubtful).count() == 1
    with pytest.raises(PySparkException):
        S.attach_identity(rows, doubtful).collect()
    assert S.bridge_unmatched(results({}, dict(year=1999)), canonical).collect()[0]["year"] == 1999


def test_lookups(spark, results):
    table = results(dict(athlete_id="old1", resolved_athlete_id="R1", year=2018), dict(athlete_id="old1", resolved_athlete_id="R1"),
                    dict(athlete_id="old2", resolved_athlete_id="R2"), dict(athlete_id="old2", resolved_athlete_id="R3"))
    asked = spark.createDataFrame([("R1",), (" old1 ",), ("old2",), ("nobody",), (" ",)], "requested_id string")
    got = {r["requested_id"]: (r["outcome"], r["athlete"]) for r in S.resolve_ids(asked, table).collect()}
    assert got == {"R1": ("CURRENT", "R1"), "old1": ("ALIAS", "R1"), "old2": ("AMBIGUOUS", None), "nobody": ("UNKNOWN", None), "": ("EMPTY", None)}
    assert S.find_athletes(table).where("athlete = 'R1'").first()["competition_count"] == 2
    assert S.latest_record(table).where("resolved_athlete_id = 'R1'").first()["year"] == 2020
    assert S.history(table, ["R1"], before_year=2020).count() == 1
    assert [r["year"] for r in S.ordered_history(S.history(table, ["R1"])).collect()] == [2018, 2020]
    with pytest.raises(ValueError):
        S.history(table, limit=0)
    with pytest.raises(ValueError):
        S.in_list_order(table, limit=0)


def test_filters_reach_the_scan(spark, results, tmp_path):
    results({}, dict(year=2019)).write.parquet(str(tmp_path / "r"))
    plan = S.competition_results(spark.read.parquet(str(tmp_path / "r")), year=2019)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(year,2019)" in plan


def test_coercion(spark):
    raw = spark.createDataFrame([(" x ", "12.5", "2020.0", "bad")], "team string, bodyweight string, year string, total string")
    got = S.coerce_numbers(S.trim_texts(raw)).first()
    assert (got["team"], got["bodyweight"], got["year"], got["total"]) == ("x", 12.5, 2020, None)
    classes = spark.createDataFrame([("120+",), (" 66 ",), ("66.0",), (None,)], "weight_class string")
    assert [r[0] for r in S.coerce_numbers(classes).select("weight_class").collect()] == ["120+", "66", "66", None]
    with pytest.raises(ValueError, match="missing columns"):
        S.application_table(raw)


def test_content_class(spark):
    text = "Open - 59kg Place Name Squat Bench Deadlift Total"
    df = spark.createDataFrame([(text,), (text + " women",), ("squat only",), ("nothing",), (None,)], "text string")
    assert [r["content_status"] for r in DC.content_class(df).collect()] == ["VALID", "REVIEW", "REVIEW", "REJECT", "ERROR"]


def test_format_profile_masks_digits_first(spark):
    header = "Place Name DOB Total sq1 sq2\n"
    df = spark.createDataFrame([(1, header + "1 A 10"), (2, header.replace("sq1", "sq9") + "x\n"), (3, "sq1 sq2 sq3 bp1 bp2"), (4, "")], "id int, text string")
    got = {r["id"]: r for r in DC.format_profile(df).collect()}
    assert got[1]["header_lines"] == 1 and got[3]["header_lines"] == 0
    assert (got[1]["lines"], got[2]["lines"], got[4]["lines"]) == (2, 2, 0)
    assert len(got[1]["format_signature"]) == 12
    groups = DC.format_groups(DC.format_profile(df), "id").collect()
    assert sum(g["file_count"] for g in groups) == 4


def test_file_facts(spark):
    df = spark.createDataFrame([("a", bytearray(b"%PDF-1.4")), ("b", bytearray(b"<html>"))], "file string, content binary")
    got = DC.file_facts(df).orderBy("file").collect()
    assert [(r["size_bytes"], r["file_status"]) for r in got] == [(8, "VALID"), (6, "INVALID")]


BASE = "https://archive.example"


def test_year_links_and_urls(spark):
    html = """<a href='/y/2019'><b>2019</b></a> <A class=x HREF="y/2018"> 2018 </A> <a href="//other.example/2017">2017</a>
      <a href="https://x.example/1">twenty</a> <a href=/y/2019>2020</a> <a name="2016">2016</a>"""
    got = {(r["url"], r["label"]) for r in PG.labelled_links(spark.createDataFrame([(1, html)], "page_id int, html string"), BASE).collect()}
    assert got == {(BASE + "/y/2019", "2020"), (BASE + "/y/2018", "2018"), ("https://other.example/2017", "2017")}
    from urllib.parse import urljoin
    for href in ("/a", "b", "../c", "./d/e", "?q=1", "#f", "", "mailto:x@y", "//h/p", "http://h/p"):
        mine = spark.range(1).select(PG.absolute_url(BASE, F.lit(href))).first()[0]
        assert mine == urljoin(BASE, href), href


def test_competition_blocks(spark):
    deep = "<div>" * 7 + "<p>Deep Powerlifting Cup</p>" + "</div>" * 7
    html = f"""<div><h2>State Powerlifting Cup</h2><ul><li><a href="/w.pdf">Women</a></li><li><a href="/m.pdf"> <i>Men</i> </a></li>
      <li><a href="/m2.pdf">Men</a></li></ul></div>
      <div><p>Bench Press Powerlifting Cup</p><a href="/b.pdf">Men</a></div>
      <section><br><p>Club Powerlifting Cup<p>no close<a href="c.pdf">MEN</a></section>{deep}"""
    got = {(r["competition"], r["men_url"]) for r in PG.competition_blocks(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string"), BASE).collect()}
    assert got == {("State Powerlifting Cup", BASE + "/m.pdf"), ("Club Powerlifting Cup", BASE + "/c.pdf")}
    links = spark.createDataFrame([(1, "u", "2019")], "page_id int, url string, label string")
    blocks = spark.createDataFrame([(1, "Cup", "m")], "page_id int, competition string, men_url string")
    pages = spark.createDataFrame([(1, "v"), (2, "u"), (3, "w")], "page_id int, url string")
    blocks = blocks.unionByName(blocks.selectExpr("2 AS page_id", "'Open' AS competition", "'o' AS men_url"))
    assert [tuple(r) for r in PG.source_rows(links, pages, blocks).collect()] == [("2019", "Open", "o", "NEEDS_VERIFICATION")]
