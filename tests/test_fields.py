"""Text, date, identity and agenda operators against literal fixtures."""

import pyspark.sql.functions as F
import pytest

from landsift.functions import scalars as S
from landsift.operators import agenda, filters, normalize


@pytest.mark.parametrize("text,date", [("2026-03-24T00:00:00", "2026-03-24"), ("1774310400000", "2026-03-24"), ("1774310400", "2026-03-24"), ("some longer text", "some longe"), ("  ", None), (None, None)])
def test_epoch_dates(one, text, date):
    assert one(S.epoch_date(F.lit(text).cast("string"))) == date


@pytest.mark.parametrize("text,date", [("1987-06-24", "1987-06-24"), ("6/24/1987", "1987-06-24"), ("06-24-1987", "1987-06-24"), ("13/45/1987", None), ("June", None), ("", None)])
def test_text_dates(one, text, date):
    assert one(S.text_date(F.lit(text))) == date


@pytest.mark.parametrize("value,problem", [("00", None), ("3-b/7", None), ("  x9 ", None), ("¶¶", None), (None, "missing"), ("", "blank"), ("   ", "blank"), ("inf", "not_finite"), ("x" * 256, "too_long")])
def test_source_ids(one, value, problem):
    assert one(S.source_id_problem(F.lit(value).cast("string"))) == problem


@pytest.mark.parametrize("url,public", [("https://a.b/c?d=e#f", "https://a.b/c"), ("http://a.b", "http://a.b"), ("ftp://a.b/c", None), ("https://u:p@a.b/c", None), ("https://", None), (None, None)])
def test_public_urls(one, url, public):
    assert one(S.public_url(F.lit(url).cast("string"))) == public


def test_hints_hashes_and_ids(one):
    assert one(S.email_hint(F.lit("anna@b.org"))) == "an***@b.org"
    assert one(S.email_hint(F.lit("nobody"))) == "***"
    assert one(S.contact_hash(F.lit(" A@B.org "))) == one(S.contact_hash(F.lit("a@b.org")))
    assert one(S.stable_id("x", F.lit("A b!"), F.lit(None).cast("string"))).startswith("x-a-b-")
    assert one(S.public_id("p", F.lit("k"), F.lit("¶¶"))).startswith("p-record-")
    assert one(S.nesting_depth(F.lit('{"a":"[[[","b":[{}]}'))) == 3


@pytest.mark.parametrize("attempt,seconds", [(0, 5), (1, 10), (9, 2560), (10, 3600), (50, 3600)])
def test_backoff(one, attempt, seconds):
    assert one(S.backoff_seconds(F.lit(attempt))) == seconds


TEXT = """Preface
A. ZONING
1. Zoning
  Preliminary matters
2. HAMPTON COVE AT THE LAKE  (PHASE 2)
   Preliminary and Final   plat ( 24 lots )
   Located: North of the road. I. Waiver: none
   Developer: Good Homes, Engineer: Lines Ltd.
3. NOTHING TO SAY
   A discussion
"""


def test_agenda_items(spark):
    df = spark.createDataFrame([("d", TEXT)], "doc string, text string")
    rows = agenda.items(agenda.blocks(df)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r["title"] == "Hampton Cove at the Lake (phase 2)"
    assert (r["source_status"], r["normalized_status"], r["lot_count"]) == ("Preliminary / Final", "preliminary", 24)
    assert (r["location"], r["developer"], r["engineer"]) == ("North of the road", "Good Homes,", "Lines Ltd")
    assert r["parse_confidence"] == "medium"


def test_links_first_of_each_address(spark):
    html = '<a href="/x/agenda-1.pdf">May <b>agenda</b></a><a class="c" href=\'/x/agenda-1.pdf\'>again</a><a href="/x/minutes.pdf">agenda minutes</a><a name="n">agenda.pdf</a>'
    rows = agenda.wanted_links(agenda.links(spark.createDataFrame([(1, html)], "page_id int, html string"))).collect()
    assert [(r["href"], r["label"]) for r in rows] == [("/x/agenda-1.pdf", "May agenda")]


def test_meeting_date(one):
    assert one(S.meeting_date(F.lit("Agenda March 4, 2025"), F.lit("u"))) == "2025-03-04"
    assert one(S.meeting_date(F.lit("Agenda"), F.lit("/2025/03/agenda.pdf"))) is None


def test_filters(spark):
    df = spark.createDataFrame([("a", "final", "subdivision", "high", [("near_wetland",)]), ("b", "layout", "subdivision", "low", [])], "id string, status string, development_type string, confidence_level string, proximity_flags array<struct<flag_type:string>>")
    ids = lambda **k: [r["id"] for r in filters.filter_records(df, **k).collect()]
    assert ids() == ["a", "b"]
    assert ids(status=["none"]) == []
    assert ids(status=["final"]) == ["a"]
    assert ids(flag=["near_wetland"]) == ["a"]
    with pytest.raises(filters.InvalidFilter):
        ids(status=["none", "final"])
    with pytest.raises(filters.InvalidFilter):
        ids(status=["odd"])
    assert filters.serialise({"status": None, "flag": [], "type": ["a"]}) == [("flag", "none"), ("type", "a")]


def test_normalizers(spark):
    rows = [
        ("city_subdivisions", {"SubdID": "7", "Subdivision": "Oak", "Phase": "2", "Status": "Preliminary", "HousingUnits": "12", "HousingUnitType": "Homes", "Prelim_date": "1774310400000", "x": "y"}, '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}'),
        ("city_permits", {"PermitID": "9", "Permit_Issue_DateTime": "1778198400000"}, '{"type":"Point","coordinates":[1,2]}'),
        ("county_subdivisions", {"Subd_ID": "3", "Subd_Name": "Elm", "DateFiled": "6/24/1987"}, '{"type":"Point","coordinates":[1,2]}'),
        ("county_subdivisions", {"Subd_Name": "None"}, None),
    ]
    df = spark.createDataFrame(rows, "source string, properties map<string,string>, geometry_json string")
    got = {(r["source_key"], r["source_record_id"]): r for r in normalize.normalize_all(df, "2026-05-01T00:00:00Z").collect()}
    a, b, c, d = got["city_subdivisions", "7"], got["city_permits", "9"], got["county_subdivisions", "3"], got["county_subdivisions", None]
    assert (a["title"], a["status"], a["application_date"]) == ("Oak 2", "preliminary", "2026-03-24") and "x" not in a["source_fields"]
    assert (b["title"], b["status"], b["permit_issue_date"]) == ("Building Permit 9", "issued_permit", "2026-05-08")
    assert c["source_status"] == "Filed subdivision (1987-06-24)" and c["validation_errors"] == ["unexpected_type"] and c["confidence_level"] == "medium"
    assert d["problem"] == "missing"
