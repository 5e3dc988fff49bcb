"""Normalizers clean a text once, however often their columns name it; source features are planned one source at a time."""

import json

from landsift.operators import normalize
from landsift.plans import fields, intake


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_cleaned_once(spark):
    features = spark.createDataFrame([("1", {}, "")], "source string, properties map<string,string>, geometry_json string")
    for source, names in (("city_subdivisions", 8), ("city_permits", 5), ("county_subdivisions", 4)):
        made = plan(normalize.normalize(features, source, "2024-02-01T00:00:00Z").drop("centroid", "area_sq_m"))
        assert made.count("regexp_replace(") <= names + 4 + 6, source  # dates and a status are cleaned as such too; six for the id's check and slug
        assert made.count("get_json_object(") == 2, source


def test_a_query_reads_properties_as_the_normalizers_do(spark, tmp_path):
    """Without ``texts`` before it, a property isn't there to be read."""
    spark.createDataFrame([(k, f"Brand#{k}") for k in range(1, 6)], "p_partkey long, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.p_partkey: r.status for r in intake.property_guard(spark, str(tmp_path)).collect()}
    assert got == {1: None, 2: "Brand#2", 3: None, 4: None, 5: None}


def test_a_source_is_planned_alone(spark):
    o = spark.createDataFrame([(1, "t", "final", "2024-01-03", 1, 2, 3, 4)], "rec_key long, title string, status string, date_discovered string, w long, s long, e long, n long")
    made = plan(fields.source_features(o).where("source = 'city_permits'"))
    assert "PermitID" in made and "SubdID" not in made and "Subd_ID" not in made


def test_sources_are_dealt_as_before(spark):
    rows = [(k, "t", "final", "2024-01-03", 1, 2, 3, 4) for k in (0, 1, 2, -1, -2, -3, None)]
    o = spark.createDataFrame(rows, "rec_key long, title string, status string, date_discovered string, w long, s long, e long, n long")
    got = {r.rec_key: r.source for r in fields.source_features(o).collect()}
    city, permit, county = "city_subdivisions", "city_permits", "county_subdivisions"
    assert got == {0: city, 1: permit, 2: county, -1: county, -2: county, -3: city, None: county}


def test_odd_texts_and_geometries(spark):
    point, ring = (json.dumps({"type": t, "coordinates": c}) for t, c in (("Point", [1, 2]), ("Polygon", [[[1, 2], [3, 4], [3, 1], [1, 2]]])))
    rows = [
        ("city_permits", {"PermitID": " 7 ", "Permit_Issue_DateTime": " 1700000000 ", "Subdivision": " "}, point),
        ("city_permits", {"PermitID": "8", "Permit_Issue_DateTime": "2024-01-02T03", "TypeOfWork": " New "}, ring),
        ("county_subdivisions", {"Subd_ID": "9", "DateFiled": " 1/2/2024 "}, ring),
        ("county_subdivisions", None, '{"type":"Polygon","coordinates":null}'),
        ("city_subdivisions", {"SubdID": "3", "Status": " Final ", "HousingUnits": "0", "HousingUnitType": "Homes"}, ""),
    ]
    f = spark.createDataFrame(rows, "source string, properties map<string,string>, geometry_json string")
    out = normalize.normalize_all(f, "2024-02-01T00:00:00Z")
    got = {r.source_record_id: r for r in out.select("source_record_id", "title", "status", "source_status", "permit_issue_date", "approval_date", "validation_errors", "confidence_level").collect()}
    assert tuple(got[" 7 "])[1:] == ("Building Permit 7", "issued_permit", "Issued", "2023-11-14", None, [], "high")
    assert tuple(got["8"])[1:] == ("New", "issued_permit", "Issued", "2024-01-02", None, ["unexpected_type"], "medium")
    assert tuple(got["9"])[1:] == ("Unnamed subdivision", "completed", "Filed subdivision (2024-01-02)", None, "2024-01-02", [], "high")
    assert tuple(got[None])[1:] == ("Unnamed subdivision", "completed", "Recorded subdivision", None, None, ["no_coordinates"], "medium")
    said = {r.source_record_id: r.description for r in normalize.normalize(spark.createDataFrame([({"SubdID": "1"}, ""), ({"SubdID": "2", "Status": "Final"}, "")], "properties map<string,string>, geometry_json string"), "city_subdivisions", "2024").select("source_record_id", "description").collect()}
    assert said == {"1": "source subdivision record from the city's subdivision layer.", "2": "Final subdivision record from the city's subdivision layer."}
    assert tuple(got["3"])[1:] == ("Unnamed subdivision", "final", "Final", None, None, ["unexpected_type"], "medium")
