"""Normalizers: source features (properties map, GeoJSON text) to records, one select a source."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from landsift.functions import geometry as G
from landsift.functions import scalars as S

#: source -> (id property, public id prefix, development type, geometry types)
SOURCES = {
    "city_subdivisions": ("SubdID", "city-subdivision", "subdivision", ("Polygon", "MultiPolygon")),
    "city_permits": ("PermitID", "city-permit", "building_permit", ("Point",)),
    "county_subdivisions": ("Subd_ID", "county-subdivision", "subdivision", ("Polygon", "MultiPolygon")),
}
#: What identifies a feature of a context layer, in order of preference.
FEATURE_IDS = ("OBJECTID", "ObjectId", "FID", "WETLAND_ID")


def prop(name: str) -> Column:
    """A property as clean text, after ``texts``."""
    return F.col(f"{name}__")


def texts(features: DataFrame, *names: str) -> DataFrame:
    """Properties as columns of clean text; features without properties have none.

    Each step of a normalizer is a select of its own: a text that is named in several places is then cleaned once, not in each.
    """
    known = F.coalesce("properties", F.create_map().cast("map<string,string>"))
    return features.withColumns({f"{n}__": S.clean(F.element_at(known, n)) for n in names})


def feature_id() -> Column:
    return F.coalesce(*[F.element_at("properties", n) for n in FEATURE_IDS])


def city_subdivision(features: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    dates = ("Layout_date", "Prelim_date", "Final_date")
    f = texts(features, "Subdivision", "Phase", "Status", "HousingUnits", "HousingUnitType", *dates)
    f = f.withColumn("stated__", F.coalesce(prop("Status"), F.lit("Unknown")))
    f = f.withColumns({"stage__": S.clean(F.col("stated__"))} | {f"{d}__": S.clean(prop(d)) for d in dates})
    name, status = F.coalesce(prop("Subdivision"), F.lit("Unnamed subdivision")), F.col("stated__")
    units, kind = prop("HousingUnits"), F.lower(prop("HousingUnitType"))
    said = F.coalesce(prop("Status"), F.lit("source"))
    with_units = F.concat(said, F.lit(" subdivision record with "), units, F.lit(" "), kind, F.lit("."))
    return f, {
        "title": F.concat_ws(" ", name, prop("Phase")),
        "description": F.when(units.isNotNull() & (units != "0") & kind.isNotNull(), with_units).otherwise(F.concat(said, F.lit(" subdivision record from the city's subdivision layer."))),
        "source_status": status,
        "status": S.clean_subdivision_status(F.col("stage__")),
        "application_date": F.coalesce(S.clean_epoch_date(prop("Layout_date")), S.clean_epoch_date(prop("Prelim_date"))),
        "approval_date": S.clean_epoch_date(prop("Final_date")),
        "permit_issue_date": F.lit(None).cast("string"),
    }


def city_permit(features: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    none, issued = F.lit(None).cast("string"), "Permit_Issue_DateTime"
    f = texts(features, "Subdivision", "OccupancyType", "TypeOfWork", "PermitID", issued)
    f = f.withColumns({"named__": F.concat_ws(" / ", prop("Subdivision"), prop("OccupancyType"), prop("TypeOfWork")), f"{issued}__": S.clean(prop(issued))})
    named = F.col("named__")
    return f, {
        "title": F.when(named != "", named).otherwise(F.concat(F.lit("Building Permit "), prop("PermitID"))),
        "description": F.lit("Issued building permit; its point isn't a parcel."),
        "source_status": F.lit("Issued"),
        "status": F.lit("issued_permit"),
        "application_date": none,
        "approval_date": none,
        "permit_issue_date": S.clean_epoch_date(prop(issued)),
    }


def county_subdivision(features: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    f = texts(features, "DateFiled", "YearFiled", "Parcels", "Subd_Name").withColumn("DateFiled__", S.clean(prop("DateFiled")))
    f = f.withColumn("filed_on__", S.clean_text_date(prop("DateFiled"))).withColumn("filed__", F.coalesce("filed_on__", prop("YearFiled")))
    filed, parcels = F.col("filed__"), prop("Parcels")
    none = F.lit(None).cast("string")
    return f, {
        "title": F.coalesce(prop("Subd_Name"), F.lit("Unnamed subdivision")),
        "description": F.concat_ws(" ", F.lit("Recorded county subdivision polygon."), F.concat(F.lit("Source parcel count: "), parcels, F.lit(".")), F.concat(F.lit("Filed: "), filed, F.lit("."))),
        "source_status": F.coalesce(F.concat(F.lit("Filed subdivision ("), filed, F.lit(")")), F.lit("Recorded subdivision")),
        "status": F.lit("completed"),
        "application_date": none,
        "approval_date": F.col("filed_on__"),
        "permit_issue_date": none,
    }


NORMALIZERS = {"city_subdivisions": city_subdivision, "city_permits": city_permit, "county_subdivisions": county_subdivision}


def normalize(features: DataFrame, source: str, checked_at: str) -> DataFrame:
    """Records of one source; problem says why a feature has no usable identity, validation_errors what is wrong with its geometry."""
    id_name, prefix, kind, types = SOURCES[source]
    f, made = NORMALIZERS[source](features.withColumn("raw__", F.element_at("properties", id_name)))
    f = f.withColumns({"kind__": F.get_json_object("geometry_json", "$.type"), "body__": F.get_json_object("geometry_json", "$.coordinates")})
    f = f.withColumn("geom", G.from_geojson_parts(F.col("kind__"), F.col("body__")))
    raw, geom, known = F.col("raw__"), F.col("geom"), F.coalesce(F.col("kind__").isin(*types), F.lit(False))
    f = f.withColumn("wrong__", F.when(~known, "unexpected_type").when(~G.has_positions(geom), "no_coordinates"))
    wrong = F.col("wrong__")
    return f.select(
        F.lit(source).alias("source_key"), raw.alias("source_record_id"), S.source_id_problem(raw).alias("problem"),
        S.public_id(prefix, F.lit(source), raw).alias("public_id"), F.lit(kind).alias("development_type"), *[v.alias(k) for k, v in made.items()],
        F.lit(checked_at[:10]).alias("date_discovered"), F.when(wrong.isNull(), "high").otherwise("medium").alias("confidence_level"),
        F.array_compact(F.array(wrong)).alias("validation_errors"), S.public_fields(F.col("properties")).alias("source_fields"),
        geom, G.vertex_mean(geom).alias("centroid"), G.area_m2(geom).alias("area_sq_m"), "geometry_json",
    )


def normalize_all(features: DataFrame, checked_at: str) -> DataFrame:
    """Features with a source column, each by its source's normalizer."""
    parts = [normalize(features.where(F.col("source") == s), s, checked_at) for s in SOURCES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def to_geojson_feature(df: DataFrame) -> DataFrame:
    """A GeoJSON feature a row: id, geometry, and all other scalar columns as properties."""
    rest = [f.name for f in df.schema if f.name not in ("public_id", "geom", "geometry_json", "box")]
    return df.select("public_id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("public_id").alias("id"), F.struct(*rest).alias("properties"))).alias("feature"), "geometry_json")
