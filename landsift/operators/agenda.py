"""Agenda text and link parsing: numbered blocks, fields, statuses, and links of a page."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

from landsift.functions import scalars as S

_HEADER = r"^\d+\.\s+[A-Z0-9]"


def blocks(texts: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """key, block (from 1), head, body of the numbered blocks of each text; what stands before the first is left out.

    Lines stay in their document: the window runs over one document's lines.
    """
    lines = texts.select(key, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("pos", "line")).withColumn("line", S.collapse(F.col("line"))).where("line <> ''")
    w = W.partitionBy(key).orderBy("pos")
    numbered = lines.withColumn("block", F.sum(F.col("line").rlike(_HEADER).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).where("block > 0")
    parts = F.array_sort(F.collect_list(F.struct("pos", "line")))
    grouped = numbered.groupBy(key, "block").agg(F.transform(parts, lambda s: s["line"]).alias("lines"))
    head = F.trim(F.regexp_replace(F.element_at("lines", 1), r"^\d+\.\s+", ""))
    return grouped.select(key, F.col("block").cast("int").alias("block"), head.alias("head"), F.array_join(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0))), " ").alias("body"))


def items(found: DataFrame) -> DataFrame:
    """Candidates of the blocks: those that aren't section headers and name a status."""
    body = F.col("body")
    statuses = S.source_statuses(body)
    location = S.labelled_field(body, "Located", ("Developer", "Engineer", "Architect"))
    developer = S.labelled_field(body, "Developer", ("Engineer", "Architect", "Located"))
    engineer = S.labelled_field(body, "Engineer", ("Developer", "Architect", "Located"))
    lots, units = S.counted(body, "lot"), S.counted(body, "unit")
    detail = developer.isNotNull() | engineer.isNotNull() | (F.coalesce(lots, F.lit(0)) > 0) | (F.coalesce(units, F.lit(0)) > 0)
    rows = found.where(~S.is_section_header(F.col("head")) & (F.size(statuses) > 0))
    keys = [c for c in found.columns if c not in ("head", "body")]
    return rows.select(
        *keys, S.title_case(F.col("head")).alias("title"), F.array_join(statuses, " / ").alias("source_status"), S.status_of(statuses).alias("normalized_status"),
        lots.alias("lot_count"), units.alias("unit_count"), developer.alias("developer"), engineer.alias("engineer"), location.alias("location"),
        F.when(location.isNotNull() & detail, "medium").otherwise("low").alias("parse_confidence"),
    )


def description(status: Column, lots: Column, units: Column, location: Column) -> Column:
    counts = F.concat_ws(", ", F.when(lots > 0, F.concat(lots.cast("string"), F.lit(" lots"))), F.when(units > 0, F.concat(units.cast("string"), F.lit(" units"))))
    return F.concat(F.lit("Planning Commission agenda candidate for "), F.lower(status), F.when(counts != "", F.concat(F.lit(" with "), counts)).otherwise(""), F.lit("."), F.coalesce(F.concat(F.lit(" Location text: "), location, F.lit(".")), F.lit("")))


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, pos, href, label of every anchor with an address, in order."""
    anchors = F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>"), F.lit(0))
    rows = pages.select(key, F.posexplode(anchors).alias("pos", "anchor"))
    href = F.regexp_extract("anchor", r"(?is)href\s*=\s*[\"']([^\"']*)[\"']", 1)
    label = S.collapse(F.regexp_replace(F.regexp_replace("anchor", r"(?is)^<a\s[^>]*>|</a>$", ""), r"(?s)<[^>]*>", " "))
    return rows.select(key, "pos", href.alias("href"), label.alias("label")).where("href <> ''")


def wanted_links(found: DataFrame, have: tuple[str, ...] = (".pdf", "agenda"), lack: tuple[str, ...] = ("minutes",), key: str = "page_id") -> DataFrame:
    """Links whose text and address hold all of ``have`` and none of ``lack``; the first of each address on a page."""
    low = F.lower(F.concat_ws(" ", "label", "href"))
    keep = F.lit(True)
    for word in have:
        keep = keep & low.contains(word)
    for word in lack:
        keep = keep & ~low.contains(word)
    return found.where(keep).groupBy(key, "href").agg(F.min("pos").alias("pos"), F.min_by("label", "pos").alias("label"))


def link_title(label: Column, href: Column) -> Column:
    name = F.replace(F.regexp_replace(F.url_decode(F.substring_index(href, "/", -1)), r"\.[^.]*$", ""), F.lit("-"), F.lit(" "))
    return F.when((label != "") & ~F.lower(label).isin("download", "attached file"), label).otherwise(F.coalesce(F.nullif(name, F.lit("")), F.lit("Planning Commission agenda")))
