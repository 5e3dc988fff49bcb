"""Text, date, identity and digest expressions. All are built-in column functions."""

from __future__ import annotations

import hashlib

import pyspark.sql.functions as F
from pyspark.sql import Column

# Fixed values.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SMALL_WORDS = ("at", "and", "of", "the", "in", "on")
STATUS_WORDS = r"(?i)\b(Boundary Plat|Repreliminary|Relayout|Layout|Preliminary|Final)\b"
SECTION_HEADERS = (
    "zoning",
    "location character and extent",
    "apartments subdivision presented for final",
    "apartments subdivisions presented for final",
    "subdivision name changes",
    "invocation extension of bonds",
)
#: The keys of source fields that may be public.
PUBLIC_FIELDS = (
    "SubdID", "Subdivision", "Phase", "Status", "HousingUnits", "HousingUnitType", "CouncilDistrict", "Layout_date", "Prelim_date", "Final_date",
    "AsBuilt_date", "SubdStatus", "PermitID", "Permit_Issue_DateTime", "OccupancyType", "OccupancySubtype", "TypeOfWork", "NumberOfUnits",
    "ShowDetails", "Subd_ID", "Subd_Name", "Subd_Type", "OBJECTID", "Parcels", "Lots", "Book", "Page", "PlatBook", "PlatPage", "DocNum", "YearFiled",
    "DateFiled", "source_document", "source_document_id", "source_document_title", "id", "title", "document_date", "meeting_label",
    "parse_confidence", "lot_count", "unit_count", "location", "submission_id", "source_url", "review_required",
)
#: What ends a labelled field besides another label.
FIELD_ENDS = r"(?i)\s+(?:I|II|III|IV|V)\.\s+|\s+Waiver\s*:|\s+Requested Rezoning\s*:|\s+Proposed Zoning\s*:"


def clean(value: Column) -> Column:
    """Trimmed text; empty is null."""
    return F.nullif(F.regexp_replace(value.cast("string"), r"^\s+|\s+$", ""), F.lit(""))


def collapse(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def excerpt(value: Column, length: int = 700) -> Column:
    return F.nullif(F.substring(collapse(value), 1, length), F.lit(""))


def subdivision_status(value: Column) -> Column:
    return clean_subdivision_status(clean(value))


def clean_subdivision_status(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.isin("layout", "preliminary", "final"), low).otherwise("proposed")


def epoch_date(value: Column) -> Column:
    """ISO text keeps its first ten characters; a number counts milliseconds above 1e10, else seconds; other text is cut at ten."""
    return clean_epoch_date(clean(value))


def clean_epoch_date(text: Column) -> Column:
    """``epoch_date`` of a text that is clean already. It names the text often, so that had better be a column."""
    number = text.try_cast("double")
    seconds = F.floor(F.when(number > 1e10, number / 1000).otherwise(number)).cast("long")
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10)).when(number.isNotNull(), F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")).otherwise(F.substring(text, 1, 10))


def text_date(value: Column) -> Column:
    """An ISO date, m/d/Y or m-d-Y as ISO text; else null."""
    return clean_text_date(clean(value))


def clean_text_date(text: Column) -> Column:
    """``text_date`` of a text that is clean already. It names the text often, so that had better be a column."""
    us = F.when(text.rlike(r"^\d{1,2}([/-])\d{1,2}\1\d{4}$"), F.replace(text, F.lit("-"), F.lit("/")))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).otherwise(F.date_format(F.try_to_timestamp(us, F.lit("M/d/yyyy")), "yyyy-MM-dd"))


def meeting_date(title: Column, url: Column) -> Column:
    """The date after a month's name in title and address; null where there is none."""
    text = F.concat_ws(" ", title, url)
    pattern = "(?i)(" + "|".join(MONTHS) + r")[-\s]+(\d{1,2})[-,\s]+(\d{4})"
    part = lambda k: F.regexp_extract(text, pattern, k)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(1)))
    return F.when(part(1) != "", F.concat_ws("-", part(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(2), 2, "0")))


def title_case(value: Column) -> Column:
    """Each word capitalised but for small words after the first."""
    words = F.split(collapse(F.lower(value)), " ")
    cap = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*SMALL_WORDS), w).otherwise(cap(w))), " ")


def source_statuses(body: Column) -> Column:
    """Distinct status words in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(STATUS_WORDS), F.lit(1)), title_case))


def status_of(statuses: Column) -> Column:
    """layout before preliminary before final."""
    low = F.transform(statuses, F.lower)
    has = lambda *w: F.arrays_overlap(low, F.array(*map(F.lit, w)))
    return F.when(has("layout", "relayout"), "layout").when(has("preliminary", "repreliminary"), "preliminary").when(has("final"), "final").otherwise("proposed")


def labelled_field(body: Column, label: str, stops: tuple[str, ...]) -> Column:
    """What follows ``label:``, up to the next label or the markers that end a field."""
    after = F.regexp_extract(body, rf"(?is){label}\s*:\s*(.*)$", 1)
    cut = F.split(after, rf"(?i)\s+(?:{'|'.join(stops)})\s*:", 2)[0]
    cut = F.split(cut, FIELD_ENDS, 2)[0]
    return F.nullif(F.regexp_replace(cut, r"^[ .;]+|[ .;]+$", ""), F.lit(""))


def counted(body: Column, noun: str) -> Column:
    """n of ``( n nouns )``"""
    found = F.regexp_extract(body, rf"(?i)\(\s*(\d+)\s+{noun}s?\s*\)", 1)
    return F.nullif(found, F.lit("")).cast("int")


def is_section_header(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), "[^a-z]+", " ")).isin(*SECTION_HEADERS)


def slug(value: Column, length: int | None = 64, default: str = "item") -> Column:
    text = F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    text = F.substring(text, 1, length) if length else text
    return F.when(text == "", default).otherwise(text)


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix-slug-digest over the parts joined by a bar; null is written None."""
    texts = [F.coalesce(p.cast("string"), F.lit("None")) for p in parts]
    digest = F.substring(F.sha2(F.concat_ws("|", *texts), 256), 1, 10)
    return F.when(F.trim(texts[0]) == "", F.concat_ws("-", F.lit(prefix), digest)).otherwise(F.concat_ws("-", F.lit(prefix), slug(texts[0]), digest))


def public_id(prefix: Column | str, source_key: Column, source_id: Column) -> Column:
    """prefix-slug-digest; the digest holds the exact source key and id with a NUL between them."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    digest = F.substring(F.sha2(F.concat(source_key, F.char(F.lit(0)), source_id), 256), 1, 16)
    return F.concat_ws("-", prefix, F.substring(slug(source_id, None, "record"), 1, 48), digest)


def source_id_problem(text: Column, kind: Column | None = None) -> Column:
    """Null for a usable source id, else why it isn't. ``kind`` is the JSON type of the value, where that is known."""
    odd = kind.isin("boolean", "object", "array") if kind is not None else F.lit(False)
    return F.when(text.isNull(), "missing").when(odd, "not_scalar").when(F.lower(text).isin("nan", "inf", "-inf", "infinity", "-infinity"), "not_finite").when(clean(text).isNull(), "blank").when(F.char_length(text) > 255, "too_long")


def contact_hash(value: Column) -> Column:
    return F.when(value != "", F.sha2(F.lower(F.trim(value)), 256))


def email_hint(value: Column) -> Column:
    at = F.locate("@", value)
    domain = F.substr(value, at + 1)
    return F.when((at == 0) | (domain == ""), "***").otherwise(F.concat(F.substr(F.substr(value, F.lit(1), at - 1), F.lit(1), F.lit(2)), F.lit("***@"), domain))


def public_url(value: Column) -> Column:
    """http(s) addresses without query and fragment; null for others and for those with credentials."""
    bare = F.regexp_replace(value, r"[?#].*$", "")
    host = F.regexp_extract(bare, r"^https?://([^/]*)", 1)
    return F.when((F.char_length(value) <= 4096) & (host != "") & ~host.contains("@") & ~host.startswith(":"), bare)


def normalized_email(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), low)


def public_fields(fields: Column) -> Column:
    """Only reviewed keys of a map."""
    return F.map_filter(fields, lambda k, v: k.isin(*PUBLIC_FIELDS))


def fingerprint(*parts: Column) -> Column:
    """sha256 of the parts' texts with a unit separator between them; null is written as NUL."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.char(F.lit(0))) for p in parts]), 256)


def chained_digest(items: Column) -> Column:
    """Fold of sha(previous + item) over an array in its order; empty text for an empty array."""
    return F.aggregate(items, F.lit(""), lambda a, x: F.sha2(F.concat(a, x), 256))


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a text or bytes, in lowercase hex."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def blob_key(sha: Column) -> Column:
    """Where content of this digest is kept."""
    return F.concat_ws("/", F.lit("sha256"), F.substring(sha, 1, 2), F.substring(sha, 3, 2), sha)


def artifact_id(source: Column, kind: Column, path: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", source, kind, path), 256), 1, 24)


def lock_key(text: Column) -> Column:
    """The first eight bytes of a sha256 as a signed 64-bit number."""
    high = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("decimal(20,0)")
    low = F.conv(F.substring(F.sha2(text, 256), 9, 8), 16, 10).cast("decimal(20,0)")
    whole = high * F.lit(4294967296).cast("decimal(20,0)") + low
    return F.when(whole >= F.lit("9223372036854775808").cast("decimal(20,0)"), whole - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(whole).cast("long")


def backoff_seconds(attempts: Column) -> Column:
    """5 * 2^attempts, an hour at most."""
    return F.least(F.lit(3600.0), 5.0 * F.pow(F.lit(2.0), F.least(attempts, F.lit(10)))).cast("long")


def retry_delay(attempt: Column, retry_after: Column) -> Column:
    """What the server asked for, 5 s at most, else 0.25 * 2^attempt."""
    return F.least(F.lit(5.0), F.when(retry_after.isNotNull(), F.greatest(retry_after, F.lit(0.0))).otherwise(0.25 * F.pow(F.lit(2.0), attempt)))


def nesting_depth(text: Column) -> Column:
    """The deepest nesting of brackets outside of strings in a JSON text."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"?', "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, c: Column) -> Column:
        now = a["now"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), ""), start, step, lambda a: a["most"])


def is_retryable(sqlstate: Column) -> Column:
    return sqlstate.rlike("^(08|40|53|54|57|58|72|F0)")


def url_category(path: Column) -> Column:
    return F.when(path.startswith("/api/"), "data").when(path.rlike(r"(?i)tile|basemap|\.pbf$"), "basemap").otherwise("assets")


def acres(area_m2: Column) -> Column:
    return F.format_string("%.1f acres", area_m2 / 4046.8564224)
