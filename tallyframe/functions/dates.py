"""Date helpers: season labels and month keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: seasons start in August ("2025-26" runs August 2025 - July 2026).
SEASON_START_MONTH = 8


def season_label(ts) -> Column:
    """'YYYY-YY' season of a date/timestamp with the August cut-over."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    start = F.when(F.month(ts) >= SEASON_START_MONTH, F.year(ts)).otherwise(F.year(ts) - 1)
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def month_key(ts) -> Column:
    """'YYYY-MM' month key (timestamps are taken in the session time zone,
    UTC by the library's defaults)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(ts, "yyyy-MM")


# Zone names of mail dates and their offsets from UTC.
ZONE_OFFSETS = {
    "UT": "+0000", "GMT": "+0000", "UTC": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600",
    "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}
# Layouts tried in this order, on text that ends with a numeric offset.
DATE_LAYOUTS = (
    ("mail", "d MMM yyyy HH:mm:ss Z"), ("mail", "d MMM yy HH:mm:ss Z"), ("mail", "d MMM yyyy HH:mm Z"),
    ("mail", "d MMM yy HH:mm Z"),
    ("iso", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]Z"), ("iso", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]Z"),
    ("iso", "yyyy-MM-dd'T'HH:mmZ"), ("date", "yyyy-MM-ddZ"), ("date", "d MMM yyyy Z"),
)


def published_at(text):
    """A publication date of any feed layout as a struct ``layout``, ``date``
    (in UTC): mail dates (weekday and seconds optional, zone as a name or an
    offset), ISO 8601 with or without offset, plain dates.  Without a zone the
    text is taken as UTC.  Both fields are null for unreadable text.
    """
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    t = F.regexp_replace(t, r"^[A-Za-z]{3,9}, ?", "")
    zone = F.upper(F.regexp_extract(t, r"(?:[0-9]| )([A-Za-z]{1,3})$", 1))
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in ZONE_OFFSETS.items() for x in kv]),
                          F.nullif(zone, F.lit("")))
    named = F.regexp_replace(t, r" ?[A-Za-z]{1,3}$", "")
    numeric = t.rlike(r"[0-9]( ?[+-][0-9]{2}:?[0-9]{2})$") & t.rlike(":")
    plain = F.regexp_replace(t, r" ?([+-][0-9]{2}):?([0-9]{2})$", "$1$2")
    body = (F.when(numeric, plain).when(offset.isNotNull(), F.concat(named, offset))
            .when(zone == "", F.concat(t, F.lit("+0000"))))
    mail = body.rlike("^[0-9]{1,2} [A-Za-z]")
    spaced = F.regexp_replace(body, r"([+-][0-9]{4})$", " $1")
    read = [F.when((mail if name == "mail" or "MMM" in form else ~mail),
                   F.try_to_timestamp(spaced if "MMM" in form else body, F.lit(form)))
            for name, form in DATE_LAYOUTS]
    days = [F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds(x) / 86400).cast("int")) for x in read]
    layout = F.coalesce(*[F.when(x.isNotNull(), F.lit(name)) for x, (name, _) in zip(read, DATE_LAYOUTS)])
    return F.struct(layout.alias("layout"), F.coalesce(*days).alias("date"))
