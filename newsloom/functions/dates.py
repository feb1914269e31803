"""Dates: feed formats, Brazilian day-first dates, and dates for messages. Sessions keep their time zone at UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Sao_Paulo"
#: Month names of the message format.
MONTHS = "jan. fev. mar. abr. mai. jun. jul. ago. set. out. nov. dez.".split()
UNKNOWN = "data não informada"


def instant(text: Column) -> Column:
    """RFC 822 or ISO text as a timestamp; null where it is neither."""
    bare = F.trim(F.regexp_replace(text, r"^\s*[A-Za-z]{3},\s*", ""))
    zone = F.regexp_replace(F.regexp_replace(bare, r"\b(UT|GMT|Z)$", "+0000"), r"([+-]\d{2}):(\d{2})$", "$1$2")
    out = [F.try_to_timestamp(zone, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yy HH:mm:ss Z")]
    return F.coalesce(*out, text.try_cast("timestamp"))


def day_first(text: Column) -> Column:
    """The first d/m/yyyy of a text, at noon three hours behind UTC."""
    m = r"(?<![0-9A-Za-z_])(\d{1,2})/(\d{1,2})/(\d{4})(?![0-9A-Za-z_])"
    day, month, year = (F.regexp_extract(text, m, i).try_cast("int") for i in (1, 2, 3))
    return F.try_make_timestamp(year, month, day, F.lit(12), F.lit(0), F.lit(0), F.lit("-03:00"))


def noon(day: Column) -> Column:
    """yyyy-MM-dd text at noon three hours behind UTC."""
    return F.concat(day, F.lit("T12:00:00-03:00")).try_cast("timestamp")


def iso_day(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def local_day(at: Column, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def spelled(at: Column, zone: str = ZONE) -> Column:
    """Like "14 ago. 2026"."""
    here = F.from_utc_timestamp(at, zone)
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(here))
    return F.when(at.isNull(), UNKNOWN).otherwise(F.concat_ws(" ", F.date_format(here, "dd"), month, F.date_format(here, "yyyy")))
