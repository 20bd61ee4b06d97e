"""ISO instants: several written forms and offsets to one UTC timestamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date, and perhaps hours, minutes, seconds, fraction and offset.
_ISO = (
    r"^\s*(\d{4})-?(\d{2})-?(\d{2})(?:(?:[Tt]|\s+)(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?"
    r"\s*(Z|z|UTC|GMT|[+-]\d{2}(?::?\d{2})?)?)?\s*$"
)


_USUAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:\d{2})$"


def blank_to_null(c: Column) -> Column:
    """Null for values that hold nothing but white space."""
    return F.when(c.rlike(r"(?U)\S"), c)


def parse_instant(c: Column) -> Column:
    """UTC timestamp of an ISO-8601 text, null where it is none.

    Accepted: a date alone (midnight UTC), ``T`` or blanks between date and
    time, with or without seconds and fractions, basic form without
    separators, and ``Z``, ``+hh``, ``+hhmm`` or ``+hh:mm``; none means UTC.
    """
    fields = F.split(F.regexp_replace(c, _ISO, "$1-$2-$3|$4|$5|$6|$7|$8"), r"\|")

    def build(p: Column) -> Column:
        two = lambda x: F.when(x == "", "00").otherwise(x)
        zone = F.when(p[5].rlike("^[+-]"), F.concat(p[5].substr(1, 3), F.lit(":"), two(F.regexp_replace(p[5].substr(4, 3), ":", ""))))
        return F.concat(
            p[0], F.lit("T"), two(p[1]), F.lit(":"), two(p[2]), F.lit(":"), two(p[3]), F.lit("."),
            F.when(p[4] == "", "0").otherwise(p[4].substr(1, 6)), F.coalesce(zone, F.lit("Z")),
        )

    # transform() over one element binds the split text once.
    text = F.transform(F.array(fields), build)[0]
    # The usual form needs none of that.
    return F.when(c.rlike(_USUAL), F.try_to_timestamp(c)).when(c.rlike(_ISO), F.try_to_timestamp(text))


def iso_utc(ts: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ``; fractions are dropped."""
    return F.concat(F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
