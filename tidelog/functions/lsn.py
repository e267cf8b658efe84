"""Log sequence numbers and other scalars of the wire format, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds from 1970-01-01 to 2000-01-01, the epoch of wire timestamps.
WIRE_EPOCH_US = 946_684_800_000_000


def format_lsn(n: Column) -> Column:
    """``high/low`` in upper-case hex of a 64-bit position."""
    return F.concat(F.hex(F.shiftrightunsigned(n, 32)), F.lit("/"), F.hex(n.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))))


def parse_lsn(text: Column) -> Column:
    """The 64-bit position of ``high/low``."""
    high, low = (F.conv(F.split(text, "/")[i], 16, 10).cast("decimal(20,0)") for i in (0, 1))
    return (high * F.lit(4294967296).cast("decimal(20,0)") + low).cast("long")


def lsn_diff(later: Column, earlier: Column) -> Column:
    """Bytes of log between two positions."""
    return later - earlier


def pretty_size(n: Column, largest: str = "TB") -> Column:
    """Bytes in the largest unit, up to ``largest``, that keeps at least ten of it, rounded half up."""
    units, out = ("bytes", "kB", "MB", "GB", "TB"), F.concat(n.cast("string"), F.lit(" bytes"))
    for i, unit in enumerate(units[1 : units.index(largest) + 1], 1):
        value = F.floor((n + F.lit(1024**i // 2)) / F.lit(1024**i)).cast("long")
        out = F.when(F.abs(n) >= 10 * 1024**i, F.concat(value.cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def wire_timestamp(us: Column) -> Column:
    """The timestamp of microseconds since 2000-01-01."""
    return F.timestamp_micros(us + F.lit(WIRE_EPOCH_US))


def full_offset(text: Column) -> Column:
    """A two-digit zone offset written out: ``+00`` as ``+00:00``."""
    return F.regexp_replace(text, r"([+-][0-9]{2})$", "$1:00")


def iso_date(day_first: Column) -> Column:
    """A strict DD/MM/YYYY as a date, anything else null."""
    return F.when(day_first.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), F.try_to_date(day_first, "dd/MM/yyyy"))


def text_day(text: Column) -> Column:
    """The day that the first ten characters of a timestamp's text name."""
    return F.substring(text, 1, 10).cast("date")
