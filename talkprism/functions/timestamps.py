"""Canonical timestamps and time windows."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkprism.errors import InvalidTimeWindow

#: RFC 3339 in UTC ending in Z; a fraction doesn't end in 0.
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d*[1-9])?Z$"
_FORMAT = "%Y-%m-%dT%H:%M:%S"


def instant(raw: Column) -> Column:
    """The timestamp of a canonical text, else null."""
    return F.when(raw.rlike(CANONICAL), F.try_to_timestamp(raw))


def rfc3339(at: Column) -> Column:
    """The canonical text of a timestamp: in UTC, a fraction without trailing zeros."""
    micros = F.unix_micros(at)
    rest = F.pmod(micros, F.lit(1_000_000))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(micros / 86_400_000_000).cast("int"))
    second = F.floor(F.pmod(micros, F.lit(86_400_000_000)) / 1_000_000)
    clock = F.format_string("%02d:%02d:%02d", F.floor(second / 3600), F.floor(second % 3600 / 60), F.floor(second % 60))
    fraction = F.when(rest > 0, F.concat(F.lit("."), F.rtrim(F.format_string("%06d", rest), F.lit("0")))).otherwise("")
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), clock, fraction, F.lit("Z"))


def parse(text: str) -> dt.datetime:
    try:
        if not text.endswith("Z"):
            raise ValueError(text)
        return dt.datetime.fromisoformat(text[:-1]).replace(tzinfo=dt.timezone.utc)
    except ValueError as e:
        raise InvalidTimeWindow(f"not a canonical timestamp: {text}") from e


@dataclass(frozen=True)
class Since:
    start: str


@dataclass(frozen=True)
class Between:
    start: str
    end: str


@dataclass(frozen=True)
class Recent:
    amount: int
    unit: str  # minutes, hours, days


@dataclass(frozen=True)
class Clock:
    """A fixed reference time, so that one request sees one window."""

    now: dt.datetime

    def lower(self, window):
        """Recent as a range; others checked and unchanged."""
        if isinstance(window, Recent):
            if window.amount <= 0 or window.unit not in ("minutes", "hours", "days"):
                raise InvalidTimeWindow("a recent window needs a positive amount of minutes, hours or days")
            start = self.now - dt.timedelta(**{window.unit: window.amount})
            return Between(start.strftime(_FORMAT) + "Z", self.now.strftime(_FORMAT) + "Z")
        if isinstance(window, Between) and parse(window.start) > parse(window.end):
            raise InvalidTimeWindow("the range is reversed")
        if isinstance(window, Since):
            parse(window.start)
        return window


def within(raw: Column, window) -> Column:
    """Whether a canonical timestamp lies in the window, both ends included; false for null or other texts."""
    if window is None:
        return F.lit(True)
    if isinstance(window, Recent):
        raise InvalidTimeWindow("lower the window first")
    at = instant(raw)
    out = at >= F.lit(parse(window.start))
    if isinstance(window, Between):
        out = out & (at <= F.lit(parse(window.end)))
    return F.coalesce(out, F.lit(False))
