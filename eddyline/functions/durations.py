"""Duration strings (``"10 seconds"``, ``"1 minute"``) → microseconds.

Only needed where a width must be a number on the driver (pane counts,
chunk widths); everywhere else the string goes to Spark as an interval.
"""

from __future__ import annotations

import re

_UNIT_US = {
    "microsecond": 1, "millisecond": 1_000, "second": 1_000_000,
    "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000,
    "week": 604_800_000_000,
}
_PART = re.compile(r"(\d+)\s*([a-z]+?)s?\b")


def duration_us(text: str) -> int:
    """Sum of ``<n> <unit>`` parts; units from microsecond to week."""
    total, found = 0, False
    for n, unit in _PART.findall(text.strip().lower()):
        if unit not in _UNIT_US:
            raise ValueError(f"unsupported duration unit in {text!r}")
        total += int(n) * _UNIT_US[unit]
        found = True
    if not found:
        raise ValueError(f"cannot parse duration {text!r}")
    return total


def shift(ts, text: str, sign: int = 1):
    """``ts ± duration`` on a TIMESTAMP column, exact to the microsecond."""
    from pyspark.sql import functions as F
    return F.timestamp_micros(F.unix_micros(ts) + F.lit(sign * duration_us(text)))
