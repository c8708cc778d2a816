"""Time functions of the SQL surface, as Spark SQL text and as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of the units a bucket width may have, and their seconds.
UNITS = {
    "s": 1, "sec": 1, "secs": 1, "second": 1, "seconds": 1,
    "m": 60, "min": 60, "mins": 60, "minute": 60, "minutes": 60,
    "h": 3600, "hr": 3600, "hrs": 3600, "hour": 3600, "hours": 3600,
    "d": 86400, "day": 86400, "days": 86400,
    "w": 604800, "week": 604800, "weeks": 604800,
}

#: Tokens of to_char and the Spark expression of each; $ is the timestamp.
TOKENS = {
    "YYYY": "date_format($,'yyyy')", "YY": "date_format($,'yy')", "Month": "date_format($,'MMMM')", "Mon": "date_format($,'MMM')",
    "MM": "date_format($,'MM')", "DD": "date_format($,'dd')", "Day": "date_format($,'EEEE')", "Dy": "date_format($,'EEE')",
    "DY": "upper(date_format($,'EEE'))", "D": "cast(dayofweek($) as string)", "HH24": "date_format($,'HH')", "HH12": "date_format($,'hh')",
    "HH": "date_format($,'hh')", "MI": "date_format($,'mm')", "SS": "date_format($,'ss')", "US": "date_format($,'SSSSSS')",
    "MS": "date_format($,'SSS')", "TZ": "'UTC'", "AM": "date_format($,'a')", "PM": "date_format($,'a')",
    "am": "lower(date_format($,'a'))", "pm": "lower(date_format($,'a'))",
}
_TOKEN = re.compile("|".join(sorted(TOKENS, key=len, reverse=True)) + r'|"[^"]*"|.', re.DOTALL)


def quote(text: str) -> str:
    """A Spark string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def width_micros(width: str) -> int:
    """Microseconds of a width such as '5 minutes' or '1h'; widths without a fixed length are errors."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]+)\s*", width)
    if not m or m[2].lower() not in UNITS or not int(m[1]):
        raise ValueError(f"time_bucket: unsupported width {width!r}")
    micros = int(m[1]) * UNITS[m[2].lower()] * 1_000_000
    if micros >= 2**63:
        raise ValueError(f"time_bucket: width {width!r} overflows")
    return micros


def time_bucket_sql(width: str, ts: str) -> str:
    """Epoch-aligned start of the bucket; instants before 1970 are cut toward zero."""
    w = width_micros(width)
    return f"timestamp_micros(unix_micros(CAST({ts} AS TIMESTAMP)) DIV {w} * {w})"


def time_bucket(width: str, ts: Column) -> Column:
    w = width_micros(width)
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(micros - F.try_mod(micros, F.lit(w)))


def to_char_sql(ts: str, fmt: str) -> str:
    """Text of a timestamp; unknown characters and "quoted" parts stand for themselves, tokens are case-sensitive."""
    parts: list[str] = []
    plain = ""
    for t in _TOKEN.findall(fmt):
        if t in TOKENS:
            if plain:
                parts.append(quote(plain))
                plain = ""
            parts.append(TOKENS[t].replace("$", f"CAST({ts} AS TIMESTAMP)"))
        else:
            plain += t[1:-1] if len(t) > 1 and t[0] == t[-1] == '"' else t
    if plain or not parts:
        parts.append(quote(plain))
    return f"IF({ts} IS NULL, NULL, concat({', '.join(parts)}))"


def epoch_sql(ts: str) -> str:
    return f"(unix_micros(CAST({ts} AS TIMESTAMP)) / 1e6D)"


#: Fields of EXTRACT whose meaning differs from Spark's; $ is the source.
FIELDS = {
    "epoch": "(unix_micros(CAST($ AS TIMESTAMP)) / 1e6D)", "second": "CAST(extract(SECOND FROM $) AS INT)", "dow": "(dayofweek($) - 1)",
    "isodow": "(weekday($) + 1)", "doy": "dayofyear($)", "millisecond": "CAST(extract(SECOND FROM $) * 1000 AS INT)",
    "microsecond": "CAST(extract(SECOND FROM $) * 1000000 AS BIGINT)",
}


def extract_sql(field: str, ts: str) -> str:
    f = field.strip("'\" ").lower().removesuffix("s") if field.lower().strip("'\" ") != "dows" else "dow"
    return FIELDS[f].replace("$", ts) if f in FIELDS else f"extract({f.upper()} FROM {ts})"
