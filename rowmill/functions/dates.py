"""Dates as day counts from 1960, interval arithmetic and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowmill.operators.rows import case_chain

EPOCH = "1960-01-01"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def from_days(n) -> Column:
    return F.date_add(F.lit(EPOCH).cast("date"), _c(n).cast("int"))


def to_days(d) -> Column:
    return F.date_diff(_c(d), F.lit(EPOCH).cast("date"))


def _months(d) -> Column:
    return 12 * F.year(_c(d)) + F.month(_c(d)) - 1


def interval_index(unit: str, d, first: int = 1) -> Column:
    """The number of the interval a date lies in; months, quarters and years may begin at month ``first``."""
    m = _months(d) - (first - 1)
    return {
        "hour": F.floor(F.unix_micros(_c(d).cast("timestamp")) / 3_600_000_000),
        "day": to_days(d),
        "week": F.floor((to_days(d) + 5) / 7),  # day 0 was a Friday; weeks begin on Sunday
        "month": m,
        "qtr": F.floor(m / 3),
        "year": F.floor(m / 12),
    }[unit]


def intck(unit: str, a, b, first: int = 1) -> Column:
    """How many interval boundaries lie between two dates."""
    return (interval_index(unit, b, first) - interval_index(unit, a, first)).cast("int")


def intnx(unit: str, d, n, align: str = "B", first: int = 1) -> Column:
    """The date n intervals on, at the interval's begin (B), middle (M), end (E) or the same day (S)."""
    n = F.lit(n) if isinstance(n, int) else n
    if unit in ("day", "week"):
        k = 1 if unit == "day" else 7
        if align == "S" or unit == "day":
            return F.date_add(_c(d), (n * k).cast("int"))
        begin = from_days((interval_index("week", d) + n) * 7 - 5)
        return {"B": begin, "M": F.date_add(begin, 3), "E": F.date_add(begin, 6)}[align]
    size = {"month": 1, "qtr": 3, "year": 12}[unit]
    if align == "S":
        return F.add_months(_c(d), (n * size).cast("int"))
    start = lambda i: F.add_months(F.lit("0000-01-01").cast("date"), (i * size + first - 1).cast("int"))
    i = interval_index(unit, d, first) + n
    begin, end = start(i), F.date_sub(start(i + 1), 1)
    return {"B": begin, "E": end, "M": F.date_add(begin, F.floor(F.date_diff(end, begin) / 2).cast("int"))}[align]


def yrdif(a, b) -> Column:
    return F.date_diff(_c(b), _c(a)) / 365.25


def fiscal_year(d, first: int = 7) -> Column:
    """The calendar year in which the fiscal year ends."""
    return (F.year(_c(d)) + F.when(F.month(_c(d)) >= first, 1 if first > 1 else 0).otherwise(0)).cast("int")


def fiscal_quarter(d, first: int = 7) -> Column:
    return (F.floor(F.pmod(F.month(_c(d)) - first, F.lit(12)) / 3) + 1).cast("int")


def mdy(m, d, y) -> Column:
    """A date from month, day and year; null if there is none."""
    return F.try_make_timestamp(_n(y), _n(m), _n(d), F.lit(0), F.lit(0), F.lit(0)).cast("date")


def _n(x) -> Column:
    return F.lit(x) if isinstance(x, int | float) else _c(x)


def hms(h, m, s) -> Column:
    """Seconds since midnight."""
    return _n(h) * 3600 + _n(m) * 60 + _n(s)


def dhms(d, h, m, s) -> Column:
    """The time so many hours, minutes and seconds after a date's midnight."""
    return F.timestamp_micros((F.unix_micros(_c(d).cast("date").cast("timestamp")) + hms(h, m, s).cast("long") * 1_000_000).cast("long"))


def datepart(ts) -> Column:
    return _c(ts).cast("date")


def timepart(ts) -> Column:
    """Seconds since midnight."""
    return F.hour(_c(ts)) * 3600 + F.minute(_c(ts)) * 60 + F.second(_c(ts))


def weekday(d) -> Column:
    """1 is Sunday."""
    return F.dayofweek(_c(d))


def datdif(a, b) -> Column:
    return F.date_diff(_c(b), _c(a))


def clock(ts) -> dict[str, Column]:
    """Year, quarter, month, day, hour, minute and second of a time."""
    return {"year": F.year(_c(ts)), "qtr": F.quarter(_c(ts)), "month": F.month(_c(ts)), "day": F.day(_c(ts)), "hour": F.hour(_c(ts)), "minute": F.minute(_c(ts)), "second": F.second(_c(ts))}


#: Display format -> Java pattern, shown in capitals.
DATE_FORMATS = {"DATE9": "ddMMMyyyy", "DATE7": "ddMMMyy", "DDMMYY10": "dd/MM/yyyy", "DDMMYY8": "dd/MM/yy", "MMDDYY10": "MM/dd/yyyy", "MMDDYY8": "MM/dd/yy", "YYMMDD10": "yyyy-MM-dd", "YYMMDD8": "yy-MM-dd", "DATETIME20": "ddMMMyyyy:HH:mm:ss", "DATETIME18": "ddMMMyy:HH:mm:ss", "TIME8": "HH:mm:ss", "TIME5": "HH:mm", "MONYY7": "MMMyyyy", "MONYY5": "MMMyy"}


def fmt(x, name: str) -> Column:
    """Display text of a value; full names are looked up first, then the name without its width."""
    x, key = _c(x), name.upper().rstrip(".")
    if key in DATE_FORMATS:
        return F.upper(F.date_format(x, DATE_FORMATS[key]))
    base = key.rstrip("0123456789")
    width = int(key[len(base) :] or 0)
    date = {"MONNAME": lambda: F.date_format(x, "MMMM"), "DOWNAME": lambda: F.date_format(x, "EEEE"), "WEEKDATE": lambda: F.date_format(x, "EEEE, MMMM d, yyyy"), "WEEKDATX": lambda: F.date_format(x, "EEEE, d MMMM yyyy"), "WEEKDAY": lambda: F.dayofweek(x).cast("string"), "DAY": lambda: F.day(x).cast("string"), "MONTH": lambda: F.month(x).cast("string"), "YEAR": lambda: F.year(x).cast("string"), "QTR": lambda: F.quarter(x).cast("string"), "JULDAY": lambda: F.dayofyear(x).cast("string"), "JULIAN": lambda: F.date_format(x, "yyDDD")}
    number = {"COMMA": lambda: F.format_number(x, 2), "DOLLAR": lambda: F.concat(F.when(x < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(x), 2)), "EURO": lambda: F.concat(F.when(x < 0, "-").otherwise(""), F.lit("€"), F.format_number(F.abs(x), 2)), "PERCENT": lambda: F.concat(F.format_number(x * 100, 2), F.lit("%")), "Z": lambda: F.lpad(x.cast("long").cast("string"), width or 1, "0"), "HEX": lambda: F.hex(x.cast("long")), "BINARY": lambda: F.bin(x.cast("long")), "OCTAL": lambda: F.conv(x.cast("string"), 10, 8), "BEST": lambda: x.cast("string"), "$UPCASE": lambda: F.upper(x), "$LOWCASE": lambda: F.lower(x), "$QUOTE": lambda: F.concat(F.lit('"'), x, F.lit('"')), "$CHAR": lambda: x, "$VARYING": lambda: F.rtrim(x)}
    if base not in date | number:
        raise ValueError(f"no display format {name}")
    return (date | number)[base]()


#: Informat -> patterns tried in turn.
INFORMATS = {"DATE9": ["ddMMMyyyy"], "DATE7": ["ddMMMyy"], "MMDDYY10": ["MM/dd/yyyy"], "DDMMYY10": ["dd/MM/yyyy"], "YYMMDD10": ["yyyy-MM-dd"], "YYMMDD8": ["yyyyMMdd"], "E8601DA": ["yyyy-MM-dd"], "IS8601DA": ["yyyy-MM-dd"], "E8601DT": ["yyyy-MM-dd'T'HH:mm:ss"], "DATETIME20": ["ddMMMyyyy:HH:mm:ss"], "MONYY7": ["MMMyyyy"], "ANYDTDTE": ["yyyy-MM-dd", "MM/dd/yyyy", "ddMMMyyyy", "yyyyMMdd"]}


def informat(s, name: str) -> Column:
    """Timestamp (dates: their midnight) read from text; null if it does not fit."""
    t = F.trim(_c(s))
    # month names are read as capital and two small letters
    t = F.regexp_replace(F.initcap(F.regexp_replace(t, r"([A-Za-z]+)", " $1 ")), " ", "")
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(p)) for p in INFORMATS[name.upper().rstrip(".")]))


def days_past_due_bucket(days: Column) -> Column:
    return case_chain([(days <= 0, "CURRENT"), (days <= 30, "1-30"), (days <= 60, "31-60"), (days <= 90, "61-90")], "90+")
