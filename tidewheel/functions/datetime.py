"""Date and time functions.  TIME values are signed microseconds (long), since they reach beyond a day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import alias_native, fn, python

MAX_TIME = (838 * 3600 + 59 * 60 + 59) * 1_000_000

alias_native(
    {n: (n, 1, 1) for n in ("dayofweek", "dayofyear", "hour", "last_day", "minute", "month", "quarter", "second", "weekday", "weekofyear", "year")}
    | {"day": ("day", 1, 1), "dayofmonth": ("day", 1, 1), "datediff": ("datediff", 2, 2), "curdate": ("current_date", 0, 0), "current_date": ("current_date", 0, 0), "utc_date": ("current_date", 0, 0)}
)

# Date format specifiers and their Spark patterns; None: composed apart.
SPECIFIERS = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%c": "M", "%M": "MMMM", "%b": "MMM", "%d": "dd", "%e": "d", "%H": "HH", "%k": "H", "%h": "hh", "%I": "hh", "%l": "h",
    "%i": "mm", "%s": "ss", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%W": "EEEE", "%a": "EEE", "%j": "DDD", "%T": "HH:mm:ss", "%r": "hh:mm:ss a",
    "%D": None, "%w": None, "%U": None, "%u": None, "%V": None, "%v": None, "%X": None, "%x": None,
}


def ts(x: Column) -> Column:
    return x.try_cast("timestamp_ntz")


def _now(*fsp):
    return F.date_trunc("second", F.localtimestamp()) if not fsp else F.localtimestamp()


for _n in ("now", "current_timestamp", "localtime", "localtimestamp", "sysdate"):
    fn(_n, least=0, most=1)(_now)


@fn("utc_timestamp", least=0, most=1)
def utc_timestamp(*fsp):
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")


@fn("date")
def date(x):
    return x.try_cast("date")


@fn("timestamp", "datetime", least=1, most=2)
def timestamp(x, time=None):
    return ts(x) if time is None else ts(x) + micros(time_of(time))


def micros(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n / 1_000_000).cast("decimal(18,6)"))


# Units of intervals as make_interval's argument places and factors.
UNITS = {"YEAR": (0, 1), "QUARTER": (1, 3), "MONTH": (1, 1), "WEEK": (3, 7), "DAY": (3, 1), "HOUR": (4, 1), "MINUTE": (5, 1), "SECOND": (6, 1), "MICROSECOND": (6, 1e-6)}
COMPOSITE = {
    "SECOND_MICROSECOND": ("SECOND", "MICROSECOND"), "MINUTE_MICROSECOND": ("MINUTE", "SECOND", "MICROSECOND"), "MINUTE_SECOND": ("MINUTE", "SECOND"),
    "HOUR_MICROSECOND": ("HOUR", "MINUTE", "SECOND", "MICROSECOND"), "HOUR_SECOND": ("HOUR", "MINUTE", "SECOND"), "HOUR_MINUTE": ("HOUR", "MINUTE"),
    "DAY_MICROSECOND": ("DAY", "HOUR", "MINUTE", "SECOND", "MICROSECOND"), "DAY_SECOND": ("DAY", "HOUR", "MINUTE", "SECOND"), "DAY_MINUTE": ("DAY", "HOUR", "MINUTE"),
    "DAY_HOUR": ("DAY", "HOUR"), "YEAR_MONTH": ("YEAR", "MONTH"),
}


def interval(n: Column, unit: str, sign: int = 1) -> Column:
    """INTERVAL n unit; composite units take text such as '1:30'."""
    unit = unit.upper()
    args = [F.lit(0)] * 6 + [F.lit(0).cast("decimal(18,6)")]
    if unit in COMPOSITE:
        names = COMPOSITE[unit]
        minus = F.when(F.startswith(F.trim(n.cast("string")), F.lit("-")), -1).otherwise(1)
        found = F.regexp_extract_all(n.cast("string"), F.lit(r"\d+"), F.lit(0))
        for i, name in enumerate(reversed(names)):
            v = F.coalesce(F.try_element_at(found, F.lit(-1 - i)).cast("long"), F.lit(0)) * minus * sign
            at, k = UNITS[name]
            args[at] = args[at] + (v * k).cast("decimal(18,6)" if at == 6 else "int")
    else:
        at, k = UNITS[unit]
        args[at] = (n.cast("decimal(18,6)") * F.lit(k).cast("decimal(10,6)") * sign).cast("decimal(18,6)") if at == 6 else (n.cast("double") * k * sign).cast("int")
    return F.make_interval(*args)


def add(d: Column, n: Column, unit: str, sign: int = 1) -> Column:
    """Date arithmetic: months clamp to the month's end; a date stays one unless the unit is of time."""
    moved = ts(d) + interval(n, unit, sign)
    timed = unit.upper().split("_")[-1] in ("HOUR", "MINUTE", "SECOND", "MICROSECOND")
    return moved if timed else F.when(F.typeof(d) == "date", moved.cast("date").cast("timestamp_ntz")).otherwise(moved)


@fn("date_add", "adddate", least=2, most=3)
def date_add(d, n, unit=None):
    return F.date_add(d.try_cast("date"), n.cast("int")) if unit is None else add(d, n, _plain(unit))


@fn("date_sub", "subdate", least=2, most=3)
def date_sub(d, n, unit=None):
    return F.date_sub(d.try_cast("date"), n.cast("int")) if unit is None else add(d, n, _plain(unit), -1)


def _plain(c: Column) -> str:
    s = c._jc.toString() if hasattr(c, "_jc") else str(c)
    return s[1:-1] if len(s) > 1 and s[0] == s[-1] == "'" else s


@fn("timestampadd", least=3)
def timestampadd(unit, n, d):
    return add(d, n, _plain(unit))


@fn("timestampdiff", least=3)
def timestampdiff(unit, a, b):
    u, a, b = _plain(unit).upper(), ts(a), ts(b)
    us = F.unix_micros(b.cast("timestamp_ltz")) - F.unix_micros(a.cast("timestamp_ltz"))
    size = {"MICROSECOND": 1, "SECOND": 10**6, "MINUTE": 60 * 10**6, "HOUR": 3600 * 10**6, "DAY": 86400 * 10**6, "WEEK": 7 * 86400 * 10**6}
    if u in size:
        return (F.when(us >= 0, F.floor(us / size[u])).otherwise(F.ceil(us / size[u]))).cast("long")
    months = F.months_between(b, a, False)
    whole = F.when(months >= 0, F.floor(months)).otherwise(F.ceil(months))
    k = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}[u]
    return F.when(whole >= 0, F.floor(whole / k)).otherwise(F.ceil(whole / k)).cast("long")


@fn("dayname")
def dayname(x):
    return F.date_format(ts(x), "EEEE")


@fn("monthname")
def monthname(x):
    return F.date_format(ts(x), "MMMM")


@fn("microsecond")
def microsecond(x):
    return F.date_format(ts(x), "SSSSSS").cast("int")


@fn("to_days")
def to_days(x):
    return F.datediff(x.try_cast("date"), F.lit("1970-01-01").cast("date")) + 719528


@fn("from_days")
def from_days(n):
    return F.date_add(F.lit("1970-01-01").cast("date"), (n - 719528).cast("int"))


@fn("unix_timestamp", least=0, most=1)
def unix_timestamp(x=None):
    return F.unix_timestamp() if x is None else F.unix_seconds(ts(x).cast("timestamp_ltz"))


@fn("from_unixtime", least=1, most=2)
def from_unixtime(n, fmt=None):
    t = F.timestamp_seconds(n).cast("timestamp_ntz")
    return t if fmt is None else format_date(t, _plain(fmt))


def week_parts(d: Column, mode: int) -> tuple[Column, Column]:
    """(year, week) by one of the eight modes.

    Bit 0: weeks begin on Monday; bit 1: week 0 doesn't exist (it is the last one
    of the year before); bit 2: week 1 is the first that begins in the year,
    instead of the first with four days (for Monday weeks the other way round).
    """
    d = d.try_cast("date")
    monday, no_zero, flip = mode & 1, mode & 2, mode & 4
    first_day_rule = bool(flip) != (not monday)  # week 1 begins with the first first-day of the year

    def week_in(year: Column) -> Column:
        jan1 = F.make_date(year, F.lit(1), F.lit(1))
        wd = F.weekday(jan1) if monday else (F.dayofweek(jan1) - 1)  # days since the week began
        if first_day_rule:
            start = F.date_add(jan1, ((7 - wd) % 7).cast("int"))
        else:
            start = F.date_sub(jan1, wd.cast("int"))
            start = F.when(wd > 3, F.date_add(start, 7)).otherwise(start)
        return F.floor(F.datediff(d, start) / 7) + 1

    year = F.year(d)
    w = week_in(year)
    if not no_zero:
        return year, F.when(w < 1, 0).otherwise(w).cast("int")
    nxt = week_in(year + 1)
    y = F.when(w < 1, year - 1).when(nxt >= 1, year + 1).otherwise(year)
    return y, F.when(w < 1, week_in(year - 1)).when(nxt >= 1, nxt).otherwise(w).cast("int")


@fn("week", least=1, most=2)
def week(d, mode=None):
    return week_parts(d, int(_plain(mode)) if mode is not None else 0)[1]


@fn("yearweek", least=1, most=2)
def yearweek(d, mode=None):
    y, w = week_parts(d, (int(_plain(mode)) if mode is not None else 0) | 2)
    return (y * 100 + w).cast("int")


def format_date(x: Column, fmt: str) -> Column:
    """DATE_FORMAT with a plain format."""
    t, out, i, lit = ts(x), [], 0, ""
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            spec = fmt[i : i + 2]
            i += 2
            if spec not in SPECIFIERS:
                lit += spec[1]
                continue
            if lit:
                out.append(F.lit(lit))
                lit = ""
            if SPECIFIERS[spec]:
                out.append(F.date_format(t, SPECIFIERS[spec]))
            elif spec == "%D":
                n = F.day(t)
                end = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
                out.append(F.concat(n.cast("string"), end))
            elif spec == "%w":
                out.append((F.dayofweek(t) - 1).cast("string"))
            else:
                mode = {"U": 0, "u": 1, "V": 2, "v": 3, "X": 2, "x": 3}[spec[1]]
                y, w = week_parts(t, mode)
                out.append(F.lpad((y if spec[1] in "Xx" else w).cast("string"), 4 if spec[1] in "Xx" else 2, "0"))
        else:
            lit += fmt[i]
            i += 1
    if lit:
        out.append(F.lit(lit))
    return F.concat(*out) if out else F.when(x.isNotNull(), F.lit(""))


@fn("date_format", least=2)
def date_format(x, fmt):
    return format_date(x, _plain(fmt))


@fn("str_to_date", least=2)
def str_to_date(s, fmt):
    pattern = "".join(SPECIFIERS.get(p, None) or p[-1:] if p.startswith("%") else f"'{p}'" if p.isalpha() else p for p in _split_format(_plain(fmt)))
    return F.try_to_timestamp(s, F.lit(pattern)).cast("timestamp_ntz")


def _split_format(fmt: str) -> list[str]:
    out, i = [], 0
    while i < len(fmt):
        n = 2 if fmt[i] == "%" else 1
        out.append(fmt[i : i + n])
        i += n
    return out


@fn("get_format", least=2)
def get_format(kind, where):
    # Formats by kind and locale.
    table = {
        ("DATE", "USA"): "%m.%d.%Y", ("DATE", "JIS"): "%Y-%m-%d", ("DATE", "ISO"): "%Y-%m-%d", ("DATE", "EUR"): "%d.%m.%Y", ("DATE", "INTERNAL"): "%Y%m%d",
        ("TIME", "USA"): "%h:%i:%s %p", ("TIME", "JIS"): "%H:%i:%s", ("TIME", "ISO"): "%H:%i:%s", ("TIME", "EUR"): "%H.%i.%s", ("TIME", "INTERNAL"): "%H%i%s",
        ("DATETIME", "USA"): "%Y-%m-%d %H.%i.%s", ("DATETIME", "JIS"): "%Y-%m-%d %H:%i:%s", ("DATETIME", "ISO"): "%Y-%m-%d %H:%i:%s", ("DATETIME", "EUR"): "%Y-%m-%d %H.%i.%s", ("DATETIME", "INTERNAL"): "%Y%m%d%H%i%s",
    }
    return F.lit(table.get((_plain(kind).upper(), _plain(where).upper())))


@fn("convert_tz", least=3)
def convert_tz(t, a, b):
    """An unknown zone gives NULL."""
    from datetime import timedelta, timezone
    from zoneinfo import ZoneInfo

    def zone(s):
        if s[0] in "+-":
            h, m = s[1:].split(":")
            return timezone((1 if s[0] == "+" else -1) * timedelta(hours=int(h), minutes=int(m)))
        try:
            return ZoneInfo(s)
        except Exception as e:
            raise ValueError(s) from e

    return python(lambda t, a, b: t.to_pydatetime().replace(tzinfo=zone(a)).astimezone(zone(b)).replace(tzinfo=None), "timestamp_ntz")(ts(t), a, b)


def time_of(x: Column) -> Column:
    """TIME of a text [-]H:M[:S[.f]] (or of a number HHMMSS) as microseconds, clamped."""
    s = x.cast("string")
    m = lambda g: F.regexp_extract(s, r"^\s*(-?)(?:(\d+)\s+)?(?:\d{4}-\d\d-\d\d[ T])?(\d+):(\d+)(?::(\d+)(?:\.(\d{1,6}))?)?", g)
    n = lambda g: F.coalesce(m(g).try_cast("long"), F.lit(0))
    us = ((n(2) * 24 + n(3)) * 3600 + n(4) * 60 + n(5)) * 1_000_000 + F.rpad(F.coalesce(m(6), F.lit("")), 6, "0").cast("long")
    us = F.when(m(1) == "-", -us).otherwise(us)
    return F.when(m(3) != "", F.greatest(F.lit(-MAX_TIME), F.least(F.lit(MAX_TIME), us)))


def time_text(us: Column) -> Column:
    a = F.abs(us)
    two = lambda v: F.lpad(v.cast("long").cast("string"), 2, "0")
    h, rest = F.floor(a / 3_600_000_000), a % 3_600_000_000
    out = F.concat(F.when(us < 0, "-").otherwise(""), F.when(h < 100, two(h)).otherwise(h.cast("string")), F.lit(":"), two(F.floor(rest / 60_000_000)), F.lit(":"), two(F.floor(rest % 60_000_000 / 1_000_000)))
    return F.when(a % 1_000_000 == 0, out).otherwise(F.concat(out, F.lit("."), F.lpad((a % 1_000_000).cast("string"), 6, "0")))


@fn("time")
def time(x):
    return time_text(time_of(x))


@fn("time_to_sec")
def time_to_sec(x):
    us = time_of(x)
    return F.when(us < 0, -F.floor(-us / 1_000_000)).otherwise(F.floor(us / 1_000_000)).cast("long")


@fn("sec_to_time")
def sec_to_time(n):
    return time_text(F.greatest(F.lit(-MAX_TIME), F.least(F.lit(MAX_TIME), n.cast("long") * 1_000_000)))


@fn("timediff", least=2)
def timediff(a, b):
    whole = lambda x: F.unix_micros(ts(x).cast("timestamp_ltz"))
    dated = a.cast("string").rlike(r"^\d{4}-")
    us = F.when(dated, whole(a) - whole(b)).otherwise(time_of(a) - time_of(b))
    return time_text(F.greatest(F.lit(-MAX_TIME), F.least(F.lit(MAX_TIME), us)))


@fn("time_format", least=2)
def time_format(t, fmt):
    us = F.abs(time_of(t))
    h = F.floor(us / 3_600_000_000)
    out = F.lit(_plain(fmt))
    parts = {"%H": F.lpad(h.cast("string"), 2, "0"), "%k": h.cast("string"), "%i": F.lpad(F.floor(us / 60_000_000 % 60).cast("string"), 2, "0"), "%s": F.lpad(F.floor(us / 1_000_000 % 60).cast("string"), 2, "0"), "%S": F.lpad(F.floor(us / 1_000_000 % 60).cast("string"), 2, "0"), "%f": F.lpad((us % 1_000_000).cast("string"), 6, "0"), "%h": F.lpad(((h + 11) % 12 + 1).cast("string"), 2, "0"), "%p": F.when(h % 24 < 12, "AM").otherwise("PM")}
    for k, v in parts.items():
        out = F.replace(out, F.lit(k), v)
    return out


@fn("curtime", "current_time", "utc_time", least=0, most=1)
def curtime(*fsp):
    return F.date_format(F.localtimestamp(), "HH:mm:ss")


@fn("extract", least=2)
def extract(unit, x):
    """A field of a date; composite units read as one number, such as 1530 for HOUR_MINUTE."""
    u, t = _plain(unit).upper(), ts(x)
    one = {"YEAR": F.year(t), "QUARTER": F.quarter(t), "MONTH": F.month(t), "WEEK": week_parts(t, 0)[1], "DAY": F.day(t), "HOUR": F.hour(t), "MINUTE": F.minute(t), "SECOND": F.second(t).cast("int"), "MICROSECOND": microsecond(t)}
    if u in one:
        return one[u]
    out = None
    for name in COMPOSITE[u]:
        out = one[name].cast("long") if out is None else out * (1_000_000 if name == "MICROSECOND" else 100) + one[name]
    return out


def call_yearweek(d: Column, mode: int) -> Column:
    y, w = week_parts(d, mode | 2)
    return (y * 100 + w).cast("int")


def months_apart(d: Column) -> Column:
    return timestampdiff(F.lit("MONTH"), F.lit("1992-01-15"), d)


def call_extract(unit: str, d: Column) -> Column:
    return extract(F.lit(unit), d)


def parse(s: Column, fmt: str) -> Column:
    return str_to_date(s, F.lit(fmt))
