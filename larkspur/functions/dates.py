"""Date and time functions. Dates may be columns of date, timestamp or text; bad text gives NULL.

A TIME is wider than a day here, so it is a signed number of seconds (a double) and is shown as text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.text import Col, _int, _text, col

MAX_TIME = 838 * 3600 + 59 * 60 + 59
_EPOCH_DAYS = 719_528

#: Format codes by their letter, as date_format patterns; None is computed apart.
_CODES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "M": "MMMM", "b": "MMM", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h",
    "i": "mm", "s": "ss", "S": "ss", "p": "a", "W": "EEEE", "a": "EEE", "j": "DDD", "f": "SSSSSS", "T": "HH:mm:ss", "r": "hh:mm:ss a",
}


def stamp(x: Col) -> Column:
    """As a timestamp without time zone; NULL where text is no date."""
    return col(x).try_cast("timestamp_ntz")


def day_of(x: Col) -> Column:
    return stamp(x).cast("date")


def translate_format(fmt: str) -> str:
    """A ``%`` format as a Java pattern, for codes that have one."""
    out = ""
    for code, plain in re.findall(r"%(.)|([^%]+)", fmt, re.S):
        if code:
            out += _CODES.get(code) or "'" + code.replace("'", "''") + "'"
        else:
            out += re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", plain.replace("'", "''"))
    return out.replace("''''", "''")


def date_format(x: Col, fmt: str) -> Column:
    """Codes that Java lacks (%D, %w, %U, %u, %V, %v, %X, %x) are computed."""
    t = stamp(x)
    n = F.dayofmonth(t)
    suffix = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    pad = lambda c, k: F.lpad(c.cast("string"), k, "0")
    own = {
        "D": lambda: F.concat(n.cast("string"), suffix), "w": lambda: (F.dayofweek(t) - 1).cast("string"),
        "U": lambda: pad(week(t, 0), 2), "u": lambda: pad(week(t, 1), 2), "V": lambda: pad(week(t, 2), 2), "v": lambda: pad(week(t, 3), 2),
        "X": lambda: pad(F.floor(yearweek(t, 2) / 100), 4), "x": lambda: pad(F.floor(yearweek(t, 3) / 100), 4),
    }
    parts = []
    for piece in re.split(r"(%[DwUuVvXx])", fmt):
        if piece[:1] == "%" and piece[1:] in own:
            parts.append(own[piece[1]]())
        elif piece:
            parts.append(F.date_format(t, translate_format(piece)))
    return F.concat(*parts) if parts else F.when(t.isNotNull(), "")


def str_to_date(s: Col, fmt: str) -> Column:
    return F.try_to_timestamp(_text(s), F.lit(translate_format(fmt))).cast("timestamp_ntz")


def date(x: Col) -> Column:
    return day_of(x)


def year(x: Col) -> Column:
    return F.year(stamp(x))


def quarter(x: Col) -> Column:
    return F.quarter(stamp(x))


def month(x: Col) -> Column:
    return F.month(stamp(x))


def day(x: Col) -> Column:
    return F.dayofmonth(stamp(x))


def dayname(x: Col) -> Column:
    return F.date_format(stamp(x), "EEEE")


def monthname(x: Col) -> Column:
    return F.date_format(stamp(x), "MMMM")


def dayofweek(x: Col) -> Column:
    return F.dayofweek(stamp(x))


def weekday(x: Col) -> Column:
    return F.weekday(stamp(x))


def dayofyear(x: Col) -> Column:
    return F.dayofyear(stamp(x))


def hour(x: Col) -> Column:
    return F.hour(stamp(x))


def minute(x: Col) -> Column:
    return F.minute(stamp(x))


def second(x: Col) -> Column:
    return F.second(stamp(x))


def microsecond(x: Col) -> Column:
    return F.date_format(stamp(x), "SSSSSS").cast("int")


def last_day(x: Col) -> Column:
    return F.last_day(stamp(x))


def to_days(x: Col) -> Column:
    return F.datediff(day_of(x), F.lit("1970-01-01").cast("date")) + _EPOCH_DAYS


def from_days(n: Col) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), (_int(n) - _EPOCH_DAYS).cast("int"))


def seconds_of_day(x: Col) -> Column:
    t = stamp(x)
    return F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def to_seconds(x: Col) -> Column:
    return to_days(x).cast("bigint") * 86400 + seconds_of_day(x)


def time_to_sec(x: Col) -> Column:
    return seconds_of_day(x)


def _weeks(x: Col, mode: int) -> tuple[Column, Column]:
    """(year, week) of a mode; week 0 is only possible where the mode numbers from 0."""
    d = day_of(x)
    monday, from_one, first_full = bool(mode & 1), bool(mode & 2), bool(mode & 4)
    # Modes 1, 3, 4 and 6 give week 1 to the year's first stretch of four days or more; the others to its first whole week.
    four_days = monday != first_full
    # 0 on the day that starts a week.
    offset = F.weekday(d) if monday else F.dayofweek(d) - 1
    start = lambda y: F.make_date(y, F.lit(1), F.lit(1))

    def first(y: Column) -> Column:
        """Day of the year's week 1."""
        j = start(y)
        at = F.weekday(j) if monday else F.dayofweek(j) - 1
        ahead = F.when(at <= 3, -at).otherwise(7 - at) if four_days else F.when(at == 0, F.lit(0)).otherwise(7 - at)
        return F.date_add(j, ahead.cast("int"))

    y = F.year(d)
    begin = F.date_sub(d, offset.cast("int"))
    in_next = begin >= first(y + 1)
    before = d < first(y)
    count = lambda yy: (F.floor(F.datediff(begin, first(yy)) / 7) + 1).cast("int")
    if from_one:
        owner = F.when(before, y - 1).when(in_next, y + 1).otherwise(y)
        return owner, F.when(before, count(y - 1)).when(in_next, F.lit(1)).otherwise(count(y))
    return y, F.when(before, F.lit(0)).otherwise(count(y))


def week(x: Col, mode: int = 0) -> Column:
    return _weeks(x, mode & 7)[1]


def weekofyear(x: Col) -> Column:
    return week(x, 3)


def yearweek(x: Col, mode: int = 0) -> Column:
    y, w = _weeks(x, (mode & 7) | 2)
    return y * 100 + w


_UNIT_FORMATS = {
    "MICROSECOND": "SSSSSS", "SECOND": "s", "MINUTE": "m", "HOUR": "H", "DAY": "d", "MONTH": "M", "QUARTER": "Q", "YEAR": "y",
    "SECOND_MICROSECOND": "sSSSSSS", "MINUTE_MICROSECOND": "mssSSSSSS", "MINUTE_SECOND": "mss", "HOUR_MICROSECOND": "HmmssSSSSSS", "HOUR_SECOND": "Hmmss", "HOUR_MINUTE": "Hmm",
    "DAY_MICROSECOND": "dHHmmssSSSSSS", "DAY_SECOND": "dHHmmss", "DAY_MINUTE": "dHHmm", "DAY_HOUR": "dHH", "YEAR_MONTH": "yMM",
}


def extract(unit: str, x: Col) -> Column:
    """All 20 units; the composite ones read as one number (HOUR_MINUTE of 13:05 is 1305)."""
    unit = unit.upper()
    return week(x, 0).cast("bigint") if unit == "WEEK" else F.date_format(stamp(x), _UNIT_FORMATS[unit]).cast("bigint")


#: Simple parts of the composite interval units, from the left.
_PARTS = {
    "SECOND_MICROSECOND": ("second", "microsecond"), "MINUTE_MICROSECOND": ("minute", "second", "microsecond"), "MINUTE_SECOND": ("minute", "second"),
    "HOUR_MICROSECOND": ("hour", "minute", "second", "microsecond"), "HOUR_SECOND": ("hour", "minute", "second"), "HOUR_MINUTE": ("hour", "minute"),
    "DAY_MICROSECOND": ("day", "hour", "minute", "second", "microsecond"), "DAY_SECOND": ("day", "hour", "minute", "second"), "DAY_MINUTE": ("day", "hour", "minute"), "DAY_HOUR": ("day", "hour"), "YEAR_MONTH": ("year", "month"),
}


def _add(t: Column, unit: str, n: Column) -> Column:
    unit = unit.upper()
    n = n.cast("bigint")
    if unit in ("YEAR", "QUARTER", "MONTH"):
        return t + F.make_ym_interval(F.lit(0), (n * {"YEAR": 12, "QUARTER": 3, "MONTH": 1}[unit]).cast("int"))
    per = {"WEEK": 604800, "DAY": 86400, "HOUR": 3600, "MINUTE": 60, "SECOND": 1}
    micro = n if unit == "MICROSECOND" else n * per[unit] * 1_000_000
    days = F.floor(micro / 86_400_000_000).cast("int")
    rest = micro - days.cast("bigint") * 86_400_000_000
    return t + F.make_dt_interval(days, F.lit(0), F.lit(0), (rest.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))


def date_add(x: Col, n: Col | int | str, unit: str = "DAY", sign: int = 1) -> Column:
    """Adds an interval of any of the 20 units; a composite amount is text such as ``'1:30'``."""
    t = stamp(x)
    parts = _PARTS.get(unit.upper())
    if not parts:
        return _add(t, unit, (F.lit(n) if isinstance(n, (int, str)) else n) * sign)
    amount = F.lit(n) if isinstance(n, (int, str)) else col(n)
    numbers = F.regexp_extract_all(amount.cast("string"), F.lit(r"(\d+)"), 1)
    minus = F.when(amount.cast("string").startswith("-"), -sign).otherwise(sign)
    months = F.lit(0)
    for k, part in enumerate(parts):
        # Fewer numbers than parts fill from the right.
        at = F.size(numbers) - len(parts) + k
        text = F.when(at >= 0, F.get(numbers, F.greatest(at, F.lit(0))))
        if part == "microsecond":
            text = F.rpad(text, 6, "0")
        number = F.coalesce(text.try_cast("bigint"), F.lit(0)) * minus
        if unit.upper() == "YEAR_MONTH":
            months = months + number * (12 if part == "year" else 1)
        else:
            t = _add(t, part, number)
    return _add(t, "MONTH", months) if unit.upper() == "YEAR_MONTH" else t


def date_sub(x: Col, n: Col | int | str, unit: str = "DAY") -> Column:
    return date_add(x, n, unit, -1)


def timestampadd(unit: str, n: Col | int, x: Col) -> Column:
    return date_add(x, n, unit)


def datediff(a: Col, b: Col) -> Column:
    return F.datediff(day_of(a), day_of(b))


def _micros(x: Col) -> Column:
    return F.unix_micros(stamp(x).cast("timestamp"))


def timestampdiff(unit: str, a: Col, b: Col) -> Column:
    """b - a in whole units; a YEAR is twelve whole months."""
    unit = unit.upper()
    if unit in ("YEAR", "QUARTER", "MONTH"):
        months = _months(a, b)
        per = {"YEAR": 12, "QUARTER": 3, "MONTH": 1}[unit]
        return _towards_zero(months / per)
    per = {"WEEK": 604800, "DAY": 86400, "HOUR": 3600, "MINUTE": 60, "SECOND": 1}
    gap = _micros(b) - _micros(a)
    return gap if unit == "MICROSECOND" else _towards_zero(gap / (per[unit] * 1_000_000))


def _towards_zero(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("bigint")


def _months(a: Col, b: Col) -> Column:
    s, e = stamp(a), stamp(b)
    whole = (F.year(e) - F.year(s)) * 12 + F.month(e) - F.month(s)
    rest = lambda t: F.dayofmonth(t).cast("bigint") * 86_400_000_000 + seconds_of_day(t).cast("bigint") * 1_000_000 + microsecond(t)
    return F.when((whole > 0) & (rest(e) < rest(s)), whole - 1).when((whole < 0) & (rest(e) > rest(s)), whole + 1).otherwise(whole)


def makedate(y: Col | int, n: Col | int) -> Column:
    """Two-digit years are 1970 to 2069; a day below 1 gives NULL."""
    yy = _int(y)
    full = F.when(yy < 70, yy + 2000).when(yy < 100, yy + 1900).otherwise(yy)
    return F.when(_int(n) >= 1, F.date_add(F.make_date(full, F.lit(1), F.lit(1)), (_int(n) - 1).cast("int")))


def time_text(seconds: Column) -> Column:
    """Signed seconds as [-]HH:MM:SS, clamped to 838:59:59."""
    s = F.least(F.abs(seconds.cast("bigint")), F.lit(MAX_TIME))
    text = F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), (s % 60).cast("int"))
    return F.when(seconds < 0, F.concat(F.lit("-"), text)).when(seconds.isNotNull(), text)


def maketime(h: Col | int, m: Col | int, s: Col | int) -> Column:
    hh, mm, ss = _int(h), _int(m), _int(s)
    total = F.abs(hh) * 3600 + mm * 60 + ss
    return F.when(mm.between(0, 59) & ss.between(0, 59), time_text(F.when(hh < 0, -total).otherwise(total)))


def sec_to_time(n: Col) -> Column:
    return time_text(_int(n))


def time_seconds(x: Col) -> Column:
    """Text [-]H:M[:S] or D H:M:S, or the time of day of a date, as signed seconds."""
    t = _text(x)
    shape = r"\A(-?)(?:(\d+) )?(\d{1,3}):(\d{1,2})(?::(\d{1,2}))?(?:\.\d+)?\z"
    g = lambda k: F.coalesce(F.nullif(F.regexp_extract(t, shape, k), F.lit("")).cast("bigint"), F.lit(0))
    total = g(2) * 86400 + g(3) * 3600 + g(4) * 60 + g(5)
    fine = t.rlike(shape) & (g(4) < 60) & (g(5) < 60)
    return F.when(fine, F.when(t.startswith("-"), -total).otherwise(total)).when(t.rlike(r"\A\d{4}-"), seconds_of_day(x).cast("bigint"))


def time(x: Col) -> Column:
    return time_text(time_seconds(x))


def timediff(a: Col, b: Col) -> Column:
    """Text of a - b; NULL for a date and a time."""
    dated = lambda x: _text(x).rlike(r"\A\d{4}-")
    both = F.floor((_micros(a) - _micros(b)) / 1_000_000).cast("bigint")
    return F.when(dated(a) & dated(b), time_text(both)).when(~dated(a) & ~dated(b), time_text(time_seconds(a) - time_seconds(b)))


def addtime(x: Col, delta: Col | str, sign: int = 1) -> Column:
    """A date plus a time is a timestamp's text; a time plus a time is a time's text."""
    d = time_seconds(F.lit(delta) if isinstance(delta, str) else delta) * sign
    dated = _text(x).rlike(r"\A\d{4}-")
    moved = F.date_format(_add(stamp(x), "SECOND", d), "yyyy-MM-dd HH:mm:ss")
    return F.when(dated, moved).otherwise(time_text(time_seconds(x) + d))


def subtime(x: Col, delta: Col | str) -> Column:
    return addtime(x, delta, -1)


def time_format(x: Col, fmt: str) -> Column:
    """Hours may exceed 23 (%H, %k); %h and %l are on the twelve-hour clock."""
    s = F.abs(time_seconds(x))
    h, m, sec = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), (s % 60).cast("int")
    twelve = (h + 11) % 12 + 1
    two = lambda c: F.lpad(c.cast("string"), 2, "0") if isinstance(c, Column) else c
    half = F.when(h % 24 >= 12, "PM").otherwise("AM")
    known = {"H": F.when(h > 99, h.cast("string")).otherwise(two(h)), "k": h.cast("string"), "h": two(twelve), "I": two(twelve), "l": twelve.cast("string"), "i": two(m), "s": two(sec), "S": two(sec), "f": F.lit("000000"), "p": half}
    known["T"] = F.concat(known["H"], F.lit(":"), known["i"], F.lit(":"), known["s"])
    known["r"] = F.concat(known["h"], F.lit(":"), known["i"], F.lit(":"), known["s"], F.lit(" "), half)
    parts = [known.get(c, F.lit(c)) if c else F.lit(p) for c, p in re.findall(r"%(.)|([^%]+)", fmt, re.S)]
    return F.concat(*parts)


def convert_tz(x: Col, source: str, target: str) -> Column:
    return F.convert_timezone(F.lit(source), F.lit(target), stamp(x))


def unix_timestamp(x: Col | None = None) -> Column:
    return F.unix_timestamp() if x is None else F.unix_seconds(stamp(x).cast("timestamp"))


def from_unixtime(n: Col, fmt: str | None = None) -> Column:
    t = F.timestamp_seconds(col(n)).cast("timestamp_ntz")
    return F.when(col(n) >= 0, date_format(t, fmt or "%Y-%m-%d %H:%i:%s"))


def period_add(p: Col | int, n: Col | int) -> Column:
    months = _period(_int(p)) + _int(n)
    return F.floor(months / 12).cast("bigint") * 100 + months % 12 + 1


def _period(p: Column) -> Column:
    """YYYYMM or YYMM as months; years below 70 are 20YY."""
    y = F.floor(p / 100).cast("bigint")
    return F.when(y < 70, y + 2000).when(y < 100, y + 1900).otherwise(y) * 12 + p % 100 - 1


def period_diff(a: Col | int, b: Col | int) -> Column:
    return _period(_int(a)) - _period(_int(b))


def now() -> Column:
    return F.current_timestamp()


sysdate = now


def curdate() -> Column:
    return F.current_date()
