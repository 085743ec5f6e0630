"""Column functions on dates: local calendars as ISO text with their offset, and parsed times.

`now` is always a parameter. Local time is UTC+8 without daylight saving.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: years between the Minguo calendar and the common one.
ROC = 1911
OFFSET = "+08:00"
#: What marks a court's result in a title, and categories with states of their own.
VERDICT = r"判決|定讞|判刑|判賠|宣判|判處|改判|更審|上訴駁回|無罪(?:確定|定讞)|判.{0,4}(?:徒刑|拘役|罰金)"
RULING, SEARCH = "司法判決", "協尋"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _two(c: Column) -> Column:
    return F.lpad(c, 2, "0")


def _part(c: Column, pattern: str, group: int, default: str | None = None) -> Column:
    found = F.regexp_extract(c, pattern, group)
    return found if default is None else F.when(found == "", default).otherwise(found)


def _iso(year: Column, month: Column, day: Column, hour="12", minute="00", second="00") -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else _two(x)
    return F.concat(year.cast("string"), F.lit("-"), lit(month), F.lit("-"), lit(day), F.lit("T"), lit(hour), F.lit(":"), lit(minute), F.lit(":"), lit(second), F.lit(OFFSET))


def roc_date(c: Column) -> Column:
    """P10: yyyMMdd at noon; null with fewer than seven digits."""
    d = F.regexp_replace(_text(c), r"\D", "")
    return F.when(F.length(d) >= 7, _iso(d.substr(1, 3).cast("int") + ROC, d.substr(4, 2), d.substr(6, 2)))


def roc_datetime(c: Column) -> Column:
    """P10: yyyMMddHHmm; with fewer than eleven digits as `roc_date`."""
    d = F.regexp_replace(_text(c), r"\D", "")
    return F.when(F.length(d) >= 11, _iso(d.substr(1, 3).cast("int") + ROC, d.substr(4, 2), d.substr(6, 2), d.substr(8, 2), d.substr(10, 2))).otherwise(roc_date(d))


def roc_month(c: Column) -> Column:
    """P10: yyyMM at the month's first midnight; null with fewer than five digits."""
    d = F.regexp_replace(_text(c), r"\D", "")
    return F.when(F.length(d) >= 5, _iso(d.substr(1, 3).cast("int") + ROC, d.substr(4, 2), F.lit("01"), "00"))


def roc_chinese(c: Column) -> Column:
    """P10: year, month, day, hour, minute and where given second in Chinese."""
    p = r"(\d{2,3})年(\d{1,2})月(\d{1,2})日\s*(\d{1,2})時(\d{1,2})分(?:(\d{1,2})秒)?"
    t = _text(c)
    return F.when(t.rlike(p), _iso(_part(t, p, 1).cast("int") + ROC, *(_part(t, p, i) for i in (2, 3, 4, 5)), _part(t, p, 6, "00")))


def roc_chinese_month(c: Column) -> Column:
    """P10: year and month in Chinese."""
    p = r"(\d{2,3})年\s*(\d{1,2})月"
    t = _text(c)
    return F.when(t.rlike(p), roc_month(F.concat(F.lpad(_part(t, p, 1), 3, "0"), _two(_part(t, p, 2)))))


def official_date(c: Column, fallback: Column) -> Column:
    """P10: yyy.MM.dd (also with / or -, a remark in brackets and a time), else an ISO or slash date, as UTC text; else the fallback."""
    t = F.trim(_text(c))
    p = r"(\d{3})[./-](\d{1,2})[./-](\d{1,2})(?:\([^)]*\))?(?:\s*(\d{1,2}):(\d{2})(?::(\d{2}))?)?"
    g = r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})(?:[ T](\d{1,2}):(\d{2})(?::(\d{2}))?)?"
    # A four-digit year holds a three-digit one; the reference takes the first match, so year 2024-01-02 reads as 024.
    roc = _iso(_part(t, p, 1).cast("int") + ROC, *(_part(t, p, i) for i in (2, 3)), *(_part(t, p, i, "00") for i in (4, 5, 6)))
    common = _iso(_part(t, g, 1), *(_part(t, g, i) for i in (2, 3)), *(_part(t, g, i, "00") for i in (4, 5, 6)))
    as_time = lambda x: F.try_to_timestamp(x, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    return F.coalesce(utc_text(F.when(t.rlike(p), as_time(roc)).when(t.rlike(g), as_time(common))), fallback)


def utc_text(ts: Column) -> Column:
    """A time as ISO text in UTC with milliseconds (the session's zone must be UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def gregorian_date(c: Column) -> Column:
    """Eight digits that begin with 20, at noon."""
    d = F.regexp_replace(_text(c), r"\D", "")
    return F.when((F.length(d) == 8) & d.startswith("20"), _iso(d.substr(1, 4), d.substr(5, 2), d.substr(7, 2)))


def slash_date(c: Column) -> Column:
    """y/M/d anywhere in the text, at noon."""
    p, t = r"(\d{4})/(\d{1,2})/(\d{1,2})", _text(c)
    return F.when(t.rlike(p), _iso(*(_part(t, p, i) for i in (1, 2, 3))))


def slash_datetime(c: Column) -> Column:
    """y/M/d H:mm anywhere in the text."""
    p, t = r"(\d{4})/(\d{1,2})/(\d{1,2})\s+(\d{1,2}):(\d{2})", _text(c)
    return F.when(t.rlike(p), _iso(*(_part(t, p, i) for i in range(1, 6))))


def local_datetime(c: Column) -> Column:
    """Y-M-d or y/M/d with a time of 24 hours, or of 12 hours after a Chinese morning or afternoon mark."""
    t = F.regexp_replace(F.trim(_text(c)), r'^"+|"+$', "")
    half, full = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})\s*(上午|下午)\s*(\d{1,2}):(\d{2})(?::(\d{2}))?", r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[T\s-])(\d{1,2}):(\d{2})(?::(\d{2}))?"
    hour, pm = _part(t, half, 5).cast("int"), _part(t, half, 4) == "下午"
    hour = F.when(pm & (hour < 12), hour + 12).when(~pm & (hour == 12), 0).otherwise(hour).cast("string")
    twelve = _iso(*(_part(t, half, i) for i in (1, 2, 3)), hour, _part(t, half, 6), _part(t, half, 7, "00"))
    return F.when(t.rlike(half), twelve).when(t.rlike(full), _iso(*(_part(t, full, i) for i in range(1, 6)), _part(t, full, 6, "00")))


def calendar_parts(year: Column, month: Column, day: Column, hour: Column | None = None, minute: Column | None = None) -> Column:
    """A time from its parts; null if any is."""
    return _iso(*(x.cast("int").cast("string") for x in (year, month, day, F.lit(0) if hour is None else hour, F.lit(0) if minute is None else minute)))


def date_and_time(date: Column, time: Column) -> Column:
    """yyyyMMdd and HHmmss (zeros before it may lack); null unless the date has eight letters."""
    d, t = _text(date), F.lpad(F.coalesce(F.nullif(time.cast("string"), F.lit("")), F.lit("000000")), 6, "0")
    return F.when(F.length(d) == 8, _iso(d.substr(1, 4), d.substr(5, 2), d.substr(7, 2), t.substr(1, 2), t.substr(3, 2), t.substr(5, 2)))


def eight_digits_midnight(c: Column) -> Column:
    """yyyyMMdd at midnight; null unless the text has eight letters."""
    t = F.trim(_text(c))
    return F.when(F.length(t) == 8, _iso(t.substr(1, 4), t.substr(5, 2), t.substr(7, 2), "00"))


def compact_utc(c: Column) -> Column:
    """yyyyMMdd'T'HHmmss'Z' as ISO text in UTC; other texts as they stand."""
    t = F.trim(_text(c))
    p = r"^(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})(\d{2})Z?$"
    return F.when(t.rlike(p), utc_text(F.try_to_timestamp(F.regexp_replace(t, p, "$1-$2-$3 $4:$5:$6"), F.lit("yyyy-MM-dd HH:mm:ss")))).otherwise(t)


def apply_offset(c: Column, offset: str | None) -> Column:
    """The offset after times that have none; other texts trimmed."""
    t = F.trim(_text(c))
    p = r"^(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}(?::\d{2})?)$"
    return F.when(t.rlike(p), F.regexp_replace(t, p, "$1T$2" + offset)).otherwise(t) if offset else t


def iso_week_end(year: Column, week: Column) -> Column:
    """The Sunday of an ISO week."""
    monday = F.date_trunc("week", F.make_date(year.cast("int"), F.lit(1), F.lit(4))).cast("date")
    return F.date_add(monday, (week.cast("int") - 1) * 7 + 6)


def month_end(c: Column) -> Column:
    """Last second of the month yyyyMM in local time, as UTC text; null for other texts."""
    t = _text(c)
    good = t.rlike(r"^\d{6}$") & t.substr(5, 2).try_cast("int").between(1, 12)
    return F.when(good, F.concat(F.last_day(F.try_to_date(F.concat(t.substr(1, 4), F.lit("-"), t.substr(5, 2), F.lit("-01")))).cast("string"), F.lit("T15:59:59.000Z")))


def year_end(c: Column) -> Column:
    """Last second of a year from 1900 to 2200 in local time, as UTC text."""
    y = c.try_cast("int")
    return F.when(y.between(1900, 2200), F.concat(y.cast("string"), F.lit("-12-31T15:59:59.000Z")))


def ten_day_date(year: Column, month: Column, period: Column) -> Column:
    """The date of a ten-day period (first, second or third, or a day's number; else the 15th), not beyond the month's end."""
    y, m, p = year.try_cast("int"), month.try_cast("int"), F.trim(_text(period))
    number = p.try_cast("int")
    day = F.when(number.between(1, 31), number).when(p.contains("上旬"), 10).when(p.contains("中旬"), 20).when(p.contains("下旬"), 30).otherwise(15)
    good = (y >= 1900) & m.between(1, 12)
    last = F.last_day(F.make_date(F.when(good, y), F.when(good, m), F.lit(1)))
    return F.when(good, F.date_format(F.least(F.date_add(F.trunc(last, "month"), day - 1), last), "yyyy-MM-dd"))


def roc_month_range_end(c: Column) -> Column:
    """The last day of a Minguo month, or of the last month of a range, in Chinese."""
    p, t = r"^(\d{3})年(\d{1,2})(?:-(\d{1,2}))?月", _text(c)
    month = F.when(_part(t, p, 3) == "", _part(t, p, 2)).otherwise(_part(t, p, 3)).try_cast("int")
    good = t.rlike(p) & month.between(1, 12)
    return F.when(good, F.date_format(F.last_day(F.make_date(F.when(good, _part(t, p, 1).try_cast("int") + ROC), F.when(good, month), F.lit(1))), "yyyy-MM-dd"))


def roc_period(c: Column) -> Column:
    """struct(year, month, key) of a label of a single Minguo month; null for years and ranges."""
    t = F.trim(F.regexp_replace(F.regexp_replace(_text(c), "[‌‍]", ""), r"\s+", " "))
    p = r"(\d{2,3})\s*年\s*(\d{1,2})\s*月"
    return F.when(t.rlike(p), F.struct(_part(t, p, 1).try_cast("int").alias("year"), _part(t, p, 2).try_cast("int").alias("month"), F.concat(_part(t, p, 1), _two(_part(t, p, 2))).alias("key")))


def local_day(ts: Column) -> Column:
    """The day at UTC+8."""
    return F.date_format(ts + F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd")


def local_hour(ts: Column) -> Column:
    """The hour at UTC+8."""
    return F.date_format(ts + F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd HH:00")


def temporal_state(category: Column, title: Column, ts: Column, now: datetime, days: int = 180) -> Column:
    """P30: 'judicial' by category or title, else 'historical' if older than `days`, else null; searches for people are never historical."""
    return (
        F.when(F.coalesce(category == RULING, F.lit(False)) | _text(title).rlike(VERDICT), "judicial")
        .when(F.coalesce(category == SEARCH, F.lit(False)), None).when(ts < F.lit(now - timedelta(days=days)), "historical")
    )


def clamp_future(ts: Column, fetched: Column, now: datetime, days: int = 400) -> Column:
    """struct(ts, clamped): a time more than `days` ahead becomes the time of fetching, else now."""
    far = F.coalesce(ts > F.lit(now + timedelta(days=days)), F.lit(False))
    return F.struct(F.when(far, F.coalesce(fetched, F.lit(now))).otherwise(ts).alias("ts"), far.alias("clamped"))


def staleness_hours(ts: Column, now: datetime) -> Column:
    """Hours from `ts` to now; null without a time."""
    return (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(3.6e9)


def staleness_notice(ts: Column, now: datetime, threshold: float = 6) -> Column:
    """A notice where more than `threshold` hours have passed; else null."""
    hours = staleness_hours(ts, now)
    return F.when(hours > threshold, F.concat(F.lit("資料已 "), F.floor(hours).cast("string"), F.lit(" 小時未更新（最後更新 "), F.date_format(ts, "yyyy/M/d HH:mm:ss"), F.lit("）")))
