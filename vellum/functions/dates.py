"""Date functions: texts to dates, calendar days, days of the site's zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ZONE = "Asia/Shanghai"
# How dates are written.
NUMERIC_DATE = r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"
CHINESE_DATE = r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"

#: Bounds of the buckets of a notice's period in days, both inclusive; the first takes negatives too.
PERIOD_BUCKETS = (("le7", None, 7), ("d8_15", 8, 15), ("d16_30", 16, 30), ("gt30", 31, None))


def _date_of(text: Column, pattern: str) -> Column:
    year, month, day = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
    whole = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    # years below 100 are not years here
    return F.when((year != "") & (year >= "0100"), F.try_to_date(whole, "yyyy-MM-dd"))


def date_in(text: Column) -> Column:
    """The first date written in ``text``, numeric forms before the Chinese one; null if no such day exists."""
    return F.when(F.regexp_extract(text, NUMERIC_DATE, 0) != "", _date_of(text, NUMERIC_DATE)).otherwise(_date_of(text, CHINESE_DATE))


def deadline_in(text: Column, patterns: list[str]) -> Column:
    """The date in the first pattern's first match that is a real day; later patterns stand in for earlier ones."""
    return F.coalesce(*[date_in(F.regexp_extract(text, p, 0)) for p in patterns])


def site_day(at: Column, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def site_month(at: Column, zone: str = ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM")


def day_of_millis(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def last_months(day: Column, n: int) -> Column:
    """The n months up to a day's own, oldest first."""
    return F.transform(F.sequence(F.lit(1 - n), F.lit(0)), lambda k: F.date_format(F.add_months(day, k), "yyyy-MM"))


def period_bucket(published: Column, deadline: Column) -> Column:
    days = F.datediff(deadline, published)
    out = None
    for name, _, high in PERIOD_BUCKETS:
        out = F.when(days <= high, name) if out is None else out.when(days <= high, name) if high is not None else out.when(days.isNotNull(), name)
    return out


def days_left(deadline: Column, as_of: str) -> Column:
    return F.datediff(deadline, F.lit(as_of).cast("date"))


def urgency(deadline: Column, as_of: str) -> Column:
    days = days_left(deadline, as_of)
    return F.when(days.isNull(), "none").when(days < 0, "past").when(days == 0, "today").when(days <= 3, "urgent").when(days <= 7, "soon").otherwise("later")


def countdown(deadline: Column, as_of: str) -> Column:
    days = days_left(deadline, as_of)
    return F.when(days.isNull(), "no deadline").when(days < 0, "closed").when(days == 0, "closes today").otherwise(F.concat(days.cast("string"), F.lit(" days left")))
