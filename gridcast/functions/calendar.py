"""Calendar expressions over wall-clock hours.

Local hours are TIMESTAMP_NTZ throughout. Only functions that never consult the session time zone are
used on them (casts, ``hour``, ``convert_timezone``, interval arithmetic), so results do not depend on
how the caller configured the session.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EASTERN = "America/New_York"

# First and last moment of the stay-at-home period, both included.
STAY_AT_HOME_START = "2020-03-18 00:00:00"
STAY_AT_HOME_END = "2020-06-30 00:00:00"

# First observed Juneteenth of the federal calendar.
JUNETEENTH_FROM = "2021-06-18"


def _hours(n: int) -> Column:
    return F.expr(f"INTERVAL '{n}' HOUR")


def ntz(text: str) -> Column:
    """A wall-clock literal."""
    return F.lit(text).cast("timestamp_ntz")


def wall_hour(date: Column, hour: Column) -> Column:
    """Date and hour number to the wall-clock timestamp."""
    return date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour)


def truncate_hour(ts: Column) -> Column:
    return wall_hour(ts.cast("date"), F.hour(ts))


def parse_wall_time(text: Column, fmt: str | None = None) -> Column:
    """Text to wall-clock timestamp; malformed text is an error, as in the source data's own reader."""
    return F.to_timestamp_ntz(text, F.lit(fmt)) if fmt else text.cast("timestamp_ntz")


def local_to_utc(ts: Column, tz: str = EASTERN) -> Column:
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), ts)


def utc_to_local(ts: Column, tz: str = EASTERN) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts)


def is_real_unique_hour(ts: Column, tz: str = EASTERN) -> Column:
    """True where the wall-clock hour happened exactly once.

    A skipped hour does not survive the round trip through UTC. A repeated hour is also shown by a
    neighbouring UTC hour.
    """
    utc = local_to_utc(ts, tz)
    exists = utc_to_local(utc, tz) == ts
    repeated = (utc_to_local(utc + _hours(1), tz) == ts) | (utc_to_local(utc - _hours(1), tz) == ts)
    return exists & ~repeated


def localize_drop(df: DataFrame, ts: str, tz: str = EASTERN) -> DataFrame:
    """Keep only hours that exist and are unambiguous in ``tz``."""
    return df.filter(is_real_unique_hour(F.col(ts), tz))


def is_dst(ts: Column, tz: str = EASTERN, dst_offset_hours: int = -4) -> Column:
    """True where the local offset from UTC equals the daylight-saving offset."""
    return (ts - local_to_utc(ts, tz)) == _hours(dst_offset_hours)


def day_name(date: Column) -> Column:
    return F.date_format(date, "EEEE")


def dow_number(date: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(date) + 1


def weekend(date: Column) -> Column:
    return F.weekday(date) >= 5


def season_number(month: Column) -> Column:
    """Fixed grouping of months by cooling need: 1 summer, 2 and 3 shoulder months, 4 the rest."""
    return (
        F.when(month.between(6, 9), 1)
        .when(month.isin(5, 10), 2)
        .when(month.isin(4, 11), 3)
        .otherwise(4)
    )


def regime(ts: Column, start: str = STAY_AT_HOME_START, end: str = STAY_AT_HOME_END) -> dict[str, Column]:
    """Three flags that partition time around a period whose both ends belong to it."""
    first, last = ntz(start), ntz(end)
    return {"is_sah": ts.between(first, last), "precovid": ts < first, "postcovid": ts > last}


def cyclic(value: Column, low: int, high: int, period: float | None = None) -> tuple[Column, Column]:
    """Cosine and sine of a value on a circle. The default circumference is ``high - low``, which puts
    the two ends of the range on the same point; pass ``period`` for a true cycle."""
    angle = value * F.lit(2 * pi / (period if period is not None else high - low))
    return F.cos(angle), F.sin(angle)


def holiday(date: Column, juneteenth_from: str = JUNETEENTH_FROM) -> Column:
    """United States federal holiday, with weekend dates moved to the nearest workday."""
    since = F.lit(juneteenth_from).cast("date")

    def on_fixed_date(d: Column) -> Column:
        month_day = F.month(d) * 100 + F.dayofmonth(d)
        # New year, independence, veterans, christmas; then juneteenth.
        return month_day.isin(101, 704, 1111, 1225) | ((month_day == 619) & (date >= since))

    weekday, month, day = F.weekday(date), F.month(date), F.dayofmonth(date)
    observed = (
        ((weekday < 5) & on_fixed_date(date))
        | ((weekday == 4) & on_fixed_date(F.date_add(date, 1)))
        | ((weekday == 0) & on_fixed_date(F.date_sub(date, 1)))
    )
    nth_monday = (weekday == 0) & (
        (month.isin(1, 2) & day.between(15, 21))
        | ((month == 5) & (day >= 25))
        | ((month == 9) & (day <= 7))
        | ((month == 10) & day.between(8, 14))
    )
    thanksgiving = (weekday == 3) & (month == 11) & day.between(22, 28)
    return observed | nth_monday | thanksgiving


def next_day(run_date: Column) -> Column:
    return F.date_add(run_date, 1)


def format_date(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def with_calendar(
    df: DataFrame,
    ts: str = "datetime",
    tz: str = EASTERN,
    true_cycle: bool = False,
    juneteenth_from: str = JUNETEENTH_FROM,
) -> DataFrame:
    """Add every calendar column next to the wall-clock column ``ts``."""
    t = F.col(ts)
    date = t.cast("date")
    hour_cos, hour_sin = cyclic(F.hour(t), 0, 23, 24 if true_cycle else None)
    month_cos, month_sin = cyclic(F.month(date), 1, 12, 12 if true_cycle else None)
    return df.withColumns(
        {
            "date": date,
            "hour": F.hour(t),
            "year": F.year(date),
            "dow": day_name(date),
            "is_dst": is_dst(t, tz),
            **regime(t),
            "weekend": weekend(date),
            "recent": F.lit(1),
            "hour_cos": hour_cos,
            "hour_sin": hour_sin,
            "month_cos": month_cos,
            "month_sin": month_sin,
            "dow_num": dow_number(date),
            "holiday": holiday(date, juneteenth_from),
            "season_num": season_number(F.month(date)),
        }
    )
