"""Dates and calendars.  Input may be a string (yyyy-MM-dd or yyyy/MM/dd), a date or a timestamp; what can't be a date is NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_FORM = r"^\d{1,4}[-/]\d{1,2}[-/]\d{1,2}$"
PERIODS = {"month": 12, "day": 31, "day_of_week": 7, "day_of_year": 366, "week_of_year": 53, "quarter": 4, "hour": 24, "minute": 60, "second": 60}


def parse(x: Column) -> Column:
    """The date of a string; years outside 1000 to 2200 and days that do not exist are NULL."""
    d = F.when(x.rlike(_FORM), F.try_to_timestamp(F.regexp_replace(x, "/", "-"), F.lit("y-M-d")).cast("date"))
    return F.when(F.year(d).between(1000, 2200), d)


def coerce(x: Column, form: str | None = None) -> Column:
    free = F.try_to_timestamp(x)
    return F.coalesce(F.try_to_timestamp(x, F.lit(form)), free) if form else free


def day_of_week(d: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(d) - 1


def _wave(v: Column, period: float) -> list[Column]:
    angle = v * (2 * 3.141592653589793 / period)
    return [F.sin(angle), F.cos(angle)]


def cyclic(d: Column, fraction_of_year: bool = False) -> Column:
    """8 numbers: sine and cosine of year, month, day, weekday.  The year's are 0 and 1, or of the fraction of the year."""
    year = _wave(F.dayofyear(d), 366) if fraction_of_year else [F.dayofyear(d) * 0.0, F.dayofyear(d) * 0.0 + 1.0]
    return F.array(*year, *_wave(F.month(d), 12), *_wave(F.dayofmonth(d), 31), *_wave(day_of_week(d), 7))


def season(d: Column) -> Column:
    m = F.month(d)
    return F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").when(m.isin(9, 10, 11), "fall")


def season_one_hot(d: Column) -> Column:
    return F.array(*[F.when(season(d) == s, 1.0).otherwise(0.0) for s in ("winter", "spring", "summer", "fall")])


def calendar(d: Column) -> dict[str, Column]:
    """The 14 calendar features; weekday 0 is Monday here."""
    day = d.cast("date")
    is_ = lambda c: c.cast("int")
    next_day = F.date_add(day, 1)
    return {
        "year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d), "day_of_week": F.weekday(d), "day_of_year": F.dayofyear(d), "week_of_year": F.weekofyear(d), "quarter": F.quarter(d),
        "is_weekend": is_(F.weekday(d) >= 5), "is_month_start": is_(F.dayofmonth(d) == 1), "is_month_end": is_(day == F.last_day(day)),
        "is_quarter_start": is_(day == F.trunc(day, "quarter")), "is_quarter_end": is_(next_day == F.trunc(next_day, "quarter")),
        "is_year_start": is_(F.dayofyear(d) == 1), "is_year_end": is_(next_day == F.trunc(next_day, "year")),
    }


def normalised(d: Column) -> dict[str, Column]:
    return {"year": (F.year(d) - 2000) / 30, "month": (F.month(d) - 1) / 11, "day": (F.dayofmonth(d) - 1) / 30, "day_of_week": F.weekday(d) / 6, "day_of_year": (F.dayofyear(d) - 1) / 365, "week_of_year": (F.weekofyear(d) - 1) / 52, "quarter": (F.quarter(d) - 1) / 3}


def waves(d: Column, parts: Sequence[str] = tuple(PERIODS)) -> dict[str, Column]:
    """part_sin and part_cos of each part; weekdays count from 1 here."""
    unknown = set(parts) - set(PERIODS)
    if unknown:
        raise ValueError(f"no such calendar part: {sorted(unknown)}")
    value = {"month": F.month(d), "day": F.dayofmonth(d), "day_of_week": F.weekday(d) + 1, "day_of_year": F.dayofyear(d), "week_of_year": F.weekofyear(d), "quarter": F.quarter(d), "hour": F.hour(d), "minute": F.minute(d), "second": F.second(d)}
    out = {}
    for p in parts:
        out[f"{p}_sin"], out[f"{p}_cos"] = _wave(value[p], PERIODS[p])
    return out


def since(d: Column, reference: str, unit: str = "days") -> Column:
    """Days, weeks, hours or years (of 365.25 days) from the reference date on."""
    days = F.datediff(d, F.lit(reference).cast("date"))
    return {"days": days, "weeks": days / 7, "hours": days * 24, "years": days / 365.25}[unit]
