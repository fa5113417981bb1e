"""Day, week, session and window keys of bar times (epoch milliseconds, UTC; the local day is UTC+10)."""

from pyspark.sql import Column, functions as F

HOUR, DAY = 3_600_000, 86_400_000
LOCAL_SHIFT = 10 * HOUR
#: UTC hours of each session (they overlap), local hours of each trade window and each session phase.
SESSIONS = {"asia": (0, 8), "london": (7, 16), "ny": (12, 21)}
WINDOWS = {"asia": (9, 12), "mid": (12, 16), "london": (16, 19), "ny": (21, 24)}
PHASES = {"overnight": (0, 9), "open": (9, 12), "lunch": (12, 14), "middle": (14, 18), "close": (18, 24)}


def _floor(x: Column, width: int) -> Column:
    return F.floor(x / F.lit(width)).cast("long")


def day_utc(t: Column) -> Column:
    return _floor(t, DAY)


def week_utc(t: Column) -> Column:
    """Weeks begin on Monday."""
    return _floor(_floor(t, DAY) + 3, 7)


def day_local(t: Column) -> Column:
    return day_utc(t + LOCAL_SHIFT)


def week_local(t: Column) -> Column:
    return week_utc(t + LOCAL_SHIFT)


def hour_utc(t: Column) -> Column:
    return F.pmod(t, F.lit(DAY)) / F.lit(float(HOUR))


def hour_local(t: Column) -> Column:
    return hour_utc(t + LOCAL_SHIFT)


def weekday_utc(t: Column) -> Column:
    """0 for Monday."""
    return F.pmod(day_utc(t) + 3, F.lit(7)).cast("int")


def weekday_local(t: Column) -> Column:
    return weekday_utc(t + LOCAL_SHIFT)


def slot_utc(t: Column, minutes: int) -> tuple[Column, Column]:
    """Start of the slot of that many minutes, and whole minutes since."""
    start = _floor(t, minutes * 60_000) * (minutes * 60_000)
    return start, _floor(t - start, 60_000)


#: Zones of strict local minutes; the higher timeframe of each one.
ZONES = ("UTC", "America/New_York", "Europe/London", "Asia/Tokyo")
HIGHER = {"1m": "1h", "5m": "1h", "15m": "1h", "1h": "4h", "4h": "1d"}


def local_minute(date: Column, zone: str, minute: Column) -> tuple[Column, Column]:
    """(epoch ms, status) of a minute of the local day: ok, invalid, nonexistent (skipped by the clock) or ambiguous (there twice).

    Only for ZONES and the years 2000 to 2099; the time is null unless the status is ok.
    """
    if zone not in ZONES:
        raise ValueError(f"no strict local minutes for {zone}")
    wall = F.date_trunc("minute", date.cast("date").cast("timestamp_ntz")) + F.make_dt_interval(mins=minute.cast("int"))
    wall = wall.cast("timestamp_ntz")
    at = F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)
    back = lambda hours: F.convert_timezone(F.lit("UTC"), F.lit(zone), at + F.make_dt_interval(hours=F.lit(hours))) == wall
    known = date.isNotNull() & F.year(date).between(2000, 2099) & minute.between(0, 1439)
    status = F.when(~F.coalesce(known, F.lit(False)), "invalid").when(~back(0), "nonexistent").when(back(1) | back(-1), "ambiguous").otherwise("ok")
    ms = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at)
    return F.when(status == "ok", ms), status


def higher_timeframe(tf: Column, requested: Column | None = None) -> Column:
    """The timeframe above; requested: auto (as null or empty), none, or one by name. Null for none and for the chart's own."""
    own = F.lower(F.trim(tf))
    auto = F.create_map(*[F.lit(x) for pair in HIGHER.items() for x in pair])[own]
    if requested is None:
        return auto
    value = F.lower(F.trim(F.coalesce(requested, F.lit(""))))
    return F.when(value.isin("", "auto"), auto).when((value != "none") & (value != own), value)


def hour_new_york(t: Column) -> Column:
    """Hour of the day in New York, with its daylight-saving rules."""
    return F.hour(F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.timestamp_millis(t).cast("timestamp_ntz")))


def _named(hour: Column, table: dict[str, tuple[int, int]]) -> Column:
    out = F.lit(None).cast("string")
    for name, (a, b) in table.items():
        out = F.when((hour >= a) & (hour < b), name).otherwise(out)
    return out


def session_phase(t: Column) -> Column:
    return _named(hour_local(t), PHASES)


def trade_window(t: Column) -> Column:
    """Null outside all windows."""
    return _named(hour_local(t), WINDOWS)


def in_session(t: Column, name: str) -> Column:
    a, b = SESSIONS[name]
    return (hour_utc(t) >= a) & (hour_utc(t) < b)


def minutes_into_window(t: Column) -> Column:
    start = F.lit(None).cast("double")
    for a, b in WINDOWS.values():
        start = F.when((hour_local(t) >= a) & (hour_local(t) < b), float(a)).otherwise(start)
    return F.floor((hour_local(t) - start) * 60 + 1e-6).cast("long")


def window_segment(t: Column) -> Column:
    """open, middle or close: which hour of its window."""
    m = minutes_into_window(t)
    return F.when(m < 60, "open").when(m < 120, "middle").when(m < 180, "close")


def spans_weekend(start: Column, end: Column) -> Column:
    """Whether [start, end) touches a Saturday (UTC), or is a week or longer."""
    return (end - start >= 7 * DAY) | (_floor(day_utc(end - 1) - 2, 7) > _floor(day_utc(start) - 3, 7))
