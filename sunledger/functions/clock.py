"""Grid positions and local clock columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import STEP_SECONDS


def bin_end(time: Column, seconds: int = STEP_SECONDS) -> Column:
    """Grid position of the right-closed bin that holds a time: 12:00 covers (11:45, 12:00]."""
    width = F.lit(seconds * 1_000_000)
    reach = F.unix_micros(time.cast("timestamp")) + width - 1
    return ((reach - F.pmod(reach, width)) / width).cast("long")


def step_of(time: Column, seconds: int = STEP_SECONDS) -> Column:
    """Grid position of a time that lies on the grid."""
    return F.floor(F.unix_seconds(time.cast("timestamp")) / F.lit(seconds))


def instant(step: Column, seconds: int = STEP_SECONDS) -> Column:
    return F.timestamp_seconds(step * F.lit(seconds))


def stamp(step: Column, seconds: int = STEP_SECONDS) -> Column:
    """Zone-free timestamp of a grid position."""
    return instant(step, seconds).cast("timestamp_ntz")


def hour_float(time: Column) -> Column:
    return F.hour(time) + F.minute(time) / F.lit(60.0)


def year_progress(time: Column) -> Column:
    """(day of year - 1) over the length of the year."""
    year = F.year(time)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return (F.dayofyear(time) - 1) / F.when(leap, F.lit(366.0)).otherwise(F.lit(365.0))


def season(time: Column, title: bool = True) -> Column:
    names = ("Winter", "Spring", "Summer", "Autumn")
    winter, spring, summer, autumn = names if title else [n.lower() for n in names]
    month = F.month(time)
    return (F.when(month.isin(12, 1, 2), winter).when(month.isin(3, 4, 5), spring)
            .when(month.isin(6, 7, 8), summer).otherwise(autumn))
