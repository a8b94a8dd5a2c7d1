"""Solar position and clear-sky irradiance as plain Column expressions.

Declination, equation of time and refraction follow the published low-order Fourier
formulae; their error against a full ephemeris is a few hundredths of a degree. The
apparent elevation drives both the daylight flag and the clear-sky model.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ..schema import (EXTRATERRESTRIAL, LINKE_TURBIDITY, MAX_CLEAR_INDEX, MIN_CLEAR_REFERENCE,
                      UTC_OFFSET_HOURS)


def _fourier(angle: Column, constant: float, terms: list[tuple[float, float]]) -> Column:
    total = F.lit(constant)
    for k, (c, s) in enumerate(terms, start=1):
        total = total + c * F.cos(k * angle) + s * F.sin(k * angle)
    return total


def year_angle(time: Column) -> Column:
    hour = F.hour(time) + F.minute(time) / 60.0 + F.second(time) / 3600.0
    return F.lit(2 * math.pi / 365.0) * (F.dayofyear(time) - 1 + (hour - 12) / 24.0)


def declination(angle: Column) -> Column:
    return _fourier(angle, 0.006918, [(-0.399912, 0.070257), (-0.006758, 0.000907),
                                      (-0.002697, 0.00148)])


def equation_of_time(angle: Column) -> Column:
    """Minutes by which the sundial runs ahead of the clock."""
    return 229.18 * _fourier(angle, 0.000075, [(0.001868, -0.032077), (-0.014615, -0.040849)])


def hour_angle(time: Column, angle: Column, longitude: Column,
               utc_offset: float = UTC_OFFSET_HOURS) -> Column:
    """Degrees, zero at solar noon."""
    clock = F.hour(time) * 60 + F.minute(time) + F.second(time) / 60.0
    solar = clock + equation_of_time(angle) + 4.0 * longitude - 60.0 * utc_offset
    return solar / 4.0 - 180.0


def true_elevation(latitude: Column, tilt: Column, turn: Column) -> Column:
    """Degrees from latitude (degrees), declination and hour angle (radians)."""
    place = F.radians(latitude)
    return F.degrees(F.asin(F.sin(place) * F.sin(tilt)
                            + F.cos(place) * F.cos(tilt) * F.cos(turn)))


def azimuth(latitude: Column, tilt: Column, turn: Column) -> Column:
    """Degrees clockwise from north."""
    place = F.radians(latitude)
    south = F.atan2(F.sin(turn), F.cos(turn) * F.sin(place) - F.tan(tilt) * F.cos(place))
    return F.degrees(south) + 180.0


def refraction(elevation: Column) -> Column:
    """Degrees to add to a true elevation."""
    slope = F.tan(F.radians(elevation))
    high = 58.1 / slope - 0.07 / F.pow(slope, 3) + 0.000086 / F.pow(slope, 5)
    low = 1735 + elevation * (-518.2 + elevation * (103.4 + elevation * (
        -12.79 + elevation * 0.711)))
    seconds = (F.when(elevation > 85, F.lit(0.0)).when(elevation > 5, high)
               .when(elevation > -0.575, low).otherwise(-20.772 / slope))
    return seconds / 3600.0


def apparent_elevation(true_elevation: Column) -> Column:
    return true_elevation + refraction(true_elevation)


def clear_sky(elevation: Column, altitude: Column,
              turbidity: float = LINKE_TURBIDITY) -> Column:
    """Ineichen-Perez global horizontal irradiance; zero below the horizon."""
    zenith = F.least(F.greatest(90.0 - elevation, F.lit(0.0)), F.lit(89.9))
    cosine = F.cos(F.radians(zenith))
    fh1, fh2 = F.exp(-altitude / 8000.0), F.exp(-altitude / 1250.0)
    cg1, cg2 = 5.09e-5 * altitude + 0.868, 3.92e-5 * altitude + 0.0387
    depth = cg2 * (1.0 / cosine) * (fh1 + fh2 * (turbidity - 1.0))
    return (F.when(elevation <= 0, F.lit(0.0))
            .otherwise(cg1 * EXTRATERRESTRIAL * cosine * F.exp(-depth)))


def clearness(ghi: Column, clear: Column, daylight: Column,
              minimum: float = MIN_CLEAR_REFERENCE) -> Column:
    return F.when(daylight & (clear > minimum), ghi / clear)


def scaled_clearness(kt: Column, scale: Column, top: float = MAX_CLEAR_INDEX) -> Column:
    ratio = kt / scale
    return F.when(ratio.isNotNull(), F.least(F.greatest(ratio, F.lit(0.0)), F.lit(top)))
