"""Felt temperature and temperature bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import kmh


def either(cond: Column, yes: Column, no: Column) -> Column:
    """Two-way choice that is NULL when the condition is NULL."""
    return F.when(cond, yes).when(~cond, no)


# Fixed values below: the constants of the public humidex and wind-chill formulas.
def vapour_pressure(dewp_kelvin: Column) -> Column:
    exponent = F.lit(5417.753) * (F.lit(1.0) / F.lit(273.16) - F.lit(1.0) / dewp_kelvin)
    return F.lit(6.11) * F.exp(exponent)


def humidex_excess(dewp_kelvin: Column) -> Column:
    return F.lit(5.0) / F.lit(9.0) * (vapour_pressure(dewp_kelvin) - F.lit(10.0))


def wind_chill(temp: Column, wind_kmh: Column) -> Column:
    w = F.pow(wind_kmh, F.lit(0.16))
    return (F.lit(13.12) + F.lit(0.6215) * temp - F.lit(11.37) * w
            + F.lit(0.3965) * temp * w)


def low_wind_chill(temp: Column, wind_ms: Column) -> Column:
    return temp + (F.lit(-1.59) + F.lit(0.1345) * temp) / F.lit(5.0) * wind_ms


def perceived_temp(variant: str = "a", temp: str = "max_temp",
                   wind: str = "average_wind_speed", dewp: str = "dewp") -> Column:
    """Felt temperature.

    ``a``: wind chill when cold and windy, humidex when warm and humid.
    ``b``: the second published form; its last step overwrites the wind chill
    and compares the dew point (in kelvin) with 10.
    ``b_intended``: the same form with both slips undone.
    """
    t, ms, d = F.col(temp), F.col(wind), F.col(dewp)
    wind_kmh = kmh(ms)
    humid = t + humidex_excess(d)
    if variant == "a":
        return either((t <= 0) & (wind_kmh >= 5), wind_chill(t, wind_kmh),
                      either((t > 20) & (d >= 283), humid, t))
    if variant == "b":
        return either((t >= 20) & (d >= 10), humid, t)
    if variant == "b_intended":
        chilled = either((t <= 0) & (wind_kmh >= 5), wind_chill(t, wind_kmh),
                         either((t < 0) & (wind_kmh >= 0) & (wind_kmh <= 5),
                                low_wind_chill(t, ms), t))
        return either((t >= 20) & (d >= 283), humid, chilled)
    raise ValueError(f"unknown variant {variant!r}")


def temp_bands(temp: Column, with_hot: bool = False) -> dict[str, Column]:
    bands = {
        "freeze": temp < 0,
        "cold_0_to_10": (temp >= 0) & (temp < 10),
        "cool_10_to_20": (temp >= 10) & (temp < 20),
        "warm_20_to_30": (temp >= 20) & (temp < 30),
    }
    if with_hot:
        bands["hot_30_plus"] = temp >= 30
    return bands
