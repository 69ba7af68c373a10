"""Geodesy, projection and text of places, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth in km, decay of the game score in km,
#: the latitude at which the map is cut, kilometres of a degree of longitude at
#: the equator and of latitude.
EARTH_KM, SCORE_KM, CUT_LATITUDE, LON_KM, LAT_KM = 6371.0088, 1492.7, 85.05112878, 111.320, 110.574
#: Largest zoom; margin of the screen in pixels; the steps of the scale bar in km; fixed values.
ZOOM_MAX, MARGIN_PX = 11.0, 200.0
SCALE_STEPS_KM = [0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0, 1000.0, 2000.0, 5000.0]


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    return F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2.0)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(clamp(half, 0.0, 1.0)))


def game_score(km: Column) -> Column:
    """The most points are a fixed value."""
    return 5000.0 * F.exp(-km / SCORE_KM)


def mercator_y(lat: Column) -> Column:
    """Northing in degrees, latitude cut at both ends."""
    return F.degrees(F.log(F.tan(F.lit(math.pi / 4) + F.radians(clamp(lat, -CUT_LATITUDE, CUT_LATITUDE)) / 2)))


def mercator_lat(y: Column) -> Column:
    return F.degrees(2.0 * F.atan(F.exp(F.radians(y))) - math.pi / 2)


def unit_xyz(lat: Column, lon: Column) -> Column:
    phi, lam = F.radians(lat), F.radians(lon)
    return F.array(F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi))


def wrap_lon(lon: Column) -> Column:
    """Into -180 to 180; both ends stay what they are."""
    turned = F.pmod(lon + 180.0, F.lit(360.0)) - 180.0
    return F.when(lon.between(-180.0, 180.0), lon).when((turned == -180.0) & (lon > 0), F.lit(180.0)).otherwise(turned)


def format_km(km: Column) -> Column:
    """Whole metres below 1 km, then fewer and fewer places."""
    return (
        F.when(km < 1.0, F.format_string("%d m", (km * 1000).cast("int")))
        .when(km < 10.0, F.format_string("%.2f km", km))
        .when(km < 1000.0, F.format_string("%.1f km", km))
        .otherwise(F.format_string("%,.0f km", km))
    )


def format_lat_lon(lat: Column, lon: Column) -> Column:
    """Five places and a letter; 0 counts as north and east."""
    ns, ew = F.when(lat >= 0, "N").otherwise("S"), F.when(lon >= 0, "E").otherwise("W")
    return F.format_string("%.5f°%s, %.5f°%s", F.abs(lat), ns, F.abs(lon), ew)


def clamp_zoom(zoom: Column, width: Column, height: Column) -> Column:
    """Between the zoom at which the world fills the height, and the largest."""
    return clamp(zoom, F.log2(F.greatest(F.lit(1.0), height / width)), ZOOM_MAX)


def pixels_per_unit(zoom: Column, width: Column) -> Column:
    return width * F.pow(F.lit(2.0), zoom) / 360.0


def northing_limit(zoom: Column, width: Column, height: Column) -> Column:
    """How far the centre may move before a pole leaves a gap."""
    ppu = pixels_per_unit(zoom, width)
    return F.when(ppu <= 0, 180.0).otherwise(F.greatest(F.lit(0.0), 180.0 - height / F.nullif(ppu, F.lit(0.0)) / 2))


def spread_zoom(span: Column, lat: Column, width: Column, height: Column) -> Column:
    """The zoom that frames four times the span of the answers; its limits are fixed values."""
    stretch = 1.0 / F.greatest(F.cos(F.radians(lat)), F.lit(0.15))
    return clamp_zoom(F.log2(360.0 / (clamp(span * 4, 3.6, 120.0) * stretch)), width, height)


def project(lat: Column, lon: Column, centre_lon: Column, centre_y: Column, ppu: Column, width: Column, height: Column) -> Column:
    """Screen coordinates (x, y), null beyond the margin."""
    x = width / 2 + wrap_lon(lon - centre_lon) * ppu
    y = height / 2 - (mercator_y(lat) - centre_y) * ppu
    seen = x.between(-MARGIN_PX, width + MARGIN_PX) & y.between(-MARGIN_PX, height + MARGIN_PX)
    return F.when(seen, F.struct(x.alias("x"), y.alias("y")))


def scale_bar_km(km_per_px: Column, target_px: float = 88.0) -> Column:
    """The first step at least as long as the target (a fixed value), else the last."""
    steps = F.array(*map(F.lit, SCALE_STEPS_KM))
    return F.coalesce(F.get(F.filter(steps, lambda s: s / km_per_px >= target_px), 0), F.lit(SCALE_STEPS_KM[-1]))


def scale_bar_px(km_per_px: Column) -> Column:
    """The longest bar is a fixed value."""
    return F.least(scale_bar_km(km_per_px) / km_per_px, F.lit(220.0))


def km_per_pixel(lat: Column, ppu: Column) -> Column:
    return LON_KM * F.cos(F.radians(lat)) / ppu


def segment_km(lat: Column, lon: Column, edge: Column, ky: float = LAT_KM) -> Column:
    """Distance to an edge (x1, y1, x2, y2) in degrees, on a local plane."""
    kx = LON_KM * F.cos(F.radians(lat))
    ax, ay = (edge["x1"] - lon) * kx, (edge["y1"] - lat) * ky
    dx, dy = (edge["x2"] - edge["x1"]) * kx, (edge["y2"] - edge["y1"]) * ky
    length = dx * dx + dy * dy
    t = clamp(-(ax * dx + ay * dy) / F.when(length == 0, 1.0).otherwise(length), 0.0, 1.0)
    return F.sqrt(F.pow(ax + t * dx, 2.0) + F.pow(ay + t * dy, 2.0))


def crosses(lat: Column, lon: Column, edge: Column) -> Column:
    """Whether a ray to the east crosses the edge."""
    span = F.nullif(edge["y2"] - edge["y1"], F.lit(0.0))
    at = edge["x1"] + (lat - edge["y1"]) * (edge["x2"] - edge["x1"]) / span
    return ((edge["y1"] > lat) != (edge["y2"] > lat)) & F.coalesce(lon < at, F.lit(False))


def confidence_tier(confidence: Column) -> Column:
    """The bounds are fixed values."""
    return F.when(confidence >= 0.7, "good").when(confidence >= 0.4, "warn").otherwise("dim")


def confidence_text(confidence: Column, hit_km: float = 25.0) -> Column:
    return F.format_string(f"%d%% within {hit_km:.0f} km", F.floor(confidence * 100 + 0.5).cast("int"))


def country_rank_at(zoom: Column) -> Column:
    """The largest label rank of countries shown at a zoom, null if none are; fixed steps."""
    return F.when(zoom < 2.4, 3).when(zoom < 4.5, 5).when(zoom < 14, 7)


def place_rank_at(zoom: Column) -> Column:
    """The largest rank of places shown at a zoom, null if none are; fixed steps."""
    steps = [(5, 1), (10, 2), (22, 3), (50, 4), (100, 6), (220, 7), (520, 8)]
    out = F.when(zoom < 2.6, F.lit(None).cast("int"))
    for below, rank in steps:
        out = out.when(zoom < below, rank)
    return out.otherwise(10)


def time_left(bytes_left: Column, per_second: Column) -> Column:
    """Seconds or minutes; the bounds and the words are fixed values."""
    seconds = (bytes_left / per_second).cast("int")
    text = F.when(seconds < 90, F.format_string("%ds left", seconds)).otherwise(F.format_string("%d min left", F.floor((seconds + 30) / 60).cast("int")))
    return F.when(per_second > 1e4, text)


def gigabytes(n: Column) -> Column:
    """Decimal gigabytes to two places."""
    return F.format_string("%.2f", n / 1e9)


def progress_text(done: Column, total: Column) -> Column:
    """The words are fixed values."""
    return F.concat(F.lit("Downloading — "), gigabytes(done), F.lit(" of "), gigabytes(total), F.lit(" GB"))


def speed_text(per_second: Column) -> Column:
    """Whole megabytes a second; null while too slow to say."""
    return F.when(per_second > 1e4, F.format_string("%.0f MB/s", per_second / 1e6))


def fraction_done(done: Column, total: Column) -> Column:
    return clamp(F.coalesce(F.try_divide(done.cast("double"), total), F.lit(0.0)), 0.0, 1.0)


def saturating_progress(seconds: Column) -> Column:
    """Decay and ceiling are fixed values."""
    return clamp(1.0 - F.exp(-seconds / 3.4), 0.0, 0.97)


def quantise_degrees(deg: Column) -> Column:
    """Microdegrees, cut at 180 degrees on either axis."""
    return clamp(F.rint(deg * 1e6), -180e6, 180e6).cast("int")
