"""Reflectance scaling, cloud masks and radar radiometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.guards import clip, ratio

# OLI to TM coefficients (slope, intercept) by band.
HARMONISE = {"blue": (0.8474, 0.0003), "green": (0.8483, 0.0088), "red": (0.9047, 0.0061), "nir": (0.8462, 0.0412), "swir1": (0.8937, 0.0254), "swir2": (0.9071, 0.0172)}


# Bits of the quality band.
FILL, DILATED, CLOUD, SHADOW, CLEAR = 0, 1, 3, 4, 6
# Scene classes that are clear ground, and those that are not to be used.
CLEAR_CLASSES, BAD_CLASSES = (4, 5, 6, 7), (1, 2, 3, 7, 8, 9, 10, 11)


def landsat_reflectance(dn: Column) -> Column:
    return clip(dn * 2.75e-5 - 0.2, 0, 1)


def sentinel2_reflectance(dn: Column, clipped: bool = True) -> Column:
    scaled = dn / 10000.0
    return clip(scaled, 0, 1) if clipped else scaled


def naip_reflectance(dn: Column) -> Column:
    return clip(dn / 255.0, 0, 1)


def harmonise(band: str, value: Column, platform: Column) -> Column:
    """OLI sensors (LC08, LC09) to the TM scale; other platforms as they are."""
    slope, intercept = HARMONISE[band]
    return F.when(platform.isin("LC08", "LC09"), value * slope + intercept).otherwise(value)


def bit(qa: Column, n: int) -> Column:
    return F.getbit(qa, F.lit(n)) == 1


def landsat_clear(qa: Column) -> Column:
    """Clear flag set, and neither dilated cloud, cloud nor cloud shadow."""
    return bit(qa, CLEAR) & ~bit(qa, DILATED) & ~bit(qa, CLOUD) & ~bit(qa, SHADOW)


def landsat_bad(qa: Column) -> Column:
    """Cloud, cloud shadow or fill."""
    return bit(qa, CLOUD) | bit(qa, SHADOW) | bit(qa, FILL)


def scene_class_clear(scl: Column, keep: tuple[int, ...] = CLEAR_CLASSES) -> Column:
    return scl.isin(*keep)


def scene_class_bad(scl: Column, drop: tuple[int, ...] = BAD_CLASSES) -> Column:
    return scl.isin(*drop)


def to_db(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Linear to decibel, from 1e-10 up; optionally clipped."""
    db = 10 * F.log10(F.when(x.isNotNull(), F.greatest(x, F.lit(1e-10))))
    return db if low is None else clip(db, low, high)


def from_db(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10)


def water_index_absolute(vv: Column) -> Column:
    return 1 - clip(vv, 0, 0.1) / 0.1


def water_index_relative(vv: Column, vh: Column) -> Column:
    return ratio(vh - vv, vh + vv)


def cross_ratio_linear(vv: Column, vh: Column) -> Column:
    return clip(ratio(vh, F.greatest(vv, F.lit(1e-10))), 0, 2)


def cross_ratio_db(vv_db: Column, vh_db: Column, limit: float | None = None) -> Column:
    d = vh_db - vv_db
    return d if limit is None else clip(d, -limit, limit)


def total_power_db(vv_db: Column, vh_db: Column) -> Column:
    return 10 * F.log10(from_db(vv_db) + from_db(vh_db) + 1e-20)


def sar_masks(vv_db: Column, vh_db: Column) -> dict[str, Column]:
    """Open water, buildings and forest by backscatter."""
    return {"water": vv_db < -15, "building": vv_db > -5, "forest": vh_db - vv_db > -6}
