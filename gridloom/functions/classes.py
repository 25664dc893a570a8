"""Class codes, crosswalks and rule lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reference land-cover codes to 8 classes (0 water, 1 wetland, 2 forest, 3 shrub and grass, 4 agriculture, 5 low and 6 high development, 7 barren).
CROSSWALK_8 = {11: 0, 90: 1, 95: 1, 41: 2, 42: 2, 43: 2, 51: 3, 52: 3, 71: 3, 72: 3, 73: 3, 74: 3, 81: 4, 82: 4, 21: 5, 22: 5, 23: 6, 24: 6, 31: 7}
# Reference codes to 12 classes, counted from 1.
CROSSWALK_12 = {11: 1, 12: 1, 90: 3, 95: 2, 41: 5, 42: 4, 43: 5, 52: 6, 71: 7, 72: 7, 73: 7, 74: 7, 81: 8, 82: 8, 21: 9, 22: 9, 23: 10, 24: 10, 31: 12}
# Classes that a pixel of a class may be in a year later.
ALLOWED = {0: (0, 1, 7), 1: (0, 1, 2, 3), 2: (1, 2, 3, 4, 5), 3: (1, 2, 3, 4, 5, 7), 4: (3, 4, 5, 7), 5: (5, 6), 6: (6,), 7: (3, 4, 5, 7)}
# Flood zones of high risk.
HIGH_RISK_ZONES = ("A", "AE", "AH", "AO", "AR", "A99", "V", "VE")


def transition_code(before: Column, after: Column, classes: int) -> Column:
    """before * classes + after, -1 if nothing changed."""
    return F.when(before == after, -1).otherwise(before * classes + after)


def crosswalk(code: Column, mapping: dict[int, int], default: int) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, code), F.lit(default))


def flood_category(zone: Column, subtype: Column) -> Column:
    """Category by rules in order: floodway, high-risk zone, 0.2 percent chance, other."""
    z, s = F.upper(F.trim(F.coalesce(zone, F.lit("")))), F.upper(F.trim(F.coalesce(subtype, F.lit(""))))
    return F.when(s.contains("FLOODWAY"), "floodway").when(z.isin(*HIGH_RISK_ZONES), "100-year").when(s.contains("0.2 PCT ANNUAL CHANCE"), "500-year").otherwise("other")


def season(month: Column) -> Column:
    """0 winter (12, 1, 2) to 3 autumn."""
    return F.floor((month % 12) / 3).cast("int")


def month_of(iso: Column) -> Column:
    """Month of an ISO date text; 0 if it is none."""
    return F.coalesce(F.month(F.try_to_date(iso)), F.lit(0))


# Index above which ground counts as built, low and high.
BUILT_LOW, BUILT_HIGH = 0.05, 0.05 + 0.10


def pseudo_label(ndvi: Column, evi: Column, ndwi: Column, mndwi: Column, ndbi: Column, bsi: Column) -> Column:
    """Class by rules of which the last that holds counts; shrub and grass where none does. The bounds are fixed values."""
    water = (ndwi > 0.10) | (mndwi > 0.10)
    forest = ~water & (ndvi > 0.50) & (evi > 0.3)
    built = (ndbi > BUILT_HIGH) & (ndvi < 0.25)
    return (
        F.when((bsi > 0.15) & (ndvi < 0.25) & ~built, 7)
        .when(~built & (ndbi > BUILT_LOW) & (ndvi < 0.50), 5)
        .when(built, 6)
        .when(~water & ~forest & (ndvi > 0.35) & (evi > 0.2) & (evi < 0.4), 4)
        .when(~water & ~forest & (ndvi > 0.25) & (ndvi <= 0.50), 3)
        .when(forest, 2)
        .when(~water & (ndwi > 0.0) & (ndvi > 0.15) & (ndvi < 0.45), 1)
        .when(water, 0)
        .otherwise(3)
    )


def risk_level(zone: Column) -> Column:
    z = F.upper(F.trim(F.coalesce(zone, F.lit(""))))
    return F.when(z.isin(*HIGH_RISK_ZONES), "high").when(z == "X", "moderate").when(z == "D", "undetermined").otherwise("minimal")
