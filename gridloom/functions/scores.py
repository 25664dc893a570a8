"""Scores, fusions and rules over per-pixel or per-feature measures."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.guards import clip, ratio, sigmoid

Z95 = 1.959963984540054


def susceptibility(hand: Column, slope: Column) -> Column:
    return sigmoid(-(hand / 5 - 1)) * sigmoid(-(slope / 3 - 1))


def ndsm_building(height: Column, ndvi: Column) -> Column:
    return sigmoid(2 * (height - 2.5)) * (1 - clip(ndvi, 0, 1))


def binary_entropy(p: Column) -> Column:
    q = clip(p, 1e-7, 1 - 1e-7)
    return -q * F.log2(q) - (1 - q) * F.log2(1 - q)


def softmax(scores: Column, temperature: float = 1.0) -> Column:
    """Softmax of an array; null and empty arrays stay."""
    shifted = F.transform(scores, lambda x: F.exp((x - F.array_max(scores)) * temperature))
    return F.transform(F.array(shifted), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))[0]


def argmax(values: Column) -> Column:
    """Index from 0 of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def entropy_share(p: Column) -> Column:
    """Entropy of an array of shares over the largest possible one."""
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log2(x)).otherwise(0.0)) / F.log2(F.size(p).cast("double"))


def flood_zone(frequency: Column, hand: Column | None = None, permanent: float = 0.85, seasonal: float = 0.20, rare: float = 0.05, low_hand: float = 5.0, low_share: float = 0.5) -> Column:
    """3 permanent, 2 seasonal, 1 rare, 0 dry; low ground turns permanent earlier; no observation is dry."""
    zone = F.when(frequency >= permanent, 3)
    if hand is not None:
        zone = zone.when((hand < low_hand) & (frequency >= low_share), 3)
    return zone.when(frequency >= seasonal, 2).when(frequency >= rare, 1).otherwise(0)


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval of k of n; null without observations."""
    p = F.try_divide(k.cast("double"), n)
    d = 1 + F.try_divide(F.lit(z * z), n)
    centre = p + F.try_divide(F.lit(z * z / 2), n)
    half = z * F.sqrt(F.greatest(F.try_divide(p * (1 - p) + F.try_divide(F.lit(z * z / 4), n), n), F.lit(0.0)))
    return clip((centre - half) / d, 0, 1), clip((centre + half) / d, 0, 1)


def fuse(parts: dict[str, tuple[Column, float]], renormalise: bool = False) -> Column:
    """Weighted sum of scores; with renormalise the weights of null scores are shared out, else weights must sum to 1 within .01."""
    if not renormalise:
        if not math.isclose(sum(w for _, w in parts.values()), 1, abs_tol=0.01):
            raise ValueError("weights must sum to 1")
        return sum((c * w for c, w in parts.values()), F.lit(0.0))
    total = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts.values()), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts.values()), F.lit(0.0))
    return ratio(total, weight)


def model_average(quantum: Column, svm: Column, boost: Column, confidence: Column) -> Column:
    """Bayesian model average of three water probabilities, weighted by confidence and agreement."""
    wq, ws, wg = 0.40 * confidence, 0.35 * (1 - F.abs(svm - quantum)), F.lit(0.25)
    return (wq * quantum + ws * svm + wg * boost) / (wq + ws + wg)


def adjust_posterior(p: Column, hard_urban: Column, soft_urban: Column, sar_building: Column, sar_water: Column, suscept: Column, terrain_ok: Column) -> Column:
    """Rules on a water probability, in order: urban masks, radar evidence, terrain."""
    # Rules that scale are factors, so that the probability, which may be a long expression, is named once.
    p = F.when(hard_urban, 0.0).otherwise(p * F.when(soft_urban, 0.3).otherwise(1.0)) * F.when(sar_building, 0.1).otherwise(1.0)
    p = F.when(sar_water & (p > 0.2), F.least(p * 1.4, F.lit(1.0))).otherwise(p)
    p = p * suscept
    return clip(F.when(terrain_ok, p).otherwise(0.0), 0, 1)


def stability(mean: Column, std: Column, floor: float = 0.70, rescaled: bool = False) -> Column:
    """1 - coefficient of variation, from the floor to 1; or rescaled so that the floor is 0."""
    s = 1 - clip(std / F.greatest(mean, F.lit(1e-10)), 0, 1)
    return clip((s - floor) / (1 - floor), 0, 1) if rescaled else clip(s, floor, 1)


def pol_ratio(vv: Column, vh: Column, low: float = 0.02, high: float = 0.30, descending: bool = False) -> Column:
    """VH over VV (linear) between two bounds as 0..1; descending: 1 where VV stands out."""
    s = clip((vh / F.greatest(vv, F.lit(1e-10)) - low) / (high - low + 1e-10), 0, 1)
    return 1 - s if descending else s


# Weights of the eight structure indicators, the ten building features and the four canopy evidences.
STRUCTURE_WEIGHTS = {"stability": 0.18, "pol_ratio": 0.12, "texture": 0.12, "anomaly": 0.13, "optical": 0.10, "entropy": 0.13, "coherence": 0.12, "seasonal": 0.10}
BUILDING_WEIGHTS = {"mbi": 0.14, "contrast": 0.10, "edge": 0.06, "non_veg": 0.08, "shadow_prox": 0.04, "ndsm": 0.22, "glcm": 0.10, "attr_profile": 0.08, "osm_prior": 0.10, "shadow_pair": 0.08}
CANOPY_WEIGHTS = {"lidar_penetration": 0.35, "sar_double_bounce": 0.30, "thermal_anomaly": 0.20, "hand_inundation": 0.15}


def confidence_zone(score: Column, high: float = 0.65, moderate: float = 0.45, values: tuple[int, int, int] = (0, 2, 3)) -> Column:
    return F.when(score >= high, values[2]).when(score >= moderate, values[1]).otherwise(values[0])


def compactness(area: Column, perimeter: Column) -> Column:
    return F.least(ratio(4 * math.pi * area, perimeter * perimeter), F.lit(1.0))


def building_score(rectangularity: Column, compact: Column, solidity: Column, edge: Column, prob: Column, ndwi: Column, area: Column) -> Column:
    """Footprint score of seven parts, each scaled to its typical building."""
    part = lambda x, full: F.least(x / full, F.lit(1.0))
    size = F.when(area < 30, 0.1).when(area <= 5000, 1.0).when(area <= 20000, F.greatest(1 - (area - 5000) / 15000, F.lit(0.0))).otherwise(0.0)
    dry = F.greatest(1 - F.greatest(ndwi, F.lit(0.0)) * 5, F.lit(0.0))
    return 0.18 * part(rectangularity, 0.70) + 0.14 * part(compact, 0.50) + 0.14 * part(solidity, 0.75) + 0.13 * part(edge, 0.1) + 0.13 * size + 0.12 * part(prob, 0.60) + 0.16 * dry


# Base weights of the water indices by sensor, and their seasonal factors by month.
ATTENTION = {"landsat": (0.30, 0.35, 0.35), "sentinel2": (0.35, 0.30, 0.35), "naip": (0.70, 0.15, 0.15)}
SEASONAL = [(0.7, 1.2, 1.3), (0.7, 1.2, 1.3), (0.9, 1.1, 1.1), (0.9, 1.1, 1.1), (0.9, 1.1, 1.1), (0.6, 1.3, 1.4), (0.5, 1.4, 1.5), (0.5, 1.4, 1.5), (0.6, 1.3, 1.4), (0.8, 1.1, 1.2), (0.8, 1.1, 1.2), (0.7, 1.2, 1.3)]


def attention(sensor: Column, month: Column) -> Column:
    """Weights of NDWI, MNDWI and AWEI (array) of a sensor in a month; unknown sensors as landsat, month 0 without season."""
    base = F.when(sensor == "naip", _array(ATTENTION["naip"])).when(sensor == "sentinel2", _array(ATTENTION["sentinel2"])).otherwise(_array(ATTENTION["landsat"]))
    season = F.coalesce(F.try_element_at(F.array(*[_array(s) for s in SEASONAL]), F.when(month.between(1, 12), month)), _array((1.0, 1.0, 1.0)))
    powers = F.transform(F.zip_with(base, season, lambda w, m: w * m), lambda x: F.exp(3 * x))
    return F.transform(F.array(powers), lambda e: F.transform(e, lambda x: x / (e[0] + e[1] + e[2])))[0]


def _array(values: tuple[float, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lidar_evidence(penetration: Column, height: Column, forest: Column) -> Column:
    return F.when((height > 5) & forest, clip(penetration / 0.35, 0, 1)).otherwise(0.0)


def double_bounce_evidence(vv_db: Column, forest: Column) -> Column:
    return F.when(forest & (vv_db > -8), clip((vv_db + 8) / 8, 0, 1)).otherwise(0.0)


def thermal_evidence(z: Column, forest: Column) -> Column:
    return F.when(forest & (z > 1.5), clip((z - 1.5) / 2, 0, 1)).otherwise(0.0)


def inundation_evidence(vv_db: Column, hand: Column, forest: Column) -> Column:
    return F.when(forest & (hand < 2) & (vv_db < -15), clip((-15 - vv_db) / 5 * (1 - hand / 2), 0, 1)).otherwise(0.0)
