"""Spectral indices: Column -> Column, each with the zero guard of its tool family."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.guards import clip, ratio


def difference(a: Column, b: Column, guard: str = "zero") -> Column:
    """(a - b) / (a + b)."""
    return ratio(a - b, a + b, guard)


def savi(nir: Column, red: Column, soil: float = 0.5, guard: str = "sentinel") -> Column:
    quotient = ratio(nir - red, nir + red + soil, guard)
    return F.when(nir + red + soil == 0, quotient).otherwise(quotient * (1 + soil)) if guard == "sentinel" else quotient * (1 + soil)


def evi(nir: Column, red: Column, blue: Column, guard: str = "sentinel") -> Column:
    den = nir + 6 * red - 7.5 * blue + 1
    quotient = ratio(2.5 * (nir - red), den, guard)
    return quotient


def awei_sh(green: Column, nir: Column, swir1: Column, swir2: Column) -> Column:
    return 4 * (green - swir1) - (0.25 * nir + 2.75 * swir2)


def bare_soil(blue: Column, red: Column, nir: Column, swir1: Column, guard: str = "zero") -> Column:
    return difference(swir1 + red, nir + blue, guard)


def water_ratio(green: Column, red: Column, nir: Column, swir1: Column) -> Column:
    return ratio(green + red, nir + swir1, "zero")


def eps_difference(a: Column, b: Column) -> Column:
    """Difference index with 1e-8 on the denominator, clipped to [-1, 1]."""
    return clip(ratio(a - b, a + b, "eps"), -1, 1)


@dataclass(frozen=True)
class Index:
    """A named index, the bands it needs, and its expression over them."""

    name: str
    bands: tuple[str, ...]
    compute: Callable[..., Column]


#: The user-facing indices; NDVI, NDWI, SAVI and EVI mark a zero denominator with the sentinel.
REGISTRY: dict[str, Index] = {
    i.name: i
    for i in (
        Index("NDVI", ("nir", "red"), lambda nir, red: difference(nir, red, "sentinel")),
        Index("NDWI", ("green", "nir"), lambda green, nir: difference(green, nir, "sentinel")),
        Index("SAVI", ("nir", "red"), savi),
        Index("EVI", ("nir", "red", "blue"), evi),
    )
}


def parse_index_list(text: str) -> list[str]:
    """Names of a comma list in upper case, or all for ALL; ValueError for unknown ones."""
    names = [n.strip().upper() for n in text.split(",") if n.strip()]
    names = list(REGISTRY) if "ALL" in names else names
    if unknown := [n for n in names if n not in REGISTRY]:
        raise ValueError(f"unknown indices: {', '.join(unknown)}")
    return names


def with_indices(df: DataFrame, names: list[str], bands: dict[str, str] | None = None) -> DataFrame:
    """df with the named indices; bands maps band names to columns. Missing bands are an error before any data is read."""
    bands = bands or {}
    needed = {b for n in names for b in REGISTRY[n].bands}
    if missing := sorted(b for b in needed if bands.get(b, b) not in df.columns):
        raise ValueError(f"missing bands: {', '.join(missing)}")
    return df.withColumns({n.lower(): REGISTRY[n].compute(*[F.col(bands.get(b, b)) for b in REGISTRY[n].bands]) for n in names})


def bundle_eps(blue: Column, green: Column, red: Column, nir: Column, swir1: Column, swir2: Column) -> dict[str, Column]:
    """Eleven indices with 1e-8 guards; those that need an absent short-wave band are 0."""
    wave = lambda c: F.when(swir1.isNotNull() & swir2.isNotNull(), c).otherwise(0.0)
    d = eps_difference
    return {
        "ndvi": d(nir, red),
        "evi": clip(ratio(2.5 * (nir - red), nir + 6 * red - 7.5 * blue + 1, "eps"), -1, 1),
        "savi": clip(ratio(1.5 * (nir - red), nir + red + 0.5, "eps"), -1, 2),
        "ndwi": d(green, nir),
        "mndwi": wave(d(green, swir1)),
        "awei": wave(clip(awei_sh(green, nir, swir1, swir2), -5, 5)),
        "ndbi": wave(d(swir1, nir)),
        "ui": wave(d(swir2, nir)),
        "bci": d(blue + red, nir),
        "bsi": wave(d(swir1 + red, nir + blue)),
        "lswi": wave(d(nir, swir1)),
    }


def bundle_tiny(blue: Column, green: Column, red: Column, nir: Column, swir1: Column, swir2: Column) -> dict[str, Column]:
    """Ten indices that are null where the denominator (and 1e-10) is within 1e-10 of 0."""
    tiny = lambda num, den: ratio(num, den + 1e-10, "tiny")
    d = lambda a, b: tiny(a - b, a + b)
    return {
        "ndvi": d(nir, red),
        "evi": 2.5 * tiny(nir - red, nir + 6 * red - 7.5 * blue + 1),
        "savi": 1.5 * tiny(nir - red, nir + red + 0.5),
        "ndwi": d(green, nir),
        "mndwi": d(green, swir1),
        "ndbi": d(swir1, nir),
        "bsi": F.try_divide(swir1 - nir - red, swir1 + nir + red + 1e-10),
        "nbr": d(nir, swir2),
        "evi2": 2.5 * tiny(nir - red, nir + 2.4 * red + 1),
        "arvi": d(nir, 2 * red - blue),
    }


def band_ratios(green: Column, red: Column, nir: Column, swir1: Column) -> dict[str, Column]:
    return {"nir_red": ratio(nir, red + 1e-10, "tiny"), "swir1_nir": ratio(swir1, nir + 1e-10, "tiny"), "green_red": ratio(green, red + 1e-10, "tiny")}


def detector_index(a: Column, b: Column) -> Column:
    """Difference index whose zero denominator is 1e-10, clipped to [-1, 1]."""
    return clip((a - b) / F.when(a + b == 0, F.lit(1e-10)).otherwise(a + b), -1, 1)


def brightness(red: Column, green: Column, blue: Column) -> Column:
    return (red + green + blue) / 3
