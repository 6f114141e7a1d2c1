"""Spectral index algebra as columns. Every ratio carries ``EPS`` in its denominator unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
#: Weights of nine reflectances (b2, b3, b4, b5, b6, b7, b8, b11, b12) are a parameter of ``albedo``.
CLEAR_CLASSES = (4, 5, 6, 7, 11)


def normalised_difference(a: Column, b: Column) -> Column:
    return (a - b) / (a + b + EPS)


def ndvi(nir: Column, red: Column) -> Column:
    return normalised_difference(nir, red)


def ndwi(green: Column, nir: Column) -> Column:
    return normalised_difference(green, nir)


def gndvi(green: Column, nir: Column) -> Column:
    return normalised_difference(nir, green)


def ndmi(nir: Column, swir: Column) -> Column:
    return normalised_difference(nir, swir)


def nbr(nir: Column, swir2: Column) -> Column:
    return normalised_difference(nir, swir2)


def ndsi(green: Column, swir: Column) -> Column:
    return normalised_difference(green, swir)


def clre(nir: Column, edge: Column) -> Column:
    return nir / (edge + EPS) - 1


def evi(nir: Column, red: Column, blue: Column, scale: float = 1.0) -> Column:
    """``scale`` turns the given numbers into reflectance; with 1 they are taken as they are."""
    n, r, b = nir * scale, red * scale, blue * scale
    return 2.5 * (n - r) / (n + 6 * r - 7.5 * b + 1 + EPS)


def wavi(nir: Column, blue: Column, soil: float = 0.5) -> Column:
    return (1 + soil) * (nir - blue) / (nir + blue + soil + EPS)


def albedo(bands: list[Column], weights: list[float]) -> Column:
    """Weighted sum of reflectances, kept between 0 and 1."""
    total = sum((b * w for b, w in zip(bands, weights)), F.lit(0.0))
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def plain_difference(a: Column, b: Column) -> Column:
    """Normalised difference without epsilon; null where the sum is 0."""
    return F.try_divide(a - b, a + b)


def decibel(power: Column) -> Column:
    """10 log10 of a positive power, null otherwise."""
    return F.when(power > 0, 10 * F.log10(power))


def reflectance(raw: Column, baseline: Column, day: Column, offset: int = 1000) -> Column:
    """Raw numbers minus the offset that processing from baseline 4.0 (or, unknown, from 2022-01-25) adds, 0 at least."""
    shifted = F.when(baseline.isNotNull(), baseline >= 4.0).otherwise(day >= F.lit("2022-01-25").cast("date"))
    return F.greatest(raw - F.when(shifted, F.lit(offset)).otherwise(F.lit(0)), F.lit(0))


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue, saturation and value in 0..1 from red, green and blue in 0..1."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = high - low
    hue = F.when(span == 0, F.lit(0.0)).when(high == r, F.pmod((g - b) / span, F.lit(6.0))).when(high == g, (b - r) / span + 2).otherwise((r - g) / span + 4)
    return hue / 6, F.when(high == 0, F.lit(0.0)).otherwise(F.try_divide(span, high)), high


def excess_green(r: Column, g: Column, b: Column) -> Column:
    return 2 * g - r - b


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def drop(early: Column, late: Column) -> Column:
    """What an index loses from the early to the late season."""
    return early - late


def clear_only(band: Column, scene_class: Column) -> Column:
    """The band where the scene class is clear, else null; pixel by pixel, without a vote of the window."""
    return F.when(scene_class.isin(*CLEAR_CLASSES), band)


def snow_free(scene_class: Column, green: Column, swir: Column, limit: float = 0.4) -> Column:
    """Clear without snow: neither the class of snow nor its index."""
    return F.coalesce(scene_class.isin(*[c for c in CLEAR_CLASSES if c != 11]) & (ndsi(green, swir) < limit), F.lit(False))


def image_masks(hue: Column, saturation: Column, value: Column) -> dict[str, Column]:
    """What a pixel of an image shows. The intervals of hue, saturation and value."""
    green = (hue > 0.18) & (hue < 0.45) & (saturation > 0.12) & (value > 0.18)
    return {
        "green": green, "bright_green": green & (saturation > 0.25) & (value > 0.30), "pale": (saturation < 0.12) & (value > 0.35),
        "rock": (saturation < 0.20) & (value > 0.20) & (value < 0.55), "pale_around": (saturation < 0.15) & (value > 0.40), "snow": (saturation < 0.10) & (value > 0.75),
        "water": (hue > 0.45) & (hue < 0.65) & (saturation > 0.20)}
