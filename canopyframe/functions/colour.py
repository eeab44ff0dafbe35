"""Colour indices, masks, ramps and palettes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopyframe.dims import PALETTE


def exg(r: Column, g: Column, b: Column) -> Column:
    """Excess green of chromatic coordinates; a black pixel gives 0."""
    s = r + g + b + F.lit(1e-6)
    return (2 * g - r - b) / s


def gli(r: Column, g: Column, b: Column) -> Column:
    """Green leaf index with a guarded denominator."""
    return (2 * g - r - b) / (2 * g + r + b + F.lit(1e-6))


def gli_strict(r: Column, g: Column, b: Column) -> Column:
    """Green leaf index, null for black pixels."""
    return F.try_divide(2 * g - r - b, F.nullif(2 * g + r + b, F.lit(0)).cast("double"))


def vari(r: Column, g: Column, b: Column) -> Column:
    """Visible atmospherically resistant index, null at a zero denominator."""
    return F.try_divide(g - r, F.nullif(g + r - b, F.lit(0)).cast("double"))


def exg_strict(r: Column, g: Column, b: Column) -> Column:
    """Excess green over at least one count of brightness."""
    return (2 * g - r - b) / F.greatest(r + g + b, F.lit(1)).cast("double")


def luminance(r: Column, g: Column, b: Column) -> Column:
    return F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b


def bright_sky(r: Column, g: Column, b: Column) -> Column:
    """Bright pixel with a blue cast."""
    return ((r + g + b) / F.lit(3.0) >= 140) & (b - r > 6) & (b - g > 6)


def deep_shadow(r: Column, g: Column, b: Column) -> Column:
    return (r + g + b) / F.lit(3.0) <= 18


def crown(r: Column, g: Column, b: Column) -> Column:
    """Neither sky nor deep shadow."""
    return ~(bright_sky(r, g, b) | deep_shadow(r, g, b))


def hemisphere_sky(r: Column, g: Column, b: Column) -> Column:
    """Bright and bluish or unsaturated pixel of a full panorama."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    sat = F.when(top > 0, (top - low) / F.greatest(top, F.lit(1)).cast("double")).otherwise(0.0)
    return (top > 140) & (((b >= r) & (b >= g)) | (sat < 0.20))


def pseudo_ndvi(nir: Column, red: Column) -> Column:
    """Vegetation index of a colour-infrared image; dark pixels are null."""
    return F.when(nir + red >= 40, (nir - red) / (nir + red + F.lit(1e-6)))


def ramp(t: Column, stops: tuple[tuple[int, int, int], ...]) -> list[Column]:
    """Piecewise-linear colour (r, g, b as doubles) of ``t`` clipped to 0..1."""
    last = len(stops) - 1
    pos = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * F.lit(float(last))
    low = F.least(F.floor(pos), F.lit(last - 1)).cast("int")
    out = []
    for k in range(3):
        table = F.array(*[F.lit(float(s[k])) for s in stops])
        a, b = F.element_at(table, low + 1), F.element_at(table, low + 2)
        out.append(a + (b - a) * (pos - low))
    return out


def palette(index: Column) -> list[Column]:
    """Cyclic label colour."""
    return [F.element_at(F.array(*[F.lit(c[k]) for c in PALETTE]), (F.pmod(index, F.lit(len(PALETTE))) + 1).cast("int"))
            for k in range(3)]


def hsv(r: Column, g: Column, b: Column) -> list[Column]:
    """Hue in half degrees (0..180), saturation and value (0..255), unrounded."""
    top, low = F.greatest(r, g, b).cast("double"), F.least(r, g, b).cast("double")
    span = F.nullif(top - low, F.lit(0.0))
    hue = (F.when(top == r, (g - b) / span * 60.0)
           .when(top == g, (b - r) / span * 60.0 + 120.0).otherwise((r - g) / span * 60.0 + 240.0))
    hue = F.coalesce(F.when(hue < 0, hue + 360.0).otherwise(hue), F.lit(0.0)) / 2.0
    sat = F.coalesce(F.try_divide((top - low) * 255.0, F.nullif(top, F.lit(0.0))), F.lit(0.0))
    return [hue, sat, top]


# fixed value: zeroth spherical-harmonic constant
SH_C0 = 0.28209479177387814


def splat_colour(f_dc: Column) -> Column:
    """Base colour 0..1 of a splat coefficient."""
    return F.least(F.greatest(F.lit(0.5) + F.lit(SH_C0) * f_dc, F.lit(0.0)), F.lit(1.0))


def splat_coefficient(colour: Column) -> Column:
    """Inverse of ``splat_colour`` for an 8-bit colour."""
    return (colour / F.lit(255.0) - 0.5) / F.lit(SH_C0)


def splat_opacity(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def splat_logit(opacity: Column) -> Column:
    return F.log(opacity / (F.lit(1.0) - opacity))
