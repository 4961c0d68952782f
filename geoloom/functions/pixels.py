"""Pixel indices and masks as Column expressions; they stay inside whole-stage codegen.

Bands are numeric columns in 0..255. Arithmetic is in doubles, so pixels within 1e-6 of a threshold may fall on the
other side than in single precision.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
#: Fixed values of the index definitions and mask thresholds.
CIVE_R, CIVE_G, CIVE_B, CIVE_0 = 0.441, 0.811, 0.385, 18.78745
VEGETATION = {"exg": 8.0, "v": 0.05, "cive": 18.78, "vig": 0.0, "votes": 2}
SHADOW = {"dark": 60.0, "s": 0.0}
SOIL = {"exg": 5.0, "low": 70.0, "high": 200.0, "rg": 5.0, "rb": 8.0}


def _d(c: Column) -> Column:
    return c.cast("double")


def excess_green(r: Column, g: Column, b: Column) -> Column:
    return 2 * _d(g) - _d(r) - _d(b)


def color_invariance(r: Column, g: Column, b: Column) -> Column:
    return F.lit(4 / math.pi) * F.atan((_d(g) - _d(b)) / (_d(g) + _d(b) + EPS))


def intensity(r: Column, g: Column, b: Column) -> Column:
    return (_d(r) + _d(g) + _d(b)) / 3


def shadow_invariance(r: Column, g: Column, b: Column) -> Column:
    """Never above 0 (the norm is at least the mean), so the shadow mask with s > 0 is empty by definition."""
    i, norm = intensity(r, g, b), F.sqrt(_d(r) * _d(r) + _d(g) * _d(g) + _d(b) * _d(b))
    return F.lit(4 / math.pi) * F.atan((i - norm) / (i + norm + EPS))


def vi_green(r: Column, g: Column, b: Column) -> Column:
    return _d(g) / (F.pow(_d(g) + EPS, F.lit(0.667)) * F.pow(_d(b) + EPS, F.lit(0.333)))


def ngbdi(r: Column, g: Column, b: Column) -> Column:
    return (_d(g) - _d(b)) / (_d(g) + _d(b) + EPS)


def dsbi(r: Column, g: Column, b: Column) -> Column:
    return 0.5 * (_d(b) - _d(r)) + 0.5 * (_d(b) - _d(g))


def normalized(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    total = (_d(r) + _d(g) + _d(b)) / 255 + 1e-9
    return _d(r) / 255 / total, _d(g) / 255 / total, _d(b) / 255 / total


def cive(r: Column, g: Column, b: Column) -> Column:
    nr, ng, nb = normalized(r, g, b)
    return CIVE_R * nr - CIVE_G * ng + CIVE_B * nb + CIVE_0


def vig(r: Column, g: Column, b: Column) -> Column:
    return (_d(g) - _d(r)) / (_d(g) + _d(r) + EPS)


def vegetation(r: Column, g: Column, b: Column, valid: Column) -> Column:
    """At least two of four indices vote for vegetation."""
    t = VEGETATION
    votes = [excess_green(r, g, b) > t["exg"], color_invariance(r, g, b) > t["v"], cive(r, g, b) < t["cive"], vig(r, g, b) > t["vig"]]
    return (sum((v.cast("int") for v in votes[1:]), votes[0].cast("int")) >= t["votes"]) & valid


def shadow(r: Column, g: Column, b: Column, valid: Column, above: float = SHADOW["s"]) -> Column:
    """`above` other than 0 gives a shadow mask that can fire."""
    return (intensity(r, g, b) < SHADOW["dark"]) & (shadow_invariance(r, g, b) > above) & valid


def soil(r: Column, g: Column, b: Column, valid: Column) -> Column:
    i = intensity(r, g, b)
    return (_d(r) >= _d(g) - SOIL["rg"]) & (_d(r) > _d(b) + SOIL["rb"]) & (_d(g) > _d(b)) & (excess_green(r, g, b) < SOIL["exg"]) & (i > SOIL["low"]) & (i < SOIL["high"]) & valid


def prioritized(veg: Column, dark: Column, bare: Column) -> Column:
    """The class of a pixel: vegetation before shadow before soil; null without any."""
    return F.when(veg, "vegetation").when(dark, "shadow").when(bare, "soil")


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue, saturation and value in [0, 1]; hue and saturation of a grey are 0."""
    r, g, b = _d(r) / 255, _d(g) / 255, _d(b) / 255
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    h = F.when(d == 0, 0.0).when(top == r, (g - b) / d).when(top == g, 2 + (b - r) / d).otherwise(4 + (r - g) / d) / 6
    return h - F.floor(h), F.when(top == 0, 0.0).otherwise(d / top), top


def intensity_u8(r: Column, g: Column, b: Column) -> Column:
    return F.floor(intensity(r, g, b)).cast("int")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def confidence_pct(x: Column) -> Column:
    return F.rint(x * 100).cast("int")


#: Detector classes that are kept, by the number the detector gives them.
DETECTED = {10: "car", 9: "large_vehicle"}


def detected_class(number: Column) -> Column:
    out = F.lit(None).cast("string")
    for n, name in DETECTED.items():
        out = F.when(number == n, name).otherwise(out)
    return out


def scaled(band: Column, valid: Column) -> Column:
    """Network input: the band in [0, 1], 0 where the pixel is not valid."""
    return F.when(valid, _d(band) / 255).otherwise(0.0)


def augmented(row: Column, col: Column, size: int, flip_h: Column, flip_v: Column, quarter_turns: Column) -> tuple[Column, Column]:
    """Where a pixel of a square patch goes under flips and then counter-clockwise quarter turns."""
    last = size - 1
    c = F.when(flip_h, last - col).otherwise(col)
    r = F.when(flip_v, last - row).otherwise(row)
    k = F.pmod(quarter_turns, F.lit(4))
    turned_r = F.when(k == 0, r).when(k == 1, last - c).when(k == 2, last - r).otherwise(c)
    turned_c = F.when(k == 0, c).when(k == 1, r).when(k == 2, last - c).otherwise(last - r)
    return turned_r, turned_c


def valid_pixel(alpha: Column | None, r: Column, g: Column, b: Column) -> Column:
    """Alpha above 0; without alpha any band above 0."""
    return alpha > 0 if alpha is not None else (r > 0) | (g > 0) | (b > 0)
