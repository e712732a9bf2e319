"""Colors as Column expressions: hex, Lab, CIEDE2000, HSL, hue families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: The nine basic names.
BASIC_NAMES = {
    "black": "#000000",
    "white": "#ffffff",
    "red": "#ff0000",
    "green": "#008000",
    "blue": "#0000ff",
    "yellow": "#ffff00",
    "gray": "#808080",
    "grey": "#808080",
    "silver": "#c0c0c0",
}


def expand_hex(color: Column) -> Column:
    """Six lower-case digits of a hex color of 3, 4, 6 or 8 digits (alpha drops out); null for other lengths."""
    h = F.lower(F.regexp_replace(color, "^#", ""))
    double = F.regexp_replace(F.substring(h, 1, 3), "(.)", "$1$1")
    return F.when(F.length(h).isin(3, 4), double).when(F.length(h).isin(6, 8), F.substring(h, 1, 6))


def channel(six: Column, k: int) -> Column:
    """Channel k (0 red, 1 green, 2 blue) in 0..1."""
    return F.conv(F.substring(six, 2 * k + 1, 2), 16, 10).cast("double") / 255


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    part = lambda x: F.lpad(F.lower(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), x.cast("int"))))), 2, "0")
    return F.concat(F.lit("#"), part(r), part(g), part(b))


def _channels(six: Column) -> Column:
    return F.struct(*(channel(six, k).alias(c) for k, c in enumerate("rgb")))


def lab(six: Column) -> Column:
    """CIE Lab (D65) of six hex digits, as a struct L, a, b. Each step is worked out once."""
    linear = lambda c: F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    f = lambda t: F.when(t > 216 / 24389, F.cbrt(t)).otherwise((24389 / 27 * t + 16) / 116)

    def xyz(v: Column) -> Column:
        r, g, b = v["r"], v["g"], v["b"]
        x = (0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047
        y = 0.2126729 * r + 0.7151522 * g + 0.0721750 * b
        z = (0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883
        return let(F.struct(x.alias("x"), y.alias("y"), z.alias("z")), lambda p: F.struct(*(f(p[c]).alias(c) for c in "xyz")))

    own = let(_channels(six), lambda v: F.struct(*(linear(v[c]).alias(c) for c in "rgb")))
    return let(let(own, xyz), lambda p: F.struct((116 * p["y"] - 16).alias("L"), (500 * (p["x"] - p["y"])).alias("a"), (200 * (p["y"] - p["z"])).alias("b")))


def delta_e(p: Column, q: Column) -> Column:
    """CIEDE2000 of two Lab structs (Sharma, Wu, Dalal 2005)."""
    c_mean = (F.sqrt(p.a**2 + p.b**2) + F.sqrt(q.a**2 + q.b**2)) / 2
    g = 0.5 * (1 - F.sqrt(c_mean**7 / (c_mean**7 + 25.0**7)))
    a1, a2 = (1 + g) * p.a, (1 + g) * q.a
    c1, c2 = F.sqrt(a1**2 + p.b**2), F.sqrt(a2**2 + q.b**2)
    hue = lambda b, a: F.when((a == 0) & (b == 0), F.lit(0.0)).otherwise(F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0)))
    h1, h2 = hue(p.b, a1), hue(q.b, a2)
    grey = c1 * c2 == 0
    dh = h2 - h1
    dh = F.when(grey, F.lit(0.0)).when(F.abs(dh) <= 180, dh).when(dh > 180, dh - 360).otherwise(dh + 360)
    d_h = 2 * F.sqrt(c1 * c2) * F.sin(F.radians(dh / 2))
    l_mean, c_bar = (p.L + q.L) / 2, (c1 + c2) / 2
    h_sum = h1 + h2
    h_bar = F.when(grey, h_sum).when(F.abs(h1 - h2) <= 180, h_sum / 2).when(h_sum < 360, (h_sum + 360) / 2).otherwise((h_sum - 360) / 2)
    cos = lambda x: F.cos(F.radians(x))
    t = 1 - 0.17 * cos(h_bar - 30) + 0.24 * cos(2 * h_bar) + 0.32 * cos(3 * h_bar + 6) - 0.20 * cos(4 * h_bar - 63)
    s_l = 1 + 0.015 * (l_mean - 50) ** 2 / F.sqrt(20 + (l_mean - 50) ** 2)
    s_c, s_h = 1 + 0.045 * c_bar, 1 + 0.015 * c_bar * t
    turn = 30 * F.exp(-(((h_bar - 275) / 25) ** 2))
    r_t = -2 * F.sqrt(c_bar**7 / (c_bar**7 + 25.0**7)) * F.sin(F.radians(2 * turn))
    l, c, h = (q.L - p.L) / s_l, (c2 - c1) / s_c, d_h / s_h
    return F.sqrt(l**2 + c**2 + h**2 + r_t * c * h)


def hsl(six: Column) -> Column:
    """Hue in degrees, saturation and lightness of six hex digits. Each step is worked out once."""

    def parts(v: Column) -> Column:
        r, g, b, high, low = (v[c] for c in ("r", "g", "b", "high", "low"))
        d, light = high - low, (high + low) / 2
        sat = F.when(d == 0, F.lit(0.0)).otherwise(d / F.when(light > 0.5, 2 - high - low).otherwise(high + low))
        hue = F.when(d == 0, F.lit(0.0)).when(high == r, ((g - b) / d + 6) % 6).when(high == g, (b - r) / d + 2).otherwise((r - g) / d + 4) * 60
        return F.struct(hue.alias("h"), sat.alias("s"), light.alias("l"))

    bounds = lambda v: F.struct(*(v[c].alias(c) for c in "rgb"), F.greatest(*(v[c] for c in "rgb")).alias("high"), F.least(*(v[c] for c in "rgb")).alias("low"))
    return let(let(_channels(six), bounds), parts)


def hue_family(h: Column) -> Column:
    family = F.when((h < 15) | (h >= 345), "red")
    for below, name in ((45, "orange"), (70, "yellow"), (165, "green"), (200, "cyan"), (255, "blue"), (290, "violet")):
        family = family.when(h < below, name)
    return family.otherwise("magenta")
