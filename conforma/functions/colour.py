"""Colour arithmetic: parsing, luminance, contrast, and theme modifiers, as Column expressions.

A colour is a struct (r, g, b) of doubles from 0 to 255.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of preset colours.
PRESETS = {
    "black": (0, 0, 0), "white": (255, 255, 255), "red": (255, 0, 0),
    "green": (0, 128, 0), "blue": (0, 0, 255), "yellow": (255, 255, 0),
    "gray": (128, 128, 128), "grey": (128, 128, 128), "darkGray": (169, 169, 169),
    "lightGray": (211, 211, 211),
}


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(r.cast("double").alias("r"), g.cast("double").alias("g"), b.cast("double").alias("b"))


def parse_hex(text: Column) -> Column:
    """'#A1B2C3' or 'A1B2C3'; null if it is no colour."""
    bare = F.regexp_replace(F.trim(text), "^#", "")
    part = [F.conv(F.substring(bare, 1 + 2 * i, 2), 16, 10) for i in range(3)]
    return F.when(bare.rlike("^[0-9A-Fa-f]{6}$"), rgb(*part))


def to_hex(colour: Column) -> Column:
    def two(x: Column) -> Column:
        whole = F.least(F.lit(255), F.greatest(F.lit(0), F.rint(x).cast("int")))
        return F.lpad(F.hex(whole), 2, "0")

    return F.concat(two(colour["r"]), two(colour["g"]), two(colour["b"]))


def preset(name: Column) -> Column:
    out = F.lit(None)
    for k, v in PRESETS.items():
        out = F.when(name == k, rgb(*[F.lit(x) for x in v])).otherwise(out)
    return out


def linear(channel: Column) -> Column:
    x = channel / 255.0
    return F.when(x <= 0.03928, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def unlinear(x: Column) -> Column:
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return 255.0 * F.when(x <= 0.0031308, 12.92 * x).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)


def luminance(colour: Column) -> Column:
    return 0.2126 * linear(colour["r"]) + 0.7152 * linear(colour["g"]) + 0.0722 * linear(colour["b"])


def contrast(a: Column, b: Column) -> Column:
    """From 1 to 21; null unless both colours are known."""
    return ratio(luminance(a), luminance(b))


def ratio(x: Column, y: Column) -> Column:
    """The contrast of two luminances."""
    return F.when(x.isNotNull() & y.isNotNull(), (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05))


def shade(colour: Column, share: Column) -> Column:
    """Darker, in linear light: share 1 leaves the colour, 0 is black."""
    return rgb(*[unlinear(linear(colour[c]) * share) for c in "rgb"])


def tint(colour: Column, share: Column) -> Column:
    """Lighter, in linear light: share 1 leaves the colour, 0 is white."""
    return rgb(*[unlinear(linear(colour[c]) * share + (1 - share)) for c in "rgb"])


def lum_mod_off(colour: Column, factor: Column, offset: Column) -> Column:
    """Lightness times factor plus offset, hue and saturation kept (HLS)."""

    def ends(c: Column) -> Column:
        r, g, b = (c[x] / 255.0 for x in "rgb")
        return F.struct(r.alias("r"), g.alias("g"), b.alias("b"), F.greatest(r, g, b).alias("high"), F.least(r, g, b).alias("low"))

    def hls(c: Column) -> Column:
        high, low = c["high"], c["low"]
        spread = high - low
        sat = F.when(spread == 0, 0.0).when(high + low <= 1, spread / (high + low))
        sat = sat.otherwise(spread / F.greatest(2 - high - low, F.lit(1e-12)))
        hue = F.when(spread == 0, 0.0).when(c["r"] == high, (c["g"] - c["b"]) / spread)
        hue = hue.when(c["g"] == high, 2 + (c["b"] - c["r"]) / spread).otherwise(4 + (c["r"] - c["g"]) / spread)
        light = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (high + low) / 2 * factor + offset))
        return F.struct(hue.alias("h"), light.alias("l"), sat.alias("s"))

    def span(c: Column) -> Column:
        top = F.when(c["l"] <= 0.5, c["l"] * (1 + c["s"])).otherwise(c["l"] + c["s"] - c["l"] * c["s"])
        return F.struct((c["h"] / 6).alias("h"), (2 * c["l"] - top).alias("base"), top.alias("top"))

    def back(c: Column) -> Column:
        def channel(shift: float) -> Column:
            def level(h: Column) -> Column:
                rise = c["top"] - c["base"]
                return 255.0 * (
                    F.when(h < 1 / 6, c["base"] + rise * h * 6)
                    .when(h < 0.5, c["top"])
                    .when(h < 2 / 3, c["base"] + rise * (F.lit(2 / 3) - h) * 6)
                    .otherwise(c["base"])
                )

            return let(F.pmod(c["h"] + shift, F.lit(1.0)), level)

        return rgb(channel(1 / 3), channel(0.0), channel(-1 / 3))

    return let(let(let(let(colour, ends), hls), span), back)


def modified(colour: Column, mods: Column) -> Column:
    """Applies modifiers (array of name, val in 1/100000): shade and tint in order, then lightness."""

    def step(acc: Column, m: Column) -> Column:
        share = m["val"] / 100000.0
        return F.when(m["name"] == "shade", shade(acc, share)).when(m["name"] == "tint", tint(acc, share)).otherwise(acc)

    def last(name: str, default: float) -> Column:
        found = F.filter(mods, lambda m: m["name"] == name)
        return F.when(F.size(found) > 0, F.element_at(found, -1)["val"] / 100000.0).otherwise(F.lit(default))

    out = F.aggregate(mods, colour, step)
    light = F.exists(mods, lambda m: m["name"].isin("lumMod", "lumOff"))
    return F.when(light, lum_mod_off(out, last("lumMod", 1.0), last("lumOff", 0.0))).otherwise(out)


def large_text(size: Column, bold: Column) -> Column:
    """From 18 pt, or bold from 14 pt; an unknown size is not large. size in 1/100 pt."""
    return F.coalesce((size >= 1800) | (F.coalesce(bold, F.lit(False)) & (size >= 1400)), F.lit(False))


def required_ratio(size: Column, bold: Column, level: str = "AA") -> Column:
    small, large = (7.0, 4.5) if level == "AAA" else (4.5, 3.0)
    return F.when(large_text(size, bold), large).otherwise(small)
