"""Colour expressions: hex text, HSV in single precision, cluster keys, hex comparison."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from embedspark.constants import HUE_EPS


def unit_channel(channel: Column, kind: str = "float") -> Column:
    """0..255 channel on the 0..1 scale, in single (default) or double precision."""
    return (channel.cast(kind) / F.lit(255).cast(kind)).cast(kind)


def _hex_byte(channel: Column, half_even: bool) -> Column:
    scaled = channel.cast("double") * 255.0 if half_even else (channel.cast("float") * F.lit(255).cast("float")).cast("double")
    nearest = F.bround(scaled) if half_even else F.round(scaled)
    return F.lower(F.lpad(F.hex(nearest.cast("int")), 2, "0"))


def rgb_to_hex(r: Column, g: Column, b: Column, half_even: bool = False) -> Column:
    """``#rrggbb`` of 0..1 channels; halves round away from zero, or to even on request."""
    return F.concat(F.lit("#"), *[_hex_byte(c, half_even) for c in (r, g, b)])


def hue(r: Column, g: Column, b: Column, high: Column, delta: Column, kind: str) -> Column:
    """Hue in 0..1; every step is rounded to ``kind`` because bin edges depend on the width."""

    def step(value: Column) -> Column:
        return value.cast(kind)

    six = step(F.lit(6))
    red = step(F.pmod(step((g - b) / delta), six) / six)
    green = step(step(step((b - r) / delta) + step(F.lit(2))) / six)
    blue = step(step(step((r - g) / delta) + step(F.lit(4))) / six)
    eps = step(F.lit(HUE_EPS))
    return (
        F.when(delta < eps, step(F.lit(0)))
        .when(F.abs(high - r) < eps, red)
        .when(F.abs(high - g) < eps, green)
        .otherwise(blue)
    )


def saturation(high: Column, delta: Column, kind: str) -> Column:
    return F.when(high > F.lit(0).cast(kind), (delta / high).cast(kind)).otherwise(F.lit(0).cast(kind))


def bin_of(value: Column, kind: str) -> Column:
    """Tenths, truncated."""
    return (value * F.lit(10).cast(kind)).cast(kind).cast("int")


def cluster_key(h: Column, s: Column, v: Column, kind: str = "float") -> Column:
    """h*1000 + s*10 + v over truncated tenths; (s, 10) and (s+1, 0) share a key by design."""
    return bin_of(h, kind) * 1000 + bin_of(s, kind) * 10 + bin_of(v, kind)


def hex_digits(text: Column) -> Column:
    """Lower-case hex text without leading ``#``."""
    return F.lower(F.ltrim(text, F.lit("#")))


def hex_channel(text: Column, index: int) -> Column:
    """0..255 value of channel ``index`` of a hex colour, NULL unless it has six hex digits."""
    digits = hex_digits(text)
    value = F.conv(F.substring(digits, 2 * index + 1, 2), 16, 10).cast("int")
    return F.when(digits.rlike("^[0-9a-f]{6}$"), value)


def hex_distance(a: Column, b: Column) -> Column:
    """Largest channel difference of two hex colours on the 0..1 scale, 1.0 if one is invalid."""
    gaps = [F.abs(hex_channel(a, i) - hex_channel(b, i)) for i in range(3)]
    valid = hex_channel(a, 0).isNotNull() & hex_channel(b, 0).isNotNull()
    return F.when(valid, F.greatest(*gaps) / 255.0).otherwise(F.lit(1.0))


def hex_digit_difference(a: Column, b: Column) -> Column:
    """Number of differing hex digits, 6 when either text does not have six characters."""
    left, right = hex_digits(a), hex_digits(b)
    differing = sum(
        (
            (F.substring(left, i, 1) != F.substring(right, i, 1)).cast("int")
            for i in range(1, 7)
        ),
        F.lit(0),
    )
    valid = (F.length(left) == 6) & (F.length(right) == 6)
    return F.when(valid, differing).otherwise(F.lit(6))


def channel_distance(a: Column, b: Column) -> Column:
    """Largest channel difference of two rgb arrays, 1.0 if one is missing."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.coalesce(F.array_max(gaps), F.lit(1.0))


def sortable_scientific(value: Column) -> Column:
    """``m.mmmE±eee`` text of a number; zero is ``0.000E+000``.

    The number format rounds the exact binary value and carries into the exponent
    (9.9996 becomes 1.000 with the next exponent); only a plus sign is added.
    """
    text = F.call_function("format_number", value.cast("double"), F.lit("0.000E000"))
    exponent = F.substring_index(text, "E", -1)
    sign = F.when(exponent.startswith("-"), F.lit("")).otherwise(F.lit("+"))
    return F.when(value == 0.0, F.lit("0.000E+000")).otherwise(
        F.concat(F.substring_index(text, "E", 1), F.lit("E"), sign, exponent)
    )
