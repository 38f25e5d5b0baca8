"""Image samples as Column expressions.

p is a raw sample, z the zero offset (BZERO), s the scale (BSCALE). ``mode="reference"`` has the
reference's arithmetic to the bit, in which 8- and 32-bit images invert the ratio when normalized and
multiply, wrapping, in superpixels; ``mode="standard"`` treats them as 16-bit images are treated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..layout import BITPIX

# The largest sample of integer images.
LARGEST = {8: 255.0, 16: 32767.0, 32: 2147483647.0, 64: 9223372036854775807.0}


def _check(bitpix: int) -> None:
    if bitpix not in BITPIX:
        raise ValueError(f"BITPIX {bitpix} is invalid")


def divide(a: Column, b: Column) -> Column:
    """IEEE division: infinities and NaN where ANSI SQL raises an error."""
    zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def physical(p: Column, z: Column, s: Column) -> Column:
    """The format's physical value, z + s * p."""
    return z + s * p.cast("double")


def blank(p: Column, value: Column) -> Column:
    """p, null where it is the image's BLANK."""
    return F.when(value.isNull() | (p != value), p)


def normalize(p: Column, bitpix: int, z: Column, s: Column, mode: str = "standard") -> Column:
    """(p + z) * s / (largest + z) for integers, p for floats."""
    _check(bitpix)
    p = p.cast("double")
    if bitpix < 0:
        return p
    scaled, most = (p + z) * s, F.lit(LARGEST[bitpix]) + z
    return divide(most, scaled) if mode == "reference" and bitpix in (8, 32) else divide(scaled, most)


def _wrap(x: Column, bits: int, signed: bool) -> Column:
    """Integer overflow as in two's complement of so many bits."""
    m = F.pmod(x, F.lit(2**bits).cast("bigint"))
    return F.when(m >= 2 ** (bits - 1), m - 2**bits).otherwise(m) if signed else m


def _truncated(x: Column, low: float, high: float) -> Column:
    """A float as an integer: towards zero, saturating, NaN to 0."""
    return F.least(F.greatest(F.nanvl(x, F.lit(0.0)), F.lit(low)), F.lit(high)).cast("bigint")


def superpixel_channel(a: Column, bitpix: int, z: Column, s: Column, b: Column | None = None, mode: str = "standard") -> Column:
    """A channel of a superpixel from its sample a, or from two samples a and b that it averages."""
    _check(bitpix)
    if bitpix == -32:
        return (a.cast("float") if b is None else (a.cast("float") + b.cast("float")) / F.lit(2.0).cast("float")).cast("double")
    if bitpix == -64:
        return a if b is None else (a + b) / 2
    most = F.lit(LARGEST[bitpix]) + z
    if mode == "reference" and bitpix in (8, 32):
        bits, signed = (8, False) if bitpix == 8 else (32, True)
        low, high = (0.0, 255.0) if bitpix == 8 else (-2147483648.0, 2147483647.0)
        one = lambda p: _wrap(_wrap(p.cast("bigint") + _truncated(z, low, high), bits, signed) * _truncated(s, low, high), bits, signed)
        if b is None:
            return most * one(a).cast("double")
        total = _wrap(one(a) + one(b), bits, signed)
        half = F.when(total < 0, -F.floor(-total / 2)).otherwise(F.floor(total / 2))
        return most * half.cast("double")
    shift = F.abs(z) if bitpix == 16 or mode == "reference" else z
    one = lambda p: (p.cast("double") + shift) * s
    return divide(one(a) if b is None else (one(a) + one(b)) / 2, most)


def byte_channel(v: Column) -> Column:
    """255 * v as a byte: truncated, saturating, NaN to 0."""
    return _truncated(F.lit(255.0) * v, 0.0, 255.0).cast("int")
