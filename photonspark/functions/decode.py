"""Bit decoding of raw detector words as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Input bit of each output bit, per ADC generation.
SAR_05_06_07_08 = (29, 17, 28, 18, 31, 21, 27, 20, 24, 23, 25, 22)
SAR_05 = (29, 19, 28, 18, 31, 21, 27, 20, 24, 23, 25, 22)
SAR_04 = (15, 17, 19, 21, 23, 4, 6, 8, 10, 12, 14, 16)

#: Gain bits sit above the 14 bits of the value; the pattern 2 counts as gain 0.
VALUE_BITS = 14
VALUE_MASK = 0x3FFF


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def gain(raw: Column | str) -> Column:
    top = F.shiftright(_c(raw), VALUE_BITS)
    return F.when(top == 1, 1).when(top == 3, 2).otherwise(0)


def value(raw: Column | str) -> Column:
    return _c(raw).bitwiseAND(F.lit(VALUE_MASK))


def value_and_gain(raw: Column | str) -> Column:
    return F.struct(value(raw).alias("value"), gain(raw).alias("gain"))


def pick_bits(word: Column | str, bits: tuple[int, ...]) -> Column:
    """Output bit i is input bit ``bits[i]``."""
    one = F.lit(1).cast("long")
    return sum((F.shiftleft(F.shiftrightunsigned(_c(word), b).bitwiseAND(one), i) for i, b in enumerate(bits)), F.lit(0).cast("long"))


def custom_weights(word: Column | str, weights: list[float]) -> Column:
    """Sum over set bits i of ``weights[i] ** i``; at most 16 weights."""
    if len(weights) > 16:
        raise ValueError("at most 16 weights")
    one = F.lit(1).cast("long")
    terms = (F.shiftright(_c(word), i).bitwiseAND(one).cast("double") * F.lit(float(w) ** i) for i, w in enumerate(weights))
    return sum(terms, F.lit(0.0))


def bit_offset(offset: int) -> int:
    if not 0 <= offset <= 7:
        raise ValueError("a bit offset is 0 to 7")
    return offset


def mask24(word: Column | str, offset: int = 0) -> Column:
    return F.shiftrightunsigned(_c(word), bit_offset(offset)).bitwiseAND(F.lit(0xFFFFFF))


def byte_at(data: Column, at: Column | int) -> Column:
    """Unsigned value of one byte of a binary column, 0-based."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("int")


def expand24to32(data: Column | str, offset: int = 0) -> Column:
    """Little-endian three-byte words; with an offset one more byte must follow the last word."""
    data, spare = _c(data), 1 if bit_offset(offset) else 0
    n = F.floor((F.octet_length(data) - spare) / 3).cast("int")
    whole = (F.octet_length(data) - spare) % 3 == 0

    def word(i: Column) -> Column:
        parts = [byte_at(data, i * 3 + k).cast("long") * (1 << (8 * k)) for k in range(3 + spare)]
        return mask24(sum(parts[1:], parts[0]), offset)

    words = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), word)
    good = F.when(n > 0, words).otherwise(F.array().cast("array<bigint>"))
    return F.when(whole, good).otherwise(F.raise_error(F.lit("the byte count does not fit three-byte words")).cast("array<bigint>"))


def expand4to8(data: Column | str) -> Column:
    """Two values a byte, the low nibble first."""
    data = _c(data)

    def pair(i: Column) -> Column:
        b = byte_at(data, i)
        return F.array(b.bitwiseAND(F.lit(15)), F.shiftright(b, 4))

    last = F.octet_length(data) - 1
    return F.when(last >= 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), pair))).otherwise(F.array().cast("array<int>"))


def decode_my302(data: Column | str, offset: int = 4) -> Column:
    """Two outputs of 64 channels x 3 counters of 24 bits, one after the other."""
    data, spare = _c(data), 1 if offset else 0
    half = 64 * 3 * 3
    halves = [expand24to32(F.substring(data, k * (half + spare) + 1, half + spare), offset) for k in (0, 1)]
    exact = F.octet_length(data) == 2 * (half + spare)
    return F.when(exact, F.concat(*halves)).otherwise(F.raise_error(F.lit("unexpected size of a Mythen frame")).cast("array<bigint>"))


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


#: Nanoseconds of each unit.
UNITS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000}


def duration_ns(text: Column | str) -> Column:
    """Nanoseconds of a duration such as ``1.5us``; without a unit seconds, an unknown unit is an error."""
    number = F.regexp_extract(_c(text), r"^\s*([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)", 1)
    unit = F.regexp_extract(_c(text), r"^\s*[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?\s*([A-Za-z]*)\s*$", 1)
    factor = F.when(unit == "", F.lit(UNITS["s"]))
    for name, ns in UNITS.items():
        factor = factor.when(unit == name, F.lit(ns))
    factor = factor.otherwise(F.raise_error(F.concat(F.lit("unknown unit "), unit)).cast("int"))
    return F.round(F.try_divide(number.cast("double") * factor, F.lit(1.0))).cast("long")
