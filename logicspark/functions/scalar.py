"""Column expressions: rates, hex, command fields, colours. No row UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"

# Sample-rate units and their multipliers (case-sensitive).
RATE_UNITS = {"GHz": 1e9, "MHz": 1e6, "KHz": 1e3, "kHz": 1e3, "Hz": 1.0}

# Background colour of an empty screen cell, bytes per pixel.
BACKGROUND = 0x333333
BYTES_PER_PIXEL = 6


def parse_sample_rate(text: Column) -> Column:
    """``"50 MHz"`` to Hz; anything that is not number + known unit gives NULL."""
    parts = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    number, unit = F.get(parts, 0), F.get(parts, 1)
    factor = F.lit(None).cast("double")
    for name, value in RATE_UNITS.items():
        factor = F.when(unit == name, F.lit(value)).otherwise(factor)
    return F.when(number.rlike(_NUMBER), number.try_cast("double") * factor)


def ns_to_us(t_ns: Column) -> Column:
    return t_ns.cast("double") / 1000.0


def timestamp_step(samplerate_hz: Column) -> Column:
    """Whole nanoseconds per sample; rates above 1 GHz have no integer step."""
    step = F.floor(F.lit(1e9) / samplerate_hz).cast("bigint")
    return F.when(step > 0, step).otherwise(
        F.raise_error(F.concat(F.lit("sample rate too high for a ns step: "), samplerate_hz)).cast("bigint")
    )


def is_hex(text: Column) -> Column:
    return text.rlike(r"^(0[xX])?[0-9A-Fa-f]+$")


def parse_hex(text: Column) -> Column:
    """Hex with optional 0x prefix to BIGINT; NULL for bad digits (``conv`` would give 0)."""
    digits = F.regexp_replace(text, r"^(0x)*(0X)*0*(?=.)", "")
    return F.when(digits.rlike("^[0-9A-Fa-f]{1,16}$"), F.conv(digits, 16, -10).cast("bigint"))


def format_hex(value: Column, digits: int, prefix: str = "") -> Column:
    return F.format_string(f"{prefix}%0{digits}X", value)


def is_read(mosi: Column) -> Column:
    return F.shiftright(mosi, 23).bitwiseAND(F.lit(1)) == 1


def register_of(mosi: Column) -> Column:
    return F.shiftright(mosi, 16).bitwiseAND(F.lit(0x7F)).cast("int")


def value_of(mosi: Column) -> Column:
    return mosi.bitwiseAND(F.lit(0xFFFF)).cast("int")


def high_byte(value: Column) -> Column:
    return F.shiftright(value, 8).bitwiseAND(F.lit(0xFF))


def low_byte(value: Column) -> Column:
    return value.bitwiseAND(F.lit(0xFF))


def bit_of(data: Column, index: Column) -> Column:
    """Bit ``index`` of packed bytes, least significant first; past the end is 0."""
    offset = F.floor(index / 8).cast("int")
    byte = F.conv(F.hex(F.substr(data, offset + 1, F.lit(1))), 16, 10).cast("int")
    shift = F.pmod(index, F.lit(8)).cast("int")
    bit = F.call_function("shiftright", byte, shift).bitwiseAND(F.lit(1))
    return F.when(offset < F.octet_length(data), bit).otherwise(F.lit(0))


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def apply_gain(value16: Column, gain: float, gamma: bool = False) -> Column:
    """16-bit plane value to 0..255 in single precision, truncated."""
    linear = clamp(value16.cast("float") * F.lit(gain).cast("float"), 0.0, 255.0).cast("float")
    if not gamma:
        return linear.cast("int")
    root = F.sqrt((linear / F.lit(255.0).cast("float")).cast("float")).cast("float")
    return (root * F.lit(255.0).cast("float")).cast("int")


def luma(r: Column, g: Column, b: Column) -> Column:
    return (F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b).cast("int")


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def red_of(rgb: Column) -> Column:
    return F.shiftright(rgb, 16).bitwiseAND(F.lit(0xFF))


def green_of(rgb: Column) -> Column:
    return F.shiftright(rgb, 8).bitwiseAND(F.lit(0xFF))


def blue_of(rgb: Column) -> Column:
    return rgb.bitwiseAND(F.lit(0xFF))
