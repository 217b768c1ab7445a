"""Scalar expressions: rates, bit text, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(text: Column) -> Column:
    """A rate such as "30000/1001" or "25" as a number; null where it is none, or divided by 0."""
    parts = F.split(text, "/")
    top = parts[0].try_cast("double")
    return F.when(F.size(parts) == 1, top).when(F.size(parts) == 2, F.try_divide(top, F.try_element_at(parts, F.lit(2)).try_cast("double")))


def text_bits(text: Column) -> Column:
    """The bits of a text, 8 for each character, most significant first; characters must be below U+0100."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c: F.lpad(F.bin(F.ascii(c).cast("long")), 8, "0")), "")


def bits_text(bits: Column) -> Column:
    """The text of a bit string; what is left over after the last 8 is dropped."""
    n = F.floor(F.length(bits) / 8).cast("int")
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.chr(F.conv(F.substring(bits, (i - 1) * 8 + 1, F.lit(8)), 2, 10).cast("long")))
    return F.when(n < 1, "").otherwise(F.array_join(each, ""))


def phase_of(phase: Column, k: Column, period: float) -> Column:
    """Where a symbol starts between two frames, 0 to 1."""
    return F.pmod(phase + k * F.lit(period), F.lit(1.0))


def period_of(rate_: Column, fps: float) -> Column:
    """Frames of a symbol at a rate in symbols a second."""
    return F.lit(fps) / rate_


def rate_of(period: Column, fps: float) -> Column:
    """Symbols a second of a period in frames."""
    return F.lit(fps) / period


def truth_bits(text: Column) -> Column:
    """The bits of a truth file's text: field bits of json, else the text itself; null where neither is 0 and 1 alone."""
    said = F.coalesce(F.get_json_object(text, "$.bits"), F.trim(text))
    return F.when(said.rlike("^[01]+$"), said)
