"""Pixel types: merging, and conversion between normalised integers and floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions import numeric

# Bits and signedness of the integer types.
INTEGERS = {"uint8": (8, False), "int8": (8, True), "uint16": (16, False), "int16": (16, True), "uint32": (32, False), "int32": (32, True)}
FLOATS = ("half", "float", "double")
#: Which smaller types each type can hold without loss.
HOLDS = {
    "uint32": {"uint8", "uint16"}, "int32": {"int8", "int16", "uint8", "uint16"}, "uint16": {"uint8"}, "half": {"uint8", "int8"}, "int16": {"int8", "uint8"},
}


def merge(a: str, b: str) -> str:
    """The type that holds both; float where neither holds the other."""
    if a == b or not b:
        return a
    if not a:
        return b
    if "double" in (a, b) or "float" in (a, b):
        return "double" if "double" in (a, b) else "float"
    for x, y in ((a, b), (b, a)):
        if y in HOLDS.get(x, ()):
            return x
    return "float"


def convert(v: Column, source: str, target: str) -> Column:
    """A stored value of one type as that of another; integers are normalised, so that their maxima agree."""
    if source == target:
        return v
    normal = numeric.dequantize(v, *INTEGERS[source]) if source in INTEGERS else v.cast("double")
    if target in INTEGERS:
        return numeric.quantize(normal, *INTEGERS[target])
    return normal.cast("double" if target == "double" else "float")


def dither(v: Column, noise: Column, bits: int = 8) -> Column:
    """Quantised after noise of one step (0 to 1) is added."""
    return numeric.quantize(v + (noise - 0.5) / float((1 << bits) - 1), bits)


def swap_endian(v: Column) -> Column:
    """The four bytes of a 32-bit integer in the other order."""
    byte = lambda k: F.shiftright(v, 8 * k).bitwiseAND(255)
    return F.shiftleft(byte(0), 24).bitwiseOR(F.shiftleft(byte(1), 16)).bitwiseOR(F.shiftleft(byte(2), 8)).bitwiseOR(byte(3))
