"""A hash of whole numbers that SQL engines can compute as well."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the integer hash, which SQL engines can compute as well.
_MULTIPLIER, MASK = 73244475, 0xFFFFFFFF


def mixed(number: Column, seed: int = 0) -> Column:
    """A hash in 0..2^32-1 of a whole number, made of shifts and products that stay below 2^60."""
    value = (number.bitwiseXOR(F.shiftright(number, 32)).bitwiseAND(MASK) + seed).bitwiseAND(MASK)
    for _ in range(3):
        value = (value.bitwiseXOR(F.shiftright(value, 16)) * F.lit(_MULTIPLIER).cast("bigint")).bitwiseAND(MASK)
    return value.bitwiseXOR(F.shiftright(value, 16))


def mixed_sql(number: str, seed: int = 0) -> str:
    """The SQL of :func:`mixed`."""
    value = f"((xor({number}, {number} >> 32) & {MASK}) + {seed}) & {MASK}"
    for _ in range(3):
        value = f"list_transform([{value}], lambda h: (xor(h, h >> 16) * {_MULTIPLIER}) & {MASK})[1]"
    return f"list_transform([{value}], lambda h: xor(h, h >> 16))[1]"
