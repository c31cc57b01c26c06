"""Cell expressions: nodata is NULL, and NULL on either side gives NULL, also in logic.

Comparisons with NaN are false (Spark calls NaN equal to itself and the largest, so it is replaced by -infinity on
the greater side), division and logarithm give infinities and NaN instead of errors, and a NaN result counts as nodata
where the output's nodata is NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: |v| up to which a value is false, and up to which two values are equal.
EPSILON = 1e-8


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(None).cast("double") if v is None or v != v else F.lit(float(v))


def real(v: Column) -> Column:
    """NaN as nodata."""
    return F.nanvl(v, F.lit(None).cast("double"))


def single(v: Column) -> Column:
    return v.cast("float").cast("double")


def true(v: Column) -> Column:
    """Not zero. Spark orders NaN above all numbers, so that NaN is true; NULL stays NULL."""
    return F.abs(v) > EPSILON


def flag(test: Column) -> Column:
    """1 or 0; NULL where the test is NULL. Inputs occur once, so that nested formulas grow by their length only."""
    return test.cast("double")


_LEAST = float("-inf")


def divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), a * F.lit(float("inf")) + b * 0)


def log(v: Column, base: float | None = None) -> Column:
    import math

    ln = F.when(v == 0, F.lit(float("-inf"))).when(v > 0, F.ln(F.when(v > 0, v)))
    return real(ln if base is None else ln / math.log(base))


def long(v: Column) -> Column:
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 9.2e18), v).cast("long")


#: name: (function of two cells, output type)
BINARY = {
    "add": (lambda a, b: real(single(a + b)), "float"),
    "minus": (lambda a, b: real(single(a - b)), "float"),
    "rminus": (lambda a, b: real(single(b - a)), "float"),
    "mult": (lambda a, b: real(single(a * b)), "float"),
    "div": (lambda a, b: real(single(divide(a, b))), "float"),
    "rdiv": (lambda a, b: real(single(divide(b, a))), "float"),
    "pow": (lambda a, b: real(single(F.pow(a, b))), "float"),
    "rpow": (lambda a, b: real(single(F.pow(b, a))), "float"),
    "and": (lambda a, b: flag(true(a)) * flag(true(b)), "byte"),
    "or": (lambda a, b: flag(flag(true(a)) + flag(true(b)) > 0), "byte"),
    "xor": (lambda a, b: flag(true(a) != true(b)), "byte"),
    "eq": (lambda a, b: flag(F.abs(a - b) <= EPSILON), "byte"),
    "ne": (lambda a, b: flag(F.abs(a - b) > EPSILON), "byte"),
    "gt": (lambda a, b: flag(F.nanvl(a, F.lit(_LEAST)) > b), "byte"),
    "ge": (lambda a, b: flag(F.nanvl(a, F.lit(_LEAST)) >= b), "byte"),
    "lt": (lambda a, b: flag(a < F.nanvl(b, F.lit(_LEAST))), "byte"),
    "le": (lambda a, b: flag(a <= F.nanvl(b, F.lit(_LEAST))), "byte"),
    "bitand": (lambda a, b: single(long(a).bitwiseAND(long(b)).cast("double")), "float"),
    "bitor": (lambda a, b: single(long(a).bitwiseOR(long(b)).cast("double")), "float"),
    "bitxor": (lambda a, b: single(long(a).bitwiseXOR(long(b)).cast("double")), "float"),
}

#: name: (function of a cell, output type; None: the input's)
UNARY = {
    "abs": (F.abs, None),
    "uminus": (lambda a: -a, None),
    "bitnot": (lambda a: F.bitwise_not(long(a)).cast("double"), None),
    "not": (lambda a: flag(~true(a)), "byte"),
    "sin": (lambda a: real(single(F.sin(a))), "float"),
    "cos": (lambda a: real(single(F.cos(a))), "float"),
    "tan": (lambda a: real(single(F.tan(a))), "float"),
}
#: Names in scripts and of Python operators.
NAMES = {
    "+": "add", "-": "minus", "*": "mult", "/": "div", "**": "pow", "&&": "and", "||": "or", "==": "eq", "!=": "ne", "<>": "ne", ">": "gt", ">=": "ge", "gte": "ge",
    "<": "lt", "<=": "le", "lte": "le", "&": "bitand", "|": "bitor", "^": "bitxor", "!": "not", "~": "bitnot",
}


def binary(name: str):
    return BINARY[NAMES.get(name.lower(), name.lower())]


def unary(name: str):
    return UNARY[NAMES.get(name.lower(), name.lower())]


def convert_range(kind: str) -> tuple[float, float]:
    """Values that a type can hold beside its nodata."""
    top = 3.4028234663852886e38
    return {"byte": (0.0, 254.0), "short": (-32767.0, 32767.0), "ushort": (0.0, 65535.0), "int": (-2147483647.0, 2147483647.0), "float": (-top, top), "double": (-1.7976931348623157e308, 1.7976931348623157e308)}[kind]


def as_type(v: Column, kind: str) -> Column:
    """A value as the type stores it: integers lose their fraction, float its digits."""
    if kind == "double":
        return v
    if kind == "float":
        return single(v)
    return F.when(~F.isnan(v), F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double"))
