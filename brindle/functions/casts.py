"""Casts between the five types, strict at run time: what can't be cast is an error, never NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.errors import PlanError

INTEGER, REAL, BOOLEAN, TEXT, BLOB = "INTEGER", "REAL", "BOOLEAN", "TEXT", "BLOB"
SPARK = {INTEGER: "bigint", REAL: "double", BOOLEAN: "boolean", TEXT: "string", BLOB: "binary"}
LEGAL = {(INTEGER, REAL), (INTEGER, BOOLEAN), (INTEGER, TEXT), (REAL, INTEGER), (REAL, TEXT), (BOOLEAN, INTEGER), (BOOLEAN, TEXT), (TEXT, INTEGER), (TEXT, REAL), (TEXT, BOOLEAN), (TEXT, BLOB), (BLOB, TEXT)}
#: Spellings of truth values: fixed values.
TRUE_WORDS, FALSE_WORDS = ("1", "t", "true", "y", "yes", "on"), ("0", "f", "false", "n", "no", "off")
_REAL = r"(?i)^[+-]?(?:\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?|inf|infinity|nan)$"


def type_of_spark(name: str) -> str | None:
    """The engine's type of a Spark type name; None where the column can only be passed through."""
    name = name.lower()
    if name in ("bigint", "int", "smallint", "tinyint"):
        return INTEGER
    if name in ("double", "float") or name.startswith("decimal"):
        return REAL
    return {"boolean": BOOLEAN, "string": TEXT, "binary": BLOB}.get(name)


def fail(message: str, shown: Column) -> Column:
    return F.raise_error(F.concat(F.lit(message), F.coalesce(shown.cast("string"), F.lit("NULL"))))


def real_to_text(x: Column) -> Column:
    """Shortest digits without an exponent: 1, 2.5, 0.0001, 12345678900, inf, NaN."""
    s = F.abs(x).cast("string")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "E.*$", ""), r"\.0$", ""), r"\.", "")
    power = F.regexp_extract(s, r"E(-?\d+)$", 1)
    e = F.when(power == "", F.lit(0)).otherwise(power).cast("int")
    n = F.length(digits)
    big = F.when(n > e + 1, F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, n))).otherwise(F.rpad(digits, e + 1, F.lit("0")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    plain = F.when(s.contains("E"), F.when(e >= 0, big).otherwise(small)).otherwise(F.regexp_replace(s, r"\.0$", ""))
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    return F.when(F.isnan(x), "NaN").when(s == "Infinity", F.concat(sign, F.lit("inf"))).when(x.isNotNull(), F.concat(sign, plain))


def real_to_integer(x: Column) -> Column:
    """Half away from zero, held to the range; NaN is 0."""
    top, low = F.lit((1 << 63) - 1), F.lit(-(1 << 63))
    return F.when(F.isnan(x), F.lit(0).cast("bigint")).when(x >= 9.223372036854775807e18, top).when(x <= -9.223372036854775808e18, low).otherwise(F.round(x).cast("bigint"))


def cast(c: Column, source: str | None, target: str) -> Column:
    if source == target:
        return c
    if source is None:
        return F.lit(None).cast(SPARK[target])
    if (source, target) not in LEGAL:
        raise PlanError(f"cannot cast {source} to {target}")
    if (source, target) == (REAL, INTEGER):
        return real_to_integer(c)
    if (source, target) == (REAL, TEXT):
        return real_to_text(c)
    if (source, target) == (TEXT, INTEGER):
        return F.when(c.isNull() | c.rlike(r"^[+-]?\d+$"), c.cast("bigint")).otherwise(fail("not an INTEGER: ", c).cast("bigint"))
    if (source, target) == (TEXT, REAL):
        word = F.regexp_replace(F.lower(c), "^([+-]?)inf$", "$1infinity")
        return F.when(c.isNull() | c.rlike(_REAL), F.when(word.rlike("^[+-]?nan$"), F.lit(float("nan"))).otherwise(word.cast("double"))).otherwise(fail("not a REAL: ", c).cast("double"))
    if (source, target) == (TEXT, BOOLEAN):
        low = F.lower(c)
        return F.when(low.isin(*TRUE_WORDS), F.lit(True)).when(low.isin(*FALSE_WORDS), F.lit(False)).when(c.isNull(), F.lit(None).cast("boolean")).otherwise(fail("not a BOOLEAN: ", c).cast("boolean"))
    if (source, target) == (TEXT, BLOB):
        return F.encode(c, "UTF-8")
    if (source, target) == (BLOB, TEXT):
        return F.validate_utf8(c.cast("string"))
    return c.cast(SPARK[target])
