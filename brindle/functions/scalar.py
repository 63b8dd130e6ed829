"""Scalar functions and operators by exact argument types. NULL fits any argument; INTEGER is never taken for REAL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.errors import PlanError
from brindle.functions.casts import BLOB, BOOLEAN, INTEGER, REAL, SPARK, TEXT, fail

_NAN, _INF = float("nan"), float("inf")


def _some(*cs: Column) -> Column:
    known = cs[0].isNotNull()
    for c in cs[1:]:
        known = known & c.isNotNull()
    return known


def divide(x: Column, y: Column, kind: str) -> Column:
    """Truncating for INTEGER (an error by zero), IEEE for REAL."""
    if kind == INTEGER:
        return F.call_function("div", x, y)
    below_zero = y.cast("string") == "-0.0"
    by_zero = F.when(F.isnan(x) | (x == 0), _NAN).when((x > 0) == ~below_zero, _INF).otherwise(-_INF)
    return F.when(_some(x, y), F.when(y != 0, x / F.nullif(y, F.lit(0.0))).otherwise(by_zero))


def modulo(x: Column, y: Column, kind: str) -> Column:
    if kind == INTEGER:
        return x % y
    return F.when(_some(x, y), F.when(y == 0, _NAN).otherwise(x % F.nullif(y, F.lit(0.0))))


def _log(x: Column, f: Callable[[Column], Column]) -> Column:
    return F.when(F.isnan(x) | (x < 0), F.lit(_NAN)).when(x == 0, F.lit(-_INF)).otherwise(f(x))


def _whole(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """ceil and floor of doubles; those beyond 2^52 are whole already."""
    return lambda x: F.when(F.isnan(x) | (F.abs(x) >= 4503599627370496.0), x).otherwise(f(x).cast("double"))


def _round(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) >= 4503599627370496.0), x).otherwise(F.round(x))


def _replace(s: Column, old: Column, new: Column) -> Column:
    between = F.array_join(F.concat(F.array(F.lit("")), F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)), F.array(F.lit(""))), "\x00")
    spread = F.when(s == "", new).otherwise(F.replace(between, F.lit("\x00"), new))
    return F.when(_some(s, old, new), F.when(old == "", spread).otherwise(F.replace(s, old, new)))


def _repeat(s: Column, n: Column) -> Column:
    return F.when(n < 0, fail("cannot repeat a text so often: ", n)).otherwise(F.repeat(s, n.cast("int")))


def _log_base(b: Column, x: Column) -> Column:
    top, bottom = _log(x, F.log), _log(b, F.log)
    return divide(top, bottom, REAL)


_one = lambda f: [((REAL,), REAL, f)]
#: name -> [(argument types, result type, builder)]
SCALARS: dict[str, list] = {
    "abs": [((INTEGER,), INTEGER, F.abs), ((REAL,), REAL, F.abs)],
    "ceil": _one(_whole(F.ceil)), "ceiling": _one(_whole(F.ceil)), "floor": _one(_whole(F.floor)),
    "degrees": _one(F.degrees), "radians": _one(F.radians), "exp": _one(F.exp),
    "ln": _one(lambda x: _log(x, F.log)), "log10": _one(lambda x: _log(x, F.log10)),
    "log": [((REAL,), REAL, lambda x: _log(x, F.log10)), ((REAL, REAL), REAL, _log_base)],
    "mod": [((INTEGER, INTEGER), INTEGER, lambda x, y: modulo(x, y, INTEGER)), ((REAL, REAL), REAL, lambda x, y: modulo(x, y, REAL))],
    "pi": [((), REAL, F.pi)],
    "power": [((REAL, REAL), REAL, F.pow)],
    "round": _one(_round),
    "sign": _one(lambda x: F.when(x.isNull(), F.lit(None).cast("double")).when(F.isnan(x) | (x == 0), 0.0).when(x > 0, 1.0).otherwise(-1.0)),
    "sqrt": _one(F.sqrt),
    "trunc": _one(lambda x: F.when(x < 0, _whole(F.ceil)(x)).otherwise(_whole(F.floor)(x))),
    **{n: _one(getattr(F, n)) for n in ("acos", "asin", "atan", "cos", "sin", "tan", "acosh", "asinh", "atanh", "cosh", "sinh", "tanh")},
    "atan2": [((REAL, REAL), REAL, F.atan2)],
    "length": [((TEXT,), INTEGER, lambda s: F.length(s).cast("bigint"))],
    "lower": [((TEXT,), TEXT, F.lower)], "upper": [((TEXT,), TEXT, F.upper)],
    "octet_length": [((TEXT,), INTEGER, lambda s: F.octet_length(s).cast("bigint"))],
    "repeat": [((TEXT, INTEGER), TEXT, _repeat)],
    "replace": [((TEXT, TEXT, TEXT), TEXT, _replace)],
}
#: These need the session: random numbers and sequences.
IMPURE = {"random": [((), REAL)], "setseed": [((REAL,), REAL)], "nextval": [((TEXT,), INTEGER)], "currval": [((TEXT,), INTEGER)]}
TABLE_FUNCTIONS = ("generate_series", "columns", "functions", "indexes", "keywords", "sequences", "tables", "views")


def fits(types: tuple, given: tuple) -> bool:
    return len(types) == len(given) and all(g is None or g == t for t, g in zip(types, given))


def resolve(name: str, given: tuple) -> tuple:
    for found in SCALARS.get(name, ()):
        if fits(found[0], given):
            return found
    raise PlanError(f"no function {name}({', '.join(g or 'NULL' for g in given)})")


def _avg(c: Column, kind: str) -> Column:
    return F.avg(c) if kind == REAL else divide(F.sum(c).cast("double"), F.count(c).cast("double"), REAL)


_any = (INTEGER, REAL, BOOLEAN, TEXT, BLOB)
AGGREGATES = ("count", "min", "max", "sum", "avg")


def aggregate(name: str, c: Column, kind: str | None, distinct: bool) -> tuple[Column, str]:
    """Column and type of an aggregate of one argument."""
    kind = kind or INTEGER
    if name == "count":
        return (F.count_distinct(c) if distinct else F.count(c)).cast("bigint"), INTEGER
    if name in ("min", "max"):
        return (F.min if name == "min" else F.max)(c), kind
    if kind not in (INTEGER, REAL):
        raise PlanError(f"no function {name}({kind})")
    if name == "sum":
        return (F.sum_distinct(c) if distinct else F.sum(c)), kind
    if distinct:
        return divide(F.sum_distinct(c).cast("double"), F.count_distinct(c).cast("double"), REAL), REAL
    return _avg(c, kind), REAL


def like(c: Column, pattern: Column, constant: str | None, fold: bool) -> Column:
    """LIKE with % and _; a backslash takes the next character as it is; neither wildcard crosses a line feed."""
    flags = "(?iu)" if fold else ""
    if constant is not None:
        out, at = [], 0
        while at < len(constant):
            ch = constant[at]
            if ch == "\\":
                at += 1
                if at == len(constant):
                    raise PlanError("LIKE pattern ends in a backslash")
                ch = constant[at]
            elif ch in "%_":
                out.append("[^\\n]*" if ch == "%" else "[^\\n]")
                at += 1
                continue
            out.append(ch if ch.isalnum() or ord(ch) > 127 or ch == " " else "\\" + ch if not ch.isspace() else f"\\x{ord(ch):02x}")
            at += 1
        return c.rlike(f"{flags}\\A{''.join(out)}\\z")
    part = F.transform(F.regexp_extract_all(pattern, F.lit(r"(?s)\\.|."), F.lit(0)), lambda t: F.when(t == "%", "[^\\n]*").when(t == "_", "[^\\n]").when(t == "\\", fail("LIKE pattern ends in a backslash: ", pattern)).otherwise(F.concat(F.lit("\\x{"), F.lower(F.hex(F.encode(F.substring(t, -1, 1), "UTF-32"))), F.lit("}"))))
    return F.rlike(c, F.concat(F.lit(f"{flags}\\A"), F.array_join(part, ""), F.lit("\\z")))


def typed_null(kind: str | None) -> Column:
    return F.lit(None).cast(SPARK[kind or INTEGER])
