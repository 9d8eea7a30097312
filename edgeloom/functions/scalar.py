"""Scalar functions by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import __version__, errors, types
from .typed import Typed, arithmetic, as_time, coalesce, div, literal, micros, numbers, plain, timestamp

# fixed values: names that stand for another function
ALIASES = {
    "coal": "coalesce",
    "sine": "sin",
    "cosine": "cos",
    "tang": "tan",
    "tangent": "tan",
    "asine": "asin",
    "arcsin": "asin",
    "arcsine": "asin",
    "acosine": "acos",
    "arccos": "acos",
    "arccosine": "acos",
    "atang": "atan",
    "atangent": "atan",
    "arctan": "atan",
    "arctang": "atan",
    "arctangent": "atan",
    "arcsinh": "asinh",
    "arccosh": "acosh",
    "arctanh": "atanh",
}


def _float(f: Callable[[Column], Column]) -> Callable[..., Typed]:
    def apply(x: Typed) -> Typed:
        numbers(x, what="a mathematical function")
        return Typed(f(plain(x, "float")), "float")

    return apply


def _log(x: Column) -> Column:
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.log(x))


def _part(f: Callable[[Column], Column]) -> Callable[..., Typed]:
    def apply(x: Typed) -> Typed:
        return Typed(f(timestamp(_time(x))).cast("bigint"), "uint")

    return apply


def _time(x: Typed) -> Typed:
    x = as_time(x)
    if x.kind == "nothing":
        return Typed(F.lit(None).cast("bigint"), "time")
    if x.kind != "time":
        raise errors.TypeMismatchError(f"a time is needed, not {x.kind}")
    return x


def _fraction(unit: int) -> Callable[..., Typed]:
    """What is past the whole second, in units of so many nanoseconds."""

    def apply(x: Typed) -> Typed:
        x = _time(x)
        if x.ts is not None:
            part = F.pmod(micros(x), F.lit(1_000_000))
            return Typed(part * F.lit(1000 // unit) if unit <= 1000 else div(part, F.lit(unit // 1000)), "uint")
        return Typed(div(F.pmod(x.col, F.lit(types.SECOND)), F.lit(unit)), "uint")

    return apply


def _round(x: Typed, places: Typed | None = None) -> Typed:
    numbers(x, what="round")
    return Typed(F.round(plain(x, "float"), places.const if places else 0), "float")


def _abs(x: Typed) -> Typed:
    return Typed(F.abs(plain(x, kind := numbers(x, what="abs"))), kind)


def _to_float(x: Typed) -> Typed:
    numbers(x, what="tofloat")
    return Typed(x.col.cast("double"), "float")


def _to_whole(kind: str) -> Callable[..., Typed]:
    def apply(x: Typed) -> Typed:
        numbers(x, what=f"to{kind}")
        whole = x.col.try_cast("bigint") if x.kind == "float" else x.col.cast("bigint")
        return Typed(F.when(whole >= 0, whole) if kind == "uint" else whole, kind)

    return apply


def _to_time(x: Typed) -> Typed:
    x = as_time(x)
    return x if x.kind == "time" else Typed(_to_whole("int")(x).col, "time")


def _to_text(x: Typed) -> Typed:
    return Typed((x.ts if x.ts is not None else x.col).cast("string"), "text")


def _bits(x: Typed) -> Column:
    if x.kind not in ("int", "uint"):
        raise errors.TypeMismatchError(f"an int is needed, not {x.kind}")
    return x.col.cast("bigint")


def _text(*xs: Typed) -> list[Column]:
    for x in xs:
        if x.kind not in ("text", "nothing"):
            raise errors.TypeMismatchError(f"a text is needed, not {x.kind}")
    return [plain(x, "text") for x in xs]


def _const(value: Callable[[], Column], kind: str) -> Callable[[], Typed]:
    return lambda: Typed(value(), kind)


def _instant(ns: int) -> Callable[[], Typed]:
    return lambda: Typed(F.lit(ns).cast("bigint"), "time", const=ns)


#: name: (least and most arguments, function); None: any number.
FUNCTIONS: dict[str, tuple[int, int | None, Callable[..., Typed]]] = {
    "log": (1, 1, _float(_log)),
    "abs": (1, 1, _abs),
    "ceil": (1, 1, _float(lambda x: F.ceil(x).cast("double"))),
    "floor": (1, 1, _float(lambda x: F.floor(x).cast("double"))),
    "round": (1, 2, _round),
    **{n: (1, 1, _float(getattr(F, n))) for n in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh")},
    "root": (2, 2, lambda x, n: Typed(F.pow(plain(x, "float"), F.lit(1.0) / plain(n, "float")), "float")),
    "bitand": (2, 2, lambda a, b: Typed(_bits(a).bitwiseAND(_bits(b)), "int")),
    "bitor": (2, 2, lambda a, b: Typed(_bits(a).bitwiseOR(_bits(b)), "int")),
    "bitxor": (2, 2, lambda a, b: Typed(_bits(a).bitwiseXOR(_bits(b)), "int")),
    "bitnot": (1, 1, lambda a: Typed(F.bitwise_not(_bits(a)), "int")),
    "shl": (2, 2, lambda a, n: Typed(F.call_function("shiftleft", _bits(a), _bits(n).cast("int")), "int")),
    "shr": (2, 2, lambda a, n: Typed(F.call_function("shiftright", _bits(a), _bits(n).cast("int")), "int")),
    "pi": (0, 0, _const(F.pi, "float")),
    "e": (0, 0, _const(F.e, "float")),
    "tofloat": (1, 1, _to_float),
    "toint": (1, 1, _to_whole("int")),
    "touint": (1, 1, _to_whole("uint")),
    "totime": (1, 1, _to_time),
    "totext": (1, 1, _to_text),
    "year": (1, 1, _part(F.year)),
    "month": (1, 1, _part(F.month)),
    "mday": (1, 1, _part(F.dayofmonth)),
    "wday": (1, 1, _part(lambda t: F.dayofweek(t) - 1)),
    "yday": (1, 1, _part(lambda t: F.dayofyear(t) - 1)),
    "hour": (1, 1, _part(F.hour)),
    "minute": (1, 1, _part(F.minute)),
    "second": (1, 1, _part(F.second)),
    "milli": (1, 1, _fraction(types.MILLI)),
    "micro": (1, 1, _fraction(types.MICRO)),
    "nano": (1, 1, _fraction(types.NANO)),
    "now": (0, 0, _const(lambda: F.unix_micros(F.current_timestamp()) * F.lit(1000), "time")),
    "dawn": (0, 0, _instant(types.DAWN)),
    "dusk": (0, 0, _instant(types.DUSK)),
    "epoch": (0, 0, _instant(types.EPOCH)),
    "bin": (2, 2, lambda t, unit: arithmetic("-", Typed(_time(t).col, "int"), Typed(F.pmod(_time(t).col, plain(unit, "int")), "int"))),
    "format": (2, 2, lambda t, how: Typed(F.date_format(timestamp(_time(t)), how.const), "text")),
    "century": (1, 1, lambda t: Typed(div(F.year(timestamp(_time(t))).cast("bigint") + 99, F.lit(100)), "uint")),
    "coalesce": (1, None, lambda *xs: coalesce(list(xs))),
    "version": (0, 0, lambda: literal(__version__)),
    "substr": (3, 3, lambda s, a, n: Typed(F.substring(_text(s)[0], a.col.cast("int"), n.col.cast("int")), "text")),
    "length": (1, 1, lambda s: Typed(F.length(_text(s)[0]).cast("bigint"), "uint")),
    "strcat": (1, None, lambda *xs: Typed(F.concat(*_text(*xs)), "text")),
    "pos": (2, 2, lambda s, part: Typed(F.position(_text(part)[0], _text(s)[0]).cast("bigint"), "uint")),
}


def call(name: str, args: list[Typed]) -> Typed:
    name = ALIASES.get(name, name)
    if name not in FUNCTIONS:
        raise errors.UnknownSymbolError(f"no function {name}")
    least, most, f = FUNCTIONS[name]
    if len(args) < least or most is not None and len(args) > most:
        raise errors.FunctionError(f"{name} takes {least}{'' if most == least else f' to {most}' if most else ' or more'} arguments, not {len(args)}")
    return f(*args)
