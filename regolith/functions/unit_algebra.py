"""Compound units: products, quotients, powers, prefixes and brackets, as dimensions and a scale; conversions between them.

A unit is read by a fold over its tokens with a small stack: `/` and a bracket after it turn the sign of the exponents that follow
(`/` that of one factor or bracket, as in UCUM: `a/b.c` is a/b times c; a blank is a product). Symbols are case-sensitive (`mM` is no `Mm`), names are
not. What cannot be read is null, and so is a factor between units of different dimensions.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimal prefixes of the SI, by symbol and by name.
PREFIXES = {"Q": 30, "R": 27, "Y": 24, "Z": 21, "E": 18, "P": 15, "T": 12, "G": 9, "M": 6, "k": 3, "h": 2, "da": 1, "d": -1, "c": -2, "m": -3, "u": -6, "µ": -6, "μ": -6, "n": -9, "p": -12, "f": -15, "a": -18, "z": -21, "y": -24, "r": -27, "q": -30}
NAMED_PREFIXES = {"tera": 12, "giga": 9, "mega": 6, "kilo": 3, "hecto": 2, "deca": 1, "deci": -1, "centi": -2, "milli": -3, "micro": -6, "nano": -9, "pico": -12, "femto": -15}
#: Exponents of metre, kilogram, second, ampere, kelvin, mole, candela.
BASES = ("m", "kg", "s", "A", "K", "mol", "cd")
# Units that take prefixes, with names, scale to SI base units, and dimensions.
PREFIXED = {
    "m": ("meter metre", 1.0, {"m": 1}), "g": ("gram gramme", 1e-3, {"kg": 1}), "s": ("second", 1.0, {"s": 1}), "A": ("ampere amp", 1.0, {"A": 1}), "K": ("kelvin", 1.0, {"K": 1}),
    "mol": ("mole", 1.0, {"mol": 1}), "cd": ("candela", 1.0, {"cd": 1}), "Hz": ("hertz", 1.0, {"s": -1}), "N": ("newton", 1.0, {"kg": 1, "m": 1, "s": -2}),
    "Pa": ("pascal", 1.0, {"kg": 1, "m": -1, "s": -2}), "J": ("joule", 1.0, {"kg": 1, "m": 2, "s": -2}), "W": ("watt", 1.0, {"kg": 1, "m": 2, "s": -3}), "C": ("coulomb", 1.0, {"A": 1, "s": 1}),
    "V": ("volt", 1.0, {"kg": 1, "m": 2, "s": -3, "A": -1}), "F": ("farad", 1.0, {"kg": -1, "m": -2, "s": 4, "A": 2}), "Ohm": ("ohm", 1.0, {"kg": 1, "m": 2, "s": -3, "A": -2}),
    "Ω": ("", 1.0, {"kg": 1, "m": 2, "s": -3, "A": -2}), "S": ("siemens", 1.0, {"kg": -1, "m": -2, "s": 3, "A": 2}), "Wb": ("weber", 1.0, {"kg": 1, "m": 2, "s": -2, "A": -1}),
    "T": ("tesla", 1.0, {"kg": 1, "s": -2, "A": -1}), "H": ("henry", 1.0, {"kg": 1, "m": 2, "s": -2, "A": -2}), "lm": ("lumen", 1.0, {"cd": 1}), "lx": ("lux", 1.0, {"cd": 1, "m": -2}),
    "Bq": ("becquerel", 1.0, {"s": -1}), "Gy": ("gray", 1.0, {"m": 2, "s": -2}), "Sv": ("sievert", 1.0, {"m": 2, "s": -2}), "kat": ("katal", 1.0, {"mol": 1, "s": -1}),
    "L": ("liter litre", 1e-3, {"m": 3}), "l": ("", 1e-3, {"m": 3}), "M": ("molar", 1e3, {"mol": 1, "m": -3}), "bar": ("bar", 1e5, {"kg": 1, "m": -1, "s": -2}), "rad": ("radian", 1.0, {}),
    "eV": ("electronvolt", 1.602176634e-19, {"kg": 1, "m": 2, "s": -2}), "cal": ("calorie", 4.184, {"kg": 1, "m": 2, "s": -2}), "Da": ("dalton", 1.6605390666e-27, {"kg": 1}), "G": ("gauss", 1e-4, {"kg": 1, "s": -2, "A": -1}),
}
# Units without prefixes.
PLAIN = {
    "min": ("minute", 60.0, {"s": 1}), "h": ("hour hr", 3600.0, {"s": 1}), "d": ("day", 86400.0, {"s": 1}), "wk": ("week", 604800.0, {"s": 1}), "mo": ("month", 2629800.0, {"s": 1}), "yr": ("year", 31557600.0, {"s": 1}),
    "in": ("inch", 0.0254, {"m": 1}), "ft": ("foot feet", 0.3048, {"m": 1}), "yd": ("yard", 0.9144, {"m": 1}), "mi": ("mile", 1609.344, {"m": 1}), "lb": ("pound", 0.45359237, {"kg": 1}), "oz": ("ounce", 0.028349523125, {"kg": 1}), "t": ("tonne", 1e3, {"kg": 1}),
    "mmHg": ("", 133.322387415, {"kg": 1, "m": -1, "s": -2}), "atm": ("atmosphere", 101325.0, {"kg": 1, "m": -1, "s": -2}), "psi": ("", 6894.757293168361, {"kg": 1, "m": -1, "s": -2}), "deg": ("degree", math.pi / 180, {}),
    "sr": ("steradian", 1.0, {}), "%": ("percent", 0.01, {}), "ppm": ("", 1e-6, {}), "ppb": ("", 1e-9, {}), "rpm": ("", 1 / 60, {"s": -1}), "bpm": ("", 1 / 60, {"s": -1}), "Å": ("angstrom", 1e-10, {"m": 1}),
}
# Temperatures with an offset, which only stand alone: scale, and kelvins at zero.
OFFSET = {"degC": ("celsius", 1.0, 273.15), "°C": ("", 1.0, 273.15), "degF": ("fahrenheit", 5 / 9, 273.15 - 32 * 5 / 9), "°F": ("", 5 / 9, 273.15 - 32 * 5 / 9)}

PARSED = "struct<scale:double,offset:double,dims:array<int>>"
#: A unit of the tables: its scale is m times 10^e, whole numbers wherever they fit, so that products and quotients of scales are rounded once.
_UNIT = "struct<m:double,e:int,offset:double,dims:array<int>>"
_TOKEN = r"[()/.*·]|\^?[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|[^()/.*·\s^0-9+-]+|\S"


def _map(entries: dict[str, str], kind: str) -> Column:
    """A map literal, written as SQL; Spark folds it into one constant."""
    pairs = ", ".join(f"'{k}', {v}" for k, v in entries.items())
    return F.expr(f"cast(map({pairs}) as map<string,{kind}>)")


def _written(scale: float, dims: dict[str, int], offset: float = 0.0) -> str:
    told = Decimal(repr(scale)).normalize().as_tuple()
    whole = int("".join(map(str, told.digits)))
    m, e = (float(whole), told.exponent) if whole < 1 << 53 else (scale, 0)
    return f"named_struct('m', {m!r}D, 'e', {e}, 'offset', {offset!r}D, 'dims', array({', '.join(str(dims.get(b, 0)) for b in BASES)}))"


def _symbols(units: dict) -> dict[str, str]:
    return {symbol: _written(scale, dims) for symbol, (_, scale, dims) in units.items()}


def _names(units: dict) -> dict[str, str]:
    return {name + s: _written(scale, dims) for names, scale, dims in units.values() for name in names.split() for s in ("", "s")}


def _looked_up(tokens: Column) -> Column:
    """Array of (t, unit): a unit of its own goes before one with a prefix (min, cd, Pa, ft)."""
    degrees = {n: _written(scale, {"K": 1}, offset) for symbol, (name, scale, offset) in OFFSET.items() for n in (symbol, name) if n}
    own, names = _map(_symbols({**PLAIN, **PREFIXED}) | degrees, _UNIT), _map(_names({**PLAIN, **PREFIXED}) | degrees | {"inches": _written(0.0254, {"m": 1})}, _UNIT)
    after, named_after = _map(_symbols(PREFIXED), _UNIT), _map(_names(PREFIXED), _UNIT)
    powers, named_powers = (_map({k: f"{v}" for k, v in t.items()}, "int") for t in (PREFIXES, NAMED_PREFIXES))
    pattern = f"^({'|'.join(NAMED_PREFIXES)})(.+)$"

    def scaled(power, unit):
        return F.when(power.isNotNull() & unit.isNotNull(), F.struct(unit["m"].alias("m"), (power + unit["e"]).alias("e"), unit["offset"].alias("offset"), unit["dims"].alias("dims")).cast(_UNIT))

    def cut(t):
        low = F.lower(t)
        return F.struct(
            t.alias("t"), F.coalesce(F.try_element_at(own, t), F.try_element_at(names, low)).alias("own"), F.try_element_at(powers, F.substring(t, 1, 1)).alias("p"), F.try_element_at(after, F.substr(t, F.lit(2))).alias("u"),
            F.try_element_at(after, F.regexp_extract(t, "^da(.+)$", 1)).alias("tens"), F.try_element_at(named_powers, F.regexp_extract(low, pattern, 1)).alias("q"), F.try_element_at(named_after, F.regexp_extract(low, pattern, 2)).alias("v"),
        )

    return F.transform(F.transform(tokens, cut), lambda c: F.struct(c["t"].alias("t"), F.coalesce(c["own"], scaled(c["p"], c["u"]), scaled(F.lit(1), c["tens"]), scaled(c["q"], c["v"])).alias("unit")))


def parsed(unit: Column) -> Column:
    """struct(scale, offset, dims) of a unit, or null: a value times scale plus offset is in SI base units, dims are the exponents of BASES."""
    tight = F.regexp_replace(F.trim(unit), r"\s*([()/.*·])\s*", "$1")
    plain = F.translate(F.regexp_replace(tight, r"\s+", "."), "²³¹", "231")  # what stands apart is a factor of its own
    tokens = F.regexp_extract_all(plain, F.lit(_TOKEN), F.lit(0))
    nothing = F.struct(
        F.lit(1.0).alias("over"), F.lit(1.0).alias("under"), F.lit(0).alias("e"), F.lit(0.0).alias("offset"), F.array(*(F.lit(0) for _ in BASES)).alias("dims"), F.lit(1).alias("sign"), F.array(F.lit(1)).alias("stack"),
        F.lit(None).cast(_UNIT).alias("last"), F.lit(0).alias("last_sign"), F.lit("start").alias("before"), F.lit(True).alias("fine"), F.lit(0).alias("n"),
    )

    def end(s):
        whole = s["fine"] & (F.size(s["stack"]) == 1) & ~s["before"].isin("operator", "start")
        # an offset has a meaning only where the unit stands by itself
        scale = F.when(s["e"] < 0, s["over"] / (s["under"] * F.pow(F.lit(10.0), -s["e"]))).otherwise(s["over"] * F.pow(F.lit(10.0), s["e"]) / s["under"])
        return F.when(whole, F.struct(scale.alias("scale"), F.when(s["n"] == 1, s["offset"]).otherwise(0.0).alias("offset"), s["dims"].alias("dims")))

    return F.aggregate(_looked_up(tokens), nothing, _step, end)


def _step(s: Column, read: Column) -> Column:
    """One token: an operator, a bracket, a number (a power after a unit, else a factor), or a unit."""
    token = read["t"]
    outer = F.element_at(s["stack"], -1)
    after_value = s["before"].isin("unit", "power", "close", "number")
    operator, opens, closes = token.isin("/", ".", "*", "·"), token == "(", token == ")"
    number = token.rlike(r"^\^?[+-]?[0-9]")
    power = number & (s["before"] == "unit") & token.rlike(r"^\^?[+-]?[0-9]{1,2}$")
    unit = ~operator & ~opens & ~closes & ~number
    found = F.when(unit, read["unit"])
    sign = F.when(after_value, outer).otherwise(s["sign"])  # two factors side by side are a product
    exponent = F.try_to_number(F.regexp_replace(token, r"^\^?\+?", ""), F.lit("S999")).cast("int")
    more = F.when(power, s["last_sign"] * (exponent - 1)).when(unit, sign)
    of = F.when(power, s["last"]).when(unit, found)
    value = F.when(number & ~power, F.regexp_replace(token, r"^\^", "").try_cast("double"))
    # whole mantissas gather over and under a fraction, powers of ten beside it; it is divided once, at the end
    factor, times = F.when(more.isNotNull() & of.isNotNull(), of["m"]).when(value.isNotNull(), value), F.coalesce(F.when(of.isNotNull(), more), F.when(value.isNotNull(), sign))
    over = F.when(factor.isNotNull() & (times > 0), s["over"] * F.pow(factor, times)).otherwise(s["over"])
    under = F.when(factor.isNotNull() & (times < 0), s["under"] * F.pow(factor, -times)).otherwise(s["under"])
    e = F.when(more.isNotNull() & of.isNotNull(), s["e"] + of["e"] * more).otherwise(s["e"])
    dims = F.when(more.isNotNull() & of.isNotNull(), F.zip_with(s["dims"], of["dims"], lambda a, b: (a + b * more).cast("int"))).otherwise(s["dims"])
    stack = F.when(opens, F.concat(s["stack"], F.array(sign))).when(closes, F.slice(s["stack"], F.lit(1), F.greatest(F.size(s["stack"]) - 1, F.lit(1)))).otherwise(s["stack"])
    fine = (
        s["fine"]
        & F.when(operator, after_value | ((s["before"] == "start") & (token == "/"))).when(closes, after_value & (F.size(s["stack"]) > 1)).when(unit, found.isNotNull()).when(power, exponent.isNotNull())
        .when(number, value.isNotNull() & (value > 0) & ~after_value & ~F.startswith(token, F.lit("^"))).otherwise(F.lit(True))
    )
    kind = F.when(operator, "operator").when(opens, "operator").when(closes, "close").when(power, "power").when(number, "number").otherwise("unit")
    # after "/" the sign is turned; after an opening bracket it is that of the bracket
    after = F.when(operator & (token == "/"), -outer).when(opens, sign).otherwise(F.when(closes, F.element_at(stack, -1)).otherwise(outer))
    return F.struct(
        F.coalesce(over, F.lit(1.0)).alias("over"), F.coalesce(under, F.lit(1.0)).alias("under"), e.cast("int").alias("e"), F.when(unit & found.isNotNull(), found["offset"]).otherwise(s["offset"]).alias("offset"), dims.alias("dims"), after.cast("int").alias("sign"), stack.alias("stack"),
        F.when(unit, found).alias("last"), F.when(unit, sign).otherwise(F.lit(0)).alias("last_sign"), kind.alias("before"), F.coalesce(fine, F.lit(False)).alias("fine"), (s["n"] + 1).alias("n"),
    )


def compatible(a: Column, b: Column) -> Column:
    """Whether two parsed units have the same dimensions; null where one could not be read."""
    return a["dims"] == b["dims"]


def factor(a: Column, b: Column) -> Column:
    """value in a * factor = value in b, for parsed units of the same dimensions and without offsets; else null."""
    return _once(a, b, F.lit(None), lambda p: F.when(compatible(p["a"], p["b"]) & (p["a"]["offset"] == 0) & (p["b"]["offset"] == 0), p["a"]["scale"] / p["b"]["scale"]))


def converted(value: Column, a: Column, b: Column) -> Column:
    """A value in parsed unit a, in parsed unit b; null if their dimensions differ. Temperatures keep their offsets."""
    return _once(a, b, value, lambda p: F.when(compatible(p["a"], p["b"]), (p["v"] * p["a"]["scale"] + p["a"]["offset"] - p["b"]["offset"]) / p["b"]["scale"]))


def _once(a: Column, b: Column, value: Column, of) -> Column:
    """An expression of two units that are named once, so that reading them is written once into the plan."""
    return F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"), value.alias("v"))), of), F.lit(0))
