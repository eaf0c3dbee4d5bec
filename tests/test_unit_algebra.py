"""Units against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from regolith.functions import unit_algebra as ua

READ = {
    # unit: scale, exponents of m kg s A K mol cd
    "m": (1, {"m": 1}), "mg/mL": (1.0, {"kg": 1, "m": -3}), "m.s-2": (1, {"m": 1, "s": -2}), "kg*m^2/s^2": (1, {"kg": 1, "m": 2, "s": -2}), "m/s/s": (1, {"m": 1, "s": -2}),
    "kg/(m.s2)": (1, {"kg": 1, "m": -1, "s": -2}), "kg/(m/(s.s))": (1, {"kg": 1, "m": -1, "s": 2}), "a/b.c": None, "m/s.kg": (1, {"m": 1, "s": -1, "kg": 1}), "mM": (1.0, {"mol": 1, "m": -3}), "Mm": (1e6, {"m": 1}),
    "µV": (1e-6, {"kg": 1, "m": 2, "s": -3, "A": -1}), "nmol/L/min": (1e-9 / 1e-3 / 60, {"mol": 1, "m": -3, "s": -1}), "/s": (1, {"s": -1}), "cm²": (1e-4, {"m": 2}), "s^-1": (1, {"s": -1}),
    "Kilograms": (1, {"kg": 1}), "milliseconds": (1e-3, {"s": 1}), "min": (60, {"s": 1}), "cd": (1, {"cd": 1}), "ft": (0.3048, {"m": 1}), "%": (0.01, {}), "mg kg-1 d-1": (1e-6 / 86400, {"s": -1}),
    "100 g": (0.1, {"kg": 1}), "mmHg": (133.322387415, {"kg": 1, "m": -1, "s": -2}), "degC": (1, {"K": 1}), "(m)": (1, {"m": 1}), "1/s": (1, {"s": -1}), "µg/dL": (1e-9 / 1e-4, {"kg": 1, "m": -3}),
    "": None, "parsec-ish": None, "m//s": None, "m/": None, "(m": None, "m)": None, "^2": None, ".m": None, "m s-": None, "$": None, "5": (5, {}), "m 5": (5, {"m": 1}), "mg / mL": (1.0, {"kg": 1, "m": -3}), "m ^2": None, "()": None,
}


def test_units_are_read(spark):
    df = spark.createDataFrame([(u,) for u in READ] + [(None,)], "u string").select("u", ua.parsed(F.col("u")).alias("p"))
    got = {r.u: r.p for r in df.collect()}
    assert got.pop(None) is None
    for u, want in READ.items():
        if want is None:
            assert got[u] is None, u
        else:
            assert got[u] is not None, u
            assert got[u].scale == pytest.approx(want[0], rel=1e-12), u
            assert got[u].dims == [want[1].get(b, 0) for b in ua.BASES], u


@pytest.mark.parametrize(("a", "b", "want"), [("mg/mL", "g/L", 1.0), ("km/h", "m/s", 1 / 3.6), ("N.m", "J", 1.0), ("mmol/L", "mM", 1.0), ("kg", "s", None), ("kg", "nonsense", None), ("degC", "K", None), ("yr", "mo", 12.0), ("V/Ohm", "mA", 1000.0), ("lb/ft2", "kg/m2", 4.882427636383051), ("bpm", "Hz", 1 / 60)])
def test_factors(spark, a, b, want):
    (got,) = spark.range(1).select(ua.factor(ua.parsed(F.lit(a)), ua.parsed(F.lit(b)))).first()
    assert got is None if want is None else got == pytest.approx(want, rel=1e-12)


def test_temperatures(spark):
    rows = spark.createDataFrame([(37.0, "degC", "degF", 98.6), (98.6, "°F", "K", 310.15), (0.0, "K", "celsius", -273.15), (5.0, "degC", "m", None), (2.0, "degC/min", "K/s", 2 / 60)], "v double, a string, b string, want double")
    for r in rows.withColumn("got", ua.converted(F.col("v"), ua.parsed(F.col("a")), ua.parsed(F.col("b")))).collect():
        assert r.got is None if r.want is None else r.got == pytest.approx(r.want, rel=1e-9)


def test_every_prefixed_unit_is_its_power_of_ten(spark):
    taken = {**ua.PREFIXED, **ua.PLAIN}
    want = {p + u: (scale * 10.0**power, dims) for u, (_, scale, dims) in ua.PREFIXED.items() for p, power in ua.PREFIXES.items() if p + u not in taken}
    clash = {p + u for u in ua.PREFIXED for p in ua.PREFIXES for q in ua.PREFIXES for w in ua.PREFIXED if p + u == q + w and p != q}
    rows = spark.createDataFrame([(u,) for u in want if u not in clash], "u string").select("u", ua.parsed(F.col("u")).alias("p")).collect()
    for r in rows:
        assert r.p is not None and r.p.scale == pytest.approx(want[r.u][0], rel=1e-12) and r.p.dims == [want[r.u][1].get(b, 0) for b in ua.BASES], r.u


def test_scales_are_rounded_once(spark):
    """Quotients of decimal units are the doubles nearest to them, not those of a product of powers."""
    want = {"ug/L": 1e-6, "g/mL": 1e3, "cm-1": 100.0, "km/h": 1 / 3.6, "mg/dL": 1e-2, "pg/nL": 1e-3, "ft": 0.3048, "s/min": 1 / 60}
    got = {r.u: r.p.scale for r in spark.createDataFrame([(u,) for u in want], "u string").select("u", ua.parsed(F.col("u")).alias("p")).collect()}
    assert got == want
