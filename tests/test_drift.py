"""DR1-DR9 against the FIXTURES F2 drift pair and PSI properties."""

import math

import pytest

from riskframe.operators import drift as D

REF = [(1.0, "x", 10.0), (1.5, "x", 10.5), (2.0, "y", 11.0), (2.5, "y", 11.5)]
PROD = [(1.0, "x", None), (2.0, "y", 10.0), (3.0, "x", 11.0)]
SCHEMA = "A double, B string, C double"


def report(spark, ref, prod, schema=SCHEMA, **kw):
    r = spark.createDataFrame(ref, schema)
    p = spark.createDataFrame(prod, schema)
    return {row.feature: row for row in D.compute_drift(r, p, **kw).collect()}


def test_fixture_f2(spark):
    rep = report(spark, REF, PROD, bins=5, cat_top_k=10)
    assert math.isclose(rep["A"].psi, 3.179212138107844, rel_tol=1e-12)
    assert math.isclose(rep["B"].psi, 0.115524530093324, rel_tol=1e-12)
    assert math.isclose(rep["C"].psi, 9.423241137011738, rel_tol=1e-12)
    assert rep["A"].type == "numeric" and rep["B"].type == "categorical"
    assert math.isclose(rep["C"].prod_missing_rate, 1 / 3) and rep["C"].ref_missing_rate == 0.0
    assert math.isclose(rep["C"].missing_rate_delta, 1 / 3)
    assert rep["A"].ref_n == 4 and rep["A"].prod_n == 3


def test_identical_sides_zero(spark):
    rep = report(spark, REF, REF)
    for f in "ABC":
        assert abs(rep[f].psi) < 1e-12


def test_constant_reference(spark):
    rep = report(spark, [(1.0,), (1.0,), (None,)], [(1.0,), (None,), (None,)], "A double")
    a_ref, a_prod = 2 / 3, 1 / 3
    exp = (a_ref - a_prod) * math.log(a_ref / a_prod) + (a_prod - a_ref) * math.log(a_prod / a_ref)
    assert math.isclose(rep["A"].psi, exp, rel_tol=1e-12)


def test_empty_production_is_null(spark):
    rep = report(spark, REF, [])
    assert rep["A"].psi is None and rep["A"].prod_missing_rate is None


def test_production_fully_missing(spark):
    rep = report(spark, REF, [(None, None, None)] * 2)
    # bin shares undefined and skipped; MISSING: ref 0 -> eps, prod 1 (renormalised by its own sum)
    exp = (1e-6 - 1.0) * math.log(1e-6 / 1.0)
    assert math.isclose(rep["A"].psi, exp, rel_tol=1e-9)


def test_union_of_columns(spark):
    r = spark.createDataFrame([(1.0,), (2.0,)], "A double")
    p = spark.createDataFrame([(1.0, 5.0), (2.0, 6.0)], "A double, Z double")
    rep = {row.feature: row for row in D.compute_drift(r, p).collect()}
    assert set(rep) == {"A", "Z"}
    assert rep["Z"].ref_missing_rate == 1.0 and rep["Z"].prod_missing_rate == 0.0


def psi_numeric_np(ref, prod, bins):
    """Independent NumPy reading of the documented numeric PSI."""
    import numpy as np
    ref, prod = np.asarray(ref, float), np.asarray(prod, float)
    rv, pv = ref[~np.isnan(ref)], prod[~np.isnan(prod)]
    edges = np.unique(np.quantile(rv, np.linspace(0, 1, bins + 1)))
    if len(edges) < 3:
        edges = np.linspace(rv.min(), rv.max(), bins + 1)
    inner = edges[1:-1]
    nb = len(edges) - 1

    def shares(v, all_):
        b = np.array([np.sum(inner < x) for x in v])
        s = np.array([np.mean(b == i) for i in range(nb)] + [np.mean(np.isnan(all_))])
        return s / s.sum()
    a, c = np.maximum(shares(rv, ref), 1e-6), np.maximum(shares(pv, prod), 1e-6)
    return float(np.sum((a - c) * np.log(a / c)))


@pytest.mark.parametrize("ref,prod", [
    ([0.0] * 100 + [1.0], [0.05, 0.5, 0.95, 1.0, float("nan")]),            # two-edge fallback
    ([0.0] * 9 + [1.0], [0.0, 0.1, 0.5, 2.0]),                              # duplicate edges
    ([float(i % 7) for i in range(50)] + [float("nan")] * 5, [1.0, 2.0, 2.0, 6.5, -3.0]),
])
def test_numeric_psi_against_numpy(spark, ref, prod):
    import numpy as np
    to_row = lambda x: (None if np.isnan(x) else x,)
    rep = report(spark, [to_row(x) for x in ref], [to_row(x) for x in prod], "A double", bins=10)
    assert math.isclose(rep["A"].psi, psi_numeric_np(ref, prod, 10), rel_tol=1e-9)


def test_severity_bands(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(0.05,), (0.1,), (0.25,), (0.3,), (None,)], "psi double")
    got = [r[0] for r in df.select(D.severity(F.col("psi"))).collect()]
    assert got == ["low", "moderate", "high", "severe", None]


def test_categorical_top_k_against_python(spark):
    import random
    rng = random.Random(7)
    ref = [(f"c{rng.randint(0, 40)}" if rng.random() > 0.05 else None,) for _ in range(600)]
    prod = [(f"c{rng.randint(0, 60)}" if rng.random() > 0.1 else None,) for _ in range(400)]
    rep = report(spark, ref, prod, "B string", cat_top_k=5)

    def mapped(rows, top):
        out = {}
        for (v,) in rows:
            k = "MISSING" if v is None else (v if v in top else "OTHER")
            out[k] = out.get(k, 0) + 1
        return {k: c / len(rows) for k, c in out.items()}
    counts = {}
    for (v,) in ref:
        counts[v] = counts.get(v, 0) + 1
    ranked = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0] is None, kv[0] or ""))
    top = {v for v, _ in ranked[:5]}
    a, b = mapped(ref, top), mapped(prod, top)
    exp = 0.0
    for k in set(a) | set(b):
        x, y = max(a.get(k, 0.0), 1e-6), max(b.get(k, 0.0), 1e-6)
        exp += (x - y) * math.log(x / y)
    assert math.isclose(rep["B"].psi, exp, rel_tol=1e-9)
