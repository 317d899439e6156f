"""AGG1 semantics, alignment cases (FIXTURES F4), sampling properties."""

import math

import pytest
from pyspark.sql import functions as F

from riskframe.operators import rollup as R
from riskframe.operators import sampling as S
from riskframe.operators.align import FeatureSpec, RequestedRule, align_rows
from riskframe.operators.rollup import agg_numeric_and_cat
from riskframe.plans.tables import Tables
from tests.conftest import SF_SMALL


def test_rollup_pandas_semantics(spark):
    df = spark.createDataFrame(
        [(1, 2.0, "a"), (1, None, None), (2, None, "b"), (None, 5.0, "a")], "k long, x double, c string")
    out = {r.k: r for r in agg_numeric_and_cat(df, "k", "P_").collect()}
    assert set(out) == {1, 2}                      # NULL key dropped
    assert out[2]["P_x_SUM"] == 0.0                # all-missing sum is 0
    assert out[2]["P_x_MEAN"] is None and out[2]["P_x_MIN"] is None
    assert out[1]["P_x_VAR"] is None               # one value: var undefined
    assert out[1]["P_c_a_MEAN"] == 0.5 and out[1]["P_c_nan_MEAN"] == 0.5
    assert out[2]["P_c_b_MEAN"] == 1.0 and out[2]["P_c_nan_MEAN"] == 0.0


FEATURES = ["AMT", "FLAG_OWN", "NAME_EDUCATION_TYPE_Higher education", "NAME_EDUCATION_TYPE_Secondary",
            "ORGANIZATION_TYPE_Business Entity Type 3"]


def align_one(spark, row: dict, strict=True, rule=None):
    spec = FeatureSpec.of(FEATURES)
    df = spark.createDataFrame([(0, {k: (None if v is None else str(v)) for k, v in row.items()})],
                               "row_index long, features map<string,string>")
    return align_rows(df, spec, strict=strict, rule=rule).first()


@pytest.mark.parametrize("value", ["  ", "NaN", "None", "null", None])
def test_missing_tokens(spark, value):
    r = align_one(spark, {"AMT": value})
    assert r["AMT"] is None and r["reject_reason"] is None


def test_decimal_comma_and_invalid_number(spark):
    assert align_one(spark, {"AMT": "1,23"})["AMT"] == 1.23
    assert align_one(spark, {"AMT": "abc"})["reject_reason"] == "invalid_number"
    assert align_one(spark, {"AMT": "1.5d"})["reject_reason"] == "invalid_number"


@pytest.mark.parametrize("value,expected", [("Oui", 1.0), ("t", 1.0), ("non", 0.0), ("F", 0.0)])
def test_binary_tokens(spark, value, expected):
    assert align_one(spark, {"FLAG_OWN": value})["FLAG_OWN"] == expected


def test_binary_rejects_numeric_text(spark):
    assert align_one(spark, {"FLAG_OWN": "1.0"})["reject_reason"] == "invalid_binary"


def test_group_expansion_and_normalisation(spark):
    r = align_one(spark, {"NAME_EDUCATION_TYPE": " Higher   Education "})
    assert r["NAME_EDUCATION_TYPE_Higher education"] == 1.0 and r["NAME_EDUCATION_TYPE_Secondary"] == 0.0
    assert r["used_groups"] == ["NAME_EDUCATION_TYPE"]
    # full dummy name accepted as a value
    r = align_one(spark, {"NAME_EDUCATION_TYPE": "name_education_type_secondary"})
    assert r["NAME_EDUCATION_TYPE_Secondary"] == 1.0
    # the one-dummy prefix is not a group
    assert "ORGANIZATION_TYPE" not in FeatureSpec.of(FEATURES).groups


def test_unknown_category_and_keys(spark):
    assert align_one(spark, {"NAME_EDUCATION_TYPE": "phd"})["reject_reason"] == "invalid_category"
    assert align_one(spark, {"NOPE": "1"})["reject_reason"] == "unknown_keys"
    assert align_one(spark, {"NOPE": "1"}, strict=False)["reject_reason"] is None


def test_direct_dummy_overrides_group(spark):
    r = align_one(spark, {"NAME_EDUCATION_TYPE": "secondary", "NAME_EDUCATION_TYPE_Higher education": "1"})
    assert r["NAME_EDUCATION_TYPE_Higher education"] == 1.0 and r["NAME_EDUCATION_TYPE_Secondary"] == 1.0


def test_fill_rule(spark):
    rule = RequestedRule(["AMT", "NAME_EDUCATION_TYPE"], 1.0)
    r = align_one(spark, {"AMT": "3"}, rule=rule)
    assert r["reject_reason"] == "insufficient_filled_requested" and r["filled_count"] == 1
    assert RequestedRule.read({"required_groups": ["A"], "min_filled_rate_groups": "x"}).min_rate == 0.0
    assert RequestedRule.read({"requested_groups": ["A"], "min_filled_rate_requested": 7}).min_rate == 1.0


def test_fold_and_split_properties(spark):
    ev = Tables(spark, SF_SMALL).events.select("event_id", (F.col("event_type") == "error").cast("int").alias("y"))
    folds = S.stratified_folds(ev, "y", "event_id", 3)
    counts = {(r.y, r.fold): r["count"] for r in folds.groupBy("y", "fold").count().collect()}
    for y in (0, 1):
        sizes = [counts.get((y, f), 0) for f in range(3)]
        assert max(sizes) - min(sizes) <= 1
    n = ev.count()
    split = S.stratified_split(ev, "y", "event_id", 0.2)
    assert split.filter("is_test").count() == math.ceil(0.2 * n)
    # ranks are exactly 1..n_class inside each class
    ranks = S.rank_within(ev, "y", "event_id").groupBy("y").agg(F.min("rank").alias("a"), F.max("rank").alias("b"),
                                                                 F.count("*").alias("n")).collect()
    for r in ranks:
        assert r.a == 1 and r.b == r.n


def test_json_typed_numbers_for_binary_fields(spark):
    from riskframe.sources.tables import compact_rows_from_json
    spec = FeatureSpec.of(FEATURES)
    df = spark.createDataFrame([(1, '{"FLAG_OWN": 1.0}'), (2, '{"FLAG_OWN": "1.0"}'), (3, '{"FLAG_OWN": 2}'),
                                (4, '{"AMT": "1,5", "FLAG_OWN": "oui"}'), (5, "[1, 2]"), (6, "not json")],
                               "i long, j string")
    rows = compact_rows_from_json(df, "j", "i")
    out = {r.row_index: r for r in align_rows(rows, spec).collect()}
    assert out[1]["FLAG_OWN"] == 1.0 and out[1]["reject_reason"] is None
    assert out[2]["reject_reason"] == "invalid_binary"
    assert out[3]["reject_reason"] == "invalid_binary"
    assert out[4]["AMT"] == 1.5 and out[4]["FLAG_OWN"] == 1.0
    assert out[5]["reject_reason"] == "invalid_input" and out[6]["reject_reason"] == "invalid_input"


def test_fail_fast_reports_lowest_rejected_row(spark):
    from riskframe.operators.align import BatchRejected, fail_fast, split_batch
    spec = FeatureSpec.of(FEATURES)
    df = spark.createDataFrame([(0, {"AMT": "1"}), (7, {"AMT": "x"}), (3, {"NOPE": "1"})],
                               "row_index long, features map<string,string>")
    aligned = align_rows(df, spec)
    ok, bad = split_batch(aligned)
    assert ok.count() == 1 and bad.count() == 2
    with pytest.raises(BatchRejected) as e:
        fail_fast(aligned)
    assert e.value.row_index == 3 and e.value.reason == "unknown_keys"


def _close(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12))


def _exchanged(df):
    """Columns of each shuffle in the plan."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.initialPlan()
    out, todo = [], [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            out.append(node.output().size())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_rows_are_shuffled_where_keys_do_not_meet(spark):
    """A key whose rows are spread over the tasks: the shuffle carries the rows, not partial rows several times as wide."""
    rows = spark.range(20_000).repartition(4).selectExpr("id % 9000 AS k", "id % 7 * 1.5D AS x", "cast(id % 11 as double) AS y", "if(id % 3 = 0, 'a', 'b') AS c")
    out = agg_numeric_and_cat(rows, "k", "P_")
    assert _exchanged(out)[0] == 4
    combined = agg_numeric_and_cat(rows, "k", "P_", plan=R.ShufflePlan(True))
    assert _exchanged(combined)[0] > 12
    want = {r.k: r for r in combined.collect()}
    got = {r.k: r for r in out.collect()}
    assert set(got) == set(want) and all(_close(a, b) for k in got for a, b in zip(got[k], want[k]))


def test_hot_keys_are_combined_in_map_tasks(spark, monkeypatch):
    """A key with a third of the rows among many others is found and is not sent to one task row by row."""
    monkeypatch.setattr(R, "HOT_ROWS", 500)
    rows = spark.range(30_000).repartition(4).selectExpr("if(id % 3 = 0, -1, id) AS k", "cast(id % 13 as double) AS x", "cast(null as string) AS c")
    spec = R.rollup_spec(rows, "k", "P_")
    plan = R.shuffle_plan(rows, "k", spec)
    assert plan == R.ShufflePlan(False, [-1])
    out = agg_numeric_and_cat(rows, "k", "P_", spec=spec, plan=plan)
    got = {r.k: r for r in out.collect()}
    want = {r.k: r for r in agg_numeric_and_cat(rows, "k", "P_", spec=spec, plan=R.ShufflePlan(True)).collect()}
    assert len(got) == 20_001 and all(_close(a, b) for k in got for a, b in zip(got[k], want[k]))
    few = spark.range(10_000).selectExpr("id % 5 AS k", "1.0D AS x")
    assert R.shuffle_plan(few, "k", R.rollup_spec(few, "k", "P_")).combine
