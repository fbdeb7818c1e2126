"""Lifetime value and ROI: cases re-expressed from the original tests."""

from pyspark.sql import functions as F

from staysignal.operators import scoring as S

from .conftest import SF


def clv_row(spark, m, t, p_pct, contract):
    df = spark.createDataFrame([(m, t, p_pct, contract)],
                               "MonthlyCharges double, tenure double, Churn_Probability double, Contract string")
    return S.add_clv(df).first()


def test_clv_probability_zero_and_one(spark):
    r0 = clv_row(spark, 70.0, 12.0, 0.0, "Month-to-month")
    assert r0.CLV_Estimate == 70.0 * 12 and r0.Revenue_at_Risk == 0.0
    r1 = clv_row(spark, 70.0, 12.0, 100.0, "Month-to-month")
    assert r1.CLV_Estimate == 0.0 and r1.Revenue_at_Risk == 70.0 * 12


def test_clv_tenure_beyond_expected_is_zero(spark):
    r = clv_row(spark, 50.0, 100.0, 40.0, "Two year")
    assert r.remaining_months == 0.0 and r.CLV_Estimate == 0.0 and r.Revenue_at_Risk == 0.0


def test_unknown_contract_uses_24_months(spark):
    assert clv_row(spark, 10.0, 4.0, 0.0, "Weekly").remaining_months == 20.0


def test_clv_plus_rar_equals_value_of_remaining_months(spark):
    r = clv_row(spark, 64.3, 5.0, 37.5, "One year")
    assert abs(r.CLV_Estimate + r.Revenue_at_Risk - 64.3 * 31) < 0.02


def test_missing_columns_use_defaults(spark):
    df = spark.createDataFrame([(40.0, "Churn")], "Churn_Probability double, Prediction string")
    r = S.add_clv(df).first()
    # 65.0 a month, 12 months of tenure, month-to-month -> 12 months remaining
    assert r.remaining_months == 12.0
    assert r.CLV_Estimate == round(65.0 * 12 * 0.6, 2)


def roi(spark, base, new, m, t, contract, cost):
    df = spark.createDataFrame([(base, new, m, t, contract, cost)],
                               "b double, n double, m double, t double, c string, cost double")
    cols = S.roi_columns(F.col("b"), F.col("n"), F.col("m"), F.col("t"), F.col("c"), F.col("cost"))
    return df.select(*[v.alias(k) for k, v in cols.items()]).first()


def test_roi_basic_case(spark):
    r = roi(spark, 0.7, 0.3, 65.0, 6.0, "Month-to-month", 50.0)
    assert abs(r.revenue_saved - 65.0 * 0.4 * 18) < 0.01
    assert abs(r.net_roi - (r.revenue_saved - 50.0)) < 0.011
    assert r.break_even_months == round(50.0 / (65.0 * 0.4), 1)


def test_roi_zero_cost_gives_zero_pct(spark):
    assert roi(spark, 0.7, 0.3, 65.0, 6.0, "Month-to-month", 0.0).roi_pct == 0.0


def test_roi_no_improvement_has_no_break_even(spark):
    r = roi(spark, 0.3, 0.5, 65.0, 6.0, "Month-to-month", 20.0)
    assert r.prob_reduction == 0.0 and r.revenue_saved == 0.0 and r.break_even_months is None


def test_longer_contract_saves_more(spark):
    a = roi(spark, 0.7, 0.3, 65.0, 6.0, "Month-to-month", 20.0)
    b = roi(spark, 0.7, 0.3, 65.0, 6.0, "Two year", 20.0)
    assert b.revenue_saved > a.revenue_saved


def test_any_scorer_gives_the_scorecards_rows(spark):
    from staysignal.functions import scorecard
    from staysignal.operators import evaluate as EV
    from staysignal.operators import scoring as S
    from staysignal.plans.context import cust
    c = cust(spark, SF)

    def rows(df):
        return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)

    for fn in (S.recommend, S.recommend_roi, S.best_roi_action, S.what_if):
        assert rows(fn(c, scorer=scorecard.score)) == rows(fn(c)), fn.__name__
    risky = c.limit(1).withColumns({"tenure": F.lit(1), "Contract": F.lit("Month-to-month")})
    loyal = c.limit(1).withColumns({"tenure": F.lit(70), "Contract": F.lit("Two year")})
    assert S.score_batch(risky).first().p > S.score_batch(loyal).first().p
    assert [r.grid_value for r in EV.partial_dependence(c, "SeniorCitizen").orderBy("grid_index").collect()] == [0, 1]


def test_each_probability_is_computed_once(spark):
    from staysignal.operators import scoring as S
    from staysignal.plans.context import cust
    for fn in (S.recommend_roi, S.best_roi_action, S.what_if):
        plan = fn(cust(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("EXP(") <= 9, fn.__name__
