"""Plans for scoring, value, actions, top-k and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import ACTIONS, CALIBRATION_BINS, ID_COL, SHAP_BINS, WATERFALL_TOP, WHAT_IF_SCENARIO
from ..functions import scorecard
from ..functions.numeric import round_half_up_sql as rhu
from ..functions.value import expected_months
from ..operators import clean as K
from ..operators import evaluate as EV
from ..operators import scoring as S
from ..operators import segments as G
from ..session import shared_path
from ..sources.tables import read_table
from ..streaming import history as H
from .catalog import query
from .context import cust, raw
from .oracle import oracle
from .sqlbase import CLEAN_SELECT, margin_sql, prob_sql, with_ctes

# ---------------------------------------------------------------------------
# shared inputs
# ---------------------------------------------------------------------------


def batch_input(spark, sf):
    """Scoring input: no label, and cleaning that drops no row."""
    return K.preprocess_score_input(raw(spark, sf).drop("Churn"))


def batch_scored(spark, sf):
    return S.add_clv(S.score_batch(batch_input(spark, sf)))


def eval_table(spark, sf):
    c = cust(spark, sf)
    return c.select(ID_COL, F.col("Churn").alias("y"), scorecard.probability().alias("p"))


BAT_CTE = f"bat AS (SELECT * EXCLUDE (Churn) FROM ({CLEAN_SELECT}) t)"

_EXPECTED_SQL = ("CASE Contract WHEN 'Month-to-month' THEN 24.0e0 WHEN 'One year' THEN 36.0e0 "
                 "WHEN 'Two year' THEN 60.0e0 ELSE 24.0e0 END")
_REM_SQL = f"GREATEST(0.0e0, {_EXPECTED_SQL} - CAST(tenure AS DOUBLE))"
_RISK_SQL = ("CASE WHEN p >= 0 AND p <= 0.3 THEN 'Low' WHEN p > 0.3 AND p <= 0.6 THEN 'Medium' "
             "WHEN p > 0.6 AND p <= 1.0 THEN 'High' END")
BSC_CTE = (f"bs0 AS (SELECT *, {prob_sql()} AS p FROM bat),\n"
           f"bs1 AS (SELECT *, {rhu('p * 100.0e0', 1)} AS Churn_Probability, "
           f"CASE WHEN p >= 0.5e0 THEN 'Churn' ELSE 'Stay' END AS Prediction, {_RISK_SQL} AS Risk_Level FROM bs0),\n"
           f"bsc AS (SELECT *, {_REM_SQL} AS remaining_months, "
           f"{rhu(f'MonthlyCharges * {_REM_SQL} * (1.0e0 - Churn_Probability / 100.0e0)', 2)} AS CLV_Estimate, "
           f"{rhu(f'MonthlyCharges * (Churn_Probability / 100.0e0) * {_REM_SQL}', 2)} AS Revenue_at_Risk FROM bs1)")
EV_CTE = f"ev AS (SELECT customerID, Churn AS y, {prob_sql()} AS p FROM cust)"


def bsql(body: str, *extra: str) -> str:
    return with_ctes(body, BAT_CTE, BSC_CTE, *extra)


def esql(body: str, *extra: str) -> str:
    return with_ctes(body, EV_CTE, *extra)


# ---------------------------------------------------------------------------
# scoring and batch insights
# ---------------------------------------------------------------------------

_SCORE_OUT = ["customerID", "Contract", "tenure", "MonthlyCharges", "p", "Churn_Probability", "Prediction",
              "Risk_Level"]


@query("score_batch")
def q_score_batch(spark, sf):
    return S.score_batch(batch_input(spark, sf)).select(*_SCORE_OUT)


oracle("score_batch", bsql(f"SELECT {', '.join(_SCORE_OUT)} FROM bsc"))


@query("score_with_id")
def q_score_with_id(spark, sf):
    scores = S.score_batch(batch_input(spark, sf)).select(ID_COL, "Churn_Probability")
    return cust(spark, sf).select(ID_COL, "Contract", "Churn").join(scores, ID_COL, "left")


oracle("score_with_id", bsql(
    "SELECT c.customerID, c.Contract, c.Churn, b.Churn_Probability FROM cust c LEFT JOIN bsc b "
    "ON c.customerID = b.customerID"))


@query("batch_summary")
def q_batch_summary(spark, sf):
    s = batch_scored(spark, sf)
    churn = F.col("Prediction") == "Churn"
    return s.agg(F.count(F.lit(1)).alias("total"), F.count_if(churn).alias("churn_n"),
                 F.count_if(~churn).alias("stay_n"),
                 F.round(F.count_if(churn) * 100.0 / F.count(F.lit(1)), 4).alias("churn_rate_pct"),
                 F.round(F.avg("Churn_Probability"), 4).alias("mean_prob_pct"))


BATCH_SUMMARY_SQL = (
    "SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE Prediction = 'Churn') AS churn_n, "
    "COUNT(*) FILTER (WHERE Prediction <> 'Churn') AS stay_n, "
    "ROUND(COUNT(*) FILTER (WHERE Prediction = 'Churn') * 100.0 / COUNT(*), 4) AS churn_rate_pct, "
    "ROUND(AVG(Churn_Probability), 4) AS mean_prob_pct FROM bsc")
oracle("batch_summary", bsql(BATCH_SUMMARY_SQL))


@query("risk_distribution")
def q_risk_distribution(spark, sf):
    return batch_scored(spark, sf).groupBy("Risk_Level").agg(F.count(F.lit(1)).alias("n"))


oracle("risk_distribution", bsql("SELECT Risk_Level, COUNT(*) AS n FROM bsc GROUP BY Risk_Level"))


@query("rar_by_contract")
def q_rar_by_contract(spark, sf):
    return (batch_scored(spark, sf).groupBy("Contract")
            .agg(F.round(F.sum("Revenue_at_Risk"), 2).alias("revenue_at_risk"))
            .orderBy("revenue_at_risk"))


oracle("rar_by_contract", bsql(
    "SELECT Contract, ROUND(SUM(Revenue_at_Risk), 2) AS revenue_at_risk FROM bsc GROUP BY Contract "
    "ORDER BY revenue_at_risk"))

_TOP_RISK_COLS = ["customerID", "Contract", "tenure", "MonthlyCharges", "InternetService", "Churn_Probability",
                  "Risk_Level", "Revenue_at_Risk", "CLV_Estimate"]


@query("top_risk")
def q_top_risk(spark, sf):
    return G.top_n(batch_scored(spark, sf), [F.desc("Churn_Probability"), F.asc(ID_COL)], 10, _TOP_RISK_COLS)


oracle("top_risk", bsql(
    f"SELECT {', '.join(_TOP_RISK_COLS)} FROM bsc ORDER BY Churn_Probability DESC, customerID LIMIT 10"))


@query("clv")
def q_clv(spark, sf):
    return batch_scored(spark, sf).select(ID_COL, "Churn_Probability", "remaining_months", "CLV_Estimate",
                                          "Revenue_at_Risk")


oracle("clv", bsql("SELECT customerID, Churn_Probability, remaining_months, CLV_Estimate, Revenue_at_Risk FROM bsc"))


@query("clv_simple")
def q_clv_simple(spark, sf):
    return S.clv_simple(cust(spark, sf)).select(ID_COL, "CLV")


oracle("clv_simple", with_ctes(f"SELECT customerID, {rhu('MonthlyCharges * tenure', 2)} AS CLV FROM cust"))


@query("top_clv_simple")
def q_top_clv_simple(spark, sf):
    return G.top_n(S.clv_simple(cust(spark, sf)), [F.desc("CLV"), F.asc(ID_COL)], 5,
                   [ID_COL, "MonthlyCharges", "tenure", "CLV"])


oracle("top_clv_simple", with_ctes(
    f"SELECT customerID, MonthlyCharges, tenure, {rhu('MonthlyCharges * tenure', 2)} AS CLV FROM cust "
    "ORDER BY CLV DESC, customerID LIMIT 5"))


@query("lookup_join")
def q_lookup_join(spark, sf):
    from ..constants import EXPECTED_TOTAL_MONTHS
    dim = spark.createDataFrame([(k, float(v)) for k, v in EXPECTED_TOTAL_MONTHS.items()],
                                "Contract string, expected_months double")
    # the dimension is the fixed 3-row contract catalog: a proven size bound
    j = cust(spark, sf).select(ID_COL, "Contract").join(F.broadcast(dim), "Contract", "left")
    return j.select(ID_COL, "Contract", F.coalesce("expected_months", F.lit(24.0)).alias("expected_months"))


oracle("lookup_join", with_ctes(f"SELECT customerID, Contract, {_EXPECTED_SQL} AS expected_months FROM cust"))


@query("expected_months")
def q_expected_months(spark, sf):
    return cust(spark, sf).select(ID_COL, expected_months("Contract").alias("expected_months"))


oracle("expected_months", with_ctes(f"SELECT customerID, {_EXPECTED_SQL} AS expected_months FROM cust"))


@query("recent_predictions")
def q_recent_predictions(spark, sf):
    """Requests (the events' users) land as files, a stream scores them into the history, whose newest rows are read."""
    landing, path, chk = (shared_path(spark, n) for n in ("requests", "history", "history-chk"))
    ev = read_table(spark, sf, "events", ["event_id", "ts", "user_id"])
    ev.select("event_id", "ts", F.concat(F.lit("C"), F.col("user_id").cast("string")).alias(ID_COL)) \
      .repartition(4).write.parquet(landing)
    H.start_history(spark, landing, batch_input(spark, sf), path, chk, files_per_batch=2).awaitTermination()
    return H.recent(spark.read.parquet(path))


oracle("recent_predictions", bsql(
    "SELECT event_id, ts, customerID, Contract, tenure, MonthlyCharges, InternetService, TechSupport, Churn_Probability, "
    "Prediction, Risk_Level, CLV_Estimate, Revenue_at_Risk FROM bsc JOIN events ON customerID = "
    "CONCAT('C', CAST(user_id AS VARCHAR(20))) ORDER BY ts DESC, event_id DESC LIMIT 20"))


@query("head_preview")
def q_head_preview(spark, sf):
    return G.head_preview(cust(spark, sf), 5)


oracle("head_preview", with_ctes("SELECT * FROM cust ORDER BY customerID LIMIT 5"))


@query("union_sources")
def q_union_sources(spark, sf):
    c = cust(spark, sf)
    a = c.filter(F.col("Contract") == "Month-to-month").select(ID_COL, "tenure", "MonthlyCharges", "Churn")
    b = c.filter(F.col("Contract") != "Month-to-month").select(ID_COL, "tenure", "Contract")
    return G.union_sources(a, b)


oracle("union_sources", with_ctes(
    "SELECT customerID, tenure, MonthlyCharges, Churn, NULL::VARCHAR AS Contract FROM cust "
    "WHERE Contract = 'Month-to-month' UNION ALL SELECT customerID, tenure, NULL::DOUBLE, NULL::INTEGER, Contract "
    "FROM cust WHERE Contract <> 'Month-to-month'"))


@query("worst_segment_per_feature")
def q_worst_segment_per_feature(spark, sf):
    return G.worst_segment_per_feature(cust(spark, sf), ["Contract", "InternetService", "PaymentMethod"])


oracle("worst_segment_per_feature", with_ctes(
    "SELECT feature, value, ROUND(rate * 100, 4) AS churn_rate_pct, n FROM (SELECT feature, value, rate, n, "
    "ROW_NUMBER() OVER (PARTITION BY feature ORDER BY rate DESC, value) AS rk FROM (SELECT feature, value, "
    "AVG(Churn) AS rate, COUNT(*) AS n FROM (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {f} AS value, Churn FROM cust" for f in
        ["Contract", "InternetService", "PaymentMethod"]) + ") u GROUP BY feature, value) g) r WHERE rk = 1"))

# ---------------------------------------------------------------------------
# actions, recommendations, ROI, what-if
# ---------------------------------------------------------------------------

_ACTS_CTE = ("acts AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{a}', '{t}', '{cat}')" for a, t, _, cat in ACTIONS) + ") v(action_id, title, category))")
_ELIG_SQL = {
    "upgrade_2yr": "c.Contract = 'Month-to-month'",
    "upgrade_1yr": "c.Contract = 'Month-to-month'",
    "add_tech_support": "c.TechSupport = 'No' AND c.InternetService <> 'No'",
    "add_online_security": "c.OnlineSecurity = 'No' AND c.InternetService <> 'No'",
    "add_online_backup": "c.OnlineBackup = 'No' AND c.InternetService <> 'No'",
    "device_protection": "c.DeviceProtection = 'No' AND c.InternetService <> 'No'",
    "switch_auto_payment": "c.PaymentMethod = 'Electronic check'",
    "loyalty_discount": "COALESCE(c.MonthlyCharges, 0.0e0) > 70.0e0",
}
_NEW_SQL = {
    "Contract": "CASE a.action_id WHEN 'upgrade_2yr' THEN 'Two year' WHEN 'upgrade_1yr' THEN 'One year' ELSE c.Contract END",
    "TechSupport": "CASE WHEN a.action_id = 'add_tech_support' THEN 'Yes' ELSE c.TechSupport END",
    "OnlineSecurity": "CASE WHEN a.action_id = 'add_online_security' THEN 'Yes' ELSE c.OnlineSecurity END",
    "OnlineBackup": "CASE WHEN a.action_id = 'add_online_backup' THEN 'Yes' ELSE c.OnlineBackup END",
    "DeviceProtection": "CASE WHEN a.action_id = 'device_protection' THEN 'Yes' ELSE c.DeviceProtection END",
    "PaymentMethod": "CASE WHEN a.action_id = 'switch_auto_payment' THEN 'Bank transfer (automatic)' ELSE c.PaymentMethod END",
    "MonthlyCharges": "CASE WHEN a.action_id = 'loyalty_discount' THEN GREATEST(COALESCE(c.MonthlyCharges, 65.0e0) * 0.85e0, 25.0e0) ELSE c.MonthlyCharges END",
}
_RX_CTE = ("rx AS (SELECT c.*, a.action_id, a.title, a.category, "
           + ", ".join(f"{v} AS new_{k}" for k, v in _NEW_SQL.items())
           + " FROM cust c JOIN acts a ON (" + " OR ".join(
               f"(a.action_id = '{k}' AND {v})" for k, v in _ELIG_SQL.items()) + "))")
_REC_CTE = (f"rc0 AS (SELECT *, {prob_sql()} AS baseline_prob, "
            f"{prob_sql({k: 'new_' + k for k in _NEW_SQL})} AS new_prob FROM rx),\n"
            f"rc1 AS (SELECT *, {rhu('baseline_prob - new_prob', 4)} AS delta FROM rc0),\n"
            f"rec AS (SELECT *, {rhu('delta * 100.0e0', 2)} AS delta_pct, CAST(ROW_NUMBER() OVER "
            "(PARTITION BY customerID ORDER BY delta DESC, action_id) AS INTEGER) AS rank FROM rc1)")


def rsql(body: str, *extra: str) -> str:
    return with_ctes(body, _ACTS_CTE, _RX_CTE, _REC_CTE, *extra)


@query("action_eligible")
def q_action_eligible(spark, sf):
    f = S.action_flags(cust(spark, sf))
    return f.select(ID_COL, *[c for c in f.columns if c.startswith("elig_")])


oracle("action_eligible", with_ctes("SELECT customerID, " + ", ".join(
    f"CASE WHEN {v.replace('c.', '')} THEN 1 ELSE 0 END AS elig_{k}" for k, v in _ELIG_SQL.items()) + " FROM cust"))


@query("customer_x_action")
def q_customer_x_action(spark, sf):
    return S.explode_actions(cust(spark, sf)).select(ID_COL, "action_id")


oracle("customer_x_action", with_ctes("SELECT customerID, action_id FROM rx", _ACTS_CTE, _RX_CTE))


@query("action_apply")
def q_action_apply(spark, sf):
    return S.explode_actions(cust(spark, sf)).select(ID_COL, "action_id", *[f"new_{k}" for k in _NEW_SQL])


oracle("action_apply", with_ctes(
    "SELECT customerID, action_id, " + ", ".join(f"new_{k}" for k in _NEW_SQL) + " FROM rx", _ACTS_CTE, _RX_CTE))

_REC_OUT = [ID_COL, "action_id", "title", "category", "baseline_prob", "new_prob", "delta", "delta_pct", "rank"]


@query("recommend")
def q_recommend(spark, sf):
    return S.recommend(cust(spark, sf)).select(*_REC_OUT)


oracle("recommend", rsql(f"SELECT {', '.join(_REC_OUT)} FROM rec"))


@query("best_action_per_customer")
def q_best_action_per_customer(spark, sf):
    return S.recommend(cust(spark, sf), 6).select(*_REC_OUT)


oracle("best_action_per_customer", rsql(f"SELECT {', '.join(_REC_OUT)} FROM rec WHERE rank <= 6"))

_ROI_OUT = ["prob_reduction", "revenue_saved", "cost", "net_roi", "roi_pct", "break_even_months", "monthly_rar"]


def _roi_sql(cost: str) -> str:
    red = "GREATEST(0.0e0, baseline_prob - new_prob)"
    saved = f"MonthlyCharges * {red} * {_REM_SQL}"
    net = f"({saved} - {cost})"
    return ", ".join([
        f"{rhu(red, 4)} AS prob_reduction", f"{rhu(saved, 2)} AS revenue_saved", f"{rhu(cost, 2)} AS cost",
        f"{rhu(net, 2)} AS net_roi",
        f"{rhu(f'CASE WHEN {cost} > 0 THEN {net} / {cost} * 100.0e0 ELSE 0.0e0 END', 1)} AS roi_pct",
        f"{rhu(f'CASE WHEN {red} > 0 AND MonthlyCharges > 0 THEN {cost} / (MonthlyCharges * {red}) END', 1)} "
        "AS break_even_months",
        f"{rhu('MonthlyCharges * baseline_prob', 2)} AS monthly_rar"])


_COST_SQL = "(CASE WHEN category = 'Pricing' THEN 50.0e0 ELSE 20.0e0 END)"


def _roi_cte():
    return f"roi AS (SELECT customerID, action_id, rank, baseline_prob, new_prob, MonthlyCharges, " \
           f"{_roi_sql(_COST_SQL)} FROM rec WHERE rank <= 6)"


@query("roi")
def q_roi(spark, sf):
    c = cust(spark, sf)
    rec = S.recommend(c)
    cols = S.roi_columns(F.col("baseline_prob"), F.col("new_prob"), F.col("MonthlyCharges"), F.col("tenure"),
                         F.col("Contract"), S.action_cost(F.col("category")))
    return rec.withColumns(cols).select(ID_COL, "action_id", *_ROI_OUT)


oracle("roi", rsql(f"SELECT customerID, action_id, {_roi_sql(_COST_SQL)} FROM rec"))


@query("recommend_roi")
def q_recommend_roi(spark, sf):
    return S.recommend_roi(cust(spark, sf)).select(ID_COL, "action_id", "rank", *_ROI_OUT)


oracle("recommend_roi", rsql("SELECT customerID, action_id, rank, " + ", ".join(_ROI_OUT) + " FROM roi",
                             _roi_cte()))


@query("best_roi_action")
def q_best_roi_action(spark, sf):
    return S.best_roi_action(cust(spark, sf)).select(ID_COL, "action_id", "roi_pct", "net_roi")


oracle("best_roi_action", rsql(
    "SELECT customerID, action_id, roi_pct, net_roi FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY customerID "
    "ORDER BY roi_pct DESC, rank) AS r FROM roi) t WHERE r = 1", _roi_cte()))


@query("breakeven_curve")
def q_breakeven_curve(spark, sf):
    return S.breakeven_curve(S.best_roi_action(cust(spark, sf)))


oracle("breakeven_curve", rsql(
    "SELECT customerID, action_id, CAST(m.month AS INTEGER) AS month, "
    f"{rhu('MonthlyCharges * GREATEST(0.0e0, baseline_prob - new_prob) * m.month', 2)} AS cumulative_saved, cost "
    "FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY customerID ORDER BY roi_pct DESC, rank) AS r FROM roi) t, "
    "(SELECT UNNEST(RANGE(0, 49)) AS month) m WHERE r = 1", _roi_cte()))


def _what_if_sql() -> str:
    parts = []
    diffs = []
    types = {"tenure": "BIGINT", "MonthlyCharges": "DOUBLE"}
    for feat, val in WHAT_IF_SCENARIO.items():
        lit = f"CAST({val!r} AS {types[feat]})" if feat in types else f"'{val}'"
        diff = f"CAST({feat} AS VARCHAR) <> '{val}'"
        diffs.append(diff)
        p = prob_sql({feat: lit})
        parts.append(f"SELECT customerID, baseline_prob, '{feat}' AS feature, '{val}' AS new_val, {p} AS probability "
                     f"FROM wb WHERE {diff}")
    allc = {f: (f"CAST({v!r} AS {types[f]})" if f in types else f"'{v}'") for f, v in WHAT_IF_SCENARIO.items()}
    parts.append(f"SELECT customerID, baseline_prob, 'combined', NULL::VARCHAR, {prob_sql(allc)} FROM wb WHERE "
                 + " OR ".join(diffs))
    body = " UNION ALL ".join(parts)
    return with_ctes(
        f"SELECT customerID, baseline_prob, feature, new_val, probability, {rhu('probability - baseline_prob', 4)} "
        "AS delta, CASE WHEN probability - baseline_prob > 0.01e0 THEN 'Higher Risk' WHEN probability - baseline_prob "
        "< -0.01e0 THEN 'Lower Risk' ELSE 'No Change' END AS direction FROM (" + body + ") s",
        f"wb AS (SELECT *, {prob_sql()} AS baseline_prob FROM cust)")


@query("what_if")
def q_what_if(spark, sf):
    return S.what_if(cust(spark, sf))


oracle("what_if", _what_if_sql())


@query("customer_x_scenario")
def q_customer_x_scenario(spark, sf):
    return S.customer_x_scenario(cust(spark, sf))


oracle("customer_x_scenario", "SELECT customerID, feature, new_val FROM (" + _what_if_sql() + ") q")


@query("profile_vs_average")
def q_profile_vs_average(spark, sf):
    return S.profile_vs_average(cust(spark, sf))


def _pva_sql() -> str:
    parts = []
    for f in ["tenure", "MonthlyCharges", "TotalCharges"]:
        x = f"CAST({f} AS DOUBLE)"
        lo, hi = f"(SELECT MIN({x}) FROM cust)", f"(SELECT MAX({x}) FROM cust)"
        ch = f"(SELECT AVG(CASE WHEN Churn = 1 THEN {x} END) FROM cust)"
        st = f"(SELECT AVG(CASE WHEN Churn = 0 THEN {x} END) FROM cust)"
        rng = f"(CASE WHEN {hi} - {lo} = 0 THEN 1.0e0 ELSE {hi} - {lo} END)"

        def norm(v):
            return f"ROUND(LEAST(1.0e0, GREATEST(0.0e0, ({v} - {lo}) / {rng})), 6)"
        parts.append(f"SELECT customerID, '{f}' AS feature, {norm(x)} AS customer_norm, {norm(ch)} AS churner_norm, "
                     f"{norm(st)} AS stayer_norm FROM cust")
    return with_ctes(" UNION ALL ".join(parts))


oracle("profile_vs_average", _pva_sql())

# ---------------------------------------------------------------------------
# evaluation on the fixed scorecard
# ---------------------------------------------------------------------------


@query("confusion_matrix")
def q_confusion_matrix(spark, sf):
    return EV.confusion_matrix(eval_table(spark, sf))


oracle("confusion_matrix", esql(
    "SELECT y, pred, COUNT(*) AS n, ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (PARTITION BY y), 4) AS row_pct "
    "FROM (SELECT y, CASE WHEN p >= 0.5e0 THEN 1 ELSE 0 END AS pred FROM ev) t GROUP BY y, pred"))

_COUNTS_SQL = ("cnt AS (SELECT COUNT(*) FILTER (WHERE p >= 0.5e0 AND y = 1) AS tp, "
               "COUNT(*) FILTER (WHERE p >= 0.5e0 AND y = 0) AS fp, COUNT(*) FILTER (WHERE p < 0.5e0 AND y = 1) AS fn, "
               "COUNT(*) FILTER (WHERE p < 0.5e0 AND y = 0) AS tn FROM ev)")


def _d0(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE 0.0e0 END)"


def _prf_sql(tp, fp, fn):
    return (_d0(tp, f"{tp} + {fp}"), _d0(tp, f"{tp} + {fn}"), _d0(f"2.0e0 * {tp}", f"2 * {tp} + {fp} + {fn}"))


@query("metrics_at_threshold")
def q_metrics_at_threshold(spark, sf):
    return EV.metrics_at_threshold(eval_table(spark, sf))


_P1, _R1, _F1 = _prf_sql("tp", "fp", "fn")
oracle("metrics_at_threshold", esql(
    f"SELECT 0.5e0 AS threshold, ROUND((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy, "
    f"ROUND({_P1}, 6) AS precision, ROUND({_R1}, 6) AS recall, ROUND({_F1}, 6) AS f1, "
    "ROUND((tp + fp) * 100.0 / CAST(tp + fp + fn + tn AS DOUBLE), 4) AS predicted_pct FROM cnt", _COUNTS_SQL))


@query("classification_report")
def q_classification_report(spark, sf):
    return EV.classification_report(eval_table(spark, sf))


_P0, _R0, _F0 = _prf_sql("tn", "fn", "fp")
oracle("classification_report", esql(
    f"SELECT '0' AS label, ROUND({_P0}, 6) AS precision, ROUND({_R0}, 6) AS recall, ROUND({_F0}, 6) AS f1, "
    f"tn + fp AS support FROM cnt UNION ALL SELECT '1', ROUND({_P1}, 6), ROUND({_R1}, 6), ROUND({_F1}, 6), tp + fn "
    f"FROM cnt UNION ALL SELECT 'macro avg', ROUND(({_P1} + {_P0}) / 2, 6), ROUND(({_R1} + {_R0}) / 2, 6), "
    f"ROUND(({_F1} + {_F0}) / 2, 6), tp + fp + fn + tn FROM cnt", _COUNTS_SQL))

_HIST_CTE = "hist AS (SELECT p, CAST(SUM(y) AS BIGINT) AS pos, CAST(SUM(1 - y) AS BIGINT) AS neg FROM ev GROUP BY p)"
_CUM_CTE = ("cum AS (SELECT p, pos, neg, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, "
            "(SELECT SUM(pos) FROM hist) AS tot_pos, (SELECT SUM(neg) FROM hist) AS tot_neg FROM hist "
            "WINDOW w AS (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))")


@query("threshold_curve")
def q_threshold_curve(spark, sf):
    return EV.threshold_curve(eval_table(spark, sf))


def _threshold_sql():
    grid = ", ".join(f"CAST({t!r} AS DOUBLE)" for t in EV.threshold_grid())
    tp = "SUM(CASE WHEN p >= t THEN pos ELSE 0 END)"
    fp = "SUM(CASE WHEN p >= t THEN neg ELSE 0 END)"
    fn = "SUM(CASE WHEN p >= t THEN 0 ELSE pos END)"
    pr, rc, f1 = _prf_sql("tp", "fp", "fn")
    return esql(f"SELECT ROUND(t, 6) AS threshold, ROUND({pr}, 6) AS precision, ROUND({rc}, 6) AS recall, "
                f"ROUND({f1}, 6) AS f1 FROM (SELECT t, {tp} AS tp, {fp} AS fp, {fn} AS fn FROM hist, "
                f"(SELECT UNNEST([{grid}]) AS t) g GROUP BY t) s", _HIST_CTE)


oracle("threshold_curve", _threshold_sql())


@query("roc_curve")
def q_roc_curve(spark, sf):
    return EV.roc_curve(eval_table(spark, sf))


oracle("roc_curve", esql(f"SELECT p AS threshold, ROUND({_d0('fp', 'tot_neg')}, 6) AS fpr, ROUND({_d0('tp', 'tot_pos')}, 6) AS tpr "
                         "FROM cum UNION ALL SELECT NULL, 0.0e0, 0.0e0", _HIST_CTE, _CUM_CTE))


@query("roc_auc")
def q_roc_auc(spark, sf):
    return EV.roc_auc(eval_table(spark, sf))


oracle("roc_auc", esql(
    "SELECT ROUND(SUM((fpr - fpr0) * (tpr + tpr0) / 2.0e0), 6) AS roc_auc FROM (SELECT fpr, tpr, "
    "COALESCE(LAG(fpr) OVER (ORDER BY p DESC), 0.0e0) AS fpr0, COALESCE(LAG(tpr) OVER (ORDER BY p DESC), 0.0e0) AS tpr0 "
    f"FROM (SELECT p, {_d0('fp', 'tot_neg')} AS fpr, {_d0('tp', 'tot_pos')} AS tpr FROM cum) a) b", _HIST_CTE, _CUM_CTE))


@query("pr_curve")
def q_pr_curve(spark, sf):
    return EV.pr_curve(eval_table(spark, sf))


oracle("pr_curve", esql(
    f"SELECT p AS threshold, ROUND(CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE), 6) AS precision, "
    f"ROUND({_d0('tp', 'tot_pos')}, 6) AS recall FROM cum UNION ALL SELECT NULL, 1.0e0, 0.0e0", _HIST_CTE, _CUM_CTE))


@query("average_precision")
def q_average_precision(spark, sf):
    return EV.average_precision(eval_table(spark, sf))


oracle("average_precision", esql(
    "SELECT ROUND(SUM((r - r0) * pr), 6) AS average_precision, ROUND(ANY_VALUE(tot_pos) / CAST(ANY_VALUE(tot_pos) + "
    "ANY_VALUE(tot_neg) AS DOUBLE), 6) AS base_rate FROM (SELECT r, pr, tot_pos, tot_neg, COALESCE(LAG(r) OVER (ORDER BY p DESC), 0.0e0) AS r0 FROM "
    f"(SELECT p, tot_pos, tot_neg, {_d0('tp', 'tot_pos')} AS r, CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) AS pr FROM cum) a) b",
    _HIST_CTE, _CUM_CTE))


@query("calibration")
def q_calibration(spark, sf):
    return EV.calibration(eval_table(spark, sf))


oracle("calibration", esql(
    "SELECT bin, ROUND(AVG(p), 6) AS mean_pred, ROUND(AVG(y), 6) AS observed, COUNT(*) AS n FROM (SELECT p, y, "
    + " + ".join(f"(CASE WHEN p > CAST({e!r} AS DOUBLE) THEN 1 ELSE 0 END)"
                 for e in EV.calibration_edges(CALIBRATION_BINS)[1:-1])
    + " AS bin FROM ev) t GROUP BY bin"))


@query("partial_dependence")
def q_partial_dependence(spark, sf):
    return EV.partial_dependence(cust(spark, sf), "tenure")


oracle("partial_dependence", with_ctes(
    "SELECT CAST(gi AS INTEGER) AS grid_index, ROUND(ANY_VALUE(g), 6) AS grid_value, "
    f"ROUND(AVG({prob_sql({'tenure': 'g'})}), 6) AS avg_p FROM (SELECT cust.*, gi, "
    "b.lo + gi * (b.hi - b.lo) / 49.0e0 AS g FROM cust, (SELECT UNNEST(RANGE(0, 50)) AS gi) r, "
    "(SELECT QUANTILE_CONT(CAST(tenure AS DOUBLE), 0.05) AS lo, QUANTILE_CONT(CAST(tenure AS DOUBLE), 0.95) AS hi "
    "FROM cust) b) t GROUP BY gi"))


@query("partial_dependence_few_values")
def q_partial_dependence_few_values(spark, sf):
    """Fewer distinct values than grid points: the values are the grid."""
    return EV.partial_dependence(cust(spark, sf), "SeniorCitizen")


oracle("partial_dependence_few_values", with_ctes(
    "SELECT CAST(gi AS INTEGER) AS grid_index, CAST(g AS DOUBLE) AS grid_value, "
    f"ROUND(AVG({prob_sql({'SeniorCitizen': 'g'})}), 6) AS avg_p FROM cust, (SELECT SeniorCitizen AS g, "
    "ROW_NUMBER() OVER (ORDER BY SeniorCitizen) - 1 AS gi FROM cust GROUP BY SeniorCitizen) v GROUP BY gi, g"))


@query("shap_linear")
def q_shap_linear(spark, sf):
    return EV.linear_contributions(cust(spark, sf))


def _shap_sql():
    from ..functions.scorecard import INTERCEPT, TERMS
    from .sqlbase import term_sql
    means = ", ".join(f"AVG({term_sql(t)}) AS m{i}" for i, (t, _) in enumerate(TERMS))
    base = f"CAST({INTERCEPT!r} AS DOUBLE)"
    for i, (_, w) in enumerate(TERMS):
        base = f"({base} + CAST({w!r} AS DOUBLE) * m{i})"
    rows = " UNION ALL ".join(
        f"SELECT customerID, ROUND({base}, 6) AS base_margin, '{t}' AS feature, "
        f"CAST({w!r} AS DOUBLE) * ({term_sql(t)} - m{i}) AS contribution FROM cust, mu"
        for i, (t, w) in enumerate(TERMS))
    return with_ctes(
        "SELECT customerID, base_margin, feature, ROUND(contribution, 6) AS contribution, CAST(ROW_NUMBER() OVER "
        "(PARTITION BY customerID ORDER BY ABS(contribution) DESC, feature) AS INTEGER) AS rank FROM (" + rows + ") t",
        f"mu AS (SELECT {means} FROM cust)")


oracle("shap_linear", _shap_sql())


@query("shap_top")
def q_shap_top(spark, sf):
    return EV.linear_contributions(cust(spark, sf), top=WATERFALL_TOP)


oracle("shap_top", "SELECT customerID, base_margin, CASE WHEN rank <= 8 THEN feature ELSE 'other' END AS feature, "
       "ROUND(SUM(raw), 6) AS contribution, CAST(LEAST(rank, 9) AS INTEGER) AS rank FROM ("
       + _shap_sql().replace("ROUND(contribution, 6) AS contribution", "contribution AS raw") + ") q "
       "GROUP BY ALL")


@query("shap_dependence")
def q_shap_dependence(spark, sf):
    return EV.shap_dependence(cust(spark, sf), "tenure")


def _shap_dep_sql():
    from ..functions.scorecard import TERMS
    from .sqlbase import term_sql
    w = dict(TERMS)["tenure"]
    contrib = f"(CAST({w!r} AS DOUBLE) * ({term_sql('tenure')} - (SELECT AVG({term_sql('tenure')}) FROM cust)))"
    rows = " UNION ALL ".join(f"SELECT '{t}' AS other_feature, CORR({contrib}, {term_sql(t)}) AS corr FROM cust"
                              for t, _ in TERMS if t != "tenure")
    return with_ctes(
        "SELECT 'tenure' AS feature, other_feature, ROUND(corr, 6) AS corr, CAST(ROW_NUMBER() OVER "
        "(ORDER BY ABS(corr) DESC, other_feature) AS INTEGER) AS rank FROM (" + rows + ") t "
        "WHERE corr IS NOT NULL AND NOT isnan(corr)")


oracle("shap_dependence", _shap_dep_sql())


@query("shap_dependence_points")
def q_shap_dependence_points(spark, sf):
    """Attribution against value, every scorecard term."""
    return EV.attribution_bins(EV.linear_points(cust(spark, sf)))


def _shap_points_sql():
    from ..functions.scorecard import TERMS
    from .sqlbase import term_sql
    rows = " UNION ALL ".join(
        f"SELECT '{t}' AS feature, CAST({term_sql(t)} AS DOUBLE) AS x, CAST({w!r} AS DOUBLE) * ({term_sql(t)} - "
        f"(SELECT AVG({term_sql(t)}) FROM cust)) AS contribution FROM cust" for t, w in TERMS)
    return with_ctes(
        "SELECT feature, bin, COUNT(*) AS n, ROUND(AVG(x), 6) AS value, ROUND(AVG(contribution), 6) AS contribution, "
        "ROUND(STDDEV_POP(contribution), 6) AS spread FROM (SELECT *, CAST(CASE WHEN hi > lo THEN "
        f"LEAST(FLOOR((x - lo) / (hi - lo) * {SHAP_BINS}.0e0), {SHAP_BINS - 1}) ELSE 0 END AS INTEGER) AS bin FROM "
        "(SELECT *, MIN(x) OVER (PARTITION BY feature) AS lo, MAX(x) OVER (PARTITION BY feature) AS hi FROM pt) r) b "
        "GROUP BY feature, bin", f"pt AS ({rows})")


oracle("shap_dependence_points", _shap_points_sql())

# keep margin_sql importable for users composing their own oracles
__all__ = ["margin_sql"]
