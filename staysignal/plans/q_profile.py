"""Plans for aggregations, segments and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import (CATEGORICAL_FEATURES, COHORT_BAND_EDGES, COHORT_BAND_LABELS, EDA_BAND_EDGES,
                         EDA_BAND_LABELS, NUMERIC_FEATURES, RAW_COLUMNS, SERVICE_COLS)
from ..operators import clean as K
from ..operators import profile as P
from .catalog import query
from .context import cust, raw
from .oracle import oracle
from .q_clean import _band_case
from .sqlbase import with_ctes

RATE = "ROUND(AVG(Churn) * 100.0, 4)"


@query("churn_overview")
def q_churn_overview(spark, sf):
    return P.churn_overview(cust(spark, sf))


oracle("churn_overview", with_ctes(
    "SELECT Churn, COUNT(*) AS n, ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 4) AS share_pct, "
    "ROUND(COALESCE(SUM(COUNT(*) FILTER (WHERE Churn = 0)) OVER (), 0) / CAST(GREATEST(COALESCE(SUM(COUNT(*) FILTER "
    "(WHERE Churn = 1)) OVER (), 0), 1) AS DOUBLE), 4) AS imbalance_ratio "
    "FROM cust GROUP BY Churn"))


@query("kpi_summary")
def q_kpi_summary(spark, sf):
    return P.kpi_summary(cust(spark, sf))


oracle("kpi_summary", with_ctes(
    f"SELECT COUNT(*) AS customers, CAST(SUM(Churn) AS BIGINT) AS churners, {RATE} AS churn_rate_pct, "
    "ROUND(AVG(MonthlyCharges), 4) AS avg_monthly, ROUND(AVG(tenure), 4) AS avg_tenure, "
    "ROUND(SUM(CASE WHEN Churn = 1 THEN MonthlyCharges END), 2) AS revenue_at_risk, "
    "ROUND(SUM(MonthlyCharges), 2) AS total_revenue FROM cust"))

_DIMS = {"contract": "Contract", "payment": "PaymentMethod", "internet": "InternetService",
         "senior": "SeniorCitizen", "gender": "gender"}


@query("churn_by_dim")
def q_churn_by_dim(spark, sf):
    return P.churn_by_dim(cust(spark, sf), "Contract")


oracle("churn_by_dim", with_ctes(
    f"SELECT Contract, {RATE} AS churn_rate_pct, COUNT(*) AS n FROM cust GROUP BY Contract"))


def _dim_query(dim):
    return lambda spark, sf: P.churn_by_dim(cust(spark, sf), dim)


for _name, _dim in _DIMS.items():
    if _name == "contract":
        continue
    query(f"churn_by_{_name}")(_dim_query(_dim))
    oracle(f"churn_by_{_name}", with_ctes(
        f"SELECT {_dim}, {RATE} AS churn_rate_pct, COUNT(*) AS n FROM cust GROUP BY {_dim}"))


@query("churn_by_tenure_band")
def q_churn_by_tenure_band(spark, sf):
    return P.churn_by_tenure_band(cust(spark, sf))


oracle("churn_by_tenure_band", with_ctes(
    f"SELECT tenure_group, {RATE} AS churn_rate_pct, COUNT(*) AS n FROM "
    f"(SELECT *, {_band_case(EDA_BAND_EDGES, EDA_BAND_LABELS, False)} AS tenure_group FROM cust) t "
    "WHERE tenure_group IS NOT NULL GROUP BY tenure_group"))


@query("cohort_table")
def q_cohort_table(spark, sf):
    return P.cohort_table(cust(spark, sf))


oracle("cohort_table", with_ctes(
    f"SELECT tenure_band, COUNT(*) AS n, {RATE} AS churn_rate_pct, ROUND(AVG(MonthlyCharges), 4) AS avg_monthly "
    f"FROM (SELECT *, {_band_case(COHORT_BAND_EDGES, COHORT_BAND_LABELS, True)} AS tenure_band FROM cust) t "
    "WHERE tenure_band IS NOT NULL GROUP BY tenure_band"))

# Segment used by the segment plans: month-to-month or one-year contracts on
# fiber or DSL, seniors and non-seniors, any gender (empty list = no filter).
_SEGMENT = dict(Contract=["Month-to-month", "One year"], InternetService=["Fiber optic", "DSL"],
                SeniorCitizen=[0, 1], gender=[])
_SEGMENT_SQL = ("Contract IN ('Month-to-month', 'One year') AND InternetService IN ('Fiber optic', 'DSL') "
                "AND SeniorCitizen IN (0, 1)")


@query("segment_filter")
def q_segment_filter(spark, sf):
    return K.segment_filter(cust(spark, sf), **_SEGMENT)


oracle("segment_filter", with_ctes(f"SELECT * FROM cust WHERE {_SEGMENT_SQL}"))


@query("segment_share")
def q_segment_share(spark, sf):
    pred = (F.col("Contract").isin(_SEGMENT["Contract"]) & F.col("InternetService").isin(_SEGMENT["InternetService"])
            & F.col("SeniorCitizen").isin(_SEGMENT["SeniorCitizen"]))
    return P.segment_share(cust(spark, sf), pred)


oracle("segment_share", with_ctes(
    f"SELECT CAST(SUM(CASE WHEN {_SEGMENT_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS segment_n, COUNT(*) AS total_n, "
    f"ROUND(CAST(SUM(CASE WHEN {_SEGMENT_SQL} THEN 1 ELSE 0 END) AS BIGINT) * 100.0 / COUNT(*), 4) AS share_pct FROM cust"))


@query("segment_kpis")
def q_segment_kpis(spark, sf):
    return P.segment_kpis(K.segment_filter(cust(spark, sf), **_SEGMENT))


oracle("segment_kpis", with_ctes(
    f"SELECT COUNT(*) AS n, {RATE} AS churn_rate_pct, ROUND(AVG(MonthlyCharges), 4) AS avg_monthly, "
    f"ROUND(AVG(tenure), 4) AS avg_tenure FROM cust WHERE {_SEGMENT_SQL}"))


@query("bool_split")
def q_bool_split(spark, sf):
    return P.bool_split(cust(spark, sf))


oracle("bool_split", with_ctes(
    "SELECT Churn, COUNT(*) AS n, ROUND(SUM(MonthlyCharges), 2) AS sum_MonthlyCharges, "
    "ROUND(AVG(MonthlyCharges), 4) AS avg_MonthlyCharges FROM cust GROUP BY Churn"))


@query("services_matrix")
def q_services_matrix(spark, sf):
    return P.services_matrix(cust(spark, sf))


oracle("services_matrix", with_ctes(
    "SELECT Service, ROUND(AVG(CASE WHEN Status = 'No' THEN Churn END) * 100.0, 4) AS \"No\", "
    "ROUND(AVG(CASE WHEN Status = 'Yes' THEN Churn END) * 100.0, 4) AS \"Yes\" FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS Service, {c} AS Status, Churn FROM cust" for c in SERVICE_COLS)
    + ") t WHERE LOWER(Status) NOT IN ('no internet service', 'no phone service') GROUP BY Service"))


@query("revenue_at_risk")
def q_revenue_at_risk(spark, sf):
    return P.revenue_at_risk(cust(spark, sf))


oracle("revenue_at_risk", with_ctes(
    "SELECT ROUND(SUM(CASE WHEN Churn = 1 THEN MonthlyCharges END), 2) AS at_risk_revenue, "
    "ROUND(SUM(CASE WHEN Churn = 0 THEN MonthlyCharges END), 2) AS retained_revenue, "
    "ROUND(SUM(CASE WHEN Churn = 1 THEN MonthlyCharges END) * 100.0 / (SUM(CASE WHEN Churn = 1 THEN MonthlyCharges END) "
    "+ SUM(CASE WHEN Churn = 0 THEN MonthlyCharges END)), 4) AS at_risk_pct FROM cust"))


@query("churn_hierarchy")
def q_churn_hierarchy(spark, sf):
    return P.churn_hierarchy(cust(spark, sf))


oracle("churn_hierarchy", with_ctes(
    "SELECT Contract, InternetService, Churn_Label, COUNT(*) AS n, "
    "CAST(GROUPING(Contract, InternetService, Churn_Label) AS BIGINT) AS level FROM "
    "(SELECT Contract, InternetService, CASE WHEN Churn = 1 THEN 'Churn' ELSE 'No Churn' END AS Churn_Label FROM cust) t "
    "GROUP BY ROLLUP (Contract, InternetService, Churn_Label)"))


@query("correlation_matrix")
def q_correlation_matrix(spark, sf):
    return P.correlation_matrix(cust(spark, sf))


oracle("correlation_matrix", with_ctes(" UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, ROUND(CORR(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr FROM cust"
    for i, a in enumerate(NUMERIC_FEATURES) for b in NUMERIC_FEATURES[i + 1:])))


@query("null_report")
def q_null_report(spark, sf):
    return P.null_report(raw(spark, sf))


oracle("null_report", with_ctes(
    "SELECT column_name, nulls, ROUND(nulls * 100.0 / total, 4) AS null_pct FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS nulls, COUNT(*) AS total FROM raw"
        for c in RAW_COLUMNS) + ") t WHERE nulls > 0"))


@query("clean_delta")
def q_clean_delta(spark, sf):
    r = raw(spark, sf)
    return P.clean_delta(r, K.clean(r))


oracle("clean_delta", with_ctes(
    "SELECT 'before' AS stage, COUNT(*) AS rows, CAST(21 AS BIGINT) AS cols, CAST(COALESCE(SUM("
    + " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in RAW_COLUMNS) + "), 0) AS BIGINT) AS nulls FROM raw "
    "UNION ALL SELECT 'after', COUNT(*), CAST(20 AS BIGINT), CAST(0 AS BIGINT) FROM cust"))


_RAW_TYPES = {"customerID": "string", "gender": "string", "SeniorCitizen": "int", "Partner": "string",
              "Dependents": "string", "tenure": "bigint", "PhoneService": "string", "MultipleLines": "string",
              "InternetService": "string", "OnlineSecurity": "string", "OnlineBackup": "string",
              "DeviceProtection": "string", "TechSupport": "string", "StreamingTV": "string",
              "StreamingMovies": "string", "Contract": "string", "PaperlessBilling": "string",
              "PaymentMethod": "string", "MonthlyCharges": "double", "TotalCharges": "string", "Churn": "string"}


@query("column_profile")
def q_column_profile(spark, sf):
    return P.column_profile(raw(spark, sf))


oracle("column_profile", with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, COUNT(DISTINCT {c}) AS n_distinct, "
    f"CAST(MIN({c}) AS VARCHAR) AS sample_value FROM raw" for c, t in _RAW_TYPES.items())))


@query("categorical_profile")
def q_categorical_profile(spark, sf):
    return P.categorical_profile(cust(spark, sf))


oracle("categorical_profile", with_ctes(
    "SELECT column_name, n_distinct, value AS top_value, cnt AS top_count FROM ("
    "SELECT column_name, value, cnt, ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rk, "
    "COUNT(*) OVER (PARTITION BY column_name) AS n_distinct FROM ("
    "SELECT column_name, value, COUNT(*) AS cnt FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value FROM cust" for c in CATEGORICAL_FEATURES)
    + ") u GROUP BY column_name, value) g) r WHERE rk = 1"))


@query("numeric_profile")
def q_numeric_profile(spark, sf):
    return P.numeric_profile(cust(spark, sf))


oracle("numeric_profile", with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, ROUND(AVG(CAST({c} AS DOUBLE)), 2) AS mean, "
    f"ROUND(STDDEV_SAMP(CAST({c} AS DOUBLE)), 2) AS std, ROUND(MIN(CAST({c} AS DOUBLE)), 2) AS min, "
    f"ROUND(MAX(CAST({c} AS DOUBLE)), 2) AS max FROM cust" for c in NUMERIC_FEATURES)))


@query("describe")
def q_describe(spark, sf):
    return P.describe(cust(spark, sf))


oracle("describe", with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT({c}) AS count, ROUND(AVG(CAST({c} AS DOUBLE)), 6) AS mean, "
    f"ROUND(STDDEV_SAMP(CAST({c} AS DOUBLE)), 6) AS std, MIN(CAST({c} AS DOUBLE)) AS min, "
    f"ROUND(QUANTILE_CONT(CAST({c} AS DOUBLE), 0.25), 6) AS q25, ROUND(QUANTILE_CONT(CAST({c} AS DOUBLE), 0.5), 6) AS q50, "
    f"ROUND(QUANTILE_CONT(CAST({c} AS DOUBLE), 0.75), 6) AS q75, MAX(CAST({c} AS DOUBLE)) AS max FROM cust"
    for c in NUMERIC_FEATURES)))


@query("crosstab")
def q_crosstab(spark, sf):
    return P.crosstab(cust(spark, sf), "gender", "Churn", [0, 1])


oracle("crosstab", with_ctes(
    "SELECT gender, CAST(SUM(CASE WHEN Churn = 0 THEN 1 ELSE 0 END) AS BIGINT) AS Churn_0, "
    "CAST(SUM(CASE WHEN Churn = 1 THEN 1 ELSE 0 END) AS BIGINT) AS Churn_1 FROM cust GROUP BY gender"))


@query("box_stats")
def q_box_stats(spark, sf):
    return P.box_stats(cust(spark, sf), "MonthlyCharges")


oracle("box_stats", with_ctes(
    "SELECT s.Churn, ROUND(mn, 6) AS min, ROUND(q1, 6) AS q1, ROUND(med, 6) AS median, ROUND(q3, 6) AS q3, "
    "ROUND(mx, 6) AS max, ROUND(lw, 6) AS lower_whisker, ROUND(uw, 6) AS upper_whisker, n_outliers FROM "
    "(SELECT Churn, MIN(MonthlyCharges) AS mn, QUANTILE_CONT(MonthlyCharges, 0.25) AS q1, "
    "QUANTILE_CONT(MonthlyCharges, 0.5) AS med, QUANTILE_CONT(MonthlyCharges, 0.75) AS q3, MAX(MonthlyCharges) AS mx "
    "FROM cust GROUP BY Churn) s JOIN (SELECT c.Churn, "
    "MIN(CASE WHEN MonthlyCharges >= lo AND MonthlyCharges <= hi THEN MonthlyCharges END) AS lw, "
    "MAX(CASE WHEN MonthlyCharges >= lo AND MonthlyCharges <= hi THEN MonthlyCharges END) AS uw, "
    "CAST(SUM(CASE WHEN MonthlyCharges >= lo AND MonthlyCharges <= hi THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers "
    "FROM cust c JOIN (SELECT Churn, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM "
    "(SELECT Churn, QUANTILE_CONT(MonthlyCharges, 0.25) AS q1, QUANTILE_CONT(MonthlyCharges, 0.75) AS q3 FROM cust "
    "GROUP BY Churn) f0) f ON c.Churn = f.Churn GROUP BY c.Churn) w ON s.Churn = w.Churn"))


def _hist_sql(col: str, bins: int, src: str = "cust", by: str = "Churn") -> str:
    lo = f"(SELECT MIN(CAST({col} AS DOUBLE)) FROM {src})"
    hi = f"(SELECT MAX(CAST({col} AS DOUBLE)) FROM {src})"
    b = (f"CAST(CASE WHEN {hi} - {lo} > 0 THEN LEAST(FLOOR((CAST({col} AS DOUBLE) - {lo}) / ({hi} - {lo}) * "
         f"CAST({bins} AS DOUBLE)), {bins - 1}) ELSE 0 END AS INTEGER)")
    return (f"SELECT {by}, bin, ROUND({lo} + bin * ({hi} - {lo}) / CAST({bins} AS DOUBLE), 6) AS bin_lo, "
            f"ROUND({lo} + (bin + 1) * ({hi} - {lo}) / CAST({bins} AS DOUBLE), 6) AS bin_hi, n FROM "
            f"(SELECT {by}, {b} AS bin, COUNT(*) AS n FROM {src} GROUP BY ALL) h")


@query("histogram")
def q_histogram(spark, sf):
    return P.histogram(cust(spark, sf), "tenure", 30)


oracle("histogram", with_ctes(_hist_sql("tenure", 30)))


@query("feature_distributions")
def q_feature_distributions(spark, sf):
    return P.feature_distributions(cust(spark, sf))


def _feature_dist_sql() -> str:
    # numeric columns with more than two distinct values: tenure, MonthlyCharges, TotalCharges
    parts = []
    for c in ["tenure", "MonthlyCharges", "TotalCharges"]:
        parts.append(f"SELECT '{c}' AS feature, * FROM ({_hist_sql(c, 30)}) x{len(parts)}")
    return " UNION ALL ".join(parts)


oracle("feature_distributions", with_ctes(_feature_dist_sql()))


@query("scatter_sample")
def q_scatter_sample(spark, sf):
    return P.scatter_bins(cust(spark, sf))


def _bin_sql(col: str, bins: int) -> str:
    lo = f"(SELECT MIN(CAST({col} AS DOUBLE)) FROM cust)"
    hi = f"(SELECT MAX(CAST({col} AS DOUBLE)) FROM cust)"
    return (f"CAST(CASE WHEN {hi} - {lo} > 0 THEN LEAST(FLOOR((CAST({col} AS DOUBLE) - {lo}) / ({hi} - {lo}) * "
            f"CAST({bins} AS DOUBLE)), {bins - 1}) ELSE 0 END AS INTEGER)")


oracle("scatter_sample", with_ctes(
    f"SELECT Churn, {_bin_sql('tenure', 20)} AS x_bin, {_bin_sql('MonthlyCharges', 20)} AS y_bin, COUNT(*) AS n "
    "FROM cust GROUP BY ALL"))


# --- the same tables from mergeable sketches (stated error, one scan); tests compare them with the exact ones ---------

@query("describe_sketched")
def q_describe_sketched(spark, sf):
    return P.describe(cust(spark, sf), exact=False)


@query("box_stats_sketched")
def q_box_stats_sketched(spark, sf):
    return P.box_stats(cust(spark, sf), "MonthlyCharges", exact=False)


@query("column_profile_sketched")
def q_column_profile_sketched(spark, sf):
    return P.column_profile_sketched(raw(spark, sf))
