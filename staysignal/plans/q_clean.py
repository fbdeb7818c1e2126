"""Plans for sources, cleaning, encodings and scalar expressions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..constants import (CLUSTER_CAT_MAP, INTERNET_SERVICE_COLS, NUMERIC_FEATURES, RAW_COLUMNS)
from ..functions import cleaning as C
from ..functions.bands import cohort_tenure_band, eda_tenure_band, notebook_tenure_band, risk_level
from ..functions.numeric import round_half_up, round_half_up_sql
from ..functions.scorecard import score
from ..operators import clean as K
from ..operators.segments import non_numeric_audit
from .catalog import query
from .context import cust, raw
from .oracle import oracle
from .sqlbase import flag_sql, label_sql, with_ctes, prob_sql

_NOT_NULL_RAW = " AND ".join(f"{c} IS NOT NULL" for c in RAW_COLUMNS)
_SERVICES_FILL = ", ".join(f"COALESCE({c}, 'No internet service') AS {c}" for c in INTERNET_SERVICE_COLS)


def _key():
    return F.substring(F.col("customerID"), 2, 20).cast("bigint")


# --- sources ---------------------------------------------------------------

@query("scan_parquet")
def q_scan_parquet(spark, sf):
    return raw(spark, sf)


oracle("scan_parquet", with_ctes("SELECT * FROM raw"))


# --- cleaning steps ---------------------------------------------------------

@query("drop_columns")
def q_drop_columns(spark, sf):
    return K.drop_columns(raw(spark, sf))


oracle("drop_columns", with_ctes("SELECT * EXCLUDE (customerID) FROM raw"))


@query("clean_yes_no")
def q_clean_yes_no(spark, sf):
    return K.clean_yes_no(raw(spark, sf))


oracle("clean_yes_no", with_ctes(
    "SELECT * REPLACE (" + ", ".join(f"{flag_sql(c)} AS {c}" for c in
                                    ["Partner", "Dependents", "PhoneService", "PaperlessBilling"]) + ") FROM raw"))


@query("clean_label")
def q_clean_label(spark, sf):
    return K.clean_label(raw(spark, sf))


oracle("clean_label", with_ctes(
    f"SELECT * FROM (SELECT * REPLACE ({label_sql('Churn')} AS Churn) FROM raw) t WHERE Churn IS NOT NULL"))


@query("clean_label_text")
def q_clean_label_text(spark, sf):
    return K.clean_label_text(raw(spark, sf)).select("customerID", "Churn")


oracle("clean_label_text", with_ctes(
    "SELECT customerID, CASE WHEN TRIM(Churn) IN ('Yes','True') THEN 'Yes' "
    "WHEN TRIM(Churn) IN ('No','False') THEN 'No' END AS Churn FROM raw"))


@query("clean_senior")
def q_clean_senior(spark, sf):
    return K.clean_senior(raw(spark, sf)).select("customerID", "SeniorCitizen")


oracle("clean_senior", with_ctes(
    "SELECT customerID, CAST(TRUNC(COALESCE(TRY_CAST(TRIM(CAST(SeniorCitizen AS VARCHAR)) AS DOUBLE), 0)) AS INTEGER) "
    "AS SeniorCitizen FROM raw"))


@query("fill_services")
def q_fill_services(spark, sf):
    return K.fill_services(raw(spark, sf))


oracle("fill_services", with_ctes(
    f"SELECT * REPLACE ({_SERVICES_FILL}, COALESCE(MultipleLines, 'No') AS MultipleLines) FROM raw"))


@query("collapse_services")
def q_collapse_services(spark, sf):
    return K.collapse_services(K.fill_services(raw(spark, sf))).select("customerID", *INTERNET_SERVICE_COLS)


oracle("collapse_services", with_ctes(
    "SELECT customerID, " + ", ".join(
        f"CASE WHEN COALESCE({c}, 'No internet service') = 'No internet service' THEN 'No' ELSE {c} END AS {c}"
        for c in INTERNET_SERVICE_COLS) + " FROM raw"))


@query("clean_total_charges")
def q_clean_total_charges(spark, sf):
    return K.clean_total_charges(raw(spark, sf)).select("customerID", "TotalCharges")


oracle("clean_total_charges", with_ctes(
    "SELECT customerID, COALESCE(TRY_CAST(TRIM(TotalCharges) AS DOUBLE), MonthlyCharges * tenure) AS TotalCharges FROM raw"))


@query("blank_to_null")
def q_blank_to_null(spark, sf):
    return K.blank_to_null(raw(spark, sf)).select("customerID", "TotalCharges")


oracle("blank_to_null", with_ctes(
    "SELECT customerID, TRY_CAST(NULLIF(TRIM(TotalCharges), '') AS DOUBLE) AS TotalCharges FROM raw"))


@query("drop_nulls_all")
def q_drop_nulls_all(spark, sf):
    return K.drop_nulls(raw(spark, sf))


oracle("drop_nulls_all", with_ctes(f"SELECT * FROM raw WHERE {_NOT_NULL_RAW}"))


@query("drop_nulls_subset")
def q_drop_nulls_subset(spark, sf):
    return K.drop_nulls(raw(spark, sf), ["MultipleLines", "Dependents"])


oracle("drop_nulls_subset", with_ctes(
    "SELECT * FROM raw WHERE MultipleLines IS NOT NULL AND Dependents IS NOT NULL"))


@query("dedup")
def q_dedup(spark, sf):
    return K.dedup(cust(spark, sf).drop("customerID"))


oracle("dedup", with_ctes("SELECT DISTINCT * EXCLUDE (customerID) FROM cust"))


@query("ffill")
def q_ffill(spark, sf):
    src = raw(spark, sf).select("customerID", _key().alias("cust_key"), "OnlineSecurity", "Dependents")
    return K.ffill(src, ["OnlineSecurity", "Dependents"], "cust_key")


oracle("ffill", with_ctes(
    "SELECT customerID, CAST(SUBSTRING(customerID, 2, 20) AS BIGINT) AS cust_key, "
    "LAST_VALUE(OnlineSecurity IGNORE NULLS) OVER w AS OnlineSecurity, "
    "LAST_VALUE(Dependents IGNORE NULLS) OVER w AS Dependents FROM raw "
    "WINDOW w AS (ORDER BY CAST(SUBSTRING(customerID, 2, 20) AS BIGINT) "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))


@query("clean_pipeline")
def q_clean_pipeline(spark, sf):
    return K.clean(raw(spark, sf))


oracle("clean_pipeline", with_ctes("SELECT * EXCLUDE (customerID) FROM cust"))


def _score_input(spark, sf):
    """Scoring path: the label is dropped before cleaning, so no row is lost."""
    return K.preprocess_score_input(raw(spark, sf).drop("Churn"))


@query("preprocess_score_input")
def q_preprocess_score_input(spark, sf):
    return _score_input(spark, sf)


_SCORE_INPUT_SELECT = f"""SELECT customerID, gender,
 CAST(TRUNC(COALESCE(TRY_CAST(TRIM(CAST(SeniorCitizen AS VARCHAR)) AS DOUBLE), 0)) AS INTEGER) AS SeniorCitizen,
 {flag_sql('Partner')} AS Partner, {flag_sql('Dependents')} AS Dependents, tenure,
 {flag_sql('PhoneService')} AS PhoneService, COALESCE(MultipleLines, 'No') AS MultipleLines, InternetService,
 {_SERVICES_FILL}, Contract, {flag_sql('PaperlessBilling')} AS PaperlessBilling, PaymentMethod, MonthlyCharges,
 TRY_CAST(TRIM(TotalCharges) AS DOUBLE) AS TotalCharges FROM raw"""
SCORE_INPUT_CTE = f"si AS ({_SCORE_INPUT_SELECT})"

oracle("preprocess_score_input", with_ctes("SELECT * FROM si", SCORE_INPUT_CTE))


# --- imputation -------------------------------------------------------------

@query("impute_mean")
def q_impute_mean(spark, sf):
    si = _score_input(spark, sf)
    return K.impute(si, si, ["TotalCharges"], "mean").select(
        "customerID", F.round("TotalCharges", 6).alias("TotalCharges"))


oracle("impute_mean", with_ctes(
    "SELECT customerID, ROUND(COALESCE(TotalCharges, (SELECT AVG(TotalCharges) FROM si)), 6) AS TotalCharges FROM si",
    SCORE_INPUT_CTE))


@query("impute_median")
def q_impute_median(spark, sf):
    si = _score_input(spark, sf)
    return K.impute(si, si, ["TotalCharges"], "median").select(
        "customerID", F.round("TotalCharges", 6).alias("TotalCharges"))


oracle("impute_median", with_ctes(
    "SELECT customerID, ROUND(COALESCE(TotalCharges, (SELECT QUANTILE_CONT(TotalCharges, 0.5) FROM si)), 6) "
    "AS TotalCharges FROM si", SCORE_INPUT_CTE))


@query("impute_mode")
def q_impute_mode(spark, sf):
    r = raw(spark, sf)
    return K.impute(r, r, ["OnlineSecurity", "Dependents"], "mode").select(
        "customerID", "OnlineSecurity", "Dependents")


def _mode_sql(col: str) -> str:
    return (f"(SELECT {col} FROM (SELECT {col}, COUNT(*) AS n FROM raw WHERE {col} IS NOT NULL GROUP BY {col}) "
            f"ORDER BY n DESC, {col} LIMIT 1)")


oracle("impute_mode", with_ctes(
    f"SELECT customerID, COALESCE(OnlineSecurity, {_mode_sql('OnlineSecurity')}) AS OnlineSecurity, "
    f"COALESCE(Dependents, {_mode_sql('Dependents')}) AS Dependents FROM raw"))


@query("impute_zero")
def q_impute_zero(spark, sf):
    si = _score_input(spark, sf)
    return K.impute(si, si, ["TotalCharges"], "zero").select("customerID", "TotalCharges")


oracle("impute_zero", with_ctes(
    "SELECT customerID, COALESCE(TotalCharges, 0.0) AS TotalCharges FROM si", SCORE_INPUT_CTE))


# --- derived columns and encodings --------------------------------------------

def _band_case(edges, labels, include_lowest):
    parts = []
    for i, lab in enumerate(labels):
        lo_op = ">=" if include_lowest and i == 0 else ">"
        parts.append(f"WHEN tenure {lo_op} {edges[i]} AND tenure <= {edges[i + 1]} THEN '{lab}'")
    return "CASE " + " ".join(parts) + " END"


@query("tenure_band")
def q_tenure_band(spark, sf):
    return cust(spark, sf).select("customerID", "tenure", eda_tenure_band().alias("eda_band"),
                                  cohort_tenure_band().alias("cohort_band"),
                                  notebook_tenure_band().alias("notebook_band"))


def _bands_sql():
    from ..constants import (COHORT_BAND_EDGES, COHORT_BAND_LABELS, EDA_BAND_EDGES, EDA_BAND_LABELS,
                             NOTEBOOK_BAND_EDGES, NOTEBOOK_BAND_LABELS)
    return (f"{_band_case(EDA_BAND_EDGES, EDA_BAND_LABELS, False)} AS eda_band, "
            f"{_band_case(COHORT_BAND_EDGES, COHORT_BAND_LABELS, True)} AS cohort_band, "
            f"{_band_case(NOTEBOOK_BAND_EDGES, NOTEBOOK_BAND_LABELS, False)} AS notebook_band")


oracle("tenure_band", with_ctes(f"SELECT customerID, tenure, {_bands_sql()} FROM cust"))


@query("charges_per_tenure")
def q_charges_per_tenure(spark, sf):
    return cust(spark, sf).select("customerID", F.round(F.col("TotalCharges") / (F.col("tenure") + 1), 6)
                                  .alias("charges_per_tenure"))


oracle("charges_per_tenure", with_ctes(
    "SELECT customerID, ROUND(TotalCharges / (tenure + 1), 6) AS charges_per_tenure FROM cust"))


@query("label_encode")
def q_label_encode(spark, sf):
    c = cust(spark, sf)
    out = K.label_encode(c, c.select("customerID", "Contract", "PaymentMethod"), "Contract")
    return K.label_encode(c, out, "PaymentMethod")


oracle("label_encode", with_ctes(
    "SELECT customerID, Contract, PaymentMethod, "
    "CAST((SELECT COUNT(DISTINCT c2.Contract) FROM cust c2 WHERE c2.Contract < cust.Contract) AS INTEGER) AS Contract_code, "
    "CAST((SELECT COUNT(DISTINCT c3.PaymentMethod) FROM cust c3 WHERE c3.PaymentMethod < cust.PaymentMethod) AS INTEGER) "
    "AS PaymentMethod_code FROM cust"))


@query("ordinal_encode")
def q_ordinal_encode(spark, sf):
    return K.ordinal_encode(cust(spark, sf), CLUSTER_CAT_MAP).select(
        "customerID", *[c + "_enc" for c in CLUSTER_CAT_MAP])


oracle("ordinal_encode", with_ctes(
    "SELECT customerID, " + ", ".join(
        f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.items()) + f" ELSE 0 END AS {c}_enc"
        for c, m in CLUSTER_CAT_MAP.items()) + " FROM cust"))


def _safe(name: str) -> str:
    return re.sub(r"[^0-9A-Za-z]+", "_", name).strip("_")


# FIXED VALUES — category domains used to name indicator columns in the oracle
_ONE_HOT_DOMAINS = {
    "Contract": ["Month-to-month", "One year", "Two year"],
    "InternetService": ["DSL", "Fiber optic", "No"],
    "PaymentMethod": ["Bank transfer (automatic)", "Credit card (automatic)", "Electronic check", "Mailed check"],
}


@query("one_hot")
def q_one_hot(spark, sf):
    c = cust(spark, sf)
    levels = K.category_levels(c, list(_ONE_HOT_DOMAINS))
    enc = K.one_hot(c, levels)
    cols = [f"{k}_{lv}" for k, lvs in levels.items() for lv in sorted(lvs)[1:]]
    return enc.select("customerID", *[F.col(f"`{x}`").alias(_safe(x)) for x in cols])


oracle("one_hot", with_ctes(
    "SELECT customerID, " + ", ".join(
        f"CASE WHEN {k} = '{lv}' THEN 1 ELSE 0 END AS {_safe(k + '_' + lv)}"
        for k, lvs in _ONE_HOT_DOMAINS.items() for lv in sorted(lvs)[1:]) + " FROM cust"))


@query("align_columns")
def q_align_columns(spark, sf):
    c = cust(spark, sf)
    test = K.one_hot(c.filter(F.col("Contract") != "Two year"), {"Contract": ["Month-to-month", "One year"]})
    train_cols = ["customerID", "Contract_One year", "Contract_Two year"]
    out = K.align_columns(test, train_cols)
    return out.select(*[F.col(f"`{x}`").alias(_safe(x)) for x in train_cols])


oracle("align_columns", with_ctes(
    "SELECT customerID, CASE WHEN Contract = 'One year' THEN 1 ELSE 0 END AS Contract_One_year, "
    "0 AS Contract_Two_year FROM cust WHERE Contract <> 'Two year'"))


@query("standardize")
def q_standardize(spark, sf):
    c = cust(spark, sf)
    z = K.standardize(c, c, NUMERIC_FEATURES)
    return z.select("customerID", *[F.round(f"{x}_z", 6).alias(f"{x}_z") for x in NUMERIC_FEATURES])


oracle("standardize", with_ctes(
    "SELECT customerID, " + ", ".join(
        f"ROUND(({x} - (SELECT AVG({x}) FROM cust)) / (SELECT CASE WHEN STDDEV_POP({x}) > 0 THEN STDDEV_POP({x}) "
        f"ELSE 1.0 END FROM cust), 6) AS {x}_z" for x in NUMERIC_FEATURES) + " FROM cust"))


_MM = ["tenure", "MonthlyCharges", "TotalCharges"]


@query("minmax_profile")
def q_minmax_profile(spark, sf):
    c = cust(spark, sf)
    return K.minmax_scale(c, _MM).select("customerID", *[F.round(f"{x}_mm", 6).alias(f"{x}_mm") for x in _MM])


oracle("minmax_profile", with_ctes(
    "SELECT customerID, " + ", ".join(
        f"ROUND(LEAST(1.0, GREATEST(0.0, ({x} - (SELECT MIN({x}) FROM cust)) / "
        f"(SELECT CASE WHEN MAX({x}) - MIN({x}) = 0 THEN 1.0 ELSE MAX({x}) - MIN({x}) END FROM cust))), 6) AS {x}_mm"
        for x in _MM) + " FROM cust"))


@query("risk_level")
def q_risk_level(spark, sf):
    s = score(cust(spark, sf))
    return s.select("customerID", "p", risk_level("p").alias("risk_level"))


oracle("risk_level", with_ctes(
    "SELECT customerID, p, CASE WHEN p >= 0 AND p <= 0.3 THEN 'Low' WHEN p > 0.3 AND p <= 0.6 THEN 'Medium' "
    "WHEN p > 0.6 AND p <= 1.0 THEN 'High' END AS risk_level FROM scored", scored=True))


@query("format_labels")
def q_format_labels(spark, sf):
    s = score(cust(spark, sf))
    return s.select("customerID",
                    F.concat(round_half_up(F.col("p") * 100, 1).cast("string"), F.lit("%")).alias("prob_label"),
                    F.concat(F.lit("Cluster "), (F.pmod(_key(), F.lit(4)) + 1).cast("string")).alias("cluster_label"),
                    F.trim(F.regexp_replace(F.col("PaymentMethod"), r"\s*\(automatic\)", "")).alias("payment_label"))


oracle("format_labels", with_ctes(
    f"SELECT customerID, CONCAT(CAST({round_half_up_sql('p * 100', 1)} AS VARCHAR), '%') AS prob_label, "
    "CONCAT('Cluster ', CAST(CAST(SUBSTRING(customerID, 2, 20) AS BIGINT) % 4 + 1 AS VARCHAR)) AS cluster_label, "
    "TRIM(REGEXP_REPLACE(PaymentMethod, '\\s*\\(automatic\\)', '', 'g')) AS payment_label FROM scored", scored=True))


# --- filters / predicates -----------------------------------------------------

@query("non_numeric_audit")
def q_non_numeric_audit(spark, sf):
    return non_numeric_audit(raw(spark, sf), "TotalCharges").select("customerID", "TotalCharges")


oracle("non_numeric_audit", with_ctes(
    "SELECT customerID, TotalCharges FROM raw WHERE TotalCharges IS NOT NULL "
    "AND TRY_CAST(TRIM(TotalCharges) AS DOUBLE) IS NULL"))
