"""Common-table expressions shared by the oracle SQL strings (DuckDB dialect).

``raw``   the dirty customer view (same rows as sources.customer_view)
``cust``  the cleaned view, id kept
``scored`` cleaned view + fixed-scorecard probability ``p``
"""

from __future__ import annotations

from ..functions.scorecard import INTERCEPT, TERMS

RAW_CTES = """
s AS (SELECT MAX(o_orderdate) AS ref_d FROM orders),
o AS (SELECT o_custkey AS ck, COUNT(*) AS n_ord, MAX(o_orderdate) AS last_o FROM orders GROUP BY o_custkey),
b AS (SELECT c_custkey AS k, COALESCE(n_ord, 0) AS n, c_mktsegment AS seg, c_nationkey AS nk,
        CASE WHEN last_o IS NULL THEN 9999 ELSE DATE_DIFF('day', CAST(last_o AS DATE), CAST(ref_d AS DATE)) END AS rec
      FROM customer LEFT JOIN o ON c_custkey = ck CROSS JOIN s),
v AS (SELECT k, n, nk, rec, (k * 7 + n * 13) % 73 AS tenure, (1825 + (k * 7919 + n * 104729) % 10050) / 100.0 AS m,
        CASE seg WHEN 'BUILDING' THEN 'Two year' WHEN 'FURNITURE' THEN 'One year' ELSE 'Month-to-month' END AS ctr FROM b),
raw AS (SELECT CONCAT('C', CAST(k AS VARCHAR(20))) AS customerID,
 CASE WHEN k % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
 CASE WHEN CAST(FLOOR(k / 3.0) AS BIGINT) % 6 = 0 THEN 1 ELSE 0 END AS SeniorCitizen,
 CASE WHEN k % 4 < 2 THEN ' Yes' ELSE 'No' END AS Partner,
 CASE k % 5 WHEN 0 THEN 'True' WHEN 1 THEN 'Yes' WHEN 2 THEN 'False' WHEN 3 THEN 'No' ELSE NULL END AS Dependents,
 CAST(tenure AS BIGINT) AS tenure,
 CASE WHEN k % 10 = 9 THEN 'No' ELSE 'Yes' END AS PhoneService,
 CASE WHEN k % 10 = 9 THEN 'No phone service' WHEN k % 10 = 8 THEN NULL WHEN k % 10 < 4 THEN 'Yes' ELSE 'No' END AS MultipleLines,
 CASE nk % 3 WHEN 0 THEN 'DSL' WHEN 1 THEN 'Fiber optic' ELSE 'No' END AS InternetService,
 CASE WHEN nk % 3 = 2 THEN CASE WHEN k % 10 < 5 THEN NULL ELSE 'No internet service' END WHEN CAST(FLOOR(k / 3.0) AS BIGINT) % 2 = 0 THEN 'Yes' ELSE 'No' END AS OnlineSecurity,
 CASE WHEN nk % 3 = 2 THEN CASE WHEN k % 10 < 5 THEN NULL ELSE 'No internet service' END WHEN CAST(FLOOR(k / 5.0) AS BIGINT) % 2 = 0 THEN 'Yes' ELSE 'No' END AS OnlineBackup,
 CASE WHEN nk % 3 = 2 THEN CASE WHEN k % 10 < 5 THEN NULL ELSE 'No internet service' END WHEN CAST(FLOOR(k / 7.0) AS BIGINT) % 2 = 0 THEN 'Yes' ELSE 'No' END AS DeviceProtection,
 CASE WHEN nk % 3 = 2 THEN CASE WHEN k % 10 < 5 THEN NULL ELSE 'No internet service' END WHEN CAST(FLOOR(k / 11.0) AS BIGINT) % 2 = 0 THEN 'Yes' ELSE 'No' END AS TechSupport,
 CASE WHEN nk % 3 = 2 THEN CASE WHEN k % 10 < 5 THEN NULL ELSE 'No internet service' END WHEN CAST(FLOOR(k / 13.0) AS BIGINT) % 2 = 0 THEN 'Yes' ELSE 'No' END AS StreamingTV,
 CASE WHEN nk % 3 = 2 THEN CASE WHEN k % 10 < 5 THEN NULL ELSE 'No internet service' END WHEN CAST(FLOOR(k / 17.0) AS BIGINT) % 2 = 0 THEN 'Yes' ELSE 'No' END AS StreamingMovies,
 ctr AS Contract,
 CASE WHEN k % 5 < 3 THEN 'Yes' ELSE 'No' END AS PaperlessBilling,
 CASE CAST(FLOOR(k / 2.0) AS BIGINT) % 4 WHEN 0 THEN 'Electronic check' WHEN 1 THEN 'Mailed check' WHEN 2 THEN 'Bank transfer (automatic)' ELSE 'Credit card (automatic)' END AS PaymentMethod,
 CAST(m AS DOUBLE) AS MonthlyCharges,
 CASE WHEN tenure = 0 THEN ' ' ELSE CAST(CAST(ROUND(m * tenure, 2) AS DECIMAL(12,2)) AS VARCHAR(20)) END AS TotalCharges,
 CASE WHEN k % 97 = 96 THEN 'Unknown'
      WHEN rec > CASE ctr WHEN 'Month-to-month' THEN 200 WHEN 'One year' THEN 450 ELSE 900 END THEN CASE WHEN k % 2 = 0 THEN 'Yes' ELSE 'True' END
      ELSE CASE WHEN k % 2 = 0 THEN 'No' ELSE 'False' END END AS Churn
FROM v)"""


def flag_sql(col: str) -> str:
    return (f"CASE WHEN TRIM(CAST({col} AS VARCHAR)) IN ('Yes','True') THEN 1 ELSE 0 END")


def label_sql(col: str) -> str:
    return (f"CASE WHEN TRIM(CAST({col} AS VARCHAR)) IN ('Yes','True') THEN 1 "
            f"WHEN TRIM(CAST({col} AS VARCHAR)) IN ('No','False') THEN 0 END")


CLEAN_SELECT = f"""SELECT customerID, gender,
 CAST(TRUNC(COALESCE(TRY_CAST(TRIM(CAST(SeniorCitizen AS VARCHAR)) AS DOUBLE), 0)) AS INTEGER) AS SeniorCitizen,
 {flag_sql('Partner')} AS Partner, {flag_sql('Dependents')} AS Dependents, tenure,
 {flag_sql('PhoneService')} AS PhoneService, COALESCE(MultipleLines, 'No') AS MultipleLines, InternetService,
 COALESCE(OnlineSecurity, 'No internet service') AS OnlineSecurity,
 COALESCE(OnlineBackup, 'No internet service') AS OnlineBackup,
 COALESCE(DeviceProtection, 'No internet service') AS DeviceProtection,
 COALESCE(TechSupport, 'No internet service') AS TechSupport,
 COALESCE(StreamingTV, 'No internet service') AS StreamingTV,
 COALESCE(StreamingMovies, 'No internet service') AS StreamingMovies,
 Contract, {flag_sql('PaperlessBilling')} AS PaperlessBilling, PaymentMethod, MonthlyCharges,
 COALESCE(TRY_CAST(TRIM(TotalCharges) AS DOUBLE), MonthlyCharges * tenure) AS TotalCharges,
 {label_sql('Churn')} AS Churn
FROM raw"""

CLEAN_COLS = ["customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure", "PhoneService",
              "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
              "TechSupport", "StreamingTV", "StreamingMovies", "Contract", "PaperlessBilling",
              "PaymentMethod", "MonthlyCharges", "TotalCharges", "Churn"]

CUST_CTE = ("cust AS (SELECT * FROM (" + CLEAN_SELECT + ") t WHERE "
            + " AND ".join(f"{c} IS NOT NULL" for c in CLEAN_COLS) + ")")


def term_sql(term: str, cols: dict | None = None) -> str:
    cols = cols or {}
    if "=" in term:
        name, level = term.split("=", 1)
        src = cols.get(name, name)
        return f"(CASE WHEN {src} = '{level}' THEN 1.0e0 ELSE 0.0e0 END)"
    return f"CAST({cols.get(term, term)} AS DOUBLE)"


def _num(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def margin_sql(cols: dict | None = None) -> str:
    z = _num(INTERCEPT)
    for term, w in TERMS:
        z = f"({z} + {_num(w)} * {term_sql(term, cols)})"
    return z


def prob_sql(cols: dict | None = None) -> str:
    return f"ROUND(1.0e0 / (1.0e0 + EXP(-{margin_sql(cols)})), 4)"


SCORED_CTE = f"scored AS (SELECT *, {prob_sql()} AS p FROM cust)"


def with_ctes(body: str, *extra: str, scored: bool = False) -> str:
    ctes = [RAW_CTES.strip(), CUST_CTE]
    if scored:
        ctes.append(SCORED_CTE)
    ctes += list(extra)
    return "WITH " + ",\n".join(ctes) + "\n" + body
