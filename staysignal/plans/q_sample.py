"""Plans for splits, folds, sampling, weights, statistical tests and the
per-cluster tables on a deterministic cluster key (SURVEY 2.5, 2.9, 2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import ID_COL
from ..operators import cluster as CL
from ..operators import resample as R
from ..operators import stats as ST
from .catalog import query
from .context import cust
from .oracle import oracle
from .sqlbase import with_ctes

_K = "customerID"
_H = f"CAST(CONCAT('0x', SUBSTRING(MD5(CONCAT({_K}, ':42')), 1, {R.HASH_HEX_DIGITS})) AS BIGINT)"


@query("split_stratified")
def q_split_stratified(spark, sf):
    return R.split(cust(spark, sf), ID_COL, 0.2, ["Churn"]).select(ID_COL, "Churn", "split")


def _rank_sql(partition: str, cols: str) -> str:
    part = f"PARTITION BY {partition} " if partition else ""
    return (f"SELECT {cols}, ROW_NUMBER() OVER ({part}ORDER BY {_H}, {_K}) - 1 AS rank, "
            f"COUNT(*) OVER ({part.strip()}) AS n FROM cust")


def split_sql(cols: str) -> str:
    out = "* EXCLUDE (rank, n)" if cols == "*" else cols
    return with_ctes(f"SELECT {out}, CASE WHEN rank < FLOOR(0.2e0 * n + 0.5e0) THEN 'test' ELSE 'train' END AS split "
                     f"FROM ({_rank_sql('Churn', cols)}) t")


oracle("split_stratified", split_sql("customerID, Churn"))


@query("split_random")
def q_split_random(spark, sf):
    return R.split(cust(spark, sf), ID_COL, 0.3).select(ID_COL, "split")


oracle("split_random", with_ctes(
    "SELECT customerID, CASE WHEN rank < FLOOR(0.3e0 * n + 0.5e0) THEN 'test' ELSE 'train' END AS split "
    f"FROM ({_rank_sql('', 'customerID')}) t"))


@query("kfold")
def q_kfold(spark, sf):
    return R.kfold(cust(spark, sf), ID_COL, 5, ["Churn"]).select(ID_COL, "Churn", "fold")


oracle("kfold", with_ctes(
    f"SELECT customerID, Churn, CAST(rank % 5 AS INTEGER) AS fold FROM ({_rank_sql('Churn', 'customerID, Churn')}) t"))


@query("sample_rows")
def q_sample_rows(spark, sf):
    return R.sample_rows(cust(spark, sf), ID_COL, 300).select(ID_COL, "tenure", "MonthlyCharges")


oracle("sample_rows", with_ctes(f"SELECT customerID, tenure, MonthlyCharges FROM cust ORDER BY {_H}, {_K} LIMIT 300"))


@query("class_weights")
def q_class_weights(spark, sf):
    return R.class_weights(cust(spark, sf))


oracle("class_weights", with_ctes(
    "SELECT Churn, COUNT(*) AS n_c, ROUND(SUM(COUNT(*)) OVER () / (COUNT(*) OVER () * COUNT(*)), 6) AS weight "
    "FROM cust GROUP BY Churn"))


@query("mask_labels")
def q_mask_labels(spark, sf):
    return R.mask_labels(cust(spark, sf), ID_COL).select(ID_COL, "masked_label")


oracle("mask_labels", with_ctes(
    f"SELECT customerID, CASE WHEN {_H} < {int(0.8 * R.HASH_MOD)} THEN -1 ELSE Churn END AS masked_label FROM cust"))

# --- statistical tests ---------------------------------------------------------


def _tail_sql(density: str, z: str) -> str:
    """Two-sided tail beyond ``z`` >= 0 of a symmetric density in ``u``, by
    Simpson's rule over 4,000 steps of [0, z] (independent of the operators)."""
    return (f"(SELECT 1.0e0 - 2.0e0 * SUM(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END "
            f"* {density}) * {z} / 12000.0e0 FROM (SELECT i, {z} * i / 4000.0e0 AS u FROM "
            "(SELECT UNNEST(RANGE(0, 4001)) AS i) a) b)")


_NORMAL = "EXP(-u * u / 2.0e0) / SQRT(2.0e0 * PI())"
_STUDENT = ("EXP(LGAMMA((dof + 1) / 2.0e0) - LGAMMA(dof / 2.0e0)) / SQRT(dof * PI()) "
            "* POWER(1.0e0 + u * u / dof, -(dof + 1) / 2.0e0)")


@query("chi_square")
def q_chi_square(spark, sf):
    return ST.chi_square(cust(spark, sf), "gender", "Churn", correction=True)


oracle("chi_square", with_ctes(
    f"SELECT ROUND(stat, 6) AS statistic, CAST(1 AS BIGINT) AS dof, ROUND({_tail_sql(_NORMAL, 'SQRT(stat)')}, 6) "
    "AS p_value FROM (SELECT SUM(POWER(ABS(o - e) - LEAST(0.5e0, ABS(o - e)), 2) / e) AS stat FROM "
    "(SELECT o, ra * cb / CAST(n AS DOUBLE) AS e FROM (SELECT gender, Churn, COUNT(*) AS o FROM cust GROUP BY ALL) c "
    "JOIN (SELECT gender, COUNT(*) AS ra FROM cust GROUP BY gender) USING (gender) "
    "JOIN (SELECT Churn, COUNT(*) AS cb FROM cust GROUP BY Churn) USING (Churn), "
    "(SELECT COUNT(*) AS n FROM cust) t) x) y"))


def _moments_sql(value: str, cond1: str, cond2: str) -> str:
    x = f"CAST({value} AS DOUBLE)"
    return (f"SELECT COUNT(*) FILTER (WHERE {cond1}) AS n1, AVG(CASE WHEN {cond1} THEN {x} END) AS m1, "
            f"VAR_SAMP(CASE WHEN {cond1} THEN {x} END) AS v1, COUNT(*) FILTER (WHERE {cond2}) AS n2, "
            f"AVG(CASE WHEN {cond2} THEN {x} END) AS m2, VAR_SAMP(CASE WHEN {cond2} THEN {x} END) AS v2 FROM cust")


@query("t_test_pooled")
def q_t_test_pooled(spark, sf):
    return ST.t_test_pooled(cust(spark, sf), "MonthlyCharges", F.col("Contract"), "Month-to-month", "One year")


_POOLED_SQL = (
    "SELECT ROUND((m1 - m2) / SQRT(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0e0 / n1 + 1.0e0 / n2)), 6) "
    "AS t_stat, CAST(n1 + n2 - 2 AS DOUBLE) AS dof, n1, n2, ROUND(m1, 6) AS mean1, ROUND(m2, 6) AS mean2 FROM ("
    + _moments_sql("MonthlyCharges", "Contract = 'Month-to-month'", "Contract = 'One year'") + ") m")
oracle("t_test_pooled", with_ctes(_POOLED_SQL))


@query("t_test_welch")
def q_t_test_welch(spark, sf):
    """Welch's test with its decision at the 5 % level (the p-value of the one-row result)."""
    out = ST.t_test_welch(cust(spark, sf), "tenure", F.col("Churn"), 1, 0)
    return out.withColumn("decision", F.lit(ST.decision(out.first())))


_WELCH_SQL = (
    "SELECT ROUND((m1 - m2) / SQRT(v1 / n1 + v2 / n2), 6) AS t_stat, ROUND((v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) "
    "/ ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1)), 6) AS dof, n1, n2, "
    "ROUND(m1, 6) AS mean1, ROUND(m2, 6) AS mean2 FROM (" + _moments_sql("tenure", "Churn = 1", "Churn = 0") + ") m")
oracle("t_test_welch", with_ctes(
    f"SELECT w.*, CASE WHEN {_tail_sql(_STUDENT, 'ABS(t_stat)')} < 0.05e0 THEN 'reject' ELSE 'fail to reject' END AS decision "
    f"FROM ({_WELCH_SQL}) w"))


@query("t_test_pvalues")
def q_t_test_pvalues(spark, sf):
    """Exact two-sided p-values of both t tests: the statistics are one row
    each; the incomplete beta runs on the driver over those two numbers."""
    c = cust(spark, sf)
    rows = []
    for name, res in [("pooled", ST.t_test_pooled(c, "MonthlyCharges", F.col("Contract"), "Month-to-month",
                                                  "One year")),
                      ("welch", ST.t_test_welch(c, "tenure", F.col("Churn"), 1, 0))]:
        r = res.first()
        rows.append((name, r["t_stat"], r["dof"], round(ST.t_pvalue(r["t_stat"], r["dof"]), 6)))
    return spark.createDataFrame(rows, "test string, t_stat double, dof double, p_value double")


oracle("t_test_pvalues", with_ctes(
    f"SELECT test, t_stat, dof, ROUND({_tail_sql(_STUDENT, 'ABS(t_stat)')}, 6) AS p_value FROM ("
    f"SELECT 'pooled' AS test, t_stat, dof FROM ({_POOLED_SQL}) a UNION ALL "
    f"SELECT 'welch', t_stat, dof FROM ({_WELCH_SQL}) b) t"))


# --- per-cluster tables on a deterministic key (Cluster = contract) ------------


def clustered(spark, sf):
    return cust(spark, sf).withColumn("Cluster", F.col("Contract"))


@query("cluster_profile")
def q_cluster_profile(spark, sf):
    return CL.cluster_profile(clustered(spark, sf))


oracle("cluster_profile", with_ctes(
    "SELECT Cluster, feature, ROUND((mean - MIN(mean) OVER w) / (MAX(mean) OVER w - MIN(mean) OVER w + 1e-9), 3) "
    "AS norm_value FROM (" + " UNION ALL ".join(
        f"SELECT Contract AS Cluster, '{f}' AS feature, AVG(CAST({f} AS DOUBLE)) AS mean FROM cust GROUP BY Contract"
        for f in CL.PROFILE_FEATURES) + ") t WINDOW w AS (PARTITION BY feature)"))


@query("cluster_churn")
def q_cluster_churn(spark, sf):
    return CL.cluster_churn(clustered(spark, sf))


oracle("cluster_churn", with_ctes(
    "SELECT Contract AS Cluster, COUNT(*) AS n, ROUND(AVG(Churn), 6) AS churn_rate, ROUND(AVG(Churn) * 100.0, 4) "
    "AS churn_pct, ROUND(AVG(MonthlyCharges), 4) AS avg_monthly FROM cust GROUP BY Contract"))


def _mode_sql(col: str) -> str:
    return (f"(SELECT {col} FROM cust c2 WHERE c2.Contract = g.Cluster GROUP BY {col} "
            f"ORDER BY COUNT(*) DESC, {col} LIMIT 1)")


@query("cluster_summary")
def q_cluster_summary(spark, sf):
    return CL.cluster_summary(clustered(spark, sf))


oracle("cluster_summary", with_ctes(
    f"SELECT g.*, {_mode_sql('Contract')} AS dominant_contract, {_mode_sql('InternetService')} AS dominant_internet "
    "FROM (SELECT Contract AS Cluster, COUNT(*) AS customers, ROUND(AVG(Churn), 6) AS churn_rate, "
    "ROUND(AVG(tenure), 4) AS avg_tenure, ROUND(AVG(MonthlyCharges), 4) AS avg_monthly, "
    "ROUND(AVG(TotalCharges), 4) AS avg_total FROM cust GROUP BY Contract) g"))


@query("cluster_map_accuracy")
def q_cluster_map_accuracy(spark, sf):
    return CL.cluster_map_accuracy(clustered(spark, sf))


oracle("cluster_map_accuracy", with_ctes(
    "SELECT ROUND(AVG(CASE WHEN c.Churn = m.majority THEN 1.0 ELSE 0.0 END), 6) AS accuracy, COUNT(*) AS n FROM cust c "
    "JOIN (SELECT Contract, Churn AS majority FROM (SELECT Contract, Churn, ROW_NUMBER() OVER (PARTITION BY Contract "
    "ORDER BY COUNT(*) DESC, Churn) AS r FROM cust GROUP BY Contract, Churn) t WHERE r = 1) m USING (Contract)"))
