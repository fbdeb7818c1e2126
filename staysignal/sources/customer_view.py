"""The raw (deliberately dirty) 21-column customer table derived from the
given ``customer`` and ``orders`` tables.

Scale notes: ``orders`` is reduced to one row per customer with a partial
(map-side) aggregate before the shuffle, so a customer owning a third of all
orders costs one row per map task, not a hot partition.  The 1:1 join to
``customer`` is then skew-free.  The reference date is a scalar subquery
(one global max, computed once), not a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

_INTERNET_SERVICE_DIVISORS = {
    "OnlineSecurity": 3, "OnlineBackup": 5, "DeviceProtection": 7,
    "TechSupport": 11, "StreamingTV": 13, "StreamingMovies": 17,
}


def _internet_addon(k: Column, nk: Column, divisor: int) -> Column:
    no_internet = (nk % 3) == 2
    return (F.when(no_internet, F.when((k % 10) < 5, F.lit(None).cast("string"))
                   .otherwise(F.lit("No internet service")))
             .when(F.floor(k / divisor) % 2 == 0, F.lit("Yes"))
             .otherwise(F.lit("No")))


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderdate"])
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])

    ref_d = orders.agg(F.max("o_orderdate")).scalar()
    per_cust = orders.groupBy(F.col("o_custkey").alias("ck")).agg(
        F.count(F.lit(1)).alias("n_ord"), F.max("o_orderdate").alias("last_o"))

    b = (customer.join(per_cust, customer.c_custkey == per_cust.ck, "left")
         .select(F.col("c_custkey").alias("k"),
                 F.coalesce(F.col("n_ord"), F.lit(0)).alias("n"),
                 F.col("c_mktsegment").alias("seg"),
                 F.col("c_nationkey").alias("nk"),
                 F.when(F.col("last_o").isNull(), F.lit(9999))
                  .otherwise(F.datediff(ref_d.cast("date"), F.col("last_o").cast("date")))
                  .alias("rec")))

    k, n, nk = F.col("k"), F.col("n"), F.col("nk")
    v = b.select(
        "k", "n", "nk", "rec",
        ((k * 7 + n * 13) % 73).alias("tenure"),
        ((F.lit(1825) + (k * 7919 + n * 104729) % 10050) / F.lit(100.0)).cast("double").alias("m"),
        F.when(F.col("seg") == "BUILDING", "Two year")
         .when(F.col("seg") == "FURNITURE", "One year")
         .otherwise("Month-to-month").alias("ctr"))

    tenure, m, ctr = F.col("tenure"), F.col("m"), F.col("ctr")
    churn_after = (F.when(ctr == "Month-to-month", 200).when(ctr == "One year", 450).otherwise(900))
    yes_word = F.when(k % 2 == 0, "Yes").otherwise("True")
    no_word = F.when(k % 2 == 0, "No").otherwise("False")

    cols = [
        F.concat(F.lit("C"), k.cast("string")).alias("customerID"),
        F.when(k % 2 == 0, "Male").otherwise("Female").alias("gender"),
        F.when(F.floor(k / 3) % 6 == 0, 1).otherwise(0).alias("SeniorCitizen"),
        F.when(k % 4 < 2, " Yes").otherwise("No").alias("Partner"),
        (F.when(k % 5 == 0, "True").when(k % 5 == 1, "Yes").when(k % 5 == 2, "False")
          .when(k % 5 == 3, "No").otherwise(F.lit(None).cast("string"))).alias("Dependents"),
        tenure.cast("bigint").alias("tenure"),
        F.when(k % 10 == 9, "No").otherwise("Yes").alias("PhoneService"),
        (F.when(k % 10 == 9, "No phone service").when(k % 10 == 8, F.lit(None).cast("string"))
          .when(k % 10 < 4, "Yes").otherwise("No")).alias("MultipleLines"),
        F.when(nk % 3 == 0, "DSL").when(nk % 3 == 1, "Fiber optic").otherwise("No").alias("InternetService"),
    ]
    cols += [_internet_addon(k, nk, d).alias(c) for c, d in _INTERNET_SERVICE_DIVISORS.items()]
    cols += [
        ctr.alias("Contract"),
        F.when(k % 5 < 3, "Yes").otherwise("No").alias("PaperlessBilling"),
        (F.when(F.floor(k / 2) % 4 == 0, "Electronic check")
          .when(F.floor(k / 2) % 4 == 1, "Mailed check")
          .when(F.floor(k / 2) % 4 == 2, "Bank transfer (automatic)")
          .otherwise("Credit card (automatic)")).alias("PaymentMethod"),
        m.alias("MonthlyCharges"),
        F.when(tenure == 0, " ")
         .otherwise(F.round(m * tenure, 2).cast("decimal(12,2)").cast("string")).alias("TotalCharges"),
        (F.when(k % 97 == 96, "Unknown")
          .when(F.col("rec") > churn_after, yes_word)
          .otherwise(no_word)).alias("Churn"),
    ]
    return v.select(*cols)
