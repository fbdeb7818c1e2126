"""Retention-action eligibility predicates and attribute overrides.

Each action is (id, eligibility Column, {feature: override Column}).  The
catalog is tiny and fixed, so applying it is a per-row ``explode`` of an
array of structs: no join, no shuffle, eligibility filtered before scoring.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (LOYALTY_CHARGE_MIN, LOYALTY_DISCOUNT_FACTOR,
                         LOYALTY_DISCOUNT_FLOOR)


def _has_internet() -> Column:
    return F.col("InternetService") != "No"


def eligibility() -> dict[str, Column]:
    return {
        "upgrade_2yr": F.col("Contract") == "Month-to-month",
        "upgrade_1yr": F.col("Contract") == "Month-to-month",
        "add_tech_support": (F.col("TechSupport") == "No") & _has_internet(),
        "add_online_security": (F.col("OnlineSecurity") == "No") & _has_internet(),
        "add_online_backup": (F.col("OnlineBackup") == "No") & _has_internet(),
        "device_protection": (F.col("DeviceProtection") == "No") & _has_internet(),
        "switch_auto_payment": F.col("PaymentMethod") == "Electronic check",
        "loyalty_discount": F.coalesce(F.col("MonthlyCharges"), F.lit(0.0)) > LOYALTY_CHARGE_MIN,
    }


def overrides() -> dict[str, dict[str, Column]]:
    return {
        "upgrade_2yr": {"Contract": F.lit("Two year")},
        "upgrade_1yr": {"Contract": F.lit("One year")},
        "add_tech_support": {"TechSupport": F.lit("Yes")},
        "add_online_security": {"OnlineSecurity": F.lit("Yes")},
        "add_online_backup": {"OnlineBackup": F.lit("Yes")},
        "device_protection": {"DeviceProtection": F.lit("Yes")},
        "switch_auto_payment": {"PaymentMethod": F.lit("Bank transfer (automatic)")},
        "loyalty_discount": {"MonthlyCharges": F.greatest(
            F.coalesce(F.col("MonthlyCharges"), F.lit(65.0)) * F.lit(LOYALTY_DISCOUNT_FACTOR),
            F.lit(LOYALTY_DISCOUNT_FLOOR))},
    }
