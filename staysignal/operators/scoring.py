"""Batch scoring, lifetime value, ROI, retention actions and what-if
scenarios (SURVEY 2.4, 2.8, 2.11).

The per-customer loops of the original (one model call per action, per
scenario) become columns (scorecard: one probability per action or scenario,
ranked inside the row) or, for any other scorer, one ``explode`` of candidate
rows and a single scoring pass.  The fan-out per customer is fixed by the
catalog (8 actions, 8 scenarios), so the work stays linear in customers;
only ranking a fitted model's actions shuffles, by customer id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (ACTION_COST_OTHER, ACTION_COST_PRICING, ACTIONS, BREAKEVEN_MAX_MONTHS,
                         DECISION_THRESHOLD, DEFAULT_MONTHLY_CHARGE, DEFAULT_PROBABILITY_PCT,
                         DEFAULT_TENURE, ID_COL, TOP_ACTIONS, WHAT_IF_DEAD_BAND, WHAT_IF_SCENARIO)
from ..functions import actions as A
from ..functions import scorecard
from ..functions.bands import risk_level
from ..functions.numeric import round_half_up
from ..functions.value import remaining_months
from .common import scalar_stats

Scorer = Callable[[DataFrame], DataFrame]


def score_batch(df: DataFrame, scorer: Scorer = scorecard.score) -> DataFrame:
    """Adds p, Churn_Probability (0-100, 1 decimal), Prediction, Risk_Level."""
    s = scorer(df)
    return s.withColumns({
        "Churn_Probability": round_half_up(F.col("p") * 100.0, 1),
        "Prediction": F.when(F.col("p") >= DECISION_THRESHOLD, "Churn").when(F.col("p").isNotNull(), "Stay"),
        "Risk_Level": risk_level("p"),
    })


def add_clv(df: DataFrame) -> DataFrame:
    """CLV and revenue at risk from the batch columns, with the documented
    defaults for missing inputs (65.0 / 12 / Month-to-month / 50 %)."""
    m = F.coalesce(F.col("MonthlyCharges").cast("double"), F.lit(DEFAULT_MONTHLY_CHARGE)) \
        if "MonthlyCharges" in df.columns else F.lit(DEFAULT_MONTHLY_CHARGE)
    t = F.coalesce(F.col("tenure").cast("double"), F.lit(DEFAULT_TENURE)) \
        if "tenure" in df.columns else F.lit(DEFAULT_TENURE)
    ctr = F.col("Contract") if "Contract" in df.columns else F.lit("Month-to-month")
    p = F.coalesce(F.col("Churn_Probability").cast("double"), F.lit(DEFAULT_PROBABILITY_PCT)) / 100.0
    rem = remaining_months(ctr, t)
    return df.withColumns({
        "remaining_months": rem,
        "CLV_Estimate": round_half_up(m * rem * (F.lit(1.0) - p), 2),
        "Revenue_at_Risk": round_half_up(m * p * rem, 2),
    })


def clv_simple(df: DataFrame) -> DataFrame:
    return df.withColumn("CLV", round_half_up(F.col("MonthlyCharges") * F.col("tenure"), 2))


def roi_columns(baseline: Column, new: Column, monthly: Column, tenure: Column, contract: Column,
                cost: Column) -> dict[str, Column]:
    rem = remaining_months(contract, tenure)
    reduction = F.greatest(F.lit(0.0), baseline - new)
    saved = monthly * reduction * rem
    net = saved - cost
    pct = F.when(cost > 0, net / cost * F.lit(100.0)).otherwise(F.lit(0.0))
    be = F.when((reduction > 0) & (monthly > 0), cost / (monthly * reduction))
    return {
        "prob_reduction": round_half_up(reduction, 4),
        "revenue_saved": round_half_up(saved, 2),
        "cost": round_half_up(cost, 2),
        "net_roi": round_half_up(net, 2),
        "roi_pct": round_half_up(pct, 1),
        "break_even_months": round_half_up(be, 1),
        "monthly_rar": round_half_up(monthly * baseline, 2),
    }


# --- actions --------------------------------------------------------------

def action_flags(df: DataFrame) -> DataFrame:
    """One 0/1 column per action: is it applicable to this customer?"""
    elig = A.eligibility()
    return df.withColumns({f"elig_{a}": F.coalesce(c, F.lit(False)).cast("int") for a, c in elig.items()})


_CHANGED = ["Contract", "TechSupport", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
            "PaymentMethod", "MonthlyCharges"]


def explode_actions(df: DataFrame) -> DataFrame:
    """customer x applicable action: each customer row is repeated once per
    eligible action with that action's overrides applied (``new_*``)."""
    elig, over = A.eligibility(), A.overrides()
    meta = {a[0]: a for a in ACTIONS}
    structs = []
    for aid, cond in elig.items():
        fields = [F.lit(aid).alias("action_id"), F.lit(meta[aid][1]).alias("title"),
                  F.lit(meta[aid][3]).alias("category")]
        for c in _CHANGED:
            fields.append(over[aid].get(c, F.col(c)).alias(c))
        structs.append(F.when(F.coalesce(cond, F.lit(False)), F.struct(*fields)))
    arr = F.filter(F.array(*structs), lambda x: x.isNotNull())
    out = df.withColumn("__act", F.explode(arr))
    return out.withColumns({"action_id": F.col("__act.action_id"), "title": F.col("__act.title"),
                            "category": F.col("__act.category"),
                            **{f"new_{c}": F.col(f"__act.{c}") for c in _CHANGED}}).drop("__act")


def _with(df: DataFrame, scorer: Scorer, out: str) -> DataFrame:
    """``df`` plus the scorer's ``p`` as ``out``; its other columns go."""
    return scorer(df).select(*df.columns, F.col("p").alias(out))


def _action_scores(df: DataFrame) -> tuple[DataFrame, list[str], str]:
    """The scorecard's probabilities, one column for the customer as is
    (``__p``) and one per action (``__p_<id>``), with the reduction
    ``__d_<id>`` (NULL where the action does not apply): each probability is
    computed once, everything after reads the columns."""
    elig, over = A.eligibility(), A.overrides()
    ids = list(elig)
    out = df.withColumns({"__p": scorecard.probability(),
                          **{f"__p_{a}": scorecard.probability(over[a]) for a in ids},
                          **{f"__e_{a}": F.coalesce(elig[a], F.lit(False)) for a in ids}})
    out = out.withColumns({f"__d_{a}": F.when(F.col(f"__e_{a}"), round_half_up(F.col("__p") - F.col(f"__p_{a}"), 4))
                           for a in ids})
    return out, ids, "__p"


def _action_rank(aid: str, ids: list[str]) -> Column:
    """1 + how many applicable actions come first (delta desc, action id)."""
    d = F.col(f"__d_{aid}")
    ahead = [F.when(F.col(f"__d_{o}") >= d if o < aid else F.col(f"__d_{o}") > d, 1).otherwise(0)
             for o in ids if o != aid]
    return sum(ahead, F.lit(1))


def recommend(df: DataFrame, k: int | None = None, scorer: Scorer | None = None) -> DataFrame:
    """Baseline vs post-action probability per (customer, action), ranked by
    the reduction (ties -> action id).

    Without a ``scorer`` the fixed scorecard is used: scored, ranked and
    sorted inside the row, no shuffle.  With one (a fitted model), every
    (customer, applicable action) row is scored in one pass and ranked by
    customer id, the only shuffle (at most one row per action and customer).
    """
    if scorer is not None:
        return _recommend_scored(df, scorer, k)
    meta = {a[0]: a for a in ACTIONS}
    sc, ids, base = _action_scores(df)
    structs = []
    for aid in ids:
        d = F.col(f"__d_{aid}")
        structs.append(F.when(d.isNotNull(), F.struct(
            (-d).alias("neg_delta"), F.lit(aid).alias("action_id"), F.lit(meta[aid][1]).alias("title"),
            F.lit(meta[aid][3]).alias("category"), F.col(base).alias("baseline_prob"),
            F.col(f"__p_{aid}").alias("new_prob"), d.alias("delta"))))
    # sort_array puts the NULLs of ineligible actions first; skip them
    n_ok = sum((F.col(f"__d_{a}").isNotNull().cast("int") for a in ids), F.lit(0))
    arr = F.slice(F.sort_array(F.array(*structs)), F.lit(len(structs)) - n_ok + 1, n_ok)
    if k:
        arr = F.slice(arr, 1, k)
    ex = sc.select(*df.columns, F.posexplode(arr).alias("__pos", "__a"))
    return (ex.withColumns({
        "action_id": F.col("__a.action_id"), "title": F.col("__a.title"), "category": F.col("__a.category"),
        "baseline_prob": F.col("__a.baseline_prob"), "new_prob": F.col("__a.new_prob"),
        "delta": F.col("__a.delta"), "delta_pct": round_half_up(F.col("__a.delta") * 100.0, 2),
        "rank": (F.col("__pos") + 1).cast("int")}).drop("__pos", "__a"))


def _recommend_scored(df: DataFrame, scorer: Scorer, k: int | None) -> DataFrame:
    cand = explode_actions(_with(df, scorer, "baseline_prob"))
    own = {c: f"__own_{c}" for c in _CHANGED}
    cand = cand.withColumnsRenamed(own).withColumnsRenamed({f"new_{c}": c for c in _CHANGED})
    cand = _with(cand, scorer, "new_prob").drop(*_CHANGED).withColumnsRenamed({v: c for c, v in own.items()})
    delta = round_half_up(F.col("baseline_prob") - F.col("new_prob"), 4)
    w = Window.partitionBy(ID_COL).orderBy(F.desc_nulls_last("delta"), "action_id")
    out = cand.withColumn("delta", delta).withColumns({"delta_pct": round_half_up(F.col("delta") * 100.0, 2),
                                                       "rank": F.row_number().over(w).cast("int")})
    out = out.select(*df.columns, "action_id", "title", "category", "baseline_prob", "new_prob", "delta", "delta_pct",
                     "rank")
    return out.filter(F.col("rank") <= k) if k else out


def action_cost(category: Column) -> Column:
    return F.when(category == "Pricing", F.lit(ACTION_COST_PRICING)).otherwise(F.lit(ACTION_COST_OTHER))


def _action_roi() -> dict[str, Column]:
    return roi_columns(F.col("baseline_prob"), F.col("new_prob"), F.col("MonthlyCharges"),
                       F.col("tenure"), F.col("Contract"), action_cost(F.col("category")))


def recommend_roi(df: DataFrame, k: int = TOP_ACTIONS, scorer: Scorer | None = None) -> DataFrame:
    return recommend(df, k, scorer).withColumns(_action_roi())


def best_roi_action(df: DataFrame, k: int = TOP_ACTIONS, scorer: Scorer | None = None) -> DataFrame:
    """Per customer the top-k action with the highest ROI % (ties -> better
    rank), chosen inside the row for the scorecard: no shuffle.  Customers
    to whom no action applies have no row."""
    if scorer is not None:
        w = Window.partitionBy(ID_COL).orderBy(F.desc_nulls_last("roi_pct"), "rank")
        out = recommend_roi(df, k, scorer).withColumn("__r", F.row_number().over(w))
        return out.filter(F.col("__r") == 1).drop("__r", "delta_pct")
    meta = {a[0]: a for a in ACTIONS}
    applicable = reduce(lambda x, y: x | y, [F.coalesce(c, F.lit(False)) for c in A.eligibility().values()])
    sc, ids, base = _action_scores(df.filter(applicable))
    sc = sc.withColumns({f"__r_{a}": _action_rank(a, ids) for a in ids})
    m, t, c = F.col("MonthlyCharges"), F.col("tenure"), F.col("Contract")
    structs = []
    for aid in ids:
        category = F.lit(meta[aid][3])
        pct = roi_columns(F.col(base), F.col(f"__p_{aid}"), m, t, c, action_cost(category))["roi_pct"]
        structs.append(F.when(F.col(f"__d_{aid}").isNotNull() & (F.col(f"__r_{aid}") <= k), F.struct(
            pct.alias("pct"), (-F.col(f"__r_{aid}")).alias("neg_rank"), F.lit(aid).alias("action_id"),
            F.lit(meta[aid][1]).alias("title"), category.alias("category"), F.col(f"__p_{aid}").alias("new_prob"),
            F.col(f"__d_{aid}").alias("delta"))))
    out = sc.withColumn("__b", F.greatest(*structs))  # skips the NULLs of actions that do not apply
    out = out.select(*df.columns, *[F.col(f"__b.{f}").alias(f) for f in ("action_id", "title", "category")],
                     F.col(base).alias("baseline_prob"), F.col("__b.new_prob").alias("new_prob"),
                     F.col("__b.delta").alias("delta"), (-F.col("__b.neg_rank")).cast("int").alias("rank"))
    return out.withColumns(_action_roi())


def breakeven_curve(best: DataFrame, max_months: int = BREAKEVEN_MAX_MONTHS) -> DataFrame:
    """Cumulative revenue saved per month 0..max for each (customer, action)
    row, a fixed fan-out of max+1 rows per input row."""
    red = F.greatest(F.lit(0.0), F.col("baseline_prob") - F.col("new_prob"))
    out = best.withColumn("month", F.explode(F.sequence(F.lit(0), F.lit(max_months))))
    return out.select(ID_COL, "action_id", "month",
                      round_half_up(F.col("MonthlyCharges") * red * F.col("month"), 2).alias("cumulative_saved"),
                      F.col("cost"))


# --- what-if ----------------------------------------------------------------

def _scenario_rows(df: DataFrame, scenario: dict) -> tuple[list[tuple], Column]:
    """[(feature, text, overrides, does it differ?)] and: does any differ?"""
    rows, changed_any = [], F.lit(False)
    for feat, val in scenario.items():
        differs = F.coalesce(F.col(feat).cast("string") != F.lit(val).cast("string"), F.lit(False))
        changed_any = changed_any | differs
        rows.append((feat, str(val), {feat: F.lit(val).cast(df.schema[feat].dataType)}, differs))
    combined = {f: F.lit(v).cast(df.schema[f].dataType) for f, v in scenario.items()}
    return rows + [("combined", None, combined, changed_any)], changed_any


def what_if(df: DataFrame, scenario: dict | None = None, scorer: Scorer | None = None) -> DataFrame:
    """One row per attribute whose scenario value differs from the
    customer's (compared as text), plus the combined scenario.  A
    ``scorer`` scores all scenario rows in one pass, without a shuffle."""
    scenario = dict(scenario or WHAT_IF_SCENARIO)
    rows, _ = _scenario_rows(df, scenario)
    label = [F.struct(F.lit(f).alias("feature"), F.lit(v).cast("string").alias("new_val"), F.lit(i).alias("i"))
             for i, (f, v, _, _) in enumerate(rows)]
    if scorer is None:
        # every probability once, as a column; the exploded structs read them
        sc = df.withColumns({"baseline_prob": scorecard.probability(),
                             **{f"__p{i}": scorecard.probability(o) for i, (_, _, o, _) in enumerate(rows)}})
        items = [F.when(d, F.struct(label[i].alias("s"), F.col(f"__p{i}").alias("probability")))
                 for i, (_, _, _, d) in enumerate(rows)]
        ex = sc.select(ID_COL, "baseline_prob", F.explode(F.array_compact(F.array(*items))).alias("x"))
        ex = ex.select(ID_COL, "baseline_prob", "x.s.feature", "x.s.new_val", "x.probability")
    else:
        base = _with(df, scorer, "baseline_prob")
        ex = base.withColumn("__s", F.explode(F.array_compact(F.array(
            *[F.when(d, label[i]) for i, (_, _, _, d) in enumerate(rows)]))))
        i = F.col("__s.i")
        ex = ex.withColumns({f: F.when(i.isin([j for j, r in enumerate(rows) if f in r[2]]), rows[-1][2][f])
                             .otherwise(F.col(f)) for f in scenario})
        ex = _with(ex, scorer, "probability").select(ID_COL, "baseline_prob", "__s.feature", "__s.new_val",
                                                     "probability")
    delta = F.col("probability") - F.col("baseline_prob")
    return ex.select(ID_COL, "baseline_prob", "feature", "new_val", "probability",
                     round_half_up(delta, 4).alias("delta"),
                     F.when(delta > WHAT_IF_DEAD_BAND, "Higher Risk")
                      .when(delta < -WHAT_IF_DEAD_BAND, "Lower Risk").otherwise("No Change").alias("direction"))


def customer_x_scenario(df: DataFrame, scenario: dict | None = None) -> DataFrame:
    """The rows of ``what_if`` without scoring them."""
    rows, _ = _scenario_rows(df, dict(scenario or WHAT_IF_SCENARIO))
    items = [F.when(d, F.struct(F.lit(f).alias("feature"), F.lit(v).cast("string").alias("new_val")))
             for f, v, _, d in rows]
    return df.select(ID_COL, F.explode(F.array_compact(F.array(*items))).alias("s")).select(ID_COL, "s.*")


# --- profile vs average -------------------------------------------------------

def profile_vs_average(df: DataFrame, feats=("tenure", "MonthlyCharges", "TotalCharges")) -> DataFrame:
    """Customer, average churner and average stayer on a min-max scale (all
    statistics in one scalar subquery)."""
    aggs = {}
    for i, f in enumerate(feats):
        x = F.col(f).cast("double")
        aggs.update({f"lo{i}": F.min(x), f"hi{i}": F.max(x), f"ch{i}": F.avg(F.when(F.col("Churn") == 1, x)),
                     f"st{i}": F.avg(F.when(F.col("Churn") == 0, x))})
    s = scalar_stats(df, **aggs)
    rows = []
    for i, f in enumerate(feats):
        x = F.col(f).cast("double")
        lo, hi, ch, st = s[f"lo{i}"], s[f"hi{i}"], s[f"ch{i}"], s[f"st{i}"]
        rng = F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo)

        def norm(v, lo=lo, rng=rng):
            return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - lo) / rng)), 6)
        rows.append(F.struct(F.lit(f).alias("feature"), norm(x).alias("customer_norm"),
                             norm(ch).alias("churner_norm"), norm(st).alias("stayer_norm")))
    ex = df.select(ID_COL, F.explode(F.array(*rows)).alias("r"))
    return ex.select(ID_COL, "r.*")
