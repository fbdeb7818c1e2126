"""Model evaluation on a scored table ``(id, y, p)``.

Scale: every curve is computed from the *score histogram* -- one row per
distinct probability with its positive/negative counts, built by a partial
aggregate.  With the 4-decimal scorecard the histogram has at most 10,001 rows
whatever the number of customers; a fitted model's raw probabilities can
give one row per customer, so the cumulative counts that turn it into
ROC / PR points are a distributed prefix sum (``common.running_sums``),
never a single-partition window.  The previous point of a curve is the current
cumulative count minus this score's own count (no ``lag``).  Threshold
sweeps cross the histogram with a fixed 50-point grid
(an ``explode`` of a literal array, not a join).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (CALIBRATION_BINS, DECISION_THRESHOLD, PDP_GRID_POINTS, SHAP_BINS, THRESHOLD_GRID_HIGH,
                         THRESHOLD_GRID_LOW, THRESHOLD_GRID_POINTS)
from ..functions import scorecard
from .common import quantiles, running_sums, scalar_stats


Scorer = Callable[[DataFrame], DataFrame]


def _div0(a: Column, b: Column) -> Column:
    """a / b with 0 when b is 0 (zero_division=0)."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def score_histogram(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return scored.groupBy(F.col(p).alias("p")).agg(
        F.sum(F.col(y)).cast("bigint").alias("pos"),
        F.sum(F.lit(1) - F.col(y)).cast("bigint").alias("neg"))


def confusion_matrix(scored: DataFrame, threshold: float = DECISION_THRESHOLD) -> DataFrame:
    pred = F.when(F.col("p") >= threshold, 1).otherwise(0)
    cm = scored.groupBy(F.col("y"), pred.alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    row_total = F.sum("n").over(Window.partitionBy("y"))  # <= 4 aggregated rows
    return cm.withColumn("row_pct", F.round(F.col("n") * 100.0 / row_total, 4))


def _counts(scored: DataFrame, threshold: float) -> DataFrame:
    pred = F.col("p") >= threshold
    return scored.agg(
        F.count_if(pred & (F.col("y") == 1)).alias("tp"), F.count_if(pred & (F.col("y") == 0)).alias("fp"),
        F.count_if(~pred & (F.col("y") == 1)).alias("fn"), F.count_if(~pred & (F.col("y") == 0)).alias("tn"))


def _prf(tp, fp, fn) -> dict[str, Column]:
    precision = _div0(tp.cast("double"), (tp + fp).cast("double"))
    recall = _div0(tp.cast("double"), (tp + fn).cast("double"))
    f1 = _div0(2.0 * tp.cast("double"), (2 * tp + fp + fn).cast("double"))
    return {"precision": precision, "recall": recall, "f1": f1}


def metrics_at_threshold(scored: DataFrame, threshold: float = DECISION_THRESHOLD) -> DataFrame:
    c = _counts(scored, threshold)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = (tp + fp + fn + tn).cast("double")
    m = _prf(tp, fp, fn)
    return c.select(F.lit(threshold).alias("threshold"),
                    F.round((tp + tn) / n, 6).alias("accuracy"),
                    *[F.round(v, 6).alias(k) for k, v in m.items()],
                    F.round((tp + fp) * 100.0 / n, 4).alias("predicted_pct"))


def classification_report(scored: DataFrame, threshold: float = DECISION_THRESHOLD) -> DataFrame:
    """Per-class and macro precision / recall / F1 / support."""
    c = _counts(scored, threshold)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    pos = _prf(tp, fp, fn)     # class 1
    neg = _prf(tn, fn, fp)     # class 0 (roles swapped)
    rows = F.array(
        F.struct(F.lit("0").alias("label"), neg["precision"].alias("precision"), neg["recall"].alias("recall"),
                 neg["f1"].alias("f1"), (tn + fp).alias("support")),
        F.struct(F.lit("1").alias("label"), pos["precision"].alias("precision"), pos["recall"].alias("recall"),
                 pos["f1"].alias("f1"), (tp + fn).alias("support")),
        F.struct(F.lit("macro avg").alias("label"), ((pos["precision"] + neg["precision"]) / 2).alias("precision"),
                 ((pos["recall"] + neg["recall"]) / 2).alias("recall"), ((pos["f1"] + neg["f1"]) / 2).alias("f1"),
                 (tp + fp + fn + tn).alias("support")))
    out = c.select(F.explode(rows).alias("r")).select("r.*")
    return out.select("label", *[F.round(k, 6).alias(k) for k in ("precision", "recall", "f1")],
                      F.col("support").cast("bigint").alias("support"))


def threshold_grid(low=THRESHOLD_GRID_LOW, high=THRESHOLD_GRID_HIGH, n=THRESHOLD_GRID_POINTS) -> list[float]:
    return [float(x) for x in np.linspace(low, high, n)]


def threshold_curve(scored: DataFrame, grid: list[float] | None = None) -> DataFrame:
    """Precision, recall and F1 at each threshold.  A score counts for the
    grid points not above it: rows are aggregated by that number first, then
    the at most len(grid) + 1 sums are added up for every grid point."""
    grid = sorted(grid or threshold_grid())
    passed = sum((F.when(F.col("p") >= t, 1).otherwise(0) for t in grid), F.lit(0))
    small = scored.groupBy(passed.alias("passed")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    at = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(grid)])
    ex = small.withColumn("g", F.explode(at)).select("*", "g.*")
    ge = F.col("passed") > F.col("i")
    agg = ex.groupBy("t").agg(
        F.sum(F.when(ge, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(ge, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(ge, 0).otherwise(F.col("pos"))).alias("fn"))
    m = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return agg.select(F.round("t", 6).alias("threshold"), *[F.round(v, 6).alias(k) for k, v in m.items()])


def _cumulative(scored: DataFrame) -> DataFrame:
    """Histogram rows in descending score order with running TP / FP, the
    distributed prefix sum whatever the scores' precision."""
    hist = score_histogram(scored)
    tot = scalar_stats(hist, P=F.sum("pos"), N=F.sum("neg"))
    run = running_sums(hist, F.desc("p"), ["pos", "neg"])
    return run.select("p", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
                      tot["P"].alias("tot_pos"), tot["N"].alias("tot_neg"))


def _end_point(df: DataFrame, x: str, y: str, values: tuple[float, float]) -> DataFrame:
    """One more point, where nothing is predicted positive (threshold NULL)."""
    return df.unionByName(df.sparkSession.range(1).select(
        F.lit(None).cast(df.schema["threshold"].dataType).alias("threshold"),
        F.lit(values[0]).alias(x), F.lit(values[1]).alias(y)))


def roc_curve(scored: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, and the start (0, 0)."""
    c = _cumulative(scored)
    out = c.select(F.col("p").alias("threshold"), F.round(_div0(F.col("fp"), F.col("tot_neg")), 6).alias("fpr"),
                   F.round(_div0(F.col("tp"), F.col("tot_pos")), 6).alias("tpr"))
    return _end_point(out, "fpr", "tpr", (0.0, 0.0))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Trapezoid area under the ROC points (ties handled as one step)."""
    c = _cumulative(scored)
    fpr = _div0(F.col("fp"), F.col("tot_neg"))
    tpr = _div0(F.col("tp"), F.col("tot_pos"))
    fpr0 = _div0(F.col("fp") - F.col("neg"), F.col("tot_neg"))
    tpr0 = _div0(F.col("tp") - F.col("pos"), F.col("tot_pos"))
    return c.agg(F.round(F.sum((fpr - fpr0) * (tpr + tpr0) / 2.0), 6).alias("roc_auc"))


def pr_curve(scored: DataFrame) -> DataFrame:
    """(threshold, precision, recall) at every distinct score, and the end
    (recall 0, precision 1)."""
    c = _cumulative(scored)
    out = c.select(F.col("p").alias("threshold"),
                   F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"),
                   F.round(_div0(F.col("tp"), F.col("tot_pos")), 6).alias("recall"))
    return _end_point(out, "precision", "recall", (1.0, 0.0))


def average_precision(scored: DataFrame) -> DataFrame:
    """sum over thresholds of (R_n - R_{n-1}) * P_n, plus the base rate."""
    c = _cumulative(scored)
    rec = _div0(F.col("tp"), F.col("tot_pos"))
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    rec0 = _div0(F.col("tp") - F.col("pos"), F.col("tot_pos"))
    return c.agg(F.round(F.sum((rec - rec0) * prec), 6).alias("average_precision"),
                 F.round(F.first("tot_pos") / (F.first("tot_pos") + F.first("tot_neg")), 6).alias("base_rate"))


def calibration_edges(n_bins: int = CALIBRATION_BINS) -> list[float]:
    return [float(x) for x in np.linspace(0.0, 1.0, n_bins + 1)]


def calibration(scored: DataFrame, n_bins: int = CALIBRATION_BINS) -> DataFrame:
    """Uniform bins: a score equal to an inner edge falls in the lower bin;
    empty bins do not appear."""
    inner = calibration_edges(n_bins)[1:-1]
    b = sum((F.when(F.col("p") > e, 1).otherwise(0) for e in inner), F.lit(0))
    return scored.groupBy(b.alias("bin")).agg(
        F.round(F.avg("p"), 6).alias("mean_pred"), F.round(F.avg("y"), 6).alias("observed"),
        F.count(F.lit(1)).alias("n"))


def pdp_grid(df: DataFrame, feature: str, points: int = PDP_GRID_POINTS) -> list[float]:
    """The feature's distinct values where they are fewer than ``points``,
    else ``points`` even steps from its 5th to its 95th percentile (at most
    ``points`` numbers on the driver)."""
    counts = df.groupBy(F.col(feature).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n")) \
               .filter(F.col("value").isNotNull())
    few = [r["value"] for r in counts.select("value").limit(points).collect()]
    if len(few) < points:
        return sorted(few)
    b = quantiles(counts, {"lo": 0.05, "hi": 0.95}).first()
    return [b["lo"] + i * (b["hi"] - b["lo"]) / float(points - 1) for i in range(points)]


def partial_dependence(df: DataFrame, feature: str, points: int = PDP_GRID_POINTS,
                       scorer: Scorer = scorecard.score) -> DataFrame:
    """Mean score over a grid of the feature, the other columns as observed.
    Every row is scored at every grid point: a fixed fan-out, aggregated
    map-side to one partial row per grid point."""
    grid = pdp_grid(df, feature, points)
    at = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(g).alias("g")) for i, g in enumerate(grid)])
    ex = df.drop(feature).withColumn("__g", F.explode(at)).withColumn(feature, F.col("__g.g"))
    return scorer(ex).groupBy(F.col("__g.i").alias("grid_index"), F.round("__g.g", 6).alias("grid_value")) \
                     .agg(F.round(F.avg("p"), 6).alias("avg_p"))


def linear_contributions(df: DataFrame, id_col: str = "customerID", top: int | None = None) -> DataFrame:
    """Per-row additive attributions of the linear scorecard on the margin
    scale: w_j * (x_j - mean(x_j)); base = margin at the means.  Long format,
    ranked by |contribution| within the row (sorted inside the row, then
    ``posexplode``: no shuffle, no window).  With ``top``, the terms after
    the first ``top`` are summed up in one last row ``other``."""
    terms = scorecard.TERMS
    means = scalar_stats(df, **{f"m{i}": F.avg(scorecard.term_value(t)) for i, (t, _) in enumerate(terms)})
    base = F.lit(scorecard.INTERCEPT)
    for i, (t, w) in enumerate(terms):
        base = base + F.lit(w) * means[f"m{i}"]
    structs = []
    for i, (t, w) in enumerate(terms):
        c = F.lit(w) * (scorecard.term_value(t) - means[f"m{i}"])
        structs.append(F.struct((-F.abs(c)).alias("neg_abs"), F.lit(t).alias("feature"), c.alias("contribution")))
    arr = F.sort_array(F.array(*structs))
    if top and top < len(terms):
        df, arr = df.select(id_col, arr.alias("__c"), base.alias("__base")), F.col("__c")
        base = F.col("__base")
        rest = sum((arr[i]["contribution"] for i in range(top, len(terms))), F.lit(0.0))
        other = F.struct((-F.abs(rest)).alias("neg_abs"), F.lit("other").alias("feature"), rest.alias("contribution"))
        arr = F.concat(F.slice(arr, 1, top), F.array(other))
    ex = df.select(id_col, F.round(base, 6).alias("base_margin"), F.posexplode(arr).alias("pos", "c"))
    return ex.select(id_col, "base_margin", F.col("c.feature").alias("feature"),
                     F.round(F.col("c.contribution"), 6).alias("contribution"),
                     (F.col("pos") + 1).cast("int").alias("rank"))


def shap_dependence(df: DataFrame, feature: str, id_col: str = "customerID") -> DataFrame:
    """Correlation of one feature's attribution with every other scorecard
    input, strongest |corr| first (rank 1 is the colouring feature)."""
    terms = [t for t, _ in scorecard.TERMS]
    if feature not in terms:
        raise ValueError(f"{feature} is not a scorecard term")
    idx = terms.index(feature)
    w = scorecard.TERMS[idx][1]
    mean = df.agg(F.avg(scorecard.term_value(feature))).scalar()
    contrib = F.lit(w) * (scorecard.term_value(feature) - mean)
    others = [t for t in terms if t != feature]
    wide = df.agg(*[F.corr(contrib, scorecard.term_value(t)).alias(f"c{i}") for i, t in enumerate(others)])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(t).alias("other_feature"), F.col(f"c{i}").alias("corr"))
                                           for i, t in enumerate(others)])).alias("r")).select("r.*")
    long = long.filter(F.col("corr").isNotNull() & ~F.isnan("corr"))
    rk = Window.orderBy(F.desc(F.abs("corr")), F.asc("other_feature"))  # <= 8 rows
    return long.select(F.lit(feature).alias("feature"), "other_feature", F.round("corr", 6).alias("corr"),
                       F.row_number().over(rk).alias("rank"))


def attribution_bins(points: DataFrame, bins: int = SHAP_BINS) -> DataFrame:
    """Attribution against value: ``points`` (feature, x, contribution) in ``bins`` equal ranges of each feature's
    values, with the number of rows, mean value, mean attribution and its (population) deviation.

    Sums that merge, so a hot value costs a row per task; a row without a value (null, NaN) is in no bin.
    """
    points = points.filter(F.col("x").isNotNull() & ~F.isnan("x") & F.col("contribution").isNotNull())
    ends = points.groupBy("feature").agg(F.min("x").alias("__lo"), F.max("x").alias("__hi"))  # one row per feature
    share = (F.col("x") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * F.lit(float(bins))
    at = F.when(F.col("__hi") > F.col("__lo"), F.least(F.floor(share), F.lit(bins - 1))).otherwise(0).cast("int")
    return (points.join(ends, "feature").groupBy("feature", at.alias("bin"))
            .agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("value"),
                 F.round(F.avg("contribution"), 6).alias("contribution"),
                 F.round(F.stddev_pop("contribution"), 6).alias("spread")))


def linear_points(df: DataFrame) -> DataFrame:
    """(feature, x, contribution) of the scorecard's terms, one row per customer and term."""
    means = scalar_stats(df, **{f"m{i}": F.avg(scorecard.term_value(t)) for i, (t, _) in enumerate(scorecard.TERMS)})
    each = [F.struct(F.lit(t).alias("feature"), scorecard.term_value(t).cast("double").alias("x"),
                     (F.lit(w) * (scorecard.term_value(t) - means[f"m{i}"])).alias("contribution"))
            for i, (t, w) in enumerate(scorecard.TERMS)]
    return df.select(F.explode(F.array(*each)).alias("e")).select("e.*")
