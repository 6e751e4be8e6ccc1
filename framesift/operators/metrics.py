"""Metrics of binary scores: confusion, rates, ROC-AUC, calibration error, Brier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usable() -> Column:
    """Rows (label, score) that metrics take: label 0 or 1, finite score in 0..1."""
    return F.col("label").isin(0, 1) & (F.col("score") >= 0) & (F.col("score") <= 1) & ~F.isnan("score")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def confusion(rows: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """tp, tn, fp, fn at score >= threshold."""
    hit, truth = F.col("score") >= threshold, F.col("label") == 1
    return rows.groupBy(*(by or [])).agg(
        F.count_if(hit & truth).alias("tp"), F.count_if(~hit & ~truth).alias("tn"), F.count_if(hit & ~truth).alias("fp"), F.count_if(~hit & truth).alias("fn")
    )


def rates(counts: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall, specificity, f1; null where there is nothing to divide by."""
    c = {k: F.col(k) for k in ("tp", "tn", "fp", "fn")}
    p, r = _ratio(c["tp"], c["tp"] + c["fp"]), _ratio(c["tp"], c["tp"] + c["fn"])
    return counts.select(
        "*", _ratio(c["tp"] + c["tn"], c["tp"] + c["tn"] + c["fp"] + c["fn"]).alias("accuracy"), p.alias("precision"), r.alias("recall"),
        _ratio(c["tn"], c["tn"] + c["fp"]).alias("specificity"), F.when(p + r > 0, 2 * p * r / (p + r)).alias("f1"),
    )


def roc_auc(rows: DataFrame) -> DataFrame:
    """One row: roc_auc by the rank sum with average ranks for ties; null for one class only.

    Rows are first counted by score. The running count over scores is the sum of a score range's
    offset and a window inside that range, so no task orders all scores; ranges are equal-width bins
    of the score, which is bounded by 0 and 1.
    """
    by_score = rows.groupBy("score").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("p")).withColumn("bin", F.floor(F.col("score") * 4096).cast("int"))
    bins = by_score.groupBy("bin").agg(F.sum("n").alias("n"))
    # At most 4097 rows: one task for their running sum.
    offsets = bins.select("bin", (F.sum("n").over(Window.orderBy("bin")) - F.col("n")).alias("offset"))
    inside = F.sum("n").over(Window.partitionBy("bin").orderBy("score")) - F.col("n")
    ranked = by_score.withColumn("inside", inside).join(offsets, "bin")
    rank = F.col("offset") + F.col("inside") + (F.col("n") + 1) / 2
    s = ranked.agg(F.sum(F.col("p") * rank).alias("ranks"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("m"))
    return s.select(F.when((F.col("p") > 0) & (F.col("m") > 0), (F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("m"))).alias("roc_auc"))


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """One row: mean over equal-width bins (the last closed) of |mean score - share of 1|, by rows."""
    at = sum(((F.col("score") >= i / bins).cast("int") for i in range(1, bins)), F.lit(0))
    grouped = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("s"), F.avg("label").alias("y"))
    return grouped.agg((F.sum(F.col("n") * F.abs(F.col("s") - F.col("y"))) / F.sum("n")).alias("ece"))


def brier(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier_score"))


def status_counts(rows: DataFrame) -> DataFrame:
    of = lambda s: F.count_if(F.col("status") == s)
    return rows.agg(F.count("*").alias("samples"), of("evaluated").alias("evaluated"), of("no_face").alias("no_face"), of("read_error").alias("read_errors"))


def evaluate(rows: DataFrame, threshold: float) -> DataFrame:
    """All metrics of the usable rows in one row; an error if there are none."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must lie in 0..1")
    good = rows.filter(usable())
    if good.isEmpty():
        raise ValueError("no evaluated samples")
    return rates(confusion(good, threshold)).crossJoin(roc_auc(good)).crossJoin(calibration_error(good)).crossJoin(brier(good))  # single rows
