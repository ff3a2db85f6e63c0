"""Votes and classification metrics over prediction rows (truth, pred)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def majority_vote(predictions: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Per subject: its truth, the most frequent prediction (ties: alphabetically first) and row count.

    Counts per (subject, prediction) are aggregated first, so a subject with very many rows
    reaches the vote as a handful of counts.
    """
    counts = predictions.groupBy(subject, "pred").agg(F.count("*").alias("_n"), F.min("truth").alias("truth"))
    return (counts.groupBy(subject)
            .agg(F.min("truth").alias("truth"), F.min(F.struct(-F.col("_n"), "pred"))["pred"].alias("pred"),
                 F.sum("_n").alias("epochs")))


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("truth", "pred").agg(F.count("*").alias("n"))


def confusion_matrix(predictions: DataFrame, labels: list[str]) -> DataFrame:
    """One row per true class, one column per predicted class."""
    return (predictions.groupBy("truth").pivot("pred", labels).agg(F.count(F.lit(1))).na.fill(0).orderBy("truth"))


def class_scores(predictions: DataFrame) -> DataFrame:
    """Recall and F1 of every class that occurs as truth or prediction (undefined scores are 0)."""
    sides = F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")),
                              F.struct(F.col("pred").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"))))
    hit = F.when((F.col("truth") == F.col("pred")) & (F.col("s.t") == 1), F.col("n")).otherwise(0)
    per = (confusion(predictions).withColumn("s", sides).groupBy(F.col("s.label").alias("label"))
           .agg(F.sum(hit).alias("hits"), F.sum(F.col("s.t") * F.col("n")).alias("support"),
                F.sum(F.col("s.p") * F.col("n")).alias("predicted")))
    return (per.withColumn("recall", F.when(F.col("support") > 0, F.col("hits") / F.col("support")))
            .withColumn("f1", F.col("hits") * 2.0 / (F.col("support") + F.col("predicted"))))


def summary_metrics(predictions: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """balanced_accuracy (mean recall of true classes) and macro_f1.

    Macro F1 averages over ``labels`` when given, else over the classes that occur.
    """
    per = class_scores(predictions)
    if labels is None:
        return per.agg(F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"))
    inside = F.when(F.col("label").isin(*labels), F.col("f1"))
    return per.agg(F.avg("recall").alias("balanced_accuracy"),
                   (F.coalesce(F.sum(inside), F.lit(0.0)) / len(labels)).alias("macro_f1"))
