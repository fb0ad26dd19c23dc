"""Prompt-variant evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed label map of the evaluation: anything else becomes -1.
LABELS = {"negative": 0, "positive": 1}


def prediction_int(word) -> "F.Column":
    """Lower-case word → 0/1, else −1 (also for no word at all)."""
    w = F.lower(word if not isinstance(word, str) else F.col(word))
    expr = F.lit(-1)
    for k, v in LABELS.items():
        expr = F.when(w == k, F.lit(v)).otherwise(expr)
    return expr


def predictions(generated: DataFrame, text_col: str = "generated") -> DataFrame:
    """N19 + N20 on model output."""
    return (generated.withColumn("prediction", T.last_token(text_col))
            .withColumn("prediction_int", prediction_int(F.col("prediction"))))


def accuracy_by(pred: DataFrame, group: str = "prompt", label_col: str = "label") -> DataFrame:
    """A2 per group (A3): mean of prediction_int == label."""
    hit = (F.col("prediction_int") == F.col(label_col)).cast("double")
    return pred.groupBy(group).agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def best_variant(acc: DataFrame, group: str = "prompt") -> DataFrame:
    """A3: the variant with the highest accuracy (ties → smallest name)."""
    return acc.agg(F.min_by(F.col(group), F.struct(-F.col("accuracy"), F.col(group))).alias("best_prompt"),
                   F.max("accuracy").alias("best_accuracy"))
