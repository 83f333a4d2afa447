"""Quality of a result against examples or another result."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def confusion_matrix(result: DataFrame, positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """``tp, fn, fp, tn`` of a result (column ``ind``) over distinct example names, in one pass of one join."""
    examples = positives.select("ind").distinct().withColumn("good", F.lit(True)).unionAll(negatives.select("ind").distinct().withColumn("good", F.lit(False)))
    found = result.select(F.col("ind").alias("__found")).distinct()
    rows = examples.join(found, F.col("ind") == F.col("__found"), "left").select("good", F.col("__found").isNotNull().alias("hit"))
    return rows.agg(F.count_if(F.col("good") & F.col("hit")).alias("tp"), F.count_if(F.col("good") & ~F.col("hit")).alias("fn"), F.count_if(~F.col("good") & F.col("hit")).alias("fp"), F.count_if(~F.col("good") & ~F.col("hit")).alias("tn"))


def agreement(predicted: DataFrame, wanted: DataFrame) -> DataFrame:
    """``both, only_predicted, only_wanted, jaccard, f1`` of two sets of names; two empty sets agree fully."""
    a = predicted.select(F.col("ind").alias("a")).distinct()
    b = wanted.select(F.col("ind").alias("b")).distinct()
    n = a.join(b, F.col("a") == F.col("b"), "full").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("only_predicted"), F.count_if(F.col("a").isNull()).alias("only_wanted"))
    total = F.col("both") + F.col("only_predicted") + F.col("only_wanted")
    jaccard = F.when(total == 0, 1.0).otherwise(F.col("both") / total)
    f1 = F.when(total == 0, 1.0).otherwise(2 * F.col("both") / (2 * F.col("both") + F.col("only_predicted") + F.col("only_wanted")))
    return n.withColumns({"jaccard": jaccard, "f1": f1})


def agreement_table(spark: SparkSession, results: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """``kind, n, jaccard, f1``: how far two answers agree, on average over the expressions of each kind.

    ``results`` are (kind of the expression, answer, wanted answer); each pair is one aggregate, and only its figures meet.
    """
    rows = [agreement(got, wanted).select(F.lit(kind).alias("kind"), "jaccard", "f1") for kind, got, wanted in results]
    if not rows:
        return spark.createDataFrame([], "kind string, n long, jaccard double, f1 double")
    return reduce(DataFrame.unionAll, rows).groupBy("kind").agg(F.count("*").alias("n"), F.avg("jaccard").alias("jaccard"), F.avg("f1").alias("f1"))


def best(scored: DataFrame, k: int = 10, order: Sequence[Column] = ()) -> DataFrame:
    """The first ``k`` rows by ``order``; without one, those of highest ``score``, ties by name."""
    return scored.orderBy(*(order or (F.desc("score"), F.col("ind")))).limit(k)
