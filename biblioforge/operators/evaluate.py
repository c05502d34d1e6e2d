"""Evaluation against sets of DOIs: confusion counts per base, metrics, missed and earned matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(pos: DataFrame, neg: DataFrame, pred: DataFrame) -> DataFrame:
    """(base, tp, fp, fn, tn). Inputs are (base, doi). Predictions outside both sets are not counted; bases without predictions stay."""
    p = pred.select("base", "doi").distinct().withColumn("hit", F.lit(1))
    gold = pos.select("base", "doi").distinct().withColumn("is_pos", F.lit(True)).unionByName(neg.select("base", "doi").distinct().withColumn("is_pos", F.lit(False)))
    x = gold.join(p, ["base", "doi"], "left")
    hit, is_pos = F.col("hit").isNotNull(), F.col("is_pos")
    return x.groupBy("base").agg(F.count_if(is_pos & hit).alias("tp"), F.count_if(~is_pos & hit).alias("fp"), F.count_if(is_pos & ~hit).alias("fn"), F.count_if(~is_pos & ~hit).alias("tn"))


def metrics(counts: DataFrame) -> DataFrame:
    """Sums and precision, recall, F1, accuracy in percent; 0 where a denominator is 0."""
    s = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "tn")])
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    s = s.withColumns({"precision": div(tp, tp + fp), "recall": div(tp, tp + fn), "accuracy": div(tp + tn, tp + fp + fn + tn)})
    s = s.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return s.select("tp", "fp", "fn", "tn", *[F.round(F.col(c) * 100, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


def missed(gold: DataFrame, pred: DataFrame) -> DataFrame:
    return gold.select("base", "doi").distinct().join(pred.select("base", "doi").distinct(), ["base", "doi"], "left_anti")


def earned(gold: DataFrame, pred: DataFrame) -> DataFrame:
    return missed(pred, gold)


def filtered(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Predictions merged with their gold rows by DOI (last gold row wins); columns of both come from the prediction."""
    last = gold.groupBy("doi").agg(F.max_by(F.struct(*[c for c in gold.columns if c != "doi"]), "ordinal").alias("g"))
    both = {c for c in pred.columns if c in gold.columns and c != "doi"}
    x = pred.join(last, "doi")
    return x.select("doi", *[c for c in pred.columns if c != "doi"], *[F.col(f"g.{c}") for c in gold.columns if c not in both and c not in ("doi", "ordinal")])


def pivoted(props: DataFrame, predicates: list[str]) -> DataFrame:
    """One row a resource, one column a predicate; of several values the greatest."""
    return props.groupBy("br").pivot("p", sorted(predicates)).agg(F.max("o"))
