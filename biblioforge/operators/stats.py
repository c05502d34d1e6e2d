"""Counts and rates of a matching run: per file and in all by one rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.native import percentage
from ..session import merged

FIELDS = ("author", "title", "doi", "year", "volume", "page")


def coverage(prepared: DataFrame, by: str = "source_file") -> DataFrame:
    """How many references have each field, per file and (null file) in all."""
    have = [F.count_if(F.col("r_year").isNotNull() if f == "year" else F.col(f"r_{f}") != "").alias(f"n_{f}") for f in FIELDS]
    return prepared.rollup(by).agg(F.count(F.lit(1)).alias("n_references"), *have)


def contribution(won: DataFrame) -> DataFrame:
    """How many winners earn each component; fuzzy titles count from 75."""
    hit = lambda c: F.count_if(F.col(f"c_{c}") > 0).alias(f"by_{c}")
    return won.agg(F.count(F.lit(1)).alias("n_matches"), hit("doi"), hit("author"), hit("year"), F.count_if(F.abs(F.col("r_year") - F.substring("pub_date", 1, 4).try_cast("int")) == 1).alias("by_year_adjacent"), hit("volume"), hit("page"), F.count_if(F.col("title_sim") >= 100).alias("by_title_exact"), F.count_if((F.col("title_sim") >= 75) & (F.col("title_sim") < 100)).alias("by_title_fuzzy"))


def distribution(won: DataFrame) -> DataFrame:
    """Matches by query type with their share."""
    n = F.count(F.lit(1))
    return won.groupBy("query_type").agg(n.alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


def rates(prepared: DataFrame, won: DataFrame, by: str = "source_file") -> DataFrame:
    """References, matches and match rate per file and in all; files without matches stay."""
    m = won.select("ref_id", F.lit(1).alias("hit"))
    out = merged(prepared, m, "ref_id", "left").rollup(by).agg(F.count(F.lit(1)).alias("n_references"), F.count("hit").alias("n_matches"))
    return out.withColumn("match_rate", F.round(percentage(F.col("n_matches"), F.col("n_references")), 6))


def band(rate: Column) -> Column:
    """Wording of a match rate."""
    return F.when(rate >= 60, "high").when(rate >= 40, "moderate").when(rate >= 20, "low").otherwise("very low")


def badge(share: Column) -> Column:
    return F.when(share >= 40, "Primary").when(share >= 20, "Secondary").otherwise("Minor")
