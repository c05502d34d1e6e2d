"""Inputs and outputs of the evaluation: cited DOIs, files of matches, looked-up properties, comparison tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import native as N
from ..schema import CROSSREF
from .files import decoded

NO_DOI = ("", ".")


def _base(path: Column, ending: str) -> Column:
    return F.regexp_extract(path, rf"([^/]+){ending}$", 1)


def cited_dois(spark: SparkSession, path: str) -> DataFrame:
    """(base, reference_id, doi) of the references with a DOI in each JSON file; ids ``b0``, ``b1``, ... by place.

    Files may be UTF-8 with or without mark, or a one-byte encoding; those that can't be read give no row.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    docs = raw.select(_base(F.col("path"), r"\.json").alias("base"), F.from_json(decoded(F.col("content")), CROSSREF).alias("j"))
    refs = docs.select("base", F.posexplode("j.message.reference").alias("i", "r"))
    doi = F.lower(F.replace(F.col("r.DOI"), F.lit("\\/"), F.lit("/")))
    return refs.where(F.col("r.DOI").isNotNull() & ~F.col("r.DOI").isin(*NO_DOI)).select("base", F.concat(F.lit("b"), F.col("i").cast("string")).alias("reference_id"), doi.alias("doi"))


def match_files(bases: DataFrame, paths: DataFrame) -> DataFrame:
    """(base, path): the file of matches of each base, the likeliest first.

    First ``<base>_matches.csv``, then ``<base>_matches_GS.csv``, then any CSV file whose name has ``matches`` and
    the base between underscores or ends, in the order of paths. Bases without a file give no row. A name's runs
    of parts are join keys, so no pair of a base and a foreign file is looked at.
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    files = paths.select("path", F.lower(name).alias("name"), name.alias("whole")).where(F.col("name").endswith(".csv") & F.col("name").contains("matches"))
    parts = F.split(F.regexp_replace("name", r"\.csv$", ""), "_")
    n = F.size(parts)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(parts, i, k), "_"))))
    keyed = files.select("path", "whole", F.explode(F.array_distinct(runs)).alias("key"))
    b = bases.select("base").distinct().withColumn("key", F.lower("base"))
    rank = F.when(F.col("whole") == F.concat("base", F.lit("_matches.csv")), 0).when(F.col("whole") == F.concat("base", F.lit("_matches_GS.csv")), 1).otherwise(2)
    return b.join(keyed, "key").groupBy("base").agg(F.min_by("path", F.struct(rank.alias("r"), F.col("path").alias("p"))).alias("path"))


def looked_up(dois: DataFrame, properties: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(with properties, without): cited DOIs split by whether ``properties`` (doi, p, o) has any of theirs."""
    known = properties.select("doi").distinct()
    return dois.join(known, "doi", "left_semi"), dois.join(known, "doi", "left_anti")


def doi_results(dois: DataFrame, properties: DataFrame, predicates: list[str]) -> DataFrame:
    """(base, reference_id, DOI, one column a predicate); of several values the greatest, missing ones empty."""
    wide = properties.groupBy("doi").pivot("p", sorted(predicates)).agg(F.max("o"))
    return dois.join(wide, "doi").select("base", "reference_id", F.col("doi").alias("DOI"), *[F.coalesce(F.col(f"`{p}`"), F.lit("")).alias(p) for p in sorted(predicates)])


def unmatched_dois(without: DataFrame) -> DataFrame:
    return without.select("base", "reference_id", F.col("doi").alias("DOI"))


def statistics(dois: DataFrame, found: DataFrame) -> DataFrame:
    """(base, Metric, Value): queries, successful ones and their rate, ``N/A`` without queries."""
    n = dois.groupBy("base").agg(F.count(F.lit(1)).alias("n")).join(found.groupBy("base").agg(F.count(F.lit(1)).alias("k")), "base", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    rate = F.when(F.col("n") > 0, F.format_string("%.2f%%", N.percentage(F.col("k"), F.col("n")))).otherwise("N/A")
    rows = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(m).alias("Metric"), v.cast("string").alias("Value")) for i, (m, v) in enumerate((("Total queries", F.col("n")), ("Successful queries", F.col("k")), ("Success rate", rate)))])
    return n.select("base", F.explode(rows).alias("r")).select("base", "r.at", "r.Metric", "r.Value")


def comparison(missed: DataFrame, earned: DataFrame) -> DataFrame:
    """(kind, base, reference_id, doi, total): missed and earned matches in one table with the total of each kind."""
    both = missed.select(F.lit("missed").alias("kind"), "base", "reference_id", "doi").unionByName(earned.select(F.lit("earned").alias("kind"), "base", "reference_id", "doi"))
    return both.join(both.groupBy("kind").agg(F.count(F.lit(1)).alias("total")), "kind")


def compared(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """``comparison`` of (base, reference_id, doi) tables; DOIs are normalised, the last row of a DOI counts (``ordinal``)."""

    def last(df: DataFrame) -> DataFrame:
        x = df.withColumn("doi", N.norm_doi_eval(F.col("doi"))).where("doi <> ''")
        return x.groupBy("base", "doi").agg(F.max_by("reference_id", "ordinal").alias("reference_id"))

    g, p = last(gold), last(pred)
    return comparison(g.join(p, ["base", "doi"], "left_anti"), p.join(g, ["base", "doi"], "left_anti"))


def sorted_by_place(df: DataFrame) -> DataFrame:
    """Rows of each base in the order of their references' numbers, for writers."""
    return df.repartition("base").sortWithinPartitions("base", F.substring("reference_id", 2, 20).try_cast("int"))


def numbered(df: DataFrame, by: str) -> DataFrame:
    """Adds ``ordinal`` from 1 within each base, for tables that were read without one."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy("base").orderBy(by)))
