"""Tables and files that a run leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import UNMATCHED_COLUMNS

NA = "N/A"


def matches(won: DataFrame) -> DataFrame:
    """The matches table; missing values read ``N/A``."""
    or_na = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(NA))
    return won.select(F.col("ref_id").alias("reference_id"), or_na("r_title").alias("article_title"), or_na("title").alias("matched_title"), F.col("score").cast("int").alias("score"), or_na("doi").alias("matched_doi"), F.col("br").alias("meta_id"), "query_type")


def unmatched(report: DataFrame, refs: DataFrame) -> DataFrame:
    """The unmatched table with its 16 columns; scores that a pass did not give read ``N/A``."""
    scores = {"best_score": "best_score", "score_original": "score_original", "score_enriched": "score_after_grobid", "score_without_year": "score_without_year"}
    x = report.select("ref_id", *[F.coalesce(F.col(c).cast("string"), F.lit(NA)).alias(n) for c, n in scores.items()], F.col("enrichment_attempted").alias("grobid_attempted"), "threshold_failed").join(refs, "ref_id")
    return x.select(*[(F.col("ref_id") if c == "reference_id" else F.col(c) if c in x.columns else F.lit("")).alias(c) for c in UNMATCHED_COLUMNS])


def write_csv(df: DataFrame, path: str, by: str | None = None, order: str | None = None) -> None:
    """CSV with header, one folder per ``by``; rows of a folder in ``order``."""
    if by:
        df = df.repartition(by)
    if order:
        df = df.sortWithinPartitions(*([by] if by else []), order)
    w = df.write.mode("overwrite").option("header", True).option("escape", '"')
    (w.partitionBy(by) if by else w).csv(path)


def chunked(df: DataFrame, order: str, size: int, buckets: int = 64) -> DataFrame:
    """Adds ``chunk``, numbered from 0 in ``order``: rows are counted within ranges, ranges added up before."""
    r = df.repartitionByRange(buckets, order).withColumn("__part", F.spark_partition_id())
    counts = r.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    base = counts.select("__part", F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(1)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    out = r.withColumn("__nth", nth).join(F.broadcast(base), "__part")  # one row a range, at most ``buckets``
    return out.withColumn("chunk", F.floor((F.col("__base") + F.col("__nth") - 1) / size)).drop("__part", "__nth", "__base")


def write_chunks(df: DataFrame, column: str, path: str, size: int = 100) -> None:
    """Text files of at most ``size`` lines, line breaks within a line as blanks; no empty file is left."""
    df.select(F.regexp_replace(column, r"[\r\n]", " ").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", size).text(path)


def output_problems(outputs: DataFrame, least_csv: int = 100, least_stats: int = 500) -> DataFrame:
    """(source_file, reason) of files whose outputs are missing or too small to be whole.

    ``outputs`` has source_file, csv_bytes and stats_bytes, null where a file is missing.
    """
    c, s = F.col("csv_bytes"), F.col("stats_bytes")
    reason = F.when(c.isNull(), "CSV missing").when(c < least_csv, "CSV empty").when(s.isNull(), "Stats missing").when(s < least_stats, "Stats too small")
    return outputs.withColumn("reason", reason).where("reason is not null").select("source_file", "reason")


def failed_files(problems: DataFrame) -> DataFrame:
    """(line): the report of failed files, its lines in the order of names; one row a line, so of any length."""
    lines = problems.select(F.lit(1).alias("at"), F.concat("source_file", F.lit(": "), "reason").alias("line"))
    head = problems.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("at"), F.concat(F.lit("Files that failed validation: "), F.col("n").cast("string")).alias("line"))
    return head.unionByName(lines).orderBy("at", "line").select("line")
