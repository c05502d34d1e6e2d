"""Command line: ``match`` links citing files to a graph, ``check-doi``, ``compare`` and ``metrics`` evaluate."""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import report
from .config import MatchConfig
from .operators import evaluate, graph, resolve, stats
from .operators import strategies as S
from .session import store
from .sources import evaluation, files, sinks

log = logging.getLogger("biblioforge")


def config(path: str | None, **over) -> MatchConfig:
    """Settings from a JSON file, if there is one, then from the command line."""
    given = json.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    known = MatchConfig.__dataclass_fields__
    if unknown := set(given) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    if "title_bands" in given:
        given["title_bands"] = tuple(map(tuple, given["title_bands"]))
    return replace(MatchConfig(), **given, **{k: v for k, v in over.items() if v is not None})


def candidates_of(spark: SparkSession, path: str) -> DataFrame:
    """The graph's wide candidate table, from a table of triples (s, p, o) or from a wide one."""
    g = spark.read.parquet(path)
    return graph.candidates(g) if {"s", "p", "o"} <= set(g.columns) else g


def references_of(spark: SparkSession, path: str, tei: bool) -> tuple[DataFrame, DataFrame]:
    """(references with ids unique over all files, failed files)."""
    if tei:
        refs = files.tei_references(spark, path).withColumn("source_file", F.lit(Path(path).name))
        return refs.withColumn("ref_id", F.concat_ws("#", "source_file", "ref_id")), spark.createDataFrame([], "source_file string, reason string")
    docs = store(files.crossref_documents(spark, path))
    return files.crossref_references(docs).withColumn("ref_id", F.concat_ws("#", "source_file", "ref_id")), files.failed_documents(docs)


def match(spark: SparkSession, a: argparse.Namespace) -> None:
    cfg = config(a.config, threshold=a.threshold, use_doi=a.use_doi)
    refs, failed = references_of(spark, a.input, a.tei)
    out = Path(a.output)
    done = out / "matches"
    if a.skip_existing and done.exists():
        have = spark.read.option("header", True).csv(str(done))
        refs = refs.join(have.select("source_file").distinct(), "source_file", "left_anti") if "source_file" in have.columns else refs
    refs = store(refs)
    kg = store(candidates_of(spark, a.graph))
    if a.use_parser:
        won, left = resolve.cascade(refs, kg, cfg, fuzzy_titles=not a.exact_titles)
    else:
        won = resolve.accepted(resolve.best(S.prepare(refs, cfg), kg, cfg, not a.exact_titles), cfg)
        left = None
    won = store(won)
    mode = "append" if a.skip_existing else "overwrite"
    table = sinks.matches(won).join(won.select(F.col("ref_id").alias("reference_id"), "source_file"), "reference_id")
    table.repartition("source_file").sortWithinPartitions("reference_id").write.mode(mode).option("header", True).option("escape", '"').partitionBy("source_file").csv(str(done))
    if left is not None:
        sinks.write_csv(sinks.unmatched(left, refs), str(out / "unmatched"))
    sinks.failed_files(failed).coalesce(1).write.mode("overwrite").text(str(out / "failed_files"))
    prep = S.prepare(refs, cfg)
    parts = (stats.coverage(prep), stats.rates(prep, won), stats.distribution(won), stats.contribution(won), resolve.pass_counts(refs, won, left) if left is not None else None)
    (out / "aggregate_stats.txt").write_text(report.text(*parts), encoding="utf-8")
    (out / "report.html").write_text(report.page("Matching report", report.facts(*parts)), encoding="utf-8")
    log.info("%s matches of %s references", won.count(), refs.count())


def check_doi(spark: SparkSession, a: argparse.Namespace) -> None:
    """Which cited DOIs the graph knows; properties come from a table (doi, p, o) or from triples."""
    g = spark.read.parquet(a.graph)
    if {"s", "p", "o"} <= set(g.columns):
        ids = graph.identifiers(g).select("br", F.lower("doi").alias("doi"))
        g = ids.join(graph.properties(g, ids), "br").select("doi", "p", "o")
    g, dois = store(g), store(evaluation.cited_dois(spark, a.input))
    found, missing = evaluation.looked_up(dois, g)
    predicates = [r[0] for r in g.select("p").distinct().orderBy("p").limit(10_000).collect()]  # a graph has few predicates
    for name, df in (("doi_results", evaluation.sorted_by_place(evaluation.doi_results(found, g, predicates))), ("unmatched_dois", evaluation.sorted_by_place(evaluation.unmatched_dois(missing))), ("statistics", evaluation.statistics(dois, found).orderBy("base", "at").drop("at"))):
        df.write.mode("overwrite").option("header", True).option("escape", '"').partitionBy("base").csv(f"{a.output}/{name}")


def _table(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """(base, reference_id, doi, ordinal) of a folder of CSV files by base; the first of the DOI columns that is there."""
    t = files.table_csv(spark, path)
    doi, ref = files.first_column(t, *names), files.first_column(t, "reference_id", "ref_id", "id")
    base = F.regexp_replace(F.coalesce(*[F.col(c) for c in ("base", "source_file") if c in t.columns], F.lit("")), r"\.json$", "")
    t = t.select(base.alias("base"), (F.col(ref) if ref else F.lit("")).alias("reference_id"), (F.col(doi) if doi else F.lit("")).alias("doi"))
    return t.withColumn("ordinal", F.monotonically_increasing_id())


def compare(spark: SparkSession, a: argparse.Namespace) -> None:
    gold, pred = _table(spark, f"{a.input}/doi_results", "DOI"), _table(spark, a.matches, "matched_doi", "doi")
    evaluation.compared(gold, pred).coalesce(1).write.mode("overwrite").json(a.output)


def metrics(spark: SparkSession, a: argparse.Namespace) -> None:
    norm = lambda d: d.withColumn("doi", evaluation.N.norm_doi_eval(F.col("doi"))).where("doi <> ''")
    pos, neg = norm(_table(spark, f"{a.input}/doi_results", "DOI")), norm(_table(spark, f"{a.input}/unmatched_dois", "DOI"))
    m = evaluate.metrics(evaluate.confusion(pos, neg, norm(_table(spark, a.matches, "matched_doi", "doi"))))
    rows = F.array(*[F.struct(F.lit(n).alias("Metric"), F.col(c).cast("string").alias("Value")) for n, c in (("True positives", "tp"), ("False positives", "fp"), ("False negatives", "fn"), ("True negatives", "tn"), ("Precision", "precision"), ("Recall", "recall"), ("F1", "f1"), ("Accuracy", "accuracy"))])
    m.select(F.explode(rows).alias("r")).select("r.*").coalesce(1).write.mode("overwrite").option("header", True).csv(a.output)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="biblioforge", description=__doc__, formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    p.add_argument("--log-level", choices=["DEBUG", "INFO", "WARNING", "ERROR"], default="INFO", help="level of the log")
    sub = p.add_subparsers(dest="verb", required=True)
    m = sub.add_parser("match", help="match references to the graph", formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    m.add_argument("--tei", action="store_true", help="the input is TEI XML, not JSON")
    m.add_argument("--threshold", type=int, help="score from which the first candidate wins (26 by default)")
    m.add_argument("--use-parser", action="store_true", help="parse raw citations of unmatched references and try again")
    m.add_argument("--no-doi", dest="use_doi", action="store_false", default=None, help="don't search by DOI")
    m.add_argument("--exact-titles", action="store_true", help="no fuzzy comparison of titles")
    m.add_argument("--skip-existing", action="store_true", help="leave out files that have matches already")
    m.add_argument("--config", help="JSON file of settings")
    c = sub.add_parser("check-doi", help="look cited DOIs up in the graph")
    for s in (m, c):
        s.add_argument("--graph", required=True, help="parquet table of triples, of candidates or of properties")
    for s, f, does in ((m, match, "citing files"), (c, check_doi, "citing files"), (sub.add_parser("compare", help="missed and earned matches"), compare, "output of check-doi"), (sub.add_parser("metrics", help="precision and recall"), metrics, "output of check-doi")):
        s.add_argument("input", help=f"folder of {does}")
        s.add_argument("--output", required=True, help="folder to write")
        s.set_defaults(run=f)
        if f in (compare, metrics):
            s.add_argument("--matches", required=True, help="folder of matches")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=a.log_level, format="%(asctime)s %(levelname)s %(message)s")
    Path(a.output).parent.mkdir(parents=True, exist_ok=True)
    if not Path(a.input).exists() and "://" not in a.input:
        log.error("no such input: %s", a.input)
        return 2
    try:
        a.run(spark or SparkSession.builder.appName("biblioforge").getOrCreate(), a)
    except ValueError as e:
        log.error("%s", e)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
