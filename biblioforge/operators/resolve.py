"""The winner of each reference, acceptance and the cascade of passes, by hash aggregates where pairs arise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..session import merged, store
from . import enrich, scoring, strategies

ORDER = strategies.ORDER


def winners(scored: DataFrame, cfg: MatchConfig = MatchConfig(), early_stop: bool = True) -> DataFrame:
    """One candidate a reference: the first at the threshold, else the first of the highest score above 0.

    Spark limits the groups before they are shuffled, so a reference with very many candidates sends few.
    """
    late = F.col("score") < cfg.threshold if early_stop else F.lit(True)
    order = [late, F.when(late, -F.col("score")).otherwise(0), F.col("prio"), *[F.coalesce(F.col(c), F.lit("")) for c in ORDER[1:]]]
    nth = F.row_number().over(Window.partitionBy("ref_id").orderBy(*order))
    return scored.where("score > 0").withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def best(refs: DataFrame, kg: DataFrame, cfg: MatchConfig = MatchConfig(), fuzzy_titles: bool = False, early_stop: bool = True) -> DataFrame:
    """``winners`` of all scored candidates of prepared references, of which only the winners are built up.

    Each pair becomes one number, in the order of its reference's candidates: points below the threshold, priority,
    place of the candidate. The least of them per reference is found by hash aggregates where the pairs arise.
    ``kg`` may be ordered already.
    """
    r, c = strategies.numbered(refs), kg if "cid" in kg.columns else strategies.ordered(kg)
    x = scoring.score(strategies.all_pairs(r, c, cfg), cfg)
    if fuzzy_titles:
        x = scoring.score(_wide(_open(x, cfg, early_stop), r, c, cfg), cfg, fuzzy_titles)
    n = c.agg(F.coalesce(F.max("cid") + 1, F.lit(1))).first()[0]
    prios, most = len(strategies.STRATEGIES) + 2, cfg.max_score + _title(cfg) + 1
    if n * prios * most >= 1 << 63:
        raise OverflowError(f"{n} places of candidates are too many for one number")
    late = F.when(F.col("score") < cfg.threshold, most - F.col("score")).otherwise(0) if early_stop else most - F.col("score")
    place = (late * prios + F.col("prio")).cast("bigint") * n + F.col("cid")
    least = x.where("score > 0").groupBy("rid").agg(F.min(place).alias("__place"))
    code = F.expr(f"__place div {n}L")
    first = store(least.select("rid", (F.col("__place") % n).alias("cid"), (code % prios).cast("int").alias("prio")))
    return winners(scoring.score(_wide(first, r, c, cfg), cfg, fuzzy_titles), cfg, early_stop).drop("rid", "cid", *strategies.KEYS)


def _title(cfg: MatchConfig) -> int:
    """The most that a title gives."""
    return max(cfg.title_exact, *[n for _, n in cfg.title_bands])


def _wide(pairs: DataFrame, r: DataFrame, c: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Pairs by number (rid, cid, prio) with all columns, as their strategies see them."""
    numbered = [*enumerate(strategies.STRATEGIES, 1)]
    out = merged(merged(pairs, r, "rid"), c, "cid").withColumn("query_type", F.element_at(F.create_map(*[F.lit(x) for i, s in numbered for x in (i, s.name)]), F.col("prio")))
    if cfg.author_edge == "reference":
        seen = F.col("prio").isin([i for i, s in numbered if s.sees_author])
        out = out.withColumns({x: F.when(seen, F.col(x)) for x in ("author_name", "author_key")})
    return out


def _open(x: DataFrame, cfg: MatchConfig, early_stop: bool) -> DataFrame:
    """Of natively scored pairs those that may still win when titles are compared: (rid, cid, prio).

    Pairs of a reference with equal points, priority and title differ by their place only, so one stands for all.
    One that can't reach what another has for sure, nor the threshold, can't win, and none of a later priority
    than one that has the threshold for sure.
    """
    may = F.col("title").isNotNull() & (F.col("r_title") != "") & (F.col("c_title") == 0)
    x = x.groupBy("rid", "prio", "nt_title", F.col("score").alias("__sure"), may.alias("__may")).agg(F.min("cid").alias("cid"))
    most, sure, all_of = F.col("__sure") + F.when(F.col("__may"), _title(cfg)).otherwise(0), F.col("__sure"), Window.partitionBy("rid")
    x = x.withColumns({"__top": F.max(sure).over(all_of), "__stop": F.min(F.when(sure >= cfg.threshold, F.col("prio"))).over(all_of)})
    keep = most >= F.col("__top")
    if early_stop:
        keep = (keep | (most >= cfg.threshold)) & (F.col("__stop").isNull() | (F.col("prio") <= F.col("__stop")))
    return store(x.where(keep & (most > 0)).select("rid", "cid", "prio"))


def accepted(won: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Acceptance is at the threshold times its factor, in double precision."""
    return won.where(F.col("score") >= F.lit(cfg.accept))


def without_year(scored: DataFrame) -> DataFrame:
    """(ref_id, score_without_year): the pass with a blank year re-runs what needs none; only the year's points can go."""
    return scored.where(F.col("query_type").isin("doi_title", "author_title") & F.col("r_year").isNotNull()).groupBy("ref_id").agg(F.max(F.col("score") - F.col("c_year")).alias("score_without_year"))


def cascade(refs: DataFrame, kg: DataFrame, cfg: MatchConfig = MatchConfig(), parser: Callable[[DataFrame], DataFrame] = enrich.by_patterns, fuzzy_titles: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted winners with ``pass_no``, report of the references that no pass matched).

    Pass 1 takes the references as they are, pass 2 what is left with a raw citation, its empty fields filled by
    ``parser``, pass 3 what is still left, filled fields kept, without its year. Of the report's scores, that of
    pass 1 is 0 without any candidate, the others are null then; ``best_score`` is the highest above 0.
    """
    cands = strategies.ordered(kg)

    def run(x: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        won = store(best(strategies.prepare(x, cfg), cands, cfg, fuzzy_titles).withColumn("pass_no", F.lit(n)))
        return won, accepted(won, cfg)

    ids = lambda d: d.select("ref_id")
    first, got1 = run(refs, 1)
    filled = store(enrich.enrich(merged(refs, ids(got1), "ref_id", "left_anti"), parser))
    second, got2 = run(filled.where("unstructured <> ''"), 2)
    left = merged(filled, ids(got2), "ref_id", "left_anti")
    third, got3 = run(left.where("year <> ''").withColumn("year", F.lit("")), 3)
    report = merged(left, ids(got3), "ref_id", "left_anti").select("ref_id", "unstructured")
    for won, name in ((first, "score_original"), (second, "score_enriched"), (third, "score_without_year")):
        report = merged(report, won.select("ref_id", F.col("score").alias(name)), "ref_id", "left")
    report = report.withColumn("score_original", F.coalesce("score_original", F.lit(0)))
    highest = F.nullif(F.greatest("score_original", F.coalesce("score_enriched", F.lit(0)), F.coalesce("score_without_year", F.lit(0))), F.lit(0))
    report = report.withColumns({"best_score": highest, "enrichment_attempted": F.when(F.col("score_enriched").isNotNull(), "Yes").otherwise("No")}).withColumn("threshold_failed", F.when(F.col("best_score").isNotNull(), "Yes").otherwise("No"))
    return got1.unionByName(got2).unionByName(got3), report.drop("unstructured")


def pass_counts(refs: DataFrame, won: DataFrame, report: DataFrame) -> DataFrame:
    """One row: references, matches by pass, attempts of the second pass and how many of these matched."""
    tried = merged(refs.where("unstructured <> ''").select("ref_id"), won.where("pass_no = 1").select("ref_id"), "ref_id", "left_anti")
    named = lambda d, name: d.select(F.lit(name).alias("what"))
    x = named(refs, "n_references").unionByName(named(tried, "n_attempts")).unionByName(named(report, "n_unmatched")).unionByName(won.select(F.concat(F.lit("n_pass_"), "pass_no").alias("what")))
    count = lambda name, alias: F.count_if(F.col("what") == name).alias(alias)
    return x.agg(*[count(n, n) for n in ("n_references", "n_pass_1", "n_pass_2", "n_pass_3", "n_attempts", "n_unmatched")], count("n_pass_2", "n_successes"))


def merge_if_empty(original: DataFrame, enriched: DataFrame, fields: list[str]) -> DataFrame:
    """The original record with its empty fields filled from the enriched one."""
    e = enriched.select("ref_id", *[F.col(f).alias(f"e_{f}") for f in fields])
    return merged(original, e, "ref_id", "left").withColumns({f: F.coalesce(F.nullif(F.col(f), F.lit("")), F.col(f"e_{f}"), F.lit("")) for f in fields}).drop(*[f"e_{f}" for f in fields])
