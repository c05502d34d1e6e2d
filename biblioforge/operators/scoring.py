"""Points of a candidate, each component a column; the fuzzy title score only where it can matter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions import fuzzy
from ..session import merged, store
from .strategies import TITLES


def points(cfg: MatchConfig = MatchConfig()) -> dict[str, Column]:
    """Components but the title, of the forms that references and candidates are stored with."""
    hit = lambda cond, n: F.when(cond, n).otherwise(0)
    r, c = (lambda x: F.col(f"r_{x}")), F.col
    return {
        "c_doi": hit((r("doi") != "") & (r("doi_key") == c("doi_key")), cfg.doi),
        "c_author": hit((r("author") != "") & (r("author_key") == c("author_key")), cfg.author),
        "c_year": hit(r("year") == c("c_year"), cfg.year_exact),
        "c_volume": hit((r("volume") != "") & (r("volume") == c("volume_num")), cfg.volume),
        "c_page": hit((r("page") != "") & (r("page_key") == c("page_key")), cfg.page),
    }


def title_points(sim: Column, cfg: MatchConfig = MatchConfig()) -> Column:
    """Bands are strict: 95 itself falls to the next."""
    out = F.when(sim >= 100, cfg.title_exact)
    for least, n in cfg.title_bands:
        out = out.when(sim > least, n)
    return out.otherwise(0)


def score(cands: DataFrame, cfg: MatchConfig = MatchConfig(), fuzzy_titles: bool = False, exact_best: bool = True) -> DataFrame:
    """Adds the components and ``score``.

    The title's similarity is the best of the reference's three titles. With ``fuzzy_titles``, equal titles stay native and each different pair is compared once. Unless exact best
    scores of unmatched references are wanted, pairs that can't reach acceptance even with a full title are not
    compared at all.
    """
    parts = points(cfg)
    out = cands.withColumns(parts)
    base = sum((F.col(c) for c in parts), F.lit(0))
    titles = [F.col(f"nt_{t}") for t in TITLES]
    # titles of which nothing is left are equal to none
    exact = F.when(F.col("title").isNotNull() & (F.col("nt_title") != "") & reduce(lambda a, b: a | b, [t == F.col("nt_title") for t in titles]), 100)
    if not fuzzy_titles:
        out = out.withColumn("title_sim", F.coalesce(exact, F.lit(0)))
    else:
        need = exact.isNull() & (F.col("r_title") != "") & F.col("title").isNotNull()
        if not exact_best:
            need &= base + cfg.title_exact >= cfg.accept
        # Python functions run eagerly, so the pairs that need one are set apart and made distinct first
        own = F.explode(F.array_distinct(F.filter(F.array(*titles), lambda t: t != "")))
        pairs = out.where(need).select(own.alias("a"), F.col("nt_title").alias("b")).distinct()
        pairs = store(pairs.withColumn("sim", fuzzy.similarity_udf(F.col("a"), F.col("b"))))
        sims = []
        for t in TITLES:
            out = merged(out, pairs.select(F.col("a").alias(f"nt_{t}"), F.col("b").alias("nt_title"), F.col("sim").alias(f"sim_{t}")), [f"nt_{t}", "nt_title"], "left")
            sims.append(F.coalesce(F.col(f"sim_{t}"), F.lit(0)))
        out = out.withColumn("title_sim", F.coalesce(exact, F.when(need, F.greatest(*sims)), F.lit(0))).drop(*[f"sim_{t}" for t in TITLES])
    out = out.withColumn("c_title", title_points(F.col("title_sim"), cfg))
    return out.withColumn("score", (base + F.col("c_title")).cast("int"))
