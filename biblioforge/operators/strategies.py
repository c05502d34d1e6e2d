"""Candidate generation: six strategies, each one equi-join with a residual condition, in order of priority.

Year windows are keys, not residuals: a reference stands in three rows, one per year allowed. References and
candidates are prepared and stored once, with what scores compare. Pairs can grow with the square of the data
(many resources share year, volume and page), so they are never shuffled or stored: joins bring the columns that
are asked for, and what reads the pairs sums them up where they arise. The strategy by author and title would meet
a hot author's rows all with all, so these are keyed by four letters of a title's word as well, which a matching
title must have.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions import fuzzy
from ..functions import native as N
from ..session import merged, store

HOT_AUTHOR = 10_000  # candidate rows from which an author's are keyed by letters of the title too
TITLES = ("article", "volume", "journal")
#: A total order on candidates: results don't depend on how rows arrive.
ORDER = ["prio", "br", "doi", "title", "author_name", "volume_num", "start_page", "end_page", "pub_date"]
KEYS = ["r_doi_key", "r_author_key", "r_page_key", "doi_key", "author_key", "page_key"]  # what scores compare
CANDIDATE = ["br", "title", "pub_date", "doi", "author_name", "volume_num", "start_page", "end_page"]


@dataclass(frozen=True)
class Strategy:
    name: str
    requires: tuple[str, ...]  # fields of the reference that must be there
    keys: tuple[tuple[str, str], ...]  # (reference's, candidate's) equal columns
    residual: Callable[[MatchConfig], Column] | None = None
    sees_author: bool = True  # under author_edge="reference" only author-led strategies do


_regex = lambda cfg: (F.col("r_pattern") == "") | F.rlike("title", F.concat(F.lit("(?i)"), F.col("r_pattern")))

STRATEGIES: list[Strategy] = [
    Strategy("year_and_doi", ("r_doi", "r_year"), (("r_doi", "doi"), ("year_key", "c_year")), sees_author=False),
    Strategy("doi_title", ("r_doi", "r_title"), (("r_doi", "doi"),), lambda cfg: _regex(cfg) & F.col("title").isNotNull(), sees_author=False),
    Strategy("author_title", ("r_title", "r_author"), (("r_author", "author_name"),), lambda cfg: _regex(cfg) & F.col("pub_date").isNotNull() & F.col("title").isNotNull()),
    Strategy("year_author_page", ("r_year", "r_author", "r_page"), (("r_author", "author_name"), ("year_key", "c_year")), lambda cfg: N.loose_page(F.col("start_page"), F.col("r_page"))),
    Strategy("year_volume_page", ("r_year", "r_volume", "r_page"), (("r_volume", "volume_num"), ("r_page", "start_page"), ("year_key", "c_year")), sees_author=False),
    Strategy("year_author_volume", ("r_year", "r_author", "r_volume"), (("r_author", "author_name"), ("r_volume", "volume_num"), ("year_key", "c_year"))),
]


def prepare(refs: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """References in comparable form, columns ``r_...`` and the three normalised titles; input columns are those of the Reference record.

    Text is composed (NFC); only values with combining marks leave the JVM for that. Repeated rows count once.
    """
    names = ["year", "volume", "first_page", "first_author_lastname", "article_title", "volume_title", "journal_title", "doi"]
    marked = lambda c: F.col(c).rlike(r"\p{M}")
    x = refs.select("ref_id", *[c for c in ("source_file", "ref_index") if c in refs.columns], *[F.coalesce(fuzzy.nfc(F.when(marked(c), F.col(c))), F.col(c)).alias(c) for c in names])
    f = {c: N.field(F.col(c)) for c in names}
    x = x.select(
        "ref_id", *[c for c in ("source_file", "ref_index") if c in refs.columns],
        N.extract_year(F.col("year"), cfg).alias("r_year"), f["volume"].alias("r_volume"), f["first_page"].alias("r_page"), f["first_author_lastname"].alias("r_author"),
        N.main_title(f["article_title"], f["volume_title"], f["journal_title"]).alias("r_title"), F.coalesce(N.norm_doi(F.col("doi")), F.lit("")).alias("r_doi"),
        *[N.norm_title(f[f"{t}_title"]).alias(f"nt_{t}") for t in TITLES],
    ).distinct()
    return x.withColumn("r_pattern", N.title_pattern(F.col("r_title"), cfg))


def numbered(refs: DataFrame) -> DataFrame:
    """Prepared references with a number ``rid`` and the forms that scores compare, stored."""
    keys = {"r_doi_key": F.lower(F.trim("r_doi")), "r_author_key": N.norm_author(F.col("r_author")), "r_page_key": N.page_key(F.col("r_page"))}
    return store(refs.withColumns(keys | {"rid": F.monotonically_increasing_id()}))


def ordered(kg: DataFrame) -> DataFrame:
    """Distinct candidates, stored, with the forms that scores compare and a number ``cid`` that follows ORDER: of equal points the lesser wins."""
    kg = kg.select(*CANDIDATE).distinct().sort(*[F.coalesce(c, F.lit("")) for c in ORDER[1:]])
    keys = {"c_year": F.substring("pub_date", 1, 4).try_cast("int"), "nt_title": N.norm_title(F.col("title")), "doi_key": F.lower(F.trim("doi")), "author_key": N.norm_author(F.col("author_name")), "page_key": N.page_key(F.col("start_page"))}
    at = F.monotonically_increasing_id()  # partition and row: rows of a partition follow each other
    x = store(kg.withColumns(keys | {"__part": F.shiftright(at, 33), "__row": at.bitwiseAND((1 << 33) - 1)}))
    n = x.agg(F.coalesce(F.max("__row") + 1, F.lit(1))).first()[0]
    return x.withColumn("cid", F.col("__part") * n + F.col("__row")).drop("__part", "__row")


def pairs(refs: DataFrame, cands: DataFrame, strategy: Strategy, cfg: MatchConfig) -> DataFrame:
    """Pairs of one strategy: all columns of both, prio, query_type. ``refs`` is numbered, ``cands`` ordered."""
    prio = [s.name for s in STRATEGIES].index(strategy.name) + 1 if strategy in STRATEGIES else len(STRATEGIES) + 1
    r, c = refs, cands
    for x in strategy.requires:
        r = r.where(F.col(x).isNotNull() if x == "r_year" else F.col(x) != "")
    if any(k == "year_key" for k, _ in strategy.keys):
        near = F.filter(F.array(F.col("r_year") - 1, F.col("r_year"), F.col("r_year") + 1), lambda y: y.between(cfg.min_year, cfg.max_year))
        r = r.withColumn("year_key", F.explode(near))
    if not strategy.sees_author and cfg.author_edge == "reference":
        c = c.withColumns({x: F.lit(None).cast("string") for x in ("author_name", "author_key")})
    if strategy.keys == (("r_author", "author_name"),) and cfg.regex_mode == "quoted":
        out = _by_author(r, c)
    else:
        out = merged(r, c, reduce(lambda a, b: a & b, [r[a] == c[b] for a, b in strategy.keys]))
    if strategy.residual is not None:
        out = out.where(strategy.residual(cfg))
    return out.select(*refs.columns, *cands.columns, F.lit(prio).alias("prio"), F.lit(strategy.name).alias("query_type"))


def all_pairs(refs: DataFrame, cands: DataFrame, cfg: MatchConfig, strategies: list[Strategy] | None = None) -> DataFrame:
    """Union of the strategies' pairs; those by DOI only where DOIs block."""
    use = [s for s in strategies or STRATEGIES if cfg.use_doi or "r_doi" not in s.requires]
    return reduce(DataFrame.unionByName, [pairs(refs, cands, s, cfg) for s in use])


def _by_author(r: DataFrame, c: DataFrame) -> DataFrame:
    """References and candidates of one author whose titles can match the reference's pattern.

    Rows of a hot author meet by four letters of the pattern's longest word, which stand in any title that
    matches, so none is lost; references without such a word match every title of their author, as the
    pattern demands.
    """
    hot = store(c.where("author_name is not null").groupBy("author_name").count().where(F.col("count") >= HOT_AUTHOR).select(F.col("author_name").alias("__hot")))
    if hot.isEmpty():
        return merged(r, c, r["r_author"] == c["author_name"])
    marked = lambda df, k: df.join(hot, df[k] == F.col("__hot"), "left")
    r, c = marked(r, "r_author"), marked(c, "author_name")
    bare = F.transform(F.split(F.lower("r_pattern"), r"\.\*"), lambda w: F.replace(w, F.lit("\\"), F.lit("")))
    word = F.element_at(F.array_sort(bare, lambda a, b: F.length(b) - F.length(a)), 1)
    r = r.withColumn("__gram", F.when(F.col("__hot").isNotNull() & (F.length(word) >= 4), F.substring(word, 1, 4)).otherwise(""))
    low, n = F.lower("title"), F.greatest(F.length("title") - 3, F.lit(0))
    grams = F.array_union(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(low, i, F.lit(4))))
    c = c.withColumn("__letters", F.explode(F.when(F.col("__hot").isNotNull(), grams).otherwise(F.array(F.lit("")))))
    return merged(r.drop("__hot"), c.drop("__hot"), (r["r_author"] == c["author_name"]) & (F.col("__gram") == F.col("__letters"))).drop("__gram", "__letters")


def generate(refs: DataFrame, kg: DataFrame, strategy: Strategy, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """(reference's columns, candidate's columns, prio, query_type) of one strategy, distinct. ``refs`` is prepared, ``kg`` is not."""
    return pairs(numbered(refs), ordered(kg), strategy, cfg).drop("rid", "cid")


def all_candidates(refs: DataFrame, kg: DataFrame, cfg: MatchConfig = MatchConfig(), strategies: list[Strategy] | None = None) -> DataFrame:
    """Union of the strategies; those by DOI only where DOIs block."""
    return all_pairs(numbered(refs), ordered(kg), cfg, strategies).drop("rid", "cid")
