"""Graph patterns over triples: joins for basic patterns, left joins for optional ones, a wide candidate table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DOI_SCHEME, P
from ..session import store


def pattern(triples: DataFrame, predicate: str, s: str, o: str, value: str | None = None) -> DataFrame:
    """One triple pattern with variables ``s`` and ``o``; ``value`` fixes the object. Predicates prune partitions."""
    t = triples.where(F.col("p") == predicate)
    if value is not None:
        return t.where(F.col("o") == value).select(F.col("s").alias(s))
    return t.select(F.col("s").alias(s), F.col("o").alias(o))


def bgp(*patterns: DataFrame, how: str = "inner") -> DataFrame:
    """Join of patterns on the variables they share."""
    out = patterns[0]
    for p in patterns[1:]:
        out = out.join(p, [c for c in p.columns if c in out.columns], how)
    return out


def identifiers(triples: DataFrame) -> DataFrame:
    """(br, doi): identifiers whose scheme is DOI."""
    return bgp(pattern(triples, P["identifier"], "br", "id"), pattern(triples, P["scheme"], "id", "", DOI_SCHEME), pattern(triples, P["value"], "id", "doi")).select("br", "doi")


def authors(triples: DataFrame) -> DataFrame:
    return bgp(pattern(triples, P["role"], "br", "ar"), pattern(triples, P["held"], "ar", "ra"), pattern(triples, P["family"], "ra", "author_name")).select("br", "author_name")


def volumes(triples: DataFrame) -> DataFrame:
    return bgp(pattern(triples, P["part"], "br", "issue"), pattern(triples, P["part"], "issue", "vol"), pattern(triples, P["sequence"], "vol", "volume_num")).select("br", "volume_num")


def pages(triples: DataFrame) -> DataFrame:
    """Optional pages inside an embodiment: a left join of left joins."""
    e = pattern(triples, P["embodiment"], "br", "re")
    return bgp(e, pattern(triples, P["start"], "re", "start_page"), pattern(triples, P["end"], "re", "end_page"), how="left").select("br", "start_page", "end_page")


def candidates(triples: DataFrame) -> DataFrame:
    """The wide table all strategies read: every optional block joined to the titles and dates, distinct.

    The triples in use are stored once, in the order of their predicates, so that each pattern reads its own only.
    """
    triples = store(triples.where(F.col("p").isin(*P.values())).sortWithinPartitions("p"))
    brs = triples.where(F.col("p").isin(P["title"], P["date"], P["identifier"])).select(F.col("s").alias("br")).distinct()
    out = bgp(brs, pattern(triples, P["title"], "br", "title"), pattern(triples, P["date"], "br", "pub_date"), identifiers(triples), authors(triples), volumes(triples), pages(triples), how="left")
    return out.select("br", "title", "pub_date", "doi", "author_name", "volume_num", "start_page", "end_page").distinct()


def properties(triples: DataFrame, brs: DataFrame) -> DataFrame:
    """(br, p, o) of the resources given: a pattern with an open predicate."""
    return triples.join(brs.select(F.col("br").alias("s")).distinct(), "s", "left_semi").select(F.col("s").alias("br"), "p", "o")


def to_triples(kg: DataFrame) -> DataFrame:
    """A wide table as triples with the graph's vocabulary; nulls give no triple."""
    t = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    br = F.col("br")
    sub = lambda x: F.concat(F.lit(f"{x}/"), br)
    rows = F.array(
        t(br, P["title"], F.col("title")), t(br, P["date"], F.col("pub_date")), t(br, P["identifier"], sub("id")), t(sub("id"), P["scheme"], F.lit(DOI_SCHEME)), t(sub("id"), P["value"], F.col("doi")),
        t(br, P["role"], sub("ar")), t(sub("ar"), P["held"], sub("ra")), t(sub("ra"), P["family"], F.col("author_name")),
        t(br, P["part"], sub("issue")), t(sub("issue"), P["part"], sub("vol")), t(sub("vol"), P["sequence"], F.col("volume_num")),
        t(br, P["embodiment"], sub("re")), t(sub("re"), P["start"], F.col("start_page")), t(sub("re"), P["end"], F.col("end_page")),
    )
    return kg.select(F.explode(rows).alias("t")).select("t.*").where("o is not null").distinct()
