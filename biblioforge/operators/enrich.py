"""Second pass: fields read out of raw citations by a parser that can be exchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions import native as N


def by_patterns(citations: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """The parser that needs no service: DOI, year, pages and author by native patterns."""
    u = F.col("unstructured")
    return citations.select(
        "ref_id", F.regexp_extract(u, r"(10\.\d{4,9}/[^\s\"<>]+?)[.,;)]*(?:\s|$)", 1).alias("doi"), F.coalesce(N.extract_year(F.regexp_extract(u, r"\b((?:17|18|19|20)\d{2})\b", 1), cfg).cast("string"), F.lit("")).alias("year"),
        F.regexp_extract(u, r"(?:\b(?:pp?|S)\.\s*|[:,]\s*)(e?\d+)\s*[-–—]\s*\d+", 1).alias("first_page"), F.regexp_extract(u, r"^(?:\[\d+\]\s*)?([\p{L}'’ -]+?)(?:,| et al| &|:|\.| \(| \d)", 1).alias("first_author_lastname"),
        F.regexp_extract(u, r"[“\"‘](.+?)[,.]?[”\"’]", 1).alias("article_title"),
    )


def enrich(refs: DataFrame, parser: Callable[[DataFrame], DataFrame] = by_patterns) -> DataFrame:
    """References whose empty fields are filled from what the parser finds in the raw citation; a given first page stays, a missing one too."""
    from .resolve import merge_if_empty

    found = parser(refs.where("unstructured <> ''").select("ref_id", N.citation_text(F.col("unstructured")).alias("unstructured")))
    return merge_if_empty(refs, found, [c for c in ("doi", "year", "first_author_lastname", "volume", "article_title") if c in found.columns])
