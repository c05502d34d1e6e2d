"""Registered queries of the core and their SQL; the reference's operators are added by ``plans``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import nested
from .plans import matching
from .session import spread, table


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "crossref_doc").select("raw_id", "payload"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten(_payloads(spark, sf_dir), "ids")


def p4_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten(_payloads(spark, sf_dir), "documents")


def p4_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten(_payloads(spark, sf_dir), "references")


def p4_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten(_payloads(spark, sf_dir), "authors")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p4_found": p4_found,
    "p4_documents": p4_documents,
    "p4_references": p4_references,
    "p4_authors": p4_authors,
    **matching.QUERIES,
}

_P4_DOCS = """
with t as (select raw_id, regexp_replace(trim(payload), '^\\x{FEFF}', '') as p from crossref_doc),
v as (select raw_id, case when json_valid(p) then
        case when json_type(p::json) = 'VARCHAR' then (p::json ->> '$') when json_type(p::json) = 'ARRAY' and json_array_length(p::json) = 1 then (p::json -> 0)::varchar else p end end as q from t),
d as (select raw_id, q::json as j from v where q is not null and json_valid(q) and json_type(q::json) = 'OBJECT'),
m as (select raw_id, j -> 'message' as m from d where json_type(j -> 'message') = 'OBJECT'),
r as (select raw_id, unnest(case json_type(m -> 'reference') when 'ARRAY' then (m -> 'reference')::json[] when 'OBJECT' then [m -> 'reference'] else []::json[] end) as ref,
        generate_subscripts(case json_type(m -> 'reference') when 'ARRAY' then (m -> 'reference')::json[] when 'OBJECT' then [m -> 'reference'] else []::json[] end, 1) as ref_index from m)
"""

_BLANKS = "' ' || chr(9) || chr(13) || chr(10) || chr(160) || chr(8203) || chr(65279) || chr(12288)"


def _first_usable(x: str, *names: str) -> str:
    """SQL of the first member that is not blank, an array's first element in its place."""
    out = "case"
    for n in names:
        e = f"(case json_type({x} -> '{n}') when 'ARRAY' then {x} -> '{n}' -> 0 else {x} -> '{n}' end)"
        out += f" when case json_type({e}) when 'VARCHAR' then trim({e} ->> '$', {_BLANKS}) <> '' when 'OBJECT' then ({e})::varchar <> '{{}}' when 'ARRAY' then ({e})::varchar <> '[]' when 'NULL' then false else {e} is not null end"
        out += f" then case when json_type({e}) in ('OBJECT', 'ARRAY') then null else {e} ->> '$' end"
    return out + " end"


_P4_AUTHORS = """, k as (select * from r where json_type(ref) <> 'NULL'),
l as (select raw_id, ref_index, case json_type(ref -> 'author') when 'ARRAY' then (ref -> 'author')::json[] when 'OBJECT' then [ref -> 'author'] when 'VARCHAR' then [ref -> 'author'] else []::json[] end as a from k),
e as (select raw_id, ref_index, unnest(a) as x, generate_subscripts(a, 1) as author_index from l),
f as (select raw_id, ref_index, author_index, x from e where case json_type(x) when 'VARCHAR' then trim(x ->> '$') <> '' when 'OBJECT' then trim(coalesce(x ->> 'family', x ->> 'family-name', x ->> 'name', x ->> 'given', '')) <> '' else false end)"""

ORACLES: dict[str, str] = {
    "p4_found": _P4_DOCS
    + _P4_AUTHORS
    + """ select raw_id, ref_index::int as ref_index, author_index::int as author_index from f
union all select raw_id, ref_index::int, 0 from k where (raw_id, ref_index) not in (select (raw_id, ref_index) from f)""",
    "p4_authors": _P4_DOCS
    + _P4_AUTHORS
    + f""" select raw_id, ref_index::int as ref_index, author_index::int as author_index, case json_type(x) when 'VARCHAR' then x ->> '$' else {_first_usable('x', 'family', 'family-name', 'name')} end as family,
case when json_type(x) = 'OBJECT' then x ->> 'given' end as given from f
union all select raw_id, ref_index::int, 0, null, null from k where (raw_id, ref_index) not in (select (raw_id, ref_index) from f)""",
    "p4_references": _P4_DOCS
    + f""" select raw_id, ref_index::int as ref_index, {_first_usable('ref', 'key')} as ref_key, {_first_usable('ref', 'DOI')} as doi, {_first_usable('ref', 'article-title', 'title')} as article_title, {_first_usable('ref', 'year')} as year,
{_first_usable('ref', 'volume')} as volume, {_first_usable('ref', 'first-page', 'page')} as first_page, {_first_usable('ref', 'unstructured')} as unstructured from r where json_type(ref) <> 'NULL'""",
    "p4_documents": _P4_DOCS
    + """ select m.raw_id, m ->> 'DOI' as doc_doi, case json_type(m -> 'title') when 'ARRAY' then m -> 'title' ->> 0 else m ->> 'title' end as doc_title,
coalesce(c, 0)::int as n_references from m left join (select raw_id, count(*) as c from r where json_type(ref) <> 'NULL' group by 1) n on n.raw_id = m.raw_id""",
}
ORACLES |= matching.ORACLES
