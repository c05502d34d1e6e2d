"""References and a graph derived from the order tables, in DataFrames and in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import merged, table


def kg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bibliographic resource per order."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    text = lambda x: x.cast("string")
    return merged(merged(o, c, F.col("o_custkey") == F.col("c_custkey")), p, F.col("p_partkey") == k % 200).select(
        F.concat(F.lit("br/"), text(k)).alias("br"), k.alias("k"),
        F.concat("p_name", F.lit(" "), F.lower("p_type"), F.lit(" series "), text(k % 50)).alias("title"),
        F.substring(text(F.col("o_orderdate")), 1, 10).alias("pub_date"),
        F.concat(F.lit("10."), text(1000 + k % 9), F.lit("/"), text(k)).alias("doi"),
        F.col("c_name").alias("author_name"), text(k % 40).alias("volume_num"), text(k % 97 + 1).alias("start_page"), text(k % 97 + 10).alias("end_page"),
    )


def refs(graph: DataFrame) -> DataFrame:
    """Every fifth resource is cited, with deterministic damage."""
    k, w = F.col("k"), F.when
    year = F.substring("pub_date", 1, 4)
    return graph.where(k % 5 == 0).select(
        F.concat(F.lit("ref_"), k.cast("string")).alias("ref_id"), F.concat(F.lit("file_"), (k % 12).cast("string")).alias("source_file"), "k",
        w(k % 13 == 0, "").when(k % 11 == 0, (year.cast("int") + 1).cast("string")).otherwise(year).alias("year"),
        w(k % 10 == 0, "").otherwise(F.col("volume_num")).alias("volume"),
        w(k % 15 == 0, "").when(k % 45 == 5, F.concat(F.lit("00"), F.col("start_page"))).otherwise(F.col("start_page")).alias("first_page"),
        w(k % 6 == 0, F.lower("author_name")).when(k % 35 == 0, "").otherwise(F.col("author_name")).alias("first_author_lastname"),
        w(k % 23 == 0, F.concat(F.lit("Unrelated heading "), k.cast("string"))).when(k % 4 == 0, "").when(k % 17 == 0, F.upper("title")).otherwise(F.col("title")).alias("article_title"),
        w(k % 12 == 0, F.col("title")).otherwise("").alias("volume_title"), w((k % 23 == 0) | (k % 8 == 0), F.col("title")).otherwise("").alias("journal_title"),
        w(k % 3 == 0, "").when(k % 7 == 0, F.concat(F.lit("https://doi.org/"), F.upper("doi"))).otherwise(F.col("doi")).alias("doi"),
        w(k % 2 == 0, F.concat(F.lit("Roe, “"), "title", F.lit("”, "), year, F.lit(", "), "start_page", F.lit("–"), "end_page", F.lit(". doi:"), "doi")).when(k % 9 == 0, "Roe, without anything else").otherwise("").alias("unstructured"),
    )


KG_SQL = """kg as (select 'br/' || o_orderkey as br, o_orderkey as k, p_name || ' ' || lower(p_type) || ' series ' || (o_orderkey % 50) as title,
  substring(cast(o_orderdate as varchar), 1, 10) as pub_date, '10.' || (1000 + o_orderkey % 9) || '/' || o_orderkey as doi, c_name as author_name,
  cast(o_orderkey % 40 as varchar) as volume_num, cast(o_orderkey % 97 + 1 as varchar) as start_page, cast(o_orderkey % 97 + 10 as varchar) as end_page
  from orders join customer on o_custkey = c_custkey join part on p_partkey = o_orderkey % 200)"""

REFS_SQL = """refs as (select 'ref_' || k as ref_id, 'file_' || (k % 12) as source_file, k,
  case when k % 13 = 0 then '' when k % 11 = 0 then cast(cast(substring(pub_date, 1, 4) as int) + 1 as varchar) else substring(pub_date, 1, 4) end as year,
  case when k % 10 = 0 then '' else volume_num end as volume,
  case when k % 15 = 0 then '' when k % 45 = 5 then '00' || start_page else start_page end as first_page,
  case when k % 6 = 0 then lower(author_name) when k % 35 = 0 then '' else author_name end as first_author_lastname,
  case when k % 23 = 0 then 'Unrelated heading ' || k when k % 4 = 0 then '' when k % 17 = 0 then upper(title) else title end as article_title,
  case when k % 12 = 0 then title else '' end as volume_title, case when k % 23 = 0 or k % 8 = 0 then title else '' end as journal_title,
  case when k % 3 = 0 then '' when k % 7 = 0 then 'https://doi.org/' || upper(doi) else doi end as doi,
  case when k % 2 = 0 then 'Roe, “' || title || '”, ' || substring(pub_date, 1, 4) || ', ' || start_page || '–' || end_page || '. doi:' || doi when k % 9 = 0 then 'Roe, without anything else' else '' end as unstructured
  from kg where k % 5 = 0)"""

_NT = r"trim(regexp_replace(regexp_replace(regexp_replace(trim(lower({})), '[.!?;:]+$', ''), '[^a-z0-9\s-]', '', 'g'), '\s+', ' ', 'g'))"  # of ASCII
PREP_SQL = rf"""main as (select *, case when article_title <> '' then article_title when volume_title <> '' then volume_title else journal_title end as m from refs),
prep as (select ref_id, source_file, k, year as raw_year,
  case when try_cast(year as int) between 1700 and 2027 then try_cast(year as int) end as r_year, volume as r_volume, first_page as r_page, first_author_lastname as r_author, m as r_title,
  replace(regexp_replace(lower(trim(doi)), '^(doi:|https?://(dx\.)?doi\.org/)', ''), '\/', '/') as r_doi,
  {_NT.format('article_title')} as nt_article, {_NT.format('volume_title')} as nt_volume, {_NT.format('journal_title')} as nt_journal,
  array_to_string(list_filter(string_split(m, ' ')[1:4], lambda w: length(w) > 3), '.*') as r_pattern from main)"""


def _strategy_sql(prio: int, name: str, where: str) -> str:
    return f"""select distinct r.*, c.br, c.title, c.pub_date, c.doi, c.author_name, c.volume_num, c.start_page, c.end_page, {prio} as prio, '{name}' as query_type from prep r join kg c on {where}"""


_YEAR = "abs(r_year - cast(substring(pub_date, 1, 4) as int)) <= 1"
_REGEX = "(r_pattern = '' or regexp_matches(title, r_pattern, 'i'))"
STRATEGY_SQL = {
    "year_and_doi": _strategy_sql(1, "year_and_doi", f"r_doi <> '' and r_doi = doi and {_YEAR}"),
    "doi_title": _strategy_sql(2, "doi_title", f"r_doi <> '' and r_title <> '' and r_doi = doi and {_REGEX}"),
    "author_title": _strategy_sql(3, "author_title", f"r_author <> '' and r_title <> '' and r_author = author_name and {_REGEX}"),
    "year_author_page": _strategy_sql(4, "year_author_page", f"r_author <> '' and r_page <> '' and r_author = author_name and {_YEAR} and (start_page = r_page or contains(start_page, r_page || '-') or contains(start_page, '-' || r_page))"),
    "year_volume_page": _strategy_sql(5, "year_volume_page", f"r_volume <> '' and r_page <> '' and r_volume = volume_num and r_page = start_page and {_YEAR}"),
    "year_author_volume": _strategy_sql(6, "year_author_volume", f"r_author <> '' and r_volume <> '' and r_author = author_name and r_volume = volume_num and {_YEAR}"),
}
SCORED_SQL = f"""cands as ({' union all '.join(STRATEGY_SQL.values())}),
parts as (select *, case when r_doi <> '' and r_doi = lower(trim(doi)) then 15 else 0 end as c_doi, case when r_author <> '' and lower(trim(r_author)) = lower(trim(author_name)) then 7 else 0 end as c_author,
  case when r_year = cast(substring(pub_date, 1, 4) as int) then 1 else 0 end as c_year, case when r_volume <> '' and r_volume = volume_num then 3 else 0 end as c_volume,
  case when r_page <> '' and ltrim(r_page, '0') = ltrim(start_page, '0') then 8 else 0 end as c_page,
  case when {_NT.format('title')} <> '' and {_NT.format('title')} in (nt_article, nt_volume, nt_journal) then 14 else 0 end as c_title from cands),
scored as (select *, c_doi + c_author + c_year + c_volume + c_page + c_title as score, case when c_title = 14 then 100 else 0 end as title_sim from parts)"""
WON_SQL = """best as (select *, row_number() over (partition by ref_id order by case when score >= 26 then 0 else 1 end, case when score >= 26 then 0 else -score end, prio, br) as rn from scored where score > 0),
won as (select * exclude (rn) from best where rn = 1), acc as (select * from won where score >= 26 * 0.9)"""


def again(sql: str, suffix: str) -> str:
    """The same steps over ``refs<suffix>``."""
    return re.sub(r"\b(refs|main|prep|cands|parts|scored|best|won|acc)\b", rf"\g<1>{suffix}", sql)


#: The second pass over what the first left, its empty fields read out of raw citations; the third without years.
CASCADE_SQL = rf"""rest as (select * from refs where ref_id not in (select ref_id from acc)),
found as (select *, unstructured <> '' as asked, regexp_extract(unstructured, '(10\.\d{{4,9}}/[^\s"<>]+?)[.,;)]*(?:\s|$)', 1) as f_doi, regexp_extract(unstructured, '\b((?:17|18|19|20)\d{{2}})\b', 1) as f_year,
  regexp_extract(unstructured, '^(?:\[\d+\]\s*)?([\p{{L}}''’ -]+?)(?:,| et al| &|:|\.| \(| \d)', 1) as f_author, regexp_extract(unstructured, '[“"‘](.+?)[,.]?[”"’]', 1) as f_title from rest),
merged as (select * exclude (f_doi, f_year, f_author, f_title) replace (case when doi = '' then f_doi else doi end as doi, case when year = '' then f_year else year end as year,
  case when first_author_lastname = '' then f_author else first_author_lastname end as first_author_lastname, case when article_title = '' then f_title else article_title end as article_title) from found),
refs2 as (select * from merged where asked)"""


BASE_SQL = f"with {KG_SQL}, {REFS_SQL}, {PREP_SQL}"
ALL_SQL = f"{BASE_SQL}, {SCORED_SQL}, {WON_SQL}"
_PASS = f"{PREP_SQL}, {SCORED_SQL}, {WON_SQL}"
ALL_PASSES_SQL = f"{ALL_SQL}, {CASCADE_SQL}, {again(_PASS, '2')}, refs3 as (select * replace ('' as year) from merged where year <> '' and ref_id not in (select ref_id from acc2)), {again(_PASS, '3')}"
