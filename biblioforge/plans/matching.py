"""Registered queries of the matcher with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions import fuzzy
from ..functions import native as N
from ..operators import evaluate, graph, resolve, scoring, stats
from ..operators import strategies as S
from ..session import merged, store, table
from ..sources import evaluation, files
from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CFG = MatchConfig()
CAND = ", ".join(S.CANDIDATE)
_i = lambda *names: [F.col(n).cast("int").alias(n) for n in names]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _kg(spark, d):
    return X.kg(spark, d)


def _refs(spark, d):
    return X.refs(_kg(spark, d))


def _prep(spark, d):
    return S.prepare(_refs(spark, d), CFG)


def _both(spark, d):
    """(prepared references, candidates), the graph's tables read once."""
    g = store(_kg(spark, d))
    return S.prepare(store(X.refs(g)), CFG), g


def _scored(spark, d):
    return scoring.score(S.all_candidates(*_both(spark, d), CFG), CFG)


def _won(spark, d, **kw):
    return resolve.best(*_both(spark, d), CFG, **kw)


# ---- scalar functions


@query(rf"{X.BASE_SQL} select ref_id, r_doi as doi_norm from prep")
def norm_doi_matcher(spark, d):
    return _prep(spark, d).select("ref_id", F.col("r_doi").alias("doi_norm"))


@query(rf"""with {X.KG_SQL}, {X.REFS_SQL} select ref_id, trim(regexp_replace(regexp_replace(replace(lower(trim('doi:' || doi)), '\/', '/'), '^doi:', ''), '^https?://(dx\.)?doi\.org/', '')) as doi_norm from refs""")
def norm_doi_eval(spark, d):
    return _refs(spark, d).select("ref_id", N.norm_doi_eval(F.concat(F.lit("doi:"), "doi")).alias("doi_norm"))


#: All white space, as the functions have it.
_WHITE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(f"select ref_row_id, lower(trim(regexp_replace(first_author_lastname, '{_WHITE}', ' ', 'g'))) as author_norm from bib_reference")
def norm_author(spark, d):
    return table(spark, d, "bib_reference").select("ref_row_id", N.norm_author(F.col("first_author_lastname")).alias("author_norm"))


_YEAR_SQL = r"try_cast(nullif(regexp_extract({0}, '\b(17|18|19|20)\d{{2}}\b'), '') as int)"


@query(rf"""with y as (select ref_row_id, case when try_cast(trim(year) as int) is not null then try_cast(trim(year) as int) else {_YEAR_SQL.format('year')} end as year_value from bib_reference)
select ref_row_id, case when year_value between 1700 and 2027 then year_value end as year_value from y""")
def extract_year(spark, d):
    return table(spark, d, "bib_reference").select("ref_row_id", N.extract_year(F.col("year"), CFG).alias("year_value"))


@query("select ref_row_id, ltrim(first_page, '0') as page_key from bib_reference")
def page_key(spark, d):
    return table(spark, d, "bib_reference").select("ref_row_id", N.page_key(F.col("first_page")).alias("page_key"))


@query(f"{X.BASE_SQL} select ref_id, r_pattern from prep")
def title_pattern(spark, d):
    return _prep(spark, d).select("ref_id", "r_pattern")


def _title_sql(c: str) -> str:
    """norm_title in SQL, from the same tables."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    for a, b in N.TITLE_SIGNS + N.GREEK + N.ISOTOPES + N.SPELT:
        c = f"replace({c}, {q(a)}, {q(b)})"
    c = f"regexp_replace(translate({c}, {q(''.join(N.LETTERS))}, {q(''.join(N.LETTERS.values()))}), '\\p{{M}}', '', 'g')"
    c = f"regexp_replace({c}, '\\p{{Z}}', ' ', 'g')"
    c = f"array_to_string(list_transform(string_split({c}, ''), lambda x: case when unicode(x) > 127 and regexp_matches(x, '\\p{{L}}') then format('u{{:04X}}', unicode(x)) else x end), '')"
    return f"trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower({c}), '\\s+', ' ', 'g')), '[.!?;:]+$', ''), '[^a-z0-9\\s-]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"select distinct br, title, {_title_sql('title')} as title_norm from kg_resource")
def norm_title(spark, d):
    return table(spark, d, "kg_resource").select("br", "title").distinct().withColumn("title_norm", N.norm_title(F.col("title")))


@query(f"select ref_row_id, {_title_sql('article_title')} as title_norm from bib_reference")
def norm_title_references(spark, d):
    return table(spark, d, "bib_reference").select("ref_row_id", N.norm_title(F.col("article_title")).alias("title_norm"))


@query(r"""select doc_id, regexp_replace(text, '[\r\n]', ' ', 'g') as line from documents""")
def newline_free(spark, d):
    return table(spark, d, "documents").select("doc_id", N.newline_free(F.col("text")).alias("line"))


@query("""select ref_row_id, coalesce(nullif(coalesce(article_title, ''), ''), nullif(coalesce(volume_title, ''), ''), nullif(coalesce(journal_title, ''), ''), '') as main_title from bib_reference""")
def main_title(spark, d):
    e = lambda c: F.coalesce(c, F.lit(""))
    return table(spark, d, "bib_reference").select("ref_row_id", N.main_title(e("article_title"), e("volume_title"), e("journal_title")).alias("main_title"))


@query(rf"""select ref_row_id, substring(trim(regexp_replace(regexp_replace(nfc_normalize(article_title), '[\x00-\x1f\x7f<>{{}}|^`]', ' ', 'g'), '{_WHITE}', ' ', 'g')), 1, 1000) as literal from bib_reference""")
def clean_literal(spark, d):
    return table(spark, d, "bib_reference").select("ref_row_id", N.clean_literal(fuzzy.nfc(F.col("article_title"))).alias("literal"))


_REPAIR = "unstructured"
for _a, _b in N.GARBLED:
    _REPAIR = "replace({}, '{}', '{}')".format(_REPAIR, _a.replace("'", "''"), _b.replace("'", "''"))


@query(f"select ref_row_id, {_REPAIR} as cleaned from bib_reference")
def repair_garbled(spark, d):
    return table(spark, d, "bib_reference").select("ref_row_id", N.repair_garbled(F.col("unstructured")).alias("cleaned"))


@query()
def transliterated(spark, d):
    return table(spark, d, "kg_resource").select("br", fuzzy.transliterate(F.col("title")).alias("ascii"), fuzzy.nfc(F.col("title")).alias("composed"))


# ---- graph


@query(f"with {X.KG_SQL} select br, doi from kg")
def kg_bgp_inner(spark, d):
    return graph.identifiers(graph.to_triples(_kg(spark, d)))


@query(f"with {X.KG_SQL} select {CAND} from kg")
def kg_optional_left(spark, d):
    return graph.candidates(graph.to_triples(_kg(spark, d)))


@query(f"with {X.KG_SQL} select p, count(*) as n from (select unnest(['dcterms:title','prism:publicationDate','datacite:hasIdentifier','datacite:usesIdentifierScheme','literal:hasLiteralValue','pro:isDocumentContextFor','pro:isHeldBy','foaf:familyName','frbr:partOf','frbr:partOf','fabio:hasSequenceIdentifier','frbr:embodiment','prism:startingPage','prism:endingPage']) as p from kg) group by p")
def kg_triples(spark, d):
    return graph.to_triples(_kg(spark, d)).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {X.KG_SQL} select br, 'dcterms:title' as p, title as o from kg union all select br, 'prism:publicationDate', pub_date from kg union all select br, 'datacite:hasIdentifier', 'id/' || br from kg union all select br, 'pro:isDocumentContextFor', 'ar/' || br from kg union all select br, 'frbr:partOf', 'issue/' || br from kg union all select br, 'frbr:embodiment', 're/' || br from kg")
def unnest_props(spark, d):
    g = _kg(spark, d)
    return graph.properties(graph.to_triples(g), g)


@query(f"with {X.KG_SQL} select br, title as \"dcterms:title\", pub_date as \"prism:publicationDate\" from kg")
def pivot_properties(spark, d):
    g = _kg(spark, d)
    return evaluate.pivoted(graph.properties(graph.to_triples(g), g), ["dcterms:title", "prism:publicationDate"])


@query(f"with {X.KG_SQL} select br, array_to_string(list_sort(['dcterms:title','prism:publicationDate','datacite:hasIdentifier','pro:isDocumentContextFor','frbr:partOf','frbr:embodiment']), ', ') as predicates from kg")
def observed_predicates(spark, d):
    g = _kg(spark, d)
    p = graph.properties(graph.to_triples(g), g).groupBy("br").agg(F.array_sort(F.collect_set("p")).alias("a"))
    return p.select("br", F.array_join("a", ", ").alias("predicates"))


# ---- candidates, one query a strategy


def _cand(name: str):
    def run(spark, d):
        s = next(s for s in S.STRATEGIES if s.name == name)
        return S.generate(*_both(spark, d), s, CFG).select("ref_id", *S.CANDIDATE, "query_type")

    run.__name__ = f"cand_{name}"
    return query(f"{X.BASE_SQL} select ref_id, {CAND}, query_type from ({X.STRATEGY_SQL[name]})")(run)


for _s in S.STRATEGIES:
    _cand(_s.name)


@query(f"{X.BASE_SQL}, {X.SCORED_SQL} select query_type, count(*) as n_candidates, count(distinct ref_id) as n_refs from cands group by 1")
def cand_union_distinct(spark, d):
    return S.all_candidates(*_both(spark, d), CFG).groupBy("query_type").agg(F.count(F.lit(1)).alias("n_candidates"), F.countDistinct("ref_id").alias("n_refs"))


@query(f"{X.BASE_SQL}, {X.SCORED_SQL} select count(*) as n from cands where prio > 2")
def cand_without_doi_blocking(spark, d):
    return S.all_candidates(*_both(spark, d), MatchConfig(use_doi=False)).agg(F.count(F.lit(1)).alias("n"))


# ---- scores and winners


@query(f"{X.BASE_SQL}, {X.SCORED_SQL} select ref_id, br, query_type, c_doi, c_author, c_year, c_volume, c_page, c_title, score from scored")
def score_native(spark, d):
    return _scored(spark, d).select("ref_id", "br", "query_type", *_i("c_doi", "c_author", "c_year", "c_volume", "c_page", "c_title", "score"))


@query(f"{X.BASE_SQL}, {X.SCORED_SQL}, b as (select *, row_number() over (partition by ref_id order by score desc, prio, br) as rn from scored where score > 0) select ref_id, br, query_type, score from b where rn = 1")
def winner_best(spark, d):
    return _won(spark, d, early_stop=False).select("ref_id", "br", "query_type", *_i("score"))


@query(f"{X.ALL_SQL} select ref_id, br, query_type, score from won")
def winner_early_stop(spark, d):
    return _won(spark, d).select("ref_id", "br", "query_type", *_i("score"))


@query(f"{X.ALL_SQL} select ref_id, br, score from acc")
def accept_threshold(spark, d):
    return resolve.accepted(_won(spark, d), CFG).select("ref_id", "br", *_i("score"))


@query(f"{X.ALL_SQL} select ref_id, max(score - c_year) as score_without_year from scored where prio in (2, 3) and r_year is not null group by 1")
def cascade_no_year(spark, d):
    return resolve.without_year(_scored(spark, d)).select("ref_id", *_i("score_without_year"))


def _cascade(spark, d):
    g = store(_kg(spark, d))
    refs = store(X.refs(g))
    return (refs, *resolve.cascade(refs, g, CFG))


@query(f"{X.ALL_PASSES_SQL} select ref_id, br, query_type, score, 1 as pass_no from acc union all select ref_id, br, query_type, score, 2 from acc2 union all select ref_id, br, query_type, score, 3 from acc3")
def winner_cascade(spark, d):
    return _cascade(spark, d)[1].select("ref_id", "br", "query_type", *_i("score", "pass_no"))


@query(f"{X.ALL_PASSES_SQL} select ref_id, doi, year, first_author_lastname, article_title from merged")
def enriched_pass(spark, d):
    """What the first pass left, its empty fields read out of the raw citations."""
    from ..operators import enrich

    g = store(_kg(spark, d))
    refs = store(X.refs(g))
    won = resolve.best(S.prepare(refs, CFG), g, CFG)
    return enrich.enrich(merged(refs, resolve.accepted(won, CFG).select("ref_id"), "ref_id", "left_anti")).select("ref_id", "doi", "year", "first_author_lastname", "article_title")


@query(f"""{X.ALL_PASSES_SQL} select count(*) as n_references, (select count(*) from acc) as n_pass_1, (select count(*) from acc2) as n_pass_2, (select count(*) from acc3) as n_pass_3,
  (select count(*) from refs2) as n_attempts, count(*) - (select count(*) from acc) - (select count(*) from acc2) - (select count(*) from acc3) as n_unmatched, (select count(*) from acc2) as n_successes from refs""")
def pass_counts(spark, d):
    return resolve.pass_counts(*_cascade(spark, d))


@query(f"""{X.ALL_PASSES_SQL}, x as (select m.ref_id, coalesce(a.score, 0) as score_original, b.score as score_enriched, c.score as score_without_year from merged m
  left join won a using (ref_id) left join won2 b using (ref_id) left join won3 c using (ref_id) where ref_id not in (select ref_id from acc2) and ref_id not in (select ref_id from acc3))
select *, nullif(greatest(score_original, coalesce(score_enriched, 0), coalesce(score_without_year, 0)), 0) as best_score, case when score_enriched is not null then 'Yes' else 'No' end as enrichment_attempted,
  case when greatest(score_original, coalesce(score_enriched, 0), coalesce(score_without_year, 0)) > 0 then 'Yes' else 'No' end as threshold_failed from x""")
def unmatched_report(spark, d):
    return _cascade(spark, d)[2].select("ref_id", *_i("score_original", "score_enriched", "score_without_year", "best_score"), "enrichment_attempted", "threshold_failed")


@query(f"""{X.ALL_PASSES_SQL}, y as (select m.ref_id, coalesce(a.score, 0) as o, b.score as e, c.score as y from merged m
  left join won a using (ref_id) left join won2 b using (ref_id) left join won3 c using (ref_id) where ref_id not in (select ref_id from acc2) and ref_id not in (select ref_id from acc3)),
z as (select *, greatest(o, coalesce(e, 0), coalesce(y, 0)) as g from y)
select r.ref_id as reference_id, r.year, volume, first_page, first_author_lastname, article_title, volume_title, journal_title, doi, unstructured, case when g > 0 then g::varchar else 'N/A' end as best_score, o::varchar as score_original,
  coalesce(e::varchar, 'N/A') as score_after_grobid, coalesce(z.y::varchar, 'N/A') as score_without_year, case when e is not null then 'Yes' else 'No' end as grobid_attempted, case when g > 0 then 'Yes' else 'No' end as threshold_failed
from z join refs r on r.ref_id = z.ref_id""")
def unmatched_table(spark, d):
    from ..sources import sinks

    refs, _, report = _cascade(spark, d)
    return sinks.unmatched(report, refs)


@query(f"""{X.ALL_SQL} select ref_id as reference_id, coalesce(nullif(r_title, ''), 'N/A') as article_title, title as matched_title, score, doi as matched_doi, br as meta_id, query_type from acc""")
def matches_table(spark, d):
    from ..sources import sinks

    return sinks.matches(resolve.accepted(_won(spark, d), CFG))


@query()
def title_fuzzy(spark, d):
    """Similarities of references' titles, as delivered, to those of the resources that have their DOI; no SQL has them."""
    k = table(spark, d, "kg_resource").select(F.lower(F.trim("doi")).alias("doi"), N.norm_title(F.col("title")).alias("b")).where("doi <> '' and b <> ''").distinct()
    r = table(spark, d, "bib_reference").select(N.norm_doi(F.col("doi")).alias("doi"), N.norm_title(F.col("article_title")).alias("a")).where("doi <> '' and a <> ''").distinct()
    x = r.join(k, "doi").select("a", "b").distinct()
    return x.select("a", "b", *[f(F.col("a"), F.col("b")).alias(n) for n, f in (("ratio", fuzzy.ratio_udf), ("partial", fuzzy.partial_ratio_udf), ("token_sort", fuzzy.token_sort_ratio_udf), ("token_set", fuzzy.token_set_ratio_udf), ("similarity", fuzzy.similarity_udf))])


@query()
def winner_fuzzy(spark, d):
    return _won(spark, d, fuzzy_titles=True).select("ref_id", "br", "query_type", "title_sim", *_i("score"))


# ---- statistics


_COV = ", ".join(f"count(*) filter (where {c}) as n_{n}" for n, c in (("author", "r_author <> ''"), ("title", "r_title <> ''"), ("doi", "r_doi <> ''"), ("year", "r_year is not null"), ("volume", "r_volume <> ''"), ("page", "r_page <> ''")))


@query(f"{X.BASE_SQL} select source_file, count(*) as n_references, {_COV} from prep group by rollup (source_file)")
def coverage_stats(spark, d):
    return stats.coverage(_prep(spark, d))


@query(f"{X.ALL_SQL} select count(*) as n_matches, count(*) filter (where c_doi > 0) as by_doi, count(*) filter (where c_author > 0) as by_author, count(*) filter (where c_year > 0) as by_year, count(*) filter (where abs(r_year - cast(substring(pub_date, 1, 4) as int)) = 1) as by_year_adjacent, count(*) filter (where c_volume > 0) as by_volume, count(*) filter (where c_page > 0) as by_page, count(*) filter (where title_sim >= 100) as by_title_exact, count(*) filter (where title_sim >= 75 and title_sim < 100) as by_title_fuzzy from acc")
def field_contribution(spark, d):
    return stats.contribution(resolve.accepted(_won(spark, d), CFG))


@query(f"{X.ALL_SQL} select query_type, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from acc group by 1")
def query_type_distribution(spark, d):
    return stats.distribution(resolve.accepted(_won(spark, d), CFG))


@query(f"{X.ALL_SQL} select source_file, count(*) as n_references, count(a.ref_id) as n_matches, round(count(a.ref_id) / count(*) * 100, 6) as match_rate from prep p left join (select ref_id from acc) a using (ref_id) group by rollup (source_file)")
def stats_rollup(spark, d):
    return stats.rates(_prep(spark, d), resolve.accepted(_won(spark, d), CFG))


@query(f"{X.ALL_SQL}, x as (select query_type, count(*) * 100.0 / sum(count(*)) over () as s from acc group by 1), m as (select count(a.ref_id) / count(*) * 100 as r from prep left join (select ref_id from acc) a using (ref_id)) select query_type, case when s >= 40 then 'Primary' when s >= 20 then 'Secondary' else 'Minor' end as badge, (select case when r >= 60 then 'high' when r >= 40 then 'moderate' when r >= 20 then 'low' else 'very low' end from m) as match_band from x")
def interpretation_bands(spark, d):
    prep, acc = _prep(spark, d), resolve.accepted(_won(spark, d), CFG)
    rate = stats.rates(prep, acc).where("source_file is null").select(stats.band(F.col("match_rate")).alias("match_band"))
    return stats.distribution(acc).select("query_type", stats.badge(F.col("share") * 100).alias("badge")).join(F.broadcast(rate), F.lit(True))  # one row


@query(f"{X.BASE_SQL} select ref_id, coalesce(nullif(r_title, ''), k.title) as article_title, coalesce(nullif(r_volume, ''), k.volume_num) as volume from prep join kg k using (k)")
def merge_if_empty(spark, d):
    r = _refs(spark, d).select("ref_id", "k", "article_title", "volume")
    e = r.select("ref_id", "k").join(_kg(spark, d).select("k", F.col("title").alias("article_title"), F.col("volume_num").alias("volume")), "k")
    return resolve.merge_if_empty(r, e, ["article_title", "volume"]).select("ref_id", "article_title", "volume")


# ---- evaluation


_EV = f"""{X.ALL_SQL}, gold as (select source_file as base, k, case when r_doi = '' then (select doi from kg z where z.k = p.k) else r_doi end as doi from prep p),
pos as (select base, doi from gold where k % 7 <> 0), neg as (select base, doi from gold where k % 7 = 0), pred as (select distinct source_file as base, lower(doi) as doi from acc)"""


def _sets(spark, d):
    kg = store(_kg(spark, d))
    refs = store(X.refs(kg))
    prep = store(S.prepare(refs, CFG))
    g = merged(merged(prep, refs.select("ref_id", "k"), "ref_id"), kg.select("k", F.col("doi").alias("own")), "k").select(F.col("source_file").alias("base"), "k", F.when(F.col("r_doi") == "", F.col("own")).otherwise(F.col("r_doi")).alias("doi"))
    won = resolve.best(prep, kg, CFG)
    pred = resolve.accepted(won, CFG).select(F.col("source_file").alias("base"), F.lower("doi").alias("doi"), "score").dropDuplicates(["base", "doi"])
    return g.where("k % 7 <> 0"), g.where("k % 7 = 0"), pred


@query(f"""{_EV}, g as (select distinct base, doi, true as is_pos from pos union all select distinct base, doi, false from neg), x as (select g.*, p.doi is not null as hit from g left join pred p on g.base = p.base and g.doi = p.doi)
select base, count(*) filter (where is_pos and hit) as tp, count(*) filter (where not is_pos and hit) as fp, count(*) filter (where is_pos and not hit) as fn, count(*) filter (where not is_pos and not hit) as tn from x group by 1""")
def eval_confusion(spark, d):
    return evaluate.confusion(*_sets(spark, d))


@query(f"""{_EV}, g as (select distinct base, doi, true as is_pos from pos union all select distinct base, doi, false from neg), x as (select g.*, p.doi is not null as hit from g left join pred p on g.base = p.base and g.doi = p.doi),
s as (select count(*) filter (where is_pos and hit) as tp, count(*) filter (where not is_pos and hit) as fp, count(*) filter (where is_pos and not hit) as fn, count(*) filter (where not is_pos and not hit) as tn from x),
m as (select *, tp / (tp + fp) as p, tp / (tp + fn) as r from s)
select tp, fp, fn, tn, round(p * 100, 6) as precision, round(r * 100, 6) as recall, round(2 * p * r / (p + r) * 100, 6) as f1, round((tp + tn) / (tp + fp + fn + tn) * 100, 6) as accuracy from m""")
def eval_metrics(spark, d):
    return evaluate.metrics(evaluate.confusion(*_sets(spark, d)))


@query(f"{_EV} select distinct base, doi from pos where (base, doi) not in (select (base, doi) from pred)")
def missed_matches(spark, d):
    pos, _, pred = _sets(spark, d)
    return evaluate.missed(pos, pred)


@query(f"{_EV} select base, doi from pred where (base, doi) not in (select (base, doi) from pos)")
def earned_matches(spark, d):
    pos, _, pred = _sets(spark, d)
    return evaluate.earned(pos, pred)


@query(f"{_EV} select base, doi from pos intersect select base, doi from pred")
def set_intersection(spark, d):
    pos, _, pred = _sets(spark, d)
    return pos.select("base", "doi").intersect(pred.select("base", "doi"))


@query(f"{_EV} select base, doi from neg except select base, doi from pred")
def set_difference(spark, d):
    _, neg, pred = _sets(spark, d)
    return neg.select("base", "doi").subtract(pred.select("base", "doi"))


@query(f"{_EV}, l as (select doi, max(k) as gold_k from gold where k % 7 <> 0 group by 1) select p.doi, p.base, gold_k from pred p join l using (doi)")
def filtered_matches(spark, d):
    pos, _, pred = _sets(spark, d)
    gold = pos.select("doi", "base", F.col("k").alias("gold_k"), F.col("k").alias("ordinal"))
    return evaluate.filtered(gold, pred.select("doi", "base"))


@query(f"{_EV} select base, avg(case when p.doi is not null then 1.0 else 0.0 end)::double as success_rate from (select distinct g.base, g.doi from gold g) g left join (select base as b2, doi from pred) p on g.base = p.b2 and g.doi = p.doi group by 1")
def lookup_success(spark, d):
    pos, neg, pred = _sets(spark, d)
    g = pos.unionByName(neg).select("base", "doi").distinct()
    return g.join(pred.select("base", "doi").withColumn("hit", F.lit(1.0)), ["base", "doi"], "left").groupBy("base").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("success_rate"))


_DOIS = f"""{X.ALL_SQL}, dois as (select source_file as base, 'b' || k as reference_id, r_doi as doi from prep where r_doi <> ''), known as (select * from kg where k % 11 <> 0)"""


def _dois(spark, d):
    """(cited DOIs, properties of the DOIs that a lookup knows)."""
    g = store(_kg(spark, d))
    refs = X.refs(g)
    dois = S.prepare(refs, CFG).join(refs.select("ref_id", "k"), "ref_id").where("r_doi <> ''").select(F.col("source_file").alias("base"), F.concat(F.lit("b"), F.col("k").cast("string")).alias("reference_id"), F.col("r_doi").alias("doi"))
    pair = lambda p, c: F.struct(F.lit(p).alias("p"), F.col(c).alias("o"))
    return dois, g.where("k % 11 <> 0").select("doi", F.explode(F.array(pair("dcterms:title", "title"), pair("prism:publicationDate", "pub_date"))).alias("t")).select("doi", "t.*")


@query(f"""{_DOIS} select base, reference_id, d.doi as "DOI", title as "dcterms:title", pub_date as "prism:publicationDate" from dois d join known k on d.doi = k.doi""")
def doi_results(spark, d):
    dois, props = _dois(spark, d)
    return evaluation.doi_results(evaluation.looked_up(dois, props)[0], props, ["dcterms:title", "prism:publicationDate"])


@query(f"""{_DOIS} select base, reference_id, doi as "DOI" from dois where doi not in (select doi from known)""")
def unmatched_dois(spark, d):
    return evaluation.unmatched_dois(evaluation.looked_up(*_dois(spark, d))[1])


@query(f"""{_DOIS}, c as (select base, count(*) as n, count(k.doi) as m from dois d left join known k on d.doi = k.doi group by 1)
select base, 0 as at, 'Total queries' as "Metric", n::varchar as "Value" from c union all select base, 1, 'Successful queries', m::varchar from c union all select base, 2, 'Success rate', printf('%.2f%%', m / n * 100) from c""")
def lookup_statistics(spark, d):
    dois, props = _dois(spark, d)
    return evaluation.statistics(dois, evaluation.looked_up(dois, props)[0])


@query(f"""{_EV}, g as (select base, doi, 'b' || max(k) as reference_id from gold where k % 7 <> 0 group by 1, 2), p as (select source_file as base, lower(doi) as doi, max(ref_id) as reference_id from acc group by 1, 2),
x as (select 'missed' as kind, base, reference_id, doi from g where (base, doi) not in (select (base, doi) from p) union all select 'earned', base, reference_id, doi from p where (base, doi) not in (select (base, doi) from g))
select *, count(*) over (partition by kind) as total from x""")
def comparison_table(spark, d):
    pos, _, _ = _sets(spark, d)
    gold = pos.select("base", F.concat(F.lit("b"), F.col("k").cast("string")).alias("reference_id"), "doi", F.col("k").alias("ordinal"))
    won = resolve.accepted(_won(spark, d), CFG).select(F.col("source_file").alias("base"), F.col("ref_id").alias("reference_id"), "doi", F.col("ref_id").alias("ordinal"))
    return evaluation.compared(gold, won)


@query(f"""{X.ALL_SQL}, n as (select source_file, count(*) as n_references from prep group by 1), m as (select source_file, count(*) as n_matches from acc group by 1), t as (select n.source_file, n_references, coalesce(n_matches, 0) as n_matches from n left join m using (source_file))
select 'files_processed' as counter, count(*) as n from t union all select 'total_files_attempted', count(*) from t union all select 'total_references', sum(n_references)::bigint from t union all select 'matches_found', sum(n_matches)::bigint from t""")
def aggregated_files(spark, d):
    """Counters of all files' statistics, as they would be read from their texts."""
    prep, g = _both(spark, d)
    prep = store(prep)
    won = resolve.accepted(resolve.best(prep, g, CFG), CFG)
    r = stats.rates(prep, won).where("source_file is not null")
    line = lambda k, c: F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value"))
    texts = store(r.select("source_file", F.explode(F.array(line("Total references processed", "n_references"), line("Total matches found", "n_matches"))).alias("l")).select("source_file", "l.*"))
    return files.aggregated(files.stats_counters(texts), texts)


# ---- lines and order


@query("select raw_id, length(payload) > 0 as has_payload, (row_number() over (order by raw_id) - 1) // 100 as chunk from crossref_doc")
def chunk_lines(spark, d):
    """Chunks of 100 lines; the number of a line comes from two-level running counts, not one task."""
    from ..sources import sinks

    return sinks.chunked(table(spark, d, "crossref_doc").select("raw_id", (F.length("payload") > 0).alias("has_payload")), "raw_id", 100)


@query("select ref_row_id, reference_id, try_cast(substring(reference_id, 5) as int) as n from bib_reference")
def numeric_suffix(spark, d):
    """Number of an id, to sort ``ref_2`` before ``ref_10``."""
    return table(spark, d, "bib_reference").select("ref_row_id", "reference_id", F.substring("reference_id", 5, 20).try_cast("int").alias("n"))


@query("select source_file, max(ref_index) as last_index, max_by(reference_id, ref_row_id) as last_id, count(*) as n from bib_reference group by 1")
def last_wins(spark, d):
    """The last delivery of a file wins."""
    return table(spark, d, "bib_reference").groupBy("source_file").agg(F.max("ref_index").alias("last_index"), F.max_by("reference_id", "ref_row_id").alias("last_id"), F.count(F.lit(1)).alias("n"))
