"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import spread, store, table
from . import entitymatch, hotdedup, lookalike, mixing, mojibake, namelink, packing, pii, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates by DOI within a citing file, in both tables; both go through one pass."""
    bib = table(spark, sf_dir, "bib_reference").select(F.lit("bib_reference").alias("t"), F.col("ref_row_id").alias("id"), "source_file", F.col("doi").alias("d"))
    mat = table(spark, sf_dir, "matches").select(F.lit("matches").alias("t"), F.col("match_id").alias("id"), "source_file", F.col("matched_doi").alias("d"))
    rows = bib.unionByName(mat).select("id", F.when(F.col("source_file").isNotNull(), F.struct("t", "source_file")).alias("g"), "d", "t")
    out = hotdedup.duplicates(rows, "id", "g", hotdedup.canonical_doi(F.col("d")), keep=F.col("g.t").alias("table_name"))
    return out.select("table_name", "keep_id", "dup_id")


@query
def p5_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per DOI over the whole of bib_reference, with its number of copies."""
    return hotdedup.collapsed(table(spark, sf_dir, "bib_reference"), "ref_row_id", hotdedup.canonical_doi(F.col("doi")))


@query
def p5_collapsed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per DOI within a citing file, in both tables, with its number of copies."""
    bib = table(spark, sf_dir, "bib_reference").select(F.lit("bib_reference").alias("table_name"), "source_file", F.col("ref_row_id").alias("id"), F.col("doi").alias("d"))
    mat = table(spark, sf_dir, "matches").select(F.lit("matches").alias("table_name"), "source_file", F.col("match_id").alias("id"), F.col("matched_doi").alias("d"))
    return hotdedup.collapsed(bib.unionByName(mat), "id", hotdedup.canonical_doi(F.col("d")), within=("table_name", "source_file"))


@query
def p5_collapsed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with keys of 8 rows taken as hot, so that salted and plain aggregation both run."""
    bib = table(spark, sf_dir, "bib_reference").select(F.lit("bib_reference").alias("table_name"), "source_file", F.col("ref_row_id").alias("id"), F.col("doi").alias("d"))
    mat = table(spark, sf_dir, "matches").select(F.lit("matches").alias("table_name"), "source_file", F.col("match_id").alias("id"), F.col("matched_doi").alias("d"))
    return hotdedup.collapsed(bib.unionByName(mat), "id", hotdedup.canonical_doi(F.col("d")), hot_rows=8, salts=4, within=("table_name", "source_file"))


_ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), *((f"&#{k};", chr(i)) for i in range(33, 127) if not chr(i).isalnum() for k in (str(i), f"x{i:x}"))]


def _doi_sql(c: str) -> str:
    """canonical_doi in DuckDB's SQL."""
    sql = lambda x: "'" + x.replace("'", "''") + "'"
    blanks, dashes, tail = r"[\s\x{00AD}\x{00A0}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{2060}\x{3000}\x{FEFF}]+", r"[\x{2010}-\x{2015}\x{2212}]", r"""[.,;:"<>\]}?!]+$"""
    x = f"url_decode(replace(lower({c}), '+', '%2b'))"
    for a, b in _ENTITIES:
        x = f"replace({x}, {sql(a)}, {sql(b)})"
    x = f"lower(regexp_replace(regexp_replace({x}, '{blanks}', '', 'g'), '{dashes}', '-', 'g'))"
    x = f"regexp_extract(replace({x}, chr(92), ''), '10\\.[0-9][0-9.]*/.+$')"
    for _ in range(3):
        x = f"regexp_replace({x}, '{tail}', '')"
        x = f"list_transform([{x}], lambda z: case when z like '%)' and length(replace(z, '(', '')) > length(replace(z, ')', '')) then z[:-2] else z end)[1]"
    return f"nullif(regexp_replace({x}, '{tail}', ''), '')"


ORACLES["p5_found"] = f"""
with u as (select 'bib_reference' as table_name, ref_row_id as id, source_file, {_doi_sql('doi')} as k from bib_reference
  union all select 'matches', match_id, source_file, {_doi_sql('matched_doi')} from matches),
w as (select table_name, min(id) over (partition by table_name, source_file, k) as keep_id, id as dup_id from u where k is not null and source_file is not null)
select * from w where dup_id > keep_id"""
ORACLES["p5_collapsed_files"] = f"""
with u as (select 'bib_reference' as table_name, ref_row_id as id, source_file, {_doi_sql('doi')} as k from bib_reference
  union all select 'matches', match_id, source_file, {_doi_sql('matched_doi')} from matches)
select table_name, source_file, k as canonical_key, min(id) as keep_id, count(*) as n_copies from u where k is not null and source_file is not null group by 1, 2, 3"""
ORACLES["p5_collapsed_split"] = ORACLES["p5_collapsed_files"]
ORACLES["p5_collapsed"] = f"select {_doi_sql('doi')} as canonical_key, min(ref_row_id) as keep_id, count(*) as n_copies from bib_reference where {_doi_sql('doi')} is not null group by 1"


def _bib(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Columns of bib_reference over all cores."""
    return spread(table(spark, sf_dir, "bib_reference").select(*cols))


TEXTS = ["article_title", "unstructured"]


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled values."""
    return mojibake.garbled(_bib(spark, sf_dir, "ref_row_id", *TEXTS), "ref_row_id", TEXTS).select("ref_row_id", "field_name")


@query
def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled values with the text restored where it can be, and whether characters are lost for good."""
    return mojibake.garbled(_bib(spark, sf_dir, "ref_row_id", *TEXTS), "ref_row_id", TEXTS)


def _is_garbled(field: str, value: str) -> bool:
    return field in TEXTS and mojibake.repair(value)[1]


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that hold look-alike forms, without the garbled ones."""
    return lookalike.variants(_bib(spark, sf_dir, "ref_row_id", "first_author_lastname", *TEXTS), "ref_row_id", ["article_title", "first_author_lastname", "unstructured"], _is_garbled).select("ref_row_id", "field_name")


@query
def p2_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same values in their one form, with flags of what was changed."""
    return lookalike.variants(_bib(spark, sf_dir, "ref_row_id", "first_author_lastname", *TEXTS), "ref_row_id", ["article_title", "first_author_lastname", "unstructured"])


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings of one person or organisation."""
    return namelink.pairs(namelink.entities(table(spark, sf_dir, "bib_reference"), "first_author_lastname"))


@query
def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spelling with its entity and the entity's number of links."""
    e = namelink.entities(table(spark, sf_dir, "bib_reference"), "first_author_lastname")
    return e.select("name", "entity", (F.count(F.lit(1)).over(Window.partitionBy("entity")) - 1).alias("n_links"))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    bib = _bib(spark, sf_dir, "ref_row_id", "source_file", "reference_id", "doi", "article_title", "first_author_lastname", "year", "first_page")
    kg = table(spark, sf_dir, "kg_resource")
    return entitymatch.matched(entitymatch.read_refs(bib), entitymatch.read_resources(kg), entitymatch.read_labelled(bib, kg))


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without DOI and the resources that are the same publication."""
    return _matched(spark, sf_dir).select(F.col("id").alias("ref_row_id"), "br")


@query
def p6_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with score share, gap to the runner-up and confidence."""
    return _matched(spark, sf_dir).select(F.col("id").alias("ref_row_id"), "br", F.round("share", 4).alias("share"), F.round("gap", 4).alias("gap"), F.round("confidence", 4).alias("confidence"))


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal items in the texts."""
    return pii.found(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "pii_type", "start_pos")


@query
def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with typed placeholders."""
    return pii.redacted(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _sized(spark: SparkSession, sf_dir: str, *others: str) -> DataFrame:
    return store(tokens.sized(spread(table(spark, sf_dir, "documents").select("doc_id", "text", *others)), "doc_id", "text", *others))


@query
def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's pieces with their containers, for each container size."""
    return packing.packed(_sized(spark, sf_dir), table(spark, sf_dir, "container_size"))


@query
def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and share of unused space by container size."""
    sizes = table(spark, sf_dir, "container_size")
    p = packing.packed(_sized(spark, sf_dir), sizes)
    per = p.groupBy("size_name").agg(F.countDistinct("container").alias("n_containers"), F.sum(F.col("n_tokens").cast("bigint")).alias("n_tokens"))
    return per.join(sizes, "size_name").select("size_name", "n_containers", "n_tokens", F.round(1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("unused_share"))


@query
def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must not happen, counted by container size: overfull containers, needless splits, texts and tokens that are lost."""
    sizes, sized = table(spark, sf_dir, "container_size").where("capacity_tokens > 0"), _sized(spark, sf_dir)
    p = store(packing.packed(sized, sizes)).join(sizes, "size_name")
    over = p.groupBy("size_name", "container").agg(F.sum(F.col("n_tokens").cast("bigint")).alias("t"), F.first("capacity_tokens").alias("c")).groupBy("size_name").agg(F.count_if(F.col("t") > F.col("c")).alias("n_overfull"))
    docs = p.groupBy("size_name", "doc_id").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("n_tokens").cast("bigint")).alias("t"), F.first("capacity_tokens").alias("c")).join(sized.groupBy("doc_id").agg(F.sum(F.col("n_tokens").cast("bigint")).alias("own"), F.count(F.lit(1)).alias("times")), "doc_id")
    each = docs.groupBy("size_name").agg(F.count_if((F.col("k") > F.col("times")) & (F.col("own") <= F.col("c"))).alias("n_split"), F.count_if(F.col("t") != F.col("own")).alias("n_changed"), F.count(F.lit(1)).alias("n_docs"))
    return over.join(each, "size_name").select("size_name", "n_overfull", "n_split", "n_changed", "n_docs")


ORACLES["p7_invariants"] = "select size_name, 0 as n_overfull, 0 as n_split, 0 as n_changed, (select count(distinct doc_id) from documents) as n_docs from container_size where capacity_tokens > 0"


@query
def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source: texts used too often, uses of texts of another source, and whether the share is within a point of its target."""
    t, docs = table(spark, sf_dir, "mix_target"), table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("own"))
    mix = store(mixing.mixed(_sized(spark, sf_dir, "source"), t))
    uses = mix.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n")).join(t.select("source", "max_repeat"), "source").join(docs, "doc_id")
    bad = uses.groupBy("source").agg(F.count_if(F.col("n") > F.col("max_repeat")).alias("n_overused"), F.count_if(F.col("own") != F.col("source")).alias("n_foreign"))
    return mixing.shares(mix, t).join(bad, "source").select("source", "n_overused", "n_foreign", (F.abs(F.col("actual_share") - F.col("target_share")) <= 0.01).alias("near_target"))


ORACLES["p8_invariants"] = "select source, 0 as n_overused, 0 as n_foreign, true as near_target from mix_target"


@query
def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix: slots in order with their texts."""
    return mixing.mixed(_sized(spark, sf_dir, "source"), table(spark, sf_dir, "mix_target"))


@query
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares really reached."""
    t = table(spark, sf_dir, "mix_target")
    return mixing.shares(mixing.mixed(_sized(spark, sf_dir, "source"), t), t)
