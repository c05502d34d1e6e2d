"""Readers of citing documents: Crossref JSON, TEI XML, dumps, CSV tables, texts of statistics."""

from __future__ import annotations

import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import native as N
from ..schema import CROSSREF, DUMP

TEI_SPACE = "http://www.tei-c.org/ns/1.0"
#: Where Windows-1252 differs from Latin-1, which Spark decodes by itself.
_HIGH = [c for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
_LATIN, _WINDOWS = "".join(map(chr, _HIGH)), bytes(_HIGH).decode("cp1252")


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 with or without mark, else Windows-1252."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.translate(F.decode(content, "iso-8859-1"), _LATIN, _WINDOWS))
    return F.regexp_replace(text, r"^\x{FEFF}", "")


def crossref_documents(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, message) of each file; files that can't be read have a null message."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    return raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file"), F.from_json(decoded(F.col("content")), CROSSREF).alias("j")).select("source_file", "j.message")


def failed_documents(docs: DataFrame) -> DataFrame:
    """(source_file, reason) of files without a message: unreadable, or an envelope of another kind."""
    return docs.where("message is null").select("source_file", F.lit("no readable message").alias("reason"))


def crossref_references(docs: DataFrame) -> DataFrame:
    """One row a reference, numbered from 1, in the Reference record's columns. Documents without references give none."""
    x = docs.where("message is not null").select("source_file", F.posexplode("message.reference").alias("i", "r")).where("r is not null")
    g = lambda n: F.col(f"r.`{n}`")
    e = lambda c: F.coalesce(c, F.lit(""))
    return x.select(
        F.concat(F.lit("ref_"), F.col("i") + 1).alias("ref_id"), (F.col("i") + 1).alias("ref_index"), "source_file", e(N.year_of(g("year"), g("issued"))).alias("year"), e(g("volume")).alias("volume"),
        e(N.page_of(g("first-page"), g("page"))).alias("first_page"), e(N.author_of(g("author"))).alias("first_author_lastname"), e(N.title_of(g("article-title"), g("title"))).alias("article_title"),
        F.lit("").alias("volume_title"), F.lit("").alias("journal_title"), e(g("DOI")).alias("doi"), e(g("unstructured")).alias("unstructured"),
    )


def empty_documents(docs: DataFrame) -> DataFrame:
    """Documents that are read but cite nothing; these succeed with empty outputs."""
    return docs.where("message is not null and (message.`reference-count` = 0 or message.reference is null or size(message.reference) = 0)").select("source_file")


_TEXT = T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_level", T.StringType()), T.StructField("_type", T.StringType())])
_SCOPE = T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_unit", T.StringType()), T.StructField("_from", T.StringType()), T.StructField("_to", T.StringType())])
_PERSON = T.StructType([T.StructField("persName", T.StructType([T.StructField("surname", T.StringType())]))])
_DATE = T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_when", T.StringType())])
_IMPRINT = T.StructType([T.StructField("date", T.ArrayType(_DATE)), T.StructField("biblScope", T.ArrayType(_SCOPE))])
TEI = T.StructType([
    T.StructField("_xml:id", T.StringType()),
    T.StructField("analytic", T.StructType([T.StructField("title", T.ArrayType(_TEXT)), T.StructField("author", T.ArrayType(_PERSON)), T.StructField("idno", T.ArrayType(_TEXT))])),
    T.StructField("monogr", T.StructType([T.StructField("title", T.ArrayType(_TEXT)), T.StructField("author", T.ArrayType(_PERSON)), T.StructField("imprint", _IMPRINT)])),
])


def tei_references(spark: SparkSession, path: str) -> DataFrame:
    """One row a ``biblStruct`` at any depth; all values stay text. No DOI and no raw citation is read here."""
    x = spark.read.format("xml").option("rowTag", "biblStruct").schema(TEI).load(path)
    level = lambda k: F.get(F.filter("monogr.title", lambda t: t["_level"] == k), 0)["_VALUE"]
    scope = lambda u: F.get(F.filter("monogr.imprint.biblScope", lambda s: s["_unit"] == u), 0)
    e = lambda c: F.coalesce(c, F.lit(""))
    article = F.get("analytic.title", 0)["_VALUE"]
    when = F.get(F.filter("monogr.imprint.date", lambda d: F.length(d["_when"]) >= 4), 0)["_when"]
    return x.select(
        F.col("`_xml:id`").alias("ref_id"), e(F.substring(when, 1, 4)).alias("year"), e(scope("volume")["_VALUE"]).alias("volume"),
        e(F.coalesce(scope("page")["_from"], F.trim(F.split_part(scope("page")["_VALUE"], F.lit("-"), F.lit(1))))).alias("first_page"),
        e(F.coalesce(F.get("analytic.author", 0)["persName"]["surname"], F.get("monogr.author", 0)["persName"]["surname"])).alias("first_author_lastname"),
        e(article).alias("article_title"), F.when(article.isNull(), e(level("m"))).otherwise("").alias("volume_title"), F.when(article.isNull(), e(level("j"))).otherwise("").alias("journal_title"),
        F.lit("").alias("doi"), F.lit("").alias("unstructured"),
    )


def dump_citations(spark: SparkSession, path: str) -> DataFrame:
    """Raw citations of a gzipped dump, one row each."""
    x = spark.read.schema(DUMP).option("multiLine", True).json(path).select(F.explode("items").alias("i")).select(F.explode("i.reference").alias("r"))
    return x.select("r.unstructured").where("unstructured <> ''")


def table_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table, all columns text."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def first_column(df: DataFrame, *names: str) -> str | None:
    """The first of the names that the table has, whatever its case."""
    have = {c.lower(): c for c in df.columns}
    return next((have[n.lower()] for n in names if n.lower() in have), None)


def tei_answers(answers: DataFrame) -> DataFrame:
    """What a citation parser's TEI answers say: (ref_id, doi, year, volume, first_page, first_author_lastname, article_title).

    ``answers`` has ref_id and tei, text or bytes; bytes that are no UTF-8 are replaced. The first element of a kind
    at any depth counts. Answers that are no XML give a row of empty fields.
    """
    fields = ("doi", "year", "volume", "first_page", "first_author_lastname", "article_title")

    def one(tei: str | bytes | None) -> list[str]:
        out = dict.fromkeys(fields, "")
        text = tei.decode("utf-8", "replace") if isinstance(tei, bytes | bytearray) else tei or ""
        try:
            root = ElementTree.fromstring(text.encode())
        except ElementTree.ParseError:
            return list(out.values())
        every = lambda tag: root.iterfind(f".//{{{TEI_SPACE}}}{tag}")
        content = lambda e: (e.text or "").strip() if e is not None else ""
        when = next((e.get("when", "") for e in every("date")), "")
        out["year"] = when[:4] if len(when) >= 4 else ""
        author = next(every("author"), None)
        out["first_author_lastname"] = content(author.find(f".//{{{TEI_SPACE}}}surname")) if author is not None else ""
        out["article_title"] = content(next(every("title"), None))
        for e in every("biblScope"):
            if e.get("unit") == "volume" and e.text:
                out["volume"] = content(e)
            elif e.get("unit") == "page" and (e.get("from") or e.text):
                out["first_page"] = e.get("from") or content(e).split("-")[0].strip()
        ids = {e.get("type"): content(e) for e in reversed(list(every("idno")))}
        target = next((e.get("target", "") for e in every("ptr") if e.get("type") == "DOI"), "")
        out["doi"] = ids.get("DOI") or ids.get("doi") or re.sub(r"^https?://(?:dx\.)?doi\.org/", "", target).strip()
        return list(out.values())

    @F.pandas_udf("struct<" + ",".join(f"{f}:string" for f in fields) + ">")
    def parsed(tei: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in tei], columns=fields)

    return answers.select("ref_id", parsed("tei").alias("f")).select("ref_id", "f.*")


def tei_documents(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, tei) of TEI files as text; bytes that are no UTF-8 are read as Windows-1252."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path)
    return raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file"), decoded(F.col("content")).alias("tei"))


#: Lines of texts of statistics and the counters they hold.
COUNTERS = {
    "total references processed": "total_references", "total references": "total_references", "total matches found": "matches_found", "total matches": "matches_found", "processing errors": "errors", "errors": "errors",
    "references with author": "refs_with_author", "author exact matches": "author_exact_matches", "references with title": "refs_with_title", "title exact matches": "title_exact_matches", "title fuzzy matches": "title_fuzzy_matches",
    "references with doi": "refs_with_doi", "doi matches": "doi_matches", "references with year": "refs_with_year", "year exact matches": "year_exact_matches", "year adjacent matches": "year_adjacent_matches",
    "references with volume": "refs_with_volume", "volume matches": "volume_matches", "references with page": "refs_with_page", "page matches": "page_matches",
}
QUERY_TYPES = ("year_and_doi", "doi_title", "author_title", "year_author_page", "year_volume_page", "year_author_volume")


def stats_counters(texts: DataFrame) -> DataFrame:
    """(source_file, counter, n) of ``stats_texts``: known counters, and ``query:<type>`` for matches by query type."""
    k = F.lower("key")
    named = F.create_map(*[F.lit(x) for kv in COUNTERS.items() for x in kv])
    counter = F.coalesce(F.element_at(named, k), F.when(k.isin(*QUERY_TYPES), F.concat(F.lit("query:"), k)))
    return texts.withColumn("counter", counter).withColumn("n", F.regexp_extract("value", r"^(\d+)", 1).try_cast("bigint")).where("counter is not null and n is not null").select("source_file", "counter", "n")


def aggregated(counters: DataFrame, files: DataFrame) -> DataFrame:
    """(counter, n) over the files with references, and how many files were attempted, processed, empty or unreadable.

    ``files`` has source_file of every text of statistics; those without a count of references are unreadable.
    """
    total = counters.where("counter = 'total_references'").groupBy("source_file").agg(F.max("n").alias("total"))
    state = files.select("source_file").distinct().join(total, "source_file", "left")
    sums = counters.join(state.where("total > 0"), "source_file", "left_semi").groupBy("counter").agg(F.sum("n").alias("n"))
    kind = F.explode(F.array(F.lit("total_files_attempted"), F.when(F.col("total") > 0, "files_processed").when(F.col("total") == 0, "empty_files").otherwise("files_with_errors")))
    return sums.unionByName(state.select(kind.alias("counter")).groupBy("counter").agg(F.count(F.lit(1)).alias("n")))


def stats_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, key, value) of ``key: value`` lines in texts of statistics."""
    x = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("source_file"), F.explode(F.split("value", r"\r?\n")).alias("line"))
    return x.select("source_file", F.trim(F.regexp_extract("line", r"^([^:]+):", 1)).alias("key"), F.trim(F.regexp_extract("line", r"^[^:]+:\s*(.*)$", 1)).alias("value")).where("key <> '' and value <> ''")
