"""Schemas of records, candidates and outputs."""

from __future__ import annotations

from pyspark.sql import types as T

_s = lambda *names: T.StructType([T.StructField(n, T.StringType()) for n in names])

REFERENCE = _s("year", "volume", "first_page", "first_author_lastname", "article_title", "volume_title", "journal_title", "doi", "unstructured")
CANDIDATE = _s("br", "title", "pub_date", "doi", "author_name", "volume_num", "start_page", "end_page")
TRIPLE = _s("s", "p", "o")
MATCH_COLUMNS = ["reference_id", "article_title", "matched_title", "score", "matched_doi", "meta_id", "query_type"]
UNMATCHED_COLUMNS = ["reference_id", *REFERENCE.names, "best_score", "score_original", "score_after_grobid", "score_without_year", "grobid_attempted", "threshold_failed"]

#: One citing document; polymorphic fields stay raw JSON text.
CROSSREF = T.StructType([
    T.StructField("message", T.StructType([
        T.StructField("DOI", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("reference-count", T.IntegerType()),
        T.StructField("reference", T.ArrayType(_s("key", "DOI", "author", "article-title", "title", "year", "issued", "volume", "first-page", "page", "unstructured"))),
    ])),
])

DUMP = T.StructType([T.StructField("items", T.ArrayType(T.StructType([T.StructField("reference", T.ArrayType(_s("unstructured")))])))])

#: Predicates of the graph.
P = {
    "title": "dcterms:title", "date": "prism:publicationDate", "identifier": "datacite:hasIdentifier", "scheme": "datacite:usesIdentifierScheme", "value": "literal:hasLiteralValue",
    "role": "pro:isDocumentContextFor", "held": "pro:isHeldBy", "family": "foaf:familyName", "part": "frbr:partOf", "sequence": "fabio:hasSequenceIdentifier",
    "embodiment": "frbr:embodiment", "start": "prism:startingPage", "end": "prism:endingPage",
}
DOI_SCHEME = "datacite:doi"
