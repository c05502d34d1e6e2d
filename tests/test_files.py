import gzip
import json

from pyspark.sql import functions as F

from biblioforge import report
from biblioforge.operators import enrich, stats
from biblioforge.sources import files, sinks
from biblioforge.streaming import batches

DOC = {"message": {"DOI": "10.1/c", "reference-count": 2, "reference": [{"author": [{"family": "Lee"}], "issued": {"date-parts": [[1999]]}, "page": "10-12", "title": ["T"]}, {"unstructured": "Roe, A. (2001). x. pp. 5-9. doi:10.1234/z."}]}}


def test_crossref(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(DOC))
    (tmp_path / "b.json").write_bytes(json.dumps(DOC).replace("Lee", "Lée").encode("cp1252"))
    (tmp_path / "c.json").write_text(json.dumps({"message": {"reference-count": 0}}))
    (tmp_path / "d.json").write_text("{")
    docs = files.crossref_documents(spark, str(tmp_path))
    rows = {(r.source_file, r.ref_index): r for r in files.crossref_references(docs).collect()}
    assert len(rows) == 4
    assert (rows["a.json", 1].year, rows["a.json", 1].first_page, rows["a.json", 1].article_title) == ("1999", "10", "T")
    assert rows["a.json", 1].first_author_lastname == "Lee"
    assert [r.source_file for r in files.empty_documents(docs).collect()] == ["c.json"]
    e = enrich.enrich(files.crossref_references(docs).where("source_file = 'a.json'")).where("ref_index = 2").first()
    assert (e.doi, e.year, e.first_page, e.first_author_lastname) == ("10.1234/z", "2001", "", "Roe")


def test_tei(spark, tmp_path):
    (tmp_path / "x.xml").write_text("""<TEI><text><listBibl>
<biblStruct xml:id="b0"><analytic><title>A</title><author><persName><surname>Lee</surname></persName></author></analytic><monogr><title level="j">J</title><imprint><date when="2001-02"/><biblScope unit="volume">3</biblScope><biblScope unit="page" from="7" to="9"/></imprint></monogr></biblStruct>
<biblStruct xml:id="b1"><monogr><title level="m">M</title><imprint><date when="1999"/><biblScope unit="page">123-130</biblScope></imprint></monogr></biblStruct></listBibl></text></TEI>""")
    a, b = files.tei_references(spark, str(tmp_path)).orderBy("ref_id").collect()
    assert (a.ref_id, a.year, a.volume, a.first_page, a.article_title, a.first_author_lastname, a.journal_title) == ("b0", "2001", "3", "7", "A", "Lee", "")
    assert (b.volume_title, b.first_page, b.year) == ("M", "123", "1999")


def test_dump_csv_and_chunks(spark, tmp_path):
    with gzip.open(tmp_path / "d.json.gz", "wt") as f:
        json.dump({"items": [{"reference": [{"unstructured": "a\nb"}, {"unstructured": ""}]}, {}]}, f)
    d = files.dump_citations(spark, str(tmp_path / "d.json.gz"))
    assert d.count() == 1
    sinks.write_chunks(d, "unstructured", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == "a b"
    n = spark.range(250).withColumnRenamed("id", "k")
    assert {(r.chunk, r.n) for r in sinks.chunked(n, "k", 100).groupBy("chunk").agg(F.count("*").alias("n")).collect()} == {(0, 100), (1, 100), (2, 50)}
    sinks.write_csv(spark.createDataFrame([("1", 'say "x", y')], "a string, b string"), str(tmp_path / "csv"))
    t = files.table_csv(spark, str(tmp_path / "csv"))
    assert t.first().b == 'say "x", y' and files.first_column(t, "B", "a") == "b"


def test_stream_resumes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text(json.dumps(DOC))
    go = lambda: batches.run(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"), files.crossref_references)
    assert go() == 1
    assert go() == 0
    (src / "b.json").write_text(json.dumps(DOC))
    assert go() == 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    assert batches.progress(str(tmp_path / "ck")) == {"begun": 2, "finished": 2}
    assert batches.archive(str(tmp_path / "ck")) and batches.archive(str(tmp_path / "ck")) is None and go() == 1


def test_stream_of_tei(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.xml").write_bytes("<TEI>l\xe4ke</TEI>".encode("cp1252"))
    (src / "b.txt").write_text("no")
    assert batches.run(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"), lambda d: d, tei=True) == 1
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("source_file", "tei").collect()] == [("a.xml", "<TEI>läke</TEI>")]


def test_report(spark):
    c = spark.createDataFrame([(None, 2, 1, 1, 1, 1, 1, 1)], "source_file string, n_references int, " + ", ".join(f"n_{f} int" for f in stats.FIELDS))
    r = spark.createDataFrame([(None, 2, 1, 50.0)], "source_file string, n_references int, n_matches int, match_rate double")
    d = spark.createDataFrame([("doi_title", 1, 1.0)], "query_type string, n int, share double")
    t = report.text(c, r, d)
    assert "Match rate: 50.0%" in t and "<td>50.0%</td>" in report.html("Run", t)
