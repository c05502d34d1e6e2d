import json

import pytest

from biblioforge.__main__ import config, main
from biblioforge.schema import DOI_SCHEME
from biblioforge.sources import evaluation as E
from biblioforge.sources import files, remote, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_cited_dois(spark, tmp_path):
    doc = {"message": {"reference": [{"DOI": "10.1\\/A"}, {"DOI": "."}, {"key": "x"}, {"DOI": ""}, {"DOI": "10.2/é"}]}}
    (tmp_path / "u.json").write_text(json.dumps(doc, ensure_ascii=False), encoding="utf-8-sig")
    (tmp_path / "l.json").write_bytes(json.dumps(doc, ensure_ascii=False).encode("latin-1"))
    (tmp_path / "broken.json").write_text("{")
    want = [("b0", "10.1/a"), ("b4", "10.2/é")]
    assert rows(E.cited_dois(spark, str(tmp_path))) == [(b, *x) for b in ("l", "u") for x in want]


def test_match_files(spark):
    names = ["x/A_1_matches.csv", "x/a_1_matches_GS.csv", "x/B_2_matches_GS.csv", "x/old/C_3_filtered_matches.csv", "x/D_4_stats.txt", "x/AA_10_matches.csv"]
    paths = spark.createDataFrame([(n,) for n in names], "path string")
    bases = spark.createDataFrame([(b,) for b in ("A_1", "B_2", "C_3", "D_4", "E_5")], "base string")
    assert rows(E.match_files(bases, paths)) == [("A_1", names[0]), ("B_2", names[2]), ("C_3", names[3])]


def test_lookups_and_comparison(spark):
    dois = spark.createDataFrame([("f", "b0", "10.1/a"), ("f", "b10", "10.1/b"), ("g", "b2", "10.1/c")], "base string, reference_id string, doi string")
    props = spark.createDataFrame([("10.1/a", "t", "T"), ("10.1/b", "t", "U"), ("10.1/b", "y", "1999")], "doi string, p string, o string")
    found, missing = E.looked_up(dois, props)
    assert rows(E.doi_results(found, props, ["y", "t"])) == [("f", "b0", "10.1/a", "T", ""), ("f", "b10", "10.1/b", "U", "1999")]
    assert rows(E.unmatched_dois(missing)) == [("g", "b2", "10.1/c")]
    assert [tuple(r)[2:] for r in E.statistics(dois, found).where("base = 'g'").orderBy("at").collect()] == [("Total queries", "1"), ("Successful queries", "0"), ("Success rate", "0.00%")]
    gold = spark.createDataFrame([("f", "b0", "10.1/A", 1), ("f", "b9", "doi:10.1/a", 2), ("f", "b1", "10.1/b", 3)], "base string, reference_id string, doi string, ordinal int")
    pred = spark.createDataFrame([("f", "r1", "https://doi.org/10.1/B", 1), ("f", "r2", "10.1/x", 2)], gold.schema)
    assert rows(E.compared(gold, pred)) == [("earned", "f", "r2", "10.1/x", 1), ("missed", "f", "b9", "10.1/a", 1)]


def test_parser_answers(spark):
    tei = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><biblStruct><analytic><title>Deep lakes</title><author><persName><surname>Lee</surname></persName></author><idno type="doi">10.1/x</idno></analytic>
<monogr><imprint><date when="2001-05"/><biblScope unit="volume">3</biblScope><biblScope unit="page">7-9</biblScope></imprint></monogr></biblStruct></TEI>"""
    other = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><ptr type="DOI" target="https://doi.org/10.1/y"/></TEI>'
    got = {r.ref_id: tuple(r)[1:] for r in files.tei_answers(spark.createDataFrame([("a", tei), ("b", other), ("c", "<no"), ("d", None)], "ref_id string, tei string")).collect()}
    assert got == {"a": ("10.1/x", "2001", "3", "7", "Lee", "Deep lakes"), "b": ("10.1/y", "", "", "", "", ""), "c": ("",) * 6, "d": ("",) * 6}
    raw = spark.createDataFrame([("a", tei.replace("lakes", "l\xe4kes").encode("latin-1"))], "ref_id string, tei binary")
    assert files.tei_answers(raw).first().article_title == "Deep l�kes"


def test_statistics_of_files(spark, tmp_path):
    (tmp_path / "a_stats.txt").write_text("Total references processed: 34\nTotal matches found: 21\nMatch percentage: 61.76%\n  doi_title: 5 (20.0%)\n")
    (tmp_path / "b_stats.txt").write_text("Total references processed: 0\nTotal matches found: 0\n")
    (tmp_path / "c_stats.txt").write_text("nothing: here\n")
    t = files.stats_texts(spark, str(tmp_path))
    got = dict(rows(files.aggregated(files.stats_counters(t), t)))
    assert got == {"total_references": 34, "matches_found": 21, "query:doi_title": 5, "total_files_attempted": 3, "files_processed": 1, "empty_files": 1, "files_with_errors": 1}


def test_output_problems(spark):
    x = spark.createDataFrame([("a", 200, 600), ("b", None, 600), ("c", 99, 600), ("d", 200, None), ("e", 200, 499)], "source_file string, csv_bytes int, stats_bytes int")
    p = sinks.output_problems(x)
    assert rows(p) == [("b", "CSV missing"), ("c", "CSV empty"), ("d", "Stats missing"), ("e", "Stats too small")]
    assert [r.line for r in sinks.failed_files(p).collect()][:2] == ["Files that failed validation: 4", "b: CSV missing"]


def test_rate_and_retries():
    now, slept = [0.0], []
    sleep = lambda s: (slept.append(s), now.__setitem__(0, now[0] + s))
    b = remote.TokenBucket(2.0, 3, lambda: now[0], sleep)
    for _ in range(7):
        b.take()
    assert now[0] == pytest.approx(2.0)
    answers = [remote.Busy(429), remote.Busy(503, 7), [1]]

    def call():
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    slept.clear()
    assert remote.patiently(call, 3, 5.0, sleep=sleep) == [1] and 4 <= slept[0] <= 6 and 5.6 <= slept[1] <= 8.4
    with pytest.raises(remote.Unavailable):
        remote.patiently(lambda: (_ for _ in ()).throw(remote.Busy(500)), 2, 1.0, sleep=sleep)


def test_remote_lookup(spark):
    def fetch(key):
        if key == "bad":
            raise ValueError("no such key")
        return [("t", key.upper())]

    keys = spark.createDataFrame([("a",), ("a",), ("bad",), (None,)], "doi string")
    assert rows(remote.looked_up(keys, "doi", fetch, "p string, o string", rate=1000, tasks=1, first=0.0).na.fill("")) == [("a", "t", "A", ""), ("bad", "", "", "no such key")]


def test_command_line(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "f.json").write_text(json.dumps({"message": {"reference": [{"DOI": "10.1/a", "year": "1999", "article-title": "Deep lakes", "author": "Lee"}, {"DOI": "10.1/zz"}, {"unstructured": "Roe, “Deep lakes”, 1999. doi:10.1234/a"}]}}))
    (src / "g.json").write_text("{")
    triples = [("br/1", "dcterms:title", "Deep lakes"), ("br/1", "prism:publicationDate", "1999"), ("br/1", "datacite:hasIdentifier", "id/1"), ("id/1", "datacite:usesIdentifierScheme", DOI_SCHEME), ("id/1", "literal:hasLiteralValue", "10.1/a")]
    spark.createDataFrame(triples, "s string, p string, o string").write.parquet(str(tmp_path / "kg"))
    out = tmp_path / "out"
    assert main(["match", str(src), "--graph", str(tmp_path / "kg"), "--output", str(out), "--use-parser"], spark) == 0
    m = files.table_csv(spark, str(out / "matches")).collect()
    assert [(r.reference_id, r.matched_doi, r.score) for r in m] == [("f.json#ref_1", "10.1/a", "30")]
    assert "Total matches: 1" in (out / "aggregate_stats.txt").read_text() and "class='box'" in (out / "report.html").read_text()
    assert "g.json: no readable message" in [r.value for r in spark.read.text(str(out / "failed_files")).collect()]
    assert main(["check-doi", str(src), "--graph", str(tmp_path / "kg"), "--output", str(tmp_path / "doi")], spark) == 0
    for verb in ("compare", "metrics"):
        assert main([verb, str(tmp_path / "doi"), "--matches", str(out / "matches"), "--output", str(tmp_path / verb)], spark) == 0
    got = {r.Metric: r.Value for r in files.table_csv(spark, str(tmp_path / "metrics")).collect()}
    assert (got["True positives"], got["True negatives"], got["Recall"]) == ("1", "1", "100.0")
    assert main(["match", str(tmp_path / "none"), "--graph", "x", "--output", str(out)], spark) == 2


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"threshold": 30, "title_bands": [[90, 12]]}')
    c = config(str(tmp_path / "c.json"), use_doi=False, threshold=None)
    assert (c.threshold, c.title_bands, c.use_doi) == (30, ((90, 12),), False)
    (tmp_path / "d.json").write_text('{"nothing": 1}')
    with pytest.raises(ValueError, match="unknown settings"):
        config(str(tmp_path / "d.json"))
