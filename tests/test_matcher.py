import re
import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from biblioforge.config import MatchConfig
from biblioforge.functions import fuzzy
from biblioforge.functions import native as N
from biblioforge.operators import resolve, scoring
from biblioforge.operators import strategies as S
from biblioforge.plans import matching

CFG = MatchConfig()


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize(("v", "want"), [("10.1/X", "10.1/x"), ("DOI:10.1/x", "10.1/x"), ("doi:https://doi.org/10.1/x", "https://doi.org/10.1/x"), ("10.1\\/x", "10.1/x"), ("", ""), ("  ", "  "), (None, None)])
def test_norm_doi(spark, v, want):
    assert one(spark, v, N.norm_doi) == want


def test_norm_doi_eval(spark):
    assert one(spark, "doi:https://doi.org/10.1/x", N.norm_doi_eval) == "10.1/x"


@pytest.mark.parametrize(("v", "want"), [("", None), (None, None), (" 2001 ", 2001), ("1699", None), ("2001a", None), ("c. 2001", 2001), ("+5", None)])
def test_year(spark, v, want):
    assert one(spark, v, N.extract_year) == want


@pytest.mark.parametrize(("v", "want"), [("007", "7"), ("0", ""), (None, None)])
def test_page_key(spark, v, want):
    assert one(spark, v, N.page_key) == want


def test_titles(spark):
    assert one(spark, "A – B?!", N.norm_title) == "a - b"
    assert one(spark, "α-synuclein…", N.norm_title) == "alpha-synuclein"
    assert one(spark, "On the way to Rome", N.title_pattern) == ""
    assert one(spark, "x" * 600, N.clean_literal) == "x" * 600
    assert one(spark, "Deep (water) rocks", N.title_pattern) == r"Deep.*\(water\).*rocks"


@pytest.mark.parametrize(("v", "want"), [("Straße nach Ørsted", "strasse nach orsted"), ("Вода и память", "voda i pamiat"), ("e\u0301tude\u00a0H₂O", "etude h2o"), ("Ｄｅｅｐ", "deep"), ("Φύσις", "phusis")])
def test_titles_are_spelt_in_ascii(spark, v, want):
    assert one(spark, v, N.norm_title).replace("u044c", "") == want


def test_citation_text(spark):
    df = spark.createDataFrame([(b"a\xff b",), ("c\ufffdd".encode(),), (None,)], "v binary")
    assert [r.o for r in df.select(N.citation_text(F.col("v").cast("string")).alias("o")).collect()] == ["a b", "c\ufffdd", None]


def test_titles_of_other_scripts_are_equal_to_themselves_only(spark):
    a, b = one(spark, "代謝の侵食", N.norm_title), one(spark, "水と記憶", N.norm_title)
    assert a and b and a != b and a == one(spark, "代謝の侵食。", N.norm_title)


@pytest.mark.parametrize(("v", "want"), [("Smith, J", "Smith"), ("J Smith", "Smith"), ('[{"family": "Lee"}]', "Lee"), ('[{"name": "Ng, A"}]', "Ng"), ('["Roe, B"]', "Roe"), ('{"family-name": "Poe"}', "Poe"), (None, None)])
def test_author_of(spark, v, want):
    assert one(spark, v, N.author_of) == want


texts = st.text("ab c", max_size=12)


@given(texts, texts)
def test_similarities(a, b):
    for f in (fuzzy.ratio, fuzzy.partial_ratio, fuzzy.token_sort_ratio, fuzzy.token_set_ratio, fuzzy.similarity):
        assert 0 <= f(a, b) <= 100
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    assert fuzzy.lcs(a, b) == n[-1][-1]
    assert fuzzy.similarity(a, a) == 100


REF = dict(ref_id="r", year="2001", volume="3", first_page="007", first_author_lastname="Müller", article_title="Deep water rocks", volume_title="", journal_title="", doi="10.1/x")


def frames(spark, cand, **over):
    refs = spark.createDataFrame([tuple({**REF, **over}.values())], list(REF))
    kg = spark.createDataFrame(cand, "br string, title string, pub_date string, doi string, author_name string, volume_num string, start_page string, end_page string")
    return S.prepare(refs), kg


FULL = ("br/1", "Deep water rocks", "2001-05", "10.1/x", "müller", "3", "7", "9")


def test_full_score(spark):
    r, kg = frames(spark, [FULL])
    s = scoring.score(S.all_candidates(r, kg), CFG)
    w = resolve.winners(s, CFG).first()
    assert (w.score, w.query_type, CFG.max_score) == (48, "year_and_doi", 48)


def test_no_doi_blocking_still_scores_dois(spark):
    r, kg = frames(spark, [(*FULL[:4], "Müller", *FULL[5:])])
    w = resolve.winners(scoring.score(S.all_candidates(r, kg, MatchConfig(use_doi=False)), CFG), CFG).first()
    assert (w.score, w.query_type) == (48, "author_title")


@pytest.mark.parametrize("n", [1, 7, 20])
def test_ties_are_stable(spark, n):
    r, kg = frames(spark, [(f"br/{i}", *FULL[1:]) for i in range(5)])
    assert resolve.winners(scoring.score(S.all_candidates(r, kg.repartition(n)), CFG), CFG).first().br == "br/0"


@pytest.mark.parametrize(("score", "ok"), [(23, False), (24, True), (25, True), (26, True)])
def test_acceptance(spark, score, ok):
    assert bool(resolve.accepted(spark.createDataFrame([(score,)], "score int"), CFG).count()) == ok


@pytest.mark.parametrize(("sim", "points"), [(100, 14), (96, 13), (95, 13), (90, 12), (85, 11), (80, 10), (76, 10), (75, 0)])
def test_title_bands(spark, sim, points):
    assert spark.range(1).select(scoring.title_points(F.lit(sim), CFG).alias("p")).first().p == points


def test_fuzzy_title_and_unmatched(spark):
    r, kg = frames(spark, [("br/1", "Deep water rocks and sands", "2009", None, "Müller", None, None, None)], doi="", first_page="")
    s = scoring.score(S.all_candidates(r, kg), CFG, fuzzy_titles=True)
    assert resolve.winners(s, CFG).first().score == 7 + 14  # the shorter title is part of the other
    empty = resolve.winners(scoring.score(S.all_candidates(r.limit(0), kg), CFG), CFG)
    assert empty.count() == 0


WIDE = ["  Müller\u00a0 Ö", "ÉCOLE\u2009\u3000X ", "Smith\tJ", "ΟΔΟΣ", "İnan", "Поляков\u2028А", "\u202fNg", "A\x85B", "C\x1fD", "", " ", None, "e\u0301tude <b>|\u00a0x^`", "中\u3000文", "é" * 1200]


def test_authors_and_literals_of_all_rows(spark, tmp_path):
    spark.createDataFrame([(i, v, v) for i, v in enumerate(WIDE)], "ref_row_id bigint, first_author_lastname string, article_title string").write.parquet(f"{tmp_path}/bib_reference.parquet")
    author = lambda v: None if v is None else " ".join(v.lower().split())
    literal = lambda v: None if v is None else " ".join(re.sub(r"[\x00-\x1f\x7f<>{}|^`]", " ", unicodedata.normalize("NFC", v)).split())[:1000]
    got = {r[0]: r[1] for r in matching.QUERIES["norm_author"](spark, str(tmp_path)).collect()}
    assert got == {i: author(v) for i, v in enumerate(WIDE)}
    got = {r[0]: r[1] for r in matching.QUERIES["clean_literal"](spark, str(tmp_path)).collect()}
    assert got == {i: literal(v) for i, v in enumerate(WIDE)}


@pytest.mark.parametrize(("name", "rows"), [("unnest_props", 6), ("pivot_properties", 1), ("observed_predicates", 1)])
def test_properties_of_all_resources(spark, name, rows):
    d = "/root/testdata/sf0.001"
    got = matching.QUERIES[name](spark, d)
    n = spark.read.parquet(f"{d}/orders.parquet").count()
    assert got.count() == rows * n and got.select("br").distinct().count() == n


RAW = "ref_id string, year string, volume string, first_page string, first_author_lastname string, article_title string, volume_title string, journal_title string, doi string, unstructured string"


def graph_of(spark, *rows):
    return spark.createDataFrame(rows, "br string, title string, pub_date string, doi string, author_name string, volume_num string, start_page string, end_page string")


def test_titles_of_different_scripts_are_no_match(spark):
    r = S.prepare(spark.createDataFrame([("r", "1999", "3", "7", "", "代謝の侵食", "", "", "", "")], RAW))
    kg = graph_of(spark, ("br/1", "Вода и память", "1999", None, None, "3", "7", None))
    w = resolve.winners(scoring.score(S.all_candidates(r, kg, CFG), CFG, fuzzy_titles=True), CFG)
    assert w.first().title_sim < 100 and resolve.accepted(w, CFG).count() == 0


def test_the_best_of_three_titles_counts(spark):
    r = S.prepare(spark.createDataFrame([("r", "1999", "3", "7", "", "Something else", "", "Deep lakes", "", "")], RAW))
    kg = graph_of(spark, ("br/1", "Deep Lakes.", "1999", None, None, "3", "7", None), ("br/2", "???", "1999", None, None, "3", "7", None))
    for fuzzy_titles in (False, True):
        w = resolve.winners(scoring.score(S.all_candidates(r, kg, CFG), CFG, fuzzy_titles), CFG).first()
        assert (w.br, w.title_sim, w.score) == ("br/1", 100, 14 + 1 + 3 + 8)


def test_hot_authors_lose_no_pair(spark, monkeypatch):
    titles = ["Deep water rocks", "DEEP (water) and rocks", "On it", "Shallow waters", "Rocks of the deep water", None]
    refs = S.prepare(spark.createDataFrame([(f"r{i}", "1999", "", "", a, t or "", "", "", "", "") for i, t in enumerate(titles) for a in ("Hot", "Cold")], RAW))
    kg = graph_of(spark, *[(f"br/{i}", t, "1999", None, a, None, None, None) for i, t in enumerate(titles) for a in ("Hot", "Cold")])
    found = lambda: sorted((r.ref_id, r.br, r.author_name) for r in S.generate(refs, kg, S.STRATEGIES[2], CFG).collect())
    plain = found()
    monkeypatch.setattr(S, "HOT_AUTHOR", 3)
    assert len(plain) > 10 and found() == plain


def test_cascade(spark):
    cite = "Roe, “Deep lakes and rivers”, 1999, 7–9. doi:10.1234/a"
    refs = spark.createDataFrame([("a", "1999", "", "", "Lee", "Deep lakes and rivers", "", "", "10.1234/a", ""), ("b", "", "", "", "", "", "", "", "", cite), ("c", "1999", "", "", "", "", "", "", "", "Roe, nothing"), ("d", "1950", "", "", "", "Deep lakes and rivers", "", "", "10.1234/a", "")], RAW)
    kg = graph_of(spark, ("br/1", "Deep lakes and rivers", "1999", "10.1234/a", "Lee", "3", "7", "9"))
    won, report = resolve.cascade(refs, kg, CFG)
    assert {(r.ref_id, r.pass_no, r.score) for r in won.collect()} == {("a", 1, 37), ("b", 2, 30), ("d", 1, 29)}
    r = report.first()
    assert report.count() == 1 and (r.ref_id, r.score_original, r.score_enriched, r.best_score, r.enrichment_attempted, r.threshold_failed) == ("c", 0, None, None, "No", "No")
    from biblioforge.sources import sinks

    u = sinks.unmatched(report, refs)
    assert len(u.columns) == 16 and (u.first().score_original, u.first().score_after_grobid, u.first().grobid_attempted) == ("0", "N/A", "No")
    n = resolve.pass_counts(refs, won, report).first()
    assert (n.n_references, n.n_pass_1, n.n_pass_2, n.n_attempts, n.n_successes, n.n_unmatched) == (4, 2, 1, 2, 1, 1)
    empty = resolve.cascade(refs.limit(0), kg, CFG)
    assert empty[0].count() == 0 and empty[1].count() == 0


def crowd(spark, n=40):
    """References and candidates that all share year, volume and page, with a few differences that points and ties turn on."""
    titles = ["Deep water rocks", "Deep water rocks and sands", "Shallow lakes", "", "Deep WATER rocks."]
    refs = spark.createDataFrame([(f"r{i}", "1999", "3", "7" if i % 3 else "07", ["Lee", "lee", "Ng", ""][i % 4], titles[i % 5], "", titles[(i + 2) % 5], f"10.1/{i}" if i % 6 == 0 else "", "") for i in range(n)], RAW)
    kg = graph_of(spark, *[(f"br/{i:03}", titles[i * 3 % 5] or None, f"{1998 + i % 3}-01", f"10.1/{i}" if i % 2 else None, ["Lee", "Ng", None][i % 3], "3" if i % 7 else "4", "7", None) for i in range(n)])
    return S.prepare(refs), kg


@pytest.mark.parametrize(("cfg", "fuzzy_titles", "early_stop"), [(CFG, True, True), (MatchConfig(author_edge="reference"), False, True), (MatchConfig(threshold=12), True, False)])
def test_best_is_the_winner_of_all_candidates(spark, cfg, fuzzy_titles, early_stop):
    refs, kg = crowd(spark)
    rows = lambda d: sorted((r.ref_id, r.br, r.query_type, r.score, r.title_sim) for r in d.collect())
    want = rows(resolve.winners(scoring.score(S.all_candidates(refs, kg, cfg), cfg, fuzzy_titles), cfg, early_stop))
    assert len(want) > 20 and rows(resolve.best(refs, kg, cfg, fuzzy_titles, early_stop)) == want


def test_pairs_are_not_stored(spark, monkeypatch):
    refs, kg = crowd(spark, 60)
    seen = []

    def store(df):
        seen.append((out := keep(df)).count())
        return out

    keep = S.store
    for module in (S, scoring, resolve):
        monkeypatch.setattr(module, "store", store)
    assert S.all_candidates(refs, kg, CFG).count() > 1000
    assert resolve.best(refs, kg, CFG).count() == 50 and seen and max(seen) <= 60


def test_no_side_of_the_pairs_goes_through_the_driver(spark):
    refs, kg = crowd(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        for df in (S.all_candidates(refs, kg, CFG), matching._refs(spark, "/root/testdata/sf0.001"), resolve.best(refs, kg, CFG)):
            assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
