import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from biblioforge.llm import entitymatch, hotdedup, lookalike, mixing, mojibake, namelink, packing, pii, pii_rows, tokens

CLEAN = ["Größe der Wälder – eine Übersicht", "L’évolution de la forêt à l’été", "¿Cómo influye la señal?", "Устойчивая популяция и вода", "代謝の侵食に関する研究", "Vliv řeka na gęstość łąka", "²⁹Si and NO₃⁻ at 20 °C, TNFα, 5 μm, √2 (n ≥ 3) †", "PAMĚŤ A BĚŽNÁ SŮL", "Fish &amp; chips", "Is it so? Yes", "« Santé » et lésion"]
SHOWN = ["cp1252", "mac_roman", "cp437", "cp1250"]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_is_no_mojibake(text):
    assert mojibake.repair(text) == (text, False, False)


@pytest.mark.parametrize("shown", SHOWN)
@pytest.mark.parametrize("text", CLEAN[:5])
def test_utf8_shown_otherwise_is_restored(text, shown):
    try:
        bad = text.encode().decode(shown)
    except UnicodeDecodeError:
        pytest.skip("bytes without a character")
    out, garbled, _ = mojibake.repair(bad)
    assert garbled and out == text


def test_more_mojibake():
    assert mojibake.repair("Größe".encode().decode("cp1252").encode().decode("cp1252"))[0] == "Größe"
    assert mojibake.repair("Вода и память".encode("cp1251").decode("cp1252"))[0] == "Вода и память"
    assert mojibake.repair("Rôle de la région économique".encode("cp1252").decode("mac_roman"))[0] == "Rôle de la région économique"
    assert mojibake.repair("Tr�bung")[1:] == (True, True) and mojibake.repair("Tr?bung")[1:] == (True, True)
    assert mojibake.repair(None) == (None, False, False) and mojibake.repair("") == ("", False, False)
    assert mojibake.repair("Ã¤" * 50_000)[0] == "ä" * 50_000


@pytest.mark.parametrize("times", [5, 6, 7])
def test_text_garbled_many_times_is_restored(times):
    bad = "Größe der Wälder"
    for _ in range(times):
        bad = bad.encode().decode("latin-1")
    assert mojibake.repair(bad)[:2] == ("Größe der Wälder", True)


def test_long_and_short_escapes_are_part_of_a_run():
    assert mojibake.repair("Gr&Atilde;&para;&Atilde;&Yuml;e")[1] and mojibake.repair("a &CounterClockwiseContourIntegral; b &#9; c")[:2] == ("a &CounterClockwiseContourIntegral; b &#9; c", False)


UTF7 = ["Untersuchungen zur Schwäche und", "Über die Gewässer der künstlichen Trübung", "γ-tubulin wounds 1568–1577", "²⁹Si and NO₃⁻ in 5 µm", "Эволюция почвы в вулкане", "„Größe“ der Wälder", "A água após a estação: região"]


@pytest.mark.parametrize("text", UTF7)
def test_utf7_read_as_ascii_is_restored(text):
    bad = text.encode("utf-7").decode("ascii")
    assert bad != text and mojibake.repair(bad) == (text, True, False)


@pytest.mark.parametrize("text", ["DNA+RNA-based", "CD5+IgM- and CD27+IgA- cells", "EPA+ALA-rich diet", "STEMI+AMI-related", "CKD+AKI-free", "C++ and a+b+c", "Na+/K+-ATPase", "+ACE-I therapy", "CD4+CD25+FoxP3- cells", "https://x.org/?q=Schw+AOQ-che"])
def test_plus_signs_are_no_utf7(text):
    assert mojibake.repair(text)[:2] == (text, False)


def test_utf7_passes_the_prefilter(spark):
    df = spark.createDataFrame([(1, "Schw+AOQ-che", None), (2, "DNA+RNA-based", "Schwache"), (3, "Ertr+AOQ-ge 7, 1568+IBM-1577", "a + b")], "i bigint, t string, u string")
    got = mojibake.garbled(df, "i", ["t", "u"]).collect()
    assert {(r.i, r.field_name, r.repaired, r.lossy) for r in got} == {(1, "t", "Schwäche", False), (3, "t", "Erträge 7, 1568–1577", False)}


chars = st.sampled_from([*"ae sé中ạ", "́", "̣", "̈", "̧", "가", "ᄀ", "ᅡ", "ᆨ", "K", "Å"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(chars, max_size=8), max_size=5))
def test_composition_is_nfc(texts):
    out, flags = lookalike.normalise(pa.array(texts, pa.string()))
    assert out.to_pylist() == [unicodedata.normalize("NFC", x) for x in texts]
    for x, f in zip(texts, flags):
        assert f or x == unicodedata.normalize("NFC", x)


@pytest.mark.parametrize(("text", "want", "flag"), [("Ｄｅｅｐ １", "Deep 1", 1), ("inﬂow", "inflow", 1), ("Mu\u0308ll", "Müll", 2), ("a​b", "ab", 4), ("a\u00a0b", "a b", 8), ("sоlvents", "solvents", 16), ("пpимере", "примере", 16), ("Κälte", "Kälte", 16), ("ɡrief", "grief", 16), ("a\U000e0020b", "ab", 4), ("a\U000e0100b", "ab", 4), ("\U0002f800", "\u4e3d", 2), ("αbout", "about", 16), ("wαter", "water", 16), ("ᎠЕЕР", "ᎠЕЕР", 0), ("Ꭰeep", "Deep", 16)])
def test_variants(text, want, flag):
    out, flags = lookalike.normalise(pa.array([text, None]))
    assert out.to_pylist() == [want, None] and flags.tolist() == [flag, 0]


def test_ordinary_forms_stay():
    texts = ["“a” – b…", "x² H₂O", "5 μm", "α-helix", "Β-AMYLASE", "5 ΜM", "вода", "Δ9-desaturase", "a\nb", "代謝とX", "ΚB-LIKE", "TNFα", "α-tubulin", "κB", "μm", "βIII", "\U00020000"]
    out, flags = lookalike.normalise(pa.array(texts))
    assert out.to_pylist() == texts and not flags.any()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=20), max_size=6))
def test_code_points_round_trip(texts):
    texts = [x.encode("utf-8", "ignore").decode() for x in texts]
    cp, bounds = lookalike.code_points(pa.array(texts, pa.string()))
    assert lookalike.to_arrow(cp, bounds).to_pylist() == texts


NAMES = [["Krülbman", "KRÜLBMAN", "Krulbman", "Kruelbman", "Krübman", "A. Krülbman", "A.Krülbman", "Krülbman A", "Krülbman, Anna", "Krülbman Jr."], ["Stolvek, Chuck", "Charles Stolvek", "C. Stolvek"], ["Stolvek, Ines", "I. Stolvek"], ["van der Zolk", "Zolk, van der", "Zolk R van der", "Vanderzolk"], ["Pilv Institute of Cells and Growth", "The Pilv Institute of Cells and Growth", "Pilv Inst. Cells & Growth", "Institute of Cells and Growth, Pilv", "PICG", "Pilv Institute of Cells and Growth (PICG)"], ["Orvan-Telman", "Telman, Orvan", "Orvan Telman", "Orvantelman"]]


def test_names_link_as_by_hand(spark):
    rows = [(n, 3) for g in NAMES for n in g] + [(None, 1), ("", 1), ("N/A", 1), ("[No author]", 1), ("Krülb​man", 1)]
    df = spark.createDataFrame([(n,) for n, k in rows for _ in range(k)], "name string")
    got = {(r.name_a, r.name_b) for r in namelink.pairs(namelink.entities(df, "name")).collect()}
    assert got == {(a, b) for g in NAMES for a in g for b in g if a < b}
    assert namelink.entities(df.limit(0), "name").count() == 0


def test_edit_and_collision_curve():
    assert [namelink.edit(a, b, 2) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "abd"), ("abc", "xyz"))] == [0, 1, 1, 3]
    b = namelink.bands(0.45, 3)
    assert 1 - (1 - 0.45**3) ** b >= 0.99 > 1 - (1 - 0.45**3) ** (b - 1)


@pytest.mark.parametrize("size", [5, 6, 7, 8, 11])
@pytest.mark.parametrize("kind", ["swap", "drop", "double", "replace"])
def test_typos_meet_in_a_band(kind, size):
    """Recall of the bands by kind of typo and length of the name."""
    rng = np.random.default_rng(size)
    pairs = []
    while len(pairs) < 300:
        w = "".join(rng.choice(list("abcdefghiklmnoprstuvwz"), size))
        i = int(rng.integers(0, size - 1))
        v = {"swap": w[:i] + w[i + 1] + w[i] + w[i + 2 :], "drop": w[:i] + w[i + 1 :], "double": w[:i] + w[i] + w[i:], "replace": w[:i] + "q" + w[i + 1 :]}[kind]
        if v != w and namelink.umlauts(w) == w and namelink.umlauts(v) == v:
            pairs.append((w, v))
    bands = [set(zip(x.band, x.h)) for x in (namelink.banded(pd.DataFrame({"kind": "person", "key": [w], "words": [w]})) for p in pairs for w in p)]
    met = np.mean([bool(bands[2 * i] & bands[2 * i + 1]) for i in range(len(pairs))])
    assert met >= 0.9
    if size > 4:
        assert all(namelink.monge_elkan(a, b) >= namelink.MIN_MONGE_ELKAN for a, b in pairs)


def test_stars_of_a_long_chain(spark):
    nodes = spark.createDataFrame([(f"k{i:02d}", i + 1) for i in range(30)], "key string, n bigint")
    links = spark.createDataFrame([(f"k{i:02d}", f"k{i + 1:02d}") for i in range(29)], "a string, b string")
    got = {r.key: r.centre for r in namelink.stars(nodes, links).collect()}
    assert len(got) == 30 and all(abs(int(k[1:]) - int(c[1:])) <= 1 for k, c in got.items())


DOIS = ["10.1000/Ab(1)-2", "https://doi.org/10.1000/ab(1)-2", "DOI 10.1000/AB(1)-2.", "<10.1000/ab%281%29-2>", "10.1000 /ab(1)‐2;", "info:doi/10.1000\\/ab(1)-2", "(http://dx.doi.org/10.1000/ab(1)-2)", "\t10.1000/ab(1)-2 .]", "&quot;10.1000/ab(1)-2&quot;", "&#39;10.1000&#47;ab(1)-2&#x27;", "&amp;lt;10.1000/ab(1)-2&gt;"]


def test_canonical_doi(spark):
    df = spark.createDataFrame([(x,) for x in [*DOIS, "10.1000/ab-1-2", "", " ", ".", "N/A", None, "10.1/" + "x" * 100_000]], "d string")
    got = [r[0] for r in df.select(hotdedup.canonical_doi(F.col("d"))).collect()]
    assert got[: len(DOIS)] == ["10.1000/ab(1)-2"] * len(DOIS) and got[len(DOIS) : -1] == ["10.1000/ab-1-2", None, None, None, None, None] and len(got[-1]) == 100_005


@pytest.mark.parametrize("hot", [3, 10_000])
def test_duplicates(spark, hot):
    """Hot keys are a table of any length: with ``hot`` 3 nearly every key is one."""
    rows = [(i, "f" if i % 2 else "g", f"10.1/{'HOT' if i % 3 == 0 else i // 4}", i) for i in range(60)] + [(100, None, "10.1/hot", 0), (101, "f", None, 0)]
    df = spark.createDataFrame(rows, "id bigint, f string, d string, keep_id int")
    seen, want = {}, set()
    for i, f, d, _ in rows[:60]:
        k = (f, d.lower())
        if k in seen:
            want.add((seen[k], i))
        seen.setdefault(k, i)
    got = hotdedup.duplicates(df, "id", "f", hotdedup.canonical_doi(F.col("d")), hot_rows=hot, salts=4)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    c = hotdedup.collapsed(df, "id", hotdedup.canonical_doi(F.col("d")), hot_rows=hot)
    assert c.agg(F.sum("n_copies")).first()[0] == 61 and c.where("canonical_key = '10.1/hot'").first().keep_id == 0


@pytest.mark.parametrize("hot", [2, 10_000])
def test_collapsed_within_files_of_both_tables(spark, hot):
    rows = [("bib_reference", "f", 1, "10.1/a"), ("bib_reference", "f", 2, "doi:10.1/A"), ("bib_reference", "g", 3, "10.1/a"), ("matches", "f", 1, "10.1/a"), ("matches", "f", 2, "10.1/a"), ("matches", None, 3, "10.1/a"), ("matches", "g", 4, None)]
    df = spark.createDataFrame(rows, "table_name string, source_file string, id bigint, d string")
    got = hotdedup.collapsed(df, "id", hotdedup.canonical_doi(F.col("d")), hot_rows=hot, within=("table_name", "source_file"))
    assert sorted(map(tuple, got.collect())) == [("bib_reference", "f", "10.1/a", 1, 2), ("bib_reference", "g", "10.1/a", 3, 1), ("matches", "f", "10.1/a", 1, 2)]


BIB = "ref_row_id bigint, source_file string, reference_id string, doi string, article_title string, first_author_lastname string, year string, first_page string"
KG = "br string, title string, pub_date string, author_name string, start_page string"


def test_entity_match(spark):
    rows = [(1, "f", "r1", None, "Deep lakes of Valonidex: II. Results", "Krülbman, A.", "2001", "17", "x"), (2, "g", "r1", ".", "Deep laeks of Valonidex", "Krulbman", "2002", "", "x"), (3, "h", "r1", "10.1/x", "Deep lakes of Valonidex", "Krülbman", "2001", "17", "x"), (4, "h", "r2", "", "Deep lakes of Gepronisax", "Other", "1990", "5", "x"), (5, None, None, None, None, None, None, None, "x"), (6, "h", None, None, "Deep lakes of Valonidex", "Krülbman", "1987", "400", "x")]
    bib = spark.createDataFrame(rows, BIB + ", br string")
    kg = spark.createDataFrame([("br/1", "Deep Lakes of Valonidex (II)", "2001-05", "Krülbman", "17"), ("br/1", "Deep Lakes of Valonidex (II)", "2001-05", "Second", "17"), *[(f"br/{i}", f"Shallow soil in Mogilox{i} and more", "1999", f"Name{i}", str(i)) for i in range(10, 40)], ("br/9", None, None, None, None)], "br string, title string, pub_date string, author_name string, start_page string")
    got = entitymatch.matched(entitymatch.read_refs(bib), entitymatch.read_resources(kg)).collect()
    assert {(r.id, r.br) for r in got} == {(1, "br/1"), (2, "br/1")} and all(0 <= r.confidence <= 1 for r in got)
    assert entitymatch.matched(entitymatch.read_refs(bib.limit(0)), entitymatch.read_resources(kg)).count() == 0
    assert entitymatch.matched(entitymatch.read_refs(bib), entitymatch.read_resources(kg.limit(0)), entitymatch.read_labelled(bib, kg.withColumn("doi", F.lit("10.1/x")).limit(0))).count() == 0


def test_long_titles_and_lost_characters(spark):
    long = " ".join(f"word{i}" for i in range(5_000))
    bib = spark.createDataFrame([(1, "f", "r1", None, long, "Lee", "2001", "7"), (2, "f", "r2", None, "Fr?a inversi�n en Kocotibones", "Roe", "1999", "5")], BIB)
    kg = spark.createDataFrame([("br/1", long.upper(), "2001", "Lee", "7"), ("br/2", "Fría inversión en Kocotibones", "1999", "Roe", "5"), ("br/3", "Other", "1999", "Roe", "6")], KG)
    got = entitymatch.matched(entitymatch.read_refs(bib), entitymatch.read_resources(kg)).collect()
    assert {(r.id, r.br) for r in got} == {(1, "br/1"), (2, "br/2")}


def test_labelled_sample_reads_the_references_once(spark):
    rows = [(k, "f", f"r{k}", f"10.1/{k}", f"Title {k}", "Lee", "2001", str(k)) for k in range(200)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    bib = spark.createDataFrame(rows, BIB).mapInArrow(counted, BIB)
    kg = spark.createDataFrame([(f"br/{k}", f"10.1/{k}") for k in range(0, 200, 2)], "br string, doi string")
    got = entitymatch.read_labelled(bib, kg, 20).select("id", "truth").collect()
    assert read.value == 200
    first = {k for (k,) in spark.createDataFrame(rows, BIB).orderBy(F.xxhash64("ref_row_id", F.lit(3))).limit(40).select("ref_row_id").collect()}
    assert len(got) == min(20, sum(k % 2 == 0 for k in first)) and all(r.id in first and r.truth == f"br/{r.id}" for r in got)


def test_plain_titles_read_as_folded_ones_and_repeated_words_count():
    for t in ("It`s a `Deep' lake", "Deep_lakes: and (rivers)", "A deep deep lake II", "Études of deep ﬁelds"):
        c, _ = entitymatch.clean_title(t)
        assert c == " ".join(entitymatch._WORD.findall(namelink.fold(c))) and sum(entitymatch.words_of(c).values()) == sum(len(w) > 1 for w in c.split())
    assert entitymatch.words_of("deep deep lake") == {"deep": 2, "lake": 1} and entitymatch.words_of("深い湖 ab") == {"深い": 1, "い湖": 1, "ab": 1}


WORDS = "deep lakes rivers and of growth wounds stems leaves erosion drought memory lipids toxins".split()


def _brute(q: list[dict], d: list[dict], w: entitymatch.Weights) -> set[tuple[int, str]]:
    """Pairs within GAP of their query's best above the bounds, by scoring every pair."""
    out = set()
    for x in q:
        rows = []
        for y in d:
            _, share, *_, page, year, _, fits = entitymatch.measure(x, y, w)
            if page >= 0 and year >= 0:
                rows.append((share, page, y["d"]))
        rows = [r for r in rows if r[0] >= (entitymatch.KEEP_PAGE if r[1] == 1 else entitymatch.KEEP_OTHER)]
        top = max((r[0] for r in rows), default=0)
        out |= {(x["q"], r[2]) for r in rows if r[0] >= top - entitymatch.GAP + 1e-3}
    return out


def test_retrieval_loses_nothing_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    title = lambda k: " ".join([*rng.choice(WORDS, 4), f"place{k}von"])
    year = lambda: None if rng.random() < 0.2 else str(rng.integers(1990, 1994))
    page = lambda: None if rng.random() < 0.4 else str(rng.integers(1, 6))
    name = lambda: None if rng.random() < 0.1 else f"Zolkman{rng.integers(0, 5)}"
    kg = [(f"br/{k}", title(k % 60), year(), name(), page()) for k in range(150)]
    bib = []
    for k in range(150):
        t, y, a, p = kg[k][1], kg[k][2], kg[k][3], kg[k][4]
        t = t.replace("von", "vn") if k % 7 == 0 else t
        bib.append((k, f"f{k}", f"ref_{k}", None, t, a if k % 5 else name(), str(int(y) + 1) if y and k % 6 == 0 else y, p if k % 4 else None))
    res = entitymatch.store(entitymatch.read_resources(spark.createDataFrame(kg, KG)).withColumn("d", F.monotonically_increasing_id()))
    w, index = entitymatch.statistics(res)
    w.w = {s: k for s, k in w.w.items() if not s.startswith("t:place")}  # the others' way is taken too
    w.words = {s: k for s, k in w.words.items() if not s.startswith("place")}
    q = entitymatch.store(entitymatch._with_rare(entitymatch.read_refs(spark.createDataFrame(bib, BIB)).withColumn("q", F.col("id")), index, w))
    got = {(r.q, r.d) for r in entitymatch._candidates(q, res, w).collect()}
    want = _brute([r.asDict(recursive=True) for r in q.collect()], [r.asDict(recursive=True) for r in res.collect()], w)
    assert len(want) > 100 and want <= got


def test_fit_finds_coefficients_and_keeps_the_prior_without_pairs():
    rng = np.random.default_rng(5)
    x = np.c_[np.ones(2000), rng.random((2000, len(entitymatch.FEATURES) - 1))]
    true = np.linspace(-2, 2, x.shape[1])
    y = (rng.random(2000) < 1 / (1 + np.exp(-x @ true))).astype(float)
    got = entitymatch.fit(x, y, np.zeros(x.shape[1]), 1e-6)
    assert np.abs(1 / (1 + np.exp(-x @ got)) - 1 / (1 + np.exp(-x @ true))).mean() < 0.05
    assert (entitymatch.fit(x[:0], y[:0]) == entitymatch.PRIOR).all()


def test_page_of_other_works_costs_no_pageless_resource(spark):
    bib = spark.createDataFrame([(1, "f", "ref_1", None, "Deep lakes and rivers of Valonidex", "Krülbman", "2001", "17")], BIB)
    other = [(f"br/{i}", "Deep lakes and rivers of Valonidex", "1950", f"Name{i}", str(100 + i)) for i in range(10, 50)]
    hot = [("br/2", "Growth of wounds", "1990", "Krülbman", "17"), ("br/3", "Stems and leaves", "2001", "Other", "17")]
    kg = spark.createDataFrame([("br/1", "Deep lakes and rivers of Valonidex", "2001-05", "Krülbman", None), *hot, *other], "br string, title string, pub_date string, author_name string, start_page string")
    got = entitymatch.matched(entitymatch.read_refs(bib), entitymatch.read_resources(kg)).collect()
    assert [(r.id, r.br) for r in got] == [(1, "br/1")] and got[0].confidence >= entitymatch.MIN_CONFIDENCE


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 250), min_size=1, max_size=80), st.integers(20, 100))
def test_packing(sizes, capacity):
    out = packing.assign(np.arange(len(sizes)), np.array(sizes), capacity)
    assert (out.groupby("container_no").n_tokens.sum() <= capacity).all()
    assert out.groupby("doc_id").n_tokens.sum().tolist() == sizes
    many = out.groupby("doc_id").size()
    assert all(sizes[d] > capacity for d in many[many > 1].index)


def test_packing_wastes_little():
    rng = np.random.default_rng(1)
    s = rng.integers(1, 400, 5000)
    out = packing.assign(np.arange(5000), s, 512)
    assert 1 - s.sum() / (512 * out.container_no.nunique()) < 0.02


def test_packed_and_mixed(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "w " * (i % 50)) for i in range(400)] + [(900, None, None), (None, "a", "x")], "doc_id bigint, source string, text string")
    sized = tokens.sized(docs, "doc_id", "text", "source")
    caps = spark.createDataFrame([("s", 64), ("n", None)], "size_name string, capacity_tokens int")
    p = packing.packed(sized.select("doc_id", "n_tokens"), caps, group_docs=100)
    assert p.select("doc_id").distinct().count() == 401 and p.groupBy("container").agg(F.sum("n_tokens").alias("t")).agg(F.max("t")).first()[0] <= 64
    target = spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 1), ("none", 0.1, 1)], "source string, target_share double, max_repeat int")
    mix = mixing.mixed(sized, target)
    sh = {r.source: r for r in mixing.shares(mix, target).collect()}
    assert abs(sh["a"].actual_share - 0.7) < 0.02 and sh["a"].most_uses <= 2 and sh["b"].most_uses <= 1 and sh["none"].n_tokens == 0
    assert mixing.mixed(sized.limit(0), target).count() == 0


def test_pii_held_out():
    model, hit, miss, false = pii.train(), 0, 0, 0
    for row in pii_rows.labelled(2, seed=77):
        text, at, want = "".join(x for x, _ in row), 0, set()
        for x, k in row:
            want |= {(at, k)} if k != "O" else set()
            at += len(x)
        got = {(s, k) for s, _, k in pii.spans(model, [text])[0]}
        hit, miss, false = hit + len(want & got), miss + len(want - got), false + len(got - want)
    assert hit / (hit + miss) > 0.95 and hit / (hit + false) > 0.95


def test_pii_tables(spark):
    text = "We thank Olga Stolmann for reading the draft. Tel. +44 20 7946 0123; fax on request."
    df = spark.createDataFrame([(1, text, "k"), (2, None, "k"), (3, "", "k"), (1, text, "k"), (4, "As Stolmann argued, lakes may follow from tides. " * 2000, "k")], "doc_id bigint, text string, pii_type string")
    rows = pii.found(df).collect()
    assert sorted((r.doc_id, r.pii_type, r.start_pos) for r in rows) == [(1, "name", 10), (1, "name", 10), (1, "phone", 52), (1, "phone", 52)]
    assert pii.redacted(df).where("doc_id = 1").first().text == "We thank [NAME] for reading the draft. Tel. [PHONE]; fax on request."
    assert pii.found(df.limit(0)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000))
def test_viterbi_is_the_best_path(seed):
    rng = np.random.default_rng(seed)
    size = rng.integers(1, 5, 4)
    em, tr, start = rng.normal(size=(size.sum(), 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    bounds = np.r_[0, np.cumsum(size)]
    got = pii.viterbi(em, tr, start, bounds)
    for a, b in zip(bounds, bounds[1:]):
        paths = np.array(np.meshgrid(*[range(3)] * (b - a))).reshape(b - a, -1).T
        score = [start[p[0]] + em[np.arange(a, b), p].sum() + tr[p[:-1], p[1:]].sum() for p in paths]
        assert got[a:b].tolist() == paths[int(np.argmax(score))].tolist()
