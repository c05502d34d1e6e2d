"""Variant spellings of one person or organisation, linked to each other.

1. Each different spelling is read once: surname key, given names, or the words of an organisation in one
   order. Letter case, accents (``ö``, ``oe`` and ``o`` alike), particles' places, glued or hyphenated double
   surnames and the usual abbreviations fall away here.
2. Keys that differ by typos meet through MinHash bands over padded q-grams. The number of bands follows
   from the collision curve ``1 - (1 - s^r)^b`` for a wanted recall at the similarity that one typo leaves:
   a swap leaves a third of the q-grams of five letters and 0.45 of those of seven, so short keys have bands
   of two hashes and long ones of three; keys of seven letters have both.
3. Candidates are verified by Monge-Elkan similarity over their words, with edit distance (neighbouring
   letters may swap) as the inner measure.
4. Verified links are cut into stars: in rounds, a key that outweighs all its free neighbours becomes a
   centre and takes them. So a typo joins its source, and chains of typos don't drag names together.
5. Within a star, given names part people who share a surname: full names apart, initials and nicknames to
   the full name they fit, bare surnames to the only person there.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, store
from . import lookalike

RECALL = 0.99  # wanted chance to meet
#: (fewest letters, most letters, hashes a band, what one typo leaves of the q-grams)
SCHEMES = ((1, 7, 2, 1 / 3), (7, None, 3, 0.45))
MIN_MONGE_ELKAN = 0.8

#: Short forms of given names.
NICKNAMES = {
    "andy": "andrew", "beppe": "giuseppe", "bill": "william", "bob": "robert", "chuck": "charles", "dick": "richard", "fred": "frederick", "hans": "johannes",
    "jim": "james", "kate": "catherine", "kathe": "katharina", "kolya": "nikolai", "liz": "elizabeth", "ned": "edward", "paco": "francisco", "peggy": "margaret",
    "sam": "samuel", "sasha": "aleksandr", "sole": "soledad", "steff": "stefan", "ted": "theodore", "thea": "dorothea", "trish": "patricia", "vic": "victor",
    "dan": "daniel", "tom": "thomas", "mike": "michael", "joe": "joseph", "tony": "anthony", "kitty": "catherine", "pepe": "jose", "gabe": "gabriel", "rafa": "rafael",
    "misha": "mikhail", "vanya": "ivan", "katya": "ekaterina", "lena": "elena", "uli": "ulrike", "moni": "monika", "toni": "anton", "rob": "robert", "will": "william",
}
#: Particles of surnames, kinds of organisation by their short forms, and what stands for no name.
PARTICLES = ("van der", "van den", "van de", "von der", "de la", "de los", "della", "van", "von", "del", "de", "di", "da", "dos", "du", "la", "le", "ter", "ten", "zu", "al", "el")
KINDS = {"inst": "institute", "dept": "department", "lab": "laboratory", "assoc": "association", "consort": "consortium", "soc": "society", "univ": "university", "acad": "academy", "cent": "centre", "center": "centre", "grp": "group", "comm": "committee", "org": "organisation", "fed": "federation", "natl": "national", "intl": "international"}
_KIND_WORDS = set(KINDS) | set(KINDS.values()) | {"network", "collaboration", "council", "agency", "ministry", "foundation", "bureau", "office", "commission", "college", "school", "hospital", "museum", "observatory"}
PLACEHOLDERS = {"anonymous", "anon", "no author", "n/a", "na", "et al", "none", "null", "nan", "unknown", "various", "author unknown", "no name", "n.n", "s.n", "others", "and others", "not available", "tba", "test"}

_FOLD = str.maketrans({"ø": "o", "œ": "o", "æ": "a", "ß": "ss", "ł": "l", "đ": "d", "ı": "i", "ð": "d", "þ": "th", "’": "'", "‘": "'", "`": "'", "´": "'", "–": "-", "‐": "-", "‑": "-", "−": "-"})
_PART = re.compile(r"^(?:" + "|".join(PARTICLES) + r")$")
_INITIALS = re.compile(r"^(?:[^\W\d_]\.?-?){1,4}$")
_SUFFIX = re.compile(r",?\s+(?:jr|sr|ii|iii|iv|phd|md)\.?$", re.I)
_ACRONYM = re.compile(r"^([^\W\d_]{2,5})(?:-([^\W\d_]{2,4}))?$")


def bands(similarity: float, rows: int, recall: float = RECALL) -> int:
    """Bands of ``rows`` hashes so that pairs of that similarity meet with that chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


class _Folded(dict):
    """What each character becomes, worked out once."""

    def __missing__(self, c: int) -> str:
        s = unicodedata.normalize("NFKD", chr(c).translate(_FOLD))
        self[c] = out = "".join(x for x in s if not unicodedata.combining(x)).translate(_FOLD)
        return out


_FOLDED = _Folded()


def fold(s: str) -> str:
    """Lower case without accents."""
    return s.lower().translate(_FOLDED)


def umlauts(s: str) -> str:
    """``ae``, ``oe``, ``ue`` as the letters of their umlauts; beside the plain form, since typos make such pairs too."""
    return re.sub("([aou])e", r"\1", s)


def _letters(s: str) -> str:
    return "".join(c for c in s if c.isalnum())


def parse(name: str) -> dict[str, str] | None:
    """Reading of a spelling; None for blanks and placeholders."""
    s = unicodedata.normalize("NFC", " ".join(name.split()))
    f = re.sub(r"\s+", " ", s.lower()).strip(" .[]()<>-–—")
    if not any(c.isalpha() for c in s) or f in PLACEHOLDERS:
        return None
    out = dict.fromkeys(("kind", "key", "words", "pair", "given", "initial", "acronym", "suffix"), "")
    m = _ACRONYM.match(s)
    if m and s == s.upper() and (m[2] or len(s) <= 5):
        return out | {"kind": "acronym", "key": fold(s), "words": fold(s), "acronym": fold(m[1]), "suffix": fold(m[2] or "")}
    tail = re.search(r"\s*\(([^()]*)\)\s*$", s)
    words = re.findall(r"[^\W_]+", s[: tail.start()] if tail else s)
    if " & " in s or any(w.lower().rstrip(".") in _KIND_WORDS for w in words) and len(words) > 2:
        body = s[: tail.start()] if tail else s
        if "," in body:
            a, _, b = body.rpartition(",")
            body = f"{b} {a}"
        toks = [KINDS.get(w.lower(), w.lower()) for w in re.findall(r"[^\W_]+", body)]
        toks = [fold(w) for w in toks if w not in ("of", "and", "the", "for", "in", "on")]
        return out | {"kind": "org", "key": "".join(sorted(toks)), "words": " ".join(sorted(toks)), "acronym": "".join(w[0] for w in toks), "suffix": toks[0][:3] if toks else ""}
    s = _SUFFIX.sub("", s)
    s = re.sub(r"^((?:[^\W\d_]\.)+)(?=[^\W\d_]{2})", r"\1 ", s)  # initials glued to the surname
    if "," in s:
        sur, _, giv = s.partition(",")
        sur, giv = sur.split(), giv.split()
    else:
        toks = s.split()
        lead = 0
        while lead < len(toks) - 1 and _INITIALS.match(toks[lead]) and ("." in toks[lead] or len(toks[lead]) == 1):
            lead += 1
        if lead == 1 and toks[0] in ("O", "D", "M", "L"):  # an apostrophe became a space
            toks, lead = [toks[0] + "'" + toks[1], *toks[2:]], 0
        end = len(toks)
        if end - lead > 2 and _PART.match(" ".join(toks[end - 2 :]).lower()):
            end -= 2
        elif end - lead > 1 and _PART.match(toks[-1].lower()) and not (toks[-1].isupper() and len(toks[-1]) < 4):
            end -= 1
        tail_parts, core = toks[end:], toks[lead:end]
        giv = toks[:lead]
        while len(core) > 1 and _INITIALS.match(core[-1]) and core[-1].rstrip(".") == core[-1].rstrip(".").upper() and len(_letters(core[-1])) <= 3:
            giv = [core.pop(), *giv]
        at = next((i for i, t in enumerate(core) if _PART.match(t.lower()) and t[0].islower()), None)
        if at is not None and at < len(core) - 1 or core and _PART.match(core[0].lower()) and len(core) > 1:
            at = at if at is not None else 0
            giv, sur = core[:at] + giv, core[at:]
        elif len(core) > 1:
            giv, sur = core[:-1] + giv, core[-1:]
        else:
            sur = core
        sur = tail_parts + sur
    parts = []  # particles given after a comma belong to the surname
    while giv and (_PART.match(" ".join(giv).lower()) and not (giv[-1].isupper() and len(giv[-1]) < 4) or _PART.match(giv[-1].lower()) and giv[-1].islower()):
        parts = [giv.pop(), *parts]
    sur = parts + sur
    tokens = [_letters(fold(x)) for t in sur for x in t.split("-")]
    key = "".join(tokens)
    if not key:
        return None
    first = giv[0] if giv else ""
    g = _letters(fold(first))
    if first and (_INITIALS.match(first) and ("." in first or first == first.upper() and len(g) <= 3)):
        out["initial"] = g[:1]
    elif g:
        out["given"] = NICKNAMES.get(g, g)  # both are folded
        out["initial"] = out["given"][0]
    if "-" in "".join(sur) and len(tokens) == 2 and min(map(len, tokens)) > 2:
        out["pair"] = "=" + " ".join(sorted(tokens))
    elif len(giv) == 1 and len(g) > 3 and len(tokens) == 1:
        out["pair"] = "?" + " ".join(sorted([_letters(fold(first)), key]))
    return out | {"kind": "person", "key": key, "words": key}


def edit(a: str, b: str, most: int) -> int:
    """Edits from a to b, swaps of neighbours included; ``most + 1`` as soon as it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prev2[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        prev2, prev = prev, row
    return prev[-1]


def monge_elkan(a: str, b: str) -> float:
    """The lower of both directions' means over words of the best inner similarity; one edit a word at most."""
    x, y = a.split(), b.split()
    if len(x) != len(y):
        return 0.0

    def inner(p: str, q: str) -> float:
        if p == q:
            return 1.0
        n = max(len(p), len(q))
        d = edit(p, q, 1)
        if d > 1:
            d = edit(umlauts(p), umlauts(q), 1)
        return 1 - d / n if d <= 1 and n > 3 else 0.0

    mean = lambda u, v: sum(max(inner(p, q) for q in v) for p in u) / len(u)
    return min(mean(x, y), mean(y, x))


def _parsed(names: DataFrame) -> DataFrame:
    """(name, n, reading...) of the spellings to link."""
    fields = ("kind", "key", "words", "pair", "given", "initial", "acronym", "suffix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, flags = lookalike.normalise(batch.column(0))
            rows = [(s, n, p) for s, n, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), flags) if not f and (p := parse(s))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), *(pa.array([r[2][k] for r in rows], pa.string()) for k in fields)], names=["name", "n", *fields])

    return names.mapInArrow(run, "name string, n bigint, " + ", ".join(f"{k} string" for k in fields))


def signatures(words: pd.Series, n_bands: int, rows: int) -> np.ndarray:
    """MinHash band hashes of padded q-grams, (values, bands)."""
    rng = np.random.default_rng(7)
    mul, add = rng.integers(1, 2**61, (2, n_bands * rows), dtype=np.uint64)
    mul |= np.uint64(1)
    out = np.zeros((len(words), n_bands), np.int64)
    mix = rng.integers(1, 2**61, rows, dtype=np.uint64) | np.uint64(1)
    for i, w in enumerate(words):
        t = "".join(f"^{x}$" for x in w.split(" "))
        c = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64)
        g = np.unique(c[:-1] * np.uint64(1_000_003) + c[1:])
        h = g[:, None] * mul + add
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        low = h.min(axis=0).reshape(n_bands, rows)
        out[i] = (low * mix).sum(axis=1).view(np.int64) if low.dtype == np.int64 else (low * mix).sum(axis=1, dtype=np.uint64).astype(np.int64)
    return out


def banded(p: pd.DataFrame, recall: float = RECALL) -> pd.DataFrame:
    """(kind, key, words, band, h) of keys with their words, by the schemes that their lengths ask for."""
    out = []
    short = p.words.map(umlauts)
    size = p.key.map(umlauts).str.len()
    for at, (least, most, rows, similarity) in enumerate(SCHEMES):
        use = (size >= least) & ((size <= most) if most else True)
        n, x = bands(similarity, rows, recall), p[use]
        rep = lambda c: np.repeat(x[c].to_numpy(), n)  # noqa: B023, E731
        out.append(pd.DataFrame({"kind": rep("kind"), "key": rep("key"), "words": rep("words"), "band": np.tile(np.arange(n) + 1000 * at, len(x)), "h": signatures(short[use], n, rows).reshape(-1)}))
    return pd.concat(out)


def similar_keys(keys: DataFrame, recall: float = RECALL) -> DataFrame:
    """(a, b) of different keys of one kind that verify, a < b. ``keys`` has kind, key, words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield banded(p, recall)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.to_pydict()
            ok = [i for i, (p, q) in enumerate(zip(x["wa"], x["wb"])) if monge_elkan(p, q) >= MIN_MONGE_ELKAN]
            yield b.take(pa.array(ok, pa.int64())).select(["a", "b"])

    sig = spread(keys.select("kind", "key", "words")).mapInPandas(run, "kind string, key string, words string, band int, h bigint")
    left = sig.select("kind", "band", "h", F.col("key").alias("a"), F.col("words").alias("wa"))
    right = sig.select("kind", "band", "h", F.col("key").alias("b"), F.col("words").alias("wb"))
    met = left.hint("merge").join(right, ["kind", "band", "h"]).where("a < b").select("a", "b", "wa", "wb").distinct()
    return met.mapInArrow(verified, "a string, b string")


def stars(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(key, centre): star clustering of keys with weights ``n``; every key gets a centre."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    w = nodes.select("key", "n")
    # tables of names grow with the data, so none is broadcast
    edges = both.hint("merge").join(w.select(F.col("key").alias("a"), F.col("n").alias("na")), "a").hint("merge").join(w.select(F.col("key").alias("b"), F.col("n").alias("nb")), "b")
    edges = store(edges.withColumn("a_first", (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))))
    done: list[DataFrame] = []
    while not done or not edges.isEmpty():
        # a centre outweighs every free neighbour; the heaviest free key always does, so each round takes some
        centres = edges.groupBy("a").agg(F.min("a_first").alias("top")).where("top").select("a")
        took = edges.hint("merge").join(centres, "a").groupBy("b").agg(F.max_by("a", F.struct("na", "a")).alias("centre")).select(F.col("b").alias("key"), "centre")
        took = store(took.unionByName(centres.select(F.col("a").alias("key"), F.col("a").alias("centre"))))
        done.append(took)
        gone = took.select("key")
        edges = store(edges.hint("merge").join(gone.select(F.col("key").alias("a")), "a", "left_anti").hint("merge").join(gone.select(F.col("key").alias("b")), "b", "left_anti"))
    all_took = done[0]
    for d in done[1:]:
        all_took = all_took.unionByName(d)
    return nodes.select("key").hint("merge").join(all_took, "key", "left").select("key", F.coalesce("centre", "key").alias("centre"))


def entities(df: DataFrame, name_col: str, recall: float = RECALL) -> DataFrame:
    """(name, entity) of each different spelling that is a plain name.

    Nulls, blanks, placeholders and values that hold presentation variants are left out; repeated rows count
    as one spelling with its weight; very long names are read whole; other columns aren't read. Spellings
    that fit two people stand alone.
    """
    names = df.select(F.col(name_col).alias("name")).where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    p = store(_parsed(names))
    # the two halves of a double surname, apart or turned round: known by the hyphenated spelling
    double = p.where(F.col("pair").startswith("=")).groupBy(F.expr("substring(pair, 2)").alias("halves")).agg(F.max_by("key", "n").alias("double_key"))
    p = p.withColumn("halves", F.expr("substring(pair, 2)")).hint("merge").join(double, "halves", "left").withColumn("turned", F.col("pair").startswith("?") & F.col("double_key").isNotNull())
    p = store(p.select("name", "n", "kind", "acronym", "suffix", F.when(F.col("turned"), F.col("double_key")).otherwise(F.col("key")).alias("key"), F.when(F.col("turned"), F.col("double_key")).otherwise(F.col("words")).alias("words"), F.when(F.col("turned"), "").otherwise(F.col("given")).alias("given"), F.when(F.col("turned"), "").otherwise(F.col("initial")).alias("initial")))
    keys = store(p.where("kind <> 'acronym'").groupBy("kind", "key").agg(F.min("words").alias("words"), F.sum("n").alias("n")).select("kind", F.concat("kind", F.lit(":"), "key").alias("key"), "words", "n"))
    star = stars(keys, similar_keys(keys, recall))
    p = p.withColumn("key", F.concat("kind", F.lit(":"), "key")).hint("merge").join(star, "key", "left")
    p = store(p)
    # acronyms: the only organisation whose initials they are
    orgs = p.where("kind = 'org'").select("centre", "acronym", "suffix").distinct()
    acr = p.where("kind = 'acronym'").select("name", F.col("acronym").alias("a"), F.col("suffix").alias("s"))
    fits = acr.hint("merge").join(orgs, (F.col("a") == F.col("acronym")) & ((F.col("s") == "") | (F.col("s") == F.col("suffix")))).groupBy("name").agg(F.countDistinct("centre").alias("k"), F.min("centre").alias("centre")).where("k = 1").select("name", "centre")
    org_out = p.where("kind = 'org'").select("name", F.col("centre").alias("entity")).unionByName(acr.hint("merge").join(fits, "name", "left").select("name", F.coalesce("centre", F.concat(F.lit("acronym:"), "name")).alias("entity")))
    # people
    who = p.where("kind = 'person'").select("name", "n", "centre", "given", "initial")
    full = who.where("given <> ''").groupBy("centre", "initial").agg(F.countDistinct("given").alias("k"), F.min("given").alias("only"))
    who = who.hint("merge").join(full, ["centre", "initial"], "left").withColumn("person", F.when(F.col("given") != "", F.col("given")).when((F.col("initial") != "") & (F.col("k") == 1), F.col("only")).when(F.col("initial") != "", F.col("initial")).otherwise(F.lit("")))
    each = who.where("person <> ''").groupBy("centre").agg(F.countDistinct("person").alias("people"), F.min("person").alias("sole"))
    who = who.hint("merge").join(each, "centre", "left").withColumn("person", F.when((F.col("person") == "") & (F.col("people") == 1), F.col("sole")).otherwise(F.col("person")))
    return org_out.unionByName(who.select("name", F.concat_ws("|", "centre", "person").alias("entity")))


def pairs(ents: DataFrame) -> DataFrame:
    """(name_a, name_b) of the spellings of each entity. An entity with very many is split by the adaptive join."""
    e = store(ents)
    return e.select("entity", F.col("name").alias("name_a")).hint("merge").join(e.select("entity", F.col("name").alias("name_b")), "entity").where("name_a < name_b").select("name_a", "name_b")
