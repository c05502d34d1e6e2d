"""References and graph resources that are the same publication, without a common key.

Retrieval is BM25 over one inverted index of titles' words, authors and years. Weights are counted over all
resources: the table of terms with at least ``postings / FREQUENT`` postings, at most ``FREQUENT`` entries
whatever the data, goes to every task; how often the rarer terms of queries occur comes by a join. A word that
no resource has is expanded to the words of the index within two edits that share its first or last letters;
without any it weighs as the rarest of the table: it speaks against a match, but is never probed.

The index is cut into shards by what the final check asks for anyway: two known pages must be equal and two
known years at most one apart. A query with a page reads its page's shard and the shards by year of resources
without page; a query without page reads the shards by year. No posting list of a hot word or author is
read whole, and nothing that could count is left out.

Pruning is exact. A resource is retrieved from ``KEEP`` of the score that the query gives itself. A query's
commonest terms, together below that bound, can't make a pair count alone, so only its other, rarer terms are
probed (``essential``), and a pair stays while its partial score and all that the rest could add reach the
bound. A sketch of 64 bits that every posting carries tells at once which of the query's terms the resource
can't have, which drops most pairs before they are shuffled. The bound rises to what the query's best candidate has for sure (k = 1), less ``GAP``, as a runner-up
further below no longer changes the confidence: first after the shards by page, then over all candidates.
What is left is scored in full.

The test for mutual nearest runs within a citing file, as a file cites a work once: of its references that
have the same resource as their best, the nearest one is taken. Confidence is logistic in share, gap and
agreement, fitted on at most ``LABELLED`` references that do have a DOI known to the graph. An exact check
follows: pages, years or numbered parts that contradict tell reprints and other parts apart.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import store
from . import hotdedup, lookalike, mojibake, namelink

K1, B = 1.2, 0.2
WEIGHTS = {"t": 1.0, "a": 0.7, "y": 0.5}
FREQUENT = 50_000  # most terms whose weights are told apart; bounds what is broadcast
LABELLED = 3_000  # most references with DOI from which the confidence is fitted
LABELLED_CANDIDATES = 12  # of each in the fit
#: Share of the score that a query gives itself from which a resource is retrieved: with an equal page, and without one.
KEEP_PAGE, KEEP_OTHER = 0.5, 0.75
GAP = 0.25  # shares by which a runner-up can lie below the best and still change the confidence
MIN_CONFIDENCE = 0.5
SCALE = 1000  # of bounds as whole numbers
SKETCHED = 100  # most terms of a query whose pairs are looked at by their sketch
CHEAP = 500  # postings of a term over all pages that are probed in a page's shard although the bound doesn't ask for it

FEATURES = ("one", "share", "gap", "title", "back", "miss", "mass", "page", "year", "near", "author", "stranger", "parts")
#: Coefficients where there are too few labelled pairs, and the centre of the fit's penalty.
PRIOR = np.array([-14.0, 2.0, 8.0, 8.0, 3.0, -6.0, 1.5, 4.0, 2.0, 0.5, 2.0, -3.0, -2.0])
RIDGE = 0.05

_WORD = re.compile(r"[^\W_]+")
_PART = re.compile(r"(?::\s*([ivx]+)\.\s*\w+|\bpart\s+([ivx]+|\d+)|\(([ivx]+|\d+)\)|(?<=[\w,:;.])\s([ivx]+|\d{1,2}))\s*[.…]*\s*$")
_TAIL = re.compile(r"(?:\s*\([^()]*[^\w\s()'’.,-][^()]*\)|\s+[^\w\s()]+)\s*$")  # signs at the end, or a bracket that holds some
_LOST = re.compile(r"\ufffd|(?<=\w)\?(?=\w)")  # characters lost for good; a letter in their place keeps a word whole and near its like
_TAG = re.compile(r"<[^<>]{1,20}>")
_YEAR = re.compile(r"(?<!\d)(1[5-9]\d\d|20\d\d)(?!\d)")
_PAGE_NUMBER = re.compile(r"[a-z]?\d+")
KEPT = 20_000  # most terms whose place in a sketch is kept in a task
_ROMAN = {r: i for i, r in enumerate(("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii"), 1)}
_HAN = re.compile("[぀-ヿ㐀-鿿가-힣]")


def clean_title(s: str | None) -> tuple[str, int]:
    """(folded words of a title without its part, number of the part or 0)."""
    if not s:
        return "", 0
    if "&" in s:
        s = html.unescape(s)
    if "<" in s:
        s = _TAG.sub("", s)
    s = " ".join(s.lower().split()).strip(" .")
    while s and not s[-1].isalnum() and (n := _TAIL.sub("", s)) != s and n:
        s = n
    part = 0
    if (s[-1:] in ").…ivx" or s[-1:].isdigit() or ":" in s[-40:]) and (m := _PART.search(s[-40:] if len(s) > 40 else s)):
        p = next(g for g in m.groups() if g)
        n, at = _ROMAN.get(p) or (int(p) if p.isdigit() else 0), m.start() + max(0, len(s) - 40)
        if n and at > 8:
            part, s = n, s[:at]
    return " ".join(_WORD.findall(s if s.isascii() else namelink.fold(s))), part  # folding only turns one sign of ASCII into another


def words_of(title: str) -> dict[str, int]:
    """Different words with their counts; scripts without blanks give pairs of characters."""
    out: list[str] = []
    if title.isascii() or not _HAN.search(title):
        out = [w for w in title.split() if len(w) > 1]
    else:
        for w in title.split():
            if len(w) > 2 and _HAN.search(w):
                out += [w[i : i + 2] for i in range(len(w) - 1)]
            elif len(w) > 1:
                out.append(w)
    once = dict.fromkeys(out, 1)
    return once if len(once) == len(out) else Counter(out)


def year_of(s: str | None) -> int | None:
    m = _YEAR.search(s or "")
    return int(m[1]) if m else None


def page_of(s: str | None) -> str | None:
    m = _PAGE_NUMBER.search((s or "").lower())
    return m[0].lstrip("e").lstrip("0") or None if m else None


_RECORD = "words array<string>, tf array<int>, part int, year int, page string, authors array<string>, sketch bigint"
_STRINGS = pa.list_(pa.string())


@lru_cache(KEPT)
def bit(term: str) -> int:
    """A term's place in a record's sketch of 64 bits."""
    return zlib.crc32(term.encode()) & 63


def _sketch(words: list[str], authors: list[str], year: int | None) -> int:
    out = 1 << bit(f"y:{year}")
    for w in words:
        out |= 1 << bit("t:" + w)
    for a in authors:
        out |= 1 << bit("a:" + a)
    return out - (1 << 64) if out >> 63 else out


def _read(df: DataFrame, title: str, authors: str, year: str, page: str, *others: str, sketched: bool = False) -> DataFrame:
    """``others`` and the attributes in comparable form. ``authors`` is an array."""
    own = df.select(*others, F.col(title).alias("__title"), F.col(authors).alias("__authors"), F.col(year).alias("__year"), F.col(page).alias("__page"))
    kinds = dict(own.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for b in batches:
            raw, au, ye, pg = (b.column(b.num_columns - 4 + i).to_pylist() for i in range(4))
            titles = list(raw)
            beyond = [i for i, t in enumerate(raw) if t and not t.isascii()]  # plain ASCII is in its one form
            for i, n in zip(beyond, lookalike.normalise(pa.array([raw[i] for i in beyond], pa.string()))[0].to_pylist() if beyond else ()):
                titles[i] = n
            if len(known) > 200_000:
                known.clear()
            new = list({a for x in au for a in x or () if a and a not in known})
            for a, n in zip(new, lookalike.normalise(pa.array(new, pa.string()))[0].to_pylist() if new else ()):
                r = namelink.parse(n if n.isascii() else mojibake.repair(n)[0])
                known[a] = namelink.umlauts(r["key"]) if r else ""
            words, tf, part, keys = [], [], [], []
            for t, n, a in zip(raw, titles, au):
                if t and not (t.isascii() and "+" not in t and "?" not in t):
                    fixed, bad, lossy = mojibake.repair(t)
                    n = fixed if bad else n
                    n = _LOST.sub("q", n) if lossy else n
                c, p = clean_title(n)
                w = words_of(c)
                words.append(list(w))
                tf.append(list(w.values()))
                part.append(p)
                keys.append(list(dict.fromkeys(k for x in a or () if x and (k := known[x]))))
            years = list(map(year_of, ye))
            cols = [pa.array(words, _STRINGS), pa.array(tf, pa.list_(pa.int32())), pa.array(part, pa.int32()), pa.array(years, pa.int32()), pa.array(map(page_of, pg), pa.string()), pa.array(keys, _STRINGS), pa.array(map(_sketch, words, keys, years) if sketched else [None] * len(words), pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-4], *cols], names=[*others, "words", "tf", "part", "year", "page", "authors", "sketch"])

    return own.mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in others) + _RECORD)


def read_refs(bib: DataFrame) -> DataFrame:
    """References without DOI (null, blank or a lone mark) and with a title; null ids are left out."""
    no_doi = F.col("doi").isNull() | ~F.col("doi").rlike(r"[\p{L}\p{N}]") | F.upper(F.trim("doi")).isin("N/A")
    return _refs(bib.where(no_doi & F.col("article_title").rlike(r"\S")))


def _refs(bib: DataFrame) -> DataFrame:
    own = bib.where("ref_row_id is not null").select(
        F.col("ref_row_id").cast("bigint").alias("id"), F.xxhash64("source_file").alias("file"), F.when(F.col("reference_id").isNull() | F.col("source_file").isNull(), F.xxhash64("ref_row_id")).otherwise(F.xxhash64("source_file", "reference_id")).alias("cited"),
        "article_title", F.array("first_author_lastname").alias("authors"), "year", "first_page",
    )
    return _read(own, "article_title", "authors", "year", "first_page", "id", "file", "cited")


def read_resources(kg: DataFrame) -> DataFrame:
    """One record per resource, with all its authors."""
    one = kg.where("br is not null").groupBy("br").agg(F.max("title").alias("title"), F.max("pub_date").alias("pub_date"), F.max("start_page").alias("start_page"), F.collect_set("author_name").alias("authors"))
    return _read(one, "title", "authors", "pub_date", "start_page", "br", sketched=True)


def read_labelled(bib: DataFrame, kg: DataFrame, most: int = LABELLED) -> DataFrame:
    """At most ``most`` references whose DOI a resource has, with that resource as ``truth``; chosen by a hash.

    They are drawn once and stored, so the references are read once and only the first by hash of each part are sorted.
    """
    doi = hotdedup.canonical_doi(F.col("doi"))
    drawn = store(bib.where(F.col("doi").contains("10.") & F.col("article_title").rlike(r"\S")).orderBy(F.xxhash64("ref_row_id", F.lit(3))).limit(2 * most))
    some = drawn.withColumn("__doi", doi)
    truth = kg.where("br is not null and doi is not null").select(F.lower(F.trim("doi")).alias("__doi"), "br").join(F.broadcast(some.select("__doi").distinct()), "__doi", "left_semi")
    got = store(some.join(F.broadcast(truth.groupBy("__doi").agg(F.min("br").alias("truth"))), "__doi").limit(most))  # at most 2 x most DOIs on either side
    return _refs(got).join(F.broadcast(got.select(F.col("ref_row_id").cast("bigint").alias("id"), "truth").distinct()), "id")


class Weights:
    """BM25's statistics: resources, mean length, and by frequent term the weight and the greatest impact of a resource.

    Of rarer terms a query brings its own counts along (``rare``); their greatest impact is that of any term.
    """

    def __init__(self, n: int, mean: float, least: float, frequent: dict[str, tuple[int, float]], most: float) -> None:
        self.n, self.mean, self.most = n, mean, most
        self.rare = self.idf(max(1.0, min(least, n)))
        self.w = {s: (self.idf(k), m) for s, (k, m) in frequent.items()}
        self.words = {s[2:]: u for s, (u, _) in self.w.items() if s[0] == "t"}

    def idf(self, df: float) -> float:
        return math.log1p((self.n - df + 0.5) / (df + 0.5)) if self.n else 0.0

    def impact(self, tf: int, length: int) -> float:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))

    def weights(self, terms: list[str], rare: str | None) -> list[tuple[float, list[tuple[str, float, float]]]]:
        """(weight, [(term of the index, weight, the most that any resource can get)]) of a query's terms."""
        own: dict[str, list[tuple[str, float]]] = {}
        for r in rare.split("\n") if rare else ():
            s, v, n, f = r.split(" ")
            own.setdefault(s, []).append((v, self.idf(int(n)) * float(f)))
        out = []
        for s in terms:
            if (k := self.w.get(s)) is not None:
                out.append((k[0], [(s, k[0], k[0] * k[1])]))
            elif s in own:
                most = self.most if s[0] == "t" else WEIGHTS[s[0]]
                found = [(v, u, u * most) for v, u in own[s]]
                out.append((max(u for _, u, _ in found), found))
            else:
                out.append((self.rare, []))
        return out


def _length() -> Column:
    return F.aggregate("tf", F.lit(0), lambda a, x: a + x)


def statistics(resources: DataFrame) -> tuple[Weights, DataFrame]:
    """(weights, (v, n) of all terms with their number of resources), counted over all resources.

    At most ``FREQUENT`` terms can have the number of postings of a frequent one, so their table is bounded.
    """
    size = resources.agg(F.count(F.lit(1)), F.avg(_length()), F.sum(F.size("words") + F.size("authors") + F.col("year").isNotNull().cast("int"))).first()
    n, mean, least = size[0], max(1.0, float(size[1] or 1)), int(size[2] or 0) / FREQUENT
    x = _terms(resources.select("*", _length().alias("len")), "len").groupBy(F.col("s").alias("v")).agg(F.count(F.lit(1)).cast("int").alias("n"), F.max(_impact(mean)).alias("most"))
    index = store(x)
    rows = index.groupBy(F.when(F.col("n") >= least, F.col("v")).alias("v")).agg(F.max("n"), F.max("most")).collect() if n else []
    return Weights(n, mean, least, {r[0]: (r[1], r[2]) for r in rows if r[0] is not None}, max((r[2] for r in rows), default=1.0)), index.select("v", "n")


def _with_rare(queries: DataFrame, index: DataFrame, w: Weights) -> DataFrame:
    """Adds ``rare``: for a query's terms beside the frequent ones the same or near terms of the index.

    Each is a line of the query's term, the index's, its number of resources and the likeness of the spelling.
    """
    frequent = F.broadcast(queries.sparkSession.createDataFrame([(s,) for s in w.w], "s string"))
    own = _terms(queries, "q").join(frequent, "s", "left_anti").select("q", "s").join(index.withColumnRenamed("v", "s"), "s", "left")
    size = F.length("s") - 2
    ends = lambda c, n: F.array(F.xxhash64(F.lit(0), F.substring(c, 3, n)), F.xxhash64(F.lit(1), F.right(c, F.lit(n))))
    keys = lambda c, size: F.explode(F.when(size >= 8, ends(c, 5)).otherwise(ends(c, 2)))
    own = store(own)
    missing = own.where(F.col("n").isNull() & F.col("s").startswith("t:") & (size >= 5)).select("s").distinct().select("s", keys("s", size).alias("key"))
    words = index.where(F.col("v").startswith("t:") & (F.length("v") >= 6)).select("v", "n", keys("v", F.length("v") - 2).alias("key"))
    letters = lambda c: F.array_sort(F.split(c, ""))
    near = missing.join(words, "key").where(F.abs(F.length("s") - F.length("v")) <= 2).withColumn("e", F.levenshtein("s", "v", 2))
    near = near.where((F.col("e") == 1) | (F.col("e") == 2) & ((size >= 8) | (letters("s") == letters("v")))).select("s", "v", "n", F.round(1 - F.col("e") / size, 4).alias("f")).distinct()
    same = own.where("n is not null").select("q", "s", F.col("s").alias("v"), "n", F.lit(1.0).alias("f"))
    other = own.where("n is null").select("q", "s").join(near, "s").select("q", "s", "v", "n", "f")
    lines = same.unionByName(other).groupBy("q").agg(F.array_join(F.collect_list(F.concat_ws(" ", "s", "v", "n", "f")), "\n").alias("rare"))
    return queries.join(lines, "q", "left")


def _flat(*others: str) -> list[Column | str]:
    """A record's columns as plain text for Python: words, their counts where any is repeated, authors."""
    counts = F.when(F.array_max("tf") > 1, F.array_join(F.col("tf").cast("array<string>"), " "))
    return [*others, F.array_join("words", " ").alias("words"), counts.alias("tf"), "part", "year", "page", F.array_join("authors", " ").alias("authors")]


def _record(words: str, tf: str | None, part: int, year: int | None, page: str | None, authors: str, rare: str | None = None) -> dict:
    x = words.split()
    return {"words": x, "tf": [int(k) for k in tf.split()] if tf else [1] * len(x), "part": part, "year": year, "page": page, "authors": authors.split(), "rare": rare}


def _impact(mean: float) -> Column:
    """What a resource gets for a term of weight 1."""
    tf, field = F.col("tf"), F.substring("s", 1, 1)
    return F.when(field == "t", tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / mean)) * WEIGHTS["t"]).when(field == "a", WEIGHTS["a"]).otherwise(WEIGHTS["y"])


def _terms(df: DataFrame, *others: str) -> DataFrame:
    """(others..., s, tf): one row a term; ``s`` is a letter for the field, a colon, the value; tf is 0 beside titles."""
    word = F.posexplode("words").alias("__i", "__w")
    t = df.select(*others, "tf", word).select(*others, F.concat(F.lit("t:"), "__w").alias("s"), F.get("tf", F.col("__i")).alias("tf"))
    a = df.select(*others, F.explode(F.array_distinct("authors")).alias("__a")).select(*others, F.concat(F.lit("a:"), "__a").alias("s"), F.lit(0).alias("tf"))
    y = df.where("year is not null").select(*others, F.concat(F.lit("y:"), F.col("year").cast("string")).alias("s"), F.lit(0).alias("tf"))
    return t.unionByName(a).unionByName(y)


#: Shards: resources by page; all by year, for queries without page; those without page by year.
_PAGE, _ALL, _PAGELESS = 1, 2, 3
_NO_YEAR, _ANY_YEAR = -1, -2


def _keyed(shard: int, v: Column) -> Column:
    return F.xxhash64("h", F.lit(shard), v)


def _postings(resources: DataFrame, w: Weights, paged: bool) -> DataFrame:
    """(key, d, imp, sketch) of the index of the shards by page, or of the others; a key is a term within a shard."""
    x = _terms(resources.select("*", _length().alias("len")), "d", "page", "year", "len", "sketch")
    x = x.select("d", "sketch", "page", F.coalesce("year", F.lit(_NO_YEAR)).alias("y"), _impact(w.mean).cast("float").alias("imp"), F.xxhash64("s").alias("h"))
    if paged:
        return x.where("page is not null").select("d", "imp", "sketch", _keyed(_PAGE, F.hash("page")).alias("key"))
    near = F.when(F.col("y") != _NO_YEAR, F.array(*[_keyed(_PAGELESS, F.col("y") + k) for k in (-1, 0, 1)])).otherwise(F.array(_keyed(_PAGELESS, F.lit(_NO_YEAR))))
    keys = F.when(F.col("page").isNotNull(), F.array(_keyed(_ALL, F.col("y")))).otherwise(F.concat(F.array(_keyed(_ALL, F.col("y")), _keyed(_PAGELESS, F.lit(_ANY_YEAR))), near))
    return x.select("d", "imp", "sketch", F.explode(keys).alias("key"))


def essential(terms: list[tuple[str, float, float]], need: float, cheap: float) -> tuple[list[tuple[str, float]], float]:
    """(terms to probe with their weights, what the rest can add). ``terms`` are (term, weight, most that a resource can get).

    The rest is the commonest terms that together stay below ``need``; of these, terms of at least the weight
    ``cheap`` are probed too.
    """
    rest, order = 0.0, sorted(terms, key=lambda t: (t[1], t[0]))
    for i, t in enumerate(order):
        if t[1] >= cheap or rest + t[2] >= need:
            return [(x[0], x[1]) for x in order[i:]], rest
        rest += t[2]
    return [], rest


def _probes(queries: DataFrame, w: Weights, paged: bool, years: list[int]) -> DataFrame:
    """(q, key, w, need, rest, own, bounds): the probes of all queries, with the bits and bounds of all their terms.

     ``queries`` has ``best``, the share that another resource has for sure.
    """
    cheap, of_title = w.idf(min(w.n, CHEAP)) if paged else math.inf, WEIGHTS["t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("s", "w", "need", "rest", "own", "bounds")}
            for best, *record in zip(*(b.column(i).to_pylist() for i in range(1, 9))):
                x = _record(*record)
                names = [f"t:{t}" for t in x["words"]]
                titled = len(names)
                names += [f"a:{t}" for t in x["authors"]]
                if x["year"] is not None:
                    names.append(f"y:{x['year']}")
                weights, tf = w.weights(names, x["rare"]), x["tf"]
                n = sum(tf)
                one = w.impact(1, n)
                parts = [u * (one if k == 1 else w.impact(k, n)) * of_title for k, (u, _) in zip(tf, weights)]  # the best of near words
                own = sum(parts + [u * WEIGHTS[s[0]] for s, (u, _) in zip(names[titled:], weights[titled:])])
                need = max(KEEP_PAGE if paged else KEEP_OTHER, (best or 0.0) - GAP) * own
                found = [t for _, y in weights for t in y]
                probes, rest = essential(found, need, cheap)
                out["s"].append([s for s, _ in probes])
                out["w"].append([u for _, u in probes])
                out["need"].append(need)
                out["rest"].append(rest)
                out["own"].append(own)
                # every probe carries them, so a very long title goes without this first look at its pairs
                out["bounds"].append([bit(v) << 24 | min(math.ceil(m * SCALE), (1 << 24) - 1) for v, _, m in found] if len(found) <= SKETCHED else None)
            cols = [pa.array(v, t) for v, t in zip(out.values(), (_STRINGS, pa.list_(pa.float32()), *[pa.float32()] * 3, pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(6), b.column(5), *cols], names=["q", "page", "year", *out])

    rows = queries.select(*_flat("q", "best"), "rare").mapInArrow(run, "q bigint, page string, year int, s array<string>, w array<float>, need float, rest float, own float, bounds array<int>")
    rows = rows.select("*", F.posexplode("s").alias("i", "t")).select("q", "page", "year", F.col("t").alias("s"), F.get("w", F.col("i")).alias("w"), "need", "rest", "own", "bounds")
    rows = rows.withColumn("h", F.xxhash64("s"))
    year, none = F.col("year"), F.lit(_NO_YEAR)
    if paged:
        keys = F.array(_keyed(_PAGE, F.hash("page")))
    else:
        every = F.transform(F.array(*[F.lit(y) for y in [*years, _NO_YEAR]]), lambda y: _keyed(_ALL, y))  # the resources' years, a few hundred at most
        keys = F.when(F.col("page").isNotNull(), F.when(year.isNull(), F.array(_keyed(_PAGELESS, F.lit(_ANY_YEAR)))).otherwise(F.array(_keyed(_PAGELESS, year), _keyed(_PAGELESS, none)))).otherwise(
            F.when(year.isNull(), every).otherwise(F.array(*[_keyed(_ALL, v) for v in (year - 1, year, year + 1, none)]))
        )
    return rows.select("q", "w", "need", "rest", "own", "bounds", F.explode(keys).alias("key"))


def _candidates(queries: DataFrame, resources: DataFrame, w: Weights) -> DataFrame:
    """(q, d) that can be a query's best or its runner-up.

    The shards by page come first: what they give for sure raises the bound for the others.
    """
    years = [r[0] for r in resources.where("year is not null").select("year").distinct().collect()]  # 600 at most, see year_of

    def met(queries: DataFrame, paged: bool) -> DataFrame:
        probes = _probes(queries, w, paged, years)
        # a resource's sketch bounds what it can have of a query's terms before any pair is shuffled
        there = lambda b: F.getbit("sketch", F.shiftright(b, 24)).cast("int") * b.bitwiseAND(F.lit((1 << 24) - 1))
        reach = F.aggregate("bounds", F.lit(0).cast("bigint"), lambda a, b: a + there(b))
        x = _postings(resources, w, paged).join(probes, "key").where(F.col("bounds").isNull() | (reach + 1 >= F.col("need") * SCALE)).groupBy("q", "d").agg(F.sum(F.col("w") * F.col("imp")).alias("s"), *[F.max(c).alias(c) for c in ("need", "rest", "own")])
        return x.where(F.col("s") + F.col("rest") >= F.col("need") - 1e-3).select("q", "d", (F.col("s") / F.col("own")).cast("float").alias("low"), ((F.col("s") + F.col("rest")) / F.col("own")).cast("float").alias("high"))

    first = store(met(queries.where("page is not null").withColumn("best", F.lit(0.0)), True))
    sure = first.groupBy("q").agg(F.max("low").cast("double").alias("best"))
    both = first.unionByName(met(queries.join(sure, "q", "left"), False))
    return both.withColumn("best", F.max("low").over(Window.partitionBy("q"))).where(F.col("high") >= F.col("best") - GAP - 1e-3).select("q", "d")


def _soft(x: list[str], y: list[str], weight: dict[str, float]) -> tuple[float, float]:
    """(share of the weight of the words of ``x`` found in ``y``, near spellings in part; greatest weight that is missing)."""
    have, own = set(y), set(x)
    if own <= have:
        return float(any(weight[t] for t in x)), 0.0
    total = got = miss = 0.0
    free = None
    for t in x:
        u = weight[t]
        total += u
        if t in have:
            got += u
            continue
        if free is None:
            free = [v for v in y if v not in own]
        best = 0.0
        if len(t) > 3:
            for v in free:
                if abs(len(v) - len(t)) <= 2 and (t[0] == v[0] or t[-1] == v[-1]) and (e := namelink.edit(t, v, 2)) <= 2:
                    best = max(best, 1 - e / len(t))
        got += u * best
        miss = max(miss, u * (1 - best))
    return (got / total if total else 0.0), miss


def measure(q: dict, d: dict, w: Weights) -> tuple[float, float, float, float, float, float, int, int, int, bool]:
    """(score, share, title, back, miss, mass, page, year, author, whether it counts) of a pair.

    It counts above the bound where nothing contradicts.

    Agreements are 1, disagreements -1, unknown 0; for years 1 is equal and 2 one apart.
    """
    near: dict[str, list[tuple[str, float]]] = {}
    for r in q["rare"].split("\n") if q["rare"] else ():
        t, v, k, f = r.split(" ")
        near.setdefault(t, []).append((v[2:], w.idf(int(k)) * float(f)))
    known, rare = w.words, w.rare
    n, m = sum(q["tf"]), sum(d["tf"])
    one, other = w.impact(1, n), w.impact(1, m)  # of words that occur once
    dt = dict(zip(d["words"], d["tf"]))
    weight: dict[str, float] = {}
    score = own = 0.0
    for t, f in zip(q["words"], q["tf"]):
        x = known.get(t)
        if x is not None:
            if k := dt.get(t):
                score += x * (other if k == 1 else w.impact(k, m))
        elif found := near.get(f"t:{t}"):
            x = max(y for _, y in found)
            score += max((y * w.impact(dt[v], m) for v, y in found if v in dt), default=0.0)
        else:
            x = rare
        weight[t] = x
        own += x * (one if f == 1 else w.impact(f, n))
    score, own = score * WEIGHTS["t"], own * WEIGHTS["t"]
    for a in q["authors"]:
        x = WEIGHTS["a"] * (w.w[f"a:{a}"][0] if f"a:{a}" in w.w else max((y for _, y in near.get(f"a:{a}", ())), default=rare))
        own += x
        score += x * (a in d["authors"])
    year = 0
    if q["year"] is not None:
        x = WEIGHTS["y"] * (w.w[y][0] if (y := f"y:{q['year']}") in w.w else max((z for _, z in near.get(y, ())), default=rare))
        own += x
        if d["year"] is not None:
            apart = abs(q["year"] - d["year"])
            score += x * (apart == 0)
            year = 1 if apart == 0 else 2 if apart == 1 else -1
    page = 0 if not q["page"] or not d["page"] else 1 if q["page"] == d["page"] else -1
    fits = page >= 0 and year >= 0 and not (q["part"] and d["part"] and q["part"] != d["part"])
    share = score / own if own else 0.0
    if not fits or share < (KEEP_PAGE if page == 1 else KEEP_OTHER) - 1e-3:
        return score, share, 0.0, 0.0, 1.0, 0.0, page, year, 0, False  # below the bound nothing else is asked
    author = 0
    if q["authors"] and d["authors"]:
        author = 1 if not set(q["authors"]).isdisjoint(d["authors"]) or any(namelink.edit(x, y, 1) <= 1 or len(x) > 6 and (x in y or y in x) for x in q["authors"] for y in d["authors"]) else -1
    for t in d["words"]:
        if t not in weight:
            weight[t] = known.get(t, rare)
    mass = math.log1p(sum(weight[t] for t in q["words"]))
    title, miss = _soft(q["words"], d["words"], weight)
    back, _ = _soft(d["words"], q["words"], weight)
    return score, share, title, back, miss / rare if rare else 0.0, mass, page, year, author, True


_MEASURES = ("score", "share", "title", "back", "miss", "mass", "page", "year", "author", "fits", "parts")


def _measured(pairs: DataFrame, queries: DataFrame, resources: DataFrame, w: Weights) -> DataFrame:
    """(q, d, br, measures) of candidate pairs."""
    shared = pairs.sparkSession.sparkContext.broadcast(w)
    named = lambda df, *c: [F.col(x).alias(f"{c[0]}_{x}") if x not in c else F.col(x) for x in df.columns]
    qs, ds = queries.select(*_flat("q"), "rare"), resources.select(*_flat("d", "br"))
    both = pairs.join(qs.select(*named(qs, "q")), "q").join(ds.select(*named(ds, "d", "br")), "d")
    order = [f"q_{c}" for c in ("words", "tf", "part", "year", "page", "authors", "rare")] + [f"d_{c}" for c in ("words", "tf", "part", "year", "page", "authors")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in zip(*(b.column(i).to_pylist() for i in range(3, 16))):
                q, d = _record(*x[:7]), _record(*x[7:])
                rows.append((*measure(q, d, shared.value), (q["part"] > 0) != (d["part"] > 0)))
            of = list(zip(*rows)) or [()] * 11
            cols = [pa.array(of[i], pa.float32() if i < 6 else pa.int8() if i < 9 else pa.bool_()) for i in range(11)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *cols], names=["q", "d", "br", *_MEASURES])

    return both.select("q", "d", "br", *order).mapInArrow(run, "q bigint, d bigint, br string, score float, share float, title float, back float, miss float, mass float, page tinyint, year tinyint, author tinyint, fits boolean, parts boolean")


def _ranked(measured: DataFrame) -> DataFrame:
    """Adds ``gap``: how far a candidate is above the best of the others, in shares, at most ``GAP``; negative below it, 0 for ties.

    Candidates that contradict rank at half their share.
    """
    rank = F.col("share") * F.when(F.col("fits"), 1.0).otherwise(0.5)
    by = Window.partitionBy("q").orderBy(F.desc("rank"), "d")
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = measured.withColumn("rank", rank).select("*", F.row_number().over(by).alias("nth"), F.first("rank").over(every).alias("first"), F.nth_value("rank", 2).over(every).alias("second"))
    other = F.when(F.col("nth") == 1, F.coalesce("second", F.lit(0.0))).otherwise(F.col("first"))
    return x.withColumn("gap", F.greatest(F.lit(-GAP), F.least(F.lit(GAP), F.col("rank") - other)))


def _features() -> list[Column]:
    page, year, author = F.col("page"), F.col("year"), F.col("author")
    num = lambda c: c.cast("double")
    return [F.lit(1.0), num(F.col("share")), num(F.col("gap")), num(F.col("title")), num(F.col("back")), num(F.col("miss")), num(F.col("mass")), num(page == 1), num(year == 1), num(year == 2), num(author == 1), num(author == -1), num(F.col("parts"))]


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, ridge: float = RIDGE) -> np.ndarray:
    """Coefficients of greatest likelihood, drawn towards ``prior``; without pairs the prior itself. Newton steps."""
    w = prior.copy()
    pull = np.full(len(prior), ridge)
    for _ in range(25 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + pull * (w - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4 / max(1e-9, float(np.abs(step).max())))
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _fitted(labelled: DataFrame, ranked: DataFrame) -> np.ndarray:
    """Coefficients fitted on the labelled references' candidates; both are bounded, see ``LABELLED``."""
    x = ranked.where(F.col("fits") & (F.col("nth") <= LABELLED_CANDIDATES)).join(F.broadcast(labelled), "q")
    rows = x.select(F.array(*_features()).alias("x"), (F.col("br") == F.col("truth")).cast("int").alias("y")).collect()
    return fit(np.array([r[0] for r in rows], float).reshape(len(rows), len(FEATURES)), np.array([r[1] for r in rows], float))


def matched(refs: DataFrame, resources: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(id, br, share, gap, confidence) of pairs that are the same publication, each reference's best.

    The frames come from ``read_refs``, ``read_resources`` and ``read_labelled``; without labelled ones, or
    with few, the confidence rests on ``PRIOR``. Records without any term match nothing; equal records are
    asked once; a reference with several equally good resources gets each of them, at a gap of 0; empty tables
    give an empty result. Jobs run while the query is built: tables of both sides are stored, and the weights
    and the fit are taken.
    """
    fields = ("words", "tf", "part", "year", "page", "authors")
    sig = F.xxhash64(*fields)
    resources = store(resources.withColumn("d", F.monotonically_increasing_id()))
    w, index = statistics(resources)
    rows = store(refs.withColumn("sig", sig))
    asked = rows.select("sig", *fields)
    if labelled is not None:
        labelled = store(labelled.withColumn("sig", sig))
        asked = asked.unionByName(labelled.select("sig", *fields))
    queries = store(asked.groupBy("sig").agg(F.first(F.struct(*fields)).alias("r")).select("sig", "r.*").withColumn("q", F.monotonically_increasing_id()))
    sigs, queries = queries.select("q", "sig"), store(_with_rare(queries.drop("sig"), index, w))
    ranked = store(_ranked(_measured(_candidates(queries, resources, w), queries, resources, w)))
    coefficients = _fitted(labelled.join(sigs, "sig").select("q", "truth"), ranked) if labelled is not None else PRIOR
    z = reduce(lambda a, b: a + b, [F.lit(float(c)) * x for c, x in zip(coefficients, _features())])
    found = F.col("fits") & (F.col("rank") == F.col("first"))
    best = ranked.where(found).select("q", "br", "share", "gap", (1 / (1 + F.exp(-z))).alias("confidence")).where(F.col("confidence") >= MIN_CONFIDENCE)
    mine = store(rows.select("id", "file", "cited", "sig").join(sigs, "sig").join(best, "q").drop("q", "sig"))  # read twice
    # mutual nearest within the citing file; rows of one citation that were delivered again stand together
    near = F.struct("confidence", "share", "cited")
    top = mine.groupBy("file", "br").agg(F.max(near).alias("top")).select("file", "br", F.col("top.cited").alias("cited"))
    return mine.join(top, ["file", "br", "cited"]).select("id", "br", "share", "gap", "confidence")
