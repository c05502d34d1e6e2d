"""Duplicates hidden by formatting, collapsed to one record per canonical key, safe against hot keys.

A canonical key is a native column expression, computed once a row and stored with the row's identifier and
group. Hot keys are found exactly: one count per key hash with map-side partial counts. They stay a table, of any
length, and meet the rows by key and salt, so no hot key's rows come together in one task. Rows of hot keys are
aggregated in two levels (key and salt, then key), the rest by one shuffle. The representative is the row of
smallest identifier. The stored table and the question whether there are hot keys at all are jobs that run while
the query is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store

HOT_ROWS = 100_000  # rows from which a key counts as hot; also bounds a cold key's rows in one task
SALTS = 64

_BLANKS = r"[\s\x{00AD}\x{00A0}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{2064}\x{3000}\x{FEFF}]+"
_TAIL = r"[.,;:\"'<>\]}?!\x{2026}]"
_DASHES = r"[\x{2010}-\x{2015}\x{2212}\x{FE58}\x{FE63}\x{FF0D}]"


def _unescaped(x: Column) -> Column:
    """Named and numeric entities of ASCII characters as these; ``&amp;`` first, as escapes are escaped again."""
    for name, to in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " ")):
        x = F.replace(x, F.lit(f"&{name};"), F.lit(to))

    def piece(p: Column, i: Column) -> Column:
        digits = F.regexp_extract(p, r"^(x[0-9a-f]{1,6}|[0-9]{1,7});", 1)
        code = F.when(digits.startswith("x"), F.conv(F.substring(digits, 2, 6), 16, 10)).otherwise(digits).cast("int")
        return F.when(i == 0, p).when((digits != "") & code.between(1, 127), F.concat(F.char(code), F.regexp_replace(p, "^[^;]*;", ""))).otherwise(F.concat(F.lit("&#"), p))

    return F.when(x.contains("&#"), F.array_join(F.transform(F.split(x, "&#"), piece), "")).otherwise(x)


def canonical_doi(c: Column) -> Column:
    """One form of a DOI, or null where the value holds none.

    Letter case, white space, scheme or resolver prefix, escapes, enclosing or trailing punctuation and
    the style of a dash are formatting. A closing bracket that has its opening one within the DOI stays.
    Blanks, lone marks and ``N/A`` give null.
    """
    x = F.regexp_replace(F.lower(c), r"%(?![0-9a-f]{2})", "%25")
    x = F.url_decode(F.replace(x, F.lit("+"), F.lit("%2b")))
    x = F.when(x.contains("&"), _unescaped(x)).otherwise(x)
    x = F.regexp_replace(F.regexp_replace(F.lower(x), _BLANKS, ""), _DASHES, "-")
    x = F.replace(x, F.lit("\\"), F.lit(""))
    x = F.regexp_replace(x, r"^.*?(?=10\.[0-9][0-9.]*/)", "")
    x = F.regexp_replace(x, r"^(?:[\[(<{\"'.,;:]|https?://|(?:www\.|dx\.)*doi\.org/|info:doi/|urn:doi:|doi:?)+", "")
    x = F.regexp_replace(x, _TAIL + "+$", "")
    x = F.regexp_replace(x, rf"^((?:[^()]++|\([^()]*+\))*+)\)(?:\)|{_TAIL})*$", "$1")  # a closing bracket too many
    x = F.regexp_replace(x, _TAIL + "+$", "")
    return F.nullif(F.regexp_extract(x, r"^(?!(?:n/a|na|none|null|nan)$)(.*[a-z0-9].*)$", 1), F.lit(""))


def _split_hot(rows: DataFrame, hot_rows: int, salts: int) -> tuple[DataFrame, DataFrame | None]:
    """(cold rows, hot rows with ``salt`` or None). ``rows`` is stored and has ``kh``, a hash of the key."""
    hot = rows.groupBy("kh").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= hot_rows).select("kh")
    hot = store(hot)
    if hot.isEmpty():
        return rows, None
    # by key and salt: whether the hot keys' table is broadcast follows from its size alone
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    keys = hot.select("kh", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return salted.join(keys, ["kh", "salt"], "left_anti").drop("salt"), salted.join(keys, ["kh", "salt"], "left_semi")


def duplicates(rows: DataFrame, id_col: str, group_col: str, key: Column, hot_rows: int = HOT_ROWS, salts: int = SALTS, keep: Column | None = None) -> DataFrame:
    """(keep_id, dup_id), and ``keep`` made of the group ``g``, for each row whose key also stands in a row of smaller id of the same group.

    Null groups, keys and ids take no part. An id that occurs again counts as the same row. Empty input gives
    an empty result. Other columns are not read.
    """
    own = store(rows.select(F.col(id_col).alias("id"), F.col(group_col).alias("g"), key.alias("k")).where("id is not null and g is not null and k is not null")).withColumn("kh", F.xxhash64("g", "k"))
    extra = [keep] if keep is not None else []
    cold, hot = _split_hot(own, hot_rows, salts)
    # a cold key has fewer than hot_rows rows, so its list of ids is bounded
    out = cold.groupBy("g", "k").agg(F.min("id").alias("keep_id"), F.collect_list("id").alias("ids")).where(F.size("ids") > 1).select(*extra, "keep_id", F.explode("ids").alias("dup_id"))
    if hot is None:
        return out.where("dup_id > keep_id")
    best = hot.groupBy("g", "k", "salt").agg(F.min("id").alias("keep_id")).groupBy("g", "k").agg(F.min("keep_id").alias("keep_id"))
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dups = hot.join(best, ["g", "k", "salt"]).select(*extra, "keep_id", F.col("id").alias("dup_id"))
    return out.unionByName(dups).where("dup_id > keep_id").distinct()


def collapsed(rows: DataFrame, id_col: str, key: Column, hot_rows: int = HOT_ROWS, salts: int = SALTS, within: tuple[str, ...] = ()) -> DataFrame:
    """One record per key, within the groups of the columns ``within``: (*within, canonical_key, keep_id, n_copies). Null keys and groups give none."""
    known = " and ".join(f"{c} is not null" for c in ("k", *within))
    own = store(rows.select(*within, F.col(id_col).alias("id"), key.alias("k")).where(known)).withColumn("kh", F.xxhash64(*within, "k"))
    cold, hot = _split_hot(own, hot_rows, salts)
    agg = lambda d: d.agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies"))
    out = agg(cold.groupBy(*within, "k"))
    if hot is not None:
        part = agg(hot.groupBy(*within, "k", "salt"))
        out = out.unionByName(part.groupBy(*within, "k").agg(F.min("keep_id").alias("keep_id"), F.sum("n_copies").alias("n_copies")))
    return out.select(*within, F.col("k").alias("canonical_key"), "keep_id", "n_copies")
