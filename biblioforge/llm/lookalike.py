"""One form for text that looks the same: widths, ligatures, marks, invisible characters, spaces, look-alikes.

Works on whole Arrow columns: the UTF-8 bytes of a batch become one array of code points, and

1. a lookup table gives each code point its replacement; those that become several (ligatures) or none
   (invisible characters) are placed by expansion offsets, the running sum of their lengths;
2. marks are put in canonical order by one sort and composed with their letters by table search, rank by
   rank over all letters at once, which gives the canonical composition (NFC);
3. in words that mix scripts, scripts of which the word has look-alike letters only give way to the other;
4. the code points become UTF-8 bytes of a new Arrow column.

No step calls a string method per row. Quotes, dashes, ellipses, line breaks, super- and subscripts, Greek
symbols of science and whole words of any script stay as they are.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORM, MARK, HIDDEN, SPACE, TWIN = 1, 2, 4, 8, 16  # what was changed in a value
_LIMIT = 0x20000  # tables are direct up to here
#: Unicode's blocks beyond that hold other than plain characters: compatibility ideographs, tags and selectors.
_FAR = ((0x2F800, 0x2FA20), (0xE0000, 0xE1000))
_LATIN, _CYRILLIC, _GREEK, _VARIANT = 1, 2, 3, 4

#: Look-alike letters, letter by letter.
_TO_LATIN = {
    _CYRILLIC: dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅ", "aeopcyxijsdhqwABEKMHOPCTYXIJS")),
    _GREEK: dict(zip("οΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oABEZHIKMNOPTYX")),
    _VARIANT: dict(zip("ɡɑɩӏӀᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏒᏕᏙᏞᏟᏢᏦᏴօհսցՕՏ", "gailIDRTAJEWMHGZRSVLCPKBohugOS")),  # and palochka, Cherokee, Armenian
}
#: Greek small letters that pass for Latin ones, though only between Latin small letters or before three of them.
_SMALL_GREEK = dict(zip("αγικντυρχ", "ayikvtupx"))
_TO_CYRILLIC = {v: k for k, v in _TO_LATIN[_CYRILLIC].items()}
_TO_GREEK = {v: k for k, v in _TO_LATIN[_GREEK].items()}
#: Greek capitals that science puts before one Latin letter (units, names), as in all-capitals titles.
_UNITS = ("ΜM", "ΜL", "ΜG", "ΜS", "ΜA", "ΜV", "ΜW", "ΚB")


class Tables:
    """Lookup tables by code point, made from Unicode's own data."""

    def __init__(self) -> None:
        codes = [*range(_LIMIT), *(c for a, b in _FAR for c in range(a, b))]
        n = len(codes)
        self.flag = np.zeros(n, np.uint8)
        self.size = np.ones(n, np.uint8)
        self.one = np.array(codes, np.int32)
        self.many: dict[int, list[int]] = {}
        self.ccc = np.zeros(n, np.uint8)
        self.script = np.zeros(n, np.uint8)
        self.nfd: dict[int, list[int]] = {}
        pairs = {}
        for i in range(0x80, n):
            c = codes[i]
            ch = chr(c)
            cat = unicodedata.category(ch)
            if cat in ("Cn", "Co", "Cs"):
                continue
            self.ccc[i] = unicodedata.combining(ch)
            dec = unicodedata.decomposition(ch)
            new = ch
            if cat == "Cf":
                new, self.flag[i] = "", HIDDEN
            elif cat == "Zs" or c in (0x115F, 0x1160, 0x3164, 0xFFA0, 0x2800):
                new, self.flag[i] = " ", SPACE
            elif dec.startswith("<"):
                k = unicodedata.normalize("NFKC", ch)
                tag = dec[1 : dec.index(">")]
                if cat[0] in "LN" and tag not in ("super", "sub", "fraction", "noBreak") and k and all(unicodedata.category(x)[0] in "LNM" for x in k) and not any(0x370 <= ord(x) < 0x400 for x in k):
                    new, self.flag[i] = k, FORM
                elif 0xFF01 <= c <= 0xFF5E or 0xFE50 <= c <= 0xFE6F:  # punctuation follows the letters' width, but is no case
                    new = ch
            elif dec:
                k = unicodedata.normalize("NFC", ch)
                if k != ch:
                    new, self.flag[i] = k, MARK
                parts = [int(x, 16) for x in dec.split()]
                if len(parts) == 2 and k == ch:
                    pairs[(parts[0] << 21) | parts[1]] = c
                self.nfd[c] = [ord(x) for x in unicodedata.normalize("NFD", ch)]
            if self.ccc[i]:
                self.flag[i] |= MARK
            if new != ch:
                self.size[i] = len(new)
                if len(new) == 1:
                    self.one[i] = ord(new)
                elif new:
                    self.many[i] = [ord(x) for x in new]
        hidden = np.array([0x034F, 0x180B, 0x180C, 0x180D, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)], np.int32)  # invisible marks
        self.flag[_low(hidden)], self.size[_low(hidden)] = HIDDEN, 0
        self.start = np.zeros(n, np.int32)
        flat: list[int] = []
        for c, x in self.many.items():
            self.start[c] = len(flat)
            flat += x
        self.flat = np.array(flat or [0], np.int32)
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_to = keys, np.array([pairs[k] for k in keys.tolist()], np.int32)
        self.second = np.zeros(n, bool)  # may compose with what stands before it
        self.second[(keys & 0x1FFFFF)[(keys & 0x1FFFFF) < n]] = True
        self.second[0x1161:0x1176] = self.second[0x11A8:0x11C3] = True
        for c in range(0x41, 0x500):
            ch = chr(c)
            if unicodedata.category(ch)[0] == "L" and ch not in "ªºµ":
                self.script[c] = _LATIN if c < 0x250 or 0x1E00 <= c < 0x1F00 else _GREEK if 0x370 <= c < 0x400 else _CYRILLIC if c >= 0x400 else 0
        self.script[0x1E00:0x1F00] = _LATIN
        for s, m in _TO_LATIN.items():
            for ch in m:
                self.script[ord(ch)] = s
        self.twin = np.zeros((5, n), np.int32)  # by target script
        for s, m in _TO_LATIN.items():
            for a, b in m.items():
                self.twin[_LATIN, ord(a)] = ord(b)
        self.small = np.zeros(n, bool)
        for a, b in _SMALL_GREEK.items():
            self.twin[_LATIN, ord(a)], self.small[ord(a)] = ord(b), True
        for t, m in ((_CYRILLIC, _TO_CYRILLIC), (_GREEK, _TO_GREEK)):
            for a, b in m.items():
                self.twin[t, ord(a)] = ord(b)

    def compose(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The composition of each pair, 0 where there is none."""
        key = (a.astype(np.int64) << 21) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        out = np.where(self.pair_keys[at] == key, self.pair_to[at], 0)
        l, v = a - 0x1100, b - 0x1161
        out = np.where((l >= 0) & (l < 19) & (v >= 0) & (v < 21), 0xAC00 + (l * 21 + v) * 28, out)
        s, t = a - 0xAC00, b - 0x11A7
        return np.where((s >= 0) & (s < 11172) & (s % 28 == 0) & (t > 0) & (t < 28), a + t, out)


@functools.cache
def tables() -> Tables:
    return Tables()


def _low(cp: np.ndarray) -> np.ndarray:
    """Places in the tables; 0 for plain characters beyond them."""
    out, at = np.where(cp < _LIMIT, cp, 0), _LIMIT
    if len(cp) and cp.max() >= _LIMIT:
        for a, b in _FAR:
            out = np.where((cp >= a) & (cp < b), cp - a + at, out)
            at += b - a
    return out


def code_points(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all values, their bounds by value); null values are empty."""
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    if col.buffers()[2] is None or off[-1] == off[0]:
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    b = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]]
    lead = (b & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    x = b[at].astype(np.int32)
    cp = x.copy()
    for k, (low, mask) in enumerate(((0xC0, 0x1F), (0xE0, 0x0F), (0xF0, 0x07)), 1):
        m = np.flatnonzero(x >= low if k == 3 else (x >= low) & (x < (0xE0, 0xF0)[k - 1]))
        if len(m):
            v = x[m] & mask
            for j in range(1, k + 1):
                v = (v << 6) | (b[at[m] + j] & 0x3F)
            cp[m] = v
    return cp, np.searchsorted(at, off - off[0]).astype(np.int64)


def to_arrow(cp: np.ndarray, bounds: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The Arrow column of code points."""
    size = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    start = end - size
    for k, mark in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        m = np.flatnonzero(size == k)
        v = cp[m]
        out[start[m]] = mark | (v >> (6 * (k - 1)))
        for j in range(1, k):
            out[start[m] + j] = 0x80 | ((v >> (6 * (k - 1 - j))) & 0x3F)
    off = np.r_[0, end][bounds].astype(np.int64)
    mask = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [mask, pa.py_buffer(off.tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.string())


def _expand(cp: np.ndarray, row: np.ndarray, size: np.ndarray, one: np.ndarray, start: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace each code point by ``size`` others, single ones from ``one``, several from ``flat``."""
    first = np.cumsum(size) - size
    src = np.repeat(np.arange(len(cp)), size)
    out = one[src]
    m = np.flatnonzero(size[src] > 1)
    out[m] = flat[start[src[m]] + (m - first[src[m]])]
    return out, row[src]


def _compose_all(cp: np.ndarray, row: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical composition; also the rows that it changed."""
    low = _low(cp)
    touched = t.second[low] | (t.ccc[low] > 0)
    hit = np.unique(row[touched])
    if not len(hit):
        return cp, row, hit
    sel = np.isin(row, hit)
    c, r = cp[sel], row[sel]
    before, before_r = c.copy(), r.copy()
    # decompose what marks may reach: letters before marks, and marks themselves
    low = _low(c)
    mark = t.ccc[low] > 0
    nxt = np.r_[mark[1:] & (r[1:] == r[:-1]), False]
    reach = np.flatnonzero(nxt | mark)
    size, start, flat = np.ones(len(c), np.int64), np.zeros(len(c), np.int64), []
    one = c.copy()
    for v in np.unique(c[reach]).tolist():
        if d := t.nfd.get(v):
            at = reach[c[reach] == v]
            size[at], start[at] = len(d), len(flat)
            if len(d) == 1:
                one[at] = d[0]
            flat += d
    c, r = _expand(c, r, size, one, start, np.array(flat or [0], np.int32))
    cc = t.ccc[_low(c)].astype(np.int64)
    starter = (cc == 0) | np.r_[True, r[1:] != r[:-1]]
    seg = np.cumsum(starter) - 1
    order = np.lexsort((np.arange(len(c)), np.where(starter & (cc == 0), 0, cc), seg))
    c, r, cc, starter, seg = c[order], r[order], cc[order], starter[order], seg[order]
    head = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    rank = np.arange(len(c)) - head[seg]
    keep = np.ones(len(c), bool)
    base, last = c[head].astype(np.int64), np.zeros(len(head), np.int64)
    for k in range(1, int(rank.max(initial=0)) + 1):
        at = np.flatnonzero(rank == k)
        s = seg[at]
        comp = t.compose(base[s], c[at])
        ok = (comp > 0) & (last[s] < cc[at]) & (cc[head[s]] == 0)
        base[s[ok]] = comp[ok]
        keep[at[ok]] = False
        last[s[~ok]] = cc[at[~ok]]
    c[head] = base
    c, r = c[keep], r[keep]
    while True:  # letters that compose with letters, left to right
        pair = np.flatnonzero((t.ccc[_low(c[1:])] == 0) & (r[1:] == r[:-1]) & t.second[_low(c[1:])])
        comp = t.compose(c[pair].astype(np.int64), c[pair + 1])
        pair, comp = pair[comp > 0], comp[comp > 0]
        if not len(pair):
            break
        free = np.r_[True, np.diff(pair) > 1]
        c[pair[free]] = comp[free]
        keep = np.ones(len(c), bool)
        keep[pair[free] + 1] = False
        c, r = c[keep], r[keep]
    new_cp, new_row = np.concatenate([cp[~sel], c]), np.concatenate([row[~sel], r])
    order = np.argsort(new_row, kind="stable")
    n = int(row.max()) + 1 if len(row) else 0
    same = np.bincount(before_r, minlength=n) == np.bincount(r, minlength=n)
    changed = np.zeros(n, bool)
    changed[hit] = ~same[hit]
    eq = same[before_r]
    eq2 = same[r]
    diff = before[eq] != c[eq2]
    changed[before_r[eq][diff]] = True
    return new_cp[order], new_row[order], np.flatnonzero(changed)


def _twins(cp: np.ndarray, row: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Look-alikes give way to the script of the rest of their word; also the rows changed."""
    low = _low(cp)
    script = t.script[low]
    foreign = np.flatnonzero(script >= _CYRILLIC)
    if not len(foreign):
        return cp, foreign
    blank = (cp == 32) | ((cp >= 9) & (cp <= 13)) | (cp == 0x3000)
    new = np.r_[True, (row[1:] != row[:-1])] | blank
    word = np.cumsum(new) - 1
    some = np.zeros(word[-1] + 1, bool)
    some[word[foreign]] = True
    at = np.flatnonzero(some[word] & (script > 0))
    w, s, c = word[at], script[at].astype(np.int64), cp[at]
    # symbols of science: a Greek letter alone before a hyphen or digit, or a unit
    nxt = np.r_[cp, 0, 0][at + 1]
    before, behind = np.r_[-1, word][at] == w, np.r_[word, -1][at + 1] == w  # neighbours count within the word only
    nxt = np.where(behind, nxt, 0)
    prev_letter = before & (np.r_[0, script][at] > 0)
    nxt_letter = behind & (np.r_[script, 0][at + 1] > 0)
    digit = ((nxt >= 48) & (nxt < 58)) | (nxt == 45) | (nxt == 0x2010) | (nxt == 0x2011) | ((nxt >= 0x2070) & (nxt < 0x20A0))
    science = (s == _GREEK) & ~prev_letter & ~nxt_letter & digit
    after = (np.r_[script, 0, 0][at + 2] > 0) & (np.r_[word, -1, -1][at + 2] == w)
    for a, b in _UNITS:
        science |= (c == ord(a)) & ~prev_letter & (nxt == ord(b)) & ~after
    n = word[-1] + 1
    count = np.bincount(w * 5 + s, minlength=n * 5).reshape(n, 5)
    alike = np.zeros((n, 5), np.int64)  # letters of a script that have a twin in Latin
    plain = (cp >= 97) & (cp <= 122)

    def plain_at(k: int) -> np.ndarray:
        i = np.clip(at + k, 0, len(cp) - 1)
        return plain[i] & (word[i] == w) & (i == at + k)

    small = t.small[_low(c)]
    passes = plain_at(-1) & plain_at(1) | ~prev_letter & plain_at(1) & plain_at(2) & plain_at(3)
    in_latin = (t.twin[_LATIN, _low(c)] > 0) & ~science & (~small | passes)
    np.add.at(alike, (w, s), in_latin)
    in_cyr, in_grk = t.twin[_CYRILLIC, _low(c)] > 0, t.twin[_GREEK, _low(c)] > 0
    lat_cyr, lat_grk = np.bincount(w[(s == _LATIN) & in_cyr], minlength=n), np.bincount(w[(s == _LATIN) & in_grk], minlength=n)
    out = np.zeros(len(cp), bool)
    result = cp.copy()

    def swap(words: np.ndarray, frm: int, to: int) -> None:
        m = at[words[w] & (s == frm)]
        result[m] = t.twin[to, _low(cp[m])]
        out[m] = True

    lat, cyr, grk, var = (count[:, k] for k in (1, 2, 3, 4))
    pure = lambda k: (count[:, k] > 0) & (alike[:, k] == count[:, k])
    # Latin words with strangers, unless the Latin letters are the strangers
    swap(pure(_VARIANT) & (lat > 0), _VARIANT, _LATIN)
    lat_alone_c = (lat > 0) & (lat_cyr == lat) & (cyr > 0)
    lat_alone_g = (lat > 0) & (lat_grk == lat) & (grk > 0) & (cyr == 0)
    both_c = lat_alone_c & pure(_CYRILLIC)
    swap(pure(_CYRILLIC) & (lat > 0) & (~lat_alone_c | both_c & (lat >= cyr)), _CYRILLIC, _LATIN)
    swap(pure(_GREEK) & (lat > 0) & (~lat_alone_g | pure(_GREEK) & (lat >= grk)), _GREEK, _LATIN)
    swap(lat_alone_c & (~pure(_CYRILLIC) | both_c & (lat < cyr)), _LATIN, _CYRILLIC)
    has_science = np.zeros(n, bool)
    has_science[w[science]] = True
    # a Greek word needs two letters of its own; a symbol beside Latin letters is no word
    swap(lat_alone_g & ~pure(_GREEK) & ~has_science & (grk - alike[:, _GREEK] >= 2), _LATIN, _GREEK)
    return result, np.unique(row[out])


def normalise(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the values in one form, flags of what was changed in each). Null stays null."""
    t = tables()
    cp, bounds = code_points(col)
    n = len(col)
    row = np.repeat(np.arange(n), np.diff(bounds))
    flags = np.zeros(n, np.uint8)
    low = _low(cp)
    f = t.flag[low]
    for bit in (FORM, MARK, HIDDEN, SPACE):
        flags[row[(f & bit) > 0]] |= bit
    if f.any():
        cp, row = _expand(cp, row, t.size[low].astype(np.int64), np.where(low > 0, t.one[low], cp), t.start[low], t.flat)
    cp, row, hit = _compose_all(cp, row, t)
    flags[hit] |= MARK
    if len(cp):
        cp, hit = _twins(cp, row, t)
        flags[hit] |= TWIN
    valid = None if not col.null_count else ~np.asarray(col.is_null())
    return to_arrow(cp, np.searchsorted(row, np.arange(n + 1)), valid), flags


def variants(df: DataFrame, id_col: str, fields: list[str], skip: callable | None = None) -> DataFrame:
    """(id, field_name, normal, flags) of each value that isn't in its one form.

    ``skip`` tells, by value, what to leave aside. Null, empty and plain values give no row, very long ones
    are read whole, repeated rows and ids give a row each; other columns are not read.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])
    own = df.select(F.col(id_col), F.explode(pairs).alias("p")).select(id_col, "p.field_name", "p.value").where(F.col("value").rlike(r"[^\x00-\x7F]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            normal, flags = normalise(batch.column(2))
            at = np.flatnonzero(flags)
            if skip is not None:
                names, values = batch.column(1).take(pa.array(at)).to_pylist(), batch.column(2).take(pa.array(at)).to_pylist()
                at = at[[not skip(a, b) for a, b in zip(names, values)]] if len(at) else at
            i = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(i), batch.column(1).take(i), normal.take(i), pa.array(flags[at].astype(np.int32))], names=[id_col, "field_name", "normal", "flags"])

    return own.mapInArrow(run, f"`{id_col}` bigint, field_name string, normal string, flags int")
