"""Flat, linked tables out of deeply nested JSON text, by vectorised structural indexing.

The text of many documents is laid end to end as bytes and indexed with whole-array operations:

1. *escape and quote bitmaps*: runs of backslashes tell which quotes are escaped; the parity of the
   running count of real quotes tells what lies inside a string;
2. *bracket and delimiter bitmap*: ``{}[]:,`` outside strings, plus the starts of strings and scalars;
3. *depth* by prefix sums over the brackets, from which each token's parent and each bracket's partner
   follow by one sort over (depth, position);
4. *grammar*: a table of allowed neighbours marks documents that are broken anywhere;
5. *spans*: members are found by comparing key bytes, array elements by their rank in the parent, and
   rows carry (document, parent number, own number) as links.

No document is parsed by a loop over its characters or values; only escapes within strings and numbers with
signs or fractions are read one by one. Wrapped documents (byte-order mark, JSON text inside a JSON string, a
one-element array) are unwrapped layer by layer and indexed again; each layer shortens the text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 4 << 20  # text indexed at once; bounds the memory of a task

_OB, _CB, _OA, _CA, _COL, _COM, _STR, _SCA, _BEG, _END = range(10)
_KIND = np.full(256, -1, np.int8)
for _c, _k in zip(b"{}[]:,\"", (_OB, _CB, _OA, _CA, _COL, _COM, _STR)):
    _KIND[_c] = _k
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\r\n")] = True

#: Which token kind may follow which; members' keys are checked apart.
_NEXT = np.zeros((10, 10), bool)
for _a, _bs in {
    _OB: (_STR, _CB), _OA: (_OB, _OA, _STR, _SCA, _CA), _COL: (_OB, _OA, _STR, _SCA),
    _COM: (_OB, _OA, _STR, _SCA), _CB: (_COM, _CB, _CA, _END), _CA: (_COM, _CB, _CA, _END),
    _STR: (_COM, _COL, _CB, _CA, _END), _SCA: (_COM, _CB, _CA, _END), _BEG: (_OB, _OA, _STR, _SCA),
}.items():
    _NEXT[_a, list(_bs)] = True

_NUMBER = re.compile(rb"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_ESCAPES = np.zeros(256, bool)
_ESCAPES[list(b'"\\/bfnrtu')] = True
_BLANK_HEAD = np.zeros(256, bool)  # first bytes of white space or of an escape
_BLANK_HEAD[list(b" \t\\\xc2\xe2\xe3\xef")] = True


@dataclass
class Index:
    """Tokens of all documents of a slice, in order of position."""

    raw: np.ndarray  # bytes
    pos: np.ndarray  # first byte
    end: np.ndarray  # one past the last byte of the token, or of the bracket's partner
    kind: np.ndarray
    doc: np.ndarray
    parent: np.ndarray  # token number of the enclosing bracket, -1 at the top
    value: np.ndarray  # is a value, not a key or delimiter
    key: np.ndarray  # token number of its key, -1 without
    good: np.ndarray  # by document
    root: np.ndarray  # by document: token number of the top value, -1 without

    def text(self, i: int) -> str | None:
        """String content, or the literal text of a scalar; None for null and brackets."""
        s = self.raw[self.pos[i] : self.end[i]].tobytes()
        if self.kind[i] == _STR:
            return json.loads(s) if b"\\" in s else s[1:-1].decode("utf-8", "replace")
        return None if self.kind[i] in (_OB, _OA) or s == b"null" else s.decode()

    def has_key(self, name: bytes) -> np.ndarray:
        """Value tokens whose key is that name; escaped keys are decoded one by one, they are rare."""
        at = np.flatnonzero(self.value & (self.key >= 0))
        k = self.key[at]
        size = self.end[k] - self.pos[k] - 2
        same = size == len(name)
        for j, b in enumerate(name):
            m = np.flatnonzero(same)
            same[m] = self.raw[self.pos[k[m]] + 1 + j] == b
        odd = np.flatnonzero(size >= len(name) + 5)
        for j in odd:
            if b"\\" in (s := self.raw[self.pos[k[j]] : self.end[k[j]]].tobytes()):
                same[j] = json.loads(s) == name.decode()
        return at[same]

    def members(self, name: bytes, of: np.ndarray) -> np.ndarray:
        """For each bracket token of ``of`` its last member of that name, else -1."""
        out = np.full(len(self.pos) + 1, -1)
        at = self.has_key(name)
        out[self.parent[at]] = at  # a later key overwrites an earlier one
        return np.where(of >= 0, out[of], -1)

    def elements(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Elements of array tokens: (token, place in ``of``, number from 1)."""
        where = np.full(len(self.pos) + 1, -1)
        where[of] = np.arange(len(of))
        at = np.flatnonzero(self.value & (self.parent >= 0) & (where[self.parent] >= 0))
        order = np.argsort(where[self.parent[at]], kind="stable")
        at = at[order]
        group = where[self.parent[at]]
        first = np.r_[True, group[1:] != group[:-1]] if len(at) else np.zeros(0, bool)
        start = np.flatnonzero(first)
        number = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)])) + 1
        return at, group, number

    def blank(self, at: np.ndarray) -> np.ndarray:
        """Null, empty or white-space strings, empty brackets."""
        out = np.zeros(len(at), bool)
        k = self.kind[at]
        null = np.flatnonzero(k == _SCA)
        out[null] = self.raw[self.pos[at[null]]] == ord("n")
        nxt = np.minimum(at + 1, len(self.pos) - 1)
        out |= ((k == _OB) & (self.kind[nxt] == _CB)) | ((k == _OA) & (self.kind[nxt] == _CA))
        text = np.flatnonzero(k == _STR)
        size = self.end[at[text]] - self.pos[at[text]] - 2
        out[text[size == 0]] = True
        head = self.raw[self.pos[at[text]] + np.minimum(size, 1)]
        for i in text[(size > 0) & _BLANK_HEAD[head]]:
            out[i] = not (self.text(at[i]) or "").strip(" \t\r\n\xa0\u200b\ufeff\u3000")
        return out


def index(raw: np.ndarray, starts: np.ndarray) -> Index:
    """Structural index of documents laid end to end; ``starts`` has their bounds."""
    n, docs = len(raw), len(starts) - 1
    bs = raw == 92
    escaped = np.zeros(n, bool)
    at = np.flatnonzero(bs)
    if len(at):  # a byte is escaped after an odd run of backslashes
        first = np.r_[True, np.diff(at) > 1]
        run = np.cumsum(first) - 1
        nth = at - at[first][run]
        odd = at[(nth % 2 == 0) & (at + 1 < n)]
        escaped[odd + 1] = True
    quote = (raw == 34) & ~escaped
    count = np.cumsum(quote, dtype=np.int32)
    before = np.r_[0, count][starts[:-1]]
    size = np.diff(starts)
    inside = ((count - np.repeat(before, size)) & 1).astype(bool)  # opening quote and content
    kind = np.where(inside | quote, -1, _KIND[raw])
    opening = quote & inside
    kind[opening] = _STR
    plain = ~inside & ~quote & (kind < 0) & ~_SPACE[raw]
    edge = np.zeros(n, bool)
    edge[starts[:-1][size > 0]] = True
    begins = plain & (edge | ~np.r_[False, plain[:-1]])
    kind[begins] = _SCA
    pos = np.flatnonzero(kind >= 0)
    kind = kind[pos]
    doc = np.searchsorted(starts, pos, "right") - 1
    t = len(pos)
    good = np.ones(docs, bool)
    good[size == 0] = False
    good &= ((np.r_[0, count][starts[1:]] - before) & 1) == 0

    end = pos + 1
    closing = np.flatnonzero(quote & ~inside)
    s = np.flatnonzero(kind == _STR)
    j = np.searchsorted(closing, pos[s])
    end[s] = np.where(j < len(closing), closing[np.minimum(j, max(len(closing) - 1, 0))] + 1, n) if len(closing) else n
    stops = np.flatnonzero(~plain)
    c = np.flatnonzero(kind == _SCA)
    j = np.searchsorted(stops, pos[c])
    end[c] = np.minimum(np.where(j < len(stops), stops[np.minimum(j, max(len(stops) - 1, 0))] if len(stops) else n, n), starts[doc[c] + 1])

    opens = (kind == _OB) | (kind == _OA)
    closes = (kind == _CB) | (kind == _CA)
    level = np.cumsum(opens.astype(np.int32) - closes)
    base = np.r_[0, level][np.searchsorted(pos, starts[:-1])]
    depth = level - base[doc] - opens  # of the container; an opener and its closer share it
    low = np.zeros(docs, np.int32)
    np.minimum.at(low, doc, depth)
    last = np.r_[0, level][np.searchsorted(pos, starts[1:])] - base
    good &= (low >= 0) & (last == 0)

    # parent: the last opener of depth-1; partner: the next token at the same depth
    parent = np.full(t, -1)
    br = np.flatnonzero(opens | closes)
    order = br[np.lexsort((br, depth[br], doc[br]))]
    a, b = order[:-1], order[1:]
    pair = opens[a] & closes[b] & (depth[a] == depth[b]) & (doc[a] == doc[b])
    partner = np.full(t, -1)
    partner[a[pair]], partner[b[pair]] = b[pair], a[pair]
    wrong = (opens | closes) & (partner < 0)
    wrong[a[pair]] |= kind[a[pair]] + 1 != kind[b[pair]]
    good[doc[wrong]] = False
    op = np.flatnonzero(opens & (partner >= 0))
    end[op] = pos[partner[op]] + 1
    o2 = op[np.lexsort((op, depth[op], doc[op]))]
    width = int(depth.max(initial=0)) + 2
    code = (doc[o2].astype(np.int64) * width + depth[o2]) * (t + 1) + o2
    want = (doc.astype(np.int64) * width + depth - 1) * (t + 1) + np.arange(t)
    j = np.searchsorted(code, want) - 1
    ok = (j >= 0) & (depth > 0)
    jj = np.where(ok, j, 0)
    if len(o2):
        cand = o2[jj]
        ok &= (doc[cand] == doc) & (depth[cand] == depth - 1)
        parent[ok] = cand[ok]

    # grammar by neighbours
    first = np.r_[True, doc[1:] != doc[:-1]] if t else np.zeros(0, bool)
    prev = np.where(first, _BEG, np.r_[_BEG, kind[:-1]] if t else kind)
    bad = ~_NEXT[prev, kind]
    final = np.r_[first[1:], True] if t else first
    bad |= final & ~_NEXT[kind, _END]
    in_obj = np.zeros(t, bool)
    hp = parent >= 0
    in_obj[hp] = kind[parent[hp]] == _OB
    nxt_colon = np.r_[kind[1:] == _COL, False] & ~final if t else first
    is_key = (kind == _STR) & nxt_colon
    bad |= is_key & ~in_obj
    bad |= (kind == _COL) & ~np.r_[False, is_key[:-1]] if t else False
    value = opens | (kind == _STR) & ~is_key | (kind == _SCA)
    after_colon = (prev == _COL) & ~first
    bad |= value & in_obj & ~after_colon
    bad |= value & ~in_obj & after_colon
    bad |= (kind == _COM) & ~hp  # no commas at the top
    bad |= value & ~hp & ~first  # one top value
    bad |= is_key & (prev != _OB) & (prev != _COM)
    # scalars: literals or numbers
    first_at, size_of = pos[c], end[c] - pos[c]
    digits = np.r_[0, np.cumsum((raw >= 48) & (raw <= 57))]
    fine = (digits[end[c]] - digits[first_at] == size_of) & ((size_of == 1) | (raw[first_at] != 48))
    for word in (b"true", b"false", b"null"):
        m = np.flatnonzero(size_of == len(word))
        fine[m] |= np.all([raw[first_at[m] + j] == x for j, x in enumerate(word)], axis=0)
    for i in c[~fine]:  # signs, fractions, exponents, and what is broken
        bad[i] |= _NUMBER.fullmatch(raw[pos[i] : end[i]].tobytes()) is None
    good[doc[bad]] = False
    # string content: known escapes, four digits after \u, no control characters
    if len(at):
        e = odd + 1
        e = e[inside[e]]
        wrong_e = ~_ESCAPES[raw[e]]
        u = e[raw[e] == 117]
        for d in range(1, 5):
            q = np.minimum(u + d, n - 1)
            good[np.searchsorted(starts, u[~_HEX[raw[q]]], "right") - 1] = False
        good[np.searchsorted(starts, e[wrong_e], "right") - 1] = False
    ctl = np.flatnonzero((raw < 32) & inside)
    good[np.searchsorted(starts, ctl, "right") - 1] = False

    key = np.where(after_colon & value, np.arange(t) - 2, -1)
    root = np.full(docs, -1)
    root[doc[first]] = np.flatnonzero(first)
    root[~good] = -1
    return Index(raw, pos, end, kind, doc, parent, value, key, good, root)


def _unwrapped(ix: Index) -> tuple[np.ndarray, list[int], list[bytes]]:
    """Documents whose top is an object; for those wrapped otherwise, the inner text to index next."""
    if not len(ix.kind):
        return np.zeros(len(ix.good), bool), [], []
    top = np.where(ix.root >= 0, ix.kind[ix.root], -1)
    again, texts = [], []
    for d in np.flatnonzero(top == _STR):
        again.append(d)
        texts.append((ix.text(ix.root[d]) or "").strip().removeprefix("﻿").encode("utf-8", "replace"))
    arrays = np.flatnonzero(top == _OA)
    if len(arrays):
        el, g, num = ix.elements(ix.root[arrays])
        many = np.bincount(g, minlength=len(arrays))
        for e, i in zip(el, g):
            if many[i] == 1 and ix.kind[e] in (_OB, _STR):
                again.append(arrays[i])
                texts.append(ix.raw[ix.pos[e] : ix.end[e]].tobytes())
    return top == _OB, again, texts


def _lay(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(x) for x in texts], dtype=np.int64)].astype(np.int64)


def documents_of(texts: list[bytes]) -> Iterator[tuple[Index, np.ndarray, np.ndarray]]:
    """(index, number of the document in ``texts`` by the index's documents, whether its top is an object)."""
    ids = np.arange(len(texts))
    while texts:
        ix = index(*_lay(texts))
        obj, again, inner = _unwrapped(ix)
        yield ix, ids, obj
        ids, texts = ids[again] if len(again) else ids[:0], inner


def linked(ix: Index, obj: np.ndarray) -> dict[str, np.ndarray]:
    """Spans of messages, references and authors with their links.

    A lone object stands for an array of one. A null reference keeps its number and gives none. A
    reference without author (absent, null, blank or empty) gives one author row numbered 0; blank
    authors within an array keep their number and give no row while another author is given.
    """
    docs = np.flatnonzero(obj)
    msg = ix.members(b"message", ix.root[docs])
    has = (msg >= 0) & (ix.kind[msg] == _OB)
    docs, msg = docs[has], msg[has]
    ref = ix.members(b"reference", msg)
    k = np.where(ref >= 0, ix.kind[ref], -1)
    arr = np.flatnonzero(k == _OA)
    el, g, num = ix.elements(ref[arr])
    lone = np.flatnonzero((k == _OB) | (k == _STR) & ~ix.blank(np.maximum(ref, 0)) if len(ref) else k == _OB)
    r_tok = np.r_[el, ref[lone]]
    r_msg = np.r_[arr[g], lone].astype(np.int64)
    r_num = np.r_[num, np.ones(len(lone), np.int64)].astype(np.int64)
    keep = ~((ix.kind[r_tok] == _SCA) & (ix.raw[ix.pos[r_tok]] == ord("n")))
    r_tok, r_msg, r_num = r_tok[keep], r_msg[keep], r_num[keep]

    au = ix.members(b"author", np.where(ix.kind[r_tok] == _OB, r_tok, -1))
    k = np.where(au >= 0, ix.kind[au], -1)
    arr = np.flatnonzero(k == _OA)
    el, g, num = ix.elements(au[arr])
    one = np.flatnonzero((au >= 0) & (k != _OA))
    a_tok, a_ref = np.r_[el, au[one]], np.r_[arr[g], one].astype(np.int64)
    a_num = np.r_[num, np.ones(len(one), np.int64)].astype(np.int64)
    none = ix.blank(a_tok)
    objs = np.flatnonzero((ix.kind[a_tok] == _OB) & ~none)
    named = np.zeros(len(objs), bool)
    for name in (b"family", b"family-name", b"name", b"given", b"literal", b"ORCID"):
        m = ix.members(name, a_tok[objs])
        named |= (m >= 0) & ~ix.blank(np.maximum(m, 0))
    none[objs] = ~named
    a_tok, a_ref, a_num = a_tok[~none], a_ref[~none], a_num[~none]
    without = np.setdiff1d(np.arange(len(r_tok)), a_ref)
    a_tok = np.r_[a_tok, np.full(len(without), -1)].astype(np.int64)
    a_ref = np.r_[a_ref, without].astype(np.int64)
    a_num = np.r_[a_num, np.zeros(len(without), np.int64)].astype(np.int64)
    return {"doc": docs, "msg": msg, "r_tok": r_tok, "r_msg": r_msg, "r_num": r_num, "a_tok": a_tok, "a_ref": a_ref, "a_num": a_num}


def _strings(ix: Index, toks: np.ndarray) -> pa.Array:
    """Strings' contents and scalars' literals by one gather of their bytes; null for -1, null and brackets."""
    if not len(toks):
        return pa.array([], pa.string())
    tok = np.maximum(toks, 0)
    is_text = (toks >= 0) & (ix.kind[tok] == _STR)
    start, n = np.where(is_text, ix.pos[tok] + 1, 0), np.where(is_text, ix.end[tok] - ix.pos[tok] - 2, 0)
    off = np.r_[0, np.cumsum(n)].astype(np.int64)
    data = ix.raw[np.arange(off[-1]) + np.repeat(start - off[:-1], n)]
    mask = pa.py_buffer(np.packbits(is_text, bitorder="little").tobytes())
    col = pa.Array.from_buffers(pa.large_string(), len(toks), [mask, pa.py_buffer(off.tobytes()), pa.py_buffer(data.tobytes())])
    slashes = np.r_[0, np.cumsum(data == 92)]
    odd = (slashes[off[1:]] > slashes[off[:-1]]) | (toks >= 0) & (ix.kind[tok] == _SCA)
    try:
        col.validate(full=True)
    except pa.ArrowInvalid:
        odd |= is_text  # bytes that are no UTF-8 are replaced one by one
        col = pa.nulls(len(toks), pa.large_string())
    if odd.any():
        col = pc.replace_with_mask(col, pa.array(odd), pa.array([ix.text(t) for t in toks[odd]], pa.large_string()))
    return col.cast(pa.string())


def _first(ix: Index, tok: np.ndarray) -> np.ndarray:
    """An array's first element in place of the array."""
    out = tok.copy()
    at = np.flatnonzero((tok >= 0) & (ix.kind[np.maximum(tok, 0)] == _OA))
    if len(at):
        uniq, inv = np.unique(tok[at], return_inverse=True)
        el, g, num = ix.elements(uniq)
        head = np.full(len(uniq), -1)
        head[g[num == 1]] = el[num == 1]
        out[at] = head[inv]
    return out


SCHEMAS = {
    "ids": "raw_id bigint, ref_index int, author_index int",
    "documents": "raw_id bigint, doc_doi string, doc_title string, n_references int",
    "references": "raw_id bigint, ref_index int, ref_key string, doi string, article_title string, year string, volume string, first_page string, unstructured string",
    "authors": "raw_id bigint, ref_index int, author_index int, family string, given string",
}


def _rows(ix: Index, obj: np.ndarray, what: str, ids: np.ndarray) -> list[np.ndarray | pa.Array]:
    x = linked(ix, obj)
    doc = ids[x["doc"]]
    if what == "documents":
        n = np.bincount(x["r_msg"], minlength=len(doc)).astype(np.int32)
        return [doc, _strings(ix, ix.members(b"DOI", x["msg"])), _strings(ix, _first(ix, ix.members(b"title", x["msg"]))), n]
    r_doc, r_num = doc[x["r_msg"]], x["r_num"].astype(np.int32)
    if what == "references":
        of = np.where(ix.kind[x["r_tok"]] == _OB, x["r_tok"], -1)
        get = lambda *names: _strings(ix, _coalesce(ix, of, names))
        return [r_doc, r_num, get(b"key"), get(b"DOI"), get(b"article-title", b"title"), get(b"year"), get(b"volume"), get(b"first-page", b"page"), get(b"unstructured")]
    a_num = x["a_num"].astype(np.int32)
    links = [r_doc[x["a_ref"]], r_num[x["a_ref"]], a_num]
    if what == "ids":
        return links
    tok = x["a_tok"]
    of = np.where((tok >= 0) & (ix.kind[tok] == _OB), tok, -1)
    family = _strings(ix, np.where(of >= 0, _coalesce(ix, of, (b"family", b"family-name", b"name")), tok))
    return [*links, family, _strings(ix, ix.members(b"given", of))]


def _coalesce(ix: Index, of: np.ndarray, names: tuple[bytes, ...]) -> np.ndarray:
    out = np.full(len(of), -1)
    for n in names:
        m = _first(ix, ix.members(n, of))
        usable = (m >= 0) & ~ix.blank(np.maximum(m, 0)) if len(m) else m >= 0
        out = np.where((out < 0) & usable, m, out)
    return out


def flatten(df: DataFrame, what: str = "ids", id_col: str = "raw_id", payload_col: str = "payload") -> DataFrame:
    """One of the linked tables ``documents``, ``references``, ``authors``, or the bare links ``ids``.

    Children carry their parents' numbers: ``raw_id`` -> ``ref_index`` -> ``author_index``, counted from 1.
    Null, empty and unreadable payloads, and those without a message object or references, give no row
    (in ``documents``: none without a message object). Repeated rows give repeated rows. Other columns of
    ``df`` are not read, whatever their names. An empty table gives an empty table.
    """
    schema = SCHEMAS[what]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:

        fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
        out_schema = pa.schema([(n, kinds[k]) for n, k in fields])
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).cast(pa.large_binary())
            start = 0
            while start < len(ids):
                stop, size = start, 0
                piece: list[bytes] = []
                while stop < len(ids) and (size < SLICE_BYTES or not piece):
                    s = texts[stop].as_py() or b""
                    s = s.strip().removeprefix(b"\xef\xbb\xbf")
                    piece.append(s)
                    size += len(s)
                    stop += 1
                own = ids[start:stop]
                for ix, num, obj in documents_of(piece):
                    cols = _rows(ix, obj, what, own[num])
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, out_schema)], schema=out_schema)
                start = stop

    return df.selectExpr(f"cast(`{id_col}` as bigint) id", f"cast(`{payload_col}` as string) payload").where("id is not null").mapInArrow(run, schema)
