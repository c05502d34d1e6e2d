"""Personal items in free text: a linear-chain conditional random field over word-shape features.

Texts are cut into tokens; numbers with their separators, identifiers of letters and digits, and e-mail
addresses, also spelt out, are one token each. A token's features are its shape, case, length, suffix, small
word lists, and the word itself where the labelled table knows it; a position sees the features of two
tokens on either side. Weights come from maximum likelihood on the small labelled table in ``pii_rows``
(forward-backward, AdaGrad), in a few seconds on the driver. Since features belong to token types, each
type's scores are summed once; a batch is then decoded by gathers and one Viterbi pass over all its
sentences at a time, in numpy.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pii_rows

TYPES = ("name", "email", "phone", "identity", "address")
LABELS = ["O"] + [f"{p}-{t}" for t in TYPES for p in ("B", "I")]
OFFSETS = (-2, -1, 0, 1, 2)
COPIES, EPOCHS, RATE, PENALTY, SEED = 10, 12, 0.25, 1e-5, 5  # training
BATCH = 64
SLICE_CHARS = 2_000_000  # text decoded at once; bounds the memory of a task

_AT, _DOT = r"(?:\s?@\s?|\s?[(\[]\s?(?i:at)\s?[)\]]\s?|\sAT\s)", r"(?:\.|\s?[(\[]\s?(?i:dot)\s?[)\]]\s?|\sDOT\s)"
_EMAIL = rf"[\w.+-]*\w{_AT}[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[A-Za-z]{{2,}}"
_CODE = r"\b[A-Z]{1,2}\d{1,2} \d[A-Z]{2}\b|\b(?!ID |NI |DNI |NIF |NIE |SSN |TIN |NO |MS |AD |BC |XX )[A-Z]{1,3}[ -]?\d[\d ]*\d(?: ?[A-Z])?\b(?![./-]\d)"
_NUMBER = r"\(?\+?\(?\d+(?:(?:[./-]|[  ]|\) ?[-/]?| ?\()\d+)*(?:\d[A-Za-z]\b|-?[A-Z]\b)?\)?(?!\w)"
_REST = rf"{_CODE}|{_NUMBER}|[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+|\n+|.)[ \t]*|\s"
TOKEN = re.compile(rf"(?:{_EMAIL}|{_REST}", re.S)
PLAIN = re.compile(rf"(?:{_REST}", re.S)
_MAYBE_EMAIL = re.compile(r"@\s?[A-Za-z]|[(\[]\s?(?i:at)\s?[)\]]|\sAT\s")
_NINES = str.maketrans("012345678", "999999999")

_GIVEN = {w.lower() for w in pii_rows.GIVEN}
_TITLE = {"ms", "mr", "mrs", "dr", "prof", "frau", "herr", "herrn", "mme", "mlle", "sra", "sr", "dra", "don", "doña", "miss", "sir"}
_PARTS = {"van", "von", "der", "de", "la", "del", "ter", "du", "di", "da", "zu", "den", "des"}
_STREET = {"street", "st", "road", "rd", "lane", "avenue", "ave", "crescent", "close", "blvd", "court", "way", "drive", "square", "rue", "bd", "boulevard", "place", "calle", "avda", "avenida", "plaza", "c", "flat", "apt", "paseo", "allee", "quai"}


class _Shapes(dict):
    """What each character looks like, worked out once: letters of Western Europe by case, digits, others as they are."""

    def __missing__(self, c: int) -> str:
        ch = chr(c)
        self[c] = out = "9" if ch.isdecimal() else "a" if "a" <= ch <= "z" or "ß" <= ch <= "ö" or "ø" <= ch <= "ÿ" else "A" if "A" <= ch <= "Z" or "À" <= ch <= "Ö" or "Ø" <= ch <= "Þ" else ch
        return out


_SHAPES, _RUNS = _Shapes(), re.compile(r"(.)\1{2,}")
_WHOLE_EMAIL, _STREETS, _DIGITS = re.compile(_EMAIL), re.compile(r"(?:str|straße|weg|platz|gasse)$"), re.compile(r"\d+")


def shape(w: str) -> str:
    return _RUNS.sub(r"\1\1+", w.translate(_SHAPES))


def tokens(text: str) -> list[str]:
    """Pieces that tile the text, each with the blanks after it."""
    return (TOKEN if _MAYBE_EMAIL.search(text) else PLAIN).findall(text)


def features(piece: str) -> list[str]:
    """Features of a token type."""
    w = piece.rstrip(" \t")
    if not w:
        return ["blank"]
    low = w.lower()
    if w[0] == "\n":
        return ["newline"]
    if len(w) > 5 and ("@" in w or " " in w) and _WHOLE_EMAIL.fullmatch(w):
        return ["email"]
    digits = sum(c.isdigit() for c in w)
    if digits:
        groups = _DIGITS.sub(lambda m: str(len(m[0])), w)
        out = ["num", "s:" + shape(w), f"d:{digits}", "g:" + groups[:24], "h:" + w[:2]]
        out += ["plus"] * (w[0] == "+" or w[:2] == "(+") + ["paren"] * (w[0] == "(") + ["letters"] * any(c.isalpha() for c in w) + ["spaces"] * (" " in w) + ["dashes"] * ("-" in w) + [f"long{min(digits, 12) // 3}"] + ["caps2"] * w[:2].isalpha()
        return out
    if not w[0].isalpha():
        return ["p:" + w]
    out = ["w:" + low, "s:" + shape(w), f"n:{min(len(w), 6)}"]
    if low in _GIVEN:
        out.append("given")
    if low in _TITLE:
        out.append("title")
    if low in _PARTS:
        out.append("part")
    if low in _STREET or len(low) > 4 and _STREETS.search(low):
        out.append("street")
    if w[0].isupper():
        out.append("initial" if len(w) == 1 else "inits" if w == w.upper() and len(w) < 4 else "caps" if w == w.upper() else "cap")
    else:
        out.append("low")
    out.append("e:" + low[-3:])
    if "-" in w:
        out.append("hyphen")
    return out


class Model:
    """Weights, and scores of the token types met so far in this process."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, trans: np.ndarray, start: np.ndarray) -> None:
        self.names, self.weights, self.trans, self.start = names, weights, trans, start
        self.clear()

    def __getstate__(self) -> tuple:
        return self.names, self.weights, self.trans, self.start

    def __setstate__(self, s: tuple) -> None:
        self.__init__(*s)

    def clear(self) -> None:
        self.ids: dict[str, int] = {"": 0}
        self.n = 0
        self.scores = np.zeros((1024, len(OFFSETS), len(LABELS)), np.float32)
        self.scores[0, OFFSETS.index(0), 1:] = -1e3  # padding is no item
        self.alike: dict[str, int] = {}
        self.kinds = np.zeros(1024, np.uint8)  # 1 ends a sentence, 2 may begin one, 4 may stand before its end

    def add(self, piece: str) -> int:
        key = ""
        if any(c in "0123456789" for c in piece[:3]) and len(piece) < 40:  # numbers alike but for later digits score alike
            key = piece[:2] + piece[2:].translate(_NINES)
            if (i := self.alike.get(key)) is not None:
                self.ids[piece] = i
                return i
        self.n += 1
        i = self.n
        if key:
            self.alike[key] = i
        if i >= len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.kinds = np.concatenate([self.kinds, np.zeros_like(self.kinds)])
        f = [self.names[x] for x in features(piece) if x in self.names]
        self.scores[i] = self.weights[:, f].sum(axis=1)
        w = piece.strip(" \t")
        self.kinds[i] = 1 * (w in (".", "?", "!") and piece != w) | 2 * (w[:1].isupper()) | 4 * (len(w) > 3 and w.islower()) | 8 * (w[:1] == "\n")
        self.ids[piece] = i
        return i


def _emissions(model: Model, ids: np.ndarray) -> np.ndarray:
    """Scores by position; two paddings part the texts."""
    out = np.zeros((len(ids), len(LABELS)), np.float32)
    n = len(ids)
    for k, o in enumerate(OFFSETS):
        src = np.clip(np.arange(n) + o, 0, n - 1)
        out += model.scores[ids[src], k]
    return out


def viterbi(em: np.ndarray, trans: np.ndarray, start: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Best labels of all sentences, longest first, one step over all of them at a time."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    size, first = size[order], bounds[:-1][order]
    n = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, n + 1), "right")  # sentences that have a k-th token
    back = np.zeros((len(em), em.shape[1]), np.int8)
    labels = np.zeros(len(em), np.int8)
    score = start + em[first[: active[0]]] if n else None
    finals = np.zeros(len(size), np.int8)
    m = em.shape[1]
    into, rows = np.ascontiguousarray(trans.T), np.arange(len(size) * m) * m  # from the label before, last
    for k in range(1, n):
        a = active[k]
        if a < len(score):
            finals[a : len(score)] = score[a:].argmax(axis=1)
            score = score[:a]
        cand = score[:, None, :] + into
        at = first[:a] + k
        best = cand.argmax(axis=2)
        back[at] = best
        score = cand.reshape(-1)[rows[: a * m] + best.reshape(-1)].reshape(a, m) + em[at]
    if n:
        finals[: len(score)] = score.argmax(axis=1)
    cur = finals.copy()
    for k in range(n - 1, -1, -1):
        a = active[k]
        at = first[:a] + k
        labels[at] = cur[:a]
        if k:
            cur[:a] = back[at, cur[:a]]
    return labels


def _cuts(model: Model, ids: np.ndarray) -> np.ndarray:
    """Where sentences begin: after a full stop that follows a plain word and precedes a capital."""
    k = model.kinds[ids]
    begin = np.zeros(len(ids), bool)
    if len(ids):
        begin[0] = True
        begin[2:] = (k[1:-1] & 1 > 0) & (k[2:] & 2 > 0) & (k[:-2] & 4 > 0)
    return begin


def spans(model: Model, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """(start, end, type) of the items of each text; positions from 0 in characters."""
    ids: list[int] = []
    lens: list[int] = []
    at = [0]
    get, add = model.ids.get, model.add
    if len(model.ids) > 400_000:
        model.clear()
        get = model.ids.get
    for t in texts:
        pieces = tokens(t)
        ids += [0, 0]
        lens += [0, 0]
        row = [get(p) for p in pieces]
        if None in row:
            row = [x if x is not None else (get(p) if p in model.ids else add(p)) for x, p in zip(row, pieces)]
        ids += row
        lens += map(len, pieces)
        at.append(len(ids))
    idv, lv = np.array(ids, np.int64), np.array(lens, np.int64)
    begin = _cuts(model, idv)
    begin[np.array(at[:-1], np.int64)] = True
    first = np.flatnonzero(begin)
    em = _emissions(model, idv)
    # a sentence in which no position can outweigh O, whatever the transitions add, is O throughout
    lead = em[:, 1:].max(axis=1) - em[:, 0]
    gain = 2 * max(0.0, float((model.trans - model.trans[0, 0]).max()), float((model.start - model.start[0]).max()))
    open_ = np.maximum.reduceat(lead, first) + gain >= 0 if len(first) else np.zeros(0, bool)
    labels = np.zeros(len(idv), np.int8)
    if open_.any():
        size = np.diff(np.r_[first, len(idv)])
        keep = np.repeat(open_, size)
        labels[keep] = viterbi(em[keep], model.trans, model.start, np.r_[0, np.cumsum(size[open_])])
    out: list[list[tuple[int, int, str]]] = []
    pos = np.cumsum(lv) - lv
    inside = np.flatnonzero(labels)
    doc = np.searchsorted(np.array(at), inside, "right") - 1
    base = pos[np.minimum(np.array(at[:-1], np.int64), len(pos) - 1)] if len(pos) else np.zeros(0, np.int64)
    out = [[] for _ in texts]
    prev = -2
    for i, d in zip(inside.tolist(), doc.tolist()):
        lab = int(labels[i])
        kind, first = TYPES[(lab - 1) // 2], lab % 2 == 1
        s = int(pos[i] - base[d])
        e = s + int(lv[i])
        if first or prev != i - 1 or not out[d] or out[d][-1][2] != kind:
            out[d].append((s, e, kind))
        else:
            out[d][-1] = (out[d][-1][0], e, kind)
        prev = i

    def end(t: str, s: int, e: int) -> int:
        item = t[s:e].rstrip(" \t\n,;")
        return s + len(item) - (item.endswith(")") and "(" not in item)

    return [[(s, end(t, s, e), k) for s, e, k in row] for t, row in zip(texts, out)]


def _allowed() -> np.ndarray:
    """Inside an item only after its beginning."""
    n = len(LABELS)
    out = np.zeros((n, n), bool)
    for j, b in enumerate(LABELS):
        for i, a in enumerate(LABELS):
            out[i, j] = b[0] != "I" or a[2:] == b[2:] and a != "O"
    return out


@functools.cache
def train(copies: int = COPIES, epochs: int = EPOCHS) -> Model:
    """Fit the field on the labelled table."""
    rng = np.random.default_rng(SEED)
    seqs: list[tuple[list[str], list[int]]] = []
    rows = pii_rows.labelled(copies)
    order = rng.permutation(len(rows))
    rows = [rows[i] for i in order]
    for a in range(0, len(rows), 3):  # three rows a sequence, as sentences stand together
        toks, labs = [], []
        for row in rows[a : a + 3]:
            text = "".join(t for t, _ in row) + (" ", "\n", " ", "\n\n")[rng.integers(4)]
            marks, at = [], 0
            for t, k in row:
                marks.append((at, at + len(t), k))
                at += len(t)
            at, last = 0, None
            for p in tokens(text):
                m = next((m for m in marks if m[0] <= at < m[1]), None)
                k = m[2] if m else "O"
                labs.append(0 if k == "O" else LABELS.index(("I-" if last == m else "B-") + k))
                last = m if k != "O" else None
                toks.append(p)
                at += len(p)
        seqs.append((toks, labs))
    count: dict[str, int] = {}
    for toks, _ in seqs:
        for p in toks:
            for f in features(p):
                count[f] = count.get(f, 0) + 1
    names = {f: i for i, f in enumerate(sorted(f for f, n in count.items() if n > 4))}
    nf, nl, no = len(names), len(LABELS), len(OFFSETS)
    types: dict[str, int] = {"": 0}
    for toks, _ in seqs:
        for p in toks:
            types.setdefault(p, len(types))
    width = max(len(features(p)) for p in types)
    ft = np.full((len(types), width), nf)
    for p, i in types.items():
        f = [names[x] for x in features(p) if x in names] if p else []
        ft[i, : len(f)] = f
    w = np.zeros((no, nf + 1, nl))
    trans, start = np.zeros((nl, nl)), np.zeros(nl)
    bar = np.where(_allowed(), 0.0, -1e4)
    sbar = np.where([x[0] != "I" for x in LABELS], 0.0, -1e4)
    gw, gt, gs = np.full(w.shape, 1e-6), np.full(trans.shape, 1e-6), np.full(start.shape, 1e-6)
    for _ in range(epochs):
        perm = rng.permutation(len(seqs))
        for b in range(0, len(seqs), BATCH):
            part = [seqs[i] for i in perm[b : b + BATCH]]
            n, m = max(len(t) for t, _ in part), len(part)
            ids = np.zeros((m, n + 4), np.int64)
            y = np.zeros((m, n), np.int64)
            mask = np.zeros((m, n), bool)
            for r, (t, l) in enumerate(part):
                ids[r, 2 : 2 + len(t)] = [types[p] for p in t]
                y[r, : len(l)] = l
                mask[r, : len(l)] = True
            em = np.zeros((m, n, nl))
            fidx = [ft[ids[:, 2 + o : 2 + o + n]] for o in OFFSETS]
            for k in range(no):
                em += w[k][fidx[k]].sum(axis=2)
            tr, st = trans + bar, start + sbar
            alpha = np.zeros((m, n, nl))
            alpha[:, 0] = st + em[:, 0]
            for i in range(1, n):
                x = alpha[:, i - 1, :, None] + tr
                mx = x.max(axis=1)
                nxt = mx + np.log(np.exp(x - mx[:, None]).sum(axis=1)) + em[:, i]
                alpha[:, i] = np.where(mask[:, i, None], nxt, alpha[:, i - 1])
            beta = np.zeros((m, n, nl))
            gtr = np.zeros_like(trans)
            mx = alpha[:, -1].max(axis=1, keepdims=True)
            z = (mx + np.log(np.exp(alpha[:, -1] - mx).sum(axis=1, keepdims=True)))[:, 0]
            for i in range(n - 2, -1, -1):
                x = tr + (em[:, i + 1] + beta[:, i + 1])[:, None, :]
                pair = np.exp(np.minimum(alpha[:, i, :, None] + x - z[:, None, None], 0)) * mask[:, i + 1, None, None]
                gtr += pair.sum(axis=0)
                mx = x.max(axis=2)
                nxt = mx + np.log(np.exp(x - mx[:, :, None]).sum(axis=2))
                beta[:, i] = np.where(mask[:, i + 1, None], nxt, 0.0)
            prob = np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * mask[:, :, None]
            gold = np.zeros_like(prob)
            np.put_along_axis(gold, y[:, :, None], 1.0, 2)
            diff = (prob - gold * mask[:, :, None]) / m
            np.add.at(gtr, (y[:, :-1][mask[:, 1:]], y[:, 1:][mask[:, 1:]]), -1.0)
            gtr = np.where(bar == 0, gtr / m, 0) + PENALTY * trans
            gst = np.where(sbar == 0, diff[:, 0].sum(axis=0), 0)
            gt += gtr**2
            gs += gst**2
            trans -= RATE * gtr / np.sqrt(gt)
            start -= RATE * gst / np.sqrt(gs)
            flat = diff.reshape(-1, nl)
            for k in range(no):
                f = fidx[k].reshape(-1, width)
                g = np.zeros((nf + 1, nl))
                for c in range(width):
                    col = f[:, c]
                    for j in range(nl):
                        g[:, j] += np.bincount(col, flat[:, j], nf + 1)
                g[nf] = 0
                g[:nf] += PENALTY * w[k, :nf]
                gw[k] += g**2
                w[k] -= RATE * g / np.sqrt(gw[k])
    return Model(names, w[:, :nf].astype(np.float32), (trans + bar).astype(np.float32), (start + sbar).astype(np.float32))


def _tagged(df: DataFrame, id_col: str, text_col: str, schema: str, make: callable) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(train())  # some thousand features, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            a = 0
            while a < len(ids):
                z, size = a, 0
                while z < len(ids) and (size < SLICE_CHARS or z == a):
                    size += len(texts[z])
                    z += 1
                yield make(ids[a:z], texts[a:z], spans(model, texts[a:z]))
                a = z

    own = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id is not null")
    return own.mapInArrow(run, schema)


def found(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pii_type, start_pos, end_pos) of each personal item, positions from 1 in characters, the end included.

    Null and empty texts give no row; very long texts are read whole; repeated rows give repeated rows; other
    columns are not read.
    """

    def make(ids: list, texts: list[str], found: list) -> pa.RecordBatch:
        rows = [(i, k, s + 1, e) for i, row in zip(ids, found) for s, e, k in row]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.int32()))], names=["doc_id", "pii_type", "start_pos", "end_pos"])

    return _tagged(df, id_col, text_col, "doc_id bigint, pii_type string, start_pos int, end_pos int", make)


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_items) with typed placeholders in the items' place; all else is unchanged. Null texts come back empty."""

    def make(ids: list, texts: list[str], found: list) -> pa.RecordBatch:
        out = []
        for t, row in zip(texts, found):
            pieces, at = [], 0
            for s, e, k in row:
                pieces += [t[at:s], f"[{k.upper()}]"]
                at = e
            out.append("".join(pieces) + t[at:])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string()), pa.array([len(r) for r in found], pa.int32())], names=["doc_id", "text", "n_items"])

    return _tagged(df, id_col, text_col, "doc_id bigint, text string, n_items int", make)
