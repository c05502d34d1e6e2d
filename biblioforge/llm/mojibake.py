"""Text decoded with the wrong encoding: detection and repair by best-first search.

A *state* is the text of a maximal run of non-ASCII characters and entity escapes. An *edge* re-encodes it
with the encoding it was shown in and decodes the bytes with the one they were written in, or unescapes
entities. States are expanded cheapest first under a *character-plausibility cost* (kind of character,
script changes and case changes within a word, symbols beside letters, Russian words without vowels);
visited states are hashed. No number of steps or states ends the search: decoding and unescaping never
lengthen a text's UTF-8 bytes, so the states run out. The cheapest reachable text wins if it beats the original by a margin, which is
lower for UTF-8 bytes, since these prove themselves. Pairs of one-byte encodings, which prove nothing, are
also weighed over all runs of a value together. Results are kept by run and context, so the search itself
runs once for each different run in a task.

UTF-7 read as ASCII (``Schw+AOQ-che``) is found by its groups, which must decode strictly to plausible
non-ASCII text, and is decoded before the search.

Losses can't be undone but are found: U+FFFD, and ``?`` in the place of a letter, quote or dash.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A space within a run stands for the U+00A0 that it was before something tidied the text.
RUN = re.compile(r"(?:[^\x00-\x7f]|(?<=[\xc2-\xef\x80-\x9f]) (?=[\x80-\xbf])|&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)+")
#: A question mark in the place of a letter, or of a quote or dash before one, or between digits.
LOST = re.compile(r"(?<=[^\W\d_])\?(?=[a-zß-öø-ÿ])|(?<=[A-ZÀ-Þ])\?(?=[^\W\d_])|(?<![^\s(\[“‘\"'«])\?(?=[^\W_])|\?\?+(?=\w)|(?<=\w)\?\?+|(?<=\d)\?(?=\d)")

#: Groups of UTF-7; most of what looks like one (``CD5+IgM-``) decodes to nothing or to nothing plausible.
UTF7 = re.compile(r"\+([A-Za-z0-9+/]{3,})-?")
#: Cost up to which a decoded group is plausible: at all, and for each character.
UTF7_BASE, UTF7_EACH = 1.0, 0.8

#: Encodings in which UTF-8 bytes may have been shown.
SHOWN = ("cp1252", "mac_roman", "cp1250", "cp1251", "cp437", "cp850", "cp852", "cp866", "koi8-r", "gbk", "big5", "shift_jis", "iso8859-2", "iso8859-15", "cp1254", "cp1253", "cp1257")
#: (shown in, written in) for texts that were not UTF-8.
PAIRS = (
    ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("cp1251", "cp1252"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1252", "koi8-r"),
    ("cp437", "cp1252"), ("cp1252", "cp437"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1252", "cp866"),
    ("cp1250", "cp1252"), ("cp1252", "cp1250"), ("cp1252", "cp1253"), ("cp1252", "shift_jis"), ("cp1252", "euc_jp"), ("cp1252", "gbk"),
)
#: Ties go to the likelier encoding.
_RANK = {f"{a}>{b}": 0.3 + 0.004 * i for i, (a, b) in enumerate(PAIRS)} | {f"{a}>utf-8": 0.003 * i for i, a in enumerate(SHOWN)}
UTF8_MARGIN, PAIR_MARGIN, JOINT_MARGIN = 0.3, 1.5, 1.6
CACHE = 200_000

_COMMON = set("àáâãäåæçèéêëìíîïñòóôõöøùúûüýßœÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŒąćęłńóśźżĄĆĘŁŃŚŹŻčďěňřšťůžČĎĚŇŘŠŤŮŽľĺŕĽőűŐŰğışŞİșțȘȚăĂđĐ")
_RARE_LATIN1 = set("ðÐþÞÿõÕëËìÌòÒùÙ")
_PLAIN = {c for c in _COMMON - _RARE_LATIN1 if c.islower()}
_RUSSIAN = set("абвгдежзийклмнопрстуфхцчшщъыьэюяё")
_VOWELS = set("аеёиоуыэюяАЕЁИОУЫЭЮЯіІїєЄ")
_TWINS = set("аеорсухіјѕԁһАВЕКМНОРСТУХІЅЈοΑΒΕΖΗΙΚΜΝΟΡΤΥΧ")
_SCIENCE = set("αβγδεζηθκλμνπρστφχψωΔΓΣΩΦΨΠΘΛµ")
_ASCII_TWINS = set("aceopxyijsABCEHIKMOPTXYZN")
#: Blocks whose characters are no surprise in a citation; 0x250 on.
_BLOCKS = ((0x261, 0x262), (0x2C6, 0x2DE), (0x300, 0x370), (0x386, 0x3D0), (0x400, 0x460), (0x490, 0x492), (0x1E00, 0x1F00), (0x2000, 0x2070), (0x2070, 0x20C0), (0x2100, 0x2200), (0x2200, 0x2300), (0x2310, 0x2311), (0x2500, 0x25D0), (0x3000, 0x3100), (0x3400, 0xA000), (0xFB00, 0xFB07), (0xFE50, 0xFE70), (0xFEFF, 0xFF00), (0xFF01, 0xFFA0))
_MARKS = set("\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u030a\u030b\u030c\u0327\u0328")
_OPEN, _CLOSE = set("“‘„«‚‹"), set("”»›")
_ALONE = set("àéóèáíúÀÉÓÈÁÍÚýôöåØøÅ") | set("иАИОУВСКЯЭовуаксяэ")
_SYMBOLS = set("¨´¸·¶§©®ªº¯†‡•¦¬¤¢£¥¼½¾÷×±µ‰")
_kinds: dict[str, tuple[float, str, str, bool]] = {}


def _kind(ch: str) -> tuple[float, str, str, bool]:
    """(own cost, class, script, in the twins); classes: u and l letters, x other letters, s symbols, o, c quotes, p others."""
    if k := _kinds.get(ch):
        return k
    n, cat = ord(ch), unicodedata.category(ch)
    script = "L" if n < 0x250 or 0x1E00 <= n < 0x1F00 or 0xFB00 <= n < 0xFB07 or 0xFF21 <= n < 0xFF5B else "G" if 0x370 <= n < 0x400 else "C" if 0x400 <= n < 0x530 else "K" if 0x3040 <= n < 0x3100 else "H" if 0x3400 <= n < 0xA000 or 0xF900 <= n < 0xFB00 else "O"
    strange = n >= 0x250 and not any(a <= n < b for a, b in _BLOCKS)
    if n < 128:
        k = (0.0, "u" if cat == "Lu" else "l" if cat == "Ll" else "p", "L", ch in _ASCII_TWINS)
    elif strange or n < 0xA0 or cat in ("Co", "Cn", "Cs"):
        k = (6.0, "s", "", False)
    elif ch == "�":
        k = (5.0, "s", "", False)
    elif ch in _SYMBOLS or 0x2C6 <= n < 0x2DE or 0x2500 <= n < 0x25A0 or cat in ("Sm", "Sc", "Sk", "So") and ch not in "°":
        k = (3.0 if 0x2500 <= n < 0x25A0 else 0.8, "s", "", False)
    elif ch in _OPEN or ch in _CLOSE:
        k = (0.4, "o" if ch in _OPEN else "c", "", False)
    elif ch in "¿¡":
        k = (0.4, "o", "", False)
    elif cat[0] == "L" and cat not in ("Lm",) and ch not in "ªº":
        if script == "L":
            own = 1.0 if ch in _RARE_LATIN1 else 0.4 if ch in _COMMON or n > 0x1E00 else 1.5
        elif script == "C":
            own = 0.3 if ch in _TWINS or ch.lower() in "оеаинтсрвлкмдпуя" else 0.5 if ch.lower() in _RUSSIAN else 1.5
        else:
            own = {"G": 0.3 if ch in _SCIENCE else 0.6, "K": 0.4, "H": 0.5}.get(script, 2.0 if 0xFF61 <= n < 0xFFA0 else 1.5)
        k = (own, "u" if cat == "Lu" else "l" if cat == "Ll" else "x", script, ch in _TWINS)
    else:
        k = (1.2 if cat == "Mn" and ch not in _MARKS else 0.4, "p", "", False)
    _kinds[ch] = k
    return k


def cost(left: str, text: str, right: str) -> float:
    """Implausibility of ``text`` between its neighbours."""
    t = left + text + right
    a, b = len(left), len(left) + len(text)
    ks = [_kind(c) for c in t]
    total = sum(k[0] for k in ks[a:b])
    p = ("p", "", False)
    for i in range(max(0, a - 1), min(len(t) - 1, b)):
        x, y = ks[i], ks[i + 1]
        if t[i] < "\x80" and t[i + 1] < "\x80":
            continue
        lx, ly = x[1] in "ulx", y[1] in "ulx"
        if lx and ly:
            if x[2] != y[2]:
                if (x[3] and t[i] >= "\x80") or (y[3] and t[i + 1] >= "\x80"):
                    total += 0.1
                elif (x[3] or y[3]) and {x[2], y[2]} <= {"L", "C", "G"}:
                    total += 1.0
                elif {x[2], y[2]} <= {"H", "K"} or {x[2], y[2]} == {"L", "K"}:
                    total += 0.1
                elif {x[2], y[2]} == {"L", "G"} and (t[i] in _SCIENCE or t[i + 1] in _SCIENCE):
                    total += 0.5
                else:
                    total += 3.0 if "H" not in (x[2], y[2]) else 2.0
            elif x[1] == "l" and y[1] == "u":
                total += 2.5
            elif x[1] == "u" and y[1] == "u" and t[i + 1] >= "\x80" and i + 2 < len(t) and ks[i + 2][1] == "l":
                total += 2.0
        elif x[1] == "s" and y[1] == "s":
            total += 1.0
        elif x[1] == "s" and ly or lx and y[1] == "s":
            both = t[i] == "·" and t[i - 1 : i] == "l" or t[i + 1] == "·"
            total += 0.5 if both and t[i : i + 3] == "l·l" else 2.5
        elif lx and y[1] == "o" or x[1] == "c" and ly:
            total += 2.0
        elif t[i] == "…" and ly or lx and t[i + 1] == "°":
            total += 1.5
        elif "\u0300" <= t[i + 1] < "\u0370" and not lx and not "\u0300" <= t[i] < "\u0370":
            total += 3.0  # a mark without its letter
    for i in range(a, b):  # letters that stand alone, Russian words without vowels
        if t[i] >= "\x80" and ks[i][1] in "ul" and ks[i][2] != "G" and t[i] not in _ALONE:
            if (ks[i - 1] if i else p)[0 if not i else 1] not in ("u", "l", "x") and (i + 1 >= len(t) or ks[i + 1][1] not in "ulx"):
                if not (i == 0 and not left) or len(t) == 1:
                    total += 1.5
    for w in re.findall("[А-Яа-яЁё]{3,}", text):
        if not _VOWELS.intersection(w):
            total += 2.5
    return total


_RANK_PAIRS = {f"{a}>{b}" for a, b in PAIRS}
_PAIR_OPS = [f"{a}>{b}" for a, b in PAIRS]


def _encode(text: str, codec: str) -> bytes | None:
    """Strictly, but with control characters standing for the bytes that a codec leaves open."""
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        pass
    out = bytearray()
    if not codec.startswith("cp125"):
        return None
    for ch in text:
        try:
            out += ch.encode(codec)
        except UnicodeEncodeError:
            if not 0x80 <= ord(ch) < 0xA0:
                return None
            out.append(ord(ch))
    return bytes(out)


_edges: dict[str, list[tuple[str, str]]] = {}


def edges(text: str) -> list[tuple[str, str]]:
    """(operation, text) reachable in one step."""
    if (found := _edges.get(text)) is not None:
        return found
    out: dict[str, str] = {}
    if "&" in text and (u := html.unescape(text)) != text:
        out[u] = "unescape"
    if " " in text:
        out[text.replace(" ", "\xa0")] = "no-break"
    for shown in SHOWN:
        if raw := _encode(text, shown):
            try:
                out.setdefault(raw.decode("utf-8"), f"{shown}>utf-8")
            except UnicodeDecodeError:
                pass
    for shown, written in PAIRS:
        if raw := _encode(text, shown):
            try:
                out.setdefault(raw.decode(written), f"{shown}>{written}")
            except UnicodeDecodeError:
                pass
    out.pop(text, None)
    if len(_edges) > CACHE:
        _edges.clear()
    _edges[text] = found = [(op, t) for t, op in out.items()]
    return found


_solved: dict[tuple[str, str, str], tuple[float, float, str, tuple[str, ...]]] = {}


def solve(left: str, run: str, right: str) -> tuple[float, float, str, tuple[str, ...]]:
    """(cost as it is, cost of the best, best text, operations) by best-first search."""
    if run in _PLAIN and not right[:1].isupper() and (right[:1].isascii() and right[:1].isalpha() or left[-1:].isascii() and left[-1:].isalpha()):
        return 0.4, 0.4, run, ()  # a usual small letter within a word: no single byte is UTF-8, and no other letter costs enough less
    key = (left, run, right)
    if hit := _solved.get(key):
        return hit
    own = cost(left, html.unescape(run) if "&" in run else run, right)  # an escape is as plausible as what it stands for
    best = (own, run, ())
    if len(run) == 1 and own < PAIR_MARGIN and run < "\u2e80" and not (right[:1] == " " and run in "ÃÂ├√"):
        _solved[key] = out = (own, own, run, ())  # one such byte is no UTF-8, and no other letter costs enough less
        return out
    heap, seen = [(own, 0, run, ())], {run}
    if right[:1] == " " and run[-1:] in "ÃÂ├√":  # the second byte became an ordinary space
        heap.append((own + 0.1, 0, run + "\xa0", ()))
        seen.add(run + "\xa0")
    while heap:
        c, n, text, ops = heapq.heappop(heap)
        decoded = any(">" in o for o in ops)
        if decoded:
            margin = UTF8_MARGIN if any(o.endswith(">utf-8") for o in ops) else PAIR_MARGIN
            if own - c >= margin and c < best[0] - 0.05:
                best = (c, text, ops)
        if decoded and (c < 0.3 or not any(ops[-1].endswith(x) for x in (">utf-8", "unescape", "no-break"))):
            continue  # plausible as it is, or a one-byte pair, after which nothing follows
        for op, new in edges(text):
            pair = ">" in op and not op.endswith(">utf-8")
            # one-byte pairs prove nothing: they stand alone, and yield to UTF-8
            if new in seen or not new or decoded and (pair or not ops[-1].endswith(">utf-8")):
                continue
            seen.add(new)
            heapq.heappush(heap, (cost(left, new, right) + 0.05 * n + _RANK.get(op, 0), n + 1, new, (*ops, op)))
    if len(_solved) > CACHE:
        _solved.clear()
    _solved[key] = out = (own, best[0], best[1], best[2])
    return out


_MATHS = set("≤≥≈≠→←↔↑↓√∞−∑∂∆⁺⁻⁼₊₋₌")


def _utf7_group(group: str) -> str | None:
    """What a group stands for, or nothing where it doesn't decode or gives unusual characters."""
    try:
        text = f"+{group}-".encode().decode("utf-7")
    except UnicodeDecodeError:
        return None
    if all(c.isprintable() or c in "\xa0\xad\u2002\u2003\u2009\u200b\u202f\u3000" for c in text) and not any(unicodedata.category(c) in ("Sm", "So", "Sc", "Sk") and c > "\x7f" and c not in _SYMBOLS | _MATHS | {"°"} for c in text):
        return text
    return None


def utf7(value: str) -> list[str]:
    """The text split at its UTF-7 groups, every second piece decoded; whole where no group is plausible."""
    found = []  # start, end, text, cost above what is plausible; ASCII groups have no cost
    for m in UTF7.finditer(value):
        text = _utf7_group(m[1])
        a = max(value.rfind(c, 0, m.start()) for c in " \t\n") + 1
        if text is not None and "://" not in value[a : m.start()]:
            left, right = value[max(0, m.start() - 2) : m.start()], value[m.end() : m.end() + 2]
            _, c, best, ops = solve(left, text, right)
            if ops and ops[-1].endswith(">utf-8"):  # UTF-8 within UTF-7 proves itself
                text = best
            else:
                c = cost(left, text.replace("µ", "μ"), right)
            found.append((m.start(), m.end(), text, None if text.isascii() else c - UTF7_BASE - UTF7_EACH * len(text)))
    over = [f[3] for f in found if f[3] is not None]
    if not any(x <= 0 for x in over):
        return [value]
    whole = sum(over) <= 0
    pieces, last = [], 0
    for a, b, text, x in found:
        if x is None or x <= 0 or whole:
            pieces += [value[last:a], text]
            last = b
    return [*pieces, value[last:]]


#: Text whose characters beyond ASCII are usual small letters, one at a time within words.
_SIMPLE = re.compile(f"(?:[\\x00-\\x7f]|(?<=[A-Za-z])[{''.join(sorted(_PLAIN))}](?![A-Z\\x80-\\U0010ffff])|[{''.join(sorted(_PLAIN))}](?=[a-z]))*")


def repair(value: str | None) -> tuple[str | None, bool, bool]:
    """(text, whether it was garbled, whether characters are lost for good)."""
    if not value or "?" not in value and "&" not in value and "+" not in value and _SIMPLE.fullmatch(value):
        return value, False, False
    if "+" in value and len(pieces := utf7(value)) > 1:  # decoded groups stay, the text between them is repaired as any other
        return "".join(x if i % 2 else repair(x)[0] for i, x in enumerate(pieces)), True, repair("".join(pieces))[2]
    lossy = "�" in value or "?" in value and any(LOST.search(w) for w in value.split() if "://" not in w)
    runs = [(m.start(), m.end()) for m in RUN.finditer(value)]
    if not runs:
        return value, lossy, lossy
    pieces, last, changed, costs = [], 0, False, []
    ctx = [(value[max(0, a - 2) : a], value[a:b], value[b : b + 2]) for a, b in runs]
    found = [solve(*c) for c in ctx]
    # one-byte pairs, over all runs together, where the runs give any reason for it
    if len(ctx) > 1 and (any(f[3] and f[3][-1] in _RANK_PAIRS for f in found) or sum(f[0] for f in found) > 1.0 + 0.5 * sum(len(c[1]) for c in ctx) or any(len(c[1]) >= 4 and max(c[1]) < "\u0100" for c in ctx)):
        first, now = sum(f[0] for f in found), sum(f[1] for f in found)
        best = now - JOINT_MARGIN if all(not f[3] for f in found) else now + 0.4 * len(found) if any(len(f[3]) == 1 and f[3][0] in _PAIR_OPS for f in found) else -1.0
        for op in _PAIR_OPS:
            news = []
            for _, run, _ in ctx:
                new = next((t for o, t in edges(run) if o == op), None)
                if new is None:
                    break
                news.append(new)
            else:
                costs = [cost(c[0], n, c[2]) + _RANK[op] for c, n in zip(ctx, news)]
                if sum(costs) < min(best, first - JOINT_MARGIN):
                    best = sum(costs)
                    found = [(f[0], k, n, (op,)) for f, k, n in zip(found, costs, news)]
    for (a, b), f in zip(runs, found):
        pieces += [value[last:a], f[2]]
        last = b
        changed |= bool(f[3])
    return ("".join(pieces) + value[last:] if changed else value), changed or lossy, lossy


def suspects(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field_name, value) of the values that could be garbled: any beyond plain ASCII without ``?``, ``&`` and UTF-7 groups."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])
    return df.select(F.col(id_col).alias(id_col), F.explode(pairs).alias("p")).select(id_col, "p.field_name", "p.value").where(F.col("value").rlike(r"[^\x00-\x7F]|\?|&|\+[A-Za-z0-9+/]{3}"))


def garbled(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field_name, repaired, lossy) of each garbled value.

    Nulls, empty and clean values give no row; very long texts are searched whole; repeated rows and ids
    give a row each. Only the named columns are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts, lost = [], [], []
            for i, v in enumerate(batch.column(2).to_pylist()):
                t, bad, lossy = repair(v)
                if bad:
                    keep.append(i)
                    texts.append(t)
                    lost.append(lossy)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(texts, pa.string()), pa.array(lost, pa.bool_())], names=[id_col, "field_name", "repaired", "lossy"])

    return suspects(df, id_col, fields).mapInArrow(run, f"`{id_col}` bigint, field_name string, repaired string, lossy boolean")
