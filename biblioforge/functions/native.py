"""Scalar functions as native column expressions: DOIs, years, pages, authors, titles."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MatchConfig

_EDGE = r"^[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+|[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+$"
_PREFIX = r"^(?:doi:|https?://(?:dx\.)?doi\.org/)"
#: What a title's signs and Greek letters become before it is compared.
TITLE_SIGNS = (("–", "-"), ("—", "-"), ("−", "-"), ("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("´", "'"), ("¨", '"'), ("…", "..."))
GREEK = (("α", "alpha"), ("β", "beta"), ("γ", "gamma"), ("δ", "delta"), ("ε", "epsilon"), ("ζ", "zeta"), ("η", "eta"), ("θ", "theta"), ("ω", "omega"), ("Ω", "Omega"))
ISOTOPES = (("(1)H", "1H"), ("(13)C", "13C"))
#: Garbled sequences of raw citations and what replaces them (an opt-in repair).
GARBLED = (("âˆ†", "Δ"), ('Î"', "Δ"), ('â€"', "–"), ("â€˜", "'"), ("â€™", "'"), ("â€œ", '"'), ("â€", '"'), ("Â", ""))
#: Letters by what they are spelt with; several letters first, then letter by letter.
SPELT = (
    ("ß", "ss"), ("ẞ", "SS"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("þ", "th"), ("Þ", "Th"),
    ("ж", "zh"), ("Ж", "Zh"), ("х", "kh"), ("Х", "Kh"), ("ц", "ts"), ("Ц", "Ts"), ("ч", "ch"), ("Ч", "Ch"), ("ш", "sh"), ("Ш", "Sh"), ("щ", "shch"), ("Щ", "Shch"), ("ю", "iu"), ("Ю", "Iu"), ("я", "ia"), ("Я", "Ia"), ("ё", "io"), ("Ё", "Io"),
    ("φ", "ph"), ("Φ", "Ph"), ("χ", "kh"), ("Χ", "Kh"), ("ψ", "ps"), ("Ψ", "Ps"),
)
_LETTERS = dict(zip("øØłŁđĐðÐıабвгдезийклмнопрстуфыэАБВГДЕЗИЙКЛМНОПРСТУФЫЭіІιΙκΚλΛμΜνΝξΞοΟπΠρΡσΣςτΤυΥΑΒΓΔΕΖΗΘ", "oOlLdDdDiabvgdeziiklmnoprstufyeABVGDEZIIKLMNOPRSTUFYEiIiIkKlLmMnNxXoOpPrRsSstTuUABGDEZETH"))
#: Latin letters with marks and the letters they stand on, raised, lowered and wide forms, from their decompositions.
LETTERS = _LETTERS | {
    chr(c): _LETTERS[d[0]] for c in (*range(0x370, 0x530), *range(0x1F00, 0x2000)) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0] in _LETTERS and chr(c) not in _LETTERS
} | {
    chr(c): d[0] for c in (*range(0xB2, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x2090), *range(0xFF01, 0xFF5F))
    if (d := unicodedata.normalize("NFKD", chr(c)))[0].isascii() and d[0].isalnum() and all(unicodedata.combining(x) for x in d[1:])
}


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode spaces included."""
    return F.regexp_replace(c, _EDGE, "")


def field(c: Column) -> Column:
    """A text field: stripped, null as empty."""
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def norm_doi(c: Column) -> Column:
    """DOI as the matcher compares it: one prefix goes. White space alone passes untouched."""
    return F.when(F.trim(c) == "", c).otherwise(F.replace(F.trim(F.regexp_replace(F.lower(F.trim(c)), _PREFIX, "")), F.lit("\\/"), F.lit("/")))


def norm_doi_eval(c: Column) -> Column:
    """DOI as the evaluation compares it: ``doi:`` goes, then a URL prefix too."""
    x = F.replace(F.lower(F.trim(c)), F.lit("\\/"), F.lit("/"))
    return F.trim(F.regexp_replace(F.regexp_replace(x, "^doi:", ""), r"^https?://(?:dx\.)?doi\.org/", ""))


def extract_year(c: Column, cfg: MatchConfig = MatchConfig()) -> Column:
    """A whole number within the years allowed; a number outside gives null; else the first year in the text."""
    s = F.trim(c)
    number = s.try_cast("int")
    found = F.regexp_extract(s, r"\b(?:17|18|19|20)\d{2}\b", 0).try_cast("int")
    y = F.when(number.isNotNull(), number).otherwise(found)
    return F.when(y.between(cfg.min_year, cfg.max_year), y)


def page_key(c: Column) -> Column:
    return F.ltrim(c, F.lit("0"))


#: All white space, as Python's ``str.split`` has it.
_BLANKS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def norm_author(c: Column) -> Column:
    """Lower case, single blanks; accents stay."""
    return F.lower(F.trim(F.regexp_replace(c, _BLANKS, " ")))


def norm_title(c: Column) -> Column:
    """A title in ASCII: signs and Greek letters by name, Latin, Cyrillic and Greek letters spelt, lower case, single blanks.

    Letters of other scripts are spelt by their code points, so that only equal texts become equal.
    """
    for a, b in ISOTOPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    far = c  # all below only where there is more than ASCII
    for a, b in TITLE_SIGNS + GREEK + SPELT:
        far = F.replace(far, F.lit(a), F.lit(b))
    far = F.regexp_replace(F.translate(far, "".join(LETTERS), "".join(LETTERS.values())), r"\p{M}", "")
    far = F.regexp_replace(far, r"\p{Z}", " ")
    code = lambda x: F.when(x.rlike(r"[^\x00-\x7F]") & x.rlike(r"\p{L}"), F.concat(F.lit("u"), F.hex(F.encode(x, "UTF-16BE")))).otherwise(x)
    far = F.when(far.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(far, ""), code), "")).otherwise(far)
    c = F.when(c.rlike(r"[^\x00-\x7F]"), far).otherwise(c)
    c = F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), r"[.!?;:]+$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^a-z0-9\s-]", ""), r"\s+", " "))


def main_title(article: Column, volume: Column, journal: Column) -> Column:
    return F.coalesce(F.nullif(article, F.lit("")), F.nullif(volume, F.lit("")), F.nullif(journal, F.lit("")), F.lit(""))


def clean_literal(c: Column) -> Column:
    """A literal as queries see it: special signs and control characters are blanks, 1,000 characters at most."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f\x7f<>{}|^`]", " "), _BLANKS, " ")), 1, 1000)


def title_pattern(c: Column, cfg: MatchConfig = MatchConfig()) -> Column:
    """Long ones of the first four words, any text between them; empty matches all. Words are quoted by default."""
    words = F.filter(F.slice(F.split(F.substring(F.trim(c), 1, 500), r"\s+"), 1, 4), lambda w: F.length(w) > 3)
    if cfg.regex_mode == "quoted":
        words = F.transform(words, lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}])", r"\\$1"))
    return F.array_join(words, ".*")


def loose_page(page: Column, x: Column) -> Column:
    return (page == x) | F.contains(page, F.concat(x, F.lit("-"))) | F.contains(page, F.concat(F.lit("-"), x))


def newline_free(c: Column) -> Column:
    return F.regexp_replace(c, r"[\r\n]", " ")


def citation_text(c: Column) -> Column:
    """A raw citation as a parser gets it: without bytes that are no UTF-8."""
    return F.when(F.is_valid_utf8(c), c).otherwise(F.replace(F.make_valid_utf8(c), F.lit("\ufffd"), F.lit("")))


def repair_garbled(c: Column) -> Column:
    """Opt-in: the fixed garbled sequences only."""
    for a, b in GARBLED:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def author_of(raw: Column) -> Column:
    """Surname of raw JSON: text before a comma or the last word; the first of an array; family, family-name or name."""
    v = F.try_parse_json(raw)
    of = lambda path: F.try_variant_get(v, path, "string")
    comma = lambda x: F.trim(F.split_part(x, F.lit(","), F.lit(1)))
    first = F.coalesce(*[of(f"$[0]{k}") for k in (".family", '["family-name"]', ".name")], F.when(~raw.startswith("[{"), of("$[0]")))
    plain = F.when(v.isNull() | ~raw.rlike(r"^\s*[\[{\"]"), raw).otherwise(of("$"))
    text = F.when(plain.contains(","), comma(plain)).otherwise(F.element_at(F.split(F.trim(plain), r"\s+"), -1))
    return F.when(raw.rlike(r"^\s*\["), comma(first)).when(raw.rlike(r"^\s*\{"), comma(F.coalesce(of("$.family"), of('$["family-name"]'), of("$.name")))).otherwise(text)


def title_of(article: Column, title: Column) -> Column:
    v = F.try_parse_json(title)
    return F.coalesce(article, F.when(title.rlike(r"^\s*\["), F.try_variant_get(v, "$[0]", "string")).otherwise(title))


def year_of(year: Column, issued: Column) -> Column:
    return F.coalesce(year, F.try_variant_get(F.try_parse_json(issued), '$["date-parts"][0][0]', "string"))


def page_of(first: Column, page: Column) -> Column:
    return F.coalesce(first, F.trim(F.split_part(page, F.lit("-"), F.lit(1))))


def percentage(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den * 100).otherwise(0.0)
