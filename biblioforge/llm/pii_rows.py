"""The small labelled table from which the tagger of personal items is trained.

One row per line; ``{name}``, ``{email}``, ``{phone}``, ``{identity}`` and ``{address}`` are labelled items, ``<...>``
slots are ordinary text: surname, given name, invented place, word, year, number. Rows are filled several
times from a seeded generator, so no real person is in the table.
"""

from __future__ import annotations

import random

ROWS = """
We thank {name} and {name} for reading the draft.
We thank <title> {name} and {name} for reading the draft.
Please write to {name} ({email}) for the raw lists.
Please write to <title> {name} for the raw lists.
The field diary names {name} as the finder.
The field diary names {name} as the finder. cc {email}; {email}
Requests go to {email} or by phone to {phone}.
Posted by {name} from {address}, mobile {phone}.
Consent form of {name}, b. <year>, ID {identity}.
Consent form of <title> {name}, b. <year>, ID {identity}.
A copy lies with {name}, {address}.
A copy lies with <title> {name}.
Reviewer note, from {name}: call me on {phone} after six.
Reviewer note, from <title> {name}: call me on {phone} after six.
The <word> figures came from {name}, whose number is {phone}.
My supervisor <title> {name} keeps the <word> files.
My supervisor {name} keeps the <word> files.
In spring {name} sent us two boxes of <word> slips.
{name} counted the <word> twice and found no error.
<title> {name} counted the <word> twice and found no error.
{name} (passport no. {identity}) signed the data release.
<title> {name} (passport no. {identity}) signed the data release.
Deposited by {name}, holder of identity card {identity}.
Deposited by <title> {name}, holder of identity card {identity}.
National insurance no. {identity} belongs to {name}.
National insurance no. {identity} stands in the header.
{identity} was left in the header by mistake.
social security number: {identity}; name: {name}
ORCID iD {identity} belongs to {name}.
ORCID iD {identity} belongs to <title> {name}.
ORCID iD {identity} belongs to {lname}.
author id {identity}, contact {email}
Tax ID {identity}, payee {name}, paid for <word> work.
Staff no. {identity} ({name}) ran the <word> batch.
Staff number {identity} ran the <word> batch.
Interviewee <n>, {name}, lives at {address}.
Interviewee <n>, <title> {name}, lives at {address}.
Proofs to: {address}
The old cover sheet still shows {address} and {phone}.
The parcel with the <word> cores went to {address}.
Correspondence: {name}, {address}.
Correspondence: <title> {name}, {address}, {email}
E-mail: {email}.
Tel. {phone}; fax on request.
Ring {phone} and ask for {name}.
Ring {phone} and ask for <title> {name}.
{phone} (office)
{phone}
{address}
[{email}]
Unlike the <word> team, {name} kept paper notes.
Sincerely,\\n{name}
Yours sincerely,\\n<title> {name}\\n{address}
Best wishes,\\n{name}
cc {email}; {email}
Anfragen an {email}.
Die Abschrift besitzt {name}.
Die Abschrift besitzt <title> {name}.
Im Mai brachte {name} zwei Kisten mit Zetteln.
Im Mai brachte <title> {name} zwei Kisten mit Zetteln.
Wir danken {name} für Hinweise zur <Noun>.
Wir danken <title> {name} für Hinweise zur <Noun>.
Telefon {phone}, abends.
Rückruf unter {phone} bei {name}.
Personalausweis Nr. {identity}, ausgestellt für {name}.
Personalausweis Nr. {identity}, ausgestellt für <title> {name}.
Ausweis {identity} lag bei.
Steuer-ID {identity} steht irrtümlich im Anhang.
Sonderdrucke: {address}
{name} wohnt nahe {address}.
<title> {name} wohnt nahe {address}.
Korrespondenz: <title> {name}, {address}, {email}
Korrespondenz: {name}, {address}, {email}
Nous remercions {name} pour ses remarques.
Nous remercions <title> {name} pour ses remarques.
La copie est chez {name}.
La copie est chez <title> {name}.
Au printemps, {name} nous a remis deux boîtes.
Au printemps, <title> {name} nous a remis deux boîtes.
Carte d’identité no {identity}, au nom de {name}.
Carte d’identité no {identity}, au nom de <title> {name}.
Passeport {identity} joint au dossier.
Le témoin habite {address}.
Tirés à part : {address}
Tél. : {phone}
Appelez {name} au {phone}.
Appelez <title> {name} au {phone}.
Copie à {email}
Correspondance : <title> {name}, {address}, {email}
Correspondance : {name}, {address}, {email}
Agradecemos a {name} sus notas sobre <word>.
Agradecemos a <title> {name} sus notas sobre <word>.
En mayo {name} trajo dos cajas de fichas.
En mayo <title> {name} trajo dos cajas de fichas.
La copia la guarda {name}.
La copia la guarda <title> {name}.
Llame a {name} al {phone}.
Llame a <title> {name} al {phone}.
DNI {identity}, a nombre de {name}.
DNI {identity}, a nombre de <title> {name}.
Pasaporte {identity} adjunto.
La encuestada vive en {address}.
Separatas: {address}
Teléfono {phone}.
Copia a {email}
Correspondencia: <title> {name}, {address}, {email}
Correspondencia: {name}, {address}, {email}
Title strings were cut at <n> signs and compared word by word.
We link each <word> record to its <word> entry by title and year.
<Word> was cited <n> times, <word> only <n> times.
As <sur> argued, <word> <word> may follow from <word>.
<sur> and <sur> (<year>) report a <word> <word> near <Place>.
Earlier work on <word> (<sur> <year>; <sur> <year>) did not separate <word> from <word>.
Earlier work on <word> (<sur> and <sur> <year>) did not separate <word> from <word>.
The <sur> test gave p = 0.0<n> for <word>.
The <sur>–<sur> model puts <word> before <word>.
Ms <n> in the archive deals with <word> (<sur> <year>; <sur> <year>).
Ms <n> in the archive deals with <word> (<sur> and <sur> <year>).
The <Place> Society and the <Place> Press list <n> titles on <word>.
In the Hotel <Place> papers, <word> <word> is called <word> <word>.
The St. <Place> basin keeps <word> <word>.
Accession <Place>-<n> holds the <word> reads.
Call numbers QH<n>.<n> LO-<year>-<n> cover <word>.
Batch no. <n>-<n>-<n> went through <word> twice.
Grant no. DI-<year>-<n> paid for the <word> <word> runs.
Table <n> gives <n>.<n> (<n>) for <word> <word>; n = <n>.
ISBN 978-99-<n>-<n>-<n> treats <word>.
The journal (ISSN 96<n>-0478X) lists <word> under <word>.
Coordinates 41.<n>, -8.<n> mark the <word> plot.
Version <n>.<n>.<n> of the matcher scored <word> below <word>.
Samples were held @ <n> °C for <n> h.
Pages <n>–<n>, volume <n>, carry the <word> study.
Page ranges such as <n>–<n> were split at the dash.
Lane <n> of the gel holds <word>, lane <n> holds <word>.
When two entries share volume <n> and page <n>, the <word> one wins.
Between <year> and <year> the share of <word> rose to 0.<n>.
Of <n> cited items, <n> had no match in the graph.
See https://doi.org/10.99140/ne<n> for the <word> data.
<Word> and <word> differ between the <word> and the <word> sample.
The <word> <word> of <Place> was measured in <word> over <n> seasons.
A <word> study of <word> in <Place> shows <word> <word>.
<sur> FE, <sur> L. <Word> <word> in <Place>: a <word> study. <Word> Letters <year>;<n>:<n>-<n>.
<sur> AB, <sur> D. Towards a <word> theory of <word> for <Place>. <Word> Letters <year>;<n>:<n>-<n>.
<sur> CM, <sur> J. Linking <word> to <word> in <word> <Place>. <Word> Letters <year>;<n>:<n>-<n>.
<sur> K, <sur> AA. ‘<Word> <word>’ revisited: <word> in <Place>. <Word> Letters <year>;<n>:<n>-<n>.
<sur> HE, <sur> P. Is <word> <word> in <Place>? A case study. <Word> Letters <year>;<n>:<n>-<n>.
<sur>, <given> & al. (<year>). <Word> of <Place> under <word> <word>. Acta <Word>, <n>(<n>), <n>–<n>.
<sur>, <given> and <sur>, <given> (<year>). <Word> and <word> in <Place>. Annals of <Word> Science, <n>(<n>), <n>-<n>.
<sur> AB, <sur> D. <Sur> and <word> <word> of <Place>: <word> <word>. <Word> Letters <year>;<n>:<n>-<n>.
<sur> HE, <sur> P. <Sur>-<word> and <word> in <Place>. <Word> Letters <year>;<n>:<n>-<n>.
<sur> CM, <sur> J. Linking <Sur> to <word> in <word> <Place>. <Word> Letters <year>;<n>:<n>-<n>.
<sur> FE, <sur> L. <Sur> and the <word> of <word> <word>. <Word> Letters <year>;<n>:<n>-<n>.
<sur> CM, <sur> J. <Word> <Sur> drives <word> in <Place>: a <word> study. <Word> Letters <year>;<n>:<n>-<n>.
<sur> AB, <sur> D. <Place> and the <word> of <word> <word>. <Word> Letters <year>;<n>:<n>-<n>.
<sur> CM, <sur> J. How <word> <word> shapes <word>: evidence from <Place>. <Word> Letters <year>;<n>:<n>-<n>.
<sur> HE, <sur> P. Effects of <word> <word> on <word> of <Place>. <Word> Letters <year>;<n>:<n>-<n>.
<sur> FE, <sur> L. <Word>, <word> and <word> of <word> <Place>. <Word> Letters <year>;<n>:<n>-<n>.
<sur> FE, <sur> L. On the <word>–<word> relation in <Place>. <Word> Letters <year>;<n>:<n>-<n>.
<sur>, “<Word> <word> in <Place>,” Proceedings on <Word> and <Word>, vol. <n>, no. <n>, pp. <n>–<n>, <year>.
As <sur>, <given> (<year>) and <given> <sur> (<year>) showed, <word> grows.
<Word> after <sur> et al. (<year>) and after the <sur> Institute of <Word>.
The <given> <sur> Institute and the <sur> Prize honour the <word> school.
Das <sur>-Verfahren trennt <Noun> und <Noun>.
Nach <sur> hängt die <Noun> von der <Noun> ab.
<sur> und <sur> (<year>) beschreiben <word> <Noun> und <Noun>.
Die <Noun> von <Place> wurde über <n> Jahre gemessen.
Förderung LE-<year>-<n>, Band <n>, S. <n>–<n>.
Siehe doi:10.99139/sa<n> zur <Noun>.
Von <n> Zitaten blieben <n> ohne Treffer.
Selon <sur>, la <word> dépend de la <word>.
<sur> et <sur> (<year>) décrivent la <word> <word>.
L’indice de <sur> sépare la <word> de la <word>.
La <word> de <Place> a été mesurée pendant <n> années.
Projet PO-<year>-<n>, vol. <n>, p. <n>-<n>.
Sur <n> citations, <n> restent sans réponse.
Voir doi:10.99114/vi<n> pour la <word>.
Según <sur>, la <word> depende de la <word>.
<sur> y <sur> (<year>) describen la <word> <word>.
El índice de <sur> separa <word> y <word>.
La <word> de <Place> se midió durante <n> años.
Proyecto ZE-<year>-<n>, vol. <n>, pp. <n>-<n>.
De <n> citas, <n> no tienen pareja.
Véase doi:10.99118/ca<n> sobre la <word>.
"""

#: Given names, as a word list; other names are known by their shapes and neighbours.
GIVEN = """Adela Agnes Aleksandr Alfredo Amara Andrew Andy Anna Anton Asha Beatriz Bill Bob Bogdan Carlos Catherine Charles Chidi Chuck Claire Daniel David
Dorothea Edward Elena Elizabeth Emeka Emma Eva Farid Francisco Fred Frederick Gabriel Giuseppe Hana Hannah Hannelore Hans Henrik Ines Ivana James Jan Jean Jim
Johannes John Jorge Jose Julia Kamala Katharina Kate Kenji Lars Laura Leila Liz Lucas Ludmila Luis Marek Margaret Maria Marie Mark Mateo Mei Michael Milena Nadia
Ned Nikolai Noor Olga Oluwaseun Patricia Paul Pavel Peter Pierre Priya Rafael Richard Robert Rosalind Samuel Sanna Simone Sofia Soledad Stefan Tamar Ted Theodore
Thomas Tomas Ulrike Valentina Victor William Xiulan Yara Yusuf Zofia""".split()
TITLES = {"en": ["Ms", "Mr", "Mrs", "Dr.", "Prof.", "Dr", "Prof. Dr."], "de": ["Frau", "Herr", "Frau Dr.", "Dr.", "Prof.", "Herrn"], "fr": ["Mme", "Dr", "Dr.", "Prof.", "Mlle", "Mme"], "es": ["Sra.", "Sr.", "Dr.", "Dra.", "Prof.", "Don"]}
_HEADS = "Br Dr G Gr K Kr L M N P R S Sch Sk St T Tr V W Z B D F H J".split()
_VOWELS = "a e i o u ä ö ü é ø á".split()
_MIDS = "lr nd lm rs nz lk mb rt ll ns sk rg nt l r n m k p t f v z g b d".split()
_ENDS = "sky mann ez lini ova ek ard nen au ic sen lulo eth er ier wicz kos dez zaki vin".split()


class Filler:
    """Fills the rows from a seeded generator."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def surname(self) -> str:
        r = self.r
        s = r.choice(_HEADS) + r.choice(_VOWELS) + "".join(r.choice(_MIDS) + r.choice(_VOWELS) for _ in range(r.choice((0, 1, 1, 2)))) + r.choice(_ENDS)
        u = r.random()
        if u < 0.06:
            return r.choice(("de ", "van der ", "von ", "de la ", "del ", "ter ")) + s
        if u < 0.12:
            return s + "-" + self.surname().split()[-1]
        return r.choice(("D'", "O'", "M'")) + s if u < 0.16 else s

    def given(self) -> str:
        return self.r.choice(GIVEN) if self.r.random() < 0.7 else self.r.choice(_HEADS) + self.r.choice(_VOWELS) + self.r.choice(_MIDS) + self.r.choice("aeio")

    def name(self, titled: bool) -> str:
        r, s, g = self.r, self.surname(), self.given()
        u = r.random()
        if titled and u < 0.5:
            return s if r.random() < 0.8 else s.upper()
        i = r.choice("ABCDEFGHJKLMNPRSTUVWXYZ")
        out = f"{s}, {g}" if u < 0.16 else f"{g} {i}. {s}" if u < 0.28 else f"{i}. {s}" if u < 0.42 else f"{i}. {r.choice('ABCEHKM')}. {s}" if u < 0.44 else f"{g} {s}"
        return out.upper() if r.random() < 0.12 and "." not in out else out

    def initials(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHJKLMNOPRSTVW") for _ in range(n))

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def phone(self) -> str:
        d, r = self.digits, self.r
        return r.choice((f"+44 20 7946 0{d(3)}", f"020 7946 0{d(3)}", f"01632 960{d(3)}", f"+441632960{d(3)}", f"0044 (0)1632 960 {d(3)}", f"({d(3)}) 01{d(1)}-0{d(3)}", f"+1-555-01{d(1)}-{d(4)}", f"+1 (555) 01{d(1)} {d(4)}", f"555.01{d(1)}.{d(4)}", f"+49 30 23125{d(3)}", f"(030) 23125-{d(3)}", f"0171 39200{d(2)}", f"0049/30/23125{d(3)}", f"+33 (0)1 9900{d(4)}", f"01 99 00 {d(2)} {d(2)}", f"01.99.00.{d(2)}.{d(2)}", f"+34 900 000 {d(3)}", f"900 000 {d(3)}", f"(+34) 900-000-{d(3)}", f"0034900000{d(3)}"))

    def identity(self) -> str:
        d, r = self.digits, self.r
        a = "".join(r.choice("ABCDEGHJKLMNPRSTXZ") for _ in range(2))
        return r.choice((f"{a}00{d(5)}", f"00{d(7)}", f"{a} 00{d(3)} {d(3)}", f"{a[0]}00{d(6)}", f"QQ {d(2)} {d(2)} {d(2)} {a[0]}", f"QQ{d(6)}{a[0]}", f"9{d(2)} {d(2)} {d(4)}", f"9{d(2)}-{d(2)}-{d(4)}", f"0000-000{d(1)}-{d(4)}-{d(3)}{r.choice('0123456789X')}", f"99/{d(3)}/{d(5)}", f"99 {d(3)} {d(3)} {d(3)}", f"99{d(9)}", f"99{d(6)}{a[0]}", f"S-{d(5)}", f"E{d(8)}"))

    def place(self) -> str:
        return self.r.choice("BCDFGKLMNPRSTVZ") + "".join(self.r.choice("aeio") + self.r.choice("bcdfgklmnprstvz") for _ in range(self.r.choice((1, 1, 2)))) + self.r.choice("aeio")

    def address(self, lang: str) -> str:
        r, d = self.r, self.digits
        n, p, q = r.choice((d(1), d(2), d(3))).lstrip("0") or "7", self.place(), self.place()
        if lang == "de":
            return f"{p}{r.choice(('str. ', 'weg ', 'straße ', 'platz ', 'gasse '))}{n}{r.choice(('', '', 'a', 'b'))}, {r.choice(('', 'D-'))}99{d(3)} {q}{r.choice(('', 'au', 'burg'))}"
        if lang == "fr":
            return f"{n}{r.choice((' ', ', ', ' bis '))}{r.choice(('rue des ', 'rue de ', 'rue ', 'bd ', 'avenue ', 'place '))}{p}, 99{d(3)} {q}{r.choice(('', 'ville'))}"
        if lang == "es":
            return r.choice((f"C/ {p}, {n}, 3.º B, 99{d(3)} {q}", f"Calle de {p} {n}, 99{d(3)} {q}", f"Avda. {p} {n}, 99{d(3)} {q}", f"Plaza {p} {n}, 99{d(3)} {q}"))
        street = f"{n}{r.choice(('', '', 'A', 'B', 'C'))} {p} {r.choice(('St.', 'Street', 'Road', 'Rd', 'Lane', 'Avenue', 'Crescent', 'Close', 'Blvd', 'Court', 'Way'))}"
        u = r.random()
        street = f"Flat {d(1)}, {street}" if u < 0.25 else f"{street}, Apt {d(2)}" if u < 0.4 else street
        return f"{street}, {q}" + r.choice(("", f" 99{d(3)}", f", XX 99{d(3)}", f", ZZ{d(1)} 9QQ", f", ZZ{d(2)} 9QQ"))

    def email(self) -> str:
        r = self.r
        g, s = self.place().lower(), self.place().lower()
        local = r.choice((f"{g}.{s}", f"{g}_{s}", s, f"{s}{self.digits(2)}", f"{g[0]}{s}"))
        host = r.choice((f"{g}-uni", f"{s}", f"mail.{g}", f"lists.{s}", f"bio.{g}-institut"))
        tld = r.choice(("example", "ac.example", "example.org", "test", "invalid"))
        u = r.random()
        if u < 0.1:
            return f"{local} (at) {host} (dot) {tld}".replace("ac.", "ac (dot) ").replace("example.", "example (dot) ")
        if u < 0.2:
            return f"{local} AT {host} DOT {tld}".replace("ac.", "ac DOT ").replace("example.", "example DOT ")
        out = f"{local} @ {host}.{tld}" if u < 0.25 else f"{local}@{host}.{tld}"
        return out.upper() if r.random() < 0.1 else out

    def word(self) -> str:
        if self.r.random() < 0.6:  # words that the table doesn't teach
            return self.place().lower() + self.r.choice("tion ment ic al ness ing ive ed ous ance ity s ation ure".split())
        return self.r.choice("wheat lakes decay erosion drought memory lipids toxins seepage sparse acute marine tidal neural deep rural forêt lésion région caña montane attention peptides networks kinship literacy grief".split())

    def fill(self, row: str) -> list[tuple[str, str]]:
        """(text, label) pieces; label O for ordinary text."""
        out: list[tuple[str, str]] = []
        lang = next((k for k, ws in (("de", ("wohnt", "Sonderdrucke", "Korrespondenz:", "Wir ", "Die ", "Im Mai", "ausgestellt")), ("fr", ("habite", "Tirés", "Correspondance", "Nous", "La copie", "Au print", "Carte", "Appelez")), ("es", ("vive", "Separatas", "Correspondencia", "Agrad", "En mayo", "La copia", "Llame", "DNI"))) if any(w in row for w in ws)), "en")
        i, titled = 0, False
        if " FE, " in row or " AB, " in row or " CM, " in row or " HE, " in row:
            row = row.replace(" FE, ", f" {self.initials(2)}, ").replace(" AB, ", f" {self.initials(2)}, ").replace(" CM, ", f" {self.initials(2)}, ").replace(" HE, ", f" {self.initials(2)}, ")
            row = row.replace("<sur> L.", f"<sur> {self.initials(1)}.").replace("<sur> D.", f"<sur> {self.initials(1)}.").replace("<sur> J.", f"<sur> {self.initials(1)}.").replace("<sur> P.", f"<sur> {self.initials(1)}.")
        while i < len(row):
            if row[i] == "{":
                kind = row[i + 1 : row.index("}", i)]
                text = self.name(titled) if kind == "name" else self.name(False).lower() if kind == "lname" else self.address(lang) if kind == "address" else getattr(self, kind)()
                out.append((text, "name" if kind == "lname" else kind))
                i, titled = row.index("}", i) + 1, False
            elif row[i] == "<":
                kind = row[i + 1 : row.index(">", i)]
                titled = kind == "title"
                text = {"title": lambda: self.r.choice(TITLES[lang]), "sur": self.surname, "Sur": lambda: self.surname().split()[-1], "given": self.given, "year": lambda: str(self.r.randint(1950, 2024)), "n": lambda: self.digits(self.r.choice((1, 2, 3, 5))), "word": self.word, "Word": lambda: self.word().capitalize(), "Noun": lambda: self.r.choice("Kälte Größe Wälder Böden Trübung Störung Nährstoffe".split()), "Place": lambda: self.place().capitalize() + self.r.choice(("xan", "vox", "pastin", ""))}[kind]()
                out.append((text, "O"))
                i = row.index(">", i) + 1
            else:
                j = min([k for k in (row.find("{", i), row.find("<", i)) if k >= 0] or [len(row)])
                out.append((row[i:j].replace("\\n", "\n"), "O"))
                i = j
        return out


def labelled(copies: int = 10, seed: int = 11) -> list[list[tuple[str, str]]]:
    """The table: each row filled ``copies`` times."""
    f = Filler(seed)
    lists = (" FE, ", " AB, ", " CM, ", " HE, ", " K, ")  # reference lists are full of names that don't count
    return [f.fill(row) for row in ROWS.strip().split("\n") for _ in range(copies * (4 if any(x in row for x in lists) else 1))]
