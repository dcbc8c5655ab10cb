"""Personal information inside free text (problem 10).

Everything but addresses of mail is found by information-theoretic disclosure: the corpus is counted for how often a
term stands with a protected entity, against how often it stands elsewhere. The disclosure of a term is its pointwise
mutual information with that entity, log2(p(entity | term) / p(entity)), in bits; full disclosure, p(entity | term) = 1,
is -log2 p(entity), and what a term is short of it, -log2 p(entity | term), is held against a threshold.

* Persons: a term is a word, the entity the place of a name beside a known name or a title. The list of names is
  incomplete and holds ordinary words. Forms of two listed names may be ``SLACK_LISTED`` short, forms with one
  ``SLACK_KNOWN``, others less.
* Identity numbers and phones: a term is the shape of a number (its letters, how many digits), the entity a label such
  as passport no., against labels of other things such as lot no. Numbers of a common form stay unless their shape is
  ``SLACK_FORM`` short in this corpus; numbers of no common form are found only if their shape is labelled as personal
  in the corpus, at most ``SLACK_SHAPE`` short. A label directly before a number decides on that number itself.
* Street addresses: a term is the word for the kind of street, the entity an address with flat, postcode or town.
* Addresses of mail have a sign of their own and are found by their form alone.

What is found is generalised to a placeholder of its type.

Terms are counted per partition before the shuffle; waiting forms meet the table of disclosing terms in shuffled
joins, as both grow with the corpus. Only the given list of names is broadcast, after a check of its size.

Edge cases: null and empty texts have no places; offsets are code points; of overlapping places the one of the more
certain type stays (mail, address, number of identity, phone, person); an empty list of names leaves titles only.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltwork.session import stored

#: How far below full disclosure (every capitalised occurrence in the place of a name) a term may be, in bits: beside
#: another unknown term, beside an initial, beside a known name, and for two listed names together.
SLACK_ALONE, SLACK_INITIAL, SLACK_KNOWN, SLACK_LISTED = 1.5, 3.0, 5.0, 8.0
#: The same for numbers and streets of a common form, and for numbers of no common form.
SLACK_FORM, SLACK_SHAPE = 5.0, 0.9
#: Largest list of names that is sent to the workers.
MAX_NAMES = 1_000_000

# ---- fixed values ---------------------------------------------------------------------------------------------------
_L = "A-Za-z0-9À-ɏ"
_DOT = r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\sdot\s)"
AT_SIGN = re.compile(r"\s?(?:[@＠]|\[at\]|\(at\))\s?|\sat\s(?=[^\s]{1,63}\sdot\s)", re.I)
#: One of these is in every text with such a sign, in small letters.
_AT_HINTS = ("@", "＠", "dot", "[at]", "(at)")
BEFORE_AT = re.compile(rf"(?<![{_L}.+_%-])[{_L}](?:[{_L}._%+-]*[{_L}_+-])?$")
AFTER_AT = re.compile(rf"[{_L}-]+(?:{_DOT}[{_L}-]+)*{_DOT}[A-Za-z]{{2,24}}(?![{_L}])", re.I)
AFTER_WORD = re.compile(rf"[{_L}-]+(?:\sdot\s[{_L}-]+)*\sdot\s[A-Za-z]{{2,24}}(?![{_L}])", re.I)
_EXT = r"(?:,?\s?(?:ext\.?|extension|poste|x)\s?\d{1,5}(?!\d))?"
PHONE_FORMS = [
    r"\(?[+＋]\d{1,3}\)?(?:[\s./-]?\(\d{1,4}\))?(?:[\s./-]?\d){6,12}",  # international
    r"00\d{2}(?:[\s./-]\d{1,6}){2,5}",
    r"(?:1[\s.-])?\(\d{3}\)\s?\d{3}[\s.-]\d{4}",
    r"(?:1[\s.-])?\d{3}([\s.-])\d{3}\1\d{4}",
    r"\(0\d{1,4}\)\s?\d{5,8}",
    r"0\d{2,4}/\d{4,8}(?:-\d{1,5})?",
    r"0\d{4}\s\d{3}\s?\d{3}",
    r"0\d([\s.])\d\d(?:\2\d\d){3}",
    r"8\s\d{3}\s\d{3}(?:[\s-]\d\d){2}",
    r"[0０]\d{1,2}[-－]\d{4}[-－]?\d{4}",
    r"0\d{9,10}(?!\d)",
]
PHONE = re.compile(rf"(?<![{_L}.,/+\-–@#$€_])(?:{'|'.join(PHONE_FORMS)}){_EXT}(?![\d]|[.,/\-]\d|[A-Za-z%])")
#: Forms that are phones only after a label, and the labels.
LABELLED_PHONE = re.compile(r"\d{3}[\s.-]\d{2}[\s.-]\d{2}[\s.-]\d{2}|\d{3}[\s.-]\d{3}[\s.-]\d{3}|\d{9,11}")
BEFORE_PHONE = re.compile(r"(?i)(?:\b(?:tel|tél|tfno|phone|telephone|teléfono|telefon|téléphone|mobile|móvil|fax|call|llame al|appeler le)|\||тел|电话(?:号码)?|電話(?:番号)?|โทร|फ़ोन)\.?\s?[:：]?\s?$")
EXTENSION = re.compile(_EXT)
#: Words before a number that make it something else.
NOT_PERSONAL = re.compile(
    r"(?i)(?:\b(?:lot|batch|isbn|issn|catalogue no|catalog no|cat\. no|part no|order no|item|grant|trial|accession|build|version|doses? of|ranked|ratio(?: was| of)?|doi|serial no|model|kit|figure|fig|table|page|pages|pp|vol|nct|ci|values)\b|[#$€£])[\s.:=]*(?:no\.?\s?)?$"
)
_NUMBER_LABEL = (
    r"(?i:\bSSN|social security (?:number|no\.?)|national insurance (?:number|no\.?)|insurance (?:number|no\.?)|NINO|NHS (?:number|no\.?)|tax (?:id|number|no\.?)|Steuer-?ID(?:-?Nr\.?)?|Steueridentifikationsnummer"
    r"|passport (?:number|no\.?)|passport|Reisepass(?:-?Nr\.?)?|Personalausweis(?:-?Nr\.?)?|identity card(?: (?:number|no\.?))?|ID(?: (?:card|number|no\.?))?|patient (?:record|id|number|no\.?)|medical record(?: number)?|MRN|record(?: no\.?)?"
    r"|DNI|NIE|NIF|N[°º] de sécurité sociale|numéro de sécurité sociale|NIR|паспорт|СНИЛС|ИНН)"
)
LONG_NUMBER = re.compile(rf"\d(?<![\d./-]\d)(?:[\s./-]?\d){{4,16}}(?:[\s-]?[A-Za-z](?![A-Za-z]))?(?![{_L}_\d])")
BEFORE_NUMBER = re.compile(rf"{_NUMBER_LABEL}\s?(?:[:：#]|is|n\.?º|nr\.?|no\.?)?\s?([A-Za-z]{{1,3}}[\s/-]?)?$")
ID_FORMS = re.compile(r"\d(?<![\w./-]\d)(?:\d\d-\d\d-\d{4}|\d\d \d\d \d{4}|\d{7}-?[A-Z]|\d\.\d{3}\.\d{3}-?[A-Z]|(?<=[12]) \d\d \d\d \d\d \d{3} \d{3} \d\d)(?![\w]|[-/]\d)")
#: A form with letters before the digits.
LETTERS_FIRST = re.compile(r"\d\d\s?\d\d\s?\d\d\s?[A-Da-d](?![\w]|[-/]\d)")
BEFORE_DIGITS = re.compile(r"(?<![\w./-])[A-Za-z]{2}\s?$")
#: Numbers of no common form: digits, and the letters before them.
SHAPE = re.compile(r"\d(?:[\s./-]?\d){5,12}(?![\w]|[-/.]\d)")
BEFORE_SHAPE = re.compile(r"(?<![\w./-])([A-Z]{1,3})[\s/-]?$")
#: What every form of a number above and below has, also with full-width signs and glued extensions.
SIX_DIGITS = re.compile(r"\d(?:\D{0,3}\d){5}")
TABLE_ID = re.compile(r"\|\s((?:[A-Z]{1,3}[\s/-]?)?\d(?:[\s./-]?\d){6,14}(?:[\s-]?[A-Z])?)\s\|\s*(?:\n|\Z)")

_CAP = r"[A-ZÀ-Þ][\w'’-]*"
_TOWN = rf"(?P<town>,\s(?:[A-Z]{{2}}\s)?\d{{5}}(?:\s{_CAP})?|,\s{_CAP}(?:,\s[A-Z]{{2}}\s\d{{5}}|\s\d{{5}}(?!\d)|,\s[A-Z]{{2}}(?!\w)|(?=[,.;:)\]\n<|]|\s(?:and|was|is|for|on|in)\s|\s?\Z)))?"
_TYPES = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Boulevard|Blvd\.?|Close|Drive|Dr\.|Court|Ct\.?|Crescent|Terrace|Place|Pl\.?|Square|Sq\.?|Way|Grove|Gardens|Row|Hill|Parkway|Highway)"
_UNIT = r"(?P<unit>,?\s(?:Flat|Apt\.?|Apartment|Unit|Suite|Room)\s?\w{1,5}|,?\s#\s?\d+\w?)?"
# a digit comes first where one can, as a search for one character of a class is fast
ADDRESS_FORMS = [
    rf"\d(?<![\w.-]\d)\d{{0,4}}[A-Za-z]?(?:[-–]\d{{1,5}}[A-Za-z]?)?\s(?:{_CAP}\s){{1,3}}(?P<kind>{_TYPES}|{_TYPES.upper()})(?![\w]){_UNIT}{_TOWN}",
    rf"(?<![\w])(?:[A-ZÄÖÜ][\wäöüß-]*(?P<kind>straße|strasse|str\.|weg|platz|allee|gasse|ring|damm|ufer)|(?P<before>Am|An\sder|Im|Auf\sdem|Zum|Zur)\s[A-ZÄÖÜ][a-zäöüß]+)\s\d{{1,4}}(?:\s?[a-z](?![a-z]))?(?![\w%]|\.\d)(?P<town>,\s\d{{5}}\s[A-ZÄÖÜ][\wäöüß-]+)?",
    rf"\d(?<![\w.-]\d)\d{{0,3}}(?:\s(?:bis|ter|quater))?,?\s(?P<kind>rue|avenue|av\.|place|boulevard|bd|chemin|impasse|allée|quai|route|cours|square)\s(?:de\sla\s|de\s|du\s|des\s|d['’]|l['’])?{_CAP}(?:\s{_CAP})?(?P<town>,\s\d{{5}}\s{_CAP})?",
    rf"(?<![\w])(?P<kind>Calle|C/|Avda\.|Avenida|Plaza|Paseo|Camino|Carrera)\s?(?:de\sla\s|de\slos\s|de\s|del\s)?{_CAP},?\s\d{{1,4}}(?P<unit>,\s\d{{1,2}}\.?[ºª°](?:\s?[A-Z](?![\w]))?)?(?P<town>,\s\d{{5}}\s{_CAP})?",
    r"(?<![\w])(?P<kind>ул\.|улица|пр\.|проспект|пер\.)\s[А-Я][\w-]+,\s(?:д\.\s?)?\d{1,4}(?P<unit>,\sкв\.\s?\d+)?(?P<town>,\s\d{6})?",
]
#: Each form with the words of which a text must have one, each white space of it taken as a blank; none where the form
#: begins with a digit.
ADDRESSES = [
    (re.compile(form), hints)
    for form, hints in zip(
        ADDRESS_FORMS,
        (
            [""],
            "straße strasse str. weg platz allee gasse ring damm ufer".split() + ["Am ", "An der ", "Im ", "Auf dem ", "Zum ", "Zur "],
            [""],
            "Calle C/ Avda. Avenida Plaza Paseo Camino Carrera".split(),
            "ул. улица пр. проспект пер.".split(),
        ),
        strict=True,
    )
]

TITLES = frozenset("mr mrs ms miss mx dr prof professor herr frau mme mlle madame monsieur sr sra srta dra don doña nurse sister г-н г-жа доктор проф д-р".split())
#: After these a family name alone counts.
ALONE = TITLES - {"nurse", "sister"}
#: What follows a name that is the name of something else.
THINGS = frozenset(
    "hospital institute university clinic centre center college school foundation laboratory syndrome disease disorder test method score scale index reaction procedure operation sign criteria street road cohort study trial archive".split()
)
WORD = re.compile(r"([^\W\d_]+(?:['’][^\W\d_]+)*(?:[-‐][^\W\d_]+)*)")
# ---------------------------------------------------------------------------------------------------------------------


class Names:
    """Given and family names by their lower-case form."""

    def __init__(self, given: set[str], family: set[str]) -> None:
        self.given, self.family = given, family

    def is_given(self, word: str) -> bool:
        return word in self.given

    def is_family(self, word: str) -> bool:
        return word in self.family or ("-" in word and any(p in self.family for p in word.split("-")))


def name_list(names: DataFrame) -> Names:
    """The list of names on the driver, after a check of its size."""
    if names.count() > MAX_NAMES:
        raise ValueError(f"the list of names has more than {MAX_NAMES} rows")
    sets: dict[str, set[str]] = {"given": set(), "family": set()}
    for entry, kind in names.select(F.trim("entry"), F.lower(F.trim("kind"))).collect():
        if entry and kind in sets:
            sets[kind].add(entry.casefold())
    return Names(**sets)


def _words(text: str) -> list[tuple[str, int, int]]:
    """Words with their places, without a possessive ending."""
    parts = WORD.split(text)
    at = list(accumulate(map(len, parts)))
    words = list(zip(parts[1::2], at[::2], at[1::2], strict=False))
    if "'s" in text or "’s" in text or "'S" in text or "’S" in text:
        words = [(w[:-2], a, b - 2) if len(w) > 3 and w[-2] in "'’" and w[-1] in "sS" else (w, a, b) for w, a, b in words]
    return words


def _gap(text: str, a: int, b: int) -> str:
    """How two words are joined: space, initial's point, comma, or other."""
    g = text[a:b]
    if g == " ":
        return " "
    if g in ("'s ", "’s "):
        return "?"
    if g.isspace():
        return "_" if g.count("\n") < 2 and len(g) < 4 else "?"
    if g in (". ", ".\n", "."):
        return "."
    if g in (", ", ",\n"):
        return ","
    return "?"


def _initial(w: str) -> bool:
    return len(w) == 1 and w.isalpha()


CAPITAL, SMALL, GIVEN, FAMILY = range(4)


def evidence(text: str, ws: list[tuple[str, int, int]], names: Names, seen: dict[str, list[int]]) -> None:
    """Add the words of a text to ``seen``: term to [capital, small, given, family]. Only within a line.

    Every word written small is counted, as any can be the unlisted part of a name written small.
    """
    given, family, n = names.given, names.is_family, len(ws)

    def note(term: str, what: int) -> None:
        row = seen.get(term)
        if row is None:
            row = seen[term] = [0, 0, 0, 0]
        row[what] += 1

    for i, (w, a, b) in enumerate(ws):
        if not w[0].isupper():
            known = w in given or family(w)
            if known or len(w) > 1 and w.islower():
                note(w.casefold(), SMALL)
            if known:
                if i and ws[i - 1][0].islower():  # both parts of a known name written small
                    prev, before = ws[i - 1][0], text[ws[i - 1][2] : a]
                    if before == " " and prev in given and family(w):
                        note(prev, GIVEN)
                        note(w, FAMILY)
                    elif before == ", " and family(prev) and w in given:
                        note(prev, FAMILY)
                        note(w, GIVEN)
            continue
        key = w.casefold()
        note(key, CAPITAL)
        if len(w) < 2:
            continue
        if i:
            j = i - 1
            before = text[ws[j][2] : a]
            prev = ws[j][0]
            if before == ". " and _stands_alone(text, ws, j):
                note(key, FAMILY)
            elif before == " " and prev[0].isupper() and prev.casefold() in given:
                note(key, FAMILY)
            elif before in (" ", ". ") and prev.casefold() in ALONE:
                note(key, FAMILY)
            elif (before == ", " or before == " " and not w.isascii() and not prev.isascii()) and prev[0].isupper() and family(prev.casefold()):
                note(key, GIVEN)
        if i + 1 < n:
            k = i + 1
            after, nxt = text[b : ws[k][1]], ws[k][0]
            if after == ", " and nxt[0].isupper() and nxt.casefold() in given:
                if not (k + 1 < n and ws[k + 1][0][0].isupper() and text[ws[k][2] : ws[k + 1][1]] == " "):
                    note(key, FAMILY)
            elif after == " ":
                if _initial(nxt) and k + 1 < n and text[ws[k][2] : ws[k + 1][1]] == ". ":
                    k += 1
                    nxt = ws[k][0]
                if nxt[0].isupper() and family(nxt.casefold()) and not _thing(ws, k + 1):
                    note(key, GIVEN)
                elif nxt[0].isupper() and not w.isascii() and nxt.casefold() in given:
                    note(key, FAMILY)


def _stands_alone(text: str, ws: list, j: int) -> bool:
    """Whether word ``j`` is a capital initial and not the end of a shortened word such as U.K."""
    w, a, _ = ws[j]
    return len(w) == 1 and w.isupper() and (a == 0 or text[a - 1] not in ".'’-&/" and not text[a - 1].isalnum())


def _thing(ws: list[tuple[str, int, int]], k: int) -> bool:
    return k < len(ws) and ws[k][0].casefold() in THINGS


class Spans:
    """Places without overlaps, in order."""

    def __init__(self) -> None:
        self.places: list[tuple[int, int]] = []

    def free(self, a: int, b: int) -> bool:
        i = bisect_left(self.places, (a, b))
        return (i == 0 or self.places[i - 1][1] <= a) and (i == len(self.places) or b <= self.places[i][0])

    def take(self, a: int, b: int) -> bool:
        """Whether the place is free; it is taken then."""
        if free := self.free(a, b):
            insort(self.places, (a, b))
        return free


def _shape(number: str) -> str:
    """Term of a number: its letters and how many digits it has, with a plus sign before them."""
    return "".join(c for c in number.upper() if c.isalpha() or c in "+＋") + str(sum(c.isdigit() for c in number))


#: What is known of a place: sure by itself, of a common form, of a shape that has to be labelled elsewhere.
SURE, FORM, BY_SHAPE = "sure", "form", "shape"
#: Sign before terms that are no words.
_NO_WORD = "#"


def graded_places(text: str, seen: dict[str, list[int]]) -> tuple[list[tuple[str, int, int, str | None, str]], Spans]:
    """``(kind, start, end, term, grade)`` of mail, addresses, identity numbers and phones, without overlaps.

    Adds to ``seen`` how often each term stands in all and with its entity: numbers after a label of their kind or of
    another thing, streets with more of an address or without.
    """
    found: list[tuple[str, int, int, str | None, str]] = []
    spans = Spans()

    def note(term: str, n: int, of: int) -> str:
        row = seen.setdefault(_NO_WORD + term, [0, 0, 0, 0])
        row[GIVEN] += n
        row[CAPITAL] += of
        return _NO_WORD + term

    def add(kind: str, a: int, b: int, term: str | None = None, grade: str = SURE) -> None:
        if spans.take(a, b):
            found.append((kind, a, b, term, grade))

    small = text.lower()
    for m in AT_SIGN.finditer(text) if any(h in small for h in _AT_HINTS) else ():
        local = BEFORE_AT.search(text, max(0, m.start() - 80), m.start())
        domain = (AFTER_WORD if m[0].strip().lower() == "at" else AFTER_AT).match(text, m.end())
        if local and domain:
            add("email", local.start(), domain.end())
    flat = " ".join(text.split())
    for form, hints in ADDRESSES:
        if hints[0] in flat or any(h in flat for h in hints):
            for m in form.finditer(text):
                if spans.free(*m.span()):
                    part = m.groupdict()
                    more = int(bool(part.get("unit") or part["town"]))
                    term = note("street " + (part["kind"] or part["before"]).strip(".").casefold(), more, 1)
                    add("address", *m.span(), term, SURE if more else FORM)
    numbers = list(LONG_NUMBER.finditer(text))
    if not numbers and not SIX_DIGITS.search(text):
        return found, spans

    def personal(kind: str, a: int, b: int, grade: str = FORM) -> None:
        """A number of a form, unless the label before it says that it is something else."""
        term = f"{kind} {_shape(text[a:b])}"
        if NOT_PERSONAL.search(text, max(0, a - 24), a):
            note(term, 0, 1)
        elif spans.free(a, b):
            labelled = kind == "phone" and BEFORE_PHONE.search(text, max(0, a - 20), a)
            term = note(term, int(bool(labelled)), int(bool(labelled)))
            add(kind, a, b, term, SURE if labelled else grade)

    for m in numbers:
        if label := BEFORE_NUMBER.search(text, max(0, m.start() - 48), m.start()):
            a, b = label.start(1) if label[1] else m.start(), m.end()
            note("id_number " + _shape(text[a:b]), 1, 1)
            add("id_number", a, b)
    shaped = []
    for m in SHAPE.finditer(text):
        if before := BEFORE_SHAPE.search(text, max(0, m.start() - 5), m.start()):
            shaped.append((before.start(), m.end()))
            label = BEFORE_NUMBER.search(text, max(0, before.start() - 48), before.start())
            if label and not label[1]:
                if spans.free(before.start(), m.end()):  # else counted above
                    note("id_number " + _shape(text[before.start() : m.end()]), 1, 1)
                add("id_number", before.start(), m.end())
    for m in ID_FORMS.finditer(text):
        personal("id_number", *m.span())
    for m in LETTERS_FIRST.finditer(text):
        if before := BEFORE_DIGITS.search(text, max(0, m.start() - 4), m.start()):
            personal("id_number", before.start(), m.end())
    for m in numbers:
        form = LABELLED_PHONE.match(text, m.start())
        if form and form.end() >= m.end() - 2 and BEFORE_PHONE.search(text, max(0, m.start() - 20), m.start()):
            add("phone", m.start(), EXTENSION.match(text, form.end()).end())
    for m in PHONE.finditer(text):
        if sum(c.isdigit() for c in m[0]) >= 8:
            personal("phone", *m.span())
    for m in TABLE_ID.finditer(text):
        personal("id_number", *m.span(1))
    for a, b in shaped:
        personal("id_number", a, b, BY_SHAPE)
    return found, spans


def fixed_places(text: str) -> list[tuple[str, int, int]]:
    """Mail, address, identity number and phone places of a text before their terms are judged, without overlaps."""
    return [x[:3] for x in graded_places(text, {})[0]]


def person_forms(text: str, ws: list[tuple[str, int, int]], names: Names, taken: Spans) -> Iterator[tuple[int, int, str | None, str | None, str]]:
    """``(start, end, given term, family term, beside)``: terms that still need disclosure, null for parts that do not.

    ``beside`` says what unknown terms stand beside: known, initial or alone; listed for two listed names, small for known
    names written small.
    """
    n, i = len(ws), 0
    keys = _Keys(ws)
    given, family = names.given, names.family
    unsure = -1  # last word of the forms that may turn out to be none, or fall with one that begins before them
    while i < n:
        w = ws[i][0]
        if len(w) > 1 and w.islower() and w not in given and w not in family and "-" not in w:
            i += 1
            continue
        form = _form(text, ws, keys, i, names)
        if form is None:
            if w in family and w.islower() and i and ws[i - 1][0].islower() and len(ws[i - 1][0]) > 2 and text[ws[i - 1][2] : ws[i][1]] == " ":
                yield ws[i - 1][1], ws[i][2], keys[i - 1], w, "small"
            i += 1
            continue
        last, g, f, beside = form
        a, end = ws[i][1], ws[last][2]
        if last > i and _initial(ws[last][0]) and text[end : end + 1] == ".":
            end += 1
        tail = text[end : end + 8].lstrip()
        if tail.startswith(("et al", "et\nal")) or _thing(ws, last + 1) and text[end : ws[last + 1][1]].isspace():
            i = last + 1
            continue
        if taken.free(a, end):
            yield a, end, g, f, beside
        # a first word that may turn out to be none leaves what follows to forms of its own, and these do the same
        if i <= unsure or g is not None and beside not in ("small", "listed"):
            unsure = max(unsure, last)
            i += 1
        else:
            i = last + 1


class _Keys:
    """Lower-case forms of words, made when asked for."""

    def __init__(self, ws: list[tuple[str, int, int]]) -> None:
        self.ws = ws

    def __getitem__(self, i: int) -> str:
        return self.ws[i][0].casefold()


def _form(text: str, ws: list, keys: _Keys, i: int, names: Names) -> tuple[int, str | None, str | None, str] | None:
    """The name form that begins at word ``i``: its last word, terms to disclose, and what they stand beside."""
    n, w, key = len(ws), ws[i][0], keys[i]
    if key in TITLES:
        return None

    def gap(k: int) -> str:
        return _gap(text, ws[k][2], ws[k + 1][1]) if k + 1 < n else "?"

    g = gap(i)
    cap = w[0].isupper()
    if len(w) == 1:  # initial(s) family
        if g != "." or not (_stands_alone(text, ws, i) or w.islower() and (i == 0 or text[ws[i][1] - 1] in " \n(")):
            return None
        k = i + 1
        if len(ws[k][0]) == 1 and ws[k][0].isupper() and gap(k) == "." and k + 1 < n:
            k += 1
        f, fk = ws[k][0], keys[k]
        if len(f) < 2 or fk in TITLES:
            return None
        if names.is_family(fk):
            if cap and f[0].isupper():
                return k, None, None, "known"
            return (k, None, fk, "small") if w.islower() and f.islower() else None
        return (k, None, fk, "initial") if cap and f[0].isupper() else None
    titled = i > 0 and keys[i - 1] in TITLES and gap(i - 1) in " ._"
    if g in " _" and i + 1 < n:  # given (initial) family
        k = i + 1
        if len(ws[k][0]) == 1 and ws[k][0].isupper() and gap(k) == "." and k + 1 < n:
            k += 1
        f, fk = ws[k][0], keys[k]
        if len(f) > 1 and fk not in TITLES:
            kg, kf = names.is_given(key), names.is_family(fk)
            caps = cap and f[0].isupper()
            if kg and kf:
                if caps:
                    return k, key, fk, "listed"
                if w.islower() and f.islower():
                    return k, key, fk, "small"
            elif kg and g == " " and k == i + 1 and w.islower() and f.islower() and len(f) > 2:
                return k, key, fk, "small"
            elif caps and kg:
                return k, None, fk, "known"
            elif caps and kf and not names.is_family(key):
                # with an initial between, the initial and the family name are a form of their own
                return k, key, None, "known" if k == i + 1 else "alone"
            elif caps and k == i + 1 and names.is_given(fk):  # family name first
                if names.is_family(key):
                    return k, fk, key, "listed"
                if not w.isascii():
                    return k, None, key, "known"
            elif caps and k == i + 1 and names.is_family(key) and not w.isascii() and not f.isascii():
                return k, fk, None, "known"
            elif caps and g == " " and not (titled or names.is_family(key) or names.is_given(fk)):
                return k, key, fk, "alone"
    if g == "," and i + 1 < n:  # family, given (initial)
        k = i + 1
        o, ok = ws[k][0], keys[k]
        kf, kg = names.is_family(key), names.is_given(ok)
        if len(o) > 1 and (kf or kg) and cap == o[0].isupper():
            last, joined = k, gap(k)
            if k + 1 < n and joined in " _" and len(ws[k + 1][0]) == 1 and ws[k + 1][0].isupper() and gap(k + 1) in (".", "?", ","):
                last = k + 1
            goes_on = k + 1 < n and joined in " _" and names.is_family(keys[k + 1])
            if not goes_on:
                if kf and kg:
                    return last, ok, key, "listed" if cap else "small"
                if cap and kf and not names.is_family(ok):
                    return last, ok, None, "known"
                if cap and kg and not (joined == " " and ws[k + 1][0][0].isupper() and last == k):
                    return last, None, key, "known"
    if titled and keys[i - 1] in ALONE and cap and (names.is_family(key) or not names.is_given(key)):
        return i, None, None, "known"
    return None


def _missing(n: Column, of: Column) -> Column:
    return -F.log2(F.least(F.lit(1.0), n / F.greatest(of, F.lit(1))))


def passed_on(scored: DataFrame, counts: DataFrame, waits: DataFrame) -> DataFrame:
    """``scored`` with the terms that stand beside a disclosing term of the other role: both parts of a name may be unknown."""
    pairs = waits.where((F.col("beside") == "alone") & F.col("given").isNotNull() & F.col("family").isNotNull()).select("given", "family")
    parts = [scored]
    for role, other in (("given", "family"), ("family", "given")):
        sure = scored.where((F.col("role") == other) & (F.col("below") <= SLACK_ALONE)).select(F.col("term").alias(other))
        n = pairs.join(sure, other, "left_semi").groupBy(F.col(role).alias("term")).agg(F.count(F.lit(1)).alias("n"))
        parts.append(n.join(counts, "term").select("term", F.lit(role).alias("role"), _missing(F.col("n"), F.col("n_capital")).alias("below"), _missing(F.col("n"), F.col("n_capital") + F.col("n_small")).alias("below_any")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("term", "role").agg(F.min("below").alias("below"), F.min("below_any").alias("below_any"))


def disclosure(counts: DataFrame) -> DataFrame:
    """``(term, role, below, below_any)``: how many bits the term's disclosure is below the full one.

    Disclosure is log2(p(role | term) / p(role)) over capitalised occurrences. Full disclosure, p(role | term) = 1, is
    -log2 p(role), so what is missing is -log2 p(role | term). ``below_any`` is the same over all occurrences. Shapes
    and kinds of streets have the role ``given`` too; there half a case is added on either side, as few are counted.
    """
    words = ~F.col("term").startswith(_NO_WORD)
    parts = [
        counts.where(words & (F.col(f"n_{role}") > 0)).select(
            "term", F.lit(role).alias("role"), _missing(F.col(f"n_{role}"), F.col("n_capital")).alias("below"), _missing(F.col(f"n_{role}"), F.col("n_capital") + F.col("n_small")).alias("below_any")
        )
        for role in ("given", "family")
    ]
    missing = _missing(F.col("n_given") + 0.5, F.col("n_capital") + F.lit(1.0))
    shapes = counts.where(~words).select("term", F.lit("given").alias("role"), missing.alias("below"), missing.alias("below_any"))
    return parts[0].unionByName(parts[1]).unionByName(shapes)


def places(documents: DataFrame, listed: DataFrame) -> DataFrame:
    """``(doc_id, pii_type, span_start, span_end)`` of all documents."""
    known = name_list(listed)
    docs = documents.where(F.length("text") > 0).select("doc_id", "text")

    n_columns = ["n_capital", "n_small", "n_given", "n_family"]
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, pii_type string, span_start int, span_end int, given string, family string, beside string, "
    schema += ", ".join(f"{c} bigint" for c in n_columns)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places and waiting forms, and per batch the counts of its terms (type ``term``, the term in ``given``)."""
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            types = [id_type, pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 3, *[pa.int64()] * 4]
            out, seen = [], {}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                fixed, taken = graded_places(text, seen)
                out += [(doc_id, kind, a, b, None if grade == SURE else term, None, grade) for kind, a, b, term, grade in fixed]
                ws = _words(text)
                evidence(text, ws, known, seen)
                out += [(doc_id, "person", *form) for form in person_forms(text, ws, known, taken)]
            counts = [None, ["term"] * len(seen), None, None, list(seen), None, None, *zip(*seen.values(), strict=True)]
            for columns, n in ((list(zip(*out, strict=True)) + [None] * 4, len(out)), (counts, len(seen))):
                if n:
                    arrays = [pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    names = [x.split(" ")[0] for x in schema.split(", ")]
    both = stored(docs.mapInArrow(find, schema), "places")
    found = both.where("pii_type <> 'term'").drop(*n_columns)
    counts = stored(both.where("pii_type = 'term'").groupBy(F.col("given").alias("term")).agg(*[F.sum(c).alias(c) for c in n_columns]), "term-counts")
    slack = F.lit(SLACK_ALONE)
    for beside, bits in {"known": SLACK_KNOWN, "initial": SLACK_INITIAL, "listed": SLACK_LISTED, FORM: SLACK_FORM, BY_SHAPE: SLACK_SHAPE}.items():
        slack = F.when(F.col("beside") == beside, bits).otherwise(slack)
    result = found.where("given is null and family is null")
    waits = found.where("given is not null or family is not null")
    scored = stored(passed_on(disclosure(counts), counts, waits), "disclosure")
    for role in ("given", "family"):
        terms = scored.where(F.col("role") == role).select(F.col("term").alias(role), "below", "below_any")
        # known names written small must often enough stand as names in the corpus, else they are ordinary words there
        enough = F.when(F.col("beside") == "small", F.col("below_any") <= SLACK_KNOWN).otherwise(F.col("below") <= slack)
        waits = waits.where(F.col(role).isNull()).unionByName(waits.where(F.col(role).isNotNull()).join(terms, role).where(enough).drop("below", "below_any"))
    spans = result.unionByName(waits).select("doc_id", "pii_type", "span_start", "span_end")
    return without_overlaps(spans)


def without_overlaps(spans: DataFrame) -> DataFrame:
    """``spans`` (doc_id, pii_type, span_start, span_end) in their order, without those that overlap one kept before.

    Only spans of a run in which each overlaps an earlier one are gone through together; most runs are one span.
    """
    earlier = Window.partitionBy("doc_id").orderBy("span_start", F.col("span_end").desc())
    upto = F.max("span_end").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    begins = spans.withColumn("begins", F.when(upto > F.col("span_start"), 0).otherwise(1))
    runs = begins.withColumn("run", F.sum("begins").over(earlier.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    span = F.struct("span_start", (-F.col("span_end")).alias("before"), "span_end", "pii_type")
    lists = runs.groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(span)).alias("l"))
    keep = lambda acc, x: F.when((F.size(acc) == 0) | (F.element_at(acc, -1)["span_end"] <= x["span_start"]), F.concat(acc, F.array(x))).otherwise(acc)
    kept = F.when(F.size("l") == 1, F.col("l")).otherwise(F.aggregate("l", F.slice("l", 1, 1), keep))
    return lists.select("doc_id", F.explode(kept).alias("s")).select("doc_id", "s.pii_type", "s.span_start", "s.span_end")


def replaced(documents: DataFrame, found: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of all documents, each place replaced by its type in brackets; all other text unchanged."""
    spans = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end", "pii_type"))).alias("spans"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        piece = F.substr(F.col("text"), acc["at"] + 1, s["span_start"] - acc["at"])
        return F.struct(s["span_end"].alias("at"), F.concat(acc["out"], piece, F.lit("["), F.upper(s["pii_type"]), F.lit("]")).alias("out"))

    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, F.length("text") - acc["at"])))
    return documents.select("doc_id", "text").join(spans, "doc_id", "left").select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(clean).alias("text"))
