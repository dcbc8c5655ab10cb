"""Sentence boundaries across languages and scripts (problem 1).

The rules are compiled into a finite transducer: two tables, next state and emission, over the symbols that a local
scan finds in a text (ends of sentences, blank lines, line breaks, list items and headings at the start of a line,
quotes and brackets with what follows them). A state says whether a unit is open, whether it is a line of its own, and
which quotation or bracket it is in, so nothing inside one is split. The depth of brackets is a counter beside the
tables, without a limit.

Every text is cut into chunks by the JVM, never beside white space or a mark, so Python sees chunks and their
surroundings only. One pass over the chunks lists their symbols and makes each a function from the state before it to
the state after it and the start of the unit that is open there. The functions of a text are composed by a parallel
prefix scan (up and down a tree of pairs), which gives each chunk its state and open unit; the first chunk of a text
starts in the state of no unit. Then every chunk emits its units by running its stored symbols through the tables. No
text is read twice, and no task holds more of a text than a chunk and one function per chunk.

What a short word before a point means is decided by lists of abbreviations and by what stands on both sides.

Edge cases: null, empty and blank texts have no units; rows without ``doc_id`` are left out; of repeated rows one
counts; an unclosed quotation or bracket ends with its paragraph; a cut-off end is a unit. A run of white space, marks
or points is never cut, so a chunk is longer than its size where such a run is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.session import stored

#: Characters of a chunk, and the surroundings that a decision may look at on either side.
CHUNK, HALO = 2000, 256

# ---- fixed values ---------------------------------------------------------------------------------------------------
#: Abbreviations that never end a sentence.
NEVER = frozenset(
    """Mr Mrs Ms Dr Drs Prof St Col Gen Lt Sgt Capt Rev Hon Messrs Sr Sra Srta Dra Dres D Dña Mme Mlle MM Me Hr Fr Frau Bros cf Cf vs viz
    i.e e.g I.e E.g ie eg approx Approx sp spp nov var subsp No Nos Nr nr Fig Figs fig figs Sect Sec sect Eq Eqs eq Ref Refs Tab Tabs tab
    Abb abb Vol vol Vols pp Ch ch Chap Art Temp Dept ca Ca circa bzw Bzw vgl Vgl ggf Ggf med z.B d.h u.a u.U s S o Bd Hrsg geb Ing Dipl
    ej ex pág págs Pág núm Núm av Avda Av aprox Aprox EE env Env éd Проф проф рис Рис табл стр см См ср ул им акад д-р напр т.е т.к т.н т к е гг
    د ص أ م डॉ श्री क्र पृ शि.वि मि.ग्रा कि.मी कि.ग्रा सं""".split()
)
#: Abbreviations that end a sentence only where the next word shows it; before a digit they do not.
NUMBERED = frozenset("Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Mon Tue Wed Thu Fri Sat Sun p v f h n т ч руб".split())
#: Abbreviations that are words too: they go on before a number, an opening bracket or a word in small letters only.
WORDS_TOO = frozenset("no nos art Don".split())
#: Abbreviations of measures that end a sentence after a number: they go on in all other places.
AFTER_NUMBER = frozenset("min max".split())
#: Words before a single letter that is no initial, and words that begin a sentence and are no name.
LETTERED = frozenset(
    """hepatitis influenza vitamin vitamins group groups type types grade class stage phase arm section part factor factors protein cohort category
    level panel appendix figure table box model scenario site strain variant lineage cluster blood plan step option gruppe typ stadium klasse phase groupe stade classe grupo tipo fase etapa""".split()
)
STARTERS = frozenset(
    """The This These Those That There Then Thus They Their It Its In On At For From With Without We Our As An After Before During Although However Here He She
    If Since Some Such To Under When Where While Which Both Each No Not Among All And But Two Three Most Many More Patients Results Conclusions Methods
    Der Die Das Ein Eine Es Im Wir Diese Dieser Bei Nach Le La Les Un Une Nous Ces Cette El Los Las Una Este Esta Estos En""".split()
)
#: What follows an ordinal number with a point.
AFTER_ORDINAL = re.compile(
    r"\s+(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Quartal|Jahrhundert|Kapitel|Abschnitt|Auflage|Woche|Tag|Jahrestag|Klasse|Stock)\b"
)
#: Headings on a line of their own, besides numbered ones and lines in capitals.
HEADINGS = """abstract|background|introduction|objectives?|aims?|methods?|materials and methods|methodology|study design|design|setting|participants|
results?|results and discussion|findings|discussion|conclusions?|summary|references|acknowledge?ments?|funding|limitations|appendix|supplement|interpretation|keywords|
hintergrund|einleitung|zusammenfassung|ziele?|methoden|methodik|methoden und daten|material und methoden|ergebnisse|diskussion|schlussfolgerung(?:en)?|fazit|literatur|
résumé|introduction|contexte|objectifs?|méthodes?|matériel et méthodes|résultats|discussion|conclusions?|références|
resumen|introducción|antecedentes|objetivos?|métodos?|material y métodos|resultados|discusión|conclusion(?:es)?|conclusión|referencias|
введение|аннотация|резюме|цель|методы|материалы и методы|результаты|обсуждение|выводы|заключение|литература|
الملخص|المقدمة|الخلفية|الأهداف|المنهجية|الطرق|النتائج|المناقشة|الخلاصة|الاستنتاجات|المراجع|
सारांश|परिचय|पृष्ठभूमि|उद्देश्य|विधियाँ|विधि|परिणाम|चर्चा|निष्कर्ष|संदर्भ|
摘要|背景|引言|前言|目的|方法|材料与方法|结果|讨论|结论|参考文献|要旨|概要|はじめに|緒言|目的|方法|対象と方法|結果|考察|結論|まとめ|参考文献|
บทคัดย่อ|บทนำ|ความเป็นมา|วัตถุประสงค์|วิธีการ|ระเบียบวิธี|ผลการศึกษา|ผลลัพธ์|อภิปราย|สรุป|เอกสารอ้างอิง""".replace("\n", "")
# ---------------------------------------------------------------------------------------------------------------------

_ENDS = ".!?…。！？।॥؟۔｡"
_MARKS = '"“”„«»「」『』《》()[]（）'
_THAI = "฀-๏๚-๿"
#: Where something may happen: line breaks, ends and marks; in Thai also white space.
EVENT = re.compile(rf"[\n{_ENDS}{re.escape(_MARKS)}]")
EVENT_THAI = re.compile(rf"[\n{_ENDS}{re.escape(_MARKS)}]|(?<=[{_THAI}])(?<!ๆ)[^\S\n]+(?![\s\dA-Za-zÀ-ɏๆ])")
THAI_CHAR = re.compile(f"[{_THAI}]")
END_RUN = re.compile(f"[{_ENDS}]+")
NON_SPACE = re.compile(r"\S")
_WORD = r"[\wऀ-ॣ॰-ॿ฀-๎'’\-]"
LAST_WORD = re.compile(rf"{_WORD}+(?:\.{_WORD}+)*\Z")
NEXT_WORD = re.compile(r"[^\W\d_]+")
LIST_ITEM = re.compile(r"[^\S\n]*(?:[•‣◦▪●*–—-]|\(?\d{1,3}[.)]|\(?[a-zA-Z][)])[^\S\n]+\S")
HEADING = re.compile(
    rf"[^\S\n]*(?:(?i:{HEADINGS})|(?:Case report|Case|Table|Figure|Section|Chapter|Part|Appendix|Box|Abschnitt|Kapitel|Tabelle|Tableau|Tabla|Capítulo|Chapitre|Глава|Раздел)[ ]\d+"
    r"|(?=[^\n]{4,60}(?:\n|\Z))(?:[A-ZÀ-ÞА-Я]{3,}[A-ZÀ-ÞА-Я0-9 &/,:()-]*)"
    r"|(?=[^\n]{3,60}(?:\n|\Z))\d{1,2}(?:\.\d{1,2}){0,3}\.?[ ](?![^\n]*[.!?,;:…。][ ]*(?:\r?\n|\Z))[^\W\d_a-zß-ÿ][^\n.!?;:]*?)[ ]*:?[^\S\n]*(?=\n|\Z)(?![^\S\n]*\n[^\S\n]*[a-zß-ÿа-я])"
)
MIXED_CASE = re.compile(r"[a-z]{1,3}[A-Z]|doi:")
GLUED_START = re.compile(r"[A-ZÀ-ÞА-Я](?:[\w'’-]*(?:[\s,:;!?。、，…（(「“《]|\Z)|\w+\.\s|\.[a-z]\.)|[a-z]{1,3}[A-Z]\w*\s")

# ---- symbols and states ---------------------------------------------------------------------------------------------
TEXT, END, BLANK, BREAK, LINE, THAI = range(6)
#: A closing mark ends a unit: never, always, if it was opened inside a unit, if it was opened at its start.
NO, ALWAYS, INSIDE, AT_START = range(4)
_KINDS = ['""', "“”", "„“", "«»", "»«", "「」", "『』", "《》", "()", "[]", "（）"]
_NESTED = (8, 9, 10)
N_SYMBOLS = 6 + 4 * len(_MARKS)


#: States that are no bracket, then six (three kinds of brackets, begun inside or at the start of a unit) per depth.
N_FLAT, N_NESTED = 19, 6


def _compile() -> tuple[list[list[int]], list[list[int]]]:
    """Tables ``next[symbol][state]`` and ``emit[symbol][state]`` (1: a unit ends here) up to depth 2.

    A bracket deeper than that does what it does at depth 2, counted from its own depth.
    """
    flat: list = ["none", "line", "open", *[(k, a) for k in range(len(_KINDS)) if k not in _NESTED for a in (0, 1)]]
    number = {s: i for i, s in enumerate(flat)}

    def at_depth(k: int, at_start: int, depth: int) -> int:
        return N_FLAT + N_NESTED * (depth - 1) + 2 * _NESTED.index(k) + at_start if k in _NESTED else number[k, at_start]

    states = [(s, number[s]) for s in flat[:3]]
    states += [((k, a, d), at_depth(k, a, d)) for k in range(len(_KINDS)) for a in (0, 1) for d in ((1, 2) if k in _NESTED else (1,))]
    opens = {m: next((k for k, p in enumerate(_KINDS) if p[0] == m), None) for m in _MARKS}
    step, emit = [[0] * len(states) for _ in range(N_SYMBOLS)], [[0] * len(states) for _ in range(N_SYMBOLS)]

    for s, at in states:
        inside = isinstance(s, tuple)

        def rule(symbol: int, to: str | int, ends: int = 0, at: int = at) -> None:
            step[symbol][at], emit[symbol][at] = number[to] if isinstance(to, str) else to, ends

        rule(TEXT, "open" if s == "none" else at)
        rule(END, at if s == "line" or inside else "none", int(s in ("none", "open")))
        rule(BLANK, "none", int(s != "none"))
        rule(BREAK, "none" if s == "line" else at, int(s == "line"))
        rule(LINE, "line" if s == "none" else at)
        rule(THAI, "none" if s == "open" else at, int(s == "open"))
        for c, mark in enumerate(_MARKS):
            for follow in (NO, ALWAYS, INSIDE, AT_START):
                symbol = 6 + 4 * c + follow
                if not inside:
                    k = opens[mark]
                    rule(symbol, "line" if s == "line" else "open" if k is None else at_depth(k, int(s == "none"), 1))
                    continue
                k, at_start, depth = s
                closes = mark == _KINDS[k][1] or (k == 2 and mark == "”")
                if closes and depth > 1:
                    rule(symbol, at_depth(k, at_start, depth - 1))
                elif closes:
                    ends = follow == ALWAYS or (follow == INSIDE and not at_start) or (follow == AT_START and at_start)
                    rule(symbol, "none" if ends else "open", int(ends))
                elif k in _NESTED and mark == _KINDS[k][0]:
                    rule(symbol, at_depth(k, at_start, depth + 1))
                else:
                    rule(symbol, at)
    return step, emit


_STEP, _EMIT = _compile()
N_STATES = len(_STEP[0])
#: Of each symbol the states that it changes or ends a unit in.
_MOVES = [[(s, to, e) for s, (to, e) in enumerate(zip(*rows, strict=True)) if e or to != s] for rows in zip(_STEP, _EMIT, strict=True)]
#: Symbols that may end a unit.
_MAY_END = [any(row) for row in _EMIT]


def step(symbol: int, state: int) -> tuple[int, int]:
    """State after a symbol, and whether a unit ends at it; of states at any depth."""
    if state < N_STATES:
        return _STEP[symbol][state], _EMIT[symbol][state]
    known = N_FLAT + N_NESTED + (state - N_FLAT) % N_NESTED
    to = _STEP[symbol][known]
    return to + state - known if to >= N_FLAT else to, _EMIT[symbol][known]


def _is_cjk(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "＀" <= c <= "￯" or "　" <= c <= "〿"


def _next_kind(text: str, at: int) -> str:
    """Of what stands at ``at``: U begins a sentence, l does not, D digit, O letter without case, ( bracket."""
    c = text[at]
    if c.islower():
        return "U" if MIXED_CASE.match(text, at) else "l"
    if c.isupper() or c.istitle():
        return "U"
    if c.isdigit():
        return "D"
    if c.isalpha():
        return "O"
    if c in "([（":
        return "("
    if c in "\"“„«»「『《¿¡•*#@<$€£'‘’":
        return "Q"
    if c in "-–—":
        return "-"
    return "l"


def _last_word(text: str, end: int) -> re.Match | None:
    """The word before ``end``, if one ends there, as far as the surroundings go."""
    lo = max(0, end - HALO)
    return LAST_WORD.search(text, max(lo, text.rfind(" ", lo, end)), end)


def _is_lettered(text: str, letter: int, after: int) -> bool:
    """Whether the capital at ``letter`` belongs to the word before it, as in hepatitis B, and is no initial."""
    if letter < 2 or not text[letter - 1].isspace():
        return False
    before = _last_word(text, letter - 1)
    if not before or not before[0][0].isalpha():
        return False
    w = before[0]
    follows = NEXT_WORD.match(text, after)
    return w.casefold() in LETTERED or w.islower() and len(w) > 3 and bool(follows) and follows[0] in STARTERS


def _ends(text: str, start: int, end: int) -> int:
    """The offset after the marks that end a sentence in ``text[start:end]``, or -1 if it goes on."""
    run = text[start:end]
    while end < len(text) and text[end] in "’'" and (end + 1 == len(text) or not text[end + 1].isalnum()):
        end += 1
    if end == len(text):
        return end
    c = text[end]
    if c in ")]”」』》）":
        return -1  # what closes decides
    glued = not c.isspace()
    last = run[-1]
    if run != "." and any(x in "。！？｡।॥۔" for x in run):
        return end
    before = text[start - 1] if start else " "
    m = None if glued else NON_SPACE.search(text, end)
    if not glued and m is None:
        return end
    at = end if glued else m.start()
    kind = _next_kind(text, at)
    broken = not glued and "\n" in text[end:at]
    if glued:
        if kind == "Q" or c in "(（":
            return end if c in "\"“„«»「『《¿¡" and not (run == "." and c == '"' and before.isspace()) else -1
        if last in "!?؟":
            if _is_cjk(before) and kind in "UDOl" and c not in ",，、":
                return end if kind != "l" or c.isalnum() else -1
            return end if kind == "O" or (kind == "U" and GLUED_START.match(text, at)) else -1
        if last == "…":
            return end if kind == "U" and GLUED_START.match(text, at) else -1
        if kind == "O":
            same = "ऀ" <= c <= "ॿ" and "ऀ" <= before <= "ॿ" or "฀" <= c <= "๿" and "฀" <= before <= "๿"
            return -1 if same or c == "º" or c == "ª" else end
        if kind == "D" and before.isalpha():
            return end if re.match(r"\d+\s?(?:年|月|日|回|में)", text[at : at + 12]) else -1
        word = _last_word(text, start)
        w = word[0] if word else ""
        if kind != "U" or not (GLUED_START.match(text, at) or len(w) > 2 and w.islower() and re.match(r"[A-Z]\.\s[A-Z]", text[at : at + 4])):
            return -1
        if not w or len(w) == 1 and word.start() and text[word.start() - 1] in "/·":
            return end
        if len(w) < 2 or w in NEVER or "." in w and not re.fullmatch(r"(?:[A-Za-z]\.)+[A-Za-z]|[\w.-]+\.[a-z]{2,10}", w):
            return -1
        if "." in w and re.fullmatch(r"(?:[A-Za-z]\.)+[A-Za-z]", w) and not re.match(r"[A-Z][a-z]+[ ,]", text[at : at + 20]):
            return -1
        return end
    if kind == "-":
        return end if broken else -1
    if kind == "l":
        return -1
    if last in "!?؟":
        return end
    if len(run) > 1 or last == "…":
        return end
    word = _last_word(text, start)
    w = word[0].lstrip("'’-") if word else ""
    if not w:
        return end
    if "'" in w or "’" in w:
        w = re.split(r"['’]", w)[-1]
    parts = w.split(".")
    if len(parts) > 1 and len(parts[-2]) > 2:  # glued to the sentence before
        w = parts[-1]
    if w in NEVER or w in WORDS_TOO and kind in "D(":
        return -1
    if w == "al" and text[max(0, word.start() - 3) : word.start()].lower() in ("et ", "et\n", "et\xa0"):
        return -1
    if w[-1].isdigit():
        return -1 if w.isdigit() and len(w) < 3 and AFTER_ORDINAL.match(text, end) else end
    if w in AFTER_NUMBER:
        return end if re.search(r"\d[\s–-]?\Z", text[max(0, word.start() - 2) : word.start()]) and kind != "D" else -1
    if len(w) == 1 and (w.isupper() or w.isalpha() and w.isascii()):
        if word.start() and text[word.start() - 1] in "/·":  # the end of a unit such as mg/l
            return end
        return end if w.isupper() and _is_lettered(text, word.start(), at) else -1
    if w in NUMBERED and kind == "D":
        return -1
    return end


_CLOSING = frozenset(" \xa0 )]”“»«\"'’」』》）")


def _closing(text: str, at: int, last: list[int]) -> int:
    """What the closing mark at ``at`` does to a unit, by the marks before it and what follows.

    ``last`` has the mark before and the place of the last other character before that one, so a run of marks is
    passed once. Chunks begin inside a word, so no run goes back beyond one.
    """
    i = at - 1
    while i >= 0 and text[i] in _CLOSING:
        i = last[1] if i == last[0] else i - 1
    last[:] = at, i
    if i < 0 or text[i] not in _ENDS:
        return NO
    nxt = NON_SPACE.search(text, at + 1)
    if nxt is None:
        return ALWAYS
    j = nxt.start()
    c, mark = text[j], text[at]
    if j == at + 1 and (c in _ENDS or c in ")]”」』》）’"):
        return NO
    kind = _next_kind(text, j)
    if kind == "-":
        kind = "Q" if "\n" in text[at + 1 : j] else "l"
    if kind == "l":
        return NO
    if mark in ")]）":
        return NO if kind == "O" and j == at + 1 else AT_START
    if "ぁ" <= c <= "ん" and j == at + 1:
        return NO
    if kind == "O":
        return INSIDE
    if kind in "UD" and _is_cjk(text[i]) and j == at + 1:
        return INSIDE
    return ALWAYS


def symbols(text: str, lo: int, hi: int, first: bool) -> Iterator[tuple[int, int]]:
    """``(symbol, offset at which a unit would end)`` of ``text[lo:hi]``, in order; looks beyond both ends."""

    def line_start(at: int) -> bool:
        return bool(LIST_ITEM.match(text, at) or HEADING.match(text, at))

    at, pos, last = lo, lo, [-1, -1]
    search = (EVENT_THAI if THAI_CHAR.search(text, lo, hi) else EVENT).search
    if first and line_start(lo):
        yield LINE, 0
    while m := search(text, pos, hi):
        a, b = m.span()
        c = text[a]
        if c == "." and a and text[a - 1].isdecimal() and text[a + 1 : a + 2].isdecimal():  # inside a number
            pos = b
            continue
        if c == "\n":
            while a > at and text[a - 1].isspace():
                a -= 1
            after = NON_SPACE.search(text, b, hi)
            b = after.start() if after else hi
        if a > at and (not text[at].isspace() or NON_SPACE.search(text, at, a)):
            yield TEXT, 0
        if c in _ENDS:
            b = END_RUN.match(text, a, hi).end()
            e = _ends(text, a, b)
            if e < 0:
                yield TEXT, 0
            else:
                yield END, e
                b = max(b, e)
        elif c in _MARKS:
            yield 6 + 4 * _MARKS.index(c) + _closing(text, a, last), b
        elif c != "\n":
            yield THAI, a
        else:
            if text.count("\n", a, b) > 1:
                yield BLANK, a
            else:
                if a and THAI_CHAR.match(text[a - 1]) and text[a - 1] != "ๆ" and b < len(text) and not re.match(r"[\dA-Za-zÀ-ɏๆ]", text[b]):
                    yield THAI, a
                yield BREAK, a
            line = text.rfind("\n", a, b) + 1
            if line_start(line):
                yield LINE, 0
        at = pos = b
    if at < hi and NON_SPACE.search(text, at, hi):
        yield TEXT, 0


def scanned(text: str, lo: int, hi: int, first: bool) -> list[int]:
    """Symbols of ``text[lo:hi]`` as a flat list: symbol, offset of the end, offset of the next character that is not
    white space within the chunk or -1. Offsets count from ``lo``; symbols that can end nothing have none."""
    out: list[int] = []
    before = -1
    for symbol, end in symbols(text, lo, hi, first):
        if _MAY_END[symbol]:
            m = NON_SPACE.search(text, end, hi)
            out += (symbol, end - lo, m.start() - lo if m else -1)
        elif symbol != TEXT or before != TEXT:
            out += (symbol, 0, -1)
        before = symbol
    return out


#: In place of the start of an open unit: it began before the chunk, or begins in a later one.
INHERITED, LATER = -2, -1


@dataclass
class Function:
    """What a chunk does: state before it to state after it, and where the unit open then began.

    The arrays have the states of no bracket, then those of each depth up to the last two, from which on all deeper
    ones do the same, counted from their own depth.
    """

    state: np.ndarray
    start: np.ndarray

    def __call__(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.state)
        last = n - N_NESTED + (states - N_FLAT) % N_NESTED
        at = np.where(states < n, states, last)
        deeper = (self.state[last] - self.state[last - N_NESTED]) // N_NESTED
        return self.state[at] + (states - at) * deeper, self.start[at]

    def at(self, state: int) -> tuple[int, int]:
        """The same of one state."""
        n = len(self.state)
        if state < n:
            return int(self.state[state]), int(self.start[state])
        to, start = self(np.array([state]))
        return int(to[0]), int(start[0])

    @property
    def depth(self) -> int:
        """Number of depths in the arrays."""
        return (len(self.state) - N_FLAT) // N_NESTED

    def then(self, other: Function) -> Function:
        """This function, then ``other``."""
        last = np.arange(len(self.state) - N_NESTED, len(self.state))
        goes_on = self.state[last] != self.state[last - N_NESTED]  # still in the bracket it began in
        gained = (self.state[last] - last)[goes_on] // N_NESTED
        depth = max(self.depth, other.depth - int(gained.min()) if goes_on.any() else 0)
        state, start = self(np.arange(N_FLAT + N_NESTED * depth))
        after, began = other(state)
        return Function(after, np.where(began == INHERITED, start, began))


def function_of(found: list[int], first: int, base: int = 0) -> Function:
    """The function of a chunk of the given symbols; ``first`` is its first character that is not white space or -1."""
    net, least = [0] * len(_NESTED), [0] * len(_NESTED)
    for symbol in found[::3]:
        if move := _DEPTH_OF[symbol]:
            kind, by = move
            net[kind] += by
            least[kind] = min(least[kind], net[kind])
    n = N_FLAT + N_NESTED * (2 - min(least))
    # current states, each with groups of the states that came there: their open start, and they themselves
    groups: dict[int, list[tuple[int, list[int]]]] = {s: [(INHERITED, [s])] for s in range(n)}
    groups[0] = [(first + base if first >= 0 else LATER, [0])]
    for symbol, nxt in zip(found[::3], found[2::3], strict=True):
        moves = _MOVES[symbol]
        if symbol == BLANK or _DEPTH_OF[symbol]:
            moves = moves + [(s, *step(symbol, s)) for s in groups if s >= N_STATES]
        moved = [(to, emits, groups.pop(s)) for s, to, emits in moves if s in groups]
        for to, emits, came in moved:
            if emits:
                came = [(nxt + base if nxt >= 0 else LATER, [s for _, some in came for s in some])]
            groups[to] = groups[to] + came if to in groups else came
    state, start = np.empty(n, np.int64), np.empty(n, np.int64)
    for to, came in groups.items():
        for began, some in came:
            state[some], start[some] = to, began
    return Function(state, start)


#: Symbols of brackets: their kind, and by how much they change the depth.
_DEPTH_OF = [None] * 6 + [next(((n, 1 - 2 * i) for n, k in enumerate(_NESTED) for i in (0, 1) if _KINDS[k][i] == m), None) for m in _MARKS for _ in range(4)]


def scan(functions: list[Function]) -> tuple[list[int], list[int]]:
    """State and open start before every chunk but the first, whose state is that of no unit.

    A parallel prefix scan: pairs are composed level by level up a tree, then every right half gets its state from the
    left one on the way down.
    """
    levels = [functions]
    while len(levels[-1]) > 1:
        f = levels[-1]
        levels.append([f[i].then(f[i + 1]) if i + 1 < len(f) else f[i] for i in range(0, len(f), 2)])
    before = [(0, LATER)]
    for f in reversed(levels[:-1]):
        down = []
        for i, (state, start) in enumerate(before):
            down.append((state, start))
            if 2 * i + 1 < len(f):
                to, began = f[2 * i].at(state)
                down.append((to, start if began == INHERITED else began))
        before = down
    return [s for s, _ in before], [b for _, b in before]


def replayed(found: list[int], first: int, state: int, start: int, base: int) -> tuple[list[int], list[int], int, int]:
    """Starts and ends of the units that end in a chunk, the state after it and the start of the unit open then."""
    starts, ends = [], []
    if start == LATER and state == 0:
        start = first + base if first >= 0 else LATER
    for symbol, end, nxt in zip(found[::3], found[1::3], found[2::3], strict=True):
        if state < N_STATES:
            emits, state = _EMIT[symbol][state], _STEP[symbol][state]
        else:
            state, emits = step(symbol, state)
        if emits:
            starts.append(start)
            ends.append(end + base)
            start = nxt + base if nxt >= 0 else LATER
    return starts, ends, state, start


def units(text: str | None) -> tuple[list[int], list[int]]:
    """Starts and ends of the units of a whole text."""
    if not text:
        return [], []
    m = NON_SPACE.search(text)
    starts, ends, state, start = replayed(scanned(text, 0, len(text), True), m.start() if m else -1, 0, LATER, 0)
    if state:
        starts.append(start)
        ends.append(len(text.rstrip()))
    return starts, ends


#: Characters beside which a text is never cut: white space, ends, marks and what may follow them.
_UNCUT = r"\s\p{Z}\x{1c}-\x{1f}" + _ENDS + re.escape(_MARKS) + "’'‘"
_CUT = f"(?<=[^{_UNCUT}])(?=[^{_UNCUT}])"


def cut_text(text: Column, size: int) -> Column:
    """``text`` as an array of chunks of ``size`` characters and on to the next place where it may be cut."""
    parts = F.regexp_extract_all(text, F.lit(rf"(?sU).{{{size}}}.*?{_CUT}|.+"), F.lit(0))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(parts)


def chunk_rows(docs: DataFrame, size: int = CHUNK, halo: int = HALO) -> DataFrame:
    """Rows ``(doc_id, k, lo, hi, part, last)``: chunk ``k`` of a text is ``part[lo:hi]``, ``last`` says that it ends the text.

    A halo ends where a text may be cut too, so a run of spaces or marks is seen whole.
    """
    p = F.col("p")
    ahead = lambda x: F.regexp_extract(x, rf"(?sU)\A(?:.{{{halo}}}.*?{_CUT}|.*)", 0)
    rows = docs.select("doc_id", cut_text(F.col("text"), size).alias("p")).select("doc_id", "p", F.posexplode("p").alias("k", "core"))
    left = F.when(F.col("k") > 0, F.substring(F.get(p, F.col("k") - 1), -halo, halo)).otherwise("")
    right = F.when(F.col("k") + 1 < F.size(p), ahead(F.get(p, F.col("k") + 1))).otherwise("")
    rows = rows.select("doc_id", "k", F.length(left).alias("lo"), F.length("core").alias("n"), F.concat(left, "core", right).alias("part"), (F.col("k") + 1 == F.size(p)).alias("last"))
    return rows.select("doc_id", "k", "lo", (F.col("lo") + F.col("n")).alias("hi"), "part", "last")


_PACKED = np.dtype("<i8")


def pack(values: list[int] | np.ndarray) -> bytes:
    return np.asarray(values, "<i4").tobytes()


def unpack(data: bytes) -> list[int]:
    return np.frombuffer(data, "<i4").tolist()


#: Columns of a scanned chunk: characters, bytes, first and after the last character that is not white space, symbols,
#: its function (none where a text is one chunk).
SCANNED = "doc_id string, k int, last boolean, n int, bytes int, first int, until int, found binary, f binary"


def scan_chunk(text: str, lo: int, hi: int, k: int, last: bool) -> tuple[list[int], tuple]:
    """Symbols of a chunk, and the values of ``SCANNED`` from ``n`` on."""
    found = scanned(text, lo, hi, k == 0)
    core = text[lo:hi]
    until = len(core.rstrip())
    first = until - len(core[:until].lstrip()) if until else -1
    f = b""
    if k or not last:
        made = function_of(found, first)
        f = np.concatenate([made.state, made.start]).astype(_PACKED).tobytes()
    return found, (hi - lo, len(core.encode()), first, until, pack(found), f)


def with_states(rows: DataFrame) -> DataFrame:
    """Scanned chunks with ``base``, ``byte_base``, ``state`` and ``start`` before each. Of a text only its functions
    come together, some hundred bytes a chunk, and not the first chunk's row, whose state is known."""

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, chunks in zip(b["doc_id"], b["chunks"], strict=True):
                base = byte_base = 0
                functions, bases = [], []
                for x in chunks:
                    state, start = np.frombuffer(x["f"], _PACKED).reshape(2, -1)
                    functions.append(Function(state, np.where(start >= 0, start + base, start)))
                    bases.append((base, byte_base))
                    base, byte_base = base + x["n"], byte_base + x["bytes"]
                out += [(doc_id, k, *at, *s) for k, (at, s) in enumerate(zip(bases, zip(*scan(functions), strict=True), strict=True)) if k]
            yield pd.DataFrame(out, columns=["doc_id", "k", "base", "byte_base", "state", "start"])

    known = "base bigint, byte_base bigint, state bigint, start bigint"
    longer = rows.where("k > 0 or not last").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "n", "bytes", "f"))).alias("chunks"))
    later = rows.where("k > 0").join(longer.mapInPandas(states, f"doc_id string, k int, {known}"), ["doc_id", "k"])
    none = {"base": 0, "byte_base": 0, "state": 0, "start": LATER}
    return rows.where("k = 0").withColumns({c: F.lit(v).cast("long") for c, v in none.items()}).unionByName(later)


def sentence_units(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """``(doc_id, sent_start, sent_end)`` of documents ``(doc_id, text)`` with unique ids."""
    docs = docs.where(F.col("doc_id").isNotNull() & (F.length("text") > 0))

    def first_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(d, k, last, *scan_chunk(p, lo, hi, k, last)[1]) for d, k, lo, hi, p, last in zip(*[b[c] for c in ("doc_id", "k", "lo", "hi", "part", "last")], strict=True)]
            yield pd.DataFrame(out, columns=["doc_id", "k", "last", "n", "bytes", "first", "until", "found", "f"])

    def second_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, starts, ends = [], [], []
            for r in b.itertuples(index=False):
                s, e, state, start = replayed(unpack(r.found), r.first, r.state, r.start, r.base)
                if r.last and state:
                    s.append(start)
                    e.append(r.base + r.until)
                ids += [r.doc_id] * len(s)
                starts += s
                ends += e
            yield pd.DataFrame({"doc_id": ids, "sent_start": np.array(starts, np.int32), "sent_end": np.array(ends, np.int32)})

    # written once, as the functions and the symbols are read apart
    rows = stored(chunk_rows(docs, size).mapInPandas(first_pass, SCANNED), "chunks")
    return with_states(rows).select("doc_id", "last", "first", "until", "found", "base", "state", "start").mapInPandas(second_pass, "doc_id string, sent_start int, sent_end int")
