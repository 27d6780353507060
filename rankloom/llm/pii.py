"""Problem 5: personal information inside free text.

Items are found by form where the form suffices (addresses with an at sign,
phone groupings, street forms) and by form and cue where it does not (document
numbers, names). They are replaced by typed placeholders. Validated numbers and
dates are permuted within their own format by a keyed Feistel network, so the
placeholder of a phone is a phone of the same layout, different values never
meet, and one value has one pseudonym in all documents, in whatever layout it
is written; names and e-mail addresses get a keyed tag instead.

Everything is a narrow, per-row stage: nothing is shuffled, and a worker
remembers the texts of a batch it has seen.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import unicodedata
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")

_EMAIL = re.compile(
    r"[\w.+'-]+ ?@ ?[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}"
    r"|[\w.+'-]+ ?[\[({] ?at ?[\])}] ?[\w-]+(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[\w-]+)+"
    r"|[\w.+'-]+ at [\w-]+(?: dot [\w-]+)+",
    re.I,
)
_LINK = re.compile(r"(?:https?://|www\.)\S+", re.I)
_CUE = r"(?:tel|telephone|phone|mobile|mob|cell|call|whatsapp|fax|telefon|handy|tél|móvil|teléfono|line|via)"
_PHONE = re.compile(
    r"(?<![\w/.,+-])(?<!\d )(?:"
    r"\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{2,6}(?:[ .-]\d{2,6}){0,4}"  # +91 55555 30235, +1 (525) 555-0131
    r"|\(\d{2,5}\)[ .-]?\d{3,4}[ .-]\d{3,4}"
    r"|0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}"  # 0559-239-9804
    r"|\d{3}\.\d{3}\.\d{4}"
    r"|(?:\d\d ){4,6}\d{1,2}"  # 05 59 83 18 29 9
    r"|\d{4,8} ?/ ?\d{5,7}"  # 5225 / 550120
    r"|\d{10,13}"
    r")(?: ?(?:ext|extn|x)\.? ?\d{1,5})?(?![\w/]|[.,-]\d)"
)
_PHONE_AFTER_CUE = re.compile(rf"\b{_CUE}\.?(?: (?:no|number|nr)\.?)?[ :–-]{{1,3}}(\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}|\d{{5}}[ .-]\d{{5}}|\d{{4}}[ .-]\d{{3}}[ .-]\d{{3}}|\d{{4}}[ .-]\d{{6}})(?![\w-])", re.I)
_ID = re.compile(
    r"\b(?:passport(?: (?:no|number|nr))?|(?:national|citizen|identity|voter|personal|tax|tax payer|student) (?:id|card|number|no|code|identity(?: card| number)?)(?: (?:no|number))?"
    r"|id card|personalausweis(?:nummer)?|reisepass|steuer-?id|ausweis|ssn|social security(?: (?:no|number))?|driv(?:ing|er'?s?) licen[cs]e(?: (?:no|number))?|führerschein|aadhaar|aadhar|pan(?: card)?|dni|nie|nif|curp|nin|permis de conduire|numéro fiscal|pasaporte|passeport)"
    r"\.?(?: ?[:#–-] ?| )((?-i:(?:[A-Z]{1,5}[ -]?)?\d(?:[ -]?\d){3,18}(?: ?[A-Z])?))(?!\w)",
    re.I,
)
_BARE_ID = re.compile(r"(?<![\w-])(?:[A-Z]{5}\d{4}[A-Z]|\d{3}-\d{2}-\d{4}|QX(?: ?\d\d){3} ?[A-D])(?![\w-])")
_CAP = r"[^\W\d_a-zà-öø-ÿ][\w'’-]*"
_ADDRESS = re.compile(
    r"\bP\.? ?O\.? ?Box \d+|\b(?:Post(?:al)? ?Box|Postfach|Apartado(?: de Correos)?|Boîte postale|BP) \d+"
    r"|\bPlot (?:no\.? )?\d+\w?|\bFlat \d+\w?, \d+"
    rf"|\b\d{{1,4}}[A-Z]?,? (?:{_CAP} ){{1,3}}(?:Road|Street|Lane|Avenue|Row|Terrace|Close|Path|Drive|Way|Court|Square|Place|Gardens?|Crescent|Hill|Grove|Mews|Walk|Rd|St|Ave|Ln|Dr)\b"
    r"|\b\d{1,4}(?: ?(?:bis|ter))?,? (?:rue|avenue|impasse|chemin|place|allée|boulevard|quai|route|cours|passage|sentier|ruelle|square)\b"
    r"|\b(?:Calle|Avenida|Avda\.?|Plaza|Camino|Paseo|Ronda|Carrera|Travesía|Glorieta|C/)(?: (?:del?|las?|los|el))* [^\W\d_][^\d,;|]{0,40}?,? (?:n[.º°]? ?)?\d+"
    r"|\b[A-ZÄÖÜ][\wäöüß-]*(?:weg|straße|strasse|str\.|gasse|platz|allee|ufer|damm|steig) \d+\w?\b|\b[A-ZÄÖÜ][\wäöüß-]*(?:ring|hof) \d+\w?, \d{4,6}\b"
    rf"|\b(?:Am|An der|An den|Zum|Zur|Im|In der|Auf dem|Auf der|Unter den|Hinter der|Beim) (?:{_CAP} ?){{1,3}}\d+\w?, \d{{4,6}}",
)
_ADDRESS_LINE = re.compile(r"(?:^|(?<=\n))[ \t]*(?:address|residence|home|postal address|anschrift|adresse|dirección|lives at) ?[:–-] ?(?=[^\n]*\d)([^\n]+)", re.I)
# a name: an optional title, then words of letters with inner apostrophes or hyphens, initials, or "Last, First"
_W = r"(?!(?:at|and|during|for|on|in|who|the|of|by)\b)[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))+"
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?"
_NAME = rf"(?:(?:{_TITLE} )?(?:[^\W\d_]\. ?)?{_W}(?:(?:,? {_W})|(?: [^\W\d_]\.)){{0,3}})"
_TITLED = re.compile(rf"\b{_TITLE} {_CAP}(?: [^\W\d_]\.)?(?: {_CAP})?")
_TWO = rf"(?:{_TITLE} )?(?:{_W}(?: [^\W\d_]\.)?(?: {_W}){{1,2}}|{_W}, {_W}(?: [^\W\d_]\.)?|[^\W\d_]\. ?(?:[^\W\d_]\. ?)?{_W}|{_TITLE} {_W})"
_CUED = re.compile(
    rf"(?:\b[Mm]entored by|\b[Rr]eported to|\b(?:[Ss]upervised|[Mm]anaged|[Vv]erified|[Rr]eferred|[Cc]oached|[Ss]igned|[Ii]nterviewed|[Rr]eviewed|[Cc]ertified|[Rr]ecommended) by|\b[Tt]ogether with|\b[Rr]each|\b[Rr]eferences?:|\b[Rr]eferees?:|\bc/o|\b(?:[Cc]ontact|[Aa]ttn|[Mm]entor|[Mm]anager|[Ss]upervisor) ?:|\b[Ww]orked (?:with|under))"
    rf" ?({_TWO})(?=[;:.(|]| \(| <|,|$|\n| during\b| and\b| at\b| for\b| on\b| in\b| who\b| -| –)",
    re.M,
)
_BADGE = re.compile(rf"/ ({_TWO})[ \t]*(?=$|\n| - |;|\.)", re.M)
_LABELLED = re.compile(rf"(?:^|(?<=\n))[ \t]*(?:(?:full |candidate |applicant )?name|candidate|applicant|curriculum vitae of|resume of|cv of|vita of|nom|nombre)(?: ?[:–-] ?| )({_NAME})[ \t]*(?=\n|$)", re.I)
_SHAPE = re.compile(rf"({_TWO})[ \t]*$")
_REFERENCES = re.compile(r"^[ \t]*(?:professional )?refere(?:nce|e)s?(?: contacts?)?[ \t]*:?[ \t]*$", re.I)
_REFEREE = re.compile(rf"^({_TWO})(?=,|[ \t]*$|[ \t]*[|–;(]| - )")
# Words that make a line a heading or a role, never a person.
NOT_NAMES = frozenset(
    "resume cv curriculum vitae profile summary objective career education experience work employment history skills technical core tools technologies projects selected academic "
    "background activities achievements certifications languages interests references referees internships internship contact details personal other the of and for with at in on engineer "
    "developer analyst designer tester manager intern lead associate editor technician scientist specialist administrator consultant student applicant candidate unknown name test user "
    "university college institute school polytechnic ltd inc llc gmbh studios systems software analytics logistics labs media retail robotics health sons team dashboard".split()
)
_BIRTH = re.compile(r"\b(?:date of birth|dob|born(?: on)?|birth ?date|geburtsdatum)(?: ?[:–-] ?| )(\d{1,4}[-/. ]\d{1,2}[-/. ]\d{1,4}|\d{1,2}(?:st|nd|rd|th|\.)? [^\W\d_]{3,9}\.?,? \d{2,4}|[^\W\d_]{3,9}\.? \d{1,2}(?:st|nd|rd|th)?,? \d{4})\b", re.I)


def _person(text: str) -> bool:
    words = re.findall(r"[^\W\d_]+", text.lower())
    return bool(words) and not any(w in NOT_NAMES for w in words)


def _clear(spans: list[tuple[int, int, str]], start: int, end: int) -> bool:
    """Whether nothing of ``spans``, which are in order and don't overlap, touches this stretch."""
    at = bisect_left(spans, (start,))
    return (at == len(spans) or spans[at][0] >= end) and (at == 0 or spans[at - 1][1] <= start)


# What can begin an item, by the kind of search it calls for; only lines that hold one are searched.
_TRIGGERS = {
    "E": ("@", "[at", "(at", "{at", "[ at", "( at", " dot "),
    "I": ("passport", "personalausweis", "reisepass", "steuer", "ausweis", "ssn", "social security", "licence", "license", "führerschein", "aadhaar", "aadhar", "pan", "dni", "nie", "nif", "curp",
          "nin", "permis de", "numéro fiscal", "pasaporte", "passeport", "national", "citizen", "identity", "voter", "personal", "tax", "student", "id card"),
    "A": ("box ", "postfach ", "apartado ", "boîte ", "bp ", "plot ", "flat ", " road", " street", " lane", " avenue", " row", " terrace", " close", " path", " drive", " way", " court", " square", " place", " garden",
          " crescent", " hill", " grove", " mews", " walk", " rd", " st", " ave", " ln", " dr", "rue ", "avenue ", "impasse ", "chemin ", "place ", "allée ", "boulevard ", "quai ", "route ", "cours ", "passage ", "sentier ",
          "ruelle ", "square ", "calle ", "avenida ", "avda", "plaza ", "camino ", "paseo ", "ronda ", "carrera ", "travesía ", "glorieta ", "c/ ", "weg ", "straße ", "strasse ", "str. ", "gasse ", "platz ", "allee ",
          "ufer ", "ring ", "damm ", "steig ", "hof ", "am ", "an der ", "an den ", "zum ", "zur ", "im ", "in der ", "auf de", "unter den ", "hinter der ", "beim ", "address", "residence", "home", "anschrift", "adresse", "dirección", "lives at"),
    "N": ("mentored by", "reported to", "supervised by", "managed by", "verified by", "referred by", "coached by", "signed by", "interviewed by", "reviewed by", "certified by", "recommended by", "together with", "reach",
          "reference", "referee", "c/o", "contact:", "contact :", "attn", "mentor:", "mentor :", "manager:", "manager :", "supervisor:", "supervisor :", "worked with", "worked under"),
    "T": tuple(t + e for t in ("mr", "ms", "mrs", "miss", "dr", "prof", "herr", "frau", "mme", "sr", "sra") for e in (" ", ". ")),
    "L": ("name", "candidate", "applicant", "curriculum vitae of", "resume of", "cv of", "vita of", "nom"),
    "R": ("refere", "r e f e r"),
    "B": ("birth", "dob", "born", "geburtsdatum"),
}
_DIGIT = re.compile(r"\d")
_LONG_DIGITS = re.compile(r"\d[\d ()./+-]{7,}\d")


def _automaton() -> ahocorasick.Automaton:
    words: dict[str, str] = {}
    for kind, triggers in _TRIGGERS.items():
        for t in triggers:
            words[t] = words.get(t, "") + kind
    out = ahocorasick.Automaton()
    for word, kinds in words.items():
        out.add_word(word, kinds)
    out.make_automaton()
    return out


_WATCH = _automaton()


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def find_pii(text: str, gated: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every item, in order, without overlaps.

    One pass of an automaton finds what can begin an item; the patterns then
    run on the lines concerned alone (on all lines if not ``gated``, with the
    same result). A full name found anywhere is found wherever else the text
    has it.
    """
    low = "\n" + _lower(text)
    starts = [0, *(m.start() + 1 for m in re.finditer("\n", text))]
    calls: dict[int, str] = {}
    for at, kinds in _WATCH.iter(low):
        line = bisect_right(starts, max(at - 1, 0)) - 1
        calls[line] = calls.get(line, "") + kinds
    for pattern, kind in ((_LONG_DIGITS, "D"), (_BARE_ID, "K")):
        for m in pattern.finditer(text):
            line = bisect_right(starts, m.start()) - 1
            calls[line] = calls.get(line, "") + kind
    if not gated:
        every = "".join(_TRIGGERS) + "DK"
        calls = {i: every for i in range(len(starts))}
    spans: list[tuple[int, int, str]] = []
    refs = None
    for line in sorted(calls):
        begin = starts[line]
        end = starts[line + 1] - 1 if line + 1 < len(starts) else len(text)
        if "R" in calls[line]:
            refs = line if refs is None else refs
        spans += [(begin + s, begin + e, k) for s, e, k in _line_items(text[begin:end], calls[line])]
    if len(starts) > 1:
        for begin, m in _name_lines(text, starts, refs):
            s, e = begin + m.start(1), begin + m.end(1)
            if _clear(spans, s, e):
                insort(spans, (s, e, "NAME"))
    _repeats(text, spans)
    return spans


def _repeats(text: str, spans: list[tuple[int, int, str]]) -> None:
    """Adds further places of the full names among ``spans``, as they are spelled there or the other way round."""
    for name in {text[s:e] for s, e, kind in spans if kind == "NAME"}:
        words = re.findall(r"[^\W\d_](?:[^\W\d_]|['’-])+", re.sub(rf"^{_TITLE} ", "", name))
        if len(words) < 2:
            continue
        for form in {" ".join(words), f"{words[-1]}, {' '.join(words[:-1])}", f"{' '.join(words[1:])} {words[0]}"}:
            at = text.find(form)
            while at >= 0:
                end = at + len(form)
                if not (text[at - 1 : at] + text[end : end + 1]).strip(" \t\n,.;:()|/–") and _clear(spans, at, end):
                    insort(spans, (at, end, "NAME"))
                at = text.find(form, end)


def _line_items(line: str, kinds: str) -> list[tuple[int, int, str]]:
    spans: list[tuple[int, int, str]] = []
    shut: list[tuple[int, int, str]] = []  # links: nothing inside them is an item

    def add(start: int, end: int, kind: str) -> None:
        if _clear(spans, start, end) and _clear(shut, start, end):
            insort(spans, (start, end, kind))

    if "E" in kinds:
        for m in _EMAIL.finditer(line):
            add(m.start(), m.end(), "EMAIL")
    if "://" in line or "www." in line:
        shut += [(m.start(), m.end(), "LINK") for m in _LINK.finditer(line) if _clear(spans, m.start(), m.end())]
    if "I" in kinds:
        for m in _ID.finditer(line):
            add(m.start(1), m.end(1), "ID_NUMBER")
    if "K" in kinds:
        for m in _BARE_ID.finditer(line):
            add(m.start(), m.end(), "ID_NUMBER")
    if "D" in kinds:
        for m in _PHONE.finditer(line):
            if 10 <= sum(c.isdigit() for c in re.sub(r"(?i) ?(?:ext|extn|x)\.? ?\d{1,5}$", "", m[0])) <= 15:
                add(m.start(), m.end(), "PHONE")
        for m in _PHONE_AFTER_CUE.finditer(line):
            add(m.start(1), m.end(1), "PHONE")
    if "B" in kinds:
        for m in _BIRTH.finditer(line):
            add(m.start(1), m.end(1), "DATE_OF_BIRTH")
    if "A" in kinds and _DIGIT.search(line):
        m = _ADDRESS_LINE.search(line)
        if m and not any(s < m.end(1) and e > m.start(1) for s, e, _ in spans):
            add(m.start(1), m.end(1), "ADDRESS")
        for m in _ADDRESS.finditer(line):
            add(m.start(), m.end(), "ADDRESS")
    if "N" in kinds:
        for m in _CUED.finditer(line):
            if _person(m[1]):
                add(m.start(1), m.end(1), "NAME")
    if " / " in line and any(k == "ID_NUMBER" for _, _, k in spans):
        for m in _BADGE.finditer(line):
            if _person(m[1]) and any(k == "ID_NUMBER" and e <= m.start() for _, e, k in spans):
                add(m.start(1), m.end(1), "NAME")
    if "T" in kinds:
        for m in _TITLED.finditer(line):
            add(m.start(), m.end(), "NAME")
    if "L" in kinds:
        m = _LABELLED.search(line)
        if m and _person(m[1]):
            add(m.start(1), m.end(1), "NAME")
    return spans


def _name_lines(text: str, starts: list[int], refs: int | None) -> Iterator[tuple[int, re.Match]]:
    """Lines that are a name by their place: the first of a text, and those below a heading for references."""
    stop = lambda i: starts[i + 1] - 1 if i + 1 < len(starts) else len(text)
    for i in range(len(starts)):
        line = text[starts[i] : stop(i)]
        if line.strip():
            m = _SHAPE.match(line.strip())
            if m and _person(m[1]) and not _DIGIT.search(line):
                yield starts[i] + line.index(line.strip()), m
            break
    if refs is None:
        return
    inside = False
    for i in range(refs, len(starts)):
        line = text[starts[i] : stop(i)]
        bare = line.strip()
        if not bare:
            continue
        tight = bare.replace(" ", "") if re.fullmatch(r"(?:\S )+\S:?", bare) else bare
        if _REFERENCES.match(tight):
            inside = True
        elif inside and line[0] not in " \t":  # indented lines hold a referee's contacts
            m = _REFEREE.match(line)
            if m and _person(m[1]):
                yield starts[i], m
            else:
                inside = False


class Feistel:
    """A keyed permutation of the strings of n symbols of one alphabet (alternating Feistel rounds)."""

    def __init__(self, key: bytes, rounds: int = 8):
        self.key, self.rounds = key, rounds

    def _round(self, tweak: str, i: int, half: int, size: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}|{i}|{half}".encode(), key=self.key, digest_size=16).digest(), "big") % size

    def permute(self, value: int, left: int, right: int, tweak: str) -> int:
        """Permutes 0 .. left * right - 1."""
        a, b = divmod(value, right)
        for i in range(self.rounds):
            if i % 2:
                a = (a + self._round(tweak, i, b, left)) % left
            else:
                b = (b + self._round(tweak, i, a, right)) % right
        return a * right + b

    def invert(self, value: int, left: int, right: int, tweak: str) -> int:
        a, b = divmod(value, right)
        for i in reversed(range(self.rounds)):
            if i % 2:
                a = (a - self._round(tweak, i, b, left)) % left
            else:
                b = (b - self._round(tweak, i, a, right)) % right
        return a * right + b

    def text(self, symbols: str, alphabet: str, tweak: str, back: bool = False) -> str:
        n, radix = len(symbols), len(alphabet)
        value = 0
        for c in symbols:
            value = value * radix + alphabet.index(c)
        left, right = radix ** (n // 2), radix ** (n - n // 2)
        value = (self.invert if back else self.permute)(value, left, right, f"{tweak}|{n}|{radix}")
        out = []
        for _ in range(n):
            value, c = divmod(value, radix)
            out.append(alphabet[c])
        return "".join(reversed(out))


DIGITS, LETTERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The days that dates of four-digit and of two-digit years are permuted within.
FOUR_DIGITS, TWO_DIGITS = (datetime.date(1900, 1, 1), 73_049), (datetime.date(1930, 1, 1), 36_525)


def _digits(value: str) -> str:
    """The decimal digits of any script, as ASCII."""
    return "".join(str(unicodedata.decimal(c)) for c in value if c.isdecimal())


def _refill(layout: str, digits: str, letters: str) -> str:
    """The layout with its digits (in their own script) and ASCII letters (in their own case) replaced in turn."""
    d, w, out = iter(digits), iter(letters), []
    for c in layout:
        if c.isdecimal():
            c = chr(ord(c) - unicodedata.decimal(c) + int(next(d)))
        elif letters and c.isascii() and c.isalpha():
            c = next(w) if c.isupper() else next(w).lower()
        out.append(c)
    return "".join(out)


# The dihedral group's products and the position permutation of the Verhoeff check, and the check letters of a number modulo 23.
_PRODUCT = [[(a + b) % 5 + 5 * (b > 4) if a < 5 else ((a - b) % 5 + 5 if b < 5 else (a - b) % 5) for b in range(10)] for a in range(10)]
_SHIFT = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
_MOD_23 = "TRWAGMYFPDXBNJZSQVHLCKE"


def verhoeff(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        c = int(c)
        for _ in range(i % 8):
            c = _SHIFT[c]
        total = _PRODUCT[total][c]
    return total == 0


def checks(digits: str, letters: str) -> tuple[bool, ...]:
    """Which rules of well-known document numbers this one fulfils."""
    shape = (len(digits), len(letters))
    return (
        shape == (12, 0) and verhoeff(digits),
        shape == (8, 1) and letters == _MOD_23[int(digits) % 23],
        shape == (7, 2) and letters[0] in "XYZ" and letters[1] == _MOD_23[int(str("XYZ".index(letters[0])) + digits) % 23],
        shape == (9, 0) and digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000",
    )


def _date(parts: list[str]) -> tuple[tuple[int, int, int], datetime.date] | None:
    """The places of year, month and day, and the day: year first, else day first, else month first; two-digit years lie in 1930 to 2029."""
    if len(parts) != 3:
        return None
    for places in ((0, 1, 2),) if len(parts[0]) == 4 else ((2, 1, 0), (2, 0, 1)):
        year = parts[places[0]]
        if len(year) not in (2, 4):
            return None
        full = int(year) + (0 if len(year) == 4 else 2000 if int(year) < 30 else 1900)
        try:
            return places, datetime.date(full, int(parts[places[1]]), int(parts[places[2]]))
        except ValueError:
            continue
    return None


def pseudonym(value: str, kind: str, feistel: Feistel, back: bool = False) -> str | None:
    """A value of the same format: of phones the last ten digits are permuted, of document numbers all digits and (if several) all letters, of dates the day.

    A document number that fulfils a check rule (``checks``) is permuted among
    those that fulfil it, any other among those that don't. Digits of any
    script come back in that script. None if the string isn't a valid value of
    its kind. ``back`` inverts; a month-first date can be read back only if its
    pseudonym's day is over 12.
    """
    if kind == "PHONE":
        tail = re.search(r"(?i) ?(?:ext|extn|x)\.? ?\d{1,5}$", value)
        body, rest = (value[: tail.start()], tail[0]) if tail else (value, "")
        digits = _digits(body)
        if not 10 <= len(digits) <= 15:
            return None
        return _refill(body, digits[:-10] + feistel.text(digits[-10:], DIGITS, "PHONE", back), "") + rest
    if kind == "ID_NUMBER":
        digits, letters = _digits(value), "".join(c for c in value if c.isascii() and c.isalpha()).upper()
        if len(digits) < 4:
            return None
        rules, new, word = checks(digits, letters), digits, letters
        while True:  # the walk stays among numbers of the same rules and ends, at the latest, where it began
            new = feistel.text(new, DIGITS, "ID", back)
            word = feistel.text(word, LETTERS, "ID", back) if len(word) > 1 else word
            if checks(new, word) == rules:
                return _refill(value, new, word)
    if kind == "DATE_OF_BIRTH":
        seps, parts = re.findall(r"[-/. ]", value), re.split(r"[-/. ]", value)
        read = _date([_digits(p) for p in parts]) if all(p.isdecimal() for p in parts) else None
        if read is None:
            return None
        places, day = read
        short = len(parts[places[0]]) == 2
        start, days = TWO_DIGITS if short else FOUR_DIGITS
        n, side = (day - start).days, math.isqrt(days - 1) + 1
        if not 0 <= n < days:
            return None
        walk = feistel.invert if back else feistel.permute
        n = walk(n, side, side, f"DATE{days}")  # a square over the days; walk on until inside
        while n >= days:
            n = walk(n, side, side, f"DATE{days}")
        new_day = start + datetime.timedelta(days=n)
        filled = dict(zip(places, (f"{new_day.year % 100:02d}" if short else f"{new_day.year:04d}", f"{new_day.month:02d}", f"{new_day.day:02d}")))
        zero = next(ord(c) - unicodedata.decimal(c) for c in value if c.isdecimal())
        plain = filled[0] + seps[0] + filled[1] + seps[1] + filled[2]
        return "".join(chr(zero + int(c)) if c.isdecimal() else c for c in plain)
    return None


def _tag(value: str, kind: str, key: bytes) -> str:
    flat = " ".join(sorted(re.findall(r"\w+", re.sub(rf"(?i)\b{_TITLE}(?= )", "", value.lower())))) if kind in ("NAME", "ADDRESS") else re.sub(r"\s", "", re.sub(r" ?[\[({] ?at ?[\])}] ?", "@", re.sub(r" ?[\[({] ?dot ?[\])}] ?", ".", value.lower())))
    return hashlib.blake2b(f"{kind}|{flat}".encode(), key=key, digest_size=5).hexdigest()


class Redactor:
    """Replaces items by typed placeholders: [PHONE +13 40721 ...] for valid numbers and dates, [NAME 5f0c...] otherwise."""

    def __init__(self, key: bytes):
        self.key, self.feistel = key, Feistel(key)
        self.value = lru_cache(maxsize=100_000)(self._value)

    def _value(self, value: str, kind: str) -> str:
        new = pseudonym(value, kind, self.feistel)
        # no pseudonym, or by chance the value itself: a keyed tag tells nothing of it
        return f"[{kind} {_tag(value, kind, self.key) if new is None or new == value else new}]"

    def items(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, placeholder) of every item, in order."""
        return [(s, e, kind, self.value(text[s:e], kind)) for s, e, kind in find_pii(text)]

    def lines(self, text: str) -> list[tuple[int, str]]:
        """(line_no, kind) of every line that gets a placeholder of one of KINDS, counted from 1 at line feeds."""
        items = self.items(text)
        if not items:
            return []
        breaks = [m.start() for m in re.finditer("\n", text)]
        return sorted({(bisect_right(breaks, s) + 1, kind) for s, _, kind, new in items if kind in KINDS and new})

    def __call__(self, text: str) -> str:
        out, at = [], 0
        for start, end, _, new in self.items(text):
            out += [text[at:start], new]
            at = end
        return "".join([*out, text[at:]])


def redacted(text: Column, key: bytes) -> Column:
    """The text with typed placeholders; null stays null, a text without items is unchanged."""

    @F.pandas_udf(StringType())
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        redact = Redactor(key)
        for series in values:
            once = {t: redact(t) for t in series.dropna().unique()}
            yield series.map(once)

    return run(text)


def pii_lines(rows: DataFrame, kind: str, key: str, text: str, secret: bytes) -> DataFrame:
    """(record_kind, record_id, line_no, pii_kind) of every line in which the redaction with ``secret`` sets a placeholder, one row a line and kind.

    Null keys and texts give no row; a key that comes twice with one text
    gives its rows once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        redact = Redactor(secret)
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            found = [redact.lines(t) for t in coded.dictionary.to_pylist()]
            ids, lines, kinds = [], [], []
            for row, code in zip(batch.column(0).to_pylist(), coded.indices.to_pylist()):
                for line, what in found[code]:
                    ids.append(row)
                    lines.append(line)
                    kinds.append(what)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int32()), pa.array(kinds, pa.string())], names=["record_id", "line_no", "pii_kind"])

    slim = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 2)).select(F.col(key).cast("long").alias("record_id"), F.col(text))
    found = slim.mapInArrow(run, "record_id long, line_no int, pii_kind string").distinct()
    return found.select(F.lit(kind).alias("record_kind"), "record_id", "line_no", "pii_kind")
