"""Problem 9: one form for all texts that read the same.

1. Runs under a bidirectional override come in the order the eye sees;
   invisible characters go; every kind of space becomes a space; wide, narrow,
   joined and font forms become their plain letters. Raised and lowered
   characters, fractions and circled forms look different and stay.
2. Each token (a run of letters and marks) gets its resolved script set: of
   each letter the scripts it is used in (script extensions) and those that
   hold a look-alike, cut over the whole token. One script left, or a
   whole-script confusable with several: the token is spelled in the first
   possible one, Latin before all others. None left (mixed scripts): each
   letter that looks Latin becomes Latin.
3. Accented letters are composed.

Look-alikes of Cyrillic, Greek and Armenian are stated here, since the public
table of confusables also joins letters of these scripts that a reader tells
apart; those of all other left-to-right scripts are taken from that table, as
the Unicode library on Spark's class path has it (``looks_of``).

The result depends on nothing but how the text looks, so no statistics and no
language column are needed and equal-looking texts meet in one hash.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from ..session import cut

# Letters that look like a Latin letter, by script, in the order of the Latin ones.
LOOKS = {
    "Cyrillic": ("AАBВCСEЕHНIІJЈKКMМOОPРSЅTТXХYУQԚWԜaаcсdԁeеhһiіjјoоpрqԛsѕwԝxхyуvѵlӏ"),
    "Greek": ("AΑBΒEΕHΗIΙJͿKΚMΜNΝOΟPΡTΤXΧYΥZΖaαcϲiιjϳoοpρuυvνßβ"),
    "Armenian": ("OՕSՏUՍgցhհnոoօuս"),
}
# Other signs that look the same.
SIGNS = {"‐": "-", "‑": "-", "∕": "/", "⁄": "/", "ǃ": "!", "ː": ":", "ɡ": "g", "․": ".", "‚": ",", "ı": "i", "ɑ": "a", "ᴄ": "c", "ᴏ": "o", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s"}
# Invisible although not format characters.
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
# Scripts that letters are looked up in.
SCRIPTS = (
    "Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Coptic", "Lisu", "Canadian_Aboriginal", "Runic", "Tifinagh", "Deseret", "Osage", "Elbasan", "Lycian", "Carian", "Old_Italic", "Warang_Citi", "Miao",
    "Georgian", "Hebrew", "Arabic", "Devanagari", "Bengali", "Thai", "Ethiopic", "Myanmar", "Oriya", "Malayalam", "Han", "Hiragana", "Katakana", "Hangul", "Bopomofo", "Khmer", "Tibetan", "Gothic", "Glagolitic",
)
_IN_SCRIPT = {s: regex.compile(rf"\p{{scx={s}}}") for s in SCRIPTS}


@lru_cache(maxsize=1 << 16)
def own_scripts(char: str) -> frozenset[str]:
    """The scripts a letter is used in (its script extensions); a letter of a script not listed has that of its name's first word."""
    return frozenset(s for s, p in _IN_SCRIPT.items() if p.match(char)) or frozenset({unicodedata.name(char, "?").split()[0]})


@dataclass
class Looks:
    """Look-alikes of Latin letters: ``latin`` from any letter to the Latin one, ``spell`` by script from the Latin one to the script's."""

    latin: dict[str, str]
    spell: dict[str, dict[str, str]]
    sets: dict[str, frozenset[str]] = field(default_factory=dict)

    @staticmethod
    def of(pairs: list[tuple[str, str, str]]) -> "Looks":
        """From (script, Latin letter, look-alike), the first of each script and Latin letter being its spelling."""
        latin, spell = {}, {}
        for script, a, b in pairs:
            latin.setdefault(b, a)
            spell.setdefault(script, {}).setdefault(a, b)
        return Looks(latin, spell)

    def scripts(self, char: str) -> frozenset[str]:
        """The scripts a letter can be read in: its own and those of its look-alikes."""
        if char not in self.sets:
            plain = self.latin.get(char, char)
            self.sets[char] = own_scripts(char) | own_scripts(plain) | {s for s, m in self.spell.items() if plain in m}
        return self.sets[char]


STATED = [(script, pairs[i], pairs[i + 1]) for script, pairs in LOOKS.items() for i in range(0, len(pairs), 2)]
BASE = Looks.of(STATED)


@lru_cache(maxsize=1)
def looks_of(spark: SparkSession) -> Looks:
    """The stated look-alikes and those of the other left-to-right scripts in the public table of confusables.

    A letter is a look-alike of the ASCII letter that has the same skeleton.
    Without the Unicode library on the class path the stated ones remain.
    """
    try:
        skeleton = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton
    except TypeError:  # no such class: the name resolves to a package
        return BASE
    ascii_letters = [c for c in map(chr, range(65, 123)) if c.isalpha()]
    letters = [
        c for c in map(chr, range(0x370, 0x20000))
        if unicodedata.category(c) in ("Lu", "Ll", "Lo") and unicodedata.bidirectional(c) == "L" and unicodedata.normalize("NFKC", c) == c and not own_scripts(c) & {"Latin", "Han", "Hangul", *LOOKS}
    ]
    shapes = skeleton("\n".join(ascii_letters + letters)).split("\n")
    plain: dict[str, str] = {}
    for c, shape in zip(ascii_letters, shapes):
        plain[shape] = c  # lower case after upper case, so an upright stroke is l, and I for capitals below
    upper = {shape: c for c, shape in zip(ascii_letters[:26], shapes)}
    found = []
    for c, shape in zip(letters, shapes[52:]):
        look = (upper if unicodedata.category(c) == "Lu" else plain).get(shape) or plain.get(shape)
        if look:
            found.append((min(own_scripts(c)), look, c))
    return Looks.of(STATED + found)


# the controls that open and close a run of forced direction
_OVERRIDE = re.compile("[\u202d\u202e]")
_CLUSTER = regex.compile(r"\X")


def in_seen_order(text: str) -> str:
    """The text with its overridden runs in the order in which they are displayed; a line feed ends all runs."""
    if not _OVERRIDE.search(text):
        return text
    stack: list[tuple[str, list[str]]] = [("\u202d", [])]

    def close() -> None:
        kind, parts = stack.pop()
        stack[-1][1].append("".join(reversed(parts) if kind == "\u202e" else parts))

    for c in _CLUSTER.findall(text):
        if c in "\u202d\u202e":
            stack.append((c, stack[-1][1]) if c == stack[-1][0] else (c, []))
            continue
        if c == "\u202c" or "\n" in c:
            while len(stack) > 1:
                kind, parts = stack[-1]
                if parts is stack[-2][1]:  # a run of its surroundings' direction: nothing to turn
                    stack.pop()
                else:
                    close()
                if c == "\u202c":
                    break
            if c == "\u202c":
                continue
        stack[-1][1].append(c)
    while len(stack) > 1:
        if stack[-1][1] is stack[-2][1]:
            stack.pop()
        else:
            close()
    return "".join(stack[0][1])


class _Fold(dict):
    """A translation table that is filled as characters are met."""

    def __missing__(self, code: int) -> str | None:
        char = chr(code)
        kind, parts = unicodedata.category(char), unicodedata.decomposition(char)
        out: str | None = SIGNS.get(char, char)
        if kind == "Cf" or code in INVISIBLE:
            out = None
        elif kind == "Zs":
            out = " "
        elif parts.startswith(("<wide>", "<narrow>", "<font>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")):
            plain = "".join(chr(int(x, 16)) for x in parts.split()[1:])
            if not plain.startswith(" "):  # spacing accents stay what they are
                out = plain.translate(self)
        self[code] = out
        return out


_FOLD = _Fold()
_TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")
_FOREIGN = re.compile("[^\u0000-\u036f\u1e00-\u1eff\u2000-\u2bff\u2e00-\u2fff\ufb00-\ufb06\ufe00-\uffff]")


def _respell(token: str, looks: Looks) -> str:
    if not _FOREIGN.search(token):
        return token
    left: frozenset[str] | None = None
    for char in token:
        if not "\u0300" <= char <= "\u036f":
            left = looks.scripts(char) if left is None else left & looks.scripts(char)
    choice = next((s for s in SCRIPTS if s in left), None) if left else None
    if choice in (None, "Latin"):
        return "".join(looks.latin.get(c, c) for c in token)
    spelled = looks.spell.get(choice, {})
    return "".join(c if choice in own_scripts(c) else spelled.get(looks.latin.get(c, c), c) for c in token)


def canonical_form(text: str, looks: Looks = BASE) -> str:
    """The one form of all texts that look like ``text``; applying it twice changes nothing."""
    if text.isascii():
        return text
    flat = unicodedata.normalize("NFD", in_seen_order(text).translate(_FOLD)).translate(_FOLD)
    if _FOREIGN.search(flat):
        flat = _TOKEN.sub(lambda m: _respell(m[0], looks), flat)
    return unicodedata.normalize("NFC", flat)


def normalize_column(text: Column) -> Column:
    """``canonical_form`` of a column; null stays null, the empty text stays empty."""
    looks = looks_of(SparkSession.active())

    @F.pandas_udf(StringType())
    def canonical(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in values:
            yield series.map(lambda t: canonical_form(t, looks), na_action="ignore")

    return canonical(text)


def look_classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, spellings): of each row the smallest key of all rows that look the same, and the number of their spellings.

    The form of ``look_alikes`` that grows with the rows alone. Null texts and
    null keys give no row.
    """
    rows = cut(documents.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("id"), F.md5(F.encode(normalize_column(F.col(text)), "UTF-8")).alias("look"), F.md5(F.encode(text, "UTF-8")).alias("spelling")
    ).distinct())
    classes = rows.groupBy("look", "spelling").agg(F.min("id").alias("low")).groupBy("look").agg(F.min("low").alias("class_id"), F.count("*").alias("spellings"))
    return rows.join(classes, "look").select(F.col("id").alias("doc_id"), "class_id", "spellings").distinct()


def look_alikes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_a, doc_b): rows whose texts look the same while the strings differ, smaller key first.

    Spellings are paired first, by the hash of their canonical form, and keys
    are joined to the spelling pairs afterwards; so a text with any number of
    exact copies counts as one spelling, and groups of one spelling are gone
    before the first join. Null texts and null keys look like nothing; a
    repeated key is taken once a spelling.
    """
    rows = cut(documents.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("id"), F.md5(F.encode(normalize_column(F.col(text)), "UTF-8")).alias("look"), F.md5(F.encode(text, "UTF-8")).alias("spelling")
    ).distinct())
    spellings = rows.groupBy("look", "spelling").agg(F.lit(1).alias("one"))
    mixed = spellings.groupBy("look").agg(F.min("spelling").alias("low"), F.max("spelling").alias("high")).where("low <> high").select("look")
    several = spellings.join(mixed, "look", "left_semi").select("look", "spelling")
    pairs = several.alias("x").join(several.alias("y"), F.expr("x.look = y.look and x.spelling < y.spelling")).select(F.col("x.spelling").alias("sa"), F.col("y.spelling").alias("sb"))
    a, b = rows.select(F.col("id").alias("ida"), F.col("spelling").alias("sa")), rows.select(F.col("id").alias("idb"), F.col("spelling").alias("sb"))
    found = pairs.join(a, "sa").join(b, "sb").where("ida <> idb")
    return found.select(F.least("ida", "idb").alias("doc_a"), F.greatest("ida", "idb").alias("doc_b")).distinct()
