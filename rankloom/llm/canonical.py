"""Problem 4: freely typed values mapped to a reference list.

A multi-pattern automaton over the canonical names and aliases finds embedded
mentions; the longest non-overlapping ones win, and a value is mapped by them,
to several entries if it names several, when what is left over only qualifies
(a level, a time span, a version). Other values go to token-set similarity:
the value's words are matched with a name's one to one in whatever order, or
both run together, and the edits of all words together must stay within a
budget that grows with the name's length. Letter counts propose the names worth
measuring: an edit changes them by two at most, whatever the words' order, so
one vector comparison with the names of like length leaves out no name within
its budget.

Mapping is a narrow stage: the reference list (a checked size) travels with
the function, each worker remembers the values it has seen, nothing is joined,
and a value that a third of all rows share costs one look-up a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from .confusables import canonical_form
from .links import STAND_INS

# Words that qualify a skill without changing which one it is.
QUALIFIERS = frozenset(
    "a an and at basic basics beginner certified college course expert expertise exposure familiar familiarity good hands in intermediate junior knowledge level "
    "month months of on plus pro proficiency proficient project projects senior skills some strong the v ver version with working year years yr yrs advanced novice fluent se ee core".split()
)
UNMATCHED = "unmatched"
_NUMBER = re.compile(r"v?\d+(?:\.\d+|\.x)*\+?")
_VERSION = re.compile(r"(?<=[a-z+#])[ -]?v?\d+(?:\.\d+)*$")


def flat_form(value: str) -> str:
    """Lower case, plain characters, words apart by one space; ``+``, ``#`` and inner dots stay."""
    text = canonical_form(value).lower()
    text = re.sub(r"[\s_\-/|•·–—*()\[\]{}:;,!?\"']+", " ", text)
    return " ".join(w for w in (w.rstrip(".") for w in text.split()) if w)


def compact(flat: str) -> str:
    return flat.replace(" ", "").replace(".", "")


def edit_budget(length: int) -> int:
    """Edits allowed for a name of so many characters."""
    return 0 if length < 4 else 1 if length < 8 else 2 if length < 16 else 3


def osa(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance (a swap of neighbours is one edit), or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


LETTERS = 32


def letter_counts(form: str) -> np.ndarray:
    """How often each letter occurs, by its code modulo LETTERS."""
    return np.bincount([ord(c) % LETTERS for c in form], minlength=LETTERS).astype(np.int16)


def token_set_edits(a: str, b: str, most: int) -> int:
    """The edits between two sets of words: matched one to one in any order, or run together; most + 1 if over ``most``."""
    best = osa(compact(a), compact(b), most)
    left, right = a.split(), b.split()
    if len(left) == len(right) > 1:
        cost, free = 0, list(right)
        for word in sorted(left, key=len, reverse=True):  # the longest word has the fewest near ones
            d, other = min((osa(word, x, most), x) for x in free)
            cost += d
            free.remove(other)
            if cost > most:
                break
        best = min(best, cost)
    return min(best, most + 1)


class Matcher:
    """Maps single values; built from (key, names) where names are in order of preference."""

    def __init__(self, entries: list[tuple[str, list[str]]]):
        self.exact: dict[str, str] = {}
        self.tight: dict[str, str] = {}
        self.automaton = ahocorasick.Automaton()
        for rank in range(max((len(n) for _, n in entries), default=0)):  # all canonical names before all first aliases, and so on
            for key, names in entries:
                if rank < len(names) and (flat := flat_form(names[rank])):
                    self.exact.setdefault(flat, key)
                    self.tight.setdefault(compact(flat), key)
        self.longest = max(map(len, self.exact), default=0)
        for flat, key in self.exact.items():
            self.automaton.add_word(flat, (flat, key))
        # the names that may have edits, by length
        self.names = sorted((n for n in self.exact if edit_budget(len(compact(n)))), key=lambda n: (len(compact(n)), n))
        forms = [compact(n) for n in self.names]
        self.sizes = np.array([len(f) for f in forms])
        self.reach = 2 * np.array([edit_budget(len(f)) for f in forms])
        self.counts = np.array([letter_counts(f) for f in forms], dtype=np.int16).reshape(-1, LETTERS)
        if len(self.automaton):
            self.automaton.make_automaton()

    def mentions(self, flat: str) -> tuple[list[tuple[int, int, str]], str]:
        """The longest non-overlapping mentions (start, end, key) in their order, and what is left of the text."""
        spans = []
        if len(self.automaton):
            for last, (name, key) in self.automaton.iter(flat):
                start, end = last - len(name) + 1, last + 1
                if (start == 0 or flat[start - 1] == " ") and (end == len(flat) or flat[end] == " "):
                    spans.append((start, end, key))
        used = bytearray(len(flat))
        taken: list[tuple[int, int, str]] = []
        for start, end, key in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
            if not used[start] and not used[end - 1]:  # a longer span that overlaps this one covers one of its ends
                used[start:end] = b"\1" * (end - start)
                taken.append((start, end, key))
        taken.sort()
        rest, at = [], 0
        for start, end, _ in taken:
            rest.append(flat[at:start])
            at = end
        return taken, " ".join([*rest, flat[at:]])

    def similar(self, flat: str) -> str | None:
        """The nearest name within its edit budget, by token-set similarity; ties go to the smaller key.

        A value longer than the longest name can be is like none.
        """
        form = compact(flat)
        if not 3 <= len(form) <= self.longest + 3:
            return None
        lo, hi = np.searchsorted(self.sizes, (len(form) - 3, len(form) + 4))
        near = np.abs(self.counts[lo:hi] - letter_counts(form)).sum(axis=1) <= self.reach[lo:hi]
        best: tuple[float, str] | None = None
        for i in (np.flatnonzero(near) + lo).tolist():
            name, size = self.names[i], int(self.sizes[i])
            budget = edit_budget(size)
            d = token_set_edits(flat, name, budget)
            if d <= budget:
                rank = (d / max(len(form), size), self.exact[name])
                best = rank if best is None or rank < best else best
        return best[1] if best else None

    def all(self, value: str) -> list[str]:
        """The keys of all entries a value names, in its order; ``unmatched`` if none."""
        flat = flat_form(value)
        if not flat or flat in STAND_INS or value.strip().lower() in STAND_INS:
            return [UNMATCHED]
        if hit := self.exact.get(flat) or self.tight.get(compact(flat)):
            return [hit]
        bare = " ".join(_VERSION.sub("", w) if not _NUMBER.fullmatch(w) else "" for w in flat.split())
        bare = " ".join(bare.split())
        for text in dict.fromkeys((flat, bare)):
            taken, rest = self.mentions(text)
            if taken and all(w in QUALIFIERS or _NUMBER.fullmatch(w) for w in rest.split()):
                return list(dict.fromkeys(key for _, _, key in taken))
        stripped = " ".join(w for w in bare.split() if w not in QUALIFIERS) or bare
        if hit := self.exact.get(stripped) or self.tight.get(compact(stripped)):
            return [hit]
        return [self.similar(flat) or (self.similar(stripped) if stripped != flat else None) or UNMATCHED]

    def __call__(self, value: str) -> str:
        return self.all(value)[0]


def read_entries(ontology: DataFrame, most: int = 50_000) -> list[tuple[str, list[str]]]:
    """The reference list, whose size is checked before it is sent to the workers."""
    rows = ontology.select("skill_key", "canonical", "aliases").where("skill_key is not null").orderBy("skill_key").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the reference list has more than {most} entries; split it")
    return [(r[0], [n for n in (r[1], *(r[2] or [])) if n]) for r in rows]


def canonical_keys(value: Column, entries: list[tuple[str, list[str]]], memory: int = 200_000) -> Column:
    """The keys of the entries a value names, or [``unmatched``]; null stays null, and a canonical name as it stands has none."""
    names = {n[0] for _, n in entries if n}

    @F.pandas_udf(ArrayType(StringType()))
    def mapped(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher, known = Matcher(entries), {}
        for series in values:
            for v in series.dropna().unique():
                if v not in known:
                    known[v] = [] if v in names else matcher.all(v)
            yield series.map(known)
            if len(known) > memory:
                known.clear()

    return mapped(value)


def mapped_values(values: DataFrame, ontology: DataFrame) -> DataFrame:
    """(record_kind, record_id, raw_value, skill_key) of every value that is not a canonical name as it stands.

    ``values`` has record_kind, record_id and raw_value. Null and blank values
    give no row; repeated rows count once; an empty reference list leaves
    every value unmatched; a value that names several entries and nothing else
    has a row for each.
    """
    todo = values.select("record_kind", "record_id", "raw_value").where(F.col("raw_value").isNotNull() & F.col("raw_value").rlike(r"(?U)\S"))
    keyed = todo.distinct().withColumn("keys", canonical_keys(F.col("raw_value"), read_entries(ontology)))
    return keyed.select("record_kind", "record_id", "raw_value", F.explode("keys").alias("skill_key"))


def entered_skills(resumes: DataFrame, requirements: DataFrame, matches: DataFrame) -> DataFrame:
    """All skills as they were entered, one row a record and value."""
    one = lambda df, kind, key, value: df.select(F.lit(kind).alias("record_kind"), F.col(key).cast("long").alias("record_id"), value.alias("raw_value"))
    return (
        one(resumes, "resumes", "resume_id", F.explode(F.array_distinct("skills")))
        .unionByName(one(requirements, "requirements", "requirement_id", F.explode(F.array_distinct("skills"))))
        .unionByName(one(matches, "skill_matches", "match_id", F.col("canonical")))
    )
