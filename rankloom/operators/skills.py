"""Skills named in free text: exact surfaces, guarded short names, likely typing errors, best evidence.

A line is read once by an automaton over all surfaces; blanks, hyphens and
underscores are one sign, and a surface counts only between signs that are no
letters or digits. Of overlapping surfaces the leftmost, then the longest,
counts. Everything is a stage of its own per text: nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, combinations

import ahocorasick
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StructField, StructType

from ..config import EVIDENCE_WEIGHT, FUZZY_MAX_EDITS, FUZZY_MIN_LEN
from .matching import surfaces

FUZZY_RATIO = 0.88
MAX_SURFACES = 500_000

# Short surfaces that are also other things, the words after which they are, and the words in a line that speak for a skill.
RISKY = ("c", "r", "go", "ts", "js", "py", "ml", "os", "qa", "sh")
LABELS = ("grade", "section", "class", "option", "batch", "division", "category", "plan", "type", "level", "rank", "part", "unit", "block", "group")
CONTEXT = ("program", "language", "c++", "java", "python", "skill", "technolog", "proficien", "coding", "develop")
# Common words near to a surface.
COMMON = frozenset((
    "about", "above", "acting", "action", "active", "against", "aware", "based", "basic", "basics", "below", "between", "class", "classes", "client", "clients", "company", "course", "courses", "create",
    "created", "design", "designed", "detail", "details", "during", "email", "every", "field", "first", "focus", "grade", "great", "group", "hobby", "hobbies", "include", "index", "issue", "issues",
    "later", "learn", "learning", "level", "major", "manage", "march", "minor", "mobile", "month", "months", "notes", "other", "others", "output", "phase", "place", "point", "points", "power",
    "present", "process", "product", "profile", "project", "projects", "quality", "queries", "query", "report", "reports", "result", "results", "review", "reviews", "score", "scored", "section",
    "senior", "server", "service", "services", "sheet", "sheets", "skill", "skills", "small", "solve", "solved", "source", "stage", "start", "state", "story", "strong", "study", "system", "systems",
    "table", "tables", "their", "there", "these", "third", "those", "times", "title", "total", "train", "under", "value", "values", "where", "which", "while", "white", "whole", "world", "would",
    "write", "writing", "written", "years", "code", "coding", "codes", "across", "around", "become", "before", "behind", "better", "change", "choose", "common", "custom", "decide", "deploy", "domain",
    "driven", "enable", "ensure", "expect", "follow", "handle", "impact", "inside", "listed", "market", "matter", "medium", "member", "method", "moving", "native", "number", "object", "office",
    "online", "option", "people", "period", "person", "policy", "public", "reason", "record", "reduce", "region", "remote", "return", "sample", "scale", "school", "search", "second", "series",
    "should", "simple", "single", "social", "status", "studio", "submit", "summer", "target", "things", "though", "toward", "travel", "trends", "update", "usage", "useful", "various", "vision",
    "within", "worked",
))

_ONE_BLANK = re.compile(r"[ \t\r\f_-]+")
_LIST_OF = re.compile(r"[a-z]+")
_TOKEN = re.compile(r"[a-z][a-z0-9+#.]{4,19}")


def levenshtein(a: str, b: str, most: int) -> int:
    """Edits from a to b, or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def indel_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths."""
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            up = row[j]
            row[j] = diagonal + 1 if x == y else max(up, row[j - 1])
            diagonal = up
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


def _without(word: str, most: int) -> set[str]:
    return {"".join(c for i, c in enumerate(word) if i not in gone) for k in range(most + 1) for gone in map(set, combinations(range(len(word)), k))}


class Scanner:
    """Finds the skills of single lines; built from (surface, skill_key)."""

    def __init__(self, forms: list[tuple[str, str]], typos: bool = True):
        self.keys = dict(forms)
        self.automaton = ahocorasick.Automaton()
        for form in self.keys:
            self.automaton.add_word(form, form)
        if self.keys:
            self.automaton.make_automaton()
        self.typos = typos
        self.near: dict[str, set[str]] = {}
        if typos:
            for form in self.keys:
                if FUZZY_MIN_LEN <= len(form) <= 20 + FUZZY_MAX_EDITS:
                    for part in _without(form, FUZZY_MAX_EDITS):
                        self.near.setdefault(part, set()).add(form)
        self.known: dict[str, str | None] = {}

    @staticmethod
    def guarded(flat: str, form: str, start: int) -> bool:
        """Whether a surface at this place means its skill."""
        if form not in RISKY:
            return True
        before = _LIST_OF.findall(flat[max(0, start - 30) : start])
        if before and before[-1] in LABELS:
            return False
        return any(c in flat for c in CONTEXT) or re.search(rf"[,/|] *{re.escape(form)} *[,/|]", flat) is not None

    def like(self, token: str) -> str | None:
        """The surface a token is a likely typing error of: the best ratio, then the first by name."""
        if token not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            best = min(((-indel_ratio(token, form), form) for form in set().union(*(self.near.get(p, ()) for p in _without(token, FUZZY_MAX_EDITS))) if levenshtein(token, form, FUZZY_MAX_EDITS) <= FUZZY_MAX_EDITS), default=None)
            self.known[token] = best[1] if best and -best[0] >= FUZZY_RATIO else None
        return self.known[token]

    def __call__(self, line: str) -> list[tuple[int, str, str, bool]]:
        """(place, key, surface, exact) of a line's skills, a skill once, exact ones first."""
        flat = _ONE_BLANK.sub(" ", line.lower())
        spans = []
        if self.keys:
            for last, form in self.automaton.iter(flat):
                start, end = last - len(form) + 1, last + 1
                if not (start and flat[start - 1].isascii() and flat[start - 1].isalnum()) and not (end < len(flat) and flat[end].isascii() and flat[end].isalnum()):
                    spans.append((start, -end, form))
        out, used, at = {}, [], 0
        for start, end, form in sorted(spans):
            if start >= at:
                at = -end
                if self.guarded(flat, form, start):
                    used.append((start, at))
                    out.setdefault(self.keys[form], (start, self.keys[form], form, True))
        if self.typos:
            for m in _TOKEN.finditer(flat):
                token = m[0].strip(".")
                if len(token) < FUZZY_MIN_LEN or token in self.keys or token in COMMON or any(s <= m.start() < e or s < m.end() <= e for s, e in used):
                    continue
                form = self.like(token)
                if form:
                    out.setdefault(self.keys[form], (m.start(), self.keys[form], token, False))
        return list(out.values())


def forms_of(ontology: DataFrame) -> list[tuple[str, str]]:
    """The surfaces, whose number is checked before they travel with a function."""
    rows = surfaces(ontology).where("surface <> ''").limit(MAX_SURFACES + 1).collect()
    if len(rows) > MAX_SURFACES:
        raise ValueError(f"more than {MAX_SURFACES} surfaces")
    return sorted((r[0], r[1]) for r in rows)


HIT = "line_no int, label string, place int, skill_key string, surface string, exact boolean, evidence string"


def mentions(rows: DataFrame, lines: str, ontology: DataFrame, typos: bool = False, best: bool = False) -> DataFrame:
    """Adds ``hits``, an array of HIT: the skills of each line of ``lines``, an array of (line_no, line, label).

    A skill comes once a line, or with ``best`` once a text: from the label
    that weighs most as evidence, then the first line. Evidence is the line's
    first 220 characters. Null lines and a null array name nothing. ``rows``
    should hold no column that isn't needed: all pass through Python.
    """
    forms = forms_of(ontology)
    names = [c.split()[0] for c in HIT.split(", ")]
    types = [{"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in HIT.split(", ")]

    def hits_of(scan: Scanner, arrays: pa.ListArray) -> pa.ListArray:
        out, sizes, at = [], [], 0
        flat = arrays.flatten()
        no, text, label = (flat.field(i).to_pylist() for i in range(3))
        for n in pa.compute.fill_null(pa.compute.list_value_length(arrays), 0).to_pylist():
            hits = [(no[i], label[i], place + 1, skill, surface, exact, text[i].strip(" \t\r")[:220]) for i in range(at, at + n) if text[i] for place, skill, surface, exact in scan(text[i])]
            at += n
            if best:
                top: dict[str, tuple] = {}
                for h in hits:
                    if h[3] not in top or EVIDENCE_WEIGHT.get(h[1], 0.7) > EVIDENCE_WEIGHT.get(top[h[3]][1], 0.7):
                        top[h[3]] = h
                hits = list(top.values())
            out += hits
            sizes.append(len(hits))
        cols = list(zip(*out)) or [()] * len(names)
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(forms, typos)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, hits_of(scan, batch.column(lines))], names=[*batch.schema.names, "hits"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("hits", ArrayType(StructType.fromDDL(HIT)))]))


def sql_mentions(source: str, keys: str, prefix: str = "sk") -> str:
    """CTEs that end in ``sk_hits`` (keys..., line_no, label, line, st, surface, skill_key), the exact mentions of a relation (keys..., line_no, line, label); needs ``surf``."""
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    edge = lambda at: f"NOT regexp_matches(substring(norm, {at}, 1), '[a-z0-9]')"
    out = f"""
sk_src AS MATERIALIZED (SELECT row_number() OVER () AS ln, * FROM (SELECT *, regexp_replace(lower(line), '[ \\t\\r\\f_-]+', ' ', 'g') AS norm FROM {source}) WHERE line <> ''),
sk_cand AS (SELECT ln, norm, surface, skill_key, unnest(list_filter(range(1, length(norm) - length(surface) + 2), lambda i: substring(norm, i, length(surface)) = surface)) AS st FROM sk_src JOIN surf ON surface <> '' AND contains(norm, surface)),
sk_fits AS (SELECT *, st + length(surface) AS en FROM sk_cand WHERE (st = 1 OR {edge('st - 1')}) AND {edge('st + length(surface)')}),
sk_longest AS MATERIALIZED (SELECT ln, st, max(en) AS en FROM sk_fits GROUP BY ln, st),
sk_taken(ln, st, en) AS (
  SELECT ln, min(st), arg_min(en, st) FROM sk_longest GROUP BY ln
  UNION ALL SELECT t.ln, min(n.st), arg_min(n.en, n.st) FROM sk_taken t JOIN sk_longest n ON n.ln = t.ln AND n.st >= t.en GROUP BY t.ln, t.st),
sk_chosen AS (SELECT f.* FROM sk_fits f JOIN sk_taken t ON t.ln = f.ln AND t.st = f.st AND t.en = f.en),
sk_hits AS MATERIALIZED (SELECT {keys}, line_no, label, line, st, surface, skill_key FROM sk_chosen c JOIN sk_src USING (ln) WHERE surface NOT IN ({quoted(RISKY)})
  OR (NOT coalesce(regexp_extract_all(substring(c.norm, greatest(1, st - 30), st - greatest(1, st - 30)), '[a-z]+')[-1] IN ({quoted(LABELS)}), false)
    AND ({' OR '.join(f"contains(c.norm, '{x}')" for x in CONTEXT)} OR regexp_matches(c.norm, '[,/|] *' || surface || ' *[,/|]'))))
"""
    return out.replace("sk_", f"{prefix}_")


#: The surfaces of the ontology in SQL, as ``matching.surfaces`` makes them.
SQL_SURFACES = """surf AS (SELECT trim(regexp_replace(lower(s), '[\\s_-]+', ' ', 'g')) AS surface, min(skill_key) AS skill_key FROM (
  SELECT skill_key, canonical AS s FROM skill_ontology UNION ALL SELECT skill_key, skill_key FROM skill_ontology UNION ALL SELECT skill_key, unnest(aliases) FROM skill_ontology) WHERE s IS NOT NULL GROUP BY 1)"""
