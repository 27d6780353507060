"""Constants and weights. All are driver-side values that become literals in plans."""

from __future__ import annotations

from dataclasses import astuple, dataclass, replace

# Thresholds and shares that results depend on.
BM25_K1, BM25_B = 1.5, 0.75
SENIORITY_CEILING = {"intern": 2.0, "junior": 3.5, "mid": 8.0, "senior": 40.0}
STUFF_MIN_SKILLS, STUFF_WORDS_PER_SKILL = 22, 28
RELATED_CREDIT, SEMANTIC_CREDIT = 0.55, 0.35
FUZZY_MIN_LEN, FUZZY_MAX_EDITS = 6, 2
TOP_CHUNKS, CHUNK_MIN_WORDS, CHUNK_MAX_WORDS = 3, 4, 80
OVERSHOOT_YEARS = 2.0
SAME_TEXT, SAME_TEXT_WITH_NAME = 0.92, 0.70
REQUIRED_WEIGHT, PREFERRED_WEIGHT = 1.6, 0.8
ENCODER_BAND = {"model": (0.08, 0.62), "lsa": (0.05, 0.45)}
EVIDENCE_WEIGHT = {
    "experience": 1.0, "projects": 0.97, "skills": 0.92, "summary": 0.85, "certifications": 0.8, "other": 0.7, "education": 0.6, "achievements": 0.5, "personal": 0.25,
}
SEVERITY = {"high": 0, "medium": 1, "low": 2, "info": 3}
STATUS_ORDER = {"exact": 0, "related": 1, "semantic": 2, "missing": 3}


@dataclass(frozen=True)
class Weights:
    """Shares of the five sub-scores in the fused score."""

    required: float = 0.34
    semantic: float = 0.26
    lexical: float = 0.16
    preferred: float = 0.12
    experience: float = 0.12

    def normalised(self) -> "Weights":
        total = sum(astuple(self)) or 1.0
        return Weights(*(v / total for v in astuple(self)))


@dataclass(frozen=True)
class Sliders:
    """Three knobs; the keyword knob is split 0.34 : 0.12 : 0.16 over required, preferred and lexical."""

    keyword: float = 0.62
    semantic: float = 0.26
    experience: float = 0.12

    def weights(self) -> Weights:
        total = (self.keyword + self.semantic + self.experience) or 1.0
        share = self.keyword / total / 0.62
        return Weights(0.34 * share, self.semantic / total, 0.16 * share, 0.12 * share, self.experience / total).normalised()

    @staticmethod
    def of(weights: Weights) -> "Sliders":
        return Sliders(weights.required + weights.preferred + weights.lexical, weights.semantic, weights.experience)

    def moved(self, **knobs: float) -> "Sliders":
        """Knobs that aren't named go back to their defaults."""
        return replace(Sliders(), **knobs)
