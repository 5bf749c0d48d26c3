"""Lexicon scoring: directions near subjects, and phrases with a sign of their own. Native expressions alone."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

LABELS = ("hawkish", "dovish", "neutral")

# The built-in vocabulary.
#: What is spoken of: 1 if more of it is tighter, -1 if more of it is looser.
SUBJECTS = {
    "inflation": 1, "prices": 1, "price": 1, "wages": 1, "costs": 1, "pressures": 1, "rate": 1, "rates": 1,
    "target": 1, "activity": 1, "growth": 1, "economy": 1, "expansion": 1, "spending": 1, "investment": 1, "output": 1,
    "production": 1, "employment": 1, "jobs": 1, "job": 1, "hiring": 1, "demand": 1, "labor": 1, "conditions": 1,
    "recovery": 1, "sales": 1, "housing": 1, "utilization": 1,
    "unemployment": -1, "slack": -1, "underutilization": -1, "losses": -1, "strains": -1,
}
#: Words of direction: 1 for more, -1 for less.
DIRECTIONS = {
    "increase": 1, "increased": 1, "increases": 1, "increasing": 1, "raise": 1, "raised": 1, "raising": 1, "rise": 1,
    "rising": 1, "rose": 1, "higher": 1, "high": 1, "elevated": 1, "strong": 1, "stronger": 1, "solid": 1,
    "robust": 1, "firm": 1, "firmed": 1, "firming": 1, "accelerate": 1, "accelerated": 1, "accelerating": 1, "improve": 1,
    "improved": 1, "improving": 1, "improvement": 1, "strengthen": 1, "strengthened": 1, "expand": 1, "expanded": 1, "expanding": 1,
    "picked": 1, "upward": 1, "heightened": 1, "tight": 1, "tighter": 1,
    "decrease": -1, "decreased": -1, "decline": -1, "declined": -1, "declining": -1, "lower": -1, "lowered": -1, "low": -1,
    "reduce": -1, "reduced": -1, "reduction": -1, "cut": -1, "weak": -1, "weaker": -1, "weakened": -1, "soft": -1,
    "softened": -1, "slow": -1, "slowed": -1, "slowing": -1, "slower": -1, "subdued": -1, "muted": -1, "depressed": -1,
    "below": -1, "contained": -1, "eased": -1, "easing": -1, "diminished": -1, "diminish": -1, "moderated": -1, "sluggish": -1,
    "downward": -1, "fall": -1, "fell": -1, "falling": -1,
}
REMOVING_ACCOMMODATION = r"\b(remov(e|ing|al of)|withdraw\w*) (policy )?accommodation\b|\bless accommodative\b"
ACCOMMODATION = r"\baccommodat(ive|ion)\b"
#: After these, "rate" is another rate.
COMPOUNDS = ("unemployment", "inflation", "participation", "savings", "exchange", "growth")
PHRASES = [
    (r"\bfirming\b", 1), (r"\btighten(ing|ed)?\b", 1), (r"\brestrictive\b", 1),
    (r"\breduc\w* (in )?the (monthly )?pace of (its )?(net )?(asset )?purchases\b", 1),
    (r"\bnormaliz\w*\b", 1), (r"\binflation risks?\b", 1), (r"\bease the stance\b", -1),
    (r"\b(asset|securities) purchases\b", -1), (r"\bpurchas(e|ing) (additional )?(agency|longer-term|treasury)\b", -1),
    (r"\bexceptionally low\b", -1), (r"\bextended period\b", -1), (r"\bconsiderable (period|time)\b", -1),
    (r"\bpatient\b", -1), (r"\bdownside risks?\b", -1),
]


@dataclass(frozen=True)
class Lexicon:
    """A vocabulary: subjects and directions with signs, phrases, and words that lose their meaning after others."""

    subjects: dict[str, int] = field(default_factory=lambda: dict(SUBJECTS))
    directions: dict[str, int] = field(default_factory=lambda: dict(DIRECTIONS))
    phrases: tuple[tuple[str, int], ...] = tuple(PHRASES)
    removing: str | None = REMOVING_ACCOMMODATION
    accommodating: str | None = ACCOMMODATION
    guarded: tuple[str, ...] = ("rate", "rates")
    compounds: tuple[str, ...] = COMPOUNDS
    window: int = 4


def _sign_of(token: Column, signs: dict[str, int]) -> Column:
    # isin becomes a hash set, a map literal would be searched from its start
    out = F
    for value in sorted(set(signs.values())):
        out = out.when(token.isin([w for w, s in signs.items() if s == value]), value)
    return out.otherwise(0) if signs else F.lit(0)


def tokens(sentence: Column) -> Column:
    """Runs of a-z of the lower-cased sentence."""
    return F.regexp_extract_all(F.lower(sentence), F.lit("[a-z]+"), F.lit(0))


def sentence_score(sentence: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """The signed count of one sentence."""
    w = lexicon.window
    patterns = [p for p, _ in lexicon.phrases] + ([lexicon.removing, lexicon.accommodating] if lexicon.accommodating else [])

    def phrases(low):
        total = F.lit(0)
        for pattern, sign in lexicon.phrases:
            total = total + F.when(low.rlike("(?U)" + pattern), sign).otherwise(0)
        if lexicon.accommodating:
            total = total + F.when(low.rlike("(?U)" + lexicon.removing), 1).when(low.rlike("(?U)" + lexicon.accommodating), -1).otherwise(0)
        # Most sentences have none of the phrases: one pattern says so.
        return F.when(low.rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns)), total).otherwise(0) if patterns else total

    def near_sign(t, i):
        near = F.concat(F.slice(t, F.greatest(F.lit(1), i - w + 1), F.least(i, F.lit(w))), F.slice(t, i + 2, w))
        return F.signum(F.aggregate(near, F.lit(0), lambda a, x: a + _sign_of(x, lexicon.directions))).cast("int")

    def counted(t):
        subjects = F.filter(
            F.transform(t, lambda x, i: F.struct(i.alias("i"), _sign_of(x, lexicon.subjects).alias("s"), (x.isin(list(lexicon.guarded)) & F.coalesce(F.get(t, i - 1).isin(list(lexicon.compounds)), F.lit(False))).alias("off"))),
            lambda r: (r["s"] != 0) & ~r["off"],
        )
        return F.aggregate(subjects, F.lit(0), lambda a, r: a + r["s"] * near_sign(t, r["i"]))

    return let(F.lower(sentence), lambda low: phrases(low) + let(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)), counted))


def label(score: Column, labels: tuple[str, str, str] = LABELS) -> Column:
    """The label of a signed count."""
    return F.when(score > 0, labels[0]).when(score < 0, labels[1]).otherwise(labels[2])


def sentence_label(sentence: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """The label of one sentence."""
    return label(sentence_score(sentence, lexicon))
