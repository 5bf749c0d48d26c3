"""Text primitives with Unicode-aware white space, and the two sentence splitters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
#: White space that is not one plain space: longer runs, and other signs.
ODD_SPACE = r"(?U)\s{2,}|[\s&&[^ ]]"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, inside an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends. Single spaces, which are most, are passed over."""
    return F.btrim(F.regexp_replace(text, ODD_SPACE, " "))


def words(text: Column) -> Column:
    """The words between white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words between white space."""
    return F.size(words(text))


def starts_with_any(text: Column, marks: list[str]) -> Column:
    """Whether the text starts with one of ``marks``."""
    out = F.lit(False)
    for m in marks:
        out = out | text.startswith(m)
    return out


def ends_with_any(text: Column, marks: list[str]) -> Column:
    """Whether the text, white space at its end aside, ends with one of ``marks``. Only a text with white space at its end is searched."""
    out = F.lit(False)
    for m in marks:
        out = out | text.endswith(m)
    return out | F.right(text, F.lit(1)).rlike(SPACE) & text.rlike(r"(?U)(?:" + "|".join(re.escape(m) for m in marks) + r")\s*\z")


def ordered_join(items: Column, sep: str) -> Column:
    """Strings of an array joined in order."""
    return F.array_join(items, sep)


# Fixed values of the scoring splitter: abbreviations (as written), the mark that hides their periods, fewest words.
SCORING_ABBREVIATIONS = ["U.S.", "a.m.", "p.m.", "Mr.", "Ms.", "Mrs.", "Dr.", "No.", "e.g.", "i.e.", "St.", "Inc.", "Co.", "Jr.", "vs.", "etc.", "approx."]
SCORING_MARK = "⁣"
SCORING_BREAK = r"""(?U)(?=[\s"')\]])(?<=[.!?])["')\]]?\s+(?=["'(\[]?[A-Z0-9])"""
#: A period that ends an abbreviation: one search tells that a paragraph, as most, has none.
SCORING_ABBREVIATED = r"\.(?<=" + "|".join(re.escape(a) for a in SCORING_ABBREVIATIONS) + ")"
MIN_WORDS = 3


def scoring_sentences(text: Column, min_words: int = MIN_WORDS) -> Column:
    """Sentences as they are scored: paragraph by paragraph, in order; short fragments dropped; none for null."""

    def of_paragraph(p):
        return F.split(let(collapse(p), hidden), SCORING_BREAK)

    def hidden(p):
        out = p
        for a in SCORING_ABBREVIATIONS:
            out = F.replace(out, F.lit(a), F.lit(a.replace(".", SCORING_MARK)))
        return F.when(p.rlike(SCORING_ABBREVIATED), out).otherwise(p)

    parts = F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)\n\s*\n"), of_paragraph))
    parts = F.transform(parts, lambda s: F.btrim(F.replace(s, F.lit(SCORING_MARK), F.lit("."))))
    # White space is single spaces here, so a text with fewer words has no such space to be cut at.
    return F.filter(parts, lambda s: F.substring_index(s, " ", min_words - 1) != s) if min_words > 1 else parts


# Fixed values of the cleaning splitter.
CLEANING_ABBREVIATIONS = [
    "Mr", "Mrs", "Ms", "Messrs", "Mses", "Dr", "St", "Jr", "Sr", "No", "Nos", "vs",
    "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec",
    "Inc", "Corp", "Co", "e.g", "i.e", "a.m", "p.m", "U.S", "U.K", "etc", "approx", "Gov",
]
CLEANING_BREAK = r"""(?U)(?:(?<=[.!?])|(?<=[.!?]["”’')\]]))\s+(?=["“(\[]?[A-Z0-9])"""
CLEANING_MARK = "\u0000"


def cleaning_sentences(text: Column) -> Column:
    """Sentences as they are cleaned: abbreviations in any case and single initials don't end one, closing quotes stay; none for null or blank."""
    listed = "|".join(a.replace(".", r"\.") for a in CLEANING_ABBREVIATIONS)
    t = collapse(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, rf"(?iuU)\b({listed})\.", "$1" + CLEANING_MARK)
    t = F.regexp_replace(t, r"(?U)\b([A-Z])\.(?=\s+[A-Z])", "$1" + CLEANING_MARK)
    parts = F.transform(F.split(t, CLEANING_BREAK), lambda s: F.btrim(F.replace(s, F.lit(CLEANING_MARK), F.lit("."))))
    return F.filter(parts, lambda s: s != "")
