"""Label ladders: rules tried in a fixed order, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shares of the score ceiling.
UNCHANGED, MODIFIED, WEAK = 0.97, 0.70, 0.55
#: Confidence below which no decision is made, and the score that decides.
SURE, MATERIAL = 0.60, 0.50


def lexical_label(ratio: Column, cosine: Column, length_ratio: Column) -> Column:
    steady = (ratio >= 0.85) & (length_ratio > 0.75) & (length_ratio < 1.25)
    return F.when((ratio >= 0.95) | (cosine >= 0.95) | steady, "Reworded").when(length_ratio >= 1.25, "Expanded").when(length_ratio <= 0.75, "Reduced").otherwise("Modified")


def pair_label(score: Column, ceiling: Column, overlap: Column, old_section: Column, new_section: Column, old_words: Column, new_words: Column) -> Column:
    """Label of a current text against its best candidate. The order matters: moved texts are told before texts that
    are unchanged without the same words."""
    share = score / ceiling
    moved = (F.coalesce(old_section, F.lit("")) != "") & (F.coalesce(new_section, F.lit("")) != "") & (old_section != new_section)
    ratio = F.when((old_words > 0) & (new_words > 0), new_words / old_words)
    return (
        F.when(score.isNull() | (ceiling == 0), "Added")
        .when((share >= UNCHANGED) & (overlap >= 0.90), "Unchanged")
        .when((share >= MODIFIED) & moved, "Relocated")
        .when(share >= UNCHANGED, "Unchanged")
        .when((share >= MODIFIED) & (ratio >= 1.4), "Expanded")
        .when((share >= MODIFIED) & (ratio <= 0.7), "Reduced")
        .when(share >= WEAK, "Modified")
        .otherwise("Added")
    )


def materiality_label(score: Column, confidence: Column) -> Column:
    """Confidence outranks the score."""
    return F.when(score.isNull() | confidence.isNull(), None).when(confidence < SURE, "Uncertain").when(score >= MATERIAL, "Yes").otherwise("No")


def relationship(previous: Column, current: Column) -> Column:
    """From the numbers of members on both sides."""
    many = lambda n: F.when(n == 1, "one").otherwise("many")
    return F.when(previous == 0, "current_only").when(current == 0, "previous_only").otherwise(F.concat(many(previous), F.lit("_to_"), many(current)))


def logical_label(status: Column, previous: Column, current: Column) -> Column:
    """Labels that need no model."""
    return F.when((status == "unmatched") & (previous == 0), "New").when((status == "unmatched") & (current == 0), "Removed").when(status == "auto_matched", "Unchanged")


def truth(value: Column) -> Column:
    """Whether a decision written in words is a yes; null if it is neither."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("yes", "true", "material", "1", "y"), True).when(v.isin("no", "false", "not material", "immaterial", "0", "n"), False)


def status_lattice(inside: Column, outside: Column) -> Column:
    """Where members are: mixed over partial over single, from two flags."""
    return F.when(inside & outside, "mixed").when(inside, "inside").when(outside, "outside").otherwise("none")
