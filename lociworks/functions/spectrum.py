"""Strand-canonical substitution labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six substitutions of a pyrimidine (fixed values).
SUBSTITUTIONS = ("C>A", "C>G", "C>T", "T>A", "T>C", "T>G")


def channels() -> list[str]:
    """The 96 channels, by substitution and then flanks."""
    return [f"{p}[{s}]{n}" for s in SUBSTITUTIONS for p in "ACGT" for n in "ACGT"]


def channel_index(channel: Column) -> Column:
    """The place of a channel among the 96, from 0; -1 for any other label and for null."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, channels())), channel), F.lit(0)).cast("int") - 1


def complement(base: Column) -> Column:
    """The paired base; null for anything but A, C, G and T."""
    return F.when(base == "A", "T").when(base == "T", "A").when(base == "C", "G").when(base == "G", "C")


def canonical_label(ref: Column, alt: Column, before: Column, after: Column) -> Column:
    """before[ref>alt]after on the pyrimidine's strand; null unless the substitution is one of the six."""
    own = ref.isin("C", "T")
    change = F.when(own, F.concat(ref, F.lit(">"), alt)).otherwise(F.concat(complement(ref), F.lit(">"), complement(alt)))
    left = F.when(own, before).otherwise(complement(after))
    right = F.when(own, after).otherwise(complement(before))
    return F.when(change.isin(*SUBSTITUTIONS), F.concat(left, F.lit("["), change, F.lit("]"), right))


def strict_label(ref: Column, alt: Column, before: Column, after: Column) -> Column:
    """The canonical label of upper-cased bases; null unless all four are A, C, G or T and ref and alt differ."""
    r, a, p, n = (F.upper(c.cast("string")) for c in (ref, alt, before, after))
    ok = r != a
    for c in (r, a, p, n):
        ok = ok & c.isin("A", "C", "G", "T")
    return F.when(ok, canonical_label(r, a, p, n))


def strand_label(ref: Column, alt: Column, before: Column, after: Column) -> Column:
    """before[ref>alt]after as observed, one of 192."""
    return F.concat(before, F.lit("["), ref, F.lit(">"), alt, F.lit("]"), after)


def substitution_of(channel: Column) -> Column:
    return F.regexp_extract(channel, r"\[(.*)\]", 1)


def trailing_integer(text: Column) -> Column:
    """The digits at the end of a text as a number; null if there are none."""
    return F.nullif(F.regexp_extract(text, "([0-9]+)$", 1), F.lit("")).cast("bigint")
