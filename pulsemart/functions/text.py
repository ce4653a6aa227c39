"""Text measures over notes as array expressions: whole texts, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def words(text: Column) -> Column:
    """Lower-case runs of latin letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def sentences(text: Column) -> Column:
    """Trimmed sentences with their end mark; line breaks end a sentence as well."""
    raw = F.regexp_extract_all(text, F.lit("([^.!?\n]+[.!?]?)"), F.lit(1))
    return F.filter(F.transform(raw, lambda s: F.trim(s)), lambda s: F.length(s) > 1)


def count_of(text: Column, lexicon: list[str]) -> Column:
    """How many words of the text are in the lexicon (plain lower-case words), in one scan."""
    listed = "|".join(lexicon)
    return F.regexp_count(F.lower(text), F.lit(f"(?<![a-z0-9])(?:{listed})(?![a-z0-9])"))


def terms_in(text: Column, terms: list[str]) -> Column:
    """The dictionary terms the text contains, in dictionary order, any case."""
    lowered = F.lower(text)
    return F.array_compact(F.array(*[F.when(F.contains(lowered, F.lit(t)), F.lit(t)) for t in terms]))


def term_hash(term: Column) -> Column:
    """Stable 32-bit hash of a term."""
    return F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long")
