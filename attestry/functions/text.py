"""Text normalisation, trigram similarity and tag escaping as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's str methods and ``re`` see it: the Unicode property
# plus the four ASCII separators that Java's ``\s`` leaves out. Fixed values.
SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"

FORGED_TAG = r"(?iU)</?untrusted_source\b[^>]*>"


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace, Unicode spaces included."""
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def slugify(text: Column) -> Column:
    """Lower-case key of ``[a-z0-9]`` runs joined by dashes; ``unknown`` when nothing is left."""
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    trimmed = F.regexp_replace(dashed, "^-|-$", "")
    return F.when(trimmed == "", F.lit("unknown")).otherwise(trimmed)


def unix_newlines(text: Column) -> Column:
    """Universal-newline reading of a text file."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def trigrams(text: Column) -> Column:
    """Distinct 3-grams of the alphanumeric words of ``text``.

    Every word is padded with two blanks in front and one behind, so a word of
    n characters yields n + 1 grams.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    padded = F.transform(words, lambda word: F.concat(F.lit("  "), word, F.lit(" ")))
    grams = F.transform(
        padded,
        lambda word: F.transform(
            F.sequence(F.lit(1), F.length(word) - 2), lambda i: F.substr(word, i, F.lit(3))
        ),
    )
    return F.array_distinct(F.flatten(grams))


def gram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two distinct gram arrays; 0 when both are empty."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(0.0)).otherwise(shared / union)


def trigram_similarity(a: Column, b: Column) -> Column:
    return gram_similarity(trigrams(a), trigrams(b))


def escape_forged_tags(text: Column) -> Column:
    """Escape the angle brackets of source-wrapper tags that the text itself contains."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(FORGED_TAG), F.lit(0)))
    return F.aggregate(
        found,
        text,
        lambda acc, tag: F.replace(
            acc, tag, F.replace(F.replace(tag, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        ),
    )


def wrap_source(source_id: Column, text: Column) -> Column:
    """One fenced block of untrusted text."""
    return F.concat(
        F.lit('<untrusted_source id="'),
        source_id.cast("string"),
        F.lit('">\n'),
        escape_forged_tags(text),
        F.lit("\n</untrusted_source>"),
    )


def quoted(text: Column) -> Column:
    """A value in single quotes, as finding messages show it."""
    return F.concat(F.lit("'"), text, F.lit("'"))
