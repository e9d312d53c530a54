"""Patterns of responses that look steered by instructions inside a source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category and pattern, matched without regard to case. Fixed values.
SMELLS = [
    (
        "ignore_previous_instructions",
        r"\bignore\s+(?:all\s+|any\s+|the\s+)?(?:previous|prior|above)\s+(?:instructions|rules|prompts?|directives|context)\b",
    ),
    (
        "disregard_instructions",
        r"\bdisregard\s+(?:(?:all|any|the)\s+)?(?:(?:previous|prior|above)\s+)?(?:instructions|rules|prompts?|directives)\b",
    ),
    (
        "fetch_url",
        r"\b(?:fetch|download|retrieve|curl|wget|visit|open|navigate to|go to)\b[^.\n]{0,60}https?://\S+",
    ),
    (
        "exfiltrate_data",
        r"\b(?:email|send|upload|exfiltrate|forward|transmit|post)\b[^.\n]{0,80}(?:@[\w.-]+\.\w+|https?://\S+)",
    ),
    (
        "change_tool_behavior",
        r"\b(?:mark|treat|flag|set)\b[^.\n]{0,40}\b(?:every|all)\b[^.\n]{0,40}\b(?:approved|passed|resolved|clean|valid)\b",
    ),
    (
        "change_tool_behavior",
        r"\b(?:auto[- ]?approve|skip (?:the )?(?:human )?review|bypass (?:the )?(?:human )?(?:gate|review))\b",
    ),
    ("system_prompt_probe", r"system prompt|reveal your (?:instructions|prompt)"),
    ("role_override", r"you are now\b|act as (?:a|an)\b"),
    ("silence_reviewer", r"do not (?:tell|inform|notify) (?:the )?(?:user|reviewer)"),
]


# Per pattern: groups of texts, lower case, of which each group must occur somewhere
# for the pattern to match. They only save work; the pattern decides.
NEEDED = [
    [["ignore"], ["previous", "prior", "above"]],
    [["disregard"]],
    [["http"], ["fetch", "download", "retrieve", "curl", "wget", "visit", "open", "navigate to", "go to"]],
    [["@", "http"], ["email", "send", "upload", "exfiltrate", "forward", "transmit", "post"]],
    [["every", "all"], ["approved", "passed", "resolved", "clean", "valid"], ["mark", "treat", "flag", "set"]],
    [["approve", "review", "gate"], ["auto", "skip", "bypass"]],
    [["system prompt", "reveal your"]],
    [["you are now", "act as"]],
    [["do not"]],
]

# Letters that equal s, i or k when case is ignored, but do not become them in lower case.
FOLDED = {"\u017f": "s", "\u0131": "i", "\u0130": "i", "\u212a": "k"}


def smells(text: Column) -> Column:
    """Array of ``(pattern, category, excerpt)``: the first match of every pattern that matches.

    A pattern runs only on a text that holds the words it needs; looking for
    fixed words is much cheaper than matching without regard to case.
    """
    plain = text
    for letter, base in FOLDED.items():
        plain = F.replace(plain, F.lit(letter), F.lit(base))

    def scan(lowered: Column) -> Column:
        hits = []
        for number, ((category, pattern), groups) in enumerate(zip(SMELLS, NEEDED)):
            possible = F.lit(True)
            for group in groups:
                some = F.lit(False)
                for word in group:
                    some = some | F.contains(lowered, F.lit(word))
                possible = possible & some
            excerpt = F.when(possible, F.regexp_extract(text, "(?iU)" + pattern, 0)).otherwise(F.lit(""))
            hits.append(
                F.struct(
                    F.lit(number).alias("pattern"),
                    F.lit(category).alias("category"),
                    excerpt.alias("excerpt"),
                )
            )
        return F.filter(F.array(*hits), lambda hit: hit["excerpt"] != "")

    # the one-element array binds the lowered text, so it is built once per row
    return F.flatten(F.transform(F.array(F.lower(plain)), scan))
