"""Text cleaning and mask matching."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.numbers import col

# A word is made of letters, digits and underscores of any script.
NON_WORD = r"(?U)\W+"


def spaced_words(text: Column | str) -> Column:
    """Upper case, every run of non-word characters one blank, blanks at both ends.

    Null counts as empty text, so a mask never matches it and the result is never null.
    """
    return F.regexp_replace(F.concat_ws("", F.lit(" "), F.upper(col(text)), F.lit(" ")), NON_WORD, " ")


def bare_word(text: Column | str) -> Column:
    """Upper case with all non-word characters removed."""
    return F.regexp_replace(F.upper(col(text)), NON_WORD, "")


def like_pattern(mask: str) -> str:
    """A LIKE mask as a search pattern; outer percent signs leave the ends open."""
    wild = {"%": ".*", "_": "."}
    body = "".join(wild.get(c, re.escape(c)) for c in mask.strip("%"))
    return ("" if mask.startswith("%") else "^") + body + ("" if mask.endswith("%") else "$")


def matches_any(text: Column | str, masks: Sequence[str]) -> Column:
    """1 when the cleaned text is LIKE one of the masks, else 0; null text gives 0.

    All masks form one pattern, so the text is cleaned and searched once per row.
    """
    return spaced_words(text).rlike("(?s)" + "|".join(like_pattern(m) for m in masks)).cast("int")


def capitalize(text: Column | str) -> Column:
    """First letter upper, all others lower, once per value (not per word)."""
    t = col(text)
    return F.concat(F.upper(F.substring(t, 1, 1)), F.lower(t.substr(F.lit(2), F.length(t))))


def replace_in_order(text: Column | str, rules: Sequence[tuple[str, str]], regex: bool = False) -> Column:
    """Apply (pattern, replacement) rules one after the other; later rules see earlier results."""
    result = col(text)
    for pattern, replacement in rules:
        if regex:
            result = F.regexp_replace(result, pattern, replacement)
        else:
            result = F.replace(result, F.lit(pattern), F.lit(replacement))
    return result


def replace_whole(text: Column | str, mapping: dict[str, str | None]) -> Column:
    """Replace a value only when the whole value matches a key; a null target clears it."""
    t = col(text)
    sources: dict[str | None, list[str]] = {}
    for source, target in mapping.items():
        sources.setdefault(target, []).append(source)
    result = None  # one set lookup for each target
    for target, found in sources.items():
        hit = t.isin(*found)
        result = F.when(hit, F.lit(target)) if result is None else result.when(hit, F.lit(target))
    return t if result is None else result.otherwise(t)


def lower_except(text: Column | str, kept: str) -> Column:
    """Lower-case everything but the given characters (Roman numerals keep their case).

    Both cases of a kept letter stay as they are.
    """
    kept = "".join(sorted(set(kept.upper() + kept.lower())))
    runs = F.regexp_extract_all(col(text), F.lit(f"([{kept}]+|[^{kept}]+)"), F.lit(1))
    lowered = F.transform(runs, lambda r: F.when(r.rlike(f"^[{kept}]"), r).otherwise(F.lower(r)))
    return F.array_join(lowered, "")


def categorize(text: Column | str, rules: Sequence[tuple[Sequence[str], str]], default: str) -> Column:
    """First category one of whose substrings occurs in the text."""
    t = col(text)
    result = None
    for parts, name in rules:
        hit = reduce(lambda a, b: a | b, [t.contains(p) for p in parts])
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return result.otherwise(default)


def band(value: Column | str, limits: Sequence[tuple[float, str]], above: str) -> Column:
    """First band whose upper limit the value does not exceed."""
    v = col(value)
    result = None
    for limit, name in limits:
        result = F.when(v <= limit, name) if result is None else result.when(v <= limit, name)
    return result.otherwise(above)
