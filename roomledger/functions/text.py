"""Text predicates and normalisers as ``Column -> Column`` functions.

All of them are built-in Spark expressions (codegen, no Python per row).
Regex flags: Java's ``(?U)`` makes ``\\b``, ``\\w`` and ``\\s`` Unicode-aware and
case folding Unicode-wide, which is what Python's ``re`` does on ``str``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

# Python's str.isspace() set, spelled the same way for Java and RE2.
WS_CLASS = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}]"
# Python's str.isdigit() is approximated by decimal digits of any script.
DIGIT_CLASS = r"\p{Nd}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """``str.strip()``: remove leading and trailing whitespace (Unicode)."""
    return F.regexp_replace(col(c), rf"^{WS_CLASS}+|{WS_CLASS}+$", "")


def nonempty(c: Column | str) -> Column:
    """``''`` -> NULL, the reference's "unknown"."""
    return F.nullif(col(c), F.lit(""))


def remove_whitespace(c: Column | str) -> Column:
    """``''.join(s.split())``."""
    return F.regexp_replace(col(c), f"{WS_CLASS}+", "")


def has_digit(c: Column | str) -> Column:
    return col(c).rlike(DIGIT_CLASS)


def address_key(address: Column | str) -> Column:
    """Dedup key of an address: lower-cased, all whitespace removed (C17)."""
    return remove_whitespace(F.lower(col(address)))


def phrase_pattern(patterns: Sequence[str] = K.UNAVAILABLE_PATTERNS) -> str:
    """One case-insensitive, Unicode-aware alternation of the phrase patterns."""
    return "(?iU)" + "|".join(patterns)


def matches_any_phrase(text: Column | str, patterns: Sequence[str] = K.UNAVAILABLE_PATTERNS) -> Column:
    """True when the text says the listing is taken (NULL text -> False)."""
    return F.coalesce(col(text).rlike(phrase_pattern(patterns)), F.lit(False))


CHAIN = 64  # up to so many keywords, looking for one after the other is faster than the pattern


def contains_any(text_lower: Column | str, keywords: Iterable[str]) -> Column:
    """Substring test against several keywords: a short list is one OR chain,
    a long one a single pattern that passes over the text once."""
    c, found = col(text_lower), sorted(set(keywords))
    if not found:
        return F.lit(False)
    if "" in found:
        return F.coalesce(c.isNotNull(), F.lit(False))
    test = reduce(lambda a, b: a | b, [c.contains(F.lit(k)) for k in found]) if len(found) <= CHAIN else c.rlike(keyword_pattern(found))
    return F.coalesce(test, F.lit(False))


def keyword_pattern(keywords: Iterable[str]) -> str:
    """One pattern that finds any of the keywords: their common beginnings
    are factored out, and where many characters can follow, a look at the next
    one halves the choices: steps for a character grow with the logarithm
    of the list."""
    tree: dict = {}
    for word in sorted(set(keywords), key=lambda w: (len(w), w)):
        node = tree
        for ch in word:
            if "" in node:  # a shorter keyword is found here already
                break
            node = node.setdefault(ch, {})
        else:
            node.clear()
            node[""] = {}
    return "(?s)" + _pattern_of(tree)


def _literal(ch: str) -> str:
    return ch if ch.isascii() and ch.isalnum() else f"\\x{{{ord(ch):X}}}"


def _pattern_of(node: dict) -> str:
    if "" in node:
        return ""
    heads = sorted(node)
    if len(heads) == 1:
        return _literal(heads[0]) + _pattern_of(node[heads[0]])
    if len(heads) <= 2:
        return "(?:" + "|".join(_literal(h) + _pattern_of(node[h]) for h in heads) + ")"
    middle = len(heads) // 2
    halves = [heads[:middle], heads[middle:]]
    return "(?:" + "|".join(f"(?=[{_literal(h[0])}-{_literal(h[-1])}])" + _pattern_of({x: node[x] for x in h}) for h in halves) + ")"


def yes_if_mentioned(text_lower: Column | str, keywords: Iterable[str]) -> Column:
    """True if any keyword is a substring, else NULL (never False)."""
    return F.when(contains_any(text_lower, keywords), F.lit(True))


def keyword_flags(text_lower: Column | str, dictionary: Mapping[str, Sequence[str]]) -> list[Column]:
    """J5 for a dictionary of literal size: one nullable flag per feature."""
    return [yes_if_mentioned(text_lower, kws).alias(feature) for feature, kws in dictionary.items()]


def classify_by_keywords(text_lower: Column | str, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Label of the first rule with a keyword in the text, else NULL."""
    expr = None
    for label, kws in rules:
        cond = contains_any(text_lower, kws)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr if expr is not None else F.lit(None).cast("string")


def area_text_match(text: Column | str, name: str = K.AREA_NAME, code: str = K.AREA_CODE) -> Column:
    """the place name (any case) or the area code occurs in the text."""
    c = col(text)
    return F.coalesce(F.lower(c).contains(F.lit(name.lower())) | c.contains(F.lit(code)), F.lit(False))


def left_chars(text: Column | str, n: int | None) -> Column:
    """The first ``n`` characters (the reference's scope window); all when None."""
    c = col(text)
    return c if n is None else F.substring(c, 1, n)


def capitalize(c: Column | str) -> Column:
    """``str.capitalize()``: first character upper, the rest lower."""
    s = col(c)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))
