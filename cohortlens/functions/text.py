"""Text expressions (p_word_count*, p_clean_text, p_sentence_split, p_contains_any).

Everything here is a built-in Spark expression (regexp_replace, split, filter,
transform, exists), so it runs inside whole-stage codegen / the JVM with no
Python round trip.
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["PUNCT", "WS", "re_escape", "strip_ws", "word_count", "word_count_clean",
           "clean_text", "sentence_split", "contains_any", "contains_any_ci",
           "SEP", "split_sep", "join_sep", "find_terms", "let"]

# Fixed values (must equal the reference): a token is dropped by the clean word
# count when it is a substring of this punctuation string (PRE word rule).
PUNCT = "\"'`~!@#$%^&*()-_=+{}[]\\|\t\n,<.>/?:;"
# Sentence separator used when a sentence list is stored as one string.
SEP = "[SEP]"
# Whitespace class written out so Java regex and RE2 (the oracle) agree.
WS = "[\\t\\n\\x0B\\f\\r ]"

_META = set(".^$*+?()[]{}|\\")


def re_escape(s: str) -> str:
    """Escape regex metacharacters (same escaping works in Java regex and RE2)."""
    return "".join("\\" + c if c in _META else c for c in s)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value, fn) -> Column:
    """Bind ``value`` once and use it inside ``fn`` (``let v = value in fn(v)``).

    Higher-order lambdas get no common-subexpression elimination and Catalyst
    inlines projected columns into them, so an expression referenced inside a
    lambda would be re-evaluated per element. A one-element ``transform`` binds
    it as a lambda variable instead, evaluated exactly once per row."""
    return F.element_at(F.transform(F.array(_c(value)), fn), 1)


def strip_ws(x) -> Column:
    """Python-style strip of leading/trailing whitespace (trim() only drops spaces)."""
    return F.regexp_replace(_c(x), f"^{WS}+|{WS}+$", "")


def word_count(x) -> Column:
    """p_word_count: number of ' '-separated pieces, empty pieces counted."""
    x = _c(x)
    return F.when(x.isNotNull(), F.size(F.split(x, " ")))


def word_count_clean(x) -> Column:
    """p_word_count_clean: split on space/newline, drop tokens that are a
    substring of PUNCT (so '' and '()' go, '--' stays); null stays null."""
    x = _c(x)
    toks = F.filter(F.split(x, " |\n"), lambda w: ~F.lit(PUNCT).contains(w) & (w != " "))
    return F.when(x.isNotNull(), F.size(toks))


def clean_text(x, phrases: Iterable[str] = ()) -> Column:
    """p_clean_text: the replacement chain in reference order.

    1. delete each institution phrase, case-insensitive (caller's list),
    2. delete '¿' and '#', 3. 'm.d.' -> 'md', 'dr.' -> 'doctor' (case-sensitive,
    also inside words), 4. delete 'http\\S+' then 'w{3}\\S+'.
    """
    x = _c(x)
    for p in phrases:
        x = F.regexp_replace(x, "(?i)" + re_escape(p), "")
    x = F.replace(x, F.lit("¿"), F.lit(""))
    x = F.replace(x, F.lit("#"), F.lit(""))
    x = F.regexp_replace(x, "m\\.d\\.", "md")
    x = F.regexp_replace(x, "dr\\.", "doctor")
    x = F.regexp_replace(x, "http\\S+", "")
    x = F.regexp_replace(x, "w{3}\\S+", "")
    return x


def sentence_split(x) -> Column:
    """p_sentence_split: split on '. ' / newline / three blanks, strip, keep len>=2."""
    parts = F.split(_c(x), f"\\.{WS}|\\n|{WS}{WS}{WS}")
    return F.filter(F.transform(parts, strip_ws), lambda s: F.length(s) >= 2)


def contains_any(x, terms: Iterable[str]) -> Column:
    """p_contains_any: literal containment of any term, the terms as one array literal."""
    x = _c(x)
    terms = list(terms)
    if not terms:
        return F.lit(False)
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: x.contains(t))


def contains_any_ci(x, terms: Iterable[str]) -> Column:
    """Case-folded (upper) containment, as the reference's str.upper() tests."""
    return contains_any(F.upper(_c(x)), [t.upper() for t in terms])


def contains_any_folded(x, terms: Iterable[str], fold=F.lower) -> Column:
    """Fold the text once (let-bound), then test every term against it."""
    terms = list(terms)
    return let(fold(_c(x)), lambda f: contains_any(f, terms))


def split_sep(x, sep: str = SEP) -> Column:
    """p_join_split_sep: string -> list on a literal separator."""
    return F.split(_c(x), re_escape(sep))


def join_sep(x, sep: str = SEP) -> Column:
    """p_join_split_sep: list -> string."""
    return F.array_join(_c(x), sep)


def find_terms(text, terms_col) -> Column:
    """Terms (array column, lexicon order) contained in the text, both lower-cased."""
    t = F.lower(_c(text))
    return F.filter(_c(terms_col), lambda w: t.contains(w))
