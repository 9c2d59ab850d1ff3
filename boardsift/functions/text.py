"""Text columns: cleaning, identifiers and term tests.

Regular expressions name their character classes in full, because ``\\s`` and
``\\w`` cover ASCII only in Java while the wanted meaning is Unicode.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardsift.functions import dictionary

SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
WORD = r"\p{L}\p{N}_"
TAG = r"<[^>]+>"
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode white space."""
    return F.trim(c, F.lit(SPACE_CHARS))


def left(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def strip_tags(c: Column, by: str = " ") -> Column:
    """Replace markup tags; text without ``<`` skips the regular expression."""
    return F.when(F.contains(c, F.lit("<")), F.regexp_replace(c, TAG, by)).otherwise(c)


def collapse(c: Column) -> Column:
    """Turn each run of white space into one blank and drop the outer ones."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def clean_string(c: Column) -> Column:
    return strip(F.coalesce(c.cast("string"), F.lit("Unknown")))


def clean_description(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    return collapse(strip_tags(text))


def clean_url(c: Column) -> Column:
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def clean_posted(c: Column) -> Column:
    return c.cast("string")


def clean_job_type(c: Column) -> Column:
    """A list becomes a comma-separated string."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ", ")


def job_id(title: Column, company: Column, source: Column) -> Column:
    return F.substring(F.md5(F.lower(F.concat_ws("_", title, company, source))), 1, 16)


def job_id_v1(title: Column, company: Column, source: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", title, company, source)), 1, 16)


def match_text(c: Column) -> Column:
    """Lower-cased text of words, ``-``, ``+``, ``#`` and ``.`` for term tests."""
    text = strip_tags(F.coalesce(c, F.lit("")))
    return F.lower(F.trim(F.regexp_replace(text, rf"[^{WORD}\-+#.]+", " ")))


def quoted(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Lists longer than this are looped over instead of unrolled: unrolled tests of
# a few lists outgrow the size up to which the JVM compiles a method at all.
UNROLL = 8
# From this length on, one scan for a pattern of all terms beats a scan for each.
ONE_SCAN = 200


def _hit(text: str, term: str, mode: str) -> str:
    if mode == "word":
        pattern = rf"(?<![{WORD}]){re.escape(term)}(?![{WORD}])"
        return f"{text} RLIKE {quoted(pattern)}"
    return f"contains({text}, {quoted(term)})"


def _bound(text: str, body: str) -> str:
    """``body`` over ``t``, bound once: a text used inside a loop would be
    computed anew on every turn."""
    return f"get(transform(array({text}), t -> {body}), 0)"


def shortest(terms: Iterable[str]) -> list[str]:
    """The different terms that hold no other one; a text with any of ``terms`` has one of these."""
    terms = list(dict.fromkeys(terms))
    return [t for t in terms if not any(o != t and o in t for o in terms)]


def _any(text: str, terms: list[str], mode: str) -> str:
    if mode == "substring" and len(terms) < ONE_SCAN:
        terms = shortest(terms)
    if len(terms) <= UNROLL or mode == "word":
        return "(" + (" OR ".join(_hit(text, t, mode) for t in terms) or "false") + ")"
    if len(terms) >= ONE_SCAN:
        return f"{text} RLIKE {quoted(dictionary.pattern(terms))}"
    listed = ", ".join(quoted(t) for t in terms)
    return f"exists(array({listed}), k -> contains({text}, k))"


def any_term(text: str, terms: Iterable[str], mode: str = "substring") -> Column:
    """True when the text, a column name or SQL expression, holds one of ``terms``.

    ``mode='word'`` asks for whole words instead of substrings.
    """
    return F.expr(_bound(text, _any("t", list(terms), mode)))


def any_keyword_sql(text: str, keywords: Iterable[str]) -> str:
    """SQL of the case-insensitive substring test of any keyword."""
    return _bound(f"lower({text})", _any("t", [k.lower() for k in keywords], "substring"))


def any_keyword(text: str, keywords: Iterable[str]) -> Column:
    return F.expr(any_keyword_sql(text, keywords))


def weighted_terms(text: str, weights: dict, mode: str = "substring") -> Column:
    """Sum the weights of the terms present, each once, in the given order."""
    whole = all(isinstance(w, int) for w in weights.values())
    number = (lambda w: str(w)) if whole else (lambda w: f"{float(w)!r}D")
    if mode == "word":
        body = " + ".join(
            f"IF({_hit('t', k, mode)}, {number(w)}, {number(0)})" for k, w in weights.items())
    elif len(weights) >= ONE_SCAN:
        return _summed(text, weights)
    else:
        pairs = ", ".join(f"struct({quoted(k)} AS k, {number(w)} AS w)" for k, w in weights.items())
        body = (f"aggregate(array({pairs}), {number(0)}, "
                f"(s, e) -> s + IF(contains(t, e.k), e.w, {number(0)}))")
    return F.expr(_bound(text, body))


def _summed(text: str, weights: dict) -> Column:
    """As the loop over all terms does, in the order of ``weights``, over the terms found in one scan."""
    zero = F.lit(0 if all(isinstance(w, int) for w in weights.values()) else 0.0)
    table = F.create_map(*(x for i, (k, w) in enumerate(weights.items()) for x in (
        F.lit(k), F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")))))
    found = F.array_sort(F.transform(_present(text, list(weights)), lambda t: table[t]))
    return F.aggregate(found, zero, lambda s, e: s + e["w"])


def _present(text: str, terms: list[str]) -> Column:
    return F.coalesce(dictionary.present(F.expr(text), terms), F.array().cast("array<string>"))


def matched_terms(text: str, terms: Iterable[str]) -> Column:
    """The terms present, in the given order."""
    terms = list(terms)
    if len(terms) >= ONE_SCAN and len(set(terms)) == len(terms):
        place = F.create_map(*(x for i, k in enumerate(terms) for x in (F.lit(k), F.lit(i))))
        found = F.transform(_present(text, terms), lambda t: F.struct(place[t].alias("i"), t.alias("t")))
        return F.transform(F.array_sort(found), lambda e: e["t"])
    listed = ", ".join(quoted(t) for t in terms)
    return F.expr(_bound(text, f"filter(array({listed}), k -> contains(t, k))"))


def first_label(text: str, terms_by_label: Iterable[tuple[str, Iterable[str]]],
                default: str | None, mode: str = "substring") -> Column:
    """The label of the first (label, terms) pair with a hit."""
    whens = " ".join(f"WHEN {_any('t', list(terms), mode)} THEN {quoted(label)}"
                     for label, terms in terms_by_label)
    rest = "NULL" if default is None else quoted(default)
    return F.expr(_bound(text, f"CASE {whens} ELSE {rest} END"))


def display_name(slug: Column) -> Column:
    """``orca-security`` -> ``Orca Security``; a letter is raised after any non-letter."""
    spaced = F.replace(slug, F.lit("-"), F.lit(" "))
    parts = F.regexp_extract_all(spaced, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, F.initcap), "")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def round_score(c: Column, places: int = 4) -> Column:
    """Half-up on the decimal form, so 2.675 gives 2.68 and not the binary 2.67."""
    return F.round(c, places)
