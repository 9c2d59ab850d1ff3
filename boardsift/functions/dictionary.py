"""Many terms found in one scan of a text.

A list of terms becomes one pattern in the shape of their prefix tree.  At each place of a text it
finds the longest term that begins there, following one branch; the shorter ones that begin there
as well are its prefixes and are known beforehand.  So the time grows with the text and hardly with
the number of terms, and the scan stays in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms of one pattern; a longer list is scanned for in several.
CHUNK = 20_000


def prefix_tree(terms: Iterable[str]) -> dict:
    """Nested dictionaries by character; the key ``None`` marks the end of a term."""
    root: dict = {}
    for term in terms:
        node = root
        for c in term:
            node = node.setdefault(c, {})
        node[None] = {}
    return root


def _literal(c: str) -> str:
    return re.escape(c) if c.isascii() else c


def _branches(parts: list[tuple[str, str]]) -> str:
    """Alternatives with different first characters, found by halving."""
    if len(parts) <= 3:
        return "|".join(p for _, p in parts)
    half = len(parts) // 2
    first = "".join(_in_class(c) for c, _ in parts[:half])
    return f"(?=[{first}])(?:{_branches(parts[:half])})|{_branches(parts[half:])}"


def _in_class(c: str) -> str:
    return "\\" + c if c.isascii() and not c.isalnum() else c


def _pattern(node: dict) -> str:
    chain = ""
    while len(node) == 1 and None not in node:  # a run without branches
        ((c, node),) = node.items()
        chain += _literal(c)
    parts = [(c, _literal(c) + _pattern(child)) for c, child in sorted((c, n) for c, n in node.items() if c is not None)]
    if not parts:
        return chain
    return chain + f"(?:{_branches(parts)})" + ("?" if None in node else "")


def pattern(terms: Iterable[str]) -> str:
    """A pattern that matches the longest term at a place."""
    return _pattern(prefix_tree(terms))


def shorter_terms(terms: Iterable[str]) -> dict[str, list[str]]:
    """The terms that begin a term, with itself, for each term that has any."""
    known = set(terms)
    found = {t: [t[:k] for k in range(len(t) + 1) if t[:k] in known] for t in known}
    return {t: p for t, p in sorted(found.items()) if len(p) > 1}


def any_present(text: Column, terms: Sequence[str]) -> Column:
    """True when the text holds one of the terms; the scan ends at the first."""
    hits = [F.rlike(text, F.lit(pattern(chunk))) for chunk in _chunks(terms)]
    out = hits[0] if hits else text.isNull() & F.lit(False)
    for h in hits[1:]:
        out = out | h
    return out


def present(text: Column, terms: Sequence[str]) -> Column:
    """The different terms that the text holds, in no particular order; NULL for a NULL text."""
    found = [F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({pattern(chunk)}))"), F.lit(1)))
             for chunk in _chunks(terms)]
    if not found:
        return F.when(text.isNotNull(), F.array().cast("array<string>"))
    longest = F.concat(*found)
    # terms of different chunks may begin each other, so prefixes are looked up over all of them
    also = shorter_terms(terms)
    if not also:
        return longest
    table = F.create_map(*(x for t, p in also.items() for x in (F.lit(t), F.array(*map(F.lit, p)))))
    return F.array_distinct(F.flatten(F.transform(longest, lambda t: F.coalesce(
        F.try_element_at(table, t), F.array(t)))))


def _chunks(terms: Sequence[str]) -> list[list[str]]:
    """Sorted, so that terms with a common beginning share their branch."""
    ordered = sorted(set(terms))
    return [ordered[k:k + CHUNK] for k in range(0, len(ordered), CHUNK)]


def occurrences(df: DataFrame, text: str, dictionary: DataFrame, term: str, *keep: str) -> DataFrame:
    """A row (keep, columns of ``dictionary``) for each text and each dictionary entry it holds.

    The terms are read by the driver, as they make up the pattern; the entries are joined by term.
    Null terms are in no text.
    """
    entries = dictionary.filter(F.col(term).isNotNull())
    terms = [r[0] for r in entries.select(term).distinct().toLocalIterator()]
    hits = df.select(*keep, F.explode(present(F.col(text), terms)).alias(term))
    return hits.join(entries, term).select(*keep, *dictionary.columns)
