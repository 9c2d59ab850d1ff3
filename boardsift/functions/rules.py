"""Classification rules as columns.

Each function takes text that the caller has lower-cased once, so that the
plan evaluates ``lower`` a single time per listing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardsift import vocab
from boardsift.config import MatchConfig
from boardsift.functions.text import SPACE, WORD, any_term, first_label, strip

# Patterns of the experience rule, each with substrings of which
# a hit must hold one (a cheap test before the regular expression).  The word
# edge is spelled out over Unicode letters, digits and underscore.
_START = rf"(?<![{WORD}])"
_EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
_YEARS = ("year", "yr")
SENIOR_PATTERNS = [
    (rf"{_START}(principal|staff{SPACE}+engineer|architect){_EDGE}",
     ("principal", "staff", "architect")),
    (rf"{_START}(director|vp|vice president|head of){_EDGE}",
     ("director", "vp", "vice", "head")),
    (rf"{_START}(10\+|12\+|15\+|20\+){SPACE}*(?:years?|yrs?){_EDGE}", _YEARS),
]
JUNIOR_PATTERNS = [
    (rf"{_START}(junior|jr\.?|entry.?level|fresher|graduate){_EDGE}",
     ("junior", "jr", "entry", "fresher", "graduate")),
    (rf"{_START}(0-[0-5]|[0-3]{SPACE}*(?:\+|to|-){SPACE}*[0-5]){SPACE}*(?:years?|yrs?){_EDGE}",
     _YEARS),
    (rf"{_START}no.?experience.?required{_EDGE}", ("experience",)),
    (rf"{_START}freshers?.?welcome{_EDGE}", ("fresher",)),
    (rf"{_START}early.?career{_EDGE}", ("career",)),
]
NO_RULE_REASON = "No clear senior requirement found"


def is_remote(place: str, cfg: MatchConfig) -> Column:
    return any_term(place, cfg.remote_terms, cfg.term_mode)


def city(place: str, cfg: MatchConfig) -> Column:
    pairs = [(label, [term]) for term, label in cfg.city_by_term.items()]
    return first_label(place, pairs, None, cfg.term_mode)


def is_accessible(location: str, place: str, remote: str, cfg: MatchConfig) -> Column:
    """True unless the listing names another country and nothing opens it up.

    The closing phrases ("us only") are weighed only with ``strict_exclusion``;
    by default a remote listing stays accessible in spite of them.
    """
    home = any_term(place, cfg.home_terms, cfg.term_mode)
    foreign = any_term(place, cfg.foreign_terms, cfg.term_mode)
    blank = F.lower(strip(F.col(location))).isin(*cfg.blank_locations)
    if not cfg.strict_exclusion:
        return F.col(remote) | home | blank | ~foreign
    exclusive = any_term(place, cfg.exclusive_phrases, cfg.term_mode)
    return home | (F.col(remote) & ~exclusive) | blank | (~foreign & ~exclusive)


def title_penalty(title: str, cfg: MatchConfig) -> Column:
    """0 for a relevant title, else the penalty of the rule that failed."""
    return (
        F.when(any_term(title, cfg.title_excluded, cfg.term_mode), F.lit(cfg.excluded_penalty))
        .when(~any_term(title, cfg.title_required, cfg.term_mode), F.lit(cfg.missing_penalty))
        .otherwise(F.lit(0.0))
    )


def category(text: str, cfg: MatchConfig) -> Column:
    return first_label(text, cfg.category_terms.items(), vocab.OTHER_CATEGORY, cfg.term_mode)


def _match(text: str, pattern: str, needs: tuple[str, ...], group: int = 0) -> Column:
    """The hit of a pattern, NULL when there is none."""
    hit = F.nullif(F.regexp_extract(F.col(text), "(?d)" + pattern, group), F.lit(""))
    return F.when(any_term(text, needs), hit)


def _first_match(text: str, patterns: list[tuple[str, tuple[str, ...]]]) -> Column:
    """The hit of the first pattern that matches, NULL when none does."""
    return F.coalesce(*[_match(text, p, needs) for p, needs in patterns])


def required_years(text: str, at_least: int) -> Column:
    """The first "N years" with N of ``at_least`` or more, without leading zeros.

    Written as one pattern over the digits, so nothing is collected per row.
    """
    number = number_at_least(at_least)
    pattern = rf"(?<![0-9])0*({number}){SPACE}*\+?{SPACE}*(?:years?|yrs?)"
    return _match(text, pattern, _YEARS, 1)


def number_at_least(n: int) -> str:
    """A pattern for decimal numbers >= n without leading zeros."""
    digits = str(n)
    parts = []
    for i, d in enumerate(digits):
        if int(d) < 9:
            tail = len(digits) - i - 1
            parts.append(digits[:i] + f"[{int(d) + 1}-9]" + ("[0-9]{%d}" % tail if tail else ""))
    parts.append(digits)
    return "[1-9][0-9]{%d,}|" % len(digits) + "|".join(parts)


def experience_reason(title: str, text: str, max_years: int = 8) -> Column:
    """Why a listing passes or fails the experience rule.

    Senior words in the title fail; then junior words anywhere pass; then the
    first demand of ``max_years`` or more fails; else it passes.
    """
    def around(prefix: str, hit: Column, suffix: str) -> Column:
        return F.concat(F.lit(prefix), hit, F.lit(suffix))  # NULL without a hit

    return F.coalesce(
        around("Senior role: '", _first_match(title, SENIOR_PATTERNS), "'"),
        around("Junior-friendly: '", _first_match(text, JUNIOR_PATTERNS), "'"),
        around("Requires ", required_years(text, max_years), "+ years experience"),
        F.lit(NO_RULE_REASON),
    )


def experience_suitable(reason: Column) -> Column:
    return reason.startswith("Junior-friendly: '") | (reason == NO_RULE_REASON)


def is_relevant(score: Column, home: Column, suitable: Column, cut: float = 0.35) -> Column:
    return (score >= F.lit(cut)) & home & F.coalesce(suitable, F.lit(True))
