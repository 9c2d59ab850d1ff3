"""Configuration as frozen dataclasses; every operator takes what it needs."""

from __future__ import annotations

from dataclasses import dataclass, field

from boardsift import vocab


@dataclass(frozen=True)
class AgePolicy:
    """How a free-text posting time becomes an age in hours.

    ``None`` stands for "too old or unknown" (infinite age).
    """

    name: str
    empty: float | None
    unparsed: float
    now_words: tuple[str, ...]
    today: float
    day_needs_ago: bool = False
    week_hours: float | None = None
    old_words: tuple[str, ...] = ("month",)
    strip_first: bool = False
    iso_time: bool = False
    date_shift: float = 0.0
    iso_min_length: int = 0
    epoch: str | None = None


AGE_V2 = AgePolicy(
    "v2", empty=24.0, unparsed=24.0,
    now_words=("just", "now", "moment", "second", "few"),
    today=6.0, week_hours=168.0, old_words=("month", "year"),
    iso_min_length=10, epoch="auto")
AGE_BASE = AgePolicy(
    "base", empty=None, unparsed=12.0,
    now_words=("just", "now", "moment", "second"), today=6.0)
AGE_V1 = AgePolicy(
    "v1", empty=None, unparsed=3.0,
    now_words=("just", "now", "moment", "second"),
    today=3.0, day_needs_ago=True, strip_first=True, iso_time=True,
    date_shift=12.0, epoch="seconds")


@dataclass(frozen=True)
class MatchConfig:
    """Vocabularies, weights and cuts of the 0-1 scorer."""

    skill_weights: dict[str, float] = field(default_factory=lambda: dict(vocab.SKILL_WEIGHTS))
    title_excluded: tuple[str, ...] = tuple(vocab.TITLE_EXCLUDED)
    title_required: tuple[str, ...] = tuple(vocab.TITLE_REQUIRED)
    home_terms: tuple[str, ...] = tuple(vocab.HOME_TERMS)
    remote_terms: tuple[str, ...] = tuple(vocab.REMOTE_TERMS)
    exclusive_phrases: tuple[str, ...] = tuple(vocab.EXCLUSIVE_PHRASES)
    foreign_terms: tuple[str, ...] = tuple(vocab.FOREIGN_TERMS)
    blank_locations: tuple[str, ...] = tuple(vocab.BLANK_LOCATIONS)
    city_by_term: dict[str, str] = field(default_factory=lambda: dict(vocab.CITY_BY_TERM))
    category_terms: dict[str, list[str]] = field(
        default_factory=lambda: {k: list(v) for k, v in vocab.CATEGORY_TERMS.items()})
    # Penalties, weights and cuts.
    excluded_penalty: float = -0.5
    missing_penalty: float = -0.3
    semantic_weight: float = 0.6
    keyword_weight: float = 0.4
    keyword_as_semantic: float = 0.8
    min_text_length: int = 50
    foreign_factor: float = 0.3
    min_score: float = 0.25
    relevant_score: float = 0.35
    table_min_score: float = 0.3
    max_age_hours: float = 168.0
    max_years: int = 8
    strict_exclusion: bool = False
    term_mode: str = "substring"


@dataclass(frozen=True)
class TaggedConfig:
    """Settings of the tag-per-search scorer on the 0-100 scale."""

    tags: dict[str, list[str]] = field(
        default_factory=lambda: {k: list(v) for k, v in vocab.TAGGED_CONFIGS.items()})
    skill_points: dict[str, int] = field(default_factory=lambda: dict(vocab.SKILL_POINTS))
    # Caps and cuts.
    keyword_cap: int = 50
    tfidf_scale: float = 50.0
    max_features: int = 3000
    min_text_length: int = 50
    min_score: float = 15.0
    max_age_hours: float = 12.0
    alerts: int = 15


def all_search_keywords() -> list[str]:
    """The distinct search keywords in sorted order, so runs are repeatable."""
    return sorted({k for group in vocab.SEARCH_KEYWORDS.values() for k in group})
