"""Raw payloads to listings, driven by one declarative spec per board.

A landing row holds one response of a board.  Positions inside a payload come
from the payload's own array, so caps such as "first 20 hits of a response"
are array slices within the row and cost no shuffle; only first-wins
deduplication across responses does.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardsift.functions import text
from boardsift.operators.dedup import by_title_company, first_wins


@dataclass(frozen=True)
class JsonList:
    """The entries of a JSON payload, each read on its own.

    ``items``   SQL that finds an ``array<variant>`` in the parsed payload ``v``
    ``fields``  what is read of an entry, as a list of fields and types
    ``keep``    condition on an entry ``e``, before ``shape``
    ``shape``   SQL over ``e`` that makes the entry the spec sees
    ``skip``    leading items that are no entries

    An entry is an object; other items are odd (see :func:`quarantine_entries`).  A field of
    unexpected type is NULL, or its JSON where text is wanted.
    """

    items: str
    fields: str
    keep: str = "true"
    shape: str = "e"
    skip: int = 0

    def found(self, first: int | None = None) -> str:
        """The JSON of every item, NULL when there is no list."""
        items = f"get(transform(array(try_parse_json(payload)), v -> {self.items}), 0)"
        if self.skip:
            items = f"filter({items}, (i, n) -> n >= {self.skip})"
        if first is not None:
            items = f"slice({items}, 1, {first})"
        return f"transform({items}, i -> coalesce(to_json(i), 'null'))"

    def read(self, first: int | None = None) -> str:
        """An array of (raw, e): the JSON and the fields of every entry."""
        parsed = (f"transform(filter({self.found(first)}, r -> startswith(r, '{{')),"
                  f" r -> struct(r AS raw, from_json(r, 'struct<{self.fields}>') AS e))")
        if self.keep != "true":
            parsed = f"filter({parsed}, x -> {over_entry('x', self.keep)})"
        if self.shape != "e":
            parsed = f"transform({parsed}, x -> struct(x.raw AS raw, {over_entry('x', self.shape)} AS e))"
        return parsed


def over_entry(x: str, sql: str) -> str:
    """SQL over ``e`` for the entry that ``x`` holds."""
    return f"get(transform(array({x}.e), e -> {sql}), 0)"


@dataclass(frozen=True)
class SourceSpec:
    """How to read one board.

    All strings are SQL.  ``entries`` is a :class:`JsonList`, or turns ``payload`` into an array; the
    other expressions see one element as ``e`` plus the landing columns
    ``board`` and ``keyword``.

    ``match``     texts searched for a keyword, ``None`` for no local search
    ``keep``      further condition on an entry
    ``first``     entries read per payload
    ``matched``   entries kept per payload, after the conditions
    ``dedup``     key of first-wins deduplication over all payloads
    ``keywords``  number of search keywords whose responses are used
    """

    name: str
    entries: str | JsonList
    fields: dict[str, str]
    match: tuple[str, ...] | None = None
    keep: str = "true"
    first: int | None = None
    matched: int | None = None
    dedup: str | None = None
    keywords: int | None = None
    extra_keywords: tuple[str, ...] = field(default=())
    source: str | None = None


# Defaults of fields a board does not give.
EMPTY_FIELDS = {
    "title": "'Unknown'", "company": "'Unknown'", "location": "'Unknown'", "description": "''",
    "url": "''", "posted": "CAST(NULL AS STRING)", "salary": "CAST(NULL AS STRING)",
    "job_type": "CAST(NULL AS STRING)",
}

# Deduplication keys over finished listings; other keys are SQL over an entry.
LISTING_KEYS = {
    "title_company": by_title_company,
    "title_company_folded": lambda: by_title_company("|", fold_case=True),
    "url": lambda: ["url"],
}


def _condition(spec: SourceSpec, keywords: Sequence[str]) -> str:
    parts = [spec.keep]
    if spec.match is not None:
        words = [*keywords, *spec.extra_keywords]
        parts.append("(" + " OR ".join(text.any_keyword_sql(m, words) for m in spec.match) + ")")
    return " AND ".join(f"({p})" for p in parts if p != "true") or "true"


def landing_of(landing: DataFrame, spec: SourceSpec, keywords: Sequence[str]) -> DataFrame:
    """Landing rows of one board; prunes partitions when ``source`` is one."""
    rows = landing.filter(F.col("source") == spec.name)
    if spec.keywords is not None:
        used = list(keywords[:spec.keywords])
        rows = rows.filter(F.col("keyword").isNull() | F.col("keyword").isin(used))
    return rows


def normalize(landing: DataFrame, spec: SourceSpec, keywords: Sequence[str],
              keep_order: bool = False) -> DataFrame:
    """Listings of one board.

    A payload that does not parse gives no rows (see :func:`quarantine`), an odd entry goes alone
    (see :func:`quarantine_entries`): one bad row never ends a batch, nor its neighbours.
    """
    condition = _condition(spec, keywords)
    rows = landing_of(landing, spec, keywords)
    if isinstance(spec.entries, JsonList):
        entries = spec.entries.read(spec.first)
        if spec.matched is not None:
            entries = f"slice(filter({entries}, x -> {over_entry('x', condition)}), 1, {spec.matched})"
        found = F.expr(f"posexplode({entries})").alias("pos", "x")
        raw, e = F.col("x.raw"), F.col("x.e")
    else:
        entries = spec.entries if spec.first is None else f"slice({spec.entries}, 1, {spec.first})"
        if spec.matched is not None:
            entries = f"slice(filter({entries}, e -> {condition}), 1, {spec.matched})"
        found = F.expr(f"posexplode({entries})").alias("pos", "x")
        raw, e = F.to_json(F.struct(F.col("x").alias("e"))), F.col("x")
    rows = rows.select("source", "board", "keyword", "ord", "fetched_at", found).select(
        "source", "board", "keyword", "ord", "fetched_at", "pos", raw.alias("raw"), e.alias("e"))
    if spec.matched is None:
        rows = rows.filter(F.expr(condition))
    values = {**EMPTY_FIELDS, **spec.fields}
    on_entry = spec.dedup is not None and spec.dedup not in LISTING_KEYS
    out = rows.select(
        "ord", "pos", "fetched_at", F.col("raw").alias("raw_data"),
        F.expr(spec.source or "source").alias("source"),
        *[F.expr(f"CAST({values[c]} AS STRING)").alias(c) for c in EMPTY_FIELDS],
        *([F.expr(spec.dedup).alias("_key")] if on_entry else []))
    out = out.withColumns({
        "title": text.clean_string(F.col("title")),
        "company": text.clean_string(F.col("company")),
        "url": text.clean_url(F.col("url")),
    })
    if spec.dedup in LISTING_KEYS:
        out = first_wins(out, LISTING_KEYS[spec.dedup](), ["ord", "pos"])
    elif spec.dedup:
        out = first_wins(out, ["_key"], ["ord", "pos"]).drop("_key")
    # no key holds the description, so it is cleaned for the rows that stay
    out = out.withColumn("description", text.clean_description(F.col("description")))
    out = out.withColumn("job_id", text.job_id(F.col("title"), F.col("company"), F.col("source")))
    columns = ["job_id", *EMPTY_FIELDS, "source", "raw_data", "fetched_at"]
    return out.select(*columns, *(["ord", "pos"] if keep_order else []))


def quarantine(landing: DataFrame, spec: SourceSpec, keywords: Sequence[str] = ()) -> DataFrame:
    """Landing rows of a board in which its spec finds no list of entries at all."""
    rows = landing_of(landing, spec, keywords)
    entries = spec.entries.found() if isinstance(spec.entries, JsonList) else spec.entries
    return rows.filter(F.col("payload").isNull() | F.expr(f"({entries}) IS NULL"))


def quarantine_entries(landing: DataFrame, spec: SourceSpec, keywords: Sequence[str] = ()) -> DataFrame:
    """(source, board, keyword, ord, fetched_at, pos, entry): list items that are no entries.

    ``pos`` counts the items from 0, without the leading ones that a board always puts there.  Pages and
    feeds have none: what their patterns do not find is no item.
    """
    rows = landing_of(landing, spec, keywords)
    items = spec.entries.found(spec.first) if isinstance(spec.entries, JsonList) else "CAST(NULL AS ARRAY<STRING>)"
    return rows.select("source", "board", "keyword", "ord", "fetched_at", F.expr(f"posexplode({items})").alias(
        "pos", "entry")).filter(~F.startswith("entry", F.lit("{")))


def ingest_errors(landing: DataFrame, run_id: str) -> DataFrame:
    """(run_id, source, error, payloads): every error of a board and how many payloads had it."""
    return landing.filter(F.col("error").isNotNull()).groupBy(
        F.lit(run_id).alias("run_id"), "source", "error").agg(F.count("*").alias("payloads"))


def ingest_log(landing: DataFrame, listings: DataFrame, run_id: str) -> DataFrame:
    """One row per board of a run: listings, time spent and first error; see :func:`ingest_errors` for all."""
    runs = landing.groupBy("source").agg(
        F.sum("duration_ms").alias("duration_ms"), F.min("error").alias("error"),
        F.count("*").alias("payloads"))
    counts = listings.groupBy("source").agg(F.count("*").alias("listings"))
    return runs.join(counts, "source", "left").select(
        F.lit(run_id).alias("run_id"), "source", "payloads",
        F.coalesce("listings", F.lit(0)).alias("listings"), "duration_ms", "error")
