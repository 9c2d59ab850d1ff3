"""SQL of the checks: the same rules written for a second engine."""

from __future__ import annotations

from boardsift import vocab
from boardsift.catalog import fixtures as fx
from boardsift.config import AgePolicy

WS = r"[\s\x0B\x1C-\x1F\x{85}\pZ]"
WORD = r"\pL\pN_"
AS_OF = f"TIMESTAMP '{fx.AS_OF}'"
STRIP_CHARS = (
    "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '"
    "||chr(133)||chr(160)||chr(5760)||"
    + "||".join(f"chr({c})" for c in range(0x2000, 0x200B))
    + "||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {STRIP_CHARS})"


def clean_string(x: str) -> str:
    text = f"coalesce(CAST({x} AS VARCHAR), 'Unknown')"
    return strip(text)


def clean_description(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g'),"
            f" '{WS}+', ' ', 'g'))")


def clean_url(x: str) -> str:
    return f"coalesce({strip(x)}, '')"


def job_id(t: str = "title", c: str = "company", s: str = "source", lower: bool = True) -> str:
    text = f"{t} || '_' || {c} || '_' || {s}"
    return f"substring(md5({f'lower({text})' if lower else text}), 1, 16)"


def any_term(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(t)})" for t in terms) + ")"


def weighted(x: str, weights: dict, kind: str = "DOUBLE") -> str:
    return "(" + " + ".join(
        f"CASE WHEN contains({x}, {q(t)}) THEN CAST({w} AS {kind}) ELSE CAST(0 AS {kind}) END"
        for t, w in weights.items()) + ")"


def match_text(x: str) -> str:
    return (f"lower(trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'),"
            rf" '[^{WORD}\-+#.]+', ' ', 'g')))")


RAW = "SELECT doc_id, source, text, " + ", ".join(
    f"{e} AS {c}" for c, e in fx.RAW_COLUMNS.items()) + " FROM documents"
LISTINGS = f"""raw AS ({RAW}),
cleaned AS (SELECT doc_id, source, {clean_string('title')} AS title,
 {clean_string('company')} AS company, location, posted, salary, job_type,
 {clean_description('description')} AS description, {clean_url('url')} AS url,
 {AS_OF} - to_hours(fetched_hours) AS fetched_at FROM raw),
listings AS (SELECT *, {job_id()} AS job_id FROM cleaned)"""


def age(policy: AgePolicy, posted: str = "posted") -> str:
    """Age in hours, by policy, as one CASE."""
    raw = strip(posted) if policy.strip_first else posted
    low = f"lower({strip(posted)})"
    inf = "'Infinity'::DOUBLE"
    num = lambda unit, empty: (
        f"coalesce(nullif(regexp_replace(split_part({low}, '{unit}', 1), '[^0-9]', '', 'g'), '')"
        f"::DOUBLE, {empty}::DOUBLE)")
    hrs = lambda ts: f"(epoch_us({AS_OF}) - epoch_us({ts}))::DOUBLE / 1e6::DOUBLE / 3600::DOUBLE"
    val = lambda x: inf if x is None else f"{x}::DOUBLE"
    day_text = f"CASE WHEN contains({raw}, 'T') THEN split_part({raw}, 'T', 1) ELSE substring({raw}, 1, 10) END"
    if not policy.iso_time:
        day_text = f"split_part({day_text}, '+', 1)"
    day = (f"CASE WHEN regexp_full_match({day_text}, '[0-9]{{4}}-(1[0-2]|0?[1-9])-(3[01]|[12][0-9]|0?[1-9])')"
           f" THEN TRY_CAST({day_text} AS TIMESTAMP) END")
    dash = f"contains({raw}, '-')"
    if policy.iso_min_length:
        dash = f"({dash} AND length({raw}) >= {policy.iso_min_length})"
    parsed = []
    if policy.iso_time:
        stamp = f"split_part(split_part(split_part({raw}, '+', 1), 'Z', 1), '.', 1)"
        parsed.append(
            f"CASE WHEN contains({raw}, 'T') AND (contains({raw}, '+') OR contains({raw}, 'Z'))"
            f" AND TRY_CAST({stamp} AS TIMESTAMP) IS NOT NULL"
            f" THEN greatest(0::DOUBLE, {hrs(f'TRY_CAST({stamp} AS TIMESTAMP)')}) END")
        cond = dash
    else:
        cond = f"(contains({raw}, 'T') OR {dash})"
    parsed.append(f"CASE WHEN {cond} AND ({day}) IS NOT NULL THEN greatest(0::DOUBLE,"
                  f" {hrs(f'({day})')} - {policy.date_shift}::DOUBLE) END")
    if policy.epoch:
        n = f"TRY_CAST({raw} AS DOUBLE)"
        if policy.epoch == "auto":
            n = f"(CASE WHEN {n} > 1e12 THEN {n} / 1000 ELSE {n} END)"
        parsed.append(
            f"CASE WHEN regexp_full_match({raw}, '[0-9]{{10,}}') AND {n} <= 253402300799"
            f" THEN greatest(0::DOUBLE, {hrs(f'to_timestamp({n})::TIMESTAMP')}) END")
    week = inf if policy.week_hours is None else f"{num('week', 1)} * {policy.week_hours}::DOUBLE"
    day_cond = "contains(%s, 'day')" % low + (f" AND contains({low}, 'ago')" if policy.day_needs_ago else "")
    return f"""CASE WHEN {raw} IS NULL OR {raw} = '' THEN {val(policy.empty)}
 WHEN {any_term(low, policy.now_words)} THEN 0::DOUBLE
 WHEN contains({low}, 'minute') THEN {num('minute', 0)} / 60
 WHEN contains({low}, 'hour') THEN {num('hour', 0)}
 WHEN contains({low}, 'today') THEN {policy.today}::DOUBLE
 WHEN contains({low}, 'yesterday') THEN 30::DOUBLE
 WHEN {day_cond} THEN {num('day', 0)} * 24
 WHEN contains({low}, 'week') THEN {week}
 WHEN {any_term(low, policy.old_words)} THEN {inf}
 ELSE coalesce({', '.join(parsed)}, {policy.unparsed}::DOUBLE) END"""


def first_of(x: str, terms_by_label: dict, default: str) -> str:
    whens = " ".join(
        f"WHEN {any_term(x, [t] if isinstance(t, str) else t)} THEN {q(label)}"
        for label, t in terms_by_label.items())
    return f"CASE {whens} ELSE {default} END"


CITY = "CASE " + " ".join(
    f"WHEN contains(place, {q(t)}) THEN {q(c)}" for t, c in vocab.CITY_BY_TERM.items()) + " END"
REMOTE = any_term("place", vocab.REMOTE_TERMS)
HOME = (f"CASE WHEN {any_term('place', vocab.HOME_TERMS)} THEN true"
        f" WHEN {REMOTE} THEN true"
        f" WHEN lower({strip('location')}) IN ({', '.join(q(b) for b in vocab.BLANK_LOCATIONS)}) THEN true"
        f" ELSE NOT {any_term('place', vocab.FOREIGN_TERMS)} END")
CATEGORY = first_of("body", vocab.CATEGORY_TERMS, "'Other'")

TEXTS = f"""{LISTINGS},
texts AS (SELECT *, lower(location || ' ' || description) AS place,
 lower(title || ' ' || description) AS body, lower(title) AS low_title,
 {match_text('title')} || ' ' || {match_text('description')} AS skill_text FROM listings)"""


def scored_sql(age_sql: str, similarity: str = "NULL::DOUBLE") -> str:
    """CTEs down to ``scored``, the reading of the 0-1 scorer."""
    return f"""{TEXTS},
flags AS (SELECT *, {HOME} AS is_india, {REMOTE} AS is_remote, {CITY} AS city,
 {CATEGORY} AS category, {age_sql} AS age_hours,
 CASE WHEN {any_term('low_title', vocab.TITLE_EXCLUDED)} THEN -0.5::DOUBLE
  WHEN NOT {any_term('low_title', vocab.TITLE_REQUIRED)} THEN -0.3::DOUBLE ELSE 0::DOUBLE END AS penalty,
 least({weighted('skill_text', vocab.SKILL_WEIGHTS)}, 1::DOUBLE) AS kw, {similarity} AS sim FROM texts),
sem AS (SELECT *, CASE WHEN length(skill_text) > 50 THEN coalesce(sim, kw * 0.8::DOUBLE)
 ELSE 0::DOUBLE END AS sem FROM flags),
summed AS (SELECT *, sem * 0.6::DOUBLE + kw * 0.4::DOUBLE AS plain FROM sem),
combined AS (SELECT *, (CASE WHEN penalty < 0 THEN greatest(0::DOUBLE, plain + penalty) ELSE plain END)
 * (CASE WHEN is_india THEN 1::DOUBLE ELSE 0.3::DOUBLE END) AS total FROM summed),
reasons AS (SELECT *, CASE WHEN NOT is_india THEN 'location' WHEN penalty < 0 THEN 'title'
 WHEN age_hours > 168 THEN 'age' WHEN total < 0.25::DOUBLE THEN 'score' END AS filter_reason FROM combined),
scored AS (SELECT *, CASE WHEN filter_reason IS NULL THEN 'detected' ELSE 'filtered' END AS status,
 round(sem, 4) AS semantic_score, round(kw, 4) AS keyword_score,
 round(total, 4) AS combined_score FROM reasons)"""


EDGE, END = rf"(?:^|[^{WORD}])", rf"(?:[^{WORD}]|$)"
_SENIOR = [rf"{EDGE}(principal|staff{WS}+engineer|architect){END}",
           rf"{EDGE}(director|vp|vice president|head of){END}",
           rf"{EDGE}((?:10\+|12\+|15\+|20\+){WS}*(?:years?|yrs?)){END}"]
_JUNIOR = [rf"{EDGE}(?:(?:(jr\.)[{WORD}])|(?:(junior|jr|entry.?level|fresher|graduate){END}))",
           rf"{EDGE}((?:0-[0-5]|[0-3]{WS}*(?:\+|to|-){WS}*[0-5]){WS}*(?:years?|yrs?)){END}",
           rf"{EDGE}(no.?experience.?required){END}", rf"{EDGE}(freshers?.?welcome){END}",
           rf"{EDGE}(early.?career){END}"]


def _hit(x: str, pattern: str, groups: int = 1) -> str:
    parts = " || ".join(f"regexp_extract({x}, {q(pattern)}, {g})" for g in range(1, groups + 1))
    return f"nullif({parts}, '')"


def experience_reason(title: str = "low_title", body: str = "body") -> str:
    senior = ", ".join(_hit(title, p) for p in _SENIOR)
    junior = ", ".join(_hit(body, p, 2 if i == 0 else 1) for i, p in enumerate(_JUNIOR))
    years = (rf"list_filter(list_transform(regexp_extract_all({body}, '([0-9]+){WS}*\+?{WS}*(?:years?|yrs?)', 1),"
             " lambda n: TRY_CAST(n AS HUGEINT)), lambda n: n >= 8)[1]")
    return (f"coalesce('Senior role: ''' || coalesce({senior}) || '''',"
            f" 'Junior-friendly: ''' || coalesce({junior}) || '''',"
            f" 'Requires ' || {years} || '+ years experience', 'No clear senior requirement found')")
