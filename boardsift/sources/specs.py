"""The boards: one spec each, and the registry to which users add their own."""

from __future__ import annotations

from dataclasses import replace

from boardsift import vocab
from boardsift.functions.text import SPACE, SPACE_CHARS, any_keyword_sql, quoted
from boardsift.sources.normalizer import JsonList, SourceSpec


def strip(x: str) -> str:
    return f"btrim({x}, {quoted(SPACE_CHARS)})"


def _at(path: str) -> str:
    return f"try_variant_get(v, '{path}', 'array<variant>')"


def _list(at: str, fields: str, **more) -> JsonList:
    """The array at path ``at`` of a JSON object payload."""
    return JsonList(_at(f"$.{at}"), fields, **more)


def _root(fields: str, **more) -> JsonList:
    return JsonList(_at("$"), fields, **more)


def _root_or(names: list[str], fields: str) -> JsonList:
    """A JSON array, or an object that holds it under one of ``names``."""
    return JsonList(f"coalesce({', '.join(map(_at, ['$', *(f'$.{n}' for n in names)]))})", fields)


def _words(x: str) -> str:
    """A list of tags as text; ``x`` is an array or NULL."""
    return f"coalesce(array_join({x}, ' '), '')"


def _listed(x: str, otherwise: str) -> str:
    """A JSON value read as text: joined when it is a list."""
    return f"IF(startswith({x}, '['), array_join(from_json({x}, 'array<string>'), ' '), {otherwise})"


def _default(x: str, value: str) -> str:
    """``value`` for a missing key; an empty value stays."""
    return f"coalesce({x}, '{value}')"


def _filled(x: str, value: str) -> str:
    """``value`` for a missing or an empty value."""
    return f"coalesce(nullif({x}, ''), {value})"


def _text(*parts: str) -> str:
    return "concat_ws(' ', " + ", ".join(f"coalesce({p}, '')" for p in parts) + ")"


def _named(x: str, field: str, otherwise: str) -> str:
    """A field of a JSON object read as text, or ``otherwise`` for other values."""
    return f"IF(startswith({x}, '{{'), coalesce(get_json_object({x}, '$.{field}'), 'Unknown'), {otherwise})"


BOARD_NAME = ("array_join(transform(regexp_extract_all(replace(board, '-', ' '), "
              "'(\\\\p{L}+|[^\\\\p{L}]+)', 1), x -> initcap(x)), '')")
BOARD_TITLE = BOARD_NAME.replace("replace(board, '-', ' ')", "board")
KEYWORD_TITLE = BOARD_TITLE.replace("board", "keyword")
TITLE_COMPANY = "concat_ws('_', title, company)"
TITLE_COMPANY_FOLDED = "concat_ws('|', lower(title), lower(company))"


def _tagged(name: str, entries: str, title: str, company: str, **more: str) -> SourceSpec:
    fields = {"title": _default(f"e.{title}", "Unknown"), "company": _default(f"e.{company}", "Unknown")}
    spec = {k: more.pop(k) for k in list(more) if k in SourceSpec.__dataclass_fields__}
    return SourceSpec(name, entries, {**fields, **more}, **spec)


# ------------------------------------------------------------ remote boards

REMOTEOK = _tagged(
    "RemoteOK", _root(
        "id string, position string, company string, location string, description string,"
        " url string, date string, salary string, tags array<string>", skip=1),
    "position", "company",
    location=_default("e.location", "Remote"), description="e.description",
    url="coalesce(e.url, concat('https://remoteok.com/jobs/', coalesce(e.id, '')))",
    posted="coalesce(e.date, '')", salary="coalesce(e.salary, '')",
    match=(_text("e.position", "e.description", _words("e.tags")),))
ARBEITNOW = _tagged(
    "Arbeitnow", _list("data", "title string, company_name string, location string,"
                       " description string, url string, created_at string, tags array<string>"),
    "title", "company_name",
    location=_default("e.location", "Unknown"), description="e.description", url="e.url",
    posted="coalesce(e.created_at, '')",
    match=(_text("e.title", "e.description", _words("e.tags")),))
HIMALAYAS = _tagged(
    "Himalayas", _list("jobs", "title string, companyName string, description string,"
                       " applicationLink string, slug string, pubDate string, salary string,"
                       " categories string, locationRestrictions array<string>"),
    "title", "companyName",
    location="coalesce(nullif(array_join(e.locationRestrictions, ', '), ''), 'Remote')",
    description="e.description",
    url=_filled("e.applicationLink", "concat('https://himalayas.app/jobs/', coalesce(e.slug, ''))"),
    posted="coalesce(e.pubDate, '')", salary="coalesce(e.salary, '')",
    match=(_text("e.title", "e.description", _listed("e.categories", "e.categories")),))
JOBICY = _tagged(
    "Jobicy", _list("jobs", "id string, jobTitle string, companyName string, jobGeo string,"
                    " jobExcerpt string, url string, pubDate string, annualSalaryMin string,"
                    " jobType string, jobIndustry string"),
    "jobTitle", "companyName",
    location=_default("e.jobGeo", "Remote"), description="e.jobExcerpt", url="e.url",
    posted="coalesce(e.pubDate, '')", salary="coalesce(e.annualSalaryMin, '')",
    job_type="coalesce(IF(startswith(e.jobType, '['), array_join(from_json(e.jobType,"
             " 'array<string>'), ', '), e.jobType), '')",
    match=(_text("e.jobTitle", "e.jobExcerpt", "e.jobIndustry"),),
    dedup="coalesce(e.id, '')")
FINDWORK = _tagged(
    "Findwork", _list("results", "id string, role string, company_name string, location string,"
                      " text string, url string, date_posted string"),
    "role", "company_name",
    location=_default("e.location", "Unknown"), description="e.text", url="e.url",
    posted="coalesce(e.date_posted, '')", dedup="coalesce(e.id, '')")
THEMUSE = SourceSpec(
    "TheMuse", _list("results", "id string, name string, contents string, company string,"
                     " locations array<struct<name string>>, refs struct<landing_page string>,"
                     " publication_date string"),
    {"title": _default("e.name", "Unknown"), "company": _named("e.company", "name", "'Unknown'"),
     "location": _default("get(e.locations, 0).name", "Unknown"), "description": "e.contents",
     "url": "e.refs.landing_page", "posted": "coalesce(e.publication_date, '')"},
    match=(_text("e.name", "e.contents"),), dedup="coalesce(e.id, '')")

_HN_FIRST = f"substring_index({strip('e.text')}, '\\n', 1)"


def _hn_title(*rules: tuple[str, str]) -> str:
    whens = " ".join(f"WHEN {cond} THEN '{title}'" for cond, title in rules)
    return f"CASE {whens} ELSE 'Tech Position' END"


def _says(word: str) -> str:
    return f"contains(lower(e.text), '{word}')"


HN_HIRING = SourceSpec(
    "HN-Hiring",
    _list("hits", "objectID string, comment_text string, created_at string", keep="length(e.comment_text) > 0",
          shape="struct(e.objectID AS id, e.created_at AS at, regexp_replace(e.comment_text, '<[^>]+>', ' ') AS text)"),
    {"title": _hn_title(
        (_says("data scientist"), "Data Scientist"), (_says("data analyst"), "Data Analyst"),
        (_says("machine learning") + " OR " + _says("ml"), "ML Engineer"),
        (_says("engineer"), "Software Engineer")),
     "company": f"CASE WHEN contains({_HN_FIRST}, '|') THEN {strip(f'''split_part({_HN_FIRST}, '|', 1)''')}"
                f" WHEN length({_HN_FIRST}) < 60 THEN {_HN_FIRST} ELSE 'HN Company' END",
     "location": "'Remote/Various'", "description": "e.text",
     "url": "concat('https://news.ycombinator.com/item?id=', coalesce(e.id, ''))",
     "posted": "coalesce(e.at, '')"},
    match=("e.text",))
WORKING_NOMADS = _tagged(
    "WorkingNomads", _root("title string, company_name string, location string, description string,"
                           " url string, pub_date string, category_name string, tags array<string>"),
    "title", "company_name",
    location=_default("e.location", "Remote"), description="e.description", url="e.url",
    posted="coalesce(e.pub_date, '')", job_type="coalesce(e.category_name, '')",
    match=("e.title", "e.category_name", _words("e.tags")))
REMOTIVE = _tagged(
    "Remotive", _list("jobs", "title string, company_name string,"
                      " candidate_required_location string, description string, url string,"
                      " publication_date string, salary string, job_type string, tags array<string>"),
    "title", "company_name",
    location=_default("e.candidate_required_location", "Remote"),
    description="e.description", url="e.url",
    posted="coalesce(e.publication_date, '')", salary="coalesce(e.salary, '')",
    job_type="coalesce(e.job_type, '')", match=("e.title", _words("e.tags")))

_CDATA = "(?d)<%s>(?:<!\\\\[CDATA\\\\[)?(.*?)(?:\\\\]\\\\]>)?</%s>"


def _rss(tag: str) -> str:
    return _CDATA % (tag, tag)


# The first closing tag ends an item or a description.  What lies before it is taken in runs that are never
# given back, which finds the same as ``.*?`` without a test of the closing tag at each character.
_ITEM = "(?s)<item>((?:[^<]++|<(?!/item>))*+)</item>"
_DESCRIPTION = ("(?s)<description>(?:<!\\\\[CDATA\\\\[)?((?:[^\\\\]<]++|\\\\](?!\\\\]></description>)|<(?!/description>))*+)"
                "(?:\\\\]\\\\]>)?</description>")
_MARKED = ("(?s)<description><!\\\\[CDATA\\\\[((?:[^\\\\]]++|\\\\](?!\\\\]></description>))*+)"
           "\\\\]\\\\]></description>")

RSS_ITEMS = (f"transform(regexp_extract_all(payload, '{_ITEM}', 1), i -> struct("
             f"i RLIKE '{_rss('title')}' AS titled, "
             f"{strip(f'''regexp_extract(i, '{_rss('title')}', 1)''')} AS title, "
             f"{strip(f'''regexp_extract(i, '{_rss('link')}', 1)''')} AS link, "
             "regexp_extract(i, '(?d)<pubDate>(.*?)</pubDate>', 1) AS at, "
             # Fixed values: the older reader takes titles and descriptions in CDATA marks only.
             "regexp_extract(i, '(?d)<title><!\\\\[CDATA\\\\[(.*?)\\\\]\\\\]></title>', 1) AS marked_title, "
             f"regexp_extract(i, '{_MARKED}', 1) AS marked, "
             f"regexp_extract(i, '{_DESCRIPTION}', 1) AS description))")
WEWORKREMOTELY = SourceSpec(
    "WWRemotely", RSS_ITEMS,
    {"title": f"IF(contains(e.title, ':'), {strip('substring(e.title, locate(chr(58), e.title) + 1)')}, e.title)",
     "company": f"IF(contains(e.title, ':'), {strip('substring_index(e.title, chr(58), 1)')}, 'Unknown')",
     "location": "'Remote'", "description": "e.description", "url": "e.link", "posted": "e.at"},
    match=("e.title", "e.description"), keep="e.titled", dedup="e.title")
JUSTREMOTE = _tagged(
    "JustRemote", _root_or(["jobs"], "title string, company string, location string,"
                           " description string, url string, date string"),
    "title", "company",
    location=_default("e.location", "Remote"), description="e.description", url="e.url",
    posted="coalesce(e.date, '')", match=("e.title",))
YC = SourceSpec(
    "YC-Jobs", _list("results[0].hits", "name string, isHiring boolean, one_liner string, location string,"
                     " slug string"),
    {"title": "concat('Data Role at ', coalesce(e.name, 'Unknown'))",
     "company": _default("e.name", "Unknown"), "location": _default("e.location", "Remote"),
     "description": "e.one_liner", "posted": "''",
     "url": "concat('https://www.ycombinator.com/companies/', coalesce(e.slug, ''))"},
    match=("e.one_liner",), keep="coalesce(e.isHiring, false)")
STARTUPJOBS = SourceSpec(
    "StartupJobs", _root_or(["jobs"], "title string, company string, location string,"
                            " description string, url string, published_at string"),
    {"title": _default("e.title", "Unknown"),
     "company": _named("e.company", "name", "coalesce(e.company, 'Unknown')"),
     "location": _default("e.location", "Remote"), "description": "e.description",
     "url": "e.url", "posted": "coalesce(e.published_at, '')"},
    match=("e.title",))
EUROPE_REMOTE = SourceSpec(
    "Europe-Remote", _root("id string, title string, company_name string, workplace_type string,"
                           " published_at string, employment_types array<struct<`from` string,"
                           " `to` string, currency string>>"),
    {"title": _default("e.title", "Unknown"), "company": _default("e.company_name", "Unknown"),
     "location": "'Remote (Europe)'", "posted": "coalesce(e.published_at, '')",
     "url": "concat('https://justjoin.it/offers/', coalesce(e.id, ''))",
     "salary": "CASE WHEN nullif(nullif(get(e.employment_types, 0).`from`, ''), '0') IS NOT NULL THEN"
               " concat(get(e.employment_types, 0).`from`, '-', coalesce(get(e.employment_types, 0).`to`, ''),"
               " ' ', coalesce(get(e.employment_types, 0).currency, '')) END"},
    match=("e.title",), keep="lower(e.workplace_type) = 'remote'")
CRYPTO = _tagged(
    "Crypto-Jobs", _root_or(["jobs"], "title string, company string, description string, url string,"
                            " apply_url string, created_at string"),
    "title", "company",
    location="'Remote (Web3)'", description="e.description",
    url="coalesce(e.url, e.apply_url, '')", posted="coalesce(e.created_at, '')",
    match=("e.title",), extra_keywords=tuple(vocab.CRYPTO_EXTRA_KEYWORDS))
LANDINGJOBS = SourceSpec(
    "LandingJobs", _root_or(["jobs", "data"], "title string, description string, skills string,"
                            " company string, company_name string, city string, location string,"
                            " url string, apply_url string, created_at string"),
    {"title": "coalesce(e.title, '')",
     "company": f"{_named('e.company', 'name', _default('e.company_name', 'Unknown'))}",
     "location": "coalesce(e.city, e.location, 'Remote')",
     "description": "concat_ws(' ', lower(coalesce(e.title, '')), lower(" + _listed("e.skills", "''") + "))",
     "url": "coalesce(e.url, e.apply_url, '')", "posted": "coalesce(e.created_at, '')"},
    match=(_text("e.title", "e.description", _listed("e.skills", "''")),))

# ------------------------------------------------------------ applicant-tracking boards


def _allowed(x: str, places: list[str]) -> str:
    return any_keyword_sql(f"coalesce({x}, '')", places)


_GH_LOCATION = _named("e.location", "name", "coalesce(e.location, '')").replace("'Unknown'", "''")
_GH = "title string, location string, absolute_url string, updated_at string"
GREENHOUSE = SourceSpec(
    "Greenhouse", _list("jobs", _GH),
    {"title": _default("e.title", "Unknown"), "company": BOARD_NAME, "location": _GH_LOCATION,
     "url": "e.absolute_url", "posted": "coalesce(e.updated_at, '')", "job_type": "''"},
    match=("e.title",), keep=_allowed(_GH_LOCATION, vocab.ATS_LOCATIONS),
    dedup="concat_ws('_', coalesce(e.title, ''), board)")
LEVER = SourceSpec(
    "Lever", _root("text string, categories struct<location string, commitment string>,"
                   " descriptionPlain string, hostedUrl string, createdAt string"),
    {"title": _default("e.text", "Unknown"), "company": BOARD_NAME,
     "location": _default("e.categories.location", "Remote"),
     "description": "e.descriptionPlain", "url": "e.hostedUrl",
     "posted": "coalesce(e.createdAt, '')", "job_type": "coalesce(e.categories.commitment, '')"},
    match=("e.text",), keep=_allowed(_default("e.categories.location", "Remote"), vocab.ATS_LOCATIONS),
    dedup="concat_ws('_', coalesce(e.text, ''), board)")
ASHBY = SourceSpec(
    "Ashby", JsonList(
        f"flatten(transform({_at('$.data.jobBoard.teams')}, t -> coalesce({_at('$.jobs').replace('(v,', '(t,')},"
        " CAST(array() AS ARRAY<VARIANT>))))", "id string, title string, employmentType string, locationName string"),
    {"title": _default("e.title", "Unknown"), "company": BOARD_NAME,
     "location": _default("e.locationName", "Remote"),
     "url": "concat('https://jobs.ashbyhq.com/', board, '/', coalesce(e.id, ''))", "posted": "''",
     "job_type": "coalesce(e.employmentType, '')"},
    match=("e.title",), keep=_allowed(_default("e.locationName", "Remote"), vocab.ATS_LOCATIONS_SHORT),
    dedup="concat_ws('_', coalesce(e.title, ''), board)")
INDIA_STARTUPS = SourceSpec(
    "India-Startups", _list("jobs", _GH),
    {"title": _default("e.title", "Unknown"), "company": BOARD_TITLE,
     "location": _filled("get_json_object(e.location, '$.name')", "'India'"),
     "url": "e.absolute_url", "posted": "coalesce(e.updated_at, '')"},
    match=("e.title",))

# ------------------------------------------------------------ Indian boards

_PLACEHOLDER = "get(filter(e.placeholders, p -> p.type = '%s'), 0)"
NAUKRI = SourceSpec(
    "Naukri", _list("jobDetails", "jobId string, title string, companyName string,"
                    " jobDescription string, jdURL string, footerPlaceholderLabel string,"
                    " placeholders array<struct<type string, label string>>"),
    {"title": _default("e.title", "Unknown"), "company": _default("e.companyName", "Unknown"),
     "location": _default(_PLACEHOLDER % "location" + ".label", "India"),
     "description": "e.jobDescription",
     "url": "concat('https://www.naukri.com', coalesce(e.jdURL, ''))",
     "posted": "coalesce(e.footerPlaceholderLabel, '')",
     "salary": "coalesce(get(e.placeholders, 0).label, '')",
     "job_type": f"coalesce({_PLACEHOLDER % 'experience'}.label, '')"},
    dedup="coalesce(e.jobId, '')")
FOUNDIT = SourceSpec(
    "Foundit", _list("jobSearchResponse.data", "jobId string, title string, companyName string,"
                     " jobDescription string, jobDetailUrl string, postedDate string,"
                     " salary string, locations array<string>"),
    {"title": _default("e.title", "Unknown"), "company": _default("e.companyName", "Unknown"),
     "location": _default("get(e.locations, 0)", "India"), "description": "e.jobDescription",
     "url": "e.jobDetailUrl", "posted": "coalesce(e.postedDate, '')",
     "salary": "coalesce(e.salary, '')"},
    dedup="coalesce(e.jobId, '')")
INSTAHYRE = SourceSpec(
    "Instahyre", _list("jobs", "title string, company struct<name string>, locations array<string>,"
                       " description string, slug string, created_at string, salary_range string"),
    {"title": _default("e.title", "Unknown"), "company": _default("e.company.name", "Unknown"),
     "location": _default("array_join(e.locations, ', ')", "India"), "description": "e.description",
     "url": "concat('https://www.instahyre.com/job/', coalesce(e.slug, ''))",
     "posted": "coalesce(e.created_at, '')", "salary": "coalesce(e.salary_range, '')"})
CUTSHORT = SourceSpec(
    "Cutshort", _root_or(["jobs"], "id string, title string, company string, location string,"
                         " description string, url string, posted_at string, salary string"),
    {"title": _default("e.title", "Unknown"), "company": _named("e.company", "name", "'Unknown'"),
     "location": _default("e.location", "India"), "description": "e.description",
     "url": "coalesce(e.url, concat('https://cutshort.io/job/', coalesce(e.id, '')))",
     "posted": "coalesce(e.posted_at, '')", "salary": "coalesce(e.salary, '')"})
HIRIST = SourceSpec(
    "Hirist", _root_or(["data", "jobs"], "title string, designation string, company string,"
                       " company_name string, location string, description string,"
                       " job_description string, url string, apply_url string, posted_date string"),
    {"title": "coalesce(e.title, e.designation, 'Unknown')",
     "company": "coalesce(e.company, e.company_name, 'Unknown')",
     "location": _default("e.location", "India"),
     "description": "coalesce(e.description, e.job_description, '')",
     "url": "coalesce(e.url, e.apply_url, '')", "posted": "coalesce(e.posted_date, '')"})


def _hrefs(url: str, title: str) -> str:
    """Links and titles of a page, paired by position; ``0`` is the link."""
    return (f"arrays_zip(regexp_extract_all(payload, '{url}', 1), "
            f"regexp_extract_all(payload, '{title}', 1))")


_POSITION = "coalesce(e.`1`, concat(keyword, ' position'))"
LINKEDIN = SourceSpec(
    "LinkedIn", _hrefs('href="(https://www\\\\.linkedin\\\\.com/jobs/view/[^"]+)"',
                       '<span class="sr-only">([^<]+)</span>'),
    {"title": _POSITION, "company": "'LinkedIn Listing'", "location": "'India'",
     "description": _POSITION, "url": "substring_index(e.`0`, '?', 1)", "posted": "'Recent'"},
    keep="e.`0` IS NOT NULL")
NAUKRI_INDEX = SourceSpec(
    "Naukri-Index", _hrefs('href="(https?://www\\\\.naukri\\\\.com/job-listings[^"]+)"',
                           '<a[^>]*href="https?://www\\\\.naukri\\\\.com/job-listings[^"]*"[^>]*>([^<]+)</a>'),
    {"title": f"{strip(_POSITION)}", "company": "'Naukri Listing'", "location": "'India'",
     "description": strip(_POSITION), "url": "e.`0`", "posted": "''"},
    keep="e.`0` IS NOT NULL", dedup="url")
GOOGLE_JOBS = SourceSpec(
    "Google-Jobs", _list("jobs_results", "title string, company_name string, location string,"
                         " description string, share_link string,"
                         " apply_options array<struct<link string>>, detected_extensions"
                         " struct<posted_at string, schedule_type string, salary string>"),
    {"title": _default("e.title", "Unknown"), "company": _default("e.company_name", "Unknown"),
     "location": _default("e.location", "India"), "description": "e.description",
     "url": "IF(size(e.apply_options) > 0, coalesce(get(e.apply_options, 0).link, ''),"
            " coalesce(e.share_link, ''))",
     "posted": "coalesce(e.detected_extensions.posted_at, '')",
     "salary": "coalesce(e.detected_extensions.salary, '')",
     "job_type": "coalesce(e.detected_extensions.schedule_type, '')"}, dedup="title_company_folded")
ADZUNA = SourceSpec(
    "Adzuna-India", _list("results", "title string, company struct<display_name string>,"
                          " location struct<display_name string>, description string,"
                          " redirect_url string, created string, salary_min string,"
                          " contract_type string"),
    {"title": _default("e.title", "Unknown"), "company": _default("e.company.display_name", "Unknown"),
     "location": _default("e.location.display_name", "India"),
     "description": "e.description", "url": "e.redirect_url",
     "posted": "coalesce(e.created, '')", "salary": "coalesce(e.salary_min, '')",
     "job_type": "coalesce(e.contract_type, '')"},
    dedup="title_company_folded")
_CARD_TITLE, _CARD_COMPANY = _default("e.title", "Unknown"), _default("e.company", "Unknown")
INDEED = SourceSpec(
    "Indeed-India", _list("cards", "title string, company string, location string, date string,"
                          " href string"),
    {"title": f"{_CARD_TITLE}", "company": f"{_filled('e.company', chr(39) + 'Unknown' + chr(39))}",
     "location": _default("e.location", "India"),
     "description": f"concat({_CARD_TITLE}, ' at ', {_CARD_COMPANY})",
     "url": "CASE WHEN length(e.href) > 0 AND NOT startswith(e.href, 'http') THEN"
            " concat('https://in.indeed.com', e.href) ELSE coalesce(e.href, '') END",
     "posted": _default("e.date", "Today")},
    keep=f"{_CARD_TITLE} <> 'Unknown'",
    dedup=f"concat_ws('_', {_CARD_TITLE}, {_CARD_COMPANY})")

# ------------------------------------------------------------ search-engine results

_BING = ('(?s)<li class="b_algo"[^>]*>.*?<h2><a href="([^"]+)"[^>]*>([^<]+)</a>.*?'
         '<p[^>]*>([^<]*)</p>')


def _groups(pattern: str, names: list[str]) -> str:
    """All hits of a pattern; each hit is split into its groups."""
    fields = ", ".join(f"regexp_extract(m, '{pattern}', {i + 1}) AS {n}" for i, n in enumerate(names))
    return f"transform(regexp_extract_all(payload, '{pattern}', 0), m -> struct({fields}))"


_BING_TITLE = strip("e.title")
BING = SourceSpec(
    "BingSearch", _groups(_BING, ["url", "title", "snippet"]),
    {"title": f"CASE WHEN contains({_BING_TITLE}, ' at ') THEN {strip(f'''split_part({_BING_TITLE}, ' at ', 1)''')}"
              f" ELSE {strip(f'''split_part({_BING_TITLE}, ' - ', 1)''')} END",
     "company": f"CASE WHEN contains({_BING_TITLE}, ' at ') THEN {strip(f'''split_part({_BING_TITLE}, ' at ', 2)''')}"
                f" WHEN contains({_BING_TITLE}, ' - ') THEN {strip(f'''split_part({_BING_TITLE}, ' - ', 2)''')}"
                " ELSE 'Unknown' END",
     "location": "'India'", "description": f"{strip('e.snippet')}", "url": "e.url",
     "posted": "''"},
    keep="contains(lower(e.url), 'job')", dedup="title_company",
    source="concat('Bing→', board)")
_DDG = ('(?s)<a[^>]*class="result__url"[^>]*href="([^"]+)"[^>]*>.*?<a[^>]*class="result__a"[^>]*>'
        '([^<]+)</a>.*?<a[^>]*class="result__snippet"[^>]*>([^<]*)</a>')
_DDG_LINK = 'href="//duckduckgo\\\\.com/l/\\\\?uddg=([^&]+)[^"]*"[^>]*>([^<]+)</a>'
_SITES = " OR ".join(f"contains(lower(e.url), '{s}')" for s in vocab.KNOWN_SITES)
DUCKDUCKGO = SourceSpec(
    "DuckDuckGo",
    # Full results when the page has them, else its redirect links.
    f"IF(payload RLIKE '{_DDG}', {_groups(_DDG, ['url', 'title'])}, "
    f"transform({_groups(_DDG_LINK, ['url', 'title'])}, "
    "l -> struct(coalesce(try_url_decode(l.url), l.url) AS url, l.title AS title)))",
    {"title": "e.title", "location": "'India'", "description": "e.title", "url": "e.url",
     "posted": "''"},
    keep=_SITES, dedup="url")
_NG_TITLE = (f"regexp_replace(regexp_replace(coalesce(e.title, ''), '(?d){SPACE}*-{SPACE}*Naukri\\\\.com.*$', ''),"
             f" '(?d){SPACE}*\\\\|.*$', '')").replace(SPACE, SPACE.replace("\\", "\\\\"))
_NG_SPLIT = f"{_NG_TITLE} RLIKE '(?s)^.* - .*$' AND length(regexp_extract({_NG_TITLE}, '(?s)^(.*) - (.*)$', 2)) < 40"
NAUKRI_GOOGLE = SourceSpec(
    "Naukri-Google", _list("organic_results", "link string, title string, snippet string"),
    {"title": f"IF({_NG_SPLIT}, {strip(f'''regexp_extract({_NG_TITLE}, '(?s)^(.*) - (.*)$', 1)''')}, {_NG_TITLE})",
     "company": f"IF({_NG_SPLIT}, {strip(f'''regexp_extract({_NG_TITLE}, '(?s)^(.*) - (.*)$', 2)''')}, 'Naukri Listing')",
     "location": "'India'", "description": "e.snippet", "url": "e.link",
     "posted": "'Recent'"},
    keep="contains(e.link, 'naukri.com')")
GITHUB = SourceSpec(
    "GitHub-Jobs", _list("items", "path string, html_url string, repository struct<full_name string>"),
    {"title": f"concat({KEYWORD_TITLE}, ' position')",
     "company": _default("e.repository.full_name", "GitHub Listing"),
     "location": "'Remote/Various'", "posted": "''",
     "description": "concat('Job listing found on GitHub: ', coalesce(e.path, ''))",
     "url": "e.html_url"}, dedup="url")

SPECS: dict[str, SourceSpec] = {s.name: s for s in (
    REMOTEOK, ARBEITNOW, HIMALAYAS, JOBICY, FINDWORK, THEMUSE, HN_HIRING, NAUKRI, FOUNDIT,
    INSTAHYRE, CUTSHORT, HIRIST, LINKEDIN, GOOGLE_JOBS, GREENHOUSE, LEVER, WORKING_NOMADS,
    REMOTIVE, WEWORKREMOTELY, JUSTREMOTE, YC, STARTUPJOBS, ASHBY, EUROPE_REMOTE, CRYPTO,
    INDIA_STARTUPS, ADZUNA, INDEED, BING, DUCKDUCKGO, NAUKRI_GOOGLE, NAUKRI_INDEX, LANDINGJOBS,
    GITHUB)}


def register(spec: SourceSpec) -> SourceSpec:
    """Add a board, or replace one of the same name."""
    SPECS[spec.name] = spec
    return spec


def _v1(spec: SourceSpec, fields: dict[str, str] | None = None, **changes) -> SourceSpec:
    return replace(spec, fields={**spec.fields, **(fields or {})}, **changes)


def _short(spec: SourceSpec) -> dict[str, str]:
    return {"description": f"{spec.fields['description']}"}


# The older reading of boards that both generations know.
SPECS_V1: dict[str, SourceSpec] = {s.name: s for s in (
    _v1(REMOTEOK, {**_short(REMOTEOK), "url": "coalesce(e.url, 'https://remoteok.com')"}),
    _v1(ARBEITNOW, _short(ARBEITNOW)),
    _v1(HIMALAYAS, _short(HIMALAYAS)),
    _v1(JOBICY, _short(JOBICY), dedup="title_company"),
    _v1(FINDWORK, _short(FINDWORK), dedup="title_company"),
    _v1(THEMUSE, _short(THEMUSE), dedup="title_company"),
    _v1(WEWORKREMOTELY, {
        "title": f"IF(contains(e.marked_title, ':'), {strip('substring(e.marked_title, locate(chr(58), e.marked_title) + 1)')},"
                 " e.marked_title)",
        "company": f"IF(contains(e.marked_title, ':'), {strip('substring_index(e.marked_title, chr(58), 1)')}, 'Unknown')",
        "description": "regexp_replace(e.marked, '<[^>]+>', '')"},
        match=("e.marked_title",), keep="e.marked_title <> ''", dedup="title_company"),
    _v1(HN_HIRING, {
        "title": _hn_title(
            (_says("engineer"), "Software Engineer"), (_says("data scientist"), "Data Scientist"),
            (_says("analyst"), "Data Analyst"),
            (_says("ml") + " OR " + _says("machine learning"), "ML Engineer"),
            (_says("python"), "Python Developer")),
        "description": "e.text"}),
    _v1(GOOGLE_JOBS, {"title": "coalesce(e.title, '')",
                      "company": f"{_default('e.company_name', 'Unknown')}",
                      "description": "e.description"}, dedup=None),
    _v1(INDEED, {"posted": _default("e.date", "today")}, dedup="title_company"),
)}
