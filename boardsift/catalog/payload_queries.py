"""Normaliser queries: payloads built by Spark from ``documents``, one response
per document with a varying number of entries, and the expected listings
computed from ``documents`` directly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift import vocab
from boardsift.catalog import duck
from boardsift.catalog.duck import any_term, q
from boardsift.catalog.fixtures import AS_OF, documents
from boardsift.config import all_search_keywords
from boardsift.sources.normalizer import ingest_errors, ingest_log, normalize, quarantine, quarantine_entries
from boardsift.sources.specs import SPECS, SPECS_V1
from boardsift.sources.threads import pick_thread

QUERIES: dict = {}
ORACLES: dict = {}
KEYWORDS = all_search_keywords()
COLUMNS = ["job_id", "title", "company", "location", "description", "url", "source", "posted",
           "salary", "job_type"]

# Attributes of entry ``i`` of document ``doc_id``, in SQL both engines read.
ENTRY = {
    "t": """CASE WHEN (doc_id + i) % 29 = 0 THEN NULL ELSE CASE (doc_id + i * 3) % 12
 WHEN 0 THEN 'Data Scientist' WHEN 1 THEN 'Office Clerk' WHEN 2 THEN 'Senior SQL Analyst'
 WHEN 3 THEN ' Python Developer ' WHEN 4 THEN 'Chef: Pastry' WHEN 5 THEN 'Tableau Lead'
 WHEN 6 THEN 'Analytics Engineer - Core' WHEN 7 THEN 'Driver' WHEN 8 THEN 'Head at Data'
 WHEN 9 THEN 'Nurse' WHEN 10 THEN 'ETL Developer' ELSE 'Clown' END END""",
    "c": "CASE WHEN (doc_id + i) % 17 = 0 THEN NULL ELSE concat('Firm ', CAST(floor((doc_id + i) / 3) AS BIGINT)) END",
    "l": """CASE (doc_id + i) % 7 WHEN 0 THEN 'Pune' WHEN 1 THEN 'Remote' WHEN 2 THEN 'London'
 WHEN 3 THEN 'Bangalore' WHEN 4 THEN NULL WHEN 5 THEN '' ELSE 'Berlin' END""",
    "d": "CASE WHEN i = 0 THEN text WHEN i % 3 = 1 THEN concat('<b>Role</b>  of', chr(10), 'level ', i, ' with python') ELSE NULL END",
    "u": "CASE WHEN (doc_id + i) % 13 = 0 THEN NULL ELSE concat('https://x.example/job/', doc_id, '/', i, '?r=1') END",
    "p": "CASE WHEN (doc_id + i) % 5 = 0 THEN NULL ELSE concat((doc_id + i) % 9, ' days ago') END",
    "s": "CASE WHEN (doc_id + i) % 4 = 0 THEN NULL ELSE (doc_id + i) % 90 * 1000 END",
    "id": "CASE WHEN (doc_id + i) % 31 = 0 THEN NULL ELSE CAST(floor((doc_id * 2 + i) / 3) AS BIGINT) END",
    "odd": "(doc_id + i) % 2 = 1",
}
TAGS = {True: "array('sql', 'remote')", False: "array('food')"}
TAG_TEXT = "CASE WHEN odd THEN 'sql remote' ELSE 'food' END"
_WORDS = [KEYWORDS[i] for i in (0, 1, 2, 3, 20)]
KEYWORD = "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN {q(w)}" for i, w in enumerate(_WORDS)) + " END"
BOARD = "CASE doc_id % 4 WHEN 0 THEN 'acme-labs' WHEN 1 THEN '1password' WHEN 2 THEN 'dbt-labs' ELSE concat('firm-', doc_id % 50) END"
BOARD_SHOWN = "CASE doc_id % 4 WHEN 0 THEN 'Acme Labs' WHEN 1 THEN '1Password' WHEN 2 THEN 'Dbt Labs' ELSE concat('Firm ', doc_id % 50) END"
BOARD_TITLED = "CASE doc_id % 4 WHEN 0 THEN 'Acme-Labs' WHEN 1 THEN '1Password' WHEN 2 THEN 'Dbt-Labs' ELSE concat('Firm-', doc_id % 50) END"


def entries(m: int, fields: str) -> str:
    """Spark SQL of the entry array of a document; ``fields`` uses ENTRY names."""
    named = ", ".join(f"{v} AS {k}" for k, v in ENTRY.items())
    return (f"transform(transform(sequence(0, CAST(doc_id % {m} AS INT)), i -> struct(i, {named})),"
            f" v -> named_struct({fields}))")


def fields_of(spec: str) -> str:
    """``title=t company=c`` -> named_struct arguments over the entry ``v``."""
    pairs = [p.split("=", 1) for p in spec.split()]
    return ", ".join(f"'{k}', v.{x}" for k, x in pairs)


def landing(spark: SparkSession, sf_dir: str, source: str, payload: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select(
        F.lit(source).alias("source"), F.expr(BOARD).alias("board"), F.expr(KEYWORD).alias("keyword"),
        F.col("doc_id").alias("ord"), F.lit(AS_OF).cast("timestamp").alias("fetched_at"),
        F.expr(payload).alias("payload"))


def oracle(m: int, values: dict[str, str], where: str = "true", first: int | None = None,
           matched: int | None = None, key: str | None = None, words: int | None = None,
           name: str = "", raw_key: str | None = None) -> str:
    shown = {"title": "coalesce(t, 'Unknown')", "company": "coalesce(c, 'Unknown')",
             "location": "coalesce(l, 'Remote')", "description": "d", "url": "u",
             "posted": "coalesce(p, '')", "salary": "NULL::VARCHAR", "job_type": "NULL::VARCHAR",
             "source": q(name)}
    shown.update(values)
    named = ", ".join(f"{v} AS {k}" for k, v in ENTRY.items())
    used = ", ".join(q(w) for w in KEYWORDS[:words]) if words else ""
    return f"""WITH ent AS (SELECT *, unnest(range(0, 1 + doc_id % {m})) AS i FROM
 (SELECT doc_id, text, {KEYWORD} AS keyword, {BOARD} AS board FROM documents)
 {f'WHERE keyword IN ({used})' if words else ''}),
f AS (SELECT doc_id, i, text, keyword, board, {named} FROM ent {f'WHERE i < {first}' if first else ''}),
m AS (SELECT * FROM f WHERE {where}
 {f'QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= {matched}' if matched else ''}),
r AS (SELECT doc_id, i, {raw_key or 'NULL'} AS raw_key, {', '.join(f'{v} AS {k}' for k, v in shown.items())} FROM m),
o AS (SELECT doc_id, i, raw_key, {duck.clean_string('title')} AS title, {duck.clean_string('company')} AS company,
 location, {duck.clean_description('description')} AS description, {duck.clean_url('url')} AS url,
 source, posted, CAST(salary AS VARCHAR) AS salary, job_type FROM r)
SELECT {duck.job_id()} AS job_id, {', '.join(COLUMNS[1:])} FROM o
{f'QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY doc_id, i) = 1' if key else ''}"""


def has(*texts: str, words=tuple(KEYWORDS)) -> str:
    return "(" + " OR ".join(any_term(f"lower({t})", words) for t in texts) + ")"


def both(*parts: str) -> str:
    return " || ' ' || ".join(f"coalesce({p}, '')" for p in parts)


def case(spec, payload: str, m: int, values: dict | None = None, prefix: str = "normalize_", **kw):
    name = prefix + spec.name.lower().replace("-", "_")

    def run(spark, sf_dir):
        return normalize(landing(spark, sf_dir, spec.name, payload), spec, KEYWORDS).select(*COLUMNS)

    QUERIES[name] = run
    ORACLES[name] = oracle(m, values or {}, name=spec.name, **kw)


def obj(path: str, array: str) -> str:
    for p in reversed(path.split(".")):
        array = f"named_struct('{p}', {array})"
    return f"to_json({array})"


def root(array: str) -> str:
    return f"to_json({array})"


def either(path: str, array: str) -> str:
    """Half of the payloads are objects, half plain arrays."""
    return f"IF(doc_id % 2 = 0, {obj(path, array)}, {root(array)})"


S = SPECS
_SAL = "coalesce(CAST(s AS VARCHAR), '')"
_tags = ", 'tags', IF(v.odd, array('sql', 'remote'), array('food'))"
_remoteok = entries(4, fields_of("id=id position=t company=c location=l description=d url=u date=p salary=s") + _tags)
_remoteok = f"concat('[{{\"legal\":\"info\"}},', substring({root(_remoteok)}, 2))"
case(S["RemoteOK"], _remoteok, 4,
     {"url": "coalesce(u, concat('https://remoteok.com/jobs/', coalesce(CAST(id AS VARCHAR), '')))", "salary": _SAL},
     where=has(both("t", "d", TAG_TEXT)))
_arbeit = obj("data", entries(4, fields_of("title=t company_name=c location=l description=d url=u created_at=p") + _tags))
case(S["Arbeitnow"], _arbeit, 4, {"location": "coalesce(l, 'Unknown')"}, where=has(both("t", "d", TAG_TEXT)))
_himal = obj("jobs", entries(4, fields_of("title=t companyName=c description=d applicationLink=u slug=id pubDate=p salary=s")
             + ", 'categories', v.t, 'locationRestrictions', IF(v.l IS NULL, NULL, array(v.l, 'EU'))"))
_himal_list = obj("jobs", entries(4, fields_of("title=t companyName=c description=d applicationLink=u slug=id pubDate=p salary=s")
                  + ", 'categories', array('sql', 'remote'), 'locationRestrictions', IF(v.l IS NULL, NULL, array(v.l, 'EU'))"))
case(S["Himalayas"], f"IF(doc_id % 2 = 0, {_himal}, {_himal_list})", 4,
     {"location": "CASE WHEN l IS NULL THEN 'Remote' ELSE l || ', EU' END", "salary": _SAL,
      "url": "coalesce(u, concat('https://himalayas.app/jobs/', coalesce(CAST(id AS VARCHAR), '')))"},
     where=has(both("t", "d", "CASE WHEN doc_id % 2 = 0 THEN t ELSE 'sql remote' END")))
_jobicy = obj("jobs", entries(4, fields_of("id=id jobTitle=t companyName=c jobGeo=l jobExcerpt=d url=u pubDate=p annualSalaryMin=s")
              + ", 'jobType', array('full', 'part'), 'jobIndustry', 'food'"))
case(S["Jobicy"], _jobicy, 4, {"salary": _SAL, "job_type": "'full, part'"},
     where=has(both("t", "d", "'food'")), raw_key="id", key="raw_key")
_findwork = obj("results", entries(4, fields_of("id=id role=t company_name=c location=l text=d url=u date_posted=p")))
case(S["Findwork"], _findwork, 4, {"location": "coalesce(l, 'Unknown')"}, raw_key="id", key="raw_key")
_MUSE_ENTRY = (fields_of("id=id name=t contents=d publication_date=p") + ", 'locations', IF(v.l = '', array(),"
               " array(named_struct('name', v.l))), 'refs', named_struct('landing_page', v.u), 'company', ")
_muse = (f"IF(doc_id % 2 = 1, {obj('results', entries(4, _MUSE_ENTRY + 'named_struct(' + q('name') + ', v.c)'))},"
         f" {obj('results', entries(4, _MUSE_ENTRY + 'v.c'))})")
case(S["TheMuse"], _muse, 4,
     {"company": "CASE WHEN doc_id % 2 = 1 THEN coalesce(c, 'Unknown') ELSE 'Unknown' END",
      "location": "CASE WHEN l = '' THEN 'Unknown' ELSE coalesce(l, 'Unknown') END"},
     where=has(both("t", "d")), raw_key="id", key="raw_key")
_HN_TEXT = "CASE WHEN i = 0 THEN text WHEN i % 3 = 1 THEN concat('Acme ', i, ' | Pune<p>python') WHEN i % 3 = 2 THEN concat('Plain ', i, chr(10), 'data scientist') ELSE '' END"
_hn = obj("hits", entries(31, "'objectID', CAST(v.i AS STRING), 'created_at', v.p, 'comment_text', CASE WHEN v.i = 0 THEN text"
                              " WHEN v.i % 3 = 1 THEN concat('Acme ', v.i, ' | Pune<p>python') WHEN v.i % 3 = 2 THEN"
                              " concat('Plain ', v.i, chr(10), 'data scientist') ELSE '' END"))
_X = f"regexp_replace({_HN_TEXT}, '<[^>]+>', ' ', 'g')"
_LOW = f"lower({_X})"
_FIRST = f"split_part({duck.strip(_X)}, chr(10), 1)"
_HN_COMMON = {
    "company": f"CASE WHEN contains({_FIRST}, '|') THEN {duck.strip(f'split_part({_FIRST}, chr(124), 1)')}"
               f" WHEN length({_FIRST}) < 60 THEN {_FIRST} ELSE 'HN Company' END",
    "location": "'Remote/Various'", "url": "concat('https://news.ycombinator.com/item?id=', i)"}
case(S["HN-Hiring"], _hn, 31,
     {**_HN_COMMON, "description": f"{_X}",
      "title": f"CASE WHEN contains({_LOW}, 'data scientist') THEN 'Data Scientist' WHEN contains({_LOW}, 'data analyst') THEN 'Data Analyst'"
               f" WHEN contains({_LOW}, 'machine learning') OR contains({_LOW}, 'ml') THEN 'ML Engineer'"
               f" WHEN contains({_LOW}, 'engineer') THEN 'Software Engineer' ELSE 'Tech Position' END"},
     where=f"{_HN_TEXT} <> '' AND {has(_X)}")
_naukri = obj("jobDetails", entries(4, fields_of("jobId=id title=t companyName=c jobDescription=d jdURL=u footerPlaceholderLabel=p")
              + ", 'placeholders', IF(v.odd, array(named_struct('type', 'experience', 'label', '2-5 Yrs'),"
                " named_struct('type', 'location', 'label', v.l)), array(named_struct('type', 'salary', 'label', '9 LPA')))"))
case(S["Naukri"], _naukri, 4,
     {"location": "CASE WHEN odd THEN coalesce(l, 'India') ELSE 'India' END",
      "url": "'https://www.naukri.com' || coalesce(u, '')", "salary": "CASE WHEN odd THEN '2-5 Yrs' ELSE '9 LPA' END",
      "job_type": "CASE WHEN odd THEN '2-5 Yrs' ELSE '' END"}, raw_key="id", key="raw_key")
_foundit = obj("jobSearchResponse.data", entries(4, fields_of("jobId=id title=t companyName=c jobDescription=d jobDetailUrl=u postedDate=p salary=s")
               + ", 'locations', IF(v.l IS NULL, array(), array(v.l, 'Pune'))"))
case(S["Foundit"], _foundit, 4, {"location": "coalesce(l, 'India')", "salary": _SAL}, raw_key="id", key="raw_key")
_insta = obj("jobs", entries(4, fields_of("title=t description=d slug=id created_at=p salary_range=s")
             + ", 'company', named_struct('name', v.c), 'locations', IF(v.l IS NULL, NULL, array(v.l, 'Pune'))"))
case(S["Instahyre"], _insta, 4,
     {"location": "CASE WHEN l IS NULL THEN 'India' ELSE l || ', Pune' END", "salary": _SAL,
      "url": "'https://www.instahyre.com/job/' || coalesce(CAST(id AS VARCHAR), '')"})
_cut = either("jobs", entries(61, fields_of("id=id title=t location=l description=d url=u posted_at=p salary=s")
              + ", 'company', named_struct('name', v.c)"))
case(S["Cutshort"], _cut, 61, {
    "location": "coalesce(l, 'India')", "salary": _SAL,
    "url": "coalesce(u, 'https://cutshort.io/job/' || coalesce(CAST(id AS VARCHAR), ''))"})
_hirist = (f"IF(doc_id % 2 = 0, {obj('data', entries(4, fields_of('title=t company=c location=l description=d url=u posted_date=p')))},"
           f" {obj('jobs', entries(4, fields_of('designation=t company_name=c location=l job_description=d apply_url=u posted_date=p')))})")
case(S["Hirist"], _hirist, 4, {"location": "coalesce(l, 'India')"})


def _page(link: str, title: str, titles: str = "v -> v.i < 12") -> str:
    arr = entries(31, fields_of("i=i t=t"))
    return (f"concat(array_join(transform({arr}, v -> concat('{link}')), ' '),"
            f" array_join(transform(filter({arr}, {titles}), v -> concat('{title}')), ' '))")


case(S["LinkedIn"], _page("<a href=\"https://www.linkedin.com/jobs/view/', doc_id, '-', v.i, '?trk=x\">", "<span class=\"sr-only\">', coalesce(v.t, 'x'), '</span>"), 31,
     {"title": "CASE WHEN i < 12 THEN coalesce(t, 'x') ELSE keyword || ' position' END", "company": "'LinkedIn Listing'",
      "location": "'India'", "description": "CASE WHEN i < 12 THEN coalesce(t, 'x') ELSE keyword || ' position' END",
      "url": "'https://www.linkedin.com/jobs/view/' || doc_id || '-' || i", "posted": "'Recent'"})
_ni_title = duck.strip("coalesce(t, 'x')")
case(S["Naukri-Index"], f"array_join(transform({entries(31, fields_of('i=i t=t'))}, v -> concat('<a class=\"r\" href=\"https://www.naukri.com/job-listings-', doc_id, '-', v.i % 7, '\">', coalesce(v.t, 'x'), '</a>')), ' ')", 31,
     {"title": f"{_ni_title}", "company": "'Naukri Listing'", "location": "'India'", "description": _ni_title,
      "url": "'https://www.naukri.com/job-listings-' || doc_id || '-' || (i % 7)", "posted": "''"}, key="url")
_google = obj("jobs_results", entries(31, fields_of("title=t company_name=c location=l description=d share_link=u")
              + ", 'apply_options', IF(v.odd, array(named_struct('link', concat('https://apply.example/', v.i))), array()),"
                " 'detected_extensions', named_struct('posted_at', v.p, 'schedule_type', 'Full-time', 'salary', v.s)"))
_G = {"location": "coalesce(l, 'India')", "description": "d", "salary": _SAL, "job_type": "'Full-time'",
      "url": "CASE WHEN odd THEN 'https://apply.example/' || i ELSE coalesce(u, '') END"}
_FOLDED = "lower(title) || '|' || lower(company)"
case(S["Google-Jobs"], _google, 31, _G, key=_FOLDED)
_gh = obj("jobs", entries(4, fields_of("title=t absolute_url=u updated_at=p") + ", 'location', named_struct('name', v.l)"))
_gh_text = obj("jobs", entries(4, fields_of("title=t location=l absolute_url=u updated_at=p")))


def allowed(place: str, places: list[str]) -> str:
    return any_term(f"lower({place})", places)


case(S["Greenhouse"], f"IF(doc_id % 3 = 0, {_gh_text}, {_gh})", 4,
     {"company": BOARD_SHOWN, "location": "coalesce(l, '')", "description": "NULL", "job_type": "''"},
     where=f"{has('t')} AND " + allowed("coalesce(l, '')", vocab.ATS_LOCATIONS), raw_key="coalesce(t, '') || '_' || board", key="raw_key")
_lever = root(entries(4, fields_of("text=t descriptionPlain=d hostedUrl=u createdAt=s") + ", 'categories', named_struct('location', v.l, 'commitment', 'Full')"))
case(S["Lever"], _lever, 4,
     {"company": BOARD_SHOWN, "description": "d", "posted": _SAL, "job_type": "'Full'"},
     where=f"{has('t')} AND " + allowed("coalesce(l, 'Remote')", vocab.ATS_LOCATIONS),
     raw_key="coalesce(t, '') || '_' || board", key="raw_key")
_ashby_jobs = entries(4, fields_of("id=id title=t locationName=l") + ", 'employmentType', 'FullTime'")
_ashby = obj("data.jobBoard.teams", f"array(named_struct('jobs', {_ashby_jobs}),"
             f" named_struct('jobs', slice({_ashby_jobs}, 1, 0)))")
case(S["Ashby"], _ashby, 4,
     {"company": BOARD_SHOWN, "description": "NULL", "posted": "''", "job_type": "'FullTime'",
      "url": "'https://jobs.ashbyhq.com/' || board || '/' || coalesce(CAST(id AS VARCHAR), '')"},
     where=f"{has('t')} AND " + allowed("coalesce(l, 'Remote')", vocab.ATS_LOCATIONS_SHORT),
     raw_key="coalesce(t, '') || '_' || board", key="raw_key")
case(S["India-Startups"], _gh, 4,
     {"company": BOARD_TITLED, "location": "coalesce(nullif(l, ''), 'India')", "description": "NULL"}, where=has("t"))
_nomads = root(entries(4, fields_of("title=t company_name=c location=l description=d url=u pub_date=p") + ", 'category_name', 'Kitchen'" + _tags))
case(S["WorkingNomads"], _nomads, 4, {"description": "d", "job_type": "'Kitchen'"},
     where=has("t", "'Kitchen'", TAG_TEXT))
_remotive = obj("jobs", entries(4, fields_of("title=t company_name=c candidate_required_location=l description=d url=u publication_date=p salary=s job_type=p") + _tags))
case(S["Remotive"], _remotive, 4, {"description": "d", "salary": _SAL, "job_type": "coalesce(p, '')"},
     where=has("t", TAG_TEXT))
_rss = ("concat('<rss><channel>', array_join(transform(" + entries(41, fields_of("i=i t=t c=c u=u p=p d=d"))
        + ", v -> concat('<item>', CASE WHEN v.t IS NULL THEN '' WHEN v.i % 2 = 0 THEN concat('<title><![CDATA[', coalesce(concat(v.c, ': '), ''), v.t, ']]></title>')"
          " ELSE concat('<title>', v.t, '</title>') END, coalesce(concat('<link>', v.u, '</link>'), ''), coalesce(concat('<pubDate>', v.p, '</pubDate>'), ''),"
          " coalesce(concat('<description><![CDATA[', v.d, ']]></description>'), ''), '</item>')), chr(10)), '</channel></rss>')")
_RT = duck.strip("CASE WHEN i % 2 = 0 THEN coalesce(c || ': ', '') || t ELSE t END")
_RD = "coalesce(d, '')"
_WWR = {"location": "'Remote'", "url": "coalesce(u, '')", "posted": "coalesce(p, '')", "description": _RD,
        "title": f"CASE WHEN contains({_RT}, ':') THEN {duck.strip(f'substring({_RT}, instr({_RT}, chr(58)) + 1)')} ELSE {_RT} END",
        "company": f"CASE WHEN contains({_RT}, ':') THEN {duck.strip(f'split_part({_RT}, chr(58), 1)')} ELSE 'Unknown' END"}
case(S["WWRemotely"], _rss, 41, _WWR, where=f"t IS NOT NULL AND {has(_RT, _RD)}", raw_key=_RT, key="raw_key")
case(S["JustRemote"], either("jobs", entries(4, fields_of("title=t company=c location=l description=d url=u date=p"))), 4,
     {"description": "d"}, where=has("t"))
_yc = f"to_json(named_struct('results', array(named_struct('hits', {entries(41, fields_of('name=c isHiring=odd one_liner=t location=l slug=id'))}))))"
case(S["YC-Jobs"], _yc, 41,
     {"title": "'Data Role at ' || coalesce(c, 'Unknown')", "description": "t", "posted": "''",
      "url": "'https://www.ycombinator.com/companies/' || coalesce(CAST(id AS VARCHAR), '')"}, where=f"odd AND {has('t')}")
_startup = either("jobs", entries(4, fields_of("title=t location=l description=d url=u published_at=p") + ", 'company', named_struct('name', v.c)"))
_startup_text = obj("jobs", entries(4, fields_of("title=t company=c location=l description=d url=u published_at=p")))
case(S["StartupJobs"], f"IF(doc_id % 3 = 0, {_startup_text}, {_startup})", 4, {"description": "d"}, where=has("t"))
_europe = root(entries(121, fields_of("id=id title=t company_name=c published_at=p") + ", 'workplace_type', IF(v.odd, 'Remote', 'office'),"
               " 'employment_types', array(named_struct('from', v.s, 'to', IF(v.odd, 90000, NULL), 'currency', 'pln'))"))
case(S["Europe-Remote"], _europe, 121,
     {"location": "'Remote (Europe)'", "description": "NULL", "url": "'https://justjoin.it/offers/' || coalesce(CAST(id AS VARCHAR), '')",
      "salary": "CASE WHEN s <> 0 THEN s || '-90000 pln' END"}, where=f"odd AND {has('t')}")
_crypto = either("jobs", entries(61, fields_of("title=t company=c description=d apply_url=u created_at=p")))
case(S["Crypto-Jobs"], _crypto, 61, {"location": "'Remote (Web3)'", "description": "d"},
     where=has("t", words=[*KEYWORDS, *vocab.CRYPTO_EXTRA_KEYWORDS]))
_adzuna = obj("results", entries(4, fields_of("title=t description=d redirect_url=u created=p salary_min=s")
              + ", 'company', named_struct('display_name', v.c), 'location', named_struct('display_name', v.l), 'contract_type', 'permanent'"))
case(S["Adzuna-India"], _adzuna, 4,
     {"location": "coalesce(l, 'India')", "description": "d", "salary": _SAL, "job_type": "'permanent'"}, key=_FOLDED)
_indeed = obj("cards", entries(31, fields_of("title=t company=c location=l date=p") + ", 'href', IF(v.odd, v.u, concat('/rc/', v.i))"))
_IN = {"location": "coalesce(l, 'India')", "description": "coalesce(t, 'Unknown') || ' at ' || coalesce(c, 'Unknown')",
       "url": "CASE WHEN odd THEN coalesce(u, '') ELSE 'https://in.indeed.com/rc/' || i END", "posted": "coalesce(p, 'Today')"}
case(S["Indeed-India"], _indeed, 31, _IN, where="t IS NOT NULL",
     raw_key="coalesce(t, 'Unknown') || '_' || coalesce(c, 'Unknown')", key="raw_key")
_bing = (f"concat('<ol>', array_join(transform({entries(11, fields_of('i=i t=t u=u odd=odd'))}, v -> concat('<li class=\"b_algo\" id=\"', v.i, '\">',"
         " '<h2><a href=\"', IF(v.odd, coalesce(v.u, 'x'), 'https://other.example'), '\" h=\"1\">', coalesce(v.t, 'x'), '</a></h2><p class=\"s\"> Snip ', v.i, '</p></li>')), chr(10)), '</ol>')")
_BT = duck.strip("coalesce(t, 'x')")
case(S["BingSearch"], _bing, 11,
     {"title": f"CASE WHEN contains({_BT}, ' at ') THEN split_part({_BT}, ' at ', 1) WHEN contains({_BT}, ' - ') THEN split_part({_BT}, ' - ', 1) ELSE {_BT} END",
      "company": f"CASE WHEN contains({_BT}, ' at ') THEN split_part({_BT}, ' at ', 2) WHEN contains({_BT}, ' - ') THEN split_part({_BT}, ' - ', 2) ELSE 'Unknown' END",
      "location": "'India'", "description": "'Snip ' || i", "url": "coalesce(u, 'x')", "posted": "''", "source": "'Bing→' || board"},
     where="odd AND u IS NOT NULL", key="title || '_' || company")
_ddg = (f"array_join(transform({entries(21, fields_of('i=i t=t odd=odd'))}, v -> IF(doc_id % 2 = 0,"
        " concat('<a class=\"result__url\" rel=\"n\" href=\"https://', IF(v.odd, 'linkedin', 'blog'), '.example/', doc_id, '/', v.i % 5, '\">u</a> <a class=\"result__a\">', coalesce(v.t, 'x'), '</a> <a class=\"result__snippet\">s</a>'),"
        " concat('<a href=\"//duckduckgo.com/l/?uddg=https%3A%2F%2F', IF(v.odd, 'in.indeed', 'blog'), '.example%2F', doc_id, '%2F', v.i % 5, '&rut=1\">', coalesce(v.t, 'x'), '</a>'))), chr(10))")
case(S["DuckDuckGo"], _ddg, 21,
     {"title": "coalesce(t, 'x')", "company": "'Unknown'", "location": "'India'", "description": "coalesce(t, 'x')", "posted": "''",
      "url": "'https://' || CASE WHEN doc_id % 2 = 0 THEN 'linkedin' ELSE 'in.indeed' END || '.example/' || doc_id || '/' || (i % 5)"},
     where="odd", key="url")
_ng = obj("organic_results", entries(4, fields_of("snippet=d") + ", 'link', IF(v.odd, concat('https://www.naukri.com/', doc_id, '/', v.i), 'https://x.example'),"
          " 'title', concat(v.t, ' - ', coalesce(v.c, ''), ' - Naukri.com - jobs | more')"))
# Without a company the title ends in " -"; a dash inside it then splits it.
case(S["Naukri-Google"], _ng, 4,
     {"title": "CASE WHEN t IS NULL THEN '' WHEN c IS NULL AND contains(t, ' - ') THEN split_part(t, ' - ', 1)"
               " WHEN c IS NULL THEN t || ' -' ELSE t END",
      "company": "CASE WHEN t IS NULL THEN 'Naukri Listing' WHEN c IS NULL AND contains(t, ' - ') THEN split_part(t, ' - ', 2) || ' -'"
                 " WHEN c IS NULL THEN 'Naukri Listing' ELSE c END", "location": "'India'",
      "description": "d", "url": "'https://www.naukri.com/' || doc_id || '/' || i", "posted": "'Recent'"},
     where="odd")
_land_root = root(entries(31, fields_of("title=t description=d location=l url=u created_at=p company_name=c")
                  + ", 'skills', 'none'"))
_land_data = obj("data", entries(31, fields_of("title=t description=d city=l apply_url=u created_at=p")
                 + ", 'company', named_struct('name', v.c), 'skills', IF(v.odd, array('SQL', 'Go'), array())"))
_landing = f"IF(doc_id % 3 = 0, {_land_root}, {_land_data})"
_SK = "CASE WHEN doc_id % 3 = 0 THEN '' WHEN odd THEN 'SQL Go' ELSE '' END"
case(S["LandingJobs"], _landing, 31,
     {"title": "coalesce(t, '')", "description": f"lower(coalesce(t, '')) || ' ' || lower({_SK})"},
     where=has(both("t", "d", _SK)))
_github = obj("items", entries(11, "'path', concat('docs/', v.i, '.md'), 'html_url', concat('https://git.example/', doc_id, '/', v.i % 3), 'repository', named_struct('full_name', v.c)"))
_KT = "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN {q(w.title())}" for i, w in enumerate(_WORDS)) + " END"
case(S["GitHub-Jobs"], _github, 11,
     {"title": f"{_KT} || ' position'", "company": "coalesce(c, 'GitHub Listing')", "location": "'Remote/Various'",
      "description": "'Job listing found on GitHub: docs/' || i || '.md'", "url": "'https://git.example/' || doc_id || '/' || (i % 3)",
      "posted": "''"}, key="url")

# ------------------------------------------------------------ the older readings

V1 = SPECS_V1
_CUT = {"description": "d"}
_TC = "title || '_' || company"
case(V1["RemoteOK"], _remoteok, 4, {**_CUT, "url": "coalesce(u, 'https://remoteok.com')", "salary": _SAL},
     "normalize_v1_", where=has(both("t", "d", TAG_TEXT)))
case(V1["Arbeitnow"], _arbeit, 4, {**_CUT, "location": "coalesce(l, 'Unknown')"}, "normalize_v1_", where=has(both("t", "d", TAG_TEXT)))
case(V1["Jobicy"], _jobicy, 4, {**_CUT, "salary": _SAL, "job_type": "'full, part'"}, "normalize_v1_",
     where=has(both("t", "d", "'food'")), key=_TC)
case(V1["Findwork"], _findwork, 4, {**_CUT, "location": "coalesce(l, 'Unknown')"}, "normalize_v1_", key=_TC)
# even entries carry marks; the older reader sees no others, and drops tags without a gap
_MT = "(coalesce(c || ': ', '') || t)"
case(V1["WWRemotely"], _rss, 41, {
    **_WWR, "description": "regexp_replace(coalesce(d, ''), '<[^>]+>', '', 'g')",
    "title": f"CASE WHEN contains({_MT}, ':') THEN {duck.strip(f'substring({_MT}, instr({_MT}, chr(58)) + 1)')} ELSE {_MT} END",
    "company": f"CASE WHEN contains({_MT}, ':') THEN {duck.strip(f'split_part({_MT}, chr(58), 1)')} ELSE 'Unknown' END"},
    "normalize_v1_", where=f"i % 2 = 0 AND t IS NOT NULL AND {has(_MT)}", key=_TC)
case(V1["HN-Hiring"], _hn, 31,
     {**_HN_COMMON, "description": f"{_X}",
      "title": f"CASE WHEN contains({_LOW}, 'engineer') THEN 'Software Engineer' WHEN contains({_LOW}, 'data scientist') THEN 'Data Scientist'"
               f" WHEN contains({_LOW}, 'analyst') THEN 'Data Analyst' WHEN contains({_LOW}, 'machine learning') OR contains({_LOW}, 'ml') THEN 'ML Engineer'"
               f" WHEN contains({_LOW}, 'python') THEN 'Python Developer' ELSE 'Tech Position' END"},
     "normalize_v1_", where=f"{_HN_TEXT} <> '' AND {has(_X)}")
case(V1["Google-Jobs"], _google, 31,
     {**_G, "title": "coalesce(t, '')", "description": "d"}, "normalize_v1_")
case(V1["Indeed-India"], _indeed, 31, {**_IN, "posted": "coalesce(p, 'today')"}, "normalize_v1_", where="t IS NOT NULL", key=_TC)


case(V1["Himalayas"], f"IF(doc_id % 2 = 0, {_himal}, {_himal_list})", 4,
     {**_CUT, "location": "CASE WHEN l IS NULL THEN 'Remote' ELSE l || ', EU' END", "salary": _SAL,
      "url": "coalesce(u, concat('https://himalayas.app/jobs/', coalesce(CAST(id AS VARCHAR), '')))"},
     "normalize_v1_", where=has(both("t", "d", "CASE WHEN doc_id % 2 = 0 THEN t ELSE 'sql remote' END")))
case(V1["TheMuse"], _muse, 4,
     {**_CUT, "company": "CASE WHEN doc_id % 2 = 1 THEN coalesce(c, 'Unknown') ELSE 'Unknown' END",
      "location": "CASE WHEN l = '' THEN 'Unknown' ELSE coalesce(l, 'Unknown') END"},
     "normalize_v1_", where=has(both("t", "d")), key=_TC)

# ------------------------------------------------------------ thread choice

_THREAD = """CASE (doc_id + i) % 5 WHEN 0 THEN 'Show HN: text' WHEN 1 THEN 'Ask HN: Who is hiring? (May 2019)'
 WHEN 2 THEN 'Ask HN: Who is hiring? (January 2024)' WHEN 3 THEN 'Who wants to be hired? (2024)'
 ELSE 'Ask HN: Who''s hiring right now' END"""


def _threads(spark, sf_dir):
    hits = (f"transform(sequence(0, CAST(doc_id % 4 AS INT)), i -> named_struct('objectID',"
            f" concat(doc_id, '-', i), 'title', {_THREAD}))")
    rows = landing(spark, sf_dir, "HN-Hiring", obj("hits", hits))
    return pick_thread(rows, AS_OF).select("ord", "thread_id", "title")


QUERIES["hiring_thread"] = _threads
ORACLES["hiring_thread"] = f"""WITH h AS (SELECT doc_id, i, {_THREAD} AS title FROM
 (SELECT doc_id, unnest(range(0, 1 + doc_id % 4)) AS i FROM documents)),
k AS (SELECT *, CASE WHEN contains(title, 'January') OR contains(title, '2024') THEN 0 ELSE 1 END AS late FROM h
 WHERE contains(title, 'Who is hiring') OR contains(title, 'Who''s hiring'))
SELECT doc_id AS ord, doc_id || '-' || i AS thread_id, title FROM k
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY late, i) = 1"""

# ------------------------------------------------------------ around the normaliser

def _mixed(spark, sf_dir) -> DataFrame:
    """A landing table of two boards with broken payloads and fetch errors."""
    one = landing(spark, sf_dir, "Arbeitnow", f"IF(doc_id % 7 = 0, '<html>busy', {_arbeit})")
    two = landing(spark, sf_dir, "Remotive", _remotive)
    error = F.when(F.col("payload") == "<html>busy", "not JSON")
    return one.unionByName(two).withColumns({
        "error": error, "duration_ms": F.col("ord") % 100})


def _quarantined(spark, sf_dir):
    return quarantine(_mixed(spark, sf_dir), S["Arbeitnow"]).select("ord", "payload")


QUERIES["quarantine"] = _quarantined
ORACLES["quarantine"] = "SELECT doc_id AS ord, '<html>busy' AS payload FROM documents WHERE doc_id % 7 = 0"


def _log(spark, sf_dir):
    rows = _mixed(spark, sf_dir)
    found = normalize(rows, S["Arbeitnow"], KEYWORDS).unionByName(
        normalize(rows, S["Remotive"], KEYWORDS))
    return ingest_log(rows, found, "run-1")


QUERIES["ingest_log"] = _log
_COUNT = "SELECT doc_id, unnest(range(0, 1 + doc_id % 4)) AS i, text FROM documents"
_NAMED = ", ".join(f"{v} AS {k}" for k, v in ENTRY.items())
ORACLES["ingest_log"] = f"""WITH f AS (SELECT doc_id, i, {_NAMED} FROM ({_COUNT})),
a AS (SELECT count(*) AS n FROM f WHERE doc_id % 7 <> 0 AND {has(both('t', 'd', TAG_TEXT))}),
b AS (SELECT count(*) AS n FROM f WHERE {has('t', TAG_TEXT)}),
d AS (SELECT count(*) AS n, CAST(sum(doc_id % 100) AS BIGINT) AS ms FROM documents)
SELECT 'run-1' AS run_id, 'Arbeitnow' AS source, d.n AS payloads, a.n AS listings, d.ms AS duration_ms, 'not JSON' AS error FROM d, a
UNION ALL SELECT 'run-1', 'Remotive', d.n, b.n, d.ms, NULL FROM d, b"""


# ------------------------------------------------------------ entries among odd items

# Before the entries of a document: a number, a text that looks like an object, an empty list, null.
_ODD = """concat('{"data":[', CASE doc_id %% 5 WHEN 0 THEN '' WHEN 1 THEN '5,' WHEN 2 THEN '"{\\\\"title\\\\":\\\\"Data\\\\"}",'
 WHEN 3 THEN '[],null,' ELSE 'true,-1.5,' END, substring(%s, 10))""" % _arbeit


def _odd_landing(spark, sf_dir) -> DataFrame:
    return landing(spark, sf_dir, "Arbeitnow", _ODD)


def _mixed_entries(spark, sf_dir):
    return normalize(_odd_landing(spark, sf_dir), S["Arbeitnow"], KEYWORDS).select(*COLUMNS)


QUERIES["normalize_mixed_entries"] = _mixed_entries
ORACLES["normalize_mixed_entries"] = ORACLES["normalize_arbeitnow"]


def _odd_entries(spark, sf_dir):
    return quarantine_entries(_odd_landing(spark, sf_dir), S["Arbeitnow"]).select(
        "ord", F.col("pos").cast("bigint").alias("pos"), "entry")


QUERIES["quarantine_entries"] = _odd_entries
ORACLES["quarantine_entries"] = """WITH o AS (SELECT doc_id AS ord, CASE doc_id % 5 WHEN 1 THEN ['5']
 WHEN 2 THEN ['"{\\"title\\":\\"Data\\"}"'] WHEN 3 THEN ['[]', 'null'] WHEN 4 THEN ['true', '-1.5'] ELSE [] END AS x FROM documents)
SELECT ord, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS entry FROM o"""


def _raw_entries(spark, sf_dir):
    """Whole entries, with the fields that no column is made of."""
    rows = landing(spark, sf_dir, "Arbeitnow", obj("data", entries(4, fields_of("title=t own=id more=s"))))
    raw = normalize(rows, S["Arbeitnow"], ["data"]).select("raw_data")
    return raw.select(*[F.get_json_object("raw_data", f"$.{k}").alias(k) for k in ("title", "own", "more")])


QUERIES["raw_entries"] = _raw_entries
ORACLES["raw_entries"] = f"""WITH f AS (SELECT {_NAMED} FROM ({_COUNT}))
SELECT t AS title, CAST(id AS VARCHAR) AS own, CAST(s AS VARCHAR) AS more FROM f WHERE t IS NOT NULL AND contains(lower(t), 'data')"""


def _all_errors(spark, sf_dir):
    rows = _mixed(spark, sf_dir).withColumn("error", F.when(
        F.col("ord") % 3 == 0, F.concat(F.lit("status "), (F.col("ord") % 4).cast("string"))))
    return ingest_errors(rows, "run-1")


QUERIES["ingest_errors"] = _all_errors
ORACLES["ingest_errors"] = """SELECT 'run-1' AS run_id, s AS source, 'status ' || (doc_id % 4) AS error, count(*) AS payloads
FROM documents, (SELECT unnest(['Arbeitnow', 'Remotive']) AS s) WHERE doc_id % 3 = 0 GROUP BY ALL"""
