import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from boardsift.sources import specs
from boardsift.sources.normalizer import (
    SourceSpec, ingest_errors, ingest_log, normalize, quarantine, quarantine_entries)
from boardsift.sources.specs import SPECS, SPECS_V1
from boardsift.sources.threads import pick_thread

KEYWORDS = ["analyst", "data", "python"]
SCHEMA = ("source STRING, board STRING, keyword STRING, ord BIGINT, fetched_at TIMESTAMP, "
          "payload STRING, error STRING, duration_ms BIGINT")


def land(spark, name, *payloads, board="acme", keyword="analyst"):
    rows = [(name, board, keyword, i, None, p if isinstance(p, (str, type(None))) else json.dumps(p),
             None, 5) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, SCHEMA)


def read(spark, name, *payloads, spec=None, **kw):
    spec = spec or SPECS[name]
    df = normalize(land(spark, name, *payloads, **kw), spec, KEYWORDS, keep_order=True)
    return df.orderBy("ord", "pos").collect()


def test_every_board_has_a_spec():
    assert len(SPECS) == 34 and all(n == s.name for n, s in SPECS.items())
    assert set(SPECS_V1) <= set(SPECS)


def test_odd_values_never_end_a_batch(spark):
    good = {"title": "Data 1", "company_name": "C", "location": None, "description": "<b>x</b>",
            "url": 7, "created_at": 1706616000, "tags": ["a"]}
    rows = read(spark, "Arbeitnow", {"data": [good, {"title": "Data 2"}]}, "not json", {"data": []},
                {"other": 1}, None, {"data": [{**good, "title": "Data 3", "tags": "sql"}]})
    assert [r.title for r in rows] == ["Data 1", "Data 2", "Data 3"]
    first = rows[0]
    assert (first.location, first.description, first.url, first.posted) == (
        "Unknown", "x", "7", "1706616000")
    assert (rows[1].company, rows[1].description, rows[1].url) == ("Unknown", "", "")


def test_quarantine(spark):
    df = quarantine(land(spark, "Arbeitnow", "not json", {"data": []}, None), SPECS["Arbeitnow"])
    assert sorted(r.ord for r in df.collect()) == [0, 2]


def test_remoteok_drops_the_first_element(spark):
    rows = read(spark, "RemoteOK", [{"legal": "data"}, {"id": 9, "position": "Data", "salary": 5}], [{"position": "Data"}])
    assert [(r.title, r.url, r.location, r.salary) for r in rows] == [
        ("Data", "https://remoteok.com/jobs/9", "Remote", "5")]


def test_categories_as_text_or_list(spark):
    rows = read(spark, "Himalayas", {"jobs": [
        {"title": "A", "categories": "python", "applicationLink": "", "slug": "s"},
        {"title": "B", "categories": ["x", "python"], "locationRestrictions": ["India", "UK"]},
        {"title": "C", "categories": ["x"]}]})
    assert [(r.title, r.location, r.url) for r in rows] == [
        ("A", "Remote", "https://himalayas.app/jobs/s"), ("B", "India, UK", "https://himalayas.app/jobs/")]


def test_payload_id_counts_only_when_matched(spark):
    rows = read(spark, "Jobicy", {"jobs": [{"id": 1, "jobTitle": "Cook"}, {"id": 2, "jobTitle": "Data a"}]},
                {"jobs": [{"id": 1, "jobTitle": "Data b"}, {"id": 2, "jobTitle": "Data c"}]})
    assert [r.title for r in rows] == ["Data a", "Data b"]


def test_placeholders(spark):
    rows = read(spark, "Naukri", {"jobDetails": [
        {"jobId": 1, "title": "A", "jdURL": "/x", "placeholders": [
            {"type": "experience", "label": "2 Yrs"}, {"type": "location", "label": "Pune"}]},
        {"jobId": 2, "title": "B"}]})
    assert [(r.location, r.salary, r.job_type, r.url) for r in rows] == [
        ("Pune", "2 Yrs", "2 Yrs", "https://www.naukri.com/x"), ("India", "", "", "https://www.naukri.com")]


def test_keyword_limit(spark):
    spec = replace(SPECS["Findwork"], keywords=2)
    payload = {"results": [{"id": 1, "role": "Any"}]}
    assert len(read(spark, "Findwork", payload, spec=spec, keyword="data")) == 1
    assert len(read(spark, "Findwork", payload, spec=spec, keyword="python")) == 0


@pytest.mark.parametrize("company,want", [({"name": "N"}, "N"), ("Text", "Text"), (None, "Unknown"), ({}, "Unknown")])
def test_company_object_or_text(spark, company, want):
    rows = read(spark, "StartupJobs", [{"title": "Data", "company": company}])
    assert [r.company for r in rows] == [want]


def test_more_links_than_titles(spark):
    link = '<a href="https://www.linkedin.com/jobs/view/%d?x=1"></a>'
    page = "".join(link % i for i in range(25)) + '<span class="sr-only">Only</span>'
    rows = read(spark, "LinkedIn", page)
    assert len(rows) == 25 and len(read(spark, "LinkedIn", page, spec=replace(SPECS["LinkedIn"], first=20))) == 20
    assert [r.title for r in rows[:2]] == ["Only", "analyst position"]
    assert rows[0].url == "https://www.linkedin.com/jobs/view/0"


def test_rss_items(spark):
    item = "<item><title><![CDATA[%s]]></title><link> http://l </link><pubDate>now</pubDate><description>d</description></item>"
    feed = "<rss>" + item % "Acme: Data: Lead" + item % "Python dev" + "<item><link>x</link></item>" + item % "Acme: Data: Lead" + "</rss>"
    rows = read(spark, "WWRemotely", feed)
    assert [(r.company, r.title, r.url) for r in rows] == [
        ("Acme", "Data: Lead", "http://l"), ("Unknown", "Python dev", "http://l")]


def test_comments_cap_counts_matches(spark):
    hits = [{"objectID": i, "comment_text": f"Firm {i} | x<p>python" if i % 2 else "nothing"} for i in range(80)]
    assert len(read(spark, "HN-Hiring", {"hits": hits})) == 40
    rows = read(spark, "HN-Hiring", {"hits": hits}, spec=replace(SPECS["HN-Hiring"], matched=25))
    assert len(rows) == 25 and rows[0].company == "Firm 1" and rows[-1].company == "Firm 49"


def test_nested_teams(spark):
    teams = [{"jobs": [{"id": "a", "title": "Data", "locationName": "India"}]}, {"jobs": None},
             {"jobs": [{"id": "b", "title": "Data", "locationName": "Remote"},
                       {"id": "c", "title": "Data x", "locationName": "Paris"}]}]
    rows = read(spark, "Ashby", {"data": {"jobBoard": {"teams": teams}}}, board="orca-security")
    assert [(r.company, r.url) for r in rows] == [("Orca Security", "https://jobs.ashbyhq.com/orca-security/a")]


def test_search_results_full_or_links(spark):
    full = ('<a class="result__url" href="https://naukri.com/1">u</a><a class="result__a">T1</a>'
            '<a class="result__snippet">s</a>')
    links = '<a href="//duckduckgo.com/l/?uddg=https%3A%2F%2Flinkedin.com%2F2&rut=1">T2</a>'
    rows = read(spark, "DuckDuckGo", full + links, links)
    assert [(r.title, r.url) for r in rows] == [("T1", "https://naukri.com/1"), ("T2", "https://linkedin.com/2")]


def test_title_suffixes(spark):
    rows = read(spark, "Naukri-Google", {"organic_results": [
        {"link": "https://naukri.com/a", "title": "Data - Acme - Naukri.com", "snippet": "s"},
        {"link": "https://naukri.com/b", "title": "Data | 5 jobs"}, {"link": "https://x.com", "title": "Data"}]})
    assert [(r.title, r.company) for r in rows] == [("Data", "Acme"), ("Data", "Naukri Listing")]


def test_own_board(spark):
    spec = specs.register(SourceSpec(
        "Mine", "from_json(payload, 'array<struct<t:string>>')", {"title": "e.t"}, match=("e.t",)))
    try:
        assert [r.title for r in read(spark, "Mine", [{"t": "Data"}, {"t": "Cook"}], spec=spec)] == ["Data"]
    finally:
        del SPECS["Mine"]


def test_threads(spark):
    hits = [[("1", "Who wants"), ("2", "Ask HN: Who is hiring? (May 2019)"), ("3", "Who is hiring? (January 2024)")],
            [("4", "Who's hiring (May 2019)")], [("5", "x")], [("6", "Who is hiring? (Dec 2019)"), ("7", "Who's hiring? (January)")]]
    rows = [{"hits": [{"objectID": i, "title": t} for i, t in h]} for h in hits]
    df = land(spark, "HN-Hiring", *rows)
    assert [tuple(r)[:2] for r in pick_thread(df, "2024-01-31").orderBy("ord").collect()] == [(0, "3"), (1, "4"), (3, "7")]
    assert [r[1] for r in pick_thread(df, "2024-01-31", dated=False).orderBy("ord").collect()] == ["2", "4", "6"]


def test_ingest_log(spark):
    rows = land(spark, "Arbeitnow", {"data": [{"title": "Data"}]}, "bad").withColumn(
        "error", F.when(F.col("payload") == "bad", "boom"))
    log = ingest_log(rows, normalize(rows, SPECS["Arbeitnow"], KEYWORDS), "r").first()
    assert (log.payloads, log.listings, log.duration_ms, log.error) == (2, 1, 10, "boom")


def test_odd_entries_go_alone(spark):
    good = {"title": "Data 1", "company_name": "C", "more": {"b": [1, 2.50, None], "a": "x"}}
    payloads = [{"data": [good, 5, "{\"title\": \"Data 0\"}", None, [good], {**good, "title": "Data 2", "tags": 7}]},
                {"data": "none"}, [good], {"data": {"title": "Data 3"}}]
    df = land(spark, "Arbeitnow", *payloads)
    rows = normalize(df, SPECS["Arbeitnow"], KEYWORDS, keep_order=True).orderBy("ord", "pos").collect()
    assert [(r.ord, r.title) for r in rows] == [(0, "Data 1"), (0, "Data 2")]
    assert json.loads(rows[0].raw_data) == good and json.loads(rows[1].raw_data) == {**good, "title": "Data 2", "tags": 7}
    odd = quarantine_entries(df, SPECS["Arbeitnow"]).orderBy("ord", "pos").collect()
    assert [(r.ord, r.pos) for r in odd] == [(0, 1), (0, 2), (0, 3), (0, 4)]
    assert [json.loads(r.entry) for r in odd] == [5, "{\"title\": \"Data 0\"}", None, [good]]
    assert sorted(r.ord for r in quarantine(df, SPECS["Arbeitnow"]).collect()) == [1, 2, 3]


@pytest.mark.parametrize("name,payload,title", [
    ("RemoteOK", [{"legal": 1}, 3, {"position": "Data"}], "Data"),
    ("Instahyre", {"jobs": [{"title": "Data", "company": "text", "locations": "Pune"}, "x"]}, "Data"),
    ("Himalayas", {"jobs": [[], {"title": "Data", "locationRestrictions": "India", "categories": {"a": 1}}]}, "Data"),
    ("StartupJobs", {"jobs": [None, {"title": "Data", "company": ["N"]}]}, "Data"),
    ("StartupJobs", [1, {"title": "Data"}], "Data"),
    ("Ashby", {"data": {"jobBoard": {"teams": [7, {"jobs": 3}, {"jobs": [4, {"title": "Data", "locationName": "India"}]}]}}}, "Data"),
    ("YC-Jobs", {"results": [{"hits": [1, {"name": "N", "isHiring": True, "one_liner": "data"}]}]}, "Data Role at N"),
    ("HN-Hiring", {"hits": [0, {"objectID": 1, "comment_text": "data scientist"}]}, "Data Scientist"),
    ("Naukri", {"jobDetails": [{"title": "Data", "placeholders": "none"}, 1.5]}, "Data")])
def test_healthy_entries_of_mixed_payloads(spark, name, payload, title):
    assert [r.title for r in read(spark, name, payload)] == [title]


def test_first_counts_odd_items_too(spark):
    spec = replace(SPECS["Arbeitnow"], first=2)
    df = land(spark, "Arbeitnow", {"data": [1, {"title": "Data 1"}, {"title": "Data 2"}, 2]})
    assert [r.title for r in normalize(df, spec, KEYWORDS).collect()] == ["Data 1"]
    assert [r.pos for r in quarantine_entries(df, spec).collect()] == [0]


def test_every_error_is_kept(spark):
    df = land(spark, "Arbeitnow", "a", "b", "c", "d").withColumn(
        "error", F.when(F.col("ord") > 0, F.concat(F.lit("e"), (F.col("ord") % 2).cast("string"))))
    assert sorted(tuple(r) for r in ingest_errors(df, "r").collect()) == [("r", "Arbeitnow", "e0", 1), ("r", "Arbeitnow", "e1", 2)]


def test_rss_markup_ends_at_the_first_closing_tag(spark):
    item = "<item><title>Python %d</title><description>%s</description></item>"
    texts = ["<![CDATA[a ]] b <i>x</i> ]> c]]>", "plain ] and ]]> text]]>", "<![CDATA[open", "", "<![CDATA[]]>", "l1\nl2 < 3" + "<b>" * 5000]
    feed = "".join(item % (n, t) for n, t in enumerate(texts)) + "<item><title>Python 9</title><description>cut</item>"
    raw = {json.loads(r.raw_data)["e"]["title"]: json.loads(r.raw_data)["e"] for r in read(spark, "WWRemotely", feed)}
    assert [raw[f"Python {n}"]["description"] for n in range(6)] == [
        "a ]] b <i>x</i> ]> c", "plain ] and ]]> text", "open", "", "", texts[5]]
    assert [raw[f"Python {n}"]["marked"] for n in range(2)] == ["a ]] b <i>x</i> ]> c", ""]
    assert raw["Python 9"]["description"] == ""


def test_descriptions_are_cleaned_after_copies_went(spark):
    text = normalize(land(spark, "WWRemotely", "<rss></rss>"), SPECS["WWRemotely"], KEYWORDS)._jdf.queryExecution(
        ).optimizedPlan().toString()
    assert text.index("<[^>]+>") < text.index("Window ")
