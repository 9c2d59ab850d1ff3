"""Queries that run as streams over the given files, and table round trips."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift.catalog import duck, listing_queries, payload_queries
from boardsift.catalog.fixtures import AS_OF, RAW_COLUMNS, fetched_at, spread, table
from boardsift.catalog.listing_queries import CFG, SCORED
from boardsift.functions import text
from boardsift.operators import dedup, score, semantic
from boardsift.plugins import classify, with_embedding
from boardsift.session import fresh_path
from boardsift.sources import tables
from boardsift.sources.idindex import open_index
from boardsift.sources.normalizer import normalize
from boardsift.sources.specs import SPECS
from boardsift.streaming import notify, streams

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return streams.read_files(spark, f"{sf_dir}/{name}.parquet", schema)


def document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = len(table(spark, sf_dir, "documents").inputFiles())
    return spread(spark, stream_of(spark, sf_dir, "documents"), files, "doc_id")


def listing_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = document_stream(spark, sf_dir).select(
        "doc_id", "source", *[F.expr(e).alias(c) for c, e in RAW_COLUMNS.items()])
    df = raw.withColumns({
        "title": text.clean_string(F.col("title")), "company": text.clean_string(F.col("company")),
        "description": text.clean_description(F.col("description")),
        "url": text.clean_url(F.col("url")), "fetched_at": fetched_at()})
    return df.withColumn("job_id", text.job_id(F.col("title"), F.col("company"), F.col("source")))


def paths(spark: SparkSession, name: str) -> tuple[str, str]:
    base = fresh_path(spark, name)
    return f"{base}/data", f"{base}/checkpoint"


_ING = payload_queries.ORACLES["normalize_arbeitnow"]


@query("stream_ingest", f"SELECT DISTINCT job_id, title, company FROM ({_ING})")
def stream_ingest(spark, sf_dir):
    docs = document_stream(spark, sf_dir)
    landing = docs.select(
        F.lit("Arbeitnow").alias("source"), F.lit(None).cast("string").alias("board"),
        F.lit(None).cast("string").alias("keyword"), F.col("doc_id").alias("ord"),
        F.lit(AS_OF).cast("timestamp").alias("fetched_at"),
        F.expr(payload_queries._arbeit).alias("payload"))
    out = streams.ingest(landing, SPECS["Arbeitnow"], payload_queries.KEYWORDS,
                         *paths(spark, "ingest"))
    return out.select("job_id", "title", "company")


@query("stream_first_seen", "SELECT DISTINCT user_id FROM events")
def stream_first_seen(spark, sf_dir):
    keys = streams.first_seen(stream_of(spark, sf_dir, "events"), "user_id")
    return streams.to_table(keys, *paths(spark, "first-seen"))


@query("stream_first_seen_within", "SELECT DISTINCT user_id FROM events")
def stream_first_seen_within(spark, sf_dir):
    """The delay spans all events, so each user appears once."""
    keys = streams.first_seen_within(
        stream_of(spark, sf_dir, "events"), "user_id", "ts", "400 days")
    return streams.to_table(keys, *paths(spark, "first-seen-within"))


@query("stream_new_only", """SELECT event_id, user_id FROM events WHERE user_id NOT IN
(SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def stream_new_only(spark, sf_dir):
    known = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("user_id"))
    rows = stream_of(spark, sf_dir, "events").select("event_id", "user_id")
    return streams.to_table(streams.new_only(rows, known, "user_id"), *paths(spark, "new-only")
                            ).select("event_id", "user_id")


@query("stream_stale", f"WITH {SCORED} SELECT doc_id, status, filter_reason, combined_score FROM scored")
def stream_stale(spark, sf_dir):
    out = streams.scored_stream(listing_stream(spark, sf_dir), AS_OF, CFG).select(
        "doc_id", "status", "filter_reason", "combined_score")
    return streams.to_table(out, *paths(spark, "stale"))


def _windows(spark, sf_dir, name, width, slide=None) -> DataFrame:
    data, checkpoint = paths(spark, name)
    counts = streams.windowed_counts(
        stream_of(spark, sf_dir, "events"), "ts", "event_type", "1 day", width, slide)
    streams.by_batch(counts, data, checkpoint, lambda batch, _: batch, mode="update")
    out = streams.latest_update(spark, data, ["start", "event_type"], "n")
    return out.select(F.unix_seconds("start").alias("start_s"), "event_type", "n")


@query("stream_tumbling", """SELECT epoch_us(date_trunc('day', ts)) // 1000000 AS start_s, event_type, count(*) AS n
FROM events GROUP BY ALL""")
def stream_tumbling(spark, sf_dir):
    return _windows(spark, sf_dir, "tumbling", "1 day")


@query("stream_sliding", """WITH w AS (SELECT (epoch_us(ts) // 21600000000 - unnest([0, 1, 2, 3])) * 21600 AS start_s, event_type FROM events)
SELECT start_s, event_type, count(*) AS n FROM w GROUP BY ALL""")
def stream_sliding(spark, sf_dir):
    return _windows(spark, sf_dir, "sliding", "1 day", "6 hours")


@query("stream_sessions", """WITH g AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 30 MINUTE
 THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts) AS sid FROM g),
a AS (SELECT event_type, sid, min(ts) AS s, max(ts) + INTERVAL 30 MINUTE AS e, count(*) AS n FROM s GROUP BY ALL)
SELECT epoch_us(s) AS start_us, epoch_us(e) AS end_us, event_type, n FROM a
WHERE e <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def stream_sessions(spark, sf_dir):
    out = streams.session_counts(
        stream_of(spark, sf_dir, "events"), "ts", "event_type", "1 day", "30 minutes")
    out = out.select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"),
                     "event_type", "n")
    return streams.to_table(out, *paths(spark, "sessions"))


@query("stream_notify_once", f"""WITH {SCORED}, one AS (SELECT * FROM scored
QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY doc_id) = 1)
SELECT job_id, combined_score FROM one WHERE status = 'detected' AND is_india""")
def stream_notify_once(spark, sf_dir):
    out = streams.notify_once(listing_stream(spark, sf_dir), AS_OF, CFG, *paths(spark, "notify"))
    return out.select("job_id", "combined_score")


@query("stream_notify_state", f"""WITH {SCORED} SELECT job_id, min(doc_id) AS doc_id, min_by(combined_score, doc_id) AS combined_score
FROM scored WHERE status = 'detected' AND is_india AND combined_score >= 0.25 GROUP BY job_id""")
def stream_notify_state(spark, sf_dir):
    """Keyed state: each listing alerts at its first sighting that is worth it."""
    rows = notify.notify_states(listing_stream(spark, sf_dir), AS_OF, CFG, "doc_id", "fetched_at",
                                "1000 days", timedelta(days=60))
    return notify.run_notify(rows, *paths(spark, "notify-state")).select(
        "job_id", F.col("ord").alias("doc_id"), "combined_score")


@query("stream_funnel", f"""WITH {SCORED} SELECT count(*) AS total_new, count(*) FILTER (NOT is_india) AS filtered_location,
 count(*) FILTER (is_india AND age_hours > 168) AS filtered_age,
 count(*) FILTER (is_india AND age_hours <= 168 AND status = 'filtered') AS filtered_score,
 count(*) FILTER (status = 'detected') AS total_matched FROM scored""")
def stream_funnel(spark, sf_dir):
    out = streams.running_funnel(listing_stream(spark, sf_dir), AS_OF, CFG, *paths(spark, "funnel"))
    return out.agg(*[streams.total(c) for c in (
        "total_new", "filtered_location", "filtered_age", "filtered_score", "total_matched")])


# ------------------------------------------------------------ tables and files

@query("history_csv", f"WITH {duck.LISTINGS} SELECT DISTINCT job_id AS id FROM listings")
def history_csv(spark, sf_dir):
    """Write old ids, add new ones as the next version, and read it."""
    batch, known = listing_queries.batch_and_known(spark, sf_dir)
    folder = fresh_path(spark, "history")
    ids = F.col("job_id").alias("id")
    tables.save_history(dedup.union_keys(tables.read_history(spark, folder), known.select(ids)), folder)
    tables.save_history(dedup.union_keys(tables.read_history(spark, folder), batch.select(ids)), folder)
    return tables.read_history(spark, folder)


@query("history_versions", f"WITH {duck.LISTINGS} SELECT DISTINCT job_id AS id FROM listings")
def history_versions(spark, sf_dir):
    """Three additions to a CSV history, each of the ids its index does not hold yet."""
    rows = listing_queries.listings(spark, sf_dir).select(F.col("job_id").alias("id"), "doc_id")
    folder = fresh_path(spark, "history")
    for upto in (1, 2, 3):
        batch = rows.filter(F.col("doc_id") % 3 < upto).select("id").distinct()
        tables.append_history(dedup.new_only(batch, tables.history_index(spark, folder), "id"), folder)
    return tables.read_history(spark, folder)


_KNOWN_SQL = f"""WITH {duck.LISTINGS}, known AS (SELECT job_id FROM listings WHERE fetched_at < {listing_queries.CUT})"""


@query("history_index_join", f"""{_KNOWN_SQL} SELECT job_id, min(doc_id) AS doc_id, min_by(title, doc_id) AS title
FROM listings WHERE fetched_at >= {listing_queries.CUT} AND job_id NOT IN (FROM known) GROUP BY job_id""")
def history_index_join(spark, sf_dir):
    """New listings of a batch against a stored id index of two parts."""
    batch, known = listing_queries.batch_and_known(spark, sf_dir)
    index = open_index(spark, fresh_path(spark, "id-index"), 20_000)
    even = F.col("doc_id") % 2 == 0
    index.add(known.filter(even), "even")
    index.add(known.filter(~even), "odd")
    return dedup.fresh_listings(batch, index, ["doc_id"]).select("job_id", "doc_id", "title")


@query("retention_by_day", f"""WITH {duck.LISTINGS}, one AS (SELECT doc_id, job_id, fetched_at,
 CASE WHEN doc_id % 5 = 0 THEN 'applied' ELSE 'detected' END AS status FROM listings
 QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY doc_id) = 1),
gone AS (SELECT * FROM one WHERE fetched_at < {duck.AS_OF} - INTERVAL 30 DAY AND status = 'detected')
SELECT job_id, status, (SELECT count(*) FROM gone) AS deleted FROM one WHERE job_id NOT IN (SELECT job_id FROM gone)""")
def retention_by_day(spark, sf_dir):
    """Expired listings leave their days' folders; the count comes with it."""
    root = fresh_path(spark, "retention")
    tables.create_tables(spark, root)
    rows = listing_queries.listings(spark, sf_dir).withColumn(
        "status", F.when(F.col("doc_id") % 5 == 0, "applied").otherwise("detected"))
    tables.insert_new(spark, rows, root, ["doc_id"])
    deleted = tables.retire(spark, root, AS_OF, 30)
    return tables.read_table(spark, root, "listings").select(
        "job_id", "status", F.lit(deleted).cast("bigint").alias("deleted"))


@query("insert_twice", f"""WITH {SCORED} SELECT job_id, min(doc_id) AS doc_id, min_by(status, doc_id) AS status,
 min_by(combined_score, doc_id) AS combined_score FROM scored GROUP BY job_id""")
def insert_twice(spark, sf_dir):
    """Insert-or-ignore of the same batch twice leaves one row per listing."""
    root = fresh_path(spark, "tables")
    tables.create_tables(spark, root)
    rows = listing_queries.listings(spark, sf_dir).withColumn("url", F.col("doc_id").cast("string"))
    for _ in range(2):
        tables.insert_new(spark, rows, root, ["doc_id"], finish=lambda new: score.score_listings(
            new, AS_OF, listing_queries.CFG))
    return tables.read_table(spark, root, "listings").select(
        "job_id", F.col("url").cast("bigint").alias("doc_id"), "status", "combined_score")


# ------------------------------------------------------------ pages and threads

_STRIP = "trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '" + duck.WS + "+', ' ', 'g'))"


@query("html_extract", f"""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
 len(regexp_extract_all(html, '<a href="([^"]+)"[^>]*>([^<]+)</a>', 1)) AS links,
 array_to_string(regexp_extract_all(html, '<a href="([^"]+)"[^>]*>([^<]+)</a>', 1), '|') AS hrefs,
 array_to_string(regexp_extract_all(html, '<a href="([^"]+)"[^>]*>([^<]+)</a>', 2), '|') AS labels,
 split_part(url, '?', 1) AS bare_url, {_STRIP} AS body FROM pages""")
def html_extract(spark, sf_dir):
    link = F.lit(r'<a href="([^"]+)"[^>]*>([^<]+)</a>')
    hrefs = F.regexp_extract_all("html", link, F.lit(1))
    labels = F.regexp_extract_all("html", link, F.lit(2))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"),
        F.size(hrefs).cast("bigint").alias("links"), F.array_join(hrefs, "|").alias("hrefs"),
        F.array_join(labels, "|").alias("labels"),
        F.substring_index("url", "?", 1).alias("bare_url"),
        text.collapse(text.strip_tags(F.col("html"))).alias("body"))


@query("page_links", """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]+)"[^>]*>([^<]+)</a>', 1)) AS href,
 generate_subscripts(regexp_extract_all(html, '<a href="([^"]+)"[^>]*>([^<]+)</a>', 1), 1) AS n FROM pages)
SELECT page_id, n - 1 AS pos, CASE WHEN href LIKE 'http%' THEN href ELSE 'https://site.example' || href END AS url FROM l""")
def page_links(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit(r'<a href="([^"]+)"[^>]*>([^<]+)</a>'), F.lit(1))
    df = table(spark, sf_dir, "pages").select("page_id", F.posexplode(links).alias("pos", "href"))
    return df.select("page_id", F.col("pos").cast("bigint").alias("pos"), F.when(
        F.col("href").startswith("http"), F.col("href")).otherwise(
        F.concat(F.lit("https://site.example"), "href")).alias("url"))


# ------------------------------------------------------------ plug-ins

def _letters():
    """A stand-in model: shares of four letters of a text."""
    def embed(texts):
        return [[t.count(c) / (len(t) or 1) for c in "aeio"] for t in texts]
    return embed


_LEN = "length(t)"
_VEC = " + ".join(
    f"CAST(CAST((length(t) - length(replace(t, '{c}', '')))::DOUBLE / length(t) AS FLOAT) AS DOUBLE) * {w}::DOUBLE"
    for c, w in zip("aeio", (0.5, 1.0, 0.25, 2.0)))


@query("embed_distinct", f"WITH x AS (SELECT doc_id, lower({duck.strip('text')}) AS t FROM documents)"
       f" SELECT doc_id, round({_VEC}, 6) AS similarity FROM x")
def embed_distinct(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_embedding(docs, F.col("text"), _letters)
    return out.select("doc_id", F.round(semantic.best_similarity(
        F.col("embedding"), [[0.5, 1.0, 0.25, 2.0]]), 6).alias("similarity"))


def _stub():
    """A stand-in classifier: refuses senior titles, fails on clerks."""
    def reply(prompt: str) -> str:
        if "Title: Office" in prompt:
            raise ValueError("no clerks")
        good = "false" if "Title: Senior" in prompt else "true"
        return 'Reply: {"suitable_for_junior": %s, "reason": "rule"}' % good
    return reply


@query("classify_stub", f"""WITH {duck.LISTINGS} SELECT CAST(doc_id AS VARCHAR) AS job_id,
 NOT starts_with(title, 'Senior') AS suitable, CASE WHEN starts_with(title, 'Office') THEN NULL ELSE 'Not specified' END AS experience_required,
 CASE WHEN starts_with(title, 'Office') THEN 'Error: no clerks' ELSE 'rule' END AS reason,
 CASE WHEN starts_with(title, 'Office') THEN 0::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM listings""")
def classify_stub(spark, sf_dir):
    rows = listing_queries.listings(spark, sf_dir).withColumn("job_id", F.col("doc_id").cast("string"))
    return classify(rows, _stub)


@query("tagged_source_union", payload_queries.ORACLES["normalize_arbeitnow"] + "\nUNION ALL "
       + payload_queries.ORACLES["normalize_remotive"].replace("WITH ent", "SELECT * FROM (WITH ent", 1) + ")")
def tagged_source_union(spark, sf_dir):
    landed = dedup.union_batches([
        payload_queries.landing(spark, sf_dir, "Arbeitnow", payload_queries._arbeit),
        payload_queries.landing(spark, sf_dir, "Remotive", payload_queries._remotive)])
    return dedup.union_batches([
        normalize(landed, SPECS[n], payload_queries.KEYWORDS).select(*payload_queries.COLUMNS)
        for n in ("Arbeitnow", "Remotive")])
