"""Queries over the listings view: cleaning, rules, scores, dedup, state, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift import vocab
from boardsift.catalog import duck
from boardsift.catalog.duck import LISTINGS, TEXTS, q, scored_sql
from boardsift.catalog.fixtures import AS_OF, listings, raw_listings, table
from boardsift.config import AGE_BASE, AGE_V1, AGE_V2, MatchConfig, TaggedConfig
from boardsift.functions import alerts, dictionary, rules, text
from boardsift.functions.age import age_hours, timestamp_literal
from boardsift.operators import dedup, report, score, semantic, state
from boardsift.plans import scan, tagged
from boardsift.session import stored

CFG = MatchConfig()
TAGGED = TaggedConfig()
QUERIES: dict = {}
ORACLES: dict = {}

# Profile texts of the demo; users bring their own.
PROFILES = {
    "Data Science": "Python, machine learning and deep learning with PyTorch and TensorFlow. "
                    "Statistics, regression, NLP, transformers, BERT, LLM and RAG work. "
                    "SQL, pandas, numpy, xgboost. Junior data scientist, 0-2 years.",
    "Data Analytics": "SQL, Excel, Power BI and Tableau dashboards. Python and pandas for "
                      "data analysis, statistics, visualization, analytics and reporting.",
    "BI Developer": "Power BI developer: DAX, Power Query, Tableau, SQL, Excel dashboards, "
                    "business intelligence and data visualization.",
}

# Stop words of the demo; the operator's default is the list shipped with Spark.
STOP_WORDS = (
    "a about after all also an and any are as at be because been but by can could for from had "
    "has have he her his how if in into is it its more no not of on one or other our out she so "
    "some such than that the their them then there these they this to up was we were what when "
    "which who will with would you your").split()


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.score_listings(listings(spark, sf_dir), AS_OF, CFG)


SCORED = scored_sql(duck.age(AGE_V2))


# ------------------------------------------------------------ scalar functions

@query("listing_clean", f"""WITH {LISTINGS}
SELECT doc_id, job_id, {duck.job_id(lower=False)} AS job_id_v1, title, company, location,
 description, url, posted, salary,
 array_to_string([CAST(x AS VARCHAR) FOR x IN [doc_id % 7, doc_id % 5]], ', ') AS job_type
FROM listings""")
def listing_clean(spark, sf_dir):
    df = listings(spark, sf_dir)
    return df.select(
        "doc_id", "job_id",
        text.job_id_v1(F.col("title"), F.col("company"), F.col("source")).alias("job_id_v1"),
        "title", "company", "location", "description", "url",
        text.clean_posted(F.col("posted")).alias("posted"), "salary",
        text.clean_job_type(F.array(F.col("doc_id") % 7, F.col("doc_id") % 5)).alias("job_type"))


@query("match_text", f"WITH {TEXTS} SELECT doc_id, skill_text FROM texts")
def match_text(spark, sf_dir):
    return score.with_match_texts(listings(spark, sf_dir)).select(
        "doc_id", F.col("_skill_text").alias("skill_text"))


def _age_query(policy):
    def run(spark, sf_dir):
        return raw_listings(spark, sf_dir).select(
            "doc_id", "posted", age_hours("posted", AS_OF, policy).alias("age_hours"))
    query(f"age_hours_{policy.name}",
          f"WITH raw AS ({duck.RAW}) SELECT doc_id, posted, {duck.age(policy)} AS age_hours FROM raw")(run)


for _policy in (AGE_V2, AGE_BASE, AGE_V1):
    _age_query(_policy)


@query("location_class", f"""WITH {TEXTS}
SELECT doc_id, location, {duck.HOME} AS is_india, {duck.REMOTE} AS is_remote, {duck.CITY} AS city
FROM texts""")
def location_class(spark, sf_dir):
    df = score.with_location(score.with_match_texts(listings(spark, sf_dir)), CFG)
    return df.select("doc_id", "location", "is_india", "is_remote", "city")


@query("title_relevance", f"""WITH {LISTINGS}, t AS (SELECT doc_id, title, lower(title) AS low FROM listings)
SELECT doc_id, title, NOT ({duck.any_term('low', vocab.TITLE_EXCLUDED)})
 AND {duck.any_term('low', vocab.TITLE_REQUIRED)} AS relevant,
 CASE WHEN {duck.any_term('low', vocab.TITLE_EXCLUDED)} THEN -0.5::DOUBLE
  WHEN {duck.any_term('low', vocab.TITLE_REQUIRED)} THEN 0::DOUBLE ELSE -0.3::DOUBLE END AS penalty FROM t""")
def title_relevance(spark, sf_dir):
    df = listings(spark, sf_dir).select("doc_id", "title", F.lower("title").alias("low"))
    df = df.withColumn("penalty", rules.title_penalty("low", CFG))
    return df.select("doc_id", "title", (F.col("penalty") == 0).alias("relevant"), "penalty")


@query("category_rules", f"WITH {TEXTS} SELECT doc_id, {duck.CATEGORY} AS category FROM texts")
def category_rules(spark, sf_dir):
    df = score.with_match_texts(listings(spark, sf_dir))
    return df.select("doc_id", rules.category("_body", CFG).alias("category"))


@query("experience_filter", f"""WITH {TEXTS}, r AS (SELECT doc_id, {duck.experience_reason()} AS reason FROM texts)
SELECT doc_id, reason, reason LIKE 'Junior-friendly: %' OR reason LIKE 'No clear%' AS suitable FROM r""")
def experience_filter(spark, sf_dir):
    df = score.with_match_texts(listings(spark, sf_dir))
    df = df.select("doc_id", rules.experience_reason(
        "_title", "_body", CFG.max_years).alias("reason"))
    return df.withColumn("suitable", rules.experience_suitable(F.col("reason")))


# ------------------------------------------------------------ scores

_MATCHED = ", ".join(q(t) for t in vocab.SKILL_WEIGHTS)


@query("keyword_score_v2", f"""WITH {TEXTS}
SELECT doc_id, round(least({duck.weighted('skill_text', vocab.SKILL_WEIGHTS)}, 1::DOUBLE), 4) AS keyword_score,
 array_to_string(list_filter([{_MATCHED}], lambda k: contains(skill_text, k)), ',') AS matched_keywords
FROM texts""")
def keyword_score_v2(spark, sf_dir):
    t = "_skill_text"
    return score.with_match_texts(listings(spark, sf_dir)).select(
        "doc_id", F.round(score.keyword_score(t, CFG), 4).alias("keyword_score"),
        F.array_join(text.matched_terms(t, CFG.skill_weights), ",").alias("matched_keywords"))


@query("keyword_score_v1", f"""WITH {LISTINGS},
t AS (SELECT doc_id, lower(title || ' ' || company || ' ' || description) AS x FROM listings)
SELECT doc_id, least({duck.weighted('x', vocab.SKILL_POINTS, 'INTEGER')}, 50) AS points FROM t""")
def keyword_score_v1(spark, sf_dir):
    df = listings(spark, sf_dir).select(
        "doc_id", F.lower(F.concat_ws(" ", "title", "company", "description")).alias("x"))
    return df.select("doc_id", score.keyword_points("x", TAGGED).alias("points"))


def _tagged_cte() -> str:
    parts = " UNION ALL ".join(
        f"SELECT *, {q(tag)} AS tag FROM words WHERE {duck.any_term('x', words)}"
        for tag, words in vocab.TAGGED_CONFIGS.items())
    return f"""words AS (SELECT *, lower(title || ' ' || company || ' ' || description) AS x,
 lower(title || ' ' || description) AS y FROM listings),
tagged AS ({parts.replace('contains(x,', 'contains(y,')})"""


def tfidf_sql(stop: list[str], profiles: dict[str, str]) -> str:
    """CTEs from ``tagged`` to ``tfidf``: term counts of both sides by unnesting and grouping."""
    stops = ", ".join(q(w) for w in stop)
    bodies = ", ".join(f"({q(tag)}, {q(body)})" for tag, body in profiles.items())
    return f"""bodies(tag, body) AS (VALUES {bodies}),
body_words AS (SELECT tag, list_filter(regexp_extract_all(lower(body), '[{duck.WORD}]{{2,}}'),
 lambda w: NOT list_contains([{stops}], w)) AS w FROM bodies),
profile AS (SELECT tag, term, count(*) AS p FROM (SELECT tag, unnest(list_concat(w, list_transform(
 range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM body_words) GROUP BY ALL),
tokens AS (SELECT doc_id, tag, list_filter(regexp_extract_all(x, '[{duck.WORD}]{{2,}}'),
 lambda w: NOT list_contains([{stops}], w)) AS w FROM tagged),
terms AS (SELECT doc_id, tag, unnest(list_concat(w, list_transform(
 range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM tokens),
counts AS (SELECT doc_id, tag, term, count(*) AS n FROM terms GROUP BY ALL),
pairs AS (SELECT k.doc_id, k.tag, coalesce(c.term, k.term) AS term, coalesce(c.n, 0) AS n, coalesce(k.p, 0) AS p
 FROM (SELECT t.doc_id, t.tag, p.term, p.p FROM tagged t JOIN profile p ON p.tag = t.tag) k
 LEFT JOIN counts c ON c.doc_id = k.doc_id AND c.tag = k.tag AND c.term = k.term
 UNION ALL SELECT c.doc_id, c.tag, c.term, c.n, 0 FROM counts c
 ANTI JOIN profile p ON p.tag = c.tag AND p.term = c.term),
kept AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY doc_id, tag
 ORDER BY n + p DESC, term) <= 3000),
sums AS (SELECT doc_id, tag, sum(n * p) AS dot,
 sum(CASE WHEN p > 0 THEN n * n ELSE 0 END) AS jj, sum(CASE WHEN n > 0 THEN p * p ELSE 0 END) AS pp,
 sum(CASE WHEN p = 0 THEN n * n ELSE 0 END) AS j1, sum(CASE WHEN n = 0 THEN p * p ELSE 0 END) AS p1
 FROM kept GROUP BY ALL),
tfidf AS (SELECT doc_id, tag, CASE WHEN dot > 0 THEN 50 * (dot::DOUBLE
 / (sqrt(jj::DOUBLE + j1::DOUBLE * power(1 + ln(1.5::DOUBLE), 2))
  * sqrt(pp::DOUBLE + p1::DOUBLE * power(1 + ln(1.5::DOUBLE), 2)))) ELSE 0::DOUBLE END AS tfidf FROM sums)"""


def tagged_listings(spark, sf_dir) -> DataFrame:
    df = listings(spark, sf_dir)
    return score.tag_listings(df, vocab.TAGGED_CONFIGS)


@query("tagged_configs", f"""WITH {LISTINGS}, {_tagged_cte()} SELECT doc_id, tag, title FROM tagged""")
def tagged_configs(spark, sf_dir):
    return tagged_listings(spark, sf_dir).select("doc_id", "tag", "title")


@query("tfidf_pair_score")
def tfidf_pair_score(spark, sf_dir):
    df = score.score_by_tag(listings(spark, sf_dir), vocab.TAGGED_CONFIGS, PROFILES, TAGGED, STOP_WORDS)
    return df.select("doc_id", "tag", F.round("tfidf", 6).alias("tfidf"), "points",
                     F.round("score", 2).alias("score"))


def _tagged_scores() -> str:
    return f"""{LISTINGS}, {_tagged_cte()}, {tfidf_sql(STOP_WORDS, PROFILES)},
tagged_scores AS (SELECT t.*, f.tfidf, least({duck.weighted('x', vocab.SKILL_POINTS, 'INTEGER')}, 50) AS points,
 CASE WHEN length(trim(x)) < 50 THEN 0::DOUBLE ELSE round(least(least({duck.weighted('x', vocab.SKILL_POINTS, 'INTEGER')}, 50)
 + f.tfidf, 100::DOUBLE), 2) END AS score
 FROM tagged t JOIN tfidf f ON f.doc_id = t.doc_id AND f.tag = t.tag)"""


def _tagged_oracles() -> dict[str, str]:
    base = _tagged_scores()
    fresh = f"{duck.age(AGE_V1)} <= 12"
    new = (f"fresh AS (SELECT s.*, {duck.job_id(lower=False)} AS job_id_v1 FROM tagged_scores s WHERE {fresh}"
           f" AND s.fetched_at >= {duck.AS_OF} - INTERVAL 30 DAY),\n"
           f"old AS (SELECT {duck.job_id(lower=False)} AS job_id_v1 FROM listings"
           f" WHERE fetched_at < {duck.AS_OF} - INTERVAL 30 DAY),\n"
           "new AS (SELECT * FROM fresh ANTI JOIN old USING (job_id_v1))")
    return {
        "tfidf_pair_score": f"WITH {base} SELECT doc_id, tag, round(tfidf, 6) AS tfidf, points, score"
                            " FROM tagged_scores",
        "tagged_top": f"WITH {base}, {new} SELECT doc_id, job_id_v1, tag, score FROM new WHERE score >= 15"
                      " ORDER BY score DESC, job_id_v1, tag, doc_id LIMIT 15",
        "tagged_funnel": f"WITH {base}, {new} SELECT count(*) AS total_new,"
                         " count(*) FILTER (score >= 15) AS total_matched,"
                         " coalesce(max(score), 0) AS best_score FROM new",
    }


ORACLES.update(_tagged_oracles())


def new_tagged(spark, sf_dir) -> DataFrame:
    """Fresh tagged listings of the last 30 days that older runs have not seen."""
    df = listings(spark, sf_dir)
    cutoff = timestamp_literal(AS_OF) - F.make_interval(days=F.lit(30))
    old = tagged.with_id(df.filter(F.col("fetched_at") < cutoff)).select(
        F.col("job_id_v1").alias("id"))
    return tagged.new_matches(
        df.filter(F.col("fetched_at") >= cutoff), old, AS_OF, PROFILES, TAGGED, STOP_WORDS)


@query("tagged_top")
def tagged_top(spark, sf_dir):
    return report.top_tagged(new_tagged(spark, sf_dir), TAGGED.min_score, TAGGED.alerts, "doc_id").select(
        "doc_id", "job_id_v1", "tag", "score")


@query("tagged_funnel")
def tagged_funnel(spark, sf_dir):
    return report.tagged_funnel(new_tagged(spark, sf_dir), TAGGED.min_score)


@query("semantic_max_profile", """WITH p AS (SELECT vec_id AS pid, embedding AS e FROM embeddings WHERE vec_id IN (0, 1)),
x AS (SELECT j.vec_id, p.pid, generate_subscripts(j.embedding, 1) AS i, unnest(j.embedding)::DOUBLE AS a,
 unnest(p.e)::DOUBLE AS b FROM embeddings j CROSS JOIN p WHERE j.vec_id > 1),
d AS (SELECT vec_id, pid, sum(a * b) AS dot FROM x GROUP BY ALL)
SELECT vec_id, round(max(dot), 6) AS similarity FROM d GROUP BY vec_id""")
def semantic_max_profile(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    profiles = semantic.profile_vectors(vectors.filter(F.col("vec_id").isin(0, 1)))
    return vectors.filter(F.col("vec_id") > 1).select(
        "vec_id", F.round(semantic.best_similarity(F.col("embedding"), profiles), 6)
        .alias("similarity"))


@query("semantic_profile_table", """SELECT j.vec_id, round(max(list_dot_product(j.embedding::DOUBLE[], p.embedding::DOUBLE[])), 6) AS similarity
FROM embeddings j CROSS JOIN (FROM embeddings WHERE vec_id < 500) p GROUP BY j.vec_id""")
def semantic_profile_table(spark, sf_dir):
    """All vectors against 500 profiles, the first ones of the table."""
    vectors = table(spark, sf_dir, "embeddings")
    found = semantic.with_similarity(vectors, "embedding", vectors.filter(F.col("vec_id") < 500))
    return found.select("vec_id", F.round("similarity", 6).alias("similarity"))


SCORE_COLUMNS = ["doc_id", "job_id", "status", "filter_reason", "category", "semantic_score",
                 "keyword_score", "combined_score", "is_india", "is_remote", "city", "age_hours"]


@query("combined_score_status", f"WITH {SCORED} SELECT {', '.join(SCORE_COLUMNS)} FROM scored")
def combined_score_status(spark, sf_dir):
    return scored(spark, sf_dir).select(*SCORE_COLUMNS)


SEMANTIC_SCORED = f"""vectors AS (SELECT vec_id, embedding FROM embeddings),
pv AS (SELECT vec_id AS pid, embedding AS e FROM embeddings WHERE vec_id IN (0, 1)),
dims AS (SELECT j.vec_id, pv.pid, unnest(j.embedding)::DOUBLE AS a, unnest(pv.e)::DOUBLE AS b
 FROM vectors j CROSS JOIN pv WHERE j.vec_id > 1),
sims AS (SELECT vec_id, max(dot) AS dot FROM (SELECT vec_id, pid, sum(a * b) AS dot FROM dims GROUP BY ALL)
 GROUP BY vec_id)"""


@query("semantic_scored", f"""WITH {SEMANTIC_SCORED}, {scored_sql(
    duck.age(AGE_V2), '(SELECT dot FROM sims WHERE sims.vec_id = texts.doc_id)')}
SELECT doc_id, status, semantic_score, combined_score FROM scored""")
def semantic_scored(spark, sf_dir):
    """Scores with a vector per listing; listings without one use their keywords."""
    vectors = table(spark, sf_dir, "embeddings")
    profiles = semantic.profile_vectors(vectors.filter(F.col("vec_id").isin(0, 1)))
    sims = vectors.filter(F.col("vec_id") > 1).select(
        F.col("vec_id").alias("doc_id"),
        semantic.best_similarity(F.col("embedding"), profiles).alias("similarity"))
    df = listings(spark, sf_dir).join(sims, "doc_id", "left")
    df = score.score_listings(df, AS_OF, CFG, similarity="similarity")
    return df.select("doc_id", "status", "semantic_score", "combined_score")


@query("relevance_flag", f"""WITH {SCORED} SELECT s.doc_id,
 combined_score >= 0.35 AND is_india AND coalesce(l.quality = 1, true) AS is_relevant
FROM scored s LEFT JOIN labels l ON l.doc_id = s.doc_id""")
def relevance_flag(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("ok"))
    df = scored(spark, sf_dir).join(labels, "doc_id", "left")
    return df.select("doc_id", rules.is_relevant(
        F.col("combined_score"), F.col("is_india"), F.col("ok"), CFG.relevant_score)
        .alias("is_relevant"))


# ------------------------------------------------------------ dictionaries

_FRAGMENTS = """fragments AS (SELECT term, count(DISTINCT p_name) AS names FROM (SELECT p_name, substr(p_name, i, n) AS term
 FROM (SELECT DISTINCT p_name FROM part), (SELECT unnest(range(1, 20)) AS i), (SELECT unnest([3, 4, 5, 6]) AS n) WHERE i + n <= length(p_name) + 1)
 GROUP BY term)"""


def name_fragments(spark, sf_dir) -> DataFrame:
    """(term, names): pieces of three to six characters of part names, and how many names have them."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    size = F.length("p_name")
    starts = names.select("p_name", F.explode(F.sequence(F.lit(1), size)).alias("i"))
    pieces = starts.select("p_name", "i", F.explode(F.array(*map(F.lit, (3, 4, 5, 6)))).alias("n")).filter(
        F.col("i") + F.col("n") <= F.length("p_name") + 1)
    return pieces.select("p_name", F.expr("substring(p_name, i, n)").alias("term")).groupBy("term").agg(
        F.count_distinct("p_name").alias("names"))


@query("dictionary_hits", f"""WITH {_FRAGMENTS}, hits AS (SELECT doc_id, term, names FROM documents, fragments WHERE contains(text, term))
SELECT doc_id, count(*) AS terms, CAST(sum(names) AS BIGINT) AS names, string_agg(term, ',' ORDER BY term) AS found FROM hits GROUP BY doc_id""")
def dictionary_hits(spark, sf_dir):
    """Documents joined with every dictionary entry they hold, in one scan of each text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = dictionary.occurrences(docs, "text", name_fragments(spark, sf_dir), "term", "doc_id")
    return hits.groupBy("doc_id").agg(
        F.count("*").alias("terms"), F.sum("names").alias("names"),
        F.array_join(F.array_sort(F.collect_list("term")), ",").alias("found"))


# ------------------------------------------------------------ verdicts

REPLY = """CASE WHEN toxic = 1 AND quality = 0 THEN 'no idea'
 WHEN toxic = 1 THEN '{"suitable_for_junior": tru'
 WHEN quality = 1 THEN 'Sure: {"suitable_for_junior": true, "experience_required": "0-2 years", "reason": "fits"} done'
 ELSE '{"suitable_for_junior": false, "reason": "too senior"}' END"""
VERDICTS_SQL = """verdicts AS (SELECT l.doc_id, CASE WHEN toxic = 1 THEN true ELSE quality = 1 END AS suitable,
 CASE WHEN toxic = 1 THEN NULL WHEN quality = 1 THEN '0-2 years' ELSE 'Not specified' END AS experience_required,
 CASE WHEN toxic = 1 THEN 'Failed to parse LLM response' WHEN quality = 1 THEN 'fits' ELSE 'too senior' END AS reason,
 CASE WHEN toxic = 1 THEN 0::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM labels l)"""


def replies(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.expr(REPLY).alias("reply"))


@query("verdict_parse", f"WITH {VERDICTS_SQL} SELECT * FROM verdicts")
def verdict_parse(spark, sf_dir):
    fields = alerts.verdict_fields(F.col("reply"))
    return replies(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in fields.items()])


@query("verdict_merge", f"""WITH {VERDICTS_SQL}, {SCORED},
v AS (SELECT s.job_id, max_by(v.suitable, s.doc_id) AS suitable, max_by(coalesce(v.experience_required, '-'), s.doc_id) AS exp,
 max_by(v.reason, s.doc_id) AS reason FROM scored s JOIN verdicts v USING (doc_id) GROUP BY s.job_id),
m AS (SELECT s.doc_id, s.job_id, s.status, v.suitable, v.exp, v.reason,
 s.status = 'detected' AND v.suitable IS NOT NULL AS asked FROM scored s LEFT JOIN v USING (job_id))
SELECT doc_id, job_id, CASE WHEN asked AND NOT suitable THEN 'filtered' ELSE status END AS status,
 CASE WHEN asked THEN suitable END AS llm_suitable,
 CASE WHEN asked THEN nullif(exp, '-') END AS llm_experience_required,
 CASE WHEN asked THEN reason END AS llm_reason FROM m""")
def verdict_merge(spark, sf_dir):
    jobs = scored(spark, sf_dir)
    parsed = verdict_parse(spark, sf_dir).join(
        listings(spark, sf_dir).select("doc_id", "job_id"), "doc_id")
    last = state.last_verdicts(parsed, "doc_id")
    out = state.apply_verdicts(jobs, last)
    return out.select("doc_id", "job_id", "status", "llm_suitable", "llm_experience_required",
                      "llm_reason")


@query("experience_applied", f"""WITH {SCORED}, r AS (SELECT *, CASE WHEN status = 'detected'
 THEN {duck.experience_reason()} END AS why FROM scored)
SELECT doc_id, CASE WHEN why LIKE 'Senior%' OR why LIKE 'Requires%' THEN 'filtered' ELSE status END AS status,
 CASE WHEN why LIKE 'Senior%' OR why LIKE 'Requires%' THEN why END AS llm_reason FROM r""")
def experience_applied(spark, sf_dir):
    return score.with_experience(scored(spark, sf_dir), CFG).select("doc_id", "status", "llm_reason")


@query("prompts", f"""WITH {SCORED} SELECT doc_id, {q(alerts.PROMPT_FORMAT).replace('%s', "' || {} || '").format(
    'title', 'company', 'description')} AS prompt
FROM scored WHERE status = 'detected' AND combined_score >= 0.25""")
def prompts(spark, sf_dir):
    df = scored(spark, sf_dir).filter(
        (F.col("status") == "detected") & (F.col("combined_score") >= CFG.min_score))
    return df.select("doc_id", alerts.prompt(
        F.col("title"), F.col("company"), F.col("description")).alias("prompt"))


# ------------------------------------------------------------ dedup and joins

CUT = f"({duck.AS_OF} - INTERVAL 20 DAY)"


def batch_and_known(spark, sf_dir):
    df = listings(spark, sf_dir)
    cutoff = timestamp_literal(AS_OF) - F.make_interval(days=F.lit(20))
    return df.filter(F.col("fetched_at") >= cutoff), df.filter(F.col("fetched_at") < cutoff)


@query("dedup_first_wins", f"""WITH {LISTINGS}
SELECT job_id, min(doc_id) AS doc_id, min_by(description, doc_id) AS description FROM listings GROUP BY job_id""")
def dedup_first_wins(spark, sf_dir):
    return dedup.first_wins(listings(spark, sf_dir), ["job_id"], ["doc_id"]).select(
        "job_id", "doc_id", "description")


@query("dedup_title_company", f"""WITH {LISTINGS}
SELECT title || '_' || company AS k, min(doc_id) AS doc_id FROM listings GROUP BY k""")
def dedup_title_company(spark, sf_dir):
    key = dedup.by_title_company()
    return dedup.first_wins(listings(spark, sf_dir), key, ["doc_id"]).select(
        key[0].alias("k"), "doc_id")


@query("dedup_title_company_folded", f"""WITH {LISTINGS}
SELECT lower(title) || '|' || lower(company) AS k, min(doc_id) AS doc_id FROM listings GROUP BY k""")
def dedup_title_company_folded(spark, sf_dir):
    key = dedup.by_title_company("|", fold_case=True)
    return dedup.first_wins(listings(spark, sf_dir), key, ["doc_id"]).select(
        key[0].alias("k"), "doc_id")


@query("dedup_by_title", f"""WITH {LISTINGS}
SELECT title, min(doc_id) AS doc_id, min_by(url, doc_id) AS url FROM listings GROUP BY title""")
def dedup_by_title(spark, sf_dir):
    return dedup.first_wins(listings(spark, sf_dir), ["title"], ["doc_id"]).select(
        "title", "doc_id", "url")


@query("per_source_cap", f"""WITH {LISTINGS} SELECT source, doc_id, title FROM listings
QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20""")
def per_source_cap(spark, sf_dir):
    return dedup.cap_per_group(listings(spark, sf_dir), ["source"], ["doc_id"], 20).select(
        "source", "doc_id", "title")


@query("new_listings_anti", f"""WITH {LISTINGS}
SELECT job_id, min(doc_id) AS doc_id, min_by(title, doc_id) AS title FROM listings
WHERE fetched_at >= {CUT} AND job_id NOT IN (SELECT job_id FROM listings WHERE fetched_at < {CUT})
GROUP BY job_id""")
def new_listings_anti(spark, sf_dir):
    batch, known = batch_and_known(spark, sf_dir)
    return dedup.fresh_listings(batch, known, ["doc_id"]).select("job_id", "doc_id", "title")


@query("known_listings_semi", f"""WITH {LISTINGS} SELECT doc_id, job_id FROM listings
WHERE fetched_at >= {CUT} AND job_id IN (SELECT job_id FROM listings WHERE fetched_at < {CUT})""")
def known_listings_semi(spark, sf_dir):
    batch, known = batch_and_known(spark, sf_dir)
    return dedup.known_only(batch, known).select("doc_id", "job_id")


@query("insert_count", f"""WITH {LISTINGS} SELECT count(DISTINCT job_id) AS inserted FROM listings
WHERE fetched_at >= {CUT} AND job_id NOT IN (SELECT job_id FROM listings WHERE fetched_at < {CUT})""")
def insert_count(spark, sf_dir):
    batch, known = batch_and_known(spark, sf_dir)
    return dedup.insertable(batch, known, ["doc_id"]).agg(F.count("*").alias("inserted"))


@query("history_union", f"""WITH {LISTINGS} SELECT DISTINCT job_id AS id FROM listings""")
def history_union(spark, sf_dir):
    batch, known = batch_and_known(spark, sf_dir)
    ids = F.col("job_id").alias("id")
    return dedup.union_keys(known.select(ids), batch.select(ids))


@query("union_sources", """SELECT 'documents' AS origin, CAST(doc_id AS VARCHAR) AS item, source FROM documents
UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), NULL FROM pages
UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR), NULL FROM benchmark""")
def union_sources(spark, sf_dir):
    def side(name, key, *more):
        return table(spark, sf_dir, name).select(
            F.lit(name).alias("origin"), F.col(key).cast("string").alias("item"), *more)
    return dedup.union_batches([
        side("documents", "doc_id", "source"), side("pages", "page_id"), side("benchmark", "item_id")])


# ------------------------------------------------------------ top lists and alerts

TOP_SQL = "status = 'detected' AND is_india AND combined_score >= 0.25"
_ONE = "QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY doc_id) = 1"


def first_scored(spark, sf_dir) -> DataFrame:
    """Scores of the first listing of each id.

    Copies of a listing are left out before its text is read and scored, see :func:`dedup.leading`.
    What is sorted and shuffled by id are the columns that the answer names, never descriptions.
    """
    first = dedup.leading(listings(spark, sf_dir), ["job_id"], ["doc_id"])
    return dedup.first_wins(score.score_listings(first, AS_OF, CFG), ["job_id"], ["doc_id"])


@query("top_matches", f"""WITH {SCORED}, one AS (SELECT * FROM scored {_ONE})
SELECT job_id, title, company, combined_score FROM one WHERE {TOP_SQL}
ORDER BY combined_score DESC, job_id LIMIT 15""")
def top_matches(spark, sf_dir):
    return report.top_matches(first_scored(spark, sf_dir), 15, CFG).select(
        "job_id", "title", "company", "combined_score")


@query("top_descriptions", f"""WITH {SCORED}, one AS (SELECT * FROM scored {_ONE})
SELECT job_id, doc_id, combined_score, description, url FROM one WHERE {TOP_SQL}
ORDER BY combined_score DESC, job_id LIMIT 15""")
def top_descriptions(spark, sf_dir):
    top = report.top_matches(first_scored(spark, sf_dir), 15, CFG).select("job_id", "doc_id", "combined_score")
    whole = listings(spark, sf_dir).select("job_id", "doc_id", "description", "url")
    return report.with_rows(top, whole, ["job_id", "doc_id"])


@query("table_top_matches", f"""WITH {SCORED} SELECT doc_id, job_id, combined_score FROM scored
WHERE combined_score >= 0.3 AND is_india ORDER BY combined_score DESC, fetched_at DESC, job_id, doc_id LIMIT 20""")
def table_top_matches(spark, sf_dir):
    return report.table_top_matches(scored(spark, sf_dir), 20, CFG.table_min_score, "doc_id").select(
        "doc_id", "job_id", "combined_score")


@query("by_status_top", f"""WITH {SCORED}, one AS (SELECT * FROM scored {_ONE})
SELECT job_id, combined_score FROM one WHERE status = 'filtered'
ORDER BY combined_score DESC, job_id LIMIT 100""")
def by_status_top(spark, sf_dir):
    return report.by_status(first_scored(spark, sf_dir), "filtered", 100).select("job_id", "combined_score")


@query("recent_listings", f"""WITH {LISTINGS}, one AS (SELECT * FROM listings {_ONE})
SELECT job_id, epoch_us(fetched_at) // 1000000 AS fetched_s FROM one
WHERE fetched_at >= {duck.AS_OF} - INTERVAL 24 HOUR ORDER BY fetched_at DESC, job_id LIMIT 100""")
def recent_listings(spark, sf_dir):
    one = dedup.first_wins(listings(spark, sf_dir), ["job_id"], ["doc_id"])
    return report.recent(one, AS_OF, 24, 100).select(
        "job_id", F.unix_seconds("fetched_at").alias("fetched_s"))


NOTIFIED_SQL = "notified AS (SELECT DISTINCT job_id FROM listings JOIN labels USING (doc_id) WHERE toxic = 1)"
_ESC = lambda x: (f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),"  # noqa: E731
                  " '\"', '&quot;')")
_TAG = "CASE category " + " ".join(
    f"WHEN {q(c)} THEN {q(t)}" for c, t in vocab.CATEGORY_TAGS.items()) + f" ELSE {q(vocab.DEFAULT_CATEGORY_TAG)} END"
_TIER = "CASE " + " ".join(f"WHEN combined_score >= {c} THEN {q(m)}" for c, m in vocab.SCORE_TIERS) + (
    f" ELSE {q(vocab.DEFAULT_TIER)} END")
_PLACE = ("(CASE WHEN is_remote THEN '🏠 Remote / ' ELSE '' END || "
          "coalesce(nullif(city, ''), nullif(location, ''), 'India'))")
_NL = "chr(10)"
MESSAGE_SQL = f"""({_TIER}) || ' <b>' || ({_TAG}) || ' - ' || CAST(trunc(combined_score * 100) AS INTEGER)
 || '% Match</b>' || {_NL} || {_NL} || '💼 <b>' || {_ESC('title')} || '</b>' || {_NL} || '🏢 ' || {_ESC('company')}
 || {_NL} || '📍 ' || {_ESC(_PLACE)} || {_NL} || '🌐 ' || {_ESC('source')} || {_NL}
 || coalesce('⏰ ' || {_ESC("nullif(posted, '')")} || {_NL}, '') || coalesce('💰 ' || {_ESC("nullif(salary, '')")} || {_NL}, '')
 || {_NL} || '<a href="' || {_ESC('url')} || '">🔗 Apply Now</a>'"""


@query("notify_once", f"""WITH {SCORED}, {NOTIFIED_SQL}, one AS (SELECT * FROM scored {_ONE}),
top AS (SELECT * FROM one WHERE {TOP_SQL} ORDER BY combined_score DESC, job_id LIMIT 15)
SELECT job_id, combined_score, {MESSAGE_SQL} AS message FROM top WHERE job_id NOT IN (SELECT job_id FROM notified)""")
def notify_once(spark, sf_dir):
    top = report.top_matches(first_scored(spark, sf_dir), 15, CFG)
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    notified = listings(spark, sf_dir).join(toxic, "doc_id", "left_semi")
    return state.pending_alerts(top, notified).select("job_id", "combined_score", "message")


@query("alert_texts", f"""WITH {SCORED}
SELECT doc_id, {MESSAGE_SQL} AS message, {_NL} || repeat('=', 60) || {_NL} || '[' || CAST(trunc(combined_score * 100) AS INTEGER)
 || '%] ' || title || {_NL} || 'Company: ' || company || {_NL} || 'Location: ' || location || ' '
 || CASE WHEN is_remote THEN '(Remote)' ELSE '' END || {_NL} || 'Source: ' || source || {_NL} || 'Category: ' || category
 || {_NL} || 'URL: ' || url || {_NL} || repeat('=', 60) AS plain FROM scored""")
def alert_texts(spark, sf_dir):
    df = scored(spark, sf_dir)
    row = {c: F.col(c) for c in df.columns}
    row["llm_experience_required"] = F.lit(None).cast("string")
    return df.select("doc_id", alerts.alert_message(row).alias("message"),
                     alerts.plain_alert(row).alias("plain"))


# ------------------------------------------------------------ reports

@query("stats_by_status", f"WITH {SCORED} SELECT status, count(*) AS n FROM scored GROUP BY status")
def stats_by_status(spark, sf_dir):
    return report.count_by(scored(spark, sf_dir), "status")


@query("stats_by_source", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source")
def stats_by_source(spark, sf_dir):
    return report.count_by_source(table(spark, sf_dir, "documents"))


@query("stats_overview", f"""WITH {SCORED} SELECT count(*) AS total_jobs,
 round(coalesce(avg(combined_score) FILTER (combined_score > 0), 0), 3) AS avg_score FROM scored""")
def stats_overview(spark, sf_dir):
    return report.overview(scored(spark, sf_dir))


@query("stats_object", f"""WITH {SCORED}, o AS (SELECT count(*) AS total_jobs,
 round(coalesce(avg(combined_score) FILTER (combined_score > 0), 0), 3) AS avg_score FROM scored)
SELECT *, (SELECT string_agg(status || '=' || n, ',' ORDER BY status) FROM (SELECT status, count(*) n FROM scored GROUP BY 1)) AS by_status,
 (SELECT string_agg(source || '=' || n, ',' ORDER BY source) FROM (SELECT source, count(*) n FROM scored GROUP BY 1)) AS by_source FROM o""")
def stats_object(spark, sf_dir):
    one = report.stats_object(scored(spark, sf_dir))

    def flat(c: str):
        pairs = F.array_sort(F.map_entries(c))
        return F.array_join(F.transform(
            pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(c)

    return one.select("total_jobs", "avg_score", flat("by_status"), flat("by_source"))


@query("funnel_stats", f"""WITH {SCORED}, r AS (SELECT *, CASE WHEN status = 'detected' THEN {duck.experience_reason()} END AS why FROM scored),
f AS (SELECT *, coalesce(why LIKE 'Senior%' OR why LIKE 'Requires%', false) AS exp_drop FROM r),
m AS (SELECT *, status = 'detected' AND NOT exp_drop AND is_india AND combined_score >= 0.25 AS matched FROM f)
SELECT count(*) AS total_new, count(*) FILTER (NOT is_india) AS filtered_location,
 count(*) FILTER (is_india AND age_hours > 168) AS filtered_age,
 count(*) FILTER (is_india AND age_hours <= 168 AND status = 'filtered') AS filtered_score,
 count(*) FILTER (exp_drop) AS filtered_experience, count(*) FILTER (matched) AS total_matched,
 coalesce(max(combined_score) FILTER (matched), 0) AS best_score,
 round(coalesce(avg(combined_score) FILTER (matched), 0), 6) AS avg_score FROM m""")
def funnel_stats(spark, sf_dir):
    out = report.funnel(score.with_experience(scored(spark, sf_dir), CFG), CFG)
    return out.withColumn("avg_score", F.round("avg_score", 6))


@query("scan_errors", """WITH e AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS run_id, user_id, event_type
 FROM events WHERE event_type IN ('error', 'search'))
SELECT run_id, string_agg(line, chr(10) ORDER BY line) AS errors FROM
(SELECT run_id, 'board' || user_id || ': ' || event_type AS line FROM e) GROUP BY run_id""")
def scan_errors(spark, sf_dir):
    log = table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "search")).select(
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"),
        F.concat(F.lit("board"), F.col("user_id").cast("string")).alias("source"),
        F.col("event_type").alias("error"))
    return report.joined_errors(log)


def api_calls(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("api_name"), F.col("ts").cast("timestamp").alias("called_at"))


@query("api_usage_monthly", """SELECT event_type AS api_name, strftime(ts, '%Y-%m') AS month, count(*) AS call_count,
 epoch_us(max(ts)) AS last_call_us FROM events GROUP BY ALL""")
def api_usage_monthly(spark, sf_dir):
    return report.calls_by_month(api_calls(spark, sf_dir)).select(
        "api_name", "month", "call_count", F.unix_micros("last_call_at").alias("last_call_us"))


@query("quota_gate", """WITH apis AS (SELECT DISTINCT event_type AS api_name FROM events UNION SELECT r_name FROM region),
u AS (SELECT event_type AS api_name, count(*) AS n FROM events WHERE strftime(ts, '%Y-%m') = '2024-01' GROUP BY 1),
l AS (SELECT api_name, coalesce(n, 0) AS call_count, greatest(2000 - coalesce(n, 0), 0) AS remaining FROM apis LEFT JOIN u USING (api_name))
SELECT api_name, call_count, remaining, least(3, remaining) AS allowed, remaining > 0 AS open FROM l""")
def quota_gate(spark, sf_dir):
    calls = api_calls(spark, sf_dir)
    apis = calls.select("api_name").union(
        table(spark, sf_dir, "region").select("r_name")).distinct()
    return report.quota_gate(report.usage(calls, apis, AS_OF), limit=2000)


QUOTAS = [report.Quota("search", ("view", "click"), 5800, 5), report.Quota("jobs", ("error",), 1, 3),
          report.Quota("ads", ("purchase",), 1_000_000_000, 4)]


@query("quota_landing", f"""WITH e AS (SELECT event_id AS ord, event_type AS source, user_id, ts,
 CASE WHEN event_type IN ('view', 'click') THEN 'search' WHEN event_type = 'error' THEN 'jobs' WHEN event_type = 'purchase' THEN 'ads' END AS api
 FROM events),
q(api, monthly, per_run) AS (VALUES ('search', 5800, 5), ('jobs', 1, 3), ('ads', 1000000000, 4)),
u AS (SELECT api, count(*) AS n FROM e WHERE api IS NOT NULL AND ts < {duck.AS_OF} - INTERVAL 2 DAY
 AND strftime(ts, '%Y-%m') = '2024-01' GROUP BY 1),
g AS (SELECT q.api, least(per_run, greatest(monthly - coalesce(n, 0), 0)) AS allowed FROM q LEFT JOIN u USING (api)),
l AS (SELECT *, row_number() OVER (PARTITION BY api ORDER BY ord) AS nth FROM e WHERE ts >= {duck.AS_OF} - INTERVAL 2 DAY)
SELECT l.ord, l.source FROM l LEFT JOIN g USING (api) WHERE l.api IS NULL OR nth <= allowed""")
def quota_landing(spark, sf_dir):
    """Events of the last two days stand for answers, earlier ones for the calls of the month."""
    cut = timestamp_literal(AS_OF) - F.make_interval(days=F.lit(2))
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"), F.col("event_id").alias("ord"), F.col("user_id").cast("string").alias("board"),
        F.lit(None).cast("string").alias("keyword"), F.col("ts").cast("timestamp").alias("fetched_at"))
    calls = report.call_events(events.filter(F.col("fetched_at") < cut), QUOTAS, AS_OF)
    answers = events.filter(F.col("fetched_at") >= cut)
    return report.unmetered(answers, QUOTAS).unionByName(
        report.within_quota(answers, calls, QUOTAS, AS_OF)).select("ord", "source")


@query("run_seconds", """SELECT user_id, strftime(min(ts), '%Y-%m-%d') AS day,
 CASE WHEN count(*) > 1 THEN (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 ELSE 0.0 END AS seconds
FROM events GROUP BY user_id, CAST(ts AS DATE)""")
def run_seconds(spark, sf_dir):
    """Each user's events of a day stand for a run; one with a single event is unfinished."""
    at = F.col("ts").cast("timestamp")
    runs = table(spark, sf_dir, "events").groupBy("user_id", F.date_format(at, "yyyy-MM-dd").alias("day")).agg(
        F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("n"))
    ended = F.when(F.col("n") > 1, F.col("ended"))
    return runs.select("user_id", "day", report.run_seconds(F.col("started"), ended).alias("seconds"))


_ROT_START = "((hour(ts) % 4) * 4 + minute(ts) // 15) * 15"


@query("rotation_slice", f"""WITH v AS (SELECT event_id, event_id % 129 AS pos, ts, {_ROT_START} AS s FROM events)
SELECT event_id, pos FROM v WHERE pos >= (CASE WHEN s >= 129 THEN 0 ELSE s END)
 AND pos < (CASE WHEN s >= 129 THEN 0 ELSE s END) + 15""")
def rotation_slice(spark, sf_dir):
    """Visits of board ``pos`` that fall into the slice of their own time."""
    visits = table(spark, sf_dir, "events").select(
        "event_id", (F.col("event_id") % 129).cast("int").alias("pos"), "ts")
    return report.rotation_slice(
        visits, 129, F.col("ts"), report.ROTATIONS["greenhouse"]).select(
        "event_id", F.col("pos").cast("bigint").alias("pos"))


_GROUPS = "[" + ", ".join(q(g[0] + "," + g[1]) for g in vocab.ROTATING_KEYWORD_GROUPS) + "]"


@query("rotating_keywords", f"""SELECT event_id, {_GROUPS}[1 + CAST(day(ts) % 6 AS INTEGER)] AS keywords,
 hour(ts) IN (8, 20) AS open FROM events""")
def rotating_keywords(spark, sf_dir):
    group = report.rotating_group(vocab.ROTATING_KEYWORD_GROUPS, F.dayofmonth("ts"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.array_join(group, ",").alias("keywords"),
        report.run_hour_open(F.col("ts"), vocab.METERED_RUN_HOURS).alias("open"))


_FUNNEL = f"""fun AS (SELECT count(*) AS total_new, count(*) FILTER ({TOP_SQL}) AS total_matched,
 coalesce(max(combined_score) FILTER ({TOP_SQL}), 0) AS best FROM scored)"""


@query("run_summary", f"""WITH {SCORED}, {_FUNNEL} SELECT '🤖 <b>Job Scan Complete</b>' || chr(10) || chr(10)
 || '📊 Fetched: ' || total_new || ' jobs' || chr(10) || '🆕 New: ' || total_new || chr(10) || '✅ Matched: ' || total_matched
 || chr(10) || '📬 Notified: ' || least(total_matched, 15) || chr(10) || '🏆 Best: ' || CAST(trunc(best * 100) AS INTEGER) || '%'
 || chr(10) || chr(10) || '⏰ 2024-01-31 00:00' AS message FROM fun""")
def run_summary(spark, sf_dir):
    row = report.funnel(scored(spark, sf_dir), CFG)
    columns = {"total_fetched": F.col("total_new"), "total_new": F.col("total_new"),
               "total_matched": F.col("total_matched"), "best_score": F.col("best_score"),
               "total_notified": F.least("total_matched", F.lit(15))}
    return row.select(alerts.run_summary(columns, timestamp_literal(AS_OF)).alias("message"))


@query("tagged_alerts", f"""WITH {LISTINGS}, {_tagged_cte()}, p AS (SELECT *, least({duck.weighted('x', vocab.SKILL_POINTS, 'INTEGER')}, 50)
 AS score FROM tagged) SELECT doc_id, tag, '🎯 <b>' || {_ESC('tag')} || ' - ' || score || '% Match</b>' || {_NL} || {_NL}
 || '💼 <b>' || {_ESC('title')} || '</b>' || {_NL} || '🏢 ' || {_ESC('company')} || {_NL} || '📍 ' || {_ESC('location')} || {_NL}
 || '🌐 ' || {_ESC('source')} || {_NL} || {_NL} || '<a href="' || {_ESC('url')} || '">🔗 Apply Now</a>' AS message FROM p""")
def tagged_alerts(spark, sf_dir):
    df = tagged_listings(spark, sf_dir).withColumn(
        "x", F.lower(F.concat_ws(" ", "title", "company", "description")))
    df = df.withColumn("score", score.keyword_points("x", TAGGED))
    row = {c: F.col(c) for c in df.columns}
    return df.select("doc_id", "tag", alerts.tagged_alert(row).alias("message"))


@query("strict_location", f"""WITH {TEXTS}, f AS (SELECT *, {duck.any_term('place', vocab.EXCLUSIVE_PHRASES)} AS closed,
 {duck.any_term('place', vocab.HOME_TERMS)} AS home, {duck.REMOTE} AS remote,
 lower({duck.strip('location')}) IN ({', '.join(q(b) for b in vocab.BLANK_LOCATIONS)}) AS blank,
 {duck.any_term('place', vocab.FOREIGN_TERMS)} AS abroad FROM texts)
SELECT doc_id, CASE WHEN home OR blank THEN true WHEN closed THEN false ELSE remote OR NOT abroad END AS is_india FROM f""")
def strict_location(spark, sf_dir):
    """The variant in which "us only" and the like close a remote listing."""
    cfg = MatchConfig(strict_exclusion=True)
    df = score.with_location(score.with_match_texts(listings(spark, sf_dir)), cfg)
    return df.select("doc_id", "is_india")


@query("word_titles", f"""WITH {LISTINGS}, w AS (SELECT doc_id, ' ' || regexp_replace(lower(title), '[^{duck.WORD}]+', ' ', 'g') || ' ' AS t FROM listings)
SELECT doc_id, contains(t, ' data ') OR contains(t, ' bi ') OR contains(t, ' ai ') OR contains(t, ' ml engineer ') AS relevant FROM w""")
def word_titles(spark, sf_dir):
    """Whole-word term tests: ``ai`` no longer hits ``training``."""
    return listings(spark, sf_dir).select("doc_id", F.lower("title").alias("low")).select(
        "doc_id", text.any_term("low", ["data", "bi", "ai", "ml engineer"], "word").alias("relevant"))


@query("listing_exists", f"WITH {LISTINGS} SELECT DISTINCT job_id FROM listings WHERE job_id = (SELECT job_id FROM listings WHERE doc_id = 1)")
def listing_exists(spark, sf_dir):
    jobs = listings(spark, sf_dir)
    wanted = jobs.filter("doc_id = 1").select("job_id").first()[0]
    return report.exists(jobs, wanted)


# ------------------------------------------------------------ state

STATUS_BY_TYPE = """CASE event_type WHEN 'view' THEN 'detected' WHEN 'click' THEN 'notified'
 WHEN 'purchase' THEN 'applied' WHEN 'error' THEN 'rejected' ELSE 'expired' END"""


def status_log(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("job_id"), F.expr(STATUS_BY_TYPE).alias("status"),
        F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"))


_LATEST = f"""latest AS (SELECT CAST(user_id AS VARCHAR) AS job_id,
 max_by({STATUS_BY_TYPE}, (ts, event_id)) AS status, max(ts) AS updated,
 max(ts) FILTER ({STATUS_BY_TYPE} = 'notified') AS notified,
 max(ts) FILTER ({STATUS_BY_TYPE} = 'applied') AS applied FROM events GROUP BY 1)"""


@query("status_latest", f"""WITH {_LATEST} SELECT job_id, status, epoch_us(updated) AS updated_us,
 epoch_us(notified) AS notified_us, epoch_us(applied) AS applied_us FROM latest""")
def status_latest(spark, sf_dir):
    last = state.latest_status(status_log(spark, sf_dir))
    return last.select("job_id", "status", F.unix_micros("updated_at").alias("updated_us"),
                       F.unix_micros("notified_at").alias("notified_us"),
                       F.unix_micros("applied_at").alias("applied_us"))


_STATUS_FIELDS = "CAST(doc_id AS STRING) AS job_id, 'detected' AS status"


def stored_with_status(spark, sf_dir) -> DataFrame:
    """Listings keyed by ``doc_id`` text, overlaid with the status log."""
    stored = listings(spark, sf_dir).select(
        "doc_id", F.expr("CAST(doc_id AS STRING)").alias("job_id"),
        F.lit("detected").alias("status"), "fetched_at",
        F.lit(None).cast("timestamp").alias("notified_at"),
        F.lit(None).cast("timestamp").alias("applied_at"))
    return state.with_current_status(stored, status_log(spark, sf_dir))


_STORED = f"""{LISTINGS}, {_LATEST}, stored AS (SELECT l.doc_id, coalesce(s.status, 'detected') AS status, l.fetched_at
 FROM listings l LEFT JOIN latest s ON s.job_id = CAST(l.doc_id AS VARCHAR))"""


@query("status_overlay", f"WITH {_STORED} SELECT doc_id, status FROM stored")
def status_overlay(spark, sf_dir):
    return stored_with_status(spark, sf_dir).select("doc_id", "status")


@query("retention_survivors", f"""WITH {_STORED} SELECT doc_id, status FROM stored
WHERE NOT (fetched_at < {duck.AS_OF} - INTERVAL 30 DAY AND status IN ('detected', 'filtered'))""")
def retention_survivors(spark, sf_dir):
    return state.survivors(stored_with_status(spark, sf_dir), AS_OF, 30).select("doc_id", "status")


@query("retention_count", f"""WITH {_STORED} SELECT count(*) AS deleted FROM stored
WHERE fetched_at < {duck.AS_OF} - INTERVAL 30 DAY AND status IN ('detected', 'filtered')""")
def retention_count(spark, sf_dir):
    return state.expired_count(stored_with_status(spark, sf_dir), AS_OF, 30)


def noted_log(spark, sf_dir) -> DataFrame:
    """The status log with extra fields: notes that later events overwrite or clear, and a city."""
    note = F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("note "), F.col("event_id") % 50))
    extras = F.when(F.col("event_id") % 4 == 0, F.create_map(F.lit("llm_reason"), note)).when(
        F.col("event_id") % 7 == 0, F.create_map(
            F.lit("city"), F.concat(F.lit("City "), F.col("event_id") % 11), F.lit("llm_reason"), note))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("job_id"), F.expr(STATUS_BY_TYPE).alias("status"),
        F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), extras.alias("extras"))


_NOTE = "CASE WHEN event_id % 3 <> 0 THEN concat('note ', event_id % 50) END"
_NOTED = f"""noted AS (SELECT CAST(user_id AS VARCHAR) AS job_id, 'llm_reason' AS field, {_NOTE} AS value, ts, event_id
 FROM events WHERE event_id % 4 = 0 OR event_id % 7 = 0
 UNION ALL SELECT CAST(user_id AS VARCHAR), 'city', concat('City ', event_id % 11), ts, event_id
 FROM events WHERE event_id % 4 <> 0 AND event_id % 7 = 0),
extra AS (SELECT * FROM noted QUALIFY row_number() OVER (PARTITION BY job_id, field ORDER BY ts DESC, event_id DESC) = 1)"""
_EXTRAS = f"""WITH {_LATEST}, {_NOTED} SELECT job_id, l.status, epoch_us(notified) AS notified_us,
 coalesce(r.event_id IS NOT NULL, false) AS has_reason, r.value AS reason, c.value AS city
FROM latest l LEFT JOIN (FROM extra WHERE field = 'llm_reason') r USING (job_id)
LEFT JOIN (FROM extra WHERE field = 'city') c USING (job_id)"""


def _extras_of(events: DataFrame) -> DataFrame:
    x = F.col("extras")
    return state.latest_status(events).join(state.latest_extras(events), "job_id", "left").select(
        "job_id", "status", F.unix_micros("notified_at").alias("notified_us"),
        F.coalesce(F.map_contains_key(x, "llm_reason"), F.lit(False)).alias("has_reason"),
        x["llm_reason"].alias("reason"), x["city"].alias("city"))


@query("status_extras", _EXTRAS)
def status_extras(spark, sf_dir):
    return _extras_of(noted_log(spark, sf_dir))


@query("status_folded", _EXTRAS)
def status_folded(spark, sf_dir):
    """The same from a folded log with older events beside it, which a late writer may add."""
    events = noted_log(spark, sf_dir)
    return _extras_of(state.folded(events).unionByName(events.filter(F.col("seq") % 2 == 0)))


@query("status_fold_events", f"""WITH {_LATEST}, {_NOTED},
k AS (SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1
 UNION SELECT user_id, max_by(event_id, (ts, event_id)) FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id, event_type
 UNION SELECT CAST(job_id AS BIGINT), event_id FROM extra)
SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq, coalesce(n, 0) AS n_extras FROM k
LEFT JOIN (SELECT event_id, count(*) AS n FROM extra GROUP BY 1) USING (event_id)""")
def status_fold_events(spark, sf_dir):
    return state.folded(noted_log(spark, sf_dir)).select(
        "job_id", "seq", F.coalesce(F.size("extras"), F.lit(0)).cast("bigint").alias("n_extras"))


@query("extras_overlay", f"""WITH {LISTINGS}, {_LATEST}, {_NOTED},
r AS (FROM extra WHERE field = 'llm_reason'), c AS (FROM extra WHERE field = 'city')
SELECT l.doc_id, coalesce(s.status, 'detected') AS status, CASE WHEN r.event_id IS NULL THEN 'none' ELSE r.value END AS llm_reason,
 CASE WHEN c.event_id IS NULL THEN l.location ELSE c.value END AS city FROM listings l
LEFT JOIN latest s ON s.job_id = CAST(l.doc_id AS VARCHAR) LEFT JOIN r ON r.job_id = CAST(l.doc_id AS VARCHAR)
LEFT JOIN c ON c.job_id = CAST(l.doc_id AS VARCHAR)""")
def extras_overlay(spark, sf_dir):
    never = F.lit(None).cast("timestamp")
    stored = listings(spark, sf_dir).select(
        "doc_id", F.col("doc_id").cast("string").alias("job_id"), F.lit("detected").alias("status"),
        F.lit("none").alias("llm_reason"), F.col("location").alias("city"), never.alias("notified_at"),
        never.alias("applied_at"))
    return state.with_current_status(stored, noted_log(spark, sf_dir)).select("doc_id", "status", "llm_reason", "city")


@query("mark_notified", f"""WITH {SCORED}, one AS (SELECT * FROM scored {_ONE})
SELECT doc_id, CASE WHEN {TOP_SQL} THEN 'notified' ELSE status END AS status,
 CASE WHEN {TOP_SQL} THEN epoch_us({duck.AS_OF}) END AS notified_us,
 CASE WHEN {TOP_SQL} THEN concat('sent to ', source) END AS llm_reason FROM one""")
def mark_notified(spark, sf_dir):
    """Every match is told about and marked, with a note of where it went."""
    never = F.lit(None).cast("timestamp")
    rows = stored(first_scored(spark, sf_dir).select(
        "doc_id", "job_id", "source", "status", "is_india", "combined_score", never.alias("notified_at"),
        never.alias("applied_at"), F.lit(None).cast("string").alias("llm_reason")), "first-scored")
    sent = state.status_events(report.matches(rows, CFG), "notified", AS_OF, {
        "llm_reason": F.concat(F.lit("sent to "), "source")})
    return state.with_current_status(rows, sent).select(
        "doc_id", "status", F.unix_micros("notified_at").alias("notified_us"), "llm_reason")


@query("run_history", f"""WITH {SCORED}, r AS (SELECT *, CASE WHEN status = 'detected' THEN {duck.experience_reason()} END AS why FROM scored),
f AS (SELECT *, coalesce(why LIKE 'Senior%' OR why LIKE 'Requires%', false) AS exp_drop FROM r),
m AS (SELECT *, status = 'detected' AND NOT exp_drop AND is_india AND combined_score >= 0.25 AS matched FROM f)
SELECT 'r1' AS run_id, epoch_us({duck.AS_OF}) AS started_us, count(*) AS total_fetched, count(*) AS total_new,
 count(*) FILTER (matched) AS total_matched, count(*) FILTER (NOT is_india) AS total_filtered_location,
 count(*) FILTER (is_india AND (age_hours > 168 OR status = 'filtered')) AS total_filtered_relevance,
 count(*) FILTER (exp_drop) AS total_filtered_llm, count(*) FILTER (matched) AS total_notified,
 coalesce(max(combined_score) FILTER (matched), 0) AS best_score,
 round(coalesce(avg(combined_score) FILTER (matched), 0), 6) AS avg_score,
 (SELECT string_agg(source || '=' || n, ',' ORDER BY source) FROM (SELECT source, count(*) n FROM documents GROUP BY 1)) AS sources,
 (SELECT string_agg(line, chr(10) ORDER BY line) FROM (SELECT DISTINCT 'board' || (user_id % 20) || ': ' || event_type AS line
  FROM events WHERE event_type = 'error')) AS errors FROM m""")
def run_history(spark, sf_dir):
    new = score.with_experience(scored(spark, sf_dir), CFG)
    errors = table(spark, sf_dir, "events").filter("event_type = 'error'").select(
        F.lit("r1").alias("run_id"), F.concat(F.lit("board"), F.col("user_id") % 20).alias("source"),
        F.col("event_type").alias("error"))
    row = scan.scan_history(listings(spark, sf_dir), new, report.matches(new, CFG), errors, "r1", AS_OF, CFG)
    sources = F.array_join(F.transform(F.array_sort(F.map_entries("source_counts")), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return row.select(
        "run_id", F.unix_micros("started_at").alias("started_us"), "total_fetched", "total_new", "total_matched",
        "total_filtered_location", "total_filtered_relevance", "total_filtered_llm", "total_notified", "best_score",
        F.round("avg_score", 6).alias("avg_score"), sources.alias("sources"), "errors")
