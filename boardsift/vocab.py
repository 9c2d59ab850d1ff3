"""Word lists, weights and texts.

Every name in this module is a fixed value: matching is defined by these exact
terms, in this order.  They are defaults only; each operator takes its lists as
parameters (see ``config.py``).
"""

# Weighted skills of the 0-1 keyword score.
SKILL_WEIGHTS = {
    "data scientist": 0.1, "data analyst": 0.1, "machine learning": 0.1,
    "deep learning": 0.1, "ml engineer": 0.1, "nlp": 0.08,
    "power bi": 0.08, "tableau": 0.08, "pytorch": 0.08,
    "tensorflow": 0.08, "scikit-learn": 0.07, "xgboost": 0.07,
    "python": 0.05, "sql": 0.05, "pandas": 0.05, "numpy": 0.05,
    "statistics": 0.05, "regression": 0.05, "classification": 0.05,
    "neural network": 0.05, "transformer": 0.05, "bert": 0.05,
    "gpt": 0.05, "llm": 0.05, "rag": 0.05,
    "airflow": 0.05, "spark": 0.05, "aws": 0.05, "azure": 0.05,
    "docker": 0.05, "mlops": 0.05, "model deployment": 0.05,
    "excel": 0.03, "dashboard": 0.03, "visualization": 0.03,
    "etl": 0.03, "data pipeline": 0.03, "jupyter": 0.03,
    "git": 0.03, "api": 0.03, "fastapi": 0.03,
}

# Integer points of the 0-50 keyword score.
SKILL_POINTS = {
    "python": 8, "machine learning": 10, "deep learning": 10,
    "nlp": 8, "pytorch": 8, "tensorflow": 8, "keras": 7,
    "xgboost": 7, "scikit-learn": 7, "sklearn": 7,
    "data scientist": 10, "ml engineer": 10,
    "aws": 6, "airflow": 6, "etl": 5, "sql": 6,
    "bert": 7, "transformer": 7, "neural network": 8,
    "time series": 7, "arima": 6, "forecasting": 6,
    "power bi": 10, "tableau": 9, "data analyst": 10,
    "dax": 8, "power query": 7, "excel": 5,
    "sql server": 7, "postgresql": 6, "mysql": 6,
    "data visualization": 8, "business intelligence": 8,
    "bi developer": 9, "analytics": 7,
    "dashboard": 6, "reporting": 5,
}

# A title holding one of these is irrelevant.
TITLE_EXCLUDED = [
    "sales", "salesperson", "business development", "bdr", "sdr",
    "account executive", "account manager", "customer success",
    "recruiter", "hr partner", "talent acquisition", "human resource",
    "marketing manager", "content writer", "copywriter",
    "graphic designer", "ui/ux designer", "product designer",
    "civil engineer", "mechanical engineer", "electrical engineer",
    "doctor", "nurse", "teacher", "professor", "chef", "driver",
    "accountant", "finance manager", "ca", "chartered accountant",
    "director", "vp", "vice president", "chief", "cto", "cdo", "ceo",
    "head of", "principal architect", "distinguished engineer",
]

# A title must hold one of these.
TITLE_REQUIRED = [
    "data", "analyst", "scientist", "ml", "machine learning",
    "ai", "intelligence", "analytics", "bi", "engineer", "python",
]

# The home-country test.
HOME_TERMS = [
    "india", "pune", "mumbai", "bangalore", "bengaluru",
    "hyderabad", "chennai", "delhi", "ncr", "noida", "gurgaon",
]

# The remote-work test.
REMOTE_TERMS = [
    "remote", "work from home", "wfh", "anywhere", "worldwide",
    "global", "distributed", "fully remote", "remote-first", "apac",
]

# Phrases that close a remote listing to other countries.
EXCLUSIVE_PHRASES = [
    "us only", "usa only", "united states only",
    "europe only", "eu only", "uk only",
    "us-based", "us based", "must be in us",
    "canada only", "australia only",
]

# Other countries and places.
FOREIGN_TERMS = [
    "usa", "u.s.", "united states", "america", "canada",
    "uk", "united kingdom", "london", "europe", "germany",
    "australia", "singapore", "dubai", "uae", "philippines",
    "vietnam", "poland", "romania", "brazil", "mexico",
    "nigeria", "kenya", "south africa",
]

# Locations that say nothing.
BLANK_LOCATIONS = ["", "unknown", "n/a", "not specified", "tbd"]

# Term -> city, first hit in this order wins.
CITY_BY_TERM = {
    "pune": "Pune", "mumbai": "Mumbai", "bangalore": "Bangalore",
    "bengaluru": "Bangalore", "hyderabad": "Hyderabad", "chennai": "Chennai",
    "delhi": "Delhi", "noida": "Noida", "gurgaon": "Gurgaon",
    "gurugram": "Gurgaon", "kolkata": "Kolkata",
}

# Category -> terms, first category with a hit wins.
CATEGORY_TERMS = {
    "ML Engineering": ["ml engineer", "machine learning engineer", "deep learning"],
    "Data Science": ["data scientist", "research scientist", "applied scientist"],
    "Data Engineering": ["data engineer", "etl", "data pipeline", "spark", "airflow"],
    "BI Developer": ["power bi", "tableau", "bi developer", "business intelligence"],
    "Data Analytics": ["data analyst", "business analyst", "analytics"],
}
OTHER_CATEGORY = "Other"

# Listing states.
STATUSES = ["detected", "filtered", "notified", "applied", "rejected", "expired"]

# Location allow-lists of the applicant-tracking boards.
ATS_LOCATIONS = [
    "india", "bangalore", "bengaluru", "mumbai", "pune",
    "hyderabad", "delhi", "gurgaon", "noida", "chennai",
    "remote", "anywhere", "worldwide", "global", "apac",
]
ATS_LOCATIONS_SHORT = ["india", "bangalore", "remote", "anywhere", "global"]

# Search keywords by theme.
SEARCH_KEYWORDS = {
    "data_science": [
        "data scientist", "machine learning", "ml engineer",
        "deep learning", "nlp engineer", "ai engineer",
        "data science", "applied scientist", "research scientist",
        "computer vision", "llm engineer", "ai ml",
    ],
    "data_analytics": [
        "data analyst", "business analyst", "analytics",
        "sql analyst", "reporting analyst", "bi analyst",
        "product analyst", "analytics engineer", "insight analyst",
    ],
    "bi_developer": [
        "power bi", "tableau", "bi developer",
        "business intelligence", "visualization analyst",
        "dashboard developer", "looker", "qlik",
    ],
    "data_engineering": [
        "data engineer", "etl developer", "python developer",
        "spark developer", "airflow", "dbt developer",
        "big data engineer", "analytics engineer",
    ],
    "general_tech": [
        "python", "sql", "machine learning engineer",
        "artificial intelligence", "data", "analyst",
    ],
}

# Extra keywords of the crypto board.
CRYPTO_EXTRA_KEYWORDS = ["data", "analyst", "python", "ml", "ai"]

# Day-of-month rotation of keyword pairs for the metered search.
ROTATING_KEYWORD_GROUPS = [
    ["data scientist", "machine learning engineer"],
    ["data analyst", "business analyst"],
    ["power bi developer", "tableau analyst"],
    ["python developer data", "sql analyst"],
    ["ai engineer", "nlp engineer"],
    ["data engineer", "analytics engineer"],
]

# Tagged search configurations (tag -> keywords).
TAGGED_CONFIGS = {
    "Data Science": ["data scientist", "machine learning", "ml engineer",
                     "data science", "deep learning", "nlp", "ai engineer"],
    "Data Analytics": ["data analyst", "business analyst", "analytics",
                       "data analysis", "sql analyst", "reporting analyst"],
    "BI Developer": ["power bi", "tableau", "bi developer",
                     "business intelligence", "visualization", "dashboard"],
}

# Sites kept from search-engine results.
KNOWN_SITES = ["linkedin", "naukri", "indeed", "glassdoor", "monster"]

# Alert decoration.
CATEGORY_TAGS = {
    "Data Science": "🧪 DS",
    "Data Analytics": "📊 DA",
    "ML Engineering": "🤖 ML",
    "BI Developer": "📈 BI",
    "Data Engineering": "⚙️ DE",
}
DEFAULT_CATEGORY_TAG = "💼"
SCORE_TIERS = [(0.7, "🔥"), (0.5, "✨")]
DEFAULT_TIER = "📌"

# Hours of the day at which the metered search may run.
METERED_RUN_HOURS = [8, 20]
