"""Word lists, boards, countries, queries and message formats.

Everything in this module is a fixed value that results depend on. Operators take each of
them as a parameter; these are the defaults.
"""

from __future__ import annotations

# --- Fixed values: title words ------------------------------------------------------------

TITLE_BLOCKS = [
    # finance
    "buchhalter", "steuerberat", "wirtschaftsprüf", "finanzberater", "controller",
    "accountant", "steuerrecht",
    # sales and marketing
    "verkäufer", "vertriebsmitarbeiter", "außendienst", "sales manager",
    "account manager", "marketing manager", "social media manager",
    "copywriter", "texter", "seo ",
    # recruiting
    "recruiter", "personalref", "personalberater", "hr manager", "talent acquisition",
    "personalentwicklung",
    # legal
    "rechtsanwalt", "rechtsanwältin", "jurist", "legal counsel", "notar",
    # care
    "arzt", "ärztin", "krankenpfleger", "pflegefachkraft", "pflegekraft",
    "therapeut", "apotheker", "nurse ", "physician", "erzieher", "hebamme",
    # logistics and trades
    "fahrer", "lagerist", "speditions", "zusteller", "elektriker",
    "sanitärinstallateur", "klempner", "maurer", "schreiner", "maler",
    # teaching
    "lehrer", "lehrerin", "grundschul", "gymnasiallehrer",
    # retail
    "kassierer", "kassiererin",
]

TITLE_KEYWORDS = [
    "machine learning", "deep learning", "computer vision", "robotics", "robot",
    "perception", "embedded software", "embedded systems", "embedded engineer",
    "data engineer", "data analyst", "data scientist", "data science",
    "c++ developer", "c++ engineer", "c++ programm",
    "python developer", "python engineer",
    "ai engineer", "ai developer", "ml engineer", "ml researcher",
    "software engineer", "software developer", "software entwickler",
    "autonom", "self-driving", "adas", "fahrerassistenz", "autonomous driving",
    "lidar", "slam", "sensor fusion", "point cloud",
    "research engineer", "research scientist", "research developer",
    "nlp engineer", "llm engineer", "generative ai", "computer scientist",
    "softwareentwickler", "softwareingenieur", "entwickler", "ingenieur",
]

TITLE_BROAD_TERMS = [
    "engineer", "developer", "analyst", "scientist", "architect",
    "researcher", "specialist", "ingenieur", "entwickler",
]

TITLE_SIGNALS = [
    "ai", "ml", "robot", "vision", "lidar", "slam", "sensor", "embedded",
    "data", "python", "c++", "perception", "autonom", "adas", "cloud",
    "nlp", "llm", "cuda", "gpu", "neural", "deep", "learning", "software",
    "backend", "hardware", "firmware", "autonomous",
]

# --- Fixed values: places -----------------------------------------------------------------

GERMANY_KEYWORDS = [
    "berlin", "munich", "münchen", "hamburg", "frankfurt", "cologne",
    "köln", "stuttgart", "düsseldorf", "dortmund", "essen", "bremen",
    "hannover", "nuremberg", "nürnberg", "germany", "deutschland",
    "de ",
]

REMOTE_WORDS = ["remote", "hybrid"]

# --- Fixed values: boards -----------------------------------------------------------------

LINKEDIN = "LinkedIn"
STEPSTONE = "StepStone"
XING = "Xing"
BA = "BA Jobbörse"

# Acquisition order of the boards; lower ranks win when a posting appears on several.
PLATFORM_RANK = {LINKEDIN: 0, STEPSTONE: 1, XING: 2, BA: 3}

# platform, country key, how the search country is compared, domain, route, path
PLATFORM_COUNTRY = [
    (LINKEDIN, "*", "any", "www.linkedin.com", "jobs", ""),
    (STEPSTONE, "Germany", "exact", "www.stepstone.de", "jobs", "in-deutschland"),
    (STEPSTONE, "Austria", "exact", "www.stepstone.at", "jobs", "in-oesterreich"),
    (STEPSTONE, "Belgium", "exact", "www.stepstone.be", "jobs", "in-belgien"),
    (STEPSTONE, "Netherlands", "exact", "www.stepstone.nl", "vacatures", "in-nederland"),
    (XING, "Germany", "ignore_case", "www.xing.com", "jobs", ""),
    (BA, "Germany", "ignore_case", "www.arbeitsagentur.de", "jobsuche", ""),
]

# Boards whose listings need the location test, drop blank descriptions, or are tested for
# freshness once more after the detail page.
NEEDS_LOCATION_CHECK = [LINKEDIN]
DROPS_BLANK_DESCRIPTION = [BA]
CHECKS_DATE_AFTER_DETAIL = [XING]
DEFAULT_LOCATION = {XING: "Germany"}

XING_ORIGIN = "https://www.xing.com"
XING_SEARCH_MARKER = "/jobs/search"
BA_DETAIL_PREFIX = "https://www.arbeitsagentur.de/jobsuche/jobdetail/"
BA_DEFAULT_LAND = "Deutschland"

LINKEDIN_PAGE_SIZE = 25
BA_PAGE_SIZE = 25
PAGES_PER_QUERY = 2
DETAILS_PER_QUERY = 20
MAX_AGE_HOURS = 48

_STEPSTONE_AND_XING_QUERIES = [
    "AI Engineer",
    "Machine Learning Engineer",
    "Robotics Engineer",
    "Computer Vision Engineer",
    "C++ Entwickler",
    "Python Entwickler",
    "Data Engineer",
    "Data Analyst",
    "Perception Engineer",
    "Development Engineer",
    "Embedded Software Engineer",
    "Research Engineer",
    "Trainee Programm",
    "Graduate Trainee",
    "Sensorfusion Ingenieur",
    "Algorithmenentwickler",
    "Autonomes Fahren Softwareentwickler",
    "Softwareentwickler Bildverarbeitung",
    "Deep Learning Entwickler",
    "Softwareentwickler Fahrerassistenz",
]

SEARCH_QUERIES = {
    LINKEDIN: [
        "AI Engineer",
        "Machine Learning Engineer",
        "Robotics Engineer",
        "Computer Vision Engineer",
        "C++ Developer",
        "Python Developer",
        "Data Engineer",
        "Data Analyst",
        "Research Engineer",
        "Perception Engineer",
        "Embedded Software Engineer",
        "Graduate Trainee Program",
        "Trainee Program Engineering",
        "Deep Learning Engineer",
        "Sensor Fusion Engineer",
        "Development Engineer",
        "Autonomous Systems Engineer",
        "Perception Software Engineer",
        "Algorithm Engineer",
        "ADAS Software Engineer",
        "Robotics Software Engineer",
        "Junior Application Engineer",
    ],
    STEPSTONE: _STEPSTONE_AND_XING_QUERIES,
    XING: _STEPSTONE_AND_XING_QUERIES,
    BA: [
        "AI Engineer",
        "Machine Learning Engineer",
        "Robotics Engineer",
        "Computer Vision Engineer",
        "C++ Entwickler",
        "Python Entwickler",
        "Research Engineer",
        "Data Engineer",
        "Data Analyst",
        "Development Engineer",
        "Perception Engineer",
        "Embedded Software Engineer",
        "Trainee Programm",
        "Graduate Trainee",
        "Sensorfusion Ingenieur",
        "Algorithmenentwickler",
        "Autonomes Fahren Softwareentwickler",
        "Softwareentwickler Bildverarbeitung",
        "Deep Learning Entwickler",
        "Softwareentwickler Fahrerassistenz",
    ],
}

# --- Fixed values: page selectors ---------------------------------------------------------
# A field is a list of (selector, attribute) tried in order; no attribute means the text.

CARD_SELECTORS = {
    LINKEDIN: {
        "card": ["ul.jobs-search__results-list > li", "div.base-card"],
        "title": [("h3.base-search-card__title", None)],
        "company": [("h4.base-search-card__subtitle", None)],
        "location": [("span.job-search-card__location", None)],
        "href": [("a.base-card__full-link", "href")],
        "posted": [("time", "datetime")],
    },
    STEPSTONE: {
        "card": ["article[data-at='job-item']", "article[class*='job']", "li[class*='ResultList']"],
        "title": [
            (
                "h2[data-at='job-item-title'], span[data-at='job-item-title'], "
                "a[data-at='job-item-title']",
                None,
            )
        ],
        "company": [("[data-at='job-item-company-name'], span[class*='company']", None)],
        "location": [("[data-at='job-item-location'], span[class*='location']", None)],
        "href": [
            ("a[href*='/stellenangebot/'], a[href*='/job/']", "href"),
            ("a[data-at='job-item-title']", "href"),
        ],
        "posted": [
            ("time, [data-at='job-item-date']", "datetime"),
            ("time, [data-at='job-item-date']", None),
        ],
    },
    XING: {
        "card": [
            "[data-testid*='job-card'], article",
            "li:has(a[href*='/jobs/'])",
            "div:has(a[href*='/jobs/'])",
        ],
        "title": [
            ("[data-testid*='job-title']", None),
            ("h2", None),
            ("h3", None),
            ("a[href*='/jobs/']", None),
        ],
        "company": [("[data-testid*='company']", None), ("[class*='company']", None), ("p", None)],
        "location": [
            ("[data-testid*='location']", None),
            ("[class*='location']", None),
            ("span:has-text('Germany')", None),
            ("span:has-text('Deutschland')", None),
        ],
        "href": [("a[href*='/jobs/']", "href")],
        "posted": [
            ("time", "datetime"),
            ("time", None),
            ("span:has-text('heute')", None),
            ("span:has-text('Heute')", None),
            ("span:has-text('Stunde')", None),
            ("span:has-text('Tag')", None),
            ("span:has-text('day')", None),
            ("span:has-text('hour')", None),
        ],
    },
}

# "stop" says whether the description search ends at the first element that exists, or only
# at the first one with text. Experience always ends at the first that exists.
DETAIL_SELECTORS = {
    LINKEDIN: {
        "stop": "exists",
        "description": [
            "div.description__text",
            "div.show-more-less-html__markup",
            "section.show-more-less-html",
            "div#job-details",
        ],
        "experience": [
            "ul.description__job-criteria-list li:has(h3:has-text('seniority')) span, "
            "ul.description__job-criteria-list li:has(h3:has-text('erfahrung')) span",
        ],
    },
    STEPSTONE: {
        "stop": "exists",
        "description": [
            "[data-at='job-ad-content']",
            "[data-at='job-ad-details-body']",
            "div[class*='jobAdBody']",
            "div[class*='JobDescription']",
            "section[class*='jobad']",
            "div.job-ad-display-8mvuy0",
            "article.js-app-ld-ContentBlock",
        ],
        "experience": [
            "[data-at='experience-requirements']",
            "span[class*='experience']",
            "li:has-text('Berufserfahrung')",
            "li:has-text('Experience')",
        ],
    },
    XING: {
        "stop": "nonblank",
        "description": [
            "[data-testid*='job-description']",
            "[class*='job-description']",
            "[class*='JobDescription']",
            "section:has-text('Deine Aufgaben')",
            "section:has-text('Your tasks')",
            "main",
        ],
        "experience": [
            "[data-testid*='career-level']",
            "[data-testid*='experience']",
            "li:has-text('Berufserfahrung')",
            "li:has-text('Experience')",
            "span:has-text('Berufseinsteiger')",
            "span:has-text('Entry')",
            "span:has-text('Junior')",
        ],
    },
}

# --- Fixed values: scoring ----------------------------------------------------------------

MODELS = ["groq/llama-3.3-70b-versatile", "groq/llama-3.1-8b-instant"]
MATCH_THRESHOLD = 7
FALLBACK_REASON = "Evaluation unavailable (API error)."
NO_DESCRIPTION = "No description available."
TRUNCATION_NOTE = "\n[description truncated]"
PROMPT_CHARS = 8000
RUN_BLOCKING_MARKERS = ["tokens per day", "tpd", "free-models-per-day"]
MAX_TOKENS = 800
TEMPERATURE = 0.1

# Regular expression and its replacement, applied in this order; {country} is filled in.
PROFILE_REWRITES = [
    (
        r"Germany only\. Remote positions are acceptable if the employer is clearly a German company or the role is contractually based in Germany\.",
        "{country} only. Remote positions are acceptable if the employer is clearly tied to {country} or the role is contractually based in {country}.",
    ),
    (r"based in Germany", "based in {country}"),
    (r"full-time permanent positions in Germany", "full-time permanent positions in {country}"),
    (r"full-time permanent roles in Germany", "full-time permanent roles in {country}"),
    (
        r"Germany only\. Remote positions are acceptable if the employer is clearly a German company\n"
        r"\(German address, German job board, or German language in posting\)\.",
        "{country} only. Remote positions are acceptable if the employer is clearly tied to {country}.",
    ),
    (
        r"Roles outside Germany unless remote for a confirmed German employer",
        "Roles outside {country} unless remote for a confirmed {country} employer",
    ),
    (
        r"Roles outside Germany \(unless remote for a confirmed German employer\)",
        "Roles outside {country} (unless remote for a confirmed {country} employer)",
    ),
]

SYSTEM_PROMPT = """You are an expert career advisor evaluating job postings for a specific candidate.

CANDIDATE PROFILE:
{profile}

YOUR TASK:
For each job posting I give you, decide whether it is a good fit for this candidate.
Base your decision on the full job DESCRIPTION content, not just the title.
A job titled "Autonomy Engineer" or "Softwareentwickler autonome Systeme" can be a
perfect match even if it doesn't say "AI Engineer" explicitly.

RESPOND with a single JSON object — no extra text, no markdown fences:
{{
  "score": <integer 1–10>,
  "reason": "<one concise paragraph: why it matches or doesn't, referencing specific details from both the job and the profile>"
}}

SCORING GUIDE:
  9–10 : Excellent fit – role, level, and tech stack align almost perfectly
  7–8  : Good fit – most requirements match, minor gaps
  5–6  : Partial fit – relevant domain but notable mismatches
  3–4  : Poor fit – wrong domain or wrong seniority level
  1–2  : No fit – unrelated to the candidate's background

HARD REJECTION RULES (score ≤ 3 regardless of other signals):
- Role requires 4+ years of experience AND description gives no junior pathway
- Role is outside {country} and not remote for an employer clearly tied to {country}
- Role has no software/engineering component (sales, HR, finance, legal, etc.)"""
