"""Words, names, patterns and formats that results depend on.

Everything in this file is data.  It has to be exactly this for the results to
come out right, so it is kept as plain text, together, in natural order.
"""

# --- Fixed values: sources -------------------------------------------------
SOURCE_LABELS = {
    "innovate_uk": "Innovate UK",
    "Innovate UK": "Innovate UK",
    "iuk_business_connect": "Innovate UK",
    "horizon_europe": "Horizon Europe",
    "ukri": "UKRI",
    "konfer": "Konfer",
    "Konfer": "Konfer",
}
SOURCE_KEYS = {
    "Innovate UK": "innovate_uk",
    "iuk_business_connect": "innovate_uk",
    "Konfer": "konfer",
}
SOURCE_ALIASES = {
    "innovate_uk": ("innovate_uk", "Innovate UK", "iuk_business_connect"),
    "horizon_europe": ("horizon_europe",),
    "ukri": ("ukri",),
    "konfer": ("konfer", "Konfer"),
}
SOURCE_ORDER = {"innovate_uk": 0, "ukri": 1, "horizon_europe": 2, "konfer": 3}
CORE_SOURCES = ("innovate_uk", "ukri", "horizon_europe", "konfer")
SOURCE_PRIORITY = {
    "iuk_business_connect": 0,
    "horizon_europe": 0,
    "innovate_uk": 1,
    "Innovate UK": 1,
    "ukri": 1,
    "konfer": 2,
    "Konfer": 2,
}
HEALTH_SOURCES = (
    ("innovate_uk", "Innovate UK"),
    ("iuk_business_connect", "IUK Business Connect"),
    ("ukri", "UKRI"),
    ("horizon_europe", "Horizon Europe"),
    ("konfer", "Konfer"),
)
UNRANKED = 99

# --- Fixed values: site addresses ------------------------------------------
COMPETITION_BASE = "https://apply-for-innovation-funding.service.gov.uk"
CONNECT_BASE = "https://iuk-business-connect.org.uk"
CONNECT_HOST = "iuk-business-connect.org.uk"
CONNECT_GENERIC_PATH = "/programme/"
COUNCIL_BASE = "https://www.ukri.org"
BROKER_BASE = "https://konfer.online"
PORTAL_BASE = "https://ec.europa.eu/info/funding-tenders/opportunities/portal"
PORTAL_TOPIC_PATH = "/screen/opportunities/topic-details/"
PORTAL_CALLS_PATH = "/screen/opportunities/calls-for-proposals?"
PORTAL_CALLS_MARK = "/competitive-calls-cs/"
PORTAL_CALLS_TYPE = "8"
PORTAL_RECORD_TYPES = ("1", "2", "8")
PORTAL_STATUSES = ("31094501", "31094502")
PORTAL_PERIOD = "2021 - 2027"
PORTAL_PAGE_SIZE = 50
PORTAL_PROGRAMME = "43108390"

# --- Fixed values: places ----------------------------------------------------
UK_WIDE = "uk_wide"
UNKNOWN_PLACE = "unknown"
PLACE_EXPLICIT_PATTERNS = (
    r"\b(?:businesses|organisations|applicants|companies|smes|enterprises)\s+(?:must\s+be\s+)?(?:based|located|registered)\s+in\s+([a-z ]+)",
    r"\bopen\s+to\s+(?:businesses|organisations|applicants|companies|smes|enterprises)\s+(?:based|located|registered)\s+in\s+([a-z ]+)",
    r"\bfor\s+(?:businesses|organisations|applicants|companies|smes|enterprises)\s+(?:based|located|registered)\s+in\s+([a-z ]+)",
)
PLACE_EXPLICIT_MARKS = ("based in", "located in", "registered in")
PLACE_WORDS = (
    ("scotland", ("scotland",)),
    ("wales", ("wales",)),
    ("northern_ireland", ("northern ireland",)),
    ("england_north_east", ("north east",)),
    ("england_north_west", ("north west",)),
    ("england_yorkshire", ("yorkshire", "humber")),
    ("england_east_midlands", ("east midlands",)),
    ("england_west_midlands", ("west midlands",)),
    ("england_london", ("london",)),
    ("england_south_east", ("south east",)),
    ("england_south_west", ("south west",)),
)
PLACE_EAST_PATTERN = r"\beast of england\b|\beast england\b"
PLACE_PHRASES = (
    ("scotland", ("Scottish Enterprise", "SMART Scotland", "Highlands and Islands Enterprise",
                  "Highlands Islands Enterprise", "South of Scotland Enterprise"), r"\bfor scotland\b"),
    ("wales", ("Development Bank of Wales", "Business Wales", "Welsh Government"), r"\bfor wales\b"),
    ("northern_ireland", ("Invest Northern Ireland", "Invest NI"), r"\bfor northern ireland\b"),
    ("england_east_midlands,england_west_midlands", ("Midlands Engine",), None),
    ("england_north_east,england_north_west,england_yorkshire", ("Northern Powerhouse",), None),
    ("england_south_west", ("South West Investment Fund",), None),
    ("england_south_east", ("South East Investment Fund",), None),
    ("england_north_east", ("North East Investment Fund",), None),
    ("england_north_west", ("North West Investment Fund",), None),
    ("england_yorkshire", ("Yorkshire and Humber Investment Fund", "Yorkshire Investment Fund"), None),
    ("england_east_midlands", ("East Midlands Investment Fund",), None),
    ("england_west_midlands", ("West Midlands Investment Fund",), None),
    ("england_east", ("East of England Investment Fund",), None),
    ("england_london", ("London Investment Fund",), None),
)

# --- Fixed values: applicants ------------------------------------------------
ANY_APPLICANT = "any"
APPLICANT_ORDER = ("business", "academic", "research_org", "public_sector", "charity", "individual")
APPLICANT_GATE_WORDS = (
    "eligible", "eligibility", "apply", "applicant", "applicants", "open to", "for", "must be",
    "lead organisation", "lead applicant", "can apply",
)
APPLICANT_WORDS = (
    ("business", ("businesses", "companies", "smes", "micro businesses", "enterprises",
                  "industry partner", "industry partners")),
    ("academic", ("universities", "university", "higher education institution", "higher education institutions",
                  "hei", "heis", "academic institution", "academic institutions")),
    ("research_org", ("research organisation", "research organisations", "research institute", "research institutes",
                      "rto", "rtos", "catapult", "catapults")),
    ("public_sector", ("public sector", "local authorities", "local authority", "nhs",
                       "government department", "government departments")),
    ("charity", ("charities", "charity", "non profit", "non profits", "not for profit", "not for profits",
                 "voluntary organisation", "voluntary organisations")),
    ("individual", ("individuals", "doctoral student", "doctoral students", "student", "students",
                    "fellow", "fellows", "researcher", "researchers")),
)
PARTNERSHIP_WORDS = ("knowledge transfer partnership", "knowledge transfer partnerships", "aktp", "ktp")
PERSONAL_WORDS = (
    "fellowship", "fellowships", "doctoral", "studentship", "phd", "early career", "new investigator", "personal award",
)
PERSONAL_ACADEMIC_PHRASES = ("university", "higher education institution", "hei", "academic institution")
BUSINESS_PHRASES = (
    "Innovate UK", "SMART grant", "SMART grants", "Contracts for Innovation",
    "Small Business Research Initiative", "SBRI", "collaborative research and development",
    "collaborative R&D", "accelerator", "investment fund", "loan fund", "business loan",
)
BUSINESS_SOURCES = ("innovate_uk", "innovate uk", "iuk_business_connect")
EU_SOURCES = ("horizon_europe", "horizon europe")
PARTNER_NEEDED_PATTERN = r"\b(?:must|requires?|required)\b.{0,80}\b(?:academic|university|hei)\b"
COUNCIL_NAMES = (
    "AHRC", "Arts and Humanities Research Council",
    "BBSRC", "Biotechnology and Biological Sciences Research Council",
    "EPSRC", "Engineering and Physical Sciences Research Council",
    "ESRC", "Economic and Social Research Council",
    "MRC", "Medical Research Council",
    "NERC", "Natural Environment Research Council",
    "STFC", "Science and Technology Facilities Council",
)
CLASS_TEXT_FIELDS = (
    "source", "title", "organisation", "funders", "funder", "award", "opportunity_type",
    "sector_tags", "niche_tags", "summary", "description", "eligibility", "eligibility_text",
)

# --- Fixed values: money, dates, links ---------------------------------------
MONEY_PATTERN = r"(?iU)(?:£|GBP\s*)([\d,]+(?:\.\d+)?)\s*(million|m|k)?"
POUND_PATTERN = r"(?iU)£\s*([\d,]+(?:\.\d+)?)\s*(million|m|thousand|k)?\b"
MONEY_SCALE = {"million": 1_000_000.0, "m": 1_000_000.0, "thousand": 1_000.0, "k": 1_000.0}
NOT_A_MINIMUM_PATTERN = r"(?i)\b(up to|maximum|share of)\b"
ORDINAL_PATTERN = r"(?i)(\d+)(st|nd|rd|th)"
FREE_TEXT_URL_PATTERN = r"(?U)https?://[^\s)]+"
COMPETITION_PATTERN = r"/competition/([^/]+)/"
EU_REFERENCE_PATTERN = r"\bHORIZON-[A-Za-z0-9-]+(?:-[A-Za-z0-9]+)*\b"
NO_DATE_WORDS = ("to be confirmed", "no closing date")

# --- Fixed values: page parts -------------------------------------------------
WANTED_HEADING_PATTERN = (
    r"(?i)\b(description|scope|specific themes|eligibility|who can apply|your project"
    r"|funding|project costs?|subsidy|grant)\b"
)
SOLE_FUNDER = "innovate uk"
TITLE_PREFIX = "Funding opportunity:"
BROKER_NICHE = "Grant Funding"
KEYWORD_LIMIT = 8
SUMMARY_CHARS = 320

# --- Fixed values: report columns -----------------------------------------------
TAG_CODE_PATTERN = r"^[A-Z0-9]+(?:-[A-Z0-9]+){2,}$"
TAG_PREFIX_PATTERN = r"(?i)^HORIZON\s+"
TAG_ALWAYS_DROPPED = "horizon europe"
TAG_LIMIT = 6
WORD_CHIP_LIMIT = 4
WORD_CHIP_MIN_CHARS = 4
WORD_CHIP_BREAKS = r"[,.:()/&\-]"
WORD_CHIP_STOP = (
    "and", "or", "for", "with", "the", "a", "an", "to", "of", "in", "on", "by", "from",
    "uk", "share", "apply", "grant", "fund", "funding", "competition", "competitions",
    "project", "projects", "organisations", "organisation", "registered", "businesses", "business",
)
CLOSING_SOON_DAYS = 14
STATUS_GROUPS = ("open", "rolling", "upcoming")
HEALTH_TEXT = {
    "success": "Loaded successfully",
    "today_pending": "Today's refresh pending",
    "partial_success": "Partially loaded",
    "failed": "Daily run failed",
    "unknown": "Ingest status unknown",
}
NEVER_UPDATED_TEXT = "Not yet updated"
NO_DATE_TEXT = "TBD"
ZERO_RESULT_TEXT = "Konfer checked successfully: no unique opportunities found."
LAST_SUCCESS_KEY = "last_successful_ingest_at"
LAST_RUN_KEY = "last_ingest_run"
SOURCE_STATUS_PREFIX = "source_status:"
BROKER_CHECK_KEY = "source_check:konfer"
