"""Word lists, patterns and constants that decide results.

They have to stay as they are for results to stay comparable between builds.
"""

# --- e-mail -----------------------------------------------------------------
PLACEHOLDER_LOCALS = [
    "example", "name", "firstname.lastname", "first.last", "username", "user", "email", "yourname",
]
ROLE_LOCALS = [
    "info", "admin", "webmaster", "office", "contact", "enquiries", "inquiries", "help",
    "support", "news", "media", "press", "admissions", "reception", "dept", "department",
    "noreply", "no-reply", "communications", "marketing", "events", "hr", "jobs", "it",
]
IMAGE_ENDINGS = [".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp"]
EMAIL_LOCAL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*"
EMAIL_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
EMAIL_TLD = r"[A-Za-z]{2,24}"
EMAIL_LABELS = 126  # before the last one: a domain name has 127 labels at most

# --- domains ----------------------------------------------------------------
SECOND_LEVEL = ["ac", "edu", "co", "com", "org", "gov", "net"]

# --- names and organisations --------------------------------------------------
HONORIFICS = [
    "dr", "prof", "professor", "mr", "mrs", "ms", "sir", "dame", "phd", "md", "frs", "jr", "sr",
]
ORG_FILLER = [
    "the", "of", "and", "at", "de", "del", "der", "des", "di", "du", "la", "le", "y", "e", "für", "fur",
    "university", "universite", "universitat", "universidad", "universita", "universiteit", "universitet",
    "universidade", "universitaet", "uni", "u",
]

# --- titles and roles -----------------------------------------------------------
# Possessive (*+, ++): Java walks such a group in a loop, where a plain one recurses once per repeat. What follows a run of
# these words can never be one of them, so both accept the same; a title starts at the first word of its run.
_BEFORE_TITLE = (
    "Distinguished |Regius |University |Emeritus |Emerita |Senior |Principal |Visiting |Adjunct |Research |Clinical |Full "
)
TITLE_PATTERN = (
    rf"(?<!\b(?:{_BEFORE_TITLE}))\b((?:{_BEFORE_TITLE})*+(?:Assistant |Associate )?(?:Professor|Lecturer|Reader|Fellow|Chair)"
    r"(?:\s+(?:of|in)\s+[A-Z][A-Za-z&,\- ]{2,80}?)?)(?=\s*(?:[.;|\n<]|,\s|$| at | in the ))"
)
ROLE_RULES = [
    ("student", ["phd student", "doctoral student", "doctoral candidate", "phd candidate", "graduate student"]),
    ("postdoc", ["postdoc", "post-doc", "postdoctoral"]),
    ("emeritus", ["emeritus", "emerita", "retired"]),
    ("faculty", ["professor", "lecturer", "reader", "chair ", "principal investigator", "group leader",
                 "head of", "director"]),
    ("researcher", ["fellow", "scientist", "researcher", "research associate", "investigator", "staff"]),
]
EMPLOYMENT_ORDER = [
    "professor", "lecturer", "reader", "chair", "principal investigator", "group leader", "fellow",
    "scientist", "researcher",
]
LEAD_THRESHOLD = 60

# --- concepts ---------------------------------------------------------------------
STOP_WORDS = (
    "a an and are as at be by for from in into is of on or the to with within via its their our we using use "
    "used based toward towards"
).split()
# Compared after stemming (see functions.text.stem).
GENERIC_WORDS = (
    "activity advance analysis application approach aspect assessment development effect evaluation "
    "framework impact investigation issue management method methodology model modeling modelling "
    "new novel outcome performance perspective practice problem process recent research review "
    "role science strategy strategic studies study system technique technology theory tool "
    "trend understanding work general various related other topic field area interest"
).split()
EVIDENCE_STOP = ["and", "the", "for", "with", "of", "in", "on", "to", "a", "an"]

# --- document profiles ----------------------------------------------------------------
FOCUS_HEADING = (
    r"(?i)^(research\s+(interests?|summary|statement|focus|areas?|overview)"
    r"|areas?\s+of\s+(research|interest|expertise)|interests?|summary|professional\s+summary|objective|profile"
    r"|about(\s+me)?|abstract|expertise|keywords?)\s*:?$"
)
LIST_HEADING = (
    r"(?i)^(research\s+interests?|areas?\s+of\s+(research|interest|expertise)|interests?|expertise|keywords?)\s*:?$"
)
OTHER_HEADING = (
    r"(?i)^(education|experience|employment|work\s+experience|professional\s+experience|publications?"
    r"|selected\s+publications?|awards?|honou?rs|skills|references|teaching|service|projects?|courses|contact"
    r"|presentations?|patents?|talks|affiliations?|funding|grants|research\s+experience)\s*:?$"
)
NOISE_LINE = (
    r"(?i)(@|https?://|www\.|linkedin\.com|github\.com|scholar\.google|orcid\.org|curriculum\s+vitae"
    r"|\bpage\s+\d+|\+?\d[\d\s().-]{8,}\d)"
)
LEAD_INS = r"(?i)^(?:i am |i'm |also |interested in |working on |my research is )++"

# --- sizes -------------------------------------------------------------------------------
MAX_DOMAINS = 5
MAX_RECENT = 5
MAX_TOPIC_TAGS = 6
MAX_KEYWORD_TAGS = 3
MAX_TAGS = 8
MIN_KEYWORD_SCORE = 0.3
RECORD_CHUNK = 1000
VECTOR_BYTES = {"int8": 560, "bits": 84}
MAX_MATCHES = 1000
PROBE_START = 24
PROBE_MAX = 192
ENOUGH_FILTERED = 200
KMEANS_ITERATIONS = 8
TAG_BOOST = 0.15
FILTER_SCOPE_ROWS = 150_000
URL_PREFIXES = ["https://orcid.org/", "https://openalex.org/"]
CSV_COLUMNS = [
    "Name", "Title", "University", "Country", "University rank", "Email", "Profile link", "Status", "Notes", "Saved",
]

# --- quality and evaluation --------------------------------------------------------------------
MAX_SHRINK = 0.20
MIN_PREVIOUS_FOR_CHECK = 50
SMALL_INSTITUTION_SHARE = 0.5
MIN_TOP_SCORE = 0.30
PASS_RATIO = 0.8
SHOWCASE_MIN_SCORE = 0.40
EVIDENCE_FOR_TOP = 5
MIN_DOCUMENT_CHARS = 200
