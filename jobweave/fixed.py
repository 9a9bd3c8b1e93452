"""Word lists, limits, patterns and formats whose content decides the results."""

# Substrings of "title url" that mark a role as too senior.
SENIOR_KEYWORDS = [
    "senior", "sr.", "sr ", "staff", "principal", "director",
    "head of", "head,", "head ", "vp ", "vp,", "vice president",
    "avp", "a]vp", "group product", "group pm", "chief",
    "fellow", "distinguished", "architect", "lead product",
    "lead pm", "specialist",
]
SENIOR_YEARS = 5

# Whole words that mark a posting title as senior in the experience gate.
GATE_SENIOR_WORDS = [
    "senior", "lead", "staff", "principal", "director", "head", "vp", "avp",
    "group pm", "distinguished", "architect", "specialist",
]

# Tolerated gap in years between requirement and candidate.
GATE_TOLERANCE = 1.0
POST_TOLERANCE = 1.5

# Order in which search sources are concatenated, and board names by URL substring.
SOURCE_ORDER = {"LinkedIn": 0, "Naukri": 1, "Board": 2}
BOARDS = [("greenhouse", "Greenhouse"), ("lever", "Lever"), ("workday", "Workday")]
OTHER_BOARD = "JobBoard"

# Daily call limits, share at which calls stop and alerts start.
DAILY_LIMITS = {"serper": 1000, "hunter": 25, "groq": 1000}
DEFAULT_LIMIT = 1000
STOP_SHARE = 0.6
ALERT_PERCENT = 60

# Wording of an alert, and the head of a day's report.
ALERT_TEXT = "> [!WARNING]\n> **%s** usage: %d/%d (%.1f%%). Limit alert triggered!"
REPORT_HEAD = "# API Usage Alerts - "

# Result sizes and text lengths.
MAX_MATCHES = 10
MAX_SNIPPETS = 10
MAX_CONTACTS = 2
MAX_NEWS = 3
MAX_REFERRERS = 5
MAX_SKILLS = 15
MIN_POSTING_CHARS = 100
POSTING_CHARS = 4000
EVALUATION_CHARS = 3000
RESUME_CHARS = 4000
DRAFT_WORDS = 100

# Experience buckets, lower bound in years and label.
BUCKETS = [
    (12, "12+ years"), (8, "8-12 years"), (5, "5-8 years"),
    (3, "3-5 years"), (1, "1-3 years"), (0, "0-1 years"),
]

# Words that stand for "still in this role", and those cut out of a date text.
OPEN_END_WORDS = ["present", "current", "now", "null"]
OPEN_END_CUTS = ["present", "current"]

# Names of months and weekdays, and words that may stand in a date without a meaning.
MONTH_NAMES = [
    ("jan", "january"), ("feb", "february"), ("mar", "march"), ("apr", "april"), ("may",), ("jun", "june"),
    ("jul", "july"), ("aug", "august"), ("sep", "sept", "september"), ("oct", "october"), ("nov", "november"), ("dec", "december"),
]
WEEKDAY_NAMES = [
    ("mon", "monday"), ("tue", "tuesday"), ("wed", "wednesday"), ("thu", "thursday"), ("fri", "friday"),
    ("sat", "saturday"), ("sun", "sunday"),
]
DATE_FILLERS = ["at", "on", "and", "ad", "m", "t", "of", "st", "nd", "rd", "th"]

# Whitespace as Python's and JavaScript's trimming sees it (regex classes).
PY_SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
JS_SPACE = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

# Patterns for requirement phrases, companies, teams, remote work and contact details.
REQUIREMENT = r"(?i)(\d+\s*(?:[-–]\s*\d+|\+)?\s*(?:years?|yrs?))"
COMPANY = r"\b(?:About|at)\s+([A-Z0-9][A-Za-z0-9&-]*(?: [A-Z0-9][A-Za-z0-9&-]*)*)"
TEAM = r"\b[Tt]eam:\s*([A-Z][A-Za-z]+)"
REMOTE = r"(?i)\b(?:remote|wfh|work from anywhere)\b"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"\+?\d[\d ()-]{7,}\d"
MONTH_POINT = (r"(?:\d{1,2}/\d{4}|\d{4}-\d{1,2}|\d{1,2}-\d{4}|\d{4}"
               r"|(?:\d{1,2} )?(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]{0,6}\.?,? ?\x27?\d{2,4})")
DATE_RANGE = rf"(?i)^\s*({MONTH_POINT})\s*(?:[-–—]|to|until)\s*({MONTH_POINT}|present|current|now)\s*$"

# Words before a company name that mark a past job; titles that always count.
PAST_JOB = ["ex", "former", "past", "previously at", "worked at"]
LEADERSHIP = ["manager", "lead", "recruiter", "director"]
REFERRER_WORDS = ["recruiter", "lead", "manager"]
LEGAL_FORMS = ["inc", "ltd", "llc", "pvt", "corp", "co", "company", "limited"]

# Resume headings and the section each one opens.
HEADINGS = {
    "summary": "summary", "about me": "summary", "professional profile": "summary",
    "skills": "skills", "tools": "skills", "skills/tools": "skills",
    "experience": "experience", "work experience": "experience",
    "education": "education", "projects": "projects", "certifications": "certifications",
}

# Openers a draft must not start with.
BANNED_OPENERS = ["i hope this finds you well", "i am writing to", "my name is"]

# Defaults for missing request fields.
DEFAULT_TITLE = "Product Manager"
DEFAULT_DRAFT_TITLE = "Engineer"
DEFAULT_INDUSTRY = "General"
DEFAULT_LOCATION = "India"

# Search texts per target; {title}, {location}, {company} and {team} are filled in.
SEARCH_TEXTS = {
    "LinkedIn": 'site:linkedin.com/jobs/view "{title}" "{location}"',
    "Naukri": 'site:naukri.com "{title}" "{location}"',
    "Board": '"{title}" "{location}" (site:boards.greenhouse.io OR site:jobs.lever.co OR site:myworkdayjobs.com'
             " OR site:zohorecruit.com OR site:smartrecruiters.com OR site:jobs.ashbyhq.com)",
}
CONTACT_SEARCH = ('site:linkedin.com/in/ current "{company}" {team} '
                  '("Manager" OR "Lead" OR "Head" OR "Recruiter" OR "Director")')
REFERRAL_SEARCH = 'site:linkedin.com/in/ "{company}" ("Recruiter" OR "Lead" OR "Manager")'
NEWS_SEARCH = "{company} news"

# Fixed value: the wording of the plain draft.
DRAFT_TEXT = (
    "Hi {name},\n\n"
    "I came across your profile and was impressed by the work {company} is doing. I'm particularly interested in the "
    "{title} role and believe my background aligns well with your team's needs.\n\n"
    "With experience in modern frontend architecture, performance optimization, and cross-functional collaboration, "
    "I'm confident I could contribute meaningfully to {company}'s mission.\n\n"
    "I'd love to connect and learn more about your team's current challenges and goals. Would you be open to a brief "
    "conversation this week?\n\n"
    "Best regards,\n[Your Name]")

# Statuses after which the same model may be tried once more.
RETRY_STATUS = [500, 503, 429]

# HTML elements that are not main content, and character entities.
BOILERPLATE = ["script", "style", "nav", "footer", "aside", "header", "head"]
ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"),
]
