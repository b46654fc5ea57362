"""Vocabularies and constants that define what the operators decide.

Fixed values: the word lists, host lists, weights and thresholds below must equal
those that results are compared against.
"""

from __future__ import annotations

# fmt: off
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "source")
TRACKING_PREFIX = "utm_"
TITLE_NOISE = ("official", "registration", "register", "applications", "application")
ORGANIZER_SUFFIXES = ("inc", "corporation", "corp", "university", "philippines", "ph")
REGISTRATION_MARKERS = ("forms.gle/", "docs.google.com/forms", "eventbrite.com/e/", "devpost.com/register", "/register", "/registration", "/apply", "lu.ma/")
LISTING_MARKERS = ("/d/", "/discover", "/search", "/sitemap", "/browse", "/tag/", "/category/", "/categories/", "/hackathons/", "/events/browse")
LISTING_KEYS = ("q", "query", "search")
NEWS_MARKERS = ("/news/", "/newsroom/", "/press-release/", "/press-releases/", "/article/", "/articles/", "/stories/", "/story/", "/bulletin/", "/announcements/", "/blog/")
DATED_PATH = r"/20[0-9]{2}/[0-9]{1,2}(/[0-9]{1,2})?/"

CATEGORY_TERMS = (
    ("BUSINESS_CASE", ("business case competition", "case competition")),
    ("CONSULTING_COMPETITION", ("consulting competition", "strategy competition")),
    ("AI_COMPETITION", ("ai competition", "artificial intelligence challenge")),
    ("DATATHON", ("datathon", "data challenge")),
    ("HACKATHON", ("hackathon", "hack-a-thon", "hackaton", "hakaton", "codefest", "buildathon", "code league")),
    ("IDEATHON", ("ideathon", "idea competition")),
    ("STARTUP_COMPETITION", ("startup competition", "pitch competition")),
    ("INNOVATION_CHALLENGE", ("innovation challenge", "innovation competition")),
)
OTHER_TERMS = ("competition", "challenge")
COMPETITION_TERMS = (
    "hackathon", "hackaton", "hakaton", "hack-a-thon", "buildathon", "codefest", "code fest", "code league", "datathon", "ideathon", "case competition",
    "case comp", "business case", "pitch competition", "startup competition", "innovation challenge", "innovation competition", "consulting competition",
    "coding competition", "programming competition", "kompetisyon", "paligsahan",
)
RESULT_TERMS = ("congratulations to", "winner announcement", "winning team", "champions of", "winners of")
RECAP_TERMS = ("event recap", "successfully held", "highlights from", "concluded last", "last weekend")
HEADLINE_RESULT_TERMS = RESULT_TERMS + (
    "champion", "champions", "secure top spot", "secures top spot", "secured top spot", "top spot", "top honors", "top honours", "bags", "bagged", "clinch",
    "clinches", "clinched", "emerged as", "emerges as", "hailed as", "crowned", "victorious", "grand winner", "1st place", "2nd place", "3rd place",
    "first place", "second place", "third place", "placed first", "placed second", "placed third", "wins", "won the", "triumph", "excel at", "excel in the",
    "excels at", "excelled at", "shine at", "shines at", "shone at", "dominate at", "dominates", "dominated", "sweeps", "swept", "tops the", "topped the",
    "represent the philippines", "advance to the", "qualified for",
)
HEADLINE_RECAP_TERMS = RECAP_TERMS + (
    "concluded", "culminated", "wrapped up", "showcases", "showcased", "was held", "were held", "took place", "recently held", "successfully concluded",
    "look back", "in review",
)
HEADLINE_CHARS = 200
ACTION_TERMS = (
    "registration is now open", "registration now open", "applications are now open", "applications now open", "registration is open",
    "registration open until", "applications are open", "applications open until", "open for registration", "now accepting", "accepting applications",
    "accepting entries", "accepting registrations", "sign ups are open", "sign-ups are open", "register now", "apply now", "registration deadline",
    "form your team", "calling all students",
)
JOB_TERMS = ("job opening", "we are hiring", "apply for this role")
CONTEST_TERMS = ("competition", "contest", "olympiad", "call for entries", "call for applications", "call for participants")
WEAK_HINTS = ("challenge", "hack", "pitch", "case study", "tilt")

PH_TERMS = ("philippines", "philippine", "filipino", "filipinas", "pilipinas", "pilipino", "metro manila")
FOREIGN_PLACES = (
    ("MY", ("malaysia", "kuala lumpur", "putrajaya", "selangor", "johor", "penang", "sabah", "sarawak", "planmalaysia")),
    ("SG", ("singapore",)),
    ("ID", ("indonesia", "jakarta", "bandung", "surabaya")),
    ("VN", ("vietnam", "hanoi", "ho chi minh")),
    ("TH", ("thailand", "bangkok", "chiang mai")),
    ("IN", ("bengaluru", "bangalore", "mumbai", "new delhi", "chennai", "hyderabad")),
    ("PK", ("pakistan", "karachi", "lahore", "islamabad")),
)
MALAY_MARKERS = (
    "jom", "sertai", "kategori", "orang awam", "bersediakah", "kecerdasan buatan", "pertandingan", "peserta", "percuma", "negeri", "sila", "hadiah",
    "penyertaan", "anjuran", "masa depan",
)
MALAY_LEAST = 2

CITY_ALIASES = (
    ("bgc", "Taguig"), ("bonifacio global city", "Taguig"), ("makati", "Makati"), ("taguig", "Taguig"), ("quezon city", "Quezon City"),
    ("pasig", "Pasig"), ("mandaluyong", "Mandaluyong"), ("pasay", "Pasay"), ("san juan", "San Juan"), ("manila", "Manila"),
    ("up diliman", "Quezon City"), ("ateneo de manila", "Quezon City"), ("de la salle university", "Manila"),
)
CITY_REGION = "Metro Manila"
METRO_CITIES = ("manila", "makati", "taguig", "quezon city", "pasig", "mandaluyong", "pasay", "san juan")
ONLINE_TERMS = ("online", "virtual", "remote")
EXCLUDES_TERMS = ("residents of philippines are not eligible", "excluding philippines", "not open to philippines")
ALLOWS_TERMS = ("open to filipinos", "participants from the philippines", "philippine residents", "nationwide", "open to all countries", "worldwide", "global competition")
STUDENT_TERMS = ("college students", "university students", "undergraduate students")
STUDENT_ONLY_TERMS = ("only", "exclusive", "currently enrolled")
PROFESSIONAL_TERMS = ("professionals", "open to everyone", "open to all")
ELIGIBILITY_MARKERS = ("eligible", "eligibility", "student", "resident", "participants from", "open to", "excluding", "nationwide")
CLOSED_TERMS = ("registration closed", "applications closed", "no longer accepting")
FORTHCOMING_TERMS = ("registration opens", "applications will open", "coming soon")
TOPICS = ("ai", "software", "data", "technology", "consulting", "strategy", "business")
DATE_LABELS = (
    ("registration_deadline", (
        "registration deadline", "applications close", "registration closes", "registration is open until", "registration open until",
        "applications open until", "open until", "apply until", "register until", "submissions close", "entries close", "last day to register", "deadline",
    )),
    ("event_start", ("event date", "hackathon date", "starts on", "competition date")),
    ("registration_open_date", ("registration opens", "applications open")),
)
DATE_WINDOW = 160
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
ZONE = "Asia/Manila"

SHORTENERS = (
    "bit.ly", "tinyurl.com", "t.co", "goo.gl", "is.gd", "ow.ly", "cutt.ly", "rb.gy", "rebrand.ly", "shorturl.at", "s.id", "lnkd.in", "linktr.ee", "lnk.bio",
    "onelink.me", "sk-qr.com", "qr.link",
)
FORM_HOSTS = (
    "forms.gle", "docs.google.com", "forms.office.com", "forms.microsoft.com", "typeform.com", "tally.so", "jotform.com", "airtable.com", "eventbrite.com",
    "lu.ma", "luma.com",
)
CHROME_HOSTS = ("accountscenter.facebook.com", "messenger.com", "www.messenger.com")
CHROME_PATHS = (
    "/login", "/checkpoint", "/recover", "/security", "/settings", "/privacy", "/policies", "/help", "/notifications", "/friends", "/marketplace", "/watch",
    "/gaming",
)
OPAQUE_HOSTS = ("instagram.com", "www.instagram.com", "youtube.com", "www.youtube.com", "youtu.be", "twitter.com", "x.com", "tiktok.com", "www.tiktok.com")
FOLLOW_HOSTS = ("devpost.com", "unstop.com", "eventbrite.com", "lu.ma", "luma.com", "hackathons.ph", "kaggle.com", "gov.ph", "edu.ph")
FACEBOOK_PAGES = ("/events/", "/groups/", "/posts/", "/permalink/")
TRUSTED_AUTHORITY = 60
STRUCTURED_HOSTS = ("devpost.com", "www.devpost.com", "kaggle.com", "www.kaggle.com", "eventbrite.com", "www.eventbrite.com")
SOCIAL_HOSTS = ("facebook.com", "www.facebook.com", "linkedin.com", "www.linkedin.com", "instagram.com", "www.instagram.com")
FORM_AUTHORITY_HOSTS = ("forms.gle", "docs.google.com")
AUTHORITY = {"organizer": 90, "structured": 80, "social": 75, "third_party": 50, "form": 30, "snippet": 20}

NON_ACTIONABLE = ("RESULTS_POST", "WINNER_ANNOUNCEMENT", "PAST_EVENT_RECAP", "NEWS_ARTICLE", "DIRECTORY", "CONFERENCE", "WEBINAR", "JOB_POSTING", "COURSE", "UNRELATED")
RESULT_KINDS = ("RESULTS_POST", "WINNER_ANNOUNCEMENT", "PAST_EVENT_RECAP")
EVENT_KINDS = ("EVENT_ANNOUNCEMENT", "REGISTRATION_OPEN")
WEIGHTS = {"geography": 30, "eligibility": 20, "category": 15, "topic": 10, "actionability": 15, "authority": 5, "lead_time": 5}
TIERS = (("HIGH_PRIORITY", 80), ("RECOMMENDED", 65), ("POSSIBLE", 50))
PREFERRED_CATEGORIES = ("HACKATHON", "BUSINESS_CASE")
PREFERRED_TOPICS = TOPICS
NEARBY_REGIONS = ("cavite", "laguna", "rizal", "bulacan")

PREFIX_WORDS = 24
PREFIX_LEAST = 4
CONTENT_RATIO = 85
CONTENT_DAYS = 180
CONTENT_RECENT = 500
EDITION_GAP_DAYS = 45
TRUSTWORTHY = 0.8
SETTLED_REASONS = ("SEARCH_SNIPPET_ONLY", "LOW_AUTHORITY", "NO_COMPETITION", "NOT_PHILIPPINES_ELIGIBLE", "INTERNATIONAL_ONSITE", "RESULTS_ONLY", "REGISTRATION_CLOSED")
EVENT_STATES = ("EVENT_CREATED", "EVENT_MATCHED", "NOTIFIED", "NOTIFICATION_PENDING", "SUPPRESSED")
DELIBERATE_CHANNELS = ("refresh", "manual")
SETTLED_DAYS, RECHECK_DAYS = 30, 7
RESOLVED_DAYS, UNRESOLVED_DAYS, UNRESOLVED_MOST = 30, 7, 60
DEBOUNCE_MINUTES = 30
ELIGIBILITY_RULES = ("student_only", "university_students_allowed", "professionals_allowed", "philippines_allowed")

ACTION_HINTS = ACTION_TERMS + (
    "register", "registration", "applications open", "application deadline", "apply now", "sign up", "deadline", "prize", "prizes", "stipend", "now open",
    "open for", "submission", "submissions",
)
QUESTION_HINTS = (
    "is there any", "are there any", "any upcoming", "anyone know", "know any", "recommend a", "looking for upcoming", "looking for hackathons",
    "looking for competitions", "saan may", "may hackathon ba", "may competition ba", "meron bang", "pwede po ba", "pwede ba", "meron po ba", "ano po",
    "paano po", "saan po", "kailan po", "sino po", "tanong lang", "ask lang", "pahelp", "help po", "may alam ba", "may alam po",
)
TEAMMATE_HINTS = (
    "looking for teammate", "looking for teammates", "looking for team", "need teammates", "need members", "need a teammate", "slot available",
    "anyone joining", "hanap team", "hanap teammate", "looking for members",
)
JOB_HINTS = (
    "we are hiring", "job opening", "we're hiring", "apply for this role", "internship opening", "internship-eligible", "internship program",
    "internship programme", "internship opportunity", "summer internship", "on-the-job training", "ojt", "now hiring", "career opportunity",
)
TALK_FORMATS = ("hackathon", "hackaton", "case competition", "ideathon", "datathon", "codefest")
TALK_WORDS = ("conference", "webinar", "summit", "symposium", "convention", "congress", "seminar", "masterclass", "bootcamp", "call for papers", "call for abstracts")
LEAD_KINDS = ("question", "question_with_link", "teammate", "recap")

# Words that a competition's name ends in, stops at, or can't consist of.
# longest first
NAME_HEADS = (
    "business case competition", "case competition", "case challenge", "pitch competition", "startup competition", "innovation challenge",
    "hackathon", "hackaton", "ideathon", "datathon", "codefest", "competition", "challenge", "tilt",
)
# words that no name reaches across
ALIAS_CONNECTIVES = ("of", "the", "and", "for", "de", "la", "del", "los", "las", "ng", "sa", "at")
NAME_STOPS = (
    "a", "an", "the", "this", "that", "these", "those", "some", "any", "every", "in", "on", "at", "of", "for", "to", "from", "with", "about", "by",
    "into", "and", "or", "but", "if", "as", "than", "then", "so", "because", "is", "are", "was", "were", "be", "been", "being", "am", "i", "we",
    "you", "he", "she", "it", "they", "me", "us", "them", "my", "our", "your", "his", "her", "its", "their", "joining", "join", "joined", "attend",
    "attending", "attended", "register", "registered", "registering", "participate", "participating", "entering", "looking", "searching", "asking",
    "know", "knows", "recommend", "planning", "upcoming", "next", "last", "recent", "past", "future", "current", "ongoing", "anyone", "someone",
    "everyone", "nobody", "who", "what", "when", "where", "why", "how", "which", "there", "here", "still", "also", "just", "only", "not", "no",
    "yes", "please", "thanks", "hi", "hello", "sa", "ng", "nga", "na", "po", "ba", "may", "meron", "yung", "ang", "mga", "ako", "ka", "siya", "kami",
    "kayo", "sila", "nila", "niya", "namin", "natin", "ito", "iyon", "yan", "dito", "doon", "kung", "kapag", "para", "pero", "ay", "din", "rin",
    "lang", "lamang", "daw", "raw", "pala", "kasi", "naman", "hindi", "wala", "mayroon", "pwede", "puwede", "sana", "baka", "tapos", "ano", "sino",
    "saan", "kailan", "paano", "bakit", "alam", "tanong",
)
# words that tell no name from another
NAME_WEAK = (
    "national", "nationwide", "international", "global", "regional", "local", "annual", "yearly", "online", "virtual", "onsite", "hybrid", "free",
    "open", "student", "students", "college", "university", "school", "youth", "junior", "coding", "code", "programming", "tech", "technology", "it",
    "ai", "data", "big", "great", "good", "best", "first", "second", "third", "new", "another",
)
NAME_REACH, HINT_WINDOW = 4, 40
# fmt: on
