"""Word lists, patterns and the registry that define results.

``Lexicon`` gathers the lists that operators take as a parameter; ``ENGLISH`` has
the fixed values, ``CORPUS`` words that occur in the synthetic driver tables.
"""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values.
CLICKBAIT = ["you won'?t believe", "what happened next", "shocking", "this is why", "breaking", "watch", "secret", "exposed", "must see"]
SENSATIONAL = ["hoax", "conspiracy", "miracle", "cover[- ]?up", "explosive", "censored", "guaranteed", "unbelievable", "panic", "traitor"]
EMOTIONAL = ["outrage", "terrifying", "horrific", "furious", "fear", "angry", "hate", "disaster", "devastating", "chaos", "crisis", "betrayal", "urgent", "warning"]
POSITIVE = ["verified", "confirmed", "official", "credible", "evidence", "stable", "accurate", "improved", "clear", "valid"]
NEGATIVE = ["fraud", "lie", "fake", "scam", "corrupt", "manipulated", "danger", "threat", "false", "misleading"]
ORG_SUFFIXES = ["Inc", "Corp", "Corporation", "University", "Agency", "Department", "Ministry", "Committee", "Council", "Bank", "Institute", "Office", "Commission", "Senate", "House", "Court"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
UNSUPPORTED = ["anonymous", "without evidence", "they don't want you to know"]
LANGUAGES = [
    ("en", ["the", "and", "of", "to", "in", "that", "with", "for", "on", "said", "from"]),
    ("es", ["de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por"]),
    ("fr", ["de", "la", "le", "les", "des", "dans", "pour", "avec", "est", "sur", "une"]),
    ("de", ["der", "die", "das", "und", "ist", "mit", "den", "von", "für", "auf", "ein"]),
    ("it", ["di", "che", "la", "il", "per", "con", "del", "una", "sono", "nel", "della"]),
    ("pt", ["de", "do", "da", "que", "em", "para", "com", "uma", "por", "não", "dos"]),
]
ACCENTED = "áéíóúñàèìòùâêîôûäëïöüç"
TOPICS = [
    ("politics", "Politics", ["president", "minister", "government", "senate", "congress", "election", "policy", "administration", "parliament", "campaign"]),
    ("economy", "Business", ["market", "economy", "stock", "inflation", "budget", "trade", "bank", "finance", "investment", "tax"]),
    ("technology", "Technology", ["technology", "software", "ai", "cyber", "data", "internet", "platform", "chip", "startup", "app"]),
    ("health", "Health", ["health", "disease", "doctor", "hospital", "vaccine", "medical", "treatment", "patient", "virus", "clinical"]),
    ("science", "Science", ["research", "scientist", "study", "laboratory", "discovery", "experiment", "university", "analysis", "evidence", "report"]),
    ("world", "World", ["international", "foreign", "country", "border", "embassy", "diplomatic", "global", "nation", "world", "leaders"]),
    ("security", "Security", ["military", "defense", "war", "attack", "security", "weapon", "troops", "conflict", "terror", "missile"]),
    ("justice", "Legal", ["court", "judge", "justice", "lawsuit", "trial", "legal", "attorney", "ruling", "crime", "investigation"]),
    ("environment", "Environment", ["climate", "environment", "wildfire", "carbon", "pollution", "storm", "energy", "temperature", "emissions", "weather"]),
    ("society", "Society", ["education", "community", "school", "media", "culture", "rights", "protest", "family", "social", "public"]),
]
STYLES = {
    "analytical": ["according", "data", "report", "analysis", "evidence", "officials", "documents", "study", "research", "numbers"],
    "opinionated": ["should", "must", "clearly", "obviously", "perhaps", "believe", "think", "opinion", "argue", "seems"],
    "conversational": ["you", "your", "we", "our", "let's", "can't", "don't", "won't", "what", "why"],
}
EMOTIONS = [
    ("trust", ["verified", "confirmed", "reliable", "trusted", "official", "documented", "credible", "consistent"]),
    ("fear", ["fear", "panic", "threat", "danger", "terrifying", "risk", "warning", "crisis"]),
    ("anger", ["angry", "furious", "outrage", "betrayal", "corrupt", "traitor", "rage", "attack"]),
    ("sadness", ["sad", "grief", "loss", "mourning", "tragic", "devastating", "sorrow", "heartbreaking"]),
    ("joy", ["joy", "success", "win", "hope", "improved", "celebrate", "benefit", "progress"]),
    ("surprise", ["shocking", "surprising", "unexpected", "suddenly", "explosive", "astonishing", "unbelievable"]),
    ("disgust", ["disgusting", "revolting", "scam", "fraud", "dirty", "corrupt", "vile", "toxic"]),
]
STOP_WORDS = "a an and are as at be by for from has have in into is it of on or that the their this to was were with will would about after before been being over under your they them than then there what when where which who why how".split()
CONTENT_STOP_WORDS = [*STOP_WORDS, "said", "also", "just", "more", "most", "very"]
TRAINING_STOP_WORDS = "also could would there their about after before while which where when those these".split()
ENGLISH_MARKERS = "the and of to in that with for on said from after according officials".split()
CLAIM_VERBS = "is are was were said says claim claims reported announced confirmed caused approved denied won lost".split()
CONTRADICTIONS = ["no evidence", "false claim", "false claims", "not true", "unfounded", "misleading", "debunked", "denied", "deny", "refuted", "hoax"]
SUPPORTS = ["confirmed", "announced", "reported", "according to", "officials said", "statement said", "evidence shows"]
FAKE_PATTERNS = ["(?:shocking|hoax|miracle|secret|exposed|conspiracy|cover[- ]?up)", "you won'?t believe", "anonymous sources claim", "without evidence", "guaranteed cure"]
REAL_PATTERNS = ["according to", "published", "reported", "confirmed", "officials?", "study"]
SUSPICIOUS_HOST_WORDS = "newsflash patriot truth rumor viral daily freedom insider".split()
SUSPICIOUS_TLDS = "buzz click top xyz info".split()
SCRIPT_SIGNALS = ["fetch-start", "headers", "function(", "window.", "webpack", "push(", "this.params", "xmlhttprequest"]
LISTING_SIGNALS = ["breaking news", "latest top stories", "more to explore", "home news sport", "newsletters", "live weather"]
BOILERPLATE_STARTS = ["advertisement", "home news", "sponsored", "photo", "image", "caption", "read more", "related", "watch", "share", "follow", "subscribe", "sign up", "cookie", "privacy", "terms"]
BOILERPLATE_ANYWHERE = ["all rights reserved", "click here"]
NON_ARTICLE_BLOCKS = "script style noscript nav header footer aside figure picture video iframe form".split()
#: domain, aliases, badge, trust score, political bias, country, reliability
REGISTRY = [
    ("reuters.com", ["reuters"], "Trusted", 95, "Center", "United Kingdom / Global", "High"),
    ("apnews.com", ["ap", "associatedpress"], "Trusted", 94, "Center", "United States", "High"),
    ("bbc.com", ["bbc", "bbc.co.uk"], "Trusted", 92, "Center", "United Kingdom", "High"),
    ("npr.org", ["npr"], "Trusted", 90, "Lean Left", "United States", "High"),
    ("theguardian.com", ["guardian", "theguardian"], "Trusted", 88, "Lean Left", "United Kingdom", "High"),
    ("nytimes.com", ["nyt", "nytimes"], "Trusted", 89, "Lean Left", "United States", "High"),
    ("washingtonpost.com", ["washingtonpost", "wapo"], "Trusted", 88, "Lean Left", "United States", "High"),
    ("wsj.com", ["wallstreetjournal", "wsj"], "Trusted", 90, "Center Right", "United States", "High"),
    ("pbs.org", ["pbs"], "Trusted", 89, "Lean Left", "United States", "High"),
    ("dw.com", ["dw"], "Trusted", 87, "Center", "Germany", "High"),
    ("aljazeera.com", ["aljazeera"], "Trusted", 85, "Lean Left", "Qatar / Global", "High"),
    ("usatoday.com", ["usatoday"], "Medium", 76, "Center", "United States", "Mostly High"),
    ("cnn.com", ["cnn"], "Medium", 73, "Lean Left", "United States", "Mixed to High"),
    ("foxnews.com", ["foxnews", "fox"], "Medium", 68, "Lean Right", "United States", "Mixed"),
    ("newsweek.com", ["newsweek"], "Medium", 66, "Center", "United States", "Mixed"),
    ("independent.co.uk", ["independent"], "Medium", 64, "Lean Left", "United Kingdom", "Mixed"),
    ("beforeitsnews.com", ["beforeitsnews"], "Suspicious", 18, "Conspiracy / Mixed", "United States", "Low"),
    ("naturalnews.com", ["naturalnews"], "Suspicious", 16, "Alternative Health / Conspiracy", "United States", "Low"),
    ("newspunch.com", ["yournewswire", "newspunch"], "Suspicious", 15, "Conspiracy / Mixed", "United Kingdom", "Low"),
    ("worldnewsdailyreport.com", ["worldnewsdailyreport"], "Suspicious", 12, "Satire / Hoax", "Unknown", "Low"),
    ("realrawnews.com", ["realrawnews"], "Suspicious", 10, "Far Right / Conspiracy", "United States", "Low"),
    ("thelastlineofdefense.org", ["lastlineofdefense"], "Suspicious", 9, "Satire / Hoax", "United States", "Low"),
]
TRUST_WEIGHTS = {"ml_probability": 1.6, "clickbait_detection": 0.9, "domain_reputation": 1.1, "writing_quality": 1.0, "sensational_language": 1.0, "emotional_language": 0.7, "author_presence": 0.5, "publication_date": 0.5, "article_length": 0.6, "source_reliability": 1.2}
#: What is said of a signal where it is strong, and where it is weak; the reputation and reliability of a source have texts of their own.
TRUST_TEXTS = {
    "ml_probability": ("The ML model strongly favors a legitimate article pattern", "The ML model assigns low credibility to the article language"),
    "clickbait_detection": ("The headline avoids clickbait cues", "The headline uses clickbait-style phrasing"),
    "writing_quality": ("Good writing quality", "Writing quality appears weak or inconsistent"),
    "sensational_language": ("Little sensational language detected", "Sensational language reduces trust"),
    "emotional_language": ("Neutral language", "Emotional language reduces credibility"),
    "author_presence": ("Author information is available", "No author is provided"),
    "publication_date": ("Publication date is available", "Publication date is missing"),
    "article_length": ("Article length provides enough context", "Article length is too short or atypical"),
}
RULE_TITLES = {"clickbait_title": "Clickbait title", "excessive_capitalization": "Excessive capitalization", "excessive_punctuation": "Excessive punctuation", "emotional_language": "Emotional language", "sensational_phrases": "Sensational phrases", "suspicious_domain": "Suspicious domain", "article_length": "Article length", "missing_author": "Missing author", "missing_publication_date": "Missing publication date"}
LANGUAGE_NAMES = {"en": "English", "es": "Spanish", "fr": "French", "de": "German", "it": "Italian", "pt": "Portuguese"}
RULE_WEIGHTS = {"clickbait_title": 1.1, "excessive_capitalization": 0.9, "excessive_punctuation": 0.8, "emotional_language": 1.0, "sensational_phrases": 1.2, "suspicious_domain": 1.15, "article_length": 0.75, "missing_author": 0.8, "missing_publication_date": 0.8}


@dataclass(frozen=True)
class Lexicon:
    positive: tuple[str, ...] = tuple(POSITIVE)
    negative: tuple[str, ...] = tuple(NEGATIVE)
    emotional: tuple[str, ...] = tuple(EMOTIONAL)
    clickbait: tuple[str, ...] = tuple(CLICKBAIT)
    sensational: tuple[str, ...] = tuple(SENSATIONAL)
    unsupported: tuple[str, ...] = tuple(UNSUPPORTED)
    emotions: tuple[tuple[str, tuple[str, ...]], ...] = tuple((k, tuple(v)) for k, v in EMOTIONS)
    topics: tuple[tuple[str, str, tuple[str, ...]], ...] = tuple((k, c, tuple(v)) for k, c, v in TOPICS)
    analytical: tuple[str, ...] = tuple(STYLES["analytical"])
    opinionated: tuple[str, ...] = tuple(STYLES["opinionated"])
    conversational: tuple[str, ...] = tuple(STYLES["conversational"])
    fake: tuple[str, ...] = tuple(FAKE_PATTERNS)
    real: tuple[str, ...] = tuple(REAL_PATTERNS)
    contradictions: tuple[str, ...] = tuple(CONTRADICTIONS)
    supports: tuple[str, ...] = tuple(SUPPORTS)
    claim_verbs: tuple[str, ...] = tuple(CLAIM_VERBS)


ENGLISH = Lexicon()

#: Words of the driver's invented prose, so that queries over it have hits on both sides of each threshold.
CORPUS = Lexicon(
    positive=("the", "der", "las", "les", "thonti"),
    negative=("of", "die", "los", "des", "idiot", "scum"),
    emotional=("idiot", "scum", "stupid", "pathetic", "moron", "loser", "with", "from", "von", "con", "pour", "thth"),
    clickbait=("in the", "to the", "of the", "la"),
    sensational=("idiot", "scum", "stupid", "pathetic", "hate", "that is", "of in"),
    unsupported=("anly", "de la", "and the"),
    emotions=(("trust", ("the", "der", "le")), ("fear", ("of", "die", "la")), ("anger", ("and", "und", "et")), ("joy", ("to", "in", "que"))),
    topics=(("articles", "Grammar", ("the", "der", "die", "las", "les")), ("joins", "Syntax", ("and", "und", "con", "avec")), ("places", "Space", ("from", "into", "von", "dans", "para"))),
    analytical=("that", "with", "und", "que"),
    opinionated=("is", "ist", "es", "est"),
    conversational=("you", "it", "se", "vous"),
    fake=("idiot", "scum", "stupid", "of the"),
    real=("with", "from", "this", "que", "und", "est"),
    contradictions=("of the", "idiot", "is the"),
    supports=("and the", "to the", "in the", "with"),
    claim_verbs=("is", "are", "was", "ist", "est", "es"),
)
