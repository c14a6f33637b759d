"""Constants and parameters.

A plain dataclass replaces a config loader: every operator takes its
parameters explicitly and defaults to the values below.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES: these must equal the behaviour being reproduced (labels,
# thresholds, weights, keyword lists, language names).  Keep them as written.
# ---------------------------------------------------------------------------

INTENT_CATEGORIES = [
    "billing",
    "technical_support",
    "account",
    "general_inquiry",
    "complaint",
    "feedback",
]

URGENCY_LEVELS = ["low", "medium", "high", "critical"]

SUPPORTED_LANGUAGES = [
    "en", "es", "fr", "de", "pt", "it", "nl", "pl", "ru", "zh",
    "ja", "ko", "ar", "hi", "th", "vi", "id", "tr", "sv", "da",
]

LANGUAGE_NAMES = {
    "en": "English",
    "es": "Spanish",
    "fr": "French",
    "de": "German",
    "pt": "Portuguese",
    "it": "Italian",
    "nl": "Dutch",
    "pl": "Polish",
    "ru": "Russian",
    "zh": "Chinese",
    "ja": "Japanese",
    "ko": "Korean",
    "ar": "Arabic",
    "hi": "Hindi",
    "th": "Thai",
    "vi": "Vietnamese",
    "id": "Indonesian",
    "tr": "Turkish",
    "sv": "Swedish",
    "da": "Danish",
}

MODEL_NAME = "facebook/bart-large-mnli"
MAX_LENGTH = 512
MAX_REQUEST_CHARS = 5000
CONFIDENCE_THRESHOLD = 0.7
ESCALATION_THRESHOLD = 0.8
LOW_CONFIDENCE_CUTOFF = 0.7

# Urgency blend weights and level cut points.
RULE_WEIGHT = 0.7
ML_WEIGHT = 0.2
CONFIDENCE_WEIGHT = 0.1
DEFAULT_ML_SCORE = 0.5
LEVEL_CRITICAL = 0.9
LEVEL_HIGH = 0.65
LEVEL_MEDIUM = 0.35
RULE_SCORES = {"critical": 1.0, "high": 0.7, "medium": 0.4, "none": 0.2}

# Keyword set of the shipped configuration (used by default).
CONFIG_KEYWORDS = {
    "critical": ["urgent", "emergency", "down", "broken", "asap"],
    "high": ["important", "immediately", "help"],
    "medium": ["question", "how to", "need", "want", "would like"],
}

# Built-in keyword set, used per level only where a configuration lists none.
BUILTIN_KEYWORDS = {
    "critical": ["urgent", "emergency", "down", "broken", "asap", "immediately",
                 "critical", "outage", "not working"],
    "high": ["important", "help", "problem", "issue", "error", "failed",
             "cannot", "unable"],
    "medium": ["question", "how to", "need", "want", "would like"],
}

# Per-language keywords (critical and high only), applied on top of the
# language-independent ones when the ticket language matches.
MULTILINGUAL_KEYWORDS = {
    "es": {
        "critical": ["urgente", "emergencia", "caído", "roto"],
        "high": ["importante", "ayuda", "problema", "error"],
    },
    "fr": {
        "critical": ["urgent", "urgence", "panne", "cassé"],
        "high": ["important", "aide", "problème", "erreur"],
    },
    "de": {
        "critical": ["dringend", "notfall", "ausgefallen", "kaputt"],
        "high": ["wichtig", "hilfe", "problem", "fehler"],
    },
    "pt": {
        "critical": ["urgente", "emergência", "fora do ar", "quebrado"],
        "high": ["importante", "ajuda", "problema", "erro"],
    },
}

RULE_LEVEL_ORDER = ["critical", "high", "medium"]
LANGUAGE_RULE_LEVEL_ORDER = ["critical", "high"]

REASON_ESCALATED = "auto-escalated due to high urgency"
REASON_STANDARD = "standard priority"

DEFAULT_CUSTOMER_NAME = "Valued Customer"
DEFAULT_TICKET_ID = "N/A"
HIGH_URGENCY_VARIANT = "high_urgency"
DEFAULT_VARIANT = "default"

# ---------------------------------------------------------------------------


def keyword_rules(config_keywords: dict | None = None) -> list[tuple]:
    """Flatten the effective rules into (rule_order, level, keyword, language).

    ``config_keywords`` overrides per level; a level it does not list falls
    back to the built-in list.  Order: language-independent rules by level
    (critical, high, medium), then per-language rules by language, level.
    The per-ticket trigger list keeps this order.
    """
    cfg = CONFIG_KEYWORDS if config_keywords is None else config_keywords
    rows: list[tuple] = []
    for level in RULE_LEVEL_ORDER:
        kws = cfg.get(level)
        if kws is None:
            kws = BUILTIN_KEYWORDS[level]
        for kw in kws:
            rows.append((len(rows), level, kw, None))
    for lang, levels in MULTILINGUAL_KEYWORDS.items():
        for level in LANGUAGE_RULE_LEVEL_ORDER:
            for kw in levels.get(level, []):
                rows.append((len(rows), level, kw, lang))
    return rows


@dataclass(frozen=True)
class Settings:
    """Parameters shared by the jobs; defaults as above."""

    intent_categories: list = field(default_factory=lambda: list(INTENT_CATEGORIES))
    max_length: int = MAX_LENGTH
    confidence_threshold: float = CONFIDENCE_THRESHOLD
    escalation_threshold: float = ESCALATION_THRESHOLD
    fallback_language: str = "en"
    model_name: str = MODEL_NAME
