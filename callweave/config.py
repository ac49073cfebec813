"""Values that decide results: label domains, thresholds, weights, patterns.

Every operator takes these as parameters; the values here are the defaults.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: label domains -------------------------------------------

AGENT = "AGENT"
CUSTOMER = "CUSTOMER"
UNKNOWN = "UNKNOWN"

SENTIMENT_SCORES = {"positive": 1, "neutral": 0, "negative": -1}
EMOTIONS = ["sadness", "joy", "love", "anger", "fear", "surprise"]
NEGATIVE_EMOTIONS = ["anger", "fear", "sadness"]
INTENTS = [
    "ACCOUNT", "CANCEL", "CONTACT", "DELIVERY", "FEEDBACK", "INVOICE",
    "ORDER", "PAYMENT", "REFUND", "SHIPPING", "SUBSCRIPTION",
]
ENTITY_TYPES = [
    "PERSON", "ORGANIZATION", "LOCATION", "PRODUCT", "DATE", "MONEY",
    "ORDER_ID", "ACCOUNT_ID", "INVOICE_ID", "PHONE", "EMAIL",
]
PII_TYPES = ["PERSON", "PHONE", "EMAIL", "ACCOUNT_ID", "ORDER_ID", "INVOICE_ID"]

# outcome -> (resolution, satisfaction, escalation)
OUTCOMES = {
    "RESOLVED_SATISFIED": ("Resolved", "Satisfied", "No"),
    "RESOLVED_NEUTRAL": ("Resolved", "Neutral", "No"),
    "PARTIALLY_RESOLVED": ("Partially Resolved", "Neutral", "No"),
    "UNRESOLVED_DISSATISFIED": ("Unresolved", "Dissatisfied", "No"),
    "UNRESOLVED_ESCALATED": ("Unresolved", "Dissatisfied", "Yes"),
}

# coarse types of a public entity corpus -> our types; everything else is O
CORPUS_TYPE_MAP = {
    "person": "PERSON",
    "organization": "ORGANIZATION",
    "location": "LOCATION",
    "product": "PRODUCT",
}
# labels of a public statistical tagger -> our types; everything else is dropped
TAGGER_TYPE_MAP = {
    "PERSON": "PERSON",
    "ORG": "ORGANIZATION",
    "GPE": "LOCATION",
    "LOC": "LOCATION",
    "PRODUCT": "PRODUCT",
    "DATE": "DATE",
    "MONEY": "MONEY",
}

# --- Fixed values: feature names -------------------------------------------

BUSINESS_FEATURES = [
    "num_turns",
    "num_customer_turns",
    "num_agent_turns",
    "conversation_duration_seconds",
    "avg_customer_utterance_length",
    "first_customer_sentiment_score",
    "last_customer_sentiment_score",
    "mean_customer_sentiment_score",
    "sentiment_trend",
    "negative_sentiment_turn_count",
    "negative_sentiment_fraction",
    "negative_emotion_count",
    "anger_or_frustration_present",
    "supervisor_request_mentioned",
    "transfer_mentioned",
    "repeated_complaint_signal",
    "ends_on_negative_sentiment",
]

CONVERSATION_FEATURES = [
    "num_turns",
    "num_customer_turns",
    "num_agent_turns",
    "avg_utterance_length",
    "customer_avg_sentiment_score",
    "customer_negative_emotion_fraction",
    "num_entities",
    "ends_on_negative_sentiment",
]

FEATURE_DISPLAY = {
    "negative_sentiment_fraction": "High proportion of negative customer sentiment",
    "negative_emotion_count": "Multiple negative-emotion customer turns",
    "anger_or_frustration_present": "Anger or frustration detected",
    "supervisor_request_mentioned": "Customer requested a supervisor",
    "transfer_mentioned": "Call was transferred",
    "repeated_complaint_signal": "Repeated complaints in the conversation",
    "ends_on_negative_sentiment": "Conversation ends on negative sentiment",
    "sentiment_trend": "Sentiment worsened during the call",
    "conversation_duration_seconds": "Unusually long conversation",
}

# a factor counts as active when `value <op> threshold`; others never do
ACTIVE_RULES = {
    "anger_or_frustration_present": (">=", 1.0),
    "supervisor_request_mentioned": (">=", 1.0),
    "transfer_mentioned": (">=", 1.0),
    "repeated_complaint_signal": (">=", 1.0),
    "ends_on_negative_sentiment": (">=", 1.0),
    "negative_sentiment_fraction": (">=", 0.5),
    "negative_emotion_count": (">=", 1.0),
    "conversation_duration_seconds": (">=", 60.0),
    "sentiment_trend": ("<=", -1.0),
}

# --- Fixed values: patterns (Unicode classes throughout, hence the U flag) ---

EMAIL_PATTERN = r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
PHONE_PATTERN = r"(?U)(?<!\w)(\+?\d{1,2}[\s.-]?)?(\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4})(?!\w)"
MONEY_PATTERN = r"(?U)\$\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?\b"
INVOICE_PATTERN = r"(?iU)\bINV-\d{4}-\d{3,6}\b"
ACCOUNT_PATTERN = r"(?iU)\b(?:ACC\d{5,8}|A-\d{4,8})\b"
ORDER_PATTERN = r"(?iU)\bORD-\d{5,8}\b"
ORDER_KEYWORD_PATTERN = r"(?iU)\border\b"
BARE_NUMBER_PATTERN = r"(?U)\b\d{4,8}\b"
ORDER_WINDOW_CHARS = 30

# priority order: a later match never displaces an earlier one.
# third field: what every match contains, tested first because it is cheap
FOUR_DIGITS = r"(?U)\d{4}"
ENTITY_PATTERNS = [
    ("EMAIL", EMAIL_PATTERN, "@"),
    ("INVOICE_ID", INVOICE_PATTERN, FOUR_DIGITS),
    ("ACCOUNT_ID", ACCOUNT_PATTERN, FOUR_DIGITS),
    ("ORDER_ID", ORDER_PATTERN, FOUR_DIGITS),
    ("PHONE", PHONE_PATTERN, FOUR_DIGITS),
    ("MONEY", MONEY_PATTERN, "$"),
]

SUPERVISOR_PATTERN = r"(?iU)\b(manager|supervisor|someone (else|in charge))\b"
TRANSFER_PATTERN = r"(?iU)\b(transfer(ring)?|connect(ing)? you)\b"
# longest text either of the two can match: "someone in charge"
KEYWORD_MAX_CHARS = 17

TOKEN_PATTERN = r"(?U)\w+(?:[-/.]\w+)*|\S"

# --- Fixed values: thresholds and weights ----------------------------------

RISK_LOW_MAX = 0.35
RISK_MEDIUM_MAX = 0.65
TOP_FACTORS = 4
TURN_GAP_MS = 400

SCORE_WEIGHTS = {
    "resolution_rate": 0.25,
    "non_escalation_rate": 0.25,
    "sentiment_improvement": 0.25,
    "satisfaction": 0.25,
}


@dataclass(frozen=True)
class AudioConfig:
    # Fixed values
    target_sample_rate: int = 16000
    target_channels: int = 1
    supported_formats: tuple[str, ...] = ("wav", "flac", "mp3")
    flagged_formats: tuple[str, ...] = ("ogg", "m4a", "aac", "wma")
    min_duration_seconds: float = 0.3
    max_duration_seconds: float = 600.0
    target_peak_dbfs: float = -3.0


@dataclass(frozen=True)
class VadConfig:
    # Fixed values
    frame_ms: int = 30
    silence_threshold_db: float = -40.0
    min_silence_ms: int = 300
    min_speech_ms: int = 200
    pad_ms: int = 100

    @property
    def min_silence_frames(self) -> int:
        return max(1, self.min_silence_ms // self.frame_ms)

    @property
    def min_speech_frames(self) -> int:
        return max(1, self.min_speech_ms // self.frame_ms)


@dataclass(frozen=True)
class SegmentConfig:
    # Fixed values, in milliseconds
    merge_gap_ms: float = 300
    min_segment_ms: float = 500
    max_segment_ms: float = 12000


@dataclass(frozen=True)
class ChunkConfig:
    # Fixed values, in milliseconds
    chunk_ms: float = 30000
    overlap_ms: float = 2000
    snap_to_silence: bool = True


@dataclass(frozen=True)
class Defaults:
    audio: AudioConfig = field(default_factory=AudioConfig)
    vad: VadConfig = field(default_factory=VadConfig)
    segment: SegmentConfig = field(default_factory=SegmentConfig)
    chunk: ChunkConfig = field(default_factory=ChunkConfig)


DEFAULTS = Defaults()
