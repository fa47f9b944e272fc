"""Text privacy and text safety on Spark DataFrames."""

from textveil.constants import LABELS_DE, SCRUB_RULES
from textveil.operators.anonymize import DenyList, Recognizer, anonymize, audit_counts, detect
from textveil.operators.classify import classify, relevance, score
from textveil.operators.scrub import scrub

__all__ = [
    "DenyList",
    "LABELS_DE",
    "Recognizer",
    "SCRUB_RULES",
    "anonymize",
    "audit_counts",
    "classify",
    "detect",
    "relevance",
    "score",
    "scrub",
]
