"""All registered queries."""

from talkprint.plans import cleaning, files, fingerprints, rendering, scoring, splitting, training
from talkprint.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "cleaning", "files", "fingerprints", "rendering", "scoring", "splitting", "training"]
