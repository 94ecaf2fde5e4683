"""Importing this module registers every query."""

from citefold.plans import audits, campaign, checks, evaluation, retrieval, text  # noqa: F401
from citefold.plans.registry import ORACLES, QUERIES  # noqa: F401
