"""Imports every query module so that the registry is complete."""

from faceoff.plans import (queries_causal, queries_clean, queries_evaluate, queries_history,  # noqa: F401
                           queries_models, queries_players)
from faceoff.plans.registry import ORACLES, QUERIES  # noqa: F401
