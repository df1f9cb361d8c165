"""Imports every plan module so that its queries register."""

from slipway.plans import base, decisions, history, live  # noqa: F401
from slipway.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
