"""Registered queries and their oracle SQL."""

from __future__ import annotations

from . import access, judge, search
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "access", "judge", "search"]
