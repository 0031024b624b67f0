"""Registered queries over the driver's tables and their SQL counterparts."""

from . import chat, drafts, merges, messages, reviews, scalars, texts, windows  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
