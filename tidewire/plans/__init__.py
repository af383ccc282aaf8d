"""Queries over the news domain, by module."""

from . import analytics, relational, scalars, service, stories  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
