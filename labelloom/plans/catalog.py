"""All registered queries; importing this module fills the registry."""

from __future__ import annotations

from labelloom.plans import learning, online, tables_and_text  # noqa: F401
from labelloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
