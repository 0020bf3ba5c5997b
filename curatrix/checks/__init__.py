"""Registered queries with their cross-check SQL, grouped by topic."""

from curatrix.checks.registry import REGISTRY, load_all

__all__ = ["REGISTRY", "load_all"]
