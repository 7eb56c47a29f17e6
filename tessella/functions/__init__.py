"""Predicates over cells."""

from tessella.functions.predicates import cell

__all__ = ["cell"]
