"""Relational operators of frames."""
