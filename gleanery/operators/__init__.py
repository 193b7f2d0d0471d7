"""Relational operators over harvested documents."""
