"""Relational operators over project records."""
