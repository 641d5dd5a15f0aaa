"""Structured streaming forms."""
