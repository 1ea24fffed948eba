"""Structured streaming forms of operators."""
