"""Relational operators over spans, logs and metrics."""
