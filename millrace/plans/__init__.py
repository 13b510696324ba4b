"""Whole runs: pipelines over a source, and traffic scenarios."""
