"""Operators for preparing training text, each with its query in :mod:`fieldlens.llm.queries`."""
