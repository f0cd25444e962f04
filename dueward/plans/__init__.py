"""Pipelines that chain operators and write their results."""
