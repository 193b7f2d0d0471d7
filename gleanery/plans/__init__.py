"""Declarative pipelines: configuration, versioned index tables, runs."""
