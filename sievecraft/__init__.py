"""Labelled, reproducible sample curation over very large catalogue tables, on Spark."""

from sievecraft.spec import CollectionSpec

__all__ = ["CollectionSpec"]
